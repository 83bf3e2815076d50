"""Each operator on awkward rows and against brute force on the smallest tables."""

import hashlib
import html
import random
import re
import time
import zipfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hubbub.llm import bpe, decontam, html_text, langid, media, near_dedup, packing, pii, quality, repeats, token_store
from hubbub.llm.common import new_path, stored, table

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000 + "end"
SCHEMA = "doc_id long, text string, lang string, score string, spans string, id int, h int, w string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and clashing extra columns."""
    texts = [(1, None), (2, ""), (3, "  \n"), (4, LONG), (5, "a b c"), (6, "a b c"), (7, "A B  C"), (7, "A B  C"), (None, "a b c"), (None, None), (8, "12345 !!"), (9, "mail a@b.co now")]
    return spark.createDataFrame([(i, t, "en" if t else None, "x", "y", 1, 2, "z") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def test_tokens_round_trip(spark, docs):
    from tokenizers import Tokenizer

    rows = token_store.op1_token_store(spark, SF).collect()
    t, start = Tokenizer.from_file(bpe.vocabulary("word_bpe_49k.json")), 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = np.array([*t.encode(docs[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_tokens_odd(spark, odd):
    write = lambda d: token_store.read_tokens(token_store.write_tokens(d, new_path(spark, "t"), bpe.vocabulary("word_bpe_49k.json"), shard_ids=10))
    rows = write(odd).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9] and rows[2].n_tokens == 1
    assert write(odd.where("false")).count() == 0


@pytest.mark.parametrize("ids", [[0], [5] * 3000, [0, 2**32 - 1, 7], list(range(2000)), [1] * 1000 + [50_000] * 24])
def test_blocks(ids):
    x = np.array(ids, np.uint32)
    shard = token_store.Shard(token_store.encode_shard(np.array([1]), np.array([len(x)]), x))
    assert (shard.ids(0, len(x)) == x).all() and (shard.ids(len(x) // 2, len(x)) == x[len(x) // 2 :]).all()


def test_hilbert_curve_visits_neighbours():
    cube = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_keys(cube, 3)
    path = cube[np.argsort(keys)]
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_packing(spark, docs, odd):
    from tokenizers import Tokenizer

    rows = packing.op5_packing(spark, SF).collect()
    at = sorted((r.sequence_id * 2048 + r.offset, r.length) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:])) and at[0][0] == 0
    assert all(r.offset + r.length <= 2048 for r in rows)
    t, sums = Tokenizer.from_file(bpe.vocabulary("byte_bpe_50k.json")), Counter()
    ids = {d: np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4") for d, text in docs.items()}
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == sums[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        sums[r.doc_id] += r.length
    assert sums == {d: len(x) for d, x in ids.items()}
    assert packing.pack(odd, bpe.vocabulary("byte_bpe_50k.json")).select("doc_id").distinct().count() == 10
    assert packing.pack(odd.where("false"), bpe.vocabulary("byte_bpe_50k.json")).count() == 0


def test_encoder_is_the_library(docs):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    mixed = ["".join(rng.choices(bpe.WHITE + "abcéñ×÷AZ漢字1.,'\"-|<>=&\x1c\u200b\u0338\u0301😀", k=rng.randrange(30))) for _ in range(4000)]
    texts = [*list(docs.values())[:40], "a  b\t\t c\n\n", "\x1c x \x85y <|endoftext|> z", "  ", "é é it's  ", "", "x's; don't, we'll.\n\nTom\n Tim\tTom\n", *mixed]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t, e = Tokenizer.from_file(bpe.vocabulary(name)), bpe.encoder(bpe.vocabulary(name))
        ids, counts = e.ids(pa.array(texts), 7)
        ends = np.cumsum(counts)
        for text, end, n in zip(texts, ends, counts, strict=True):
            assert ids[end - n : end].tolist() == [*t.encode(text, add_special_tokens=False).ids, 7], text
    assert [b.num_rows for b in bpe.chunks([pa.record_batch({"i": [1] * 4, "t": ["", "x" * 9, "y", ""]})], most=4)] == [1, 1, 2]


def test_language(spark, odd):
    rows = langid.op2_langid(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    got = [r.lang_pred for r in langid.predict(odd, langid.fit(odd)).where("doc_id in (1, 2, 5, 8)").orderBy("doc_id").collect()]
    assert got == ["und", "und", "en", "und"]
    assert langid.predict(odd, None).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(odd.where("false"), langid.fit(odd.where("false"))).count() == 0


def test_language_by_brute_force(spark):
    """Whole documents frequencies, vectors and cosines once more, with plain counting, from the fitted centroids."""
    docs = table(spark, SF, "documents").where("lang is not null")
    model, rows = langid.fit(docs), docs.collect()
    grams = lambda t: Counter(w[i : i + 3] for w in [b" " + b" ".join(re.findall(rb"[a-z\x80-\xff]+", t.lower().encode())) + b" "] for i in range(len(w) - 2))
    place = lambda g: (int.from_bytes(g, "big") * 2654435761 % 2**32) >> 20
    bags = {r.doc_id: {} for r in rows}
    for r in rows:
        for g, n in grams(r.text).items():
            bags[r.doc_id][place(g)] = bags[r.doc_id].get(place(g), 0) + n
    teach = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    df = Counter(g for r in teach for g in bags[r.doc_id])
    idf = np.array([np.log((1 + len(teach)) / (1 + df[g])) + 1 for g in range(langid.SIZE)])
    assert np.allclose(idf, model.idf)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for r in rows:
        v = np.zeros(langid.SIZE)
        for g, n in bags[r.doc_id].items():
            v[g] = (1 + np.log(n)) * idf[g]
        if v.any():
            cosines = model.centres @ (v / np.linalg.norm(v))
            assert abs(got[r.doc_id].score - cosines.max()) < 1e-4
            near = {model.langs[o] for o, c in zip(model.owner, cosines, strict=True) if c > cosines.max() - 1e-5}
            assert got[r.doc_id].lang_pred in near
    own = {langid.spherical_kmeans(np.eye(3, dtype=np.float32), 3).argmax(1).tobytes()}
    assert len(own) == 1


def test_language_of_copies(spark):
    texts = {"en": "the house and the garden", "de": "das haus und der garten"}
    docs = spark.range(6000).selectExpr("id doc_id", "if(id % 2 = 0, 'en', 'de') lang").join(spark.createDataFrame(list(texts.items()), "lang string, text string"), "lang")
    got = langid.predict(docs, langid.fit(docs, sample=100)).join(docs, "doc_id").groupBy("lang", "lang_pred").count().collect()
    assert {(r.lang, r.lang_pred, r["count"]) for r in got} == {("en", "en", 3000), ("de", "de", 3000)}


def test_quality(spark, odd):
    sf = "/root/testdata/sf0.1"
    rows = quality.op10_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.98 * len(rows)
    odd = odd.withColumnRenamed("score", "points")
    assert {r.score for r in quality.score(odd, None).collect()} == {0.5}
    with pytest.raises(ValueError, match="points"):
        quality.score(odd, None, "points")
    kept = quality.score(odd, None, "own score").drop("own score")
    assert Counter(map(tuple, kept.collect())) == Counter(map(tuple, odd.collect())) and quality.score(odd.where("false"), None).count() == 0
    model = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert quality.score(odd, model).where("score between 0 and 1").count() == 12
    assert quality.fit(odd, table(spark, SF, "labels").where("false")) is None


def _text(page):
    return html_text.main_text(page, html_text.Weights({"p": 1.0, "article": 1.0, "main": 1.0}, {}, {"a": -1.0}))


WORDS = ("plain words of the article " * 6).strip()


def test_quality_by_brute_force(spark, docs):
    """The same sample, fitted by numpy in one piece: ridge weights from the stacked rows, isotonic by its min-max form."""
    model = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in docs}
    role = {r.doc_id: r.role for r in spark.createDataFrame([(d,) for d in labels], "doc_id long").selectExpr("doc_id", "pmod(xxhash64(doc_id, 1), 4) role").collect()}
    stats = {d: quality.statistics(docs[d]) for d in labels}
    every = np.array(list(stats.values()))
    assert np.allclose(model.mean, every.mean(0)) and np.allclose(model.scale, np.where(every.std(0) < 1e-9, 1, every.std(0)))
    taught = [d for d in labels if role[d]]
    x = quality.fourier(np.array([stats[d] for d in taught]), model.mean, model.scale)
    penalty = np.diag([quality.RIDGE] * quality.FEATURES + [1e-9])
    weights = np.linalg.solve(x.T @ x + penalty, x.T @ np.array([labels[d] for d in taught]))
    assert np.allclose(x @ model.weights, x @ weights, atol=1e-6)
    rest = [d for d in labels if not role[d]]
    raw = model.raw(np.array([stats[d] for d in rest]))
    y = np.array([labels[d] for d in rest], float)[np.argsort(raw)]
    fitted = [max(min(y[i : j + 1].mean() for j in range(k, len(y))) for i in range(k + 1)) for k in range(len(y))]
    assert np.allclose(sorted(set(np.round(fitted, 9))), sorted(set(np.round(model.values, 9))))


def test_html():
    page = "<html><head><title>t</title><script>var a='<p>x</p>'</script></head><body><nav><a href=/>Home</a></nav><article><h1>Title &amp; more</h1><p>One  <b>bo</b>ld\n text<p>Two &lt;3<div class='share'>Share me</div><div id=comments><p>first!</p></div></article><footer>(c)</footer>"
    assert _text(page) == "Title & more\n\nOne bold text\n\nTwo <3"
    assert _text(None) == "" == _text("") == _text("<nav>x</nav>")
    assert _text(f"<body><div class=menu><a>a</a><a>b</a></div><p>{WORDS}</p><aside>other</aside>") == WORDS


@pytest.mark.parametrize(
    "page",
    [
        "<div class='has-sidebar'><article><p>{}</p></article></div>",
        "<body class=comments-open><div class='content-sidebar-wrap sidebar'><main><p>{}</p></main></div><footer>x</footer>",
        "<div class=tag-tags><article class='post tag-tags'>{}</article></div>",
        "<form id=aspnetForm><div><article><p>{}</article></div><nav>x</nav></form>",
        "<form><p>{}</p></form>",
        "<article><p>{}</p></article><section class=responses><article class=comment><p>{}{}</p></article></section>",
        "<article><p>{}</p><section id=comments><article>{}{}{}</article></section></article>",
        "<article><p>{}</p><form><p>Your mail <input></p></form></article>",
        "<ul><li class=ad>buy<li>{}</ul>",
        "<header><p>Site</p></header><p>{}</p>",
    ],
)
def test_html_layouts(page):
    assert _text(page.replace("{}", WORDS + " ")) == WORDS


def test_html_keeps_all_of_the_text():
    assert _text(f"<p>{WORDS} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> end") == f"{WORDS} x=2 end"
    assert _text(f"<p><a title=John's>{WORDS} it's</a> end") == f"{WORDS} it's end"
    assert _text(f"<p>{WORDS} a < b, c <b unclosed") == f"{WORDS} a < b, c <b unclosed"
    assert _text(f"<p>{WORDS} <!-- gone -->here<script>no</script> too") == f"{WORDS} here too"


@pytest.mark.parametrize("part", ["<a ", "<div>", "</span>", "<p><b>", "</p>", '<a t="', "<a x='y", "=", "<script>", "</script ", "<!--", "<![CDATA[", "&", "< "])
def test_html_is_linear(part):
    start = time.process_time()
    for page in (part * 60_000, "<script>" + part * 60_000, "<div>" * 30_000 + part * 60_000):
        _text(page)
    assert time.process_time() - start < 20


def test_html_best_region_is_the_best_of_all():
    rng = random.Random(4)
    weights = html_text.Weights({"p": 0.5, "div": -0.2}, {"x": -4.0}, {"a": -3.0, "p": -1.0, "li": -0.5})
    for _ in range(300):
        page = "".join(rng.choice(["<p>", "</p>", "<div>", "</div>", "<div class=x>", "<a>", "</a>", "<li>", "one two ", "three ", "<article>", "</article>"]) for _ in range(40))
        found, elements = html_text.blocks(page)
        word = weights.mark(elements)
        scores = [html_text.score(b, elements, word, weights) for b in found]
        ranges = [(i, j) for i in range(len(found)) for j in range(i, len(found) + 1)]
        total = lambda i, j: sum(w + t for w, t in scores[i:j]) - (scores[i][1] if i < j else 0)
        best = max((total(i, j) for i, j in ranges), default=0)
        texts = {"\n\n".join(b.text for b in found[i:j] if b.n and not elements[b.element].aside) for i, j in ranges if abs(total(i, j) - best) < 1e-9}
        assert html_text.main_text(page, weights) in texts | ({""} if best <= 0 else set())


def test_html_learns_names(spark):
    page = "<body><div class=boxes>{0} off</div><div class=menu><article><p>{1}</p></article></div><div class=story>{1}</div></body>"
    rows = [(i, f"u{i}", page.format(f"offer {i} " * 9, f"text {i} " * 60)) for i in range(40)]
    pages = spark.createDataFrame([*rows, *rows[:3], (90, None, None), (None, "u", ""), (91, "u", f"<div class=boxes>{WORDS}</div>" + f"<p>{WORDS}</p>" * 2)], "page_id long, url string, html string")
    learned = html_text.learn(pages)
    assert learned.name("boxes") < -2 and learned.name("menu") > 0 and learned.name("sidebar") < -2 and learned.name("other") == 0
    got = html_text.extract(pages.selectExpr("*", "1 text", "2 n_chars", "3 key"), learned).collect()
    assert len(got) == 46 and all(r.n_chars == len(r.text) for r in got)
    texts = {r.page_id: r.text for r in got}
    assert texts[0] == ("text 0 " * 60).strip() and texts[90] == texts[None] == "" and texts[91] == f"{WORDS}\n\n{WORDS}"
    assert html_text.extract(pages.where("false"), html_text.learn(pages.where("false"))).count() == 0


def test_html_query(spark):
    rows = html_text.op3_html(spark, SF).collect()
    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    for r in rows:  # these pages' articles have blocks alone: h1, p, and b and br in them
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = re.split(r"</?(?:h1|p)>", article.replace("<br>", " ").replace("<b>", "").replace("</b>", ""))
        assert r.text == "\n\n".join(x for p in parts if (x := " ".join(html.unescape(p).split())))


@pytest.mark.parametrize("hot", [1024, 2])
def test_repeats(spark, docs, odd, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_CORE", hot)
    seen = Counter(d[i : i + 200] for d in (t.encode() for t in docs.values()) for i in range(len(d) - 199))
    for r in repeats.op4_repeats(spark, SF).collect():
        d = docs[r.doc_id].encode()
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        assert (r.n_bytes, r.n_removed) == (len(d), gone.sum()) and r.kept_sha256 == hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()
    rows = repeats.remove_repeats(odd).collect()
    assert len(rows) == 12 and {r.n_removed for r in rows if r.doc_id == 4} == {len(LONG) - 3}
    assert repeats.remove_repeats(odd.where("false")).count() == 0


def _sets(docs):
    out = {}
    for d, t in docs.items():
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        out[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    return out


def test_near_duplicates(spark, docs, odd):
    sets, parent = _sets(docs), {d: d for d in docs}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    for r in near_dedup.op7_near_dedup(spark, SF).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()}
    assert {(1, 0, 1, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False), (None, 1, None, True)} <= got
    assert near_dedup.near_duplicates(odd.where("false")).count() == 0


def test_near_duplicates_of_a_template(spark, monkeypatch):
    """One band that many unlinked classes share, dealt over blocks: no link is lost or added."""
    monkeypatch.setattr(near_dedup, "PAIR_BLOCK", 7)
    rng = random.Random(5)
    common = [f"c{k}" for k in range(120)]
    texts = {i: " ".join(common + [f"x{rng.randrange(9)}" for _ in range(rng.choice([5, 12, 26, 34]))]) for i in range(150)}
    sets, parent = _sets(texts), {d: d for d in texts}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in texts:
        for b in range(a + 1, 150):
            i = len(sets[a] & sets[b])
            if 100 * i >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {d: root(d) for d in texts} and 1 < len(set(got.values())) < 150


def test_near_duplicate_signatures():
    x = near_dedup.shingles(" ".join(map(str, range(900))))
    y = np.unique(np.concatenate([x[60:], near_dedup.shingles("other " + " ".join(map(str, range(2000, 2060))))]))
    j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((near_dedup.signature(x) == near_dedup.signature(y)).mean() - j) < 0.08


def test_leaks(spark, docs):
    shingle = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
    items = {r.item_id: shingle(r.text.lower().split()) for r in table(spark, SF, "benchmark").collect()}
    want = {}
    for d, t in docs.items():
        s = shingle(t.lower().split())
        own = set(s)
        for i, item in items.items():
            if own & set(item):
                n, a = len(item), Counter(item)
                for k in range(max(1, len(s) - n + 1)):
                    b = Counter(s[k : k + n])
                    shared = sum((a & b).values())
                    want[d, i] = max(want.get((d, i), 0), shared / (n + sum(b.values()) - shared))
    want = {k: v for k, v in want.items() if v >= 0.8}
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.op6_decontam(spark, SF).collect()}
    assert got == pytest.approx(want) and want


def test_leaks_odd(spark, odd):
    bench = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (None, "a b c"), (4, "A B  C")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(odd, bench).collect()}
    assert got == {(d, i) for d in (5, 6, 7) for i in (1, 4)}
    assert decontam.leaks(odd, bench.where("false")).count() == 0 == decontam.leaks(odd.where("false"), bench).count()


def _personal(text):
    out, text = [], text or ""
    patterns = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for kind, pattern in patterns:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if {"ip": lambda: all(int(p) < 256 for p in m[0].split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn, "phone": lambda: 9 <= len(digits) <= 15}.get(kind, lambda: True)():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark, docs, odd):
    for r in pii.op8_pii(spark, SF).collect():
        want = _personal(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(r.spans.split(",")) | {""}
    tricky = spark.createDataFrame([(1, "a@b.c_d@e.f x@y.z 1.2.3.4.5.6.7.8 300.1.1.1 +1 (017) 555-7713x 4111 1111 1111 1111"), (2, "😀 1" * 3000 + " a@b.cc"), (3, "9" * 20_000 + "@" + "a" * 20_000 + ".b")], "doc_id long, text string")
    for r in pii.proposals(tricky).collect():
        assert [f"{pii.KINDS[b.kind]}:{b.s}:{b.e}" for b in r.base] == _personal(r.text)
    odd = odd.selectExpr("*", "'own' base", "'own' more", "'own' `row`", "'own' _base_email", "1.5 kind")
    clean = pii.redact(odd)
    assert clean.columns == odd.columns and Counter(map(tuple, clean.drop("text").collect())) == Counter(map(tuple, odd.drop("text").collect()))
    clean = {r.doc_id: r.text for r in clean.collect()}
    assert clean[9] == "mail [EMAIL] now" and clean[1] is None and clean[4] == LONG
    assert pii.redact(odd.where("false")).count() == 0


def test_media(spark, docs, odd):
    rows = media.op9_media(spark, SF).collect()
    for r in rows:
        payload = media.padded(docs[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(docs[r.doc_id].encode()), len(payload), zlib.crc32(payload[-64:])) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
    folder = new_path(spark, "m")
    assert media.write_archives(odd, folder, archive_bytes=100) == 12
    spark.dataSource.register(media.MediaArchive)
    back = media.digests(spark.read.format("media_archive").option("rangebytes", 64).load(folder)).collect()
    assert Counter(r.doc_id for r in back) == Counter([1, 2, 3, 4, 5, 6, 7, 7, 8, 9, None, None])
    path, _ = media.list_files(folder, ".zip")[0]
    with zipfile.ZipFile(path.removeprefix("file://")) as archive:
        info, body = archive.infolist()[0], archive.read(archive.infolist()[0])
    tries = []

    class Broken:
        def seek(self, at):
            tries.append(at)
            raise OSError("gone")

    assert media.read_member(path, info, data=Broken()) == body and tries == [info.header_offset]
    with pytest.raises(OSError):
        media.read_member(path, info, tries=1, data=Broken())
    for r in rows:
        payload = media.padded(docs[r.doc_id].encode())
        x, step = np.frombuffer(payload, np.uint8).astype(int), np.abs(np.diff(np.frombuffer(payload, np.uint8).astype(int))).sum()
        image = media.to_image(docs[r.doc_id].encode())
        assert r.feature == f"{len(x)}:{1000 * x.sum() // len(x)}:{1000 * (len(x) * (x * x).sum() - x.sum() ** 2) // len(x) ** 2}:{1000 * step // len(x)}"
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
    empty = new_path(spark, "m")
    assert media.write_archives(odd.where("false"), empty) == 0 and spark.read.format("media_archive").load(empty).count() == 0


def _kept(before, after):
    """Rows that a stage kept, each as often as it has it, must be rows that it was given."""
    given, got = (Counter(map(tuple, f.collect())) for f in (before, after))
    assert not got - given
    return got


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    items = [set(_sets({0: r.text})[0]) for r in table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), f"test-{name}")
        assert out.columns == docs.columns
        given, got = ({r.doc_id: r.text for r in f.collect()} for f in (docs, out))
        if name == "quality":
            model = quality.fit(docs, table(spark, SF, "labels"))
            assert got.keys() == {d for d, t in given.items() if model.score(np.array([quality.statistics(t)]))[0] >= 0.5}
        if name == "near_dedup":
            sets = _sets(given)
            like = lambda a, b: bool(a) and 100 * len(a & b) >= 80 * len(a | b)
            assert not any(like(sets[a], sets[b]) for a in got for b in got if a < b)
            assert all(any(like(sets[d], sets[o]) for o in given if o != d) for d in given.keys() - got.keys())
        if name == "decontam":
            assert given.keys() - got.keys() and all(any(len(i & _sets({0: given[d]})[0]) >= 0.6 * len(i) for i in items) for d in given.keys() - got.keys())
        if name == "pii":
            assert got.keys() == given.keys() and not any(_personal(t) for t in got.values())
        docs = out
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == got.keys()


def test_pipeline_odd(spark, odd):
    import corpus_pipeline

    leak = table(spark, SF, "benchmark").where("length(text) > 100").first().text
    more = [(None, leak), (20, leak), (21, f"{LONG} {leak}"), (22, "one text of some words"), (22, "and another one with other words"), (None, "a copy without an id"), (None, "a copy without an id")]
    docs = odd.unionByName(spark.createDataFrame([(i, t, "en", "x", "y", 1, 2, "z") for i, t in more], SCHEMA)).selectExpr("*", "'own' base", "'own' more", "'own' KIND", "1 n_chars")
    stages = dict(corpus_pipeline.STAGES)
    for rows in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, SF).columns == docs.columns, name
        assert stages["packing"](spark, rows, SF).select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()
    assert all(stage(spark, docs.where("false"), SF).count() == 0 for stage in stages.values())
    got = _kept(docs, stages["near_dedup"](spark, docs, SF))
    texts = Counter((r[0], r[1]) for r in got.elements())
    assert texts[5, "a b c"] == 1 and texts[6, "a b c"] == 0 and texts[7, "A B  C"] == 0 and texts[None, "a b c"] == 0
    assert texts[22, "one text of some words"] == texts[22, "and another one with other words"] == texts[None, "a copy without an id"] == 1
    assert texts[20, leak] == 1 and texts[None, leak] == 0 and texts[1, None] == texts[2, ""] == texts[None, None] == texts[4, LONG] == 1
    got = _kept(docs, stages["decontam"](spark, docs, SF))
    assert got.total() == docs.count() - 3 and not any(r[1] and leak in r[1] for r in got)
    clean = stages["pii"](spark, docs, SF).collect()
    assert len(clean) == docs.count() and {r.n_chars for r in clean if r.doc_id == 9} == {len("mail [EMAIL] now")}
    assert _kept(docs, stages["quality"](spark, docs, SF))
