"""Encoding at forced boundaries, hard negatives and runs: awkward rows, and brute force on the smallest tables."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from hubbub.llm import boundary_bpe, bpe, hard_negatives, word_runs
from hubbub.llm.common import table

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000 + "end"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and clashing extra columns."""
    texts = [(1, None), (2, ""), (3, "  \n"), (4, LONG), (5, "a b c"), (6, "x" * 40_000), (7, "A B  C"), (7, "A B  C"), (None, "a a a a a a"), (None, None), (8, "<|endoftext|>é <|startoftext")]
    return spark.createDataFrame([(i, t, 1, "z", "y", 2) for i, t in texts], "doc_id long, text string, ids int, runs string, collapsed string, best int")


def test_pairs_inside():
    inside = boundary_bpe.pairs_inside([b"abc", b"", b"d", b"ca"])
    assert sorted(zip(*(x.tolist() for x in np.nonzero(inside)))) == sorted([(97, 98), (98, 99), (99, 97)])


def test_codec_is_the_library():
    from tokenizers import Tokenizer

    path, rng = bpe.vocabulary("word_bpe_49k.json"), random.Random(5)
    letters = bpe.WHITE + "abcéñ×÷AZ漢字1.,'\"-|<>=&stmdrelv\x1c​̸́😀İſΣς²Ⅷ각ᄀ"
    texts = ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(5000)]
    texts += ["x<|endoftext|>y <|startoftext|><|endoftext|>", "<|endoftext|", "it's '''s don't''t ''ve we'll'd've", "ΑΣ ΣΑΣ", "q" * 5000, "qxzjqkvw" * 300, "e ́e", LONG, "a b　c"]
    library, own = Tokenizer.from_file(path), boundary_bpe.Codec(path)
    ids, counts = own.encode(pa.array(texts, pa.string()))
    decoded = boundary_bpe.decoded(ids, counts, boundary_bpe.names(path)).to_pylist()
    for text, end, n, back in zip(texts, np.cumsum(counts), counts, decoded, strict=True):
        told = library.encode(text, add_special_tokens=False).ids
        assert ids[end - n : end].tolist() == told and back == library.decode(told, skip_special_tokens=False), text
    names = boundary_bpe.names(path)
    assert boundary_bpe.decoded(np.array([320, 10**6, 320]), np.array([2, 0, 1]), names).to_pylist() == [names[320].as_py(), "", names[320].as_py()]


def test_fragments_are_independent():
    """Words cut at forced boundaries alone give the ids of whole words; the cuts do cut."""
    own, rng = boundary_bpe.codec(bpe.vocabulary("word_bpe_49k.json")), random.Random(2)
    words = ["".join(rng.choices("qxzjkvwabe", k=30)) for _ in range(300)]
    whole = [e.ids for e in own.ending.encode_batch(words)]
    ids, counts = own.encode(pa.array(words))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == whole
    assert np.mean([len(f) - 1 for f in own.fragments]) < 15


def test_bpe_odd(spark, odd):
    from tokenizers import Tokenizer

    path = bpe.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = boundary_bpe.decode(boundary_bpe.encode(odd, path), path).collect()
    told = [library.encode(r.text or "", add_special_tokens=False).ids for r in odd.collect()]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == told and [r.text for r in rows] == [library.decode(t, skip_special_tokens=False) for t in told]
    assert [r.doc_id for r in rows] == [r.doc_id for r in odd.collect()]
    assert boundary_bpe.encode(odd.where("false"), path).count() == 0
    with pytest.raises(ValueError):
        boundary_bpe.Codec(bpe.vocabulary("byte_bpe_50k.json"))


def test_op11_by_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary("word_bpe_49k.json"))
    got = {r.doc_id: r for r in boundary_bpe.op11_bpe(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert tuple(got[d.doc_id]) == (d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert len(got) == len(docs)


@pytest.mark.parametrize("width,most", [(1, 100), (64, 160), (64, 200_000), (3000, 40_000)])
def test_residue_products_are_exact(width, most):
    rng = np.random.default_rng(width)
    a, b = (rng.integers(-most, most + 1, (n, width)) for n in (17, 33))
    a[0], b[0] = most, -most
    primes = hard_negatives.moduli(width * most**2, width)
    got = hard_negatives.Residues(a, primes).products(hard_negatives.Residues(b, primes))
    assert (got == (a.astype(object) @ b.T.astype(object))).all()
    with pytest.raises(ValueError):
        hard_negatives.moduli(2**62, width)


def brute_negatives(rows):
    """rows of (vec_id, label, integers) that take part."""
    out = []
    for k, (i, label, v) in enumerate(rows):
        if i % 100:
            continue
        score = [(-sum(x * y for x, y in zip(v, w)), j, own) for n, (j, own, w) in enumerate(rows) if n != k]
        for p, j, own in sorted(s for s in score if s[2] == label)[:5]:
            fits = sorted(s for s in score if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p)[:5]
            out += [(i, j, rank, s[1], -p, -s[0]) for rank, s in enumerate(fits, 1)]
    return sorted(out)


def test_hard_negatives_odd(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 40)
    monkeypatch.setattr(hard_negatives, "LEAST_BLOCK", 10)
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 7)
    monkeypatch.setattr(hard_negatives, "TILE_ANCHORS", 2)
    rng = random.Random(4)
    plain = [(k * 25, rng.randrange(3), [rng.randrange(-3, 4) / 4 for _ in range(4)]) for k in range(150)]
    plain += [(100, 1, [0.5, 0.5, 0.25, 0.5])] * 3 + [(100, 1, [0.5, 0.5])] + [(7_000 + k, 2, [0.5, 0.5, 0.5, 0.5]) for k in range(40)] + [(3300, 0, [])]
    out = [(1, None, [1.0] * 4), (2, 1, None), (300, 1, [1.0, None, 1.0, 1.0]), (400, 1, [float("nan")] * 4), (500, 1, [float("inf")] * 4), (None, 1, [1.0] * 4)]
    schema = "vec_id long, label int, embedding array<float>, n int, tag string, score string, slot int"
    rows = spark.createDataFrame([(*r, 5, "x", "y", 9) for r in plain + out], schema)
    got = hard_negatives.hard_negatives(rows, hard_negatives.F.col("vec_id") % 100 == 0)
    told = brute_negatives([(i, label, [int(256 * x // 1) for x in v]) for i, label, v in plain])
    assert sorted(tuple(r)[:6] for r in got.collect()) == told and len(told) > 100
    assert hard_negatives.hard_negatives(rows.where("false"), hard_negatives.F.col("vec_id") % 100 == 0).count() == 0


def test_op12_by_sql(spark):
    got = hard_negatives.op12_hard_negatives(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    told = con.execute(f"SELECT {', '.join(got.columns)} FROM ({hard_negatives.ORACLE})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(told)


def lyndon(s):
    """The next smaller suffix, by comparing."""
    return [next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s)) - i for i in range(len(s))]


def brute_runs(w):
    """Every period by comparing all words with those that many words on."""
    out, x = set(), np.unique(np.array(w), return_inverse=True)[1]
    for p in range(1, len(x) // 4 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (x[:-p] == x[p:]).view(np.int8), [0]))))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
            shorter = j + p - i >= 4 * p and any((x[i : j + p - q] == x[i + q : j + p]).all() for q in range(1, p))
            if j + p - i >= max(6, 4 * p) and not shorter:
                out.add((i, j + p - i, p))
    return out


def test_baier_groups_and_runs():
    rng = random.Random(1)
    for _ in range(1500):
        k = rng.choice([1, 2, 3, 5])
        s = [rng.randrange(k) for _ in range(rng.randrange(1, 50))]
        if rng.random() < 0.7:
            u, at = [rng.randrange(k) for _ in range(rng.randrange(1, 8))], rng.randrange(len(s))
            s = s[:at] + u * rng.randrange(3, 8) + u[: rng.randrange(len(u))] + s[at:]
        length, group = word_runs.lyndon_groups(s)
        assert length.tolist() == lyndon(s)
        words = [tuple(s[i : i + n]) for i, n in enumerate(length.tolist())]
        assert len(set(zip(words, group.tolist()))) == len(set(words)) == len(set(group.tolist()))
        assert word_runs.find_runs(np.array(s)) == brute_runs(s)
        (_, found), (_, none) = word_runs.documents_runs([None, 1], [" ".join(map(str, s)), "x y"])
        assert set(found) == brute_runs(s) and not none


def test_op13_by_brute_force(spark):
    got = {r.doc_id: r for r in word_runs.op13_runs(spark, SF).collect()}
    some = 0
    for d in table(spark, SF, "documents").collect():
        w, r = (d.text or "").encode().split(), got[d.doc_id]
        h = zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = sorted(brute_runs(w), key=lambda x: (x[0], x[2]))
        some += len(runs)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()
    assert some > 5


def test_runs_odd(spark, odd):
    rows = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in word_runs.word_runs(odd).collect()}
    assert rows[None, "a"] == [(0, 6, 1)] and rows[None, ""] == rows[2, ""] == rows[3, ""] == []
    assert rows[4, "word end"] == [(0, 30_000, 1)] and rows[7, "A B C"] == []
    assert word_runs.word_runs(odd).count() == 11 and word_runs.word_runs(odd.where("false")).count() == 0
