"""What the reviewer's third round found, third part: time of the groupings and questions."""

import os
import random
import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from hubbub.functions import text as T
from hubbub.operators import grouping, questions
from hubbub.plans import store

CHAT = "channel string, win long, event_id string, ts_ms long, author string, text string"


def _chat(spark, texts, win=lambda k: k // 40):
    return spark.createDataFrame([("c", win(k), f"m{k:04}", k, "a", x) for k, x in enumerate(texts)], CHAT)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_plain_texts_are_folded_without_python(spark):
    """Every character that is not sent to Python folds as Python folds it; those of usual texts are not sent."""
    rng = random.Random(3)
    every = [chr(k) for k in range(1, 0x3000) if not 0xD800 <= k < 0xE000]
    plain = "".join(c for c in every if re.match(T._PLAIN.replace(r"\z", r"\Z"), c))
    texts = [*every, *("".join(rng.choices(plain, k=9)) for _ in range(500)), None]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", T.as_folded(F.col("x"), T.odd_folded(F.col("x"))).alias("f"), T.folded(F.col("x")).alias("g"), T.odd_folded(F.col("x")).alias("odd")).collect()
    for r in rows:
        assert r.f == r.g == (None if r.x is None else unicodedata.normalize("NFKC", r.x).casefold()), r.x
    assert not [r.x for r in rows if r.odd is not None and (r.x in "äÖüßéñàçйЖ–“" or r.x.isascii())]


def test_skeleton_equals_its_plain_form(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices(["a", "b", "ab", " ", "  ", "!", "é", "_", "\t", "\u2028", "aaa", "😀"], k=rng.randrange(1, 30))) for _ in range(3000)]
    old = F.col("x")
    for pattern, by in ((r"\p{P}", " "), (r"(?U)\s+", " "), ("^ | $", ""), (r"(.)\1{2,}", "$1$1"), (r"(.{1,4}?)\1{2,}", "$1$1"), (r"(?U)(\b\w+\b)(\s+\1\b)+", "$1")):
        old = F.regexp_replace(old, pattern, by)
    assert spark.createDataFrame([(x,) for x in texts], "x string").where(~T.skeleton(F.col("x")).eqNullSafe(old)).collect() == []


def test_groups_by_brute_force(spark):
    """Single words that share a prefix, prefix groups that join a word's, words in sentences, laughter."""
    rng = random.Random(6)
    vocabulary = ["forest", "forester", "forestry", "forge", "forget", "castle", "castles", "cast", "river", "your", "then", "LOL", "lol", "ok", "!!!"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 1, 1, 2, 3]))) for _ in range(1200)]
    want = Counter()
    for win in range(30):
        part = [re.sub(r"\b(\w+)( \1\b)+", r"\1", re.sub(r"[!\s]+", " ", x).strip().lower()) for x in texts[win * 40 : win * 40 + 40]]
        laughs = [bool(re.fullmatch(r"(?:l+o+l+(?:ol)*)", c.replace(" ", ""))) for c in part]
        tokens = [{w for w in c.split(" ") if len(w) >= 3 and w not in T.STOPWORDS} for c in part]
        heads = Counter(c[:4] for c, r in zip(part, laughs, strict=True) if not r and " " not in c and len(c) >= 4)
        own = [grouping.REACTION_KEY if r else f"p:{c[:4]}" if c and " " not in c and len(c) >= 4 and heads[c[:4]] >= 4 else None for c, r in zip(part, laughs, strict=True)]
        n = Counter(t for o, ts in zip(own, tokens, strict=True) if o is None for t in ts)
        keys = [o or min(((-n[t], f"t:{t}") for t in ts if n[t] >= 3), default=(0, None))[1] for o, ts in zip(own, tokens, strict=True)]
        sizes = Counter(k for k in keys if k)
        into = {}
        for k in sorted(k for k in sizes if k[:2] == "t:"):
            if k[2:6] not in into or sizes[k] > sizes[into[k[2:6]]]:
                into[k[2:6]] = k
        keys = [into.get(k[2:], k) if k and k[:2] == "p:" else k for k in keys]
        want.update({(win, k): c for k, c in Counter(k for k in keys if k).items() if k[:2] != "t:" or c >= 3})
    chat = _chat(spark, texts)
    found = grouping.group_chat(chat).collect()
    assert {(r.win, r.key): r["count"] for r in found} == want and len({k[:2] for _, k in want}) == 3
    summary = grouping.grouped_summary(chat).agg(F.sum("messages").alias("m"), F.sum("grouped").alias("g"), F.sum("ungrouped").alias("u")).first()
    assert (summary.m, summary.g, summary.u) == (1200, sum(want.values()), 1200 - sum(want.values()))


def test_groups_need_few_sorts(spark):
    """Sorts on the way from messages to groups: heads, tokens, messages, keys, texts and their order."""
    assert len(re.findall(r"\bSort \[", _plan(grouping.group_chat(_chat(spark, ["forest walk"] * 50))))) <= 6


def test_bursts_take_one_shuffle_and_store_nothing(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{tmp_path}")
    chat = _chat(spark, ["Hi", "hi!", "hi", "...", "yo", "yo"] * 20)
    found = grouping.reduce_chat(chat, keep_ids=3)
    assert _plan(found).count("Exchange") == 1 and not os.listdir(tmp_path)
    rows = {(r.win, r.key): (r["count"], r["sample"], r.event_ids) for r in found.collect()}
    assert rows[0, "hi"] == (21, "Hi", ["m0000", "m0001", "m0002"]) and rows[0, "∅"] == (7, "(punctuation only)", ["m0003", "m0009", "m0015"])


def test_questions_store_no_other_message(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{tmp_path}")
    asked = questions.questions(_chat(spark, ["what game is this?", "a plain line", "nothing here"] * 10)).collect()
    assert [r["count"] for r in asked] == [10]
    texts = [spark.read.parquet(str(tmp_path / t)) for t in os.listdir(tmp_path)]
    assert {r.text for t in texts if "text" in t.columns for r in t.collect()} == {"what game is this?"}
