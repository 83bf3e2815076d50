
import random
from collections import Counter

import pytest

import corpus_pipeline
from hubbub.llm import decontam, near_dedup, pii


def _near_pairs(spark, shared, own, pairs=1500):
    """Pairs of documents (2i, 2i + 1) whose sets share so many shingles and have so many of their own."""
    rows = []
    for i in range(pairs):
        common = [f"c{i}x{k}" for k in range(shared + 4)]
        rows += [(2 * i + side, " ".join(common + [f"{'ab'[side]}{i}x{k}" for k in range(own)])) for side in (0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(8)


def test_near_dedup_stage_at_eighty(spark):
    for shared, own in ((80, 10), (83, 9)):  # similarity 0.80 and 83 / 101
        docs = _near_pairs(spark, shared, own)
        kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect())
        assert kept == list(range(0, 3000, 2))
    docs = _near_pairs(spark, 79, 10)  # 79 / 99
    assert corpus_pipeline.near_dedup_stage(spark, docs, "").count() == 3000
    assert near_dedup.near_duplicates(_near_pairs(spark, 83, 9)).where("not kept").count() == 0
    assert near_dedup.tuned(85)[:2] == (24, 6) and near_dedup.tuned(80)[:2] == (29, 5)


def _best(text, item):
    shingle = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
    w, n, a, best = text.split(), len(item.split()), Counter(shingle(item.split())), 0
    for k in range(max(1, len(w) - n + 1)):
        b = Counter(shingle(w[k : k + n]))
        shared = sum((a & b).values())
        best = max(best, shared / (sum(a.values()) + sum(b.values()) - shared))
    return best


def test_leaks_in_another_order(spark):
    rng = random.Random(1)
    fill = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    items, docs = {}, {}
    for i, n in enumerate([59, 59, 41, 90, 3, 5, 13, 30, 59] * 3):
        w = [f"w{i}x{k}" for k in range(n)]
        if i % 9 == 8:
            w[40:59] = ["very"] * 19  # repeated words: weights
        items[i] = " ".join(w)
        moved = [w[n // 2 :] + w[: n // 2], w[2 * n // 3 :] + w[n // 3 : 2 * n // 3] + w[: n // 3], w, w[: n // 2] + ["other"] + w[n // 2 :], w[:40] + fill(19), w[: n // 9] + fill(1) + w[n // 9 + 1 :]]
        for k, x in enumerate(moved):
            docs[1000 * i + 2 * k], docs[1000 * i + 2 * k + 1] = " ".join(fill(37 + k) + x + fill(50 + i)), " ".join(x)
    frame = lambda rows, name: spark.createDataFrame(list(rows.items()), f"{name} long, text string")
    want = {(d, i): s for i, item in items.items() for d, text in docs.items() if d // 1000 == i and (s := _best(text, item)) >= 0.8}
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == pytest.approx(want) and (0, 0) in want and (1, 0) in want and len(want) > 100


def test_personal_data_by_evidence(spark):
    texts = {
        1: ("Ask john (at) example (dot) com. Thanks", ["john (at) example (dot) com"]),
        2: ("ring (017) 555-7713 now", ["(017) 555-7713"]),
        3: ("phone: 017 555 7713", ["017 555 7713"]),
        4: ("email: jo.hn @ example.org, or jane[at]mail.example.org!", ["jo.hn @ example.org", "jane[at]mail.example.org"]),
        5: ("we met @ home. Later 0123456789 items (2019) and 2020-2021", []),
        6: ("write a@b.co. Thanks", ["a@b.co"]),
    }
    few = [(i, t) for i, (t, _) in texts.items()]
    for rows in (few, few + [(i, f"see {i} @ place. Then order 20{i} 10{i} 3000") for i in range(1000, 1600)]):
        got = {r.doc_id: [r.text[s.s : s.e] for s in r.spans] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert {i: got[i] for i in texts} == {i: want for i, (_, want) in texts.items()}
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(few, "doc_id long, text string")).collect()}
    assert clean[1] == "Ask [EMAIL]. Thanks" and clean[2] == "ring [PHONE] now" and clean[5] == texts[5][0]
