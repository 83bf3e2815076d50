"""What the reviewer's fourth round found: queries over ticks that ran out of time, the script of a run."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hubbub.functions import text as T
from hubbub.functions.skeletons import skeletons
from hubbub.operators import grouping, questions, replay
from hubbub.plans import store

MESSAGE = "channel string, event_id string, ts_ms long, text string"


@pytest.fixture
def shared(monkeypatch, tmp_path):
    """A shared folder of its own."""
    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{tmp_path}")
    return tmp_path


def plan_of(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def chat_of(spark, seed: int):
    """Crowded and empty stretches, words that share a beginning, reactions, equal times, ids and texts, nulls."""
    rng = random.Random(seed)
    words = ["forest", "forge", "fore", "forehead", "castle", "cast", "river", "LOL", "haha", "no", "∎"]
    rows = []
    for channel, n, length in (("a", 260, 30_000), ("b", 120, 90_000), (None, 5, 1000), ("c", 1, 1)):
        for k in range(n):
            text = rng.choice(words) if rng.random() < 0.6 else " ".join(rng.choices(words, k=rng.randrange(1, 4)))
            ts = rng.randrange(length) + (400_000 if rng.random() < 0.2 else 0)
            rows.append((channel, None if k % 50 == 9 else f"m{k // 2 if k % 10 == 3 else k:03}", None if k % 60 == 7 else ts // 100 * 100, None if k % 40 == 5 else text))
    return spark.createDataFrame(rows, MESSAGE)


def copied(chat, span_ms: int, tick_ms: int, k: int):
    """rolling_groups() as it is meant: every message in each of its ticks, each tick grouped for itself."""
    rows = chat.join(chat.groupBy("channel").agg(F.min("ts_ms").alias("origin")), "channel")
    since = F.col("ts_ms") - F.col("origin")
    lo, hi = F.greatest(F.lit(1), F.ceil(since / tick_ms)), F.greatest(F.lit(1), F.ceil((since + span_ms) / tick_ms)) - 1
    rows = rows.where("ts_ms is not null").withColumns({"lo": lo, "hi": hi}).where("lo <= hi")
    rows = rows.withColumn("step", F.explode(F.sequence("lo", "hi"))).withColumn("tick", F.col("origin") + F.col("step") * tick_ms)
    return grouping.top_groups(grouping.group_chat(rows.select("channel", "tick", "event_id", "ts_ms", "text"), ["channel", "tick"], 2), ["channel", "tick"], k)


@pytest.mark.parametrize(("seed", "span_ms", "tick_ms", "k"), [(1, 4000, 500, 5), (2, 3000, 700, 2), (3, 500, 2000, 3)])
def test_ticks_by_copies(spark, seed, span_ms, tick_ms, k):
    chat = chat_of(spark, seed).dropDuplicates(["channel", "ts_ms", "event_id"]).localCheckpoint()
    found = questions.rolling_groups(chat, span_ms, tick_ms, k)
    wanted = copied(chat, span_ms, tick_ms, k).select(*found.columns)
    assert found.schema.simpleString() == wanted.schema.simpleString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect())) and not found.isEmpty()
    changes = questions.tick_changes(found)
    assert sorted(map(tuple, questions.rolling_changes(chat, span_ms, tick_ms, k).collect())) == sorted(map(tuple, changes.collect()))


def test_messages_are_not_copied_to_ticks(spark):
    """no window over copies, and a message stands in two blocks at most, seldom in more than one."""
    chat = chat_of(spark, 4)
    assert "Window" not in plan_of(questions.rolling_groups(chat))
    rows = questions._in_blocks(chat, 4000, 500, 8 * questions.BLOCK_SPANS, True)
    assert rows.count() < 1.5 * chat.where("channel is not null and ts_ms is not null").count()


def test_changes_store_no_repeated_tick(spark, shared):
    """ticks like the one before, and texts, are never written or shuffled."""
    chat = spark.createDataFrame([("c", f"m{k}", k * 100, "forest") for k in range(8)] + [("c", "z", 50_000, "river")], MESSAGE)
    assert questions.rolling_groups(chat).count() > 25
    changes = questions.rolling_changes(chat).collect()
    tables = {t.split("-")[0]: spark.read.parquet(str(shared / t)) for t in os.listdir(shared)}
    assert len(changes) == tables["lists"].count() == 2
    assert all("samples" not in t.columns for t in tables.values())


def test_script_scans_closes_once(spark):
    """no frame to the end of the channel, which is read again for every row; closes at a tick count, later ticks have none."""
    rng = random.Random(6)
    ticks = [("ab"[k % 2], rng.randrange(100)) for k in range(60)] + [("b", 500), ("quiet", 1)]
    ends = [("ab"[k % 2], k, rng.randrange(120)) for k in range(20)]
    rows = replay.next_closes(spark.createDataFrame(ticks, "channel string, at_ms long"), spark.createDataFrame(ends, "channel string, win long, close_ms long"))
    assert "unboundedfollowing" not in plan_of(rows).lower()
    assert sorted(map(tuple, rows.collect()), key=str) == sorted({(c, at, min((e for d, _, e in ends if d == c and e >= at), default=None)) for c, at in ticks}, key=str)


def test_skeletons_equal_the_patterns(spark):
    """F4 to F11: texts are cut by arrays as by patterns, whatever they hold; nulls, slices and empty batches too."""
    rng = random.Random(7)
    parts = ["a", "b", "ab", "ab ab", "x+x", " ", "  ", "!", "é", "_", "\t", "\u2028", "aaa", "😀", "ß", "ё", "Ё", "İ", "ı", "$", "да", "Да", "\x00", "\x1c", "\xa0", "ł", "ﬁ", "1", "٣", "²", "—", "-", "e\u0301"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(6000)] + [f"a{chr(k)}B" for k in range(1, 0x3000)] + [None, ""]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    by_patterns = T.skeleton(T.folded(F.coalesce("x", F.lit(""))))
    assert rows.where(~T.canonical(F.col("x")).eqNullSafe(by_patterns)).collect() == []
    usual = ["Äh, the the  river-bank!", "hahaha LOL", "nooooo", "Да, да", "Straße $5", "", None, "so so+so"]
    found = ["äh the river bank", "haha lol", "noo", "да", "strasse $5", "", None, None]
    assert skeletons(pa.array(usual)).to_pylist() == found
    assert skeletons(pa.array(usual).slice(2, 4)).to_pylist() == found[2:6] and skeletons(pa.array([], pa.string())).to_pylist() == []


def test_windows_are_grouped_without_windows_functions(spark):
    """F4 to F11: one shuffle and one sort, no copy of a message for each of its words."""
    chat = chat_of(spark, 5).withColumn("win", F.lit(0).cast("long"))
    for rows in (grouping.group_chat(chat, keep_ids=2), grouping.grouped_summary(chat)):
        plan = plan_of(rows).split("Initial Plan")[0]
        assert "Window" not in plan and "Generate" not in plan and plan.count("Exchange") == plan.count("Sort [") == 1
    summary = {r.channel: r for r in grouping.grouped_summary(chat).collect()}
    groups = grouping.group_chat(chat, keep_ids=2).collect()
    members = grouping.assigned(chat, ["channel", "win"]).groupBy("channel", "key").count().collect()
    assert {(g.channel, g.key): g["count"] for g in groups} == {(m.channel, m.key): m["count"] for m in members}
    assert sum(r.grouped for r in summary.values()) == sum(g["count"] for g in groups) and summary["a"].messages == 260
