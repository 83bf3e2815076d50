"""What the reviewer's third round found, fourth part: disk of the card queries."""

import os
import re

from pyspark.sql import functions as F

from hubbub.operators import board, grouping, replay
from hubbub.plans import context_queries, more_queries, registry, store

SF = "/root/testdata/sf0.001"


def _dealt_over(df) -> list[int]:
    """Tasks of each stated dealing in the plan."""
    return [int(n) for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])]


def test_tasks_of_groupings_stay_small_on_larger_inputs(spark, tmp_path):
    """Whatever the number of partitions says, a task gets no more than its share of bytes, so sorts need not spill."""
    path = f"{tmp_path}/a folder%20/chat"
    text = F.concat_ws(" ", *[F.substring(F.sha2(F.concat_ws("/", "id", F.lit(k)), 256), 1, 60) for k in range(5)])
    spark.range(50_000).select(F.lit("c").alias("channel"), (F.col("id") % 500).alias("win"), F.concat(F.lit("m"), "id").alias("event_id"), F.lit("chat_message").alias("type"), F.col("id").alias("ts_ms"), F.lit("a").alias("author"), text.alias("text")).write.parquet(path)
    size = sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".parquet"))
    chat = spark.read.parquet(path)
    assert store.bytes_read(chat.where("win > 3")) == size > 2 * grouping.TASK_BYTES and store.bytes_read(spark.range(3)) == 0
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        assert _dealt_over(grouping.group_chat(chat)) == [-(-size // grouping.TASK_BYTES)]
        groups = chat.select("channel", "win", F.col("ts_ms").alias("first_ts_ms"), F.lit("t:word").alias("key"))
        assert _dealt_over(board.trigger_matched(groups, chat))[0] >= 2 * size // grouping.TASK_BYTES
        few = spark.createDataFrame([("c", 0, "m", 1, "a", "hi")], "channel string, win long, event_id string, ts_ms long, author string, text string")
        assert _dealt_over(grouping.group_chat(few)) == [2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_groups_go_once_cards_and_attributions_are_stored(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{tmp_path}")
    made, events = context_queries._cards(spark, SF)
    found = more_queries._attributed(spark, SF), registry._attributed(spark, SF)[1]
    assert {t.split("-")[0] for t in os.listdir(tmp_path)} == {"origins", "cards", "attributed"}
    assert made.count() and events.count() and all(f.count() for f in found)


def test_lead_up_shuffles_no_chat_outside_its_windows(spark):
    """Also where Spark would not send a table of that size to all tasks by itself."""
    cards = spark.createDataFrame([("c", "s", ("speech", "t", "q"), ["m2"], [0, 4])], "channel string, signal_id string, trigger struct<kind: string, event_id: string, quote: string>, evidence array<string>, window_ms array<long>")
    events = spark.createDataFrame([("c", f"m{k}", "chat_message", k, f"text {k}") for k in range(9)], "channel string, event_id string, type string, ts_ms long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = replay.hero_lead_up(cards, events, span=2)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert [(r.event_id, r.cited) for r in found.orderBy("place").collect()] == [("m1", False), ("m2", True)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
