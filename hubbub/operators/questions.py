"""Questions of the chat, their answers in later speech, and trailing windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import ANSWER_MS, TILE_MS
from ..plans.store import stored
from ..sources.events import CHAT, SPEECH
from . import trailing
from .grouping import assigned, dealt, group_chat, headed, label_of, named
from .scan import ranged, scanned

MIN_SHARED, MAX_ROWS, TICK_MS = 2, 12, 2000
#: Trailing windows in a block of ticks: a longer block copies fewer messages to two blocks.
BLOCK_SPANS = 8


def questions(chat: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Question messages as groups, those that join no group alone: key, count, ts_ms, text, variants, rank."""
    scope = scope or ["channel"]
    canon = F.col("canon") if "canon" in chat.columns else T.canonical(F.col("text"))
    rows = chat.select(*scope, "event_id", "ts_ms", "author", "text", canon.alias("canon"))
    asked = stored(rows.where(T.is_question(F.coalesce("text", F.lit("")), F.col("canon"))), "asked")
    groups = group_chat(asked, scope).select(*scope, "key", "count", F.col("first_ts_ms").alias("ts_ms"), F.col("samples").alias("variants"))
    alone = asked.join(assigned(asked, scope).select(*scope, "event_id"), [*scope, "event_id"], "left_anti")
    alone = alone.select(*scope, F.concat(F.lit("q:"), "event_id").alias("key"), F.lit(1).cast("long").alias("count"), "ts_ms", F.array("text").alias("variants"))
    rows = groups.unionByName(alone).withColumn("text", F.element_at("variants", 1))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("count"), "ts_ms", "text", "key")))


def answered_by(asked: DataFrame, speech: DataFrame, as_of: int | None = None, within_ms: int = ANSWER_MS) -> DataFrame:
    """channel, key and the first segment after the question that shares MIN_SHARED tokens with a variant of it.

    A question covers two time slots at most, so the join is on (channel, slot, token).
    """
    start, end = F.col("ts_ms") + 1, F.col("ts_ms") + within_ms
    end = end if as_of is None else F.least(end, F.lit(as_of + 1))
    tokens = F.array_distinct(F.flatten(F.transform("words", lambda w: T.content_tokens(w))))
    # canonical() holds a UDF, so it runs on exploded variants, not inside a lambda
    each = asked.select("channel", "key", start.alias("lo"), end.alias("hi"), F.explode("variants").alias("variant")).withColumn("canon", T.canonical(F.col("variant")))
    wanted = each.groupBy("channel", "key", "lo", "hi").agg(F.collect_list("canon").alias("words")).select("channel", "key", "lo", "hi", F.explode(tokens).alias("token"))
    wanted = wanted.withColumn("slot", F.explode(F.sequence(F.floor(F.col("lo") / within_ms), F.floor(F.greatest("lo", "hi") / within_ms))))
    said = speech if as_of is None else speech.where(F.col("end_ms") <= as_of)
    said = said.select("channel", F.floor(F.col("ts_ms") / within_ms).alias("slot"), "ts_ms", "event_id", "text", T.canonical(F.col("text")).alias("canon"))
    said = said.select("channel", "slot", "ts_ms", "event_id", "text", F.explode(F.array_distinct(T.content_tokens(F.col("canon")))).alias("token"))
    both = wanted.join(said, ["channel", "slot", "token"]).where("ts_ms >= lo and ts_ms < hi")
    shared = both.groupBy("channel", "key", "event_id").agg(F.min("ts_ms").alias("ts_ms"), F.min("text").alias("text"), F.array_sort(F.collect_set("token")).alias("shared")).where(F.size("shared") >= MIN_SHARED)
    first = shared.groupBy("channel", "key").agg(F.min(F.struct("ts_ms", "event_id", "text", "shared")).alias("a"))
    return first.select("channel", "key", F.col("a.event_id").alias("answer_id"), F.col("a.ts_ms").alias("answer_ts_ms"), F.col("a.shared").alias("shared"))


def stream_questions(events: DataFrame, as_of: int | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """Questions so far, unanswered first, the first max_rows; `hidden` counts the rest of the channel's."""
    events = events if as_of is None else events.where(F.col("ts_ms") <= as_of)
    asked = questions(events.where(F.col("type") == CHAT))
    found = asked.join(answered_by(asked, events.where(F.col("type") == SPEECH), as_of), ["channel", "key"], "left").withColumn("answered", F.col("answer_id").isNotNull())
    w = Window.partitionBy("channel")
    found = found.withColumn("place", F.row_number().over(w.orderBy("answered", "rank"))).withColumn("hidden", F.greatest(F.count("*").over(w) - max_rows, F.lit(0)))
    return found.where(F.col("place") <= max_rows).select("channel", "place", "key", "text", "count", "ts_ms", "answered", "answer_id", "shared", "hidden")


def _in_blocks(chat: DataFrame, span_ms: int, tick_ms: int, size: int, samples: bool) -> DataFrame:
    """Messages sorted within blocks of `size` ticks: lo and hi are the first and the last tick that see one.

    Ticks count from the channel's first message; one that two blocks see is in both. Either
    texts are shuffled (for samples) or canonical texts.
    """
    first = chat.groupBy("channel").agg(F.min("ts_ms").alias("origin"))
    since = F.col("ts_ms") - F.col("origin")
    lo, hi = F.greatest(F.lit(1), F.ceil(since / tick_ms)), F.greatest(F.lit(1), F.ceil((since + span_ms) / tick_ms)) - 1
    known, canon = "canon" in chat.columns, T.canonical(F.col("text"))
    rows = chat if known or samples else chat.withColumn("canon", canon)
    rows = rows if samples else rows.withColumn("text", F.lit(None).cast("string"))
    rows = rows.select("channel", "event_id", "ts_ms", "text", *(["canon"] if known or not samples else [])).join(F.broadcast(first), "channel").withColumns({"lo": lo, "hi": hi}).where("lo <= hi")
    rows = rows.withColumn("block", F.explode(F.sequence(F.expr(f"lo div {size}"), F.expr(f"hi div {size}"))))
    rows = dealt(rows, ["channel", "block"])
    rows = headed(rows if "canon" in rows.columns else rows.withColumn("canon", canon))
    return rows.select(*trailing.MESSAGE, "event_id").sortWithinPartitions("channel", "block", "ts_ms", "event_id", "text").select(*trailing.MESSAGE)


def rolling_groups(chat: DataFrame, span_ms: int = TILE_MS, tick_ms: int = TICK_MS, k: int = 5) -> DataFrame:
    """At every tick, the first k groups of the messages in (tick - span, tick].

    Each message is in span / tick ticks, but is not copied to them: a task walks along a block
    of BLOCK_SPANS spans and keeps up the groups as messages enter and leave (trailing.py). A
    message is shuffled to the one or two blocks that see it.
    """
    size = max(1, span_ms // tick_ms) * BLOCK_SPANS
    rows = _in_blocks(chat, span_ms, tick_ms, size, True).mapInArrow(trailing.group_rows(size, tick_ms, k, 2), trailing.GROUPS)
    return named(rows).select(*[c for c in rows.columns if c != "rank"], "rule", "label", "rank")


def rolling_changes(chat: DataFrame, span_ms: int = TILE_MS, tick_ms: int = TICK_MS, k: int = 5) -> DataFrame:
    """tick_changes() of rolling_groups(): ticks like the one before go where they are found, with no text, and only the rest is shuffled and scanned."""
    size = max(1, span_ms // tick_ms) * BLOCK_SPANS
    lists = _in_blocks(chat, span_ms, tick_ms, size, False).mapInArrow(trailing.changed_lists(size, tick_ms, k), trailing.LISTS)
    lists = lists.withColumn("groups", F.transform("groups", lambda g: F.struct(label_of(g["key"]).alias("label"), g["count"].alias("count"))))
    # ranges are sampled first, which would find the lists twice
    return _changed(stored(lists, "lists"))


def tick_changes(ticks: DataFrame) -> DataFrame:
    """Ticks whose list of (label, count) differs from the tick before."""
    return _changed(ticks.groupBy("channel", "tick").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label", "count"))), lambda x: F.struct(x["label"].alias("label"), x["count"].alias("count"))).alias("groups")))


def _changed(lists: DataFrame) -> DataFrame:
    return scanned(ranged(lists, ["channel"], ["tick"]), ["channel"], befores={"before": F.col("groups")}).where(~F.col("before").eqNullSafe(F.col("groups"))).select("channel", "tick", "groups")


def tile_cli(spans: DataFrame, size_ms: int = TILE_MS) -> DataFrame:
    """Tiles (lo, hi) of spans (channel, start, end); the last one is clamped, an empty span has one tile."""
    if size_ms <= 0:
        raise ValueError("tiles need a positive size")
    last = F.greatest(F.col("start"), F.col("end") - 1)
    rows = spans.withColumn("lo", F.explode(F.sequence(F.col("start"), last, F.lit(size_ms).cast("long"))))
    return rows.select("channel", "lo", F.when(F.col("end") > F.col("start"), F.least(F.col("lo") + size_ms, F.col("end"))).otherwise(F.col("lo") + size_ms).alias("hi"))
