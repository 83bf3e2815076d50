"""The board: which speech or screen event each audience signal followed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import PREFIX_CHARS, REACTION_KEY
from ..plans.store import stored
from ..sources.events import CHAT
from .grouping import TASK_BYTES, dealt, group_chat
from .windows import SCOPE, all_tiles

MAX_ROWS = 6


def trigger_preceding(groups: DataFrame, context: DataFrame) -> DataFrame:
    """As-of: the last context event of the window at or before the group's first message, as `preceding`."""
    order = ["ts_ms", "side", "type", "event_id"]
    events = context.select(*SCOPE, "ts_ms", F.lit(0).alias("side"), "type", "event_id", F.lit(None).cast("string").alias("key"), F.struct("event_id", "type", "ts_ms", "text").alias("event"))
    marks = groups.select(*SCOPE, F.col("first_ts_ms").alias("ts_ms"), F.lit(1).alias("side"), F.lit("").alias("type"), F.col("key").alias("event_id"), "key", F.lit(None).cast(events.schema["event"].dataType).alias("event"))
    w = Window.partitionBy(*SCOPE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.unionByName(marks).withColumn("preceding", F.last("event", True).over(w)).where("side = 1").select(*SCOPE, "key", "preceding")


def trigger_matched(groups: DataFrame, context: DataFrame) -> DataFrame:
    """The last such event that says the group's token, or a word with its prefix, as `matched`."""
    order = ["ts_ms", "side", "type", "event_id", "text"]
    canon = T.canonical(F.col("text"))
    none = F.lit(None).cast("string")
    events = context.select(*SCOPE, "ts_ms", F.lit(0).alias("side"), "type", "event_id", "text", canon.alias("canon"), none.alias("key"))
    marks = groups.where(F.col("key") != REACTION_KEY).select(*SCOPE, F.col("first_ts_ms").alias("ts_ms"), F.lit(1).alias("side"), F.lit("").alias("type"), F.lit("").alias("event_id"), none.alias("text"), none.alias("canon"), "key")
    # a context event is moved once; the keys that it says are made inside the task that has its window
    rows = dealt(events.unionByName(marks), SCOPE, TASK_BYTES // 2)
    place = F.row_number().over(Window.partitionBy(*SCOPE).orderBy(*order))
    words = T.content_tokens(F.col("canon"))
    says = F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("t:"), w)), F.transform(words, lambda w: F.concat(F.lit("p:"), F.substring(w, 1, PREFIX_CHARS)))))
    # a window without groups has nothing to match
    rows = rows.withColumns({"place": place, "asks": F.max("side").over(Window.partitionBy(*SCOPE))}).where("asks = 1")
    each = rows.select(*SCOPE, "side", "ts_ms", "type", "event_id", "text", "place", F.explode(F.when(F.col("side") == 1, F.array("key")).otherwise(says)).alias("key"))
    before = Window.partitionBy(*SCOPE, "key").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    event = F.when(F.col("side") == 0, F.struct("event_id", "type", "ts_ms", "text"))
    return each.withColumn("matched", F.last(event, True).over(before)).where("side = 1 and matched is not null").select(*SCOPE, "key", "matched")


def attributed(events: DataFrame, keep_ids: int = 0) -> DataFrame:
    """Groups of each window with their trigger and its link (matched, preceding or null); keep_ids as in group_chat()."""
    chat, context = events.where(F.col("type") == CHAT), events.where(F.col("type") != CHAT)
    groups = stored(group_chat(chat, keep_ids=keep_ids), "groups")
    found = groups.join(trigger_preceding(groups, context), [*SCOPE, "key"], "left").join(trigger_matched(groups, context), [*SCOPE, "key"], "left")
    link = F.when(F.col("matched").isNotNull(), "matched").when(F.col("preceding").isNotNull(), "preceding")
    return found.withColumn("trigger", F.coalesce("matched", "preceding")).withColumn("link", link).drop("matched", "preceding")


def merged_rows(groups: DataFrame) -> DataFrame:
    """Attributed groups with one trigger as one row, `rank`ed within their window: matched first, then by count."""
    rows = groups.where("trigger is not null")
    lead = F.min(F.struct((-F.col("count")).alias("n"), "first_ts_ms", "key"))
    merged = rows.groupBy(*SCOPE, F.col("trigger.event_id").alias("trigger_id")).agg(
        F.min("trigger.ts_ms").alias("trigger_ts_ms"), F.max((F.col("link") == "matched").cast("int")).alias("is_matched"), F.sum("count").alias("count"), F.count("*").alias("groups"), lead.alias("lead")
    )
    w = Window.partitionBy(*SCOPE).orderBy(F.desc("is_matched"), F.desc("count"), "lead.first_ts_ms", "lead")
    return merged.withColumn("rank", F.row_number().over(w))


def board(events: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Rows of each window: groups with one trigger merged, matched first, the first max_rows."""
    return board_rows(attributed(events), max_rows)


def board_rows(groups: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The board of attributed() groups."""
    ranked = merged_rows(groups).where(F.col("rank") <= max_rows)
    return ranked.select(*SCOPE, "rank", "trigger_id", "trigger_ts_ms", F.when(F.col("is_matched") == 1, "matched").otherwise("preceding").alias("link"), "count", "groups", F.col("lead.first_ts_ms").alias("first_ts_ms"), F.col("lead.key").alias("lead_key"))


def unattributed(groups: DataFrame) -> DataFrame:
    """Groups of each window that no event precedes, most messages first."""
    w = Window.partitionBy(*SCOPE).orderBy(F.desc("count"), "first_ts_ms", "key")
    return groups.where("trigger is null").withColumn("rank", F.row_number().over(w)).select(*SCOPE, "rank", "key", "label", "count", "first_ts_ms")


def board_footer(events: DataFrame, groups: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """messages, rows shown, rows hidden, unattributed groups and singletons of every tile of a channel, empty ones included."""
    messages = events.where(F.col("type") == CHAT).groupBy(*SCOPE).agg(F.count("*").alias("messages"))
    rows = merged_rows(groups).groupBy(*SCOPE).agg(F.count("*").alias("merged"))
    grouped = groups.groupBy(*SCOPE).agg(F.sum("count").alias("grouped"), F.count_if(F.col("trigger").isNull()).alias("unattributed"))
    found = all_tiles(events).join(messages, SCOPE, "left").join(rows, SCOPE, "left").join(grouped, SCOPE, "left").fillna(0)
    shown = F.least("merged", F.lit(max_rows))
    return found.select(*SCOPE, "messages", shown.alias("rows"), (F.col("merged") - shown).alias("rows_hidden"), "unattributed", (F.col("messages") - F.col("grouped")).alias("singletons"))
