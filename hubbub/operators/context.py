"""What was said and shown around messages: bounded reads, context joins, rendered inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.events import CHAT, FRAME, SPEECH
from .scan import numbered, ranged, scanned
from .windows import SCOPE, window_filter

MAX_SPAN_MS, SPEECH_MS, SCREEN_MS, PENDING_MS = 180_000, 45_000, 60_000, 120_000
NO_SCREEN = "No screen description available."
LEVELS_S = (60, 300, 1800, 7200)
LATEST = {CHAT: 500, SPEECH: 100, FRAME: 20}


def bounded_window(events: DataFrame, kind: str, start: int, end: int, final_only: bool | None = None) -> DataFrame:
    """One type's events in [start, end); speech is final unless asked otherwise."""
    if end < start or end - start > MAX_SPAN_MS:
        raise ValueError(f"a context window spans 0 to {MAX_SPAN_MS} ms")
    final_only = kind == SPEECH if final_only is None else final_only
    columns = {CHAT: ["author"], SPEECH: ["end_ms"], FRAME: []}[kind]
    return window_filter(events, start, end, [kind], final_only).select("channel", "event_id", "ts_ms", *columns, "text")


def clipped(text: Column, n: int = 240) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - 1), F.lit("…"))).otherwise(t)


def visible_context(events: DataFrame, speech: int = 12, captions: int = 6) -> DataFrame:
    """The first non-empty speech segments and captions of each window, clipped."""
    rows = events.where(F.col("type").isin(SPEECH, FRAME)).withColumn("text", clipped(F.col("text"))).where("text <> ''")
    w = Window.partitionBy(*SCOPE, "type").orderBy("ts_ms", "event_id")
    limit = F.when(F.col("type") == SPEECH, speech).otherwise(captions)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select(*SCOPE, "type", "place", "event_id", "ts_ms", "text")


def bounded_chat(chat: DataFrame, rows: int = 3000, chars: int = 1024) -> DataFrame:
    w = Window.partitionBy("channel").orderBy("ts_ms", "event_id")
    return chat.withColumn("place", F.row_number().over(w)).where(F.col("place") <= rows).withColumn("text", F.substring("text", 1, chars)).select("channel", "event_id", "ts_ms", "place", "text")


def bounded_context(events: DataFrame, rows: int = 128, chars: int = 500, batch: int = 12) -> DataFrame:
    """The channel's first events other than chat, in batches."""
    w = Window.partitionBy("channel").orderBy("ts_ms", "type", "event_id")
    ranked = events.where(F.col("type") != CHAT).withColumn("place", F.row_number().over(w)).where(F.col("place") <= rows)
    return ranked.select("channel", "event_id", "place", F.floor((F.col("place") - 1) / batch).alias("batch"), F.substring("text", 1, chars).alias("text"))


def latest_n(rows: DataFrame, scope: list[str], n: int) -> DataFrame:
    """The latest n rows of each scope with `place`, ascending from 1."""
    w = Window.partitionBy(*scope)
    found = rows.withColumn("_back", F.row_number().over(w.orderBy(F.desc("ts_ms"), F.desc("event_id")))).where(F.col("_back") <= n)
    return found.withColumn("place", F.max("_back").over(w) - F.col("_back") + 1).drop("_back")


def message_batches(chat: DataFrame, size: int = 3) -> DataFrame:
    """Messages numbered in batches of `size`, in order: batch (from 0) and number (from 1)."""
    rows = numbered(chat, ["channel"], ["ts_ms", "event_id"], "_place").withColumn("_place", F.col("_place") - 1)
    return rows.withColumn("batch", F.floor(F.col("_place") / size)).withColumn("number", (F.col("_place") % size + 1).cast("int")).drop("_place")


def numbered_chat(batches: DataFrame) -> DataFrame:
    """`i. login: text` lines of each batch."""
    line = F.concat(F.col("number").cast("string"), F.lit(". "), F.coalesce("author", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    return batches.groupBy("channel", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def answers_by_number(batches: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (channel, batch, number, answer) joined back to messages; numbers out of range find none."""
    return batches.select("channel", "batch", "number", "event_id").join(answers, ["channel", "batch", "number"])


def _covered(events: DataFrame, start: Column, end: Column, size: int) -> DataFrame:
    """A row for each time slot of `size` ms that [start, end] touches: makes a range join an equi-join."""
    return events.withColumn("slot", F.explode(F.sequence(F.floor(start / size), F.floor(end / size))))


def speech_context(batches: DataFrame, speech: DataFrame, before_ms: int = SPEECH_MS) -> DataFrame:
    """Final speech that starts in [first message - before_ms, last message] of each batch, with its messages, as lines."""
    spans = batches.groupBy("channel", "batch").agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
    slots = _covered(spans, F.col("lo") - before_ms, F.col("hi"), before_ms)
    said = speech.where("final").select("channel", F.floor(F.col("ts_ms") / before_ms).alias("slot"), "ts_ms", "event_id", "text")
    near = said.join(slots, ["channel", "slot"]).where((F.col("ts_ms") >= F.col("lo") - before_ms) & (F.col("ts_ms") <= F.col("hi")))
    lines = near.select("channel", "batch", "ts_ms", F.lit("speech").alias("kind"), "event_id", "text").unionByName(batches.select("channel", "batch", "ts_ms", F.lit("chat").alias("kind"), "event_id", "text"))
    line = F.concat("kind", F.lit(": "), F.coalesce("text", F.lit("")))
    return lines.groupBy("channel", "batch").agg(F.count_if(F.col("kind") == "speech").alias("speech"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts_ms", "kind", "event_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def screen_context(batches: DataFrame, frames: DataFrame, stale_ms: int = SCREEN_MS) -> DataFrame:
    """As of a batch's last message, the latest caption not older than stale_ms before its first."""
    spans = batches.groupBy("channel", "batch").agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("ts_ms"))
    marks = spans.select("channel", "ts_ms", F.lit(1).alias("side"), "batch", "lo", F.lit(None).cast("struct<ts_ms: bigint, text: string>").alias("frame"), F.lit("").alias("id"))
    shown = frames.select("channel", "ts_ms", F.lit(0).alias("side"), F.lit(None).cast("long").alias("batch"), F.lit(None).cast("long").alias("lo"), F.struct("ts_ms", "text").alias("frame"), F.col("event_id").alias("id"))
    both = ranged(marks.unionByName(shown), ["channel"], ["ts_ms", "side", "id"])
    found = scanned(both, ["channel"], lasts={"seen": F.col("frame")}).where("side = 1")
    return found.select("channel", "batch", F.when(F.col("seen.ts_ms") >= F.col("lo") - stale_ms, F.col("seen.text")).otherwise(NO_SCREEN).alias("screen"))


def overlap_speech(speech: DataFrame, size_ms: int) -> DataFrame:
    """Speech of every window of size_ms that it overlaps (start < window end, end > window start)."""
    rows = speech.where("end_ms > ts_ms").withColumn("slot", F.explode(F.sequence(F.floor(F.col("ts_ms") / size_ms), F.floor((F.col("end_ms") - 1) / size_ms))))
    return rows.withColumn("end", (F.col("slot") + 1) * size_ms).drop("slot")


def summary_counts(events: DataFrame, levels_s: tuple[int, ...] = LEVELS_S) -> DataFrame:
    """Messages, speech and captions of each (channel, window_s, end), counted up to the latest of each type that a summary reads."""
    level = F.explode(F.array(*[F.lit(s) for s in levels_s]))
    size = F.col("window_s") * 1000
    last = F.when((F.col("type") == SPEECH) & (F.col("end_ms") > F.col("ts_ms")), F.col("end_ms") - 1).otherwise(F.col("ts_ms"))
    rows = events.where("final").withColumn("last", last).withColumn("window_s", level)
    rows = rows.withColumn("end_ms", F.explode(F.transform(F.sequence(F.floor(F.col("ts_ms") / size), F.floor(F.col("last") / size)), lambda k: (k + 1) * size)))
    counts = rows.groupBy("channel", "window_s", "end_ms").agg(*[F.least(F.count_if(F.col("type") == t), F.lit(n)).alias(f"{name}_count") for (t, n), name in zip(LATEST.items(), ("msg", "audio", "frame"), strict=True)])
    return counts


NO_DATA = "no data in this window"


def every_window(counts: DataFrame) -> DataFrame:
    """summary_counts() with the windows between a channel's first and last of each level that have no data, and what their summary says."""
    ends = counts.groupBy("channel", "window_s").agg(F.min("end_ms").alias("lo"), F.max("end_ms").alias("hi"))
    windows = ends.select("channel", "window_s", F.explode(F.sequence("lo", "hi", (F.col("window_s") * 1000).cast("long"))).alias("end_ms"))
    kinds = ["msg_count", "audio_count", "frame_count"]
    own = counts.select(F.col("channel").alias("_of"), F.col("window_s").alias("_size"), F.col("end_ms").alias("_end"), *kinds)
    on = F.col("channel").eqNullSafe(F.col("_of")) & (F.col("window_s") == F.col("_size")) & (F.col("end_ms") == F.col("_end"))
    found = windows.join(own, on, "left").select("channel", "window_s", "end_ms", *[F.coalesce(c, F.lit(0)).alias(c) for c in kinds])
    return found.withColumn("summary", F.when(F.col("msg_count") + F.col("audio_count") + F.col("frame_count") == 0, NO_DATA))


def hierarchical_prev(summaries: DataFrame, levels_s: tuple[int, ...] = LEVELS_S) -> DataFrame:
    """For each summary, the summaries of the level below in its window: as many of the latest as fill it."""
    below = {w: p for p, w in zip(levels_s, levels_s[1:])}
    prev_s = F.element_at(F.create_map(*[F.lit(x) for pair in below.items() for x in pair]), F.col("window_s"))
    upper = summaries.where(F.col("window_s").isin(*below)).select("channel", "window_s", "end_ms", prev_s.alias("prev_s"))
    lower = summaries.select("channel", F.col("window_s").alias("prev_s"), F.col("end_ms").alias("prev_end"))
    # a lower window ends inside one upper window: its slot makes the join an equi-join
    lower = lower.join(F.broadcast(summaries.sparkSession.createDataFrame([(p, w) for w, p in below.items()], "prev_s int, window_s int")), "prev_s")
    lower = lower.withColumn("end_ms", F.ceil(F.col("prev_end") / (F.col("window_s") * 1000)) * F.col("window_s") * 1000)
    both = upper.join(lower, ["channel", "window_s", "prev_s", "end_ms"])
    w = Window.partitionBy("channel", "window_s", "end_ms").orderBy(F.desc("prev_end"))
    k = F.greatest(F.lit(1), F.expr("window_s div prev_s"))
    return both.withColumn("back", F.row_number().over(w)).where(F.col("back") <= k).select("channel", "window_s", "end_ms", "prev_s", "prev_end")


def interim_replacement(speech: DataFrame, slack_ms: int = 2000) -> DataFrame:
    """Speech without interim rows that a later arrival (column arrival) contains, within slack_ms on each side."""
    size = 60_000
    later = _covered(speech.select("channel", F.col("arrival").alias("at"), F.col("ts_ms").alias("s"), F.col("end_ms").alias("e")), F.col("s") - slack_ms, F.col("e") + slack_ms, size)
    interim = speech.where("not final").withColumn("slot", F.floor(F.col("ts_ms") / size))
    hit = F.expr(f"at > arrival and ts_ms > s - {slack_ms} and end_ms < e + {slack_ms}")
    gone = interim.join(later, ["channel", "slot"]).where(hit).select("channel", "event_id").distinct()
    return speech.join(gone, ["channel", "event_id"], "left_anti")


def pending_messages(chat: DataFrame, reasons: DataFrame, as_of: DataFrame | int, age_ms: int = PENDING_MS) -> DataFrame:
    """Messages of the last age_ms that have no reason row, as of a time, or of each channel's own (channel, as_of)."""
    rows = chat.withColumn("as_of", F.lit(as_of)) if isinstance(as_of, int) else chat.join(as_of.select("channel", "as_of"), "channel")
    recent = rows.where((F.col("ts_ms") > F.col("as_of") - age_ms) & (F.col("ts_ms") <= F.col("as_of"))).drop("as_of")
    return recent.join(reasons.select("channel", "event_id").distinct(), ["channel", "event_id"], "left_anti")


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (key) without a recorded response."""
    return requests.join(cache.select("key").distinct(), "key", "left_anti")


def cache_counts(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """How many requests (key) have a recorded response and how many have none."""
    rows = requests.join(cache.select("key").distinct().withColumn("hit", F.lit(True)), "key", "left")
    return rows.agg(F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))


def render_window(events: DataFrame, chat_only: bool = False) -> DataFrame:
    """Each window's final events as lines of tag, id, time, speaker and text."""
    rows = events.where("final")
    rows = rows.where(F.col("type") == CHAT) if chat_only else rows
    tag = F.when(F.col("type") == CHAT, "chat").when(F.col("type") == SPEECH, "speech").otherwise("screen")
    line = F.concat(F.lit("["), tag, F.lit("] "), "event_id", F.lit(" "), F.col("ts_ms").cast("string"), F.lit(" "), F.coalesce("author", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    return rows.groupBy(*SCOPE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts_ms", "type", "event_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def inspect(events: DataFrame) -> DataFrame:
    """Each channel's counts, span and compression."""
    key = T.canonical(F.col("text"))
    is_chat = F.col("type") == CHAT
    found = events.groupBy("channel").agg(F.count("*").alias("events"), F.count_if(is_chat).alias("chat"), F.count_if(F.col("type") == SPEECH).alias("transcript"), F.count_if(F.col("type") == FRAME).alias("frames"), (F.max("ts_ms") - F.min("ts_ms")).alias("span_ms"), F.countDistinct(F.when(is_chat, key)).alias("bursts"))
    return found.withColumn("compression_ratio", F.coalesce(F.bround(F.try_divide("bursts", "chat"), 3), F.lit(1.0)))
