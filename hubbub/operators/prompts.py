"""The data side of model calls: what goes in, and what of an answer is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.events import CHAT, FRAME, SPEECH
from .context import LATEST, LEVELS_S

MAX_GROUPS, MAX_LABEL = 16, 90
CONTEXT_MS, CONTINUE_MS = 120_000, 300_000


def trace_id(agent: Column, case_id: Column) -> Column:
    return F.concat(F.lit("trc_"), F.substring(F.sha2(F.concat(agent, F.lit("|"), case_id), 256), 1, 8))


def request_hash(request: Column) -> Column:
    """SHA-256 of a request's JSON without spaces and with the keys of every object in order."""
    return F.sha2(F.to_json(F.parse_json(request)), 256)


def group_labels_prompt(groups: DataFrame, triggers: DataFrame, scope: list[str]) -> DataFrame:
    """One prompt for each scope: its first MAX_GROUPS groups with samples, after what was happening (triggers: scope, text)."""
    w = Window.partitionBy(*scope).orderBy(F.desc("count"), "first_ts_ms", "key")
    rows = groups.where((F.col("key") != "") & (F.size("samples") > 0)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= MAX_GROUPS)
    samples = F.array_join(F.transform(F.slice("samples", 1, 3), lambda s: F.substring(s, 1, 60)), " | ")
    line = F.concat(F.lit("key="), "key", F.lit(" count="), F.col("count").cast("string"), F.lit(" messages: "), samples)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"])
    body = rows.groupBy(*scope).agg(F.array_join(lines, "\n").alias("body")).join(triggers.select(*scope, F.col("text").alias("trigger")), scope, "left")
    head = F.when(F.coalesce("trigger", F.lit("")) != "", F.concat(F.lit("What was happening: "), F.substring("trigger", 1, 200), F.lit("\n\n"))).otherwise("")
    return body.select(*scope, F.concat(head, "body").alias("prompt"))


def apply_labels(groups: DataFrame, replies: DataFrame, scope: list[str]) -> DataFrame:
    """groups with `meaning` from replies (scope, reply): a reply that is no JSON gives none, nor does a key that was not asked for."""
    given = replies.select(*scope, F.explode(F.from_json(F.get_json_object("reply", "$.labels"), "map<string, string>")).alias("key", "said"))
    text = F.substring(F.trim(F.regexp_replace("said", r"(?U)\s+", " ")), 1, MAX_LABEL)
    given = given.select(*scope, "key", text.alias("meaning")).where("meaning <> ''")
    return groups.join(given, [*scope, "key"], "left")


def summary_inputs(events: DataFrame, summaries: DataFrame, levels_s: tuple[int, ...] = LEVELS_S, last: int = 20) -> DataFrame:
    """Text blocks of each (channel, window_s, end_ms): the latest chat, speech, captions and summaries of the level below.

    summaries: channel, window_s, end_ms, summary. Chat and captions count by their time, speech by overlap.
    """
    size = F.col("window_s") * 1000
    until = F.when((F.col("type") == SPEECH) & (F.col("end_ms") > F.col("ts_ms")), F.col("end_ms") - 1).otherwise(F.col("ts_ms"))
    rows = events.where("final").withColumn("until", until).withColumn("window_s", F.explode(F.array(*map(F.lit, levels_s))))
    rows = rows.withColumn("stop", F.explode(F.transform(F.sequence(F.floor(F.col("ts_ms") / size), F.floor(F.col("until") / size)), lambda k: (k + 1) * size)))
    scope = ["channel", "window_s", "stop"]
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in LATEST.items() for x in pair]), F.col("type"))
    back = F.row_number().over(Window.partitionBy(*scope, "type").orderBy(F.desc("ts_ms"), F.desc("event_id")))
    rows = rows.withColumn("back", back).where(F.col("back") <= limit)
    stamp = F.col("ts_ms").cast("string")
    line = F.when(F.col("type") == CHAT, F.concat(stamp, F.lit(": "), F.coalesce("author", F.lit("")), F.lit(": "), "text")).when(F.col("type") == SPEECH, F.concat(stamp, F.lit("-"), F.col("end_ms").cast("string"), F.lit(": "), "text")).otherwise(F.concat(stamp, F.lit(": "), "text"))

    def block(kind: str) -> Column:
        lines = F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct((-F.col("back")).alias("k"), line.alias("line")))))
        return F.array_join(F.transform(lines, lambda x: x["line"]), "\n")

    blocks = rows.groupBy(*scope).agg(block(CHAT).alias("chat"), block(SPEECH).alias("audio"), block(FRAME).alias("frames"))
    above = {p: w for p, w in zip(levels_s, levels_s[1:])}
    upper = F.element_at(F.create_map(*[F.lit(x) for pair in above.items() for x in pair]), F.col("window_s"))
    prev = summaries.where(F.col("window_s").isin(*above)).select("channel", upper.alias("up"), "window_s", "end_ms", "summary")
    prev = prev.withColumn("stop", F.ceil(F.col("end_ms") / (F.col("up") * 1000)) * F.col("up") * 1000)
    near = F.row_number().over(Window.partitionBy("channel", "up", "stop").orderBy(F.desc("end_ms")))
    kept = F.least(F.lit(last), F.greatest(F.lit(1), F.expr("up div window_s")))
    prev = prev.withColumn("near", near).where(F.col("near") <= kept)
    said = F.array_sort(F.collect_list(F.struct("end_ms", F.concat(F.col("end_ms").cast("string"), F.lit(": "), "summary").alias("line"))))
    prev = prev.groupBy("channel", F.col("up").alias("window_s"), "stop").agg(F.array_join(F.transform(said, lambda x: x["line"]), "\n").alias("prev"))
    return blocks.join(prev, scope, "left").withColumnRenamed("stop", "end_ms").withColumn("prev", F.coalesce("prev", F.lit("")))


def rolling_context(events: DataFrame, every_ms: int = CONTEXT_MS, continue_ms: int = CONTINUE_MS) -> DataFrame:
    """At every tick with both speech and captions in the time since the last one: their texts, and whether the last context goes on.

    Ticks are multiples of every_ms; an event belongs to the tick that ends its slot.
    """
    rows = events.where(F.col("type").isin(SPEECH, FRAME)).withColumn("tick", F.ceil(F.col("ts_ms") / every_ms) * every_ms)

    def block(kind: str) -> Column:
        lines = F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("ts_ms", "event_id", "text"))))
        return F.array_join(F.transform(lines, lambda x: F.coalesce(x["text"], F.lit(""))), "\n")

    found = rows.groupBy("channel", "tick").agg(F.count_if(F.col("type") == SPEECH).alias("speech"), F.count_if(F.col("type") == FRAME).alias("frames"), block(SPEECH).alias("speech_sum"), block(FRAME).alias("frames_sum"))
    before = F.lag("tick").over(Window.partitionBy("channel").orderBy("tick"))
    found = found.where("speech > 0 and frames > 0").withColumn("continues", F.coalesce(before > F.col("tick") - continue_ms, F.lit(False)))
    return found.select("channel", "tick", "continues", "speech_sum", "frames_sum")
