"""What a window's rail shows: rates, reach, concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import BUCKET_MS, TILE_MS
from ..sources.events import CHAT, FRAME, SPEECH
from .cards import gate_ledger
from .grouping import grouped_summary
from .windows import SCOPE


def rate_buckets(chat: DataFrame, tile_ms: int = TILE_MS, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """`rate`: messages in each bucket of the window, zeros included, late ones in the last bucket."""
    n = max(1, -(-tile_ms // bucket_ms))
    at = F.least(F.expr(f"cast((ts_ms - win) div {bucket_ms} as int)"), F.lit(n - 1))
    sums = [F.count_if(F.greatest(at, F.lit(0)) == k) for k in range(n)]
    return chat.groupBy(*SCOPE).agg(F.array(*sums).alias("rate"))


def new_chatters(chat: DataFrame) -> DataFrame:
    """Authors of each window that no earlier window of the channel has; a null author counts as one."""
    first = chat.groupBy("channel", F.coalesce("author", F.lit("")).alias("author")).agg(F.min("win").alias("win"))
    return first.groupBy(*SCOPE).agg(F.count("*").alias("new_chatters"))


def concentration(chat: DataFrame, share: float = 0.1) -> DataFrame:
    """Unique chatters and the part of messages from the busiest tenth of them (one at least)."""
    each = chat.groupBy(*SCOPE, F.coalesce("author", F.lit("")).alias("author")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*SCOPE)
    ranked = each.withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "author"))).withColumn("authors", F.count("*").over(w))
    top = F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("authors") * share))
    return ranked.groupBy(*SCOPE).agg(F.first("authors").alias("unique_chatters"), F.bround(F.sum(F.when(top, F.col("n")).otherwise(0)) / F.sum("n"), 3).alias("concentration"))


def rail(events: DataFrame, questions: bool = False) -> DataFrame:
    """The measured facts of every window that has an event; with `questions`, how many messages ask."""
    chat = events.where(F.col("type") == CHAT)
    base = events.groupBy(*SCOPE).agg(*[F.count_if(F.col("type") == t).alias(n) for t, n in ((CHAT, "messages"), (SPEECH, "speech_segments"), (FRAME, "frame_captions"))])
    # counted where messages are read: no text is shuffled
    canon = chat.select(*SCOPE, "text", T.canonical(F.col("text")).alias("canon"))
    asks = [F.count_if(T.is_question(F.coalesce("text", F.lit("")), F.col("canon"))).alias("questions")] if questions else []
    waves = canon.groupBy(*SCOPE).agg(F.count_if(T.is_reaction(F.col("canon"))).alias("reaction_wave"), *asks)
    rows = base.join(waves, SCOPE, "left").join(rate_buckets(chat), SCOPE, "left").join(concentration(chat), SCOPE, "left").join(new_chatters(chat), SCOPE, "left")
    peak = F.coalesce(F.array_max("rate"), F.lit(0))
    return rows.select(
        *SCOPE, "messages", "rate", peak.alias("peak_burst"), F.bround(peak / (BUCKET_MS / 1000), 2).alias("peak_per_second"), F.coalesce("unique_chatters", F.lit(0)).alias("unique_chatters"), F.coalesce("new_chatters", F.lit(0)).alias("new_chatters"),
        F.coalesce(F.bround(F.try_divide("messages", "unique_chatters"), 2), F.lit(0.0)).alias("messages_per_chatter"), F.coalesce("concentration", F.lit(0.0)).alias("concentration"), F.coalesce("reaction_wave", F.lit(0)).alias("reaction_wave"), "speech_segments", (F.col("speech_segments") == 0).alias("silent"), "frame_captions",
        *(["questions"] if questions else []),
    )


def full_rail(events: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """rail() with what a window's messages are made of (groups, grouped messages, singletons), how many ask, and its gate ledger.

    checked are cards through the gate (cards.check_cards); their window is that of their start.
    """
    parts = grouped_summary(events.where(F.col("type") == CHAT)).select(*SCOPE, "groups", "grouped", F.col("ungrouped").alias("singletons"))
    rows = rail(events, questions=True).join(parts, SCOPE, "left")
    rows = rows.select(*[c for c in rows.columns if c != "questions"], "questions")
    counts = ["groups", "grouped", "singletons", "questions"]
    if checked is not None:
        ledger = gate_ledger(checked)
        codes = F.array_join(F.transform("codes", lambda c: F.concat_ws(" ", c["code"], c["n"].cast("string"))), ",")
        rows = rows.join(ledger.select(*SCOPE, "verified", "abstained", "rejected", codes.alias("codes")), SCOPE, "left")
        counts += ["verified", "abstained", "rejected"]
    return rows.fillna(0, counts)


def mention_census(chat: DataFrame) -> DataFrame:
    """Mentions and distinct handles by channel, and in all (null channel)."""
    rows = chat.select("channel", F.explode(T.mentions(F.col("text"))).alias("handle"))
    return rows.rollup("channel").agg(F.count("*").alias("mentions"), F.countDistinct(F.lower("handle")).alias("handles"))
