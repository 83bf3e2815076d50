"""Recorded runs: which captures there are, where their numbers come from, and one run as a time-ordered script."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import TILE_MS
from ..plans.store import stored
from ..sources.events import CHAT
from .scan import ranged, scanned
from .windows import SCOPE, origins

SYSTEMS = ("agent", "baseline")
#: The kind of a capture whose numbers may be reported (fixed value).
REPORTABLE = "capture"
KINDS = ("chat", "card", "board", "tick")


def available_captures(meta: DataFrame, results: DataFrame) -> DataFrame:
    """Enriched captures (load_meta) with a recorded run: results (fixture_id, system); `systems` in the order of SYSTEMS."""
    known = results.where(F.col("system").isin(*SYSTEMS)).groupBy("fixture_id").agg(F.collect_set("system").alias("found"))
    systems = F.filter(F.array(*map(F.lit, SYSTEMS)), lambda x: F.array_contains("found", x))
    return meta.where("enriched").join(known, "fixture_id").select("fixture_id", "channel", "captured_utc", "duration_s", "chat_messages", systems.alias("systems"))


def fixture_provenance(cases: DataFrame, meta: DataFrame) -> DataFrame:
    """Each capture that cases (case_id, fixture, fixture_kind) use, with its kind, channel, provenance and cases; `reportable` if it was captured from a broadcast."""
    used = cases.groupBy("fixture").agg(F.coalesce(F.min_by("fixture_kind", "case_id"), F.lit("unknown")).alias("kind"), F.array_sort(F.collect_set("case_id")).alias("cases"))
    return used.join(meta.select(F.col("fixture_id").alias("fixture"), "channel", "provenance"), "fixture", "left").withColumn("reportable", F.col("kind") == REPORTABLE)


def union_emitted(verified: DataFrame, rejected: DataFrame, scope: list[str]) -> DataFrame:
    """Every card that a system gave, in emission order: `place` by the text of signal_id."""
    both = verified.unionByName(rejected, allowMissingColumns=True)
    return both.withColumn("place", F.row_number().over(Window.partitionBy(*scope).orderBy(F.coalesce("signal_id", F.lit("")))))


def hero_lead_up(cards: DataFrame, events: DataFrame, span: int = 12) -> DataFrame:
    """The chat before one card of each channel: up to `span` messages of its window that end at the first cited one.

    cards: grounded ones. Screen triggers come first, then the earliest window, then the
    signal_id. Without a cited message in the window its first `span` messages are taken.
    """
    order = Window.partitionBy("channel").orderBy(F.coalesce(F.col("trigger.kind"), F.lit("")) != "frame_caption", F.get("window_ms", F.lit(0)), "signal_id")
    hero = cards.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("channel", "signal_id", "evidence", F.get("window_ms", F.lit(0)).alias("lo"), F.get("window_ms", F.lit(1)).alias("hi"))
    # one row a channel goes to the events, so that no text is shuffled but those of the windows
    chat = events.where(F.col("type") == CHAT).join(F.broadcast(hero), "channel").where("ts_ms >= lo and ts_ms < hi")
    w = Window.partitionBy("channel").orderBy("ts_ms", "event_id")
    rows = chat.withColumn("cited", F.array_contains("evidence", F.col("event_id"))).withColumn("n", F.row_number().over(w))
    stop = F.min(F.when(F.col("cited"), F.col("n"))).over(Window.partitionBy("channel"))
    rows = rows.withColumn("stop", F.coalesce(stop, F.lit(span))).where((F.col("n") <= F.col("stop")) & (F.col("n") > F.col("stop") - span))
    return rows.select("channel", "signal_id", F.row_number().over(w).alias("place"), "event_id", "text", "cited")


def closes(chat_tiles: DataFrame, chat: DataFrame, size_ms: int = TILE_MS, origin: DataFrame | None = None) -> DataFrame:
    """channel, win, close_ms: ends of the tiles that hold chat, from the channel's first message on (`origin`: origins(chat), where known)."""
    origin = origins(chat) if origin is None else origin
    return chat_tiles.select(*SCOPE).distinct().join(F.broadcast(origin), "channel").select(*SCOPE, F.greatest(F.lit(0), F.col("win") + size_ms - F.col("origin")).alias("close_ms"))


def next_closes(ticks: DataFrame, ends: DataFrame) -> DataFrame:
    """ticks (channel, at_ms) with the first close at or after each, or null.

    Read backwards in time that is the last close so far, a prefix scan; a frame that ends
    where the channel does would be read again for every row.
    """
    tick = ticks.select("channel", (-F.col("at_ms")).alias("back"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("close_ms"))
    end = ends.select("channel", (-F.col("close_ms")).alias("back"), F.lit(0).alias("side"), F.col("close_ms").cast("long").alias("close_ms"))
    found = scanned(ranged(tick.unionByName(end), ["channel"], ["back", "side"]), ["channel"], lasts={"next_close_ms": F.col("close_ms")})
    return found.where("side = 1").select("channel", (-F.col("back")).alias("at_ms"), "next_close_ms").distinct()


def replay_script(chat: DataFrame, cards: DataFrame, chat_tiles: DataFrame, ticks: DataFrame) -> DataFrame:
    """One feed of each channel: messages at their offset, cards and boards when their window closes, ticks between.

    cards: channel, signal_id, window_ms; chat_tiles: channel, win of tiles with chat; ticks:
    channel, tick. Rows: channel, at_ms, kind, id, next_close_ms (ticks alone).
    """
    origin = stored(origins(chat), "origins")
    none = F.lit(None).cast("long").alias("next_close_ms")
    said = chat.join(F.broadcast(origin), "channel").select("channel", (F.col("ts_ms") - F.col("origin")).alias("at_ms"), F.lit("chat").alias("kind"), F.col("event_id").alias("id"), none)
    claims = cards.join(F.broadcast(origin), "channel").select("channel", F.greatest(F.lit(0), F.coalesce(F.get("window_ms", F.lit(1)), F.col("origin")) - F.col("origin")).alias("at_ms"), F.lit("card").alias("kind"), F.col("signal_id").alias("id"), none)
    ends = stored(closes(chat_tiles, chat, origin=origin), "closes")
    boards = ends.select("channel", F.col("close_ms").alias("at_ms"), F.lit("board").alias("kind"), F.col("win").cast("string").alias("id"), none)
    at = ticks.join(F.broadcast(origin), "channel").select("channel", (F.col("tick") - F.col("origin")).alias("at_ms"))
    beats = next_closes(at, ends).select("channel", "at_ms", F.lit("tick").alias("kind"), F.col("at_ms").cast("string").alias("id"), "next_close_ms")
    return said.unionByName(claims).unionByName(boards).unionByName(beats)
