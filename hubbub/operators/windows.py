"""Time windows of a channel: tiles, half-open slices, order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import TILE_MS
from .scan import numbered

SCOPE = ["channel", "win"]


def tiled(events: DataFrame, size_ms: int = TILE_MS, first: DataFrame | None = None) -> DataFrame:
    """events with `win`, the start of its tile; tiles begin at the channel's first event.

    First times are aggregated before they are joined back: one small row a channel, which
    goes to the events, so that no text is shuffled for it. `first` is origins(events), where known.
    """
    if size_ms <= 0:
        raise ValueError("tiles need a positive size")
    return events.join(F.broadcast(origins(events) if first is None else first), "channel").withColumn("win", F.expr(f"origin + (ts_ms - origin) div {size_ms} * {size_ms}")).drop("origin")


def origins(events: DataFrame) -> DataFrame:
    """`origin` of each channel, the time of its first event."""
    return events.groupBy("channel").agg(F.min("ts_ms").alias("origin"))


def all_tiles(tiled_events: DataFrame, size_ms: int = TILE_MS) -> DataFrame:
    """Every tile from a channel's first event to its last, those without events too."""
    ends = tiled_events.groupBy("channel").agg(F.min("win").alias("lo"), F.max("win").alias("hi"))
    return ends.select("channel", F.explode(F.sequence("lo", "hi", F.lit(size_ms).cast("long"))).alias("win"))


def window_filter(events: DataFrame, start: int, end: int, types: list[str] | None = None, final_only: bool = False) -> DataFrame:
    rows = events.where((F.col("ts_ms") >= start) & (F.col("ts_ms") < end))
    rows = rows.where(F.col("type").isin(types)) if types else rows
    return rows.where("final") if final_only else rows


def slices(events: DataFrame, windows: DataFrame, size_ms: int = TILE_MS) -> DataFrame:
    """Events of requested windows (channel, start, end), half-open, with the window's start and end.

    A window is cut into time slots, so that the join is on (channel, slot).
    """
    asked = windows.where("end > start").withColumn("_slot", F.explode(F.sequence(F.floor(F.col("start") / size_ms), F.floor((F.col("end") - 1) / size_ms))))
    return events.withColumn("_slot", F.floor(F.col("ts_ms") / size_ms)).join(asked, ["channel", "_slot"]).where("ts_ms >= start and ts_ms < end").drop("_slot")


def total_order(events: DataFrame) -> DataFrame:
    """`place` of each event in its channel, by (ts_ms, type, event_id); a hot channel is spread over tasks."""
    return numbered(events, ["channel"], ["ts_ms", "type", "event_id"])
