"""Live channels with keyed state and event-time timers: closed tiles, ticks of the trailing minute, speech whose interim rows go.

State lives in the engine's state store and is covered by its checkpoints; set
spark.sql.streaming.stateStore.providerClass to the RocksDB provider (require_rocksdb).
Each operator keeps the events that a timer still needs and hands them out as rows; groups,
boards, questions and counts are then DataFrame operators over the rows of a micro-batch,
the same ones that run over whole tables (for foreachBatch).

A timer fires once the watermark, the latest event time less LATENESS, has reached it, so all
events that belong to its result have come; later ones are dropped by the engine, and
LateRows counts them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.fixed import TILE_MS
from ..operators.board import board
from ..operators.grouping import assigned, group_chat, prepared, top_groups
from ..operators.questions import TICK_MS, questions
from ..sources.events import CHAT, FRAME, SPEECH
from .feeds import LATENESS, timed

EVENT = "event_id string, type string, ts_ms long, end_ms long, author string, text string, final boolean"
FIELDS = [c.split()[0] for c in EVENT.split(", ")]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def require_rocksdb(spark: SparkSession) -> None:
    """Chooses the state store that keyed state with timers needs."""
    spark.conf.set(PROVIDER, ROCKSDB)


def _tuples(rows: pd.DataFrame, schema: str) -> list[tuple]:
    """Rows as tuples of the schema's types; pandas' missing values as None."""
    to = [{"long": int, "boolean": bool}.get(c.split()[1], str) for c in schema.split(", ")]
    names = [c.split()[0] for c in schema.split(", ")]
    return [tuple(None if v is None or v != v else f(v) for v, f in zip(r, to)) for r in rows[names].astype(object).itertuples(index=False)]


class _Held(StatefulProcessor):
    """Events of one channel, its first event's time (`origin`), the last result's time (`done`) and one pending timer (`due`).

    The origin is the least time until the first timer fires: then no earlier event can come.
    """

    span = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", EVENT)
        self.clock = handle.getValueState("clock", "origin long, done long, due long")

    def next_due(self, origin: int, events: list[tuple], done: int) -> int | None:
        """When the next result over events is complete, after `done`."""
        raise NotImplementedError

    def starts(self, event: tuple) -> bool:
        """Whether the event can be the channel's first."""
        return True

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for part in rows for r in _tuples(part, EVENT)]
        events = [*self.events.get(), *new]
        origin, done, due = self.clock.get() if self.clock.exists() else (None, None, None)
        if done is None:
            origin = min((r[2] for r in events if self.starts(r)), default=None)
        if origin is None:  # nothing begins yet: only what a first tick could see is kept
            self._keep([r for r in events if r[2] > timerValues.getCurrentWatermarkInMs() - self.span])
        else:
            self.events.appendList(new)
            self._wait(origin, done, due, events)
        return iter([])

    def _keep(self, events: list[tuple]) -> None:
        self.events.put(events) if events else self.events.clear()

    def _wait(self, origin: int, done: int | None, old: int | None, events: list[tuple]) -> None:
        """One timer, at the next result."""
        due = self.next_due(origin, events, origin if done is None else done)
        if old is not None and old != due:
            self.handle.deleteTimer(old)
        if due is not None and old != due:
            self.handle.registerTimer(due)
        self.clock.update((origin, done, due))

    def close(self) -> None:
        pass


class ClosedTiles(_Held):
    """Events of each tile, once, when it has closed; only events of open tiles are state."""

    def __init__(self, size_ms: int = TILE_MS):
        self.size = size_ms

    def next_due(self, origin: int, events: list[tuple], done: int) -> int | None:
        return min((origin + ((r[2] - origin) // self.size + 1) * self.size for r in events), default=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        origin = self.clock.get()[0]
        events, now = list(self.events.get()), timerValues.getCurrentWatermarkInMs()
        until = origin + (now - origin) // self.size * self.size
        closed, held = [r for r in events if r[2] < until], [r for r in events if r[2] >= until]
        self._keep(held)
        self._wait(origin, until, None, held)
        out = pd.DataFrame(closed, columns=FIELDS)
        out.insert(0, "channel", key[0])
        out.insert(1, "win", [origin + (t - origin) // self.size * self.size for t in out["ts_ms"]])
        yield out


class Ticks(_Held):
    """At every tick, counted from the channel's first message, the events of (tick - span, tick]; events of the last span are state."""

    def __init__(self, span_ms: int = TILE_MS, tick_ms: int = TICK_MS):
        self.span, self.tick = span_ms, tick_ms

    def starts(self, event: tuple) -> bool:
        return event[1] == CHAT

    def next_due(self, origin: int, events: list[tuple], done: int) -> int | None:
        """The first tick after `done` that sees an event."""
        return min((max(done + self.tick, origin - (origin - r[2]) // self.tick * self.tick) for r in events), default=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        origin, done, tick = self.clock.get()
        events, now = sorted(self.events.get(), key=lambda r: r[2]), timerValues.getCurrentWatermarkInMs()
        while tick is not None and tick <= now:
            out = pd.DataFrame([r for r in events if tick - self.span < r[2] <= tick], columns=FIELDS)
            out.insert(0, "channel", key[0])
            out.insert(1, "tick", tick)
            yield out
            done = tick
            events = [r for r in events if r[2] > tick + self.tick - self.span]
            tick = self.next_due(origin, events, done)
        self._keep(events)
        self._wait(origin, done, None, events)


def _with(events: DataFrame, processor: StatefulProcessor, columns: str, lateness: str) -> DataFrame:
    rows = timed(events).withColumn("channel", F.coalesce("channel", F.lit(""))).withWatermark("time", lateness)
    return rows.groupBy("channel").transformWithStateInPandas(processor, columns, "append", "eventTime")


def closed_tiles(events: DataFrame, size_ms: int = TILE_MS, lateness: str = LATENESS) -> DataFrame:
    """The stream of events with `win`, each once its tile has closed; tiles begin at the channel's first event (a null channel is '')."""
    return _with(events, ClosedTiles(size_ms), f"channel string, win long, {EVENT}", lateness)


def trailing_ticks(events: DataFrame, span_ms: int = TILE_MS, tick_ms: int = TICK_MS, lateness: str = LATENESS) -> DataFrame:
    """The stream of (channel, tick, event) for the events of each tick's trailing span."""
    return _with(events, Ticks(span_ms, tick_ms), f"channel string, tick long, {EVENT}", lateness)


def tumbling_board(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over closed_tiles(): the board of each tile; a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        board(batch.persist()).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        batch.unpersist()

    return write


TICK = ["channel", "tick"]


def snapshot(rows: DataFrame, k: int = 5, ids: int = 12, most_questions: int = 12) -> dict[str, DataFrame]:
    """What each tick shows, from rows of (channel, tick, event): groups with their first ids, questions, counts of the rail."""
    chat = prepared(rows.where(F.col("type") == CHAT), TICK)
    groups = top_groups(group_chat(chat, TICK, 2), TICK, k)
    member = assigned(chat, TICK).join(groups.select(*TICK, "key"), [*TICK, "key"]).join(chat.select(*TICK, "event_id", "ts_ms"), [*TICK, "event_id"])
    place = F.row_number().over(Window.partitionBy(*TICK, "key").orderBy("ts_ms", "event_id"))
    first = member.withColumn("n", place).where(F.col("n") <= ids).groupBy(*TICK, "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "event_id"))), lambda x: x["event_id"]).alias("event_ids"))
    asked = questions(chat, TICK).where(F.col("rank") <= most_questions)
    of = lambda kind: F.count_if(F.col("type") == kind)
    chatters = F.countDistinct(F.when(F.col("type") == CHAT, F.coalesce("author", F.lit(""))))
    counts = rows.groupBy(*TICK).agg(of(CHAT).alias("messages"), chatters.alias("chatters"), of(SPEECH).alias("speech"), of(FRAME).alias("frames"))
    return {"groups": groups.join(first, [*TICK, "key"]), "questions": asked, "counts": counts}


def live_snapshot(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over trailing_ticks(): snapshot() as tables under folder; a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        for name, rows in snapshot(batch.persist()).items():
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        batch.unpersist()

    return write


SPOKEN = "event_id string, ts_ms long, end_ms long, text string, speaker string, final boolean, arrival long"


class Interims(StatefulProcessor):
    """Speech rows as they come, and a tombstone for each interim row that a later arrival contains.

    Only interim rows that a later arrival can still contain are state: one that begins slack_ms
    after an interim row's begin, or later, cannot, so a timer there forgets it.
    """

    def __init__(self, slack_ms: int = 2000):
        self.slack = slack_ms
        self.fields = [c.split()[0] for c in SPOKEN.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", SPOKEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = sorted((r for part in rows for r in _tuples(part, SPOKEN)), key=lambda r: r[6])
        held, out = list(self.pending.get()), []
        both = held + [r for r in new if not r[5]]
        kept = []
        for p in both:
            over = any(r[6] > p[6] and p[1] > r[1] - self.slack and p[2] < r[2] + self.slack for r in new)
            (out if over else kept).append(p)
        for p in kept:
            self.handle.registerTimer(p[1] + self.slack)
        self.pending.put(kept) if kept else self.pending.clear()
        frame = pd.DataFrame([("put", *r) for r in new] + [("drop", *p) for p in out], columns=["op", *self.fields])
        frame.insert(0, "channel", key[0])
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = [p for p in self.pending.get() if p[1] + self.slack > expiredTimerInfo.getExpiryTimeInMs()]
        self.pending.put(kept) if kept else self.pending.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_interims(speech: DataFrame, slack_ms: int = 2000, lateness: str = LATENESS) -> DataFrame:
    """`op` put or drop for speech (channel and SPOKEN; arrival orders the rows as they came)."""
    return _with(speech, Interims(slack_ms), f"channel string, op string, {SPOKEN}", lateness)


def merge_batches(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over stream_interims(): changes by batch; a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def merged(changes: DataFrame) -> DataFrame:
    """The rows that stand after all changes: those put and never dropped."""
    gone = changes.where("op = 'drop'").select("channel", "event_id", "arrival").distinct()
    return changes.where("op = 'put'").drop("op", "batch").join(gone, ["channel", "event_id", "arrival"], "left_anti")


class LateRows(StreamingQueryListener):
    """Counts the rows that the engine dropped behind the watermark, by query and batch.

    spark.streams.addListener(late); the counts of the last `most` batches with such rows are kept.
    """

    def __init__(self, most: int = 10_000):
        self.most = most
        self.rows: list[tuple[str, str | None, int, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        dropped = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        if dropped:
            self.rows = [*self.rows, (str(p.id), p.name, p.batchId, dropped)][-self.most :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "query string, name string, batch long, dropped long")
