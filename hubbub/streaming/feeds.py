"""Live feeds with Structured Streaming: deduplication, counts, segments, timers, new chatters, upserts. Boards and ticks are in live.

Events have a `time` column (the source's time, a timestamp); rows later than the watermark
are dropped by the engine, which counts them in the query's progress.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.parsing import SEGMENT_GAP_MS

LATENESS = "2 minutes"


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("time", F.timestamp_millis("ts_ms"))


def stream_dedupe(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each (channel, event_id) once; ids are forgotten after the watermark."""
    return timed(events).withWatermark("time", lateness).dropDuplicatesWithinWatermark(["channel", "event_id"])


def tumbling_counts(events: DataFrame, size: str = "60 seconds", lateness: str = LATENESS) -> DataFrame:
    """Counts of each tile by type; in append mode a tile comes once, when it has closed."""
    rows = timed(events).withWatermark("time", lateness).groupBy("channel", F.window("time", size)).agg(F.count("*").alias("n"), *[F.count_if(F.col("type") == t).alias(n) for t, n in (("chat_message", "messages"), ("transcript_segment", "speech"), ("frame_caption", "frames"))])
    return rows.select("channel", F.unix_millis("window.start").alias("win"), "n", "messages", "speech", "frames")


def sliding_counts(events: DataFrame, size: str = "60 seconds", every: str = "2 seconds", lateness: str = LATENESS) -> DataFrame:
    """Messages of the trailing minute at every tick."""
    rows = timed(events).withWatermark("time", lateness).groupBy("channel", F.window("time", size, every)).agg(F.count("*").alias("n"))
    return rows.select("channel", F.unix_millis("window.end").alias("tick"), "n")


def stream_new_chatters(chat: DataFrame, forget: str = "12 hours") -> DataFrame:
    """The first message of each author of a channel. The state forgets an author `forget` after it, so that it is bounded; then they are new again."""
    rows = timed(chat).withColumn("author", F.coalesce("author", F.lit("")))
    return rows.withWatermark("time", forget).dropDuplicatesWithinWatermark(["channel", "author"])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Of the rows with equal keys, the one of the highest version; of equal ones, the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_new")


def upsert_batches(folder: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch in a folder of its own, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def latest(folder_rows: DataFrame, keys: list[str]) -> DataFrame:
    """The current row of each key in a folder that upsert_batches writes."""
    return upsert(folder_rows.where("false"), folder_rows, keys, "version")


SEGMENT = "ts_ms long, end_ms long, speaker string, said string"


def close_words(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, gap_ms: int = SEGMENT_GAP_MS) -> Iterator[pd.DataFrame]:
    """Words of one channel in order as segments: one closes when the speaker changes, the pause is too long, or the watermark has passed it."""
    out = []
    now = list(state.get) if state.exists else None

    def close() -> None:
        text = " ".join(now[3].split())
        if text:
            out.append((key[0], now[0], max(now[0], now[1]), text, now[2]))

    rows = pd.concat(list(batches), ignore_index=True) if not state.hasTimedOut else pd.DataFrame()
    if state.hasTimedOut and now:
        close()
        now = None
    if len(rows):
        for r in rows.sort_values(["start_ms", "pos"]).itertuples():
            speaker = None if pd.isna(r.speaker) else r.speaker
            if now and now[2] == speaker and r.start_ms - now[1] <= gap_ms:
                now = [now[0], int(r.end_ms), speaker, f"{now[3]} {r.word}"]
            else:
                if now:
                    close()
                now = [int(r.start_ms), int(r.end_ms), speaker, r.word]
    if now:
        state.update(tuple(now))
        state.setTimeoutTimestamp(max(now[1] + gap_ms + 1, state.getCurrentWatermarkMs() + 1))
    else:
        state.remove()
    yield pd.DataFrame(out, columns=["channel", "ts_ms", "end_ms", "text", "speaker"])


def stream_words_to_segments(words: DataFrame, lateness: str = "5 seconds") -> DataFrame:
    """Words (channel, pos, start_ms, end_ms, speaker, word), in order within a channel, as closed segments; one open segment a channel is state."""
    rows = words.withColumn("time", F.timestamp_millis("start_ms")).withWatermark("time", lateness)
    return rows.groupBy("channel").applyInPandasWithState(close_words, "channel string, ts_ms long, end_ms long, text string, speaker string", SEGMENT, "append", GroupStateTimeout.EventTimeTimeout)


def note_quiet(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, after_ms: int = 12_000) -> Iterator[pd.DataFrame]:
    """One row `quiet` for a channel without a message for after_ms since it was joined; its first message ends the watch."""
    if state.hasTimedOut:
        state.update((True,))
        yield pd.DataFrame({"channel": [key[0]], "status": ["quiet"]})
        return
    spoke = any((b["type"] == "chat_message").any() for b in batches)
    done = bool(state.get[0]) if state.exists else False
    state.update((done or spoke,))
    if not done and not spoke:
        state.setTimeoutDuration(after_ms)
    yield pd.DataFrame({"channel": [], "status": []})


def quiet_channels(events: DataFrame, after_ms: int = 12_000) -> DataFrame:
    """events with a row of type `join` for each channel that is joined."""
    return events.groupBy("channel").applyInPandasWithState(partial(note_quiet, after_ms=after_ms), "channel string, status string", "done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def flush_messages(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, size: int = 3, age_ms: int = 1000) -> Iterator[pd.DataFrame]:
    """Messages of one channel in batches of `size`; what is left goes out age_ms after the last call. Batch numbers go on."""
    number, held = (state.get[0], list(state.get[1])) if state.exists else (0, [])
    out = []
    if not state.hasTimedOut:
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts_ms", "event_id"])
        held += rows["event_id"].tolist()
    while len(held) >= size or held and state.hasTimedOut:
        out += [(key[0], number, k + 1, i) for k, i in enumerate(held[:size])]
        number, held = number + 1, held[size:]
    state.update((number, held))
    if held:
        state.setTimeoutDuration(age_ms)
    yield pd.DataFrame(out, columns=["channel", "batch", "number", "event_id"])


def micro_batches(chat: DataFrame) -> DataFrame:
    """channel, batch, number, event_id; at most size - 1 ids a channel are state."""
    return chat.groupBy("channel").applyInPandasWithState(flush_messages, "channel string, batch long, number long, event_id string", "number long, held array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)
