"""Live channels as real streams, held against the operators over whole tables; prefix scans over a hot channel."""

import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hubbub.operators import context, questions, scan, windows
from hubbub.operators.board import board
from hubbub.sources import parsing
from hubbub.sources.events import CHAT, SPEECH
from hubbub.streaming import feeds, live

EVENT = "channel string, event_id string, type string, ts_ms long, end_ms long, author string, text string, final boolean"


@pytest.fixture(autouse=True)
def store(spark):
    live.require_rocksdb(spark)


def chat(channel, name, ts, text="LOL", author="x"):
    return (channel, name, CHAT, ts, ts, author, text, True)


class Feed:
    """Rows given file by file; run() reads what is new, one file a batch, and stops."""

    def __init__(self, spark, root, schema, make, write):
        self.spark, self.root, self.schema, self.make, self.write, self.files = spark, root, schema, make, write, 0

    def give(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        time.sleep(0.02)  # files are read by their time

    def run(self, name=None):
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/in")
        writer = self.make(source).writeStream.foreachBatch(self.write).option("checkpointLocation", f"{self.root}/state")
        query = (writer.queryName(name) if name else writer).trigger(availableNow=True).start()
        assert query.awaitTermination(300)
        if query.exception():
            raise query.exception()


def test_boards_of_closed_tiles_and_late_rows(spark, tmp_path):
    late = live.LateRows()
    spark.streams.addListener(late)
    speech = ("c", "s", SPEECH, 500_000, 500_500, None, "hello there", True)
    batches = [[speech, chat("c", "a", 501_000), chat("c", "b", 561_000)], [chat("c", "d", 502_000), chat("c", "e", 685_000)], [chat("c", "f", 503_000), chat("c", "g", 760_000)]]
    feed = Feed(spark, str(tmp_path), EVENT, live.closed_tiles, live.tumbling_board(f"{tmp_path}/boards"))
    for rows in batches[:2]:
        feed.give(rows)
    feed.run("tiles")
    feed.give(batches[2])
    feed.run("tiles")  # from the checkpoint
    found = {(r.win, r.trigger_id, r["count"]) for r in spark.read.parquet(f"{tmp_path}/boards").collect()}
    whole = board(windows.tiled(spark.createDataFrame([r for b in batches for r in b if r[1] != "f"], EVENT)))
    told = {(r.win, r.trigger_id, r["count"]) for r in whole.collect() if r.win < 560_000}
    assert found == told == {(500_000, "s", 2)}
    for _ in range(50):
        if late.rows:
            break
        time.sleep(0.2)
    spark.streams.removeListener(late)
    assert [(r.name, r.dropped) for r in late.table(spark).collect()] == [("tiles", 1)]


def test_closed_tiles_hold_only_open_ones(spark, tmp_path):
    """Every event of a closed tile comes once, with the tile that a whole table would give it, whatever the order of arrival."""
    rng = random.Random(4)
    rows = [chat(c, f"{c}{k}", 10**6 + rng.randrange(900_000), f"line {k % 7}") for c in "ab" for k in range(150)]
    rows.sort(key=lambda r: r[3] + rng.randrange(100_000))
    kept = []
    feed = Feed(spark, str(tmp_path), EVENT, live.closed_tiles, lambda batch, n: kept.extend(batch.select("channel", "event_id", "win").collect()))
    for k in range(0, len(rows), 75):
        feed.give(rows[k : k + 75])
    feed.run()
    feed.give([chat("z", "z", 4 * 10**6)])
    feed.run()
    whole = {(r.channel, r.event_id, r.win) for r in windows.tiled(spark.createDataFrame(rows, EVENT)).collect()}
    assert len(kept) == len(set(kept)) and {tuple(r) for r in kept} == whole


def test_ticks_equal_rolling_groups(spark, tmp_path):
    rng = random.Random(6)
    words = ["banana split", "banana bread", "LOL", "what game is this?", "forest walk", "the forest base", "hello"]
    rows = [chat(c, f"{c}{k:03}", 10**6 + rng.randrange(90_000), rng.choice(words), f"u{k % 9}") for c in "ab" for k in range(60)]
    rows += [("a", f"s{k}", SPEECH, 10**6 - 500 + 9000 * k, 10**6 + 9000 * k, None, "some speech", True) for k in range(5)]
    rows.sort(key=lambda r: r[3] + rng.randrange(20_000))
    feed = Feed(spark, str(tmp_path), EVENT, lambda e: live.trailing_ticks(e, lateness="30 seconds"), live.live_snapshot(f"{tmp_path}/out"))
    for k in range(0, len(rows), 65):
        feed.give(rows[k : k + 65])
    feed.run()
    feed.give([chat("z", "z", 3 * 10**6)])
    feed.run()
    events = spark.createDataFrame(rows, EVENT)
    whole = questions.rolling_groups(events.where(F.col("type") == CHAT))
    found = spark.read.parquet(f"{tmp_path}/out/groups")
    columns = ["channel", "tick", "rank", "key", "count", "samples"]
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert key(found) == key(whole) and found.count() > 100
    assert found.where(F.size("event_ids") != F.least("count", F.lit(12))).count() == 0
    counts = {(r.channel, r.tick): (r.messages, r.chatters, r.speech) for r in spark.read.parquet(f"{tmp_path}/out/counts").collect()}
    for (c, tick), told in counts.items():
        seen = [r for r in rows if r[0] == c and tick - 60_000 < r[3] <= tick]
        said = [r for r in seen if r[2] == CHAT]
        assert told == (len(said), len({r[5] for r in said}), len(seen) - len(said))
    asked = {(r.channel, r.tick): r.n for r in spark.read.parquet(f"{tmp_path}/out/questions").groupBy("channel", "tick").agg(F.sum("count").alias("n")).collect()}
    for (c, tick), n in asked.items():
        assert n == sum(r[0] == c and tick - 60_000 < r[3] <= tick and r[6].endswith("?") for r in rows)
    assert asked


def test_interims_equal_the_batch_form(spark, tmp_path):
    rng, rows = random.Random(8), []
    for k in range(160):
        start = 10**6 + rng.randrange(300_000)
        rows.append((rng.choice("ab"), f"e{k}", start, start + rng.randrange(200, 6000), "said", None, rng.random() < 0.4))
    rows.sort(key=lambda r: r[2] + rng.randrange(60_000))
    rows = [(*r, k) for k, r in enumerate(rows)]
    schema = f"channel string, {live.SPOKEN}"
    feed = Feed(spark, str(tmp_path), schema, live.stream_interims, live.merge_batches(f"{tmp_path}/out"))
    for k in range(0, len(rows), 40):
        feed.give(rows[k : k + 40])
        if k == 80:
            feed.run()
    feed.run()
    told = context.interim_replacement(spark.createDataFrame(rows, schema)).collect()
    found = live.merged(spark.read.parquet(f"{tmp_path}/out")).collect()
    assert sorted(r.event_id for r in found) == sorted(r.event_id for r in told) and len(told) < len(rows)


def test_timers_of_real_streams(spark, tmp_path):
    joined = [("q", "j", "join", 1, 1, None, None, True), ("t", "j", "join", 1, 1, None, None, True), *[chat("t", f"m{k}", k) for k in range(4)]]
    spark.createDataFrame(joined, EVENT).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
    quiet = feeds.quiet_channels(source, 1000).writeStream.format("memory").queryName("quiet_real").trigger(processingTime="1 second").start()
    parts = feeds.micro_batches(source.where(F.col("type") == CHAT)).writeStream.format("memory").queryName("parts_real").trigger(processingTime="1 second").start()
    told, ends = None, time.time() + 60
    while time.time() < ends and told != ([("q", "quiet")], [0, 0, 0, 1]):
        time.sleep(1)
        told = sorted(map(tuple, spark.table("quiet_real").collect())), sorted(r.batch for r in spark.table("parts_real").collect())
    quiet.stop()
    parts.stop()
    assert told == ([("q", "quiet")], [0, 0, 0, 1])


@pytest.fixture(scope="module")
def hot(spark):
    """One channel with nine tenths of all rows, a null channel, ties and repeated rows."""
    rng = random.Random(3)
    rows = [chat("hot" if k % 10 else rng.choice(["a", None]), f"m{rng.randrange(15_000)}", rng.randrange(200_000)) for k in range(20_000)]
    return spark.createDataFrame(rows, EVENT)


def test_a_hot_channel_is_spread(spark, hot):
    sizes = [r["count"] for r in scan.ranged(hot, ["channel"], ["ts_ms", "event_id"], 16).groupBy("_range").count().collect()]
    assert max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2] and len(sizes) >= 14


def test_scans_equal_windows(spark, hot):
    one = Window.partitionBy("channel").orderBy("ts_ms", "event_id")
    upto = one.rowsBetween(Window.unboundedPreceding, 0)
    odd = F.when(F.col("ts_ms") % 50 == 0, F.col("ts_ms"))
    rows = hot.dropDuplicates(["channel", "ts_ms", "event_id"])
    for ranges in (1, 16):
        got = scan.scanned(scan.ranged(rows, ["channel"], ["ts_ms", "event_id"], ranges), ["channel"], {"s": F.col("ts_ms")}, {"b": F.col("event_id")}, {"l": odd})
        told = rows.select("*", F.sum("ts_ms").over(upto).alias("s"), F.lag("event_id").over(one).alias("b"), F.last(odd, True).over(upto).alias("l"))
        columns = ["channel", "ts_ms", "event_id", "s", "b", "l"]
        assert got.select(columns).exceptAll(told.select(columns)).count() == 0 and got.count() == rows.count()
    places = scan.numbered(hot, ["channel"], ["ts_ms", "event_id"], ranges=16).groupBy("channel").agg(F.count("*").alias("n"), F.countDistinct("place").alias("d"), F.max("place").alias("m")).collect()
    assert all(r.n == r.d == r.m for r in places) and len(places) == 3
    assert scan.numbered(hot.where("false"), ["channel"], ["ts_ms"]).count() == 0


def test_segments_stay_in_their_response(spark):
    word = lambda w, a, b, s: f'{{"word": "{w}", "start": {a}, "end": {b}, "speaker": "{s}"}}'
    bare = lambda *w: '{"results": {"channels": [{"alternatives": [{"words": [' + ", ".join(w) + "]}]}]}}"
    rows = [("c", 1000, bare(word("one", 0.0, 0.3, 1), word("two", 0.4, 32.3, 1), word("three", 33.8005, 34.0, 1))), ("c", 1500, bare(word("four", 0.0, 0.1, 1)))]
    rows += [("c", 90_000, '{"results": {"utterances": [{"start": 1.0, "transcript": " said  so "}]}}'), ("c", 95_000, '{"results": {}}'), (None, 1, bare(word("x", 0, 1, 0))), ("c", 2, None)]
    found = {tuple(r) for r in parsing.stt_segments(spark.createDataFrame(rows, "channel string, start_ms long, json string")).collect()}
    assert found == {("c", 1000, 1000 + int(32.3 * 1000), "one two", "spk_1"), ("c", 34_800, 35_000, "three", "spk_1"), ("c", 1500, 1600, "four", "spk_1"), ("c", 91_000, 91_000, "said so", None), (None, 1, 1001, "x", "spk_0")}
