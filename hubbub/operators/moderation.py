"""Rows that a moderator should look at: links, coordinated copies, instructions to a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import COORDINATED_MS
from ..plans.store import stored

RULES = (("link", "Links and invites"), ("coordinated", "Coordinated repeats"), ("injection", "Prompt injection"))
MIN_AUTHORS, MIN_WORDS, MIN_CHARS, MAX_ROWS, IDS, SAMPLES = 4, 4, 20, 5, 12, 3


def links(chat: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Hosts of each channel's links by how often they are named; the first max_rows, each with its first messages' ids and texts.

    All messages of a host are rows of linked().
    """
    rows = linked(chat)
    hosts = rows.groupBy("channel", "host").agg(F.count("*").alias("count"), F.countDistinct(F.coalesce("author", F.lit(""))).alias("authors"), F.min("ts_ms").alias("first_ts_ms"))
    w = Window.partitionBy("channel").orderBy(F.desc("count"), "host")
    top = hosts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_rows)
    place = F.row_number().over(Window.partitionBy("channel", "host").orderBy("ts_ms", "event_id"))
    first = rows.withColumn("k", place).where(F.col("k") <= IDS).groupBy("channel", "host").agg(F.array_sort(F.collect_list(F.struct("k", "event_id", "text"))).alias("first"))
    shown = F.transform("first", lambda x: x["event_id"]).alias("event_ids"), F.transform(F.slice("first", 1, SAMPLES), lambda x: x["text"]).alias("samples")
    return top.join(first, ["channel", "host"]).select(*top.columns, *shown)


def linked(chat: DataFrame) -> DataFrame:
    """Messages with a link, and its host."""
    return chat.select("channel", "event_id", "author", "ts_ms", "text", T.link_host(F.col("text")).alias("host")).where("host is not null")


def injection(chat: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The first max_rows messages of each channel that try to instruct a model."""
    w = Window.partitionBy("channel").orderBy("ts_ms", "event_id")
    rows = chat.where(T.is_injection(F.col("text"))).select("channel", "event_id", "author", "ts_ms")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_rows)


def coordinated(chat: DataFrame, max_rows: int = MAX_ROWS, span_ms: int = COORDINATED_MS) -> DataFrame:
    """Long texts that MIN_AUTHORS or more authors post within span_ms: the first such stretch of each text, with its event_ids.

    Who posts in [t, t + span_ms] is counted without sets: an author's posts count for every
    start at most span_ms before them, but once where these starts overlap, so a post at p
    counts for starts after the author's post before it, or from p - span_ms on. Each such
    interval adds one at its first start and takes one behind its last; a running sum gives
    the authors of every start. Sums of messages are the difference of two running sums.
    Texts are shuffled as hashes. A text is looked at in time slots, so that one text repeated everywhere is many groups.
    """
    texts = chat.where(F.length("text") >= MIN_CHARS).select("channel", "event_id", "ts_ms", F.coalesce("author", F.lit("")).alias("author"), T.canonical(F.col("text")).alias("canon"))
    is_long = (F.length("canon") >= MIN_CHARS) & (F.size(T.words(F.col("canon"))) >= MIN_WORDS)
    # a filter here would be pushed below and canonicalise twice, so short ones are null
    texts = texts.select("channel", "event_id", "ts_ms", "author", F.when(is_long, F.col("canon")).alias("key"))
    texts = stored(texts.withColumn("hash", F.unhex(F.md5("key"))), "long-texts").where("key is not null")
    rows = texts.drop("key")
    many = rows.groupBy("channel", "hash").agg(F.countDistinct("author").alias("n")).where(F.col("n") >= MIN_AUTHORS).select("channel", "hash")
    posts = rows.join(many, ["channel", "hash"]).groupBy("channel", "hash", "author", "ts_ms").agg(F.count("*").alias("n"))
    # posts of a slot and of the next one decide about the starts of the slot
    own = F.floor(F.col("ts_ms") / span_ms)
    seen = posts.withColumn("slot", F.explode(F.array(own, own - 1))).withColumn("starts", F.col("slot") == own)
    by = ["channel", "hash", "slot"]
    before = F.lag("ts_ms").over(Window.partitionBy(*by, "author").orderBy("ts_ms"))
    counted = seen.withColumn("since", F.greatest(F.coalesce(before + 1, F.col("ts_ms") - span_ms), F.col("ts_ms") - span_ms))
    zero = F.lit(0).cast("long")
    event = lambda at, authors, n, is_start=False: F.struct(at.alias("at"), F.lit(is_start).alias("is_start"), F.lit(authors).alias("authors"), n.alias("n"))
    opens, closes = event(F.col("since"), 1, zero), event(F.col("ts_ms") + 1, -1, -F.col("n"))
    changes = counted.select(*by, F.explode(F.array_compact(F.array(opens, closes, event(F.col("ts_ms") - span_ms, 0, F.col("n")), F.when(F.col("starts"), event(F.col("ts_ms"), 0, zero, True))))).alias("e")).select(*by, "e.*")
    upto = Window.partitionBy(*by).orderBy("at", "is_start").rowsBetween(Window.unboundedPreceding, 0)
    sums = changes.withColumns({"authors": F.sum("authors").over(upto), "count": F.sum("n").over(upto)})
    starts = sums.where(F.col("is_start") & (F.col("authors") >= MIN_AUTHORS))
    first = starts.groupBy("channel", "hash").agg(F.min(F.struct(F.col("at").alias("ts_ms"), "authors", "count")).alias("s")).select("channel", "hash", F.col("s.ts_ms").alias("first_ts_ms"), F.col("s.authors").cast("int").alias("authors"), "s.count")
    first = stored(first, "stretches")
    keys = texts.join(first.select("channel", "hash"), ["channel", "hash"], "left_semi").groupBy("channel", "hash").agg(F.min("key").alias("key"))
    first = first.join(keys, ["channel", "hash"])
    w = Window.partitionBy("channel").orderBy(F.desc("authors"), "first_ts_ms", "key")
    top = first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_rows)
    members = rows.join(top, ["channel", "hash"]).where((F.col("ts_ms") >= F.col("first_ts_ms")) & (F.col("ts_ms") <= F.col("first_ts_ms") + span_ms))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ts_ms", "event_id"))), lambda x: x["event_id"])
    return top.join(members.groupBy("channel", "hash").agg(ids.alias("event_ids")), ["channel", "hash"]).drop("hash")


def needs_a_look(chat: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Every rule of every channel with its number of rows: a rule that found nothing has 0, not no row."""
    messages = chat.groupBy("channel").agg(F.count("*").alias("messages"))
    rules = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(kind).alias("kind"), F.lit(label).alias("label")) for k, (kind, label) in enumerate(RULES)]))
    found = [f(chat, max_rows).groupBy("channel").agg(F.count("*").alias("hits")).withColumn("kind", F.lit(kind)) for (kind, _), f in zip(RULES, (links, coordinated, injection), strict=True)]
    hits = found[0].unionByName(found[1]).unionByName(found[2])
    rows = messages.withColumn("r", rules).select("channel", "messages", "r.*").join(hits, ["channel", "kind"], "left")
    rows = rows.withColumn("hits", F.coalesce("hits", F.lit(0)))
    return rows.withColumn("total", F.sum("hits").over(Window.partitionBy("channel")))
