"""Chat messages reduced to counted bursts and grouped into audience signals, per scope (channel and window)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions.fixed import EMPTY_KEY, MIN_PREFIX, MIN_TOKEN, PREFIX_CHARS, REACTION_KEY, WORDISH
from ..plans.store import bytes_read, stored
from . import trailing
from .windows import SCOPE

#: Bytes of input for each task that sorts words of texts: these take some 50 times as much memory.
TASK_BYTES = 4 << 20


def reduce_chat(chat: DataFrame, scope: list[str] = SCOPE, keep_ids: int = 5) -> DataFrame:
    """One burst for each canonical text: count, first verbatim sample, first and last time, first ids.

    One pass: messages are shuffled once, and nothing is stored. Ids come from a ranking, not
    from a list of all of them.
    """
    rows = _dealt_canon(chat, scope) if len(scope) > 1 else prepared(chat, scope)
    rows = rows.select(*scope, "event_id", "ts_ms", "text", F.when(F.col("canon") == "", EMPTY_KEY).otherwise(F.col("canon")).alias("key"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*scope, "key").orderBy("ts_ms", "event_id", "text")))
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= keep_ids, F.struct("k", "event_id")))), lambda x: x["event_id"])
    sample = F.when(F.col("key") == EMPTY_KEY, "(punctuation only)").otherwise(F.max(F.when(F.col("k") == 1, F.col("text"))))
    return rows.groupBy(*scope, "key").agg(F.count("*").alias("count"), sample.alias("sample"), F.min("ts_ms").alias("first_ts_ms"), F.max("ts_ms").alias("last_ts_ms"), ids.alias("event_ids"))


def compression_ratio(chat: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """Distinct canonical texts for each message."""
    return chat.groupBy(*scope).agg((F.countDistinct(T.canonical(F.col("text"))) / F.count("*")).alias("ratio"))


def prepared(chat: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """scope, event_id, ts_ms, author, text and canon, written once: every step of a grouping reads canon."""
    if "canon" in chat.columns:
        return chat
    return stored(chat.select(*scope, "event_id", "ts_ms", "author", "text", T.canonical(F.col("text")).alias("canon")), "canonical")


def dealt(rows: DataFrame, by: list[str], task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows dealt by hash to as many tasks as spark.sql.shuffle.partitions says, and at least one for each task_bytes of the files they come from.

    So tasks stay as small on a larger input, and what they sort stays in memory, not on disk
    beside the shuffle. A stated number is not coalesced, however long the work on few megabytes.
    """
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-bytes_read(rows) // task_bytes)), *by)


def headed(rows: DataFrame) -> DataFrame:
    """rows (canon) with whether they are a reaction and the head of a single word."""
    c = F.col("canon")
    single = ~c.contains(" ") & (F.length(c) >= PREFIX_CHARS) & c.rlike(WORDISH)
    return rows.withColumn("reaction", T.is_reaction(c)).withColumn("head", F.when(~F.col("reaction") & single, F.substring(c, 1, PREFIX_CHARS)))


def shape(rows: DataFrame) -> DataFrame:
    """rows (canon) with what decides their group: reaction, head (of a single word) and tokens."""
    return headed(rows).withColumn("tokens", F.array_distinct(T.content_tokens(F.col("canon"))))


def may_group(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Rows of shape() that may join a group in some part of scope, with those heads and tokens alone that enough messages of scope share.

    A part has no more messages of a token than the whole, so no group of any part is lost.
    rows are dealt by scope.
    """
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("head", F.when(F.count("head").over(Window.partitionBy(*scope, "head")) >= MIN_PREFIX, F.col("head")))
    message = F.struct(*[c for c in rows.columns if c not in (*scope, "_row", "tokens")])
    each = rows.select(*scope, "_row", message.alias("message"), F.posexplode_outer("tokens").alias("at", "token"))
    each = each.withColumn("message", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("message"))).withColumn("n", F.count("token").over(Window.partitionBy(*scope, "token")))
    found = each.groupBy(*scope, "_row").agg(F.first("message", True).alias("m"), F.collect_list(F.when(F.col("n") >= MIN_TOKEN, F.col("token"))).alias("tokens"))
    return found.select(*scope, "m.*", "tokens").where("reaction or head is not null or size(tokens) > 0")


def _dealt_canon(chat: DataFrame, scope: list[str]) -> DataFrame:
    """scope, event_id, ts_ms, text and canon, dealt by scope.

    Texts that Python folds are folded before the shuffle, as a step in Python forgets how rows
    are dealt; the rest of canonical() runs behind it.
    """
    known = "canon" in chat.columns
    rows = chat.select(*scope, "event_id", "ts_ms", "text", "canon" if known else T.odd_folded(F.coalesce("text", F.lit(""))).alias("_odd"))
    rows = dealt(rows, scope)
    return rows if known else rows.withColumn("canon", T.skeleton(T.as_folded(F.coalesce("text", F.lit("")), F.col("_odd")))).drop("_odd")


def _windowed(chat: DataFrame, scope: list[str]) -> DataFrame:
    """Messages of small scopes (windows) with what decides their group, sorted within their window: read one after the other, windows are grouped by one pass (trailing.py).

    Messages are dealt once by scope, without their canonical texts, and sorted once; no window
    function copies one to its words.
    """
    known = ["canon"] if "canon" in chat.columns else []
    rows = dealt(chat.select(*scope, "event_id", "ts_ms", "text", *known), scope)
    rows = headed(rows if known else rows.withColumn("canon", T.canonical(F.col("text"))))
    return rows.select(*scope, *trailing.WINDOW).sortWithinPartitions(*scope, "ts_ms", "event_id", "text")


def _fields(rows: DataFrame, columns: list[str], others: str) -> StructType:
    return StructType([*(rows.schema[c] for c in columns), *StructType.fromDDL(others)])


def _floor(key: Column) -> Column:
    """How many messages a group needs."""
    return F.when(key.startswith("p:"), MIN_PREFIX).when(key.startswith("t:"), MIN_TOKEN).otherwise(1)


def assigned(chat: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """scope, event_id, key for each message that belongs to a signal: reaction, shared prefix or shared token.

    A window's messages are few and stay in one task; a channel's, which may be most of all,
    are counted with partial aggregates and joined.
    """
    if len(scope) > 1:
        rows = _windowed(chat, scope)
        return stored(rows.mapInArrow(trailing.window_keys(scope), _fields(rows, scope, "event_id string, key string")), "assigned")
    c = F.col("canon")
    rows = prepared(chat, scope).select(*scope, "event_id", "canon")
    single = ~c.contains(" ") & (F.length(c) >= PREFIX_CHARS) & c.rlike(WORDISH)
    rows = rows.withColumn("reaction", T.is_reaction(c)).withColumn("prefix", F.when(~F.col("reaction") & single, F.concat(F.lit("p:"), F.substring(c, 1, PREFIX_CHARS))))
    prefixes = rows.where("prefix is not null").groupBy(*scope, "prefix").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PREFIX).drop("n").withColumn("shared", F.lit(True))
    rows = rows.join(prefixes, [*scope, "prefix"], "left")
    rows = rows.withColumn("own", F.when(F.col("reaction"), REACTION_KEY).when(F.col("shared"), F.col("prefix")))

    tokens = rows.where("own is null").select(*scope, "event_id", F.explode(F.array_distinct(T.content_tokens(c))).alias("token"))
    counts = tokens.groupBy(*scope, "token").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_TOKEN)
    picked = tokens.join(counts, [*scope, "token"]).groupBy(*scope, "event_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "token")).alias("best"))
    found = rows.where("own is not null").select(*scope, "event_id", F.col("own").alias("key")).unionByName(picked.select(*scope, "event_id", F.concat(F.lit("t:"), F.col("best.token")).alias("key")))
    found = stored(found, "candidates")

    sizes = found.groupBy(*scope, "key").agg(F.count("*").alias("n"))
    heads = sizes.where("key like 't:%'").withColumn("prefix", F.concat(F.lit("p:"), F.substring("key", 3, PREFIX_CHARS)))
    target = heads.groupBy(*scope, "prefix").agg(F.min(F.struct((-F.col("n")).alias("n"), "key")).alias("best")).select(*scope, F.col("prefix").alias("key"), F.col("best.key").alias("into"))
    found = found.join(target, [*scope, "key"], "left").select(*scope, "event_id", F.coalesce("into", "key").alias("key"))
    large = found.groupBy(*scope, "key").agg(F.count("*").alias("n")).where(F.col("n") >= _floor(F.col("key"))).drop("n")
    return stored(found.join(large, [*scope, "key"]), "assigned")


def group_chat(chat: DataFrame, scope: list[str] = SCOPE, max_samples: int = 3, keep_ids: int = 0) -> DataFrame:
    """A row for each signal. All its message ids are rows of assigned(), not an array here.

    With keep_ids, `evidence` holds the ids of its first messages, found in the same pass.
    """
    if len(scope) > 1:
        rows, ids = _windowed(chat, scope), ", evidence array<string>" if keep_ids else ""
        groups = _fields(rows, scope, f"key string, count long, first_ts_ms long, last_ts_ms long, samples array<string>{ids}")
        return named(rows.mapInArrow(trailing.window_groups(scope, max_samples, keep_ids), groups))
    chat = prepared(chat, scope)
    rows = chat.join(assigned(chat, scope), [*scope, "event_id"])
    group, first = [*scope, "key"], []
    if keep_ids:
        place = F.row_number().over(Window.partitionBy(*group).orderBy("ts_ms", "event_id"))
        rows = rows.withColumn("place", place)
        first = [F.collect_list(F.when(F.col("place") <= keep_ids, F.struct("place", "event_id"))).alias("ids")]
    texts = rows.groupBy(*group, "text").agg(F.count("*").alias("n"), F.min(F.struct("ts_ms", "event_id")).alias("at"), F.max("ts_ms").alias("last"), *first)
    ranked = texts.withColumn("k", F.row_number().over(Window.partitionBy(*group).orderBy("at")))
    samples = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= max_samples, F.struct("k", "text")))), lambda x: x["text"])
    evidence = [F.transform(F.array_sort(F.flatten(F.collect_list("ids"))), lambda x: x["event_id"]).alias("evidence")] if keep_ids else []
    return named(ranked.groupBy(*group).agg(F.sum("n").alias("count"), F.min("at.ts_ms").alias("first_ts_ms"), F.max("last").alias("last_ts_ms"), samples.alias("samples"), *evidence))


def label_of(key: Column) -> Column:
    return F.when(key == REACTION_KEY, "reaction wave").when(key.startswith("p:"), F.concat(F.substring(key, 3, 99), F.lit("…"))).otherwise(F.substring(key, F.lit(3), F.length(key)))


def named(groups: DataFrame) -> DataFrame:
    """groups (key) with the rule that made them and a label."""
    rule = F.when(F.col("key") == REACTION_KEY, "reaction").when(F.col("key").startswith("p:"), "prefix").otherwise("token")
    return groups.withColumns({"rule": rule, "label": label_of(F.col("key"))})


def top_groups(groups: DataFrame, scope: list[str] = SCOPE, k: int = 6) -> DataFrame:
    w = Window.partitionBy(*scope).orderBy(F.desc("count"), "first_ts_ms", "key")
    return groups.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def grouped_summary(chat: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """messages, groups, grouped and ungrouped for each scope."""
    if len(scope) > 1:
        rows = _windowed(chat, scope)
        return rows.mapInArrow(trailing.window_counts(scope), _fields(rows, scope, "messages long, groups long, grouped long, ungrouped long"))
    rows = chat.select(*scope, "event_id").join(assigned(chat, scope), [*scope, "event_id"], "left")
    return rows.groupBy(*scope).agg(F.count("*").alias("messages"), F.countDistinct("key").alias("groups"), F.count("key").alias("grouped"), F.count_if(F.col("key").isNull()).alias("ungrouped"))
