"""The registered queries by name, and the SQL that DuckDB runs over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import board, grouping, metrics, moderation, windows
from ..sources import events as E
from . import chat_sql, context_queries, extra_queries, more_queries
from .store import keep, removed


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.table_events(spark, sf_dir)


def _tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tiled(_events(spark, sf_dir))


def _chat(df: DataFrame) -> DataFrame:
    return df.where(F.col("type") == E.CHAT)


def _lined(df: DataFrame, by: str = "\n") -> DataFrame:
    """Arrays of texts as one text each, as all engines compare those alike."""
    return df.withColumns({f.name: F.array_join(F.col(f.name).cast("array<string>"), by) for f in df.schema if f.dataType.typeName() == "array"})


def _attributed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = context_queries._tiles_once(s, d)
    with removed(s):
        return events, keep(board.attributed(events), "attributed")


def _asked(s: SparkSession, d: str) -> DataFrame:
    """Windows of two minutes, 45 s into every three minutes of each channel."""
    spans = _events(s, d).groupBy("channel").agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
    return spans.select("channel", F.explode(F.sequence("lo", "hi", F.lit(180_000).cast("long"))).alias("start")).selectExpr("channel", "start + 45000 start", "start + 165000 end")


def _footer(s: SparkSession, d: str) -> DataFrame:
    return board.board_footer(*_attributed(s, d))


QUERIES = {
    "unattributed": lambda s, d: board.unattributed(_attributed(s, d)[1]),
    "board_footer": _footer,
    "needs_a_look": lambda s, d: moderation.needs_a_look(_chat(_events(s, d))),
    "board": lambda s, d: board.board_rows(_attributed(s, d)[1]),
    "group_chat": lambda s, d: _lined(grouping.group_chat(_chat(_tiled(s, d)))),
    "grouped_summary": lambda s, d: grouping.grouped_summary(_chat(_tiled(s, d))),
    "top_groups": lambda s, d: _lined(grouping.top_groups(grouping.group_chat(_chat(_tiled(s, d))))),
    "reduce_chat": lambda s, d: _lined(grouping.reduce_chat(_chat(_tiled(s, d))), ","),
    "compression_ratio": lambda s, d: grouping.compression_ratio(_chat(_tiled(s, d))),
    "rail": lambda s, d: _lined(metrics.rail(_tiled(s, d)), ","),
    "coordinated": lambda s, d: _lined(moderation.coordinated(_chat(_events(s, d))), ","),
    "union_modalities": lambda s, d: _events(s, d).groupBy("channel", "type").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ts_ms"), F.max("ts_ms").alias("last_ts_ms")),
    "duplicate_ids": lambda s, d: E.duplicate_ids(_events(s, d).unionByName(_events(s, d).where("text like '%?'"))),
    "tile_board": lambda s, d: windows.all_tiles(_tiled(s, d)).join(_tiled(s, d).groupBy("channel", "win").agg(F.count("*").alias("n")), ["channel", "win"], "left").fillna(0),
    "total_order": lambda s, d: windows.total_order(_events(s, d)).select("channel", "event_id", "place"),
    "window_filter": lambda s, d: windows.slices(_chat(_events(s, d)), _asked(s, d)).select("channel", "start", "event_id", "ts_ms"),
    "rate_buckets": lambda s, d: metrics.rate_buckets(_chat(_tiled(s, d))).select("channel", "win", F.posexplode("rate").alias("bucket", "n")),
    "new_chatters": lambda s, d: metrics.new_chatters(_chat(_tiled(s, d))),
    "concentration": lambda s, d: metrics.concentration(_chat(_tiled(s, d))),
    "mention_census": lambda s, d: metrics.mention_census(_chat(_events(s, d))),
    "links": lambda s, d: _lined(moderation.links(_chat(_events(s, d)))),
    "injection": lambda s, d: moderation.injection(_chat(_events(s, d))),
}

_EVENTS = f"events_view AS ({E.DUCKDB_VIEW})"
_TILED = f"{_EVENTS}, tiled AS (SELECT *, origin + (ts_ms - origin) // 60000 * 60000 AS win FROM (SELECT *, min(ts_ms) OVER (PARTITION BY channel) AS origin FROM events_view))"
_CHATS = f"{_TILED}, chats AS (SELECT * FROM tiled WHERE type = 'chat_message')"
_HOST = "regexp_replace(lower(regexp_extract(text, '(?i)(?:https?://|www\\.)?(\\b[a-z0-9][a-z0-9-]{0,30}(?:\\.[a-z0-9-]{1,30})*\\.(?:gg|com|net|io|tv|me|xyz|link|shop|ly|app|co|org)\\b)(?:/\\S*)?', 1)), '^www\\.', '')"

ORACLE_SQL: dict[str, str] = {
    "union_modalities": f"WITH {_EVENTS} SELECT channel, type, count(*) AS n, min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms FROM events_view GROUP BY ALL",
    "duplicate_ids": f"WITH {_EVENTS} SELECT channel, event_id, count(*) AS n FROM (SELECT channel, event_id FROM events_view UNION ALL SELECT channel, event_id FROM events_view WHERE text LIKE '%?') GROUP BY ALL HAVING count(*) > 1",
    "tile_board": f"WITH {_TILED}, every AS (SELECT channel, unnest(range(min(win), max(win) + 1, 60000)) AS win FROM tiled GROUP BY channel), n AS (SELECT channel, win, count(*) AS n FROM tiled GROUP BY ALL) SELECT channel, win, coalesce(n, 0) AS n FROM every LEFT JOIN n USING (channel, win)",
    "total_order": f"WITH {_EVENTS} SELECT channel, event_id, row_number() OVER (PARTITION BY channel ORDER BY ts_ms, type, event_id) AS place FROM events_view",
    "window_filter": f"WITH {_EVENTS}, o AS (SELECT channel, min(ts_ms) AS lo FROM events_view GROUP BY ALL), p AS (SELECT e.*, (ts_ms - lo) // 180000 * 180000 + lo + 45000 AS start FROM events_view e JOIN o USING (channel)) SELECT channel, start, event_id, ts_ms FROM p WHERE type = 'chat_message' AND ts_ms >= start AND ts_ms < start + 120000",
    "rate_buckets": f"WITH {_CHATS}, w AS (SELECT DISTINCT channel, win FROM chats) SELECT channel, win, CAST(b AS INTEGER) AS bucket, (SELECT count(*) FROM chats c WHERE c.channel = w.channel AND c.win = w.win AND least((c.ts_ms - c.win) // 10000, 5) = b) AS n FROM w, range(6) AS r(b)",
    "new_chatters": f"WITH {_CHATS}, f AS (SELECT channel, coalesce(author, '') AS author, min(win) AS win FROM chats GROUP BY ALL) SELECT channel, win, count(*) AS new_chatters FROM f GROUP BY ALL",
    "concentration": f"WITH {_CHATS}, a AS (SELECT channel, win, author, count(*) AS n FROM chats GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY channel, win ORDER BY n DESC, author) AS k, count(*) OVER (PARTITION BY channel, win) AS m FROM a) "
    "SELECT channel, win, max(m) AS unique_chatters, round_even(sum(CASE WHEN k <= greatest(1, floor(m * 0.1)) THEN n ELSE 0 END) / sum(n), 3) AS concentration FROM k GROUP BY ALL",
    "mention_census": f"WITH {_EVENTS}, m AS (SELECT channel, unnest(regexp_extract_all(text, '@([A-Za-z0-9_]{{3,25}})', 1)) AS handle FROM events_view WHERE type = 'chat_message') SELECT channel, count(*) AS mentions, count(DISTINCT lower(handle)) AS handles FROM m GROUP BY ROLLUP (channel)",
    "links": f"WITH {_EVENTS}, l AS (SELECT channel, event_id, author, ts_ms, text, {_HOST} AS host FROM events_view WHERE type = 'chat_message'), h AS (SELECT channel, host, count(*) AS count, count(DISTINCT coalesce(author, '')) AS authors, min(ts_ms) AS first_ts_ms, array_to_string(list(event_id ORDER BY ts_ms, event_id) [1:12], chr(10)) AS event_ids, array_to_string(list(text ORDER BY ts_ms, event_id) [1:3], chr(10)) AS samples FROM l WHERE host <> '' GROUP BY ALL), "
    "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY channel ORDER BY count DESC, host) AS INTEGER) AS rank FROM h) SELECT * FROM r WHERE rank <= 5",
    "injection": f"WITH {_EVENTS}, r AS (SELECT channel, event_id, author, ts_ms, CAST(row_number() OVER (PARTITION BY channel ORDER BY ts_ms, event_id) AS INTEGER) AS rank FROM events_view WHERE type = 'chat_message' AND regexp_matches(text, '(?i)\\bignore (?:all |the )?(?:previous|prior|above|earlier)')) SELECT * FROM r WHERE rank <= 5",
}

QUERIES |= context_queries.QUERIES | more_queries.QUERIES | extra_queries.QUERIES
ORACLE_SQL |= context_queries.ORACLE_SQL | chat_sql.ORACLE_SQL | more_queries.ORACLE_SQL | extra_queries.ORACLE_SQL
