"""Queries over captures written as files, runs, budgets, whole rails and windows without data, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context, evaluation, metrics
from ..sources import events as E
from . import chat_sql as S
from . import context_queries as C
from . import more_queries as M
from .store import new_path, stored


def _captures(s: SparkSession, d: str) -> DataFrame:
    """The events written as capture files, chat lines with fields of their own, and read back."""
    root, events = new_path(s, "captures"), stored(C._events(s, d), "events")
    fields = {
        "chat": (E.CHAT, [F.col("event_id").alias("id"), "ts_ms", "author", "text", (F.col("ts_ms") % 7).alias("mood"), F.struct(F.length("text").alias("n")).alias("of")]),
        "transcript": (E.SPEECH, [F.when(F.col("ts_ms") % 1000 == 0, F.col("event_id")).alias("id"), "ts_ms", "end_ms", "text", "final"]),
        "frames": (E.FRAME, [F.col("event_id").alias("id"), "ts_ms", F.col("text").alias("caption")]),
    }
    for name, (kind, columns) in fields.items():
        rows = events.where(F.col("type") == kind).select("channel", F.to_json(F.struct(*columns)).alias("value"))
        rows.write.partitionBy("channel").text(f"{root}/{name}")
    found = E.read_captures(s, f"{root}/{{name}}", "part-*")
    return found.select(F.regexp_replace("channel", "^channel=", "").alias("channel"), "event_id", "type", "ts_ms", "end_ms", "author", "text", "final", F.try_element_at("meta", F.lit("mood")).alias("mood"), F.try_element_at("meta", F.lit("of")).alias("of"))


def _metas(s: SparkSession, d: str) -> DataFrame:
    """A metadata file for each channel; where its name is of odd length, without a fixture_id."""
    root = new_path(s, "metas")
    each = C._events(s, d).groupBy("channel").agg(((F.max("ts_ms") - F.min("ts_ms")) / 1000).alias("duration_s"), F.count_if(F.col("type") == E.CHAT).alias("chat_messages"))
    fixture = F.when(F.length("channel") % 2 == 0, F.concat(F.lit("f_"), "channel")).alias("fixture_id")
    told = F.struct(fixture, F.col("channel"), F.lit("2025-01-01").alias("captured_utc"), "duration_s", "chat_messages", F.when(F.col("chat_messages") > 100, True).alias("enriched"), F.lit("tables").alias("provenance"))
    each.select(F.col("channel").alias("folder"), F.to_json(told).alias("value")).write.partitionBy("folder").text(root)
    return E.load_meta(s, root, "part-*")


def _mute(s: SparkSession, d: str) -> DataFrame:
    """Languages as systems, sources as cases, texts with an address as cards."""
    docs = s.read.parquet(f"{d}/documents.parquet")
    return evaluation.mute_systems(docs.groupBy(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 2).alias("system"), F.col("source").alias("case_id")).agg(F.count_if(F.col("text").contains("@")).alias("n_cards")))


def _budgets(s: SparkSession, d: str) -> DataFrame:
    steps = F.when(F.col("trace_id") % 5 > 0, (2 + F.col("trace_id") % 3).cast("int"))
    return evaluation.run_budgets(M._runs(s, d).withColumn("max_steps", steps))


def _budget(s: SparkSession, d: str) -> DataFrame:
    prices = s.createDataFrame([("m0", 2.0, 8.0), ("m1", 0.5, 1.5)], "model string, prompt_usd double, completion_usd double")
    return evaluation.budget_state(M._calls(s, d), prices, 0.05)


def _rail(s: SparkSession, d: str) -> DataFrame:
    checked, events = C._checked(s, d)
    return metrics.full_rail(events, checked).withColumn("rate", F.array_join(F.col("rate").cast("array<string>"), ","))


QUERIES = {
    "load_events": _captures,
    "load_meta": _metas,
    "mute_systems": _mute,
    "summary_windows": lambda s, d: context.every_window(context.summary_counts(C._events(s, d))),
    "run_budgets": _budgets,
    "budget_state": _budget,
    "trigger_violations": lambda s, d: evaluation.trigger_violations(*C._checked(s, d)),
    "full_rail": _rail,
}

_SOURCE = "CASE WHEN type = 'none' THEN 'abstained' WHEN tid = 'unknown' THEN 'unknown' ELSE coalesce(ttype, 'missing') END"
ORACLE_SQL = {
    "load_events": f"WITH {C._EVENTS} SELECT channel, CASE WHEN type = 'transcript_segment' AND ts_ms % 1000 > 0 THEN concat('tr_', substring(sha256(concat(ts_ms, '|', text)), 1, 10)) ELSE event_id END AS event_id, type, ts_ms, end_ms, author, coalesce(text, '') AS text, true AS final, "
    "CASE WHEN type = 'chat_message' THEN CAST(ts_ms % 7 AS VARCHAR) END AS mood, CASE WHEN type = 'chat_message' THEN concat('{\"n\":', length(text), '}') END AS of FROM ev",
    "load_meta": f"WITH {C._EVENTS}, m AS (SELECT channel, (max(ts_ms) - min(ts_ms)) / 1000 AS duration_s, count(*) FILTER (type = 'chat_message') AS chat_messages FROM ev GROUP BY ALL) "
    "SELECT CASE WHEN length(channel) % 2 = 0 THEN concat('f_', channel) ELSE concat('folder=', channel) END AS fixture_id, channel, '2025-01-01' AS captured_utc, duration_s, chat_messages, chat_messages > 100 AS enriched, 'tables' AS provenance FROM m",
    "mute_systems": "SELECT substring(md5(CAST(doc_id AS VARCHAR)), 1, 2) AS system FROM documents GROUP BY ALL HAVING count(*) FILTER (text LIKE '%@%') = 0",
    "summary_windows": f"WITH {C._LEVELS}, w AS (SELECT channel, window_s, unnest(range(min(end_ms), max(end_ms) + 1, window_s * 1000)) AS end_ms FROM counts GROUP BY channel, window_s) "
    "SELECT channel, window_s, end_ms, coalesce(msg_count, 0) AS msg_count, coalesce(audio_count, 0) AS audio_count, coalesce(frame_count, 0) AS frame_count, CASE WHEN msg_count IS NULL THEN 'no data in this window' END AS summary FROM w LEFT JOIN counts USING (channel, window_s, end_ms)",
    "run_budgets": "WITH r AS (SELECT DISTINCT concat('agent', conv_id % 4) AS agent, conv_id, CASE WHEN conv_id % 5 > 0 THEN 2 + conv_id % 3 END AS m FROM conversations), n AS (SELECT agent, m, count(*) AS n FROM r GROUP BY ALL) "
    "SELECT agent, CAST(sum(n) AS BIGINT) AS runs, CAST(coalesce(sum(n) FILTER (m IS NOT NULL), 0) AS BIGINT) AS tool_runs, CAST(coalesce((min((-n, m)) FILTER (m IS NOT NULL))[2], 0) AS INTEGER) AS budget FROM n GROUP BY agent",
    "budget_state": "WITH c AS (SELECT CASE WHEN turn % 2 = 0 THEN 'p' END AS provider, conv_id % 3 AS m, length(text) AS p, turn AS c FROM conversations), s AS (SELECT provider, count(*) AS calls, count(*) FILTER (m = 2) AS unpriced, "
    "sum(CASE m WHEN 0 THEN coalesce(p, 0) * 2.0 + c * 8.0 WHEN 1 THEN coalesce(p, 0) * 0.5 + c * 1.5 ELSE 0 END) / 1000000.0 AS spent FROM c GROUP BY ALL) SELECT provider, calls, unpriced, CAST(round(spent, 4) AS DOUBLE) AS spent_usd, CAST(round(greatest(0, 0.05 - spent), 4) AS DOUBLE) AS remaining_usd, spent < 0.05 AS allowed FROM s",
    "trigger_violations": f"{S.CHECKED}, v AS (SELECT channel, {_SOURCE} AS source, unnest(violations) AS code FROM checked) SELECT channel, source, code, count(*) AS n FROM v GROUP BY ALL",
    "full_rail": f"SELECT r.*, coalesce(g.groups, 0) AS groups, coalesce(g.grouped, 0) AS grouped, coalesce(g.ungrouped, 0) AS singletons, coalesce(q.questions, 0) AS questions, coalesce(l.verified, 0) AS verified, coalesce(l.abstained, 0) AS abstained, coalesce(l.rejected, 0) AS rejected, l.codes AS codes "
    f"FROM ({S.ORACLE_SQL['rail']}) r LEFT JOIN ({S.ORACLE_SQL['grouped_summary']}) g ON g.channel = r.channel AND g.win = r.win "
    f"LEFT JOIN ({S.CHATS} SELECT channel, win, count(*) FILTER ({S._ASKS}) AS questions FROM chats JOIN canon_of USING (text) JOIN tokens_of USING (text) GROUP BY ALL) q ON q.channel = r.channel AND q.win = r.win "
    f"LEFT JOIN ({S.ORACLE_SQL['gate_ledger']}) l ON l.channel = r.channel AND l.win = r.win",
}
