"""Queries over context, questions, cards and scores, with SQL where DuckDB has the functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import board, cards, context, evaluation, grouping, questions, windows
from ..sources import events as E
from ..sources import parsing
from ..streaming import feeds
from .store import keep, removed, stored


def _events(s: SparkSession, d: str) -> DataFrame:
    return E.table_events(s, d)


def _of(s: SparkSession, d: str, kind: str) -> DataFrame:
    return _events(s, d).where(F.col("type") == kind)


def _tiled(s: SparkSession, d: str) -> DataFrame:
    return windows.tiled(_events(s, d))


def _tiles_once(s: SparkSession, d: str) -> DataFrame:
    """_tiled() for several readers: channels' first times are stored, not the events, which the tables give again."""
    events = _events(s, d)
    return windows.tiled(events, first=stored(windows.origins(events), "origins"))


def _batches(s: SparkSession, d: str) -> DataFrame:
    return context.message_batches(_of(s, d, E.CHAT))


def _cards(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A card for each group that has a trigger, and the events that it is held against."""
    events = _tiles_once(s, d)
    with removed(s):
        found = board.attributed(events, keep_ids=6).where("trigger is not null")
        made = keep(_broken(cards.cards_of_groups(found)), "cards")
    return made, events


def _broken(made: DataFrame) -> DataFrame:
    """Cards as a model might give them: the first digit of the id's hash says which rule, if any, a card breaks."""
    m, evidence, trigger = F.substring(F.md5("signal_id"), 1, 1), F.col("evidence"), F.col("trigger")
    ghost = F.array(F.lit("ghost"))
    cited = F.when(m == "1", F.concat(evidence, ghost)).when(m == "5", F.array().cast("array<string>")).when(m == "8", F.concat(evidence, F.array(trigger["event_id"]))).otherwise(evidence)
    cause = F.when(m == "2", "ghost").when(m == "9", cards.UNKNOWN).when(m == "6", F.get(evidence, F.lit(0))).when(m == "a", F.element_at(evidence, -1)).otherwise(trigger["event_id"])
    quote = F.when(m == "3", "nothing of the sort was said").when(m == "6", "").otherwise(trigger["quote"])
    window = F.when(m == "7", F.transform("window_ms", lambda t: t - 60_000)).otherwise(F.col("window_ms"))
    kind = F.when(m.isin("0", "6"), "reaction").when(m == "4", "none").otherwise(F.col("type"))
    return made.withColumns({"evidence": cited, "trigger": F.struct(trigger["kind"].alias("kind"), cause.alias("event_id"), quote.alias("quote")), "window_ms": window, "type": kind})


def _checked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    made, events = _cards(s, d)
    return stored(cards.check_cards(made, events), "checked"), events


def _verified(s: SparkSession, d: str) -> DataFrame:
    return _checked(s, d)[0].where("status = 'verified'")


def _sections(s: SparkSession, d: str) -> DataFrame:
    checked, events = _checked(s, d)
    return cards.debrief_sections(checked.where("status = 'verified'"), events)


def _markdown(s: SparkSession, d: str) -> DataFrame:
    checked, events = _checked(s, d)
    verified = checked.where("status = 'verified'")
    sections = stored(cards.debrief_sections(verified, events), "sections")
    return cards.debrief_markdown(sections, cards.recurring_themes(verified), _events(s, d).select("channel").distinct())


def _scores(s: SparkSession, d: str) -> DataFrame:
    """Cards of two versions of the gate as two systems, against the groups of every window as gold."""
    made, events = _cards(s, d)
    case = F.concat_ws("/", "channel", F.get("window_ms", F.lit(0)).cast("string")).alias("case_id")
    both = [cards.check_cards(made, events, v).select("*", case, F.lit(v).alias("system")) for v in cards.GATES]
    gold_no = F.row_number().over(Window.partitionBy("case_id").orderBy("signal_id")).alias("gold_no")
    gold = made.select("*", case).select("case_id", gold_no, "type", F.col("trigger.event_id").alias("trigger_event_id"), F.slice("evidence", 2, 9).alias("relevant_message_ids"))
    cases = gold.select("case_id").distinct().withColumn("must_abstain", F.lit(False))
    return evaluation.score_cases(both[0].unionByName(both[1]), stored(gold, "gold"), cases)


def _words(s: SparkSession, d: str) -> DataFrame:
    """Each word of an assistant's turn lasts 300 ms, 200 ms apart; a long one is followed by a pause."""
    turns = s.read.parquet(f"{d}/conversations.parquet").where("role = 'assistant' and text is not null")
    each = turns.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("place", "word"))
    pos, start = F.struct("turn", "place"), F.col("turn") * 100_000 + F.col("place") * 500 + F.when(F.length("word") % 7 == 6, 250).otherwise(0)
    return each.select(F.col("conv_id").cast("string").alias("channel"), pos.alias("pos"), start.alias("start_ms"), (start + F.when(F.length("word") % 5 == 0, -1400).otherwise(300)).alias("end_ms"), F.concat(F.lit("spk_"), (F.col("turn") % 2).cast("string")).alias("speaker"), "word")


def _irc(s: SparkSession, d: str) -> DataFrame:
    chat = _of(s, d, E.CHAT)
    return chat.select(F.concat(F.lit("@id="), "event_id", F.lit(";tmi-sent-ts="), F.col("ts_ms").cast("string"), F.lit(";display-name="), F.initcap("author"), F.lit(";user-type= :"), "author", F.lit("!x@y PRIVMSG #"), "channel", F.lit(" :"), F.translate("text", "\r", " ")).alias("value"))


def _turn_spans(s: SparkSession, d: str) -> DataFrame:
    spans = s.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg((F.min("turn") * 1500).alias("lo"), (F.max("turn") * 1500 + 200_000).alias("hi"))
    base = F.col("conv_id") * 7000
    return spans.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("case_id"), F.concat(F.lit("f"), F.floor(F.col("conv_id") / 50).cast("string")).alias("fixture"), (base + F.col("lo")).alias("start"), (base + F.col("hi")).alias("end"))


def _labelled(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = s.read.parquet(f"{d}/documents.parquet").where("doc_id is not null")
    row = docs.select("source", F.col("doc_id").alias("event_id"), F.coalesce("lang", F.lit("unsure")).alias("intent"), F.when(F.col("n_chars") > 0, F.floor(F.log10("n_chars"))).cast("string").alias("key"))
    return row.select("source", "event_id", "intent"), row.select("source", "event_id", "key")


QUERIES = {
    "visible_context": lambda s, d: context.visible_context(_tiled(s, d)),
    "bounded_chat": lambda s, d: context.bounded_chat(_of(s, d, E.CHAT)),
    "bounded_context": lambda s, d: context.bounded_context(_events(s, d)),
    "latest_n_context": lambda s, d: context.latest_n(_of(s, d, E.CHAT), ["channel"], 500).select("channel", "event_id", "place"),
    "numbered_chat": lambda s, d: context.numbered_chat(_batches(s, d)),
    "speech_context": lambda s, d: context.speech_context(_batches(s, d), _of(s, d, E.SPEECH)),
    "screen_context": lambda s, d: context.screen_context(_batches(s, d), _of(s, d, E.FRAME)),
    "overlap_speech": lambda s, d: context.overlap_speech(_of(s, d, E.SPEECH), 1000).select("channel", "event_id", "end"),
    "summary_counts": lambda s, d: context.summary_counts(_events(s, d)),
    "hierarchical_prev": lambda s, d: context.hierarchical_prev(stored(context.summary_counts(_events(s, d)).select("channel", "window_s", "end_ms"), "summaries")),
    "interim_replacement": lambda s, d: context.interim_replacement(_of(s, d, E.SPEECH).withColumn("final", F.length("event_id") % 2 == 0).withColumn("arrival", F.col("ts_ms"))).select("channel", "event_id", "final"),
    "pending_messages": lambda s, d: context.pending_messages(_of(s, d, E.CHAT), _of(s, d, E.CHAT).where("text like '%?'"), _of(s, d, E.CHAT).groupBy("channel").agg(F.max("ts_ms").alias("as_of"))).select("channel", "event_id"),
    "render_window": lambda s, d: context.render_window(_tiled(s, d)).select("channel", "win", F.md5("lines").alias("lines_md5")),
    "inspect": lambda s, d: context.inspect(_events(s, d)),
    "questions": lambda s, d: questions.questions(_of(s, d, E.CHAT)).withColumn("variants", F.array_join("variants", "\n")),
    "stream_questions": lambda s, d: questions.stream_questions(_events(s, d)).withColumn("shared", F.array_join("shared", ",")),
    "rolling_groups": lambda s, d: questions.rolling_groups(_of(s, d, E.CHAT)).withColumn("samples", F.array_join("samples", "\n")),
    "tick_changes": lambda s, d: questions.rolling_changes(_of(s, d, E.CHAT)).withColumn("groups", F.array_join(F.transform("groups", lambda g: F.concat_ws(" ", g["label"], g["count"].cast("string"))), ",")),
    "tile_cli": lambda s, d: questions.tile_cli(_events(s, d).groupBy("channel").agg(F.min("ts_ms").alias("start"), (F.max("ts_ms") + 1).alias("end"))),
    "check_card": lambda s, d: _checked(s, d)[0].select("channel", "signal_id", "type", "ok", "status", F.array_join("violations", ",").alias("violations")),
    "gate_ledger": lambda s, d: cards.gate_ledger(_checked(s, d)[0]).withColumn("codes", F.array_join(F.transform("codes", lambda c: F.concat_ws(" ", c["code"], c["n"].cast("string"))), ",")),
    "gate_rescore": lambda s, d: cards.gate_rescore(*_cards(s, d)),
    "cited_events": lambda s, d: cards.cited_events(*_cards(s, d)),
    "grounded_cards": lambda s, d: cards.grounded(_checked(s, d)[0]).select("channel", "signal_id"),
    "trigger_census": lambda s, d: evaluation.trigger_census(*_checked(s, d)),
    "debrief_sections": lambda s, d: _sections(s, d).drop("kind", "quote", "ids", "distribution"),
    "clip_candidates": lambda s, d: cards.clip_candidates(_sections(s, d)).drop("kind", "quote", "ids", "distribution"),
    "debrief_markdown": _markdown,
    "recurring_themes": lambda s, d: cards.recurring_themes(_verified(s, d)).withColumn("signal_ids", F.array_join("signal_ids", ",")),
    "distribution_shares": lambda s, d: cards.distribution_shares(_cards(s, d)[0]),
    "poll_drafts": lambda s, d: cards.poll_drafts(_verified(s, d)).drop("options").withColumn("warnings", F.array_join("warnings", "; ")),
    "score_cases": _scores,
    "score_systems": lambda s, d: evaluation.score_systems(_scores(s, d)),
    "pair_scores": lambda s, d: evaluation.pair_scores(*_labelled(s, d), ["source"]),
    "case_overlap": lambda s, d: evaluation.case_overlap(_turn_spans(s, d)),
    "parse_irc": lambda s, d: parsing.parse_irc(_irc(s, d)).select("event_id", "ts_ms", "login", "text"),
    "dedupe_rows": lambda s, d: parsing.dedupe_rows(_of(s, d, E.CHAT), ["channel", "ts_ms", "text"], ["event_id"]).select("channel", "event_id"),
    "user_dimension": lambda s, d: parsing.user_dimension(_of(s, d, E.CHAT).selectExpr("upper(author) login"), stored(parsing.user_dimension(_of(s, d, E.CHAT).selectExpr("channel login")), "users")),
    "words_to_segments": lambda s, d: parsing.words_to_segments(_words(s, d)),
    "upsert_summary": lambda s, d: feeds.upsert(_tiled(s, d).groupBy("channel", "win").agg(F.count("*").alias("n"), F.lit(1).alias("version")), _tiled(s, d).where("type = 'chat_message'").groupBy("channel", "win").agg(F.count("*").alias("n"), F.lit(2).alias("version")), ["channel", "win"], "version"),
}

_EVENTS = f"ev AS ({E.DUCKDB_VIEW})"
_TILED = f"{_EVENTS}, tiled AS (SELECT *, origin + (ts_ms - origin) // 60000 * 60000 AS win FROM (SELECT *, min(ts_ms) OVER (PARTITION BY channel) AS origin FROM ev))"
_RANKED = f"{_EVENTS}, chats AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ts_ms, event_id) - 1 AS p FROM ev WHERE type = 'chat_message'), batches AS (SELECT *, p // 3 AS batch, p % 3 + 1 AS number FROM chats)"
_LEVELS = (
    f"{_EVENTS}, lv AS (SELECT unnest([60, 300, 1800, 7200]) AS window_s), sp AS (SELECT ev.*, window_s, CASE WHEN type = 'transcript_segment' AND end_ms > ts_ms THEN end_ms - 1 ELSE ts_ms END AS last FROM ev, lv), "
    "sl AS (SELECT *, unnest(range(ts_ms // (window_s * 1000), last // (window_s * 1000) + 1)) AS k FROM sp), "
    "counts AS (SELECT channel, window_s, (k + 1) * window_s * 1000 AS end_ms, least(count(*) FILTER (type = 'chat_message'), 500) AS msg_count, least(count(*) FILTER (type = 'transcript_segment'), 100) AS audio_count, least(count(*) FILTER (type = 'frame_caption'), 20) AS frame_count FROM sl GROUP BY ALL)"
)

ORACLE_SQL = {
    "visible_context": f"WITH {_TILED}, t AS (SELECT channel, win, type, event_id, ts_ms, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS x FROM tiled WHERE type <> 'chat_message'), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY channel, win, type ORDER BY ts_ms, event_id) AS INTEGER) AS place FROM t WHERE x <> '') "
    "SELECT channel, win, type, place, event_id, ts_ms, CASE WHEN length(x) > 240 THEN substring(x, 1, 239) || '…' ELSE x END AS text FROM r WHERE place <= CASE WHEN type = 'transcript_segment' THEN 12 ELSE 6 END",
    "bounded_chat": f"WITH {_RANKED} SELECT channel, event_id, ts_ms, CAST(p + 1 AS INTEGER) AS place, substring(text, 1, 1024) AS text FROM chats WHERE p < 3000",
    "bounded_context": f"WITH {_EVENTS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY channel ORDER BY ts_ms, type, event_id) AS INTEGER) AS place FROM ev WHERE type <> 'chat_message') SELECT channel, event_id, place, CAST((place - 1) // 12 AS BIGINT) AS batch, substring(text, 1, 500) AS text FROM r WHERE place <= 128",
    "latest_n_context": f"WITH {_RANKED}, m AS (SELECT *, max(p) OVER (PARTITION BY channel) AS top FROM chats) SELECT channel, event_id, CAST(p - greatest(top - 499, 0) + 1 AS INTEGER) AS place FROM m WHERE p > top - 500",
    "numbered_chat": f"WITH {_RANKED} SELECT channel, batch, string_agg(concat(number, '. ', author, ': ', text), chr(10) ORDER BY number) AS lines FROM batches GROUP BY ALL",
    "screen_context": f"WITH {_RANKED}, b AS (SELECT channel, batch, min(ts_ms) AS lo, max(ts_ms) AS hi FROM batches GROUP BY ALL), f AS (SELECT b.channel, b.batch, any_value(lo) AS lo, max((ev.ts_ms, event_id, text)) AS x FROM b JOIN ev ON ev.channel = b.channel AND ev.type = 'frame_caption' AND ev.ts_ms <= hi GROUP BY ALL) "
    "SELECT b.channel, b.batch, CASE WHEN x[1] >= b.lo - 60000 THEN x[3] ELSE 'No screen description available.' END AS screen FROM b LEFT JOIN f ON f.channel = b.channel AND f.batch = b.batch",
    "overlap_speech": f"WITH {_EVENTS} SELECT channel, event_id, unnest(range(ts_ms // 1000 + 1, (end_ms - 1) // 1000 + 2)) * 1000 AS \"end\" FROM ev WHERE type = 'transcript_segment' AND end_ms > ts_ms",
    "summary_counts": f"WITH {_LEVELS} SELECT * FROM counts",
    "hierarchical_prev": f"WITH {_LEVELS}, pr AS (SELECT * FROM (VALUES (300, 60), (1800, 300), (7200, 1800)) AS p(window_s, prev_s)), j AS (SELECT u.channel, u.window_s, u.end_ms, prev_s, l.end_ms AS prev_end, row_number() OVER (PARTITION BY u.channel, u.window_s, u.end_ms ORDER BY l.end_ms DESC) AS k FROM counts u JOIN pr USING (window_s) "
    "JOIN counts l ON l.channel = u.channel AND l.window_s = prev_s AND l.end_ms > u.end_ms - u.window_s * 1000 AND l.end_ms <= u.end_ms) SELECT channel, window_s, end_ms, prev_s, prev_end FROM j WHERE k <= greatest(1, window_s // prev_s)",
    "pending_messages": f"WITH {_EVENTS}, c AS (SELECT *, max(ts_ms) OVER (PARTITION BY channel) AS as_of FROM ev WHERE type = 'chat_message') SELECT channel, event_id FROM c WHERE ts_ms > as_of - 120000 AND NOT text LIKE '%?'",
    "render_window": f"WITH {_TILED} SELECT channel, win, md5(string_agg(concat('[', CASE type WHEN 'chat_message' THEN 'chat' WHEN 'transcript_segment' THEN 'speech' ELSE 'screen' END, '] ', event_id, ' ', ts_ms, ' ', coalesce(author, ''), ': ', coalesce(text, '')), chr(10) ORDER BY ts_ms, type, event_id)) AS lines_md5 FROM tiled GROUP BY ALL",
    "tile_cli": f"WITH {_EVENTS}, s AS (SELECT channel, min(ts_ms) AS a, max(ts_ms) + 1 AS b FROM ev GROUP BY ALL), t AS (SELECT *, unnest(range(a, b, 60000)) AS lo FROM s) SELECT channel, lo, least(lo + 60000, b) AS hi FROM t",
    "pair_scores": "WITH r AS (SELECT source, lang AS intent, CASE WHEN n_chars > 0 THEN floor(log10(n_chars)) END AS key FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND lang <> 'unsure'), "
    "tp AS (SELECT source, sum(n * (n - 1) / 2) AS tp FROM (SELECT source, intent, key, count(*) AS n FROM r WHERE key IS NOT NULL GROUP BY ALL) GROUP BY ALL), sa AS (SELECT source, sum(n * (n - 1) / 2) AS sa FROM (SELECT source, key, count(*) AS n FROM r WHERE key IS NOT NULL GROUP BY ALL) GROUP BY ALL), "
    "tr AS (SELECT source, sum(n * (n - 1) / 2) AS tr FROM (SELECT source, intent, count(*) AS n FROM r GROUP BY ALL) GROUP BY ALL), a AS (SELECT tr.source AS source, coalesce(tp, 0) AS tp, coalesce(sa, 0) AS sa, tr FROM tr LEFT JOIN tp USING (source) LEFT JOIN sa USING (source)), "
    "u AS (SELECT * FROM a UNION ALL SELECT NULL, sum(tp), sum(sa), sum(tr) FROM a) SELECT source, tp, tp / nullif(sa, 0) AS precision, tp / nullif(tr, 0) AS recall, 2 * tp / nullif(sa + tr, 0) AS f1 FROM u",
    "case_overlap": "WITH c AS (SELECT concat('c', conv_id) AS case_id, concat('f', conv_id // 50) AS fixture, conv_id * 7000 + min(turn) * 1500 AS s, conv_id * 7000 + max(turn) * 1500 + 200000 AS e FROM conversations GROUP BY conv_id) "
    "SELECT x.fixture, x.case_id, y.case_id AS other, (least(x.e, y.e) - greatest(x.s, y.s)) / least(x.e - x.s, y.e - y.s) AS share FROM c x JOIN c y ON x.fixture = y.fixture AND x.case_id < y.case_id AND x.s < y.e AND y.s < x.e",
    "parse_irc": f"WITH {_EVENTS} SELECT event_id, ts_ms, lower(author) AS login, regexp_replace(replace(text, chr(13), ' '), '[\\r\\n]+$', '') AS text FROM ev WHERE type = 'chat_message'",
    "dedupe_rows": f"WITH {_EVENTS} SELECT channel, min(event_id) AS event_id FROM ev WHERE type = 'chat_message' GROUP BY channel, ts_ms, text",
    "user_dimension": f"WITH {_EVENTS}, c AS (SELECT DISTINCT lower(channel) AS login FROM ev WHERE type = 'chat_message' AND channel IS NOT NULL), k AS (SELECT row_number() OVER (ORDER BY login) AS user_id, login FROM c), n AS (SELECT DISTINCT lower(author) AS login FROM ev WHERE type = 'chat_message' AND author IS NOT NULL AND lower(author) NOT IN (SELECT login FROM c)) "
    "SELECT user_id, login FROM k UNION ALL SELECT (SELECT max(user_id) FROM k) + row_number() OVER (ORDER BY login), login FROM n",
    "upsert_summary": f"WITH {_TILED} SELECT channel, win, CASE WHEN m > 0 THEN m ELSE n END AS n, CASE WHEN m > 0 THEN 2 ELSE 1 END AS version FROM (SELECT channel, win, count(*) AS n, count(*) FILTER (type = 'chat_message') AS m FROM tiled GROUP BY ALL)",
}
