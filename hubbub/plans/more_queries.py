"""Queries over single functions, inputs, recorded runs and groupings by label, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..operators import board, cards, context, evaluation, grouping, prompts, questions, replay, windows
from ..sources import events as E
from ..sources import parsing
from . import chat_sql as S
from . import context_queries as C
from .store import keep, new_path, removed, stored


def _ids(s: SparkSession, d: str, value: Column, name: str = "value") -> DataFrame:
    return C._events(s, d).select("channel", "event_id", value.alias(name))


def _text(function) -> Column:
    return function(F.col("text"))


def _attributed(s: SparkSession, d: str) -> DataFrame:
    with removed(s):
        return keep(board.attributed(C._tiles_once(s, d)), "attributed")


def _triggers(s: SparkSession, d: str, of) -> DataFrame:
    events = C._tiles_once(s, d)
    return of(stored(grouping.group_chat(events.where(F.col("type") == E.CHAT)), "groups"), events.where(F.col("type") != E.CHAT))


def _responses(s: SparkSession, d: str) -> DataFrame:
    """Even turns as a response with one utterance, odd ones as words of 300 ms, 200 ms apart."""
    turns = s.read.parquet(f"{d}/conversations.parquet").where("text is not null")
    whole = F.to_json(F.struct(F.struct(F.array(F.struct((F.col("turn") * 1.5).alias("start"), (F.col("turn") * 1.5 + 1.2).alias("end"), F.col("text").alias("transcript"), F.lit("1").alias("speaker"))).alias("utterances")).alias("results")))
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("word"), (i * 0.5).alias("start"), (i * 0.5 + 0.3).alias("end"), F.lit("2").alias("speaker")))
    bare = F.to_json(F.struct(F.struct(F.array(F.struct(F.array(F.struct(words.alias("words"))).alias("alternatives"))).alias("channels")).alias("results")))
    return turns.select(F.concat_ws("/", "conv_id", "turn").alias("channel"), (F.col("conv_id") * 1000).alias("start_ms"), F.when(F.col("turn") % 2 == 0, whole).otherwise(bare).alias("json"))


def _captions(s: SparkSession, d: str) -> DataFrame:
    turns = s.read.parquet(f"{d}/conversations.parquet")
    text = F.when(F.col("turn") == 0, F.concat(F.lit("The image shows: "), "text")).when(F.col("turn") == 1, F.concat_ws("/", "turn", "conv_id")).when(F.col("turn") == 2, F.repeat(F.concat("text", F.lit("  ")), 6)).otherwise(F.col("text"))
    return turns.select("conv_id", "turn", text.alias("text"))


def _frames(s: SparkSession, d: str) -> DataFrame:
    turns = s.read.parquet(f"{d}/conversations.parquet")
    name = F.when(F.col("conv_id") % 2 == 0, F.format_string("%06d", F.col("turn") + 1)).otherwise((F.col("turn") * 777 + 1_700_000_000_000).cast("string"))
    folder = F.concat(F.lit("/frames/"), F.col("conv_id").cast("string"), F.lit("/"))
    return turns.select(F.concat(folder, name, F.lit(".jpg")).alias("path"), folder.alias("folder"))


def _replies(s: SparkSession, d: str) -> DataFrame:
    turns = s.read.parquet(f"{d}/conversations.parquet")
    good = F.concat(F.lit('{"cards": [{"signal_id": "c'), F.col("conv_id").cast("string"), F.lit('", "type": "reaction", "title": "'), "role", F.lit('"}, "junk", {"type": "odd", "distribution": "one"}, {"type": "none"}]}'))
    reply = F.when(F.col("turn") % 4 == 1, "no json").when(F.col("turn") % 4 == 2, '{"cards": {}}').when(F.col("turn") % 4 == 3, '{"cards": []}').otherwise(good)
    return turns.select(F.concat_ws("/", "conv_id", "turn").alias("channel"), reply.alias("reply"))


def _prompt(s: SparkSession, d: str) -> DataFrame:
    found = _attributed(s, d)
    first = board.merged_rows(found).where("rank = 1").select(*windows.SCOPE, F.col("trigger_id").alias("id"))
    said = found.where("trigger is not null").select(*windows.SCOPE, F.col("trigger.event_id").alias("id"), F.col("trigger.text").alias("text")).distinct()
    return prompts.group_labels_prompt(found, said.join(first, [*windows.SCOPE, "id"]), windows.SCOPE)


def _labelled_groups(s: SparkSession, d: str) -> DataFrame:
    """Replies that label every group by its key in upper case, one that nobody asked for, and one that is no JSON."""
    groups = stored(grouping.group_chat(C._tiled(s, d).where(F.col("type") == E.CHAT)), "groups")
    asked = groups.groupBy(*windows.SCOPE).agg(F.map_from_entries(F.collect_list(F.struct("key", F.concat(F.lit("  it  is "), F.upper("key")).alias("said")))).alias("labels"))
    reply = F.when(F.col("win") % 7 == 0, "sorry").otherwise(F.to_json(F.struct(F.map_concat("labels", F.create_map(F.lit("x:other"), F.lit("nobody"))).alias("labels"))))
    return prompts.apply_labels(groups, asked.select(*windows.SCOPE, reply.alias("reply")), windows.SCOPE).select(*windows.SCOPE, "key", "meaning")


def _script(s: SparkSession, d: str) -> DataFrame:
    made, events = C._cards(s, d)
    chat = events.where(F.col("type") == E.CHAT)
    with removed(s):
        ticks = keep(questions.rolling_changes(chat), "changes")
    return replay.replay_script(chat, made, chat, ticks)


def _meta(s: SparkSession, d: str) -> DataFrame:
    found = C._events(s, d).groupBy("channel").agg((F.max("ts_ms") - F.min("ts_ms")).alias("span"), F.count_if(F.col("type") == E.CHAT).alias("chat_messages"), F.count_if(F.col("type") == E.SPEECH).alias("speech"))
    return found.select(F.concat(F.lit("f_"), "channel").alias("fixture_id"), "channel", F.lit("2025-01-01").alias("captured_utc"), (F.col("span") / 1000).alias("duration_s"), "chat_messages", (F.col("speech") > 0).alias("enriched"), F.lit("tables").alias("provenance"))


def _results(s: SparkSession, d: str) -> DataFrame:
    rows = C._of(s, d, E.SPEECH).select(F.concat(F.lit("f_"), "channel").alias("fixture_id"), F.when(F.length("channel") % 2 == 1, "other").when(F.length("text") % 2 == 0, "baseline").otherwise("agent").alias("system"))
    return rows.distinct()


def _runs(s: SparkSession, d: str) -> DataFrame:
    turns = s.read.parquet(f"{d}/conversations.parquet")
    kind = F.when(F.col("role") == "user", "tool").when(F.col("role") == "assistant", "model").otherwise("gate")
    step = F.struct("turn", kind.alias("kind"), F.when(kind == "tool", F.concat(F.lit("t"), (F.col("turn") % 3).cast("string"))).alias("tool"), (F.col("conv_id") % 3 > 0).alias("ok"))
    runs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return runs.select(F.concat(F.lit("agent"), (F.col("conv_id") % 4).cast("string")).alias("agent"), F.col("conv_id").alias("trace_id"), "steps")


def _calls(s: SparkSession, d: str) -> DataFrame:
    turns = s.read.parquet(f"{d}/conversations.parquet")
    return turns.select(F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"), F.when(F.col("turn") % 2 == 0, "p").alias("provider"), F.length("text").cast("long").alias("prompt_tokens"), F.col("turn").alias("completion_tokens"))


def _gold_of(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards as gold signals, and their cases."""
    case = F.concat_ws("/", "channel", F.get("window_ms", F.lit(0)).cast("string")).alias("case_id")
    number = F.row_number().over(Window.partitionBy("case_id").orderBy("signal_id")).alias("gold_no")
    gold = made.select("*", case).select("case_id", number, "type", F.col("trigger.event_id").alias("trigger_event_id"), F.col("evidence").alias("relevant_message_ids"))
    cases = made.select(case, "channel", F.get("window_ms", F.lit(0)).alias("start"), F.get("window_ms", F.lit(1)).alias("end")).distinct()
    return gold, cases


def _gold(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    made, events = C._cards(s, d)
    return *_gold_of(made), events


def _matches(s: SparkSession, d: str) -> DataFrame:
    made, _ = C._cards(s, d)
    gold, _ = _gold_of(made)
    made = made.select(F.concat_ws("/", "channel", F.get("window_ms", F.lit(0)).cast("string")).alias("case_id"), F.lit("x").alias("system"), "signal_id", "type", F.slice("evidence", 2, 9).alias("evidence"))
    return evaluation.candidate_matches(made, gold)


def _arms(s: SparkSession, d: str) -> DataFrame:
    """The two groupings of each window's chat against labels by how a text begins."""
    chat = C._tiles_once(s, d).where(F.col("type") == E.CHAT)
    labels = chat.select(*windows.SCOPE, "event_id", F.when(F.length("text") % 5 == 0, "unsure").otherwise(F.substring(F.lower("text"), 1, 2)).alias("intent"))
    both = {"exact": evaluation.arm_exact(chat, windows.SCOPE), "token_prefix": evaluation.arm_token_prefix(chat, windows.SCOPE)}
    return evaluation.score_arms(labels, both, windows.SCOPE).where("win is null").select("arm", "tp", "precision", "recall", "f1")


def _clusters(s: SparkSession, d: str) -> DataFrame:
    vectors = s.read.parquet(f"{d}/embeddings.parquet").select(F.floor(F.col("vec_id") / 50).alias("win"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return evaluation.arm_embeddings(vectors, ["win"]).selectExpr("cast(round(threshold * 100) as int) percent", "win", "id", "key")


def _union(s: SparkSession, d: str) -> DataFrame:
    checked = C._checked(s, d)[0]
    return replay.union_emitted(checked.where("ok"), checked.where("not ok"), ["channel"]).select("channel", "signal_id", "status", "place")


def _capped(s: SparkSession, d: str) -> DataFrame:
    made = C._cards(s, d)[0].withColumn("place", F.length("signal_id")).withColumn("type", F.when(F.col("type") == "none", "other").otherwise(F.col("type")))
    return cards.capped(made.withColumn("win", F.get("window_ms", F.lit(0))), ["channel", "win"]).select("channel", "win", "signal_id", "dropped")


def _exported(s: SparkSession, d: str) -> DataFrame:
    made = C._cards(s, d)[0].select("signal_id", "title", "trigger", F.lit("me").alias("author"))
    return cards.mask_export(made).selectExpr("signal_id", "title", "trigger.kind", "trigger.event_id", "trigger.quote")


def _summaries(s: SparkSession, d: str) -> DataFrame:
    counts = context.summary_counts(C._events(s, d))
    return stored(counts.select("channel", "window_s", "end_ms", F.concat_ws(" and ", F.col("msg_count").cast("string"), F.col("audio_count").cast("string")).alias("summary")), "summaries")


def _written(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "written")
    parsing.write_tables(C._events(s, d), path)
    return s.read.schema("event_id string, type string, ts_ms long, text string, channel string").json(path).groupBy("channel", "type").agg(F.count("*").alias("n"), F.max("ts_ms").alias("last"), F.sum(F.length("text")).alias("chars"))


_SALT = "pepper"
QUERIES = {
    "canonical": lambda s, d: _ids(s, d, _text(T.canonical)),
    "is_reaction": lambda s, d: _ids(s, d, T.is_reaction(_text(T.canonical))),
    "content_tokens": lambda s, d: _ids(s, d, F.array_join(T.content_tokens(_text(T.canonical)), " ")),
    "is_question": lambda s, d: _ids(s, d, T.is_question(F.col("text"), _text(T.canonical))),
    "normalize_quote": lambda s, d: _ids(s, d, _text(T.normalize_quote)),
    "token_overlap": lambda s, d: C._events(s, d).select("channel", "event_id", T.normalize_quote(F.substring("text", 5, 60)).alias("q"), _text(T.normalize_quote).alias("t")).select("channel", "event_id", T.token_overlap(F.col("q"), F.col("t")).alias("value")),
    "link_host": lambda s, d: _ids(s, d, _text(T.link_host)),
    "injection_match": lambda s, d: _ids(s, d, _text(T.is_injection)),
    "mention_extract": lambda s, d: _ids(s, d, F.array_join(_text(T.mentions), " ")),
    "timecode": lambda s, d: _ids(s, d, T.timecode(F.col("ts_ms") - 5000)),
    "truncate_text": lambda s, d: _ids(s, d, T.truncated(F.col("text"), 40)),
    "make_event_id": lambda s, d: _ids(s, d, T.event_id("msg", F.col("ts_ms"), F.col("text"))),
    "trace_id": lambda s, d: _ids(s, d, prompts.trace_id(F.col("channel"), F.col("event_id"))),
    "request_hash": lambda s, d: _ids(s, d, prompts.request_hash(F.to_json(F.struct("ts_ms", F.struct(F.col("event_id").alias("z"), F.lit(1).alias("b")).alias("a"))))),
    "pseudonymise": lambda s, d: C._of(s, d, E.CHAT).select("channel", "event_id", T.pseudonym(_SALT, F.col("author")).alias("value")),
    "clean_caption": lambda s, d: _captions(s, d).select("conv_id", "turn", parsing.clean_caption(F.col("text")).alias("caption")),
    "clean_caption_legacy": lambda s, d: _captions(s, d).select("conv_id", "turn", parsing.clean_caption_legacy(F.col("text")).alias("caption")),
    "stt_segments": lambda s, d: parsing.stt_segments(_responses(s, d)),
    "speaker_phrases": lambda s, d: parsing.speaker_phrases(C._words(s, d).withColumn("response", F.col("pos.turn")).withColumn("speaker", F.when(F.col("pos.place") % 3 > 0, F.col("speaker")))),
    "stamp_frames": lambda s, d: parsing.stamp_frames(_frames(s, d), 5000, 10),
    "write_tables": _written,
    "chat_window": lambda s, d: windows.slices(C._of(s, d, E.CHAT), _thirds(s, d)).select("channel", "start", "event_id", "author"),
    "transcript_window": lambda s, d: windows.slices(C._of(s, d, E.SPEECH).where("final"), _thirds(s, d)).select("channel", "start", "event_id", "end_ms"),
    "frame_window": lambda s, d: windows.slices(C._of(s, d, E.FRAME), _thirds(s, d)).select("channel", "start", "event_id", "text"),
    "parse_cards": lambda s, d: cards.parse_cards(_replies(s, d)).selectExpr("channel", "parse_error", "place", "signal_id", "type", "title"),
    "card_types_and_cap": _capped,
    "mask_export": _exported,
    "trigger_preceding": lambda s, d: _triggers(s, d, board.trigger_preceding).selectExpr("channel", "win", "key", "preceding.event_id preceding").where("preceding is not null"),
    "trigger_matched": lambda s, d: _triggers(s, d, board.trigger_matched).selectExpr("channel", "win", "key", "matched.event_id matched"),
    "answered_by": lambda s, d: questions.answered_by(stored(questions.questions(C._of(s, d, E.CHAT)), "questions"), C._of(s, d, E.SPEECH)).withColumn("shared", F.array_join("shared", ",")),
    "group_labels_prompt": _prompt,
    "apply_labels": _labelled_groups,
    "replay_script": _script,
    "hero_lead_up": lambda s, d: (lambda found: replay.hero_lead_up(cards.grounded(found[0]), found[1]))(C._checked(s, d)),
    "cache_misses": lambda s, d: context.cache_misses(*_requests(s, d)),
    "cache_counts": lambda s, d: context.cache_counts(*_requests(s, d)),
    "available_captures": lambda s, d: replay.available_captures(_meta(s, d), _results(s, d)).withColumn("systems", F.array_join("systems", ",")),
    "fixture_provenance": lambda s, d: replay.fixture_provenance(C._of(s, d, E.FRAME).select(F.col("event_id").alias("case_id"), F.concat(F.lit("f_"), "channel").alias("fixture"), F.when(F.length("channel") % 2 == 0, "capture").alias("fixture_kind")), _meta(s, d)).withColumn("cases", F.array_join("cases", ",")),
    "trajectory_counts": lambda s, d: evaluation.trajectory_counts(_runs(s, d)),
    "tool_calls": lambda s, d: evaluation.tool_calls(_runs(s, d)),
    "usage_ledger": lambda s, d: evaluation.usage_ledger(_calls(s, d)),
    "union_emitted": _union,
    "evidence_intersection": _matches,
    "draft_action": lambda s, d: C._checked(s, d)[0].where("action is not null").selectExpr("channel", "signal_id", "action.kind", "action.state"),
    "gold_selfcheck": lambda s, d: evaluation.gold_selfcheck(*_gold(s, d)).withColumn("violations", F.array_join("violations", ",")),
    "score_arms": _arms,
    "arm_embeddings": _clusters,
    "summary_inputs": lambda s, d: prompts.summary_inputs(C._events(s, d), _summaries(s, d)).select("channel", "window_s", "end_ms", *[F.md5(c).alias(c) for c in ("chat", "audio", "frames")], "prev"),
    "rolling_context": lambda s, d: prompts.rolling_context(C._events(s, d)),
}


def _requests(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = C._of(s, d, E.CHAT).select(F.sha2("text", 256).alias("key"), "event_id", "text")
    return rows.select("key", "event_id"), rows.where("text like '%a'").select("key")


def _thirds(s: SparkSession, d: str) -> DataFrame:
    spans = C._events(s, d).groupBy("channel").agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
    return spans.select("channel", F.explode(F.sequence("lo", "hi", F.lit(context.MAX_SPAN_MS).cast("long"))).alias("start")).withColumn("end", F.col("start") + 60_000)


_EV = f"WITH {S.EVENTS}"
_SPACE = r"[\s\x0b\x85\p{Z}]+"
_ONE = f"trim(regexp_replace(coalesce({{x}}, ''), '{_SPACE}', ' ', 'g'))"
_QUOTE = r"trim(regexp_replace(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\s\x0b\x85\p{Z}]', ' ', 'g'), '[\s\x0b\x85\p{Z}]+', ' ', 'g'))"


def _one(x: str) -> str:
    return _ONE.replace("{x}", x)


def _quote(x: str) -> str:
    return _QUOTE.replace("{x}", x)


def _of_texts(value: str) -> str:
    return f"{S.TEXTS} SELECT channel, event_id, {value} AS value FROM ev JOIN canon_of USING (text) JOIN tokens_of USING (text)"


def _of_events(value: str) -> str:
    return f"{_EV} SELECT channel, event_id, {value} AS value FROM ev"


_CAPTIONS = "WITH c AS (SELECT conv_id, turn, " + _one("CASE turn WHEN 0 THEN concat('The image shows: ', text) WHEN 1 THEN concat(turn, '/', conv_id) WHEN 2 THEN repeat(concat(text, '  '), 6) ELSE text END") + " AS t FROM conversations)"
_WORDS = "w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS place FROM conversations WHERE role = 'assistant' AND text IS NOT NULL), words AS (SELECT CAST(conv_id AS VARCHAR) AS channel, turn, place, word, turn * 100000 + place * 500 + CASE WHEN length(word) % 7 = 6 THEN 250 ELSE 0 END AS start_ms, turn * 100000 + place * 500 + CASE WHEN length(word) % 7 = 6 THEN 250 ELSE 0 END + CASE WHEN length(word) % 5 = 0 THEN -1400 ELSE 300 END AS end_ms, concat('spk_', turn % 2) AS speaker FROM w)"
_THIRDS = f"{S.EVENTS}, o AS (SELECT channel, min(ts_ms) AS lo FROM ev GROUP BY ALL), th AS (SELECT e.*, (ts_ms - lo) // 180000 * 180000 + lo AS start FROM ev e JOIN o USING (channel)), thirds AS (SELECT * FROM th WHERE ts_ms < start + 60000)"
_META = f"{S.EVENTS}, meta AS (SELECT concat('f_', channel) AS fixture_id, channel, (max(ts_ms) - min(ts_ms)) / 1000 AS duration_s, count(*) FILTER (type = 'chat_message') AS chat_messages, count(*) FILTER (type = 'transcript_segment') AS speech FROM ev GROUP BY ALL)"
_RUNS = "WITH r AS (SELECT concat('agent', conv_id % 4) AS agent, conv_id, turn, CASE role WHEN 'user' THEN 'tool' WHEN 'assistant' THEN 'model' ELSE 'gate' END AS kind, conv_id % 3 > 0 AS ok FROM conversations)"
_CASES = f"{S.CARDS}, gold AS (SELECT *, concat(channel, '/', lo) AS case_id, CAST(row_number() OVER (PARTITION BY channel, lo ORDER BY signal_id) AS INTEGER) AS gold_no FROM cards)"
_PAIRS = "n * (n - 1) / 2"
#: Cards take, in the order of their ids, the gold signal with most overlap that none took before.
_MATCHED = (
    f"{_CASES}, want AS (SELECT case_id, gold_no, type, tid, evidence [2:10] AS evidence FROM gold), has_ids AS (SELECT concat(channel, '/', lo) AS case_id, signal_id, type, evidence FROM cards), "
    "cand AS (SELECT c.case_id, signal_id, gold_no, len(list_intersect(c.evidence, w.evidence)) AS overlap FROM has_ids c JOIN want w ON w.case_id = c.case_id AND w.type = c.type WHERE len(list_intersect(c.evidence, w.evidence)) > 0), "
    "opts AS (SELECT case_id, signal_id, list((-overlap, gold_no) ORDER BY -overlap, gold_no) AS o, row_number() OVER (PARTITION BY case_id ORDER BY signal_id) AS k FROM cand GROUP BY case_id, signal_id), "
    "turns AS (SELECT case_id, CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS taken, CAST(NULL AS VARCHAR) AS signal_id, CAST(NULL AS INTEGER) AS gold_no FROM (SELECT DISTINCT case_id FROM opts) UNION ALL "
    "SELECT case_id, k, CASE WHEN p IS NULL THEN taken ELSE list_append(taken, p) END, signal_id, p FROM (SELECT o.case_id, o.k, t.taken, o.signal_id, list_filter(o.o, lambda x: NOT list_contains(t.taken, x[2])) [1][2] AS p FROM turns t JOIN opts o ON o.case_id = t.case_id AND o.k = t.k + 1)), "
    f"gates AS (SELECT 'reaction-v2' AS system, signal_id, len(violations) = 0 AS ok FROM ({S._checked(True)}) UNION ALL SELECT 'strict-v1', signal_id, len(violations) = 0 FROM ({S._checked(False)})), "
    "per AS (SELECT concat(c.channel, '/', c.lo) AS case_id, b.system, count(*) AS n_cards, count(*) FILTER (t.gold_no IS NOT NULL AND c.tid = w.tid) AS trigger_correct, count(t.gold_no) AS trigger_scored, count(*) FILTER (t.gold_no IS NULL) AS unmatched, count(*) FILTER (NOT ok) AS unsupported, count(DISTINCT t.gold_no) AS recall_hits "
    "FROM cards c JOIN gates b USING (signal_id) LEFT JOIN (SELECT * FROM turns WHERE gold_no IS NOT NULL) t ON t.signal_id = c.signal_id LEFT JOIN want w ON w.case_id = t.case_id AND w.gold_no = t.gold_no GROUP BY ALL), "
    "scored AS (SELECT per.*, n_gold, false AS must_abstain, CAST(NULL AS BOOLEAN) AS abstain_correct FROM per JOIN (SELECT case_id, count(*) AS n_gold FROM want GROUP BY ALL) USING (case_id))"
)


def _scored(arm: str, predicted: str) -> str:
    return (
        f"(WITH r AS (SELECT l.channel, l.win, intent, p.key FROM labels_of l LEFT JOIN {predicted} p USING (channel, win, event_id)), tp AS (SELECT sum({_PAIRS}) AS v FROM (SELECT count(*) AS n FROM r WHERE key IS NOT NULL GROUP BY channel, win, intent, key)), "
        f"sa AS (SELECT sum({_PAIRS}) AS v FROM (SELECT count(*) AS n FROM r WHERE key IS NOT NULL GROUP BY channel, win, key)), tr AS (SELECT sum({_PAIRS}) AS v FROM (SELECT count(*) AS n FROM r GROUP BY channel, win, intent)) "
        f"SELECT '{arm}' AS arm, coalesce(tp.v, 0) AS tp, tp.v / nullif(sa.v, 0) AS precision, tp.v / nullif(tr.v, 0) AS recall, 2 * tp.v / nullif(sa.v + tr.v, 0) AS f1 FROM tp, sa, tr)"
    )


ORACLE_SQL = {
    "canonical": _of_texts("canon"),
    "is_reaction": _of_texts(S._REACTION),
    "content_tokens": _of_texts("array_to_string(tokens, ' ')"),
    "is_question": _of_texts(S._ASKS),
    "normalize_quote": _of_events(_quote("text")),
    "token_overlap": f"{_EV}, q AS (SELECT channel, event_id, list_filter(string_split({_quote('substring(text, 5, 60)')}, ' '), lambda w: w <> '') AS q, string_split({_quote('text')}, ' ') AS t FROM ev) SELECT channel, event_id, coalesce(len(list_filter(q, lambda w: list_contains(t, w))) / nullif(len(q), 0), 0) AS value FROM q",
    "link_host": _of_events(f"nullif({S._HOST}, '')"),
    "injection_match": _of_events(f"regexp_matches(text, '{fixed.INJECTION}')"),
    "mention_extract": _of_events("array_to_string(regexp_extract_all(text, '@([A-Za-z0-9_]{3,25})', 1), ' ')"),
    "timecode": f"{_EV}, t AS (SELECT *, greatest(CAST(floor((ts_ms - 5000) / 1000) AS BIGINT), 0) AS x FROM ev) SELECT channel, event_id, printf('%02d:%02d:%02d', x // 3600, x // 60 % 60, x % 60) AS value FROM t",
    "truncate_text": f"{_EV}, t AS (SELECT *, {_one('text')} AS x FROM ev) SELECT channel, event_id, CASE WHEN length(x) > 40 THEN concat(rtrim(substring(x, 1, 39)), '…') ELSE x END AS value FROM t",
    "make_event_id": _of_events("concat('msg_', substring(sha256(concat(ts_ms, '|', text)), 1, 10))"),
    "trace_id": _of_events("concat('trc_', substring(sha256(concat(channel, '|', event_id)), 1, 8))"),
    "request_hash": _of_events("""sha256(concat('{"a":{"b":1,"z":"', event_id, '"},"ts_ms":', ts_ms, '}'))"""),
    "pseudonymise": f"{_EV} SELECT channel, event_id, concat('u_', substring(sha256(concat('{_SALT}|', lower(author))), 1, 10)) AS value FROM ev WHERE type = 'chat_message'",
    "clean_caption": f"{_CAPTIONS} SELECT conv_id, turn, nullif(substring(t, 1, 500), '') AS caption FROM c",
    "clean_caption_legacy": f"{_CAPTIONS}, b AS (SELECT conv_id, turn, trim(regexp_replace(t, '(?i)^(?:the|this) (?:image|frame|screenshot) shows:?\\s*', '')) AS t FROM c) SELECT conv_id, turn, CASE WHEN t <> '' AND NOT regexp_matches(t, '^\\d+\\s*/\\s*\\d+$') THEN CASE WHEN length(t) > 500 THEN concat(regexp_replace(substring(t, 1, 499), '\\s+\\S*$', ''), '…') ELSE t END END AS caption FROM b",
    "stt_segments": f"WITH t AS (SELECT concat(conv_id, '/', turn) AS channel, conv_id * 1000 AS b, turn, {_one('text')} AS text, len(string_split(text, ' ')) AS n FROM conversations WHERE text IS NOT NULL) "
    "SELECT channel, CAST(CASE WHEN turn % 2 = 0 THEN b + turn * 1500 ELSE b END AS BIGINT) AS ts_ms, CAST(CASE WHEN turn % 2 = 0 THEN b + floor((CAST(turn AS DOUBLE) * CAST(1.5 AS DOUBLE) + CAST(1.2 AS DOUBLE)) * 1000) ELSE b + floor((CAST(n - 1 AS DOUBLE) * CAST(0.5 AS DOUBLE) + CAST(0.3 AS DOUBLE)) * 1000) END AS BIGINT) AS end_ms, text, CASE WHEN turn % 2 = 0 THEN 'spk_1' ELSE 'spk_2' END AS speaker FROM t WHERE text <> ''",
    "words_to_segments": f"WITH {_WORDS}, b AS (SELECT *, lag(speaker) OVER o AS ps, lag(end_ms) OVER o AS pe FROM words WINDOW o AS (PARTITION BY channel ORDER BY turn, place)), s AS (SELECT *, sum(CASE WHEN coalesce(ps = speaker AND start_ms - pe <= 1500, false) THEN 0 ELSE 1 END) OVER (PARTITION BY channel ORDER BY turn, place) AS segment FROM b), "
    f"g AS (SELECT channel, segment, min(start_ms) AS ts_ms, last(end_ms ORDER BY turn, place) AS e, string_agg(word, ' ' ORDER BY turn, place) AS said, any_value(speaker) AS speaker FROM s GROUP BY ALL) SELECT channel, ts_ms, greatest(e, ts_ms) AS end_ms, {_one('said')} AS text, speaker FROM g WHERE {_one('said')} <> ''",
    "speaker_phrases": f"WITH {_WORDS} SELECT channel, turn AS response, CASE WHEN place % 3 > 0 THEN speaker ELSE '0' END AS speaker, string_agg(word, ' ' ORDER BY place) AS text, first(start_ms ORDER BY place) AS start_ms, last(end_ms ORDER BY place) AS end_ms FROM words GROUP BY channel, turn, CASE WHEN place % 3 > 0 THEN speaker ELSE '0' END",
    "stamp_frames": "SELECT concat('/frames/', conv_id, '/', CASE WHEN conv_id % 2 = 0 THEN printf('%06d', turn + 1) ELSE CAST(turn * 777 + 1700000000000 AS VARCHAR) END, '.jpg') AS path, CASE WHEN conv_id % 2 = 0 THEN 5000 + (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) * 10000 ELSE turn * 777 + 1700000000000 END AS ts_ms FROM conversations",
    "write_tables": f"{_EV} SELECT channel, type, count(*) AS n, max(ts_ms) AS last, CAST(sum(length(text)) AS BIGINT) AS chars FROM ev GROUP BY ALL",
    "chat_window": f"WITH {_THIRDS} SELECT channel, start, event_id, author FROM thirds WHERE type = 'chat_message'",
    "transcript_window": f"WITH {_THIRDS} SELECT channel, start, event_id, end_ms FROM thirds WHERE type = 'transcript_segment'",
    "frame_window": f"WITH {_THIRDS} SELECT channel, start, event_id, text FROM thirds WHERE type = 'frame_caption'",
    "parse_cards": "WITH c AS (SELECT concat(conv_id, '/', turn) AS channel, conv_id, turn % 4 AS k, role FROM conversations) SELECT channel, 'no cards in reply' AS parse_error, CAST(NULL AS INTEGER) AS place, CAST(NULL AS VARCHAR) AS signal_id, CAST(NULL AS VARCHAR) AS type, CAST(NULL AS VARCHAR) AS title FROM c WHERE k IN (1, 2) "
    "UNION ALL SELECT channel, NULL, 0, concat('c', conv_id), 'reaction', role FROM c WHERE k = 0 UNION ALL SELECT channel, NULL, 2, NULL, 'odd', NULL FROM c WHERE k = 0 UNION ALL SELECT channel, NULL, 3, NULL, 'none', NULL FROM c WHERE k = 0",
    "card_types_and_cap": f"{S.CARDS}, k AS (SELECT channel, lo AS win, signal_id, greatest(count(*) OVER (PARTITION BY channel, lo) - 3, 0) AS dropped, row_number() OVER (PARTITION BY channel, lo ORDER BY length(signal_id), signal_id) AS r FROM cards WHERE type <> 'none') SELECT channel, win, signal_id, dropped FROM k WHERE r <= 3",
    "mask_export": f"{S.CARDS} SELECT signal_id, '[withheld]' AS title, kind, tid AS event_id, '[withheld]' AS quote FROM cards",
    "trigger_preceding": f"{S.ATTRIBUTED} SELECT channel, win, key, p[3] AS preceding FROM near",
    "trigger_matched": f"{S.ATTRIBUTED} SELECT channel, win, key, m[3] AS matched FROM near WHERE m IS NOT NULL",
    "answered_by": f"{S.QUESTIONS}, {S._ANSWERS} SELECT channel, key, a[2] AS answer_id, a[1] AS answer_ts_ms, array_to_string(a[3], ',') AS shared FROM ans",
    "group_labels_prompt": f"{S.ATTRIBUTED}, w AS (SELECT DISTINCT r.channel, r.win, a.trigger[4] AS text FROM ranked r JOIN att a ON a.channel = r.channel AND a.win = r.win AND a.trigger[3] = r.trigger_id WHERE rank = 1), "
    "l AS (SELECT *, row_number() OVER (PARTITION BY channel, win ORDER BY count DESC, first_ts_ms, key) AS k FROM att), b AS (SELECT channel, win, string_agg(concat('key=', key, ' count=', count, ' messages: ', array_to_string(list_transform(samples [1:3], lambda x: substring(x, 1, 60)), ' | ')), chr(10) ORDER BY k) AS body FROM l WHERE k <= 16 GROUP BY ALL) "
    "SELECT channel, win, concat(CASE WHEN coalesce(text, '') <> '' THEN concat('What was happening: ', substring(text, 1, 200), chr(10), chr(10)) ELSE '' END, body) AS prompt FROM b LEFT JOIN w USING (channel, win)",
    "apply_labels": f"{S.GROUPS} SELECT channel, win, key, CASE WHEN win % 7 <> 0 THEN substring(concat('it is ', trim(regexp_replace(upper(key), '\\s+', ' ', 'g'))), 1, 90) END AS meaning FROM g_groups",
    "replay_script": f"{S.CARDS}, ch AS (SELECT channel, min(ts_ms) AS origin FROM chats GROUP BY ALL), ends AS (SELECT DISTINCT channel, win, greatest(win + 60000 - origin, 0) AS c FROM chats JOIN ch USING (channel)), "
    + S._TICKS.split("chats AS (SELECT channel, event_id, ts_ms, text FROM ev WHERE type = 'chat_message'), ", 1)[1]
    + ", ts AS (SELECT channel, tick, string_agg(concat(label, ' ', count), ',' ORDER BY rank) AS groups FROM t_top GROUP BY ALL), tb AS (SELECT *, lag(groups) OVER (PARTITION BY channel ORDER BY tick) AS before FROM ts), tc AS (SELECT channel, tick - origin AS at_ms FROM tb JOIN ch USING (channel) WHERE before IS DISTINCT FROM groups) "
    "SELECT channel, ts_ms - origin AS at_ms, 'chat' AS kind, event_id AS id, CAST(NULL AS BIGINT) AS next_close_ms FROM chats JOIN ch USING (channel) UNION ALL SELECT channel, greatest(hi - origin, 0), 'card', signal_id, NULL FROM cards JOIN ch USING (channel) UNION ALL SELECT channel, c, 'board', CAST(win AS VARCHAR), NULL FROM ends "
    "UNION ALL SELECT tc.channel, at_ms, 'tick', CAST(at_ms AS VARCHAR), min(c) FROM tc LEFT JOIN ends ON ends.channel = tc.channel AND c >= at_ms GROUP BY tc.channel, at_ms",
    "hero_lead_up": f"{S.CHECKED}, hero AS (SELECT * FROM verified WHERE has AND coalesce(quote, '') <> '' AND len(evidence) > 0 QUALIFY row_number() OVER (PARTITION BY channel ORDER BY kind <> 'frame_caption', lo, signal_id) = 1), "
    "r AS (SELECT c.channel, h.signal_id, event_id, c.text, list_contains(h.evidence, event_id) AS cited, row_number() OVER (PARTITION BY c.channel ORDER BY c.ts_ms, event_id) AS n FROM chats c JOIN hero h ON h.channel = c.channel AND c.ts_ms >= lo AND c.ts_ms < hi), s AS (SELECT *, coalesce(min(CASE WHEN cited THEN n END) OVER (PARTITION BY channel), 12) AS stop FROM r) "
    "SELECT channel, signal_id, CAST(row_number() OVER (PARTITION BY channel ORDER BY n) AS INTEGER) AS place, event_id, text, cited FROM s WHERE n <= stop AND n > stop - 12",
    "cache_misses": f"{_EV}, r AS (SELECT sha256(text) AS key, event_id, text FROM ev WHERE type = 'chat_message') SELECT key, event_id FROM r WHERE text NOT LIKE '%a'",
    "cache_counts": f"{_EV} SELECT count(*) FILTER (text LIKE '%a') AS hits, count(*) FILTER (text NOT LIKE '%a') AS misses FROM ev WHERE type = 'chat_message'",
    "fixture_provenance": f"WITH {_META} SELECT concat('f_', e.channel) AS fixture, CASE WHEN length(e.channel) % 2 = 0 THEN 'capture' ELSE 'unknown' END AS kind, string_agg(event_id, ',' ORDER BY event_id) AS cases, any_value(m.channel) AS channel, 'tables' AS provenance, length(e.channel) % 2 = 0 AS reportable FROM ev e JOIN meta m ON m.channel = e.channel WHERE type = 'frame_caption' GROUP BY e.channel",
    "available_captures": f"WITH {_META}, r AS (SELECT DISTINCT channel, CASE WHEN length(text) % 2 = 0 THEN 'baseline' ELSE 'agent' END AS system FROM ev WHERE type = 'transcript_segment' AND length(channel) % 2 = 0), s AS (SELECT channel, string_agg(system, ',' ORDER BY system) AS systems FROM r GROUP BY ALL) "
    "SELECT fixture_id, channel, '2025-01-01' AS captured_utc, duration_s, chat_messages, systems FROM meta JOIN s USING (channel) WHERE speech > 0",
    "summary_inputs": f"WITH {C._LEVELS}, k AS (SELECT *, row_number() OVER (PARTITION BY channel, window_s, k, type ORDER BY ts_ms DESC, event_id DESC) AS back FROM sl), "
    "b AS (SELECT channel, window_s, (k + 1) * window_s * 1000 AS stop, coalesce(string_agg(concat(ts_ms, ': ', author, ': ', text), chr(10) ORDER BY back DESC) FILTER (type = 'chat_message' AND back <= 500), '') AS chat, coalesce(string_agg(concat(ts_ms, '-', end_ms, ': ', text), chr(10) ORDER BY back DESC) FILTER (type = 'transcript_segment' AND back <= 100), '') AS audio, "
    "coalesce(string_agg(concat(ts_ms, ': ', text), chr(10) ORDER BY back DESC) FILTER (type = 'frame_caption' AND back <= 20), '') AS frames FROM k GROUP BY ALL), u AS (SELECT * FROM (VALUES (60, 300), (300, 1800), (1800, 7200)) AS u(window_s, up)), "
    "p AS (SELECT channel, up, CAST(ceil(end_ms / (up * 1000)) AS BIGINT) * up * 1000 AS stop, end_ms, concat(msg_count, ' and ', audio_count) AS summary, window_s FROM counts JOIN u USING (window_s)), q AS (SELECT *, row_number() OVER (PARTITION BY channel, up, stop ORDER BY end_ms DESC) AS near FROM p), "
    "r AS (SELECT channel, up AS window_s, stop, string_agg(concat(end_ms, ': ', summary), chr(10) ORDER BY end_ms) AS prev FROM q WHERE near <= least(20, greatest(1, up // window_s)) GROUP BY ALL) SELECT channel, window_s, stop AS end_ms, md5(chat) AS chat, md5(audio) AS audio, md5(frames) AS frames, coalesce(prev, '') AS prev FROM b LEFT JOIN r USING (channel, window_s, stop)",
    "interim_replacement": f"{_EV}, s AS (SELECT *, length(event_id) % 2 = 0 AS fin FROM ev WHERE type = 'transcript_segment') SELECT channel, event_id, fin AS final FROM s WHERE fin OR NOT EXISTS (SELECT 1 FROM s l WHERE l.channel = s.channel AND l.ts_ms > s.ts_ms AND s.ts_ms > l.ts_ms - 2000 AND s.end_ms < l.end_ms + 2000)",
    "trajectory_counts": f"{_RUNS}, n AS (SELECT agent, conv_id, count(*) FILTER (kind = 'tool') AS tools, count(*) FILTER (kind = 'model') AS models, count(*) FILTER (kind = 'gate' AND ok) AS good, count(*) FILTER (kind = 'gate' AND NOT ok) AS bad FROM r GROUP BY ALL) SELECT agent, count(*) AS runs, CAST(sum(tools) AS BIGINT) AS tool_calls, CAST(sum(models) AS BIGINT) AS model_calls, CAST(sum(good) AS BIGINT) AS gate_ok, CAST(sum(bad) AS BIGINT) AS gate_rejected FROM n GROUP BY ALL",
    "tool_calls": f"{_RUNS}, t AS (SELECT agent, conv_id, concat('t', turn % 3) AS tool FROM r WHERE kind = 'tool'), n AS (SELECT agent, conv_id, count(*) AS calls FROM r WHERE kind = 'tool' GROUP BY ALL) SELECT agent, 'tool' AS what, tool AS value, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT agent, 'calls', CAST(coalesce(calls, 0) AS VARCHAR), count(*) FROM (SELECT DISTINCT agent, conv_id FROM r) LEFT JOIN n USING (agent, conv_id) GROUP BY ALL",
    "usage_ledger": "SELECT concat('m', conv_id % 3) AS model, CASE WHEN turn % 2 = 0 THEN 'p' END AS provider, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS prompt_tokens, CAST(sum(turn) AS BIGINT) AS completion_tokens FROM conversations GROUP BY ALL",
    "union_emitted": f"{S.CHECKED} SELECT channel, signal_id, status, CAST(row_number() OVER (PARTITION BY channel ORDER BY signal_id) AS INTEGER) AS place FROM checked",
    "evidence_intersection": f"{_CASES} SELECT g.case_id, 'x' AS system, c.signal_id, g.gold_no, len(list_intersect(c.evidence [2:10], g.evidence)) AS overlap FROM cards c JOIN gold g ON g.case_id = concat(c.channel, '/', c.lo) AND g.type = c.type WHERE len(list_intersect(c.evidence [2:10], g.evidence)) > 0",
    "draft_action": f"{S.CHECKED} SELECT channel, signal_id, 'draft_poll' AS kind, 'pending_approval' AS state FROM verified WHERE type = 'audience_answer' AND len(samples) > 0",
    "score_arms": f"{S.GROUPS}, labels_of AS (SELECT channel, win, event_id, substring(lower(text), 1, 2) AS intent FROM chats WHERE length(text) % 5 <> 0), exact AS (SELECT channel, win, event_id, CASE WHEN canon <> '' THEN canon ELSE concat('~', event_id) END AS key FROM chats JOIN canon_of USING (text)) SELECT * FROM {_scored('exact', 'exact')} UNION ALL SELECT * FROM {_scored('token_prefix', 'g_assigned')}",
    "arm_embeddings": "WITH RECURSIVE v AS (SELECT vec_id // 50 AS win, vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), e AS (SELECT a.win, a.id AS a, b.id AS b, list_cosine_similarity(a.x, b.x) AS c FROM v a JOIN v b ON a.win = b.win AND a.id <> b.id), t AS (SELECT unnest([" + ", ".join(str(round(100 * c)) for c in fixed.COSINES) + "]) AS percent), "
    "reach AS (SELECT percent, win, id, id AS seen FROM v, t UNION SELECT r.percent, r.win, r.id, e.b FROM reach r JOIN e ON e.win = r.win AND e.a = r.seen AND e.c >= r.percent / 100.0) SELECT CAST(percent AS INTEGER) AS percent, win, id, min(seen) AS key FROM reach GROUP BY ALL",
    "rolling_context": f"{_EV}, t AS (SELECT *, CAST(ceil(ts_ms / 120000) AS BIGINT) * 120000 AS tick FROM ev WHERE type <> 'chat_message'), g AS (SELECT channel, tick, string_agg(text, chr(10) ORDER BY ts_ms, event_id) FILTER (type = 'transcript_segment') AS speech_sum, string_agg(text, chr(10) ORDER BY ts_ms, event_id) FILTER (type = 'frame_caption') AS frames_sum FROM t GROUP BY ALL HAVING count(DISTINCT type) = 2) "
    "SELECT channel, tick, coalesce(lag(tick) OVER (PARTITION BY channel ORDER BY tick) > tick - 300000, false) AS continues, speech_sum, frames_sum FROM g",
    "speech_context": f"WITH {C._RANKED}, sp AS (SELECT channel, batch, min(ts_ms) AS lo, max(ts_ms) AS hi FROM batches GROUP BY ALL), l AS (SELECT sp.channel, sp.batch, e.ts_ms, 'speech' AS kind, e.event_id, e.text FROM sp JOIN ev e ON e.channel = sp.channel AND e.type = 'transcript_segment' AND e.ts_ms BETWEEN lo - 45000 AND hi UNION ALL SELECT channel, batch, ts_ms, 'chat', event_id, text FROM batches) "
    "SELECT channel, batch, count(*) FILTER (kind = 'speech') AS speech, string_agg(concat(kind, ': ', text), chr(10) ORDER BY ts_ms, kind, event_id) AS lines FROM l GROUP BY ALL",
    "poll_drafts": f"{S.CHECKED}, {S._VOTES.format(cards='verified WHERE type = ' + repr('audience_answer'))}, k AS (SELECT *, CASE WHEN length({_one('label')}) > 25 THEN concat(rtrim(substring({_one('label')}, 1, 24)), '…') ELSE {_one('label')} END AS short FROM shares WHERE options >= 2), "
    "p AS (SELECT channel, signal_id, string_agg(concat(short, '=', round_even(votes / total, 3)), chr(10) ORDER BY rank) FILTER (rank <= 5) AS options, any_value(total) AS total_votes, coalesce(string_agg(label, ', ' ORDER BY rank) FILTER (rank > 5), '') AS dropped, count(*) FILTER (rank <= 5 AND short <> label) AS shortened FROM k GROUP BY ALL), "
    f"a AS (SELECT channel, signal_id, title, CASE WHEN has AND coalesce(quote, '') <> '' THEN quote END AS source FROM verified WHERE type = 'audience_answer'), x AS (SELECT *, {_one('coalesce(source, nullif(title, ' + repr('') + '), ' + repr('Chat, which one?') + ')')} AS line FROM a JOIN p USING (channel, signal_id)) "
    "SELECT channel, signal_id, CASE WHEN length(line) > 60 THEN concat(rtrim(substring(line, 1, 59)), '…') ELSE line END AS question, total_votes, array_to_string(list_filter([CASE WHEN dropped <> '' THEN concat('options left out: ', dropped) END, CASE WHEN shortened > 0 THEN 'options shortened' END, CASE WHEN source IS NULL THEN 'the question is the card''s title' END], lambda w: w IS NOT NULL), '; ') AS warnings FROM x",
    "gold_selfcheck": f"{_CASES}, unquoted AS (SELECT * REPLACE (false AS misquoted) FROM rules), g2 AS ({S._checked(True).replace('FROM rules', 'FROM unquoted')}) SELECT gold.case_id, gold_no, len(violations) = 0 AS ok, array_to_string(violations, ',') AS violations, coalesce(ttype = 'chat_message', false) AS trigger_is_chat FROM g2 JOIN gold USING (signal_id)",
    "score_cases": f"{_MATCHED} SELECT * FROM scored",
    "score_systems": f"{_MATCHED} SELECT system, count(*) AS cases, CAST(sum(n_cards) AS BIGINT) AS cards, sum(trigger_correct) / nullif(sum(trigger_scored), 0) AS trigger_accuracy, sum(unmatched) / nullif(sum(n_cards), 0) AS unmatched_rate, sum(unsupported) / nullif(sum(n_cards), 0) AS unsupported_rate, sum(recall_hits) / nullif(sum(n_gold), 0) AS signal_recall, count(*) FILTER (abstain_correct) AS abstention_correct, count(*) FILTER (must_abstain) AS abstention_cases FROM scored GROUP BY ALL",
}
