"""Cards, claims about a window: parsed, held against the events (the gate), rolled up.

A card: channel, signal_id, type, title, window_ms array<long>, trigger struct<kind,
event_id, quote>, evidence array<string>, distribution map<string, double>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import SECTIONS, THEME_STOPWORDS
from ..plans.store import stored
from ..sources.events import CHAT

TYPES = ("audience_answer", "reaction", "unanswered_question", "warning", "none")
GATES = ("strict-v1", "reaction-v2")
UNKNOWN, MAX_CARDS, MIN_QUOTE = "unknown", 3, 0.6
CARD = "signal_id string, type string, title string, window_ms array<bigint>, trigger struct<kind: string, event_id: string, quote: string>, evidence array<string>, distribution map<string, double>"
KEY = ["channel", "signal_id"]


def parse_cards(replies: DataFrame) -> DataFrame:
    """Replies (channel, reply) as cards with `place`; a reply that is no JSON object with cards has one row with parse_error.

    Elements that are no object are left out, good ones beside them stay; a field of another
    type than CARD's is null.
    """
    parsed = replies.withColumn("c", F.get_json_object("reply", "$.cards"))
    parsed = parsed.withColumn("r", F.from_json("c", "array<string>"))
    bad = ~F.coalesce(F.ltrim("c").startswith("["), F.lit(False)) | F.col("r").isNull()
    rows = parsed.withColumn("parse_error", F.when(bad, "no cards in reply")).select("channel", "parse_error", F.posexplode_outer(F.when(~bad, F.col("r"))).alias("place", "element"))
    rows = rows.withColumn("card", F.from_json("element", CARD)).where(F.col("parse_error").isNotNull() | F.coalesce(F.ltrim("element").startswith("{"), F.lit(False)))
    return rows.select("channel", "parse_error", "place", "card.*")


def capped(cards: DataFrame, scope: list[str], n: int = MAX_CARDS) -> DataFrame:
    """The first n cards of known type of each scope by `place`; `dropped` counts the others of known type. A card needs no signal_id."""
    known = cards.where(F.col("type").isin(*TYPES))
    w = Window.partitionBy(*scope)
    ranked = known.withColumn("_k", F.row_number().over(w.orderBy("place", "signal_id"))).withColumn("dropped", F.greatest(F.lit(0), F.count("*").over(w) - n))
    return ranked.where(F.col("_k") <= n).drop("_k")


def _trigger_id() -> Column:
    t = F.col("trigger.event_id")
    return F.when((t != "") & (t != UNKNOWN), t)


def check_cards(cards: DataFrame, events: DataFrame, version: str = "reaction-v2") -> DataFrame:
    """cards with ok and violations (codes in the order of the checks, one for each bad id).

    Only cited events are looked up, once for each different list of citations: so a card
    needs no signal_id, and cards that share one are told apart by what they cite. Of events
    with one id the least (type, time, text) counts; a null channel is a channel. Events are
    shuffled without their texts; those of triggers are read by the stored, few ids of these.
    """
    if version not in GATES:
        raise ValueError(f"unknown gate: {version}")
    known = events.select(F.col("channel").alias("of"), F.col("event_id").alias("known"), F.struct("type", "ts_ms").alias("event"))
    cards = cards.withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>"))).withColumn("tid", _trigger_id())
    cards = cards.withColumn("_cites", F.md5(F.to_json(F.struct("channel", "evidence", "tid"))))
    lists = cards.dropDuplicates(["_cites"]).select("_cites", "channel", F.posexplode(F.concat("evidence", F.array("tid"))).alias("place", "id"))
    cited = lists.join(known, lists["channel"].eqNullSafe(known["of"]) & (lists["id"] == known["known"]), "left").groupBy("_cites", "place", "id").agg(F.min("event").alias("event"))
    found = cited.groupBy("_cites").agg(F.array_sort(F.collect_list(F.struct("place", "id", "event"))).alias("cited"))
    rows = cards.join(found, "_cites", "left").drop("_cites")
    n = F.size("evidence")
    tids = stored(cards.where("tid is not null").select(F.col("channel").alias("of"), F.col("tid").alias("known")).distinct(), "triggers")
    said = events.join(tids, events["channel"].eqNullSafe(tids["of"]) & (events["event_id"] == tids["known"])).groupBy("of", "known").agg(F.min(F.struct("type", "ts_ms", "text")).alias("trigger_event"))
    rows = rows.join(said, rows["channel"].eqNullSafe(said["of"]) & (rows["tid"] == said["known"]), "left").drop("of", "known")
    rows = rows.withColumn("cited", F.slice("cited", F.lit(1), F.greatest(n, F.lit(0))))

    lo, hi = F.get("window_ms", F.lit(0)), F.get("window_ms", F.lit(1))

    def of_citation(c: Column) -> Column:
        at = c["event"]["ts_ms"]
        return F.when(c["event"].isNull(), "E_UNKNOWN_MSG").when(c["event"]["type"] != CHAT, "E_EVIDENCE_NOT_A_MESSAGE").when(lo.isNotNull() & ((at < lo) | (at >= hi)), "E_MSG_OUT_WINDOW")

    tev = F.col("trigger_event")
    chats = F.filter("cited", lambda c: F.coalesce(c["event"]["type"] == CHAT, F.lit(False)))
    earliest = F.array_min(F.transform(chats, lambda c: c["event"]["ts_ms"]))
    others = F.filter("cited", lambda c: c["id"] != F.col("tid"))
    later = F.forall(others, lambda c: F.coalesce((c["event"]["type"] == CHAT) & (c["event"]["ts_ms"] > tev["ts_ms"]), F.lit(False)))
    excused = F.lit(version != "strict-v1") & (F.col("type") == "reaction") & F.coalesce(tev["type"] == CHAT, F.lit(False)) & (F.size(others) > 0) & later
    rows = rows.withColumn("_quote", T.normalize_quote(F.col("trigger.quote"))).withColumn("_text", T.normalize_quote(tev["text"]))
    quote = (F.col("_quote") != "") & ~F.col("_text").contains(F.col("_quote")) & (T.token_overlap(F.col("_quote"), F.col("_text")) < MIN_QUOTE)
    has = F.col("tid").isNotNull()
    claims = F.concat(
        F.array(F.when(n == 0, "E_NO_EVIDENCE")), F.transform("cited", of_citation),
        F.array(
            F.when(has & F.array_contains("evidence", F.col("tid")) & ~excused, "E_CIRCULAR_EVIDENCE"), F.when(has & tev.isNull(), "E_UNKNOWN_TRIGGER"),
            F.when(has & (tev["ts_ms"] > earliest), "E_TRIGGER_LATE"), F.when(has & tev.isNotNull() & quote, "E_QUOTE_MISMATCH"),
        ),
    )
    abstains = F.array(F.when(n > 0, "E_NONE_WITH_EVIDENCE"), F.when(has, "E_NONE_WITH_TRIGGER"))
    rows = rows.withColumn("violations", F.array_compact(F.when(F.col("type") == "none", abstains).otherwise(claims)))
    ok = F.size("violations") == 0
    status = F.when(~ok, "rejected").when(F.col("type") == "none", "abstained").otherwise("verified")
    action = F.when(ok & (F.col("type") == "audience_answer") & (F.size(F.coalesce(F.map_keys("distribution"), F.array().cast("array<string>"))) > 0), F.struct(F.lit("draft_poll").alias("kind"), F.lit("pending_approval").alias("state")))
    return rows.withColumns({"ok": ok, "status": status, "action": action}).drop("cited", "_quote", "_text", "tid")


def gate_ledger(checked: DataFrame) -> DataFrame:
    """Verified, abstained and rejected cards of each window (of its start), and violations by code."""
    rows = checked.withColumn("win", F.get("window_ms", F.lit(0)))
    counts = rows.groupBy("channel", "win").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("verified", "abstained", "rejected")], F.avg((~F.col("ok")).cast("int")).alias("unsupported_rate"))
    codes = rows.select("channel", "win", F.explode("violations").alias("code")).groupBy("channel", "win", "code").agg(F.count("*").alias("n"))
    codes = codes.groupBy(F.col("channel").alias("c"), F.col("win").alias("w")).agg(F.array_sort(F.collect_list(F.struct("code", "n"))).alias("codes"))
    return counts.join(codes, F.col("channel").eqNullSafe(F.col("c")) & F.col("win").eqNullSafe(F.col("w")), "left").drop("c", "w")


def gate_rescore(cards: DataFrame, events: DataFrame) -> DataFrame:
    """Cards whose decision differs between the two versions of the gate; equal cards are decided once and count as many."""
    rows = cards.withColumn("_row", F.md5(F.to_json(F.struct(*cards.columns))))
    each = rows.dropDuplicates(["_row"])
    old, new = (check_cards(each, events, v).select("_row", F.col("ok").alias(v.split("-")[0])) for v in GATES)
    return rows.select(*KEY, "_row").join(old.join(new, "_row").where("strict <> reaction"), "_row").drop("_row")


def grounded(checked: DataFrame) -> DataFrame:
    """Passing cards with a known trigger, a quote and evidence."""
    return checked.where(F.col("ok") & (F.col("type") != "none") & _trigger_id().isNotNull() & (F.coalesce("trigger.quote", F.lit("")) != "") & (F.size("evidence") > 0))


def cited_events(cards: DataFrame, events: DataFrame, n: int = 6) -> DataFrame:
    """The first n ids that a card cites (evidence, then trigger), each with its event or null text."""
    ids = F.slice(F.array_compact(F.concat(F.coalesce("evidence", F.array().cast("array<string>")), F.array(_trigger_id()))), 1, n)
    cited = cards.select(*KEY, F.posexplode(ids).alias("place", "event_id"))
    return cited.join(events.select("channel", "event_id", F.col("type").alias("event_type"), "ts_ms", "text"), ["channel", "event_id"], "left")


def debrief_sections(verified: DataFrame, events: DataFrame) -> DataFrame:
    """Cards filed by type in the order of their time, with its timecode; ts_source says whether that is the trigger's or the window's start."""
    times = events.select("channel", F.col("event_id").alias("tid"), F.col("ts_ms").alias("at"))
    start = events.groupBy("channel").agg(F.min("ts_ms").alias("origin"))
    rows = verified.where("type <> 'none'").withColumn("tid", _trigger_id()).join(times, ["channel", "tid"], "left").join(start, "channel", "left")
    rows = rows.withColumn("ts_ms", F.coalesce("at", F.get("window_ms", F.lit(0))))
    source = F.when(F.col("at").isNotNull(), "trigger").when(F.col("ts_ms").isNotNull(), "window").otherwise("none")
    place = F.row_number().over(Window.partitionBy("channel", "type").orderBy(F.coalesce("ts_ms", F.lit(0)), "signal_id"))
    return rows.select(
        *KEY, "type", place.alias("place"), "ts_ms", source.alias("ts_source"), T.timecode(F.col("ts_ms") - F.col("origin")).alias("timecode"), F.size("evidence").alias("cited"), F.col("tid").alias("trigger_id"),
        "title", F.col("trigger.kind").alias("kind"), F.col("trigger.quote").alias("quote"), F.slice("evidence", 1, 6).alias("ids"), "distribution",
    )


def clip_candidates(sections: DataFrame, n: int = 5) -> DataFrame:
    """Cards with a known trigger by how much they cite; the first n of each channel."""
    w = Window.partitionBy("channel").orderBy(F.desc("cited"), "ts_ms", "signal_id")
    return sections.where("trigger_id is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def recurring_themes(verified: DataFrame, stopwords: list[str] = THEME_STOPWORDS, min_cards: int = 2) -> DataFrame:
    """Words of quotes and answers that two or more cards carry; titles do not count."""
    said = F.concat(F.array(F.coalesce("trigger.quote", F.lit(""))), F.coalesce(F.map_keys("distribution"), F.array().cast("array<string>")))
    words = verified.select(*KEY, F.explode(said).alias("said")).select(*KEY, F.explode(T.words(T.normalize_quote(F.col("said")))).alias("term"))
    words = words.where((F.length("term") >= 3) & ~F.col("term").rlike(r"(?U)^\d+$") & ~F.col("term").isin(stopwords)).distinct()
    return words.groupBy("channel", "term").agg(F.count("*").alias("cards"), F.array_sort(F.collect_list("signal_id")).alias("signal_ids")).where(F.col("cards") >= min_cards)


def debrief_markdown(sections: DataFrame, themes: DataFrame, channels: DataFrame) -> DataFrame:
    """One document for each of channels (channel): every section under its title, empty ones too, or that nothing was verified."""
    votes = F.map_entries(F.coalesce("distribution", F.create_map().cast("map<string, double>")))
    total = F.aggregate(votes, F.lit(0.0), lambda n, v: n + F.coalesce(v["value"], F.lit(0.0)))
    shares = F.array_join(F.transform(F.array_sort(votes), lambda v: F.concat(F.lit("**"), v["key"], F.lit("** "), F.format_string("%.0f", v["value"]), F.when(total != 0, F.format_string(" (%.0f%%)", 100 * v["value"] / total)).otherwise(""))), " · ")
    cause = F.when(F.col("trigger_id").isNull(), "- Cause: **not established**").otherwise(F.concat(F.lit("- Cause ("), F.coalesce("kind", F.lit("event")), F.lit(" `"), "trigger_id", F.lit("`): "), F.when(F.coalesce("quote", F.lit("")) != "", F.concat(F.lit("“"), "quote", F.lit("”"))).otherwise("—")))
    ids = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("`"), i, F.lit("`"))), ", ")
    entry = F.array_join(
        F.array_compact(F.array(
            F.concat(F.lit("### `"), F.coalesce("timecode", F.lit("--:--:--")), F.lit("` "), F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("type")), F.when(F.col("ts_source") == "window", " *(window start)*").otherwise("")),
            F.when(F.size(votes) > 0, F.concat(F.lit("- "), shares)), cause, F.concat(F.lit("- Evidence: "), F.col("cited").cast("string"), F.lit(" messages ("), ids, F.when(F.col("cited") > 6, ", …").otherwise(""), F.lit(")")),
        )), "\n",
    )
    entries = sections.select("channel", "type", "place", entry.alias("line")).unionByName(clip_candidates(sections).select("channel", F.lit("clip").alias("type"), F.col("rank").alias("place"), entry.alias("line")))
    row = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("cards"), "term"))
    entries = entries.unionByName(themes.select("channel", F.lit("theme").alias("type"), row.alias("place"), F.concat(F.lit("| "), "term", F.lit(" | "), F.col("cards").cast("string"), F.lit(" |")).alias("line")))
    texts = entries.groupBy("channel", "type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    titles = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("type"), F.lit(title).alias("heading")) for k, (t, title) in enumerate(SECTIONS)]))
    parts = channels.select("channel", titles.alias("t")).select("channel", "t.*").join(texts, ["channel", "type"], "left")
    part = F.concat(F.lit("## "), "heading", F.lit("\n"), F.coalesce("lines", F.lit("_Nothing in this run._")))
    bodies = parts.groupBy("channel").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("body"))
    counts = sections.groupBy("channel").agg(F.count("*").alias("verified_cards"))
    found = bodies.join(counts, "channel", "left").fillna(0, ["verified_cards"])
    body = F.when(F.col("verified_cards") > 0, F.concat(F.col("verified_cards").cast("string"), F.lit(" verified signals\n\n"), "body")).otherwise("## No verified signals")
    return found.select("channel", "verified_cards", F.concat(F.lit("# Post-stream debrief: "), "channel", F.lit("\n\n"), body).alias("document"))


def distribution_shares(cards: DataFrame) -> DataFrame:
    """Answers of each card with votes and their share of all votes, most first."""
    rows = cards.select(*KEY, F.explode("distribution").alias("label", "votes")).where("votes > 0")
    w = Window.partitionBy(*KEY)
    return rows.withColumn("total", F.sum("votes").over(w)).withColumn("options", F.count("*").over(w)).withColumn("share", F.bround(F.col("votes") / F.col("total"), 3)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("votes"), "label")))


def poll_drafts(verified: DataFrame, max_options: int = 5, option_chars: int = 25, question_chars: int = 60) -> DataFrame:
    """Verified answers with two or more options as polls; shares are over all votes, trims are warned of."""
    answers = verified.where("type = 'audience_answer'")
    ranked = distribution_shares(answers).where("options >= 2").withColumn("short", T.truncated(F.col("label"), option_chars))
    kept = F.col("rank") <= max_options
    options = F.array_sort(F.collect_list(F.when(kept, F.struct("rank", F.col("short").alias("label"), "votes", "share"))))
    dropped = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~kept, F.struct("rank", "label")))), lambda x: x["label"]), ", ")
    polls = ranked.groupBy(*KEY).agg(options.alias("options"), F.first("total").alias("total_votes"), dropped.alias("dropped"), F.count_if(kept & (F.col("short") != F.col("label"))).alias("shortened"))
    source = F.when(_trigger_id().isNotNull() & (F.coalesce("trigger.quote", F.lit("")) != ""), F.col("trigger.quote"))
    rows = answers.select(*KEY, source.alias("source"), "title").join(polls, KEY)
    warnings = F.array_compact(F.array(F.when(F.col("dropped") != "", F.concat(F.lit("options left out: "), "dropped")), F.when(F.col("shortened") > 0, "options shortened"), F.when(F.col("source").isNull(), "the question is the card's title")))
    return rows.select(*KEY, T.truncated(F.coalesce("source", F.when(F.col("title") != "", F.col("title")), F.lit("Chat, which one?")), question_chars).alias("question"), "options", "total_votes", warnings.alias("warnings"))


WITHHELD = ("text", "title", "quote", "detail", "distribution")


def mask_export(rows: DataFrame) -> DataFrame:
    """Without authors, with texts withheld; those inside structs too."""

    def masked(field, column: Column) -> Column | None:
        if field.name in ("author", "login", "trace_path"):
            return None
        if field.name in WITHHELD:
            return F.lit("[withheld]").alias(field.name)
        if field.dataType.typeName() == "struct":
            inner = [c for f in field.dataType if (c := masked(f, column[f.name])) is not None]
            return F.when(column.isNotNull(), F.struct(*inner)).alias(field.name)
        return column.alias(field.name)

    return rows.select(*[c for f in rows.schema if (c := masked(f, F.col(f"`{f.name}`"))) is not None])


def cards_of_groups(attributed: DataFrame) -> DataFrame:
    """Groups with a trigger, as cards: their samples are the answers, their first message and trigger are cited."""
    kind = F.when(F.col("key").startswith("∎"), "reaction").otherwise("audience_answer")
    signal = F.concat_ws("/", "channel", F.col("win").cast("string"), "key")
    shares = F.map_from_arrays(F.array_distinct("samples"), F.transform(F.array_distinct("samples"), lambda x, i: F.col("count").cast("double") / (i + 1)))
    return attributed.select("channel", signal.alias("signal_id"), kind.alias("type"), F.col("label").alias("title"), F.array(F.col("win"), F.col("win") + 60_000).alias("window_ms"), F.struct(F.col("trigger.type").alias("kind"), F.coalesce("trigger.event_id", F.lit(UNKNOWN)).alias("event_id"), F.substring("trigger.text", 1, 40).alias("quote")).alias("trigger"), "evidence", shares.alias("distribution"))
