"""Raw inputs to rows: tagged chat lines, speech responses, screen captions, users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import numbered, ranged, scanned

SEGMENT_GAP_MS, CAPTION_CHARS = 1500, 500
_SPACE = r"(?U)\s+"


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " "))


def parse_irc(lines: DataFrame) -> DataFrame:
    """Tagged chat lines (column value) as messages; lines without id, time or body are dropped.

    A tag given twice takes its last value; a tag without `=` rejects the line.
    """
    parts = lines.where(F.col("value").startswith("@") & F.col("value").contains("PRIVMSG")).select(
        F.filter(F.split(F.regexp_extract("value", r"^@(\S*) ", 1), ";"), lambda t: t != "").alias("tags"),
        F.regexp_extract("value", r"(?s)^@\S* :([^:]*):(.*)$", 1).alias("head"),
        F.regexp_replace(F.regexp_extract("value", r"(?s)^@\S* :([^:]*):(.*)$", 2), r"[\r\n]+$", "").alias("text"),
    )
    parts = parts.where((F.col("head") != "") & F.forall("tags", lambda t: t.contains("=")))

    def tag(name: str) -> Column:
        last = F.try_element_at(F.filter("tags", lambda t: t.startswith(name + "=")), F.lit(-1))
        value = F.substring(last, len(name) + 2, 1_000_000)
        return F.when(value != "", value)

    rows = parts.select(
        tag("id").alias("event_id"), tag("tmi-sent-ts").try_cast("long").alias("ts_ms"), F.lower(F.coalesce(tag("display-name"), F.lit(""))).alias("login"), "text",
        F.coalesce(tag("user-type"), F.lit("")).alias("user_type"), tag("room-id").alias("room_id"), tag("reply-parent-msg-id").alias("reply_to"),
    )
    return rows.where("event_id is not null and ts_ms is not null")


def dedupe_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row, by order, of those with equal keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def words_to_segments(words: DataFrame, gap_ms: int = SEGMENT_GAP_MS, by: tuple[str, ...] = ("channel",)) -> DataFrame:
    """Words (channel, pos, start_ms, end_ms, speaker, word) merged while the speaker stays and the pause is short.

    `by` may hold more columns than channel: words of unlike ones are never merged. A channel's
    words are scanned in ranges, so none needs to fit a task; one segment's words do.
    """
    keys = list(by)
    before = scanned(ranged(words, keys, ["pos"]), keys, befores={"before": F.struct("speaker", "end_ms")})
    same = F.col("before.speaker").eqNullSafe(F.col("speaker")) & (F.col("start_ms") - F.col("before.end_ms") <= gap_ms)
    fresh = before.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).drop("before")
    rows = scanned(fresh, keys, sums={"segment": F.col("new")})
    ordered = F.array_sort(F.collect_list(F.struct("pos", "end_ms", "word")))
    found = rows.groupBy(*keys, "segment").agg(F.min("start_ms").alias("ts_ms"), ordered.alias("said"), F.first("speaker").alias("speaker"))
    text = collapsed(F.array_join(F.transform("said", lambda x: x["word"]), " "))
    return found.select(*keys, "ts_ms", F.greatest(F.element_at("said", -1)["end_ms"], F.col("ts_ms")).alias("end_ms"), text.alias("text"), "speaker").where("text <> ''")


def speaker_phrases(words: DataFrame) -> DataFrame:
    """One phrase for each speaker of a response; a missing speaker is speaker 0."""
    rows = words.withColumn("speaker", F.coalesce("speaker", F.lit("0")))
    found = rows.groupBy("channel", "response", "speaker").agg(F.array_sort(F.collect_list(F.struct("pos", "start_ms", "end_ms", "word"))).alias("said"))
    return found.select(
        "channel", "response", "speaker", F.array_join(F.transform("said", lambda x: x["word"]), " ").alias("text"),
        F.element_at("said", 1)["start_ms"].alias("start_ms"), F.element_at("said", -1)["end_ms"].alias("end_ms"),
    )


RESPONSE = (
    "results struct<utterances: array<struct<start: double, end: double, transcript: string, speaker: string>>, "
    "channels: array<struct<alternatives: array<struct<words: array<struct<word: string, punctuated_word: string, start: double, end: double, speaker: string>>>>>>>"
)


def stt_segments(responses: DataFrame) -> DataFrame:
    """Speech responses (channel, start_ms, json) as segments: utterances if any, else words merged; `speaker` is spk_N.

    Words are merged within their response alone; pauses are compared in seconds as given,
    and times cut to whole milliseconds at the end. Equal responses count as many.
    """
    own = responses.select("channel", "start_ms", F.monotonically_increasing_id().alias("response"), F.from_json("json", RESPONSE)["results"].alias("r"))
    parsed = own.withColumn("u", F.coalesce(F.col("r.utterances"), F.array().cast("array<struct<start: double, end: double, transcript: string, speaker: string>>")))

    def ms(seconds: Column) -> Column:
        return F.coalesce(seconds, F.lit(0.0)) * 1000

    def row(rows: DataFrame) -> DataFrame:
        start, end = (F.col("start_ms") + F.col(c).cast("long") for c in ("from", "to"))
        number = F.concat(F.lit("spk_"), F.col("speaker").cast("double").cast("long").cast("string"))
        return rows.select("channel", start.alias("ts_ms"), F.greatest(end, start).alias("end_ms"), "text", number.alias("speaker")).where("text <> ''")

    spoken = parsed.select("channel", "start_ms", F.explode("u").alias("x"))
    whole = spoken.select("channel", "start_ms", ms(F.col("x.start")).alias("from"), ms(F.coalesce("x.end", "x.start")).alias("to"), collapsed(F.col("x.transcript")).alias("text"), "x.speaker")
    first = F.get(F.get(F.col("r.channels"), F.lit(0))["alternatives"], F.lit(0))["words"]
    bare = parsed.where(F.size("u") == 0).select("channel", F.col("start_ms").alias("base"), "response", F.posexplode(first).alias("pos", "x"))
    words = bare.select("channel", "base", "response", "pos", ms(F.col("x.start")).alias("start_ms"), ms(F.coalesce("x.end", "x.start")).alias("end_ms"), "x.speaker", F.coalesce("x.punctuated_word", "x.word", F.lit("")).alias("word"))
    merged = words_to_segments(words, by=("channel", "base", "response")).withColumnsRenamed({"base": "start_ms", "ts_ms": "from", "end_ms": "to"})
    return row(whole).unionByName(row(merged))


def clean_caption(text: Column, n: int = CAPTION_CHARS) -> Column:
    """White space collapsed, cut at n characters; null when nothing is left."""
    t = F.substring(collapsed(text), 1, n)
    return F.when(t != "", t)


def clean_caption_legacy(text: Column, n: int = CAPTION_CHARS) -> Column:
    """Without its opening formula, cut at a word with an ellipsis; null for counters such as 3/10."""
    t = F.trim(F.regexp_replace(collapsed(text), r"(?i)^(?:the|this) (?:image|frame|screenshot) shows:?\s*", ""))
    cut = F.regexp_replace(F.substring(t, 1, n - 1), r"\s+\S*$", "")
    return F.when((t != "") & ~t.rlike(r"^\d+\s*/\s*\d+$"), F.when(F.length(t) > n, F.concat(cut, F.lit("…"))).otherwise(t))


def stamp_frames(files: DataFrame, start_ms: int, interval_s: int) -> DataFrame:
    """ts_ms of frame files (path): numbered ones by their place in number order, stamped ones by their name."""
    name = F.regexp_extract("path", r"(\d+)\.jpg$", 1)
    rows = files.withColumn("name", name).where("name <> ''").withColumn("numbered", F.length("name") == 6)
    place = F.row_number().over(Window.partitionBy("folder", "numbered").orderBy("name")) - 1
    rows = rows.withColumn("folder", F.regexp_replace("path", r"[^/]*$", ""))
    return rows.withColumn("ts_ms", F.when(F.col("numbered"), F.lit(start_ms) + place * (interval_s * 1000)).otherwise(F.col("name").cast("long"))).select("path", "ts_ms")


def user_dimension(logins: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """user_id and login: known (user_id, login) as they are, and the new lower-cased logins numbered on from the greatest known id.

    New logins are numbered by range (scan.numbered): ids are dense, unique however many tasks
    give them, and the same when a task runs again; a second run over its own result adds none.
    """
    new = logins.select(F.lower("login").alias("login")).where("login is not null").distinct()
    if known is not None:
        new = new.join(known.select("login"), "login", "left_anti")
    first = known.agg(F.coalesce(F.max("user_id"), F.lit(0))).first()[0] if known is not None else 0
    fresh = numbered(new, [], ["login"], "user_id").select((F.col("user_id") + first).cast("long").alias("user_id"), "login")
    return known.select(F.col("user_id").cast("long"), "login").unionByName(fresh) if known is not None else fresh


def write_tables(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Rows as JSON lines, CSV or Parquet in folders by channel."""
    rows.write.mode("overwrite").partitionBy("channel").format(kind).save(path)
