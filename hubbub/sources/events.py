"""The events table: one row for each chat message, speech segment and screen caption.

channel, event_id, type, ts_ms, end_ms, author, text, final. Sources: capture folders of
JSON lines, and the test tables (documents and conversations) seen as broadcasts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

CHAT, SPEECH, FRAME = "chat_message", "transcript_segment", "frame_caption"
COLUMNS = ("channel", "event_id", "type", "ts_ms", "end_ms", "author", "text", "final")
_FEEDS = (
    ("chat", "msg", CHAT, "id string, ts_ms long, author string, text string, user_type string"),
    ("transcript", "tr", SPEECH, "id string, ts_ms long, end_ms long, text string, speaker string, final boolean"),
    ("frames", "frm", FRAME, "id string, ts_ms long, caption string, frame string"),
)


def read_captures(spark: SparkSession, root: str, pattern: str = "{name}.jsonl") -> DataFrame:
    """Feeds under root/<channel>/; a feed that no channel has gives no rows; missing ids come from content.

    The pattern of file names, and root, may hold the feed's {name}. `meta` holds a chat line's other fields by name, nested ones as JSON text (null for other
    feeds); a field that is null is left out.
    """
    out = None
    for name, prefix, kind, schema in _FEEDS:
        # a filter by name instead of a glob: it may match no file
        lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern.replace("{name}", name)).text(root.replace("{name}", name))
        fields = F.from_json("value", "map<string,string>") if kind == CHAT else F.lit(None).cast("map<string,string>")
        extra = F.map_filter(fields, lambda k, v: ~k.isin("id", "ts_ms", "text", "author") & v.isNotNull())
        rows = lines.select(F.from_json("value", schema).alias("r"), extra.alias("meta"), F.col("_metadata.file_path").alias("path")).select("r.*", "meta", "path")
        text = F.coalesce(F.col("caption" if kind == FRAME else "text"), F.lit(""))
        rows = rows.where("ts_ms is not null").select(
            F.element_at(F.split("path", "/"), -2).alias("channel"),
            F.coalesce("id", T.event_id(prefix, F.col("ts_ms"), text)).alias("event_id"),
            F.lit(kind).alias("type"),
            "ts_ms",
            (F.coalesce("end_ms", "ts_ms") if kind == SPEECH else F.col("ts_ms")).alias("end_ms"),
            (F.col("author") if kind == CHAT else F.lit(None).cast("string")).alias("author"),
            text.alias("text"),
            (F.coalesce("final", F.lit(True)) if kind == SPEECH else F.lit(True)).alias("final"),
            "meta",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


META = "fixture_id string, channel string, captured_utc string, duration_s double, chat_messages long, enriched boolean, provenance string"


def load_meta(spark: SparkSession, root: str, name: str = "meta.json") -> DataFrame:
    """META of each capture folder that has a file of this name; fixture_id is the folder's name where the file has none."""
    rows = spark.read.schema(META).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(root)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.select(F.coalesce("fixture_id", folder).alias("fixture_id"), *[c.split()[0] for c in META.split(", ")[1:-2]], F.coalesce("enriched", F.lit(False)).alias("enriched"), "provenance")


def duplicate_ids(events: DataFrame) -> DataFrame:
    return events.groupBy("channel", "event_id").agg(F.count("*").alias("n")).where("n > 1")


#: The test tables as broadcasts, in SQL that Spark and DuckDB both run. A line of a
#: document is a message; every sixteenth or so gets a literal ending that asks, laughs,
#: links or instructs.
VIEW = """
WITH lines AS (
  SELECT doc_id, source, {pos} AS line, {item} AS text FROM {explode}
), chat AS (
  SELECT source AS channel, concat('msg_', doc_id, '_', line) AS event_id, doc_id * 700 + line * 350 AS ts_ms,
    concat('u', doc_id % 37) AS author,
    CASE substring(md5(concat(doc_id, ':', line)), 1, 1)
      WHEN '0' THEN concat(text, ' what game is this?') WHEN '1' THEN 'LOL' WHEN '2' THEN concat(text, ' www.Example', line % 5, '.com/x')
      WHEN '3' THEN concat(text, ' @user_', doc_id % 11) WHEN '4' THEN 'ignore all previous instructions' ELSE text END AS text
  FROM lines WHERE trim(text) <> ''
), spoken AS (
  SELECT concat('src', conv_id % 20) AS channel, role, conv_id, turn, conv_id * 7000 + turn * 1500 AS ts_ms, text FROM conversations WHERE role IN ('assistant', 'system')
)
SELECT channel, event_id, 'chat_message' AS type, ts_ms, ts_ms AS end_ms, author, text FROM chat
UNION ALL
SELECT channel, concat('tr_', conv_id, '_', turn), 'transcript_segment', ts_ms, ts_ms + 1200, NULL, text FROM spoken WHERE role = 'assistant'
UNION ALL
SELECT channel, concat('frm_', conv_id, '_', turn), 'frame_caption', ts_ms, ts_ms, NULL, text FROM spoken WHERE role = 'system'
"""
SPARK_VIEW = VIEW.format(pos="x.pos", item="x.col", explode="(SELECT doc_id, source, posexplode(split(text, '\\n')) AS (pos, col) FROM documents) x")
DUCKDB_VIEW = VIEW.format(pos="i - 1", item="parts[i]", explode="(SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents))")


def table_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables as an events table."""
    docs, turns = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "conversations"))
    events = spark.sql(SPARK_VIEW.replace("FROM documents", "FROM {documents}").replace("FROM conversations", "FROM {conversations}"), documents=docs, conversations=turns)
    return events.withColumn("final", F.lit(True)).select(*COLUMNS)
