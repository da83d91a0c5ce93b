"""Transcript, caption and label files as DataFrames, and their sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A transcript line, a caption timing line.
LINE = r"^\[(\d{2}):(\d{2}):(\d{2})\]\s*(.*)$"
TIMING = r"^(?:(\d+):)?(\d{2}):(\d{2})[.,]\d{3}\s+-->"
BREAKS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def file_date(name: Column, default: str) -> Column:
    """YYYY-MM-DD in a file name, else DD.MM.YY or DD.MM.YYYY, else the default."""
    iso = F.try_to_date(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    short = F.regexp_extract(name, r"(\d{2})\.(\d{2})\.(?:20)?(\d{2})(?!\d)", 0)
    parts = [F.regexp_extract(short, r"(\d{2})\.(\d{2})\.(?:20)?(\d{2})", k) for k in (1, 2, 3)]
    dotted = F.try_to_date(F.when(short != "", F.concat(F.lit("20"), parts[2], F.lit("-"), parts[1], F.lit("-"), parts[0])), "yyyy-MM-dd")
    return F.coalesce(iso, dotted, F.to_date(F.lit(default)))


def numbered_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """(file, line, raw) from (file, whole text)."""
    return files.select("file", F.posexplode(F.split(text, BREAKS)).alias("pos", "raw")).select("file", (F.col("pos") + 1).cast("long").alias("line"), "raw")


def parse_transcripts(files: DataFrame, default_date: str = "2026-03-01") -> DataFrame:
    """[HH:MM:SS] lines; others are dropped but count in line numbers."""
    x = numbered_lines(files).filter(F.col("raw").rlike(LINE))
    part = lambda k: F.regexp_extract("raw", LINE, k)
    timecode = F.concat_ws(":", part(1), part(2), part(3))
    at = F.to_timestamp(F.concat_ws(" ", file_date(F.col("file"), default_date).cast("string"), timecode))
    return x.select("file", "line", timecode.alias("timecode"), part(4).alias("text"), at.alias("received_at"))


def read_transcripts(spark: SparkSession, path: str, default_date: str = "2026-03-01") -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return parse_transcripts(files, default_date)


def parse_vtt(files: DataFrame) -> DataFrame:
    """(file, seq, ts_s, text): a cue is a timing line and the lines up to a blank line or the next cue."""
    from pyspark.sql import Window

    from livetext.functions.text import clean_markup

    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    x = numbered_lines(files).withColumn("timing", F.col("raw").rlike(TIMING))
    x = x.withColumn("seq", F.sum(F.col("timing").cast("long")).over(w)).withColumn("blank", F.trim("raw") == "")
    x = x.withColumn("ended", F.max(F.when(F.col("blank"), F.col("line"))).over(w)).withColumn("began", F.max(F.when(F.col("timing"), F.col("line"))).over(w))
    hour, minute, second = (F.coalesce(F.nullif(F.regexp_extract("raw", TIMING, k), F.lit("")), F.lit("0")).cast("long") for k in (1, 2, 3))
    inside = (F.col("seq") > 0) & ~F.col("timing") & (F.coalesce(F.col("ended"), F.lit(0)) < F.col("began"))
    cue = x.groupBy("file", "seq").agg(F.max(F.when(F.col("timing"), hour * 3600 + minute * 60 + second)).alias("ts_s"), F.array_sort(F.collect_list(F.when(inside, F.struct("line", "raw")))).alias("body"))
    text = clean_markup(F.array_join(F.transform("body", lambda b: b["raw"]), " "))
    return cue.filter("seq > 0").select("file", "seq", "ts_s", text.alias("text")).filter("text <> ''")


def parse_json3(files: DataFrame) -> DataFrame:
    """(file, seq, ts_s, text) from events[].tStartMs and segs[].utf8."""
    from livetext.functions.text import clean_markup

    body = F.from_json("text", "events array<struct<tStartMs:long,segs:array<struct<utf8:string>>>>")
    x = files.select("file", F.posexplode(body["events"]).alias("seq", "e"))
    text = clean_markup(F.array_join(F.transform("e.segs", lambda s: s["utf8"]), ""))
    return x.select("file", (F.col("seq") + 1).cast("long").alias("seq"), F.floor(F.col("e.tStartMs") / 1000).alias("ts_s"), text.alias("text")).filter("text <> ''")


def render_transcript(captions: DataFrame) -> DataFrame:
    """Captions as [HH:MM:SS] text lines."""
    t = F.greatest(F.lit(0), F.col("ts_s").cast("long"))
    stamp = F.format_string("[%02d:%02d:%02d] %s", F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60, F.col("text"))
    return captions.select("file", "seq", stamp.alias("value"))


def transcript_files(lines: DataFrame) -> DataFrame:
    """(file, text): the lines of each file in order, each ended by a line break. A caption file is one text, as it is read."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "value")))
    return lines.groupBy("file").agg(F.concat(F.array_join(F.transform(parts, lambda x: x["value"]), "\n"), F.lit("\n")).alias("text"))


def transcript_name(upload_date: Column, title: Column, video: Column) -> Column:
    """date__safe-title__id.txt, from YYYYMMDD; the title is cut at 80 characters."""
    day = F.when(upload_date.rlike("^[0-9]{8}$"), F.regexp_replace(upload_date, "^(....)(..)(..)$", "$1-$2-$3")).otherwise("unknown-date")
    safe = F.regexp_replace(F.regexp_replace(title, "[^A-Za-z0-9._-]+", "-"), "^[-.]+|[-.]+$", "")
    safe = F.regexp_replace(safe, "-{2,}", "-")
    return F.concat(day, F.lit("__"), F.substring(F.coalesce(F.nullif(safe, F.lit("")), video), 1, 80), F.lit("__"), video, F.lit(".txt"))


def ingest_manifest(results: DataFrame) -> DataFrame:
    """Items and their number by status; a status holds the items of one ingest run."""
    return results.groupBy("status").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("item")).alias("items"))


def rank_tracks(tracks: DataFrame, language: str = "en") -> DataFrame:
    """One track of (video, kind, lang) a video: manual first, then tracks of the language if there are any, exact before
    variants, and original ones last. Live chats are no tracks."""
    from livetext.operators.relational import first_by

    lang, wanted = F.lower("lang"), language.lower()
    variant = lang.startswith(f"{wanted}-") | lang.startswith(f"{wanted}_")
    order = [F.col("kind") != "manual", ~((lang == wanted) | variant), lang != wanted, ~variant, lang.contains("orig"), lang]
    return first_by(tracks.filter(~lang.contains("live_chat")), ["video"], order).drop("rn")


def read_reviewed(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """JSON-lines inputs in order, repeated paths once; corrupt lines are kept aside in _corrupt_record."""
    out = None
    for k, path in enumerate(dict.fromkeys(paths)):
        one = spark.read.schema(schema + ", _corrupt_record string").json(path).withColumn("input_ordinal", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def write_examples(rows: DataFrame, flagged: Column, path: str) -> None:
    """Clean and flagged rows as JSON lines, in two folders."""
    rows.withColumn("part", F.when(flagged, "flagged").otherwise("clean")).write.partitionBy("part").json(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or else the warehouse, which on a cluster must not be
    a machine's own folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if base.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/_livetext/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """``rows`` written to such a folder and read back, for tables that are used more than once; as ``schema`` if given."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(schema or rows.schema).parquet(path)


def written_examples(rows: DataFrame, flagged: Column, part: str) -> DataFrame:
    """``rows`` written by ``write_examples``, and one of the two parts read back."""
    spark = rows.sparkSession
    path = scratch(spark, "examples")
    write_examples(rows, flagged, path)
    return spark.read.schema(rows.schema).json(f"{path}/part={part}")
