"""Structured Streaming forms: segment sources, late rows and repeats, gap sessions, sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

SEGMENTS = "session_id string, segment_id string, received_at timestamp, status string, text string, confidence double"


def segment_source(spark: SparkSession, path: str | None = None, schema: str = SEGMENTS, per_trigger: int = 1000, kafka: dict | None = None) -> DataFrame:
    """Segments from a folder of JSON lines, or from Kafka when its options are given."""
    if kafka:
        raw = spark.readStream.format("kafka").options(**kafka).load()
        return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("s")).select("s.*")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def first_deliveries(segments: DataFrame, late: str = "30 seconds") -> DataFrame:
    """Each segment once: a repeat within the watermark is dropped, and so is what comes later than it."""
    return segments.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["session_id", "segment_id", "status"])


def final_segments(segments: DataFrame) -> DataFrame:
    """Partial rows never change state."""
    return segments.filter("status = 'final'")


def partial_candidates(segments: DataFrame, tag, confidence: float = 0.74) -> DataFrame:
    """Stateless tags of partial rows, confident enough."""
    return segments.filter("status = 'partial'").withColumn("tag", tag).filter(F.col("tag").isNotNull() & (F.col("confidence") >= confidence))


def sessionize_gap(segments: DataFrame, gap: str = "6 seconds", late: str = "30 seconds") -> DataFrame:
    """Runs of segments without a longer gap; a run comes out once the watermark has passed its end."""
    runs = segments.withWatermark("received_at", late).groupBy("session_id", F.session_window("received_at", gap).alias("w"))
    return runs.agg(F.count("*").alias("n"), F.max("confidence").alias("best")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "best")


#: Folders of an event log.
FOLDERS = 64


def log_folder(session: Column) -> Column:
    """The folder of a session's rows in an event log."""
    return F.pmod(F.xxhash64(session), F.lit(FOLDERS)).cast("int")


def event_log_sink(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """An append-only log by session; files are committed once a batch, also after a restart. Sessions are dealt out to ``FOLDERS`` folders,
    so a batch has no file for each session; ``session_log`` reads the folder of one."""
    return stream.withColumn("folder", log_folder(F.col("session_id"))).writeStream.format("json").partitionBy("folder").option("path", path).option("checkpointLocation", checkpoint)


def session_log(spark: SparkSession, path: str, schema: str, session: str) -> DataFrame:
    """The rows of one session in an event log."""
    rows = spark.read.schema(f"{schema}, folder int").json(path)
    return rows.filter((F.col("folder") == log_folder(F.lit(session))) & (F.col("session_id") == session)).drop("folder")


def fan_out(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str) -> DataStreamWriter:
    """Every batch to all sinks, read once."""

    def send(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)


def debounced_snapshots(stream: DataFrame, path: str, checkpoint: str, every: str = "1 second") -> DataStreamWriter:
    """At most one write per session and trigger: the last row of each session in a batch, in a folder per batch.

    A batch that is run again overwrites its own folder. ``latest_snapshots`` reads the state.
    """

    def save(batch: DataFrame, number: int) -> None:
        last = Window.partitionBy("session_id").orderBy(F.desc("received_at"), F.desc("segment_id"))
        batch.withColumn("rn", F.row_number().over(last)).filter("rn = 1").drop("rn").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(save).trigger(processingTime=every).option("checkpointLocation", checkpoint)


def latest_snapshots(spark: SparkSession, path: str) -> DataFrame:
    last = Window.partitionBy("session_id").orderBy(F.desc("batch"))
    return spark.read.parquet(path).withColumn("rn", F.row_number().over(last)).filter("rn = 1").drop("rn", "batch")
