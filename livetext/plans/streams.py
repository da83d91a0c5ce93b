"""Queries that run as streams: a given table is written as files, read as a stream, and the sink's rows are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from livetext.plans.queries import LEXICON, P, conv, plain, query, read
from livetext.sources.transcripts import scratch
from livetext.streaming import hub
from livetext.streaming import sessions as st
from livetext.streaming import state

SCHEMA = "session_id string, segment_id string, received_at timestamp, at double, status string, text string, confidence double"


def segments(spark, d) -> DataFrame:
    """Conversations as segments: a turn every two seconds, each fifth one partial."""
    at = (F.col("turn") * 2).cast("double")
    status = F.when(F.col("turn") % 5 == 4, "partial").otherwise("final")
    confidence = F.round(0.6 + (F.col("turn") % 7) / 14, 4)
    rows = conv(spark, d).select(F.col("conv_id").cast("string").alias("session_id"), F.format_string("%08d", "turn").alias("segment_id"), at.alias("at"), status.alias("status"), plain(F.col("text")).alias("text"), confidence.alias("confidence"))
    return rows.withColumn("received_at", F.timestamp_seconds("at"))


SEGMENTS = f"""g AS (SELECT conv_id::VARCHAR AS session_id, lpad(turn::VARCHAR, 8, '0') AS segment_id, (turn * 2)::DOUBLE AS tm, turn, CASE WHEN turn % 5 = 4 THEN 'partial' ELSE 'final' END AS status, {P} AS text,
round(0.6 + (turn % 7) / 14, 4) AS confidence, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)"""


def as_stream(rows: DataFrame, schema: str = SCHEMA, parts: int = 3) -> DataFrame:
    """``rows`` as a stream of files in the order of their time. Sessions go on from part to part; each part is dealt out by session,
    and a trigger reads as many files as a part has at most."""
    spark = rows.sparkSession
    path = scratch(spark, "stream")
    part = F.least(F.lit(parts - 1), F.floor(F.col("at") / 10)).cast("int")
    for k in range(parts):
        rows.filter(part == k).repartition("session_id").write.mode("append").json(path)
    return st.segment_source(spark, path, schema, per_trigger=int(spark.conf.get("spark.sql.shuffle.partitions")))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows of a stream once it has read all there is."""
    spark = stream.sparkSession
    path = scratch(spark, "drained")
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{path}/out")
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{path}/out"))
    run(writer.option("checkpointLocation", f"{path}/checkpoint"))
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def run(writer) -> None:
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


CASES = " ".join(f"WHEN regexp_matches(joined, '{p}') THEN '{t}'" for _, p, t in LEXICON)


@query(f"""WITH RECURSIVE {SEGMENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tm) AS k, lag(text) OVER w AS b, tm - lag(tm) OVER w AS gap FROM g WHERE status = 'final' WINDOW w AS (PARTITION BY session_id ORDER BY tm)),
j AS (SELECT *, CASE WHEN gap <= 4 THEN trim(b || ' ' || text) ELSE text END AS joined FROM n), t AS (SELECT *, CASE {CASES} END AS own FROM j),
f AS (SELECT session_id, 0::BIGINT AS k, NULL::VARCHAR AS segment_id, NULL::VARCHAR AS tag, 'FLAT' AS position, 'FLAT' AS after, NULL::VARCHAR AS last, 0.0::DOUBLE AS last_at FROM (SELECT DISTINCT session_id FROM t)
UNION ALL SELECT session_id, k, segment_id, CASE WHEN kept THEN s END, after, CASE WHEN kept THEN CASE s WHEN 'ENTER_LONG' THEN 'LONG' WHEN 'ENTER_SHORT' THEN 'SHORT' WHEN 'EXIT_ALL' THEN 'FLAT' ELSE after END ELSE after END, CASE WHEN kept THEN s ELSE last END, CASE WHEN kept THEN tm ELSE last_at END
FROM (SELECT *, s IS NOT NULL AND s NOT IN ('NO_ACTION', 'SETUP') AND NOT (coalesce(s = last, false) AND tm - last_at <= 2.5) AS kept FROM (SELECT t.session_id, t.k, t.segment_id, t.tm, f.after, f.last, f.last_at,
CASE WHEN t.own IN ('TRIM', 'MOVE_STOP', 'EXIT_ALL') AND f.after = 'FLAT' THEN NULL WHEN t.own = 'ENTER_' || f.after THEN 'ADD' ELSE t.own END AS s FROM f JOIN t ON t.session_id = f.session_id AND t.k = f.k + 1)))
SELECT session_id, segment_id, tag, position FROM f WHERE tag IS NOT NULL""")
def stream_intents(spark, d):
    return drained(state.stream_intents(as_stream(segments(spark, d)), [(p, t) for _, p, t in LEXICON]))


@query()
def stabilize_partials(spark, d):
    """A conversation's rows as the growing partial texts of an utterance: each holds the words of the last three rows."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("at").rowsBetween(-2, 0)
    rows = segments(spark, d).withColumn("text", F.array_join(F.collect_list("text").over(w), " "))
    partials = as_stream(rows).select(F.col("session_id").alias("utterance_id"), F.col("segment_id").cast("long").alias("seq"), "text")
    return drained(state.stabilize_partials(partials))


@query(f"WITH {SEGMENTS}, t AS (SELECT *, CASE turn % 2 WHEN 0 THEN 'TRIM' ELSE 'SETUP_LONG' END AS tag FROM g WHERE status = 'partial' AND confidence >= 0.74) SELECT session_id, segment_id, tag, confidence FROM t WHERE tag = 'TRIM' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY tm DESC) = 1")
def partial_candidates(spark, d):
    tag = F.when(F.col("segment_id").cast("long") % 2 == 0, "TRIM").otherwise("SETUP_LONG")
    return drained(state.newest_candidates(as_stream(segments(spark, d)), tag), "complete")


@query(f"""WITH {SEGMENTS}, t AS (SELECT *, turn % 2 = 0 AS long FROM g) SELECT session_id, segment_id FROM t WHERE status = 'partial' AND confidence >= 0.8 AND turn % 3 <> 0 AND contains(text, 'th')
AND regexp_matches(text, CASE WHEN long THEN '\\bthe\\b' ELSE '\\bof\\b' END)""")
def preview_entries(spark, d):
    long = F.col("segment_id").cast("long") % 2 == 0
    rows = as_stream(segments(spark, d)).select("*", F.when(long, "LONG").otherwise("SHORT").alias("side"), F.when(F.col("segment_id").cast("long") % 3 != 0, 90.0).alias("stop"), F.lit(None).cast("string").alias("guard"), F.lit(None).cast("string").alias("position"))
    rows = rows.withColumn("tag", F.concat(F.lit("ENTER_"), "side"))
    return drained(state.preview_entries(rows, {"LONG": r"\bthe\b", "SHORT": r"\bof\b"}, ["th", "versus"], 0.8).select("session_id", "segment_id"))


@query(f"WITH {SEGMENTS} SELECT session_id, segment_id, text FROM g")
def segment_source(spark, d):
    return drained(as_stream(segments(spark, d)).select("session_id", "segment_id", "text"))


@query(f"WITH {SEGMENTS} SELECT session_id, segment_id, text FROM g WHERE status = 'final'")
def event_log_sink(spark, d):
    """The log's rows; sessions are dealt out to its folders."""
    path = scratch(spark, "log")
    run(st.event_log_sink(st.final_segments(as_stream(segments(spark, d))), f"{path}/log", f"{path}/checkpoint"))
    # the folder is a column of the log by its path, not one of the result
    return spark.read.schema("session_id string, segment_id string, text string").json(f"{path}/log").select("session_id", "segment_id", "text")


@query(f"WITH {SEGMENTS} SELECT 'log' AS sink, session_id, segment_id FROM g UNION ALL SELECT 'final', session_id, segment_id FROM g WHERE status = 'final'")
def fan_out(spark, d):
    """Two sinks of one stream, each with its own rows."""
    path = scratch(spark, "fan")
    save = lambda name, part: lambda batch, k: part(batch).select("session_id", "segment_id").write.mode("overwrite").parquet(f"{path}/{name}/batch={k}")
    run(st.fan_out(as_stream(segments(spark, d)), [save("log", lambda b: b), save("final", st.final_segments)], f"{path}/checkpoint"))
    of = lambda name: spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("sink"), "session_id", "segment_id")
    return of("log").unionByName(of("final"))


@query(f"WITH {SEGMENTS} SELECT session_id, segment_id, text FROM g QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY tm DESC) = 1")
def debounced_snapshots(spark, d):
    path = scratch(spark, "snapshots")
    run(st.debounced_snapshots(as_stream(segments(spark, d)), f"{path}/state", f"{path}/checkpoint"))
    return st.latest_snapshots(spark, f"{path}/state").select("session_id", "segment_id", "text")


@query(f"""WITH {SEGMENTS}, n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM g WHERE tm < 10)
SELECT 'snapshot' AS kind, session_id, segment_id, text, n AS "rows" FROM n QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY tm DESC) = 1
UNION ALL SELECT 'delta', session_id, segment_id, text, 1 FROM g WHERE tm >= 10""")
def snapshot_then_deltas(spark, d):
    """A subscriber that comes after ten seconds of every session: their state, then all rows since, each once."""
    rows, path = segments(spark, d), scratch(spark, "hub")
    published = hub.Hub(spark, path, SCHEMA, every=2)
    run(st.fan_out(as_stream(rows.filter("at < 10")), [published.publish("first")], f"{path}/checkpoint-1"))
    subscriber = hub.Subscription(published)
    state_then = subscriber.snapshot().select(F.lit("snapshot").alias("kind"), "session_id", "segment_id", "text", "rows")
    run(st.fan_out(as_stream(rows.filter("at >= 10")), [published.publish("second")], f"{path}/checkpoint-2"))
    since = subscriber.poll().select(F.lit("delta").alias("kind"), "session_id", "segment_id", "text", F.lit(1).cast("long").alias("rows"))
    return state_then.unionByName(since)
