"""A stream's result is the batch result over the same rows; repeats and late rows follow the watermark."""

import json
import os

from pyspark.sql import functions as F

from livetext.streaming import sessions as st


def rows():
    at = lambda s: f"2026-03-01T00:{s // 60:02d}:{s % 60:02d}.000Z"
    made = [("a", "1", 0), ("a", "2", 4), ("a", "3", 30), ("b", "1", 2), ("b", "2", 9), ("a", "4", 33), ("z", "9", 600)]
    return [dict(session_id=s, segment_id=i, received_at=at(t), status="final" if i != "3" else "partial", text=f"w{i}", confidence=0.5 + t % 5 / 10) for s, i, t in made]


def feed(folder, parts):
    folder.mkdir()
    for k, part in enumerate(parts):
        file = folder / f"{k}.json"
        file.write_text("\n".join(map(json.dumps, part)))
        os.utime(file, (1_800_000_000 + k, 1_800_000_000 + k))  # files arrive in this order
    return str(folder)


def drain(writer):
    q = writer.trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()


def test_gap_sessions_equal_batch(spark, tmp_path):
    data = rows()
    path = feed(tmp_path / "in", [data[:3], data[3:6], data[6:]])
    stream = st.sessionize_gap(st.segment_source(spark, path, per_trigger=1))
    drain(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")))
    batch = st.sessionize_gap(spark.read.schema(st.SEGMENTS).json(path)).filter("session_id <> 'z'")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))


def test_repeats_within_the_watermark_come_once(spark, tmp_path):
    data = rows()
    path = feed(tmp_path / "in", [data[:3], data[:3] + data[3:]])
    stream = st.first_deliveries(st.segment_source(spark, path, per_trigger=1))
    drain(st.event_log_sink(stream, str(tmp_path / "log"), str(tmp_path / "cp")))
    got = spark.read.json(str(tmp_path / "log")).select("session_id", F.col("segment_id").cast("string")).collect()
    assert sorted(map(tuple, got)) == sorted((r["session_id"], r["segment_id"]) for r in data)


def test_fan_out_and_partials(spark, tmp_path):
    path = feed(tmp_path / "in", [rows()])
    seen = {"final": [], "partial": []}
    tag = F.when(F.col("text") == "w3", "TRIM")
    sinks = [lambda b, _: seen["final"].extend(r.text for r in st.final_segments(b).collect()), lambda b, _: seen["partial"].extend(r.tag for r in st.partial_candidates(b, tag, 0.5).collect())]
    drain(st.fan_out(st.segment_source(spark, path), sinks, str(tmp_path / "cp")))
    assert len(seen["final"]) == 6 and seen["partial"] == ["TRIM"]


def test_snapshots_hold_the_last_row(spark, tmp_path):
    data = rows()
    path = feed(tmp_path / "in", [data[:4], data[4:]])
    drain(st.debounced_snapshots(st.segment_source(spark, path, per_trigger=1), str(tmp_path / "snap"), str(tmp_path / "cp")))
    got = {r.session_id: r.text for r in st.latest_snapshots(spark, str(tmp_path / "snap")).collect()}
    assert got == {"a": "w4", "b": "w2", "z": "w9"}


def test_a_log_has_no_file_for_each_session(spark, tmp_path):
    data = [dict(session_id=f"s{k % 500}", segment_id=str(k), received_at="2026-03-01T00:00:00.000Z", status="final", text=f"w{k}", confidence=0.5) for k in range(1000)]
    path = feed(tmp_path / "in", [data])
    drain(st.event_log_sink(st.segment_source(spark, path), str(tmp_path / "log"), str(tmp_path / "cp")))
    assert len(list((tmp_path / "log").glob("*/*.json"))) <= st.FOLDERS
    one = st.session_log(spark, str(tmp_path / "log"), "session_id string, segment_id string, text string", "s7")
    assert sorted(map(tuple, one.collect())) == [("s7", "507", "w507"), ("s7", "7", "w7")]
    assert spark.read.json(str(tmp_path / "log")).count() == 1000


def test_a_logs_rows_have_no_folder(spark):
    """The query gives the columns of its SQL; how the log is dealt out stays in the log."""
    from livetext.plans import streams

    rows = streams.event_log_sink(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["session_id", "segment_id", "text"] and rows.count() == streams.segments(spark, "/root/testdata/sf0.001").filter("status = 'final'").count()
