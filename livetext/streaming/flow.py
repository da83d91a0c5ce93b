"""The spoken intent cascade, preview entries and late rows as streams.

State is kept by ``transformWithState`` in RocksDB, a variable for each kind of memory, and event-time timers drop each of them
when it has run out, whether or not its session speaks again. A row later than the watermark is dropped by Spark;
``split_late`` keeps such rows in a table of their own. The rows of a session in one trigger are read in the order of their times.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from livetext.functions.prices import resolve_price
from livetext.operators import flow as fl

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rows(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(order, kind="stable")


def _timer(handle: StatefulProcessorHandle, at: float, seconds: float) -> None:
    """A timer just after ``at + seconds``, since state holds up to that time inclusive."""
    handle.registerTimer(int(round((at + seconds) * 1000)) + 1)


def _over(at: float, seconds: float, info) -> bool:
    return round((at + seconds) * 1000) < info.getExpiryTimeInMs()


CHAINED = "session_id string, segment_id string, received_at timestamp, at double, said string, market double, before array<struct<text:string,at:double>>"


class Chain(StatefulProcessor):
    """The texts before each row that lead to it without a long gap."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "said string, at double")

    def handleInputRows(self, key, rows, timerValues):
        last = [tuple(x) for x in self.last.get()]
        out = []
        for r in fl.plain_rows(_rows(rows, ["at", "segment_id"])):
            if last and r.at - last[0][1] > fl.WINDOW:
                last = []
            out.append((key[0], r.segment_id, r.received_at, r.at, r.said, r.market, [{"text": s, "at": t} for s, t in last]))
            last = [(r.said, r.at), *last][: fl.FRAGMENTS - 1]
        self.last.put(last)
        _timer(self.handle, last[0][1], fl.WINDOW)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHAINED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last = [tuple(x) for x in self.last.get()]
        if last and _over(last[0][1], fl.WINDOW, expiredTimerInfo):
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


CUES = {"management": fl.GUARD, "exit": fl.GUARD, "away": fl.INSTRUMENT}
INTENTS = "session_id string, segment_id string, " + fl.OUT


class Interpreter(StatefulProcessor):
    """The fold of ``livetext.operators.flow`` with its state in the store."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "position string, average double, stop double, last_side string, seen_at double")
        self.cues = handle.getMapState("cues", "name string", "at double")
        self.intent = handle.getValueState("intent", "tag string, side string, at double, entry double, stop double, target double")
        self.window = handle.getValueState("window", "at double, tag string, side string, n int")
        self.recent = handle.getListState("recent", "at double")

    def _load(self) -> fl.Flow:
        flow = fl.Flow()
        if self.held.exists():
            flow.position, flow.average, flow.stop, flow.last_side, flow.seen_at = self.held.get()
        for (name,), (at,) in self.cues.iterator():
            setattr(flow, f"{name}_at", at)
        if self.intent.exists():
            flow.tag, flow.side, flow.said_at, *prices = self.intent.get()
            flow.prices = tuple(prices)
        if self.window.exists():
            flow.window_at, flow.window_tag, flow.window_side, flow.window_rows = self.window.get()
        flow.recent = tuple(x[0] for x in self.recent.get())
        return flow

    def _store(self, flow: fl.Flow) -> None:
        keep = lambda state, there, value: state.update(value) if there else state.clear()
        self.held.update((flow.position, flow.average, flow.stop, flow.last_side, flow.seen_at))
        _timer(self.handle, flow.seen_at, fl.IDLE)
        for name, seconds in CUES.items():
            at = getattr(flow, f"{name}_at")
            if at is not None:
                self.cues.updateValue((name,), (at,))
                _timer(self.handle, at, seconds)
            elif self.cues.containsKey((name,)):
                self.cues.removeKey((name,))
        keep(self.intent, flow.tag is not None, (flow.tag, flow.side, flow.said_at, *flow.prices))
        keep(self.window, flow.window_at is not None, (flow.window_at, flow.window_tag, flow.window_side, flow.window_rows))
        if flow.tag is not None:
            _timer(self.handle, flow.said_at, fl.ENTRY_REPEAT)
        if flow.window_at is not None:
            _timer(self.handle, flow.window_at, fl.WINDOW)
        if flow.recent:
            self.recent.put([(t,) for t in flow.recent])
            _timer(self.handle, flow.recent[-1], fl.LEAD)
        else:
            self.recent.clear()

    def handleInputRows(self, key, rows, timerValues):
        flow = self._load()
        out = [(key[0], r.segment_id, *fl.said(flow, r)) for r in fl.plain_rows(_rows(rows, ["at", "segment_id"]))]
        self._store(flow)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in INTENTS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        over = lambda at, seconds: _over(at, seconds, expiredTimerInfo)
        for (name,), (at,) in list(self.cues.iterator()):
            if over(at, CUES[name]):
                self.cues.removeKey((name,))
        for state, at, seconds in ((self.intent, 2, fl.ENTRY_REPEAT), (self.window, 0, fl.WINDOW), (self.held, 4, fl.IDLE)):
            if state.exists() and over(state.get()[at], seconds):
                state.clear()
        recent = [x[0] for x in self.recent.get()]
        if recent and over(recent[-1], fl.LEAD):
            self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


def stateful(stream: DataFrame, processor: StatefulProcessor, key: str, schema: str, time: str | None = None) -> DataFrame:
    """``transformWithState`` in event time; the state store must be RocksDB."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime", eventTimeColumnName=time or "")


def stream_interpret(segments: DataFrame, lex: fl.Lexicon, late: str = "30 seconds", market: Column | None = None, review: bool = False, resolve=resolve_price) -> DataFrame:
    """What each final segment (session_id, segment_id, received_at, status, normalised text) says, as ``flow.interpret`` would say."""
    price = market if market is not None else F.lit(None).cast("double")
    own = segments.filter((F.col("status") == "final") & (F.trim(F.coalesce("text", F.lit(""))) != "")).withWatermark("received_at", late)
    own = own.select("session_id", "segment_id", "received_at", F.col("received_at").cast("double").alias("at"), F.trim("text").alias("said"), price.cast("double").alias("market"))
    found = fl.readings(stateful(own, Chain(), "session_id", CHAINED, "received_at"), lex, "at", "said", "market", review, True, resolve)
    return stateful(found, Interpreter(), "session_id", INTENTS)


OUTCOMES = "session_id string, id string, outcome string, confirmed_by string"


class Confirm(StatefulProcessor):
    """Previews that wait for a final row: it confirms or flattens them; a timer lets them expire."""

    def __init__(self, within: float):
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "id string, at double, stop double")

    def _frame(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUTCOMES.split(", ")])

    def handleInputRows(self, key, rows, timerValues):
        open_, out = [tuple(x) for x in self.open.get()], []
        for r in fl.plain_rows(_rows(rows, ["at", "id"])):
            if r.final:
                for id_, at, stop in open_:
                    timely, same = r.at - at <= self.within, r.strong and stop is not None and r.stop == stop
                    out.append((key[0], id_, ("confirmed" if same else "flattened") if timely else "expired", r.id if timely and same else None))
                open_ = []
            if r.preview:
                open_.append((r.id, r.at, r.stop))
                _timer(self.handle, r.at, self.within)
        if open_:
            self.open.put(open_)
        else:
            self.open.clear()
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = [tuple(x) for x in self.open.get()]
        gone = [x for x in held if _over(x[1], self.within, expiredTimerInfo)]
        kept = [x for x in held if x not in gone]
        if kept:
            self.open.put(kept)
        else:
            self.open.clear()
        yield self._frame([(key[0], x[0], "expired", None) for x in gone])

    def close(self) -> None:
        pass


def stream_confirm_preview(rows: DataFrame, preview: Column, final: Column, strong: Column, stop: Column, within: float = 12.0, late: str = "30 seconds") -> DataFrame:
    """The outcome of each preview row (session_id, segment_id, received_at) by the first final row after it within the time; one that
    none follows comes out as "expired" once the watermark has passed its time."""
    own = rows.withWatermark("received_at", late).select("session_id", F.col("segment_id").alias("id"), "received_at", F.col("received_at").cast("double").alias("at"), *[F.coalesce(c, F.lit(False)).alias(n) for c, n in ((preview, "preview"), (final, "final"), (strong, "strong"))], stop.cast("double").alias("stop"))
    return stateful(own, Confirm(within), "session_id", OUTCOMES)


def split_late(stream: DataFrame, at: str, delay: float, path: str, checkpoint: str) -> DataStreamWriter:
    """Every row to ``path/on_time`` or ``path/late``: late is what is not after the greatest time of all earlier batches less
    ``delay`` seconds, which is the watermark that stateful operators use. Rows without a time are on time.

    Both are folders by batch, as are the greatest times; a batch that is run again overwrites its own.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = greatest_time(spark, f"{path}/marks", number)
        old = F.lit(False) if mark is None else F.coalesce(F.col(at).cast("double") <= mark - delay, F.lit(False))
        batch = batch.persist()
        try:
            for name, rows in (("on_time", batch.filter(~old)), ("late", batch.filter(old))):
                rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
            batch.agg(F.max(F.col(at).cast("double")).alias("at")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def greatest_time(spark: SparkSession, path: str, before: int) -> float | None:
    """The greatest time of the batches before one; a row for each batch."""
    if before == 0:
        return None
    return spark.read.schema("at double, batch long").parquet(path).filter(F.col("batch") < before).agg(F.max("at")).first()[0]
