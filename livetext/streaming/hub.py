"""A stream's rows as numbered versions beside a state table: a subscriber gets a snapshot first, then each later row once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass
class Hub:
    """Rows that a stream publishes, under ``path``, which driver and executors share.

    - ``deltas/version=v``: the rows of one batch; ``state/version=v``: the last row of each key up to v and the number of its rows
      (``rows``), made anew every ``every`` versions; ``commits``: one small row a version, written last

    A version counts once it is committed, so readers never see half a batch. A batch that is run again under the same ``writer`` is
    committed already and left out; what a lost attempt left behind is overwritten. One stream at a time publishes to a hub. The last
    row of a key is the greatest by ``order``; order ties by all other columns are the same row.
    """

    spark: SparkSession
    path: str
    schema: str
    key: str = "session_id"
    order: tuple[str, ...] = ("received_at", "segment_id")
    every: int = 16

    def _commits(self) -> DataFrame:
        return self.spark.read.schema("writer string, batch long, version long, kind string").parquet(f"{self.path}/commits")

    def _newest(self, kind: str, upto: int | None = None) -> int:
        """The newest committed version of a kind, or -1."""
        try:
            rows = self._commits().filter(F.col("kind") == kind)
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return -1  # nothing was ever published
        rows = rows if upto is None else rows.filter(F.col("version") <= upto)
        return rows.agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0]

    def _commit(self, kind: str, version: int, writer: str, batch: int) -> None:
        row = self.spark.createDataFrame([(writer, batch)], "writer string, batch long").coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.path}/commits/kind={kind}/version={version}")

    def version(self) -> int:
        """The newest version that can be read; -1 before the first one."""
        return self._newest("delta")

    def publish(self, writer: str):
        """A sink for ``fan_out``. ``writer`` names the stream; it changes where a stream starts again with a new checkpoint."""

        def sink(batch: DataFrame, number: int) -> None:
            head = self.version()
            done = head >= 0 and self._commits().filter((F.col("kind") == "delta") & (F.col("writer") == writer) & (F.col("batch") == number))
            if head < 0 or done.isEmpty():
                head += 1
                batch.write.mode("overwrite").parquet(f"{self.path}/deltas/version={head}")
                self._commit("delta", head, writer, number)
            # also where the state of a committed version was lost
            if (head + 1) % self.every == 0 and self._newest("state") < head:
                self.compact(head, writer, number)

        return sink

    def compact(self, version: int, writer: str = "", number: int = -1) -> None:
        """Writes the state at ``version``; a snapshot then reads that and the deltas since."""
        self.snapshot(version).write.mode("overwrite").parquet(f"{self.path}/state/version={version}")
        self._commit("state", version, writer, number)

    def _folders(self, part: str, first: int, last: int) -> DataFrame | None:
        # versions without a break, so that no folder is listed that isn't read
        paths = [f"{self.path}/{part}/version={v}" for v in range(first, last + 1)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else None

    def deltas(self, after: int, upto: int | None = None) -> DataFrame:
        """The rows of the versions after ``after``, up to the newest one or ``upto``."""
        newest = self.version()
        rows = self._folders("deltas", after + 1, newest if upto is None else min(upto, newest))
        return self.spark.createDataFrame([], self.schema) if rows is None else rows

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The last row of each key at a version (the newest), with ``rows``, the number of its rows up to there."""
        head = self.version()
        at = head if version is None else min(version, head)
        base = self._newest("state", at)
        ranked = Window.partitionBy(self.key).orderBy(*[F.desc(c) for c in self.order])
        # a key's rows of the deltas shrink to one before they are shuffled
        fresh = self.deltas(base, at)
        columns = F.struct(*fresh.columns)
        fresh = fresh.groupBy(self.key).agg(F.max_by(columns, F.struct(*self.order)).alias("r"), F.count("*").alias("rows"))
        fresh = fresh.select("r.*", "rows")
        if base < 0:
            return fresh
        old = self.spark.read.schema(f"{self.schema}, `rows` long").parquet(f"{self.path}/state/version={base}")
        both = old.unionByName(fresh)
        total = F.sum("rows").over(Window.partitionBy(self.key))
        return both.withColumn("rn", F.row_number().over(ranked)).withColumn("rows", total).filter("rn = 1").drop("rn")


@dataclass
class Subscription:
    """One subscriber of a hub, of all keys or of those in ``keys`` (one column): ``snapshot`` once, then ``poll`` again and again.

    The snapshot's version is fixed first, so a row that comes in between is in the first poll and none is in both. ``seen`` is all that
    a subscriber has to keep to go on after a restart.
    """

    hub: Hub
    keys: DataFrame | None = None
    seen: int | None = None

    def _mine(self, rows: DataFrame) -> DataFrame:
        return rows if self.keys is None else rows.join(self.keys.distinct(), self.hub.key, "left_semi")

    def snapshot(self) -> DataFrame:
        self.seen = self.hub.version()
        return self._mine(self.hub.snapshot(self.seen))

    def poll(self) -> DataFrame:
        """Rows published since; call ``snapshot`` first, or give ``seen``."""
        if self.seen is None:
            raise ValueError("a subscriber takes a snapshot first")
        upto = self.hub.version()
        rows, self.seen = self._mine(self.hub.deltas(self.seen, upto)), upto
        return rows
