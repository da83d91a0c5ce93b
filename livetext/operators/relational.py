"""Joins, aggregations, samples and set operations on transcript, label and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_labels(lines: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    return lines.join(labels.hint("merge"), keys, "left")


def resolve_chunk_refs(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """Label rows whose line is in their chunk; ``chunks`` is (file, chunk, line)."""
    return labels.join(chunks.hint("merge"), ["file", "chunk", "line"])


def merge_review_state(fresh: DataFrame, earlier: DataFrame, fields: list[str]) -> DataFrame:
    """Fresh candidates with the review fields that an earlier state holds for their id; vanished ids drop."""
    kept = earlier.select("id", *[F.col(c).alias("was_" + c) for c in fields])
    return fresh.join(kept.hint("merge"), "id", "left").select(*[F.coalesce("was_" + c, c).alias(c) if c in fields else F.col(c) for c in fresh.columns])


def exclude_reviewed(lines: DataFrame, reviewed: DataFrame) -> DataFrame:
    return lines.join(reviewed.select("file", "line").hint("merge"), ["file", "line"], "left_anti")


def guard_neighbours(lines: DataFrame, positive: DataFrame, reach: int = 1) -> DataFrame:
    near = positive.select("file", F.explode(F.sequence(F.col("line") - reach, F.col("line") + reach)).alias("line"))
    return lines.join(near.distinct().hint("merge"), ["file", "line"], "left_anti")


def exclude_covered(lines: DataFrame, covered: DataFrame) -> DataFrame:
    return lines.join(covered.select("file").distinct().hint("merge"), "file", "left_anti")


def align_labels(labels: DataFrame, rows: DataFrame, score: Column, reach: int = 10) -> DataFrame:
    """Each label on the best-scoring row within ``reach`` lines; ties go to the nearest, then the earlier line.

    The range is an equi-join on (file, block of lines) so that no file is a cross join.
    """
    block = 2 * reach + 1
    l = labels.withColumn("b", F.explode(F.array_distinct(F.array(F.floor((F.col("line") - reach) / block), F.floor((F.col("line") + reach) / block))))).withColumnRenamed("line", "at")
    r = rows.withColumn("b", F.floor(F.col("line") / block)).withColumn("score", score)
    best = Window.partitionBy("file", "at").orderBy(F.desc("score"), F.abs(F.col("line") - F.col("at")), "line")
    near = l.join(r.hint("merge"), ["file", "b"]).filter(F.abs(F.col("line") - F.col("at")) <= reach)
    return near.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("file", "at", "line", "score")


def asof_state(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` at or before its time: a union and one window, one shuffle."""
    both = left.select(key, ts, "id", F.lit(1).alias("side"), F.lit(None).cast("double").alias(value)).unionByName(right.select(key, ts, F.lit(None).cast("long").alias("id"), F.lit(0).alias("side"), F.col(value).cast("double")))
    w = Window.partitionBy(key).orderBy(ts, "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("side = 1").select(key, "id", value)


def confirm_preview(rows: DataFrame, key: str, seconds: str, id_col: str, preview: Column, final: Column, strong: Column, stop: Column, within: int = 12) -> DataFrame:
    """Each preview row with what the first final row of its key within the time does: it is "confirmed" by a strong entry with
    the same stop, "flattened" by any other, "expired" without one."""
    w = Window.partitionBy(key).orderBy(seconds, id_col).rowsBetween(1, Window.unboundedFollowing)
    facts = F.struct(F.col(seconds).alias("at"), F.col(id_col).alias("id"), strong.alias("strong"), stop.alias("stop"))
    x = rows.withColumn("next", F.first(F.when(final, facts), ignorenulls=True).over(w)).withColumn("own", stop)
    timely = F.col("next.at") - F.col(seconds) <= within
    same = F.coalesce(F.col("next.strong") & (F.col("next.stop") == F.col("own")), F.lit(False))
    outcome = F.when(F.coalesce(timely, F.lit(False)), F.when(same, "confirmed").otherwise("flattened")).otherwise("expired")
    return x.filter(preview).select(key, F.col(id_col).alias("id"), outcome.alias("outcome"), F.when(timely & same, F.col("next.id")).alias("confirmed_by"))


def similarity_gate(vectors: DataFrame, canon: DataFrame, floor: float = 0.40) -> DataFrame:
    """Largest cosine to a canonical vector; ``canon`` is a phrase list, at most a few hundred rows (checked)."""
    if canon.limit(1001).count() > 1000:
        raise ValueError("canonical vectors are a short list; cluster them first")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(a, a)) + 1e-9
    pairs = vectors.join(F.broadcast(canon.select(F.col("embedding").alias("c"))))
    cos = dot(F.col("embedding"), F.col("c")) / (norm(F.col("embedding")) * norm(F.col("c")))
    return pairs.groupBy("vec_id").agg(F.max(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cos))).alias("best")).filter(F.col("best") >= floor)


def confusion_matrix(rows: DataFrame, labels: list, true: str = "y", pred: str = "p") -> DataFrame:
    spark = rows.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], f"{true} {dict(rows.dtypes)[true]}, {pred} {dict(rows.dtypes)[pred]}")
    return grid.join(rows.groupBy(true, pred).agg(F.count("*").alias("c")), [true, pred], "left").select(true, pred, F.coalesce("c", F.lit(0)).alias("n"))


def calibrate_thresholds(scores: DataFrame) -> DataFrame:
    """For each label of (label, score, hit) the first threshold from 0.30 to 0.90 by 0.02 with the best F1.

    Counts come from ``threshold_grid``; hits scored under 0.30 are missed at every threshold.
    """
    total = scores.groupBy("label").agg(F.sum(F.col("hit").cast("long")).alias("pos"))
    at = threshold_grid(scores).join(total.hint("merge"), "label")
    f1 = F.round(2 * F.col("tp") / F.greatest(F.col("n") + F.col("pos"), F.lit(1)), 9)
    best = Window.partitionBy("label").orderBy(F.desc("f1"), "k")
    return at.withColumn("f1", f1).withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("label", F.round(0.30 + 0.02 * F.col("k"), 2).alias("threshold"), F.round("f1", 6).alias("f1"))


def threshold_grid(scores: DataFrame) -> DataFrame:
    """(label, k, tp, n) of (label, score, hit): hits and rows at each threshold 0.30 + 0.02 k, k from 0 to 30.

    Scores are counted by the last step they reach and summed from the top, so rows don't meet thresholds one by one.
    """
    step = F.least(F.lit(30), F.floor(F.round((F.col("score") - 0.30) / 0.02, 6)).cast("int"))
    counts = scores.groupBy("label", step.alias("k")).agg(F.sum(F.col("hit").cast("long")).alias("tp"), F.count("*").alias("n"))
    grid = counts.select("label").distinct().select("label", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("k"))
    down = Window.partitionBy("label").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(counts.hint("merge"), ["label", "k"], "left").na.fill(0, ["tp", "n"])
    return full.select("label", "k", F.sum("tp").over(down).alias("tp"), F.sum("n").over(down).alias("n"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.join(F.broadcast(total)).select(label, F.round(F.col("total") / (F.col("k") * F.col("n")), 6).alias("weight"))


def stable_sample(rows: DataFrame, key: Column, k: int) -> DataFrame:
    return rows.withColumn("h", F.sha2(key, 256)).orderBy("h").limit(k)


def rebalance(rows: DataFrame, negative: Column, ratio: float, key: Column) -> DataFrame:
    """All positives, and negatives up to round(positives x ratio, held to 0.5 to 6) and 6000, by hash order."""
    held = max(0.5, min(6.0, ratio))
    budget = rows.agg(F.greatest(F.lit(1), F.least(F.lit(6000), F.round(F.sum(F.when(negative, 0).otherwise(1)) * held).cast("int"))).alias("b")).first().b
    kept = rows.filter(negative).withColumn("h", F.sha2(key, 256)).orderBy("h").limit(budget).drop("h")
    return rows.filter(~negative).unionByName(kept)


def assign_folds(files: DataFrame, k: int) -> DataFrame:
    """Whole files to k folds, contiguous in hash order. Files (not rows) are ranked: a range sort with offsets."""
    ranked = files.select("file").distinct().withColumn("h", F.sha2(F.col("file").cast("string"), 256))
    # the first byte of the hash splits the ranking into 256 windows with known offsets
    part = ranked.withColumn("p", F.substring("h", 1, 2))
    sizes = part.groupBy("p").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(F.broadcast(sizes.select(F.col("p").alias("q"), F.col("n").alias("m"))), F.col("q") < F.col("p"), "left").groupBy("p").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("before"))
    total = sizes.agg(F.sum("n").alias("total"))
    rank = part.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("h"))).join(F.broadcast(before), "p").join(F.broadcast(total))
    return rank.select("file", F.floor((F.col("r") + F.col("before") - 1) / F.ceil(F.col("total") / k)).cast("int").alias("fold"))


def first_by(rows: DataFrame, keys: list, order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") <= n)


def merge_corpora(corpora: DataFrame) -> DataFrame:
    """Rows (file, line, ordinal, row, ...): a later input wins for a (file, line)."""
    return first_by(corpora, ["file", "line"], [F.desc("ordinal"), F.desc("row")]).drop("rn")
