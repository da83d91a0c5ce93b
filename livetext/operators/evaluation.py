"""Evaluation: metrics from counts, paired tests over folds, reports by file, splits by group."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def label_metrics(rows: DataFrame, labels: list, true: str = "y", pred: str = "p", by: list[str] = ()) -> DataFrame:
    """(by, label, precision, recall, f1, support), unrounded, from one pass of counts; denominators are at least 1."""
    hit = rows.groupBy(*by, true, pred).agg(F.count("*").alias("n"))
    of = lambda x: F.struct(F.lit(x).alias("label"), F.when(F.col(true) == x, F.col("n")).otherwise(0).alias("t"), F.when(F.col(pred) == x, F.col("n")).otherwise(0).alias("p"), F.when((F.col(true) == x) & (F.col(pred) == x), F.col("n")).otherwise(0).alias("tp"))
    each = hit.select(*by, F.explode(F.array(*[of(x) for x in labels])).alias("s")).select(*by, "s.*")
    sums = each.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("t", "p", "tp")])
    precision, recall = F.col("tp") / F.greatest("p", F.lit(1)), F.col("tp") / F.greatest("t", F.lit(1))
    return sums.select(*by, "label", precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"), F.col("t").alias("support"))


def classification_metrics(rows: DataFrame, labels: list, true: str = "y", pred: str = "p") -> DataFrame:
    """Precision, recall, F1 and support of each label, to four places."""
    return label_metrics(rows, labels, true, pred).select("label", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support")


def overall_metrics(rows: DataFrame, labels: list, none, true: str = "y", pred: str = "p", by: list[str] = ()) -> DataFrame:
    """Accuracy, macro F1, and precision, recall and F1 of "some action" against ``none``, to four places."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    act = lambda c: F.col(c).isin([x for x in labels if x != none])
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), count(F.col(true) == F.col(pred)).alias("same"), count(act(true) & act(pred)).alias("tp"), count(~act(true) & act(pred)).alias("fp"), count(act(true) & ~act(pred)).alias("fn"))
    macro = label_metrics(rows, labels, true, pred, by).groupBy(*by).agg((F.sum("f1") / len(labels)).alias("macro"))
    both = sums.join(macro.hint("merge"), list(by)) if by else sums.join(F.broadcast(macro))  # one row each without groups
    precision, recall = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
    made = {"accuracy": F.col("same") / F.greatest(F.lit(1), F.col("n")), "macro_f1": F.col("macro"), "action_precision": precision, "action_recall": recall, "action_f1": _f1(precision, recall)}
    return both.select(*by, *[F.round(c, 4).alias(k) for k, c in made.items()])


METRICS = ["accuracy", "macro_f1", "action_precision", "action_recall", "action_f1"]


def cv_summary(predictions: DataFrame, labels: list, none, fold: str = "fold") -> DataFrame:
    """(metric, mean, std, pooled, folds): mean and sample deviation over folds, and the metric of all rows together."""
    of_fold = overall_metrics(predictions, labels, none, by=[fold]).unpivot([fold], METRICS, "metric", "value")
    pooled = overall_metrics(predictions, labels, none).unpivot([], METRICS, "metric", "pooled")
    stats = of_fold.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std"), F.count("*").alias("folds"))
    return stats.join(F.broadcast(pooled), "metric").select("metric", "mean", "std", "pooled", "folds")


def sample_weights(rows: DataFrame, weights: dict[str, float], label: str, source: str, none: str) -> DataFrame:
    """``rows`` with ``weight``: its source's weight, 1 for rows without an action, scaled to mean 1."""
    known = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    raw = F.when(F.col(label) == none, 1.0).otherwise(F.coalesce(F.element_at(known, F.col(source)), F.lit(1.0)))
    mean = rows.agg(F.avg(raw).alias("mean"))
    return rows.withColumn("raw", raw).join(F.broadcast(mean)).withColumn("weight", F.col("raw") / F.col("mean")).drop("raw", "mean")  # one row


def tfidf_stats(docs: DataFrame, text: str, top: int, sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(term, df, idf) of the ``top`` commonest runs of one or two words (two letters or more each); smooth idf."""
    from livetext.operators.learning import leading_terms

    found = leading_terms(docs, text, top, {"df": F.lit(True)}, sizes)
    best = found.orderBy(F.desc("df"), "term").limit(top)
    n = docs.agg(F.count("*").alias("n"))
    return best.join(F.broadcast(n)).select("term", "df", F.round(F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1, 6).alias("idf"))  # one row


def error_patterns(rows: DataFrame, true: str, pred: str, id_col: str, top: int = 20, examples: int = 3) -> DataFrame:
    """The commonest confusions with their first examples."""
    wrong = rows.filter(F.col(true) != F.col(pred)).select(F.concat_ws(" -> ", true, pred).alias("pattern"), id_col)
    ranked = wrong.withColumn("rn", F.row_number().over(Window.partitionBy("pattern").orderBy(id_col)))
    found = ranked.groupBy("pattern").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("rn") <= examples, F.col(id_col)))).alias("examples"))
    return found.orderBy(F.desc("n"), "pattern").limit(top)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_critical(df: float, p: float = 0.05) -> float:
    """The t whose two-sided p is ``p``, by bisection."""
    low, high = 0.0, 1e4
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if t_p_value(mid, df) > p else (low, mid)
    return (low + high) / 2


def paired_t(folds: DataFrame) -> DataFrame:
    """For each pair of models over (model, fold, value): mean difference, t, p and 95 % interval.

    No variance or a single fold gives t 0, p 1 and an interval of one point. The distribution's values are computed for
    one row a pair of models.
    """
    a = folds.select("fold", F.col("model").alias("model_a"), F.col("value").alias("va"))
    b = folds.select("fold", F.col("model").alias("model_b"), F.col("value").alias("vb"))
    d = a.join(b, "fold").filter("model_a < model_b").withColumn("d", F.col("va") - F.col("vb"))
    g = d.groupBy("model_a", "model_b").agg(F.avg("d").alias("m"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("s"), F.count("*").alias("n"))

    @F.pandas_udf("t double, p double, crit double")
    def student(m: pd.Series, s: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = []
        for mean, spread, k in zip(m, s, n, strict=True):
            t = mean / (spread / math.sqrt(k)) if spread > 0 else 0.0
            rows.append((t, t_p_value(t, k - 1), t_critical(k - 1)) if spread > 0 else (0.0, 1.0, 0.0))
        return pd.DataFrame(rows, columns=["t", "p", "crit"])

    x = g.withColumn("x", student("m", "s", "n"))
    half = F.col("x.crit") * F.col("s") / F.sqrt("n")
    return x.select("model_a", "model_b", F.round("m", 4).alias("mean_difference"), F.round("x.t", 4).alias("t_statistic"), F.round("x.p", 4).alias("p_value"), F.round(F.col("m") - half, 4).alias("ci_lower"), F.round(F.col("m") + half, 4).alias("ci_upper"), (F.col("x.p") < 0.05).alias("significant"), F.col("n").alias("n_folds"))


def file_report(intents: DataFrame, file: str, order: str, tag: str, suspicious: Column, first: int = 5, most: int = 5, listed: str | None = None) -> DataFrame:
    """(file, intents, counts, first_hits, n_suspicious, suspicious): tags by count as sorted entries, the first hits and the
    first suspicious ones, as their tags or the column ``listed``; files with most suspicious hits first."""
    w = Window.partitionBy(file).orderBy(order)
    rows = intents.withColumn("bad", suspicious).withColumn("rn", F.row_number().over(w)).withColumn("brn", F.sum(F.col("bad").cast("int")).over(w))
    tags = rows.groupBy(file, tag).agg(F.count("*").alias("n")).groupBy(file).agg(F.array_sort(F.collect_list(F.struct(F.col(tag).alias("tag"), "n"))).alias("counts"))
    hits = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct(order, F.col(listed or tag).alias("hit"))))), lambda x: x["hit"])
    some = rows.groupBy(file).agg(F.count("*").alias("intents"), hits(F.col("rn") <= first).alias("first_hits"), F.sum(F.col("bad").cast("long")).alias("n_suspicious"), hits(F.col("bad") & (F.col("brn") <= most)).alias("suspicious"))
    return some.join(tags.hint("merge"), file).select(file, "intents", "counts", "first_hits", "n_suspicious", "suspicious").orderBy(F.desc("n_suspicious"), F.desc("intents"), file)


def aggregate_reports(reports: DataFrame, group: list[str], order: str, header: list[str], counts: str) -> DataFrame:
    """Reports merged by group: the first header values that are not null, and the sums of ``counts`` (label, n) by label."""
    head = reports.groupBy(*group).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in header], F.count("*").alias("files"))
    by = reports.select(*group, F.explode(counts).alias("c")).groupBy(*group, F.col("c.label").alias("label")).agg(F.sum("c.n").alias("n"))
    sums = by.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("counts"), F.sum("n").alias("example_count"))
    return head.join(sums.hint("merge"), group, "left")


def annotation_report(lines: DataFrame, chunks: DataFrame, annotations: DataFrame, results: DataFrame) -> DataFrame:
    """For each file of ``lines``: rows, chunks, annotations, and its errors in chunk order."""
    count = lambda df, name: df.groupBy("file").agg(F.count("*").alias(name))
    error = F.when(F.col("error").isNotNull(), F.struct("chunk", F.format_string("chunk %d: %s", F.col("chunk"), F.col("error")).alias("text")))
    errors = results.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(error)), lambda x: x["text"]).alias("errors"))
    out = count(lines, "total_rows")
    for part in (count(chunks.select("file", "chunk").distinct(), "chunk_count"), count(annotations, "annotations"), errors):
        out = out.join(part.hint("merge"), "file", "left")
    return out.na.fill(0, ["chunk_count", "annotations"]).withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))


def split_by_group(rows: DataFrame, file: str, action: Column, date: Column | None, test_files: int, validation_ratio: float) -> DataFrame:
    """(file, split): whole files to test, validation and train.

    Files stand in hash order, or by date (last ones first) where one is given. Test takes the first files with actions (any
    files if none has), then validation its share of the rest, again files with actions first; at least two files stay.
    The ranking is over one row a file.
    """
    by_date = date is not None
    files = rows.groupBy(file).agg(F.max(action.cast("int")).alias("act"), *([F.max(date).alias("day")] if by_date else []))
    files = files.withColumn("h", F.sha2(F.col(file).cast("string"), 256))
    order = [F.desc_nulls_last("day"), F.desc(F.col(file))] if by_date else [F.col("h")]
    n, n_act = files.agg(F.count("*"), F.coalesce(F.sum("act"), F.lit(0))).first()
    wanted = min(max(0, test_files), max(0, n - 2))
    tested = min(wanted, n_act or n)
    left = n - tested
    share = max(0.05, min(0.45, validation_ratio))
    held = max(1, min(round(left * share), left - 1)) if left >= 2 else 0
    first = files.orderBy(F.desc("act"), *order).limit(tested).select(file).withColumn("split", F.lit("test"))
    rest = files.join(F.broadcast(first.select(file)), file, "left_anti")  # at most ``test_files`` rows
    # validation takes from the end by date as from the start by hash: files with actions come first in hash order, last by date
    second = rest.orderBy(F.col("act") if by_date else F.desc("act"), *order).limit(held).select(file).withColumn("split", F.lit("validation"))
    taken = first.unionByName(second)
    return files.select(file).join(taken.hint("merge"), file, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def split_summary(rows: DataFrame, splits: DataFrame, file: str) -> DataFrame:
    """Files and rows of each split."""
    return rows.join(splits.hint("merge"), file).groupBy("split").agg(F.count_distinct(file).alias("files"), F.count("*").alias("n"))


def coverage_report(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file, lines, covered, chunks): whether every line lies in a chunk."""
    held = chunks.groupBy("file", "line").agg(F.count("*").alias("times"))
    seen = lines.select("file", "line").join(held.hint("merge"), ["file", "line"], "left")
    number = chunks.groupBy("file").agg(F.count_distinct("chunk").alias("chunks"))
    sums = seen.groupBy("file").agg(F.count("*").alias("lines"), F.count("times").alias("covered"))
    return sums.join(number.hint("merge"), "file", "left").na.fill(0, ["chunks"])
