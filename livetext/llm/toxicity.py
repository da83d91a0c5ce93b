"""Operator 6, toxicity by a classifier chain.

The categories of the label table are predicted in a fixed order. Each is a linear model on the words of the
text, on the probabilities of the categories before it and, for quality, on the text's shape (symbols, capitals, digits, words). In training those probabilities are out of fold: each
labelled row's comes from models fitted without its fold, so a later model learns from probabilities as
uncertain as those it will get. Labels come from the table only.

The models are fitted on a bounded sample: at most ``per_class`` labelled rows with and without the last category,
taken in the order of a hash of the id; only their hashed features go to the driver. Prediction covers the whole text of
every row, however long, in one pass without a shuffle.

Null text is the empty text, whose probabilities are those of no words. Labels that are null are not trained on;
repeated label rows count as repeated rows. Without labelled rows of both kinds a category's probability is the
constant share of its labels (0 without labels). An empty table gives an empty result. Other columns pass through
untouched.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livetext.llm.common import small_batches, table, whole
from livetext.llm.linear import BITS, SHAPES, Scores, apply_logistic, fit_logistic, shape, sparse, text_features

FOLDS = 3
#: Categories that are judged by the shape of a text too; what a text says is judged by its words.
SHAPED = frozenset({"low_quality"})


def _sample(docs: DataFrame, labels: DataFrame, targets: dict, last: str, per_class: int) -> pd.DataFrame:
    """Labels, word features and shape of at most ``2 * per_class`` rows; texts are turned into features in tasks."""
    ids = labels.select(F.col("doc_id").alias("id"), *[t.cast("int").alias(k) for k, t in targets.items()]).dropna()
    order = F.xxhash64("id")
    # the id first: the sample is chosen without texts, which are then joined for its rows only
    chosen = None
    for value in (0, 1):
        part = ids.filter(F.col(last) == value).orderBy(order, "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").alias("id"), whole("text").alias("text"))
    names = ["id", "digest", *targets]

    def encode(batches):
        for batch in batches:
            found = batch.column("text").to_pylist()
            cols = [batch.column(c) for c in names]
            cols += [pa.array([np.array(text_features(t), "<i4").tobytes() for t in found], pa.binary()), pa.array([shape(t) for t in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "features", "shape"])

    schema = ", ".join(["id long, digest long", *[f"`{t}` int" for t in targets], "features binary, shape array<double>"])
    # at most 2 * per_class ids: a proven bound; ids may repeat, so the rows have the same bound
    rows = texts.join(F.broadcast(chosen), "id").select("id", F.xxhash64("text").alias("digest"), *targets, "text")
    found = rows.mapInArrow(encode, schema).orderBy(F.xxhash64("id", "digest"), "id", "digest").limit(2 * per_class)
    return found.toPandas().sort_values(["id", "digest"], kind="stable")


def fit_chain(docs: DataFrame, labels: DataFrame, targets: dict, per_class: int = 2000) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word weights, (shape, earlier probabilities, bias) weights) of each category in order; ``targets`` maps names to
    conditions."""
    last = list(targets)[-1]
    rows = _sample(docs, labels, targets, last, per_class)
    starts, idx = sparse([np.frombuffer(x, "<i4") for x in rows.pop("features")])
    n = len(rows)
    fold = np.arange(n) % FOLDS
    models, before = [], np.array(rows["shape"].tolist(), float).reshape(n, len(SHAPES))

    def part(mask):
        at = np.nonzero(mask)[0]
        lengths = np.diff(starts)[at]
        take = np.concatenate([idx[starts[k] : starts[k + 1]] for k in at]) if len(at) else idx[:0]
        return np.concatenate([[0], np.cumsum(lengths)]), take

    for name in targets:
        y = rows[name].to_numpy(float)
        if n == 0 or y.min() == y.max():
            share = float(y.mean()) if n else 0.0
            odds = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
            models.append((np.zeros(1 << BITS), np.append(np.zeros(before.shape[1]), odds)))
            before = np.column_stack([before, np.full(n, share)])
            continue
        unused = 0 if name in SHAPED else len(SHAPES)  # weights of columns that this category doesn't read stay zero
        w, v = fit_logistic(starts, idx, before[:, unused:], y)
        models.append((w, np.concatenate([np.zeros(unused), v])))
        if name == last:
            break
        out = np.zeros(n)
        for k in range(FOLDS):
            held = fold == k
            if held.all() or not held.any():
                continue
            w, v = fit_logistic(*part(~held), before[~held, unused:], y[~held])
            out[held] = apply_logistic(*part(held), before[held, unused:], w, v)
        before = np.column_stack([before, out])
    return models


@functools.lru_cache(maxsize=2)
def _scores(_name: str, shared):
    return Scores(shared.value)


def chain_probabilities(docs: DataFrame, models: list, names: list[str], text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct of each category's probability. The weights are 2^18 numbers a category: a fixed size."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(np.column_stack([w for w, _ in models]).astype(np.float32))
    extra = [v for _, v in models]
    name = uuid.uuid4().hex

    @F.pandas_udf(", ".join(f"{c} double" for c in names))
    def predict(texts: pd.Series) -> pd.DataFrame:
        scores = _scores(name, shared)
        z = np.array([scores.text(t) for t in texts]).reshape(len(texts), len(names))
        known = np.array([shape(t) for t in texts]).reshape(len(texts), len(SHAPES))
        for k, v in enumerate(extra):
            p = 1 / (1 + np.exp(-np.clip(z[:, k] + known @ v[:-1] + v[-1], -30, 30)))
            known = np.column_stack([known, p])
        return pd.DataFrame(known[:, len(SHAPES) :], columns=names)

    return docs.withColumn(out, predict(whole(text_col)))


THRESHOLD = 0.5


def _targets() -> dict:
    """Categories of the label table in chain order; the last decides."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def score_documents(spark: SparkSession, docs: DataFrame, sf_dir: str, out: str) -> DataFrame:
    """``docs`` with the chain's probabilities, fitted on the labelled rows of the corpus."""
    models = fit_chain(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _targets())
    return chain_probabilities(docs, models, list(_targets()), out=out)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir, "p")
    return scored.select("doc_id", F.col("p.low_quality").alias("p_low_quality"), F.col("p.toxic").alias("p_toxic")).withColumn("toxic", F.col("p_toxic") >= THRESHOLD)
