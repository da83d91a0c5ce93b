"""External classifiers on Spark: a hook that scores rows in batches of bounded size, and its way into the classifier's gate."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels that stand for no action.
NON_ACTION = ("NO_ACTION", "SETUP_LONG", "SETUP_SHORT")

#: Called once a task that has rows; what it returns takes some rows and returns their probabilities, one column a label.
Loader = Callable[[], Callable[[pd.DataFrame], np.ndarray]]


def score_fn(rows: DataFrame, id_cols: list[str], inputs: list[str], load: Loader, labels: list[str], batch: int = 256) -> DataFrame:
    """(id columns, ``probs``): the probabilities of ``labels`` for each row, in their order.

    The scorer gets only the ``inputs`` columns, at most ``batch`` rows at a time, so its memory has a bound whatever the size of a
    partition. It is loaded in the task, not sent from the driver, and only where there are rows. A row whose inputs are all null is
    not sent; its probabilities are null. A result of another shape, or with a number outside 0 to 1 or none, is an error, since a gate
    would read it silently. Rows come back once each, repeated ids too.
    """
    if len(set(labels)) != len(labels) or not labels or batch < 1:
        raise ValueError("labels must be distinct and not empty, and a batch holds a row or more")
    kinds = dict(rows.select(*id_cols, *inputs).dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in id_cols], "`probs` array<double>"])

    def scored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None
        for part in parts:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                told = some[inputs].notna().any(axis=1).to_numpy()
                probs = np.full(len(some), None, dtype=object)
                if told.any():
                    scorer = scorer or load()
                    made = np.asarray(scorer(some.loc[told, inputs].reset_index(drop=True)), dtype=float)
                    if made.shape != (int(told.sum()), len(labels)):
                        raise ValueError(f"the scorer gave {made.shape} for {int(told.sum())} rows and {len(labels)} labels")
                    if not ((made >= 0) & (made <= 1)).all():
                        raise ValueError("the scorer gave a probability outside 0 to 1")
                    for k, row in zip(np.flatnonzero(told), made, strict=True):
                        probs[k] = row
                yield some[id_cols].assign(probs=probs)

    return rows.select(*id_cols, *inputs).mapInPandas(scored, schema)


def gate_scores(probs: Column, labels: list[str], tag: Column, thresholds: Mapping[str, float], fallback: float = 0.7) -> list[Column]:
    """What ``classifier_gate`` reads of a row's probabilities: p (of its tag), p_none (of all labels for no action), guess and p_guess
    (the likeliest action; the first of equals) and threshold (of the tag, or else of the guess)."""
    at = lambda names: F.array(*[F.struct(F.get(probs, labels.index(x)).alias("p"), F.lit(-labels.index(x)).alias("k"), F.lit(x).alias("l")) for x in names])
    actions = [x for x in labels if x not in NON_ACTION]
    none = [x for x in labels if x in NON_ACTION]
    best = F.array_max(at(actions)) if actions else F.struct(F.lit(None).cast("double").alias("p"), F.lit(None).cast("string").alias("l"))
    of = F.filter(at(labels), lambda x: x["l"] == tag)
    p_none = sum((F.get(probs, labels.index(x)) for x in none), F.lit(0.0))
    limits = F.create_map(*[F.lit(v) for kv in thresholds.items() for v in kv]) if thresholds else F.create_map().cast("map<string,double>")
    known = probs.isNotNull()
    guess = F.when(known, best["l"])
    threshold = F.coalesce(F.try_element_at(limits, F.coalesce(tag, guess, F.lit(""))), F.lit(fallback))
    return [
        F.when(tag.isNotNull() & known, F.coalesce(F.get(of, 0)["p"], F.lit(0.0))).alias("p"),
        F.when(known, p_none).alias("p_none"),
        guess.alias("guess"),
        F.when(known, best["p"]).alias("p_guess"),
        threshold.alias("threshold"),
    ]


def gated(intents: DataFrame, scores: DataFrame, id_cols: list[str], labels: list[str], thresholds: Mapping[str, float], fallback: float = 0.7) -> DataFrame:
    """``intents`` (ids, tag, strong and what else there is) through ``classifier_gate`` with the scores of ``score_fn``, one a key.
    An intent without a score stays as it is."""
    from livetext.operators.cascade import classifier_gate

    # a Python function's output has no true size, so the strategy is set
    x = intents.join(scores.select(*id_cols, "probs").hint("merge"), id_cols, "left")
    x = x.select(*intents.columns, *gate_scores(F.col("probs"), labels, F.col("tag"), thresholds, fallback))
    return classifier_gate(x)
