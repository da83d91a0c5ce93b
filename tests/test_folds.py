"""Ordered folds against plain walks, and sessions too long for an array."""

import random

from pyspark.sql import functions as F

from livetext.operators import ordered as od
from livetext.operators import risk
from livetext.operators.folds import ordered_fold


def test_states_start_anew_with_each_key_and_rows_keep_their_order(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # keys go on from batch to batch
    try:
        rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 2 == 0, "even").alias("g"), F.col("id").alias("at"), (F.col("id") % 5).cast("int").alias("v"))
        step = lambda s, r: ((s or 0) + r.v, ((s or 0) + r.v, f"{r.at}") if r.v else None)
        got = ordered_fold(rows, ["k", "g"], ["at"], ["v"], step, "total long, said string").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, sums = set(), {}
    for i in range(1000):
        key = (i % 3, "even" if i % 2 == 0 else None)
        sums[key] = sums.get(key, 0) + i % 5
        if i % 5:
            want.add((*key, sums[key], str(i)))
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert ordered_fold(rows.filter("at < 0"), ["k", "g"], ["at"], ["v"], lambda s, r: (s, None), "x double").count() == 0


def test_greedy_keeps_equal_a_walk(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.randint(0, 900)) for i in range(600)]
    want = set()
    for key in "ab":
        last = None
        for i, _, t in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            if last is None or t - last > 4:
                want.add((key, i))
                last = t
    data = spark.createDataFrame(rows, "id long, key string, t long")
    assert {tuple(r) for r in od.greedy_keep(data, ["key"], "t", "id", 4).collect()} == want


def test_a_session_of_a_million_rows(spark):
    """One position that is never closed, one island of near rows, one run of repeated intents: none becomes an array."""
    n = 1_000_000
    rows = spark.range(n).withColumn("key", F.lit("hot"))
    kept = od.greedy_keep(rows, ["key"], "id", "id", 9)
    assert kept.agg(F.count("*"), F.max("id")).first() == (n // 10, n - 10)
    i = F.col("id")
    kind = F.when(i == 0, "ENTER").when(i % 2 == 1, "ADD").otherwise("TRIM")
    commands = rows.select("key", "id", kind.alias("kind"), F.lit("LONG").alias("side"), F.lit(1).alias("qty"), F.lit(100.0).alias("price"), F.lit(None).cast("double").alias("stop"))
    ledger = risk.position_ledger(commands, "key", "id")
    assert ledger.agg(F.count("*"), F.min("qty"), F.max("qty"), F.max("avg_price"), F.min(F.col("ok").cast("int"))).first() == (n, 1, 2, 100.0, 1)
    price = F.lit(None).cast("double")
    intents = rows.select("key", (i * 0.5).alias("at"), "id", F.lit("TRIM").alias("tag"), F.lit("LONG").alias("side"), price.alias("entry"), price.alias("stop"), price.alias("target"))
    left = od.suppress_duplicates(intents, "key", "at", "id", F.lit(False))
    assert left.agg(F.count("*"), F.min("id")).first() == (-(-n // 6), 0)  # 2.5 seconds after each kept one
