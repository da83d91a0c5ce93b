"""Fits that see no held-out row: vocabularies by fold, calibration by inner folds."""

import random

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from livetext.operators import learning as ml


def test_a_folds_vocabulary_comes_from_the_others(spark):
    rows = [(k, f"shared words fold{k % 3} only{k % 3} shared", k % 3) for k in range(30)] + [(99, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fold int")
    found = ml.fold_vocabularies(ml.term_counts(docs, "doc_id", "text", "fold"), docs, 100).collect()
    terms = {k: {r.term: r for r in found if r.fold == k} for k in range(3)}
    for k in range(3):
        assert f"fold{k}" not in terms[k] and "shared words" in terms[k] and all(f"only{j}" in terms[k] for j in range(3) if j != k)
        assert sorted(r.k for r in terms[k].values()) == list(range(len(terms[k])))
    import math

    assert abs(terms[0]["shared"].idf - (math.log(21 / 21) + 1)) < 1e-12 and abs(terms[1]["fold0"].idf - (math.log(22 / 11) + 1)) < 1e-12
    few = ml.fold_vocabularies(ml.term_counts(docs, "doc_id", "text", "fold"), docs, 2).collect()
    assert sorted((r.fold, r.k) for r in few) == [(f, k) for f in range(3) for k in range(2)]


def noise(spark, n=60, d=40):
    rng = random.Random(4)
    rows = [(k, "a" if rng.random() < 0.5 else "b", [rng.gauss(0, 1) for _ in range(d)]) for k in range(n)]
    return spark.createDataFrame(rows, "id long, label string, x array<double>").withColumn("features", array_to_vector("x")).coalesce(1)


def test_margins_come_from_models_of_other_rows(spark):
    """Labels without any meaning: a model tells its own rows apart, but not those of its held-out fold."""
    data, _ = ml.balanced(noise(spark))
    data, folds = ml.inner_folds(data)
    data = data.cache()
    assert folds == 5 and {r["count"] for r in data.groupBy("inner").count().collect()} <= set(range(4, 25))
    from pyspark.ml.classification import LinearSVC

    right = seen = total = 0
    for k in range(folds):
        model = LinearSVC(labelCol="y", maxIter=15, regParam=0.0).fit(data.filter(F.col("inner") != k))
        out = ml.held_out_margins(model, data, k)
        assert out.filter(F.col("inner") != k).count() == 0
        sign = F.get(ml.vector_to_array("margins"), F.lit(1)) > 0
        right += out.filter(sign == (F.col("y") == 1)).count()
        total += out.count()
        seen += model.transform(data.filter(F.col("inner") != k)).filter("prediction = y").count()
    assert total == 60 and right < 45 and seen > 220
    data.unpersist()


def test_calibrated_models_and_single_rows(spark):
    rows = [(k, "xyz"[k % 3], [float(k % 3 == j) + 0.01 * k for j in range(3)]) for k in range(30)]
    data = spark.createDataFrame(rows, "id long, label string, x array<double>").withColumn("features", array_to_vector("x"))
    model = ml.fit_linear_svm(data.coalesce(1).cache(), steps=8, inner=3)
    assert isinstance(model, ml.Ensemble) and len(model.members) == 3
    assert model.predict(data).filter("label = p").count() >= 28
    single = data.filter("id < 4").union(data.filter("id = 5").withColumn("label", F.lit("alone")))
    assert isinstance(ml.fit_linear_svm(single.coalesce(1), steps=3), ml.Fitted)


def test_a_normalised_vector_costs_no_power_of_its_length(spark):
    """Means and spreads in a function of each entry took the cube of the length: 20 million steps a vector here."""
    import time

    rng = random.Random(6)
    rows = [(k, [rng.gauss(3, 2) for _ in range(768)]) for k in range(40)]
    data = spark.createDataFrame(rows, "id long, x array<float>").coalesce(1)
    began = time.time()
    got = {r.id: list(r.v) for r in data.select("id", ml.layer_norm(F.col("x")).alias("v")).collect()}
    assert time.time() - began < 20
    for k, x in rows:
        mean = sum(x) / 768
        spread = (sum((e - mean) ** 2 for e in x) / 768 + 1e-5) ** 0.5
        assert all(abs(g - (e - mean) / spread) < 1e-5 for g, e in zip(got[k], x, strict=True))


def test_leading_terms_are_exact_without_a_count_of_all(spark, monkeypatch):
    """With few buckets, and bounds from a few documents, a third of them odd, all first places are still right."""
    rng = random.Random(9)
    rows = [(k, k % 3, "odd odder" if k < 20 else " ".join(f"w{int(rng.paretovariate(0.6)) % 4000}" for _ in range(40))) for k in range(600)] + [(700, 1, None), (701, 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, fold int, text string").coalesce(2)
    monkeypatch.setattr(ml, "BUCKETS", 5000)
    monkeypatch.setattr(ml, "FIRST", 60)
    want = {}
    for _, _, text in rows:
        w = (text or "").split()
        for t in {*w, *map(" ".join, zip(w, w[1:], strict=False))}:
            want[t] = want.get(t, 0) + 1
    first = sorted(want, key=lambda t: (-want[t], t))[:50]
    assert [r.term for r in ml.vocabulary(docs, "text", 50).orderBy("k").collect()] == first
    found = ml.leading_terms(docs, "text", 50, {"df": F.lit(True)})
    assert found.count() < len(want) * 0.8
    # a fold's vocabulary as by the table of all counts
    plain = ml.fold_vocabularies(ml.term_counts(docs, "doc_id", "text", "fold"), docs, 50)
    both = [sorted((r.fold, r.k, r.term, round(r.idf, 9)) for r in x.select("fold", "k", "term", "idf").collect()) for x in (plain, ml.vocabularies_without(docs, "text", 50))]
    assert both[0] == both[1] and len(both[0]) == 150


def test_features_are_made_without_a_row_for_each_word(spark):
    """Counted where a text is read: no join or shuffle of terms; the vectors equal the weights, texts without terms have none."""
    docs = spark.createDataFrame([(1, "the cat the hat cat"), (2, None), (3, "zzz"), (4, "hat the")], "doc_id long, text string").coalesce(1)
    terms = ml.vocabulary(docs, "text", 4)
    data = ml.vectors(docs, "doc_id", "text", terms, 4)
    got = {(r.doc_id, k): round(float(w), 9) for r in data.collect() for k, w in zip(r.features.indices, r.features.values, strict=True)}
    want = {(r.doc_id, r.k): round(r.weight, 9) for r in ml.tfidf_features(docs, "doc_id", "text", terms).collect()}
    assert got == want and {k for k, _ in got} == {1, 4} and data.count() == 4 and {len(r.features) for r in data.collect()} == {4}
    plan = data._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_terms_are_counted_in_their_tasks(spark):
    """No row for each word of each text, neither for terms nor for features, and no written table but the first holds a text."""
    docs = spark.createDataFrame([(1, "the cat the hat cat"), (2, None), (3, "zzz"), (4, "")], "doc_id long, text string").coalesce(1)
    plan = ml.leading_terms(docs, "text", 4, {"df": F.lit(True)})._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "text" not in ml.vectors(docs, "doc_id", "text", ml.vocabulary(docs, "text", 4), 4).columns


def test_runs_of_words_by_brute_force(monkeypatch):
    """Texts in small slices, empty and null ones, repeats; runs of up to three words."""
    from collections import Counter

    import pyarrow as pa

    from livetext.operators import grams

    monkeypatch.setattr(grams, "CHUNK", 60)
    rng = random.Random(3)
    texts = [None, ""[:0] or None, "é é é", *[" ".join(rng.choice("a b é dd".split()) for _ in range(rng.randint(1, 30))) for _ in range(40)]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([True] * len(texts))], ["id", "t", "n"])
    runs = lambda t: [" ".join(w[k : k + n]) for w in [(t or "").split()] for n in (1, 2, 3) for k in range(len(w) - n + 1)]
    want, got = Counter(x for t in texts for x in set(runs(t))), Counter()
    for out in grams.term_counts("t", ["n"], (1, 2, 3), None)(iter([batch])):
        got.update(dict(zip(out.column("term").to_pylist(), out.column("n").to_pylist(), strict=True)))
    assert got == want
    terms = ["a", "é é", "nowhere", "b dd a", "dd"]
    found = [r for out in grams.known_counts("t", terms)(iter([batch])) for r in out.to_pylist()]
    assert [r["id"] for r in found] == list(range(len(texts))) and len(list(grams.chunks(iter([batch]), "t"))) > 10
    for r in found:
        held = Counter(runs(texts[r["id"]]))
        assert dict(zip(r["counts"]["indices"], r["counts"]["values"], strict=True)) == {k: held[t] for k, t in enumerate(terms) if held[t]}
    totals = list(grams.bucket_counts("t", ["n"], (1, 2), 7, ["a", "é é"])(iter([batch])))
    assert sum(totals[0].column("n").to_pylist()) == sum(n for t, n in want.items() if t.count(" ") < 2) and totals[1].column("n").to_pylist() == [want["a"], want["é é"]]


def test_a_rows_hash_is_computed_once(spark):
    data, _ = ml.inner_folds(ml.balanced(noise(spark))[0])
    assert data._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") == 1


def test_weights_of_all_terms_by_brute_force(spark, monkeypatch):
    """More terms than any vocabulary was cut to, in many groups; rows of one id are one text, and runs don't cross them."""
    import math
    from collections import Counter

    rng = random.Random(11)
    rows = [(k // 2 if k < 20 else k, " ".join(f"w{rng.randint(0, 900)}" for _ in range(rng.randint(1, 60)))) for k in range(150)] + [(500, None), (501, "! a"), (502, "Éa éa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ml, "GROUP", 2000)
    held = {}
    for key, text in rows:
        w = [x for x in (text or "").lower().split() if len(x) > 1]
        held.setdefault(key, Counter()).update([*w, *map(" ".join, zip(w, w[1:], strict=False))])
    df = Counter(t for c in held.values() for t in c)
    want = {}
    for key, c in held.items():
        raw = {t: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        want |= {(key, t): round(x / norm, 9) for t, x in raw.items()}
    found = ml.tfidf_features(docs, "doc_id", "text").collect()
    assert len(df) > 3000 and len(found) == len(want) and {(r.doc_id, r.term): round(r.weight, 9) for r in found} == want
    assert ml.tfidf_features(docs.filter("doc_id >= 500 and doc_id < 502"), "doc_id", "text").count() == 0


def test_a_features_query_cuts_no_term_off(spark):
    from livetext.plans.learning import tfidf_features

    assert tfidf_features(spark, "/root/testdata/sf0.001").select("term").distinct().count() > 50000


def test_an_ablation_goes_up_to_the_largest_vocabulary(spark):
    """The sizes of the reference; a vocabulary's features are not written for each size and fold."""
    from livetext.plans import learning

    rows = {r["size"]: r for r in learning.vocab_ablation(spark, "/root/testdata/sf0.001").collect()}
    assert sorted(rows) == [5_000, 10_000, 20_000, 50_000] and all(r.accuracy > 0.8 for r in rows.values())


def test_features_are_made_where_they_are_read(spark):
    docs = spark.createDataFrame([(1, "the cat the hat cat"), (2, None), (3, "zzz"), (4, "hat the")], "doc_id long, text string").coalesce(1)
    rows = ml.counted(docs, "text", ["hat", "the", "cat"])
    data = ml.featured(rows, [2, None, 0], [1.5, None, 2.0], 3)
    got = {r.doc_id: r.features for r in data.collect()}
    a, b = 1.0 * 1.5, (1 + 0.6931471805599453) * 2.0
    norm = (a * a + b * b) ** 0.5
    assert list(got[1].indices) == [0, 2] and abs(got[1].values[0] - b / norm) < 1e-12 and abs(got[1].values[1] - a / norm) < 1e-12
    assert len(got[2].indices) == len(got[3].indices) == 0 and got[2].size == 3 and list(got[4].indices) == [2]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan(data) and "ArrowEvalPython" not in plan(data.groupBy("doc_id").count())


def test_a_networks_gradient_is_its_losss_slope(monkeypatch):
    """By differences of the loss, in small blocks; a row that counts twice equals two rows."""
    import numpy as np
    import pyarrow as pa

    from livetext.operators import network

    monkeypatch.setattr(network, "BLOCK", 3)
    rng, sizes = np.random.default_rng(5), [6, 4, 3, 2]
    lists = [([0, 2], [0.6, 0.8]), ([], []), ([5], [1.0]), ([1, 2, 3], [0.1, 0.7, 0.7]), ([0, 5], [0.6, 0.8])]
    features = pa.array([dict(type=0, size=6, indices=i, values=v) for i, v in lists], pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]))
    y, w = np.array([0, 1, 1, 0, 1]), network.started(sizes, 3) + rng.normal(0, 0.1, len(network.started(sizes, 3))).astype(np.float32)

    class Sent:
        def __init__(self, value):
            self.value = value

    def loss(w, features, y, times):
        batch = pa.RecordBatch.from_arrays([features, pa.array(y), pa.array(times)], ["features", "y", "times"])
        out = pa.Table.from_batches(network.gradients(Sent(w), sizes)(iter([batch]))).to_pylist()
        return sum(r["loss"] for r in out), np.concatenate([np.frombuffer(r["gradient"], np.float32) for r in out])

    times = np.array([1.0, 2.0, 1.0, 3.0, 1.0])
    total, grad = loss(w, features, y, times)
    for k in rng.choice(len(w), 25, replace=False):
        up, down = w.copy(), w.copy()
        up[k] += 1e-2
        down[k] -= 1e-2
        slope = (loss(up, features, y, times)[0] - loss(down, features, y, times)[0]) / 2e-2
        assert abs(slope - grad[k]) < 2e-2
    again = np.repeat(np.arange(5), times.astype(int))
    repeated = loss(w, features.take(pa.array(again)), y[again], np.ones(len(again)))
    assert abs(repeated[0] - total) < 1e-4 and np.allclose(repeated[1], grad, atol=1e-4)
    # a convex function: the smallest point
    found = network.descend(lambda x: (float(((x - 3) ** 2 * np.array([1, 10])).sum()), (2 * (x - 3) * np.array([1, 10])).astype(np.float32)), np.zeros(2, np.float32), 30)
    assert np.allclose(found, 3, atol=1e-2)


def test_a_networks_query_has_the_whole_network(spark, monkeypatch):
    """Vocabulary and layers of the reference; no row is repeated."""
    from livetext.plans import learning

    seen = []
    monkeypatch.setattr(ml.network, "fit", lambda rows, sizes, steps, seed: seen.append((rows, sizes, steps)) or ml.network.started(sizes, seed))
    assert learning.fit_mlp(spark, "/root/testdata/sf0.001").count() == 200
    rows, sizes, steps = seen[0]
    assert sizes[:3] == [20_000, 256, 128] and steps == 30 and rows.count() == 200 and rows.select("features").first()[0].size == 20_000
