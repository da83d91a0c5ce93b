"""Instruments of a text, external scorers and the hub: cases, brute force, and snapshot plus deltas."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from livetext.operators import instruments as ins
from livetext.operators import learning as ml
from livetext.operators import scoring as sc
from livetext.plans import learning
from livetext.streaming import hub
from livetext.streaming import sessions as st
from tests.test_streaming import drain, feed

DIR = "/root/testdata/sf0.001"


def scopes(spark, texts, root="NQ", **more):
    rows = spark.createDataFrame([(k, root, t) for k, t in enumerate(texts)], "id int, root string, text string")
    others = spark.createDataFrame([(x,) for x in [*ins.OTHER_INSTRUMENTS, "crude oil", "crude oil mini future"]], "alias string")
    got = ins.symbol_scope(rows, "id", "text", "root", ins.known_aliases(spark), others, **more).collect()
    return {r.id: (r.own, r.named, r.inline, r.context, r.foreign) for r in got}


def test_own_named_inline_and_context(spark):
    texts = {
        "long nq here and mnq too": (True, None, None, False, None),
        "watching gold": (False, "gold", None, False, "gold"),
        "nq follows tsla and amd": (True, "tsla", None, False, "tsla"),
        "crude oil is up": (False, "crude oil", None, False, "crude oil"),
        "crude oil mini future and oil": (False, "crude oil mini future", None, False, "crude oil mini future"),
        "crude oil mini futures": (False, "crude oil", None, False, "crude oil"),
        "i m long in apple today": (False, None, "apple", False, "apple"),
        "i m long in it but got short in tesla": (False, None, "tesla", False, "tesla"),
        "i am long in nq": (True, None, None, False, None),
        "adding to my swings in amd": (False, "amd", None, True, "swing_context"),
        "goldman and oils": (False, None, None, False, None),
        "": (False, None, None, False, None),
        None: (False, None, None, False, None),
    }
    assert scopes(spark, texts) == dict(enumerate(texts.values()))


def test_an_alias_of_the_root_is_not_foreign(spark):
    assert scopes(spark, ["crude is up", "crude oil is up", "oil"], root="CL") == {
        0: (True, None, None, False, None),
        1: (False, "crude oil", None, False, "crude oil"),  # the longer name is another one
        2: (True, None, None, False, None),
    }
    assert scopes(spark, ["gold", "nq"], root=None) == {0: (False, "gold", None, False, "gold"), 1: (False, None, None, False, None)}


def test_symbol_roots(spark):
    got = spark.createDataFrame([("MNQZ5",), ("@es",), ("123",), (None,), ("abcdefgh",)], "s string").select(ins.symbol_root(F.col("s")).alias("r")).collect()
    assert [r.r for r in got] == ["MNQZ", "ES", None, None, "ABCDE"]
    roots = spark.createDataFrame([("NQ",), ("ZB",), (None,), ("ZB",)], "root string")
    rows = ins.known_aliases(spark, roots).collect()
    assert sum(r.root == "ZB" for r in rows) == 1 and sum(r.root == "NQ" for r in rows) == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    phrase = lambda most: " ".join(rng.choice("abc") for _ in range(rng.randint(1, most)))
    aliases, texts = sorted({phrase(4) for _ in range(8)}), [phrase(30) for _ in range(60)]

    def brute(text):
        words, found = text.split(), []
        for s in range(len(words)):
            found += [(s, n, " ".join(words[s : s + n])) for n in range(1, 5) if s + n <= len(words) and " ".join(words[s : s + n]) in aliases]
        return {m for m in found if not any(o[0] <= m[0] and o[0] + o[1] >= m[0] + m[1] and o[1] > m[1] for o in found)}

    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = ins.alias_matches(rows, "id", "text", spark.createDataFrame([(a,) for a in aliases], "alias string")).collect()
    assert {(r.id, r.start, r.n, r.phrase) for r in got} == {(k, *m) for k, t in enumerate(texts) for m in brute(t)}
    assert len(got) == len({(r.id, r.start) for r in got})


def test_no_rows_and_no_aliases(spark):
    rows, none = spark.createDataFrame([(1, "NQ", "long nq")], "id int, root string, text string"), spark.createDataFrame([], "root string, alias string")
    assert ins.symbol_scope(rows, "id", "text", "root", none).select("own", "foreign").collect() == [(False, None)]
    assert ins.symbol_scope(rows.limit(0), "id", "text", "root", ins.known_aliases(spark)).count() == 0


def counting(sizes):
    """A scorer of two labels that reports the greatest batch it saw, and fails on empty ones."""

    def load():
        def scorer(rows):
            assert 0 < len(rows) <= sizes
            p = rows["x"].to_numpy(dtype=float)
            return np.column_stack([p, 1 - p])

        return scorer

    return load


def test_scores_come_in_bounded_batches_and_empty_partitions_load_nothing(spark):
    rows = spark.range(1000).select("id", (F.col("id") / 1000).alias("x"), F.lit("aside").alias("probs")).repartition(3)
    got = sc.score_fn(rows, ["id"], ["x"], counting(17), ["NO_ACTION", "TRIM"], batch=17).collect()
    assert sorted(r.id for r in got) == list(range(1000)) and all(abs(r.probs[0] - r.id / 1000) < 1e-12 for r in got)

    def never():
        raise AssertionError("loaded for no rows")

    assert sc.score_fn(rows.filter("id < 0").repartition(5), ["id"], ["x"], never, ["A"]).count() == 0
    blank = rows.select("id", F.lit(None).cast("double").alias("x"))
    assert {r.probs for r in sc.score_fn(blank, ["id"], ["x"], never, ["A"]).collect()} == {None}


@pytest.mark.parametrize("made", [lambda r: np.ones((len(r), 3)), lambda r: np.full((len(r), 2), np.nan), lambda r: np.full((len(r), 2), 1.5)])
def test_wrong_scores_are_errors(spark, made):
    rows = spark.range(4).select("id", F.lit(0.5).alias("x"))
    with pytest.raises(Exception, match="the scorer gave"):
        sc.score_fn(rows, ["id"], ["x"], lambda: made, ["A", "B"]).collect()


def test_a_fitted_model_as_a_scorer(spark):
    data, _ = learning.featured(spark, DIR, 200)
    fitted = ml.fit_logreg(data, steps=20)
    weights, bias = fitted.model.coefficientMatrix.toArray(), fitted.model.interceptVector.toArray()
    from pyspark.ml.functions import vector_to_array

    rows = data.filter("features is not null").select("doc_id", vector_to_array("features").alias("x")).repartition(7)

    def load():
        def scorer(part):
            z = np.stack(part["x"].to_list()) @ weights.T + bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return scorer

    scores = sc.score_fn(rows, ["doc_id"], ["x"], load, fitted.labels, batch=32)
    got = {r.doc_id: fitted.labels[int(np.argmax(r.probs))] for r in scores.collect()}
    assert got == {r.doc_id: r.p for r in fitted.predict(data.filter("features is not null")).collect()}


def test_scores_meet_the_gate(spark):
    labels = ["NO_ACTION", "SETUP_LONG", "ENTER_LONG", "TRIM"]
    rows = [(1, "TRIM", False), (2, None, False), (3, "TRIM", False), (4, None, False), (5, "TRIM", True), (6, "TRIM", False), (7, None, False)]
    intents = spark.createDataFrame([(*r, 0.6) for r in rows], "id int, tag string, strong boolean, confidence double")
    probs = [(1, [0.0, 0.1, 0.1, 0.8]), (2, [0.1, 0.0, 0.8, 0.1]), (3, [0.5, 0.4, 0.05, 0.05]), (4, [0.5, 0.0, 0.25, 0.25]), (5, [0.9, 0.1, 0.0, 0.0])]
    scores = spark.createDataFrame(probs, "id int, probs array<double>")
    got = {r.id: (r.decision, r.final_tag, r.final_confidence) for r in sc.gated(intents, scores, ["id"], labels, {"ENTER_LONG": 0.75}).collect()}
    assert got == {
        1: ("support", "TRIM", 0.8),
        2: ("promote", "ENTER_LONG", 0.8),
        3: ("block", None, None),  # no action and setups together
        4: ("none", None, None),
        5: ("rule", "TRIM", 0.6),
        6: ("keep", "TRIM", 0.6),  # never scored
        7: ("none", None, None),
    }


def made(n, at=0):
    return [dict(session_id="abc"[k % 3], segment_id=f"{k:04d}", received_at=f"2026-03-01T00:{k // 60:02d}:{k % 60:02d}.000Z", status="final", text=f"w{k}", confidence=0.5) for k in range(at, at + n)]


def test_late_subscribers_get_every_row_once(spark, tmp_path):
    path = feed(tmp_path / "in", [made(10, at=10 * k) for k in range(5)])
    h = hub.Hub(spark, str(tmp_path / "hub"), st.SEGMENTS, every=2)
    assert h.version() == -1 and h.snapshot().count() == 0 and h.deltas(-1).count() == 0
    with pytest.raises(ValueError, match="snapshot first"):
        hub.Subscription(h).poll()
    early = hub.Subscription(h)
    early.snapshot()
    drain(st.fan_out(st.segment_source(spark, path, per_trigger=1), [h.publish("one")], str(tmp_path / "cp")))
    assert h.version() == 4 and sorted(r.segment_id for r in early.poll().collect()) == [f"{k:04d}" for k in range(50)]
    assert early.poll().count() == 0
    rows = made(50)
    for version in range(5):  # with a state table at 1 and 3, between them and after the last
        upto = rows[: 10 * (version + 1)]
        want = {k: (max(r["segment_id"] for r in upto if r["session_id"] == k), sum(r["session_id"] == k for r in upto)) for k in "abc"}
        assert {r.session_id: (r.segment_id, r.rows) for r in h.snapshot(version).collect()} == want
        rest = sorted(r.segment_id for r in h.deltas(version).collect())
        assert sum(n for _, n in want.values()) + len(rest) == 50 and rest == [f"{k:04d}" for k in range(10 * (version + 1), 50)]
    one = hub.Subscription(h, keys=spark.createDataFrame([("b",), ("b",)], "session_id string"), seen=2)
    assert {r.session_id for r in one.poll().collect()} == {"b"} and one.seen == 4


def test_batches_that_run_again_count_once(spark, tmp_path):
    h = hub.Hub(spark, str(tmp_path / "hub"), st.SEGMENTS, every=2)
    batch = lambda at: spark.createDataFrame([(r["session_id"], r["segment_id"], None, "final", r["text"], 0.5) for r in made(6, at)], st.SEGMENTS)
    first = h.publish("one")
    first(batch(0), 0)
    first(batch(0), 0)
    batch(6).write.parquet(f"{h.path}/deltas/version=1")  # an attempt that was lost before its commit
    assert h.version() == 0 and h.deltas(-1).count() == 6
    first(batch(6), 1)
    h.publish("two")(batch(12), 0)  # another checkpoint counts from zero again
    assert h.version() == 2 and sorted(r.segment_id for r in h.deltas(-1).collect()) == [f"{k:04d}" for k in range(18)]
    assert {r.rows for r in h.snapshot().collect()} == {6}
