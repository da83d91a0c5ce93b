import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from livetext.llm import language
from livetext.llm.language import Crf, fit, identify, marginal_sums, words_of
from livetext.llm.linear import fit_logistic, sparse, text_features
from livetext.llm.toxicity import _sample, _targets, chain_probabilities, fit_chain, op6_toxicity

from helpers import ODD, docs

VOCAB = {"aa": "tokar melin sopat radun kelit".split(), "bb": "gwynth orllwyd cwmbach pendref llanfa".split(), "cc": "itzal mendia zuria etxea haizea".split()}


def texts(rng, n):
    return [(" ".join(rng.choice(VOCAB[k]) + rng.choice(["", "a", "i"]) for _ in range(rng.randrange(3, 40))), k) for k in VOCAB for _ in range(n)]


def test_forward_backward_is_enumeration():
    rng = np.random.default_rng(0)
    emit, trans = np.exp(rng.normal(size=(9, 3))), np.exp(rng.normal(size=(3, 3)))
    seqs = [rng.integers(0, 9, n) for n in (1, 4, 2, 6)]
    got = marginal_sums(emit, trans, seqs)
    for ids, have in zip(seqs, got, strict=True):
        total, want = 0.0, np.zeros(3)
        for path in itertools.product(range(3), repeat=len(ids)):
            p = np.prod([emit[i, y] for i, y in zip(ids, path, strict=True)]) * np.prod([trans[a, b] for a, b in zip(path, path[1:], strict=False)])
            total += p
            want += p * np.bincount(path, minlength=3)
        assert np.allclose(have, want / total)


def test_held_out_and_code_switching():
    rng = random.Random(1)
    model = fit(texts(rng, 40))
    emit = lambda t: np.array([model.emission(w) for w in words_of(t)])
    for t, k in texts(rng, 30):
        assert model.langs[int(marginal_sums(emit(t), model.trans, [np.arange(len(words_of(t)))])[0].argmax())] == k
    switched = " ".join(VOCAB["aa"] * 4 + VOCAB["bb"] * 4)
    marg, _, _ = marginal_sums(emit(switched), model.trans, [np.arange(40)], sums=False)
    assert [model.langs[k] for k in marg.argmax(1)] == ["aa"] * 20 + ["bb"] * 20


def test_identify_odd_rows(spark):
    model = fit(texts(random.Random(2), 20))
    got = identify(docs(spark, [*ODD, (20, "42 !!"), (21, "tokar melin"), (22, "tokar " * 30000), (23, "½ ② ² ٣")]), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD) + 4 and all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1, 2, 3, 20, 23))
    assert by[21].lang_pred == "aa" and by[22].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got)
    assert identify(docs(spark, []), model).collect() == [] and fit([]) is None
    assert {r.lang_pred for r in identify(docs(spark, ODD), None).collect()} == {"und"}


def test_long_runs_are_read_to_their_end():
    a, b = "x" * 60 + "tokar", "x" * 60 + "itzal"
    assert "".join(words_of(a)).replace("-", "") == a and words_of(a)[:-1] == words_of(b)[:-1]
    feats = lambda t: [language.features(w, {}) for w in words_of(t)]
    assert feats(a) != feats(b) and words_of("a½b ①x d'été") == ["a", "b", "x", "d", "été"]
    cut = language.features(words_of(a)[0], {})
    assert cut[3:6] != language.features("x" * language.PIECE, {})[3:6]  # a cut is no word's end


def test_labelled_rows_are_bounded_though_ids_repeat(spark):
    rows = docs(spark, [(7, f"tokar {k}", "aa") for k in range(500)] + [(8, "itzal", "cc")])
    assert sorted(k for _, k in language.sample(rows, F.lit(True), 20)) == ["aa"] * 20 + ["cc"]


def test_query_on_held_out_rows(spark):
    got = language.op3_language_crf(spark, "/root/testdata/sf0.001", per_lang=40).join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out")
    assert held.filter(F.col("lang") == F.col("lang_pred")).count() >= 0.95 * held.count() > 0


def test_logistic_finds_the_words():
    rng = random.Random(3)
    rows = [(" ".join(rng.choices("red blue green tall small fast".split(), k=30)) + (" vile" if k % 4 == 0 else ""), k % 4 == 0) for k in range(200)]
    starts, idx = sparse([text_features(t) for t, _ in rows])
    w, v = fit_logistic(starts, idx, np.empty((200, 0)), np.array([y for _, y in rows], float))
    score = lambda t: w[sparse([text_features(t)])[1]].sum() + v[-1]
    assert score("red tall vile") > 0 > score("red tall blue")


def test_chain(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices("red blue green tall small fast".split(), k=20)) + (" spam" if k % 2 else "") + (" vile" if k % 4 == 1 else "")) for k in range(240)]
    labels = spark.createDataFrame([(k, k % 2, int(k % 4 == 1), "x") for k, _ in rows] + [(1, None, 1, "x"), (1, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    targets = {"spam": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    models = fit_chain(docs(spark, rows), labels, targets)
    got = chain_probabilities(docs(spark, [*ODD, (500, "red vile spam"), (501, "red blue")]), models, list(targets), out="p").collect()
    by = {r.doc_id: r.p for r in got}
    assert len(got) == len(ODD) + 2 and by[500].toxic > 0.5 > by[501].toxic and by[500].spam > 0.5 > by[501].spam and by[1] == by[2]
    assert chain_probabilities(docs(spark, []), models, list(targets)).collect() == []
    none = fit_chain(docs(spark, rows), labels.limit(0), targets)
    assert chain_probabilities(docs(spark, ODD), none, list(targets), out="p").filter("p.toxic > 0.5").count() == 0


def test_toxicity_query(spark):
    d = "/root/testdata/sf0.01"
    got = op6_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").withColumnRenamed("toxic", "y"), "doc_id")
    assert got.filter(F.col("toxic") == (F.col("y") == 1)).count() >= 0.98 * got.count()


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    rows, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.xxhash64("doc_id") % 2 == 0
    models = fit_chain(rows, labels.filter(~held), _targets())
    scored = chain_probabilities(rows.select("doc_id", "text"), models, list(_targets()), out="p").join(labels.filter(held), "doc_id").collect()
    for name, truth, recall in (("toxic", lambda r: r.toxic == 1, 0.85), ("low_quality", lambda r: r.quality == 0, 0.75)):
        caught = [truth(r) for r in scored if r.p[name] >= 0.5]
        assert sum(caught) >= recall * sum(map(truth, scored)) and len(caught) - sum(caught) <= 0.02 * len(scored)
    many = spark.createDataFrame([(5, f"vile {k}") for k in range(300)], "doc_id long, text string")
    one = spark.createDataFrame([(5, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(_sample(many, one, {"toxic": F.col("toxic") == 1}, "toxic", 20)) == 40
