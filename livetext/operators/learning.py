"""Text features and classifiers with Spark ML: fits, group cross-validation, weights by feature.

Labels are strings in ``label``; every fit weighs its classes to balance. Vocabularies and models have a bounded size, rows
stay distributed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from livetext.operators import evaluation as ev
from livetext.operators import grams, network


def _once(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, also where ``f`` names it inside another function."""
    return F.element_at(F.transform(F.array(value), f), 1)


#: A word. The plain letters in the class spare Java a look at the properties of most characters.
WORD = r"(?U)[a-zA-Z0-9_\w]{2,}"


def terms_of(text: Column, sizes: tuple[int, ...] = (1, 2)) -> Column:
    """Runs of as many words as ``sizes`` has, of two letters or more each; words and pairs of neighbours by default."""

    def runs(w, size):
        out = w
        for k in range(1, size):
            n = F.greatest(F.size(w) - k, F.lit(0))
            out = F.zip_with(F.slice(out, F.lit(1), n), F.slice(w, F.lit(k + 1), n), lambda a, b: F.concat_ws(" ", a, b))
        return out

    return _once(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.concat(*[runs(w, n) for n in sizes]))


#: Buckets that terms are counted in first, and the documents whose terms give the bounds.
BUCKETS, FIRST = 1 << 18, 2000
#: A column of this name holds a text's words with a blank between two; see ``worded``.
WORDS = "__words"


def worded(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with its words in place of the text, null if it has none. The table is written, since texts are cut into words once and
    counted several times. A table of this kind stays as it is."""
    from livetext.sources.transcripts import kept

    if text == WORDS:
        return docs
    words = F.nullif(F.array_join(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0)), " "), F.lit(""))
    return kept(docs.withColumn(WORDS, words).drop(text), "words")


def leading_terms(docs: DataFrame, text: str, size: int, sets: dict[str, Column], sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(term, ``sets``): in how many documents of each set (a condition on rows) a term, a run of as many words as ``sizes`` has, is, for
    all terms that can be among the ``size`` commonest of a set.

    Exact in two passes without a count of every term. The first counts by a hash of the terms, a bounded number of rows, and beside
    that some terms by themselves: the commonest of a few documents. No term is commoner than its bucket, and the last of ``size``
    counted terms bounds the rank from below, so only terms of buckets that reach it are counted in the second pass.
    """
    from livetext.sources.transcripts import kept

    names, buckets = list(sets), max(BUCKETS, 40 * size)  # so many that most hold no leading term
    rows = worded(docs, text).select(*[c.alias(k) for k, c in sets.items()], WORDS).filter(F.col(WORDS).isNotNull())
    longs, sums = ", ".join(f"`{k}` long" for k in names), [F.sum(k).alias(k) for k in names]
    few = rows.limit(FIRST).select(F.lit(True).alias("n"), WORDS).mapInArrow(grams.term_counts(WORDS, ["n"], sizes, None), "term string, n long")
    listed = [r.term for r in few.groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "term").limit(size * 2).select("term").collect()]
    first = rows.mapInArrow(grams.bucket_counts(WORDS, names, sizes, buckets, listed), f"bucket int, own int, {longs}")
    first = kept(first.groupBy("bucket", "own").agg(*sums), "term-buckets")
    ranked = first.filter("own is not null").select(*names).collect()  # at most twice ``size`` rows
    least = {k: max(1, ([0] * size + sorted(r[k] for r in ranked))[-size]) for k in names}
    reached = first.filter("bucket is not null").filter(reduce(lambda a, b: a | b, [F.col(k) >= least[k] for k in names])).select("bucket")
    full = np.zeros(buckets, bool)
    full[reached.toPandas()["bucket"].to_numpy(dtype=int)] = True  # at most ``BUCKETS`` numbers
    return rows.mapInArrow(grams.term_counts(WORDS, names, sizes, full), f"term string, {longs}").groupBy("term").agg(*sums)


def vocabulary(docs: DataFrame, text: str, size: int) -> DataFrame:
    """(k, term, idf) of the ``size`` terms in most documents, numbered in that order; smooth idf."""
    docs = worded(docs, text)
    top = leading_terms(docs, WORDS, size, {"df": F.lit(True)}).orderBy(F.desc("df"), "term").limit(size)
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("df")).alias("minus"), "term"))).alias("all"))
    rows = ranked.select(F.posexplode("all").alias("k", "t"))  # at most ``size`` entries in one array
    n = docs.agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(n)).select("k", "t.term", (F.log((1 + F.col("n")) / (1 - F.col("t.minus"))) + 1).alias("idf"))


def vocabularies_without(docs: DataFrame, text: str, size: int, fold: str = "fold") -> DataFrame:
    """``fold_vocabularies`` straight from texts. Each fold (a few) is a set of ``leading_terms``: the rows of all others."""
    from livetext.sources.transcripts import kept

    docs, text = worded(docs, text), WORDS
    sizes = {r[fold]: r.n for r in docs.groupBy(fold).agg(F.count("*").alias("n")).collect()}
    sets = {f"df{i}": F.col(fold) != k for i, k in enumerate(sorted(sizes))}
    found = kept(leading_terms(docs, text, size, sets), "fold-terms")
    whole, kind = sum(sizes.values()), dict(docs.dtypes)[fold]
    best = []
    for i, k in enumerate(sorted(sizes)):
        top = found.select("term", F.col(f"df{i}").alias("df")).filter("df > 0").orderBy(F.desc("df"), "term").limit(size)
        ranked = top.withColumn("k", F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1)  # at most ``size`` rows
        best.append(ranked.select(F.lit(k).cast(kind).alias(fold), F.col("k").cast("int").alias("k"), "term", (F.log((1 + F.lit(whole - sizes[k])) / (1 + F.col("df"))) + 1).alias("idf")))
    return reduce(DataFrame.unionByName, best)


def term_counts(docs: DataFrame, id_col: str, text: str, *keep: str) -> DataFrame:
    """(id, ``keep``, term, n): how often each text holds each of its terms."""
    return docs.select(id_col, *keep, F.explode(terms_of(F.col(text))).alias("term")).groupBy(id_col, *keep, "term").agg(F.count("*").alias("n"))


def fold_vocabularies(counts: DataFrame, rows: DataFrame, size: int, fold: str = "fold") -> DataFrame:
    """(fold, k, term, idf) for each held-out fold: the vocabulary and smooth idf of all other folds' rows.

    ``counts`` is a table of ``term_counts`` with the fold, ``rows`` the documents. Document frequencies are counted once by term
    and fold; a fold's training counts are the term's sum less its own. Terms that only the held-out fold has fall
    out. The first ``size`` of each fold are exact, and no fold's list passes through one task as a whole until then.
    """
    from livetext.operators.relational import first_by

    by_fold = counts.groupBy("term", fold).agg(F.count("*").alias("df"))
    of_term = by_fold.groupBy("term").agg(F.sum("df").alias("all"), F.map_from_entries(F.collect_list(F.struct(fold, "df"))).alias("own"))  # a few folds
    sizes = rows.groupBy(fold).agg(F.count("*").alias("own_rows"))
    sizes = sizes.join(F.broadcast(sizes.agg(F.sum("own_rows").alias("all_rows"))))  # one row
    each = of_term.join(F.broadcast(sizes))  # a row for each fold
    df = F.col("all") - F.coalesce(F.col("own")[F.col(fold)], F.lit(0))
    trained = each.select(fold, "term", df.alias("df"), (F.col("all_rows") - F.col("own_rows")).alias("n")).filter("df > 0")
    best = first_by(trained, [fold], [F.desc("df"), "term"], size)
    return best.select(fold, (F.col("rn") - 1).cast("int").alias("k"), "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights_of(counts: DataFrame, id_col: str, terms: DataFrame) -> DataFrame:
    """(id, k, term, weight): 1 + ln(count) times idf, scaled to length 1 by document. ``terms`` is a vocabulary, whose size
    its caller bounds."""
    raw = counts.join(F.broadcast(terms.select("k", "term", "idf")), "term").select(id_col, "k", "term", ((1 + F.log("n")) * F.col("idf")).alias("raw"))
    norm = raw.groupBy(id_col).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm.hint("merge"), id_col).select(id_col, "k", "term", (F.col("raw") / F.col("norm")).alias("weight"))


COUNTS = StructType([StructField("indices", ArrayType(IntegerType())), StructField("values", ArrayType(DoubleType()))])


def counted(docs: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """``docs`` with ``counts`` in place of the text, how often it holds each of the given terms, as numbers of terms and counts in two
    arrays. Each text is counted where it is read."""
    rows = worded(docs, text)
    if not terms:
        return rows.drop(WORDS).withColumn("counts", F.struct(F.array().cast("array<int>").alias("indices"), F.array().cast("array<double>").alias("values")))
    plain = [f for f in rows.schema if f.name != WORDS]
    return rows.mapInArrow(grams.known_counts(WORDS, terms), StructType([*plain, StructField("counts", COUNTS)]))


#: Bytes of words in a group of texts, or in the runs that are counted together.
GROUP = 1 << 22


def all_features(docs: DataFrame, id_col: str, text: str, sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(id, term, weight): the weights of all terms in each text, however many there are; rows of one id are one text.

    Texts are dealt to groups by their id. A group sends each of its terms once, packed by a hash of the term, gets back in how many
    texts of all groups it is, and weighs its texts. So no vocabulary is held anywhere, and no row is shuffled for a term of a text.
    """
    rows = worded(docs.select(id_col, text), text)
    n, length = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(WORDS)), F.lit(0))).first()
    parts = int(length) // GROUP + 1
    rows = rows.filter(F.col(WORDS).isNotNull()).withColumn("chunk", F.pmod(F.xxhash64(id_col), F.lit(parts)))
    dealt = rows.groupBy("chunk").applyInArrow(grams.dealt_counts(id_col, WORDS, sizes, parts), "chunk long, part long, terms string, df binary")
    counts = dealt.groupBy("part").applyInArrow(grams.summed_counts, "chunk long, part long, df binary")
    out = f"`{id_col}` {dict(rows.dtypes)[id_col]}, term string, weight double"
    return rows.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(grams.weights(id_col, WORDS, sizes, parts, n), out)


def tfidf_features(docs: DataFrame, id_col: str, text: str, terms: DataFrame | None = None) -> DataFrame:
    """The weights of a vocabulary's terms in each text, or of all terms; rows of one id are one text."""
    if terms is None:
        return all_features(docs, id_col, text)
    found = terms.select("k", "term", "idf").collect()  # a vocabulary
    # only the vocabulary's terms are dealt out, by document
    counts = counted(docs.select(id_col, text), text, [r.term for r in found]).select(id_col, F.explode(F.arrays_zip("counts.indices", "counts.values")).alias("e"))
    counts = counts.groupBy(id_col, F.col("e.indices").alias("at")).agg(F.sum("e.values").alias("n"))
    places = terms.sparkSession.createDataFrame([(at, *r) for at, r in enumerate(found)], "at int, k int, term string, idf double")
    return weights_of(counts.join(F.broadcast(places.select("at", "term")), "at"), id_col, places)


def vectors(docs: DataFrame, id_col: str, text: str, terms: DataFrame, size: int) -> DataFrame:
    """``docs`` with ``features`` in place of the text, one sparse vector a document, written for the fits that read it many times."""
    from livetext.sources.transcripts import kept

    found = terms.select("k", "term", "idf").collect()  # a vocabulary
    out = featured(counted(docs, text, [r.term for r in found]), [r.k for r in found], [r.idf for r in found], size)
    return kept(out, "features")


def featured(rows: DataFrame, numbers: list, idf: list, size: int) -> DataFrame:
    """``rows`` of ``counted`` with ``features`` in place of ``counts``; where only other columns are read, no vector is made."""
    return rows.withColumn("features", F.arrow_udf(grams.vectors(numbers, idf, size), VectorUDT())("counts")).drop("counts")


def balanced(rows: DataFrame, label: str = "label") -> tuple[DataFrame, list]:
    """``rows`` with a number ``y`` for each label and a weight that makes the classes equal, and the labels in order."""
    counts = {r[label]: r.n for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}  # one row a label
    labels = sorted(counts)
    total = sum(counts.values())
    lookup = lambda values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col(label)]
    out = rows.withColumn("y", lookup({x: float(k) for k, x in enumerate(labels)}))
    return out.withColumn("weight", lookup({x: total / (len(labels) * n) for x, n in counts.items()})), labels


class Fitted:
    """A model over ``features`` and its labels; ``predict`` adds ``p``, the label."""

    def __init__(self, model, labels: list, after=None):
        self.model, self.labels, self.after = model, labels, after

    def predict(self, rows: DataFrame) -> DataFrame:
        keep = rows.columns
        out = self.model.transform(rows)
        if self.after:
            out = self.after.transform(out.drop("prediction", "probability").withColumnRenamed("rawPrediction", "margins"))
        names = F.array(*[F.lit(x) for x in self.labels])
        return out.withColumn("p", F.get(names, F.col("prediction").cast("int"))).select(*keep, "p")


def fit_logreg(rows: DataFrame, c: float = 1.0, steps: int = 100) -> Fitted:
    """Balanced multinomial logistic regression with an L2 penalty of 1 / (c n)."""
    data, labels = balanced(rows)
    n = data.count()
    model = LogisticRegression(labelCol="y", weightCol="weight", family="multinomial", regParam=1 / (c * max(n, 1)), maxIter=steps, standardization=False)
    return Fitted(model.fit(data), labels)


class Ensemble:
    """Calibrated models; ``predict`` adds ``p``, the label with the greatest mean probability (the first of equals)."""

    def __init__(self, members: list[tuple], labels: list):
        self.members, self.labels = members, labels

    def predict(self, rows: DataFrame) -> DataFrame:
        keep, out = rows.columns, rows
        for k, (model, after) in enumerate(self.members):
            margins = model.transform(out).drop("prediction").withColumnRenamed("rawPrediction", "margins")
            out = after.transform(margins).withColumn(f"__p{k}", vector_to_array("probability")).drop("margins", "calibrated", "probability", "prediction")
        total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [F.col(f"__p{k}") for k in range(len(self.members))])
        names = F.array(*[F.lit(x) for x in self.labels])
        best = F.array_position(F.col("__total"), F.array_max("__total")).cast("int") - 1
        return out.withColumn("__total", total).withColumn("p", F.get(names, best)).select(*keep, "p")


def inner_folds(rows: DataFrame, most: int = 5, label: str = "y") -> tuple[DataFrame, int]:
    """``rows`` with ``inner``, a fold of each class's rows in turn, and the number of folds: ``most``, or the rows of the smallest
    class. Rows are taken in the order of a hash of their features, so copies share a fold only by chance of their places."""
    least = rows.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    folds = min(most, least)
    if folds < 2:
        return rows, folds
    # numbered within buckets of a class, so that no class is one task's window; the hash is a column, so it is computed once a row
    keyed = rows.withColumn("__key", F.xxhash64(F.hash(vector_to_array("features")))).withColumn("__bucket", F.pmod("__key", F.lit(64)))
    place = F.row_number().over(Window.partitionBy(label, "__bucket").orderBy("__key")) + F.col("__bucket")
    return keyed.withColumn("inner", F.pmod(place, F.lit(folds)).cast("int")).drop("__key", "__bucket"), folds


def fit_linear_svm(rows: DataFrame, c: float = 1.0, steps: int = 30, inner: int = 5) -> Fitted | Ensemble:
    """Balanced one-against-rest hinge loss, calibrated by inner folds: in each, a model of the other folds gives the margins on
    which a logistic fit is made, and predictions are the mean of the calibrated models. So no row's margins come from a model
    that saw it. Where a class has a single row there is one model without calibration."""
    data, labels = balanced(rows)
    data, folds = inner_folds(data, inner)
    data = data.persist()  # every fit reads it
    n = data.count()
    svm = lambda n: OneVsRest(classifier=LinearSVC(labelCol="y", weightCol="weight", regParam=1 / (c * max(n, 1)), maxIter=steps, tol=1e-3, standardization=False), labelCol="y", weightCol="weight", parallelism=4)
    try:
        if len(labels) < 2 or folds < 2:
            return Fitted(svm(n).fit(data), labels)
        members = []
        for k in range(folds):
            model = svm(n * (folds - 1) // folds).fit(data.filter(F.col("inner") != k))
            margins = held_out_margins(model, data, k)
            after = LogisticRegression(featuresCol="margins", labelCol="y", weightCol="weight", family="multinomial", maxIter=30, rawPredictionCol="calibrated").fit(margins)
            members.append((model, after))
        return Ensemble(members, labels)
    finally:
        data.unpersist()


def held_out_margins(model, data: DataFrame, fold: int) -> DataFrame:
    """The rows of an inner fold with ``margins`` by a model of the others."""
    return model.transform(data.filter(F.col("inner") == fold).drop("p")).drop("prediction").withColumnRenamed("rawPrediction", "margins")


def oversampled(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows of small classes repeated, whole times, towards the size of the largest."""
    counts = {r[label]: r.n for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}  # one row a label
    times = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, max(counts.values()) // n)])[F.col(label)]
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).drop("copy")


class Net:
    """A network of dense layers and its labels; ``predict`` adds ``p``, the label."""

    def __init__(self, weights: np.ndarray, sizes: list[int], labels: list):
        self.weights, self.sizes, self.labels = weights, sizes, labels

    def predict(self, rows: DataFrame) -> DataFrame:
        weights = rows.sparkSession.sparkContext.broadcast(self.weights)
        names = F.array(*[F.lit(x) for x in self.labels])
        return rows.withColumn("p", F.get(names, F.arrow_udf(network.classes(weights, self.sizes), IntegerType())("features")))


def fit_mlp(rows: DataFrame, size: int, hidden: tuple[int, ...] = (256, 128), steps: int = 30, seed: int = 7) -> Net:
    """A network of two hidden layers. Rows of small classes count whole times, towards the size of the largest, as ``oversampled`` repeats them."""
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row a label
    labels = sorted(counts)
    lookup = lambda values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("label")]
    data = rows.withColumn("y", lookup({x: k for k, x in enumerate(labels)})).withColumn("times", lookup({x: float(max(counts.values()) // n) for x, n in counts.items()}))
    sizes = [size, *hidden, max(len(labels), 2)]
    return Net(network.fit(data, sizes, steps, seed), sizes, labels)


def layer_norm(vector: Column) -> Column:
    """A vector with mean 0 and deviation 1. Mean and spread are computed once a vector, not once an entry."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, e: s + e) / F.size(x)
    spread = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e) / F.size(x) + 1e-5)
    centred = lambda x: _once(mean(x), lambda m: F.transform(x, lambda e: e - m))
    scaled = lambda c: _once(spread(c), lambda s: F.transform(c, lambda e: e / s))
    return array_to_vector(_once(F.transform(vector, lambda e: e.cast("double")), lambda x: _once(centred(x), scaled)))


def fit_vector_head(rows: DataFrame, vector: str, steps: int = 50) -> Fitted:
    """A linear classifier on given vectors, normalised row by row into ``features``."""
    return fit_logreg(rows.withColumn("features", layer_norm(F.col(vector))), steps=steps)


def cross_validate(rows: DataFrame, fit: Callable[[DataFrame], Fitted], fold: str = "fold", train: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Predictions of every row by a model fitted without its fold; only training rows go through ``train``."""
    folds = sorted(r[fold] for r in rows.select(fold).distinct().collect())  # a few folds
    parts = [fit(train(rows.filter(F.col(fold) != k))).predict(rows.filter(F.col(fold) == k)) for k in folds]
    return reduce(DataFrame.unionByName, parts)


def cross_validate_texts(docs: DataFrame, id_col: str, text: str, size: int, fit: Callable[[DataFrame], Fitted], fold: str = "fold", train: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """As ``cross_validate`` from texts: each fold's vocabulary and idf come from the other folds alone. Terms are counted and written
    once; a fold's features are made from these counts where they are read, and only its predictions are written."""
    return next(cross_validate_sizes(docs, text, [size], fit, fold, train))


def cross_validate_sizes(docs: DataFrame, text: str, sizes: list[int], fit: Callable[[DataFrame], Fitted], fold: str = "fold", train: Callable[[DataFrame], DataFrame] = lambda x: x):
    """``cross_validate_texts`` for each vocabulary size. A small vocabulary is the start of a large one, so the texts are read for the
    largest, and the terms of all folds are counted in one table."""
    from livetext.sources.transcripts import kept

    docs, terms = worded(docs, text), {}
    for r in vocabularies_without(docs, WORDS, max(sizes), fold).collect():  # a vocabulary for each of a few folds
        terms.setdefault(r[fold], {})[r.term] = (r.k, r.idf)
    known = sorted({t for found in terms.values() for t in found})
    rows = kept(counted(docs, WORDS, known), "counts")
    # each step of a fit sends a gradient a partition
    rows = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    folds = sorted(r[fold] for r in docs.select(fold).distinct().collect())  # a few folds

    def predicted(size: int, k) -> DataFrame:
        own = {t: x for t, x in terms.get(k, {}).items() if x[0] < size}
        data = featured(rows, [own[t][0] if t in own else None for t in known], [own[t][1] if t in own else None for t in known], size)
        return fit(train(data.filter(F.col(fold) != k))).predict(data.filter(F.col(fold) == k)).drop("features")

    for size in sizes:
        # steps of a fit are short jobs, so some folds are fitted side by side
        with ThreadPool(min(len(folds), 3) or 1) as pool:
            parts = pool.map(inheritable_thread_target(rows.sparkSession)(lambda k: predicted(size, k)), folds)  # noqa: B023
        yield kept(reduce(DataFrame.unionByName, parts), "predictions")


def feature_importance(fitted: Fitted, terms: DataFrame, top: int) -> DataFrame:
    """(label, rank, term, weight): the terms with the largest coefficients of each class."""
    from livetext.operators.relational import first_by

    spark = terms.sparkSession
    matrix = fitted.model.coefficientMatrix.toArray()
    rows = [(x, k, float(w)) for x, row in zip(fitted.labels, matrix, strict=False) for k, w in enumerate(row)]  # labels times vocabulary
    weights = spark.createDataFrame(rows, "label string, k int, weight double").join(F.broadcast(terms), "k")
    best = first_by(weights, ["label"], [F.desc("weight"), "term"], top)
    return best.select("label", F.col("rn").alias("rank"), "term", "weight")


def vocab_ablation(docs: DataFrame, id_col: str, text: str, sizes: list[int], none, fold: str = "fold") -> DataFrame:
    """Metrics of cross-validated logistic regression for each vocabulary size; each fold's vocabulary and idf come from the others."""
    out = []
    labels = sorted(r.label for r in docs.select("label").distinct().collect())
    for size, found in zip(sizes, cross_validate_sizes(docs, text, sizes, fit_logreg, fold), strict=True):
        out.append(ev.overall_metrics(found.withColumnRenamed("label", "y"), labels, none).withColumn("size", F.lit(size)))
    return reduce(DataFrame.unionByName, out)
