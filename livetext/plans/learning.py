"""Queries on text features and fits. Documents are classified by language, vectors by label; folds are whole sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from livetext.operators import evaluation as ev
from livetext.operators import learning as ml
from livetext.plans.queries import query, read
from livetext.sources.transcripts import kept

SIZE = 1000
#: Vocabularies of the ablation, those of the reference.
SIZES = [5_000, 10_000, 20_000, 50_000]


def labelled(spark, d):
    """Documents with a language, and a fold for each source."""
    fold = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(3)).cast("int")
    return read(spark, d, "documents").filter("lang is not null and doc_id is not null").select("doc_id", "text", F.col("lang").alias("label"), fold.alias("fold"))


def featured(spark, d, size: int = SIZE):
    docs = ml.worded(labelled(spark, d), "text")
    terms = kept(ml.vocabulary(docs, ml.WORDS, size), "vocabulary")
    return ml.vectors(docs, "doc_id", ml.WORDS, terms, size), terms


GRAMS = r"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pN_\pM]{2,}') AS w FROM documents WHERE lang IS NOT NULL),
t AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS term FROM w), n AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL),
v AS (SELECT term, ln((1 + (SELECT count(*) FROM w)) / (1 + count(*))) + 1 AS idf FROM n GROUP BY term)"""


@query(f"WITH {GRAMS}, r AS (SELECT doc_id, term, (1 + ln(n)) * idf AS raw FROM n JOIN v USING (term)) SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM r")
def tfidf_features(spark, d):
    """The weights of all terms of every text; no vocabulary is cut off."""
    return ml.tfidf_features(labelled(spark, d), "doc_id", "text").select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query()
def fit_logreg(spark, d):
    """Languages of all documents as a model fitted on them gives them."""
    data, _ = featured(spark, d)
    return ml.fit_logreg(data).predict(data).select("doc_id", "label", "p")


@query()
def fit_linear_svm(spark, d):
    data, _ = featured(spark, d)
    return ml.fit_linear_svm(data, steps=20, inner=2).predict(data).select("doc_id", "label", "p")


@query()
def fit_mlp(spark, d):
    """The reference's network: layers of 256 and 128 on 20,000 terms."""
    data, _ = featured(spark, d, 20_000)
    return ml.fit_mlp(data, 20_000, (256, 128)).predict(data).select("doc_id", "label", "p")


@query()
def fit_vector_head(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), "embedding").filter("label is not null and embedding is not null")
    data = rows.withColumn("features", ml.layer_norm(F.col("embedding")))
    return ml.fit_vector_head(rows, "embedding").predict(data).select("vec_id", "label", "p")


@query(r"""WITH d AS (SELECT doc_id, text, CASE WHEN source IS NULL OR source = '' THEN 0 ELSE ascii(source) % 3 END AS fold FROM documents WHERE lang IS NOT NULL AND doc_id IS NOT NULL), w AS (SELECT doc_id, fold, regexp_extract_all(lower(text), '[\pL\pN_\pM]{2,}') AS w FROM d),
t AS (SELECT DISTINCT doc_id, fold, unnest(w || list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS term FROM w), held AS (SELECT fold, (SELECT count(*) FROM d) - count(*) AS n FROM d GROUP BY fold),
c AS (SELECT h.fold, h.n, term, count(*) AS df FROM held h JOIN t ON t.fold <> h.fold GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY df DESC, term) AS rn FROM c)
SELECT fold, (rn - 1)::INTEGER AS k, term, round(ln((1 + n) / (1 + df)) + 1, 9) AS idf FROM r WHERE rn <= 1000""")
def fold_vocabularies(spark, d):
    """The vocabulary of each held-out fold, from the other folds alone. Folds are by the first letter of a source."""
    source = F.coalesce("source", F.lit(""))
    docs = read(spark, d, "documents").filter("lang is not null and doc_id is not null").select("doc_id", "text", F.when(source == "", 0).otherwise(F.ascii(source) % 3).alias("fold"))
    found = ml.vocabularies_without(docs, "text", SIZE)
    return found.withColumn("idf", F.round("idf", 9))


@query()
def cross_validate(spark, d):
    """Metrics of logistic regression over folds of whole sources; small classes are repeated in training only."""
    found = ml.cross_validate_texts(labelled(spark, d), "doc_id", "text", SIZE, ml.fit_logreg, train=ml.oversampled).withColumnRenamed("label", "y")
    labels = sorted(r.y for r in found.select("y").distinct().collect())
    return ev.cv_summary(found, labels, "en")


@query()
def feature_importance(spark, d):
    data, terms = featured(spark, d)
    return ml.feature_importance(ml.fit_logreg(data), terms, 20)


@query()
def vocab_ablation(spark, d):
    return ml.vocab_ablation(labelled(spark, d), "doc_id", "text", SIZES, "en")
