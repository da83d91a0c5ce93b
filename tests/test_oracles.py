"""Every query with SQL gives DuckDB's rows at the smallest size."""

import decimal

import duckdb
import pytest

from pyspark.sql import functions as F

from livetext.plans import curation, evaluation, flows, learning, orders, streams, texts
from livetext.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    result = duck.execute(SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr) == want


@pytest.mark.parametrize("name, least", [("fit_logreg", 0.95), ("fit_linear_svm", 0.95), ("fit_mlp", 0.6), ("fit_vector_head", 0.1)])
def test_fits_learn_their_labels(spark, name, least):
    got = QUERIES[name](spark, DIR).agg(F.avg((F.col("label") == F.col("p")).cast("int")), F.count("*")).first()
    assert got[0] >= least and got[1] >= 190


def test_cross_validation_is_held_out(spark):
    got = {r.metric: r for r in QUERIES["cross_validate"](spark, DIR).collect()}
    assert len(got) == 5 and got["accuracy"].pooled >= 0.9 and got["accuracy"].folds == 3 and got["accuracy"].std >= 0


def test_weights_of_terms_by_class(spark):
    rows = QUERIES["feature_importance"](spark, DIR).collect()
    assert len({r.label for r in rows}) >= 3 and all(r.rank <= 20 for r in rows)
    sizes = QUERIES["vocab_ablation"](spark, DIR).collect()
    assert [r["size"] for r in sorted(sizes, key=lambda r: r["size"])] == [100, 1000] and all(r.accuracy > 0.8 for r in sizes)


def test_stabilised_partials_of_every_row(spark):
    rows = QUERIES["stabilize_partials"](spark, DIR).collect()
    assert len(rows) == spark.read.parquet(f"{DIR}/conversations.parquet").count() and all(r.shown.startswith(r.committed) for r in rows)


#: Queries that SQL cannot express, each with a test above or in test_text_cases.
WITHOUT_SQL = {"fit_logreg", "fit_linear_svm", "fit_mlp", "fit_vector_head", "cross_validate", "feature_importance", "vocab_ablation", "stabilize_partials", "interpret_stream"}


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("module", [curation, evaluation, flows, learning, orders, streams, texts])
def test_queries_are_registered(module):
    named = {n for n, f in vars(module).items() if getattr(f, "__module__", "") == module.__name__ and getattr(f, "__code__", None) and f.__code__.co_varnames[:2] == ("spark", "d")}
    assert named - {"examples", "scored", "labelled", "segments", "featured", "spoken", "cleaned"} <= set(QUERIES)
