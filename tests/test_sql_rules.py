"""Queries and their SQL state one rule on inputs that the smallest tables lack."""

import datetime
import html
import random

import duckdb
from pyspark.sql import types as T

from livetext.plans import texts  # noqa: F401  registers its queries
from livetext.plans.queries import QUERIES, SQL


def both(spark, tmp_path, name, table, rows, schema):
    path = str(tmp_path / f"{table}.parquet")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    df = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    return sorted(map(tuple, df.select(*columns).collect()), key=repr), sorted(want, key=repr)


def test_references_without_semicolons_are_decoded_by_query_and_sql(spark, tmp_path):
    rng = random.Random(8)
    parts = ["&amp", "&ampx", "&amp;lt;", "&notit;", "&notin;", "&eacute", "&Eacute;", "&nosuch;", "&", "&&amp;", "&#65", "&#65;", "&#x41;z", "&#X0041g", "&#0;", "&#128;", "&#129;", "&#xD800;", "&#x110000;", "&#99999999999999999999;", "&#11;",
             "&#xfdd0;", "&#x1F600;", "&#00065;", "&#;", "&#x;", "&lt;b&gt;", "<i>", "</i>", " ", "\n", "x", "é", "&NotEqualTilde;", "&nbsp;", "&zwnj;", "&copy2;", "&ltcc;", "&gt", "​", "'", "&thinsp;;"]
    pages = [(k, "".join(rng.choice(parts) for _ in range(12))) for k in range(400)] + [(900, None), (901, ""), (902, "and&amp"), (902, "a twin"), (None, "&lt;b>")]
    got, want = both(spark, tmp_path, "clean_markup", "pages", pages, "page_id long, html string")
    assert got == want and len(got) == 405 and (902, "and&") in got
    plain = {k: t for k, t in got}
    assert all(plain[k].count("é") == html.unescape(h).count("é") for k, h in pages[:400] if "<" not in html.unescape(h))


def test_a_gap_of_exactly_the_limit_goes_on_in_query_and_sql(spark, tmp_path):
    start = datetime.datetime(2026, 1, 1)
    seconds = {1: [0, 21600, 43200], 2: [0, 21601], 3: [0, 21599, 43199, 64800], 4: [5]}
    rows = [(k * 10 + i, start + datetime.timedelta(seconds=s), k, "view", 1.0, "{}") for k, at in seconds.items() for i, s in enumerate(at)]
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])
    got, want = both(spark, tmp_path, "sessionize_gap", "events", rows, schema)
    assert got == want == sorted([(10, 3, 43200, 1), (20, 1, 0, 2), (21, 1, 0, 2), (30, 3, 43199, 3), (33, 1, 0, 3), (40, 1, 0, 4)], key=repr)


def test_a_spoken_price_is_cleaned_once_not_for_each_completion(spark):
    from pyspark.sql import functions as F

    from livetext.functions.prices import resolve_price

    rows = spark.createDataFrame([("twenty five and a half", 5012.0), ("1,9-50", 4900.0), (None, 5000.0), ("40", None)], "raw string, market double")
    priced = rows.select(resolve_price(F.col("raw"), F.col("market")).alias("p"))
    assert priced._jdf.queryExecution().analyzed().toString().count("lower(trim(") == 1
    assert priced.collect()[2].p is None and priced.collect()[3].p == 40.0
