import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest

from livetext.llm import lexical
from livetext.llm.lexical import OP13_SQL, Documents, Items, Search, op13_lexical_search, ranked, terms_of

from helpers import ODD, docs

DIR = "/root/testdata/sf0.001"
ITEMS = "item_id long, text string, doc_id string, rank string, score long"


def words(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(items, rows, k):
    """Sorted (item_id, rank, doc_id, score), each row of the items by itself."""
    counted = [(i, n) for i, t in rows if t and (n := collections.Counter(words(t)))]
    nd, nl = len(counted), sum(sum(n.values()) for _, n in counted)
    df = collections.Counter(t for _, n in counted for t in n)
    out = []
    for item, text in items:
        scores = []
        for doc_id, n in counted:
            m = 50 + (50 * sum(n.values()) * nd) // nl
            score = sum(math.floor(1000 * math.log((2 * nd + 2) / (2 * df[t] + 1))) * ((1000000000 * n[t]) // (1000 * n[t] + 20 * m)) for t in set(words(text or "")) if t in n)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item, r, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_terms():
    for text in ["", "A-b_C9 éÀ", "x\u0080y\x7fz", "日本 語 🙂x", "İstanbul ß K", "a b"]:
        assert [t.decode() for t in terms_of(text)] == words(text)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_odd_rows(spark, k):
    rows = [*ODD, (9, "one two three"), (10, "one two three"), (11, "ONE Two"), (None, "one"), (12, "the the the one " * 40)]
    items = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (4, "?!"), (5, "not anywhere"), (None, "words text one"), (6, "one One oNE"), (7, "日本語 Привет 🙂")]
    asked = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in items], ITEMS)
    assert result(ranked(asked, docs(spark, rows).repartition(3), k)) == brute(items, rows, k)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, "one", "x", "y", 1)], ITEMS)
    assert ranked(none, docs(spark, ODD)).collect() == [] and ranked(some, docs(spark, [])).collect() == []
    assert ranked(some, docs(spark, [(1, None), (2, "")])).columns == ["item_id", "rank", "doc_id", "score"]


def corpus(n, seed):
    """Zipf words, passages of items in some documents, groups of copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    weights = [1 / (k + 3) for k in range(3000)]
    items = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randint(4, 30)))) for k in range(60)]
    rows = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 200)))) for k in range(n)]
    rows = [(k, f"{t} {items[k % 60][1]}" if k % 17 == 0 else rows[5][1] if k % 5 == 0 else t) for k, t in rows]
    return items, rows


def test_small_trees_in_many_blocks(spark, monkeypatch):
    items, rows = corpus(700, 1)
    monkeypatch.setattr(lexical, "BATCH", 64)
    monkeypatch.setattr("livetext.llm.decontaminate.BLOCK_ITEMS", 25)
    asked = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in items], ITEMS)
    assert result(ranked(asked, docs(spark, rows).repartition(5), 10)) == brute(items, rows, 10)


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(0)
    n, v = 4096, 2000
    weights = np.sort(rng.integers(100, 9000, v)).astype(float)
    rows = [np.unique(np.concatenate([rng.integers(0, 60, 20), (k // 64 * 30 + rng.integers(0, 30, 10)) % v])) for k in range(n)]
    impacts = [rng.integers(1, 600_000, len(r)) for r in rows]
    tree = Documents(np.arange(n), np.zeros(n, bool), np.concatenate(rows), np.concatenate(impacts), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    items = [sorted({*rng.integers(0, 60, 3).tolist(), *((c * 30 + rng.integers(0, 30, 8)) % v).tolist()}) for c in rng.integers(0, 64, 100)]
    seed, whole = Search(Items(items, weights), 20, np.ones(100, np.int64)), None
    seed.promising(tree)
    least = np.array([seed.best[k][0][19] if len(seed.best[k][0]) == 20 else 1 for k in range(100)])
    whole = Search(Items(items, weights), 20, least)
    whole.both(tree)
    dense = np.zeros((n, v), np.int64)
    for k, (r, g) in enumerate(zip(rows, impacts, strict=True)):
        dense[k, r] = g
    for k, terms in enumerate(items):
        scores = dense[:, terms] @ weights[terms].astype(np.int64)
        order = np.lexsort((np.arange(n), -scores))[:20]
        assert whole.best[k][1].tolist() == order.tolist() and whole.best[k][0].tolist() == scores[order].tolist()
    assert whole.scored < 0.3 * whole.pairs


def test_query_equals_sql_and_brute_force(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    got = result(op13_lexical_search(spark, DIR))
    assert got == sorted(con.execute(OP13_SQL).fetchall(), key=repr)
    read = lambda t, c: [(r[0], r[1]) for r in spark.read.parquet(f"{DIR}/{t}.parquet").select(c, "text").collect()]
    assert got == brute(read("benchmark", "item_id"), read("documents", "doc_id"), 50)
