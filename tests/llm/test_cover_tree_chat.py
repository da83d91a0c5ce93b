import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from livetext.llm import chat
from livetext.llm.cover_tree import Top, near_vectors, unit

from helpers import union_find


def vectors(rng, n):
    base = rng.normal(size=(12, 16))
    out = [base[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.02, 0.2, 0.35, 2]) for _ in range(n)]
    out += [base[0] * s for s in (1, 3, 1e-200, 1e200)] + [-base[0]]
    return [v.tolist() for v in out]


@pytest.mark.parametrize("block", [40, 5000])
def test_near_vectors_is_all_pairs(spark, block):
    rows = list(enumerate(vectors(np.random.default_rng(4), 300)))
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (7, rows[7][1]), (None, [-1.0, 0.0])]
    data = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, rid string")
    got = near_vectors(data, 0.9, block=block).collect()

    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(v) for _, v in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.9]
    degree = collections.Counter(x for pair in links for x in pair)
    classes = union_find(range(len(rows)), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[classes[k]] = min(i, least.get(classes[k], i))
    want = collections.Counter((i, degree[k], least.get(classes[k]), i is None or i == least.get(classes[k])) for k, (i, _) in enumerate(rows))
    assert collections.Counter(tuple(r) for r in got) == want


def test_block_pairs_without_a_surviving_centre_pair_do_not_meet():
    rng = np.random.default_rng(5)
    base = np.linalg.qr(rng.normal(size=(64, 64)))[0][:20]
    points = unit(np.concatenate([b + 0.02 * rng.normal(size=(100, 64)) for b in base]))
    top = Top(points[::7])
    cell, far = top.nearest(points)
    counts = {c: (int((cell == c).sum()), float(far[cell == c].max())) for c in np.unique(cell).tolist()}
    top.cut(counts, 100, 0.447)
    met = sum(len(top.met_by(b)) for b in range(20))
    assert met < 100  # of 400
    block = top.block_of(cell, np.arange(len(points)))
    a, b = np.nonzero(points @ points.T >= 0.9)
    assert all(y in top.met_by(x) for x, y in set(zip(block[a].tolist(), block[b].tolist(), strict=True)))


def test_clusters_are_all_pairs(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(30, 32))
    made = np.concatenate([b + s * rng.normal(size=(20, 32)) for b in base for s in (0.05, 0.3)]).astype(np.float32)
    data = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(made)], "vec_id long, embedding array<float>")
    units = unit(made)
    links = (units @ units.T >= 0.9) & ~np.eye(len(units), dtype=bool)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(data, 0.9, block=64).collect()}
    classes = union_find(range(len(made)), zip(*(x.tolist() for x in np.nonzero(links)), strict=True))
    assert got == {k: (int(links[k].sum()), classes[k]) for k in range(len(made))}


def test_near_vectors_empty(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


LOG = "conv_id long, seq long, kind string, msg_id long, role string, text string, place int"
EVENTS = [
    (1, 1, "message", 1, "user", "hi"),
    (1, 2, "delta", 2, "assistant", "Hel"),
    (1, 4, "delta", 2, None, "lo"),
    (1, 3, "delta", 2, None, "l"),
    (1, 5, "message", 3, "user", "again"),
    (1, 6, "edit", 1, None, "hi there"),
    (1, 7, "regenerate", 2, None, "Hey"),
    (1, 8, "delta", 2, None, " <\\|you|>"),
    (None, 1, "message", None, None, None),
    (2, None, "message", None, "a\\n\nb<|", ""),
    (2, None, "message", None, "a\\n\nb<|", ""),
]


def test_fold_and_round_trip(spark):
    log = spark.createDataFrame([(*e, 0) for e in EVENTS], LOG)
    messages = chat.fold_messages(log)
    got = {r.conv_id: r for r in chat.render(messages).withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "hi there"), ("assistant", "Hey <\\|you|>"), ("user", "again")]
    assert [tuple(t) for t in got[2].turns] == [("a\\n\nb<|", "")] * 2 and [tuple(t) for t in got[None].turns] == [("", "")]
    (span,) = got[1].loss_spans
    assert got[1].formatted[span.start : span.end] == "Hey <\\\\|you|>"
    assert chat.render(chat.fold_messages(log.limit(0))).collect() == []


def test_every_text_comes_back(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("<|>\\im_end\n é🙂") for _ in range(rng.randrange(30))) for _ in range(300)] + ["x" * 200000, chat.END, chat.START]
    log = spark.createDataFrame([(k % 7, k, "message", None, rng.choice(["user", "assistant", t[:6]]), t, 0) for k, t in enumerate(texts)], LOG)
    back = chat.render(chat.fold_messages(log)).withColumn("turns", chat.parse(F.col("formatted"))).collect()
    for conv in back:
        want = [(r.role, r.text) for r in log.filter(F.col("conv_id") == conv.conv_id).orderBy("seq").collect()]
        assert [tuple(t) for t in conv.turns] == want
        masked = "".join(conv.formatted[s.start : s.end] for s in conv.loss_spans)
        assert masked.replace("<\\|", "<|").count("<|") >= 0 and len(conv.loss_spans) == sum(r == "assistant" for r, _ in want)


def test_query_equals_sql(spark, tmp_path):
    conversations = duckdb.read_parquet("/root/testdata/sf0.001/conversations.parquet")
    want = {r[0]: r[1:] for r in duckdb.sql(chat.OP2_SQL).fetchall()}
    got = {r.conv_id: tuple(r)[1:] for r in chat.op2_chat_format(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and got[-1][3] == hashlib.sha256(b"<|im_end|><|im_start|>assistant ok").hexdigest()
