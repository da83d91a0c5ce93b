import collections
import random

import corpus_pipeline
from pyspark.sql import functions as F

from livetext.llm import simhash
from livetext.llm.decontaminate import words_of
from livetext.llm.simhash import near_copy_components, shingle_hashes

from helpers import ODD, docs, union_find

DIR = "/root/testdata/sf0.001"


def test_near_copies_are_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    base = rows[3][1].split()
    rows += [(5000 + k, " ".join([*base[:k], "changed", *base[k + 1 :]])) for k in range(20, 60)]
    sets = {i: set(shingle_hashes(t, 5).tolist()) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = union_find(ids, links)
    got = {r.doc_id: r.component_id for r in near_copy_components(docs(spark, rows)).collect()}
    assert all(got[a] == got[b] for a, b in links)
    assert sum(got[i] != want[i] for i in ids) <= 2  # fingerprints within two bits may join a little more
    assert near_copy_components(docs(spark, [])).collect() == []


def test_stages_on_odd_rows(spark):
    rows = docs(spark, [*ODD, (30, "An unusual short note.")])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, DIR)
        if name != "packing":
            assert out.columns == rows.columns
            assert out.filter("doc_id = 30").count() == 1
            assert stage(spark, rows.limit(0), DIR).count() == 0
        else:
            assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, 5, 6, 7, 8, 30, None}


def test_run(spark):
    DIR = "/root/testdata/sf0.01"
    out = corpus_pipeline.run(spark, DIR)
    packed = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert packed.filter("n > 2048 or n <> end").count() == 0
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    all_docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{DIR}/labels.parquet").filter("toxic = 1").collect()}
    assert len(kept & toxic) <= 0.05 * len(toxic) and len(kept) > 0.5 * len(all_docs)
    copies = collections.Counter(" ".join(all_docs[i].lower().split()) for i in kept)
    assert max(copies.values()) == 1
    items = [" ".join(words_of(r.text)) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    assert not any(item in " ".join(words_of(all_docs[i])) for i in kept for item in items)


def test_large_groups_lose_no_link(spark, monkeypatch):
    """Groups that one text doesn't unite: drifting chains of copies, and texts that share a passage and nothing else."""
    monkeypatch.setattr(simhash, "PAIRED", 3)
    monkeypatch.setattr(simhash, "FEW_A_ROW", 0.01)
    rng = random.Random(9)
    word = lambda: "w%05d" % rng.randrange(10**5)
    rows = []
    for chain in range(4):
        text = [word() for _ in range(100)]
        for k in range(45):
            at = rng.randrange(90)
            text = [*text[:at], word(), *text[at + 1 :]]
            rows.append((1000 * chain + k, " ".join(text)))
    passage = [word() for _ in range(60)]
    rows += [(9000 + k, " ".join(passage + [word() for _ in range(25)])) for k in range(60)]
    rng.shuffle(rows)
    for rounds in (0, 6):  # only pairs across; pivots first
        monkeypatch.setattr(simhash, "ROUNDS", rounds)
        got = {r.doc_id: r.component_id for r in near_copy_components(docs(spark, rows)).collect()}
        sets = {i: set(shingle_hashes(t, 5).tolist()) for i, t in rows}
        links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
        want = union_find(sets, links)
        assert len(set(want.values())) < len(want)
        assert got == want
