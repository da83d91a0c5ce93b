"""Operator 5, SimHash near-duplicates by a segment-popcount embedding.

A fingerprint becomes sixteen 4-bit segments, and these sixteen counts of set bits (0 to 4). The Manhattan
distance of two such vectors never exceeds the Hamming distance of the fingerprints, so fingerprints within two
bits lie within Manhattan distance two, and then some grid cell lies within one of both. The range join is an
equi-join on these cells: each distinct fingerprint visits its own cell and the cells one step off.

Candidates are then verified exactly. A cell with two fingerprints gives one pair, compared bit by bit. In
cells with more (a group of near copies shares its cells), pairs aren't listed: fingerprints are within two
bits exactly if some value is within one bit of both, so each is joined to the smallest other one at each of
its 65 such values. That keeps every component and is linear in a group's size.

Null text is the empty text. A text without words has fingerprint zero and is linked like any other. Exact
copies share a fingerprint and so a component. Repeated ids keep their rows. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from livetext.llm.common import small_batches, table, whole, written
from livetext.llm.components import components

SEGMENTS, WIDTH = 16, 4
SEED = 42


def shingle_hashes(text: str, n: int) -> np.ndarray:
    """XXH64 of every n-word shingle, repeats included; bytes.lower and bytes.split are ASCII's."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)) if len(words) >= n else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64)


def fingerprint(text: str, n: int) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; as a signed 64-bit number."""
    hashes = shingle_hashes(text, n)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, n: int, text_col: str = "text", out: str = "fp") -> DataFrame:
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, n) for t in texts], dtype="int64")

    return docs.withColumn(out, fp(whole(text_col)))


def cells(fp: str = "fp"):
    """The cell of a fingerprint's popcount vector, packed as sixteen 4-bit counts, and the cells one step off."""
    value = F.col(fp)
    own = F.lit(0).cast("long")
    for k in range(SEGMENTS):
        own = own.bitwiseOR(F.shiftleft(F.bit_count(F.shiftrightunsigned(value, WIDTH * k).bitwiseAND(F.lit(15).cast("long"))).cast("long"), WIDTH * k))
    count = lambda k: F.shiftrightunsigned(F.col("own"), WIDTH * k).bitwiseAND(F.lit(15).cast("long"))
    # counts lie from 0 to 4; steps beyond are left out
    steps = [F.when(ok, F.col("own") + F.lit(sign * (1 << WIDTH * k)).cast("long")) for k in range(SEGMENTS) for ok, sign in ((count(k) < WIDTH, 1), (count(k) > 0, -1))]
    around = F.filter(F.array(F.col("own"), *steps), lambda c: c.isNotNull())
    return own, around


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``prints(fp)`` that keep the components of "at most 2 bits"."""
    own, around = cells()
    seen = written(prints.select("fp", own.alias("own")).select("fp", F.explode(around).alias("cell")), "cells")
    shared = written(seen.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "shared-cells")
    pairs = shared.filter("n = 2").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b")
    crowded = seen.join(shared.filter("n > 2").select("cell").hint("merge"), "cell").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(np.array([1 << k], np.uint64).view(np.int64)[0].item()).cast("long") for k in range(64)])
    meets = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    meets = written(meets, "meets")
    least = written(meets.groupBy("value").agg(F.count("*").alias("n"), F.min("fp").alias("a")).filter("n > 1").select("value", "a"), "met")
    stars = meets.join(least.hint("merge"), "value").filter("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def simhash_components(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of ``docs``; links are fingerprints within two bits."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = written(with_fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), n).select("doc_id", "fp"), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    labels = components(near_links(prints))
    named = prints.join(labels.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    named = written(named, "named")
    least = written(named.groupBy("label").agg(F.min("first").alias("component_id")), "least")
    by_print = written(named.join(least.hint("merge"), "label").select("fp", "component_id"), "by-print")
    return rows.join(by_print.hint("merge"), "fp").select("doc_id", "fp", "component_id")


# --- near copies beyond two bits ------------------------------------------------------------------------------

BANDS, ROWS, WORDS = 12, 4, 5
SKETCH = "doc_id long, digest binary, fp long, bands array<struct<near:long,nearer:long>>"
SETS = "doc_id long, shingles array<long>"
#: Groups of at most so many texts are compared pair by pair; larger ones with their first text and in finer groups,
#: and where that leaves a group in several components, by _links_across.
PAIRED = 16
#: Rounds of pivots before all pairs across components are compared; sooner once these are few for each row, or fewer
#: than a share HELPS of a round's pairs were links.
ROUNDS, FEW_A_ROW, HELPS = 6, 4, 0.05


def _sketches(docs: DataFrame, n: int) -> DataFrame:
    """Of each text: a digest of its words, its fingerprint, and fingerprints of min-wise samples of its shingles.

    A sample takes the shingle that comes first in each of ROWS random orders, so two texts share it with
    probability J^ROWS for Jaccard similarity J, whatever their lengths; ``nearer`` takes twice as many.
    """
    rng = np.random.default_rng(20)
    odd = rng.integers(1, 2**63, (BANDS, 2 * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sketch(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = np.unique(shingle_hashes(text, WORDS))
                bands = []
                if len(hashes):
                    with np.errstate(over="ignore"):
                        least = np.full(BANDS * 2 * ROWS, np.iinfo(np.uint64).max)
                        for at in range(0, len(hashes), 2048):
                            part = hashes[at : at + 2048, None] * odd.ravel()[None, :]
                            least = np.minimum(least, (part ^ (part >> np.uint64(31))).min(0))
                    for k, row in enumerate(least.reshape(BANDS, 2 * ROWS)):
                        key = [xxhash.xxh64_intdigest(row[:m].tobytes(), k) for m in (ROWS, 2 * ROWS)]
                        bands.append(dict(zip(("near", "nearer"), np.array(key, np.uint64).view(np.int64).tolist(), strict=True)))
                words = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
                rows.append((doc_id, xxhash.xxh128_digest(words), fingerprint(text, n), bands))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.struct([("near", pa.int64()), ("nearer", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "digest", "fp", "bands"])

    return docs.mapInArrow(sketch, SKETCH)


def _shingle_sets(docs: DataFrame) -> DataFrame:
    def sets(batches):
        for batch in batches:
            found = [np.unique(shingle_hashes(t, WORDS)).view(np.int64).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return docs.mapInArrow(sets, SETS)


def _candidates(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of members(key, doc) that share a key, and the rows of groups that were too large for all pairs."""
    sizes = written(members.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("first")).filter("n > 1"), "bands")
    joined = members.join(sizes.hint("merge"), "key")
    few = joined.filter(F.col("n") <= PAIRED).groupBy("key").agg(F.array_sort(F.collect_list("doc")).alias("docs"))  # at most PAIRED
    pairs = few.select(F.explode(F.flatten(F.transform("docs", lambda a, k: F.transform(F.slice("docs", k + 2, PAIRED), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("p.a", "p.b")
    large = joined.filter(F.col("n") > PAIRED)
    return pairs.union(large.filter("doc <> first").select(F.col("first").alias("a"), F.col("doc").alias("b"))), large.select("key", "doc", "nearer")


def _labelled(docs: DataFrame, links: DataFrame) -> DataFrame:
    """``docs`` with the component label of column doc: its own id where no link names it."""
    labels = components(links)
    return docs.join(labels.hint("merge"), F.col("doc") == F.col("node"), "left").withColumn("label", F.coalesce("label", "doc")).drop("node")


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(key, doc, n, rank): of each set of n shingles so many of the rarest that two sets alike always share one (prefix filter)."""
    each = written(sets.select(F.col("doc_id").alias("doc"), F.size("shingles").alias("n"), F.explode("shingles").alias("key")), "shingles")
    often = written(each.groupBy("key").agg(F.count("*").alias("often")).filter("often > 1"), "frequencies")
    counted = each.join(often.hint("merge"), "key", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("doc").orderBy("often", "key"))
    kept = counted.withColumn("rank", rank).filter(F.col("rank") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1)
    return written(kept.filter("often > 1").select("key", "doc", "n", "rank"), "prefixes")


def _links_across(prefixes: DataFrame, links: DataFrame, alike, similarity: float) -> DataFrame:
    """``links`` and those that join different components of it, from sets that share a key of ``prefixes``.

    First each set is compared with one set of its key, another one each round while that finds links. Pairs within a
    component are never needed, so what is left are the pairs across. All of these are compared but those whose sizes
    differ too much, or that can't share enough after the key (the first shared key of two sets alike passes).
    """
    helps = True
    for round_ in range(ROUNDS + 1):
        rows = written(_labelled(prefixes, links), "labelled-prefixes")
        each = rows.groupBy("key", "label").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("doc", F.lit(round_)).alias("h"), "doc")).alias("pivot"))
        keys = each.groupBy("key").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("within"), F.min("pivot").getField("doc").alias("pivot"))
        keys = written(keys.filter(F.col("all") * F.col("all") > F.col("within")).select("key", "pivot", ((F.col("all") * F.col("all") - F.col("within")) / 2).alias("across")), "open-keys")
        across = keys.agg(F.sum("across")).first()[0]
        if across is None:
            return links
        open_rows = rows.join(keys.hint("merge"), "key")
        if round_ == ROUNDS or not helps or across <= FEW_A_ROW * prefixes.count():
            x, y = (open_rows.select("key", *[F.col(c).alias(c + k) for c in ("doc", "label", "n", "rank")]) for k in "ab")
            near = (F.col("labela") < F.col("labelb")) & (F.least("na", "nb") >= similarity * F.greatest("na", "nb"))
            enough = (1 + F.least(F.expr("na - ranka"), F.expr("nb - rankb"))) * (1 + similarity) >= similarity * F.expr("na + nb") - 1e-6
            pairs = x.join(y.hint("merge"), "key").filter(near & enough).select(F.col("doca").alias("a"), F.col("docb").alias("b"))
            return links.union(written(alike(written(pairs.distinct(), "pairs-across")), "links-across"))
        of_pivot = rows.select("key", F.col("doc").alias("pivot"), F.col("label").alias("other"))
        pairs = open_rows.join(of_pivot.hint("merge"), ["key", "pivot"]).filter("label <> other").select(F.col("pivot").alias("a"), F.col("doc").alias("b"))
        pairs = written(pairs.distinct(), "pivot-pairs")
        found = written(alike(pairs), "pivot-links")
        links, helps = links.union(found), found.count() >= HELPS * pairs.count()


def near_copy_components(docs: DataFrame, similarity: float = 0.8, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for each document with an id: classes of fingerprints within two bits, and of texts whose
    sets of five-word shingles are at least ``similarity`` alike.

    Two bits hold only very close copies. So texts are also fingerprinted on min-wise samples of their shingles;
    texts that share one of twelve such fingerprints are candidates (at similarity 0.8 all but 2 in 1,000 pairs do), and
    the sets are compared exactly. Exact copies are one text first. Groups too large for all pairs lose no link either:
    where one falls into several components, its texts are joined by a prefix filter on their rarest shingles.
    """
    small_batches(docs.sparkSession)
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    rows = written(_sketches(texts, n), "sketches")
    firsts = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first")), "firsts")
    same = rows.select("doc_id", "digest").join(firsts.hint("merge"), "digest").select("doc_id", "first")
    own = written(rows.join(firsts.select("digest", F.col("first").alias("doc_id")).hint("merge"), ["digest", "doc_id"], "left_semi").dropDuplicates(["digest"]).select("doc_id", "fp", "bands"), "own-sketches")

    prints = written(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    of_print = own.select("doc_id", "fp").join(prints.hint("merge"), "fp").filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    doc_of = lambda c: prints.select(F.col("fp").alias(c), F.col("first").alias(c + "_doc")).hint("merge")
    bits = near_links(prints).join(doc_of("a"), "a").join(doc_of("b"), "b").select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b"))

    members = written(own.select("doc_id", F.explode("bands").alias("s")).select(F.col("s.near").alias("key"), F.col("doc_id").alias("doc"), F.col("s.nearer").alias("nearer")), "band-members")
    pairs, large = _candidates(members)
    finer, _ = _candidates(large.select(F.col("nearer").alias("key"), "doc", "nearer"))
    pairs = written(pairs.union(finer).distinct(), "candidates")
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidate-ids")
    sets = written(_shingle_sets(texts.join(wanted.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])), "shingle-sets")
    of = lambda c: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(c + "_set")).hint("merge")

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("shared", F.size(F.array_intersect("a_set", "b_set")))
        return both.filter(F.col("shared") >= similarity * (F.size("a_set") + F.size("b_set") - F.col("shared"))).select("a", "b")

    links = written(of_print.union(bits).union(alike(pairs)), "links")
    crowded = written(_labelled(large.select("key", "doc"), links), "crowded")
    split = written(crowded.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key"), "split-keys")
    unsure = written(crowded.join(split.hint("merge"), "key", "left_semi").select(F.col("doc").alias("doc_id")).distinct(), "unsure")
    if not unsure.isEmpty():
        links = _links_across(_prefixes(sets.join(unsure.hint("merge"), "doc_id", "left_semi"), similarity), links, alike, similarity)

    labels = components(links)
    named = written(same.join(labels.hint("merge"), F.col("first") == F.col("node"), "left").select("doc_id", F.coalesce("label", "first").alias("label")), "named-documents")
    least = written(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least-documents")
    return named.join(least.hint("merge"), "label").select("doc_id", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
