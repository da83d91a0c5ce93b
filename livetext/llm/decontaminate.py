"""Operator 4, benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

A document leaks an item of L words if their best local alignment (match 1, mismatch and gap -1) scores at least
``threshold`` * L, or ``long_match`` for long items; let s be that, rounded up. Candidates are exact:

1. An alignment of M matched words and P errors scores M - P >= s. Its matched words lie in at most P + 1 runs, so it shares at
   least s - 1 of the item's L - 1 word pairs. Hence it holds one of any L - s + 1 pairs of the item: the seeds are
   those that the fewest items have. It covers at most 2L - s words of the document.
2. One pass over the documents marks the seeds. Round each, as far as an alignment may reach, a passage is kept if it shares s - 1
   word pairs with any items together, and then with the item.
3. Passages are joined to their items and aligned word by word.

So every document is found that full alignment with every item would find (tested against that). Items go in blocks of
bounded size and number of characters, each of which is sent to all tasks as arrays of hashes: a stated query set against all rows.
The documents are never shuffled; a text is searched whole in one task.

Words are runs of letters and digits, lower-cased, compared by 64-bit hashes. Inside a longer text, an item of fewer than
``least`` words is no evidence; it is leaked by a document whose words are exactly its own. Null texts and items, and those without
words, match nothing. Documents with one id (null is an id here) share their verdict; ties between
items go to the smaller item_id. Empty tables give no leaks. Other columns pass through ``decontaminate`` untouched.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livetext.llm.common import small_batches, table, whole, written

WORD = re.compile(r"[^\W_]+")
PASSAGES = "doc_id long, item int, words array<long>"
LEAKS = "doc_id long, item_id long, score double"
#: A block of test items: at most so many items and so many characters (of the average item).
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 32_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Hashes:
    """Hashes of words, kept for the words seen last."""

    MOST = 500_000

    def __init__(self):
        self.seen = {}

    def words(self, words: list[str]) -> np.ndarray:
        import xxhash

        seen = self.seen
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 1)
        h = np.fromiter((seen[w] for w in words), np.uint64, len(words))
        if len(seen) > self.MOST:
            seen.clear()
        return h


def pairs(h: np.ndarray) -> np.ndarray:
    """Hash of the pair of words at each place but the last."""
    with np.errstate(over="ignore"):
        out = (h[:-1] * _MIX ^ h[1:]) * _MIX
        return out ^ out >> np.uint64(29)


def align(a: list[int], b: list[int]) -> int:
    """Smith-Waterman score of two word sequences: 1 a match, -1 a mismatch or gap; by anti-diagonal-free rows.

    A row's gaps along it are a running maximum: H[j] = max over k <= j of T[k] - (j - k).
    """
    b = np.asarray(b)
    at = np.arange(len(b) + 1)
    row, best = np.zeros(len(b) + 1, np.int64), 0
    for x in a:
        t = np.zeros(len(b) + 1, np.int64)
        t[1:] = np.maximum(0, np.maximum(row[:-1] + np.where(b == x, 1, -1), row[1:] - 1))
        row = np.maximum.accumulate(t + at) - at
        best = max(best, int(row.max()))
    return best


def _blocks(items: DataFrame) -> list[list[tuple[int, str]]]:
    sized = items.select(F.col("item_id").cast("long").alias("item_id"), whole("text").alias("text"))
    n, chars = sized.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / BLOCK_ITEMS), math.ceil(chars / BLOCK_CHARS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        yield [(r.item_id, r.text) for r in sized.filter(part == k).collect()]


class Items:
    """A block's items as arrays of hashes."""

    def __init__(self, items: list[list[str]], threshold: float, long_match: int, least: int):
        hashes = Hashes()
        self.words = [hashes.words(w) for w in items]
        #: The least score of a leak, and how far an alignment may reach from a seed.
        self.score = [math.ceil(min(threshold * len(w), long_match) - 1e-9) for w in items]
        self.reach = [2 * len(w) - s for w, s in zip(items, self.score, strict=True)]
        own = [pairs(w) if len(w) >= least else np.zeros(0, np.uint64) for w in self.words]
        values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, own)]), return_counts=True)
        seeds: dict[int, list[int]] = {}
        for k, p in enumerate(own):
            if len(p):
                rare = np.argsort(counts[np.searchsorted(values, p)], kind="stable")[: len(p) + 2 - self.score[k]]
                for x in set(p[rare].tolist()):
                    seeds.setdefault(x, []).append(k)
        self.pairs = [np.unique(p) for p in own]
        self.keys = np.array(sorted(seeds), np.uint64)
        self.items_of = np.array([k for x in self.keys.tolist() for k in seeds[x]], np.int64)
        self.offsets = np.cumsum([0, *[len(seeds[x]) for x in self.keys.tolist()]])
        # one bit test settles nearly every place before the search
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        # pairs of any item, whose number in a window bounds that of each item
        self.any_bits = np.zeros(1 << 22, bool)
        self.any_bits[(values & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.score_of, self.reach_of = np.array(self.score, np.int64), np.array(self.reach, np.int64)
        self.short: dict[bytes, list[int]] = {}
        for k, w in enumerate(self.words):
            if 0 < len(w) < least:
                self.short.setdefault(w.tobytes(), []).append(k)
        self.shorter = least

    def passages(self, h: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(item, words) of each passage of a text that may hold a copy of the item."""
        if len(h) < self.shorter:
            return [(k, h) for k in self.short.get(h.tobytes(), ())]
        if not len(self.keys):
            return []
        p = pairs(h)
        low = (p & np.uint64((1 << 22) - 1)).astype(np.int64)
        at = np.nonzero(self.bits[low])[0]
        k = np.minimum(np.searchsorted(self.keys, p[at]), len(self.keys) - 1)
        same = self.keys[k] == p[at]
        at, k = at[same], k[same]
        if not len(at):
            return []
        each = self.offsets[k + 1] - self.offsets[k]
        item = self.items_of[np.arange(each.sum()) + np.repeat(self.offsets[k] - (np.cumsum(each) - each), each)]
        at = np.repeat(at, each)
        before = np.concatenate([[0], np.cumsum(self.any_bits[low])])
        some = before[np.minimum(at + 1 + self.reach_of[item], len(p))] - before[np.maximum(at - self.reach_of[item], 0)]
        near = some >= self.score_of[item] - 1
        at, item = at[near], item[near]
        if not len(at):
            return []
        order = np.lexsort((at, item))
        at, item, out = at[order], item[order], []
        for places in np.split(np.arange(len(at)), np.nonzero(np.diff(item))[0] + 1):
            one, reach = int(item[places[0]]), self.reach[int(item[places[0]])]
            first, last = np.maximum(at[places] - reach, 0), np.minimum(at[places] + 2 + reach, len(h))
            new = np.concatenate([[True], first[1:] > last[:-1]])
            for a, b in zip(first[new].tolist(), last[np.append(new[1:], True)].tolist(), strict=True):
                if np.isin(p[a : b - 1], self.pairs[one]).sum() >= self.score[one] - 1:
                    out.append((one, h[a:b]))
        return out


def passages(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, item, words): the passages that may hold a copy of an item, as hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def find(batches):
        items, hashes = shared.value, Hashes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                if words:
                    rows += [(doc_id, item, w.view(np.int64)) for item, w in items.passages(hashes.words(words))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.list_(pa.int64())], strict=True)], names=["doc_id", "item", "words"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(find, PASSAGES)


def aligned(batches):
    """(doc_id, item_id, score) of passages beside their item's words, where the score is enough."""
    for batch in batches:
        rows = []
        for doc_id, item_id, least, words, item in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "item_id", "least", "words", "item_words")], strict=True):
            score = align(item, words)
            if score >= least:
                rows.append((doc_id, item_id, score / len(item)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.float64()], strict=True)], names=["doc_id", "item_id", "score"])


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = 4, threshold: float = 0.6, long_match: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score): for each document with a leak its best item and the aligned share of that item."""
    spark = docs.sparkSession
    small_batches(spark)
    found = None
    for block in _blocks(benchmark):
        block = [(i, words) for i, t in block if (words := words_of(t))]
        if not block:
            continue
        items = Items([words for _, words in block], threshold, long_match, least)
        kept = written(passages(docs, items, id_col, text_col), "passages")
        table_of = [(k, i, items.score[k], items.words[k].view(np.int64).tolist()) for k, (i, _) in enumerate(block)]
        table_of = written(spark.createDataFrame(table_of, "item int, item_id long, least int, item_words array<long>"), "items")
        # sort-merge: adaptive execution splits the passages of an item with very many copies
        one = written(kept.join(table_of.hint("merge"), "item").select("doc_id", "item_id", "least", "words", "item_words").mapInArrow(aligned, LEAKS), "leaks")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], LEAKS)
    # structs are compared field by field: the highest score, then the smallest item
    best = F.max(F.struct("score", (-F.col("item_id")).alias("last"), "item_id"))
    return found.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.item_id", "b.score")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that leak a test item."""
    bad = written(leaks(docs, benchmark, id_col=id_col, text_col=text_col).select("doc_id"), "leaking-ids")
    return docs.join(bad.hint("merge"), docs[id_col].cast("long").eqNullSafe(bad["doc_id"]), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    bad = written(leaks(docs, benchmark), "leaks-by-document")
    rows = docs.select("doc_id").join(bad.select(F.col("doc_id").alias("id"), "item_id", "score").hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return rows.select("doc_id", F.col("score").isNotNull().alias("leaked"), "item_id", "score")
