"""Operator 13, exact ranked lexical search by two trees.

1. One pass over the documents counts the items' terms in each text. Numbers of documents, of terms and of documents by term
   are sums over that table; they give each term's weight ``w`` and each document's impact ``g`` of a term. A score is the
   sum of ``w * g`` over the item's terms.
2. Documents are range-sorted by their rarest terms, so that like ones lie together, and written. A task takes them in batches,
   each a tree: a leaf has ``LEAF_DOCS`` documents, a node above it ``FAN`` nodes, and every node the greatest impact
   of each term below it. The items form such a tree of greatest weights.
3. A first pass goes down from each batch's root to the most promising leaf of each item and scores it. The ``k``-th best of
   all scores found is a score that the item's answer reaches for certain.
4. The second pass goes down both trees. The sum of greatest weight times greatest impact bounds every score below a pair of
   nodes; where it is under the weakest ``k``-th score of the node's items, the pair and all below it are left out. Scores
   of the other leaves are exact, and a task's own ``k``-th scores tighten the bound as it goes on. Each task gives its best
   ``k`` of each item, and the best of these are the answer.

A document is left out only if its score is strictly below an item's ``k``-th, so ties are settled by the smaller
doc_id (null last) over all documents. Items go in blocks of bounded number and size, each of which is sent to all tasks: a
stated query set against all rows. Documents are never collected; a task holds one batch and its answers.

Terms are maximal runs of ASCII letters and digits and of all other characters from U+0080 on; only A-Z is lower-cased. Null
or empty texts have none: such a document is not counted, such an item has no rows. Repeated documents each count and
rank; each row of the items has an answer of its own, repeated ids too. Empty tables give an empty result. Other columns
are not read. Whole texts are counted. Numbers over 64 bits are an error.
"""

from __future__ import annotations

import collections
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from livetext.llm.common import drop_written, small_batches, table, whole, written
from livetext.llm.decontaminate import _blocks

LEAF_DOCS, LEAF_ITEMS, FAN, BATCH = 32, 8, 8, 8192
#: Bytes that stand in a term, with A-Z in lower case; all others become blanks.
_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_BYTES).split()


# --- trees ----------------------------------------------------------------------------------------------------


class Items:
    """The items' tree. ``levels[0]`` are leaves of items; a node is (children or items, terms, greatest weights)."""

    def __init__(self, items: list[list[int]], weights: np.ndarray):
        self.terms = [np.array(sorted(t), np.int64) for t in items]
        self.weights = weights
        rarest = lambda k: sorted(self.terms[k].tolist(), key=lambda t: (-weights[t], t))[:2]
        order = sorted((k for k in range(len(items)) if items[k]), key=lambda k: (rarest(k), k))
        nodes = [self._node(order[a : a + LEAF_ITEMS], self.terms) for a in range(0, len(order), LEAF_ITEMS)]
        self.levels = [nodes]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            above = [below[k][1] for k in range(len(below))]
            self.levels.append([self._node(list(range(a, min(a + FAN, len(below)))), above) for a in range(0, len(below), FAN)])

    def _node(self, children: list[int], terms: list[np.ndarray]) -> tuple[list[int], np.ndarray]:
        return children, np.unique(np.concatenate([terms[c] for c in children]))

    def matrix(self, level: int, node: int) -> tuple[np.ndarray, np.ndarray]:
        """(terms, greatest weight of each by child) of a node: an item holds a term with its weight or not at all."""
        children, terms = self.levels[level][node]
        out = np.zeros((len(terms), len(children)))
        for k, c in enumerate(children):
            at = np.searchsorted(terms, self.terms[c] if level == 0 else self.levels[level - 1][c][1])
            out[at, k] = self.weights[terms[at]]
        return terms, out


class Documents:
    """The tree of a batch: greatest impacts by node and term, level by level; ``levels[0]`` are leaves of documents."""

    def __init__(self, doc_ids: np.ndarray, no_id: np.ndarray, terms: np.ndarray, impacts: np.ndarray, offsets: np.ndarray):
        self.doc_ids, self.no_id, self.terms, self.impacts, self.offsets = doc_ids, no_id, terms, impacts, offsets
        self.known = np.unique(terms)
        n = len(doc_ids)
        columns = np.searchsorted(self.known, terms)
        leaf = np.repeat(np.arange(n), np.diff(offsets)) // LEAF_DOCS
        first = np.zeros((-(-n // LEAF_DOCS), len(self.known) + 1), np.float32)  # impacts are below 2^24; the last column is for terms of no document
        np.maximum.at(first, (leaf, columns), impacts)
        self.levels = [first]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN), axis=0))

    def columns(self, terms: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, terms)
        at[self.known[np.minimum(at, len(self.known) - 1)] != terms] = len(self.known)
        return at

    def children(self, level: int, node: int) -> range:
        return range(node * FAN, min((node + 1) * FAN, len(self.levels[level - 1])))

    def scores(self, leaf: int, terms: np.ndarray, weights: np.ndarray) -> tuple[int, np.ndarray]:
        """(first document, scores by document and item); sums stay exact, below 2^53."""
        a, b = leaf * LEAF_DOCS, min((leaf + 1) * LEAF_DOCS, len(self.doc_ids))
        s, e = self.offsets[a], self.offsets[b]
        at = np.searchsorted(terms, self.terms[s:e])
        same = terms[np.minimum(at, len(terms) - 1)] == self.terms[s:e]
        rows = np.repeat(np.arange(b - a), np.diff(self.offsets[a : b + 1]))
        dense = np.zeros((b - a, len(terms)))
        dense[rows[same], at[same]] = self.impacts[s:e][same]
        return a, np.rint(dense @ weights).astype(np.int64)


class Search:
    """One task's best ``k`` of each item."""

    def __init__(self, items: Items, k: int, least: np.ndarray):
        self.items, self.k, self.least = items, k, least.copy()
        self.best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.matrices: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.scored = self.pairs = 0
        self.weakest: list[np.ndarray] = [np.zeros(0)] * len(items.levels)
        for level in range(len(items.levels)):
            self.weakest[level] = np.array([self._weakest(level, n) for n in range(len(items.levels[level]))])

    def _weakest(self, level: int, node: int) -> int:
        children = self.items.levels[level][node][0]
        return self.least[children].min() if level == 0 else self.weakest[level - 1][children].min()

    def _raise(self, leaf: int) -> None:
        """A leaf's items have better scores: its weakest one, and those of the nodes above, follow."""
        node = leaf
        for level in range(len(self.items.levels)):
            now = self._weakest(level, node)
            if now == self.weakest[level][node]:
                return
            self.weakest[level][node] = now
            node //= FAN

    def matrix(self, level: int, node: int) -> tuple[np.ndarray, np.ndarray]:
        if (level, node) not in self.matrices:
            if len(self.matrices) > 4096:
                self.matrices.clear()
            self.matrices[level, node] = self.items.matrix(level, node)
        return self.matrices[level, node]

    def add(self, docs: Documents, leaf: int, node: int) -> None:
        """Score a leaf of documents for those items of a leaf whose own bound reaches their ``k``-th score."""
        terms, weights = self.matrix(0, node)
        children = np.array(self.items.levels[0][node][0])
        mine = np.nonzero(docs.levels[0][leaf][docs.columns(terms)] @ weights >= self.least[children])[0]
        if not len(mine):
            return
        used = np.nonzero(weights[:, mine].any(axis=1))[0]
        first, scores = docs.scores(leaf, terms[used], weights[np.ix_(used, mine)])
        self.scored += scores.size
        raised = False
        for c, item in enumerate(children[mine].tolist()):
            own = scores[:, c]
            good = np.nonzero(own >= self.least[item])[0]
            if not len(good):
                continue
            s, d, x = self.best.get(item, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)))
            s, d, x = np.append(s, own[good]), np.append(d, docs.doc_ids[first + good]), np.append(x, docs.no_id[first + good])
            order = np.lexsort((d, x, -s))[: self.k]
            self.best[item] = s[order], d[order], x[order]
            if len(order) == self.k and s[order[-1]] > self.least[item]:
                self.least[item] = s[order[-1]]
                raised = True
        if raised:
            self._raise(node)

    def both(self, docs: Documents) -> None:
        """Down both trees, the better pairs first."""
        top = [(len(self.items.levels) - 1, 0, len(docs.levels) - 1, 0, math.inf)]
        self.pairs += len(docs.doc_ids) * sum(len(x[0]) for x in self.items.levels[0])
        while top:
            level, node, depth, at, bound = top.pop()
            if bound < self.weakest[level][node]:
                continue
            if level == 0 and depth == 0:
                self.add(docs, at, node)
                continue
            terms, weights = self.matrix(level, node)
            if level == 0:  # the items of a leaf are bounded together
                nodes, weights, level_then = [node], weights.max(axis=1)[:, None], 0
            else:
                nodes, level_then = self.items.levels[level][node][0], level - 1
            kids, depth_then = ([at], 0) if depth == 0 else (docs.children(depth, at), depth - 1)
            bounds = docs.levels[depth_then][kids[0] : kids[-1] + 1][:, docs.columns(terms)] @ weights
            for i, j in zip(*np.unravel_index(np.argsort(bounds, axis=None, kind="stable"), bounds.shape), strict=True):
                if bounds[i, j] >= self.weakest[level_then][nodes[j]]:
                    top.append((level_then, nodes[j], depth_then, kids[i], bounds[i, j]))

    def promising(self, docs: Documents) -> None:
        """Each leaf of items down to its most promising leaf of documents."""
        for node in range(len(self.items.levels[0])):
            terms, weights = self.matrix(0, node)
            columns = docs.columns(terms)
            for leaf in sorted({self._leaf(docs, columns, weights[:, c]) for c in range(weights.shape[1])}):
                self.add(docs, leaf, node)

    def _leaf(self, docs: Documents, columns: np.ndarray, weights: np.ndarray) -> int:
        used = np.nonzero(weights)[0]
        columns, weights, at = columns[used], weights[used], 0
        for depth in range(len(docs.levels) - 1, 0, -1):
            kids = docs.children(depth, at)
            at = kids[int((docs.levels[depth - 1][kids.start : kids.stop][:, columns] @ weights).argmax())]
        return at

    def rows(self) -> pa.RecordBatch:
        found = [(item, *x) for item, (s, d, no) in sorted(self.best.items()) for x in zip(s.tolist(), d.tolist(), no.tolist(), strict=True)]
        cols = list(zip(*found, strict=True)) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([None if no else d for d, no in zip(cols[2], cols[3], strict=True)], pa.int64()), pa.array(cols[1], pa.int64())], names=["item", "doc_id", "score"])


def batches_of(batches, size: int):
    """Trees of at most ``size`` documents from Arrow batches (doc_id, terms, impacts)."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part, batch = batch.slice(0, size - n), batch.slice(size - n)
            held.append(part)
            n += part.num_rows
            if n == size:
                yield _tree(held)
                held, n = [], 0
    if n:
        yield _tree(held)


def _tree(held: list[pa.RecordBatch]) -> Documents:
    rows = pa.Table.from_batches(held).combine_chunks()
    ids, terms, impacts = (rows[c].combine_chunks() for c in ("doc_id", "terms", "impacts"))
    ids, terms, impacts = (x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks) for x in (ids, terms, impacts))
    offsets = np.concatenate([[0], np.cumsum(np.array(terms.value_lengths(), np.int64))])
    return Documents(np.array(ids.fill_null(0), np.int64), np.array(ids.is_null(), bool), np.array(terms.flatten(), np.int64), np.array(impacts.flatten(), np.int64), offsets)


# --- on Spark -------------------------------------------------------------------------------------------------

COUNTS, VECTORS, FOUND = "doc_id long, n long, terms array<int>, tfs array<int>", "doc_id long, a int, b int, terms array<int>, impacts array<int>", "item int, doc_id long, score long"
OUT = "item_id long, rank int, doc_id long, score long"


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Documents with at least one term: their number of terms, and the counts of those in ``vocabulary``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        get = shared.value.get
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                terms = terms_of(text.as_py())
                if terms:
                    found = collections.Counter(map(get, terms))
                    found.pop(None, None)
                    rows.append((doc_id, len(terms), list(found), list(found.values())))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(count, COUNTS)


def vectors(counts: DataFrame, n_docs: int, n_terms: int, weights: np.ndarray) -> DataFrame:
    """Impacts of the items' terms by document, like documents together; ``a`` and ``b`` are a document's rarest terms."""
    rank = np.empty(len(weights), np.int32)
    rank[np.argsort(-weights, kind="stable")] = np.arange(len(weights), dtype=np.int32)

    def rarest(batches):
        for batch in batches:
            terms = batch.column("terms")
            firsts = [sorted(rank[t].tolist())[:2] if (t := x.values.to_numpy()).size else [0] for x in terms]
            a, b = pa.array([f[0] for f in firsts], pa.int32()), pa.array([f[-1] for f in firsts], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), a, b, terms, batch.column("impacts")], names=["doc_id", "a", "b", "terms", "impacts"])

    m = F.expr(f"50L + ((50L * n * {n_docs}L) div {n_terms}L)")
    impacts = F.expr("cast(transform(tfs, tf -> (1000000000L * tf) div (1000L * tf + 20L * m)) as array<int>)")
    own = counts.filter(F.size("terms") > 0).withColumn("m", m).select("doc_id", "terms", impacts.alias("impacts"))
    # the hash splits documents that share their rarest terms, however many they are
    return own.mapInArrow(rarest, VECTORS).repartitionByRange("a", "b", F.xxhash64("doc_id")).sortWithinPartitions("a", "b", F.xxhash64("doc_id")).drop("a", "b")


def search(sorted_vectors: DataFrame, items: Items, k: int, least: np.ndarray, all_pairs: bool) -> DataFrame:
    """(item, doc_id, score): each task's best ``k`` of each item with at least that score; without ``all_pairs`` only those of
    the most promising leaves."""
    shared = sorted_vectors.sparkSession.sparkContext.broadcast((items, least))

    def find(batches):
        one = Search(shared.value[0], k, shared.value[1])
        for docs in batches_of(batches, BATCH):
            (one.both if all_pairs else one.promising)(docs)
        yield one.rows()

    return sorted_vectors.mapInArrow(find, FOUND)


def top(found: DataFrame, k: int) -> DataFrame:
    """``found`` with the rank of the best ``k`` of each item; tasks leave out what can't be among them before the shuffle."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked(items: DataFrame, docs: DataFrame, k: int = 50, item_id: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest scores for each row of ``items``."""
    spark = docs.sparkSession
    small_batches(spark)
    out = None
    for block in _blocks(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))):
        vocabulary: dict[bytes, int] = {}
        own = [[vocabulary.setdefault(t, len(vocabulary)) for t in dict.fromkeys(terms_of(text))] for _, text in block]
        if not vocabulary:
            continue
        counts = written(term_counts(docs, vocabulary, id_col, text_col), "term-counts")
        n_docs, n_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        df = np.zeros(len(vocabulary), np.int64)  # a row for each term of the block's items
        for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.float64)
        if max((weights[t].sum() for t in own), default=0) * 1e6 >= 2**53:
            raise OverflowError("an item's scores may exceed 2^53")
        tree = Items(own, weights)
        near = written(vectors(counts, n_docs, n_terms, weights), "sorted-vectors")
        least = np.ones(len(own), np.int64)  # a score is above 0
        for r in top(search(near, tree, k, least, False), k).filter(F.col("rank") == k).collect():  # a row for each item at most
            least[r["item"]] = max(1, r["score"])
        found = written(search(near, tree, k, least, True), "found")
        best = top(found, k)
        ids = spark.createDataFrame([(x, i) for x, (i, _) in enumerate(block)], "item int, item_id long")
        one = written(best.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
        for done in (counts, near, found):
            drop_written(done)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], OUT) if out is None else out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH own AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents WHERE text IS NOT NULL),
counted AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM own WHERE len(terms) > 0),
totals AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nl FROM counted),
tfs AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM counted) GROUP BY r, doc_id, n, term),
asked AS (SELECT row_number() OVER () AS q, item_id,
        list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms
    FROM benchmark WHERE text IS NOT NULL),
wanted AS (SELECT q, item_id, unnest(terms) AS term FROM asked),
weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM tfs, totals WHERE term IN (SELECT term FROM wanted) GROUP BY term, nd),
scores AS (
    SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // nl)))) AS BIGINT) AS score
    FROM wanted JOIN weights USING (term) JOIN tfs USING (term), totals GROUP BY q, item_id, r, doc_id),
best AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= 50
"""
