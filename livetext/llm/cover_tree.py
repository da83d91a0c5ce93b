"""Operator 7, embedding near-duplicates by dual traversal of cover trees.

Unit vectors at cosine c are sqrt(2 - 2c) apart, so a cosine threshold is a distance threshold t.

1. The top level is global: at most ``CENTRES`` centres, a net of a bounded sample. Every vector goes to its nearest centre;
   the greatest distance there is the centre's covering radius. Near centres follow each other in a chain, along which
   the vectors are cut into blocks; a centre with many vectors spans several blocks.
2. Two centres at distance d with covering radii r, s are dropped if d - r - s > t. A pair of blocks is formed only if a
   pair of their centres is left, and is one task's group: no other pair of blocks meets.
3. A block becomes one tree: nested levels of centres with halving radii, each node with its true covering radius. The
   two trees of a pair are traversed together from the top: a pair of nodes is dropped if d - r - s > t, taken whole
   if d + r + s <= t, and else opened into its children; pairs of vectors are compared by their cosine in double
   precision. Node pairs taken whole are counted, not listed: a group of copies of any size costs one comparison a
   block pair. Links for components join each linked vector to one partner a node pair, which keeps every component.

The bounds prune what lies in clusters. Vectors that lie in no cluster (random ones of many dimensions) keep every
pair of blocks, and their products grow with the square of the rows.

Vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different
lengths are not compared. Ids may repeat: each row is a vector, and component_id is the smallest id in its class
(null only where no row of the class has one). An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from livetext.llm.common import small_batches, table, written
from livetext.llm.components import components

#: Vectors of a block: at most so many, and so many bytes in double precision.
BLOCK, BLOCK_BYTES = 32_768, 16_000_000
#: Blocks below the size above, so that small tables are dealt to several tasks too.
TASKS = 4
#: Centres of the global level and the radius of their net.
CENTRES, TOP = 1024, 0.5
#: From the level next to the threshold's distance down: above it, random vectors of many dimensions share nodes by chance,
#: whose radii then prune nothing.
LEVELS = (0.5, 0.25, 0.125)
#: Margin for rounding where a bound decides; pairs within it are compared one by one.
SLACK = 1e-9
VECTORS = "rid long, vec_id long, dim int, v binary"
MET = pa.schema([("dim", pa.int32()), ("p", pa.int32()), ("q", pa.int32()), ("block", pa.int32()), ("tree", pa.binary())])


def chords(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosines))


def owners(single: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a net ``radius`` apart and each row's centre in it (near enough in single precision), in matrix products."""
    least = np.float32(1 - radius**2 / 2)
    owner, net = np.empty(len(single), np.int64), []
    centres = np.empty((64, single.shape[1]), np.float32)
    for at in range(0, len(single), 256):
        x = single[at : at + 256]
        open_ = np.ones(len(x), bool)
        if net:
            cos = x @ centres[: len(net)].T
            best = cos.argmax(1)
            open_ = cos[np.arange(len(x)), best] < least
            owner[at : at + 256] = best
        left = np.flatnonzero(open_)
        near = x[left] @ x[left].T >= least
        free = np.ones(len(left), bool)
        for k in range(len(left)):
            if free[k]:
                mine = near[k] & free
                mine[k] = True
                free &= ~mine
                owner[at + left[mine]] = len(net)
                if len(net) == len(centres):
                    centres = np.concatenate([centres, np.empty_like(centres)])
                centres[len(net)] = x[left[k]]
                net.append(at + left[k])
    return np.array(net, np.int64), owner


def build(points: np.ndarray) -> dict[str, np.ndarray]:
    """The tree in arrays: nodes by level, children[first:last] of each, members in leaf order."""
    nodes, order = [], []
    children: list[list[int]] = []
    single = points.astype(np.float32)

    def grow(members: np.ndarray, level: int) -> list[int]:
        made = []
        net, owner = owners(single[members], LEVELS[level])
        far = chords(np.einsum("kd,kd->k", points[members], points[members[net[owner]]]))
        far[net] = 0
        radii = np.zeros(len(net))
        np.maximum.at(radii, owner, far)
        by_owner = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(net)))
        for c, (centre, radius, end) in enumerate(zip(members[net].tolist(), radii.tolist(), ends.tolist(), strict=True)):
            own = members[by_owner[(ends[c - 1] if c else 0) : end]]
            k = len(nodes)
            nodes.append((centre, radius, len(order), 0))
            children.append([])
            made.append(k)
            if len(own) > 1 and radius > 0 and level + 1 < len(LEVELS):
                children[k] = grow(own, level + 1)
            else:
                order.extend(own.tolist())
            nodes[k] = (centre, radius, nodes[k][2], len(order))
        return made

    top = grow(np.arange(len(points)), 0)
    table_ = np.array(nodes, float).reshape(-1, 4)
    flat = [c for own in children for c in own]
    starts = np.cumsum([0] + [len(own) for own in children])
    return {"centre": table_[:, 0].astype(np.int64), "radius": table_[:, 1], "first": table_[:, 2].astype(np.int64), "last": table_[:, 3].astype(np.int64), "top": np.array(top, np.int64), "flat": np.array(flat, np.int64), "starts": starts, "order": np.array(order, np.int64)}


def first_level(a: dict, b: dict, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of top nodes that may hold links. Single-precision products in slices of like radius: one comparison with the
    slices' largest radii settles nearly all, with a margin above the products' rounding; the rest are measured again."""
    tops = [t[np.argsort(-tree["radius"][t], kind="stable")] for tree, t in ((a, a["top"]), (b, b["top"]))]
    x, y = (tree["points"][tree["centre"][t]].astype(np.float32) for tree, t in ((a, tops[0]), (b, tops[1])))
    r, s = a["radius"][tops[0]], b["radius"][tops[1]]
    out_i, out_j = [tops[0][:0]], [tops[1][:0]]
    for p in range(0, len(x), 512):
        for q in range(0, len(y), 2048):
            least = 1 - min(2.0, limit + r[p] + s[q]) ** 2 / 2 - 1e-4
            at = np.flatnonzero((x[p : p + 512] @ y[q : q + 2048].T).ravel() >= np.float32(least))
            k, m = np.divmod(at, len(y[q : q + 2048]))
            out_i.append(tops[0][p + k])
            out_j.append(tops[1][q + m])
    return np.concatenate(out_i), np.concatenate(out_j)


def traverse(a: dict, b: dict, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Links of each row of a with rows of b and the reverse, and pairs of row positions that connect them.

    ``same`` compares a tree with itself: each node pair is met in both orders, so only a's counts are used.
    """
    limit = math.sqrt(2 - 2 * cosine)
    x, y = a["points"], b["points"]
    n_a, n_b, joined = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), []
    i, j = first_level(a, b, limit)
    while len(i):
        more_i, more_j = [], []
        for at in range(0, len(i), 65536):
            p, q = i[at : at + 65536], j[at : at + 65536]
            cos = np.einsum("kd,kd->k", x[a["centre"][p]], y[b["centre"][q]])
            one = (a["last"][p] - a["first"][p] == 1) & (b["last"][q] - b["first"][q] == 1)
            linked = one & (cos >= cosine)
            own, other = a["centre"][p[linked]], b["centre"][q[linked]]
            np.add.at(n_a, own, 1)
            np.add.at(n_b, other, 1)
            joined.append((own, other))
            d, reach = chords(cos), a["radius"][p] + b["radius"][q]
            near = (d - reach <= limit + SLACK) & ~one
            p, q, d, reach = p[near], q[near], d[near], reach[near]
            whole = d + reach <= limit - SLACK
            for k, m in zip(p[whole].tolist(), q[whole].tolist(), strict=True):
                own, other = a["order"][a["first"][k] : a["last"][k]], b["order"][b["first"][m] : b["last"][m]]
                n_a[own] += len(other)
                n_b[other] += len(own)
                joined.append((np.append(np.full(len(other), own[0]), own[1:]), np.append(other, np.full(len(own) - 1, other[0]))))
            for k, m in zip(p[~whole].tolist(), q[~whole].tolist(), strict=True):
                mine, theirs = a["flat"][a["starts"][k] : a["starts"][k + 1]], b["flat"][b["starts"][m] : b["starts"][m + 1]]
                if len(mine) or len(theirs):
                    mine, theirs = mine if len(mine) else np.array([k]), theirs if len(theirs) else np.array([m])
                    more_i.append(np.repeat(mine, len(theirs)))
                    more_j.append(np.tile(theirs, len(mine)))
                    continue
                own, other = a["order"][a["first"][k] : a["last"][k]], b["order"][b["first"][m] : b["last"][m]]
                for s in range(0, len(own), 512):
                    linked = x[own[s : s + 512]] @ y[other].T >= cosine
                    n_a[own[s : s + 512]] += linked.sum(1)
                    n_b[other] += linked.sum(0)
                    if linked.any():
                        joined.append(spanning(own[s : s + 512], other, linked))
        i, j = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (more_i, more_j))
    if same:
        n_a -= 1  # itself
    return n_a, n_b, joined


def spanning(rows: np.ndarray, cols: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep the components of a bipartite matrix: a forest found by search."""
    out, row_left, col_left = [], np.ones(len(rows), bool), np.ones(len(cols), bool)
    while row_left.any():
        start = int(np.argmax(row_left))
        row_left[start], frontier = False, [start]
        while frontier:
            r = frontier.pop()
            new_cols = np.nonzero(linked[r] & col_left)[0]
            col_left[new_cols] = False
            for c in new_cols.tolist():
                out.append((int(rows[r]), int(cols[c])))
                new_rows = np.nonzero(linked[:, c] & row_left)[0]
                row_left[new_rows] = False
                out += [(int(rows[n]), int(cols[c])) for n in new_rows.tolist()]
                frontier += new_rows.tolist()
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def unit(raw: np.ndarray) -> np.ndarray:
    points = raw.astype(float)
    return points / np.linalg.norm(points, axis=1)[:, None]


def opened(blobs, dim: int) -> np.ndarray:
    """Vectors of one length from their bytes: single precision where that lost nothing, else double."""
    out = np.empty((len(blobs), dim))
    for k, blob in enumerate(blobs):
        out[k] = np.frombuffer(blob, "<f4" if len(blob) == 4 * dim else "<f8")
    return out


def pack_tree(rids: np.ndarray, raw: np.ndarray) -> bytes:
    """The tree and its vectors, in single precision where that loses nothing."""
    out, single = io.BytesIO(), raw.astype(np.float32)
    np.savez(out, rids=rids, raw=single if (single == raw).all() else raw, **build(unit(raw)))
    return out.getvalue()


def open_tree(blob: bytes) -> dict[str, np.ndarray]:
    tree = dict(np.load(io.BytesIO(blob)))
    tree["points"] = unit(tree.pop("raw"))
    return tree


def prepared(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(rid, vec_id, dim, v): a number for each row, and its vector's bytes, null where it links with nothing. Vectors are
    scaled by a power of two, which loses no bit, so that no square overflows."""

    def prepare(batches):
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            lists = batch.column(1)
            dims = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            values = pc.fill_null(lists.flatten(), float("nan")).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(dims)])[:-1]
            blobs = np.full(len(dims), None, object)
            for dim in np.unique(dims[dims > 0]).tolist():
                rows = np.flatnonzero(dims == dim)
                raw = values[starts[rows][:, None] + np.arange(dim)]
                top = np.abs(raw).max(1)
                fine = np.isfinite(top) & (top > 0)
                raw = raw[fine] / np.ldexp(1.0, np.frexp(top[fine])[1] - 1)[:, None]
                with np.errstate(under="ignore"):
                    small = raw.astype("<f4")
                exact = (small == raw).all(1)
                for r, one, s, ok in zip(rows[fine].tolist(), raw, small, exact.tolist(), strict=True):
                    blobs[r] = s.tobytes() if ok else one.astype("<f8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(dims))), batch.column(0), pa.array(dims.astype(np.int32)), pa.array(blobs, pa.binary())], names=["rid", "vec_id", "dim", "v"])
            at += len(dims)

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(prepare, VECTORS)


class Top:
    """The global level for vectors of one length: centres in chain order, then their radii, places and surviving pairs."""

    def __init__(self, sample: np.ndarray):
        points = unit(sample)
        net, _ = owners(points.astype(np.float32), TOP)
        left, chain = set(range(1, len(net))), [0]
        cos = points[net] @ points[net].T
        while left:
            near = max(left, key=lambda k: cos[chain[-1], k])
            chain.append(near)
            left.remove(near)
        self.centres = points[net[chain]]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cos = points @ self.centres.T
        cell = cos.argmax(1)
        return cell, chords(cos[np.arange(len(points)), cell])

    def cut(self, counts: dict[int, tuple[int, float]], block: int, limit: float) -> None:
        n, radii = (np.array([counts.get(c, (0, 0.0))[k] for c in range(len(self.centres))]) for k in (0, 1))
        self.n, self.before, self.block = n, np.concatenate([[0], np.cumsum(n)]), block
        apart = chords(self.centres @ self.centres.T) - radii[:, None] - radii[None]
        self.near = (apart <= limit + 1e-6) & (n > 0)[:, None] & (n > 0)[None]

    def block_of(self, cell: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """A row's place among its centre's rows is drawn from its number, so that blocks fill evenly."""
        return (self.before[cell] + salt % self.n[cell]) // self.block

    def met_by(self, block: int) -> np.ndarray:
        """Blocks that hold a centre whose pair with one of this block's centres is left."""
        spans = lambda c: range(self.before[c] // self.block, (self.before[c + 1] - 1) // self.block + 1)
        mine = [c for c in range(len(self.n)) if self.n[c] and block in spans(c)]
        return np.unique([b for c in np.flatnonzero(self.near[mine].any(0)) for b in spans(c)]).astype(int)


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``vectors``."""
    spark = vectors.sparkSession
    small_batches(spark)
    limit = math.sqrt(2 - 2 * cosine)
    rows = written(prepared(vectors, id_col, vector_col), "vectors")
    fine = rows.filter("v is not null")
    # at most CENTRES rows of each length of vectors
    some = fine.withColumn("rank", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("rid")))).filter(F.col("rank") <= CENTRES)
    tops: dict[int, Top] = {dim: Top(opened(part["v"].tolist(), dim)) for dim, part in some.select("dim", "v").toPandas().groupby("dim")}
    if not tops:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    first = spark.sparkContext.broadcast(tops)

    def assign(batches):
        for batch in batches:
            dims, blobs = batch.column("dim").to_numpy(), batch.column("v").to_numpy(zero_copy_only=False)
            cell, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                cell[at], far[at] = first.value[dim].nearest(unit(opened(blobs[at], dim)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "dim", "v")), pa.array(cell), pa.array(far)], names=["rid", "dim", "v", "cell", "far"])

    cells = written(fine.select("rid", "dim", "v").mapInArrow(assign, "rid long, dim int, v binary, cell int, far double"), "cells")
    counts: dict[int, dict] = {}
    for r in cells.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # at most CENTRES a length
        counts.setdefault(r.dim, {})[r.cell] = (r.n, r.far)
    n_blocks = 0
    for dim, top in tops.items():
        total = sum(n for n, _ in counts[dim].values())
        most = block or min(BLOCK, max(BLOCK_BYTES // (8 * dim), 256))
        top.cut(counts[dim], -(-total // max(-(-total // most), min(TASKS, -(-total // 2048)))), limit)
        n_blocks += -(-total // top.block)
    shared = spark.sparkContext.broadcast(tops)

    def deal(batches):
        for batch in batches:
            dims, cell, rid = (batch.column(c).to_numpy() for c in ("dim", "cell", "rid"))
            salt = (rid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64)
            out = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                out[at] = shared.value[dim].block_of(cell[at], salt[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "dim", "v")), pa.array(out)], names=["rid", "dim", "v", "block"])

    dealt = cells.mapInArrow(deal, "rid long, dim int, v binary, block int")

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iat[0])
        return pd.DataFrame({"dim": [dim], "block": [pdf["block"].iat[0]], "tree": [pack_tree(pdf["rid"].to_numpy(), opened(pdf["v"].tolist(), dim))]})

    trees = written(dealt.repartition(min(max(n_blocks, 1), 2000), "dim", "block").groupBy("dim", "block").applyInPandas(tree, "dim int, block int, tree binary"), "trees")

    def pairs(batches):
        """A block with every block that it meets, itself included; the group of a pair holds two trees."""
        for batch in batches:
            for dim, own, blob in zip(*(batch.column(c).to_pylist() for c in ("dim", "block", "tree")), strict=True):
                for other in shared.value[dim].met_by(own).tolist():
                    yield pa.RecordBatch.from_pylist([{"dim": dim, "p": min(own, other), "q": max(own, other), "block": own, "tree": blob}], schema=MET)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        found = {int(r.block): r.tree for r in pdf.itertuples()}
        p, q = int(pdf["p"].iat[0]), int(pdf["q"].iat[0])
        a = open_tree(found[p])
        b = a if p == q else open_tree(found[q])
        n_a, n_b, joined = traverse(a, b, p == q, cosine)
        ours = np.nonzero(n_a)[0]
        parts = [(a["rids"][ours], np.full(len(ours), -1), n_a[ours])]
        if p != q:
            theirs = np.nonzero(n_b)[0]
            parts.append((b["rids"][theirs], np.full(len(theirs), -1), n_b[theirs]))
        if joined:
            one, two = a["rids"][np.concatenate([x for x, _ in joined])], b["rids"][np.concatenate([y for _, y in joined])]
            linked = np.unique(np.column_stack([np.minimum(one, two), np.maximum(one, two)])[one != two], axis=0)
            parts.append((linked[:, 0], linked[:, 1], np.zeros(len(linked), np.int64)))
        return pd.DataFrame({"a": np.concatenate([x[0] for x in parts]), "b": np.concatenate([x[1] for x in parts]), "n": np.concatenate([x[2] for x in parts])}).astype("int64")

    met = trees.mapInArrow(pairs, "dim int, p int, q int, block int, tree binary")
    n_pairs = n_blocks * (n_blocks + 1) // 2
    found = written(met.repartition(min(max(n_pairs, 1), 20000), "dim", "p", "q").groupBy("dim", "p", "q").applyInPandas(meet, "a long, b long, n long"), "met-trees")
    counted = found.filter("b = -1").groupBy("a").agg(F.sum("n").alias("n_links"))
    labels = components(found.filter("b <> -1").select("a", "b"))
    named = rows.select("rid", "vec_id").join(counted.withColumnRenamed("a", "rid").hint("merge"), "rid", "left").join(labels.withColumnRenamed("node", "rid").hint("merge"), "rid", "left")
    named = written(named.select("rid", "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("label", "rid").alias("label")), "named-vectors")
    least = written(named.groupBy("label").agg(F.min("vec_id").alias("component_id")), "least-vectors")
    out = named.join(least.hint("merge"), "label")
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
