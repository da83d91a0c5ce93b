"""Operator 12, whitening of embeddings by spectrum slicing.

1. Entries become whole numbers, ``x = floor(64 * c) + 1000000``. The fit list holds each distinct vector once, found by a
   shuffle of vectors and written. Its number, its sums by dimension (exact) and its centred second moments are summed by
   tasks; what comes to the driver is one matrix of ``d x d`` entries for vectors of ``d`` entries, however many rows there are.
2. The inertia of ``V - sI``, read from the pivots of its LDLᵀ factors, counts the eigenvalues above ``s``. Bisection by such
   counts isolates each leading eigenvalue in an interval of its own. Rayleigh quotient iteration from there converges
   cubically; a value that leaves its interval narrows the interval and starts again. Two more counts, just below and just
   above the value found, certify its number. Eigenvalues too near one another to be told apart are taken as one
   cluster, whose number of members the counts give and whose vectors are made orthogonal.
3. All rows are projected where they lie, with a model of 16 vectors.

Vectors that are null or hold a null or non-finite entry are dropped, as are empty ones. All vectors should have one length;
where they do not, those of the most frequent length (the longer of two as frequent) are used and the others dropped.
Components whose eigenvalue is not above ``d * 1e-13`` of the trace (there are as few as the rank of V) have no whitened
values and are left out; a table of one distinct vector, or an empty one, gives an empty result. Ties between
equal eigenvalues: any orthogonal basis of their space. Repeated rows and ids keep their rows; a null id stays null. Other
columns are not read. A deviation above the range of a long is an error, never a wrapped number. The whole of a vector,
not a prefix, is used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from livetext.llm.common import table, written

SCALE, SHIFT = 64, 1_000_000


# --- spectrum slicing -----------------------------------------------------------------------------------------

_BUNCH = (1 + 17**0.5) / 8


def inertia(a: np.ndarray) -> tuple[int, int]:
    """(positive, negative) eigenvalues of a symmetric matrix, from its LDLᵀ pivots of order one and two."""
    a = np.array(a, np.float64)
    n, k, positive, negative = len(a), 0, 0, 0

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        if k == n - 1:
            positive, negative = positive + (a[k, k] > 0), negative + (a[k, k] < 0)
            break
        below = np.abs(a[k + 1 :, k])
        r = k + 1 + int(below.argmax())
        size, two = below[r - k - 1], False
        if max(abs(a[k, k]), size) == 0:
            k += 1
            continue
        if abs(a[k, k]) < _BUNCH * size:
            column = np.abs(a[k:, r])
            column[r - k] = 0
            other = column.max()
            if abs(a[k, k]) * other >= _BUNCH * size * size:
                pass
            elif abs(a[r, r]) >= _BUNCH * other:
                swap(k, r)
            else:
                swap(k + 1, r)
                two = True
        if two:
            block = a[k : k + 2, k : k + 2].copy()
            rest = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(block, rest.T)
            # such a block is indefinite by the way it was chosen
            positive, negative, k = positive + 1, negative + 1, k + 2
        else:
            positive, negative = positive + (a[k, k] > 0), negative + (a[k, k] < 0)
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k + 1 :, k] / a[k, k])
            k += 1
    return positive, negative


def above(v: np.ndarray, s: float) -> int:
    """Eigenvalues of ``v`` greater than ``s``."""
    return inertia(v - s * np.eye(len(v)))[0]


def _solved(v: np.ndarray, s: float, x: np.ndarray, scale: float) -> np.ndarray:
    """``(V - sI)^-1 x``, of unit length; a shift that meets an eigenvalue is moved by a rounding error."""
    for nudge in (0.0, 1e-15, 1e-13):
        try:
            y = np.linalg.solve(v - (s + nudge * scale) * np.eye(len(v)), x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all() and np.linalg.norm(y) > 0:
            return y / np.linalg.norm(y)
    return x / np.linalg.norm(x)


def leading(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a covariance, the ``most`` largest above rounding level, falling."""
    d, trace = len(v), float(np.trace(v))
    # the largest row sum bounds the eigenvalues
    if d == 0 or not trace > 0:
        return np.zeros(0), np.zeros((d, 0))
    v = (v + v.T) / 2
    floor, top = d * 1e-13 * trace, float(np.abs(v).sum(axis=1).max()) + 1e-12 * trace
    wanted = min(most, above(v, floor))
    rng, values, vectors = np.random.default_rng(12), [], np.zeros((d, 0))

    def free(x: np.ndarray) -> np.ndarray:
        """Without its part in the vectors that are done (twice, for rounding)."""
        for _ in range(2):
            x = x - vectors @ (vectors.T @ x)
        return x / np.linalg.norm(x)

    known = {floor: above(v, floor), top: 0}

    def count(s: float) -> int:
        if s not in known:
            known[s] = above(v, s)
        return known[s]

    while len(values) < wanted:
        k = len(values) + 1
        low = max(s for s, c in known.items() if c >= k)
        high = min(s for s, c in known.items() if c < k)
        # bisect until this eigenvalue is alone between the bounds, or can't be told from its neighbours
        while count(low) - count(high) > 1 and high - low > 1e-11 * trace:
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) >= k else (low, middle)
        members = count(low) - count(high)
        for _ in range(min(members, wanted - len(values))):
            value, vector = _eigenpair(v, low, high, free, rng, trace, count, k if members == 1 else 0)
            values.append(value)
            vectors = np.column_stack([vectors, vector])
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], vectors[:, order]


def _eigenpair(v, low, high, free, rng, trace, count, number) -> tuple[float, np.ndarray]:
    """The eigenvalue between the bounds and its vector. ``number`` is certified by counts; 0 for one of a cluster."""
    slip = 0.0 if number else 1e-10 * trace  # a cluster's bounds are as near one another as rounding errors
    for _ in range(60):
        shift = (low + high) / 2
        x = free(rng.standard_normal(len(v)))
        for _ in range(3):  # the interval's middle first: the iteration then starts near the right vector
            x = free(_solved(v, shift, x, trace))
        value, last = float(x @ v @ x), np.inf
        for _ in range(30):
            y = free(_solved(v, value, x, trace)) if low - slip <= value <= high + slip else x
            value = float(y @ v @ y)
            off = float(np.linalg.norm(v @ y - value * y))
            x, better, last = y, off < last / 2, min(off, last)
            if not low - slip <= value <= high + slip or not better:
                break
        inside, slack = low - slip <= value <= high + slip, max(4 * last, 1e-13 * trace)
        if number == 0 and inside and last <= 1e-10 * trace:
            return value, x
        if inside and last <= 1e-12 * trace and count(value - slack) >= number > count(value + slack):
            return value, x
        middle = (low + high) / 2
        if count(middle) >= max(number, 1):
            low = middle
        else:
            high = middle
    raise ArithmeticError(f"no eigenpair between {low} and {high}")


# --- on Spark -------------------------------------------------------------------------------------------------


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the usable rows."""
    doubles = F.col(vector_col).cast("array<double>")
    usable = vectors.select(F.col(id_col).alias("vec_id"), doubles.alias("c")).filter(F.coalesce(F.forall("c", _finite) & (F.size("c") > 0), F.lit(False)))
    lengths = usable.groupBy(F.size("c").alias("size")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("size")).first()  # one row
    usable = usable.filter(F.size("c") == (most["size"] if most else 0))
    return usable.select("vec_id", F.transform("c", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return np.array(column.flatten(), np.int64).reshape(len(column), -1)


def _moments(rows: DataFrame, size: int, centred) -> np.ndarray:
    """Sum over the rows of the outer products of ``centred(x)``; one matrix from each task, added by Spark."""

    def partial(batches):
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                y = centred(_matrix(batch))
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    cells = rows.mapInArrow(partial, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((size, size))
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # size * size cells
        out[r.i, r.j] = r.v
    return out


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each usable vector and each leading component."""
    spark = vectors.sparkSession
    own = written(whole_vectors(vectors, id_col, vector_col), "whole-vectors")
    fit = written(own.select("x").distinct(), "fit-list")
    at = fit.select(F.posexplode("x").alias("j", "x")).groupBy("j").agg(F.sum("x").alias("s"), F.count("*").alias("n")).orderBy("j").collect()  # a row for each dimension
    if not at:
        return spark.createDataFrame([], OUT)
    n, sums = at[0].n, np.array([r.s for r in at], np.int64)
    # n * x - S is exact; one division then rounds once
    centre = lambda x: (n * x - sums) / n
    v = _moments(fit, len(sums), centre) / n
    values, basis = leading(v, components)
    if not len(values):
        return spark.createDataFrame([], OUT)
    explained, project = values / np.trace(v), basis / np.sqrt(values)
    k = len(values)

    # measured on the whitened fit list itself: its means, then its centred moments
    def sums_of(batches):
        total = np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                total += (centre(_matrix(batch)) @ project).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total)], names=["i", "v"])

    means = np.zeros(k)
    for r in fit.mapInArrow(sums_of, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        means[r.i] = r.v / n
    error = float(np.abs(_moments(fit, k, lambda x: centre(x) @ project - means) / n - np.eye(k)).max())

    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            z = (centre(_matrix(batch)) @ project).ravel()
            each = pa.array(np.repeat(np.arange(batch.num_rows), k))
            cols = [batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1), batch.num_rows), pa.int32()), pa.array(np.full(len(z), n)), batch.column("deviation").take(each)]
            cols += [pa.array(z), pa.array(np.tile(explained, batch.num_rows)), pa.array(np.full(len(z), error))]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in OUT.split(", ")])

    off = F.zip_with("x", F.array(*[F.lit(int(s)) for s in sums]), lambda x, s: F.lit(n) * x - s)
    deviation = F.aggregate(off, F.lit(0).cast("long"), lambda a, y: a + y * y)
    return own.select(F.col("vec_id").cast("long").alias("vec_id"), "x", deviation.alias("deviation")).mapInArrow(rows, OUT)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
