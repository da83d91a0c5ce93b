"""A network of dense layers on sparse features. Tasks compute gradients of their rows, a block of rows at a time with the columns it uses;
a step of the fit adds them up. Weights and gradients have a bounded size, rows stay distributed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are multiplied together, and the pieces that gradients are added up in.
BLOCK, PIECES = 256, 16


def started(sizes: list[int], seed: int) -> np.ndarray:
    """Weights to begin with, all layers in one array: uniform, scaled to the width of a layer."""
    rng, out = np.random.default_rng(seed), []
    for n, m in zip(sizes, sizes[1:], strict=False):
        bound = (6 / (n + m)) ** 0.5
        out.append(rng.uniform(-bound, bound, (n + 1) * m).astype(np.float32))
    return np.concatenate(out)


def layers(flat: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of each layer's weights and of what it adds."""
    out, at = [], 0
    for n, m in zip(sizes, sizes[1:], strict=False):
        out.append((flat[at : at + n * m].reshape(n, m), flat[at + n * m : at + (n + 1) * m]))
        at += (n + 1) * m
    return out


def blocks(features: pa.Array, size: int, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, x, columns): the rows in this order, and their values in the columns that any of them uses."""
    lists = pc.struct_field(features, "indices")
    index, value = lists.flatten().to_numpy(zero_copy_only=False), pc.struct_field(features, "values").flatten().to_numpy(zero_copy_only=False)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    for begin in range(0, len(order), BLOCK):
        rows = order[begin : begin + BLOCK]
        n = lengths[rows]
        at = np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        used = np.zeros(size, bool)
        used[index[at]] = True
        x = np.zeros((len(rows), int(used.sum())), np.float32)
        x[np.repeat(np.arange(len(rows)), n), (np.cumsum(used) - 1)[index[at]]] = value[at]
        yield rows, x, np.flatnonzero(used)


def forward(net: list, x: np.ndarray, columns: np.ndarray) -> list[np.ndarray]:
    """What each layer gives; all but the last one cut off at zero."""
    out = [x @ net[0][0][columns] + net[0][1]]
    for w, b in net[1:]:
        out[-1] = np.maximum(out[-1], 0)
        out.append(out[-1] @ w + b)
    return out


def add_gradient(net: list, grad: list, x: np.ndarray, columns: np.ndarray, y: np.ndarray, times: np.ndarray) -> float:
    """The rows' loss, each as many times as it counts; its gradient is added to ``grad``."""
    out = forward(net, x, columns)
    z = out[-1].astype(np.float64)
    z -= z.max(axis=1, keepdims=True)
    total = np.log(np.exp(z).sum(axis=1))
    delta = np.exp(z - total[:, None])
    delta[np.arange(len(y)), y] -= 1
    delta = (delta * times[:, None]).astype(np.float32)
    for k in range(len(net) - 1, 0, -1):
        grad[k][0][...] += out[k - 1].T @ delta
        grad[k][1][...] += delta.sum(axis=0)
        delta = (delta @ net[k][0].T) * (out[k - 1] > 0)
    grad[0][0][columns] += x.T @ delta
    grad[0][1][...] += delta.sum(axis=0)
    return float(((total - z[np.arange(len(y)), y]) * times).sum())


def gradients(weights, sizes: list[int]):
    """For ``mapInArrow`` on (features, y, times): (piece, loss, gradient) of a task's rows together."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, flat, loss, seen = layers(weights.value, sizes), np.zeros(len(weights.value), np.float32), 0.0, False
        grad = layers(flat, sizes)
        for batch in batches:
            y, times = batch.column("y").to_numpy().astype(np.int64), batch.column("times").to_numpy()
            # rows of a class use the same columns, so blocks are narrow
            for rows, x, columns in blocks(batch.column("features"), sizes[0], np.argsort(y, kind="stable")):
                loss, seen = loss + add_gradient(net, grad, x, columns, y[rows], times[rows]), True
        if seen:
            for k, piece in enumerate(np.array_split(flat, PIECES)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([loss if k == 0 else 0.0]), pa.array([piece.tobytes()], pa.binary())], ["piece", "loss", "gradient"])

    return add


def summed(rows: pa.Table) -> pa.Table:
    """A piece of the gradients of all tasks, added up."""
    total = sum(np.frombuffer(g, np.float32).astype(np.float64) for g in rows.column("gradient").to_pylist())
    return pa.table([rows.column("piece").slice(0, 1), pa.array([pc.sum(rows.column("loss")).as_py()]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["piece", "loss", "gradient"])


def descend(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int, memory: int = 5, tol: float = 1e-6) -> np.ndarray:
    """Weights of a small ``f``, which gives a loss and its gradient: at most ``steps`` steps of limited-memory BFGS, each halved until the loss falls."""
    dot = lambda a, b: float(np.dot(a.astype(np.float64), b.astype(np.float64)))
    loss, g = f(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, used = -g, []
        for s, y, sy in reversed(past):
            used.append(dot(s, d) / sy)
            d = d - np.float32(used[-1]) * y
        if past:
            d = d * np.float32(past[-1][2] / dot(past[-1][1], past[-1][1]))
        for (s, y, sy), a in zip(past, reversed(used), strict=True):
            d = d + np.float32(a - dot(y, d) / sy) * s
        slope = dot(g, d)
        if slope >= 0:
            break
        t = 1.0 if past else min(1.0, 1 / max(dot(g, g) ** 0.5, 1e-12))
        while True:
            new = w + np.float32(t) * d
            new_loss, new_g = f(new)
            if new_loss <= loss + 1e-4 * t * slope:
                break
            t /= 2
            if t < 1e-6:
                return w
        s, y, before = new - w, new_g - g, loss
        sy = dot(s, y)
        if sy > 1e-12:
            past = [*past, (s, y, sy)][-memory:]
        w, loss, g = new, new_loss, new_g
        if before - loss <= tol * max(abs(before), abs(loss), 1):
            break
    return w


def fit(rows: DataFrame, sizes: list[int], steps: int, seed: int) -> np.ndarray:
    """Weights of a network by (features, y, times): rows count ``times`` times. Each step reads the rows once, or more often if it is halved."""
    sc = rows.sparkSession.sparkContext
    rows = rows.select("features", "y", "times").coalesce(sc.defaultParallelism)  # a task sends a gradient
    whole = rows.agg(F.sum("times")).first()[0]
    if not whole:
        return started(sizes, seed)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        sent = sc.broadcast(w)
        try:
            of_tasks = rows.mapInArrow(gradients(sent, sizes), "piece int, loss double, gradient binary")
            found = sorted(of_tasks.groupBy("piece").applyInArrow(summed, "piece int, loss double, gradient binary").collect())  # one gradient
            return found[0].loss / whole, np.concatenate([np.frombuffer(r.gradient, np.float32) for r in found]) / np.float32(whole)
        finally:
            sent.destroy()

    return descend(loss, started(sizes, seed), steps)


def classes(weights, sizes: list[int]):
    """For ``arrow_udf`` on features: the class with the largest output."""

    def predict(features: pa.Array) -> pa.Array:
        net, out = layers(weights.value, sizes), np.zeros(len(features), np.int32)
        for rows, x, columns in blocks(features, sizes[0], np.arange(len(features))):
            out[rows] = forward(net, x, columns)[-1].argmax(axis=1)
        return pa.array(out)

    return predict
