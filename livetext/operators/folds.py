"""Folds over ordered rows of a key, in batches: no key is ever one array."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], fields: list[str], step: Callable, out: str) -> DataFrame:
    """(keys, ``out``): what ``step`` gives for the rows of each key in their order.

    ``step(state, row)`` returns the next state and the values of ``out`` ("name type, ..."), or None where a row gives nothing; the
    state is None before a key's first row. A row has the attributes ``order`` and ``fields``, null as None. Rows are dealt out by
    ``keys`` and sorted on disk if need be; a task holds one Arrow batch and one state, however many rows a key has. A lost task
    is folded again from its shuffled rows.
    """
    used = list(dict.fromkeys([*keys, *order, *fields]))
    kinds = dict(rows.dtypes)
    named = [part.split() for part in out.split(", ")]
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"`{n}` {t}" for n, t in named]])
    row_of = namedtuple("Row", [c for c in used if c not in keys])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            names = zip(*[batch.column(k).to_pylist() for k in keys], strict=True)
            values = zip(*[batch.column(c).to_pylist() for c in row_of._fields], strict=True)
            places, made = [], []
            for place, (now, value) in enumerate(zip(names, values, strict=True)):
                if now != key:
                    key, state = now, None
                state, result = step(state, row_of(*value))
                if result is not None:
                    places.append(place)
                    made.append(result)
            held = [batch.column(k).take(pa.array(places, pa.int64())) for k in keys]
            told = [pa.array([m[j] for m in made], TYPES[t]) for j, (_, t) in enumerate(named)]
            yield pa.RecordBatch.from_arrays([*held, *told], names=[*keys, *[n for n, _ in named]])

    return rows.select(*used).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(fold, schema)
