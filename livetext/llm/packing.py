"""Operator 9, bulk-synchronous best-fit packing.

1. Documents are encoded where they lie and cut into pieces; each piece gets a rank among the pieces of its
   length inside its task. The pieces (ids' checksum, not the ids) are written once.
2. Ranks become global from the counts by (length, task), which sorts the pieces by (length, rank).
3. Supersteps: pieces of one length, longest first, sweep the gaps in rising order for the smallest that holds
   them. Both sides are runs (a length and a count; a gap size and a range of sequences), so a superstep
   resolves all conflicts of a length at once, by rank, and then updates the gaps. The runs are at most one for
   each length and gap size, at any number of documents.
4. Every piece finds its run by (length, rank) and so its sequence and offset.

The sweep over runs is on the driver: its input is a histogram of at most 2,048 lengths and its output a few
thousand runs. No document goes there.

Null text is the empty text: one token, the separator. Ties between equal lengths fall by rank. Repeated rows
are packed each. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from livetext.llm.common import small_batches, table, whole, written
from livetext.llm.encoding import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long"
OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all full but the first."""
    first = n % size or size
    return [(0, min(first, n))] + [(s, size) for s in range(first, n, size)]


def pieces_of(docs: DataFrame, tokenizer: str, size: int, separator: int, id_col: str, text_col: str) -> DataFrame:
    def encode(batches):
        ids_of, seen, task = encoder(tokenizer).ids, {}, TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(ids_of(text), np.uint32(separator)).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), size)):
                    rank = seen[n] = seen.get(n, -1) + 1
                    rows.append((doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes()), task, rank))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()], strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(encode, PIECES)


def supersteps(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int]]:
    """Runs (length, first rank, first sequence, offset), best fit by falling length.

    A gap run is [first sequence, count] under its gap size. Pieces of one length that go into a run fill each
    of its sequences once; a sequence that still holds the length is then the tightest gap and is swept again.
    """
    runs, gaps, sizes, opened = [], {}, [], 0

    def add(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):  # no gap holds it: open as many sequences as these pieces fill
                each = size // length
                full, rest = divmod(left, each)
                for k in range(each):
                    if full:
                        runs.append((length, rank, opened, k * length))
                        rank += full
                add(size - each * length, opened, full)
                opened += full
                for k in range(rest):
                    runs.append((length, rank, opened, k * length))
                    rank += 1
                if rest:
                    add(size - rest * length, opened, 1)
                    opened += 1
                left = 0
                continue
            gap = sizes[at]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            taken = min(count, left)
            if taken < count:
                add(gap, first + taken, count - taken)
            runs.append((length, rank, first, size - gap))
            add(gap - length, first, taken)
            rank, left = rank + taken, left - taken
    return runs


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: its document, place there, checksum, sequence and offset in the sequence."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = written(pieces_of(docs, tokenizer, size, separator, id_col, text_col), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "offsets")
    histogram = {r.length: r.n for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows

    # each task's table of runs: sorted by (length, rank); a run's pieces go to successive sequences
    runs = sorted(supersteps(histogram, size))
    keys = np.array([length << 44 | rank for length, rank, _, _ in runs], np.int64)
    ranks, firsts, places = (np.array([r[k] for r in runs], np.int64) for k in (1, 2, 3))

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("task_rank").to_numpy() + batch.column("before").to_numpy()
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            found = [pa.array(firsts[at] + rank - ranks[at]), pa.array(places[at])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + found, names=[x.split()[0] for x in OUT.split(", ")])

    # at most `size` rows of offsets for each input task; merge keeps a hot length splittable
    return pieces.join(offsets.select("length", "task", "before").hint("merge"), ["length", "task"]).mapInArrow(place, OUT)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
