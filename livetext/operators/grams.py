"""Runs of words counted where texts are read: Arrow in, numbers out. A text here is its words with a blank between two.

Words and runs are numbered within some megabytes of texts; strings are made only of the runs that a caller asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are numbered together; a longer text is numbered alone.
CHUNK = 1 << 24


def chunks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``CHUNK`` bytes of text, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(ends):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + CHUNK, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


class Grams:
    """The runs of up to ``longest`` words of some texts. ``levels[n - 1]`` has the number of each run of n words and its text's place."""

    def __init__(self, texts: pa.Array, longest: int):
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten().dictionary_encode()
        self.texts, self.words = len(texts), words.dictionary
        first = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        self.keys, self.levels = [np.arange(len(self.words))], [(first, of)]
        at, ids = np.arange(len(first)), first
        for n in range(1, longest):
            inside = at + n < len(first)
            at, ids = at[inside], ids[inside]
            inside = of[at] == of[at + n]
            at, ids = at[inside], ids[inside]
            # a run is the number of the run without its last word, and that word
            ids, keys = pd.factorize(ids * len(self.words) + first[at + n])
            self.keys.append(keys)
            self.levels.append((ids, of[at]))

    def counts(self, n: int, sets: list[np.ndarray]) -> np.ndarray:
        """In how many texts of each set each run of n words is."""
        ids, of = self.levels[n - 1]
        size = max(1, len(self.keys[n - 1]))
        once = pd.unique(of * size + ids)
        ids, of = once % size, once // size
        return np.stack([np.bincount(ids[s[of]], minlength=len(self.keys[n - 1])) for s in sets], axis=1)

    def hashes(self, n: int) -> np.ndarray:
        """A number of each run of n words that is the same in all tasks."""
        own = pd.util.hash_array(self.words.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(self.words) else np.zeros(0, np.uint64)
        out = own
        for keys in self.keys[1:n]:
            out = out[keys // len(self.words)] * np.uint64(0x9E3779B97F4A7C15) + own[keys % len(self.words)]
        return out ^ (out >> np.uint64(29))

    def strings(self, n: int, which: np.ndarray) -> pa.Array:
        if n == 1:
            return self.words.take(pa.array(which)).cast("string")
        keys = self.keys[n - 1][which]
        return pc.binary_join_element_wise(self.strings(n - 1, keys // len(self.words)), self.strings(1, keys % len(self.words)), " ")

    def find(self, n: int, terms: list[list[str]]) -> np.ndarray:
        """The numbers of terms of n words each; -1 where no text has one."""
        place = lambda k: pc.fill_null(pc.index_in(pa.array([t[k] for t in terms], self.words.type), value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = place(0)
        for k in range(1, n):
            last = place(k)
            code = np.where((ids >= 0) & (last >= 0), ids * len(self.words) + last, -1)
            ids = pd.Index(self.keys[k]).get_indexer(code)
        return ids


def by_length(terms: list[str]) -> dict[int, tuple[np.ndarray, list[list[str]]]]:
    """For each number of words: the places of the terms that have so many, and their words."""
    split = [t.split(" ") for t in terms]
    return {n: (np.array([k for k, w in enumerate(split) if len(w) == n]), [w for w in split if len(w) == n]) for n in sorted({len(w) for w in split})}


def _sets(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [pc.fill_null(batch.column(c), False).to_numpy(zero_copy_only=False).astype(bool) for c in names]


def bucket_counts(text: str, names: list[str], sizes: tuple[int, ...], buckets: int, listed: list[str]):
    """For ``mapInArrow``: (bucket, own, ``names``), the counts of a task's runs by bucket, and those of listed terms by place."""
    own = by_length(listed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mine = np.zeros((buckets, len(names)), np.int64), np.zeros((len(listed), len(names)), np.int64)
        for batch in chunks(batches, text):
            grams, sets = Grams(batch.column(text), max(sizes)), _sets(batch, names)
            for n in sizes:
                found = grams.counts(n, sets)
                bucket = (grams.hashes(n) % np.uint64(buckets)).astype(np.int64)
                for k in range(len(names)):
                    total[:, k] += np.bincount(bucket, weights=found[:, k], minlength=buckets).astype(np.int64)
                if n in own:
                    places, terms = own[n]
                    ids = grams.find(n, terms)
                    mine[places[ids >= 0]] += found[ids[ids >= 0]]
        for label, counts in (("bucket", total), ("own", mine)):
            at = np.flatnonzero(counts.any(axis=1))
            key, none = pa.array(at.astype(np.int32)), pa.nulls(len(at), pa.int32())
            yield pa.RecordBatch.from_arrays([key if label == "bucket" else none, key if label == "own" else none, *[pa.array(counts[at, k]) for k in range(len(names))]], ["bucket", "own", *names])

    return count


def term_counts(text: str, names: list[str], sizes: tuple[int, ...], full: np.ndarray | None):
    """For ``mapInArrow``: (term, ``names``), partial counts of the runs whose bucket is ``full``, or of all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            grams, sets = Grams(batch.column(text), max(sizes)), _sets(batch, names)
            for n in sizes:
                found = grams.counts(n, sets)
                at = np.arange(len(found)) if full is None else np.flatnonzero(full[(grams.hashes(n) % np.uint64(len(full))).astype(np.int64)])
                yield pa.RecordBatch.from_arrays([grams.strings(n, at), *[pa.array(found[at, k].astype(np.int64)) for k in range(len(names))]], ["term", *names])

    return count


def known_counts(text: str, terms: list[str]):
    """For ``mapInArrow``: the rows with ``counts`` in place of their texts, how often each holds each of the terms: places in ascending
    order, and numbers."""
    own = by_length(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            grams, held = Grams(batch.column(text), max(own)), []
            for n, (places, split) in own.items():
                ids = grams.find(n, split)
                place = np.full(len(grams.keys[n - 1]) + 1, -1)
                place[ids[ids >= 0]] = places[ids >= 0]
                found, of = grams.levels[n - 1]
                found = place[found]
                held.append(of[found >= 0] * len(terms) + found[found >= 0])
            pairs, times = np.unique(np.concatenate(held), return_counts=True)
            starts = pa.array(np.searchsorted(pairs, np.arange(len(batch) + 1) * len(terms)).astype(np.int32))
            indices = pa.ListArray.from_arrays(starts, pa.array((pairs % len(terms)).astype(np.int32)))
            values = pa.ListArray.from_arrays(starts, pa.array(times.astype(np.float64)))
            kept = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.StructArray.from_arrays([indices, values], ["indices", "values"])], [*kept, "counts"])

    return count


def vectors(numbers: list, idf: list, size: int):
    """For ``arrow_udf`` on ``counts``: sparse vectors of 1 + ln(count) times idf, scaled to length 1. ``numbers`` and ``idf`` hold the place and
    idf of each counted term, null for terms outside the vocabulary."""
    place = np.array([-1 if x is None else x for x in numbers], np.int64)
    factor = np.array([0.0 if x is None else x for x in idf])

    def weigh(counts: pa.Array) -> pa.Array:
        lists, values = pc.struct_field(counts, "indices"), pc.struct_field(counts, "values")
        of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        term = lists.flatten().to_numpy(zero_copy_only=False)
        k = place[term] if len(place) else np.zeros(0, np.int64)
        known = np.flatnonzero(k >= 0)
        known = known[np.argsort(of[known] * size + k[known], kind="stable")]
        of, k, term = of[known], k[known], term[known]
        raw = (1 + np.log(values.flatten().to_numpy(zero_copy_only=False)[known])) * factor[term]
        norm = np.sqrt(np.bincount(of, weights=raw * raw, minlength=len(lists)))
        ends = pa.array(np.searchsorted(of, np.arange(len(lists) + 1)).astype(np.int32))
        indices, weights = pa.ListArray.from_arrays(ends, pa.array(k.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(raw / norm[of]))
        of_all = lambda x, kind: pa.array(np.full(len(lists), x), kind)
        return pa.StructArray.from_arrays([of_all(0, pa.int8()), of_all(size, pa.int32()), indices, weights], ["type", "size", "indices", "values"])

    return weigh


def _packed(numbers: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of whole numbers, each as bytes."""
    data = np.ascontiguousarray(numbers, "<i8")
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(data)])


def _unpacked(rows: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(rows.to_pylist()), "<i8")


class Group:
    """The runs of a group of texts, rows of one id as one text, dealt to ``parts`` by a hash of the run. The order of runs and parts is that
    of the sorted rows, so it is the same each time the group is read."""

    def __init__(self, rows: pa.Table, id_col: str, text: str, sizes: tuple[int, ...], parts: int):
        rows = rows.sort_by([(id_col, "ascending"), (text, "ascending")]).combine_chunks()
        column = lambda name: pa.concat_arrays(rows.column(name).chunks)
        ids = column(id_col).dictionary_encode(null_encoding="encode")
        grams, owner = Grams(column(text), max(sizes)), ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        terms, part, first, own, run, times = [], [], 0, [], [], []
        for n in sizes:
            found, of = grams.levels[n - 1]
            size = len(grams.keys[n - 1])
            pairs, count = np.unique(owner[of] * max(1, size) + found, return_counts=True)
            own.append(pairs // max(1, size))
            run.append(first + pairs % max(1, size))
            times.append(count)
            terms.append(grams.strings(n, np.arange(size)))
            part.append((grams.hashes(n) % np.uint64(parts)).astype(np.int64))
            first += size
        self.ids, self.terms, self.part = ids.dictionary, pa.concat_arrays(terms), np.concatenate(part)
        #: What each text holds: its place among ``ids``, the run, and how often.
        self.own, self.run, self.times = np.concatenate(own), np.concatenate(run), np.concatenate(times)
        self.order = np.argsort(self.part, kind="stable")


def dealt_counts(id_col: str, text: str, sizes: tuple[int, ...], parts: int):
    """For ``applyInArrow`` on a group of texts: (chunk, part, terms, df), a row for each part of runs, with the number of texts that hold each."""

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        group = Group(rows, id_col, text, sizes, parts)
        used, starts = np.unique(group.part[group.order], return_index=True)
        ends = np.append(starts, len(group.order))
        terms = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), group.terms.take(pa.array(group.order)))
        df = np.bincount(group.run, minlength=len(group.order))[group.order]
        chunk = pa.array(np.full(len(used), key[0].as_py(), np.int64))
        return pa.table([chunk, pa.array(used.astype(np.int64)), pc.binary_join(terms, "\n"), _packed(df, ends)], ["chunk", "part", "terms", "df"])

    return count


def summed_counts(rows: pa.Table) -> pa.Table:
    """For ``applyInArrow`` on a part of runs from ``dealt_counts``: (chunk, part, df), the counts of all groups together in the order of each row's runs."""
    lists = pc.split_pattern(pa.concat_arrays(rows.column("terms").chunks), "\n")
    codes = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    total = np.bincount(codes, weights=_unpacked(rows.column("df"))).astype(np.int64)[codes]
    ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    return pa.table([rows.column("chunk"), rows.column("part"), _packed(total, ends)], ["chunk", "part", "df"])


def weights(id_col: str, text: str, sizes: tuple[int, ...], parts: int, n: int):
    """For ``applyInArrow`` on a group of texts and its rows of ``summed_counts``: (id, term, weight) of all runs of each text; ``n`` texts in all."""

    def weigh(rows: pa.Table, counts: pa.Table) -> pa.Table:
        group = Group(rows, id_col, text, sizes, parts)
        df = np.empty(len(group.order), np.int64)
        df[group.order] = _unpacked(counts.sort_by("part").column("df"))
        raw = (1 + np.log(group.times)) * (np.log((1 + n) / (1 + df)) + 1)[group.run]
        norm = np.sqrt(np.bincount(group.own, weights=raw * raw, minlength=len(group.ids)))
        return pa.table([group.ids.take(pa.array(group.own)), group.terms.take(pa.array(group.run)), pa.array(raw / norm[group.own])], [id_col, "term", "weight"])

    return weigh
