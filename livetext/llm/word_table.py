"""Operator 11, byte-level BPE by a table of distinct words, and decoding by a table of pieces.

1. Tasks split their texts into the tokenizer's words (pre-tokens) and number them by first appearance in a chunk of
   texts of at most ``CHUNK_CHARS`` characters (a longer text is a chunk of its own). A text becomes its list of word
   numbers, with the words that are new in the chunk.
2. The chunks' words are dealt out and sorted by word. Each distinct word is encoded once, its ids are joined to the
   vocabulary's pieces, and both go back to the chunks that have the word.
3. In each chunk ids are put at the words' positions, and pieces at the ids' positions.

So the joins carry each word once for each chunk, not once for each place where it stands, and a word that is in every text
is a row for each chunk. The only table that is sent to all tasks is the vocabulary (as many rows as its file has tokens).

Chunks are numbered inside the tasks that read the input. A task that is run again must meet the same rows in the same order,
as it does where ``docs`` is read from files; write out what comes from a shuffle first.

Words are those of the ``tokenizers`` library: texts in the Latin range are split by the published pattern, where character
classes agree, all others by the library's own pre-tokenizer. Added tokens such as ``<|endoftext|>`` are words of one id
wherever they stand, the library's default. Only byte-level BPE files without a normalizer can be read this way; others are
an error.

Null text is the empty text: no ids, empty decoded text. Null ids inside lists count as absent, a null list is empty, an id
that the vocabulary lacks decodes to nothing. Rows may repeat in any column: each keeps its row. An empty table gives an
empty result. Other columns are not read. A text is split and joined in one task, so its length is bounded by a task's memory.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from livetext.llm.common import small_batches, table, whole, written
from livetext.llm.encoding import OUTSIDE_LATIN, encoder

CHUNK_CHARS = 32_000_000
#: Compression of what is shuffled.
LEVEL = 9


class Words:
    """The tokenizer's words of a text."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        before, model = file["pre_tokenizer"] or {}, file["model"]
        if file["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or model["type"] != "BPE":
            raise ValueError(f"{path}: only byte-level BPE without a normalizer has words that stand alone")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take in their surroundings are not supported")
        added = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.latin, self.library = regex.compile(public_tokenizers.PATTERN), Tokenizer.from_file(path).pre_tokenizer

    def _plain(self, text: str) -> list[str]:
        if OUTSIDE_LATIN.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.latin.findall(text)

    def of(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return self._plain(text)
        return [w for k, part in enumerate(self.added.split(text)) if part for w in ([part] if k % 2 else self._plain(part))]


@functools.lru_cache(maxsize=4)
def words(path: str) -> Words:
    return Words(path)


def pieces(path: str) -> pd.DataFrame:
    """(id, piece) of a byte-level vocabulary: bytes are written as characters, printable ones as themselves and the
    others, in order, as those from U+0100 on; a token with any other character stands for its own text."""
    from tokenizers import Tokenizer

    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    known = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    rows = [(i, bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()) for t, i in known.items()]
    return pd.DataFrame(rows, columns=["id", "piece"])


def packed(values: np.ndarray) -> bytes:
    """Non-negative whole numbers in the fewest bytes that hold the largest, first bytes first, compressed: the tables here hold a
    number for each word of the corpus."""
    most = int(values.max(initial=0))
    size = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    planes = np.frombuffer(values.astype(f"<u{size}").tobytes(), np.uint8).reshape(-1, size).T
    return b"%d" % size + zstandard.compress(planes.tobytes(), LEVEL)


def unpacked(data: bytes) -> np.ndarray:
    size = int(data[:1])
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(size, -1)
    return np.frombuffer(planes.T.tobytes(), f"<u{size}").astype(np.int64)


class Numbers(dict):
    """Numbers by first appearance."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


#: Bits of a chunk's number that count a task's chunks, and bits of a word's number: both make up its place.
CHUNKS_OF_TASK, KEY = 14, 28
SPLIT = "chunk long, parts array<binary>"
#: Places in ``parts``.
DOC_ID, PLACES, FIRST, SIZES, WORDS = range(5)


def split(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Texts as numbers of words in their chunk. ``parts`` is the id, the (packed) numbers and, in the last text of a batch, the
    words that no earlier batch of the chunk has: the first one's number, their sizes and their bytes. One column, so that all
    uses of it read the same shuffle files."""

    def number(batches):
        of, known, chars, chunk = words(tokenizer).of, Numbers(), 0, TaskContext.get().partitionId() << CHUNKS_OF_TASK
        for batch in batches:
            rows, first = [], len(known)

            def with_words():
                new = [w.encode() for w in itertools.islice(reversed(known), len(known) - first)][::-1]
                if new:
                    rows[-1][1].extend([b"%d" % first, packed(np.array([len(w) for w in new])), zstandard.compress(b"".join(new), LEVEL)])  # noqa: B023

            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if known and chars + len(text) > chunk_chars:
                    if rows:
                        with_words()
                    known, first, chars, chunk = Numbers(), 0, 0, chunk + 1
                    if not chunk & (1 << CHUNKS_OF_TASK) - 1:
                        raise OverflowError("a task has more chunks than can be numbered")
                found = of(text)
                places = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
                chars += len(text)
                rows.append((chunk, [b"" if doc_id is None else b"%d" % doc_id, packed(places)]))
            if rows:
                with_words()
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.binary()))], names=["chunk", "parts"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(number, SPLIT)


def new_words(rows: DataFrame) -> DataFrame:
    """(place, word) of the split table; a place is a chunk's number and a word's number in it."""

    def unpack(batches):
        for batch in batches:
            for chunk, parts in zip(batch.column("chunk").to_pylist(), batch.column("parts"), strict=True):
                if len(parts) > WORDS:
                    sizes, data = unpacked(parts[SIZES].as_py()), zstandard.decompress(parts[WORDS].as_py())
                    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                    found = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(data)).cast(pa.string())
                    first = int(parts[FIRST].as_py())
                    if first + len(sizes) > 1 << KEY:
                        raise OverflowError("a text has more distinct words than can be numbered")
                    yield pa.RecordBatch.from_arrays([pa.array((chunk << KEY) + np.arange(first, first + len(sizes))), found], names=["place", "word"])

    return rows.mapInArrow(unpack, "place long, word string")


def word_table(found: DataFrame, tokenizer: str) -> DataFrame:
    """(ids, places): the ids of each distinct word of ``found`` (place, word), and where it stands. A word is encoded once; one in very
    many places has several rows."""

    def encode(batches):
        ids_of, last, ids = encoder(tokenizer).ids, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = batch.column("word").dictionary_encode()  # sorted: a word's rows are neighbours
            rows = []
            for word in runs.dictionary.to_pylist():
                if word != last:
                    last, ids = word, ids_of(word).astype(np.int32)
                rows.append(ids)
            cuts = np.searchsorted(np.array(runs.indices), np.arange(len(rows) + 1))
            places = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), batch.column("place"))
            yield pa.RecordBatch.from_arrays([_lists(np.concatenate(rows), np.cumsum([0, *map(len, rows)])), places], names=["ids", "places"])

    return found.repartition("word").sortWithinPartitions("word").mapInArrow(encode, "ids array<int>, places array<long>")


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of the runs with these starts and lengths, one after another."""
    return np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    lengths = np.array(column.value_lengths().fill_null(0), np.int64)
    return np.array(column.flatten().fill_null(0)), np.concatenate([[0], np.cumsum(lengths)])


def _texts(local: np.ndarray, ends: np.ndarray, piece: list[bytes]) -> list[str]:
    """Decoded texts of documents whose tokens are places in ``piece``; ``ends`` bounds the documents' tokens."""
    sizes = np.array([len(p) for p in piece], np.int64)
    starts, every = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(piece), np.uint8)
    lengths = sizes[local] if len(local) else np.zeros(0, np.int64)
    data = every[_runs(starts[local], lengths)].tobytes() if len(local) else b""
    cuts = np.concatenate([[0], np.cumsum(lengths)])[ends]
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


TEXT = "doc_id long, text string"


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


TABLE = "of long, keys binary, at binary, ids binary, known binary, pieces array<binary>"
#: Tokens of a task's share of the chunks' tables that are packed at once.
HELD = 1_500_000


def _chunk_tables(found: DataFrame) -> DataFrame:
    """Tokens of words (at, id, piece, places) as one row for each task and chunk: of each token its word's key, its place in
    the word and its id; and the pieces of these ids."""

    def pack(batches):
        held, n = [], 0

        def flush():
            rows = pa.Table.from_batches(held)
            places, bounds = _flat(rows["places"])
            chunk, keys = places >> KEY, places & (1 << KEY) - 1
            each = np.repeat(np.arange(rows.num_rows), np.diff(bounds))
            at, ids = np.array(rows["at"], np.int64)[each], np.array(rows["id"], np.int64)
            piece = dict(zip(ids.tolist(), rows["piece"].to_pylist(), strict=True))
            ids = ids[each]
            order = np.lexsort((at, keys, chunk))
            cuts = np.nonzero(np.diff(chunk[order], prepend=chunk[order[0]] - 1))[0]
            out = []
            for mine in np.split(order, cuts[1:]):
                known = np.unique(ids[mine])
                out.append((int(chunk[mine[0]]), packed(np.diff(keys[mine], prepend=0)), packed(at[mine]), packed(ids[mine]), packed(known), [piece[i] for i in known.tolist()]))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), *[pa.binary()] * 4, pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in TABLE.split(", ")])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += len(batch.column("places").flatten())
            if n >= HELD:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return found.mapInArrow(pack, TABLE)


def encode_and_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", then: Callable[[np.ndarray, str], tuple] | None = None, schema: str = "ids array<int>, text string") -> DataFrame:
    """(doc_id, ids, text) for each row of ``docs``; ``text`` is decoded from the ids. The same as ``decode(encode(docs))``,
    but ids meet their pieces once for each distinct word. ``then`` makes other columns (``schema``) of each row's ids and text
    where they come to be, so that what is only digested or counted needn't leave its task."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = split(docs, tokenizer, id_col, text_col).repartition("chunk")
    found = word_table(new_words(rows), tokenizer)
    vocabulary = spark.createDataFrame(pieces(tokenizer), "id int, piece binary")
    tokens = found.select("places", F.posexplode("ids").alias("at", "id"))
    tables = _chunk_tables(tokens.join(F.broadcast(vocabulary), "id").select("at", "id", "piece", "places"))  # as many rows as the vocabulary has tokens

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        column = lambda c: np.concatenate([none, *map(unpacked, right[c].to_pylist())])
        keys = np.concatenate([none, *[np.cumsum(unpacked(x)) for x in right["keys"].to_pylist()]])
        ids, order = column("ids"), np.lexsort((column("at"), keys))
        ids, counts = ids[order], np.bincount(keys)
        starts = np.cumsum(counts) - counts
        piece = dict(zip(column("known").tolist(), (p for row in right["pieces"].to_pylist() for p in row), strict=True))
        known = np.array(sorted(piece), np.int64)
        piece, local = [piece[i] for i in known.tolist()], np.searchsorted(known, ids)
        rows = []
        for row in left["parts"]:  # text by text: only the results of a chunk are held
            places = unpacked(row[PLACES].as_py())
            own = _runs(starts[places], counts[places])
            doc_id, text = row[DOC_ID].as_py(), b"".join([piece[k] for k in local[own].tolist()]).decode("utf-8", "replace")
            made = ids[own].astype(np.int32), text
            rows.append((int(doc_id) if doc_id else None, *(then(*made) if then else made)))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    arrow = to_arrow_schema(_parse_datatype_string(f"doc_id long, {schema}"))
    return rows.groupBy("chunk").cogroup(tables.groupBy("of")).applyInArrow(place, f"doc_id long, {schema}")


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for each row of ``docs``."""
    return encode_and_decode(docs, tokenizer, id_col, text_col).select("doc_id", "ids")


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids", chunk_ids: int = 2_000_000) -> DataFrame:
    """(doc_id, text) for each row of ``encoded`` (an id and an array of token ids)."""
    spark = encoded.sparkSession
    small_batches(spark)

    def number(batches):
        known, n, chunk = set(), 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            chunks, news = [], []
            values, offsets = _flat(batch.column(1))
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if n and n + b - a > chunk_ids:
                    known, n, chunk = set(), 0, chunk + 1
                new = set(np.unique(values[a:b]).tolist()) - known
                known |= new
                n += b - a
                chunks.append(chunk)
                news.append(sorted(new))
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), batch.column(0), _lists(values, offsets), pa.array(news, pa.list_(pa.int32()))], names=["chunk", "doc_id", "ids", "new"])

    own = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.filter(F.col(ids_col), lambda x: x.isNotNull()).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    rows = written(own.mapInArrow(number, "chunk long, doc_id long, ids array<int>, new array<int>"), "ids-by-chunk")
    vocabulary = spark.createDataFrame(pieces(tokenizer), "id int, piece binary")
    found = rows.select("chunk", F.explode("new").alias("id")).join(F.broadcast(vocabulary), "id")

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        values, bounds = _flat(left["ids"])
        keys = np.array(right["id"], np.int32)
        order = np.argsort(keys, kind="stable")
        piece = right["piece"].to_pylist()
        piece = [piece[k] for k in order] + [b""]
        local = np.searchsorted(keys[order], values)
        local[np.append(keys[order], -1)[local] != values] = len(piece) - 1
        return pa.table({"doc_id": left["doc_id"], "text": pa.array(_texts(local, bounds, piece), pa.string())})

    left, right = rows.select(F.col("chunk").alias("part"), "doc_id", "ids"), found.select(F.col("chunk").alias("of"), "id", "piece")
    return left.groupBy("part").cogroup(right.groupBy("of")).applyInArrow(place, TEXT)


def op11_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    def digests(ids: np.ndarray, text: str) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    return encode_and_decode(docs, path, then=digests, schema="n_tokens long, ids_sha256 string, decoded_sha256 string")
