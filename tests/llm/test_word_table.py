import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from livetext.llm.encoding import encoder
from livetext.llm.word_table import decode, encode, encode_and_decode, op11_word_table, packed, pieces, split, unpacked, word_table, words

from helpers import ODD, docs

PATH = public_tokenizers.path("byte_bpe_50k.json")
REAL = Tokenizer.from_file(PATH)
TEXTS = st.text(st.one_of(st.characters(max_codepoint=0x24F), st.characters(min_codepoint=0x2000, max_codepoint=0x20AC), st.sampled_from(" \n\t'<|>sé日🙂"), st.characters()), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.booleans())
def test_words_stand_alone(text, special):
    text = text + " <|endoftext|> x" + text if special else text
    text = text.encode("utf-8", "ignore").decode()
    found = words(PATH).of(text)
    assert "".join(found) == text
    assert [i for w in found for i in encoder(PATH).ids(w).tolist()] == REAL.encode(text, add_special_tokens=False).ids


def test_pieces_decode_as_the_library():
    rng, piece = np.random.default_rng(3), dict(pieces(PATH).itertuples(index=False))
    assert len(piece) == 50257
    for _ in range(300):  # random ids cut characters into broken bytes
        ids = rng.integers(0, 50257, 12).tolist()
        assert b"".join(piece[i] for i in ids).decode("utf-8", "replace") == REAL.decode(ids, skip_special_tokens=False)


MANY = [*ODD, (11, "<|endoftext|>"), (12, "a  <|endoftext|>  b\r\n\r\n c"), (13, "it's we'LL   1234 ½²³ …"), (14, "x" * 3000 + " " * 5000 + "y"), (15, "́ ̀ combining   sep")]


@pytest.mark.parametrize("chunk_chars", [1, 40, 8_000_000])
def test_ids_and_texts_are_the_librarys(spark, chunk_chars, monkeypatch):
    monkeypatch.setattr("livetext.llm.word_table.split.__defaults__", ("doc_id", "text", chunk_chars))
    got = encode_and_decode(docs(spark, MANY).repartition(3), PATH).collect()
    want = collections.Counter((i, tuple(REAL.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in MANY)
    assert collections.Counter((r.doc_id, tuple(r.ids), r.text) for r in got) == want
    ids = encode(docs(spark, MANY), PATH)
    assert ids.columns == ["doc_id", "ids"] and collections.Counter((r.doc_id, tuple(r.ids)) for r in ids.collect()) == collections.Counter((i, x) for i, x, _ in want.elements())
    assert collections.Counter((r.doc_id, r.text) for r in decode(ids, PATH, chunk_ids=chunk_chars).collect()) == collections.Counter((i, t) for i, _, t in want.elements())


def test_each_word_is_carried_once_a_chunk(spark):
    rows = split(docs(spark, [(i, "the same words again and the words") for i in range(100)]).coalesce(1), PATH).collect()
    assert sum(len(unpacked(r.parts[3])) for r in rows if len(r.parts) > 2) == 6 and all(len(unpacked(r.parts[1])) == 7 for r in rows)


def test_a_word_in_many_chunks_is_encoded_once(spark):
    found = spark.range(5000).selectExpr("id as place", "if(id % 3 = 0, 'rare' || id, ' the') as word")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    rows = word_table(found, PATH).collect()
    assert sorted(p for r in rows for p in r.places) == list(range(5000)) and all(len(r.places) <= 100 for r in rows)
    assert {tuple(r.ids) for r in rows if len(r.places) > 1} == {tuple(encoder(PATH).ids(" the").tolist())}


def test_odd_ids(spark):
    rows = [(1, None), (2, []), (3, [464, None, 464]), (4, [999_999, 464, -5]), (None, [50256]), (5, [447, 447])]
    got = {r.doc_id: r.text for r in decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect()}
    assert got == {1: "", 2: "", 3: "TheThe", 4: "The", None: "<|endoftext|>", 5: REAL.decode([447, 447])}
    assert decode(spark.createDataFrame([], "doc_id long, ids array<int>"), PATH).collect() == []


def test_empty_tables_and_texts(spark):
    assert encode_and_decode(docs(spark, []), PATH).collect() == []
    assert [(r.doc_id, r.ids, r.text) for r in encode_and_decode(docs(spark, [(1, None), (1, "")]), PATH).collect()] == [(1, [], ""), (1, [], "")]


def test_other_vocabularies_are_an_error():
    with pytest.raises(ValueError):
        words(public_tokenizers.path("word_bpe_49k.json"))


def test_query(spark):
    got = {r.doc_id: r for r in op11_word_table(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(rows)
    for r in rows:
        ids, one = REAL.encode(r.text, add_special_tokens=False).ids, got[r.doc_id]
        assert one.n_tokens == len(ids) and one.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert one.decoded_sha256 == hashlib.sha256(REAL.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("values", [[], [0], [255], [256, 1], [70_000, 3], [4_000_000_000]])
def test_packed_numbers(values):
    assert unpacked(packed(np.array(values, np.int64))).tolist() == values
