import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from livetext.llm.common import new_path
from livetext.llm.components import components
from livetext.llm.encoding import encoder
from livetext.llm.packing import cut, pack, supersteps
from livetext.llm.simhash import fingerprint, near_links, simhash_components
from livetext.llm.token_counts import count_tokens

from helpers import ODD, docs, union_find

PATH = public_tokenizers.path("byte_bpe_50k.json")
REAL = Tokenizer.from_file(PATH)
TEXTS = st.text(st.one_of(st.characters(max_codepoint=0x24F), st.characters(min_codepoint=0x2000, max_codepoint=0x20AC), st.sampled_from(" \n'<|>sé日🙂")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.booleans())
def test_ids_are_the_librarys(text, special):
    text = text + "<|endoftext|> x" + text if special else text
    want = REAL.encode(text, add_special_tokens=False).ids
    assert encoder(PATH).ids(text).tolist() == want
    assert encoder(PATH).count(text) == len(want)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_and_cache(spark, name):
    cache = new_path(spark, "cache")
    got = collections.Counter(count_tokens(docs(spark, ODD), public_tokenizers.path(name), cache).collect())
    one = encoder(public_tokenizers.path(name))
    want = collections.Counter((i, len((t or "").encode()), one.count(t or ""), one.count(t or "") > 512) for i, t in ODD)
    assert got == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in ODD})
    again = count_tokens(docs(spark, [*ODD, (9, "new")]), public_tokenizers.path(name), cache)
    assert again.count() == len(ODD) + 1 and spark.read.parquet(cache).count() == stored.count() + 1
    for folder in [r.path for r in spark.read.parquet(cache).select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("path")).distinct().collect()]:
        spark.read.parquet(folder).write.mode("append").parquet(folder)  # a second writer had the same misses
    assert collections.Counter(count_tokens(docs(spark, ODD), public_tokenizers.path(name), cache).collect()) == want
    assert count_tokens(docs(spark, []), PATH, new_path(spark, "cache")).collect() == []


def test_cut():
    assert cut(5, 2048) == [(0, 5)] and cut(2048, 2048) == [(0, 2048)]
    assert cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_supersteps_are_best_fit_decreasing(lengths):
    runs = sorted(supersteps(dict(collections.Counter(lengths)), 64))
    gaps = []
    for n in sorted(lengths, reverse=True):  # the sequential rule
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(64 - n)
        else:
            gaps.remove(fit)
            gaps.append(fit - n)
    used, at = collections.defaultdict(list), collections.Counter(lengths)
    for k, (n, rank, first, place) in enumerate(runs):
        end = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == n else at[n]
        for r in range(rank, end):
            used[first + r - rank].append((place, n))
    assert len(used) == len(gaps)
    for parts in used.values():
        assert [p for p, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist() and sum(n for _, n in parts) <= 64


def test_pack(spark):
    rows = [*ODD, *((k, "w " * (k % 37)) for k in range(10, 400))]
    got = pack(docs(spark, rows), PATH, 64).collect()
    pieces = collections.Counter()
    for i, t in rows:
        ids = np.array([*encoder(PATH).ids(t or ""), 0], "<u4")
        pieces.update((i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), 64)))
    assert collections.Counter(tuple(r)[:5] for r in got) == pieces
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:k]) for k, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= 64
    assert pack(docs(spark, []), PATH).collect() == []


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_sparks_hash(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] % 2**64 == xxhash.xxh64_intdigest("a b c", 42)
    for _, t in ODD:
        assert fingerprint(t or "", 3) % 2**64 == plain_fingerprint(t)


def test_simhash_components(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(50)) for _ in range(120)) for _ in range(6)]
    rows = list(ODD)
    for k in range(160):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = "x"
        rows.append((100 + k, " ".join(words)))
    rows += [(900 + k, base[0]) for k in range(30)]
    got = simhash_components(docs(spark, rows), 3).collect()
    assert len(got) == len(rows)
    prints = {}
    for i, t in rows:
        prints.setdefault(plain_fingerprint(t), []).append(i)
    at = list(prints)
    classes = union_find(at, [(a, b) for a in at for b in at if a < b and bin(a ^ b).count("1") <= 2])
    least = {}
    for p, c in classes.items():
        least[c] = min([x for x in prints[p] if x is not None] + ([least[c]] if least.get(c) is not None else []), default=None)
    want = collections.Counter((i, plain_fingerprint(t), least[classes[plain_fingerprint(t)]]) for i, t in rows)
    assert collections.Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want
    assert simhash_components(docs(spark, []), 3).collect() == []


def test_crowded_cells_keep_components(spark):
    rng = random.Random(5)
    values = {0}
    for _ in range(300):
        x = rng.choice(sorted(values))
        for _ in range(rng.choice([1, 2, 3])):
            x ^= 1 << rng.randrange(64)
        values.add(x)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    values = [signed(v) for v in values]
    links = [tuple(r) for r in near_links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()]
    near = lambda a, b: bin((a ^ b) % 2**64).count("1") <= 2
    assert all(near(a, b) for a, b in links)
    assert union_find(values, links) == union_find(values, [(a, b) for a in values for b in values if a < b and near(a, b)])


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 80)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(80)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union_find({x for link in links for x in link}, links)
    assert len(set(zip(got.values(), (want[n] for n in got)))) == len(set(got.values())) == len({want[n] for n in got})
    assert {n for n in want if n not in got} <= {a for a, b in links if a == b}
