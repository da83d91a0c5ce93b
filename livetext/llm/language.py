"""Operator 3, language identification by a linear-chain conditional random field.

Each word of a text gets a distribution over the languages by forward-backward over the whole text: affixes,
letter n-grams and a learned lexicon give a word's scores, learned transitions tie neighbours. So a text that
switches language is labelled word by word; its own language is the one with the largest expected number of
words, and the score is that number's share.

The model is fitted on a bounded sample: ``per_lang`` labelled texts of each language, taken in the order of a hash
of the id. Their words are cut into segments that are chained across languages, so that transitions are learned
from switches too. The labels are the values of the label column.

Prediction is one pass without a shuffle; a whole text is labelled in one task, however long it or a word of it is. Null text and text without letters give ``und`` with score 0, as does any text
where no labelled text was given. Repeated rows and ids keep their rows; ties go to the first language in sorted
order. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from livetext.llm.common import small_batches, table, whole

WORD = re.compile(r"[^\W\d_]+")
BITS = 16
PIECE = 24
OUT = "doc_id long, lang_pred string, score double"


def words_of(text: str) -> list[str]:
    """Runs of letters; a run of more than ``PIECE`` (glued text, scripts without spaces) is cut into pieces, each a place
    of the chain. A dash marks the side where a piece goes on."""
    out = []
    for run in WORD.findall(text.lower()):
        # number characters such as ½ or ② are no letters
        for w in (run,) if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split():
            if len(w) <= PIECE:
                out.append(w)
            else:
                out += [("-" if k else "") + w[k : k + PIECE] + ("-" if k + PIECE < len(w) else "") for k in range(0, len(w), PIECE)]
    return out


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    padded = ("" if word[0] == "-" else "<") + word.strip("-") + ("" if word[-1] == "-" else ">")
    parts = [padded[:2], padded[:3], padded[:4], padded[-2:], padded[-3:], padded[-4:]]
    parts += [padded[k : k + 3] for k in range(len(padded) - 2)] + ["#" + c for c in word if c > "\x7f"]
    if word in lexicon:
        parts.append(f"lexicon {lexicon[word]}")
        parts.append("=" + word)
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for p in parts]


def marginal_sums(emit: np.ndarray, trans: np.ndarray, ids: list[np.ndarray], sums: bool = True):
    """Forward-backward over many sequences at once; ``ids`` index rows of ``emit`` (exponentiated scores).

    Sequences run side by side, longest first, so that step t holds those that are longer than t. Returns
    the sum of each sequence's marginals, or all marginals by step with the pairwise expectations' sum.
    """
    order = np.argsort([-len(s) for s in ids], kind="stable")
    lengths = np.array([len(ids[k]) for k in order])
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), "left")
    starts = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty(starts[-1], np.int64)
    for row, k in enumerate(order):
        flat[starts[: len(ids[k])] + row] = ids[k]
    e = emit[flat]
    alpha = np.empty_like(e)
    last = None
    for t in range(steps):
        a = e[starts[t] : starts[t + 1]]
        if t:
            a = a * (last[: active[t]] @ trans)
        a = a / a.sum(1, keepdims=True)
        alpha[starts[t] : starts[t + 1]] = last = a
    beta = np.ones((0, emit.shape[1]), emit.dtype)
    pairs = np.zeros_like(trans)
    for t in range(steps - 1, -1, -1):
        at = slice(starts[t], starts[t + 1])
        full = np.ones((active[t], emit.shape[1]), emit.dtype)
        if len(beta):
            onward = e[starts[t + 1] : starts[t + 2]] * beta
            if not sums:
                p = alpha[at][: len(onward), :, None] * trans[None] * onward[:, None, :]
                pairs += (p / p.sum((1, 2), keepdims=True)).sum(0)
            full[: len(onward)] = onward @ trans.T
            full /= full.sum(1, keepdims=True)
        beta = full
        alpha[at] *= beta
    alpha /= alpha.sum(1, keepdims=True)
    if not sums:
        return alpha, flat, pairs
    out = np.zeros((len(ids), emit.shape[1]))
    for t in range(steps):
        out[: active[t]] += alpha[starts[t] : starts[t + 1]]
    back = np.empty_like(out)
    back[order] = out
    return back


class Crf:
    """Weights of hashed features by language, transitions, and the lexicon; a fixed size but for the lexicon, which
    the sample bounds."""

    def __init__(self, langs: list[str], weights: np.ndarray, trans: np.ndarray, lexicon: dict[str, int]):
        self.langs, self.weights, self.trans, self.lexicon = langs, weights.astype(np.float32), np.exp(trans).astype(np.float32), lexicon

    def emission(self, word: str) -> np.ndarray:
        s = self.weights[features(word, self.lexicon)].sum(0)
        return np.maximum(np.exp(s - s.max()), np.float32(1e-12))


def fit(rows: list[tuple[str, str]], steps: int = 30, segment: int = 24, rate: float = 0.1, l2: float = 1e-3, seed: int = 7) -> Crf | None:
    """A CRF from (text, language) pairs, by Adam on the conditional log-likelihood."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    k = len(langs)
    vocab: dict[str, int] = {}
    segments = []
    for text, lang in rows:
        ids = np.array([vocab.setdefault(w, len(vocab)) for w in words_of(text)], np.int64)
        segments += [(ids[at : at + segment], langs.index(lang)) for at in range(0, len(ids), segment)]
    if not segments:
        return Crf(langs, np.zeros((1 << BITS, k)), np.zeros((k, k)), {})
    counts = np.zeros((len(vocab), k))
    for ids, y in segments:
        np.add.at(counts[:, y], ids, 1)
    top = counts.argmax(1)
    sure = (counts.sum(1) >= 5) & (counts.max(1) >= 0.8 * counts.sum(1))
    lexicon = {w: int(top[i]) for w, i in vocab.items() if sure[i]}
    feats = [features(w, lexicon) for w in vocab]
    owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    used, cols = np.unique(np.concatenate([np.array(f) for f in feats]), return_inverse=True)

    order = np.random.default_rng(seed).permutation(len(segments))
    chains, labels = [], []  # four segments each, of whatever languages the shuffle brings together
    for at in range(0, len(order), 4):
        part = [segments[i] for i in order[at : at + 4]]
        chains.append(np.concatenate([ids for ids, _ in part]))
        labels.append(np.concatenate([np.full(len(ids), y) for ids, y in part]))
    gold = np.zeros((len(vocab), k))
    gold_pairs = np.zeros((k, k))
    for ids, y in zip(chains, labels, strict=True):
        np.add.at(gold, (ids, y), 1)
        np.add.at(gold_pairs, (y[:-1], y[1:]), 1)
    total = gold.sum()
    w, trans = np.zeros((len(used), k)), np.zeros((k, k))
    m = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
    sum_by = lambda index, values, size: np.column_stack([np.bincount(index, values[:, c], size) for c in range(k)])
    for t in range(1, steps + 1):
        s = sum_by(owner, w[cols], len(vocab))
        emit = np.maximum(np.exp(s - s.max(1, keepdims=True)), 1e-12)
        marg, flat, pairs = marginal_sums(emit, np.exp(trans), chains, sums=False)
        diff = gold - sum_by(flat, marg, len(vocab))
        grads = (-(sum_by(cols, diff[owner], len(used))) / total * 50 + l2 * w, (pairs - gold_pairs) / total * 50 + l2 * trans)
        for x, g, a in ((w, grads[0], 0), (trans, grads[1], 2)):
            m[a] = 0.9 * m[a] + 0.1 * g
            m[a + 1] = 0.999 * m[a + 1] + 0.001 * g * g
            x -= rate * (m[a] / (1 - 0.9**t)) / (np.sqrt(m[a + 1] / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros((1 << BITS, k))
    weights[used] = w
    return Crf(langs, weights, trans, lexicon)


def sample(docs: DataFrame, keep, per_lang: int) -> list[tuple[str, str]]:
    """At most ``per_lang`` (text, lang) of each language, first by id and then joined for their texts."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # a rank with a bound: each task sends at most per_lang ids of a language
    chosen = docs.filter(keep & F.col("lang").isNotNull()).select("doc_id", "lang").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_lang).select("doc_id").distinct()
    texts = docs.filter(keep & F.col("lang").isNotNull()).select("doc_id", whole("text").alias("text"), "lang")
    found = texts.join(F.broadcast(chosen), "doc_id", "left_semi")
    # ids may repeat: the bound holds for rows too
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text"))
    return [(r.text, r.lang) for r in found.withColumn("rank", rank).filter(F.col("rank") <= per_lang).orderBy("doc_id", "text").collect()]


class Labeller:
    """Word rows of one worker; words seen are kept up to a bound."""

    MOST, WORDS = 400_000, 1_000_000

    def __init__(self, model: Crf):
        self.model, self.ids, self.emit = model, {}, []

    def indexed(self, text: str) -> np.ndarray:
        words, ids = words_of(text), self.ids
        for w in set(words).difference(ids):
            ids[w] = len(self.emit)
            self.emit.append(self.model.emission(w))
        return np.array([ids[w] for w in words], np.int32)

    def distributions(self, found: list[np.ndarray]) -> list[tuple[str, float]]:
        out = [("und", 0.0)] * len(found)
        some = [k for k, ids in enumerate(found) if len(ids)]
        if some:
            sums = marginal_sums(np.array(self.emit, np.float32), self.model.trans, [found[k] for k in some])
            sums /= sums.sum(1, keepdims=True)
            for k, p in zip(some, sums, strict=True):
                out[k] = (self.model.langs[int(p.argmax())], float(p.max()))
        if len(self.emit) > self.MOST:
            self.ids, self.emit = {}, []  # a bound on memory only: words are scored again when met
        return out


def identify(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def label(batches):
        one = Labeller(shared.value) if shared.value else None
        held, found, words = [], [], 0

        def flush():
            langs = one.distributions(found) if one else [("und", 0.0)] * len(held)
            return pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array([a for a, _ in langs], pa.string()), pa.array([b for _, b in langs], pa.float64())], names=["doc_id", "lang_pred", "score"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = one.indexed(text.as_py()) if one else []
                held.append(doc_id)
                found.append(ids)
                words += len(ids)
                if words >= Labeller.WORDS:
                    yield flush()
                    held, found, words = [], [], 0
        if held:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(label, OUT)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op3_language_crf(spark: SparkSession, sf_dir: str, per_lang: int = 150) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(sample(docs, ~held_out(F.col("doc_id")), per_lang))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
