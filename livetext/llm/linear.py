"""Small linear models on hashed word features, fitted on bounded samples and applied inside tasks.

A word's features are itself, its first four, five and six letters and its last three, hashed into one table of
weights. A text's score is the sum over its distinct words, so a word's own sum is computed once a worker.
``shape`` adds what a text looks like whatever its words are.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

WORD = re.compile(r"[^\W\d_]+")
BITS = 18
#: Kinds of characters for ``shape``: letters, capitals, digits, symbols, others. Beyond the table all count as letters.
LETTER, CAPITAL, DIGIT, SYMBOL, OTHER = range(5)


def _kind(c: str) -> int:
    if c.isalpha():
        return CAPITAL if c.isupper() else LETTER
    return DIGIT if c.isdigit() else OTHER if c.isspace() or c in ".,;:'\"()-_" else SYMBOL


KINDS = np.array([_kind(chr(c)) for c in range(0x2100)] + [LETTER], np.uint8)


def word_features(word: str) -> list[int]:
    parts = ["=" + word] + ["^" + word[:n] for n in (4, 5, 6) if len(word) > n] + ["$" + word[-3:]] * (len(word) > 3)
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for p in parts]


def distinct_words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


#: Columns of ``shape``.
SHAPES = ("symbols", "capitals", "digits", "word length", "distinct words")


def shape(text: str) -> list[float]:
    """Shares of symbols, capitals and digits, mean length of words (in tens, 3 at most) and share of distinct words."""
    n = max(len(text), 1)
    words = text.split()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(KINDS[np.minimum(codes, len(KINDS) - 1)], minlength=5).tolist()
    return [counts[SYMBOL] / n, counts[CAPITAL] / max(counts[LETTER] + counts[CAPITAL], 1), counts[DIGIT] / n, min(len(text) / max(len(words), 1) / 10, 3), len(set(words)) / max(len(words), 1)]


class Scores:
    """Sums of weights by word, kept for the words seen last; ``weights`` is (features, outputs)."""

    MOST = 500_000

    def __init__(self, weights: np.ndarray):
        self.weights, self.seen = weights, {}

    def text(self, text: str) -> np.ndarray:
        total, seen = np.zeros(self.weights.shape[1]), self.seen
        fresh = []
        rows = []
        for w in distinct_words(text):
            s = seen.get(w)
            if s is None:
                fresh.append(w)
            else:
                rows.append(s)
        if len(seen) + len(fresh) > self.MOST:
            seen.clear()  # a bound on memory only: words are scored again when met
        for w in fresh:
            s = seen[w] = tuple(self.weights[word_features(w)].sum(0).tolist())
            rows.append(s)
        for k, part in enumerate(zip(*rows, strict=True)):
            total[k] = sum(part)
        return total


def text_features(text: str) -> list[int]:
    return [f for w in distinct_words(text) for f in word_features(w)]


def sparse(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Row starts and feature numbers of rows of features."""
    idx = [np.asarray(r, np.int32) for r in rows]
    return np.cumsum([0] + [len(i) for i in idx]), np.concatenate(idx) if idx else np.empty(0, np.int32)


def telling(starts: np.ndarray, idx: np.ndarray, y: np.ndarray, least: float = 8.0) -> np.ndarray:
    """Features whose presence in a text goes with the label (likelihood ratio G of the 2 x 2 table)."""
    n, n1 = len(y), y.sum()
    a, df = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for k in range(n):  # row by row: memory for one text at a time
        found = np.unique(idx[starts[k] : starts[k + 1]])
        df[found] += 1
        a[found] += y[k]
    g = np.zeros(1 << BITS)
    for seen, given, of in ((a, df, n1), (df - a, df, n - n1), (n1 - a, n - df, n1), (n - n1 - df + a, n - df, n - n1)):
        want = given * of / n
        g += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(want, 1e-12)), 0)
    return g >= least


def fit_logistic(starts: np.ndarray, idx: np.ndarray, dense: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 120, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the hashed features and of (dense columns, bias) by Adam on the whole log loss;
    only telling features count, so that a long text's many neutral words add nothing. Dense columns are brought to one scale."""
    n, size = len(y), 1 << BITS
    keep = telling(starts, idx, y)[idx]
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))[keep]
    used, cols = np.unique(idx[keep], return_inverse=True)
    dense = dense.reshape(n, -1)
    mean, spread = dense.mean(0), np.maximum(dense.std(0), 1e-6)
    extra = np.column_stack([(dense - mean) / spread, np.ones(n)])
    w, v = np.zeros(len(used)), np.zeros(extra.shape[1])
    m1, m2 = np.zeros(len(used) + len(v)), np.zeros(len(used) + len(v))
    share = min(max(y.mean(), 1 / (n + 1)), 1 - 1 / (n + 1))
    v[-1] = np.log(share / (1 - share))
    for t in range(1, steps + 1):
        z = np.bincount(row, w[cols], n) + extra @ v
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        e = (p - y) / n
        g = np.concatenate([np.bincount(cols, e[row], len(used)) + l2 * w, extra.T @ e])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, v = w - step[: len(w)], v - step[len(w) :]
    out = np.zeros(size)
    out[used] = w
    v[:-1] /= spread
    v[-1] -= v[:-1] @ mean
    return out, v


def apply_logistic(starts: np.ndarray, idx: np.ndarray, dense: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    n = len(starts) - 1
    row = np.repeat(np.arange(n), np.diff(starts))
    z = np.bincount(row, w[idx], n) + np.column_stack([dense.reshape(n, -1), np.ones(n)]) @ v
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
