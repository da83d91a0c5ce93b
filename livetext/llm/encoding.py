"""Token ids inside tasks.

The ``.json`` vocabulary belongs to the ``tokenizers`` library. Its byte-level BPE is also
published as ranks for ``tiktoken``, which encodes the same text to the same ids about five
times as fast. ``ByteBpe`` uses the ranks for texts in the Latin range, where both libraries'
character classes are known to agree (tests/llm compare them), and ``tokenizers`` itself for
every other text. The special string is one token wherever it stands, as ``tokenizers`` does by default.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re

import numpy as np

SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
OUTSIDE_LATIN = re.compile("[^\u0000-ɏ‐-‧€]")


class ByteBpe:
    def __init__(self, json_path: str):
        import public_tokenizers
        import tiktoken

        self._json_path, self._slow = json_path, None
        with open(json_path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def slow_ids(self, text: str) -> np.ndarray:
        if self._slow is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self._json_path)
            self._slow.no_truncation()
            self._slow.no_padding()
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, text: str) -> np.ndarray:
        if OUTSIDE_LATIN.search(text):
            return self.slow_ids(text)
        if SPECIAL not in text:
            return np.array(self._fast.encode_ordinary(text), np.uint32)
        parts = []
        for k, part in enumerate(text.split(SPECIAL)):
            parts += [[SPECIAL_ID]] * (k > 0) + [self._fast.encode_ordinary(part)]
        return np.array([x for part in parts for x in part], np.uint32)

    def count(self, text: str) -> int:
        if SPECIAL in text or OUTSIDE_LATIN.search(text):
            return len(self.ids(text))
        return len(self._fast.encode_ordinary(text))


class Library:
    """Any other vocabulary file, by its own library."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda text: model.encode(text)
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            one = Tokenizer.from_file(path)
            one.no_truncation()
            one.no_padding()
            self._encode = lambda text: one.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        return np.array(self._encode(text), np.uint32)

    def count(self, text: str) -> int:
        return len(self._encode(text))


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """One encoder for each Python worker."""
    ranks = path.removesuffix(".json") + ".tiktoken"
    return ByteBpe(path) if path.endswith("byte_bpe_50k.json") and os.path.exists(ranks) else Library(path)


def version(path: str) -> str:
    """Digest of the vocabulary file and of the versions of the libraries that read it: counts from another version never match."""
    import importlib.metadata

    libraries = ["sentencepiece"] if path.endswith(".model") else ["tokenizers", "tiktoken"]
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + " ".join(f"{x} {importlib.metadata.version(x)}" for x in libraries).encode()).hexdigest()
