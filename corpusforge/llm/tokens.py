"""Token ids of whole texts by a public word-level BPE vocabulary, vectorised over Arrow batches.

The vocabulary's own library encodes each distinct word once a Python worker; texts are then cut into
words and mapped to ids with NumPy. Cutting follows the vocabulary file's declared steps: NFC, white
space as separator, lower case, then contractions, letter runs, single digits, and runs of the rest.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa

from .text import RADIX, mix, powers

#: White space of the Unicode property White_Space (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Contractions that the vocabulary keeps as words (fixed values).
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
SPACE, LETTER, DIGIT, OTHER = range(4)
KEPT_WORDS = 500_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = DIGIT
    out[WHITE] = SPACE
    return out


class WordTokenizer:
    """Ids of batches of texts; keeps the ids of words seen (at most KEPT_WORDS of them)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.encode_special_tokens = True
        self.classes = _classes()
        vocab = self.inner.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16 if len(self.closes) <= 1 << 16 else np.uint32)
        self.at = np.zeros(1, np.int64)

    def _learn(self, words: list[str], keys: np.ndarray) -> None:
        got = np.array(self.inner.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.closes[got]) + 1
        if len(ends) != len(words):  # a word of which the vocabulary lacks a part
            each = [e.ids for e in self.inner.encode_batch_fast(words, add_special_tokens=False)]
            ends = np.cumsum([len(x) for x in each])
            got = np.array([i for x in each for i in x], np.int64)
        base = len(self.at) - 1
        self.at = np.concatenate([self.at, self.at[-1] + ends])
        self.ids = np.concatenate([self.ids, got.astype(self.ids.dtype)])
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.slot = np.insert(self.slot, place, np.arange(base, base + len(keys)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (with one more at the end)."""
        joined = "\n".join(texts)
        if not joined.isascii() and not unicodedata.is_normalized("NFC", joined):
            texts = [unicodedata.normalize("NFC", t) for t in texts]
        texts = [t.replace("Σ", "σ").lower() for t in texts]
        joined = "\n".join(texts)
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        kind = self.classes[cps]
        change = np.empty(len(cps) + 1, bool)
        change[0] = change[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
        change[1:-1] |= kind[1:] == DIGIT
        starts = np.flatnonzero(change[:-1])
        if "'" in joined:
            starts = self._contractions(joined, cps, kind, change, starts)
        ends = np.append(starts[1:], len(cps))
        full = kind[starts] != SPACE if len(starts) else np.zeros(0, bool)
        starts, ends = starts[full], ends[full]
        up, down = powers(len(cps))
        total = np.zeros(len(cps) + 1, np.uint64)
        np.cumsum((cps.astype(np.uint64) + np.uint64(77)) * RADIX * up[: len(cps)], out=total[1:])
        keys = mix((total[ends] - total[starts]) * down[starts])
        keys, where, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > KEPT_WORDS:
            self._forget()
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = self.keys[place] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            self._learn([joined[a:b] for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)], keys[new])
            place = np.searchsorted(self.keys, keys)
        slot = self.slot[place][back] if len(keys) else np.zeros(0, np.int64)
        sizes = self.at[slot + 1] - self.at[slot]
        out_at = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=out_at[1:])
        ids = self.ids[np.repeat(self.at[slot] - out_at[:-1], sizes) + np.arange(out_at[-1])]
        return ids, out_at[np.searchsorted(starts, first)]

    @staticmethod
    def _contractions(joined: str, cps: np.ndarray, kind: np.ndarray, change: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Word starts, where an apostrophe that stands alone takes the letters of a contraction along."""
        drop, more = [], []
        alone = np.flatnonzero((cps == 0x27) & change[:-1] & change[1:])
        for p in alone.tolist():
            found = next((c for c in CONTRACTIONS if joined.startswith(c, p)), None)
            if found:
                drop.append(p + 1)
                if p + len(found) < len(cps) and kind[p + len(found)] == LETTER:
                    more.append(p + len(found))
        return np.union1d(np.setdiff1d(starts, drop), np.array(more, np.int64)) if drop else starts


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker and path; its word store lives as long as the worker."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with end_id after those of each text."""
    return np.insert(ids, at[1:], end_id), at + np.arange(len(at))


def binary(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """One little-endian binary value a text."""
    wide = ids.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * wide).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids).astype(ids.dtype.newbyteorder("<")))])
