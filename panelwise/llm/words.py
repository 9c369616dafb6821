"""Words of texts and hashes of runs of words, a whole batch of texts at a time.

A word is a run of digits, letters a-z (A-Z are lower-cased) and characters from U+0080 on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from panelwise.llm.base import mix

_BASE = 0x9E3779B97F4A7C15
_KEPT: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    have = _KEPT.get("power")
    if have is None or len(have) < n:
        size = 1 << max(19, (n - 1).bit_length())
        for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _KEPT[name] = np.multiply.accumulate(steps)
    return _KEPT["power"][:n], _KEPT["inverse"][:n]


def _fold() -> np.ndarray:
    """Each byte lower-cased, 0 where it is no part of a word."""
    if "fold" not in _KEPT:
        fold = np.zeros(256, dtype=np.uint8)
        for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
            fold[low:high + 1] = np.arange(low, high + 1)
        fold[0x41:0x5B] = np.arange(0x61, 0x7B)
        _KEPT["fold"] = fold
    return _KEPT["fold"]


@dataclass
class Words:
    """All words of a run of texts. ``first[i]:first[i + 1]`` are those of text i."""

    hashes: np.ndarray
    first: np.ndarray
    data: np.ndarray  # folded bytes of all texts
    begin: np.ndarray  # of each word in data
    end: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = _fold()[np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", dtype=np.uint8)]
        inside = data != 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        begin, end = edge[::2], edge[1::2]
        power, inverse = _powers(len(data))
        total = np.cumsum(data.astype(np.uint64) * power)
        hashes = mix((total[end - 1] - total[begin - 1]) * inverse[begin]) if len(begin) else np.empty(0, np.uint64)
        starts = np.cumsum([1] + [len(r) + 1 for r in raw])
        return cls(hashes, np.searchsorted(begin, starts), data, begin, end)

    def text_of(self) -> np.ndarray:
        """For each word the text it stands in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> str:
        return self.data[self.begin[i]:self.end[i]].tobytes().decode("utf-8", "replace")


def run_hashes(words: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all runs of k words, or of those that begin at the given places, as if they stood in one text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n if at is None else len(at), k, dtype=np.uint64)
    for j in range(k):
        h = h * np.uint64(_BASE) + (words[j:j + n] if at is None else words[at + j].astype(np.uint64))
    return mix(h)


def runs(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words within each text, and the number of each run's first word."""
    text = words.text_of()
    h = run_hashes(words.hashes, k)
    at = np.flatnonzero(text[k - 1:] == text[:len(h)]) if len(h) else np.empty(0, np.int64)
    return h[at], at


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles, repeats included, and the text of each.

    A text of fewer than k words has its words as one shingle, a text without words none.
    """
    h, at = runs(words, k)
    text = words.text_of()
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if not len(short):
        return h, text[at]
    extra = np.array([run_hashes(words.hashes[words.first[i]:words.first[i + 1]], int(count[i]))[0] for i in short.tolist()], dtype=np.uint64)
    return np.concatenate([h, extra]), np.concatenate([text[at], short])
