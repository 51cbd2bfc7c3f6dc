"""Words of texts through a memo of distinct words, for operators that compute something once per distinct word."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


#: Runs of letters, and of signs of numbers that are not digits (superscripts, fractions, Roman numerals): see `letters`.
LETTERS = re.compile(r"[^\W\d_]+")
SLICE_CHARS, MEMO = 1 << 20, 250_000


def slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about `limit` characters; a text is never split."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


#: What a worker has learnt for the operator that it last worked for, and whose it is.
_held: list = [None, None]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def give_back() -> None:
    """Return what allocators keep of freed memory to the system: batches come and go, and a worker would hold the most it ever used."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def held(owner: object, make: Callable[[], object] = lambda: None) -> object:
    """What `make` gave for this owner (an object, or a tuple that names one); anything kept for another is let go first, so that a worker
    that serves one operator after the other holds the memo of one."""
    if not (_held[0] is owner or isinstance(owner, tuple) and _held[0] == owner):
        _held[:] = [None, None]
        gc.collect()
        give_back()
        _held[:] = [owner, make()]
    return _held[1]


class WordMemo:
    """Row numbers of words; `learn` gives the rows of new words, and at most about `limit` words are kept."""

    def __init__(self, learn: Callable[[list[str]], np.ndarray], limit: int = MEMO):
        self.learn, self.limit = learn, limit
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows: np.ndarray | None = None

    def index(self, words: list[str]) -> np.ndarray:
        if len(self.at) > self.limit:
            self.clear()
        at = self.at
        new = list({w for w in words if w not in at})
        if new:
            got = self.learn(new)
            if self.rows is None:
                self.rows = np.zeros((max(1 << 14, len(new)), *got.shape[1:]), got.dtype)
            while len(at) + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[len(at) : len(at) + len(new)] = got
            at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
        return np.fromiter(map(at.__getitem__, words), np.int64, len(words))


def word_lists(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """All lower-cased words of some texts in order, and where each text begins and the last ends."""
    split = [LETTERS.findall(t.lower()) if t else [] for t in texts]
    return [w for s in split for w in s], np.cumsum([0, *map(len, split)])


def letters(word: str) -> str:
    """A word without the signs that are no letters."""
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds, 0 where there are none; what a text's neighbours hold does not change its sum's last bits."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]))
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(values.astype(np.float64), bounds[:-1][some], axis=0)
    return out
