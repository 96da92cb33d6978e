"""Token ids of words, remembered per Python worker within a fixed number of entries."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from pressline.llm.textarrays import ranges

ENTRIES = 150_000


def joined(found: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and all elements of id sequences."""
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    return lengths, np.fromiter(chain.from_iterable(found), np.uint16, int(lengths.sum()))


def give_back() -> None:
    """Return what a task has given up, so that idle workers leave the executor's memory to later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()


class TokenMemo:
    """Maps words to runs in one flat array of token ids.

    ``encode`` turns a list of new words into the number of ids of each and all ids in order.
    The first ``entries`` words
    stay; later ones are encoded again for each call, so memory is bounded and results never
    depend on the memo.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], entries: int = ENTRIES):
        self.encode, self.entries = encode, entries
        self.forget()

    def forget(self) -> None:
        """Start anew without any word."""
        self.place: dict[Hashable, int] = {}
        self.ids = np.zeros(1 << 16, np.uint16)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.used = 0
        self.passing: list = []  # words of the last call only
        self.settled = 0  # ids that stay

    def _add(self, words: list) -> None:
        lengths, flat = self.encode(words)
        at, n = len(self.place), len(words)
        while at + n > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.start[at : at + n] = self.used + np.cumsum(lengths) - lengths
        self.length[at : at + n] = lengths
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.place.update(zip(words, range(at, at + n)))

    def look_up(self, words: list) -> np.ndarray:
        """Index of every word; valid until the next call."""
        for word in self.passing:
            del self.place[word]
        self.passing, self.used = [], self.settled
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = list({words[k] for k in missing})
            stay = max(0, self.entries - len(self.place))
            self._add(new[:stay])
            self.settled = self.used
            self.passing = new[stay:]
            if self.passing:
                self._add(self.passing)
            at[missing] = [self.place[words[k]] for k in missing]
        return at

    def tokens(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of every word, and all ids in order."""
        at = self.look_up(words)
        length = self.length[at]
        return length, self.ids[ranges(self.start[at], length)]
