"""A table of text pieces and the numbers that belong to each, kept in Arrow and numpy by a Python worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class PieceTable:
    """make(pieces) gives the sizes and the joined numbers of pieces that aren't known. The pieces met first, which are the
    frequent ones, are kept, up to `limit` and the batch that passes it."""

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 200_000):
        self.make, self.limit = make, limit
        self.words = pa.array([], pa.string())
        self.size = self.begin = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(size, begin, flat): the numbers of words[k] are flat[begin[k] : begin[k] + size[k]]."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        miss, hit = np.flatnonzero(at < 0), np.flatnonzero(at >= 0)
        new = words.take(pa.array(miss))
        made, more = self.make(new.to_pylist())
        start = np.cumsum(made) - made + len(self.flat)
        size, begin = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        size[hit], begin[hit] = self.size[at[hit]], self.begin[at[hit]]
        size[miss], begin[miss] = made, start
        flat = np.concatenate([self.flat, more])
        if len(self.words) < self.limit:
            self.words = pa.concat_arrays([self.words, new])
            self.size, self.begin, self.flat = np.concatenate([self.size, made]), np.concatenate([self.begin, start]), flat
        return size, begin, flat
