"""Ids of recurring chunks of text, looked up rather than encoded again."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from afluente.llm.common import spans


class ChunkIds:
    """Ids of chunks by their text; ``encode`` gives them for a list of new chunks, as one list or array for each, or
    as all of them in one array and how many each has.

    When the table holds more than ``limit`` chunks, those met only once leave it, and the rarer others beyond half of
    it, which bounds its memory and changes no result. With ``decimal`` it also keeps every chunk's ids as text.
    """

    def __init__(self, encode: Callable[[list[str]], list | tuple[np.ndarray, np.ndarray]], limit: int = 400_000, decimal: bool = False) -> None:
        self.encode, self.limit, self.decimal = encode, limit, decimal
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.texts: list[str] = []
        self.pool = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.times = np.zeros(1 << 14, np.int64)
        self.used = 0

    def shrink(self) -> None:
        """Keep the chunks met more than once, at most half of ``limit``, the most frequent ones; halve their counts."""
        chunks, texts = list(self.index), self.texts
        kept = self._keep(len(chunks)).tolist()
        self.index = {chunks[k]: n for n, k in enumerate(kept)}
        if self.decimal:
            self.texts = [texts[k] for k in kept]

    def _keep(self, count: int) -> np.ndarray:
        """Which of ``count`` chunks stay; what the table holds by number is theirs alone then."""
        kept = np.flatnonzero(self.times[:count] > 1)
        if len(kept) > self.limit // 2:
            kept = np.sort(kept[np.argsort(-self.times[kept], kind="stable")[: self.limit // 2]])
        pool, lengths, times = self.ids(kept), self.lengths[kept], self.times[kept] // 2
        self.clear()
        self.used = len(pool)
        self.pool = pool
        self.starts, self.lengths, self.times = np.cumsum(lengths) - lengths, lengths, times
        return kept

    def add(self, chunks: list[str]) -> None:
        encoded, first = self.encode(chunks), len(self.index)
        if isinstance(encoded, tuple):
            flat, sizes = encoded
        else:
            sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
            flat = np.fromiter(chain.from_iterable(encoded), np.int32) if isinstance(encoded[0], list) else np.concatenate(encoded)
        self._store(first, flat, sizes)
        self.index.update(zip(chunks, range(first, first + len(chunks))))
        if self.decimal:
            self.texts.extend(",".join(map(str, ids.tolist())) for ids in encoded)

    def _store(self, first: int, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Hold the ids of the chunks that are numbered from ``first`` on."""
        self.pool = _room(self.pool, self.used + len(flat))
        self.starts, self.lengths, self.times = (_room(a, first + len(sizes)) for a in (self.starts, self.lengths, self.times))
        self.pool[self.used : self.used + len(flat)] = flat
        self.starts[first : first + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.lengths[first : first + len(sizes)] = sizes
        self.used += len(flat)

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The number of every chunk in the table, unknown chunks added first."""
        if len(self.index) > self.limit:
            self.shrink()
        found = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        unknown = np.flatnonzero(found < 0).tolist()
        if unknown:
            self.add(list(dict.fromkeys(chunks[k] for k in unknown)))
            found[unknown] = [self.index[chunks[k]] for k in unknown]
        self.times[: len(self.index)] += np.bincount(found, minlength=len(self.index))
        return found

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the chunks one after the other."""
        return self.pool[spans(self.starts[numbers], self.lengths[numbers])]


class ArrowChunkIds(ChunkIds):
    """The same for chunks in Arrow arrays, which are looked up with no Python object for each."""

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], limit: int = 400_000) -> None:
        super().__init__(encode, limit)

    def clear(self) -> None:
        super().clear()
        self.chunks = pa.array([], pa.string())

    def shrink(self) -> None:
        chunks = self.chunks
        self.chunks = chunks.take(pa.array(self._keep(len(chunks))))

    def numbers(self, chunks: pa.Array) -> np.ndarray:
        if len(self.chunks) > self.limit:
            self.shrink()
        found = pc.index_in(chunks, value_set=self.chunks)
        unknown = found.is_null()
        found = found.fill_null(-1).to_numpy()
        if (found < 0).any():
            others = chunks.filter(unknown)
            new, first = others.unique(), len(self.chunks)
            self._store(first, *self.encode(new))
            self.chunks = pa.concat_arrays([self.chunks, new])
            found = found.copy()
            found[found < 0] = pc.index_in(others, value_set=new).to_numpy() + first
        self.times[: len(self.chunks)] += np.bincount(found, minlength=len(self.chunks))
        return found


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])
