"""SentencePiece encoding and decoding for vocabularies of merges."""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from afluente.llm.common import slices, small_batches, texts_of
from afluente.llm.words import ChunkIds

SPACE = "▁"
SHORT = 48  # symbols of a chunk that is merged in step with others
_OTHER = 1 << 20  # symbols from here on are characters outside the vocabulary
_NONE = np.iinfo(np.int32).max


class Merger:
    """Encodes as a merge-type vocabulary does: of all adjacent pairs whose union is a piece, the one of the best score
    is joined first, the leftmost of equal ones, until no pair is left.

    Chunks are independent where no piece has a space sign after another sign, which is checked. What is no piece at
    the end is written as its bytes.
    """

    def __init__(self, library) -> None:
        size = library.get_piece_size()
        pieces = [library.id_to_piece(k) for k in range(size)]
        odd = [library.is_byte(k) or library.is_control(k) or library.is_unknown(k) for k in range(size)]
        if any(library.is_unused(k) for k in range(size)):
            raise ValueError("vocabularies with unused pieces are not supported")
        self.library = library
        self.number = {p: k for k, p in enumerate(pieces) if not odd[k]}
        self.bytes = {int(pieces[k][3:5], 16): k for k in range(size) if library.is_byte(k)}
        self.unknown = library.unk_id()
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        self.splits = not any(inner.search(p) for p in self.number)
        self.line_ends_alone = not any("\n" in p and len(p) > 1 for p in self.number)
        scores = sorted({library.get_score(k) for k in self.number.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for piece, k in self.number.items():
            place = rank[library.get_score(k)]
            for cut in range(1, len(piece)):
                left, right = self.symbol(piece[:cut]), self.symbol(piece[cut:])
                if left is not None and right is not None:
                    self.pairs[left, right] = (place, k)
        keys = np.array([a << 22 | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        values = np.array(list(self.pairs.values()), np.int32).reshape(-1, 2)[order]
        self.ranks = np.append(values[:, 0], _NONE).astype(np.int32)
        self.merged = np.append(values[:, 1], -1).astype(np.int32)

    def symbol(self, text: str) -> int | None:
        found = self.number.get(text)
        return found if found is not None else _OTHER + ord(text) if len(text) == 1 else None

    def chunks(self, text: str) -> list[str]:
        """The text with its space signs, cut where no piece reaches across."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        if not self.splits:
            return [marked]
        if SPACE in text or SPACE * 2 in marked or not self.line_ends_alone:
            return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", marked)
        return marked.replace(SPACE, " " + SPACE).replace("\n", " \n").split(" ")[1:]

    def encode(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of every chunk."""
        out: list[np.ndarray | None] = [None] * len(chunks)
        by_length: dict[int, list[int]] = defaultdict(list)
        for k, chunk in enumerate(chunks):
            if len(chunk) > SHORT:
                out[k] = self.finish(self.agenda(chunk))
            else:
                by_length[-(-len(chunk) // 4) * 4].append(k)
        for width, members in by_length.items():
            for start in range(0, len(members), 8192):
                part = members[start : start + 8192]
                for k, ids in zip(part, self.in_step([chunks[k] for k in part], width)):
                    out[k] = ids
        return out

    def finish(self, symbols) -> np.ndarray:
        ids: list[int] = []
        for s in symbols:
            if s < _OTHER:
                ids.append(s)
            else:
                raw = chr(s - _OTHER).encode("utf-8", "surrogatepass")
                ids.extend(self.bytes[b] for b in raw) if self.bytes else ids.append(self.unknown)
        return np.array(ids, np.int32)

    def agenda(self, chunk: str) -> list[int]:
        """One chunk of any length: a heap of pairs by score and place, over a linked list of symbols."""
        number, pairs = self.number, self.pairs
        symbols = [number.get(c, _OTHER + ord(c)) for c in chunk]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting: list[tuple[int, int, int, int]] = []
        for k in range(n - 1):
            found = pairs.get((symbols[k], symbols[k + 1]))
            if found:
                waiting.append((found[0], k, symbols[k], symbols[k + 1]))
        heapq.heapify(waiting)
        while waiting:
            _, k, left, right = heapq.heappop(waiting)
            nxt = after[k] if symbols[k] == left else n
            if nxt >= n or symbols[nxt] != right:
                continue  # one of the two has been joined to another meanwhile
            symbols[k], symbols[nxt] = pairs[left, right][1], -1
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n:
                    found = pairs.get((symbols[a], symbols[b]))
                    if found:
                        heapq.heappush(waiting, (found[0], a, symbols[a], symbols[b]))
        return [s for s in symbols if s >= 0]

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) << 22 | right.astype(np.int64)
        at = np.searchsorted(self.keys, key)
        at[(self.keys[at] != key) | (left < 0) | (right < 0)] = len(self.keys) - 1
        return self.ranks[at], at

    def in_step(self, chunks: list[str], width: int) -> list[np.ndarray]:
        """Short chunks side by side: each step takes the best pair off the agenda of every chunk at once."""
        symbols = np.full((len(chunks), width + 1), -1, np.int32)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, inverse = np.unique(points, return_inverse=True)
        known = np.array([self.number.get(chr(c), _OTHER + int(c)) for c in kinds], np.int32)
        symbols[:, :width][np.arange(width) < sizes[:, None]] = known[inverse]
        ranks, at = self._look_up(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())
        ranks, at = ranks.reshape(-1, width), at.reshape(-1, width)
        busy, rest = np.arange(len(chunks)), symbols.copy()
        columns = np.arange(width)
        while len(busy):
            place = ranks.argmin(axis=1)
            row = np.arange(len(busy))
            going = ranks[row, place] != _NONE
            if not going.all():
                rest[busy[~going]] = symbols[~going]
                busy, symbols, ranks, at, place = busy[going], symbols[going], ranks[going], at[going], place[going]
                row = np.arange(len(busy))
                if not len(busy):
                    break
            symbols[row, place] = self.merged[at[row, place]]
            shift = columns[None, :] > place[:, None]
            symbols[:, :-1] = np.where(shift, symbols[:, 1:], symbols[:, :-1])
            symbols[:, -1] = -1
            ranks[:, :-1] = np.where(shift[:, :-1], ranks[:, 1:], ranks[:, :-1])
            at[:, :-1] = np.where(shift[:, :-1], at[:, 1:], at[:, :-1])
            ranks[:, -1] = _NONE
            ranks[row, place], at[row, place] = self._look_up(symbols[row, place], symbols[row, place + 1])
            prior = place > 0
            r, p = row[prior], place[prior] - 1
            ranks[r, p], at[r, p] = self._look_up(symbols[r, p], symbols[r, p + 1])
        flat = rest[rest >= 0]
        ends = np.cumsum((rest >= 0).sum(axis=1))
        plain = flat < _OTHER
        out = np.split(flat, ends[:-1])
        if plain.all():
            return out
        whole = np.logical_and.reduceat(plain, ends - np.diff(ends, prepend=0)) if len(ends) else plain
        return [ids if ok else self.finish(ids.tolist()) for ids, ok in zip(out, whole)]


def load(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


class CheckedIds:
    """Encodes chunks with the merger and compares every new chunk with the library."""

    def __init__(self, merger: Merger) -> None:
        self.merger, self.mended = merger, 0
        library = merger.library
        # After a line end nothing is added, so the library's leading space sign can be told apart.
        self.lead = library.encode("\n")
        self.table = ChunkIds(self.encode, decimal=True)

    def encode(self, chunks: list[str]) -> list[np.ndarray]:
        found = self.merger.encode(chunks)
        plain = [c[1:].replace(SPACE, " ") if c.startswith(SPACE) else "\n" + c for c in chunks]
        wanted = self.merger.library.encode(plain, num_threads=1)
        for k, (chunk, ids) in enumerate(zip(chunks, wanted)):
            if not chunk.startswith(SPACE):
                ids = ids[len(self.lead) :]
            if chunk != SPACE and ids != found[k].tolist():
                found[k] = np.array(ids, np.int32)
                self.mended += 1
        return found


def encode_documents(documents: DataFrame, model: str) -> DataFrame:
    """``doc_id``, ``ids`` (array of ints) and ``text`` decoded from them, for every whole document.

    Merging runs over the distinct chunks of each batch, checked against the library chunk by chunk; documents are put
    together from chunks. Decoding is the library's. Null and empty texts have no ids and decode to an empty text.
    Texts of any length are taken whole; repeated rows each give a row; an empty table gives an empty result. Columns
    other than ``doc_id`` and ``text`` are ignored. ``model`` must be readable on the executors.
    """

    def result(ids, texts, library):
        decoded = library.decode([list(map(int, i)) for i in ids], num_threads=1)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        bounds = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat, pa.int32())), pa.array(decoded, pa.string())]

    return _over(documents, model, "doc_id long, ids array<int>, text string", ["ids", "text"], result)


def summarise_encoding(documents: DataFrame, model: str) -> DataFrame:
    """Counts and digests of what ``encode_documents`` gives, made where the ids are, so that they need not move.

    ``n_mended`` counts, per document, the chunks first met in its batch in which the library disagreed; the library's
    ids are taken there.
    """
    return _over(
        documents,
        model,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_mended long",
        ["n_tokens", "ids_sha256", "decoded_sha256", "n_mended"],
        None,
    )


def _over(documents: DataFrame, model: str, schema: str, names: list[str], result) -> DataFrame:
    small_batches(documents.sparkSession)

    def run(batches):
        gc.collect()  # what the task before has left in this worker
        checked = None
        for batch in slices(batches, limit=2 << 20):
            if checked is None:
                checked = CheckedIds(Merger(load(model)))
            table, merger, mended = checked.table, checked.merger, checked.mended
            parts = [merger.chunks(t) for t in batch.column("text").to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            numbers = table.numbers([c for p in parts for c in p])
            lengths = np.concatenate([[0], np.cumsum(table.lengths[numbers])])[bounds]
            flat = table.ids(numbers)
            ids = [flat[lengths[k] : lengths[k + 1]] for k in range(len(parts))]
            if result is not None:
                made = result(ids, parts, merger.library)
            else:
                texts, spots = table.texts, numbers.tolist()
                joined = [",".join([texts[i] for i in spots[bounds[k] : bounds[k + 1]]]) for k in range(len(parts))]
                decoded = merger.library.decode([i.tolist() for i in ids], num_threads=1)
                made = [
                    pa.array(np.diff(lengths)),
                    pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined], pa.string()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                    pa.array(np.full(len(parts), checked.mended - mended)),
                ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", *names])

    return texts_of(documents).mapInArrow(run, schema)
