"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, by runs along the diagonal."""

from __future__ import annotations

import functools
import gc
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afluente.llm.common import fresh_worker, slices, small_batches, spans, text_bytes, texts_of
from afluente.llm.pieces import SPACE, load
from afluente.llm.tokenfiles import ByteEncoder, as_one
from afluente.llm.words import ChunkIds
from afluente.session import written

SLICE = 1 << 20  # text bytes aligned at once, one text at least
WORDS = 400_000  # words whose ids a worker keeps
# Pairs of ids that go to every task of the join: those in the most documents. A pair beyond them is in few documents.
BROADCAST_PAIRS = 2_000_000
_ID_BITS = 22


class SpacedEncoder(ByteEncoder):
    """Encodes a space and the text, so that every word follows a blank."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.table = ChunkIds(self._words, limit=WORDS)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = as_one(pa.array(texts, pa.string())).tolist()
        parts = [[] if alone else t.replace("\n", " \n").split(" ") for t, alone in zip(texts, whole)]
        numbers = self.table.numbers([w for p in parts for w in p])
        flat = self.table.ids(numbers)
        ends = np.concatenate([[0], np.cumsum(self.table.lengths[numbers])])
        others = iter(self._all([" " + t for t, alone in zip(texts, whole) if alone]))
        out, at = [], 0
        for p, alone in zip(parts, whole):
            out.append(np.array(next(others), np.int32) if alone else flat[ends[at] : ends[at + len(p)]])
            at += len(p)
        return out


class TokenBytes:
    """The bytes of every token of a vocabulary."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        # decimal ids with room for a sign behind them
        digits = [str(k).encode() for k in range(len(tokens))]
        self.width = max(map(len, digits), default=1)
        self.decimal = np.zeros((len(tokens), self.width + 1), np.uint8)
        self.decimal[:, : self.width] = np.frombuffer(b"".join(d.ljust(self.width, b"\0") for d in digits), np.uint8).reshape(-1, self.width)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[spans(self.starts[ids], self.sizes[ids])]


def byte_tokens(encoder: ByteEncoder) -> TokenBytes:
    """Tokens of a byte-level vocabulary: the signs that stand for bytes, taken back."""
    byte_of = {chr(b): b for b in range(256) if b not in encoder.signs} | {sign: b for b, sign in encoder.signs.items()}
    vocabulary = encoder.library.get_vocab(with_added_tokens=True)
    tokens = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for text, k in vocabulary.items():
        if all(c in byte_of for c in text):
            tokens[k] = bytes(byte_of[c] for c in text)
    return TokenBytes(tokens)


def piece_tokens(library) -> TokenBytes:
    """Tokens of a vocabulary of pieces: byte pieces as their byte, space signs as spaces."""
    tokens = []
    for k in range(library.get_piece_size()):
        piece = library.id_to_piece(k)
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece) if library.is_byte(k) else None
        tokens.append(bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE, " ").encode("utf-8", "surrogatepass"))
    return TokenBytes(tokens)


def _stretch(a: list[int], b: list[int], wide_a: bytes, wide_b: bytes, i: int, j: int, limit: int) -> int:
    """How many ends from ``i`` and ``j`` on are equal, at most ``limit``; the first two are known to be."""
    length, step = 2, 2
    while length < limit:
        step = min(step, limit - length)
        x, y = i + length, j + length
        if step == 1:
            if a[x] != b[y]:
                break
            length, step = length + 1, 2
        elif wide_a[8 * x : 8 * (x + step)] == wide_b[8 * y : 8 * (y + step)]:
            length, step = length + step, 2 * step
        else:
            step //= 2
    return length


def align(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of two rising lists of token ends with the same last end.

    At the current shift between the two indices, ends are compared in blocks whose length doubles while they are equal
    and halves when they are not, so that a one-to-one stretch is jumped in few steps. Where ends differ, the side that
    lags goes on until both meet, which is the end of a group and sets a new shift. Returns the ends of the groups as
    counts of left and of right tokens, and the links as indices of the left and the right token.
    """
    a, b = left.tolist(), right.tolist()
    wide_a, wide_b = left.astype(np.int64).tobytes(), right.astype(np.int64).tobytes()
    n, m = len(a), len(b)
    events: list[int] = []  # starts in both lists and the length of each run; a length of 0 marks an irregular group
    odd_a: list[int] = []
    odd_b: list[int] = []
    a.append(-1)  # unequal ends behind the last ones
    b.append(-2)
    i = j = 0
    while i < n:
        length = 0
        if a[i] == b[j]:
            length = 1
            if a[i + 1] == b[j + 1]:
                length = _stretch(a, b, wide_a, wide_b, i, j, min(n - i, m - j))
        if length:
            events += (i, j, length)
            i, j = i + length, j + length
            if i >= n:
                break
        events += (i, j, 0)
        while True:
            odd_a.append(i)
            odd_b.append(j)
            x, y = a[i], b[j]
            if x < y:
                i += 1
            elif y < x:
                j += 1
            else:
                i, j = i + 1, j + 1
                break
    at = np.array(events, np.int64).reshape(-1, 3)
    lengths = at[:, 2]
    groups = np.maximum(lengths, 1)
    after = np.concatenate([at[1:, :2], [[n, m]]]) if len(at) else at[:, :2]
    # the last group of an event ends where the next event starts, those before it one token earlier each
    back = np.repeat(np.cumsum(groups), groups) - 1 - np.arange(int(groups.sum()))
    ends_a, ends_b = np.repeat(after[:, 0], groups) - back, np.repeat(after[:, 1], groups) - back
    runs_a, runs_b = spans(at[:, 0], lengths), spans(at[:, 1], lengths)
    return ends_a, ends_b, np.concatenate([runs_a, np.array(odd_a, np.int64)]), np.concatenate([runs_b, np.array(odd_b, np.int64)])


def _written_groups(ids: tuple[np.ndarray, np.ndarray], ends: tuple[np.ndarray, np.ndarray], last: np.ndarray, tokens: tuple[TokenBytes, TokenBytes]):
    """``a1,a2|b1;a3|b2`` of all groups one after the other, and where each group's text ends; ``last`` groups end a document."""
    sizes = [np.diff(e, prepend=0) for e in ends]
    order = [np.arange(len(ids[0])) + np.repeat(ends[1] - sizes[1], sizes[0]), np.arange(len(ids[1])) + np.repeat(ends[0], sizes[1])]
    width = max(t.width for t in tokens) + 1
    table = np.zeros((len(ids[0]) + len(ids[1]), width), np.uint8)
    for side in (0, 1):
        rows = np.zeros((len(ids[side]), width), np.uint8)
        rows[:, : tokens[side].width] = tokens[side].decimal[ids[side], : tokens[side].width]
        rows[:, -1] = ord(",")
        rows[ends[side] - 1, -1] = np.where(last, 0, ord(";")) if side else ord("|")
        table[order[side]] = rows
    filled = table != 0
    return table[filled], np.cumsum(filled.sum(axis=1))[ends[0] + ends[1] - 1]


class Aligner:
    """Aligns the tokens of texts under a byte-level vocabulary and one of pieces."""

    def __init__(self, byte_vocabulary: str, piece_vocabulary: str) -> None:
        self.encoder, self.library = SpacedEncoder(byte_vocabulary), load(piece_vocabulary)
        self.tokens = byte_tokens(self.encoder), piece_tokens(self.library)

    def _usable(self, texts: pa.Array, ids: tuple[list, list]) -> np.ndarray:
        """Whether the tokens of both sides, joined, are a space and the text; empty texts are not usable."""
        data, bounds = text_bytes(texts)
        sizes = np.diff(bounds)
        spaced = np.full(len(data) + len(sizes), 32, np.uint8)
        spaced[spans(bounds[:-1] + np.arange(len(sizes)) + 1, sizes)] = data
        bounds = bounds + np.arange(len(bounds))
        good = sizes > 0
        for tokens, own in zip(self.tokens, ids):
            flat = np.concatenate(own)
            token_bounds = np.concatenate([[0], np.cumsum([len(i) for i in own])])
            joined = tokens.joined(flat)
            ends = np.concatenate([[0], np.cumsum(tokens.sizes[flat])])[token_bounds]
            same = np.diff(ends) == np.diff(bounds)
            if same.all():
                unequal = np.concatenate([[0], np.cumsum(joined != spaced)])
                good &= np.diff(unequal[bounds]) == 0
            else:
                good &= [ok and np.array_equal(joined[s:e], spaced[p:q]) for ok, s, e, p, q in zip(same, ends, ends[1:], bounds, bounds[1:])]
        return good

    def rows(self, texts: pa.Array) -> dict[str, pa.Array]:
        listed = texts.to_pylist()
        left = self.encoder.encode(listed)
        right = [np.array(i, np.int32) for i in self.library.encode(listed, num_threads=1)]
        good = self._usable(texts, (left, right))
        none = np.zeros(0, np.int32)
        sides = [[i if ok else none for i, ok in zip(own, good)] for own in (left, right)]
        ids = tuple(np.concatenate([none, *own]) for own in sides)
        counts = [np.array([len(i) for i in own], np.int64) for own in sides]
        # all texts as one: each ends at an offset where both sides have an end
        positions = [np.cumsum(t.sizes[i]) for t, i in zip(self.tokens, ids)]
        ends_a, ends_b, link_a, link_b = align(*positions)
        token_ends = np.cumsum(counts[0])
        group_bounds = np.searchsorted(ends_a, token_ends, side="right")
        last = np.zeros(len(ends_a), bool)
        last[group_bounds[counts[0] > 0] - 1] = True
        written_out, text_ends = _written_groups(ids, (ends_a, ends_b), last, self.tokens) if len(ends_a) else (none, none)
        edges = np.concatenate([[0], text_ends])[np.concatenate([[0], group_bounds])].tolist()
        raw = written_out.tobytes()
        digests = [hashlib.sha256(raw[s:e]).hexdigest() if ok else "" for s, e, ok in zip(edges, edges[1:], counts[0] > 0)]
        owner = np.searchsorted(token_ends, link_a, side="right")
        pairs, times = np.unique(owner << 2 * _ID_BITS | ids[0][link_a].astype(np.int64) << _ID_BITS | ids[1][link_b], return_counts=True)
        pair_bounds = np.searchsorted(pairs >> 2 * _ID_BITS, np.arange(len(good) + 1)).astype(np.int32)
        pairs = pairs & ((1 << 2 * _ID_BITS) - 1)
        return {
            "n_a": pa.array(counts[0]),
            "n_b": pa.array(counts[1]),
            "n_groups": pa.array(np.diff(group_bounds, prepend=0).astype(np.int64)),
            "n_links": pa.array(np.bincount(owner, minlength=len(good)).astype(np.int64)),
            "groups_sha256": pa.array(digests, pa.string()),
            "pairs": pa.ListArray.from_arrays(pa.array(pair_bounds), pa.array(pairs)),
            "times": pa.ListArray.from_arrays(pa.array(pair_bounds), pa.array(times.astype(np.int32))),
        }


def worker_aligner(byte_vocabulary: str, piece_vocabulary: str) -> Aligner:
    """The aligner that this Python worker keeps from task to task, with the words it knows; a bounded table."""
    found = [os.stat(p) for p in (byte_vocabulary, piece_vocabulary)]
    return _aligner(byte_vocabulary, piece_vocabulary, *(x for f in found for x in (f.st_mtime_ns, f.st_size)))


@functools.lru_cache(maxsize=1)
def _aligner(byte_vocabulary: str, piece_vocabulary: str, *version: int) -> Aligner:
    return Aligner(byte_vocabulary, piece_vocabulary)


def align_documents(documents: DataFrame, byte_vocabulary: str, piece_vocabulary: str) -> DataFrame:
    """Tokens of every whole text under both vocabularies, cut into groups where tokens of both end, one row per row.

    ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links`` (token pairs whose bytes overlap), ``groups_sha256`` (of the
    groups written out), and the distinct linked ids as ``pairs`` (first id shifted left by 22 bits, plus the second) with
    ``times``. Null and empty texts, and texts that a vocabulary cannot give back byte by byte, have no tokens. Texts of
    any length are taken whole, about 1 MB at once, one text at least. Other columns than ``doc_id`` and ``text`` are
    ignored. The vocabularies must be readable on the executors.
    """
    small_batches(documents.sparkSession)
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches):
        fresh_worker()
        for batch in slices(batches, limit=SLICE):
            aligner = worker_aligner(byte_vocabulary, piece_vocabulary)
            gc.disable()  # the lists of a slice hold no cycles, and looking through them takes a tenth of the time
            try:
                found = aligner.rows(batch.column("text"))
            finally:
                gc.enable()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(found[n] for n in names)], ["doc_id", *names])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return texts_of(documents).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, ``n`` (documents that hold it linked) and ``best`` (no pair of its first id is in more documents)."""
    counts = written(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    first = F.shiftright("pair", _ID_BITS).alias("first")
    highest = counts.groupBy(first).agg(F.max("n").alias("highest"))
    return counts.select("pair", "n", first).join(highest, "first").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def score_links(documents: DataFrame, byte_vocabulary: str, piece_vocabulary: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Counts and digest of ``align_documents`` with ``n_best`` (links whose pair is in the most documents that any pair of
    its first id is in, ties included) and ``count_sum`` (documents of the pair, over all links).

    Texts are aligned once and the result saved. At most ``broadcast_pairs`` pairs, those in the most documents, go to every
    task; the others are joined by pair, and each of them is in few documents, so that no key of that join is hot. Repeated
    rows are documents of their own; an empty table gives an empty result.
    """
    aligned = align_documents(documents, byte_vocabulary, piece_vocabulary)
    # once saved, the numbers of the rows stay as they are
    aligned = written(aligned.withColumn("row", F.monotonically_increasing_id()))
    counts = written(pair_counts(aligned))
    # pairs in at least ``cut`` documents: never more than the sum of all counts through ``cut``
    total = counts.agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("pairs")).first()
    cut = 0 if total["pairs"] <= broadcast_pairs else -(-total["links"] // broadcast_pairs)
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(
        "row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times")
    )

    def added_up(rows: DataFrame) -> DataFrame:
        best = F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))
        return rows.groupBy("row").agg(F.sum(best).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))

    if cut:
        common = F.broadcast(counts.where(F.col("n") >= cut))  # at most broadcast_pairs rows
        met = links.join(common, "pair", "left")
        rare = met.where(F.col("n").isNull()).select("row", "pair", "times").join(counts.where(F.col("n") < cut), "pair")
        sums = added_up(met.where(F.col("n").isNotNull()).select("row", "times", "n", "best").unionByName(rare.select("row", "times", "n", "best")))
    else:
        sums = added_up(links.join(F.broadcast(counts), "pair"))  # at most broadcast_pairs rows
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    wide = aligned.select("row", *columns).join(sums, "row", "left")
    return wide.select(*columns[:5], F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
