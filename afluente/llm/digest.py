"""Document fingerprints of improbable features (similarity digests)."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afluente.llm.common import id_bounds, in_id_order, partitions_of, slices, small_batches, text_bytes, texts_of

WINDOW = 64  # bytes of a feature, and windows that compete with each other
POPULAR = 16  # a window that wins this many of its competitions is a feature
FILTER_BITS = 2048
HASHES = 5
FILTER_FEATURES = 160
SCORES = 1000
BLOCK = 256 << 10

# Bits of information are kept as whole numbers so that a window's score depends on its bytes alone.
_COUNTS = np.arange(WINDOW + 1)
_WEIGHT = np.round(65536 * _COUNTS * np.log2(np.maximum(_COUNTS, 1))).astype(np.int64)
_GAIN = np.diff(_WEIGHT, prepend=0)  # what the c-th equal byte adds


def entropy_scores(data: np.ndarray) -> np.ndarray:
    """Entropy of every window of WINDOW bytes, from 0 (one byte value) to SCORES (all differ)."""
    n = len(data) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int32)
    ahead, behind = np.ones(len(data), np.uint8), np.ones(len(data), np.uint8)
    for k in range(1, WINDOW):
        same = (data[:-k] == data[k:]).view(np.uint8)
        ahead[:-k] += same
        behind[k:] += same
    total = np.empty(n, np.int64)
    total[0] = _WEIGHT[np.bincount(data[:WINDOW], minlength=256)].sum()
    if n > 1:  # a window drops its first byte and takes in the next one
        total[1:] = total[0] + np.cumsum(_GAIN[behind[WINDOW:]] - _GAIN[ahead[: n - 1]])
    most = _WEIGHT[WINDOW]
    return ((most - total) * SCORES // most).astype(np.int32)


def score_counts(documents: DataFrame) -> np.ndarray:
    """How many windows of all documents have each score."""

    def count(batches):
        counts = np.zeros(SCORES + 1, np.int64)
        for batch in slices(batches, limit=BLOCK):
            data, bounds = text_bytes(batch.column("text"))
            scores = entropy_scores(data)
            counts += np.bincount(scores[_inside(bounds, len(scores))], minlength=SCORES + 1)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["score", "n"])

    rows = texts_of(documents).select("text").mapInArrow(count, "score long, n long").groupBy("score").agg(F.sum("n").alias("n"))
    counts = np.zeros(SCORES + 1, np.int64)
    for row in rows.collect():  # SCORES + 1 rows at most
        counts[row["score"]] = row["n"]
    return counts


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each score, the rarest first; equal counts in order of the score. Scores never seen rank last."""
    order = np.lexsort((np.arange(len(counts)), np.where(counts == 0, np.iinfo(np.int64).max, counts)))
    ranks = np.empty(len(counts), np.int32)
    ranks[order] = np.arange(len(counts), dtype=np.int32)
    return ranks


def _inside(bounds: np.ndarray, windows: int) -> np.ndarray:
    """Which windows of joined documents lie in one document."""
    if not windows:
        return np.zeros(0, bool)
    step = np.zeros(windows + 1, np.int32)
    starts, stops = bounds[:-1], np.maximum(bounds[1:] - WINDOW + 1, bounds[:-1])
    np.add.at(step, np.minimum(starts, windows), 1)
    np.add.at(step, np.minimum(stops, windows), -1)
    return np.cumsum(step[:-1]) > 0


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Chained filters of every text: an array of filters, each of FILTER_BITS / 8 bytes; none for an empty text."""
    out: list[np.ndarray] = []
    block: list[bytes] = []
    size = 0
    for text in texts:
        block.append(text)
        size += len(text)
        if size >= BLOCK:
            out += _digests(block, ranks)
            block, size = [], 0
    return out + (_digests(block, ranks) if block else [])


def _digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    key = ranks[entropy_scores(data)].astype(np.int64) << 40 | np.arange(max(0, len(data) - WINDOW + 1))
    low, width = key, 1
    while width < WINDOW and len(low) > width:  # the rarest of WINDOW windows in a row, the leftmost of equal ones
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    winner = low & ((1 << 40) - 1)
    starts = bounds[:-1]
    windows = np.maximum(0, np.diff(bounds) - WINDOW + 1)
    wins = np.zeros(len(key) + 1, np.int64)
    if width >= WINDOW and len(winner):
        step = np.zeros(len(winner) + 1, np.int32)
        runs = np.maximum(0, windows - WINDOW + 1)
        np.add.at(step, np.minimum(starts, len(winner)), 1)
        np.add.at(step, np.minimum(starts + runs, len(winner)), -1)
        wins[: len(key)] = np.bincount(winner[np.cumsum(step[:-1]) > 0], minlength=len(key))
    chosen = np.flatnonzero(wins[: len(key)] >= POPULAR)
    at = np.searchsorted(chosen, bounds)
    out = []
    for k, text in enumerate(texts):
        start = int(starts[k])
        places = chosen[at[k] : at[k + 1]].tolist()
        if not places and windows[k]:  # too short for a competition
            places = [start + int(np.argmin(key[start : start + windows[k]]))]
        features = [joined[p : p + WINDOW] for p in places] if places else [text] if text else []
        out.append(_filters(features))
    return out


def _filters(features: list[bytes]) -> np.ndarray:
    features = list(dict.fromkeys(features))
    count = -(-len(features) // FILTER_FEATURES)
    bits = np.zeros((count, FILTER_BITS), np.uint8)
    if count:
        raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, features)), np.uint8).reshape(-1, 16)
        parts = raw[:, : 2 * HASHES].copy().view("<u2") & (FILTER_BITS - 1)
        bits[np.repeat(np.arange(len(features)) // FILTER_FEATURES, HASHES), parts.ravel()] = 1
    return np.packbits(bits, axis=1)


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """From 0 to 1: for every filter of the shorter chain its best overlap with the other's, averaged.

    An overlap counts above what two unrelated filters of as many bits would share, as a part of the most they could
    share. Equal chains give 1, also two empty ones; an empty and another one give 0.
    """
    if one.shape == other.shape and np.array_equal(one, other):
        return 1.0
    if not len(one) or not len(other):
        return 0.0
    a, b = sorted((one, other), key=lambda x: (len(x), x.tobytes()))
    b_bits = np.unpackbits(b, axis=1).astype(np.float32)
    b_size = b_bits.sum(axis=1)
    best = []
    for k in range(0, len(a), 64):
        a_bits = np.unpackbits(a[k : k + 64], axis=1).astype(np.float32)
        a_size = a_bits.sum(axis=1)[:, None]
        chance, most = a_size * b_size / FILTER_BITS, np.minimum(a_size, b_size)
        floor = chance + 0.3 * (most - chance)
        best.append(np.clip((a_bits @ b_bits.T - floor) / np.maximum(most - floor, 1e-6), 0, 1).max(axis=1))
    return float(np.concatenate(best).mean())


def text_of(filters: np.ndarray) -> str:
    """The chain as text: base64 of the filters one after the other."""
    return base64.b64encode(filters.tobytes()).decode("ascii")


def edited(text: str, follower: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``follower``."""
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


def fingerprint_documents(documents: DataFrame, counts: np.ndarray | None = None, partitions: int | None = None) -> DataFrame:
    """Fingerprint of every document and of its edited form, and how alike they are.

    Windows of 64 bytes are ranked by how rare their entropy is among all windows of all documents; the winners of
    their neighbourhood go into chained Bloom filters. Documents are dealt out by ranges of the id, once, and read in
    order, so that each meets its follower.

    Null texts are empty; empty texts have an empty fingerprint. Texts below one window are one feature as a whole.
    Repeated ids are ordered by text; a single document follows itself. An empty table gives an empty result. Columns
    other than ``doc_id`` and ``text`` are ignored.
    """
    spark = documents.sparkSession
    small_batches(spark)
    rows = texts_of(documents)
    ranks = rarity_ranks(score_counts(rows) if counts is None else counts)
    ordered = in_id_order(rows, id_bounds(rows, partitions or partitions_of(spark)), with_next=True)

    def run(batches):
        held: tuple | None = None  # id, text and digest of the row before
        for batch in slices(batches, limit=1 << 20):
            ids, texts, tails, parts = (batch.column(c).to_pylist() for c in ("doc_id", "text", "tail", "part"))
            own = digests([t.encode() for t in texts], ranks)
            pairs = []
            for row in zip(ids, texts, own, tails, parts):
                if held is not None and held[4] == row[4] and not held[3]:
                    pairs.append((held, row))
                held = row
            if not pairs:
                continue
            changed = [edited(a[1], b[1]) for a, b in pairs]
            prints = digests([t.encode() for t in changed], ranks)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[0] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                    pa.array([text_of(a[2]) for a, _ in pairs], pa.string()),
                    pa.array([text_of(p) for p in prints], pa.string()),
                    pa.array([likeness(a[2], p) for (a, _), p in zip(pairs, prints)], pa.float64()),
                    pa.array([likeness(a[2], b[2]) for a, b in pairs], pa.float64()),
                ],
                NAMES,
            )

    return ordered.mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
