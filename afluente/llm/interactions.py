"""Filter interaction audit: what each of five filters removes in every order, from one pass over the bytes of each text."""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from afluente.llm.common import slices, small_batches, text_bytes
from afluente.session import written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]

# Classes of bytes: a later byte of a character, white space, a capital, a symbol, the first byte of any other character.
_LATER, _BLANK, _CAPITAL, _SYMBOL, _OTHER = range(5)
CLASSES = np.full(256, _OTHER, np.uint8)
CLASSES[0x80:0xC0] = _LATER
CLASSES[[0x20, *range(0x09, 0x0E)]] = _BLANK
CLASSES[ord("A") : ord("Z") + 1] = _CAPITAL
CLASSES[np.frombuffer(b"#$%&*|", np.uint8)] = _SYMBOL

# States: outside of words (0), inside (1). In UTF-8 a later byte follows a byte of a word, so the class alone sets the state.
AFTER = np.array([1, 0, 1, 1, 1], np.uint8)
POINT, CAPITAL, SYMBOL, START, END = 1, 2, 4, 8, 16
# What the transducer puts out, by state before the byte and class of the byte.
OUTPUT = np.array(
    [
        [0, POINT, POINT | CAPITAL | START, POINT | SYMBOL | START, POINT | START],
        [0, POINT | END, POINT | CAPITAL, POINT | SYMBOL, POINT],
    ],
    np.uint8,
)

_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)


def transduce(data: np.ndarray, bounds: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Counts per text, and starts and ends of all words of the texts, which lie one after the other in ``data``."""
    classes = CLASSES[data]
    before = np.zeros(len(data), np.uint8)
    before[1:] = AFTER[classes[:-1]]
    first = bounds[:-1][np.diff(bounds) > 0]
    before[first] = 0
    out = OUTPUT[before, classes]
    starts = np.flatnonzero(out & START)
    last = bounds[1:][np.diff(bounds) > 0]
    open_ends = last[AFTER[classes[last - 1]] == 1]
    ends = np.sort(np.concatenate([np.flatnonzero(out & END), open_ends]))
    counts = {"words": np.diff(np.searchsorted(starts, bounds))}
    for name, bit in (("points", POINT), ("capitals", CAPITAL), ("symbols", SYMBOL)):
        counts[name] = np.diff(np.concatenate([[0], np.cumsum((out & bit) > 0, dtype=np.int64)])[bounds])
    return counts, starts, ends


class SpanTable:
    """An open-addressing table of word spans; a hit counts only if the bytes are the same."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self.starts, self.sizes = starts, ends - starts
        # eight bytes from any place on
        self.padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.blocks = np.ndarray(len(data) + 1, "<u8", self.padded.data, strides=(1,))
        self.hashes = self._hashes(data, starts, ends)

    @staticmethod
    def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A polynomial over the bytes of each span, from running sums."""
        powers = np.ones(len(data) + 1, np.uint64)
        powers[1:] = np.cumprod(np.full(len(data), _PRIME, np.uint64))
        inverse = np.ones(len(data) + 1, np.uint64)
        inverse[1:] = np.cumprod(np.full(len(data), _INVERSE, np.uint64))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
        return (sums[ends] - sums[starts]) * inverse[starts]

    def same(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the spans hold the same bytes."""
        equal = (self.sizes[left] == self.sizes[right]) & (self.hashes[left] == self.hashes[right])
        open_, at = np.flatnonzero(equal), 0
        while len(open_):
            rest = np.minimum(self.sizes[left[open_]] - at, 8).astype(np.uint64)
            mask = np.uint64(2**64 - 1) >> (np.uint64(64) - rest * np.uint64(8))
            a, b = (self.blocks[self.starts[side[open_]] + at] & mask for side in (left, right))
            equal[open_[a != b]] = False
            at += 8
            open_ = open_[(a == b) & (self.sizes[left[open_]] > at)]
        return equal

    def distinct(self, owners: np.ndarray, n_owners: int) -> np.ndarray:
        """How many different words each owner has. Every span looks for its slot; the first of its kind stays there."""
        bits = max(4, int(2 * len(self.starts)).bit_length())
        mixed = (self.hashes ^ owners.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(_PRIME)
        slot = (mixed >> np.uint64(64 - bits)).astype(np.int64)
        table = np.full(1 << bits, -1, np.int64)
        waiting = np.arange(len(self.starts))
        while len(waiting):
            place = slot[waiting]
            free = table[place] < 0
            table[place[free]] = waiting[free]
            held = table[place]
            found = held == waiting
            other = np.flatnonzero(~found & (owners[held] == owners[waiting]))
            found[other] = self.same(held[other], waiting[other])
            waiting = waiting[~found]
            slot[waiting] = (slot[waiting] + 1) & ((1 << bits) - 1)
        return np.bincount(owners[table[table >= 0]], minlength=n_owners)


def failures(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D that each text fails; the filters' limits are fixed values."""
    counts, starts, ends = transduce(data, bounds)
    owners = np.repeat(np.arange(len(bounds) - 1), counts["words"])
    distinct = SpanTable(data, starts, ends).distinct(owners, len(bounds) - 1)
    fails = (
        counts["words"] < 200,
        100 * distinct < 50 * counts["words"],
        100 * counts["capitals"] > 2 * counts["points"],
        counts["symbols"] > 0,
    )
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def document_failures(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``part`` (the source, null as empty), ``failed`` (bits of A to D) and ``digest`` (SHA-256 of the text).

    One row per row of the table. Null texts are empty; texts of any length are taken whole, about 4 MB of text at once,
    one text at least. Columns other than ``doc_id``, ``text`` and ``source`` are ignored.
    """
    small_batches(documents.sparkSession)
    d = documents
    rows = d.select(
        d["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(d["source"].cast("string"), F.lit("")).alias("part"),
        F.coalesce(d["text"].cast("string"), F.lit("")).alias("text"),
    )

    def run(batches):
        for batch in slices(batches):
            data, bounds = text_bytes(batch.column("text"))
            found = failures(data, bounds)
            digests = [hashlib.sha256(data[s:e]).digest() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(found, pa.int32()), pa.array(digests, pa.binary())],
                ["doc_id", "part", "failed", "digest"],
            )

    return rows.mapInArrow(run, "doc_id long, part string, failed int, digest binary")


def _with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with ``good`` and ``toxic``; several labels of one document count as the largest. Rows without an id have none."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    named = rows.where(F.col("doc_id").isNotNull()).join(known, "doc_id", "left")
    # rows without an id never meet a label, and would all be one key of the join
    nameless = rows.where(F.col("doc_id").isNull()).select("*", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return named.unionByName(nameless).fillna(0, ["good", "toxic"])


def failure_classes(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask`` (bits of A to E), ``n``, ``n_good``, ``n_toxic``: the documents of each kind.

    E is failed by a text that a row with a smaller id has, wherever that row is; null ids are smaller than all others.
    Copies are added up before they meet, so a text that a third of all rows share is a few rows per task.
    """
    rows = _with_labels(written(document_failures(documents)), labels)
    place = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id")
    kind = ["digest", "part", "failed", "good", "toxic"]
    by_id = rows.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    copies = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(place).alias("first"), F.min_by("n", place).alias("n_first"))
    lowest = copies.groupBy("digest").agg(F.min("first").alias("lowest"))
    first = F.when(F.col("first") == F.col("lowest"), F.col("n_first")).otherwise(F.lit(0))
    known = copies.join(lowest, "digest").select(
        "part", "good", "toxic", F.explode(F.array(F.struct(F.col("failed").alias("mask"), first.alias("n")),
            F.struct(F.col("failed").bitwiseOR(16).alias("mask"), (F.col("n") - first).alias("n")))).alias("kind")
    )
    return known.groupBy("part", "kind.mask").agg(
        F.sum("kind.n").alias("n"),
        F.sum(F.col("kind.n") * F.col("good")).alias("n_good"),
        F.sum(F.col("kind.n") * F.col("toxic")).alias("n_toxic"),
    )


def _bits(letters: Column) -> Column:
    """Bits of the filters named by ``letters``, an array."""
    return F.aggregate(letters, F.lit(0), lambda bits, c: bits.bitwiseOR(F.get(F.array(*[F.lit(1 << k) for k in range(5)]), F.ascii(c) - 65)))


def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """What every filter removes at every step of all 120 orders, one row per part, order and step.

    Counts within the part, zeros included: ``kept`` after the step, ``removed`` by it, ``redundant`` (fail its filter but
    were removed before), ``unique_fails`` (fail its filter alone), ``good_lost`` and ``toxic_lost`` (labelled ones among
    the removed), ``shapley`` (what its filter removes, summed over all orders). Everything follows from at most 32 classes
    per part, so orders cost nothing per document. Repeated rows count as often as they stand there; rows of one id are
    not copies of each other. Empty texts fail A alone (and E after the first). An empty table gives no row. Labels may be
    missing, null or repeated (the largest counts).
    """
    classes = written(failure_classes(documents, labels))
    steps = classes.select("*", F.explode(F.array(*[F.lit(o) for o in ORDERS])).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")
    )
    letters = F.split("filter_order", "")
    steps = steps.select(
        "*", _bits(F.slice(letters, F.col("step"), F.lit(1))).alias("own"), _bits(F.slice(letters, F.lit(1), F.col("step") - 1)).alias("before")
    )
    mask = F.col("mask")
    fails, gone = mask.bitwiseAND(F.col("own")) != 0, mask.bitwiseAND(F.col("before")) != 0

    def total(condition: Column, count: Column, name: str) -> Column:
        return F.sum(F.when(condition, count).otherwise(F.lit(0))).cast("long").alias(name)

    n = F.col("n")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone, n, "kept"),
        total(fails & ~gone, n, "removed"),
        total(fails & gone, n, "redundant"),
        total(mask == F.col("own"), n, "unique_fails"),
        total(fails & ~gone, F.col("n_good"), "good_lost"),
        total(fails & ~gone, F.col("n_toxic"), "toxic_lost"),
        total(fails, (n * len(ORDERS)) / F.bit_count(mask), "shapley"),
    )
