"""Near-duplicates by SimHash: pairs of near fingerprints, verified by the Jaccard similarity of the texts' word shingles.

A prefix filter then finds the similar pairs whose fingerprints are too far apart, so that none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afluente.functions.columns import free_name
from afluente.llm.common import slices, small_batches, text_bytes
from afluente.llm.components import smallest_reachable
from afluente.llm.simhash import SEED, fingerprint_of, near_pairs, words_of
from afluente.session import removed_path, shared_folder, written

SHINGLE_WORDS = 5
SHARE = (4, 5)  # least Jaccard similarity, as a fraction
RADIUS = 14  # of 64 bits: sets at the least similarity differ in 9.7 on average
SKETCH_BITS = 64  # least bits of a sketch
SAMPLE_TEXTS = 20_000  # texts that common shingles are counted on
COMMON_COUNT = 4  # texts of the sample that a common shingle is in
COMMON = 1 << 16
TILE = 512
SMALL = 32  # rows of a shingle whose pairs are made together with those of other shingles
GATHERED_ROWS = 1 << 13  # rows, and bytes of their sketches, that are looked at together
GATHERED_BYTES = 8 << 20
SKETCH_WORDS = 1 << 20  # words of sketches that are compared at once


def shingles(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, one without words none."""
    found = words_of(text)
    if not found:
        return np.zeros(0, np.uint64)
    parts = [" ".join(found)] if len(found) < words else set(map(" ".join, zip(*(found[k:] for k in range(words)))))
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts)))


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of the hashes in each cell, a power of two of them, one for each member at least: two sketches, the
    longer one folded, differ in no more bits than the sets in members, and chance pairs of any size in many more."""
    cells = max(SKETCH_BITS, 1 << (len(hashes) - 1).bit_length())
    return np.packbits((np.bincount((hashes % np.uint64(cells)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)).tobytes()


def _remixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles, for a second fingerprint."""
    hashes = (hashes ^ hashes >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return (hashes ^ hashes >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)


def prefix(hashes: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first members by a fixed order, common ones last: two sets within the least similarity share one of them."""
    n = len(hashes)
    keep = n - -(-SHARE[0] * n // SHARE[1]) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        hashes = hashes[np.argsort(np.where(common[at] == hashes, ranks[at], -1), kind="stable")]
    return hashes[:keep]


class _Sketches:
    """Sketches of a column, one after the other."""

    def __init__(self, column: pa.Array) -> None:
        data, bounds = text_bytes(column)
        self.words = data.view(np.uint64)
        self.starts, self.lengths = bounds[:-1] // 8, np.diff(bounds) // 8

    def folded(self, rows: np.ndarray, width: int) -> np.ndarray:
        length = int(self.lengths[rows[0]])
        found = self.words[self.starts[rows, None] + np.arange(length)]
        return np.bitwise_xor.reduce(found.reshape(len(rows), -1, width), axis=1)

    def apart(self, rows: np.ndarray, others: _Sketches, at: np.ndarray) -> np.ndarray:
        """Bits in which sketches ``rows`` differ from sketches ``at`` of the others."""
        out = np.zeros(len(rows), np.int64)
        kinds = self.lengths[rows] << 32 | others.lengths[at]
        for kind in np.unique(kinds).tolist():
            same, width = np.flatnonzero(kinds == kind), min(kind >> 32, kind & 0xFFFFFFFF)
            step = max(1, SKETCH_WORDS // max(kind >> 32, kind & 0xFFFFFFFF))
            for some in (same[k : k + step] for k in range(0, len(same), step)):
                bits = self.folded(rows[some], width) ^ others.folded(at[some], width)
                out[some] = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        return out


def _near_sizes(size: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return SHARE[1] * np.minimum(size, sizes) >= SHARE[0] * np.maximum(size, sizes)


def _near_sketches(total: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """True for all pairs within the least similarity; ``total`` has the sums of their sizes."""
    # |A ^ B| <= (1 - s) / (1 + s) * (|A| + |B|) where the similarity is s or more
    return apart * (SHARE[1] + SHARE[0]) <= (SHARE[1] - SHARE[0]) * total


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many texts, sorted, and their ranks. Bears on the cost alone: any fixed order finds all pairs."""
    step = max(1, texts.count() // SAMPLE_TEXTS)

    def run(batches):
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], ["shingle"])

    held = texts.filter(F.pmod("id", F.lit(step)) == 0).select("text").mapInArrow(run, "shingle long").groupBy("shingle").count()
    rows = held.filter(F.col("count") >= COMMON_COUNT).orderBy(F.desc("count"), "shingle").limit(COMMON).collect()
    found = np.array([r["shingle"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], (len(found) - order).astype(np.int64)


def _prefixes(texts: DataFrame) -> DataFrame:
    """``shingle``, ``id`` and ``size`` of the set for every member of every prefix."""
    common, ranks = _common(texts)

    def run(batches):
        for batch in slices(batches):
            for own, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                hashes = shingles(text)
                if len(hashes):
                    first = prefix(hashes, common, ranks)
                    same = [pa.array(np.full(len(first), own, np.int64)), pa.array(np.full(len(first), len(hashes), np.int64))]
                    yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), *same], ["shingle", "id", "size"])

    return texts.mapInArrow(run, "shingle long, id long, size long")


def _verified(pairs: DataFrame, marks: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` that are within the least similarity."""
    wide = pairs
    for side in ("a", "b"):
        wide = wide.join(marks.select(F.col("id").alias(side), F.col("size").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)

    def screen(batches):
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            near = np.flatnonzero(_near_sizes(n_a, n_b))
            apart = _Sketches(batch.column("s_a")).apart(near, _Sketches(batch.column("s_b")), near)
            near = pa.array(near[_near_sketches((n_a + n_b)[near], apart)])
            yield pa.RecordBatch.from_arrays([batch.column("a").take(near), batch.column("b").take(near)], ["a", "b"])

    wide = written(wide.mapInArrow(screen, "a long, b long"))
    for side in ("a", "b"):
        wide = wide.join(texts.select(F.col("id").alias(side), F.col("text").alias("text" if side == "a" else "other")), side)

    def compare(batches):
        for batch in slices(batches):
            near, last, hashes = [], None, None
            for b, text, other in zip(batch.column("b").to_pylist(), batch.column("text").to_pylist(), batch.column("other").to_pylist()):
                if b != last:
                    last, hashes = b, shingles(other)
                own = shingles(text)
                both = len(np.intersect1d(own, hashes, assume_unique=True))
                near.append(SHARE[1] * both >= SHARE[0] * (len(own) + len(hashes) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    return written(wide.select("a", "b", "text", "other").mapInArrow(compare, "a long, b long"))


def _groups(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The groups (``id`` and ``low``, the smallest id in it) that links between their members join to larger ones."""
    if links.isEmpty():
        return groups
    for side in ("a", "b"):
        links = links.join(groups.select(F.col("id").alias(side), F.col("low").alias(f"low_{side}")), side)
    between = links.filter("low_a != low_b").select(F.col("low_a").alias("a"), F.col("low_b").alias("b"))
    lows = groups.filter("id = low").select(F.col("low").alias("fingerprint"), "low")
    joined = smallest_reachable(lows, between).filter("fingerprint != component").withColumnRenamed("fingerprint", "low")
    return written(groups.join(joined, "low", "left").select("id", F.coalesce("component", "low").alias("low")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _mixed(shared: DataFrame, marks: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of shingles whose members are in different groups (``id``, ``low``) so far, with group and sketch."""
    rows = shared.join(groups, "id")
    mixed = rows.groupBy("shingle").agg(F.min("low").alias("least"), F.max("low").alias("most")).filter("least != most")
    rows = rows.join(mixed.select("shingle"), "shingle", "left_semi").join(marks.select("id", "sketch"), "id")
    return rows.select("shingle", "id", "size", "low", "sketch")


class _Members:
    """Rows of ``_mixed``, whole shingles of them: where each shingle starts, how many rows it has, and the columns."""

    def __init__(self, held: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(held).combine_chunks()
        keys, self.own, self.size, self.low = (table.column(c).to_numpy() for c in ("shingle", "id", "size", "low"))
        self.heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.counts = np.diff(np.append(self.heads, len(keys)))
        self.sketches = _Sketches(pa.concat_arrays(table.column("sketch").chunks))

    def pairs(self, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        """The ids of rows ``x`` and ``y`` where they are in different groups and may be near."""
        good = (self.low[x] != self.low[y]) & _near_sizes(self.size[x], self.size[y])
        x, y = x[good], y[good]
        near = _near_sketches(self.size[x] + self.size[y], self.sketches.apart(x, self.sketches, y))
        found = np.unique(np.stack([self.own[x[near]], self.own[y[near]]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])


def _whole_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[_Members]:
    """Some shingles at a time, each with all its rows, which come sorted by shingle."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held, rows, size = [*held, batch], rows + batch.num_rows, size + batch.nbytes
        last = batch.column("shingle")[-1].as_py()
        if (rows >= GATHERED_ROWS or size >= GATHERED_BYTES) and held[0].column("shingle")[0].as_py() != last:
            start = len(held) - 1
            while held[start].column("shingle")[0].as_py() == last:
                start -= 1
            at = int(np.searchsorted(held[start].column("shingle").to_numpy(), last))
            yield _Members([*held[:start], held[start].slice(0, at)])
            held = [held[start].slice(at), *held[start + 1 :]] if at < held[start].num_rows else held[start + 1 :]
            rows, size = sum(b.num_rows for b in held), sum(b.nbytes for b in held)
    if held:
        yield _Members(held)


def _pairs_by_shingle(rows: DataFrame, pairs_of) -> DataFrame:
    def run(batches):
        for members in _whole_shingles(batches):
            yield from pairs_of(members)

    # Not by the bare column: joins before have dealt the rows by it, so Spark would drop this exchange, and joins that
    # turn to broadcasts while they run would then leave the rows of a shingle in several tasks.
    dealt = rows.repartition(F.xxhash64("shingle")).sortWithinPartitions("shingle")
    return _ordered(dealt.mapInArrow(run, "a long, b long"))


def _hub_pairs(shared: DataFrame) -> DataFrame:
    """Every member of a shingle with three of its members that may be near, so that a large group of copies costs no
    square; for the rows of ``_mixed``."""

    def pairs_of(members: _Members) -> Iterator[pa.RecordBatch]:
        own, heads, counts = members.own, members.heads, members.counts
        number, rows = np.repeat(np.arange(len(heads)), counts), np.arange(len(own))
        mixed = (own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        order = [np.lexsort((keys, number)) for keys in (own, mixed)]
        for hub in (order[0][heads], order[0][heads + counts - 1], order[1][heads]):
            yield members.pairs(rows, hub[number])

    return _pairs_by_shingle(shared, pairs_of)


def _other_pairs(shared: DataFrame, marks: DataFrame, groups: DataFrame) -> DataFrame:
    """All pairs of a shingle that are in different groups (``id``, ``low``) so far and may be near."""

    def pairs_of(members: _Members) -> Iterator[pa.RecordBatch]:
        within = np.arange(len(members.own)) - np.repeat(members.heads, members.counts)
        few = np.repeat(members.counts <= SMALL, members.counts)
        for back in range(1, SMALL):
            later = np.flatnonzero(few & (within >= back))
            if not len(later):
                break
            yield members.pairs(later, later - back)
        for head, count in zip(members.heads, members.counts):
            if count > SMALL:
                yield from tiles(members, head + np.argsort(members.size[head : head + count], kind="stable"))

    def tiles(members: _Members, order: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = members.size[order]
        for i in range(0, len(order), TILE):
            last = min(i + TILE, len(order))
            end = int(np.searchsorted(size, size[last - 1] * SHARE[1] // SHARE[0], side="right"))
            for j in range(i, end, TILE):
                x, y = np.meshgrid(np.arange(i, last), np.arange(j, min(j + TILE, end)), indexing="ij")
                yield members.pairs(order[x[x < y]], order[y[x < y]])

    return _pairs_by_shingle(_mixed(shared, marks, groups), pairs_of)


def without_near_duplicates(documents: DataFrame) -> DataFrame:
    """One row of each group of texts that chains of pairs with a 5-word Jaccard similarity of 0.8 or more connect.

    Pairs of near SimHash fingerprints over the distinct shingles come first, verified by the texts. Complete: every
    similar pair that they have not connected shares a member of its prefixes, by which it is found, and only verified
    pairs connect. Rows
    stay by their texts, never by their ids: null and repeated ids lose nothing but their own near-duplicates. The row
    of the smallest id stays (null ids last), of equal ids the one of the smallest hash of all columns.

    Words are as in ``simhash.fingerprint``. Texts of fewer than five words are one shingle; null and blank texts are
    one group. Equal sets are one row before any pair is made. Sets and shingles are told apart by 64-bit hashes. All
    columns are kept; an empty table gives an empty result.
    """
    small_batches(documents.sparkSession)
    names = sorted(documents.columns)
    own = free_name("_row", names)
    numbered = documents.withColumn(own, F.unhex(F.sha2(F.to_json(F.struct(*names)), 256)))

    def mark(batches):
        for batch in slices(batches):
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            ids = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in found], np.uint64)
            prints, checks = (np.array([fingerprint_of(h) for h in hashes], np.uint64) for hashes in (found, map(_remixed, found)))
            made = [pa.array(ids.view(np.int64)), pa.array([len(h) for h in found], pa.int64()), pa.array([sketch(h) for h in found], pa.binary())]
            made += [pa.array(prints.view(np.int64)), pa.array(checks.view(np.int64))]
            names = ["_row", "doc_id", "id", "size", "sketch", "fingerprint", "check"]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), *made], names)

    plain = numbered.select(F.col(own).alias("_row"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = written(plain.mapInArrow(mark, "_row binary, doc_id long, id long, size long, sketch binary, fingerprint long, check long"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("named"), "doc_id", "_row"))
    same = [F.first(c).alias(c) for c in ("size", "sketch", "fingerprint", "check")]
    marks = written(marked.groupBy("id").agg(first.alias("low"), *same))
    chosen = plain.join(marks.select(F.col("low._row").alias("_row"), "id"), "_row")
    texts = written(chosen.select("id", "text").dropDuplicates(["id"]))

    guessed = written(near_pairs(marks, RADIUS))
    groups = _groups(marks.select("id", F.col("id").alias("low")), _verified(guessed, marks, texts))

    path = shared_folder(documents.sparkSession)
    _prefixes(texts).write.parquet(path)
    every = documents.sparkSession.read.schema("shingle long, id long, size long").parquet(path)
    shared = written(every.join(every.groupBy("shingle").count().filter("count > 1"), "shingle", "left_semi").select("shingle", "id", "size"))
    removed_path(documents.sparkSession, path)
    tried = written(_hub_pairs(_mixed(shared, marks, groups)).join(guessed, ["a", "b"], "left_anti"))
    groups = _groups(groups, _verified(tried, marks, texts))
    rest = written(_other_pairs(shared, marks, groups).join(guessed.unionByName(tried), ["a", "b"], "left_anti"))
    groups = _groups(groups, _verified(rest, marks, texts))
    firsts = marks.select("id", F.col("low").alias("first")).join(groups, "id").groupBy("low").agg(F.min("first").alias("first"))
    kept = firsts.select("first._row")
    # Rows of one _row are equal in all columns.
    kept = kept.withColumnRenamed("_row", own)
    return numbered.join(kept, own, "left_semi").dropDuplicates([own]).drop(own)
