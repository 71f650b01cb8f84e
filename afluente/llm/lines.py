"""Incremental line deduplication: cuckoo filters by shard over exact reference counts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from afluente.llm.common import slices, small_batches
from afluente.session import written

MIN_CHARS = 20
MIN_DOCUMENTS = 3
BLANKS = " \t\n\x0b\x0c\r"
SHARD_KEYS = 500_000  # active keys that a shard's filter is made for
FILTER_LIMIT_BYTES = 32 << 20  # filters go to all tasks only while they are smaller than this together
NOBODY = -(2**63)  # stands for the rows without an id, before all others

_SLOTS = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class CuckooFilter:
    """A set of 16-byte keys kept as 16-bit marks in two possible buckets of four; keys can be taken out again.

    It never misses a key that was put in; of others it lets about one in 8,000 through.
    """

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @classmethod
    def for_keys(cls, keys: list[bytes]) -> CuckooFilter:
        buckets = 1 << max(1, int(len(keys) / (_SLOTS * 0.8)).bit_length())
        while True:
            made = cls(np.zeros((buckets, _SLOTS), np.uint16))
            if all(made.insert(key) for key in keys):
                return made
            buckets *= 2

    @classmethod
    def of_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, _SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        marks = (words[:, 0] >> np.uint64(48)).astype(np.uint16)
        marks[marks == 0] = 1
        mask = np.uint64(len(self.table) - 1)
        first = words[:, 1] & mask
        return marks, first, first ^ (marks.astype(np.uint64) * np.uint64(0x5BD1E995) & mask)

    def insert(self, key: bytes) -> bool:
        """False if there is no room; a larger filter must then be made."""
        marks, first, second = self._places(np.frombuffer(key, np.uint64).reshape(1, 2))
        mark, mask = int(marks[0]), len(self.table) - 1
        for bucket in (int(first[0]), int(second[0])):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        bucket = int(second[0])
        for turn in range(500):  # push marks on to their other buckets
            slot = turn % _SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket ^= mark * 0x5BD1E995 & mask
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def delete(self, key: bytes) -> None:
        """Take out a key that is in."""
        marks, first, second = self._places(np.frombuffer(key, np.uint64).reshape(1, 2))
        for bucket in (int(first[0]), int(second[0])):
            there = np.flatnonzero(self.table[bucket] == marks[0])
            if len(there):
                self.table[bucket, there[0]] = 0
                return
        raise KeyError(key)

    def holds(self, words: np.ndarray) -> np.ndarray:
        """For keys as rows of two 64-bit words: which may be in."""
        marks, first, second = self._places(words)
        return ((self.table[first] == marks[:, None]) | (self.table[second] == marks[:, None])).any(axis=1)


def line_key(line: Column) -> Column:
    """A line without blanks at its ends and with A-Z lowered."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def _digest(key: Column) -> Column:
    return F.unhex(F.md5(key))


def _doc(documents: DataFrame) -> Column:
    return F.coalesce(documents["doc_id"].cast("long"), F.lit(NOBODY))


def _lines(documents: DataFrame) -> Column:
    return F.split(F.coalesce(documents["text"].cast("string"), F.lit("")), "\n", -1)


def references_of(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``key`` (16 bytes), ``doc`` and ``refs``, the lines of the document with that key."""
    keys = F.filter(F.transform(_lines(documents), line_key), lambda k: F.char_length(k) >= min_chars)
    rows = documents.select(_doc(documents).alias("doc"), F.explode(keys).alias("line"))
    return rows.select(_digest("line").alias("key"), "doc").groupBy("key", "doc").agg(F.count("*").alias("refs"))


@dataclass
class LineIndex:
    """State of the deduplication; all three are tables in the shared folder.

    ``references``: every key of every document with its count; ``active``: keys in enough documents, with the largest
    document; ``filters``: one cuckoo filter of active keys per shard.
    """

    references: DataFrame
    active: DataFrame
    filters: DataFrame
    shards: int
    min_documents: int
    min_chars: int


def _active(references: DataFrame, min_documents: int) -> DataFrame:
    held = references.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last"))
    return held.filter(F.col("n_docs") >= min_documents)


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _make_filters(active: DataFrame, shards: int) -> DataFrame:
    def build(group: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.for_keys([bytes(k) for k in group["key"]])
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "filter": [made.to_bytes()]})

    return active.select(_shard(shards).alias("shard"), "key").groupBy("shard").applyInPandas(build, "shard int, filter binary")


def build_index(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS) -> LineIndex:
    """Index of a first set of documents. Repeated rows of one id are one document."""
    references = written(references_of(documents, min_chars))
    active = written(_active(references, min_documents))
    shards = max(4, -(-active.count() // SHARD_KEYS))
    return LineIndex(references, active, written(_make_filters(active, shards)), shards, min_documents, min_chars)


def insert_documents(index: LineIndex, documents: DataFrame) -> LineIndex:
    """The index with further documents, whose ids must be new."""
    added = written(references_of(documents, index.min_chars))
    return _changed(index, index.references.unionByName(added), added)


def delete_documents(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index as if the documents of these ids (column ``doc_id``) had never been put in."""
    gone = ids.select(_doc(ids).alias("doc")).distinct()
    removed = written(index.references.join(gone, "doc", "left_semi").select("key", "doc", "refs"))
    return _changed(index, index.references.join(gone, "doc", "left_anti").select("key", "doc", "refs"), removed)


def _changed(index: LineIndex, references: DataFrame, changes: DataFrame) -> LineIndex:
    """Count the touched keys again and put in or take out those that became or ceased to be active."""
    references = written(references)
    touched = changes.select("key").distinct()
    again = written(_active(references.join(touched, "key", "left_semi"), index.min_documents))
    before = index.active.join(touched, "key", "left_semi")
    came = again.join(before, "key", "left_anti").select("key", F.lit(True).alias("came"))
    went = before.join(again, "key", "left_anti").select("key", F.lit(False).alias("came"))
    moves = came.union(went).withColumn("shard", _shard(index.shards))
    active = written(index.active.join(touched, "key", "left_anti").unionByName(again))

    def patch(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        filled = CuckooFilter.of_bytes(bytes(old["filter"].iloc[0])) if len(old) else CuckooFilter.for_keys([])
        for k, put in sorted(zip(map(bytes, new["key"]), new["came"]), key=lambda m: (m[1], m[0])):
            if not put:
                filled.delete(k)
            elif not filled.insert(k):
                return pd.DataFrame({"shard": [key[0]], "filter": [b""]})  # no room: made anew below
        return pd.DataFrame({"shard": [key[0]], "filter": [filled.to_bytes()]})

    patched = written(
        index.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(patch, "shard int, filter binary")
    )
    full = patched.filter(F.length("filter") == 0).select("shard")
    if not full.isEmpty():
        lacking = active.withColumn("shard", _shard(index.shards)).join(full, "shard", "left_semi").select("key")
        patched = written(patched.filter(F.length("filter") > 0).unionByName(_make_filters(lacking, index.shards)))
    return LineIndex(references, active, patched, index.shards, index.min_documents, index.min_chars)


def _screened(index: LineIndex) -> DataFrame:
    """References whose key may be active by the filters. With filters too large to send, all references."""
    size = index.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
    if size > FILTER_LIMIT_BYTES:
        return index.references.select("key", "doc")
    raw = {row["shard"]: bytes(row["filter"]) for row in index.filters.collect()}

    def screen(batches):
        filters = {shard: CuckooFilter.of_bytes(data) for shard, data in raw.items()}
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            keys = b"".join(batch.column("key").to_pylist())
            words = np.frombuffer(keys, np.uint64).reshape(-1, 2)
            maybe = np.zeros(len(shards), bool)
            for shard, own in filters.items():
                here = np.flatnonzero(shards == shard)
                maybe[here] = own.holds(words[here])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc")], ["key", "doc"]).filter(pa.array(maybe))

    marked = index.references.select("key", "doc", _shard(index.shards).alias("shard"))
    return marked.mapInArrow(screen, "key binary, doc long")


def drop_repeated_lines(documents: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """The documents without the lines that enough documents share; the largest of these documents keeps them.

    A line's key has no blanks at its ends and A-Z lowered; keys below the least length always stay. Columns ``text``
    (remaining lines), ``n_lines`` and ``n_dropped`` are set, all others are kept. ``index`` must hold the documents;
    without one it is made from them.

    The filters spare most references the exact join. Counting combines on the map side, and the join of one frequent
    key is split by the adaptive plan, as its other side has one row per key. Null texts are one empty line. Rows
    without an id are one document before all others; repeated rows of an id are one document and each loses or keeps
    its lines. An empty table gives an empty result.
    """
    small_batches(documents.sparkSession)
    index = index or build_index(documents)
    least = index.min_chars
    lost = _screened(index).join(index.active.select("key", "last"), "key").filter(F.col("doc") < F.col("last"))
    by_doc = lost.groupBy("doc").agg(F.collect_list("key").alias("lost"))
    kept = [c for c in documents.columns if c not in ("text", "n_lines", "n_dropped")]
    inputs = [documents[c].alias(f"c{k}") for k, c in enumerate(kept)]
    rows = documents.select(*inputs, _doc(documents).alias("doc"), F.coalesce(documents["text"].cast("string"), F.lit("")).alias("text"))
    wide = rows.join(by_doc, "doc", "left").drop("doc")
    lower = str.maketrans(_UPPER, _LOWER)

    def rewrite(batches):
        import hashlib

        def key(line: str) -> bytes | None:
            line = line.strip(BLANKS)
            return hashlib.md5(line.translate(lower).encode(), usedforsecurity=False).digest() if len(line) >= least else None

        for batch in slices(batches):
            texts, counts, dropped = [], [], []
            for text, keys in zip(batch.column("text").to_pylist(), batch.column("lost").to_pylist()):
                lines = text.split("\n")
                gone = set(keys or ())
                left = [x for x in lines if key(x) not in gone] if gone else lines
                counts.append(len(lines))
                dropped.append(len(lines) - len(left))
                texts.append("\n".join(left) if dropped[-1] else text)
            made = [pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())]
            same = [batch.column(f"c{k}") for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*same, *made], [*(f"c{k}" for k in range(len(kept))), "text", "n_lines", "n_dropped"])

    kinds = dict(wide.dtypes)
    schema = "".join(f"c{k} {kinds[f'c{k}']}, " for k in range(len(kept))) + "text string, n_lines long, n_dropped long"
    done = wide.mapInArrow(rewrite, schema)
    return done.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(kept)), "text", "n_lines", "n_dropped")
