"""Benchmark decontamination: exact pieces of test items lead to places that a bit-parallel edit distance verifies."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afluente.llm.common import slices, small_batches, texts_of

ERROR_RATE = 0.1  # edits allowed per character of an item
BLOCK_CHARS = 4 << 20  # characters of items that a task holds at once
GRAM = 6


def plain(text: str) -> str:
    """Lower case, every run of white space as one space."""
    return " ".join(text.lower().split())


@dataclass
class Item:
    """A test item: its plain text, the edits allowed, and bit masks of its characters."""

    item_id: int | None
    text: str
    budget: int

    def __post_init__(self) -> None:
        self.masks: dict[str, int] = defaultdict(int)
        for k, c in enumerate(self.text):
            self.masks[c] |= 1 << k
        self.masks = dict(self.masks)
        self.grams = [self.text[k : k + GRAM] for k in range(len(self.text) - GRAM + 1)]
        # An edit spoils no more than GRAM grams, so that many must be found in any place within the budget.
        self.least = len(self.grams) - GRAM * self.budget

    def pieces(self) -> list[tuple[str, int]]:
        """The text cut into one piece more than there are edits: one of them must be found as it is."""
        n, count = len(self.text), self.budget + 1
        cuts = [n * k // count for k in range(count + 1)]
        return [(self.text[a:b], a) for a, b in zip(cuts, cuts[1:])]

    def may_be_in(self, window: str) -> bool:
        if self.least <= 0:
            return True
        there = {window[k : k + GRAM] for k in range(len(window) - GRAM + 1)}
        return sum(map(there.__contains__, self.grams)) >= self.least

    def distance(self, window: str) -> tuple[int, int]:
        """Least edit distance to any part of the window, and where the first such part ends (Myers)."""
        m = len(self.text)
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score = full, 0, m
        best, end = m, 0
        masks = self.masks
        for k, c in enumerate(window, 1):
            equal = masks.get(c, 0)
            vertical = equal | minus
            horizontal = (((equal & plus) + plus) ^ plus) | equal
            up, down = minus | ~(horizontal | plus) & full, plus & horizontal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best:
                    best, end = score, k
            up, down = up << 1 & full, down << 1 & full
            plus, minus = down | ~(vertical | up) & full, up & vertical
        return best, end


class Finder:
    """Finds items in plain texts within their budgets."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = ERROR_RATE) -> None:
        self.items = [Item(k, t, int(rate * len(t))) for k, t in items if t]
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, item in enumerate(self.items):
            for piece, offset in item.pieces():
                where[piece].append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int | None, int, int]]:
        """``item_id``, distance and end of the best place of every item that the text has within its budget."""
        if not self.items:
            return
        starts: dict[int, set[int]] = defaultdict(set)
        for last, (size, uses) in self.automaton.iter(text):
            for number, offset in uses:
                starts[number].add(last - size + 1 - offset)
        for number, found in sorted(starts.items()):
            item, best = self.items[number], None
            for low, high in _merged(sorted(found), item.budget):
                begin = max(0, low - item.budget)
                window = text[begin : max(0, high + len(item.text) + item.budget)]
                if not item.may_be_in(window):
                    continue
                distance, end = item.distance(window)
                if distance <= item.budget and (best is None or distance < best[0]):
                    best = (distance, begin + end)
            if best:
                yield item.item_id, *best


def _merged(starts: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """Starts that lie close together as one stretch."""
    low = high = starts[0]
    for start in starts[1:]:
        if start - high > gap:
            yield low, high
            low = start
        high = start
    yield low, high


def contaminated(documents: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Which documents have which test items: ``doc_id``, ``item_id``, ``distance`` (edits) and ``end_at``.

    Texts are compared in lower case with single spaces. An item of m characters is found where a part of the document
    is within ``rate`` times m edits of it; ``end_at`` is where the best part ends, in that form of the document. Every
    item is cut into one piece more than its budget; an automaton finds all exact pieces in one pass over the whole
    document, and each place is verified.

    Items are the query set: blocks of bounded size go to all tasks, and each block is one pass over the documents.
    Null and blank texts and items are in nothing; items below 1 / ``rate`` characters must be found exactly. Repeated
    rows each give their rows; equal items are found each by its own id. Other columns are ignored.
    """
    spark = documents.sparkSession
    small_batches(spark)
    rows = texts_of(documents)
    schema = "doc_id long, item_id long, distance long, end_at long"
    found = spark.createDataFrame([], schema)
    for block in _blocks(_items(benchmark), block_chars):

        def run(batches, block=block):
            finder = Finder(block, rate)
            for batch in slices(batches):
                out = [
                    (doc, *hit)
                    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                    for hit in finder.find(plain(text))
                ]
                columns = zip(*out) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["doc_id", "item_id", "distance", "end_at"])

        found = found.unionByName(rows.mapInArrow(run, schema))
    return found


def _items(benchmark: DataFrame) -> DataFrame:
    b = benchmark
    return b.select(b["item_id"].cast("long").alias("item_id"), b["text"].cast("string").alias("text")).filter(F.trim("text") != "")


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of about ``limit`` characters, one block at a time on the driver."""
    block, size = [], 0
    for row in items.toLocalIterator():
        text = plain(row["text"])
        block.append((row["item_id"], text))
        size += len(text)
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def without_contamination(documents: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents, all columns kept, without the rows whose text has a test item. Each row is judged by its own text,
    whatever its id; every block of items is one pass over the rows that the blocks before have left."""
    small_batches(documents.sparkSession)
    left = documents
    for block in _blocks(_items(benchmark), block_chars):

        def run(batches, block=block):
            finder = Finder(block, rate)
            for batch in slices(batches):
                clean = [next(finder.find(plain(t or "")), None) is None for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        left = left.mapInArrow(run, documents.schema)
    return left
