"""Connected components of links between fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from afluente.session import written

MOST_NODES = 100_000  # that a task holds at once


class LocalSets:
    """Disjoint sets within a task; each gives links from its members to its smallest one."""

    def __init__(self, kind: type = np.uint64) -> None:
        self.kind = kind
        self.above: dict[int, int] = {}

    def __len__(self) -> int:
        return len(self.above)

    def clear(self) -> None:
        self.above.clear()

    def top(self, item: int) -> int:
        above = self.above
        root = item
        while above.get(root, root) != root:
            root = above[root]
        while above.get(item, item) != root:
            above[item], item = root, above[item]
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        low, high = min(a, b), max(a, b)
        self.above[low] = low
        self.above[high] = low

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        found = [(item, self.top(item)) for item in self.above]
        found = [(a, b) for a, b in found if a != b]
        return np.array([a for a, _ in found], self.kind), np.array([b for _, b in found], self.kind)


def smallest_reachable(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``fingerprint`` and ``component``, the smallest ``low`` of all nodes that links (``a``, ``b``) connect to it.

    Each task first joins the links it reads. Large-star and small-star steps in turn then point every node's neighbours
    at the smallest of them, so that chains shrink by a factor in each round and no group is gathered. Steps read and
    write tables in the shared folder; the driver sees only counts, which the writes bring along.
    """
    edges, seen = _counted(links.filter(F.col("a") != F.col("b")).select("a", "b").mapInArrow(_joined, "a long, b long"))
    before = None
    while seen[0] and seen != before:
        before = seen
        edges, seen = _counted(_small_star(_large_star(edges)))
    # Now every linked node points at the smallest fingerprint of its component.
    centre = nodes.join(edges.withColumnRenamed("a", "fingerprint"), "fingerprint", "left")
    centre = centre.withColumn("centre", F.coalesce("b", "fingerprint")).drop("b")
    lowest = centre.groupBy("centre").agg(F.min("low").alias("component"))
    return centre.join(lowest, "centre").select("fingerprint", "component")


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, with their number and the sum of their hashes."""
    seen = Observation()
    marks = F.count("*").alias("rows"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hashes")
    saved = written(edges.observe(seen, *marks))
    found = seen.get or saved.agg(*marks).first().asDict()
    return saved, (found["rows"], found["hashes"])


def _joined(batches):
    """Links that connect what the links of this task do, one for each node at most, now and then begun anew."""
    sets = LocalSets(np.int64)

    def drain():
        a, b = sets.pairs()
        sets.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            sets.join(a, b)
        if len(sets) > MOST_NODES:
            yield drain()
    yield drain()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node are pointed at the smallest of the node and its neighbours; rows may repeat."""
    pairs = _both_ways(edges)
    least = pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    wide = pairs.join(least, "a").filter(F.col("b") > F.col("a"))
    return wide.select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below are pointed at the smallest of those."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    wide = down.join(least, "a")
    pointed = wide.select(F.col("b").alias("a"), F.col("least").alias("b")).filter(F.col("a") != F.col("b"))
    return pointed.union(least.select("a", F.col("least").alias("b"))).distinct()
