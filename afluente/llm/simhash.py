"""SimHash near-duplicates: exact comparison of tiles of fingerprints, and near pairs at a wide radius by sorted tables."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afluente.llm.common import slices, small_batches, texts_of
from afluente.llm.components import LocalSets, smallest_reachable
from afluente.session import written

RADIUS = 2
SHINGLE_WORDS = 3
SEED = 42
BITS = 64
TILE = 4096  # fingerprints that one comparison takes from either side
FULL_TILE = 2000  # fingerprints that a tile should have on average
TABLES = 32  # orders of the bits under which fingerprints are sorted
BUCKET = 16  # fingerprints of a table that should share their first bits
WINDOW = 64  # fingerprints before it in its bucket that each one is compared with

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str) -> list[str]:
    """The words between ASCII blanks, A-Z lowered."""
    return _WORDS.findall(text.translate(_LOWER) if not text.isascii() else text.lower())


def fingerprint(text: str) -> int:
    """Bit i is set where over half of the shingles' hashes have it; 0 without words."""
    words = words_of(text)
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        shingles = [" ".join(words)]
    else:
        shingles = list(map(" ".join, zip(*(words[k:] for k in range(SHINGLE_WORDS)))))
    digest = xxhash.xxh64_digest
    return majority(b"".join([digest(s, SEED) for s in shingles[k : k + (1 << 16)]]) for k in range(0, len(shingles), 1 << 16))


def majority(digests: Iterable[bytes]) -> int:
    """Bit i is set where over half of the hashes have it; they come as their bytes, the highest first, block by block."""
    n, counts = 0, np.zeros(BITS, np.int64)
    for raw in digests:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8), axis=1)
        n, counts = n + len(bits), counts + bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of shingles that are hashed already; 0 without any."""
    return majority(hashes[k : k + (1 << 16)].astype(">u8").tobytes() for k in range(0, len(hashes), 1 << 16))


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``fingerprint`` (a long with the 64 bits) of every document."""
    small_batches(documents.sparkSession)

    def run(batches):
        for batch in slices(batches):
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    return texts_of(documents).mapInArrow(run, "doc_id long, fingerprint long")


def parts_for(count: int, full: int = FULL_TILE) -> int:
    """Into how many parts fingerprints are cut so that tiles of equal part counts have about ``full`` members.

    A part of b fair bits has a count with a spread of sqrt(b) / 2, so about 2 sqrt(b) values share the fingerprints.
    """
    for parts in (1, 2, 4, 8):
        if count / (2 * (BITS / parts) ** 0.5) ** parts <= full:
            return parts
    return 16


def visits(parts: int, radius: int = RADIUS) -> list[tuple[int, ...]]:
    """The changes of part counts that two fingerprints within the radius can have, one of each opposite pair."""
    found: set[tuple[int, ...]] = {(0,) * parts}
    for _ in range(radius):
        found |= {v[:k] + (v[k] + d,) + v[k + 1 :] for v in found for k in range(parts) for d in (1, -1)}
    return sorted(v for v in found if v > (0,) * parts)


def links(prints: DataFrame, radius: int = RADIUS, parts: int | None = None) -> DataFrame:
    """Links ``a, b`` between different fingerprints, enough of them to join all that chains of near ones join.

    ``prints`` has distinct longs in ``fingerprint``. Each fingerprint is cut into parts; those with equal population
    counts of all parts are a tile. Two within the radius have counts that differ by no more than the radius in all, so
    only such pairs of tiles are compared: each fingerprint stays in its own tile and visits the tiles a little above.
    A task compares blocks with exclusive-or and bit counts, and passes on one link per fingerprint and tile at most.
    """
    if parts is None:
        parts = parts_for(prints.count())
    width = BITS // parts
    mask = (1 << width) - 1

    def part_counts(values: np.ndarray) -> np.ndarray:
        return np.stack([np.bitwise_count(values >> np.uint64(k * width) & np.uint64(mask)) for k in range(parts)], axis=1).astype(np.int16)

    moves = np.array(visits(parts, radius), np.int16)

    def deal(batches):
        for batch in batches:
            values = batch.column("fingerprint").to_numpy().view(np.uint64)
            for start in range(0, len(values), 4096):
                piece = values[start : start + 4096]
                counts = part_counts(piece)
                there = counts[:, None, :] + moves[None, :, :]
                fits = ((there >= 0) & (there <= width)).all(axis=2)
                keys = np.concatenate([counts, there[fits]]).astype(np.uint8)
                who = np.concatenate([np.arange(len(piece)), np.nonzero(fits)[0]])
                tile = pa.array([k.tobytes() for k in keys], pa.binary())
                home = pa.array(np.arange(len(keys)) < len(piece))
                yield pa.RecordBatch.from_arrays([tile, home, pa.array(piece[who].view(np.int64))], ["tile", "home", "fingerprint"])

    def compare(batches):
        # Rows come tile by tile, the members of a tile before its visitors.
        key, members, sets = None, [], LocalSets()
        waiting: list[int] = []

        def visit():
            nonlocal waiting
            if waiting and members:
                _join_near(np.array(waiting, np.uint64), np.array(members, np.uint64), radius, sets)
            waiting = []

        def close():
            visit()
            if key is not None and len(members) > 1:
                own = np.array(members, np.uint64)
                for k in range(0, len(own), TILE):
                    _join_near(own[k : k + TILE], own[k:], radius, sets)

        def drain():
            a, b = sets.pairs()
            sets.clear()
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            tiles = batch.column("tile").to_pylist()
            homes = batch.column("home").to_pylist()
            values = batch.column("fingerprint").to_numpy().view(np.uint64).tolist()
            for tile, home, value in zip(tiles, homes, values):
                if tile != key:
                    close()
                    if len(sets) > 100_000:
                        yield drain()
                    key, members = tile, []
                if home:
                    members.append(value)
                else:
                    waiting.append(value)
                    if len(waiting) >= TILE:
                        visit()
        close()
        yield drain()

    dealt = prints.select("fingerprint").mapInArrow(deal, "tile binary, home boolean, fingerprint long")
    together = dealt.repartition("tile").sortWithinPartitions("tile", F.col("home").desc())
    return together.mapInArrow(compare, "a long, b long")


def _join_near(some: np.ndarray, others: np.ndarray, radius: int, sets: LocalSets) -> None:
    """Join all pairs within the radius, comparing block by block."""
    for j in range(0, len(others), TILE):
        block = others[j : j + TILE]
        for k in range(0, len(some), 256):
            near = np.bitwise_count(some[k : k + 256, None] ^ block[None, :]) <= radius
            for x, y in zip(*(n.tolist() for n in np.nonzero(near))):
                if some[k + x] != block[y]:
                    sets.join(int(some[k + x]), int(block[y]))


def near_pairs(prints: DataFrame, radius: int, tables: int = TABLES) -> DataFrame:
    """Pairs ``a < b`` of different ids whose fingerprints differ in ``radius`` bits or fewer; for radii too wide for tiles.

    ``prints`` has ``id`` and ``fingerprint`` (longs, one row per id). Each table puts the bits in another fixed order
    and sorts by it; fingerprints with the same first bits are a bucket, and each is paired with the nearest of those
    up to ``WINDOW`` places before it, so that a bucket of any size costs no square. Every pair given is within the
    radius; pairs may be missed, the farther apart the likelier, so who needs all must look for the rest by other means.

    A second fingerprint in ``check`` drops pairs that differ in more than twice ``radius`` bits of both: at a wide radius
    the pairs that are near by chance grow much faster than the rows.
    """
    checked = ["check"] if "check" in prints.columns else []
    lead = max(0, prints.count().bit_length() - BUCKET.bit_length())
    orders = [np.random.default_rng(k).permutation(BITS) for k in range(tables)]

    def deal(batches):
        for batch in batches:
            bits = np.unpackbits(batch.column("fingerprint").to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)
            for k, order in enumerate(orders):
                place = np.frombuffer(np.packbits(bits[:, order], axis=1).tobytes(), ">u8").astype(np.uint64)
                bucket = (place >> np.uint64(BITS - lead) if lead else np.zeros_like(place)) * np.uint64(tables) + np.uint64(k)
                made = [pa.array(bucket.view(np.int64)), pa.array(place.view(np.int64)), *(batch.column(c) for c in ["id", *checked])]
                yield pa.RecordBatch.from_arrays(made, ["bucket", "place", "id", *checked])

    def compare(batches):
        held = [np.zeros(0, np.int64)] * (3 + len(checked))  # the last rows of the batch before
        for batch in batches:
            fresh = [batch.column(c).to_numpy() for c in ("bucket", "place", "id", *checked)]
            old = len(held[0])
            bucket, place, own, *check = both = [np.concatenate(pair) for pair in zip(held, fresh)]
            least, nearest = np.full(len(own), radius + 1), np.zeros(len(own), np.int64)
            for back in range(1, min(WINDOW, len(own) - 1) + 1):
                same = bucket[back:] == bucket[:-back]
                if not same.any():
                    break
                apart = np.where(same, np.bitwise_count((place[back:] ^ place[:-back]).view(np.uint64)), BITS)
                better = np.flatnonzero(apart < least[back:])
                least[back + better], nearest[back + better] = apart[better], better
            found = np.flatnonzero(least[old:] <= radius) + old
            for second in check:
                apart = np.bitwise_count((second[found] ^ second[nearest[found]]).view(np.uint64))
                found = found[least[found] + apart <= 2 * radius]
            a, b = own[found], own[nearest[found]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            held = [c[-WINDOW:] for c in both]

    schema = ", ".join(f"{name} long" for name in ("bucket", "place", "id", *checked))
    dealt = prints.select("id", "fingerprint", *checked).mapInArrow(deal, schema)
    together = dealt.repartition("bucket").sortWithinPartitions("bucket", "place", "id")
    return together.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprint (16 hexadecimal digits) and component of every document.

    Fingerprints of 3-word shingles are linked where they differ in ``radius`` bits or fewer; a component's id is the
    smallest ``doc_id`` reachable. Documents of one fingerprint are brought down to one row before any comparison, so
    copies cost nothing more, however many they are.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows stay and share their
    component. Rows with a null id take part and get the component's smallest id, null if no member has one. An empty
    table gives an empty result. Columns other than ``doc_id`` and ``text`` are ignored.
    """
    marked = written(fingerprints(documents))
    distinct = written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("low")))
    joined = smallest_reachable(distinct, written(links(distinct, radius)))
    wide = marked.join(joined, "fingerprint", "left")
    return wide.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
