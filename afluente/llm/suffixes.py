"""Removal of repeated byte strings: common prefixes from a Burrows-Wheeler transform, up to a least length."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afluente.llm.common import fresh_worker, slices, small_batches, spans, text_bytes
from afluente.session import removed_path, session_like, shared_folder, written

LENGTH = 50
GRAM = 12  # bytes of the anchor that decides where a string is compared, a multiple of four
BLOCK_BYTES = 3 << 20  # text bytes of a map-side block
BUCKET_BYTES = 8 << 20  # bytes of anchor hashes or of segments that a bucket should have
GROUP_BYTES = 1 << 18  # segment bytes that are sorted at once, in arrays that caches hold; about 70 times as much memory is used
TARGET_BYTES = 32 << 20  # text bytes of the documents whose runs one target puts together
PAIRS = 0.12  # pairs per text byte: anchors change about every (LENGTH - GRAM + 2) / 2 bytes, at either end
SEGMENT = 64  # bytes of a segment: its windows begin at about 15 places, the last brings LENGTH - 1 bytes more
BLOB_ROWS = 32  # rows of an Arrow batch where a row may hold a whole block
CHUNK = 1 << 15  # bytes whose anchors are found at once, in arrays that caches hold
SEED = 12  # symbols, at most, of the strings that the breadth-first extension begins with
WIDE = 1 << 13  # intervals above this are extended symbol by symbol, others element by element
NOBODY = -(2**63)


def _first_symbols(symbols: np.ndarray, count: int, bits: int) -> np.ndarray:
    """The first ``count`` symbols of every rotation as one number, joined by doubling."""
    if count == 1:
        return symbols.astype(np.int64)
    half = _first_symbols(symbols, count // 2, bits)
    key = half << bits * (count // 2) | np.roll(half, -(count // 2))
    return key << bits | np.roll(symbols, 1 - count) if count % 2 else key


def suffix_order(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rotations of ``symbols`` sorted by at least their first ``length`` symbols.

    Also, in that order, which rotations differ from the one before in their first few symbols, which of these do so in
    the last of the few alone, and how many the few are: as many as fit one number.
    """
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    few = known = min(63 // bits, SEED, length)
    key = _first_symbols(symbols, few, bits)
    order = np.argsort(key).astype(np.int32)  # ties get one rank, whatever their order
    ordered = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    ordered >>= bits
    late = fresh.copy()
    late[:1], late[1:] = False, fresh[1:] & (ordered[1:] == ordered[:-1])
    changes = fresh
    width = n.bit_length()
    ranks = 63 // width  # that fit one number
    while known < length:
        tied = ~changes
        tied[:-1] |= ~changes[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            break
        first = np.flatnonzero(changes).astype(np.int32)
        rank = np.empty(n, np.int32)
        rank[order] = np.repeat(first, np.diff(first, append=n))
        # Only members of groups above one are sorted again, by what follows them.
        some = order[places]
        again = rank[some].astype(np.int64)
        taken = 1
        while taken < ranks and known * taken < length:
            after = some + np.int32(known * taken % n)
            after[after >= n] -= n
            again = again << width | rank[after]
            taken += 1
        turn = np.argsort(again)
        order[places] = some[turn]
        known *= taken
        if known < length:
            again = again[turn]
            changes = changes.copy()
            changes[places[1:]] |= again[1:] != again[:-1]
    return order, fresh, late, few


def prefix_bounds(symbols: np.ndarray, order: np.ndarray, fresh: np.ndarray, late: np.ndarray, few: int, length: int) -> np.ndarray:
    """Where, in sorted order, the common prefix with the rotation before is shorter than ``length``.

    Breadth first on the transform: all intervals of strings of one length are extended backward by one symbol at
    once. The end of an interval of a string of length l + 1 has a common prefix of l unless it was found before, so
    values come in increasing order and the search ends below ``length``; what is left has at least that much. The
    search begins at the strings of ``few`` symbols, whose intervals the order has shown.
    """
    n = len(symbols)
    bwt = symbols[order - 1]
    back = np.argsort(bwt, kind="stable").astype(np.int32)  # the k-th rotation in order extends the rotation at back[k]
    forward = np.empty(n, np.int32)
    forward[back] = np.arange(n, dtype=np.int32)
    counts = np.bincount(bwt)
    starts = np.cumsum(counts) - counts
    sorted_symbols = bwt[back]
    before, after = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    same = sorted_symbols[1:] == sorted_symbols[:-1]
    ahead, behind = back[:-1][same], back[1:][same]
    before[behind], after[ahead] = ahead, behind
    found = np.empty(n + 1, bool)
    found[:n], found[n] = fresh, True
    edges = np.flatnonzero(found).astype(np.int32)
    chosen = np.append(late[edges[1:-1]], False)  # the end differs in the last symbol alone
    lows, highs = edges[:-1][chosen], edges[1:][chosen]
    for _ in range(few, length):
        if not len(lows):
            break
        sizes = highs - lows
        wide = sizes > WIDE
        some = wide.any()
        new_lows, new_highs = [], []
        for symbol in np.flatnonzero(counts) if some else ():
            own = back[starts[symbol] : starts[symbol] + counts[symbol]]
            a, b = np.searchsorted(own, lows[wide]), np.searchsorted(own, highs[wide])
            new_lows.append((starts[symbol] + a[b > a]).astype(np.int32))
            new_highs.append((starts[symbol] + b[b > a]).astype(np.int32))
        if some:
            lows, highs, sizes = lows[~wide], highs[~wide], sizes[~wide]
        if len(lows):
            ends = np.cumsum(sizes, dtype=np.int32)
            own_low, own_high = np.repeat(lows, sizes), np.repeat(highs, sizes)
            places = np.repeat(lows - (ends - sizes), sizes)
            places += np.arange(len(places), dtype=np.int32)
            first = before[places] < own_low
            last = after[places] >= own_high
            # In order of what they lead to, first and last elements of the same interval and symbol stand side by side.
            new_lows.append(np.sort(forward[places[first]]))
            new_highs.append(np.sort(forward[places[last]]) + np.int32(1))
        lows, highs = (np.concatenate(new_lows), np.concatenate(new_highs)) if some else (new_lows[0], new_highs[0])
        open_ends = ~found[highs]
        lows, highs = lows[open_ends], highs[open_ends]
        found[highs] = True
        if some:
            turn = np.argsort(lows)
            lows, highs = lows[turn], highs[turn]
    return found[:n]


def repeated_windows(data: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For every byte of the joined segments: whether the string of ``length`` bytes from there, within its segment,
    also starts in a segment of a smaller document."""
    out = np.zeros(len(data), bool)
    within = np.maximum(sizes - length + 1, 0)  # windows of each segment
    if not within.any():
        return out
    # The bytes that there are, numbered from one without gaps; zero ends a segment.
    there = np.bincount(data, minlength=256) > 0
    numbers = np.cumsum(there).astype(np.uint8 if there.sum() < 256 else np.uint16)
    starts = np.cumsum(sizes) - sizes
    symbols = np.zeros(len(data) + len(sizes), numbers.dtype)
    place = np.ones(len(symbols), bool)
    place[np.cumsum(sizes) + np.arange(len(sizes))] = False
    symbols[place] = numbers[data]
    order, *start = suffix_order(symbols, length)
    bounds = prefix_bounds(symbols, order, *start, length)
    group = np.empty(len(symbols), np.int32)
    group[order] = np.cumsum(bounds, dtype=np.int32)
    windows = np.repeat(np.arange(len(sizes)), within)  # the segment of each
    at = spans(starts, within)
    group = group[at + windows]
    least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, docs[windows])
    out[at] = least[group] < docs[windows]
    return out


def _extremes(keys: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest of every ``reach`` neighbours, by doubling."""
    out = []
    for choose in (np.minimum, np.maximum):
        found, width = keys, 1
        while width * 2 <= reach:
            found = choose(found[:-width], found[width:])
            width *= 2
        if width < reach:
            found = choose(found[: len(found) - (reach - width)], found[reach - width :])
        out.append(found)
    return out[0], out[1]


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of ``length`` bytes the place of its anchor and its pair, and the hash of the gram at every place.

    The anchor is the gram of the least hash. The pair is a hash of the grams of least and of greatest hash and of how far
    apart they are. Of grams with equal hashes the one at the side that the window's bytes alone decide is taken, so equal
    windows have equal anchors and equal pairs.
    """
    n = len(data) - GRAM + 1
    if n < length - GRAM + 1:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    windows = len(data) - length + 1
    low, pair, hashed = np.empty(windows, np.int32), np.empty(windows, np.uint64), np.empty(n, np.uint64)
    for start in range(0, windows, CHUNK):  # the arrays of all steps are small, whatever the size of the data
        stop = min(start + CHUNK, windows)
        at, found, grams = _anchors(data[start : stop + length - 1], length)
        low[start:stop], pair[start:stop], hashed[start : start + len(grams)] = at, found, grams
        low[start:stop] += start
    return low, pair, hashed


def _anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) - GRAM + 1
    one = data.astype(np.uint64)
    two = one[:-1] * np.uint64(257) + one[1:]
    four = two[:-2] * np.uint64(66_067) + two[2:]
    hashed = four[:n].copy()
    for k in range(4, GRAM, 4):
        hashed *= np.uint64(0x100000001B3)
        hashed += four[k : k + n]
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    hashed ^= hashed >> np.uint64(32)
    # First bits of the hash, the same number of them everywhere, and the place share 32 bits.
    mask = np.uint32((1 << (CHUNK + length).bit_length()) - 1)
    low, high = _extremes((hashed >> np.uint64(32)).astype(np.uint32) & ~mask | np.arange(n, dtype=np.uint32), length - GRAM + 1)
    low, high = (low & mask).astype(np.int32), (high & mask).astype(np.int32)
    change = np.ones(len(low), bool)
    change[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    heads = np.flatnonzero(change)
    a, b = low[heads], high[heads]
    pair = (hashed[a] ^ hashed[b] * np.uint64(0x9E3779B97F4A7C15)) + (b - a).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    pair = (pair ^ pair >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    pair ^= pair >> np.uint64(29)
    return low, np.repeat(pair, np.diff(heads, append=len(low))), hashed


def _segments(wanted: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run of wanted windows with one anchor."""
    if not len(wanted):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.ones(len(wanted) + 1, bool)
    change[1:-1] = (anchor[1:] != anchor[:-1]) | (wanted[1:] != wanted[:-1])
    edges = np.flatnonzero(change)
    first, last = edges[:-1], edges[1:] - 1
    keep = wanted[first]
    return first[keep], last[keep]


def _groups(keys: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The segments in groups of about GROUP_BYTES; equal keys stay together, and no string has two keys."""
    count = -(-int(sizes.sum()) // GROUP_BYTES)
    group = (keys >> np.uint64(20)) % np.uint64(max(1, count))
    return [np.flatnonzero(group == k) for k in range(count)]


def _equal_segments(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For every segment a number that segments of the same bytes share."""
    within = spans(np.zeros(len(sizes), np.int64), sizes)
    weights = np.arange(1, int(sizes.max()) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    weights = (weights ^ weights >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
    places, heads = spans(starts, sizes), np.cumsum(sizes) - sizes
    digest = np.add.reduceat((data[places].astype(np.uint64) + np.uint64(1)) * weights[within], heads)
    order = np.lexsort((digest, sizes))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (digest[order][1:] != digest[order][:-1]) | (sizes[order][1:] != sizes[order][:-1])
    leader = np.empty(len(order), np.int64)
    leader[order] = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    # Equal digests are no proof: a segment that differs from its leader stays on its own.
    same = np.logical_and.reduceat(data[places] == data[np.repeat(starts[leader], sizes) + within], heads)
    return np.where(same, leader, np.arange(len(order)))


def _marks(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """Places in ``data`` of the windows of the segments that ``repeated_windows`` finds.

    Of segments of the same bytes, one of the smallest document and one of the next go to the transform. Any further
    one has the windows of these two, and so what is found for the one of its rank holds for it.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    kind = _equal_segments(data, starts, sizes)
    order = np.lexsort((docs, kind))
    new_kind = np.diff(kind[order], prepend=-1) != 0
    least = docs[order][np.flatnonzero(new_kind)[np.cumsum(new_kind) - 1]]
    later = docs[order] != least
    chosen = new_kind | np.concatenate([[False], later[1:] & ~later[:-1]]) & ~new_kind
    sample = np.empty(len(order), np.int64)  # which chosen segment stands for this one
    sample[order] = np.cumsum(chosen) - 1
    few = order[chosen]
    found = repeated_windows(data[spans(starts[few], sizes[few])], sizes[few], docs[few], length)
    heads = np.cumsum(sizes[few]) - sizes[few]
    return spans(starts, sizes)[found[spans(heads[sample], sizes)]]


def _in_several(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which rows have a key that rows of another document have too."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys)
    ordered, docs = keys[order], docs[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    low, high = np.minimum.reduceat(docs, heads), np.maximum.reduceat(docs, heads)
    out = np.empty(len(keys), bool)
    out[order] = np.repeat(low != high, np.diff(np.append(heads, len(keys))))
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [zstandard.ZstdCompressor(level=1).compress(a.tobytes()) for a in arrays]
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def _unpack(blob: bytes, kinds: list[str], which: range | list[int]) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(kinds))
    ends = 8 * len(kinds) + np.cumsum(sizes)
    expand = zstandard.ZstdDecompressor()
    return [np.frombuffer(expand.decompress(blob[ends[k] - sizes[k] : ends[k]]), kinds[k]) for k in which]


_KINDS = ["<u8", "<i8", "<i8", "<i8", "<i4", "u1"]  # anchor hash, document, tag, first byte, bytes, all bytes
_NAMES = ["bucket", "target", "blob"]


def _rows(bucket: list, target: list, blob: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(target, pa.int32()), pa.array(blob, pa.binary())], _NAMES)


def _mark_rows(docs: np.ndarray, tags: np.ndarray, places: np.ndarray, buckets: int, targets: int, length: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows as runs, those of many documents in one row per target; a target holds some of the documents."""
    order = np.lexsort((places, tags, docs))
    docs, tags, places = docs[order], tags[order], places[order]
    fresh = np.ones(len(docs), bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1]) | (np.diff(places) > length)  # windows that touch are one run
    heads = np.flatnonzero(fresh)
    if not len(heads):
        return
    ends = places[np.append(heads[1:], len(docs)) - 1] + length
    docs, tags, firsts = docs[heads], tags[heads], places[heads]
    mixed = (docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ tags.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    parts = _by_bucket(mixed >> np.uint64(33), targets)
    blobs = [_pack(docs[own], tags[own], firsts[own], ends[own]) for _, own in parts]
    yield _rows([k % buckets for k, _ in parts], [k for k, _ in parts], blobs)


def _merged_runs(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """One row of runs for each document of a target, runs that touch or overlap put together."""
    held = [_unpack(b, ["<i8"] * 4, range(4)) for b in blobs]
    docs, tags, firsts, ends = (np.concatenate([h[k] for h in held]) for k in range(4))
    order = np.lexsort((firsts, tags, docs))
    docs, tags, firsts, ends = docs[order], tags[order], firsts[order], ends[order]
    own = np.ones(len(docs), bool)
    own[1:] = (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])
    # one scale for all documents: each begins beyond the last end of the one before
    reach = (np.cumsum(own) - 1) * (int(ends.max()) + 1)
    furthest = np.maximum.accumulate(ends + reach)
    fresh = own.copy()
    fresh[1:] |= (firsts + reach)[1:] > furthest[:-1]
    heads = np.flatnonzero(fresh)
    last = np.append(heads[1:], len(docs)) - 1
    runs = np.stack([firsts[heads], furthest[last] - reach[last]], axis=1)
    owners = np.flatnonzero(own[heads])
    for start in range(0, len(owners), 4096):
        part = owners[start : start + 4096]
        stops = np.append(owners, len(heads))[start + 1 : start + 1 + len(part)]
        kept = [runs[a:b].astype("<i8").tobytes() for a, b in zip(part, stops)]
        yield _batch(doc=(docs[heads[part]], pa.int64()), tag=(tags[heads[part]], pa.int64()), runs=(kept, pa.binary()))


_BLOCK_KINDS = ["<i8", "<i8", "<i8", "u1"]  # documents, tags, bounds, all bytes


def _batch(**columns: tuple[list, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in columns.values()], list(columns))


def _blocks(rows: DataFrame) -> tuple[DataFrame, str]:
    """``block`` (a name) and ``blob``: documents joined to blocks of about BLOCK_BYTES, saved so that names hold.

    A row may be as large as a block, so the table is read in a session of few rows to an Arrow batch.
    """
    spark = rows.sparkSession

    def join(batches):
        fresh_worker()
        held, size = [], 0
        for batch in slices(batches, limit=BLOCK_BYTES):
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= BLOCK_BYTES:
                yield joined(held)
                held, size = [], 0
        if held:
            yield joined(held)

    def joined(held):
        data, bounds = text_bytes(pa.concat_arrays([b.column("text").cast(pa.large_string()) for b in held]))
        docs, tags = (np.concatenate([b.column(c).to_numpy() for b in held]).astype("<i8") for c in ("doc", "tag"))
        return _batch(block=([uuid.uuid4().hex], pa.string()), blob=([_pack(docs, tags, bounds, data)], pa.binary()))

    path = shared_folder(spark)
    rows.select("doc", "tag", "text").mapInArrow(join, "block string, blob binary").write.parquet(path)
    lean = session_like(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BLOB_ROWS)})
    return lean.read.schema("block string, blob binary").parquet(path), path


def _cut(bounds: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors, pairs and hashes of a block, the document each window starts in, and whether the window ends in it too."""
    anchor, pair, hashed = anchors(data, length)
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))[: len(anchor)]
    inside = np.ones(len(anchor), bool)
    tails = np.maximum(bounds[1:] - length + 1, bounds[:-1])  # windows that begin here end beyond the document
    inside[spans(tails, np.minimum(bounds[1:], len(anchor)) - np.minimum(tails, len(anchor)))] = False
    return anchor, pair, hashed, owner, inside


def _codes(pairs: np.ndarray, buckets: int) -> np.ndarray:
    """Pairs as they travel: the bucket they meet in and 32 bits of theirs. Chance hits cost time, never results."""
    return (pairs % np.uint64(buckets)) << np.uint64(32) | pairs >> np.uint64(32)


def _by_bucket(keys: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """The buckets that keys belong to, and where in ``keys`` those of each are."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    heads = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    return [(int(bucket[order[a]]), order[a:b]) for a, b in zip(heads, np.append(heads[1:], len(order)))]


def _shared_pairs(blocks: DataFrame, buckets: int, length: int) -> DataFrame:
    """``block``, ``bucket`` and ``keys``: the pairs of its windows that another block has too, in pieces. A block names
    each of its pairs once, however often it has it, and only four bytes of a pair travel."""

    def listed(batches):
        fresh_worker()
        for batch in batches:
            for name, blob in zip(batch.column("block").to_pylist(), batch.column("blob").to_pylist()):
                bounds, data = _unpack(blob, _BLOCK_KINDS, [2, 3])
                _, pair, _, _, inside = _cut(bounds, data, length)
                codes = np.sort(_codes(pair[_segments(inside, pair)[0]], buckets))
                codes = codes[np.diff(codes, prepend=~codes[:1]) != 0]
                parts = _by_bucket(codes >> np.uint64(32), buckets)
                yield _batch(
                    bucket=([k for k, _ in parts], pa.int32()),
                    block=([name] * len(parts), pa.string()),
                    keys=([codes[own].astype("<u4").tobytes() for _, own in parts], pa.binary()),
                )

    def matched(batches):
        fresh_worker()
        current, held = None, []
        for batch in batches:
            for bucket, block, keys in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "keys"))):
                if bucket != current:
                    yield from found(current, held)
                    current, held = bucket, []
                held.append((block, np.frombuffer(keys, "<u4")))
        yield from found(current, held)

    def found(bucket, held):
        if len(held) < 2:
            return
        ordered = np.sort(np.concatenate([keys for _, keys in held]))
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return
        for block, keys in held:
            both = keys[_among(keys, twice)]
            if len(both):
                yield _batch(block=([block], pa.string()), bucket=([bucket], pa.int32()), keys=([both.tobytes()], pa.binary()))

    sent = blocks.mapInArrow(listed, "bucket int, block string, keys binary")
    met = sent.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    return met.mapInArrow(matched, "block string, bucket int, keys binary")


def _among(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted ones."""
    if not len(ordered):
        return np.zeros(len(keys), bool)
    return ordered[np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)] == keys


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc``, ``tag`` and ``runs`` (pairs of first byte and end) of what repeats, for the rows of ``_tagged``.

    1. Documents are joined to blocks, which are saved. Every window of ``length`` bytes has an anchor and a pair of
       grams that depend on its bytes alone, so strings can only be equal where these are. Blocks exchange the hashes
       of their pairs and learn which of them another block has too.
    2. Within a block the transform finds strings that an earlier document of the block has, among the windows whose
       pair another document of the block has.
    3. The other windows whose pair another block has, cut where the anchor changes, go to the bucket of the anchor's
       hash; equal strings meet there. Each block sends a string once, so a passage that a third of all documents share
       arrives once per block. In a bucket the transform finds the rest.
    4. What is found goes to targets, each of which puts the runs of its documents together.
    """
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, blocks_path = _blocks(rows)
    listing = max(4, -(-int(total * PAIRS * 4) // BUCKET_BYTES))
    shared_path = shared_folder(rows.sparkSession)
    _shared_pairs(blocks, listing, length).write.parquet(shared_path)
    shared = rows.sparkSession.read.schema("block string, bucket int, keys binary").parquet(shared_path)
    sent_bytes = (shared.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 4 * SEGMENT
    buckets = max(8, -(-sent_bytes // BUCKET_BYTES))
    targets = max(8, -(-int(total) // TARGET_BYTES))

    def by_blocks(batches):
        fresh_worker()
        for batch in batches:
            for blob, lists in zip(batch.column("blob").to_pylist(), batch.column("lists").to_pylist()):
                docs, tags, bounds, data = _unpack(blob, _BLOCK_KINDS, range(4))
                codes = [np.uint64(e["bucket"]) << np.uint64(32) | np.frombuffer(e["keys"], "<u4").astype(np.uint64) for e in lists or ()]
                elsewhere = np.sort(np.concatenate(codes)) if codes else np.zeros(0, np.uint64)
                yield from block(data, bounds, docs, tags, elsewhere)

    def block(data, bounds, docs, tags, elsewhere):
        anchor, pair, hashed, owner, inside = _cut(bounds, data, length)
        # A segment never spans two documents: no window inside a document reaches the next one.
        first, last = _segments(inside, pair)
        codes = _codes(pair[first], listing)
        several, away = _in_several(codes, docs[owner[first]]), _among(codes, elsewhere)

        def windows(which):
            out = np.zeros(len(anchor), bool)
            out[spans(first[which], last[which] - first[which] + 1)] = True
            return out

        head, end = _segments(windows(several), anchor)
        gone = np.zeros(len(anchor), bool)
        for own in _groups(hashed[anchor[head]], end - head + length):
            gone[_marks(data, head[own], end[own] - head[own] + length, docs[owner[head[own]]], length)] = True
        marked = np.flatnonzero(gone)
        home = owner[marked]
        yield from _mark_rows(docs[home], tags[home], marked - bounds[:-1][home], buckets, targets, length)
        head, end = _segments(windows(away) & ~gone, anchor)
        if not len(head):
            return
        keys, here, sizes = hashed[anchor[head]], owner[head], end - head + length
        numbers, blobs = [], []
        for bucket, own in _by_bucket(keys, buckets):
            there = bounds[:-1][here[own]]
            blobs.append(_pack(keys[own], docs[here[own]], tags[here[own]], (head[own] - there).astype(np.int64), sizes[own].astype(np.int32), data[spans(head[own], sizes[own])]))
            numbers.append(bucket)
        yield _rows(numbers, [None] * len(blobs), blobs)

    def by_bucket(batches):
        fresh_worker()
        current, blobs = None, []
        for batch in batches:
            for bucket, target, blob in zip(*(batch.column(c).to_pylist() for c in _NAMES)):
                if target is not None:
                    yield _rows([bucket], [target], [blob])  # found within a block
                    continue
                if bucket != current:
                    yield from compare(blobs)
                    current, blobs = bucket, []
                blobs.append(blob)
        yield from compare(blobs)

    def compare(blobs):
        if not blobs:
            return
        heads = [_unpack(b, _KINDS, range(5)) for b in blobs]
        counts = np.cumsum([0] + [len(h[0]) for h in heads])
        keys, docs, tags, firsts, sizes = (np.concatenate([h[k] for h in heads]) for k in range(5))
        chosen = _in_several(keys, docs)
        if not chosen.any():
            return
        data = []
        for k, blob in enumerate(blobs):
            own = chosen[counts[k] : counts[k + 1]]
            if own.any():
                lengths = heads[k][4].astype(np.int64)
                data.append(_unpack(blob, _KINDS, [5])[0][spans((np.cumsum(lengths) - lengths)[own], lengths[own])])
        keys, docs, tags, firsts, sizes = keys[chosen], docs[chosen], tags[chosen], firsts[chosen], sizes[chosen].astype(np.int64)
        data, starts = np.concatenate(data), np.cumsum(sizes) - sizes
        marked = [_marks(data, starts[own], sizes[own], docs[own], length) for own in _groups(keys, sizes)]
        marked = np.concatenate(marked)
        home = np.searchsorted(starts, marked, side="right") - 1
        yield from _mark_rows(docs[home], tags[home], firsts[home] + marked - starts[home], buckets, targets, length)

    def by_target(batches):
        fresh_worker()
        current, blobs = None, []
        for batch in batches:
            for target, blob in zip(batch.column("target").to_pylist(), batch.column("blob").to_pylist()):
                if target != current and blobs:
                    yield from _merged_runs(blobs)
                    blobs = []
                current = target
                blobs.append(blob)
        if blobs:
            yield from _merged_runs(blobs)

    pieces = max(4, -(-int(total) // (4 * BLOCK_BYTES)))  # some blocks to a task, whatever the cluster's settings
    lists = shared.groupBy("block").agg(F.collect_list(F.struct("bucket", "keys")).alias("lists"))
    known = blocks.repartition(pieces, "block").join(lists, "block", "left")
    sent = known.select("blob", "lists").mapInArrow(by_blocks, "bucket int, target int, blob binary")
    met = sent.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    found = met.mapInArrow(by_bucket, "bucket int, target int, blob binary").select("target", "blob")
    dealt = found.repartitionById(targets, F.col("target")).sortWithinPartitions("target")
    out = written(dealt.mapInArrow(by_target, "doc long, tag long, runs binary"))
    for path in (blocks_path, shared_path):
        removed_path(rows.sparkSession, path)
    return out


def _tagged(documents: DataFrame) -> DataFrame:
    text = F.coalesce(documents["text"].cast("string"), F.lit(""))
    rows = documents.select(F.coalesce(documents["doc_id"].cast("long"), F.lit(NOBODY)).alias("doc"), text.alias("text"))
    return rows.withColumn("tag", F.xxhash64("text"))


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the remaining bytes) of every document.

    Texts are UTF-8 bytes. A byte goes if a string of ``length`` bytes over it also starts in a document with a
    smaller ``doc_id``; strings lie within one document and are judged on the input. ``n_spans`` counts maximal
    removed runs.

    Null texts are empty; texts below ``length`` bytes stay. Rows without an id are one document before all others.
    Repeated rows of an id take nothing from each other. An empty table gives an empty result. Columns other than
    ``doc_id`` and ``text`` are ignored.
    """
    small_batches(documents.sparkSession)
    rows = _tagged(documents)
    runs = repeated_spans(rows, length).groupBy("doc", "tag").agg(F.collect_list("runs").alias("runs"))
    wide = rows.join(runs, ["doc", "tag"], "left").select("doc", "text", "runs")

    def cut(batches):
        for batch in slices(batches):
            out = []
            for text, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist()):
                pairs = np.frombuffer(b"".join(runs or ()), "<i8").reshape(-1, 2)
                step = np.zeros(len(text) + 1, np.int64)
                np.add.at(step, pairs[:, 0], 1)
                np.add.at(step, pairs[:, 1], -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if len(pairs) else text
                out.append((len(text), len(text) - len(kept), int((np.diff(gone, prepend=False) & gone).sum()), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            made = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *made], ["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    done = wide.mapInArrow(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.select(F.nullif("doc", F.lit(NOBODY)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
