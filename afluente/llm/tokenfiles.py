"""Token ids in files: one compressed frame per document, a shared dictionary, an index of offsets."""

from __future__ import annotations

import functools
import gc
import hashlib
import os
import struct
import uuid
import zlib
from dataclasses import dataclass
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from afluente.llm.common import fresh_worker, id_bounds, in_id_order, partitions_of, slices, small_batches, text_bytes, texts_of
from afluente.llm.words import ArrowChunkIds
from afluente.session import shared_folder, written

MAGIC = b"TIDF0001"
HEAD = "<8s32sB7x"  # magic, hash of the dictionary, bytes of an id
TAIL = "<QQ8s"  # where the index starts, documents, magic
ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u8"), ("n_ids", "<u8"), ("named", "u1")])
FILE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCUMENTS = 2000  # documents, and the characters of each, that the dictionary is trained on
SAMPLE_CHARS = 8000
LEVEL = 3
PLAIN = 0x250  # code points that words of plain signs are made of are below this
LINE_END, WORD_END = 4, 5
BLOCK_WORDS = 4096  # new words that go to the model at once
NO_SINGLE_BLANKS = (
    r"[ \n][ \n]|\A[ \n]|[ \n]\z|\A\z"
    r"|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def _kind(sign: str) -> int:
    """What the pattern takes a plain sign for: letter, digit or another sign. 0: left to the library."""
    if sign in "\n\t":
        return LINE_END if sign == "\n" else WORD_END
    if sign.isalpha():
        return 1
    if not "!" <= sign <= "~" or sign == "'":
        return 0
    return 2 if sign.isdigit() else 3


class ByteEncoder:
    """Ids by a byte-level vocabulary of the tokenizers library, recurring words looked up.

    The vocabulary's pattern always starts a new part at a single space or line end between signs that are no blanks,
    so a text may be encoded word by word. Texts with other blanks go to the library as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.line_end = self._all(["\n"])[0]
        # The signs that stand for bytes in the vocabulary: printable ones for themselves, others from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.signs = {b: chr(256 + k) for k, b in enumerate(rest)}
        self.sign_of = np.array([ord(self.signs.get(b, chr(b))) for b in range(256)], "<u2")
        self.sign_of[9] = 10  # a tab parts what the model takes; no sign is a line end
        self.kinds = np.array([_kind(chr(c)) for c in range(PLAIN)] + [0], np.uint8)
        if any(not t.special for t in self.library.get_added_tokens_decoder().values()):
            self.kinds[:] = 0  # such tokens are found inside words, by the library alone
        # The library's model without its pattern, for parts that are cut already.
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = CharDelimiterSplit("\n")
        vocabulary = self.library.get_vocab()
        self.first = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # tokens that a word begins with
        self.first[[k for t, k in vocabulary.items() if t[:1] == self.signs[32]] + self.line_end] = True
        self.table = ArrowChunkIds(self._words)

    def _all(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has. Words follow a space, or their own line end."""
        blocks = [self._block(words[k : k + BLOCK_WORDS]) for k in range(0, len(words), BLOCK_WORDS)]
        return np.concatenate([ids for ids, _ in blocks]), np.concatenate([sizes for _, sizes in blocks])

    def _block(self, words: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = _tabbed(words) if isinstance(words, pa.Array) else "\t".join(words) + "\t"
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kinds = self.kinds[np.minimum(codes, PLAIN)]
        lengths = np.diff(np.flatnonzero(codes == 9), prepend=-1)
        plain = np.logical_and.reduceat(kinds > 0, np.cumsum(lengths) - lengths)
        ids = self._plain(codes, kinds, np.repeat(plain, lengths)) if plain.any() else np.zeros(0, np.int32)
        heads = np.flatnonzero(self.first[ids])
        if len(heads) != np.count_nonzero(plain):  # signs that the vocabulary lacks
            plain[:], ids, heads = False, ids[:0], heads[:0]
        sizes = np.empty(len(words), np.int64)
        sizes[plain] = np.diff(heads, append=len(ids))
        if plain.all():
            return ids, sizes
        others = list(compress(joined.split("\t"), ~plain))
        found = self._all([w if w[:1] == "\n" else " " + w for w in others])
        sizes[~plain] = list(map(len, found))
        own, flat = np.repeat(plain, sizes), np.empty(int(sizes.sum()), np.int32)
        flat[own], flat[~own] = ids, np.fromiter(chain.from_iterable(found), np.int32)
        return flat, sizes

    def _plain(self, codes: np.ndarray, kinds: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """Ids of words of plain signs. The pattern cuts these where the kind of sign changes, so the model can take the
        parts at once."""
        codes, kinds = codes[kept], kinds[kept]
        new = np.ones(len(codes), bool)
        new[1:] = kinds[:-1] == WORD_END
        more = new & (kinds != LINE_END)  # a space before a word
        more[1:] |= (kinds[1:] != kinds[:-1]) & (kinds[1:] != WORD_END) & ~new[1:]  # a tab between parts
        at = np.arange(len(codes)) + np.cumsum(more)
        text = np.empty(int(at[-1]) + 1, "<u4")
        text[at] = codes
        text[at[more] - 1] = np.where(new[more], 32, 9)
        parts = np.frombuffer(text[:-1].tobytes().decode("utf-32-le").encode(), np.uint8)
        signs = self.sign_of[parts].tobytes().decode("utf-16-le")
        return np.array(self.model.encode_batch_fast([signs], add_special_tokens=False)[0].ids, np.int32)

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        whole = as_one(texts)
        lined = pc.replace_substring(texts.filter(pa.array(~whole)), "\n", " \n")
        parts = pc.split_pattern(pc.binary_join_element_wise("\n", lined, ""), " ")  # the line end before a text is taken off
        numbers = self.table.numbers(parts.flatten())
        flat = self.table.ids(numbers)
        ends = np.concatenate([[0], np.cumsum(self.table.lengths[numbers])])
        bounds = parts.offsets.to_numpy()
        pairs = zip(ends[bounds[:-1]].tolist(), ends[bounds[1:]].tolist())
        others = iter(self._all(texts.filter(pa.array(whole)).to_pylist()))
        skipped, out = len(self.line_end), []
        for alone in whole.tolist():
            if alone:
                out.append(np.array(next(others), np.int32))
            else:
                start, end = next(pairs)
                out.append(flat[start + skipped : end])
        return out


def as_one(texts: pa.Array) -> np.ndarray:
    """Which texts are empty or have blanks other than single spaces and line ends between signs."""
    return pc.match_substring_regex(texts, NO_SINGLE_BLANKS).to_numpy(zero_copy_only=False)


def _tabbed(words: pa.Array) -> str:
    """The words with a tab after each."""
    data, bounds = text_bytes(words)
    out = np.full(len(data) + len(words), 9, np.uint8)
    place = np.ones(len(out), bool)
    place[bounds[1:] + np.arange(len(words))] = False
    out[place] = data
    return out.tobytes().decode()


def worker_encoder(path: str) -> ByteEncoder:
    """The encoder that this Python worker keeps from task to task, with the words it knows; a bounded table."""
    found = os.stat(path)
    return _encoder(path, found.st_mtime_ns, found.st_size)


@functools.lru_cache(maxsize=1)
def _encoder(path: str, *version: int) -> ByteEncoder:
    return ByteEncoder(path)


def fitted(ids: np.ndarray, width: int) -> np.ndarray:
    """The ids in ``width`` bytes each; one that does not fit is an error."""
    if len(ids) and (ids.min() < 0 or int(ids.max()) >> 8 * width):
        raise ValueError(f"id {ids.max()} does not fit {width} bytes")
    return ids.astype(f"<u{width}")


def train_dictionary(documents: DataFrame, tokenizer: str, width: int, sample: int = SAMPLE_DOCUMENTS) -> bytes:
    """A dictionary from a bounded sample: the ``sample`` documents of the smallest hashed ids, the start of each.

    It bears on the size of the files alone, never on what they hold. Tables too small to train on use the sampled ids
    themselves.
    """
    texts = texts_of(documents)
    ids = texts.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).dropna().distinct().collect()
    few = F.broadcast(documents.sparkSession.createDataFrame([tuple(i) for i in ids], "doc_id long"))  # sample rows at most
    rows = texts.join(few, "doc_id").select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).limit(sample).collect()
    samples = [fitted(ids, width).tobytes() for ids in ByteEncoder(tokenizer).encode([r["text"] for r in rows])]
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


@dataclass
class TokenFiles:
    """Written files: ``manifest`` has one row per file, in the order of the documents."""

    spark: SparkSession
    folder: str
    manifest: DataFrame
    dictionary: bytes


def write_token_files(documents: DataFrame, tokenizer: str, end_id: int | None, folder: str | None = None, width: int = 2) -> TokenFiles:
    """Encode every whole text, append ``end_id`` and write the ids in ascending order of ``doc_id``.

    A file holds a head (magic, hash of the dictionary, bytes per id), one zstandard frame per document, an index of
    ids, offsets and counts, and a tail. Documents are compressed where they are encoded, dealt out by id ranges and
    sorted. Files have names of their own, and only those of tasks that succeeded are in the manifest, so that
    repeated tasks do no harm. Null texts are empty; null ids come first; repeated rows are all written, ordered by
    their frames. Ids that ``width`` bytes cannot hold are an error. An empty table writes no file. Other columns than ``doc_id`` and ``text`` are ignored.
    """
    spark = documents.sparkSession
    small_batches(spark)
    folder = folder or shared_folder(spark)
    raw = train_dictionary(documents, tokenizer, width)
    label = hashlib.sha256(raw).digest()
    store, place = _store(folder)
    store.create_dir(place, recursive=True)
    with store.open_output_stream(f"{place}/dictionary-{label.hex()}") as out:
        out.write(raw)
    ending = np.array([] if end_id is None else [end_id], np.int32)

    def squeezed(batches):
        fresh_worker()
        squeeze = None
        for batch in slices(batches, limit=2 << 20):
            squeeze = squeeze or zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
            gc.disable()  # the lists of a slice hold no cycles, and looking through them takes a sixth of the time
            try:
                ids = worker_encoder(tokenizer).encode(batch.column("text"))
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) + len(ending)
                data = memoryview(fitted(np.concatenate([i for own in ids for i in (own, ending)]), width).tobytes())
                ends = (np.cumsum(sizes) * width).tolist()
                frames = [squeeze.compress(data[a:b]) for a, b in zip([0, *ends], ends)]
            finally:
                gc.enable()
            made = [batch.column("doc_id"), pa.array(sizes), pa.array(frames, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_ids", "frame"])

    rows = texts_of(documents)
    bounds = id_bounds(rows.select("doc_id"), partitions_of(spark))
    ordered = in_id_order(rows, bounds, made=squeezed, schema="doc_id long, n_ids long, frame binary")

    def write(batches):
        fresh_worker()
        store, place = _store(folder)
        number, held = 0, _File(label, width)
        for batch in batches:
            parts = batch.column("part").to_pylist()
            for part, doc, n_ids, frame in zip(parts, *(batch.column(c).to_pylist() for c in ("doc_id", "n_ids", "frame"))):
                held.add(doc, n_ids, frame)
                if held.size >= FILE_BYTES:
                    yield held.save(store, place, part, number)
                    number, held = number + 1, _File(label, width)
        if held.entries:
            yield held.save(store, place, part, number)

    manifest = written(ordered.mapInArrow(write, "part int, number int, path string, n_docs long, n_ids long, n_bytes long"))
    return TokenFiles(spark, folder, manifest, raw)


class _File:
    def __init__(self, label: bytes, width: int) -> None:
        self.blocks = [struct.pack(HEAD, MAGIC, label, width)]
        self.size = struct.calcsize(HEAD)
        self.entries: list[tuple] = []

    def add(self, doc: int | None, n_ids: int, frame: bytes) -> None:
        self.entries.append((doc or 0, self.size, len(frame), n_ids, doc is not None))
        self.blocks.append(frame)
        self.size += len(frame)

    def save(self, store: fs.FileSystem, place: str, part: int, number: int) -> pa.RecordBatch:
        index = np.array(self.entries, ENTRY)
        name = f"{part:06d}-{number:06d}-{uuid.uuid4().hex}.ids"
        with store.open_output_stream(f"{place}/{name}") as out:
            for block in (*self.blocks, index.tobytes(), struct.pack(TAIL, self.size, len(index), MAGIC)):
                out.write(block)
        n_bytes = self.size + index.nbytes + struct.calcsize(TAIL)
        row = {"part": part, "number": number, "path": name, "n_docs": len(index), "n_ids": int(index["n_ids"].sum()), "n_bytes": n_bytes}
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))


def index_of(data: bytes) -> tuple[np.ndarray, bytes, int]:
    """Index, dictionary hash and bytes per id of a file."""
    magic, label, width = struct.unpack_from(HEAD, data)
    start, count, again = struct.unpack_from(TAIL, data, len(data) - struct.calcsize(TAIL))
    if magic != MAGIC or again != MAGIC:
        raise ValueError("not a file of token ids")
    return np.frombuffer(data, ENTRY, count, start), label, width


def read_token_files(files: TokenFiles) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids`` (little-endian unsigned 32-bit)."""
    return _read(files, "ids binary", lambda ids: ids.tobytes(), pa.binary())


def token_checksums(files: TokenFiles) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of the ids as little-endian unsigned 32-bit numbers."""
    return _read(files, "ids_crc32 long", lambda ids: zlib.crc32(ids.tobytes()), pa.int64())


def _read(files: TokenFiles, column: str, value, kind: pa.DataType) -> DataFrame:
    raw, name = files.dictionary, column.split()[0]
    schema = f"file string, doc_id long, inside long, n_tokens long, {column}"
    order = [(r["path"], r["n_ids"]) for r in files.manifest.orderBy("part", "number").collect()]  # one row per file
    if not order:
        return files.spark.createDataFrame([], f"doc_id long, start long, n_tokens long, {column}")

    def run(batches):
        fresh_worker()
        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = data.as_buffer()
                index, label, width = index_of(data)
                if label != hashlib.sha256(raw).digest():
                    raise ValueError(f"{path} needs another dictionary")
                view, inside = memoryview(data), 0
                for block in np.array_split(index, max(1, len(index) // 1024)):
                    sizes = block["n_ids"].astype(np.int64)
                    made = []
                    for entry in block:
                        start = int(entry["offset"])
                        frame = expand.decompress(view[start : start + int(entry["size"])])
                        made.append(value(np.frombuffer(frame, f"<u{width}").astype("<u4")))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([path.rpartition("/")[2]] * len(block), pa.string()),
                            pa.array(block["doc_id"].astype(np.int64), mask=block["named"] == 0),
                            pa.array(inside + np.cumsum(sizes) - sizes),
                            pa.array(sizes),
                            pa.array(made, kind),
                        ],
                        ["file", "doc_id", "inside", "n_tokens", name],
                    )
                    inside += int(sizes.sum())

    reader = files.spark.read.format("binaryFile").option("pathGlobFilter", "*.ids")
    found = reader.load(files.folder).select("path", "content").mapInArrow(run, schema)
    before = np.cumsum([0] + [n for _, n in order]).tolist()
    starts = files.spark.createDataFrame([(p, b) for (p, _), b in zip(order, before)], "file string, before long")
    wide = found.join(starts, "file")  # files that a failed task left behind are in no manifest
    return wide.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", name)
