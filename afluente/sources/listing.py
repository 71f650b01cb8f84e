"""Files that Spark's readers pass over, found by tasks that list the folders; and lines of files with hidden names."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afluente import constants as C
from afluente.functions.text import decode_latin1, plain_path
from afluente.session import shared_folder
from afluente.sources import stores
from afluente.sources.folder import Folder, extension_rank, file_name, files, load_matching, location_of, passed_over, route

ODD_SCHEMA = "uri string, length bigint, detail string"
LINES_SCHEMA = "uri string, length bigint, block bigint, line bigint, value binary"

_ROWS_PER_BATCH = 4096
_READ_BYTES = 1 << 20
_LINE_ENDS = re.compile(rb"[\r\n]+")
_BYTE_ORDER_MARK = b"\xef\xbb\xbf"
_ODD_FIELDS = pa.schema([("uri", pa.string()), ("length", pa.int64()), ("detail", pa.string())])
_LINE_FIELDS = pa.schema(
    [("uri", pa.string()), ("length", pa.int64()), ("block", pa.int64()), ("line", pa.int64()), ("value", pa.binary())]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def is_hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _list_odd(extensions: tuple[str, ...]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, is_folder in zip(batch["place"].to_pylist(), batch["is_folder"].to_pylist()):
                store, inside = stores.store_of(stores.quoted(place))
                entries = store.get_file_info(fs.FileSelector(inside)) if is_folder else [store.get_file_info(inside)]
                found = []
                for entry in entries:
                    hidden = is_hidden(entry.base_name)
                    if entry.type == fs.FileType.File and (hidden or not entry.size) and entry.base_name.lower().endswith(extensions):
                        uri = stores.quoted(f"{place}/{entry.base_name}" if is_folder else place)
                        found.append((uri, entry.size, C.HIDDEN_NAME if hidden else None))
                if found:
                    yield _batch(found, _ODD_FIELDS)

    return read


def odd_files(folder: Folder) -> DataFrame:
    """(uri, length, detail) of empty files (no detail) and of files with hidden names; worked out once per folder object.

    The folders of the location are dealt out and each is listed by a task. Stores that only Spark's readers know are
    listed on the driver, with a few calls per file.
    """
    if "odd" not in folder.saved:
        spark, place = folder.spark, shared_folder(folder.spark)
        if stores.reachable(location_of(folder), place):
            places = [(p, False) for p in folder.only] if folder.only is not None else [(p, True) for p in _folders(folder)]
            listed = spark.createDataFrame(places, "place string, is_folder boolean")
            spread = listed.repartition(max(1, min(len(places), 4 * spark.sparkContext.defaultParallelism)))
            found = spread.mapInArrow(_list_odd(C.EXTENSIONS), ODD_SCHEMA)
        else:
            found = spark.createDataFrame(passed_over(folder), ODD_SCHEMA)
        found.write.parquet(place)
        folder.saved["odd"] = stores.SavedTable(spark.read.schema(ODD_SCHEMA).parquet(place), (place,))
    return folder.saved["odd"].table


def _folders(folder: Folder) -> list[str]:
    """The folders that the location names; a glob is resolved by one call, never file by file."""
    glob = folder.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder.location)
    settings = folder.spark._jsparkSession.sessionState().newHadoopConf()
    found = glob.getFileSystem(settings).globStatus(glob) or ()
    return [s.getPath().toString() for s in found if s.isDirectory()]


def hidden_files(folder: Folder, extensions: tuple[str, ...]) -> DataFrame | None:
    """(uri, length) of the files with hidden names and content that tasks can open; None without any."""
    key = ("hidden", extensions)
    if key not in folder.saved:
        found = None
        if stores.reachable(location_of(folder)):
            name = F.lower(file_name(plain_path(F.col("uri"))))
            wanted = F.lit(False)
            for extension in extensions:
                wanted = wanted | name.endswith(extension)
            found = odd_files(folder).where((F.col("detail") == C.HIDDEN_NAME) & (F.col("length") > 0) & wanted).select("uri", "length")
            found = None if found.isEmpty() else found
        folder.saved[key] = stores.SavedTable(found, ())
    return folder.saved[key].table


def unread_files(folder: Folder) -> DataFrame:
    """The odd files that stay unread: empty ones, and hidden ones in stores that tasks cannot open."""
    odd = odd_files(folder)
    return odd.where(F.col("length") == 0) if stores.reachable(location_of(folder)) else odd


def _first_byte_of_line(source, position: int, length: int) -> int:
    """Where the first line begins that starts at ``position`` or later; neighbouring blocks agree on it."""
    if position <= 0 or position >= length:
        return min(max(position, 0), length)
    source.seek(position - 1)
    at = position - 1
    while piece := source.read(_READ_BYTES):
        end = re.search(rb"[\r\n]", piece)
        if end:
            return at + end.start() + 1
        at += len(piece)
    return length


def _block_lines(source, block: int, size: int, length: int) -> Iterator[bytes]:
    """Non-blank lines that begin in the block, read piece by piece."""
    at, end = _first_byte_of_line(source, block, length), _first_byte_of_line(source, block + size, length)
    source.seek(at)
    rest, first = b"", at == 0
    while at < end:
        piece = source.read(min(_READ_BYTES, end - at))
        if not piece:
            break
        at += len(piece)
        if first and len(rest + piece) >= len(_BYTE_ORDER_MARK):
            rest, piece, first = b"", (rest + piece).removeprefix(_BYTE_ORDER_MARK), False
        lines = _LINE_ENDS.split(rest + piece)
        rest = lines.pop()
        yield from (line for line in lines if line)
    if rest:
        yield rest.removeprefix(_BYTE_ORDER_MARK) if first else rest


def _line_reader(size: int, most: int | None):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, length, block in zip(*(batch[c].to_pylist() for c in ("uri", "length", "block"))):
                pending = []
                with stores.opened(uri) as source:
                    for line, value in enumerate(_block_lines(source, block, size, length)):
                        if line == most:
                            break
                        pending.append((uri, length, block, line, value))
                        if len(pending) == _ROWS_PER_BATCH:
                            yield _batch(pending, _LINE_FIELDS)
                            pending = []
                if pending:
                    yield _batch(pending, _LINE_FIELDS)

    return read


def hidden_lines(folder: Folder, bytes_per_block: int, first: int | None = None) -> DataFrame | None:
    """(uri, length, block, line, value) of the lines in text files with hidden names, blank lines left out.

    Files are cut into blocks as other big files are, and each block numbers its own lines. With ``first``, no more than
    that many lines of each file, from its first block.
    """
    found = hidden_files(folder, C.DELIMITED_EXTENSIONS)
    if found is None:
        return None
    zero = F.lit(0).cast("bigint")
    last = zero if first is not None else (F.floor((F.col("length") - 1) / bytes_per_block) * bytes_per_block).cast("bigint")
    blocks = found.select("uri", "length", F.explode(F.sequence(zero, last, F.lit(bytes_per_block).cast("bigint"))).alias("block"))
    spread = blocks.repartition(folder.spark.sparkContext.defaultParallelism, "uri", "block")
    lines = spread.mapInArrow(_line_reader(bytes_per_block, first), LINES_SCHEMA)
    return lines.withColumn("value", decode_latin1(F.col("value")))


def folder_files(folder: Folder) -> DataFrame:
    """(path, length, modified) of all supported files of the folder; nothing of them is read.

    Files that Spark's readers pass over have no modification time; they count as changed when their length does.
    """
    odd = odd_files(folder).select(plain_path(F.col("uri")).alias("path"), "length", F.lit(None).cast("timestamp").alias("modified"))
    columns = [plain_path(F.col("_metadata.file_path")).alias("path"), F.col("length"), F.col("modificationTime").alias("modified")]
    found = load_matching(folder.spark.read.format("binaryFile"), folder, C.EXTENSIONS, columns)
    return odd if found is None else found.where(F.col("length") > 0).unionAll(odd)


def list_sources(folder: Folder) -> DataFrame:
    """Supported files with their kind and status; only names and sizes are read.

    The status is ``listed``, ``empty`` for files of zero bytes, or ``skipped`` for hidden names that are empty or lie in
    a store that tasks cannot open.
    """
    unread = unread_files(folder)
    status = F.when(F.col("detail").isNull(), "empty").otherwise("skipped")
    odd = unread.select("uri", "length", status.alias("status"))
    for listed in (files(folder, C.EXTENSIONS), hidden_files(folder, C.EXTENSIONS)):
        if listed is not None:
            odd = odd.unionAll(listed.where(F.col("length") > 0).select("uri", "length", F.lit("listed").alias("status")))
    path = plain_path(F.col("uri"))
    name = file_name(path)
    return odd.select(
        path.alias("path"), name.alias("file"), extension_rank(name).alias("rank"), route(name).alias("route"), "length", "status"
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
