"""Which files a folder holds, and how each of them is read."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from afluente import constants as C
from afluente.functions.text import any_case_glob, plain_path
from afluente.session import case_keeping

@dataclass(frozen=True)
class Folder:
    """Where the inputs are (a folder, or a glob of folders) and how to split their lines.

    ``only`` narrows it to the files listed under these paths. ``saved`` keeps what has been worked out of its files, so that all steps of a run
    see the same; open the folder again to see later changes.
    """

    spark: SparkSession
    location: str
    separator: str = ";"
    only: tuple[str, ...] | None = None
    saved: dict = field(default_factory=dict, compare=False, repr=False)


def open_folder(spark: SparkSession, location: str, separator: str = ";") -> Folder:
    if not separator:
        raise ValueError("the separator must not be empty")
    return Folder(case_keeping(spark), location.rstrip("/"), separator)


def globs(folder: Folder, extensions: tuple[str, ...]) -> list[str]:
    """One pattern per extension, in any letter case, for files directly in the folder."""
    if folder.only is not None:
        return [re.sub(r"([\\\[\]{}*?^,])", r"\\\1", path) for path in folder.only if path.lower().endswith(extensions)]
    return [f"{folder.location}/*{any_case_glob(e)}" for e in extensions]


def narrowed(folder: Folder, paths: Iterable[str]) -> Folder:
    """The folder with some of its files alone, as listed under ``paths``."""
    return replace(folder, only=tuple(paths), saved={})


def location_of(folder: Folder) -> str:
    """The deepest folder that holds all inputs: the location up to its first pattern."""
    return re.split(r"/[^/]*[*?\[{]", folder.location)[0] or "/"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_rank(name: Column) -> Column:
    """Sources are taken by kind first, then by path."""
    lowered = F.lower(name)
    rank = F.lit(len(C.EXTENSIONS))
    for position, extension in reversed(list(enumerate(C.EXTENSIONS))):
        rank = F.when(lowered.endswith(extension), F.lit(position)).otherwise(rank)
    return rank


def route(name: Column) -> Column:
    """How a file is read, from its extension alone."""
    lowered = F.lower(name)

    def ends_with_any(extensions: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for extension in extensions:
            hit = hit | lowered.endswith(extension)
        return hit

    return (
        F.when(ends_with_any(C.DELIMITED_EXTENSIONS), "delimited")
        .when(ends_with_any(C.WORKBOOK_EXTENSIONS), "workbook")
        .otherwise("unsupported")
    )


def load_matching(
    reader: DataFrameReader, folder: Folder, extensions: tuple[str, ...], columns: list[Column]
) -> DataFrame | None:
    """``columns`` of all files with one of the extensions; None without any file."""
    found = None
    patterns = globs(folder, extensions)
    # single files are known to exist, so one listing does for all
    for pattern in [patterns] if folder.only is not None and patterns else patterns:
        try:
            part = reader.load(pattern).select(*columns)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found = part if found is None else found.unionAll(part)
    return found


def files(folder: Folder, extensions: tuple[str, ...]) -> DataFrame | None:
    """The matching files as (uri, length, content), if any; unused columns are never read."""
    uri = F.col("_metadata.file_path").alias("uri")
    reader = folder.spark.read.format("binaryFile")
    return load_matching(reader, folder, extensions, [uri, F.col("length"), F.col("content")])


def passed_over(folder: Folder) -> list[tuple[str, int, str | None]]:
    """(uri, length, detail) of the supported files that Spark's readers leave out without a word.

    These are files of zero bytes, without a detail, and files whose names begin with ``_`` or
    ``.``, which no reader opens. The listing takes a few calls per file on the driver.
    """
    jvm = folder.spark.sparkContext._jvm
    settings = folder.spark._jsparkSession.sessionState().newHadoopConf()
    found = []
    for pattern in globs(folder, C.EXTENSIONS):
        glob = jvm.org.apache.hadoop.fs.Path(pattern)
        for status in glob.getFileSystem(settings).globStatus(glob) or ():
            place, length = status.getPath(), status.getLen()
            name = place.getName()
            hidden = name.startswith(".") or (name.startswith("_") and "=" not in name)
            if (hidden or length == 0) and status.isFile():
                found.append((place.toUri().toString(), length, C.HIDDEN_NAME if hidden else None))
    return found
