"""Opening files by their uri inside tasks, with reads of just the bytes that are asked for."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlsplit

from pyarrow import fs
from pyspark.sql import DataFrame

# Schemes of Hadoop that other libraries know by another name.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a uri and the place in it; escapes of a local path are undone."""
    scheme = urlsplit(uri).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(uri.removeprefix("file:").removeprefix("//")) if scheme else uri
    known = _SCHEMES.get(scheme, scheme)
    return fs.FileSystem.from_uri(known + uri[len(scheme) :])


def opened(uri: str):
    """A file that can be read from any place on."""
    store, place = store_of(uri)
    return store.open_input_file(place)


def reachable(*folders: str) -> bool:
    """Whether tasks can open files there without Spark's readers; one call per folder."""
    try:
        for folder in folders:
            store, place = store_of(folder)
            store.get_file_info(place)
    except Exception:  # a store that only Spark's readers know
        return False
    return True


def quoted(place: str) -> str:
    """The uri of a plain place, with the escapes that Spark's readers use; letters outside ASCII stay as they are."""
    head = re.match("[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", place)
    start = head[0] if head else "file:"
    rest = place[len(head[0]) :] if head else place
    return start + "".join(c if ord(c) > 127 else quote(c, safe="/:@!$&'()*+,;=~-._") for c in rest)


@dataclass(frozen=True)
class SavedTable:
    """A table worked out for a folder, and where it is saved, if it is."""

    table: DataFrame | None
    paths: tuple[str, ...]
