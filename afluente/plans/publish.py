"""Several outputs of one run, published together: all of them appear, or none does."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession

MANIFEST = "_manifest.json"


@dataclass(frozen=True)
class RunReport:
    """Where each output is, and the row totals of the run."""

    places: dict[str, str]
    totals: dict[str, int]


class Store:
    """The file system of a folder, by the calls that Spark's own committers use."""

    def __init__(self, spark: SparkSession, place: str) -> None:
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(place).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def exists(self, place: str) -> bool:
        return self._files.exists(self._path(place))

    def move(self, source: str, target: str) -> None:
        """Rename a folder; a target that exists is an error, as a rename would otherwise put the source into it."""
        if self.exists(target) or not self._files.rename(self._path(source), self._path(target)):
            raise OSError(f"{source} cannot be moved to {target}")

    def remove(self, place: str) -> None:
        self._files.delete(self._path(place), True)

    def read(self, place: str) -> str | None:
        """A small text, or None where there is none."""
        if not self.exists(place):
            return None
        source = self._files.open(self._path(place))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def replace(self, place: str, text: str) -> None:
        """A small text in place of an older one; a reader sees either, or for a moment none."""
        self.put(f"{place}.new", text)
        self._files.delete(self._path(place), False)
        self.move(f"{place}.new", place)

    def put(self, place: str, text: str) -> None:
        out = self._files.create(self._path(place), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


def publish(
    spark: SparkSession,
    path: str,
    names: Mapping[str, str],
    write: Callable[[str, str], None],
    totals: Callable[[], dict[str, int]],
) -> RunReport:
    """Write every output of ``names`` (output, folder name) to a staging folder, then move all of them below ``path``.

    ``write`` takes an output and where to put it. A failure in any output, or in a move, takes back what was moved and
    leaves ``path`` as it was. An output that is already there is an error before anything is written. The manifest comes
    last: a reader that waits for it never sees half a run.
    """
    path = path.rstrip("/")
    store = Store(spark, path)
    targets = {part: f"{path}/{name}" for part, name in names.items()}
    taken = [place for place in targets.values() if store.exists(place)]
    if taken:
        raise FileExistsError(f"already there: {', '.join(taken)}")
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    moved: list[str] = []
    try:
        for part, name in names.items():
            write(part, f"{staging}/{name}")
        report = RunReport(targets, totals())
        for part, name in names.items():
            store.move(f"{staging}/{name}", targets[part])
            moved.append(targets[part])
        store.put(f"{path}/{MANIFEST}", json.dumps({"outputs": dict(names), "totals": report.totals}, indent=1))
    except BaseException:
        for place in moved:
            store.remove(place)
        raise
    finally:
        store.remove(staging)
    return report
