"""Session helpers: the shared folder and readers with their own split size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A lookup table goes to every executor only while it is estimated below this.
BROADCAST_LIMIT_BYTES = 256 << 20

_SPLIT_BYTES = "spark.sql.files.maxPartitionBytes"
_OPEN_COST = "spark.sql.files.openCostInBytes"
_MOST_PARTITIONS = "spark.sql.files.maxPartitionNum"


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that all executors can reach."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="afluente-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/afluente-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` saved in the shared folder and read back: stable, and cut off from its lineage."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed_path(spark: SparkSession, path: str) -> None:
    """Remove a table that ``written`` or a run saved below the shared folder for itself."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def block_size(spark: SparkSession) -> int:
    """Bytes per scan task in this session."""
    text = spark.conf.get(_SPLIT_BYTES).strip().lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    digits = text.rstrip("bkmg")
    return int(digits) * units[text[len(digits):] or "b"]


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores when it comes in fewer pieces than there are; heavy work per row follows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def session_like(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session on the same context with the same settings but for the given ones."""
    child = spark.newSession()
    for key, value in {**spark.conf.getAll, **settings}.items():
        if key in settings or spark.conf.isModifiable(key):
            child.conf.set(key, value)
    return child


def one_block_per_task(spark: SparkSession, bytes_per_block: int) -> SparkSession:
    """A session whose file scans put exactly one block into each task.

    With the opening cost equal to the split size, Spark never packs two
    blocks together and never shrinks blocks to fit the number of cores. A
    limit on the number of partitions would pack them again, so it is lifted. Block
    boundaries then depend on the file alone, so (block, row in task) is the
    same in every run and after every retry.
    """
    size = str(bytes_per_block)
    return session_like(spark, {_SPLIT_BYTES: size, _OPEN_COST: size, _MOST_PARTITIONS: str(2**31 - 1)})


def case_keeping(spark: SparkSession) -> SparkSession:
    """A session in which ``Valor`` and ``valor`` are two columns, as they are in the inputs."""
    return session_like(spark, {"spark.sql.caseSensitive": "true"})
