"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_own: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; only where it is unset (tests) a folder of our own."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="granary-")
    return _own


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, computed once into the shared folder and read back; later reads survive lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = (path,)
    return out


def written_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of two written frames, to be dropped together."""
    out = a.union(b)
    out._written_at = (*a._written_at, *b._written_at)
    return out


def drop_written(*frames: DataFrame | None) -> None:
    """Deletes the tables of written() frames that no later step reads."""
    for df in frames:
        for path in getattr(df, "__dict__", {}).pop("_written_at", ()):
            drop_folder(df.sparkSession, path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder in the shared storage, whatever its file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def open_folder(uri: str):
    """(file system, path) by pyarrow, for workers that write or map files in the shared folder."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def session_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_field(schema: T.StructType, name: str, kind: str) -> T.StructType:
    return T.StructType([*schema.fields, *T.StructType.fromDDL(f"`{name}` {kind}").fields])


def tidy(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a mapInArrow, after which the worker, which lives on for other tasks, gives what
    it has freed back to the system."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps what it has
                ctypes.CDLL(None).malloc_trim(0)

    return run


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of the frame has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of the frame but those called `names` in any case."""
    left_out = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in left_out]
