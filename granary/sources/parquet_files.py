"""Parquet output into the processed zone, and input of files with nanosecond timestamps."""

from __future__ import annotations

import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import RawWritePermissionError
from ..layout import ensure_data_layout, is_under


def export_parquet(frame: DataFrame, destination: Path | str, *, data_root: Path | str | None = None, single_file: bool = False) -> Path:
    """Writes Snappy Parquet, replacing what is there; refuses other suffixes and other zones.

    The result is a dataset directory named like the file; `single_file` makes it one file, which
    one task writes, so it is meant for small results.
    """
    destination, layout = Path(destination), ensure_data_layout(data_root)
    if destination.suffix.lower() != ".parquet":
        raise ValueError(f"expected a .parquet destination, got {destination.name}")
    if is_under(destination, layout.raw):
        raise RawWritePermissionError(destination, "export_parquet")
    if not is_under(destination, layout.processed):
        raise ValueError(f"{destination} is not in the processed zone {layout.processed}")
    destination.parent.mkdir(parents=True, exist_ok=True)
    target = destination.with_name(destination.name + ".parts") if single_file else destination
    if destination.is_file():
        destination.unlink()
    (frame.coalesce(1) if single_file else frame).write.mode("overwrite").option("compression", "snappy").parquet(str(target))
    if single_file:
        if destination.is_dir():
            shutil.rmtree(destination)
        next(target.glob("part-*.parquet")).replace(destination)
        shutil.rmtree(target)
    return destination


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A panel file by whatever writer: timestamps in nanoseconds, which Spark reads as longs on
    request only, become microseconds."""
    legacy = "spark.sql.legacy.parquet.nanosAsLong"
    before = spark.conf.get(legacy, "false")
    spark.conf.set(legacy, "true")
    try:
        frame = spark.read.parquet(path)
        kinds = dict(frame.dtypes)
    finally:
        spark.conf.set(legacy, before)
    if kinds.get("timestamp") != "bigint":
        return spark.read.parquet(path)
    micros = F.timestamp_micros(F.floor(F.col("timestamp") / F.lit(1000)).cast("long"))
    return frame.withColumn("timestamp", F.convert_timezone(F.lit("UTC"), F.lit("UTC"), micros.cast("timestamp_ntz")))
