"""Structured Streaming form of what concerns single rows of the barrier, and daily totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.barrier import accepted, judged


def split_stream(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected rows with their violation) of a stream of aligned text rows.

    Repeated keys and gap filling need the whole table; they run on the table that the accepted
    rows are written to.
    """
    rows = judged(aligned)
    raw = [F.col(c).alias(f"raw_{c}") for c in aligned.columns]
    rejected = rows.select(*raw, F.explode(F.array_compact(F.array("_v"))).alias("_v")).select(*[f"raw_{c}" for c in aligned.columns], "_v.*")
    return accepted(rows), rejected


def daily_totals(rows: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Demand by SKU and day in event time; days are final once the watermark has passed them."""
    stamped = rows.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", lateness)
    days = stamped.groupBy("sku_id", F.window("event_time", "1 day")).agg(F.sum("demand_qty").alias("demand_qty"), F.max("lead_time_days").alias("lead_time_days"))
    return days.select("sku_id", F.col("window.start").alias("day"), "demand_qty", "lead_time_days")
