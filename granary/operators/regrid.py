"""Daily re-gridding: one row per SKU and day, demand 0 in the gaps, lead time carried on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..contract import CANONICAL, TemporalContinuityError

DAY = "interval 1 day"
#: Longest span of one SKU that is accepted, in days: all days that nanosecond timestamps reach.
MAX_SPAN_DAYS = 213_600


def _check_columns(frame: DataFrame) -> None:
    missing = [c for c in CANONICAL if c not in frame.columns]
    if missing:
        raise TemporalContinuityError(f"missing columns: {missing}")


#: How the error of an overlong span begins where the running plan finds it.
SPAN_ERROR = "too long a span of days"


def regrid_unique(frame: DataFrame, max_span_days: int = MAX_SPAN_DAYS) -> DataFrame:
    """The daily panel of barrier output (unique sku and day, midnights, no nulls).

    Each observation is spread over the days up to the next one of its SKU: no join, one exchange
    on the SKU, and no pass before it.  An SKU that spans `max_span_days` or more days makes the plan
    fail with SPAN_ERROR.  Rows are not sorted across the result.
    """
    by_sku = W.partitionBy("sku_id").orderBy("timestamp")
    following = F.coalesce(F.lead("timestamp").over(by_sku), F.col("timestamp"))
    placed = frame.select(*CANONICAL, following.alias("_next"), F.first("timestamp").over(by_sku).alias("_first"))
    days = F.datediff("_next", "_first")
    checked = F.when(days < max_span_days, F.col("_next")).otherwise(F.raise_error(F.concat(F.lit(f"{SPAN_ERROR}: sku "), F.col("sku_id"), F.lit(" has "), days + 1)))
    until = F.greatest(checked - F.expr(DAY), F.col("timestamp"))
    spread = placed.select(*CANONICAL, F.explode(F.sequence("timestamp", until, F.expr(DAY))).alias("_day"))
    demand = F.when(F.col("_day") == F.col("timestamp"), F.col("demand_qty").cast("double")).otherwise(F.lit(0.0))
    return spread.select("sku_id", F.col("_day").alias("timestamp"), demand.alias("demand_qty"), F.col("lead_time_days").cast("long").alias("lead_time_days"))


def grid_bounds(frame: DataFrame) -> DataFrame:
    """First and last day of each SKU (null SKUs left out)."""
    day = F.date_trunc("day", "timestamp").cast("timestamp_ntz")
    return frame.filter("sku_id is not null").groupBy("sku_id").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def daily_grid(bounds: DataFrame) -> DataFrame:
    """Every day between the bounds, both included."""
    return bounds.select("sku_id", F.explode(F.sequence("first_day", "last_day", F.expr(DAY))).alias("timestamp"))


def join_grid(grid: DataFrame, frame: DataFrame) -> DataFrame:
    """Observations on their days, nulls on the others."""
    return grid.join(frame, ["sku_id", "timestamp"], "left")


def last_known(value: str) -> Column:
    """The SKU's last known value up to the day."""
    before = W.partitionBy("sku_id").orderBy("timestamp").rowsBetween(W.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(before)


def carried(value: str) -> Column:
    """Last known value of the SKU up to the day; before the first known one, that one."""
    known = F.when(F.col(value).isNotNull(), F.col("timestamp"))
    return F.coalesce(last_known(value), F.min_by(value, known).over(W.partitionBy("sku_id")))


def regrid_general(frame: DataFrame) -> DataFrame:
    """The panel of a frame that did not pass the barrier: an outer join on the grid.

    Observations off midnight miss the grid and count as gaps; null demand counts as 0; null lead
    times are filled from both sides.  Repeated days stay repeated, for check_continuity() to find.
    """
    joined = join_grid(daily_grid(grid_bounds(frame)), frame.select(*CANONICAL))
    return joined.select("sku_id", "timestamp", F.coalesce(F.col("demand_qty").cast("double"), F.lit(0.0)).alias("demand_qty"), carried("lead_time_days").cast("long").alias("lead_time_days"))


def in_order(panel: DataFrame) -> DataFrame:
    """The panel by SKU and day, which is the order of files: a range exchange, sorted in each part."""
    return panel.orderBy("sku_id", "timestamp")


def broken_steps(panel: DataFrame) -> DataFrame:
    """Rows that do not follow their SKU's previous row by exactly one day."""
    step = F.col("timestamp") - F.lag("timestamp").over(W.partitionBy("sku_id").orderBy("timestamp"))
    return panel.withColumn("step", step).filter(F.col("step").isNotNull() & (F.col("step") != F.expr(DAY)))


def gap_counts(frame: DataFrame) -> DataFrame:
    """Rows, days and missing days of each SKU of a frame with unique days."""
    day = F.date_trunc("day", "timestamp")
    span = (F.datediff(F.max(day), F.min(day)) + 1).cast("long")
    return frame.filter("sku_id is not null").groupBy("sku_id").agg(F.count("*").alias("observed"), span.alias("days")).withColumn("gaps", F.col("days") - F.col("observed"))


def _unique(frame: DataFrame) -> bool:
    """Whether the direct plan holds: unique days at midnight, nothing null; one aggregate."""
    odd = F.col("sku_id").isNull() | F.col("timestamp").isNull() | F.col("demand_qty").isNull() | F.col("lead_time_days").isNull() | (F.date_trunc("day", "timestamp").cast("timestamp_ntz") != F.col("timestamp").cast("timestamp_ntz"))
    keys = frame.groupBy("sku_id", "timestamp").agg(F.count("*").alias("n"), F.max(odd).alias("odd"))
    return keys.filter("n > 1 or odd").isEmpty()


def regrid_daily(frame: DataFrame, *, validated: bool = False, max_span_days: int = MAX_SPAN_DAYS) -> DataFrame:
    """One row per SKU and day between the SKU's first and last one.

    `validated` says that the frame passed the barrier, which leaves nothing to look at before the
    plan runs: only an overlong span is left to find, and the running plan does (see regrid_unique()).
    Else the preconditions are checked and the general plan is used where they fail.  Raises
    TemporalContinuityError for missing columns and, unless `validated`, for an empty frame, repeated
    days, an SKU without any lead time, or a span of `max_span_days` or more.
    """
    _check_columns(frame)
    frame = frame.select("sku_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "demand_qty", "lead_time_days")
    if validated:
        return regrid_unique(frame, max_span_days)
    days = F.datediff("last_day", "first_day")
    spans = grid_bounds(frame).agg(F.count("*").alias("n"), F.max_by("sku_id", days).alias("sku"), F.max(days).alias("days")).first()
    if not spans["n"]:
        raise TemporalContinuityError("the frame has no rows to lay on a grid")
    if (spans["days"] or 0) >= max_span_days:
        raise TemporalContinuityError(f"sku {spans['sku']} spans {spans['days'] + 1} days, more than {max_span_days}")
    if _unique(frame):
        return regrid_unique(frame, max_span_days)
    panel = regrid_general(frame)
    empty = panel.filter("lead_time_days is null").select("sku_id").first()
    if empty:
        raise TemporalContinuityError(f"no lead time is known for sku {empty['sku_id']}")
    broken = broken_steps(panel).select("sku_id").first()
    if broken:
        raise TemporalContinuityError(f"the days of sku {broken['sku_id']} do not follow each other")
    return panel
