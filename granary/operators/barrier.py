"""The schema barrier: rows become typed, or the first violation in file order is raised."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import CANONICAL, SchemaBarrierError
from ..functions.parsing import checked_day, dashed, has_zone, strip, to_double, whole_number
from ..logs import get_logger
from ..sources.csv_files import ROW_INDEX


#: Column and message of each kind of violation, in the order in which a row's are looked for.
VIOLATIONS = (
    ("timestamp", "timestamp is empty"),
    ("timestamp", "timestamp names a time zone"),
    ("timestamp", "timestamp is not an ISO 8601 date"),
    ("demand_qty", "demand is not a number"),
    ("demand_qty", "demand is negative"),
    ("lead_time_days", "lead time is not a number"),
    ("lead_time_days", "lead time is not a whole number"),
    ("lead_time_days", "lead time is less than one day or too large"),
    (None, "demand is not a number"),
    (None, "sku is blank"),
)


def parsed(aligned: DataFrame) -> DataFrame:
    """The frame with every text stripped and parsed once: _stamp, _zone, _day, _demand, _amount,
    _lead, _days, _sku."""
    stripped = aligned.select("*", *[strip(F.coalesce(F.col(c), F.lit(""))).alias(a) for c, a in zip(CANONICAL, ("_sku", "_stamp", "_demand", "_lead"), strict=True)])
    # one step at a time, so that generated code stays small
    zoned = stripped.select("*", has_zone(F.col("_stamp")).alias("_zone"), dashed(F.col("_stamp")).alias("_plain"))
    cast = zoned.select("*", F.col("_plain").try_cast("timestamp_ntz").alias("_at"))
    return cast.select("*", checked_day(F.col("_plain"), F.col("_at"), F.col("_zone")).alias("_day"), to_double(F.col("_demand")).alias("_amount"), to_double(F.col("_lead")).alias("_days"))


def judged(aligned: DataFrame) -> DataFrame:
    """parsed() with `_v`, the struct (prio, column, raw_value, message) of a row's first violation,
    null if it has none.

    Within a row: timestamp, demand, lead time, then what concerns the row as a whole (NaN demand,
    blank SKU), which names no column.
    """

    amount, days = F.col("_amount"), F.col("_days")
    tests = (
        F.col("_stamp") == "",
        F.col("_zone"),
        F.col("_day").isNull(),
        amount.isNull(),
        ~F.isnan(amount) & (amount < 0),
        days.isNull(),
        ~whole_number(days),
        (days < 1) | (days >= 2.0**63),
        F.isnan(amount),
        F.col("_sku") == "",
    )
    prio = F.lit(None).cast("int")
    for k in range(len(tests), 0, -1):
        prio = F.when(tests[k - 1], F.lit(k)).otherwise(prio)
    ranked = parsed(aligned).withColumn("_prio", prio)

    def chosen(values: list[Column]) -> Column:
        return F.get(F.array(*values), F.col("_prio") - 1)

    columns = [column for column, _ in VIOLATIONS]
    v = F.struct(
        F.col("_prio").alias("prio"),
        chosen([F.lit(c).cast("string") for c in columns]).alias("column"),
        chosen([F.col(c) if c else F.lit(None).cast("string") for c in columns]).alias("raw_value"),
        chosen([F.lit(m) for _, m in VIOLATIONS]).alias("message"),
    )
    return ranked.withColumn("_v", F.when(F.col("_prio").isNotNull(), v))


def accepted(rows: DataFrame) -> DataFrame:
    """The canonical columns, typed, of judged rows without a violation."""
    columns = [F.col("_sku").alias("sku_id"), F.col("_day").alias("timestamp"), (F.col("_amount") + F.lit(0.0)).alias("demand_qty"), F.col("_days").try_cast("bigint").alias("lead_time_days")]
    place = [F.col(ROW_INDEX)] if ROW_INDEX in rows.columns else []
    # a list of one row or none, not a filter: the optimiser would copy the whole parse into the predicate
    return rows.select(F.inline(F.when(F.col("_prio").isNull(), F.array(F.struct(*columns, *place)))))


def violations(aligned: DataFrame) -> DataFrame:
    """Every row with a violation: row_index, prio, column, raw_value, message."""
    # exploding the one-element list (not filtering) keeps the optimiser from copying the chain into a predicate
    listed = judged(aligned).select(F.col(ROW_INDEX).alias("row_index"), F.explode(F.array_compact(F.array("_v"))).alias("_v"))
    return listed.select("row_index", "_v.*")


def first_violation(aligned: DataFrame) -> DataFrame:
    """The violation of least row index, as one row, or no row."""
    least = violations(aligned).agg(F.min_by(F.struct("row_index", "prio", "column", "raw_value", "message"), "row_index").alias("v"))
    return least.filter("v is not null").select("v.*")


def duplicate_keys(frame: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Keys that occur more than once, with the number of rows and the first position."""
    return frame.groupBy(*keys).agg(F.count("*").alias("n"), F.min(position).alias("first_row")).filter("n > 1")


def _fail(message: str, **where) -> None:
    get_logger(__name__).error("%s %s", message, where)
    raise SchemaBarrierError(message, **where)


def validate_aligned(aligned: DataFrame, *, keep: bool = False) -> DataFrame:
    """The typed canonical frame, or SchemaBarrierError for the first violation in file order.

    Two small actions: one aggregate counts the rows and finds the first bad one; only if there is
    none, another looks for repeated (sku, day) keys and reports the first row that belongs to any.
    `keep` persists the typed frame before the second, for callers that read it again; they may
    unpersist it.
    """
    columns = tuple(c for c in aligned.columns if c != ROW_INDEX)
    if columns != CANONICAL:
        _fail(f"columns must be {list(CANONICAL)}, got {list(columns)}")
    if ROW_INDEX not in aligned.columns:
        aligned = aligned.withColumn(ROW_INDEX, F.monotonically_increasing_id())
    rows = judged(aligned)
    bad_at = F.when(F.col("_prio").isNotNull(), F.col(ROW_INDEX))
    seen = rows.agg(F.count("*").alias("n"), F.min_by(F.struct(F.col(ROW_INDEX).alias("row_index"), "_v"), bad_at).alias("bad")).first()
    if not seen["n"]:
        _fail("the frame has no rows")
    if seen["bad"]:
        bad = seen["bad"]["_v"]
        _fail(bad["message"], row_index=seen["bad"]["row_index"], column=bad["column"], raw_value=bad["raw_value"])
    done = accepted(rows)
    if keep:
        done = done.persist(StorageLevel.MEMORY_AND_DISK)
    twice = duplicate_keys(done, ["sku_id", "timestamp"], ROW_INDEX).agg(F.min("first_row").alias("first_row")).first()
    if twice["first_row"] is not None:
        if keep:
            done.unpersist()
        _fail("a sku has more than one row for a day", row_index=twice["first_row"])
    return done.select(*CANONICAL)
