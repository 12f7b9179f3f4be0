"""One query for each operator over the driver's tables, with the SQL that must agree with it.

Observations are the shipped quantities of each supplier by day; the lead time of a day is the
shortest time from order to shipment, at least one day.  Dirty text comes from events.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..contract import CANONICAL, HeaderMapping
from ..functions import parsing
from ..layout import deposit_raw_csv, ensure_data_layout
from ..operators import align, barrier, diagnostics, forecast, regrid
from ..sources import csv_files
from ..sources.csv_files import ROW_INDEX
from ..sources.parquet_files import export_parquet, read_panel
from ..streaming.barrier import daily_totals, split_stream
from ..workspace import new_path
from .ingest import run_semantic_pipeline

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- demand panel -------------------------------------------------------------------------------


def canonical_projection(spark, sf_dir):
    mapping = HeaderMapping("L_SUPPKEY", "l_shipdate", "l_quantity", "l_linenumber")
    return align.apply_header_mapping(_table(spark, sf_dir, "lineitem"), mapping).frame


def header_sample(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return spark.createDataFrame(align.sample_rows(lines.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), lines.schema)


def case_insensitive_resolve(spark, sf_dir):
    columns = _table(spark, sf_dir, "lineitem").columns
    return spark.createDataFrame([(w, align.resolve_column(w, columns)) for w in ("l_quantity", "L_QUANTITY", "L_ShipDate")], "wanted string, found string")


def observations_daily(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_quantity")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    days = F.greatest(F.lit(1), F.min(F.datediff("l_shipdate", "o_orderdate"))).cast("long")
    day = F.date_trunc("day", "l_shipdate").cast("timestamp_ntz")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.groupBy(F.col("l_suppkey").cast("string").alias("sku_id"), day.alias("timestamp")).agg(F.sum("l_quantity").alias("demand_qty"), days.alias("lead_time_days"))


OBSERVATIONS = """
    SELECT CAST(l_suppkey AS VARCHAR) AS sku_id, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS "timestamp",
           sum(l_quantity) AS demand_qty,
           CAST(greatest(1, min(date_diff('day', o_orderdate, l_shipdate))) AS BIGINT) AS lead_time_days
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    GROUP BY ALL
"""
GRID = f"""
    WITH obs AS ({OBSERVATIONS}),
    bounds AS (SELECT sku_id, min("timestamp") AS first_day, max("timestamp") AS last_day FROM obs GROUP BY sku_id),
    grid AS (SELECT sku_id, unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS "timestamp" FROM bounds)
"""
PANEL = f"""{GRID},
    joined AS (SELECT g.sku_id, g."timestamp", o.demand_qty, o.lead_time_days FROM grid g LEFT JOIN obs o ON g.sku_id = o.sku_id AND g."timestamp" = o."timestamp"),
    panel AS (
        SELECT sku_id, "timestamp", coalesce(demand_qty, 0.0) AS demand_qty,
               last_value(lead_time_days IGNORE NULLS) OVER (PARTITION BY sku_id ORDER BY "timestamp" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lead_time_days
        FROM joined
    )
"""
# every third day of a supplier's own sequence loses its lead time, the first one always
HOLES = f"""
    holes AS (
        SELECT sku_id, "timestamp", CASE WHEN row_number() OVER (PARTITION BY sku_id ORDER BY "timestamp") % 3 = 1 THEN NULL ELSE lead_time_days END AS lead_time_days
        FROM ({OBSERVATIONS})
    )
"""


def _panel(spark, sf_dir):
    return regrid.regrid_daily(observations_daily(spark, sf_dir), validated=True)


def grid_bounds(spark, sf_dir):
    return regrid.grid_bounds(observations_daily(spark, sf_dir))


def daily_grid(spark, sf_dir):
    return regrid.daily_grid(grid_bounds(spark, sf_dir))


def grid_left_join(spark, sf_dir):
    observed = observations_daily(spark, sf_dir)
    return regrid.join_grid(regrid.daily_grid(regrid.grid_bounds(observed)), observed)


def zero_fill_demand(spark, sf_dir):
    return grid_left_join(spark, sf_dir).select("sku_id", "timestamp", F.coalesce("demand_qty", F.lit(0.0)).alias("demand_qty"))


def gap_count_per_sku(spark, sf_dir):
    return regrid.gap_counts(observations_daily(spark, sf_dir))


def _with_holes(spark, sf_dir):
    place = F.row_number().over(W.partitionBy("sku_id").orderBy("timestamp"))
    return observations_daily(spark, sf_dir).withColumn("_place", place).withColumn("lead_time_days", F.when(F.col("_place") % 3 != 1, F.col("lead_time_days")))


def lead_ffill(spark, sf_dir):
    return _with_holes(spark, sf_dir).select("sku_id", "timestamp", regrid.last_known("lead_time_days").alias("lead_time_days"))


def lead_bfill(spark, sf_dir):
    return _with_holes(spark, sf_dir).select("sku_id", "timestamp", regrid.carried("lead_time_days").alias("lead_time_days"))


def resample_daily(spark, sf_dir):
    return _panel(spark, sf_dir)


class _FixedAnswer:
    """A provider that always proposes the same mapping."""

    def __init__(self, mapping: dict[str, str]):
        self.answer = json.dumps(mapping)

    def complete(self, prompt: str, *, temperature: float, timeout: float) -> str:
        return self.answer


def semantic_pipeline(spark, sf_dir):
    """Observations as text under odd headers, through probe, barrier and re-gridding."""
    seen = observations_daily(spark, sf_dir)
    text = seen.select(
        F.date_format("timestamp", "yyyy/MM/dd").alias("Fecha"), F.lit("x").alias("Note"), F.col("lead_time_days").cast("string").alias("Plazo"), F.concat(F.lit(" "), "sku_id").alias("Item"), F.col("demand_qty").cast("string").alias("Usage")
    )
    provider = _FixedAnswer({"sku_id": "item", "timestamp": "Fecha", "demand_qty": "Usage", "lead_time_days": "PLAZO"})
    return run_semantic_pipeline(text, provider)[2]


def resample_daily_general(spark, sf_dir):
    return regrid.regrid_general(observations_daily(spark, sf_dir))


def continuity_check(spark, sf_dir):
    return regrid.broken_steps(_panel(spark, sf_dir)).agg(F.count("*").alias("broken"))


def panel_union(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    return panel.filter("demand_qty > 0").unionByName(panel.filter("demand_qty = 0"))


def _local_root(spark, name):
    """A data root for the operators that work on zones of a mounted folder."""
    return Path(urlsplit(new_path(spark, name)).path)


def panel_parquet_roundtrip(spark, sf_dir):
    root = _local_root(spark, "panel")
    path = export_parquet(_panel(spark, sf_dir), ensure_data_layout(root).processed / "panel.parquet", data_root=root)
    return read_panel(spark, str(path))


def panel_output_order(spark, sf_dir):
    """Each row of the exported panel with its place: by file, then in the file."""
    root = _local_root(spark, "ordered")
    path = export_parquet(regrid.in_order(_panel(spark, sf_dir)), ensure_data_layout(root).processed / "panel.parquet", data_root=root)
    rows = spark.read.parquet(str(path)).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("inside"))
    files = rows.groupBy("file").agg(F.count("*").alias("n"))  # one row for each file
    before = files.select("file", (F.sum("n").over(W.orderBy("file")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "file").select(*CANONICAL, (F.col("before") + F.col("inside")).alias("place"))


def last_season(spark, sf_dir):
    return forecast.last_season(_panel(spark, sf_dir), 7)


def seasonal_naive_forecast(spark, sf_dir):
    return forecast.seasonal_naive(_panel(spark, sf_dir), horizon=17, season_length=7)


def seasonal_naive_per_sku(spark, sf_dir):
    return forecast.forecast_per_sku(_panel(spark, sf_dir), lambda: forecast.SeasonalNaive(7), horizon=17)


FORECAST = f"""{PANEL},
    season AS (
        SELECT sku_id, "timestamp", demand_qty, CAST(7 - rank AS INTEGER) AS place, n FROM (
            SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY "timestamp" DESC) AS rank, count(*) OVER (PARTITION BY sku_id) AS n FROM panel
        ) WHERE rank <= 7 AND n >= 7
    ),
    last_days AS (SELECT sku_id, max("timestamp") AS last_day FROM season GROUP BY sku_id),
    forecast AS (
        SELECT s.sku_id, CAST(step AS INTEGER) AS step, CAST(last_day + CAST(step AS INTEGER) * INTERVAL 1 DAY AS TIMESTAMP) AS "timestamp", s.demand_qty AS yhat
        FROM (SELECT unnest(generate_series(1, 17)) AS step) t JOIN season s ON s.place = (t.step - 1) % 7 JOIN last_days l ON l.sku_id = s.sku_id
    )
"""

# --- barrier ------------------------------------------------------------------------------------


def _by_event(n: int, *cases: str) -> Column:
    """The k-th text for event_id % n = k; null for the others."""
    out = F.lit(None).cast("string")
    for k, text in enumerate(cases):
        out = F.when(F.col("event_id") % n == k, F.lit(text)).otherwise(out)
    return out


def _dirty(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return events.select(
        F.when(F.col("event_id") % 13 == 0, F.lit("   ")).otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit("\t"))).alias("sku_id"),
        F.coalesce(_by_event(10, " ", "2024-02-30", "2024-10-01T10:00:00Z"), F.date_format("ts", "yyyy-MM-dd")).alias("timestamp"),
        F.coalesce(_by_event(7, "abc", "-1", "nan"), F.floor(F.abs("value")).cast("string")).alias("demand_qty"),
        F.coalesce(_by_event(11, "1.5", "0", "x"), (F.col("event_id") % 5 + 1).cast("string")).alias("lead_time_days"),
        F.col("event_id").alias(ROW_INDEX),
    )


DIRTY = """
    dirty AS (
        SELECT event_id AS row_index,
               CASE WHEN event_id % 13 = 0 THEN '   ' ELSE ' ' || CAST(user_id AS VARCHAR) || chr(9) END AS sku_id,
               CASE event_id % 10 WHEN 0 THEN ' ' WHEN 1 THEN '2024-02-30' WHEN 2 THEN '2024-10-01T10:00:00Z' ELSE strftime(ts, '%Y-%m-%d') END AS stamp,
               CASE event_id % 7 WHEN 0 THEN 'abc' WHEN 1 THEN '-1' WHEN 2 THEN 'nan' ELSE CAST(CAST(floor(abs(value)) AS BIGINT) AS VARCHAR) END AS demand_qty,
               CASE event_id % 11 WHEN 0 THEN '1.5' WHEN 1 THEN '0' WHEN 2 THEN 'x' ELSE CAST(event_id % 5 + 1 AS VARCHAR) END AS lead_time_days
        FROM events
    ),
    judged AS (
        SELECT *, CASE
            WHEN trim(stamp) = '' THEN 1 WHEN stamp LIKE '%Z' THEN 2 WHEN TRY_CAST(stamp AS TIMESTAMP) IS NULL THEN 3
            WHEN TRY_CAST(demand_qty AS DOUBLE) IS NULL THEN 4 WHEN TRY_CAST(demand_qty AS DOUBLE) < 0 THEN 5
            WHEN TRY_CAST(lead_time_days AS DOUBLE) IS NULL THEN 6 WHEN CAST(lead_time_days AS DOUBLE) <> floor(CAST(lead_time_days AS DOUBLE)) THEN 7
            WHEN CAST(lead_time_days AS DOUBLE) < 1 THEN 8 WHEN demand_qty = 'nan' THEN 9 WHEN trim(sku_id, ' ' || chr(9)) = '' THEN 10 END AS prio
        FROM dirty
    ),
    violations AS (
        SELECT row_index, CAST(prio AS INTEGER) AS prio,
               CASE WHEN prio <= 3 THEN 'timestamp' WHEN prio <= 5 THEN 'demand_qty' WHEN prio <= 8 THEN 'lead_time_days' END AS "column",
               CASE WHEN prio <= 3 THEN stamp WHEN prio <= 5 THEN demand_qty WHEN prio <= 8 THEN lead_time_days END AS raw_value
        FROM judged WHERE prio IS NOT NULL
    )
"""


def barrier_violations(spark, sf_dir):
    return barrier.violations(_dirty(spark, sf_dir)).drop("message")


def barrier_first_violation(spark, sf_dir):
    return barrier.first_violation(_dirty(spark, sf_dir)).drop("message")


def typed_observations(spark, sf_dir):
    return barrier.accepted(barrier.judged(_dirty(spark, sf_dir))).withColumnRenamed(ROW_INDEX, "row_index")


def stream_barrier(spark, sf_dir):
    """The same rows through Structured Streaming, over everything there is now."""
    path, out, state = (new_path(spark, n) for n in ("dirty", "accepted", "state"))
    _dirty(spark, sf_dir).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    accepted, _ = split_stream(stream)
    accepted.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(accepted.schema).parquet(out).withColumnRenamed(ROW_INDEX, "row_index")


def stream_daily_totals(spark, sf_dir):
    """Shipped quantities by supplier and day through Structured Streaming, over everything there is now."""
    path, out, state = (new_path(spark, n) for n in ("lines", "totals", "state"))
    lines = _table(spark, sf_dir, "lineitem")
    lines.select(F.col("l_suppkey").cast("string").alias("sku_id"), F.col("l_shipdate").alias("timestamp"), F.col("l_quantity").alias("demand_qty"), F.col("l_linenumber").alias("lead_time_days")).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    totals = daily_totals(stream)
    kept = totals.writeStream.outputMode("complete").option("checkpointLocation", state).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    kept.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(totals.schema).parquet(out).withColumn("day", F.col("day").cast("timestamp_ntz"))


def duplicate_keys(spark, sf_dir):
    days = _table(spark, sf_dir, "events").select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_id")
    return barrier.duplicate_keys(days, ["user_id", "day"], "event_id")


def sku_strip(spark, sf_dir):
    return _dirty(spark, sf_dir).select(F.col(ROW_INDEX).alias("row_index"), parsing.strip(F.col("sku_id")).alias("sku_id"))


def timestamp_iso_parse(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    text = F.coalesce(
        F.when(F.col("event_id") % 8 == 5, F.date_format("ts", "yyyyMMdd"))
        .when(F.col("event_id") % 8 == 6, F.date_format("ts", "yyyy/MM/dd"))
        .when(F.col("event_id") % 8 == 7, F.date_format("ts", "yyyyMMdd'T'HHmmss")),
        _by_event(8, "", "2024-02-30", "+2024-10-01", "2024-10-01T10:00:00+05:30"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
    )
    return events.select("event_id", parsing.to_day(text).alias("day"))


def demand_parse(spark, sf_dir):
    text = F.coalesce(_by_event(12, "1_000", "1d", "1e3", ".5", "5.", "inf", "", "1__0", "+2", "0x10"), F.col("event_id").cast("string"))
    return _table(spark, sf_dir, "events").select("event_id", parsing.to_double(text).alias("demand_qty"))


def lead_parse(spark, sf_dir):
    text = F.coalesce(_by_event(7, "17.0", "1e3", "1.5", "inf", "x"), (F.col("event_id") % 9).cast("string"))
    value = parsing.to_double(text)
    return _table(spark, sf_dir, "events").select("event_id", F.when(parsing.whole_number(value) & (value >= 1), value).try_cast("bigint").alias("lead_time_days"))


# --- sources ------------------------------------------------------------------------------------


def file_sha256(spark, sf_dir):
    """Every table's file with its hash; the files of a table that is a folder go by that folder's name
    and their own."""
    name = F.regexp_extract("path", r"([^/]+\.parquet/.+|[^/]+)$", 0)
    return csv_files.sha256_of_files(spark, f"{sf_dir}/*.parquet").select(name.alias("file"), "sha256")


def csv_text_extract(spark, sf_dir):
    """Events as a CSV of the raw zone, with quotes, commas, line breaks and empty fields, extracted:
    every column text, in file order."""
    root = _local_root(spark, "extract")
    note = F.when(F.col("event_id") % 5 == 0, F.lit('a "quoted", line\nbreak')).when(F.col("event_id") % 5 == 1, F.lit("")).when(F.col("event_id") % 5 == 2, F.lit(" NA ")).otherwise(F.col("event_type"))
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props", note.alias("note")).orderBy("event_id")
    parts = root / "written"
    rows.coalesce(1).write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(str(parts))
    source = deposit_raw_csv(next(parts.glob("*.csv")).rename(root / "events.csv"), data_root=root)
    return csv_files.extract_csv(spark, source, data_root=root).frame.withColumnRenamed(ROW_INDEX, "row_index")


# --- extensions ---------------------------------------------------------------------------------


def demand_classes(spark, sf_dir):
    found = diagnostics.demand_classes(_panel(spark, sf_dir))
    return found.withColumn("adi", F.round("adi", 6)).withColumn("cv2", F.round("cv2", 6))


def forecast_errors(spark, sf_dir):
    train, test = diagnostics.holdout(_panel(spark, sf_dir), 14)
    errors = diagnostics.forecast_errors(test, forecast.seasonal_naive(train, 14), train)
    return errors.select("sku_id", "n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "smape", "mase")])


def diebold_mariano(spark, sf_dir):
    train, test = diagnostics.holdout(_panel(spark, sf_dir), 14)
    weekly, daily = forecast.seasonal_naive(train, 14), forecast.seasonal_naive(train, 14, 1)
    found = diagnostics.diebold_mariano(weekly, daily, test)
    return found.withColumn("dm", F.round("dm", 6))


HOLDOUT = f"""{PANEL},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY "timestamp" DESC) AS back FROM panel),
    test AS (SELECT *, 15 - back AS step FROM ranked WHERE back <= 14),
    train AS (SELECT *, back - 14 AS rank, count(*) OVER (PARTITION BY sku_id) AS n FROM ranked WHERE back > 14),
    both_ AS (
        SELECT t.sku_id, t.demand_qty AS y, w.demand_qty AS y7, d.demand_qty AS y1
        FROM test t JOIN train w ON w.sku_id = t.sku_id AND w.n >= 7 AND w.rank = 7 - (t.step - 1) % 7 JOIN train d ON d.sku_id = t.sku_id AND d.rank = 1
    ),
    scales AS (SELECT sku_id, avg(d) AS scale FROM (SELECT sku_id, abs(demand_qty - lag(demand_qty, 7) OVER (PARTITION BY sku_id ORDER BY "timestamp")) AS d FROM train) GROUP BY sku_id)
"""

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        resample_daily,
        canonical_projection,
        header_sample,
        case_insensitive_resolve,
        observations_daily,
        grid_bounds,
        daily_grid,
        grid_left_join,
        zero_fill_demand,
        gap_count_per_sku,
        lead_ffill,
        lead_bfill,
        semantic_pipeline,
        resample_daily_general,
        continuity_check,
        panel_union,
        panel_parquet_roundtrip,
        panel_output_order,
        last_season,
        seasonal_naive_forecast,
        seasonal_naive_per_sku,
        barrier_violations,
        barrier_first_violation,
        typed_observations,
        stream_barrier,
        stream_daily_totals,
        duplicate_keys,
        sku_strip,
        timestamp_iso_parse,
        demand_parse,
        lead_parse,
        file_sha256,
        csv_text_extract,
        demand_classes,
        forecast_errors,
        diebold_mariano,
    )
}

_COLUMNS = ", ".join(f'"{c}"' for c in CANONICAL)
_TYPED = f"""WITH {DIRTY} SELECT trim(sku_id, ' ' || chr(9)) AS sku_id, CAST(stamp AS TIMESTAMP) AS "timestamp", CAST(demand_qty AS DOUBLE) AS demand_qty,
    CAST(lead_time_days AS BIGINT) AS lead_time_days, row_index FROM judged WHERE prio IS NULL"""

ORACLE_SQL: dict[str, str] = {
    "canonical_projection": 'SELECT l_suppkey AS sku_id, l_shipdate AS "timestamp", l_quantity AS demand_qty, l_linenumber AS lead_time_days FROM lineitem',
    "header_sample": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5",
    "case_insensitive_resolve": "SELECT * FROM (VALUES ('l_quantity', 'l_quantity'), ('L_QUANTITY', 'l_quantity'), ('L_ShipDate', 'l_shipdate')) t(wanted, found)",
    "observations_daily": OBSERVATIONS,
    "grid_bounds": f"{GRID} SELECT * FROM bounds",
    "daily_grid": f"{GRID} SELECT * FROM grid",
    "grid_left_join": f"{PANEL} SELECT * FROM joined",
    "zero_fill_demand": f'{PANEL} SELECT sku_id, "timestamp", coalesce(demand_qty, 0.0) AS demand_qty FROM joined',
    "gap_count_per_sku": f"{PANEL} SELECT sku_id, count(demand_qty) AS observed, count(*) AS days, count(*) FILTER (WHERE demand_qty IS NULL) AS gaps FROM joined GROUP BY sku_id",
    "lead_ffill": f'WITH {HOLES} SELECT sku_id, "timestamp", last_value(lead_time_days IGNORE NULLS) OVER (PARTITION BY sku_id ORDER BY "timestamp" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lead_time_days FROM holes',
    "lead_bfill": f"""WITH {HOLES} SELECT sku_id, "timestamp", coalesce(
        last_value(lead_time_days IGNORE NULLS) OVER (PARTITION BY sku_id ORDER BY "timestamp" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(lead_time_days IGNORE NULLS) OVER (PARTITION BY sku_id ORDER BY "timestamp" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS lead_time_days FROM holes""",
    "resample_daily": f"{PANEL} SELECT {_COLUMNS} FROM panel",
    "semantic_pipeline": f"{PANEL} SELECT {_COLUMNS} FROM panel",
    "resample_daily_general": f"{PANEL} SELECT {_COLUMNS} FROM panel",
    "continuity_check": f'{PANEL} SELECT count(*) AS broken FROM (SELECT "timestamp" - lag("timestamp") OVER (PARTITION BY sku_id ORDER BY "timestamp") AS step FROM panel) WHERE step <> INTERVAL 1 DAY',
    "panel_union": f"{PANEL} SELECT {_COLUMNS} FROM panel WHERE demand_qty > 0 UNION ALL SELECT {_COLUMNS} FROM panel WHERE demand_qty = 0",
    "panel_parquet_roundtrip": f"{PANEL} SELECT {_COLUMNS} FROM panel",
    "last_season": f'{FORECAST} SELECT sku_id, "timestamp", demand_qty, place FROM season',
    "seasonal_naive_forecast": f"{FORECAST} SELECT * FROM forecast",
    "seasonal_naive_per_sku": f"{FORECAST} SELECT * FROM forecast",
    "barrier_violations": f"WITH {DIRTY} SELECT * FROM violations",
    "barrier_first_violation": f"WITH {DIRTY} SELECT * FROM violations ORDER BY row_index LIMIT 1",
    "typed_observations": _TYPED,
    "stream_barrier": _TYPED,
    "duplicate_keys": "SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n, min(event_id) AS first_row FROM events GROUP BY 1, 2 HAVING count(*) > 1",
    "sku_strip": f"WITH {DIRTY} SELECT row_index, trim(sku_id, ' ' || chr(9)) AS sku_id FROM dirty",
    "timestamp_iso_parse": "SELECT event_id, CASE WHEN event_id % 8 >= 4 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) END AS day FROM events",
    "demand_parse": """SELECT event_id, CASE event_id % 12 WHEN 0 THEN 1000.0 WHEN 1 THEN NULL WHEN 2 THEN 1000.0 WHEN 3 THEN 0.5 WHEN 4 THEN 5.0 WHEN 5 THEN CAST('inf' AS DOUBLE)
        WHEN 6 THEN NULL WHEN 7 THEN NULL WHEN 8 THEN 2.0 WHEN 9 THEN NULL ELSE CAST(event_id AS DOUBLE) END AS demand_qty FROM events""",
    "lead_parse": "SELECT event_id, CAST(CASE event_id % 7 WHEN 0 THEN 17 WHEN 1 THEN 1000 WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE nullif(event_id % 9, 0) END AS BIGINT) AS lead_time_days FROM events",
    "csv_text_extract": r"""SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, coalesce(event_type, '') AS event_type, coalesce(props, '') AS props,
        CASE event_id % 5 WHEN 0 THEN 'a "quoted", line' || chr(10) || 'break' WHEN 1 THEN '' WHEN 2 THEN ' NA ' ELSE coalesce(event_type, '') END AS note,
        row_number() OVER (ORDER BY event_id) - 1 AS row_index FROM events""",
    "file_sha256": "SELECT regexp_extract(filename, '[^/]+$') AS file, sha256(content) AS sha256 FROM read_blob('/root/testdata/sf0.01/*.parquet')",
    "stream_daily_totals": "SELECT CAST(l_suppkey AS VARCHAR) AS sku_id, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS day, sum(l_quantity) AS demand_qty, max(l_linenumber) AS lead_time_days FROM lineitem GROUP BY 1, 2",
    "panel_output_order": f'{PANEL} SELECT {_COLUMNS}, row_number() OVER (ORDER BY sku_id, "timestamp") - 1 AS place FROM panel',
    "demand_classes": f"""{PANEL}, stats AS (
        SELECT sku_id, count(*) AS days, count(*) FILTER (WHERE demand_qty > 0) AS active, avg(demand_qty) FILTER (WHERE demand_qty > 0) AS m, var_pop(demand_qty) FILTER (WHERE demand_qty > 0) AS v FROM panel GROUP BY sku_id
    ) SELECT sku_id, days, active, round(days / active, 6) AS adi, round(v / (m * m), 6) AS cv2,
        CASE WHEN active = 0 THEN 'no demand' WHEN days / active >= 1.32 AND v / (m * m) >= 0.49 THEN 'lumpy' WHEN days / active >= 1.32 THEN 'intermittent' WHEN v / (m * m) >= 0.49 THEN 'erratic' ELSE 'smooth' END AS class FROM stats""",
    "forecast_errors": f"""{HOLDOUT} SELECT b.sku_id, count(*) AS n, round(avg(abs(y - y7)), 6) AS mae, round(sqrt(avg((y - y7) ^ 2)), 6) AS rmse,
        round(avg(coalesce(2 * abs(y - y7) / nullif(abs(y) + abs(y7), 0), 0)), 6) AS smape, round(avg(abs(y - y7)) / nullif(any_value(scale), 0), 6) AS mase
        FROM both_ b LEFT JOIN scales s ON s.sku_id = b.sku_id GROUP BY b.sku_id""",
    "diebold_mariano": f"""{HOLDOUT}, losses AS (SELECT sku_id, (y - y7) ^ 2 - (y - y1) ^ 2 AS d FROM both_)
        SELECT sku_id, count(*) AS n, round(avg(d) / sqrt(nullif(var_pop(d), 0) / count(*)) * sqrt((count(*) - 1) / count(*)), 6) AS dm FROM losses GROUP BY sku_id""",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_daily(spark, sf_dir)
