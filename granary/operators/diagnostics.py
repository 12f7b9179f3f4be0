"""Extensions beyond the ingestion path: demand classes, forecast errors and their comparison.

Published methods: demand classes by Syntetos, Boylan and Croston (2005); MASE by Hyndman and
Koehler (2006); the Diebold-Mariano test (1995) with the correction of Harvey, Leybourne and
Newbold (1997).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The published cut-offs.
ADI_LIMIT, CV2_LIMIT = 1.32, 0.49


def demand_classes(panel: DataFrame) -> DataFrame:
    """ADI (days per day with demand), CV2 of the demand sizes, and the class of each SKU."""
    sizes = F.when(F.col("demand_qty") > 0, F.col("demand_qty"))
    stats = panel.groupBy("sku_id").agg(F.count("*").alias("days"), F.count(sizes).alias("active"), F.avg(sizes).alias("mean"), F.var_pop(sizes).alias("var"))
    measured = stats.select("sku_id", "days", "active", F.try_divide(F.col("days"), F.col("active")).alias("adi"), F.try_divide("var", F.col("mean") * F.col("mean")).alias("cv2"))
    rare, uneven = F.col("adi") >= ADI_LIMIT, F.col("cv2") >= CV2_LIMIT
    kind = F.when(F.col("active") == 0, "no demand").when(rare & uneven, "lumpy").when(rare, "intermittent").when(uneven, "erratic").otherwise("smooth")
    return measured.withColumn("class", kind)


def holdout(panel: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    """The panel without, and with only, the last `horizon` days of each SKU."""
    back = F.row_number().over(W.partitionBy("sku_id").orderBy(F.desc("timestamp")))
    ranked = panel.withColumn("_back", back)
    return ranked.filter(F.col("_back") > horizon).drop("_back"), ranked.filter(F.col("_back") <= horizon).drop("_back")


def forecast_errors(actual: DataFrame, forecast: DataFrame, history: DataFrame, season_length: int = 7) -> DataFrame:
    """MAE, RMSE, sMAPE and MASE of each SKU; MASE is null where the history has no error of its own."""
    season = F.lag("demand_qty", season_length).over(W.partitionBy("sku_id").orderBy("timestamp"))
    scale = history.withColumn("_d", F.abs(F.col("demand_qty") - season)).groupBy("sku_id").agg(F.avg("_d").alias("scale"))
    error = F.col("demand_qty") - F.col("yhat")
    joined = actual.join(forecast.select("sku_id", "timestamp", "yhat"), ["sku_id", "timestamp"])
    size = F.abs(F.col("demand_qty")) + F.abs(F.col("yhat"))
    errors = joined.groupBy("sku_id").agg(
        F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.coalesce(F.try_divide(2 * F.abs(error), size), F.lit(0.0))).alias("smape"),
    )
    return errors.join(scale, "sku_id", "left").withColumn("mase", F.try_divide("mae", F.when(F.col("scale") > 0, F.col("scale")))).drop("scale")


def diebold_mariano(first: DataFrame, second: DataFrame, actual: DataFrame) -> DataFrame:
    """One-step Diebold-Mariano statistic of squared errors by SKU, corrected for small samples;
    negative where the first forecast is better, null where the losses never differ."""
    both = actual.join(first.select("sku_id", "timestamp", F.col("yhat").alias("y1")), ["sku_id", "timestamp"]).join(second.select("sku_id", "timestamp", F.col("yhat").alias("y2")), ["sku_id", "timestamp"])
    loss = F.pow(F.col("demand_qty") - F.col("y1"), 2) - F.pow(F.col("demand_qty") - F.col("y2"), 2)
    stats = both.withColumn("_d", loss).groupBy("sku_id").agg(F.count("*").alias("n"), F.avg("_d").alias("mean"), F.var_pop("_d").alias("var"))
    plain = F.try_divide("mean", F.sqrt(F.when(F.col("var") > 0, F.col("var") / F.col("n"))))
    return stats.select("sku_id", "n", (plain * F.sqrt((F.col("n") - 1) / F.col("n"))).alias("dm"))
