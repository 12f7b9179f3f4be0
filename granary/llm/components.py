"""Connected components of a graph given by its edges, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, written

#: Parts that the rows of one key are dealt into where a key may hold very many.
SALTS = 8


def spread_join(rows: DataFrame, by_key: DataFrame, key: str, spread: str) -> DataFrame:
    """rows joined with by_key, which has one row for each `key`: the rows of a key are dealt into
    SALTS tasks by their column `spread`, and each meets a copy of the key's row."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = by_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def connected_components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(node, label) for every node of `edges` (a long, b long); label is the least node reachable.

    Every round lowers each label to the least among the neighbours' and then to its label's own
    label, so long chains shorten by half; rounds are written to the shared folder, each in place of
    the one before, and end when nothing changes.  Loops and repeated edges are allowed; no edges,
    no rows.  Joins on a hub or a label, which may have very many rows, are spread.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), name)
    while True:
        near = spread_join(both, labels.select(F.col("node").alias("b"), "label"), "b", "a").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        lows = lower.select("low").distinct()
        jump = lower.join(lows.withColumnRenamed("low", "node"), "node", "left_semi").select(F.col("node").alias("low"), F.col("low").alias("next"))
        jumped = spread_join(lower, jump, "low", "node").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved"))
        now = written(jumped, name)
        drop_written(labels)
        labels = now
        if now.filter("moved").isEmpty():
            drop_written(both)
            return labels
