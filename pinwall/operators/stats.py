"""Order statistics by the rules that the raster and layout operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(counts: DataFrame, by: list[str], value: str, count: str, shares: list[float]) -> DataFrame:
    """by, p, value: the value at index round(p * (n - 1)) (halves up) of each group's sorted values.

    counts has a row for each group and distinct value with its number, so that a group of any
    number of rows is a short list of distinct values; neither of Spark's percentile functions
    follows this rule.
    """
    order = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    rows = counts.withColumn("_hi", F.sum(count).over(order)).withColumn("_n", F.sum(count).over(whole))
    rows = rows.withColumn("p", F.explode(F.array(*(F.lit(float(s)) for s in shares))))
    index = F.floor(F.col("p") * (F.col("_n") - 1) + 0.5)
    return rows.where((index < F.col("_hi")) & (index >= F.col("_hi") - F.col(count))).select(*by, "p", F.col(value).alias("value"))


def upper_median(values):
    """sorted[n div 2] of an array column; 0 for an empty one."""
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int")))
