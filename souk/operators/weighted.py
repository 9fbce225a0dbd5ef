"""Weighted statistics over groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .selection import Values


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, qs: dict[str, float], tie: list[str]) -> DataFrame:
    """Midpoint-rule weighted quantiles: with values ascending (ties: heavier first, then by ``tie``), a row
    stands at the running weight less half its own; the quantile is interpolated at q times the total and held
    at both ends. Null values and weights that are null or not positive are ignored; a group without rows left
    gives no row. qs: result column -> q. For groups of members or units; see weighted_quantile_of_many() for others."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.col(weight) > 0))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    order = whole.orderBy(F.col(value), F.col(weight).desc(), *tie).rowsBetween(Window.unboundedPreceding, 0)
    w = F.col(weight).cast("double")
    placed = rows.select(*keys, F.col(value).cast("double").alias("v"), (F.sum(w).over(order) - w / 2).alias("cw"), F.sum(w).over(whole).alias("total"))
    return interpolated(placed, keys, qs)


def interpolated(placed: DataFrame, keys: list[str], qs: dict[str, float]) -> DataFrame:
    """Quantiles of values v that stand at cw of total."""
    out = []
    for name, q in qs.items():
        low, high, cut = F.col("cw") <= q * F.col("total"), F.col("cw") > q * F.col("total"), F.max(q * F.col("total"))
        c0, c1 = F.max(F.when(low, F.col("cw"))), F.min(F.when(high, F.col("cw")))
        v0, v1 = F.max_by("v", F.when(low, F.col("cw"))), F.min_by("v", F.when(high, F.col("cw")))
        out.append(F.when(c0.isNull(), v1).when(c1.isNull(), v0).otherwise(v0 + (v1 - v0) * (cut - c0) / (c1 - c0)).alias(name))
    return placed.groupBy(*keys).agg(*out)


def weighted_quantile_of_many(df: DataFrame, keys: list[str], value: str, weight: str, qs: dict[str, float], per_range: int | None = None) -> DataFrame:
    """weighted_quantile() for groups of any size, such as a whole table (no keys), by selection.Values. Rows of one
    value count as one: the heaviest stands first and the lightest last, and only these two places matter."""
    return Values(df, keys, value, weight, per_range).weighted(qs)


def weighted_mean(value: str, weight: str):
    """Mean weighted by positive weights, nulls skipped; null where nothing is left."""
    ok = F.col(value).isNotNull() & (F.col(weight) > 0)
    return F.try_divide(F.sum(F.when(ok, F.col(value) * F.col(weight))), F.sum(F.when(ok, F.col(weight))))
