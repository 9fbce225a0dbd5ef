"""Filters, labels and checks that account for what they drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.sources.tables import stored

from .selection import Values


def number(text: Column) -> Column:
    """Text with thousands separators as a double, null where it is none."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def robust_bounds(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Median m and scaled median absolute deviation s of ln(value) for each group (keys may be empty); exact, and
    no task has a whole group."""
    logs = Values(df.where(F.col(value) > 0), keys, F.ln(value))
    centre = stored(logs.percentiles({"__m": 0.5}))  # one row a group
    beside = lambda rows: rows.join(centre, keys) if keys else rows.crossJoin(centre)
    # The deviations follow from the counted values; df is not read again.
    spread = Values(beside(logs.each), keys, F.abs(F.col("__v") - F.col("__m")), "__w").percentiles({"__s": 0.5})
    return stored(beside(spread.withColumn("__s", F.col("__s") * 1.4826)))


def robust_filter(df: DataFrame, value: str, keys: list[str] | None = None, limit: float = 4.0) -> DataFrame:
    """Rows whose ln(value) lies within ``limit`` robust deviations of the median; with no spread, no row."""
    keys = keys or []
    bounds = robust_bounds(df, value, keys)  # one row for each group; the planner broadcasts it where its size allows
    joined = df.join(bounds, keys) if keys else df.crossJoin(bounds)
    return joined.where(F.try_divide(F.abs(F.ln(value) - F.col("__m")), F.col("__s")) <= limit).drop("__m", "__s")


def staged_reject(rules: dict[str, Column]) -> Column:
    """Name of the first rule that a row breaks (rule: the condition that must hold), else null."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules.items()):
        out = F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def reject_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(reason, rows) with ``kept`` for rows that break no rule, from one pass."""
    return df.select(F.coalesce(staged_reject(rules), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


def label(cases: list[tuple[Column, str]], default: str) -> Column:
    """First case that holds."""
    out = F.lit(default)
    for condition, name in reversed(cases):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def layer(df: DataFrame, keys: list[str], columns: list[str], suffix: str) -> DataFrame:
    """Keys and those of columns that df has, renamed with the period's suffix."""
    return df.select(*keys, *[F.col(c).alias(f"{c}_{suffix}") for c in columns if c in df.columns])


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with consecutive numbers from 1 in a total order. Rows are numbered within the ranges of a range
    partitioning, which is written once so that its ranges are the same for counting and numbering."""
    ranged = stored(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    base = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__base"))  # one row for each range
    out = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order))).join(base, "__p")
    return out.withColumn(name, F.col("__base") + F.col("__r")).drop("__p", "__r", "__base")


def surrogate_key(df: DataFrame, order: list[str], prefix: str) -> DataFrame:
    """Consecutive keys such as D21-00001 in a total order."""
    return numbered(df, order, "__i").withColumn("key", F.format_string(f"{prefix}-%05d", F.col("__i"))).drop("__i")


def expectations(df: DataFrame, unique: list[str], rules: dict[str, Column]) -> DataFrame:
    """(check, failures) for a unique key and row conditions."""
    repeated = df.groupBy(*unique).count().where("count > 1").agg(F.count("*").alias("failures")).select(F.lit("unique").alias("check"), "failures")
    row_rules = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return repeated.unionByName(row_rules.unpivot([], list(rules), "check", "failures"))
