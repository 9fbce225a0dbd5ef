"""Comparisons between periods, classes and similar units."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import Values


def growth(df: DataFrame, unit: str, period: str, value: str) -> DataFrame:
    """df with ``previous`` and ``growth`` against the period just before; null where that one is missing."""
    w = Window.partitionBy(unit).orderBy(period)
    before = F.when(F.lag(period).over(w) == F.col(period) - 1, F.lag(value).over(w))
    return df.withColumn("previous", before).withColumn("growth", F.try_divide(F.col(value), F.col("previous")) - 1)


def class_breaks(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """Nearest-rank breaks v[floor(i * n / k)] of each group, repeated ones once, ascending. Ranks come from counts of
    lesser values, so a group of any size is in no one place."""
    placed = Values(df, keys, value).placed().withColumn("__v", F.col("__v").cast(df.schema[value].dataType))
    rank = lambda i: F.least(F.col("__total") - 1, F.floor(i * F.col("__total") / k))
    held = F.exists(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: (rank(i) >= F.col("__before")) & (rank(i) < F.col("__before") + F.col("__w")))
    return placed.where(held).groupBy(*keys).agg(F.sort_array(F.collect_set("__v")).alias("breaks"))  # fewer than k


def class_of(value: Column, breaks: Column) -> Column:
    """How many breaks are at most the value."""
    return F.when(value.isNotNull(), F.size(F.filter(breaks, lambda b: b <= value)))


def similar_units(df: DataFrame, unit: str, group: str, value: str, size: str, within: float = 0.07, k: int = 8, levels: int = 14) -> DataFrame:
    """For each unit the k largest of other groups whose value is within a share of its own: unit, similar, rank.

    Values are put in logarithmic bins, on ``levels`` levels of half the width each. A unit's range is parted into
    bins that lie wholly inside it, a few of the widest and at most two of each finer level; of such a bin only the
    2 k largest units, at most k of a group, can be among the answers. What is left at both ends of the range is
    two bins of the finest level, which are searched whole. So a unit meets a bounded number of others, however
    many have values like its own."""
    wide = (math.log1p(within) - math.log1p(-within)) / 4
    width = [wide / 2**j for j in range(levels)]
    units = df.where(F.col(value) > 0).select(F.col(unit).alias("unit"), F.col(group).alias("g"), F.col(value).cast("double").alias("v"), F.col(size).alias("s"), F.ln(value).alias("l"))
    bins = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.floor(F.col("l") / width[j]).alias("b")) for j in range(levels)]))
    other = units.select(F.col("unit").alias("similar"), F.col("g").alias("h"), F.col("v").alias("u"), "s", bins.alias("x")).select("similar", "h", "u", "s", "x.j", "x.b")
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("s").desc(), "similar"))
    lists = other.withColumn("i", best("j", "b", "h")).where(F.col("i") <= k).withColumn("i", best("j", "b")).where(F.col("i") <= 2 * k).drop("i")
    lo, hi = F.col("l") + math.log1p(-within), F.col("l") + math.log1p(within)
    first, stop = [F.floor(lo / w) + 1 for w in width], [F.floor(hi / w) for w in width]  # bins wholly inside: first .. stop - 1
    none = F.array().cast("array<struct<j:int,b:bigint>>")
    one = lambda j, b, when: F.when(when, F.array(F.struct(F.lit(j).alias("j"), b.alias("b")))).otherwise(none)
    inside = [F.transform(F.sequence(first[0], stop[0] - 1), lambda b: F.struct(F.lit(0).alias("j"), b.alias("b")))]
    for j in range(1, levels):
        inside += [one(j, first[j], first[j] < 2 * first[j - 1]), one(j, stop[j] - 1, stop[j] > 2 * stop[j - 1])]
    asked = units.select("unit", "g", "v", F.explode(F.concat(*inside)).alias("x")).select("unit", "g", "v", "x.*")
    ends = units.select("unit", "g", "v", F.lit(levels - 1).alias("j"), F.explode(F.array_distinct(F.array(first[-1] - 1, stop[-1]))).alias("b"))
    near = asked.join(lists, ["j", "b"]).unionByName(ends.join(other.where(F.col("j") == levels - 1), ["j", "b"]))
    near = near.where((F.abs(F.col("u") / F.col("v") - 1) < within) & (F.col("g") != F.col("h"))).select("unit", "similar", "s").distinct()
    rank = F.row_number().over(Window.partitionBy("unit").orderBy(F.col("s").desc(), "similar"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("unit", "similar", "rank")


def afford_class(price: Column, budget: Column, stretch: float = 1.2) -> Column:
    """0 within the budget, 1 within stretch times it, 2 above."""
    return F.when(price <= budget, 0).when(price <= budget * stretch, 1).when(price.isNotNull(), 2)


def waterfall(df: DataFrame, keys: list[str], order: str, log_step: str, start: float) -> DataFrame:
    """Contribution of each factor in money at its place in the chain."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    after = F.lit(start) * F.exp(F.sum(log_step).over(w))
    return df.withColumn("after", after).withColumn("contribution", F.col("after") - F.col("after") / F.exp(log_step))


def last_in_period(df: DataFrame, keys: list[str], t: str, values: list[str]) -> DataFrame:
    """The last known value of each column within its keys (such as a year), and where it stands."""
    return df.groupBy(*keys).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(t))).alias(v) for v in values], *[F.max(F.when(F.col(v).isNotNull(), F.col(t))).alias(f"{v}_t") for v in values])


def since_first(unit: str, t: str, value: str) -> Column:
    """Change since the unit's first known value."""
    first = F.first(value, ignorenulls=True).over(Window.partitionBy(unit).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.try_divide(F.col(value), first) - 1


def trailing(unit: str, t: str, value: str, steps: int) -> Column:
    """The values of the last ``steps`` steps up to each row, oldest first; a gap has none."""
    return F.collect_list(value).over(Window.partitionBy(unit).orderBy(t).rangeBetween(-(steps - 1), 0))


def jumps(df: DataFrame, unit: str, t: str, value: str, most: float) -> DataFrame:
    """Rows that changed by more than a share ``most`` against the step just before; not across gaps."""
    w = Window.partitionBy(unit).orderBy(t)
    change = F.when(F.col(t) - F.lag(t).over(w) == 1, F.try_divide(F.col(value), F.lag(value).over(w)) - 1)
    return df.withColumn("change", change).where(F.abs("change") > most)


def matches(query: str, *names: Column, number: Column | None = None) -> Column:
    """Whether any name holds the query, letters in either case; or, given a number, whether the query is it."""
    out = F.lit(False)
    for n in names:
        out = out | F.coalesce(F.contains(F.lower(n), F.lit(query.lower())), F.lit(False))
    return out if number is None or not query.strip().isdigit() else out | F.coalesce(number == int(query), F.lit(False))


def value_in(df: DataFrame, unit: str, period: str, value: str, wanted: DataFrame) -> DataFrame:
    """wanted (unit, period) with the value of just that period, null where it has none; never carried over."""
    return wanted.join(df.select(unit, period, value), [unit, period], "left")


def ladder(df: DataFrame, unit: str, period: str, value: str, at: int, before: int) -> DataFrame:
    """Units by their value at one period, nulls last, with place, how many are ranked, the value of the period
    before and the change. place is null for units without a value."""
    now = df.where(F.col(period) == at).select(unit, F.col(value).alias("now"))
    then = df.where(F.col(period) == before).select(unit, F.col(value).alias("then"))
    every = df.select(unit).distinct().join(now, unit, "left").join(then, unit, "left")
    w = Window.partitionBy(F.lit(0))  # a list of units
    place = F.when(F.col("now").isNotNull(), F.rank().over(w.orderBy(F.col("now").desc_nulls_last())))
    return every.withColumn("place", place).withColumn("ranked", F.count("now").over(w)).withColumn("change", F.try_divide(F.col("now"), F.col("then")) - 1)


def history(df: DataFrame, unit: str, periods: dict[str, int], selected: int) -> DataFrame:
    """A wide row of a unit (a column for each period) as rows (unit, period, value, selected)."""
    long = df.unpivot([unit], list(periods), "c", "value")
    number = F.element_at(F.create_map(*[F.lit(x) for p in periods.items() for x in p]), F.col("c"))
    return long.select(unit, number.alias("period"), "value", (number == selected).alias("selected"))


def money_matrix(budgets: DataFrame, places: DataFrame, price: str, level: str, roll: str) -> DataFrame:
    """What each budget buys at each place's level rolled forward: a row for each of both, so budgets
    should be the few that are asked for and places a reference table."""
    return budgets.crossJoin(places).withColumn("buys", F.try_divide(F.col(price), F.col(level) * (1 + F.col(roll))))
