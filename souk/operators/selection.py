"""Exact order statistics of groups of any size: many quantiles, groups and columns from one stored structure.

The values of all groups are counted once and stored, one row for each (keys, value). Ranges of about ``PER_RANGE`` of
these rows are cut by an approximate percentile of the distinct values, so also concentrated values are parted. Sums
by range, a small table, tell in which ranges the wanted ranks lie; only those ranges are read again, and a rank is
found within its range. So the input is read once, whatever is asked, and no task sees more than a range of a group.

Groups may overlap: ``copies`` names for each key the groups that its rows count for (all rows, all other folds). They
are formed from the sums of ranges; rows are copied only in the ranges that hold wanted ranks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.sources.tables import stored

#: Rows (values of keys) of a range, and the most ranges, whose cuts are literals of the plan.
PER_RANGE, MOST_RANGES = 200_000, 10_000


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on equal keys, null equal to null; only left's keys stay."""
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    equal = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]) if keys else F.lit(True)
    return left.join(other, equal, how).drop(*[f"__{k}" for k in keys])


class Values:
    """Counted values of df: keys, __v (double), __w (the weight or number of their rows), and the heaviest (``__first``) and
    lightest (``__last``) of these. Null and NaN values are left out, and weights that are null or not positive. ``__before``
    as used below is the weight of a group's lesser values."""

    def __init__(self, df: DataFrame, keys: list[str], value: str | Column, weight: str | Column | None = None, per_range: int | None = None):
        value = F.col(value) if isinstance(value, str) else value
        weight = F.lit(1.0) if weight is None else F.col(weight) if isinstance(weight, str) else weight
        rows = df.select(*keys, value.cast("double").alias("__v"), weight.cast("double").alias("__w")).where(F.col("__v").isNotNull() & ~F.isnan("__v") & (F.col("__w") > 0))
        counted = rows.groupBy(*keys, "__v").agg(F.sum("__w").alias("__w"), F.max("__w").alias("__first"), F.min("__w").alias("__last"))
        self.keys, self.each = keys, self._ranged(stored(counted), per_range or PER_RANGE)

    @staticmethod
    def _ranged(each: DataFrame, per_range: int) -> DataFrame:
        ranges = min(MOST_RANGES, -(-each.count() // per_range))
        if ranges < 2:
            return each.withColumn("__r", F.lit(0.0))
        from pyspark.ml.feature import Bucketizer

        cuts = each.agg(F.percentile_approx("__v", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
        cuts = sorted({c for c in cuts if c - c == 0})  # finite ones
        return Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="__v", outputCol="__r").transform(each) if cuts else each.withColumn("__r", F.lit(0.0))

    def _sums(self, copies: Column | None, out: list[str]) -> DataFrame:
        """(out, __r, __s, __base, __total): weights of ranges, of those before, and of the group."""
        sums = self.each.groupBy(*self.keys, "__r").agg(F.sum("__w").alias("__s"))
        if copies is not None:
            sums = sums.select(F.explode(copies).alias("__c"), "__r", "__s").select("__c.*", "__r", "__s").groupBy(*out, "__r").agg(F.sum("__s").alias("__s"))
        whole = Window.partitionBy(*(out or [F.lit(0)]))  # at most MOST_RANGES rows a group
        return sums.withColumn("__base", F.sum("__s").over(whole.orderBy("__r")) - F.col("__s")).withColumn("__total", F.sum("__s").over(whole))

    def _within(self, rows: DataFrame, out: list[str]) -> DataFrame:
        order = Window.partitionBy(*out, "__r").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("__before", F.col("__base") + F.coalesce(F.sum("__w").over(order), F.lit(0.0)))

    def placed(self) -> DataFrame:
        """All values with __before and __total."""
        sums = self._sums(None, self.keys).select(*self.keys, "__r", "__base", "__total")
        return self._within(joined(self.each, sums, [*self.keys, "__r"]), self.keys).drop("__base", "__r", "__first", "__last")

    def _hit(self, target, copies: Column | None, out: list[str]) -> DataFrame:
        """Values of the ranges whose own or neighbouring range holds one of the targets, with before and total."""
        order = Window.partitionBy(*(out or [F.lit(0)])).orderBy("__r")
        sums = self._sums(copies, out)
        low = F.col("__base") - F.coalesce(F.lag("__s").over(order), F.lit(0.0))
        high = F.col("__base") + F.col("__s") + F.coalesce(F.lead("__s").over(order), F.lit(0.0))
        near = sums.withColumn("__low", low).withColumn("__high", high)
        hits = near.where(F.exists(target(F.col("__total")), lambda t: (t >= F.col("__low")) & (t <= F.col("__high")))).select(*out, "__r", "__base", "__total")
        rows = self.each
        if copies is not None:
            hits = stored(hits)  # few rows, used twice
            rows = rows.join(F.broadcast(hits.select("__r").distinct()), "__r", "left_semi")  # at most MOST_RANGES numbers
            rows = rows.select(F.explode(copies).alias("__c"), "__r", "__v", "__w", "__first", "__last").select("__c.*", "__r", "__v", "__w", "__first", "__last")
        rows = joined(rows, hits, [*out, "__r"])
        if copies is not None:
            rows = rows.groupBy(*out, "__r", "__base", "__total", "__v").agg(F.sum("__w").alias("__w"), F.max("__first").alias("__first"), F.min("__last").alias("__last"))
        return self._within(rows, out)

    def percentiles(self, qs: dict[str, float], copies: Column | None = None, out: list[str] | None = None, n: str | None = None) -> DataFrame:
        """One row a group: for each q the value at rank q * (n - 1) from 0 on, interpolated between the two nearest
        rows; with n, a column of the number of rows. Weights, if any, must be numbers of rows."""
        out = self.keys if copies is None else out
        rows = self._hit(lambda total: F.array(*[F.lit(float(q)) * (total - 1) for q in qs.values()]), copies, out)
        found = []
        for name, q in qs.items():
            rank = F.lit(float(q)) * (F.col("__total") - 1)
            found += [F.max(F.when(F.col("__before") <= edge(rank), F.col("__v"))).alias(f"__{side}_{name}") for side, edge in (("a", F.floor), ("z", F.ceil))]
        sides = rows.groupBy(*out).agg(F.max("__total").alias("__n"), *found)
        made = []
        for name, q in qs.items():
            rank, a, z = F.lit(float(q)) * (F.col("__n") - 1), F.col(f"__a_{name}"), F.col(f"__z_{name}")
            made.append(F.when(a == z, a).otherwise((F.ceil(rank) - rank) * a + (rank - F.floor(rank)) * z).alias(name))
        return sides.select(*out, *made, *([F.col("__n").cast("long").alias(n)] if n else []))

    def weighted(self, qs: dict[str, float], copies: Column | None = None, out: list[str] | None = None) -> DataFrame:
        """One row a group: quantiles by the midpoint rule of weighted_quantile()."""
        out = self.keys if copies is None else out
        rows = self._hit(lambda total: F.array(*[F.lit(float(q)) * total for q in qs.values()]), copies, out)
        ends = F.array(F.struct("__v", (F.col("__before") + F.col("__first") / 2).alias("cw")), F.struct("__v", (F.col("__before") + F.col("__w") - F.col("__last") / 2).alias("cw")))
        from .weighted import interpolated

        return interpolated(rows.select(*out, "__total", F.explode(ends).alias("__e")).select(*out, F.col("__total").alias("total"), F.col("__e.__v").alias("v"), F.col("__e.cw").alias("cw")), out, qs)


def and_all(*keys: str) -> Column:
    """copies for groups by keys beside one of all rows: keys, null where ``all`` is true."""
    own = F.struct(*[F.col(k).alias(k) for k in keys], F.lit(False).alias("all"))
    return F.array(own, F.struct(*[F.when(F.lit(False), F.col(k)).alias(k) for k in keys], F.lit(True).alias("all")))
