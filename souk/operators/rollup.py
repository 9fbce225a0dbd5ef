"""Roll-ups of members into groups and comparisons with the total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.sources.tables import stored

from .selection import Values, joined
from .weighted import weighted_mean, weighted_quantile


def average_rank(value: str, keys: list[str] | None = None) -> Column:
    """Descending rank with ties averaged and cut to an integer."""
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    ties = F.count("*").over(Window.partitionBy(*(keys or [F.lit(0)]), value))
    return F.floor(F.rank().over(w.orderBy(F.col(value).desc())) + (ties - 1) / 2).cast("int")


def competition_rank(value: str, keys: list[str] | None = None) -> Column:
    """1 + the number of greater values; null for null."""
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    return F.when(F.col(value).isNotNull(), F.rank().over(w.orderBy(F.col(value).desc_nulls_last())))


def rollup(df: DataFrame, keys: list[str], member: str, value: str, weight: str, least_weight: float) -> DataFrame:
    """Members, total weight, weighted quartiles, and the dearest, cheapest and heaviest member of each group;
    dearest and cheapest among members of at least least_weight, first by name on ties."""
    big = F.col(weight) >= least_weight
    low = df.groupBy(*keys).agg(F.min(F.when(big, F.struct(F.col(value), F.col(member)))).alias("lo"), F.min(F.when(big, F.struct((-F.col(value)).alias("v"), F.col(member)))).alias("hi"), F.min(F.struct((-F.col(weight)).alias("w"), F.col(member))).alias("most"), F.count("*").alias("members"), F.sum(weight).alias("weight"), F.max(weight).alias("top"))
    flat = low.select(*keys, "members", "weight", F.col(f"lo.{member}").alias("cheapest"), F.col(f"hi.{member}").alias("dearest"), F.col(f"most.{member}").alias("largest"), F.try_divide(F.col("top"), F.col("weight")).alias("largest_share"))
    return flat.join(weighted_quantile(df, keys, value, weight, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, [member]), keys, "left")


def distribution(df: DataFrame, keys: list[str], value: str, shares: dict[str, Column]) -> DataFrame:
    """n, exact quartiles and the shares of rows for which conditions hold."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c.cast("double")).alias(n) for n, c in shares.items()])
    quartiles = Values(df, keys, value).percentiles({"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return joined(out, quartiles, keys, "left").select(*keys, "n", "p25", "p50", "p75", *shares)


def level_with_fallback(df: DataFrame, group: str, member: str, value: str, least: int) -> DataFrame:
    """Group level as the weighted median of its members' medians, over members with ``least`` rows; the median
    of the group's own rows where no member has as many."""
    own = F.struct(F.col(group).alias(group), F.col(member).alias(member), F.lit(False).alias("all"))
    every = F.struct(F.col(group).alias(group), F.when(F.lit(False), F.col(member)).alias(member), F.lit(True).alias("all"))
    found = stored(Values(df, [group, member], value).percentiles({"m": 0.5}, F.array(own, every), [group, member, "all"], n="n"))
    level = weighted_quantile(found.where("not all").where(F.col("n") >= least), [group], "m", "n", {"level": 0.5}, [member])
    direct = found.where("all").select(group, F.col("m").alias("direct"), "n")
    return direct.join(level, group, "left").select(group, "n", F.coalesce("level", "direct").alias("level"), F.col("level").isNotNull().alias("from_members"))


def scope_medians(df: DataFrame, scopes: dict[str, str], columns: list[str]) -> DataFrame:
    """scope, unit, n (values of the first column) and the median of each column, for the units of several scopes
    (scope -> column of the unit, all of one type), from one pass; rows without a unit count in other scopes only."""
    units, kind = list(dict.fromkeys(scopes.values())), df.schema[next(iter(scopes.values()))].dataType
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("__what"), F.col(c).cast("double").alias("__v")) for c in columns]))
    long = df.select(*units, cells.alias("__c")).select(*units, "__c.*")
    copies = F.filter(F.array(*[F.struct(F.col("__what"), F.lit(s).alias("scope"), F.col(u).cast(kind).alias("unit")) for s, u in scopes.items()]), lambda x: x["unit"].isNotNull())
    found = Values(long, ["__what", *units], "__v").percentiles({"m": 0.5}, copies, ["__what", "scope", "unit"], n="n")
    is_ = lambda c: F.col("__what") == c
    return found.groupBy("scope", "unit").agg(F.max(F.when(is_(columns[0]), F.col("n"))).alias("n"), *[F.max(F.when(is_(c), F.col("m"))).alias(c) for c in columns])


def log_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line and correlation of ln y on ln x, with a verdict at 0.3."""
    lx, ly = F.ln(x), F.ln(y)
    out = df.where((F.col(x) > 0) & (F.col(y) > 0)).groupBy(*keys).agg(F.regr_slope(ly, lx).alias("slope"), F.regr_intercept(ly, lx).alias("intercept"), F.corr(lx, ly).alias("r"))
    return out.withColumn("verdict", F.when(F.col("r") < -0.3, "catching up").when(F.col("r") > 0.3, "pulling away").otherwise("mixed"))


def member_table(df: DataFrame, keys: list[str], member: str, value: str, weight: str, least_weight: float, medians: dict[str, str], shares: dict[str, str]) -> DataFrame:
    """rollup() with weighted medians of further columns (result -> column) and weighted means of shares, and
    vs_total and place of the group's median among all."""
    out = rollup(df, keys, member, value, weight, least_weight)
    for name, column in medians.items():
        out = out.join(weighted_quantile(df, keys, column, weight, {name: 0.5}, [member]), keys, "left")
    out = out.join(df.groupBy(*keys).agg(*[weighted_mean(c, weight).alias(n) for n, c in shares.items()]), keys, "left")
    total = weighted_quantile(df, [], value, weight, {"total": 0.5}, [member])  # over members
    return out.crossJoin(total).withColumn("vs_total", F.try_divide(F.col("p50"), F.col("total")) - 1).withColumn("place", average_rank("p50")).drop("total")


def growth_multiple(old: DataFrame, new: DataFrame, key: str, value: str, least: int) -> DataFrame:
    """Units of ``old`` (rows) beside ``new`` (key, later): n, the median of value, a flag for ``least`` rows, and how
    many times the median the later value is, for flagged units only. Units that new lacks stay."""
    early = old.groupBy(key).agg(F.count("*").alias("n"), F.median(value).alias("before"))
    out = early.join(new, key, "left").withColumn("reliable", F.col("n") >= least)
    return out.withColumn("multiple", F.when(F.col("reliable"), F.try_divide(F.col("later"), F.col("before"))))


def coverage(df: DataFrame, matched: Column, weight: str) -> DataFrame:
    """Share of the weight that is matched."""
    return df.agg(F.try_divide(F.sum(F.when(matched, F.col(weight)).otherwise(0)), F.sum(weight)).alias("share"))


def error_interval(df: DataFrame, log_error: str, qs: tuple[float, ...] = (0.1, 0.25, 0.75, 0.9)) -> DataFrame:
    """Quantiles of actual over predicted from log errors (predicted less actual): the tails change places."""
    names = [f"q{round(100 * q)}" for q in qs]
    return Values(df, [], log_error).percentiles(dict(zip(names, (1 - q for q in qs), strict=True))).select(*[F.exp(-F.col(n)).alias(n) for n in names])


def residual_quantiles(df: DataFrame, residual: str, qs: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    return Values(df, [], residual).percentiles({f"q{round(100 * q)}": q for q in qs})


def best_per(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with ``best``: whether the value is the least of its keys."""
    return df.withColumn("best", F.col(value) == F.min(value).over(Window.partitionBy(*keys)))


def positive_shares(df: DataFrame, value: str) -> DataFrame:
    """df with ``share``: values below zero count as none, all shares add up to one."""
    clipped = F.greatest(F.lit(0.0), F.col(value))
    return df.crossJoin(df.agg(F.sum(clipped).alias("__all"))).withColumn("share", F.try_divide(clipped, F.col("__all"))).drop("__all")


def availability(df: DataFrame, period: str, sources: dict[str, Column]) -> DataFrame:
    """For each period which sources have any value."""
    return df.groupBy(period).agg(*[F.coalesce(F.bool_or(c.isNotNull()), F.lit(False)).alias(n) for n, c in sources.items()])


def with_benchmark(df: DataFrame, row: DataFrame, order: str) -> DataFrame:
    """A ranked list with a benchmark row in its place; place is by ``order``, descending, nulls last."""
    both = df.withColumn("benchmark", F.lit(False)).unionByName(row.withColumn("benchmark", F.lit(True)), allowMissingColumns=True)
    return both.withColumn("place", competition_rank(order))


def ordered(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """df with ``rank`` within its keys by value, descending, nulls last."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last(), tie)))
