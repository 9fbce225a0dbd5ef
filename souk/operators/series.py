"""Many time series at once: calendars, gaps, back-tests and forecasts. Tables are (series, t, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.sources.tables import stored

from .selection import Values


def spine(df: DataFrame, series: str, t: str) -> DataFrame:
    """Every t from each series' first to its last."""
    return df.groupBy(series).agg(F.min(t).alias("a"), F.max(t).alias("z")).select(series, F.explode(F.sequence("a", "z")).alias(t))


def changes(df: DataFrame, series: str, t: str, y: str, lag: int) -> Column:
    """y against lag steps before on a dense spine."""
    return F.try_divide(F.col(y), F.lag(y, lag).over(Window.partitionBy(series).orderBy(t))) - 1


def gap_fill(df: DataFrame, series: str, t: str, y: str) -> DataFrame:
    """Linear interpolation across gaps, the nearest value at both ends."""
    back = Window.partitionBy(series).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(series).orderBy(t).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(y).isNotNull(), F.struct(F.col(t).alias("t"), F.col(y).alias("y")))
    out = df.withColumn("__a", F.last(known, ignorenulls=True).over(back)).withColumn("__z", F.first(known, ignorenulls=True).over(ahead))
    line = F.col("__a.y") + (F.col("__z.y") - F.col("__a.y")) * (F.col(t) - F.col("__a.t")) / (F.col("__z.t") - F.col("__a.t"))
    return out.withColumn("filled", F.coalesce(F.col(y), line, F.col("__a.y"), F.col("__z.y"))).drop("__a", "__z")


def origins(df: DataFrame, series: str = "series", t: str = "t", y: str = "y", min_history: int = 12) -> DataFrame:
    """Level and drifts known at each origin with t >= min_history: last, long-run drift, 12-step drift (from
    the last value at or before t - 12, else the first)."""
    w = Window.partitionBy(series).orderBy(t)
    upto, year = w.rowsBetween(Window.unboundedPreceding, 0), w.rangeBetween(Window.unboundedPreceding, -12)
    point = F.struct(F.col(t).alias("t"), F.col(y).alias("y"))
    known = df.where(F.col(y).isNotNull()).withColumn("f", F.first(point).over(upto)).withColumn("p", F.coalesce(F.last(point).over(year), F.first(point).over(upto)))
    slope = lambda c: F.coalesce(F.try_divide(F.col(y) - F.col(f"{c}.y"), F.col(t) - F.col(f"{c}.t")), F.lit(0.0))
    return known.where(F.col(t) >= min_history).select(series, F.col(t).alias("origin"), F.col(y).alias("last"), slope("f").alias("drift_long"), slope("p").alias("drift_12m"))


#: Searches of the two smoothing methods, from coarse to fine: the first grid, and what each later one adds to (damped
#: trend: level and trend weight and damping, within their limits) or multiplies (local linear trend: variances of
#: observation and slope, as multiples of the level's) the best point so far with.
HOLT = [(i / 10, j / 10, 0.8 + 0.195 * k / 4) for i in range(11) for j in range(11) for k in range(5)]
HOLT_FINER = [[(i / 10 / 4**r, j / 10 / 4**r, 0.195 * k / 4 / 2**r) for i in range(-4, 5) for j in range(-4, 5) for k in range(-2, 3)] for r in (1, 2, 3)]
HOLT_LIMITS = ((0.0, 0.0, 0.8), (1.0, 1.0, 0.995))
TREND = [(4.0**i, 4.0**j) for i in range(-7, 8) for j in range(-13, 4)]
TREND_FINER = [[(4.0 ** (i / 4**r), 4.0 ** (j / 4**r)) for i in range(-4, 5) for j in range(-4, 5)] for r in (1, 2, 3)]
STATE = "series string, origin int, level double, step double, damp double"


def _straight(step: str):
    def states(df: DataFrame) -> DataFrame:
        made = origins(df, min_history=0)
        slope = F.lit(0.0) if step == "naive" else F.col(step)
        return made.select("series", "origin", F.col("last").alias("level"), slope.alias("step"), F.lit(1.0).alias("damp"))

    return states


def _by_series(run):
    """run(t, y), ascending, y NaN where missing -> level, step and damp at each known t. One series is one group:
    its steps follow from each other."""

    def one(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("t")
        first, last = int(pdf.t.iloc[0]), int(pdf.t.iloc[-1])
        y = np.full(last - first + 1, np.nan)
        y[pdf.t.to_numpy() - first] = pdf.y.to_numpy()
        level, step, damp = run(y)
        known = np.flatnonzero(~np.isnan(y))
        return pd.DataFrame({"series": pdf.series.iloc[0], "origin": known + first, "level": level[known], "step": step[known], "damp": damp[known]})

    def states(df: DataFrame) -> DataFrame:
        known = df.where(F.col("y").isNotNull()).select(F.col("series").cast("string").alias("series"), F.col("t").cast("int").alias("t"), "y")
        return known.groupBy("series").applyInPandas(one, STATE)

    return states


def _searched(run, coarse, finer, join):
    """run(parameters) gives for each step the objective of every point and its state (level, step, damp). The state of
    the best point at each step: first of ``coarse``, then of each later grid laid round that step's own best (join
    puts a point and a grid together). What is known at a step does not depend on later ones, so each grid is run once
    for all steps, side by side for all different points."""
    import numpy as np

    points = np.array(coarse).T
    blocks, which, out = [points], None, []
    for level in range(len(finer) + 1):
        size, best, out = blocks[0].shape[1], [], []
        for i, (objective, *state) in enumerate(run(np.concatenate(blocks, axis=1))):
            at = 0 if which is None else which[i] * size
            j = at + int(np.argmin(np.round(objective[at : at + size], 9)))
            best.append((at // size, j - at))
            out.append([x[j] for x in state])
        if level < len(finer):
            chosen = np.array([blocks[c][:, j] for c, j in best])
            kinds, which = np.unique(chosen, axis=0, return_inverse=True)
            which = which.ravel()
            blocks = [join(k[:, None], np.array(finer[level]).T) for k in kinds]
    return np.array(out).T


def _damped(y):
    """Damped-trend smoothing, gaps filled linearly, by least squared one-step errors. Errors are linear in the first
    level and trend, which are therefore solved for at every point of the search: the recursion carries the response to
    the data and to either of them, and the sums of products of these three kinds of errors."""
    import numpy as np

    at = np.arange(len(y))
    v = np.interp(at, at[~np.isnan(y)], y[~np.isnan(y)])
    low, high = (np.array(x)[:, None] for x in HOLT_LIMITS)

    def run(points):
        a, b, p = points
        level, step = np.zeros((3, len(a))), np.zeros((3, len(a)))
        level[1], step[2] = 1, 1
        m = np.zeros((6, len(a)))
        for x in v:
            guess = level + p * step
            e = -guess
            e[0] = x - guess[0]
            m += np.array([e[0] * e[0], e[0] * e[1], e[0] * e[2], e[1] * e[1], e[1] * e[2], e[2] * e[2]])
            level, step = guess + a * e, p * step + a * b * e
            det = m[3] * m[5] - m[4] * m[4]
            both = det > 1e-12 * m[3] * m[5] + 1e-300
            d = np.where(both, det, 1.0)
            l0 = np.where(both, (m[2] * m[4] - m[1] * m[5]) / d, -m[1] / np.maximum(m[3], 1e-300))
            s0 = np.where(both, (m[1] * m[4] - m[2] * m[3]) / d, 0.0)
            sse = m[0] + 2 * l0 * m[1] + 2 * s0 * m[2] + l0 * l0 * m[3] + 2 * l0 * s0 * m[4] + s0 * s0 * m[5]
            yield sse, level[0] + l0 * level[1] + s0 * level[2], step[0] + l0 * step[1] + s0 * step[2], p

    return _searched(run, HOLT, HOLT_FINER, lambda point, grid: np.clip(point + grid, low, high))


def _trend(y):
    """Local linear trend by the Kalman filter, missing months skipped, by the greatest concentrated likelihood. The
    start is exactly diffuse: level and slope come from the first two known months, with the covariance that they
    then have; the likelihood counts from the third on."""
    import numpy as np

    known = np.flatnonzero(~np.isnan(y))
    if len(known) < 2:
        return np.array([np.full(len(y), y[known[0]]), np.zeros(len(y)), np.ones(len(y))])
    second, gap = int(known[1]), int(known[1] - known[0])

    def run(points):
        v, w = points
        none = np.zeros(len(v))
        for _ in range(second):
            yield none, np.full(len(v), y[known[0]]), none, np.ones(len(v))
        level, step = np.full(len(v), y[second]), np.full(len(v), (y[second] - y[known[0]]) / gap)
        p11, p12 = v, v / gap
        p22 = (2 * v + gap + w * (gap * (gap - 1) * (2 * gap - 1) / 6)) / (gap * gap) + w
        fit, logs, n = none, none, 0
        yield none, level, step, np.ones(len(v))
        for x in y[second + 1 :]:
            level = level + step
            p11, p12, p22 = p11 + 2 * p12 + p22 + 1, p12 + p22, p22 + w
            if not np.isnan(x):
                e, f = x - level, p11 + v
                g, h = p11 / f, p12 / f
                fit, logs, n = fit + e * e / f, logs + np.log(f), n + 1
                level, step = level + g * e, step + h * e
                p11, p12, p22 = p11 - g * p11, p12 - g * p12, p22 - h * p12
            yield n * np.log(np.maximum(fit, 1e-300) / max(n, 1)) + logs, level, step, np.ones(len(v))

    return _searched(run, TREND, TREND_FINER, lambda point, grid: point * grid)


#: Methods by name: each gives, for every known month of a table (series, t, y), the state from which it would
#: forecast there: level, step and damping.
METHODS = {"naive": _straight("naive"), "drift_long": _straight("drift_long"), "drift_12m": _straight("drift_12m"), "holt_damped": _by_series(_damped), "local_linear_trend": _by_series(_trend)}


def paths(states: DataFrame, horizon: int) -> DataFrame:
    """states with h from 1 to horizon and pred = level + step * (damp + damp^2 + .. + damp^h)."""
    gained = F.when(F.col("damp") == 1, F.col("h").cast("double")).otherwise(F.col("damp") * (1 - F.pow("damp", F.col("h"))) / (1 - F.col("damp")))
    return states.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("pred", F.col("level") + F.col("step") * gained)


def states_of(df: DataFrame, methods: list[str] | None = None) -> DataFrame:
    out = None
    for name in methods or METHODS:
        one = METHODS[name](df).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def backtest(df: DataFrame, horizon: int, min_history: int = 36, methods: list[str] | None = None) -> DataFrame:
    """Rolling-origin errors in logs of df (series, t, y): series, method, origin, h, err, ape, for each origin with
    t >= min_history and each horizon that has an actual."""
    df = stored(df.select("series", "t", "y"))  # every method reads it
    made = paths(states_of(df, methods).where(F.col("origin") >= min_history), horizon)
    actual = df.where(F.col("y").isNotNull()).select(F.col("series").cast("string").alias("series"), "t", "y")
    err = F.col("pred") - F.col("y")
    return made.withColumn("t", F.col("origin") + F.col("h")).join(actual, ["series", "t"]).select("series", "method", "origin", "h", err.alias("err"), F.abs(F.expm1(err)).alias("ape"))


def leaderboard(bt: DataFrame, horizons: tuple[int, ...] = (1, 3, 6, 12, 24)) -> DataFrame:
    """Mean absolute percentage error of each method at some horizons, the mean of those of horizons 1 to 12, and the
    number of origins at 12; place by the error at 12."""
    by = bt.groupBy("method", "h").agg(F.avg("ape").alias("e"), F.count("*").alias("n"))
    at = lambda h, c: F.max(F.when(F.col("h") == h, F.col(c)))
    out = by.groupBy("method").agg(*[at(h, "e").alias(f"h{h}") for h in horizons], F.avg(F.when(F.col("h") <= 12, F.col("e"))).alias("avg_1_12"), at(12, "n").alias("origins"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("h12").asc_nulls_last(), "method")))  # a row for each method


def error_bands(bt: DataFrame, method: str, horizon: int) -> DataFrame:
    """Quantiles of actual / forecast at each horizon, gaps filled linearly and at the ends."""
    names = ("q10", "q25", "q75", "q90")
    found = Values(bt.where(F.col("method") == method), ["h"], F.exp(-F.col("err"))).percentiles(dict(zip(names, (0.1, 0.25, 0.75, 0.9), strict=True)))
    out = bt.sparkSession.range(1, horizon + 1).select(F.col("id").cast("int").alias("h"), F.lit(0).alias("one")).join(found, "h", "left")
    for n in names:
        out = gap_fill(out, "one", "h", n).drop(n).withColumnRenamed("filled", n)
    return out.drop("one")


def last_states(df: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """The states at each series' last known month."""
    df = stored(df.select("series", "t", "y"))
    last = df.where(F.col("y").isNotNull()).groupBy(F.col("series").cast("string").alias("series")).agg(F.max("t").cast("int").alias("origin"))
    return states_of(df, methods).join(last, ["series", "origin"])


def forecast_paths(df: DataFrame, horizon: int, methods: list[str] | None = None) -> DataFrame:
    """series, method, h, t and value of every method from the last known month on."""
    return paths(last_states(df, methods), horizon).select("series", "method", "h", (F.col("origin") + F.col("h")).alias("t"), F.exp("pred").alias("value"))


def growth_rates(df: DataFrame, months: int = 12) -> DataFrame:
    """Monthly log growth over all known months and over the last ``months`` (from the last value at or before then,
    else the first), and both as growth a year."""
    w = Window.partitionBy("series").orderBy("t")
    point = F.struct(F.col("t").alias("t"), F.col("y").alias("y"))
    known = df.where(F.col("y").isNotNull()).withColumn("f", F.first(point).over(w)).withColumn("p", F.coalesce(F.last(point).over(w.rangeBetween(Window.unboundedPreceding, -months)), F.first(point).over(w)))
    last = known.groupBy("series").agg(F.max_by(F.struct("t", "y", "f", "p"), "t").alias("e"))
    slope = lambda c: F.try_divide(F.col("e.y") - F.col(f"e.{c}.y"), F.col("e.t") - F.col(f"e.{c}.t"))
    return last.select("series", slope("f").alias("long_run"), slope("p").alias("trailing")).withColumn("long_run_year", annual(F.col("long_run"))).withColumn("trailing_year", annual(F.col("trailing")))


def annual(monthly_log: Column) -> Column:
    return F.expm1(12 * monthly_log)


def growth_presets(rates: DataFrame) -> DataFrame:
    """Each series' presets of monthly growth: long, recent, half of the long, none."""
    return rates.select("series", F.explode(F.array(*[F.struct(F.lit(n).alias("preset"), g.alias("monthly")) for n, g in (("long", F.col("long_run")), ("recent", F.col("trailing")), ("half", F.col("long_run") / 2), ("zero", F.lit(0.0)))])).alias("p")).select("series", "p.*")


def scenario_fan(latest: DataFrame, bands: DataFrame, monthly: str) -> DataFrame:
    """latest (series, level and a column of monthly growth) x bands (h, q10..q90): the path level * exp(g h) and
    its bands. bands has a row for each horizon."""
    mid = F.col("level") * F.exp(F.col("h") * F.col(monthly))
    return latest.crossJoin(bands).select(*latest.columns, "h", mid.alias("mid"), *[(mid * F.col(q)).alias(q) for q in ("q10", "q25", "q75", "q90")])


def reality_check(df: DataFrame, other: DataFrame, monthly: str) -> DataFrame:
    """df (series, t, y and a column of monthly growth) against another source (series, t, value): the other's
    latest value, the path from df's last known month carried to that month, and how far off it is."""
    end = df.where(F.col("y").isNotNull()).groupBy("series").agg(F.max_by(F.struct(F.col("t").alias("t"), F.exp("y").alias("level"), F.col(monthly).alias("g")), "t").alias("e"))
    late = other.where(F.col("value").isNotNull()).groupBy("series").agg(F.max_by(F.struct(F.col("t").alias("t"), F.col("value").alias("value")), "t").alias("o"))
    path = F.col("e.level") * F.exp(F.col("e.g") * (F.col("o.t") - F.col("e.t")))
    return end.join(late, "series").select("series", F.col("o.t").alias("t"), F.col("o.value").alias("value"), path.alias("path"), (F.try_divide(F.col("o.value"), path) - 1).alias("off"))


def rebased(df: DataFrame, keys: list[str], t: str, value: str, residual: str, base: int) -> DataFrame:
    """Indexes with 100 at the base month: the raw value's, and that of a log residual, which is free of the mix;
    null where the base month is missing."""
    at = df.where(F.col(t) == base).select(*keys, F.col(value).alias("__v"), F.col(residual).alias("__r"))
    out = df.join(at, keys, "left")
    return out.withColumn("raw", 100 * F.try_divide(F.col(value), F.col("__v"))).withColumn("adjusted", 100 * F.exp(F.col(residual) - F.col("__r"))).drop("__v", "__r")


def timeline(first: int, sources: dict[str, DataFrame], spark) -> DataFrame:
    """One dense row a month from ``first`` to the last month of any source (t, value), a column for each source;
    sources are set side by side, never blended."""
    last = None
    for df in sources.values():
        one = df.select("t")
        last = one if last is None else last.unionByName(one)
    out = last.agg(F.max("t").alias("z")).select(F.explode(F.sequence(F.lit(first), F.col("z").cast("int"))).alias("t"))
    for name, df in sources.items():
        out = out.join(df.select("t", F.col("value").alias(name)), "t", "left")
    return out


def holt_damped(df: DataFrame, horizon: int) -> DataFrame:
    """series, h, pred (in logs) by damped-trend smoothing from each series' last known month."""
    return paths(last_states(df, ["holt_damped"]), horizon).select("series", "h", "pred")
