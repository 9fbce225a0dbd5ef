"""Registered queries of back-tests, forecasts and indexes of monthly series, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.functions import calendar
from souk.operators import rollup, series

from .market import MONTHS, months, r6, register, table
from .reports import STARTS

HORIZON, HISTORY = 24, 36


def listed(rows, names: str) -> str:
    values = ", ".join("(" + ", ".join(f"{x!r}::double" for x in r) + ")" for r in rows)
    return f"(select row_number() over () - 1 i, * from (values {values}) g({names}))"


def holt_sql() -> str:
    """CTEs up to hb (series, t, l, s, p): each level's grid is run over all months by recursion and the best point of
    each month, first level and trend solved for, is the middle of the next."""
    low, high = series.HOLT_LIMITS
    out = []
    for r, grid in enumerate([series.HOLT, *series.HOLT_FINER]):
        if r:
            point = ", ".join(f"least({z!r}::double, greatest({a!r}::double, c.{n} + g.{n})) {n}" for n, a, z in zip("abp", low, high, strict=True))
            start = f"(select c.series, {point}, g.i, c.a ca, c.b cb, c.p cp from (select distinct series, a, b, p from hb{r - 1}) c, hg{r} g)"
        else:
            start = "(select series, g.a, g.b, g.p, g.i, 0.0::double ca, 0.0::double cb, 0.0::double cp from (select distinct series from v), hg0 g)"
        go = lambda k: f"(l{k} + p * s{k})"
        e = [f"(x - {go(0)})", f"(-{go(1)})", f"(-{go(2)})"]
        steps = ", ".join([f"{go(k)} + a * {e[k]} l{k}" for k in range(3)] + [f"p * s{k} + a * b * {e[k]} s{k}" for k in range(3)])
        products = ", ".join(f"m{n} + {e[i]} * {e[j]} m{n}" for n, (i, j) in enumerate(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))))
        out.append(f"""hg{r} as {listed(grid, "a, b, p")},
hr{r} as (select q.*, a0.a - 1 t, 0.0::double l0, 1.0::double l1, 0.0::double l2, 0.0::double s0, 0.0::double s1, 1.0::double s2, 0.0::double m0, 0.0::double m1, 0.0::double m2, 0.0::double m3, 0.0::double m4, 0.0::double m5 from {start} q join ends a0 on a0.series = q.series
 union all select series, a, b, p, i, ca, cb, cp, t, {steps}, {products} from (select h.* exclude (t), v.t, v.v x from hr{r} h join v on v.series = h.series and v.t = h.t + 1)),
hs{r} as (select *, m3 * m5 - m4 * m4 > 1e-12::double * m3 * m5 + 1e-300::double ok, m3 * m5 - m4 * m4 det from hr{r}),
hz{r} as (select *, case when ok then (m2 * m4 - m1 * m5) / det else -m1 / greatest(m3, 1e-300::double) end lz, case when ok then (m1 * m4 - m2 * m3) / det else 0.0::double end sz from hs{r}),
hb{r} as (select z.series, z.t, unnest(arg_min(struct_pack(a := z.a, b := z.b, p := z.p, l := z.l0 + lz * z.l1 + sz * z.l2, s := z.s0 + lz * z.s1 + sz * z.s2), (round(m0 + 2 * lz * m1 + 2 * sz * m2 + lz * lz * m3 + 2 * lz * sz * m4 + sz * sz * m5, 9), i)))
 from hz{r} z join k on k.series = z.series and k.t = z.t {f"join hb{r - 1} o on o.series = z.series and o.t = z.t and o.a = ca and o.b = cb and o.p = cp" if r else ""} group by 1, 2)""")
    return ",\n".join(out) + f",\nhb as (select * from hb{len(out) - 1})"


def trend_sql() -> str:
    """CTEs up to tb (series, t, l, s), likewise; from each series' second known month on."""
    out = ["""two as (select k.series, k.t t2, k.y y2, o.t t1, o.y y1, k.t - o.t d from (select *, row_number() over (partition by series order by t) i from k) k join (select *, row_number() over (partition by series order by t) i from k) o on o.series = k.series and o.i = 1 and k.i = 2)"""]
    levels = [series.TREND, *series.TREND_FINER]
    for r, grid in enumerate(levels):
        if r:
            start = f"(select c.series, c.v * g.v v, c.w * g.w w, g.i, c.v cv, c.w cw from (select distinct series, v, w from tb{r - 1}) c, tg{r} g)"
        else:
            start = "(select series, g.v, g.w, g.i, 0.0::double cv, 0.0::double cw from two, tg0 g)"
        out.append(f"""tg{r} as {listed(grid, "v, w")},
tr{r} as (select q.*, t2 t, y2 l, (y2 - y1) / d s, v p11, v / d p12, (2 * v + d + w * (d * (d - 1) * (2 * d - 1) / 6)) / (d * d) + w p22, 0.0::double fit, 0.0::double logs, 0 n from {start} q join two on two.series = q.series
 union all select series, v, w, i, cv, cw, t, case when y is null then l else l + p11 / f * (y - l) end, case when y is null then s else s + p12 / f * (y - l) end,
  case when y is null then p11 else p11 - p11 / f * p11 end, case when y is null then p12 else p12 - p11 / f * p12 end, case when y is null then p22 else p22 - p12 / f * p12 end,
  case when y is null then fit else fit + (y - l) * (y - l) / f end, case when y is null then logs else logs + ln(f) end, case when y is null then n else n + 1 end
  from (select *, p11 + v f from (select r.series, v.t, r.v, r.w, i, cv, cw, l + s l, s, p11 + 2 * p12 + p22 + 1 p11, p12 + p22 p12, p22 + r.w p22, fit, logs, n, v.y from tr{r} r join v on v.series = r.series and v.t = r.t + 1) x) z),
tb{r} as (select z.series, z.t, unnest(arg_min(struct_pack(v := z.v, w := z.w, l := z.l, s := z.s), (round(n * ln(greatest(fit, 1e-300::double) / greatest(n, 1)) + logs, 9), i)))
 from tr{r} z join k on k.series = z.series and k.t = z.t {f"join tb{r - 1} o on o.series = z.series and o.t = z.t and o.v = cv and o.w = cw" if r else ""} group by 1, 2)""")
    return ",\n".join(out) + f",\ntb as (select * from tb{len(levels) - 1})"


SMOOTHED = f"{holt_sql()},\n{trend_sql()}"
#: Every method's state (level, step, damping) at every known month of ser (series, t, y), by recursion in SQL.
STATES = f"""k as (select * from ser where y is not null), ends as (select series, min(t) a, max(t) z from k group by 1),
straight as (select k.series, k.t origin, k.y, arg_min(b.y, b.t) fy, min(b.t) ft, arg_max(b.y, b.t) filter (where b.t <= k.t - 12) py, max(b.t) filter (where b.t <= k.t - 12) pt from k join k b on b.series = k.series and b.t <= k.t group by 1, 2, 3),
gaps as (select s.series, s.t, s.y, last_value(case when s.y is not null then s.t end ignore nulls) over b ta, last_value(s.y ignore nulls) over b ya, first_value(case when s.y is not null then s.t end ignore nulls) over c tz, first_value(s.y ignore nulls) over c yz from ser s join ends on ends.series = s.series and s.t between a and z
 window b as (partition by s.series order by s.t rows unbounded preceding), c as (partition by s.series order by s.t rows between current row and unbounded following)),
v as (select series, t, y, coalesce(y, ya + (yz - ya) / (tz - ta) * (t - ta)) v from gaps),
{SMOOTHED},
states as (select series, origin, 'naive' as "method", y as "level", 0.0::double step, 1.0::double damp from straight
 union all select series, origin, 'drift_long', y, coalesce((y - fy) / nullif(origin - ft, 0), 0), 1 from straight
 union all select series, origin, 'drift_12m', y, coalesce((y - coalesce(py, fy)) / nullif(origin - coalesce(pt, ft), 0), 0), 1 from straight
 union all select k.series, k.t, 'holt_damped', hb.l, hb.s, hb.p from k join hb on hb.series = k.series and hb.t = k.t
 union all select k.series, k.t, 'local_linear_trend', tb.l, tb.s, 1 from k join tb on tb.series = k.series and tb.t = k.t),
pth as (select *, "level" + step * case when damp = 1 then h else damp * (1 - pow(damp, h)) / (1 - damp) end pred from states, (select unnest(generate_series(1, {HORIZON})) h)),
bt as (select pth.series, "method", origin, h, pred - k.y err from pth join k on k.series = pth.series and k.t = origin + h where origin >= {HISTORY})"""
#: Every ninth month of the series is missing, as after a publication gap.
GAPPY = MONTHS.replace("ln(v) y", "case when (sp.t - 3) % 9 <> 0 then ln(v) end y")


def gappy(spark, sf):
    """The segments' monthly totals in logs; every ninth calendar month is missing."""
    m = months(spark, sf)
    first = table(spark, sf, "orders").agg(F.min((F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate"))).scalar()
    return m.withColumn("f", first).withColumn("y", F.when((F.col("t") + F.col("f") - 3) % 9 != 0, F.col("y"))).drop("f")


def errors(spark, sf):
    return series.backtest(gappy(spark, sf), HORIZON, HISTORY)


LEADERS = """e as (select "method", h, avg(abs(exp(err) - 1)) e, count(*) n from bt group by 1, 2),
lb as (select "method", max(e) filter (where h = 1) h1, max(e) filter (where h = 3) h3, max(e) filter (where h = 6) h6, max(e) filter (where h = 12) h12, max(e) filter (where h = 24) h24, avg(e) filter (where h <= 12) avg_1_12, max(n) filter (where h = 12) origins from e group by 1)"""


@register(f"""with recursive {GAPPY}, {STATES}, {LEADERS} select "method", round(h1, 6) h1, round(h3, 6) h3, round(h6, 6) h6, round(h12, 6) h12, round(h24, 6) h24, round(avg_1_12, 6) avg_1_12, origins, cast(row_number() over (order by h12 nulls last, "method") as int) place from lb""")
def forecast_leaderboard(spark, sf):
    """Five methods, back-tested from every origin with a history of three years, two years ahead."""
    return series.leaderboard(errors(spark, sf)).select("method", *r6("h1", "h3", "h6", "h12", "h24", "avg_1_12"), "origins", "place")


@register(f"""with recursive {GAPPY}, {STATES}, e as (select "method", h, avg(abs(exp(err) - 1)) e from bt where h in (1, 3, 6, 12, 24) group by 1, 2) select "method", h::int h, round(e, 6) ape, e = min(e) over (partition by h) best from e""")
def best_by_horizon(spark, sf):
    """Which method is best at each horizon."""
    e = errors(spark, sf).where("h in (1, 3, 6, 12, 24)").groupBy("method", "h").agg(F.avg("ape").alias("e"))
    return rollup.best_per(e, ["h"], "e").select("method", "h", F.round("e", 6).alias("ape"), "best")


@register(f"""with recursive {GAPPY}, {STATES}, q as (select h, quantile_cont(exp(-err), [0.1, 0.25, 0.75, 0.9]) q from bt where "method" = 'drift_long' group by 1) select h::int h, round(q[1], 6) q10, round(q[2], 6) q25, round(q[3], 6) q75, round(q[4], 6) q90 from q""")
def forecast_bands(spark, sf):
    return series.error_bands(errors(spark, sf), "drift_long", HORIZON).select("h", *r6("q10", "q25", "q75", "q90"))


@register(f"""with recursive {GAPPY}, {STATES} select pth.series, "method", h::int h, (origin + h)::int t, round(exp(pred) / 1e6, 6) as value from pth join ends on ends.series = pth.series and origin = z""")
def forecast_paths(spark, sf):
    """Every method's path from each series' last known month."""
    out = series.forecast_paths(gappy(spark, sf), HORIZON)
    return out.select("series", "method", "h", "t", F.round(F.col("value") / 1e6, 6).alias("value"))


@register(f"""with recursive {MONTHS}, {STATES} select pth.series, h::int h, round(pred, 6) pred from pth join ends on ends.series = pth.series and origin = z where "method" = 'holt_damped' and h <= 12""")
def holt_forecast(spark, sf):
    return series.holt_damped(months(spark, sf), 12).select("series", "h", *r6("pred"))


RATES = """r as (select a.series, (a.y - a.fy) / (a.origin - a.ft) long_run, (a.y - coalesce(a.py, a.fy)) / (a.origin - coalesce(a.pt, a.ft)) "trailing", a.origin, a.y from straight a join ends on ends.series = a.series and a.origin = ends.z)"""


@register(f"""with recursive {GAPPY}, {STATES}, {RATES} select series, round(long_run, 6) long_run, round("trailing", 6) "trailing", round(exp(12 * long_run) - 1, 6) long_run_year, round(exp(12 * "trailing") - 1, 6) trailing_year from r""")
def growth_rates(spark, sf):
    """Growth over all months and over the last twelve, a month and a year."""
    return series.growth_rates(gappy(spark, sf)).select("series", *r6("long_run", "trailing", "long_run_year", "trailing_year"))


PRESETS = """ps as (select series, y, preset, case preset when 'long' then long_run when 'recent' then "trailing" when 'half' then long_run / 2 else 0 end g from r, (values ('long'), ('recent'), ('half'), ('zero')) x(preset))"""


@register(f"""with recursive {GAPPY}, {STATES}, {RATES}, {PRESETS}, q as (select h, quantile_cont(exp(-err), [0.1, 0.25, 0.75, 0.9]) q from bt where "method" = 'drift_long' group by 1)
select series, preset, h::int h, round(exp(y) * exp(h * g) / 1e6, 6) mid, round(exp(y) * exp(h * g) * q[1] / 1e6, 6) q10, round(exp(y) * exp(h * g) * q[2] / 1e6, 6) q25, round(exp(y) * exp(h * g) * q[3] / 1e6, 6) q75, round(exp(y) * exp(h * g) * q[4] / 1e6, 6) q90 from ps, q""")
def outlook(spark, sf):
    """Scenarios of growth from the last level, with the bands of the back-tested errors."""
    m = gappy(spark, sf)
    level = m.where("y is not null").groupBy("series").agg(F.exp(F.max_by("y", "t")).alias("level"))
    presets = series.growth_presets(series.growth_rates(m)).join(level, "series")
    out = series.scenario_fan(presets, series.error_bands(errors(spark, sf), "drift_long", HORIZON), "monthly")
    return out.select("series", "preset", "h", *[F.round(F.col(c) / 1e6, 6).alias(c) for c in ("mid", "q10", "q25", "q75", "q90")])


@register(f"""with recursive {GAPPY}, {STATES}, cutoff as (select * from k where t <= 60), e as (select series, max(t) t, arg_max(y, t) y, (arg_max(y, t) - arg_min(y, t)) / (max(t) - min(t)) g from cutoff group by 1), o as (select series, max(t) t, arg_max(exp(y), t) v from k group by 1)
select o.series, o.t::int t, round(v / 1e6, 6) as value, round(exp(e.y) * exp(g * (o.t - e.t)) / 1e6, 6) path, round(v / (exp(e.y) * exp(g * (o.t - e.t))) - 1, 6) off from o join e using (series)""")
def reality_check(spark, sf):
    """The latest value of one source against the path from the end of another."""
    m = gappy(spark, sf)
    official = m.where("t <= 60")
    official = official.join(series.growth_rates(official).select("series", "long_run"), "series")
    out = series.reality_check(official, m.select("series", "t", F.exp("y").alias("value")), "long_run")
    return out.select("series", "t", *[F.round(F.col(c) / 1e6, 6).alias(c) for c in ("value", "path")], *r6("off"))


@register(f"""with {MONTHS}, b as (select series, exp(y) p0, y / 3 r0 from ser where t = 12) select ser.series, t::int t, round(100 * exp(y) / p0, 6) raw, round(100 * exp(y / 3 - r0), 6) adjusted from ser left join b using (series)""")
def rebased_index(spark, sf):
    """Indexes with 100 at a base month, of the value and of a residual in logs."""
    m = months(spark, sf).withColumn("p", F.exp("y")).withColumn("r", F.col("y") / 3)
    return series.rebased(m, ["series"], "t", "p", "r", 12).select("series", "t", *r6("raw", "adjusted"))


@register(f"""with {GAPPY}, {STARTS}, sp2 as (select unnest(generate_series(0, (select max(t) from ser where y is not null and series in ('BUILDING', 'MACHINERY')))) t), w as (select sp2.t, max(exp(y)) filter (where series = 'BUILDING') building, max(exp(y)) filter (where series = 'MACHINERY' and sp2.t >= 50) machinery from sp2 left join ser using (t) group by 1)
select t::int t, s.jy::int jy, s.jm::int jm, s.d date, round(building / 1e6, 6) building, round(machinery / 1e6, 6) machinery, round(building / lag(building, 12) over (order by w.t) - 1, 6) yoy, round(building / lag(building, 1) over (order by w.t) - 1, 6) mom from (select t, building, machinery, t - 300 jt from w) w join (select t jt, jy, jm, d from starts) s using (jt)""")
def timeline(spark, sf):
    """Two sources on one dense month axis with dates, side by side, and changes of the first."""
    m = gappy(spark, sf).withColumn("value", F.exp("y")).where("value is not null")
    one = lambda name, since: m.where((F.col("series") == name) & (F.col("t") >= since)).select("t", "value")
    line = series.timeline(0, {"building": one("BUILDING", 0), "machinery": one("MACHINERY", 50)}, spark)
    line = line.withColumn("one", F.lit(0)).withColumn("yoy", series.changes(line, "one", "t", "building", 12)).withColumn("mom", series.changes(line, "one", "t", "building", 1))
    j = calendar.from_month_index(F.col("t") - 300)  # the made series are put on an axis of their own
    return line.select("t", j["jy"].alias("jy"), j["jm"].alias("jm"), calendar.month_start(F.col("t") - 300).alias("date"), *[F.round(F.col(c) / 1e6, 6).alias(c) for c in ("building", "machinery")], *r6("yoy", "mom"))
