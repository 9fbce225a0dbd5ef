"""Registered queries of places, roll-ups, periods and composite tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.functions import calendar, text
from souk.operators import asof, geo, joins, periods, quality, rollup
from souk.operators.weighted import weighted_quantile
from souk.sources.tables import stored

from .market import MONTHS, POINTS, UNITS, months, points, r6, register, table, units, wq

# Places -------------------------------------------------------------------------------------------------------

BOX = f"{POINTS}, places as (select poly as \"name\", x0 + 0.75 cx, y0 + 0.75 cy, x0 x_min, x0 + 1.5 x_max, y0 y_min, y0 + 1.5 y_max from boxes)"


def places(spark, sf):
    _, polys = points(spark, sf)
    return polys.select(F.col("poly").alias("name"), (F.col("x0") + 0.75).alias("cx"), (F.col("y0") + 0.75).alias("cy"), F.col("x0").alias("x_min"), (F.col("x0") + 1.5).alias("x_max"), F.col("y0").alias("y_min"), (F.col("y0") + 1.5).alias("y_max"))


@register(f"""with {BOX}, t as (select id, x, y, case when id % 9 <> 0 then id % 25 end tag from pts),
h as (select t.*, coalesce(x between x_min - 0.8 and x_max + 0.8 and y between y_min - 0.8 and y_max + 0.8, false) ok from t left join places on "name" = tag),
n as (select id, arg_min("name", (d2, "name")) nearest from (select h.id, p."name", pow((x - cx) * 0.8, 2) + pow(y - cy, 2) d2 from h, places p) group by 1)
select id, case when ok then tag else nearest end "name", ok from h join n using (id)""")
def tag_check(spark, sf):
    """A given tag stands if the point is in its place's box, else the nearest place."""
    pts, _ = points(spark, sf)
    tagged = pts.withColumn("tag", F.when(F.col("id") % 9 != 0, (F.col("id") % 25).cast("int")))
    return geo.verified(tagged, places(spark, sf), 0.8, 2.0, 30.0, 0.8)


@register(f"""with {POINTS}, h as (select id, min(poly) poly from pts join boxes on x > x0 + 0.005 and x < x0 + 1.505 and y > y0 + 0.005 and y < y0 + 1.505 group by 1),
v as (select poly, c_mktsegment as label, count(*) n from h join customer on c_custkey = id group by 1, 2)
select boxes.poly, arg_min(label, (-n, label)) as label from boxes left join v on v.poly = boxes.poly group by 1""")
def polygon_vote(spark, sf):
    pts, polys = points(spark, sf)
    labels = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))
    return geo.majority_label(pts.join(labels, "id"), polys)


@register(f"""with {POINTS}, b as (select min(x) a, max(x) z, min(y) lo, max(y) hi from pts), k as (select *, cos(radians((lo + hi) / 2)) kx from b), s as (select *, 580 / ((z - a) * kx) sc from k)
select id, round(10 + (x - a) * kx * sc, 4) px, round(10 + (hi - y) * sc, 4) py, round(20 + (hi - lo) * sc, 1) height from pts, s""")
def projected_points(spark, sf):
    """Points in a projection fitted to their own box."""
    pts, _ = points(spark, sf)
    fitted = geo.projection(pts.agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max")), 600)
    out = geo.projected(pts, fitted).crossJoin(fitted.select("height"))
    return out.select("id", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"), "height")


@register("select n_nationkey, round(n_nationkey / 7.0, 2) a, round(n_nationkey / 7.0 + 0.333, 2) b, round(round(n_nationkey / 7.0, 2) + round(n_nationkey / 3.0, 2), 6) c from nation")
def rounded_shapes(spark, sf):
    k = F.col("n_nationkey")
    rings = F.array(F.array(F.array(k / 7.0, k / 3.0), F.array(k / 7.0 + 0.333, k / 3.0)))
    r = table(spark, sf, "nation").select("n_nationkey", geo.rounded_rings(rings, 2).alias("r"))
    return r.select("n_nationkey", F.col("r")[0][0][0].alias("a"), F.col("r")[0][1][0].alias("b"), F.round(F.col("r")[0][0][0] + F.col("r")[0][0][1], 6).alias("c"))


# Filters and layers --------------------------------------------------------------------------------------------


@register("""select s.q, p_partkey, p_retailprice from part, (values ('BRAND#1'), ('17'), ('steel')) s(q) where contains(lower(p_brand), lower(s.q)) or contains(lower(p_type), lower(s.q)) or p_size = try_cast(s.q as int)""")
def text_search(spark, sf):
    """Names that hold a text, or the number itself."""
    p = table(spark, sf, "part")
    found = [p.where(periods.matches(q, F.col("p_brand"), F.col("p_type"), number=F.col("p_size"))).select(F.lit(q).alias("q"), "p_partkey", "p_retailprice") for q in ("BRAND#1", "17", "steel")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@register("""select p_partkey, row_number() over (partition by p_brand order by p_retailprice desc nulls last, p_partkey) "rank" from part where p_retailprice is not null and not (p_size > 45 or p_retailprice < 950)""")
def eligible_units(spark, sf):
    """Units with a value and an acceptable flag, ordered within their group by price."""
    flag = quality.label([(F.col("p_size") > 45, "outlier"), (F.col("p_retailprice") < 950, "thin")], "ok")
    return rollup.ordered(table(spark, sf, "part").withColumn("flag", flag).where("p_retailprice is not null and flag = 'ok'"), ["p_brand"], "p_retailprice", "p_partkey").select("p_partkey", "rank")


@register("""with y as (select c_nationkey u, year(o_orderdate) p, count(*) n, round(avg(o_totalprice), 2) v from orders join customer on o_custkey = c_custkey group by 1, 2)
select a.u, a.v, b.v v_later, b.n n_later, c.v v_1990 from (select * from y where p = 1996) a left join (select * from y where p = 1997 and n > 2) b on a.u = b.u left join y c on c.u = a.u and c.p = 1990""")
def layered_periods(spark, sf):
    """A later period's columns beside an earlier one's, and a period that has none, which stays missing."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    y = o.groupBy(F.col("c_nationkey").alias("u"), F.year("o_orderdate").alias("p")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("v"))
    later = quality.layer(y.where("p = 1997 and n > 2"), ["u"], ["v", "n", "no_such_column"], "later")
    old = periods.value_in(y, "u", "p", "v", y.where("p = 1996").select("u", F.lit(1990).alias("p"))).select("u", F.col("v").alias("v_1990"))
    return y.where("p = 1996").select("u", "v").join(later, "u", "left").join(old, "u", "left")


TIES = "l_suppkey, l_orderkey, l_linenumber"
MEMBERS = f"""{UNITS}, mem as (select n_regionkey, n_name, sum(w) weight, median(price) value, median(w) size, avg(case when w > 25 then 1.0 else 0 end) big, avg(case when price > 1400 then 1.0 else 0 end) dear from units group by all)"""


def members(spark, sf):
    share = lambda c: F.avg(c.cast("double"))
    return units(spark, sf).groupBy("n_regionkey", "n_name").agg(F.sum("w").alias("weight"), F.median("price").alias("value"), F.median("w").alias("size"), share(F.col("w") > 25).alias("big"), share(F.col("price") > 1400).alias("dear"))


@register(f"""with {MEMBERS}, {wq("mem", "n_regionkey", "value", "weight", "n_name", 0.25, "q1")}, {wq("mem", "n_regionkey", "value", "weight", "n_name", 0.5, "q2")}, {wq("mem", "n_regionkey", "value", "weight", "n_name", 0.75, "q3")}, {wq("mem", "n_regionkey", "size", "weight", "n_name", 0.5, "q4")}, {wq("(select 0 one, * from mem)", "one", "value", "weight", "n_name", 0.5, "qa")},
s as (select n_regionkey, count(*) members, sum(weight) weight, arg_min(n_name, (value, n_name)) filter (where weight >= 100) cheapest, arg_min(n_name, (-value, n_name)) filter (where weight >= 100) dearest, sum(big * weight) / sum(weight) big, sum(dear * weight) / sum(weight) dear from mem group by 1)
select n_regionkey, members, weight, cheapest, dearest, round(q1.x, 6) p25, round(q2.x, 6) p50, round(q3.x, 6) p75, round(q4.x, 6) size, round(big, 6) big, round(dear, 6) dear, round(q2.x / qa.x - 1, 6) vs_total, cast(floor(rank() over (order by q2.x desc) + (count(*) over (partition by q2.x) - 1) / 2.0) as int) place
from s join q1 on q1.k = n_regionkey join q2 on q2.k = n_regionkey join q3 on q3.k = n_regionkey join q4 on q4.k = n_regionkey, qa""")
def district_table(spark, sf):
    """Groups of members: quartiles and medians weighted by listings, shares, dearest and cheapest, place, and the
    comparison with all members."""
    t = rollup.member_table(members(spark, sf), ["n_regionkey"], "n_name", "value", "weight", 100, {"size": "size"}, {"big": "big", "dear": "dear"})
    return t.select("n_regionkey", "members", "weight", "cheapest", "dearest", *r6("p25", "p50", "p75", "size", "big", "dear", "vs_total"), "place")


@register(f"""with {UNITS}, mem as (select n_name, n_regionkey, sum(w) weight, median(price) value from units group by all), {wq("mem", "n_regionkey", "value", "weight", "n_name", 0.5, "d")},
p as (select *, row_number() over (order by n_name) - 1 i from mem), j as (select p.*, d.x, case when i % 6 = 0 then null else n_regionkey end region from p join d on d.k = n_regionkey)
select n_name, weight, round(value, 6) value, case when region is null then 'outside' when weight >= 1000 and value / x < 0.99 then 'outlier' when weight < 1000 then 'thin' else 'ok' end quality from j""")
def hood_table(spark, sf):
    """Units with their group's level and a flag: outside, outlier against the group, thin, or ok."""
    m = units(spark, sf).groupBy("n_name", "n_regionkey").agg(F.sum("w").alias("weight"), F.median("price").alias("value"))
    numbered = quality.surrogate_key(m, ["n_name"], "H").withColumn("i", text.first_integer(F.col("key")) - 1)
    region = F.when(F.col("i") % 6 != 0, F.col("n_regionkey"))
    level = weighted_quantile(m, ["n_regionkey"], "value", "weight", {"level": 0.5}, ["n_name"])
    joined = numbered.join(level, "n_regionkey", "left")
    flag = quality.label([(region.isNull(), "outside"), ((F.col("weight") >= 1000) & (F.try_divide(F.col("value"), F.col("level")) < 0.99), "outlier"), (F.col("weight") < 1000, "thin")], "ok")
    return joined.select("n_name", "weight", *r6("value"), flag.alias("quality"))


TOWNS = """old as (select c_nationkey k, count(*) n, median(o_totalprice) b from orders join customer on o_custkey = c_custkey where year(o_orderdate) = 1996 group by 1),
new as (select c_nationkey k, median(o_totalprice) later from orders join customer on o_custkey = c_custkey where year(o_orderdate) = 2000 and c_nationkey % 7 <> 0 group by 1),
al as (select count(*) n, median(o_totalprice) filter (where year(o_orderdate) = 1996) b, median(o_totalprice) filter (where year(o_orderdate) = 2000) later from orders),
t as (select cast(k as varchar) u, n, b, later, n >= 12 reliable, case when n >= 12 then later / b end multiple, false benchmark from old left join new using (k) union all select 'all', n, b, later, true, later / b, true from al)"""


@register(f"""with {TOWNS} select u, n, round(b, 6) as before, round(later, 6) later, reliable, round(multiple, 6) multiple, benchmark, case when multiple is not null then rank() over (order by multiple desc nulls last) end::int place from t""")
def town_growth(spark, sf):
    """Growth of units between two periods, for those with rows enough, with the whole as a benchmark row."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("u", F.col("c_nationkey").cast("string"))
    new = o.where("year(o_orderdate) = 2000 and c_nationkey % 7 <> 0").groupBy("u").agg(F.median("o_totalprice").alias("later"))
    towns = rollup.growth_multiple(o.where("year(o_orderdate) = 1996"), new, "u", "o_totalprice", 12)
    of = lambda y: F.median(F.when(F.year("o_orderdate") == y, F.col("o_totalprice")))
    whole = table(spark, sf, "orders").agg(F.count("*").alias("n"), of(1996).alias("before"), of(2000).alias("later")).select(F.lit("all").alias("u"), "n", "before", "later", F.lit(True).alias("reliable"), (F.col("later") / F.col("before")).alias("multiple"))
    return rollup.with_benchmark(towns, whole, "multiple").select("u", "n", *r6("before", "later"), "reliable", *r6("multiple"), "benchmark", "place")


GROWN = """g as (select c_nationkey k, median(o_totalprice) filter (where year(o_orderdate) = 1996) a, median(o_totalprice) filter (where year(o_orderdate) = 2000) z, count(*) filter (where year(o_orderdate) = 1996) n from orders join customer on o_custkey = c_custkey group by 1)"""


@register(f"""with {GROWN} select count(*) units, round(regr_slope(ln(z / a), ln(a)), 6) slope, round(corr(ln(a), ln(z / a)), 6) r, case when corr(ln(a), ln(z / a)) < -0.3 then 'catching up' when corr(ln(a), ln(z / a)) > 0.3 then 'pulling away' else 'mixed' end verdict from g where n >= 5 and z is not null""")
def growth_against_level(spark, sf):
    """Whether units that were cheap grew more: growth multiple on the level at the start, both in logs."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    new = o.where("year(o_orderdate) = 2000").groupBy("c_nationkey").agg(F.median("o_totalprice").alias("later"))
    grown = rollup.growth_multiple(o.where("year(o_orderdate) = 1996"), new, "c_nationkey", "o_totalprice", 5).where("multiple is not null")
    fit = rollup.log_fit(grown, [], "before", "multiple")
    return grown.agg(F.count("*").alias("units")).crossJoin(fit).select("units", *r6("slope", "r"), "verdict")


@register(f"""with {UNITS}, y as (select year(l_shipdate) p, s.s_nationkey k, count(*) n, median(l_extendedprice / l_quantity) v, median(l_quantity) s from lineitem join supplier s on l_suppkey = s_suppkey group by 1, 2), {wq("y", "p", "v", "n", "k", 0.5, "a")}, {wq("y", "p", "s", "n", "k", 0.5, "b")}
select a.k p, round(a.x, 6) price, round(b.x, 6) size from a join b using (k)""")
def typical_by_period(spark, sf):
    """Typical price and size of each period: weighted medians over the units' own medians."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("k")), "l_suppkey")
    y = li.groupBy(F.year("l_shipdate").alias("p"), "k").agg(F.count("*").alias("n"), F.median(F.col("l_extendedprice") / F.col("l_quantity")).alias("v"), F.median("l_quantity").alias("s"))
    return weighted_quantile(y, ["p"], "v", "n", {"price": 0.5}, ["k"]).join(weighted_quantile(y, ["p"], "s", "n", {"size": 0.5}, ["k"]), "p").select("p", *r6("price", "size"))


@register("select round(sum(o_totalprice) filter (where c_mktsegment in ('BUILDING', 'MACHINERY')) / sum(o_totalprice), 6) share from orders left join customer on o_custkey = c_custkey")
def coverage_share(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rollup.coverage(o, F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "o_totalprice").select(*r6("share"))


@register(f"""with {MONTHS}, y as (select series, t // 12 y, t, exp(y) v, case when t % 12 < 6 then exp(y) * 2 end w from ser), f as (select series, arg_min(v, t) v0 from y where v is not null group by 1),
l as (select series, y, arg_max(v, t) v, max(t) filter (where v is not null) v_t, arg_max(w, t) filter (where w is not null) w, max(t) filter (where w is not null) w_t from y group by 1, 2),
s as (select series, t, v / first_value(v) over (partition by series order by t) - 1 since, len(list(v) over (partition by series order by t range between 35 preceding and current row)) spark from y where v is not null)
select l.series, cast(l.y as int) y, round(l.v, 2) v, round(l.w, 2) w, cast(v_t as int) v_t, cast(w_t as int) w_t, round(l.v / p.v - 1, 6) yoy, round(s.since, 6) since, cast(s.spark as int) spark
from l left join y p on p.series = l.series and p.t = l.v_t - 12 left join s on s.series = l.series and s.t = l.v_t""")
def kpi_strip(spark, sf):
    """For each scope and year the last known figures, the change on a year before and since the first, and how
    many months a small chart of three years has."""
    from souk.operators import series

    m = months(spark, sf).withColumn("v", F.exp("y")).withColumn("w", F.when(F.col("t") % 12 < 6, F.col("v") * 2)).withColumn("year", F.floor(F.col("t") / 12).cast("int"))
    m = m.withColumn("yoy", series.changes(m, "series", "t", "v", 12))
    known = m.where("v is not null").withColumn("since", periods.since_first("series", "t", "v")).withColumn("spark", F.size(periods.trailing("series", "t", "v", 36)))
    last = periods.last_in_period(m, ["series", "year"], "t", ["v", "w"])
    out = last.join(known.select("series", F.col("t").alias("v_t"), "yoy", "since", "spark"), ["series", "v_t"], "left")
    return out.select("series", F.col("year").alias("y"), F.round("v", 2).alias("v"), F.round("w", 2).alias("w"), "v_t", "w_t", *r6("yoy", "since"), "spark")


LADDER = """y as (select c_nationkey u, year(o_orderdate) p, round(sum(o_totalprice), 2) v from orders join customer on o_custkey = c_custkey where o_orderpriority = '1-URGENT' group by 1, 2)"""


def yearly(spark, sf):
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").alias("u"), F.year("o_orderdate").alias("p")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))


@register(f"""with {LADDER}, e as (select distinct u from y), j as (select e.u, a.v as "now", b.v as "then" from e left join (select * from y where p = 1998) a using (u) left join (select * from y where p = 1997) b on b.u = e.u)
select u, "now", "then", case when "now" is not null then rank() over (order by "now" desc nulls last) end::int place, count("now") over () ranked, round("now" / "then" - 1, 6) change from j""")
def rank_ladder(spark, sf):
    """Units ranked at one period beside the period before; units without a value come last, unranked."""
    return periods.ladder(yearly(spark, sf), "u", "p", "v", 1998, 1997).select("u", "now", "then", "place", "ranked", *r6("change"))


@register(f"""with {LADDER}, w as (select u, sum(v) filter (where p = 1995) a, sum(v) filter (where p = 1996) b, sum(v) filter (where p = 1997) c from y group by 1)
select u, period, case period when 1995 then a when 1996 then b else c end as value, period = 1996 selected from w, (values (1995), (1996), (1997)) t(period)""")
def unit_history(spark, sf):
    """A unit's values over all periods, the selected one marked."""
    at = lambda y: F.sum(F.when(F.col("p") == y, F.col("v")))
    wide = yearly(spark, sf).groupBy("u").agg(at(1995).alias("a"), at(1996).alias("b"), at(1997).alias("c"))
    return periods.history(wide, "u", {"a": 1995, "b": 1996, "c": 1997}, 1996)


@register("""select year(o_orderdate) y, coalesce(bool_or(case when o_orderstatus = 'F' then 1 end is not null), false) finished, coalesce(bool_or(case when o_orderstatus = 'O' then 1 end is not null), false) as open, coalesce(bool_or(case when o_totalprice > 400000 then 1 end is not null), false) dear from orders group by 1""")
def source_availability(spark, sf):
    """Which sources have anything in a year."""
    has = lambda c: F.when(c, F.lit(1))
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    return rollup.availability(o, "y", {"finished": has(F.col("o_orderstatus") == "F"), "open": has(F.col("o_orderstatus") == "O"), "dear": has(F.col("o_totalprice") > 400000)})


@register(f"""with {MONTHS}, l as (select series, t, y, lag(t) over w lt, exp(y) / exp(lag(y) over w) - 1 c from ser where y is not null and t % 5 <> 0 window w as (partition by series order by t)) select series, cast(t as int) t, round(c, 6) change from l where t - lt = 1 and abs(c) > 0.08""")
def jump_check(spark, sf):
    """Changes beyond a limit between neighbouring months, not across gaps."""
    m = months(spark, sf).where("y is not null and t % 5 <> 0").withColumn("v", F.exp("y"))
    return periods.jumps(m, "series", "t", "v", 0.08).select("series", "t", *r6("change"))


@register("""with f as (select p_partkey, unnest([1, 2, 3]) i, unnest([ln(1 + p_size / 100.0), -ln(p_retailprice / 1000), 0.05]) s from part), a as (select *, 1000 * exp(sum(s) over (partition by p_partkey order by i rows unbounded preceding)) z from f)
select p_partkey, i, round(z, 6) as after, round(z - z / exp(s), 6) contribution from a""")
def contributions(spark, sf):
    """Each factor's part of a price in money, at its place in the chain."""
    steps = F.array(F.log1p(F.col("p_size") / 100.0), -F.ln(F.col("p_retailprice") / 1000), F.lit(0.05))
    f = table(spark, sf, "part").select("p_partkey", F.posexplode(steps).alias("i", "s")).withColumn("i", F.col("i") + 1)
    return periods.waterfall(f, ["p_partkey"], "i", "s", 1000.0).select("p_partkey", "i", *r6("after", "contribution"))


@register("""with v as (select p_brand, avg(p_retailprice) - 1400 v from part group by 1) select p_brand, round(greatest(v, 0) / nullif(sum(greatest(v, 0)) over (), 0), 6) share from v""")
def importance_shares(spark, sf):
    v = table(spark, sf, "part").groupBy("p_brand").agg((F.avg("p_retailprice") - 1400).alias("v"))
    return rollup.positive_shares(v, "v").select("p_brand", *r6("share"))


# Listings ------------------------------------------------------------------------------------------------------

@register("""with k as (select *, case when not coalesce(l_quantity between 2 and 48, false) then 'quantity' when not coalesce(l_extendedprice / l_quantity between 920 and 2100, false) then 'price' else 'kept' end reason from lineitem),
h as (select n_nationkey, n_name, case when n_nationkey % 5 = 0 then 'OVER' when n_nationkey % 5 = 1 then null else n_name end target, case when n_nationkey % 5 = 0 then 'override' when n_nationkey % 5 = 1 then 'none' else 'key' end link from nation)
select link, count(*) n, count(distinct target) targets from k join supplier on l_suppkey = s_suppkey join h on n_nationkey = s_nationkey where reason = 'kept' group by 1""")
def located_listings(spark, sf):
    """Cleaned rows linked to places through their labels: by hand, by key, or not at all."""
    li = table(spark, sf, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    rules = {"quantity": F.col("l_quantity").between(2, 48), "price": F.col("price").between(920, 2100)}
    kept = li.where(quality.staged_reject(rules).isNull())
    n = table(spark, sf, "nation")
    s = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.lower("n_name").alias("label"))
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")  # noqa: E731  (made names differ in digits only)
    keys = n.where("n_nationkey % 5 > 1").select(letters(F.col("n_name")).alias("key"), F.col("n_name").alias("target"))
    hand = n.where("n_nationkey % 5 = 0").select(F.lower("n_name").alias("name"), F.lit("OVER").alias("target"))
    linked = joins.cascade_link(kept.join(s, "l_suppkey"), "label", hand, keys, letters)
    return linked.groupBy("link").agg(F.count("*").alias("n"), F.countDistinct("target").alias("targets"))


CURRENT = """p as (select l_partkey id, l_extendedprice / l_quantity price, l_quantity size from lineitem where l_quantity between 2 and 48 and l_extendedprice / l_quantity between 500 and 2500),
c as (select median(ln(price)) m from p), s as (select 1.4826 * median(abs(ln(price) - m)) s from p, c), k as (select p.* from p, c, s where abs(ln(price) - m) / s <= 1.6),
b as (select n_nationkey poly, n_regionkey region, (n_nationkey % 5) * 2.0::double x0, (n_nationkey // 5) * 2.0::double y0 from nation),
pt as (select p_partkey id, (p_partkey * 37 % 997) / 100.0::double x, (p_partkey * 91 % 991) / 100.0::double y, case when p_partkey % 4 = 0 then p_partkey * 13 % 25 when p_partkey % 7 > 0 then least(4, (p_partkey * 37 % 997) // 200) + 5 * least(4, (p_partkey * 91 % 991) // 200) end tag from part),
h as (select id, min(region) region from pt join b on x > x0 + 0.005 and x < x0 + 1.505 and y > y0 + 0.005 and y < y0 + 1.505 group by 1),
t as (select pt.id, coalesce(bool_or(poly = tag and x between x0 + 0.002 and x0 + 1.508 and y between y0 + 0.002 and y0 + 1.508), false) ok, any_value(tag) tag, arg_min(poly, (x - x0 - 0.755) * (x - x0 - 0.755) + (y - y0 - 0.755) * (y - y0 - 0.755)) near from pt, b group by 1),
a as (select k.*, region, case when ok then tag else near end poly, ok from k join h using (id) join t using (id)),
hood as (select region, poly, count(*) n, median(price) v from a group by 1, 2), big as (select * from hood where n >= 10), every as (select 0 one, poly, count(*) n, median(price) v from a group by 2 having count(*) >= 10)"""


@register(f"""with {CURRENT}, {wq("big", "region", "v", "n", "poly", 0.5, "lv")}, {wq("every", "one", "v", "n", "poly", 0.5, "al")}
select 'hood' scope, poly unit, count(*) n, round(median(price), 6) level, round(median(size), 6) size, round(avg(ok::int), 6) tags_kept from a group by 2
union all select 'district', region, count(*), round(coalesce(max(lv.x), median(price)), 6), round(median(size), 6), round(avg(ok::int), 6) from a left join lv on lv.k = region group by 2
union all select 'city', -1, count(*), round(max(al.x), 6), round(median(size), 6), round(avg(ok::int), 6) from a, al""")
def current_tables(spark, sf):
    """The current period's tables: filtered, robustly cleaned and located rows summed up by unit, by group (level
    over the units with rows enough) and for the whole. A row's group is of the polygon that holds it; its unit is the
    tag it came with, where it lies in that unit's box, else the nearest unit."""
    li = table(spark, sf, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity")).where(F.col("l_quantity").between(2, 48) & F.col("price").between(500, 2500))
    kept = quality.robust_filter(li.select(F.col("l_partkey").alias("id"), "price", F.col("l_quantity").alias("size")), "price", [], 1.6)
    _, polys = points(spark, sf)
    id_, x, y = F.col("p_partkey"), F.col("p_partkey") * 37 % 997, F.col("p_partkey") * 91 % 991
    cell = F.least(F.lit(4), F.floor(x / 200)) + 5 * F.least(F.lit(4), F.floor(y / 200))
    spots = table(spark, sf, "part").select(id_.alias("id"), (x / 100.0).alias("x"), (y / 100.0).alias("y"), F.when(id_ % 4 == 0, id_ * 13 % 25).when(id_ % 7 > 0, cell).alias("tag"))
    regions = table(spark, sf, "nation").select(F.col("n_nationkey").alias("poly"), F.col("n_regionkey").alias("region"))
    group = geo.locate(spots.select("id", "x", "y"), polys).join(regions, "poly").select("id", "region")
    places = polys.select(F.col("poly").alias("name"), (F.col("x0") + 0.755).alias("cx"), (F.col("y0") + 0.755).alias("cy"), "x_min", "x_max", "y_min", "y_max")
    unit = geo.verified(spots, places, 0.003, 1.0, 10.0).select("id", F.col("name").alias("poly"), "ok")
    at = stored(group.join(unit, "id"))  # once for each place, not for each row
    a = stored(kept.join(at, "id").withColumn("city", F.lit(-1).cast("long")).withColumn("region", F.col("region").cast("long")).withColumn("poly", F.col("poly").cast("long")))
    scopes = {"hood": "poly", "district": "region", "city": "city"}
    found = rollup.scope_medians(a, scopes, ["price", "size"])
    tags = None
    for name, unit in scopes.items():
        one = a.groupBy(F.col(unit).alias("unit")).agg(F.avg(F.col("ok").cast("double")).alias("tags_kept")).withColumn("scope", F.lit(name))
        tags = one if tags is None else tags.unionByName(one)
    levels = None
    for name in ("district", "city"):
        one = rollup.level_with_fallback(a, scopes[name], "poly", "price", 10).select(F.lit(name).alias("scope"), F.col(scopes[name]).alias("unit"), "level")
        levels = one if levels is None else levels.unionByName(one)
    out = found.join(tags, ["scope", "unit"]).join(levels, ["scope", "unit"], "left")
    return out.select("scope", F.col("unit").cast("int").alias("unit"), "n", F.round(F.coalesce("level", "price"), 6).alias("level"), *r6("size", "tags_kept"))


@register("""with k as (select case when not coalesce(o_totalprice between 20000 and 400000, false) then 'price' when not coalesce(o_orderstatus in ('O', 'F'), false) then 'status' else 'kept' end reason from orders),
r as (select 'cleaning' section, reason metric, count(*)::double v from k group by 2 union all select 'priority', o_orderpriority, count(*) from orders group by 2 union all select 'coverage', 'linked', round(avg(case when c_nationkey % 5 <> 0 then 1.0 else 0 end), 6) from orders left join customer on o_custkey = c_custkey) select section, metric, v as value from r""")
def run_report(spark, sf):
    """Counts of cleaning, of values, and the linked share, as (section, metric, value)."""
    o = table(spark, sf, "orders")
    rules = {"price": F.col("o_totalprice").between(20000, 400000), "status": F.col("o_orderstatus").isin("O", "F")}
    cleaning = quality.reject_report(o, rules).select(F.lit("cleaning").alias("section"), F.col("reason").alias("metric"), F.col("rows").cast("double").alias("value"))
    values = o.groupBy("o_orderpriority").count().select(F.lit("priority").alias("section"), F.col("o_orderpriority").alias("metric"), F.col("count").cast("double").alias("value"))
    linked = o.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").withColumn("one", F.lit(1.0))
    share = rollup.coverage(linked, F.coalesce(F.col("c_nationkey") % 5 != 0, F.lit(False)), "one").select(F.lit("coverage").alias("section"), F.lit("linked").alias("metric"), F.round("share", 6).alias("value"))
    return cleaning.unionByName(values).unionByName(share)


@register("""with o as (select *, year(o_orderdate) p from orders), h as (select * from o where p < 1998 and o_orderkey % 3 <> 0), w as (select * from o where p = 1998) select p, count(*) n from (select o_orderkey, p from h union all select o_orderkey, p from w where o_orderkey not in (select o_orderkey from h)) group by 1""")
def appended_units(spark, sf):
    """Units that only the new period has, added to the old table; columns that it lacks are null."""
    o = table(spark, sf, "orders").withColumn("p", F.year("o_orderdate"))
    old = o.where("p < 1998 and o_orderkey % 3 <> 0")
    return joins.append_new(old, o.where("p = 1998").drop("o_orderpriority"), "o_orderkey").groupBy("p").agg(F.count("*").alias("n"))


# Calendar ------------------------------------------------------------------------------------------------------

#: Month starts as SQL: a known first day, and the lengths of all months since; leap years by their place in the cycle.
STARTS = """ym as (select jy, jm, case when jm <= 6 then 31 when jm <= 11 or jy % 33 in (1, 5, 9, 13, 17, 22, 26, 30) then 30 else 29 end len from (select unnest(generate_series(1370, 1385)) jy), (select unnest(generate_series(1, 12)) jm)),
starts as (select jy, jm, (jy - 1395) * 12 + jm - 1 t, date '1991-03-21' + cast(coalesce(sum(len) over (order by jy, jm rows between unbounded preceding and 1 preceding), 0) as int) d from ym)"""


@register(f"""with {STARTS}, o as (select distinct cast(o_orderdate as date) od from orders), a as (select od, max(d) d from o join starts on d <= od group by 1)
select od, jy::int jy, jm::int jm, (od - d + 1)::int jd, t::int t, jy || '/' || lpad(cast(jm as varchar), 2, '0') as label from a join starts using (d)""")
def jalali_dates(spark, sf):
    """Dates in the Solar Hijri calendar, against a join with the latest month start on or before each."""
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("od")).distinct()
    j = o.withColumn("j", calendar.from_gregorian(F.col("od")))
    return j.select("od", "j.jy", "j.jm", "j.jd", calendar.month_of(F.col("od")).alias("t"), calendar.month_label(F.col("j.jy"), F.col("j.jm")).alias("label"))


MONTH_NAMES = "[" + ", ".join(f"'{m}'" for m in calendar.MONTHS) + "]"


@register(f"""with {STARTS}, o as (select distinct year(o_orderdate) y, month(o_orderdate) m from orders), a as (select y, m, max(d) d from o join starts on d <= make_date(y, m, 15) group by 1, 2)
select y::int y, m::int m, t::int t, ({MONTH_NAMES})[jm] as "name" from a join starts using (d)""")
def gregorian_months(spark, sf):
    """Gregorian months on the calendar's month axis by their 15th."""
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).distinct()
    t = calendar.month_of_gregorian(F.col("y"), F.col("m"))
    return o.withColumn("t", t).select("y", "m", "t", calendar.month_name(calendar.from_month_index(F.col("t"))["jm"]).alias("name"))


@register(f"""with {STARTS}, l as (select max(t) t from starts where d <= (select cast(max(o_orderdate) as date) from orders)) select h::int h, s.jy::int jy, s.jm::int jm, s.d starts from l, (select unnest(generate_series(1, 24)) h), starts s where s.t = l.t + h""")
def future_months(spark, sf):
    """The 24 months after the last order with their first days."""
    last = table(spark, sf, "orders").agg(calendar.month_of(F.to_date(F.max("o_orderdate"))).alias("t"))
    m = last.select("t", F.explode(F.sequence(F.lit(1), F.lit(24))).alias("h")).withColumn("t", F.col("t") + F.col("h"))
    j = calendar.from_month_index(F.col("t"))
    return m.select("h", j["jy"].alias("jy"), j["jm"].alias("jm"), calendar.month_start(F.col("t")).alias("starts"))


# As-of joins -----------------------------------------------------------------------------------------------------

CLICKS = "c as (select user_id, ts, arg_max(event_id, event_id) click, arg_max(value, event_id) worth from events where event_type = 'click' group by 1, 2), b as (select event_id, user_id, ts from events where event_type = 'purchase')"


@register(f"""with {CLICKS} select b.event_id, case when c.ts >= b.ts - interval 6 hour then click end as_of_event_id, case when c.ts >= b.ts - interval 6 hour then worth end as_of_value from b asof left join c on b.user_id = c.user_id and b.ts >= c.ts""")
def last_click(spark, sf):
    """Each purchase with the user's last click of the six hours before."""
    e = table(spark, sf, "events")
    bought, clicks = (e.where(F.col("event_type") == k).select("event_id", "user_id", "ts", "value") for k in ("purchase", "click"))
    out = asof.asof_join(bought, clicks, ["user_id"], "ts", ["event_id", "value"], ["event_id"], F.expr("interval 6 hours"))
    return out.select("event_id", "as_of_event_id", "as_of_value")


@register("""with p as (select cast(o_orderdate as date) d, o_orderpriority k, median(o_totalprice) m from orders where day(o_orderdate) <= 3 group by 1, 2), b as (select o_orderkey, cast(o_orderdate as date) d, o_orderpriority k, o_totalprice from orders)
select o_orderkey, round(o_totalprice / m, 6) ratio from b asof left join p on b.k = p.k and b.d > p.d""")
def price_as_of(spark, sf):
    """Each order's price against the last published level of its priority before that day; levels come out on the
    first days of a month."""
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderpriority", "o_totalprice")
    levels = o.where(F.day("day") <= 3).groupBy("day", "o_orderpriority").agg(F.median("o_totalprice").alias("level"))
    out = asof.asof_join(o, levels, ["o_orderpriority"], "day", ["level"], strict=True)
    return out.select("o_orderkey", F.round(F.col("o_totalprice") / F.col("as_of_level"), 6).alias("ratio"))
