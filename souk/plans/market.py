"""Registered queries of the market operators on the driver's tables, each beside SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.functions import calendar, text
from souk.operators import geo, joins, periods, quality, rollup, series, valuation
from souk.operators.selection import Values, and_all
from souk.operators.weighted import weighted_mean
from souk.sources.tables import stored

QUERIES, ORACLE_SQL = {}, {}


def register(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def units(spark, sf) -> DataFrame:
    """Supplier nations' shipments: nation, supplier, part, unit price and weight."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("w"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return li.join(s, "l_suppkey").join(n, "n_nationkey")


UNITS = """units as (select n_name, n_regionkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice / l_quantity price, l_quantity w
 from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)"""


def wq(source: str, key: str, v: str, w: str, tie: str, q: float, name: str) -> str:
    """Weighted quantile as SQL: CTE of the given name with (k, x)."""
    return f"""{name}_c as (select {key} k, {v} v, sum({w}) over (partition by {key} order by {v}, {w} desc, {tie} rows unbounded preceding) - 0.5 * {w} cw, {q} * sum({w}) over (partition by {key}) t from {source} where {v} is not null and {w} > 0),
{name}_g as (select k, max(t) t, max(cw) filter (where cw <= t) c0, min(cw) filter (where cw > t) c1, arg_max(v, cw) filter (where cw <= t) v0, arg_min(v, cw) filter (where cw > t) v1 from {name}_c group by k),
{name} as (select k, case when c0 is null then v1 when c1 is null then v0 else v0 + (v1 - v0) * (t - c0) / (c1 - c0) end x from {name}_g)"""


@register(f"""with {UNITS}, {wq("units", "n_name", "price", "w", "l_orderkey, l_linenumber", 0.5, "m")},
{wq("(select 0 one, * from units)", "one", "price", "w", "l_orderkey, l_linenumber", 0.5, "a")}
select m.k n_name, round(m.x, 6) p50, cast(floor(rank() over (order by m.x desc) + (count(*) over (partition by m.x) - 1) / 2.0) as int) place, round(m.x / a.x - 1, 6) vs_total from m, a""")
def nation_price_table(spark, sf):
    found = stored(Values(units(spark, sf), ["n_name"], "price", "w").weighted({"p50": 0.5}, and_all("n_name"), ["n_name", "all"]))
    total = found.where("all").select(F.col("p50").alias("total"))
    return found.where("not all").withColumn("place", rollup.average_rank("p50")).crossJoin(F.broadcast(total)).select("n_name", F.round("p50", 6).alias("p50"), "place", F.round(F.try_divide(F.col("p50"), F.col("total")) - 1, 6).alias("vs_total"))


@register(f"""with {UNITS} select n_name, round(sum(price * w) / sum(w), 6) mean_price, count(*) n from units group by n_name""")
def nation_weighted_mean(spark, sf):
    return units(spark, sf).groupBy("n_name").agg(F.round(weighted_mean("price", "w"), 6).alias("mean_price"), F.count("*").alias("n"))


SUPPLIERS = f"""{UNITS}, members as (select n_regionkey, n_name, sum(w) weight, median(price) value from units group by all)"""


@register(f"""with {SUPPLIERS}, {wq("members", "n_regionkey", "value", "weight", "n_name", 0.25, "q1")}, {wq("members", "n_regionkey", "value", "weight", "n_name", 0.5, "q2")}, {wq("members", "n_regionkey", "value", "weight", "n_name", 0.75, "q3")},
s as (select n_regionkey, count(*) members, round(sum(weight), 6) weight, arg_min(n_name, (value, n_name)) filter (where weight >= 100) cheapest, arg_min(n_name, (-value, n_name)) filter (where weight >= 100) dearest,
 arg_min(n_name, (-weight, n_name)) largest, round(max(weight) / sum(weight), 6) largest_share from members group by 1)
select s.*, round(q1.x, 6) p25, round(q2.x, 6) p50, round(q3.x, 6) p75 from s join q1 on q1.k = n_regionkey join q2 on q2.k = n_regionkey join q3 on q3.k = n_regionkey""")
def region_rollup(spark, sf):
    m = units(spark, sf).groupBy("n_regionkey", "n_name").agg(F.sum("w").alias("weight"), F.median("price").alias("value"))
    out = rollup.rollup(m, ["n_regionkey"], "n_name", "value", "weight", 100)
    return out.select("n_regionkey", "members", *r6("weight"), "cheapest", "dearest", "largest", *r6("largest_share", "p25", "p50", "p75"))


@register("""with l as (select *, ln(l_extendedprice / l_quantity) x from lineitem), m as (select l_returnflag f, median(x) m from l group by 1),
s as (select f, m, 1.4826 * median(abs(x - m)) s from l join m on l_returnflag = f group by 1, 2)
select l_returnflag, count(*) n, round(min(x), 6) low, round(max(x), 6) high from l join s on l_returnflag = f where abs(x - m) / nullif(s, 0) <= 1.5 group by 1""")
def robust_filter_lineitem(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    return quality.robust_filter(li, "price", ["l_returnflag"], 1.5).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.min(F.ln("price")), 6).alias("low"), F.round(F.max(F.ln("price")), 6).alias("high"))


@register("""select case when not coalesce(o_totalprice between 20000 and 400000, false) then 'price' when not coalesce(o_orderstatus in ('O', 'F'), false) then 'status' when o_orderdate is null then 'date' else 'kept' end reason, count(*) "rows" from orders group by 1""")
def clean_report_orders(spark, sf):
    rules = {"price": F.col("o_totalprice").between(20000, 400000), "status": F.col("o_orderstatus").isin("O", "F"), "date": F.col("o_orderdate").isNotNull()}
    return quality.reject_report(table(spark, sf, "orders"), rules)


@register("""select p_partkey, case when p_size >= 40 then 'large' when p_retailprice > 1200 then 'dear' else 'plain' end flag from part""")
def quality_flag_parts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", quality.label([(F.col("p_size") >= 40, "large"), (F.col("p_retailprice") > 1200, "dear")], "plain").alias("flag"))


@register("""select printf('CU-%05d', row_number() over (order by c_acctbal nulls first, c_custkey nulls first)) key, c_custkey from customer""")
def surrogate_keys(spark, sf):
    return quality.surrogate_key(table(spark, sf, "customer").select("c_acctbal", "c_custkey"), ["c_acctbal", "c_custkey"], "CU").select("key", "c_custkey")


@register("""select 'unique' "check", count(*) failures from (select o_orderkey from orders group by 1 having count(*) > 1) union all select 'positive', count(*) filter (where not o_totalprice > 0) from orders union all select 'dated', count(*) filter (where o_orderdate is null) from orders""")
def order_expectations(spark, sf):
    return quality.expectations(table(spark, sf, "orders"), ["o_orderkey"], {"positive": F.col("o_totalprice") > 0, "dated": F.col("o_orderdate").isNotNull()})


@register("""select p_brand, count(*) n, round(quantile_cont(p_retailprice, 0.25), 6) p25, round(quantile_cont(p_retailprice, 0.5), 6) p50, round(quantile_cont(p_retailprice, 0.75), 6) p75, round(avg(case when p_size > 25 then 1.0 else 0 end), 6) big from part group by 1""")
def brand_distribution(spark, sf):
    return rollup.distribution(table(spark, sf, "part"), ["p_brand"], "p_retailprice", {"big": F.col("p_size") > 25}).select("p_brand", "n", *r6("p25", "p50", "p75", "big"))


@register(f"""with m as (select c_mktsegment g, c_nationkey k, median(c_acctbal) v, count(*) n from customer group by 1, 2 having count(*) >= 12), {wq("m", "g", "v", "n", "k", 0.5, "l")}
select c_mktsegment, count(*) n, round(coalesce(max(l.x), median(c_acctbal)), 6) level, max(l.x) is not null from_members from customer left join l on l.k = c_mktsegment group by 1""")
def level_with_fallback(spark, sf):
    return rollup.level_with_fallback(table(spark, sf, "customer"), "c_mktsegment", "c_nationkey", "c_acctbal", 12).select("c_mktsegment", "n", *r6("level"), "from_members")


@register("""with c as (select o_orderstatus s, o_orderpriority p, count(*) n from orders group by 1, 2) select s o_orderstatus, arg_min(p, (-n, p)) top from c group by 1""")
def mode_priority(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.mode("o_orderpriority", True).alias("top"))


@register("""select p_brand, round(regr_slope(ln(p_retailprice), ln(p_size)), 6) slope, round(regr_intercept(ln(p_retailprice), ln(p_size)), 6) intercept, round(corr(ln(p_size), ln(p_retailprice)), 6) r,
 case when corr(ln(p_size), ln(p_retailprice)) < -0.3 then 'catching up' when corr(ln(p_size), ln(p_retailprice)) > 0.3 then 'pulling away' else 'mixed' end verdict from part where p_size > 0 and p_retailprice > 0 group by 1""")
def log_growth_fit(spark, sf):
    return rollup.log_fit(table(spark, sf, "part"), ["p_brand"], "p_size", "p_retailprice").select("p_brand", *r6("slope", "intercept", "r"), "verdict")


@register("""select 'all' scope, count(*) n, round(median(o_totalprice), 6) p50 from orders union all select o_orderpriority, count(*), round(median(o_totalprice), 6) from orders group by 1""")
def snapshot_union(spark, sf):
    o = table(spark, sf, "orders").withColumn("city", F.lit("all"))
    return rollup.scope_medians(o, {"all": "city", "priority": "o_orderpriority"}, ["o_totalprice"]).select(F.col("unit").alias("scope"), "n", F.round("o_totalprice", 6).alias("p50"))


@register("""with y as (select c_nationkey u, year(o_orderdate) p, round(sum(o_totalprice), 2) v from orders join customer on o_custkey = c_custkey group by 1, 2), l as (select *, lag(p) over w lp, lag(v) over w lv from y window w as (partition by u order by p)),
g as (select u, p, v, case when lp = p - 1 then lv end previous from l) select u, p, v, previous, round(v / nullif(previous, 0) - 1, 6) growth, rank() over (partition by p order by v desc) place from g""")
def period_growth(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    y = o.groupBy(F.col("c_nationkey").alias("u"), F.year("o_orderdate").alias("p")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return periods.growth(y, "u", "p", "v").select("u", "p", "v", "previous", *r6("growth"), rollup.competition_rank("v", ["p"]).cast("long").alias("place"))


@register("""with b as (select p_brand, list_sort(list(p_retailprice)) s, count(*) n from part group by 1), e as (select p_brand, list_distinct(list_transform([1, 2, 3, 4], lambda i: s[least(n - 1, i * n // 5) + 1])) br from b)
select p_partkey, cast(len(list_filter(br, lambda x: x <= p_retailprice)) as int) class from part join e using (p_brand)""")
def class_of_parts(spark, sf):
    p = table(spark, sf, "part")
    return p.join(periods.class_breaks(p, ["p_brand"], "p_retailprice", 5), "p_brand").select("p_partkey", periods.class_of(F.col("p_retailprice"), F.col("breaks")).alias("class"))


@register("""with n as (select a.s_suppkey as unit, b.s_suppkey as "similar", row_number() over (partition by a.s_suppkey order by b.s_acctbal desc, b.s_suppkey) as "rank" from supplier a join supplier b on abs(b.s_acctbal / a.s_acctbal - 1) < 0.07 and a.s_nationkey <> b.s_nationkey where a.s_acctbal > 0 and b.s_acctbal > 0) select * from n where "rank" <= 8""")
def similar_suppliers(spark, sf):
    return periods.similar_units(table(spark, sf, "supplier"), "s_suppkey", "s_nationkey", "s_acctbal", "s_acctbal")


@register("""select p_brand, b budget, count(*) filter (where p_retailprice <= b) fits, count(*) filter (where p_retailprice > b and p_retailprice <= b * 1.2) near, count(*) filter (where p_retailprice > b * 1.2) above from part, (values (1000.0::double), (1300.0::double)) t(b) group by 1, 2""")
def affordability(spark, sf):
    p = table(spark, sf, "part").withColumn("budget", F.explode(F.array(F.lit(1000.0), F.lit(1300.0)))).withColumn("c", periods.afford_class(F.col("p_retailprice"), F.col("budget")))
    return p.groupBy("p_brand", "budget").agg(*[F.count_if(F.col("c") == i).alias(n) for i, n in enumerate(("fits", "near", "above"))])


@register("""select c_custkey, case c_mktsegment when 'BUILDING' then 'CONSTRUCTION' when 'MACHINERY' then null else c_mktsegment end target, case c_mktsegment when 'BUILDING' then 'override' when 'MACHINERY' then 'none' else 'key' end link from customer""")
def cascade_link(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.lower("c_mktsegment").alias("label"))
    keys = table(spark, sf, "customer").where("c_mktsegment not in ('BUILDING', 'MACHINERY')").select(text.place_key(F.col("c_mktsegment")).alias("key"), F.col("c_mktsegment").alias("target")).distinct()
    hand = c.where("label = 'building'").select(F.col("label").alias("name"), F.lit("CONSTRUCTION").alias("target")).distinct()
    return joins.cascade_link(c, "label", hand, keys, text.place_key).select("c_custkey", "target", "link")


@register("""with a as (select p_partkey, p_size from part where p_partkey % 3 <> 0), b as (select p_partkey, case when p_partkey % 7 = 0 then p_size + 1 else p_size end p_size from part where p_partkey % 5 <> 0)
select side, count(*) n from (select *, 'left' side from (select * from a except all select * from b) union all select *, 'right' from (select * from b except all select * from a)) group by 1""")
def table_diff(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    b = p.where("p_partkey % 5 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return joins.table_diff(p.where("p_partkey % 3 <> 0"), b).groupBy("side").agg(F.count("*").alias("n"))


@register("""with o as (select cast(o_orderdate as date) d, count(*) n from orders group by 1), x as (select * from o where day(d) <> 1), y as (select d, n + 1 n from o where day(d) <= 2)
select d, n from x where d not in (select d from y) union all select d, n from y""")
def upsert_days(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    return joins.replace_by_key(o.where(F.day("d") != 1), o.where(F.day("d") <= 2).withColumn("n", F.col("n") + 1), "d")


MONTHS = """mm as (select c_mktsegment s, (year(o_orderdate) - 1990) * 12 + month(o_orderdate) t, sum(o_totalprice) v from orders join customer on o_custkey = c_custkey group by 1, 2),
sp as (select s, unnest(generate_series(min(t), max(t))) t from mm group by 1), ser as (select sp.s series, sp.t - min(sp.t) over () t, ln(v) y from sp left join mm using (s, t))"""


def months(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    m = o.groupBy(F.col("c_mktsegment").alias("series"), ((F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate")).alias("t")).agg(F.sum("o_totalprice").alias("v"))
    first = m.agg(F.min("t")).scalar()
    return series.spine(m, "series", "t").join(m, ["series", "t"], "left").withColumn("f", first).select("series", (F.col("t") - F.col("f")).cast("int").alias("t"), F.ln("v").alias("y"))


@register(f"""with {MONTHS} select series, cast(t as int) t, round(exp(y), 2) v, round(exp(y) / exp(lag(y, 12) over w) - 1, 6) yoy, round(exp(y) / exp(lag(y, 1) over w) - 1, 6) mom from ser window w as (partition by series order by t)""")
def monthly_changes(spark, sf):
    m = months(spark, sf).withColumn("v", F.exp("y"))
    return m.select("series", "t", F.round("v", 2).alias("v"), F.round(series.changes(m, "series", "t", "v", 12), 6).alias("yoy"), F.round(series.changes(m, "series", "t", "v", 1), 6).alias("mom"))


@register(f"""with {MONTHS}, z as (select series, t, case when t % 4 = 0 then y end y from ser), f as (select *, last_value(case when y is not null then t end ignore nulls) over b ta, last_value(y ignore nulls) over b ya, first_value(case when y is not null then t end ignore nulls) over c tz, first_value(y ignore nulls) over c yz from z
 window b as (partition by series order by t rows unbounded preceding), c as (partition by series order by t rows between current row and unbounded following))
select series, cast(t as int) t, round(coalesce(y, case when tz <> ta then ya + (yz - ya) * (t - ta) / (tz - ta) end, ya, yz), 6) filled from f""")
def gap_fill(spark, sf):
    z = months(spark, sf).withColumn("y", F.when(F.col("t") % 4 == 0, F.col("y")))
    return series.gap_fill(z, "series", "t", "y").select("series", "t", *r6("filled"))


@register("""select distinct cast(o_orderdate as date) d, cast(datediff('month', date '1990-01-01', o_orderdate) as int) gregorian_month from orders""")
def order_months(spark, sf):
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.select("d", ((F.year("d") - 1990) * 12 + F.month("d") - 1).alias("gregorian_month"))


POINTS = "pts as (select c_custkey id, (c_custkey * 37 % 1000) / 100.0::double x, (c_custkey * 91 % 1000) / 100.0::double y from customer), boxes as (select n_nationkey poly, (n_nationkey % 5) * 2.0::double x0, (n_nationkey // 5) * 2.0::double y0 from nation)"


def points(spark, sf):
    c = table(spark, sf, "customer")
    pts = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 1000 / 100.0).alias("x"), (F.col("c_custkey") * 91 % 1000 / 100.0).alias("y"))
    b = table(spark, sf, "nation").select(F.col("n_nationkey").alias("poly"), (F.col("n_nationkey") % 5 * 2.0).alias("x0"), (F.floor(F.col("n_nationkey") / 5) * 2.0).alias("y0"))
    side = lambda x1, y1, x2, y2: F.struct(*[e.cast("double").alias(n) for e, n in ((F.col("x0") + x1, "x1"), (F.col("y0") + y1, "y1"), (F.col("x0") + x2, "x2"), (F.col("y0") + y2, "y2"))])
    square = F.array(side(0.005, 0.005, 1.505, 0.005), side(1.505, 0.005, 1.505, 1.505), side(1.505, 1.505, 0.005, 1.505), side(0.005, 1.505, 0.005, 0.005))
    return pts, b.select("poly", "x0", "y0", square.alias("edges"), (F.col("x0") + 0.005).alias("x_min"), (F.col("x0") + 1.505).alias("x_max"), (F.col("y0") + 0.005).alias("y_min"), (F.col("y0") + 1.505).alias("y_max"))


@register(f"""with {POINTS} select id, min(poly) poly from pts left join boxes on x > x0 + 0.005 and x < x0 + 1.505 and y > y0 + 0.005 and y < y0 + 1.505 group by 1""")
def point_in_polygon(spark, sf):
    pts, polys = points(spark, sf)
    return geo.locate(pts, polys)


@register(f"""with {POINTS}, d as (select id, poly, greatest(x0 + 0.005 - x, x - x0 - 1.505, 0) dx, greatest(y0 + 0.005 - y, y - y0 - 1.505, 0) dy from pts, boxes), o as (select id from d group by id having min(dx + dy) > 0)
select id, poly, case when poly is null then 'outside' else 'snapped' end status from (select o.id, arg_min(poly, (round(sqrt(dx * dx + dy * dy), 9), poly)) filter (where sqrt(dx * dx + dy * dy) <= 0.3) poly from o join d using (id) group by 1)""")
def snap_nearest(spark, sf):
    pts, polys = points(spark, sf)
    out = geo.locate(pts, polys).where("poly is null").select("id")
    return geo.snap(pts.join(out, "id"), polys, 0.3)


@register(f"""with {POINTS}, d as (select id, poly, pow(x - x0, 2) + pow(y - y0, 2) d2 from pts, boxes) select id, arg_min(poly, (d2, poly)) as name, round(min(d2), 6) d2 from d group by 1""")
def nearest_centroid(spark, sf):
    pts, polys = points(spark, sf)
    return geo.nearest_centroid(pts, polys.select(F.col("poly").alias("name"), F.col("x0").alias("cx"), F.col("y0").alias("cy")), 2.0, 20.0).select("id", "name", *r6("d2"))


#: Folds of parts as valuation.fold() deals them, with seeds 42 and 7.
FOLD, INNER = (f"('0x' || substr(md5(p_partkey::varchar || ':{seed}'), 1, 8))::bigint % 5" for seed in (42, 7))
OOF = f"""f as (select p_partkey, p_brand, ln(p_retailprice) y, ln(p_size + 1) x, {FOLD} fold from part), k as (select p_brand, y, u.g from f, (select unnest([0, 1, 2, 3, 4]) g) u where u.g <> fold), a as (select g, median(y) al from k group by 1), m as (select g, p_brand, median(y) md, count(*) n from k group by 1, 2),
e as (select f.*, coalesce((md * n + al * 5) / (n + 5), al) level from f join a on a.g = fold left join m on m.g = fold and m.p_brand = f.p_brand)"""


def encoded(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.ln("p_retailprice").alias("y"), F.ln(F.col("p_size") + 1).alias("x")).withColumn("fold", valuation.fold("p_partkey"))
    return valuation.out_of_fold_encoding(p, "p_brand", "y", "fold")


@register(f"with {OOF} select p_partkey, round(level, 6) level from e")
def out_of_fold_levels(spark, sf):
    return encoded(spark, sf).select("p_partkey", *r6("level"))


@register(f"with {OOF} select round(1 - sum(pow(level - y, 2)) / (var_pop(y) * count(*)), 6) r2, round(avg(abs(exp(level - y) - 1)), 6) mape, round(median(abs(exp(level - y) - 1)), 6) median_ape, round(avg(case when abs(exp(level - y) - 1) <= 0.2 then 1.0 else 0 end), 6) within_20 from e")
def out_of_fold_errors(spark, sf):
    return valuation.error_measures(encoded(spark, sf), "y", "level").select(*r6("r2", "mape", "median_ape", "within_20"))


@register("select 'x' term, round(regr_slope(ln(p_retailprice), ln(p_size + 1)), 6) as value from part union all select 'intercept', round(regr_intercept(ln(p_retailprice), ln(p_size + 1)), 6) from part")
def hedonic_coefficients(spark, sf):
    p = table(spark, sf, "part").select(F.ln("p_retailprice").alias("y"), F.ln(F.col("p_size") + 1).alias("x"))
    return valuation.coefficients(p, ["x"], "y").select("term", *r6("value"))
