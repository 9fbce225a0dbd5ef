"""Registered queries of the valuation model, each beside its SQL. Parts stand for homes, brands for places."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.operators import periods, rollup, selection, series, valuation
from souk.sources.tables import scratch, spread, stored, write_history

from .market import FOLD, INNER, MONTHS, OOF, encoded, months, r6, register, table

FOLDS = f"{FOLD} fold, {INNER} inn"
CV = f"""f as (select p_partkey id, p_brand, ln(p_retailprice) y, ln(p_size + 1) x, ln(p_retailprice) - ln(p_size + 1) lp, {FOLDS} from part), fs as (select unnest([0, 1, 2, 3, 4]) f),
tr as (select f.*, fs.f from f, fs where fold <> fs.f), seen as (select tr.*, g from tr, (select unnest([-1, 0, 1, 2, 3, 4]) g) where g <> inn),
al as (select f, g, median(lp) al from seen group by 1, 2), lv as (select f, g, p_brand, median(lp) m, count(*) n from seen group by 1, 2, 3),
r as (select f.*, fs.f, fold = fs.f test, case when fold = fs.f then -1 else inn end g from f, fs),
e as (select r.*, coalesce((m * n + al * 5) / (n + 5), al) lev from r join al on al.f = r.f and al.g = r.g left join lv on lv.f = r.f and lv.g = r.g and lv.p_brand = r.p_brand),
c as (select f, var_pop(x) s11, var_pop(lev) s22, covar_pop(x, lev) s12, covar_pop(x, y) s1, covar_pop(lev, y) s2, avg(x) mx, avg(lev) ml, avg(y) my from e where not test group by 1),
b as (select *, (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) b1, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) b2 from c),
oof as (select e.*, my - b1 * mx - b2 * ml + b1 * x + b2 * lev hedonic_ols, x + lev location_only from e join b using (f) where test)"""


def homes(spark, sf):
    p = spread(table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size"))
    p = p.select(F.col("p_partkey").alias("id"), "p_brand", F.ln("p_retailprice").alias("y"), F.ln(F.col("p_size") + 1).alias("x"))
    p = p.withColumn("lp", F.col("y") - F.col("x"))
    return p.withColumn("fold", valuation.fold("id")).withColumn("inn", valuation.fold("id", seed=7))


def predicted(spark, sf):
    return valuation.cross_validated(homes(spark, sf), "p_brand", "lp", "x", "y", [], "fold", "inn")


@register(f"""with {CV}, m as (select 'hedonic_ols' model, y, hedonic_ols p from oof union all select 'location_only', y, location_only from oof) select model, round(1 - sum(pow(p - y, 2)) / (var_pop(y) * count(*)), 6) r2, round(avg(abs(exp(p - y) - 1)), 6) mape, round(median(abs(exp(p - y) - 1)), 6) median_ape, round(avg(case when abs(exp(p - y) - 1) <= 0.2 then 1.0 else 0 end), 6) within_20 from m group by 1""")
def model_comparison(spark, sf):
    """Out-of-fold errors of least squares with a nested location level, and of location alone."""
    return valuation.compared(predicted(spark, sf), "y", ["hedonic_ols", "location_only"]).select("model", *r6("r2", "mape", "median_ape", "within_20"))


@register(f"with {CV} select id, round(hedonic_ols, 6) hedonic_ols, round(location_only, 6) location_only from oof")
def nested_predictions(spark, sf):
    return predicted(spark, sf).select("id", *r6("hedonic_ols", "location_only"))


@register(f"""with {CV} select round(exp(-quantile_cont(hedonic_ols - y, 0.9)), 6) q10, round(exp(-quantile_cont(hedonic_ols - y, 0.75)), 6) q25, round(exp(-quantile_cont(hedonic_ols - y, 0.25)), 6) q75, round(exp(-quantile_cont(hedonic_ols - y, 0.1)), 6) q90 from oof""")
def prediction_interval(spark, sf):
    """The band of actual over predicted prices from out-of-fold errors."""
    e = predicted(spark, sf).withColumn("e", F.col("hedonic_ols") - F.col("y"))
    return rollup.error_interval(e, "e").select(*r6("q10", "q25", "q75", "q90"))


@register(f"""with {CV}, d as (select y - hedonic_ols r from oof) select round(quantile_cont(r, 0.1), 6) q10, round(quantile_cont(r, 0.25), 6) q25, round(quantile_cont(r, 0.5), 6) q50, round(quantile_cont(r, 0.75), 6) q75, round(quantile_cont(r, 0.9), 6) q90 from d""")
def residual_quantiles(spark, sf):
    e = predicted(spark, sf).withColumn("r", F.col("y") - F.col("hedonic_ols"))
    return rollup.residual_quantiles(e, "r").select(*r6("q10", "q25", "q50", "q75", "q90"))


#: Of the boosted trees: how many, and the step; few and large, so that the query is soon done.
TREES, STEP = 20, 0.2


def boosting_comparison(spark, sf):
    """Out-of-fold errors of boosted trees on size and level, beside those of least squares and of location alone, on
    the same folds. SQL cannot fit the trees."""
    both = stored(predicted(spark, sf).select("id", "hedonic_ols", "location_only"))
    out = valuation.boosted(homes(spark, sf), "p_brand", "lp", ["x"], "y", "fold", "inn", trees=TREES, step=STEP).join(both, "id")
    return valuation.compared(out, "y", ["hedonic_ols", "location_only", "gradient_boosting"]).select("model", *r6("r2", "mape", "median_ape", "within_20"))


def boosting_importance(spark, sf):
    """How much R2 falls when size or level is dealt anew within each fold, for boosted trees."""
    rows = stored(valuation.nested_encoding(homes(spark, sf), "p_brand", "lp", "fold", "inn"))
    fits = valuation.boosted_fits(rows, ["x", "level"], "y", trees=TREES, step=STEP)
    return valuation.permutation_importance(rows.where("test"), "id", ["x", "level"], "y", lambda c: valuation.tree_sum(F.col("trees"), [c["x"], c["level"]]), repeats=3, within=["outer_fold"], models=fits).select("feature", *r6("drop"))


FIT = f"""{OOF}, s as (select var_pop(x) s11, var_pop(level) s22, covar_pop(x, level) s12, covar_pop(x, y) s1, covar_pop(level, y) s2, avg(x) mx, avg(level) ml, avg(y) my from e), b as (select *, (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) b1, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) b2 from s)"""
FIT = FIT.replace("level from f join", "\"level\" from f join").replace("var_pop(level)", 'var_pop("level")').replace("covar_pop(x, level)", 'covar_pop(x, "level")').replace("covar_pop(level, y)", 'covar_pop("level", y)').replace("avg(level)", 'avg("level")')


@register(f"""with {FIT} select term, round(v, 6) as value, case when term <> 'intercept' then round(exp(v) - 1, 6) end premium, case when term <> 'intercept' then round(pow(1.1, v - 1) - 1, 6) end ten_percent from (select 'x' term, b1 v from b union all select 'level', b2 from b union all select 'intercept', my - b1 * mx - b2 * ml from b)""")
def premium_table(spark, sf):
    """Coefficients of the final fit, on out-of-fold levels, as premiums and elasticities."""
    fit = valuation.least_squares(encoded(spark, sf), [], ["x", "level"], "y")
    terms = F.explode(F.arrays_zip(F.array(*map(F.lit, ("intercept", "x", "level"))).alias("term"), F.col("beta").alias("value"))).alias("t")
    return fit.select(terms).select("t.*").select("term", *r6("value"), *[F.when(F.col("term") != "intercept", F.round(c, 6)).alias(n) for n, c in (("premium", valuation.premium(F.col("value"))), ("ten_percent", valuation.elasticity_10(F.col("value"))))])


UNIFORM = "(('0x' || substr(md5(concat_ws(':', cast(p_partkey as varchar), cast({rep} as varchar), '7')), 1, 8))::bigint / 4294967296.0::double)"
CUTS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


@register(f"""with d as (select p_partkey, ln(p_retailprice) y, ln(p_size + 1) x, rep, {UNIFORM.format(rep="rep")} u from part, (select unnest(generate_series(1, 50)) rep)),
w as (select *, {" + ".join(f"(u >= {c!r}::double)::int" for c in CUTS)} w from d), s as (select rep, sum(w) n, sum(w * x) sx, sum(w * y) sy, sum(w * x * x) sxx, sum(w * x * y) sxy from w group by 1),
b as (select (sxy - sx * sy / n) / (sxx - sx * sx / n) b, sy / n - (sxy - sx * sy / n) / (sxx - sx * sx / n) * sx / n a from s)
select 'x' term, round(quantile_cont(b, 0.05), 6) low, round(quantile_cont(b, 0.95), 6) high from b union all select 'intercept', round(quantile_cont(a, 0.05), 6), round(quantile_cont(a, 0.95), 6) from b""")
def bootstrap_intervals(spark, sf):
    """Intervals of coefficients over 50 bootstrap samples."""
    p = table(spark, sf, "part").select("p_partkey", F.ln("p_retailprice").alias("y"), F.ln(F.col("p_size") + 1).alias("x"))
    return valuation.bootstrap_intervals(p, "p_partkey", ["x"], "y", repeats=50).select("term", *r6("low", "high"))


@register(f"""with {CV}, t as (select id, f, y, x, lev, my - b1 * mx - b2 * ml b0, b1, b2, row_number() over (partition by f order by id) i from e join b using (f) where test), base as (select 1 - sum(pow(y - (b0 + b1 * x + b2 * lev), 2)) / (var_pop(y) * count(*)) r from t),
d as (select rep, f, x x2, lev lev2, row_number() over (partition by rep, f order by md5(concat_ws(':', cast(id as varchar), cast(rep as varchar), '7')), id) i from t, (select unnest([1, 2, 3]) rep)),
pr as (select rep, 1 - sum(pow(y - (b0 + b1 * x2 + b2 * lev), 2)) / (var_pop(y) * count(*)) a, 1 - sum(pow(y - (b0 + b1 * x + b2 * lev2), 2)) / (var_pop(y) * count(*)) b from t join d using (f, i) group by 1)
select 'x' feature, round(avg(base.r - a), 6) "drop" from pr, base union all select 'level', round(avg(base.r - b), 6) from pr, base""")
def permutation_importance(spark, sf):
    """How much R2 falls when size or level is dealt anew within each fold, for the cross-validated least squares."""
    rows = stored(valuation.nested_encoding(homes(spark, sf), "p_brand", "lp", "fold", "inn"))
    fits = stored(valuation.least_squares(rows.where("not test"), ["outer_fold"], ["x", "level"], "y").select("outer_fold", "beta"))
    return valuation.permutation_importance(rows.where("test"), "id", ["x", "level"], "y", lambda c: valuation.linear([c["x"], c["level"]]), repeats=3, within=["outer_fold"], models=fits).select("feature", *r6("drop"))


PLACES = f"""iv as (with {CV} select exp(-quantile_cont(hedonic_ols - y, 0.9)) q10, exp(-quantile_cont(hedonic_ols - y, 0.1)) q90 from oof), co as (with {FIT} select b1 b_x from b),
gr as (with {MONTHS} select exp(6 * (arg_max(y, t) - arg_min(y, t)) / (max(t) - min(t))) - 1 roll from ser where series = 'BUILDING' and y is not null),
pl as (select p_brand, median(p_retailprice) "level", quantile_cont(p_retailprice, 0.25) p25, quantile_cont(p_retailprice, 0.75) p75, median(p_size) size0, count(*) n from part group by 1),
sm as (select a.p_brand, arg_min(b.p_brand, (-b.n, b.p_brand)) "similar" from pl a join pl b on abs(b."level" / a."level" - 1) < 0.07 and b.p_brand <> a.p_brand group by 1),
h as (select s_suppkey id, pl.*, 20.0 + s_suppkey % 60 size, ln(21.0 + s_suppkey % 60) x, ln(size0 + 1) x0, b_x, roll, q10, q90 from supplier join pl on p_brand = 'Brand#' || (s_suppkey % 25 + 1), co, gr, iv),
est as (select *, "level" * size0 * exp(b_x * (x - x0)) * (1 + roll) price from h)"""


def fitted(spark, sf):
    """What pricing needs from the fits, as one row of the history of fits: the coefficient of size (final fit on
    out-of-fold levels), the band of actual over predicted prices (out-of-fold errors) and the roll-forward, half a year
    of one series' long-run growth."""
    beta = valuation.least_squares(encoded(spark, sf), [], ["x", "level"], "y").select(F.get("beta", F.lit(1)).alias("b_x"))
    band = rollup.error_interval(predicted(spark, sf).withColumn("e", F.col("hedonic_ols") - F.col("y")), "e", (0.1, 0.9))
    growth = series.growth_rates(months(spark, sf)).where("series = 'BUILDING'").select(F.expm1(6 * F.col("long_run")).alias("roll"))
    path = scratch(spark)
    write_history(beta.crossJoin(band).crossJoin(growth).withColumn("fit", F.lit("parts-1")), path, "fit")  # one row each
    return spark.read.parquet(path).where("fit = 'parts-1'").drop("fit")


def place_levels(spark, sf):
    p = table(spark, sf, "part").withColumn("size", F.col("p_size").cast("double"))
    price = selection.Values(p, ["p_brand"], "p_retailprice").percentiles({"level": 0.5, "p25": 0.25, "p75": 0.75}, n="n")
    return stored(price.join(selection.Values(p, ["p_brand"], "size").percentiles({"size0": 0.5}), "p_brand"))


def priced(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Brand#"), F.col("s_suppkey") % 25 + 1).alias("p_brand"), (20.0 + F.col("s_suppkey") % 60).alias("size"))
    h = s.join(place_levels(spark, sf), "p_brand").crossJoin(F.broadcast(fitted(spark, sf)))  # one row
    h = h.withColumns({"x": F.ln(F.col("size") + 1), "x0": F.ln(F.col("size0") + 1)})
    return valuation.estimate(h, ["x"], "roll", {"low": F.col("q10"), "high": F.col("q90")})


@register(f"""with {PLACES} select id, p_brand, round(price, 6) price, round(price * q10, 6) low, round(price * q90, 6) high, round(price / size, 6) price_m2, case when price / size / (1 + roll) < p25 then 'below' when price / size / (1 + roll) > p75 then 'above' else 'inside' end "position", "similar" from est left join sm using (p_brand)""")
def price_homes(spark, sf):
    """Homes priced from their place's level and the fitted results, with the range of the fit's errors, the position in
    the place's middle half, and the largest place of a like level."""
    top = periods.similar_units(place_levels(spark, sf), "p_brand", "p_brand", "level", "n", k=1).select(F.col("unit").alias("p_brand"), "similar")
    out = priced(spark, sf).join(top, "p_brand", "left")
    return out.select("id", "p_brand", *r6("price", "low", "high", "price_m2"), valuation.band_position(F.col("price_m2") / (1 + F.col("roll")), F.col("p25"), F.col("p75")).alias("position"), "similar")


@register(f"""with {PLACES}, f as (select id, "level" * size0 base, unnest(['x', 'roll']) factor, unnest([1, 2]) i, unnest([b_x * (x - x0), ln(1 + roll)]) s from h), a as (select *, base * exp(sum(s) over (partition by id order by i rows unbounded preceding)) z from f)
select id, factor, i::int i, round(z, 6) as after, round(z - z / exp(s), 6) contribution from a""")
def price_breakdown(spark, sf):
    """What each factor adds to a home's price, in money, step by step from the place's typical home."""
    h = priced(spark, sf).withColumn("base", F.col("level") * F.col("size0"))
    steps = valuation.factor_steps(h, ["id", "base"], ["x"], "roll")
    w = periods.waterfall(steps, ["id", "base", "factor"], "i", "step", 1.0).drop("after", "contribution")
    out = periods.waterfall(w, ["id"], "i", "step", 1.0)
    return out.select("id", "factor", "i", F.round(F.col("after") * F.col("base"), 6).alias("after"), F.round(F.col("contribution") * F.col("base"), 6).alias("contribution"))


@register(f"""with {PLACES} select est.id, pl.p_brand, round(price / (pl."level" * (1 + roll)), 6) buys from est, pl where est.id % 10 = 0 or est.id = 1""")
def same_money(spark, sf):
    """What a home's price buys at each place's level."""
    out = priced(spark, sf).where("id % 10 = 0 or id = 1").select("id", "price", "roll")
    places = place_levels(spark, sf).select("p_brand", "level")
    return periods.money_matrix(out, places, "price", "level", "roll").select("id", "p_brand", *r6("buys"))


from .market import QUERIES  # noqa: E402

QUERIES["boosting_comparison"], QUERIES["boosting_importance"] = boosting_comparison, boosting_importance
