"""Every registered market query against its SQL, and exact values of calendar and text functions."""

import collections
import datetime
import json
import math
import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from souk.functions import calendar, text
from souk.operators import geo, joins, periods, quality, rollup, series, valuation
from souk.operators.weighted import weighted_quantile, weighted_quantile_of_many
from souk.plans import registry
from souk.sources import tables
from souk.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for n in os.listdir(SF):
        con.sql(f"create view {n.split('.')[0]} as select * from '{SF}/{n}'")
    return con


def rows(df: pd.DataFrame):
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return ""
        if hasattr(v, "year"):
            return str(v)[:10]
        return v if isinstance(v, str) else round(float(v), 4)

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got)
        return
    want = db.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    for a, b in zip(rows(got), rows(want), strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-4 for x, y in zip(a, b, strict=True)), (a, b)


def test_surrogate_keys_beyond_five_digits(spark, tmp_path):
    path = f"{tmp_path}/customer.parquet"
    duckdb.sql(f"copy (select i::bigint c_custkey, case when i % 1000 <> 7 then (i * 7919 % 5003)::double end c_acctbal from range(100200) t(i)) to '{path}'")
    con = duckdb.connect()
    con.sql(f"create view customer as select * from '{path}'")
    want = dict(con.sql(f"select c_custkey, key from ({registry.ORACLE_SQL['surrogate_keys']})").fetchall())
    got = {r.c_custkey: r.key for r in registry.QUERIES["surrogate_keys"](spark, str(tmp_path)).collect()}
    assert got == want and len(set(got.values())) == 100200 and "CU-100200" in got.values()


@pytest.mark.parametrize(("jy", "jm", "day"), [(1395, 1, "2016-03-20"), (1399, 12, "2021-02-19"), (1400, 1, "2021-03-21"), (1403, 1, "2024-03-20"), (1404, 1, "2025-03-21"), (1405, 7, "2026-09-23")])
def test_month_starts(spark, jy, jm, day):
    assert str(spark.range(1).select(calendar.to_gregorian(F.lit(jy), F.lit(jm), F.lit(1))).first()[0]) == day


def test_calendar_round_trip(spark):
    d = spark.range(0, 12000, 7).select(F.date_add(F.lit(datetime.date(2000, 1, 1)), F.col("id").cast("int")).alias("d"))
    j = calendar.from_gregorian(F.col("d"))
    assert d.select("d", j.alias("j")).where(calendar.to_gregorian(F.col("j.jy"), F.col("j.jm"), F.col("j.jd")) != F.col("d")).isEmpty()
    assert spark.range(1).select(calendar.from_gregorian(F.lit(datetime.date(2025, 3, 20)))).first()[0] == (1403, 12, 30)


def test_amounts(spark):
    cases = {"۱۲٫۵ میلیارد": 12.5e9, "۸۵۰ میلیون تومان": 850e6, "۲۳٬۵۰۰٬۰۰۰٬۰۰۰ تومان": 23.5e9, "12 میلیارد": 12e9, "توافقی": None, "12": None}
    got = spark.createDataFrame(list(cases.items()), "t string, want double").select("t", "want", text.amount(F.col("t")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_place_key(spark):
    a, b = spark.range(1).select(text.place_key(F.lit("Punak")), text.place_key(F.lit("poonak"))).first()
    assert a == b


def test_weighted_quantile_edges(spark):
    d = spark.createDataFrame([("a", 1.0, 1.0, 1), ("a", None, 5.0, 2), ("a", 3.0, 0.0, 3), ("b", 2.0, 1.0, 4), ("b", 4.0, 1.0, 5)], "k string, v double, w double, id int")
    assert dict(weighted_quantile(d, ["k"], "v", "w", {"q": 0.5}, ["id"]).collect()) == {"a": 1.0, "b": 3.0}


def test_quantiles_of_many_are_those_of_few(spark):
    """Ranges or one window, with ties of value and weight, hot groups and nulls: the same quantiles."""
    rng = random.Random(3)
    rows = [(rng.choice("aaaab"), float(rng.randrange(40)) if rng.random() > 0.1 else None, float(rng.randrange(4)), i) for i in range(900)] + [("c", 5.0, 2.0, 1000), ("d", None, 1.0, 1001)]
    d = spark.createDataFrame(rows, "k string, v double, w double, id int")
    qs = {"q1": 0.25, "q2": 0.5, "q3": 0.9}
    one = {r.k: r for r in weighted_quantile(d, ["k"], "v", "w", qs, ["id"]).collect()}
    for ranges in (2, 7, 64):
        many = {r.k: r for r in weighted_quantile_of_many(d, ["k"], "v", "w", qs, ranges).collect()}
        assert many.keys() == one.keys() == {"a", "b", "c"}
        assert all(abs(many[k][n] - one[k][n]) < 1e-9 for k in one for n in qs)
    assert abs(weighted_quantile_of_many(d, [], "v", "w", {"q": 0.5}).first().q - weighted_quantile(d, [], "v", "w", {"q": 0.5}, ["id"]).first().q) < 1e-9
    assert weighted_quantile_of_many(d.limit(0), ["k"], "v", "w", qs).isEmpty()


def test_nearest_place_far_away_and_on_ties(spark):
    rng = random.Random(4)
    pts = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(300)] + [(300, None, 1.0), (301, 1000.0, 1000.0), (302, 0.5, 0.0)]
    cs = [(f"c{i}", rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(20)] + [("a", 0.0, 0.0), ("b", 1.0, 0.0)]
    got = geo.nearest_centroid(spark.createDataFrame(pts, "id int, x double, y double"), spark.createDataFrame(cs, "name string, cx double, cy double"), 0.5, 3000.0, 0.8).collect()
    for r in got:
        _, x, y = pts[r.id]
        want = min((((x - cx) * 0.8) ** 2 + (y - cy) ** 2, n) for n, cx, cy in cs) if x is not None else (None, None)
        assert r.name == want[1]


def test_similar_units_in_dense_and_sparse_values(spark):
    """Many units of one value, one group of a third of all, ties at the range's ends: the answers of brute force."""
    rng = random.Random(8)
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 7}", rng.choice([100.0, 93.0, 107.0, 93.00001, 106.99999, rng.uniform(80, 120), math.exp(rng.uniform(0, 9))]), rng.randrange(50)) for i in range(600)] + [(600, "x", None, 1), (601, "x", -5.0, 1)]
    got = collections.defaultdict(list)
    for r in periods.similar_units(spark.createDataFrame(rows, "u int, g string, v double, s int"), "u", "g", "v", "s").orderBy("unit", "rank").collect():
        got[r.unit].append(r.similar)
    for u, g, v, _ in rows[:600]:
        assert got[u] == [x for _, x in sorted((-s, x) for x, h, w, s in rows[:600] if h != g and abs(w / v - 1) < 0.07)[:8]], u


def test_cards(spark):
    """Chips and prices of a card: the last chip counts, no room, new buildings, flags by icon, missing totals."""
    kind = "price_fields array<struct<title:string,value:string>>, chips array<struct<title:string,icon_url_light:string>>"
    chips = [("۱۰۰ متر", None), ("۱۲۰ متر", None), ("بدون اتاق", None), ("نوساز", None), (None, "x/parking.png"), (" ", "x/elevator.svg")]
    rows = [([("قیمت کل :", "۱۲ میلیارد"), ("قیمت هر متر", "توافقی")], chips), ([("", "۹ میلیارد تومان"), ("هر متر :", "۸۰ میلیون")], [("۵ سال", None), ("۳ اتاق", None)]), ([], []), (None, None)]
    df = spark.createDataFrame(rows, kind)
    got = df.withColumn("c", text.chips(F.col("chips"))).withColumn("p", text.card_prices(F.col("price_fields"), F.col("c.size_m2"))).select("c.*", "p.price", "p.price_m2", "p.text").collect()
    assert got[0][:5] == (120.0, 0.0, 0.0, 1, 1) and got[0][5:7] == (12e9, 1e8) and got[0].text == "قیمت کل=۱۲ میلیارد | قیمت هر متر=توافقی"
    assert got[1][:5] == (None, 3.0, 5.0, 0, 0) and got[1][5:7] == (9e9, 8e7)
    assert got[2][:7] == (None, None, None, 0, 0, None, None) and got[3][:3] == (None, None, None) and got[3].price is None


def test_geojson_with_holes_and_parts(spark, tmp_path):
    ring = lambda a, z: [[a, a], [z, a], [z, z], [a, z], [a, a]]
    feature = lambda i, kind, c: {"type": "Feature", "properties": {"poly": i}, "geometry": {"type": kind, "coordinates": c}}
    doc = {"type": "FeatureCollection", "features": [feature(1, "Polygon", [ring(0, 4), ring(1, 2)]), feature(2, "MultiPolygon", [[ring(10, 11)], [ring(12, 14)]])]}
    (tmp_path / "f.geojson").write_text(json.dumps(doc, indent=1))
    shapes = tables.geojson(spark, str(tmp_path / "f.geojson"), "poly:int")
    assert [(r.file, r.poly, len(r.edges), r.x_min, r.x_max) for r in shapes.orderBy("poly").collect()] == [("f.geojson", 1, 8, 0.0, 4.0), ("f.geojson", 2, 8, 10.0, 14.0)]
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 10.5, 10.5), (4, 11.5, 11.5), (5, 13.0, 13.0)], "id int, x double, y double")
    assert {r.id: r.poly for r in geo.locate(pts, shapes).collect()} == {1: 1, 2: None, 3: 2, 4: None, 5: 2}


def test_methods_on_a_straight_line(spark):
    """On a noiseless line every trend method goes on along it; errors of the naive one are h steps."""
    d = spark.createDataFrame([("s", t, 0.5 * t) for t in range(60) if t % 7], "series string, t int, y double")
    bt = series.backtest(d, 12, 36)
    worst = {r.method: r.e for r in bt.groupBy("method").agg(F.max(F.abs("err")).alias("e")).collect()}
    assert set(worst) == set(series.METHODS)
    assert all(worst[m] < 1e-6 for m in ("drift_long", "drift_12m")) and worst["local_linear_trend"] < 0.05 and abs(worst["naive"] - 6.0) < 1e-9
    cut = series.states_of(d.where("t <= 40")).where("origin = 40").orderBy("method").collect()
    assert cut == series.states_of(d).where("origin = 40").orderBy("method").collect()  # no look ahead


def test_bands_fill_gaps(spark):
    bt = spark.createDataFrame([("m", h, e / 10) for h in (2, 4) for e in range(5)], "method string, h int, err double")
    got = {r.h: r.q10 for r in series.error_bands(bt, "m", 5).collect()}
    assert got[1] == got[2] == got[5] and abs(got[3] - (got[2] + got[4]) / 2) < 1e-12


def test_least_squares_weights_and_singular_groups(spark):
    rows = [("a", float(i), float(i * i % 7), 2.0 + 3 * i - 0.5 * (i * i % 7)) for i in range(20)] + [("b", 1.0, 2.0, 3.0)] * 3
    fits = {r.k: r.beta for r in valuation.least_squares(spark.createDataFrame(rows, "k string, x double, z double, y double"), ["k"], ["x", "z"], "y").collect()}
    assert all(abs(a - b) < 1e-9 for a, b in zip(fits["a"], (2, 3, -0.5), strict=True)) and "b" not in fits or len(fits["b"]) == 3
    draws = spark.range(4000).select(valuation.poisson_weight(F.col("id"), F.lit(1), 7).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(draws[0] - 1) < 0.06 and abs(draws[1] - 1) < 0.12


def test_folds_of_large_keys(spark):
    f = spark.createDataFrame([(2**62 + i,) for i in range(1000)], "id long").select(valuation.fold("id").alias("f")).groupBy("f").count().collect()
    assert len(f) == 5 and all(150 < r["count"] < 250 for r in f)


def test_boosting_beats_the_mean(spark):
    rng = random.Random(1)
    rows = [(i, f"g{i % 4}", (i % 4) + math.sin(x := rng.uniform(0, 6)), x, (i % 4) + math.sin(x), i % 3, i // 3 % 3) for i in range(400)]
    d = spark.createDataFrame(rows, "id int, g string, lp double, x double, y double, fold int, inn int")
    out = valuation.boosted(d, "g", "lp", ["x"], "y", "fold", "inn", k=3, trees=15, step=0.3)
    assert out.count() == 400 and valuation.compared(out, "y", ["gradient_boosting"]).first().r2 > 0.8


def test_incomplete_snapshot(spark):
    rows = [("s", f"2024-01-{d:02d}", n) for d, n in enumerate([100, 100, 100, 40, 100, 100], 1)]
    got = jobs.incomplete(spark.createDataFrame(rows, "scope string, collected_on string, listings int")).orderBy("collected_on").collect()
    assert [r.incomplete for r in got] == [False, False, False, True, False, False]


def test_text_helpers(spark):
    r = spark.range(1).select(text.bare_place(F.lit("Qaem Shahr County")).alias("a"), text.first_integer(F.lit("ab 012 7")).alias("b"), text.first_integer(F.lit("none")).alias("c"), text.pretty(F.lit("shahrak-e-gharb")).alias("d"), text.ascii_digits(F.lit("۱۲٣")).alias("e"), calendar.month_name(F.lit(12)).alias("f"), calendar.month_of_gregorian(F.lit(2024), F.lit(3)).alias("g"), calendar.month_start(F.lit(108)).alias("h")).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("qaem shahr", 12, None, "Shahrak e Gharb", "123", "Esfand")
    assert r.g == (1402 - 1395) * 12 + 11 and str(r.h) == "2025-03-21"


def test_small_tables_and_searches(spark):
    d = spark.createDataFrame([(1, 2000, 5.0), (1, 2001, 7.0), (2, 2000, 3.0)], "u int, p int, v double")
    assert {(r.u, r.now, r.place, r.ranked) for r in periods.ladder(d, "u", "p", "v", 2001, 2000).collect()} == {(1, 7.0, 1, 1), (2, None, None, 1)}
    assert d.where(periods.matches("2", F.col("p").cast("string"), number=F.col("u"))).count() == 3
    assert joins.append_new(d, d.withColumn("u", F.col("u") + 1), "u").count() == 4
    assert [r.share for r in rollup.positive_shares(spark.createDataFrame([(1.0,), (-5.0,), (3.0,)], "v double"), "v").collect()] == [0.25, 0.0, 0.75]


def test_no_private_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    with pytest.raises(ValueError, match="checkpoint"):
        tables.scratch(type("S", (), {"sparkContext": Context()})())


def test_number_and_reject(spark):
    d = spark.createDataFrame([("1,200",), ("x",), (None,)], "s string")
    assert [r[0] for r in d.select(quality.number(F.col("s"))).collect()] == [1200.0, None, None]


def test_snap_status(spark):
    pts = spark.createDataFrame([(1, 1.1, 0.5), (2, 9.0, 9.0), (3, None, 1.0)], "id int, x double, y double")
    square = "array(struct(0D as x1,0D as y1,1D as x2,0D as y2),struct(1D as x1,0D as y1,1D as x2,1D as y2),struct(1D as x1,1D as y1,0D as x2,1D as y2),struct(0D as x1,1D as y1,0D as x2,0D as y2))"
    poly = spark.range(1).select(F.lit(7).alias("poly"), F.expr(square).alias("edges"), *[F.lit(float(v)).alias(n) for n, v in (("x_min", 0), ("x_max", 1), ("y_min", 0), ("y_max", 1))])
    assert {r.id: (r.poly, r.status) for r in geo.snap(pts, poly, 0.2).collect()} == {1: (7, "snapped"), 2: (None, "outside"), 3: (None, "no_coordinates")}


def test_history_is_replaced_by_date(spark, tmp_path):
    path = str(tmp_path / "h")
    for n in (5, 6):
        tables.write_history(spark.createDataFrame([("2024-01-01", "city", n)], "collected_on string, scope string, listings int"), path)
    tables.write_history(spark.createDataFrame([("2024-01-02", "city", 9)], "collected_on string, scope string, listings int"), path)
    assert sorted(r.listings for r in spark.read.parquet(path).collect()) == [6, 9]
    assert tables.optional_csv(spark, str(tmp_path / "none.csv"), tables.SNAPSHOT).columns[0] == "collected_on"


def test_stream_dedup(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 00:00:00")], "token string, ts string").select("token", F.to_timestamp("ts").alias("ts")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("token string, ts timestamp").parquet(str(tmp_path / "in"))
    jobs.append_job(jobs.dedup(s, ["token"], "ts"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_bootstrap_hashes_a_draw_once_on_all_cores(spark):
    d = spark.range(0, 900, 1, 1).select("id", F.ln(F.col("id") % 50 + 1).alias("x"), F.when(F.col("id") % 97 > 0, F.ln(F.col("id") * 31 % 400 + 2)).alias("y"))
    out = valuation.bootstrap_intervals(d, "id", ["x"], "y", repeats=20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "md5" in line]
    assert "RoundRobinPartitioning" in plan
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("r").cast("string"), F.lit("7"))), 1, 8), 16, 10).cast("double") / 2.0**32
    draws = d.select("*", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("r")).withColumns({"w": valuation.poisson_weight(F.col("id"), F.col("r"), 7), "u": u}).toPandas()
    share = [sum(math.exp(-1) / math.factorial(i) for i in range(n)) for n in range(1, 9)]
    assert draws.w.tolist() == [sum(x >= c for c in share) for x in draws.u]
    fits = []
    for _, g in draws[draws.y.notna() & (draws.w > 0)].groupby("r"):
        w, x, y = (g[c].to_numpy(float) for c in ("w", "x", "y"))
        b = (w.sum() * (w * x * y).sum() - (w * x).sum() * (w * y).sum()) / (w.sum() * (w * x * x).sum() - (w * x).sum() ** 2)
        fits.append(b)
    got = next(r for r in out.collect() if r.term == "x")
    assert abs(got.low - pd.Series(fits).quantile(0.05)) < 1e-9 and abs(got.high - pd.Series(fits).quantile(0.95)) < 1e-9
