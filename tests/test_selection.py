"""Quantiles of groups of any size, squares of polygons, as-of joins, streams with state and fitted models against plain Python."""

import collections
import datetime
import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from souk.operators import asof, geo, quality, rollup, selection, series, valuation
from souk.operators.weighted import weighted_quantile
from souk.plans import forecasts  # noqa: F401
from souk.sources import tables
from souk.streaming import jobs


def made(n=900):
    rnd = random.Random(4)
    return [(rnd.choice(["a", "b", None]), rnd.randrange(4), rnd.choice([None, float("nan"), 1.0, 1.0, 2.5, rnd.uniform(-5, 5), rnd.uniform(1, 1.01), 1e12]), rnd.choice([None, 0.0, -1.0, 1.0, 2.0, 7.5]), i) for i in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(made(), "g string, f int, v double, w double, i int")


def known(v):
    return v is not None and not math.isnan(v)


@pytest.mark.parametrize("per_range", [10**6, 40, 1])
def test_percentiles_are_exact(frame, per_range):
    qs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.77, "e": 1.0}
    got = selection.Values(frame, ["g"], "v", per_range=per_range).percentiles(qs, n="n").collect()
    assert len(got) == 3
    for r in got:
        own = [v for g, _, v, _, _ in made() if g == r.g and known(v)]
        assert r.n == len(own) and np.allclose([r[x] for x in qs], np.quantile(own, list(qs.values())))
    whole = selection.Values(frame, [], "v", per_range=per_range).percentiles(qs).first()
    assert np.allclose([whole[x] for x in qs], np.quantile([x[2] for x in made() if known(x[2])], list(qs.values())))


@pytest.mark.parametrize("per_range", [10**6, 30])
def test_overlapping_groups(frame, per_range):
    """Every fold's others, by group and for all, without copying rows."""
    others = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda f: f != F.col("f"))
    copies = F.flatten(F.transform(others, lambda f: F.array(F.struct(f.alias("o"), F.col("g").alias("g"), F.lit(False).alias("all")), F.struct(f.alias("o"), F.lit(None).cast("string").alias("g"), F.lit(True).alias("all")))))
    got = selection.Values(frame, ["g", "f"], "v", per_range=per_range).percentiles({"m": 0.5}, copies, ["o", "g", "all"], n="n").collect()
    assert len(got) == 16
    for r in got:
        own = [v for g, f, v, _, _ in made() if f != r.o and (r.all or g == r.g) and known(v)]
        assert r.n == len(own) and abs(r.m - np.median(own)) < 1e-9


@pytest.mark.parametrize("per_range", [10**6, 25])
def test_weighted_rule_is_that_of_the_window(frame, per_range):
    qs = {"a": 0.02, "b": 0.5, "c": 0.9}
    rows = frame.where("g is not null")
    want = {r.g: r for r in weighted_quantile(rows, ["g"], "v", "w", qs, ["i"]).collect()}
    got = {r.g: r for r in selection.Values(rows, ["g"], "v", "w", per_range=per_range).weighted(qs).collect()}
    assert got.keys() == want.keys() and all(abs(got[g][q] - want[g][q]) < 1e-9 for g in got for q in qs)


def test_no_values(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert selection.Values(empty, ["g"], "v").percentiles({"m": 0.5}).isEmpty()
    assert selection.Values(empty, [], "v").percentiles({"m": 0.5}).first().m is None
    assert quality.robust_filter(empty, "v", ["g"]).isEmpty()


def test_robust_filter_reads_its_input_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") % 89 + 1.0).alias("v")).write.parquet(path)
    plan = quality.robust_filter(spark.read.parquet(path), "v", ["g"], 1.0)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count(path.rsplit("/", 1)[0]) <= 2  # the filter itself, and its printed place


def test_scope_medians(spark):
    rows = [(p, p % 2, float(v), float(-v)) for p in range(4) for v in range(p + 3)]
    df = spark.createDataFrame(rows, "p long, d long, x double, y double").withColumn("all", F.lit(-1).cast("long"))
    got = {(r.scope, r.unit): (r.n, r.x, r.y) for r in rollup.scope_medians(df, {"hood": "p", "district": "d", "city": "all"}, ["x", "y"]).collect()}
    want = {}
    for scope, at in (("hood", lambda r: r[0]), ("district", lambda r: r[1]), ("city", lambda r: -1)):
        for r in rows:
            want.setdefault((scope, at(r)), []).append(r)
    assert got == {k: (len(v), np.median([r[2] for r in v]), np.median([r[3] for r in v])) for k, v in want.items()}


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("tolerance", [None, 5])
def test_asof_against_a_scan(spark, strict, tolerance):
    rnd = random.Random(5)
    key = lambda: "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", "c", None])
    time = lambda: None if rnd.random() < 0.03 else rnd.randrange(120)
    left = [(key(), time(), i) for i in range(400)] + [("hot", 60, 1000 + i) for i in range(50)]
    right = [(key(), time(), i, rnd.choice([None, i])) for i in range(150)]
    a = spark.createDataFrame(left, "k string, t int, i int")
    b = spark.createDataFrame(right, "k string, t int, i int, v int").repartition(3)
    got = {(r.k, r.t, r.i): (r.as_of_t, r.as_of_i, r.as_of_v) for r in asof.asof_join(a, b, ["k"], "t", ["i", "v"], ["i"], None if tolerance is None else F.lit(tolerance), strict).collect()}
    assert len(got) == len(left)
    for k, t, i in left:
        fits = [(x[1], x[2], x[3]) for x in right if k is not None and t is not None and x[0] == k and x[1] is not None and (x[1] < t if strict else x[1] <= t)]
        best = max(fits, key=lambda x: x[:2], default=(None, None, None))
        if best[0] is not None and tolerance is not None and best[0] + tolerance < t:
            best = (None, None, None)
        assert got[k, t, i] == best


def test_asof_with_empty_sides(spark):
    a = spark.createDataFrame([("a", 1)], "k string, t int")
    b = spark.createDataFrame([], "k string, t int, v int")
    assert [tuple(r) for r in asof.asof_join(a, b, ["k"], "t", ["v"]).collect()] == [("a", 1, None, None)]
    assert asof.asof_join(a.limit(0), b, ["k"], "t", ["v"]).isEmpty()


def test_stateful_flags_over_restarts_and_late_rows(spark):
    day = lambda d: datetime.date(2024, 1, d)
    schema = "scope string, collected_on date, listings long"
    path, out = tables.scratch(spark), tables.scratch(spark)
    runs = [[("s", day(1), 100), ("s", day(2), 100), ("r", day(1), 3)], [("s", day(3), 40), ("s", day(3), 45), ("s", day(4), 100)], [("s", day(2), 10), ("s", None, 1), ("r", day(5), 1), ("s", day(5), 50)]]
    for rows in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        jobs.append_job(jobs.flag_incomplete(spark.readStream.schema(schema).parquet(path)), out, f"{out}-state").awaitTermination()
    got = collections.Counter((r.scope, r.collected_on.day, r.listings, r.incomplete) for r in spark.read.parquet(out).collect())
    want = [("s", 1, 100, False), ("s", 2, 100, False), ("r", 1, 3, False), ("s", 3, 40, True), ("s", 3, 45, True), ("s", 4, 100, False), ("s", 2, 10, True), ("r", 5, 1, True), ("s", 5, 50, False)]
    # The last: before it come 45, 100, 10 and 100, whose median is 72.5.
    assert got == collections.Counter(want)


def test_counts_of_a_date_add_up_and_repeats_do_not(spark):
    out = tables.scratch(spark)
    rows = [("2024-01-01", "a", v) for v in (1.0, 2.0, 2.0, 9.0, None)] + [("2024-01-02", "a", 5.0)]
    part = lambda some: spark.createDataFrame(some, "d string, s string, v double")
    jobs.merge_counts(part(rows[:2]), 0, out, ["d", "s"], "v")
    for _ in range(3):
        jobs.merge_counts(part(rows[2:]), 1, out, ["d", "s"], "v")
    got = {str(r.d): (r.listings, r.level) for r in jobs.counted_history(spark, out, ["d", "s"]).collect()}
    assert got == {"2024-01-01": (5, 2.0), "2024-01-02": (1, 5.0)}


# The official monthly mean price a square metre, in toman, from the first month of 1395 on; None where no
# figure came out.
OFFICIAL = [
    4089000, 4287000, 4328000, 4350000, 4391000, 4335000, 4370000, 4410000, 4429000, 4493000, 4502000, 4567000, 4267700, 4435000, 4465600, 4521900,
    4566200, 4650000, 4692100, 4792900, 4982100, 5124700, 5384900, 5638600, 5528000, 5978000, 6510000, 6973000, 7399900, 8095700, 8510000, 9179400,
    9554700, 9797300, 9967200, 10901126, 11269100, 12672500, 13299700, 13351200, 13025900, 12667700, 12715700, 12463700, 13525700, 13882700, 14397000,
    15658800, 15295900, 16972700, 19071900, 20986100, 23107800, 24288100, 26720000, 27193100, 26905500, 27386000, 28398100, 30274700, None, None, None,
    None, None, 31703400, 31631100, 32009000, 32590800, 32936400, 33056200, 35120000, 34272700, 36351500, 39414500, 41704900, 42729900, 43216900,
    43724900, 46704800, 48073700, None, None, None, None, 75320000, 78300000, 76540000, 75790000, 75330000, 76000000, 75770000, 74090000, 75390000, None,
    81440000, 81630000, 84750000, 85910000, 87460000, 88500000,
]


def official_series(spark):
    """The official series in logs, with its publication gaps."""
    return spark.createDataFrame([("m", t, math.log(v)) for t, v in enumerate(OFFICIAL) if v], "series string, t int, y double")


def test_leaderboard_of_the_official_series(spark):
    got = {r.method: r for r in series.leaderboard(series.backtest(official_series(spark), 24)).collect()}
    assert sorted(got, key=lambda m: got[m].place) == ["drift_long", "naive", "holt_damped", "local_linear_trend", "drift_12m"]
    published = {
        "drift_long": (0.0336, 0.0712, 0.1294, 0.2079, 0.1524),
        "naive": (0.0358, 0.0894, 0.1821, 0.3266, 0.5370),
        "holt_damped": (0.0329, 0.0880, 0.2015, 0.3383, 0.5892),
        "local_linear_trend": (0.0335, 0.0919, 0.2119, 0.3898, 0.8739),
        "drift_12m": (0.0366, 0.0935, 0.1938, 0.3921, 0.4380),
    }
    near = {"holt_damped": 0.045, "local_linear_trend": 0.03}
    for method, want in published.items():
        mine = [got[method][h] for h in ("h1", "h3", "h6", "h12", "h24")]
        assert all(abs(a / b - 1) <= near.get(method, 0) + 0.0016 for a, b in zip(mine, want, strict=True)), (method, mine)
        assert got[method].origins == 35
    assert abs(got["holt_damped"].h12 / 0.3383 - 1) < 0.01


def test_trees_scored_as_columns_are_those_of_the_model(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    df = spark.range(600).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") * 7 % 23).cast("double").alias("b")).withColumn("y", F.col("a") * F.col("b"))
    x = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df)
    model = GBTRegressor(featuresCol="x", labelCol="y", maxIter=6, maxDepth=valuation.DEPTH, seed=1).fit(x)
    nodes = valuation.packed(valuation.node_table(model))
    both = model.transform(x).crossJoin(nodes).select("prediction", valuation.tree_sum(F.col("trees"), ["a", "b"]).alias("own")).collect()
    assert len(both) == 600 and all(abs(r.prediction - r.own) < 1e-9 for r in both)


def test_given_nodes(spark):
    rows = [(0, 0, 0, 5.0, 1, 2, 0.0), (0, 1, -1, None, -1, -1, 10.0), (0, 2, 1, 1.5, 3, 4, 0.0), (0, 3, -1, None, -1, -1, 20.0), (0, 4, -1, None, -1, -1, 30.0), (1, 0, -1, None, -1, -1, 0.5)]
    nodes = valuation.packed(spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, left int, right int, value double"))
    at = spark.createDataFrame([(5.0, 9.0), (5.1, 1.5), (6.0, 2.0)], "a double, b double").crossJoin(nodes)
    assert [r[0] for r in at.select(valuation.tree_sum(F.col("trees"), ["a", "b"])).collect()] == [10.5, 20.5, 30.5]


def test_importance_within_folds(spark):
    df = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("fold"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    df = df.withColumn("y", F.when(F.col("fold") == 0, F.col("a")).otherwise(-F.col("a")))
    models = spark.createDataFrame([(0, [0.0, 1.0, 0.0]), (1, [0.0, -1.0, 0.0])], "fold int, beta array<double>")
    got = {r.feature: r.drop for r in valuation.permutation_importance(df, "id", ["a", "b"], "y", lambda c: valuation.linear([c["a"], c["b"]]), 2, within=["fold"], models=models).collect()}
    assert got["b"] == 0 and 0.1 < got["a"] < 1


def ring(points):
    return [(*a, *b) for a, b in zip(points, [*points[1:], points[0]])]


def shape(spark, shapes):
    rows = [(p, [tuple(map(float, e)) for e in edges]) for p, edges in shapes]
    df = spark.createDataFrame(rows, "poly int, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")
    ends = lambda c: F.flatten(F.transform("edges", lambda e: F.array(e[f"{c}1"], e[f"{c}2"])))
    return df.withColumns({f"{c}_{side}": f(ends(c)) for c in "xy" for side, f in (("min", F.array_min), ("max", F.array_max))})


def holds(edges, x, y):
    return sum((a[1] > y) != (a[3] > y) and x < (a[2] - a[0]) * (y - a[1]) / (a[3] - a[1]) + a[0] for a in edges) % 2 == 1


@pytest.mark.parametrize("most_edges", [2, 16])
def test_cells_of_polygons_against_the_ray_test(spark, most_edges):
    rnd = random.Random(2)
    star = ring([((2 + i % 2) * math.cos(math.pi * i / 20), (2 + i % 2) * math.sin(math.pi * i / 20)) for i in range(40)])
    hole = ring([(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)])
    strip = ring([(0.0, 0.0), (64.0, 0.01), (64.0, 0.02), (0.0, 0.011)])
    tiny = ring([(1.0, 1.0), (1.0 + 1e-6, 1.0), (1.0, 1.0 + 1e-6)])
    shapes = [(1, star + hole), (2, strip), (3, tiny), (4, ring([(0, 0), (4, 0), (4, 4), (0, 4)]))]
    at = [(i, rnd.uniform(-4, 5), rnd.uniform(-4, 5)) for i in range(800)] + [(1000 + i, rnd.uniform(0, 64), rnd.uniform(0, 0.03)) for i in range(200)] + [(2000, 1.0 + 2e-7, 1.0 + 2e-7), (2001, None, 1.0)]
    got = {r.id: r.poly for r in geo.locate(spark.createDataFrame(at, "id int, x double, y double"), shape(spark, shapes), most_edges).collect()}
    assert got == {i: min((p for p, edges in shapes if x is not None and holds(edges, x, y)), default=None) for i, x, y in at}


def test_a_polygon_of_many_edges(spark):
    n = 100_000
    wave = [((5 + 0.3 * math.sin(200 * t)) * math.cos(t), (5 + 0.3 * math.sin(200 * t)) * math.sin(t)) for t in (2 * math.pi * i / n for i in range(n))]
    edges = ring(wave)
    squares = geo.cover(shape(spark, [(7, edges)]))
    sizes = squares.agg(F.count("*"), F.max(F.size("edges")), F.count_if(F.size("edges") == 0)).first()
    assert sizes[0] < n and sizes[1] <= 16 and sizes[2] > 100
    rnd = random.Random(3)
    at = [(i, rnd.uniform(-5.5, 5.5), rnd.uniform(-5.5, 5.5)) for i in range(150)]
    a = np.array(edges)
    got = {r.id for r in geo.covered(spark.createDataFrame(at, "id int, x double, y double"), squares).collect()}
    with np.errstate(divide="ignore", invalid="ignore"):
        want = {i for i, x, y in at if np.sum(((a[:, 1] > y) != (a[:, 3] > y)) & (x < (a[:, 2] - a[:, 0]) * (y - a[:, 1]) / (a[:, 3] - a[:, 1]) + a[:, 0])) % 2}
    assert got == want


def test_boosted_fits_see_equal_features_once(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    df = spark.range(3000).select((F.col("id") % 2).cast("int").alias("outer_fold"), F.lit(False).alias("test"), (F.col("id") % 7).cast("double").alias("a"), (F.floor(F.col("id") / 7) % 5).cast("double").alias("b"), F.sin(F.col("id")).alias("e"))
    df = df.withColumn("y", F.col("a") * F.col("b") + F.col("e"))
    whole = GBTRegressor(featuresCol="x", labelCol="y", maxIter=5, stepSize=0.3, maxDepth=valuation.DEPTH, minInstancesPerNode=20, seed=7)
    want = whole.fit(VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df.where("outer_fold = 0")))
    seen, real = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, rows, *more: seen.append(rows.count()) or real(self, rows, *more))
    fits = valuation.boosted_fits(df, ["a", "b"], "y", k=2, trees=5, step=0.3)
    assert seen == [35, 35]  # rows of equal features are one
    grid = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df.select("a", "b").distinct())
    both = want.transform(grid).crossJoin(fits.where("outer_fold = 0")).select("prediction", valuation.tree_sum(F.col("trees"), ["a", "b"]).alias("own")).collect()
    assert len(both) == 35 and all(abs(r.prediction - r.own) < 1e-6 for r in both)


def test_importance_predicts_equal_features_once(spark):
    df = spark.range(2000).select("id", (F.col("id") % 4).cast("double").alias("a"), (F.floor(F.col("id") / 4) % 3).cast("double").alias("b"), F.sin(F.col("id")).alias("e")).withColumn("y", 2 * F.col("a") + F.col("e")).drop("e")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def predict(a, b):
        calls.add(1)
        return 2 * a + 0.1 * b

    got = {r.feature: r.drop for r in valuation.permutation_importance(df, "id", ["a", "b"], "y", lambda c: predict(c["a"], c["b"]), 1).collect()}
    assert calls.value <= 200  # not once for each of 2,000 rows and variants
    rows = df.toPandas()
    var = lambda p: 1 - ((rows.y - p) ** 2).sum() / ((rows.y - rows.y.mean()) ** 2).sum()
    deal = rows.iloc[pd.Series([hashlib.md5(f"{i}:1:7".encode()).hexdigest() for i in rows.id]).argsort(kind="stable")]
    rows = rows.sort_values("id").reset_index(drop=True)
    a2, b2 = deal.a.reset_index(drop=True), deal.b.reset_index(drop=True)
    base = var(2 * rows.a + 0.1 * rows.b)
    assert abs(got["a"] - (base - var(2 * a2 + 0.1 * rows.b))) < 1e-9 and abs(got["b"] - (base - var(2 * rows.a + 0.1 * b2))) < 1e-9
