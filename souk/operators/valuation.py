"""Hedonic valuation: out-of-fold location levels, least squares, error measures, premiums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.sources.tables import scratch, spread, stored

from .selection import Values, and_all, joined


def fold(key: str, k: int = 5, seed: int = 42) -> Column:
    """A row's fold by a hash of its key and the seed: dealt as by a shuffle, the same on any partitioning."""
    digits = F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8)
    return (F.conv(digits, 16, 10).cast("long") % k).cast("int")


def target_encoding(df: DataFrame, group: str, log_value: str, prior: float = 5.0) -> DataFrame:
    """group -> level, the median of log_value shrunk to the overall median by ``prior`` rows."""
    found = Values(df, [group], log_value).percentiles({"m": 0.5}, and_all(group), [group, "all"], n="n")
    overall = found.where("all").select(F.col("m").alias("overall"))
    return found.where("not all").crossJoin(overall).select(group, _shrunk(F.col("m"), F.col("n"), F.col("overall"), prior).alias("level"))


def _shrunk(level: Column, n: Column, overall: Column, prior: float) -> Column:
    return (level * n + overall * prior) / (n + prior)


def out_of_fold_encoding(df: DataFrame, group: str, log_value: str, fold_col: str, k: int = 5, prior: float = 5.0) -> DataFrame:
    """df with ``level``, each row's group level from the other folds only; the other folds' overall median for
    groups that they lack. Values are counted by group and fold; what each fold leaves out follows from the counts."""
    folds = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("__own"))
    seen = lambda f, g, every: F.struct(f.alias("__f"), g.alias("__g"), F.lit(every).alias("__every"))
    none = F.lit(None).cast(df.schema[group].dataType)
    copies = F.flatten(F.transform(folds, lambda f: F.array(seen(f, F.col("__g"), False), seen(f, none, True))))
    values = Values(df.select(F.col(group).alias("__g"), F.col(fold_col).cast("int").alias("__own"), log_value), ["__g", "__own"], log_value)
    found = stored(values.percentiles({"__m": 0.5}, copies, ["__f", "__g", "__every"], n="__n"))
    overall = found.where("__every").select("__f", F.col("__m").alias("__all"))  # k rows
    level = found.where("not __every").select("__f", "__g", "__m", "__n")
    out = df.withColumn("__f", F.col(fold_col).cast("int")).join(F.broadcast(overall), "__f").join(level.withColumnRenamed("__f", "__h"), (F.col("__f") == F.col("__h")) & (F.col(group) == F.col("__g")), "left")
    return out.withColumn("level", F.coalesce(_shrunk(F.col("__m"), F.col("__n"), F.col("__all"), prior), F.col("__all"))).drop("__f", "__h", "__g", "__m", "__n", "__all")


def ols(df: DataFrame, features: list[str], target: str):
    """Fitted pyspark.ml linear regression (normal equations)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    made = VectorAssembler(inputCols=features, outputCol="__x").transform(df.na.drop(subset=[*features, target]))
    return LinearRegression(featuresCol="__x", labelCol=target, solver="normal", regParam=0.0).fit(made)


def coefficients(df: DataFrame, features: list[str], target: str) -> DataFrame:
    model = ols(df, features, target)
    return df.sparkSession.createDataFrame([("intercept", float(model.intercept)), *zip(features, map(float, model.coefficients), strict=True)], "term string, value double")


def error_measures(df: DataFrame, actual_log: str, predicted_log: str, keys: list[str] | None = None) -> DataFrame:
    """R2 on logs, mean and median absolute percentage error, share within a fifth."""
    keys = keys or []
    rows = stored(df.select(*keys, F.col(actual_log).alias("__y"), (F.col(predicted_log) - F.col(actual_log)).alias("__e")))
    e, ape = F.col("__e"), F.abs(F.expm1("__e"))
    median = Values(rows, keys, ape).percentiles({"median_ape": 0.5})
    out = rows.groupBy(*keys).agg((1 - F.sum(e * e) / (F.var_pop("__y") * F.count("*"))).alias("r2"), F.avg(ape).alias("mape"), F.avg((ape <= 0.2).cast("double")).alias("within_20"))
    return (out.join(median, keys, "left") if keys else out.crossJoin(median)).select(*keys, "r2", "mape", "median_ape", "within_20")


def premium(coefficient: Column) -> Column:
    """Percentage effect of one unit in a log model."""
    return F.expm1(coefficient)


def elasticity_10(coefficient: Column) -> Column:
    """Effect of ten percent more on the price per unit."""
    return F.pow(F.lit(1.1), coefficient - 1) - 1


def nested_encoding(df: DataFrame, group: str, log_value: str, fold_col: str, inner_col: str, k: int = 5, prior: float = 5.0) -> DataFrame:
    """Rows of df for each ``outer_fold``, with ``test`` (the row is of that fold) and ``level``. A test row's level is
    from all training rows of the fold; a training row's is from those of other inner folds, so it never sees its
    own price."""
    folds = F.sequence(F.lit(0), F.lit(k - 1))
    inner = F.concat(F.array(F.lit(-1)), F.filter(folds, lambda i: i != F.col("__inner")))
    seen = lambda f, i, g, every: F.struct(f.alias("__f"), i.alias("__i"), g.alias("__g"), F.lit(every).alias("__every"))
    none = F.lit(None).cast(df.schema[group].dataType)
    of_fold = lambda f: F.flatten(F.transform(inner, lambda i: F.array(seen(f, i, F.col("__g"), False), seen(f, i, none, True))))
    copies = F.flatten(F.transform(F.filter(folds, lambda f: f != F.col("__outer")), of_fold))
    values = Values(df.select(F.col(group).alias("__g"), F.col(fold_col).cast("int").alias("__outer"), F.col(inner_col).cast("int").alias("__inner"), log_value), ["__g", "__outer", "__inner"], log_value)
    found = stored(values.percentiles({"__m": 0.5}, copies, ["__f", "__i", "__g", "__every"], n="__n"))
    overall = found.where("__every").select("__f", "__i", F.col("__m").alias("__all"))
    level = found.where("not __every").select("__f", "__i", "__g", "__m", "__n")
    rows = df.select("*", F.col(group).alias("__g"), F.explode(folds).alias("__f")).withColumn("test", F.col("__f") == F.col(fold_col)).withColumn("__i", F.when(F.col("test"), F.lit(-1)).otherwise(F.col(inner_col)))
    out = rows.join(overall, ["__f", "__i"]).join(level, ["__f", "__i", "__g"], "left")
    return out.select(*df.columns, F.col("__f").alias("outer_fold"), "test", F.coalesce(_shrunk(F.col("__m"), F.col("__n"), F.col("__all"), prior), F.col("__all")).alias("level"))


def least_squares(df: DataFrame, keys: list[str], features: list[str], target: str, weight: Column | None = None) -> DataFrame:
    """Coefficients for each group of keys: keys, beta array<double> (intercept first) and n. The sums of products are
    taken by Spark; only the small systems of equations are solved row by row. No result where a system has none."""
    xs = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    w = F.lit(1.0) if weight is None else weight
    size = len(xs)
    known = df.na.drop(subset=[*features, target])
    sums = known.groupBy(*keys).agg(F.array(*[F.sum(w * xs[i] * xs[j]) for i in range(size) for j in range(i, size)]).alias("a"), F.array(*[F.sum(w * x * F.col(target)) for x in xs]).alias("b"), F.sum(w).alias("n")).where("n > 0")

    def solve(batches):
        import numpy as np

        upper = np.triu_indices(size)
        for pdf in batches:
            betas = []
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                m = np.zeros((size, size))
                m[upper] = a
                m = m + np.triu(m, 1).T
                scale = 1 / np.sqrt(np.maximum(np.diag(m), 1e-300))
                try:
                    betas.append(scale * np.linalg.solve(m * np.outer(scale, scale), np.asarray(b) * scale))
                except np.linalg.LinAlgError:
                    betas.append(None)
            yield pdf.assign(beta=betas)[[*keys, "beta", "n"]]

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(solve, f"{kinds}{', ' if keys else ''}beta array<double>, n double").where("beta is not null")


def linear(features: list[str | Column], beta: Column | None = None) -> Column:
    """Prediction from a column ``beta`` (intercept first) and columns of features."""
    beta = F.col("beta") if beta is None else beta
    out = F.get(beta, F.lit(0))
    for i, f in enumerate(features, 1):
        out = out + F.get(beta, F.lit(i)) * (F.col(f) if isinstance(f, str) else f)
    return out


def cross_validated(df: DataFrame, group: str, log_unit: str, log_size: str, target: str, others: list[str], fold_col: str, inner_col: str, k: int = 5) -> DataFrame:
    """df with out-of-fold predictions of two models: least squares on log size, others and the nested level; and
    location only, log size plus level. All folds are fitted in one pass."""
    rows = nested_encoding(df, group, log_unit, fold_col, inner_col, k)
    features = [log_size, *others, "level"]
    fits = least_squares(rows.where("not test"), ["outer_fold"], features, target)
    return rows.where("test").join(fits.select("outer_fold", "beta"), "outer_fold").withColumn("hedonic_ols", linear(features)).withColumn("location_only", F.col(log_size) + F.col("level")).drop("outer_fold", "test", "beta")


def compared(df: DataFrame, actual: str, models: list[str]) -> DataFrame:
    """Error measures of each model's column of predictions: model, r2, mape, median_ape, within_20."""
    long = df.select(F.col(actual).alias("a"), F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in models])).alias("x")).select("a", "x.*")
    return error_measures(long, "a", "p", ["model"])


def boosted(df: DataFrame, group: str, log_unit: str, features: list[str], target: str, fold_col: str, inner_col: str, k: int = 5, trees: int = 300, step: float = 0.05) -> DataFrame:
    """df with out-of-fold predictions ``gradient_boosting`` of pyspark.ml's boosted trees on features and level, scored
    from the tables of their nodes, once for equal features."""
    rows = stored(nested_encoding(df, group, log_unit, fold_col, inner_col, k))
    names = ["outer_fold", *features, "level"]
    fits = boosted_fits(rows, names[1:], target, k, trees, step)
    tests = rows.where("test")
    scored = tests.select(*names).distinct().join(F.broadcast(fits), "outer_fold")  # k rows of bounded size
    scored = stored(scored.select(*names, tree_sum(F.col("trees"), names[1:]).alias("gradient_boosting")))
    return joined(tests, scored, names).drop("outer_fold", "test", "level")


#: Levels of a boosted tree below its root, and the least rows of a node.
DEPTH, LEAF = 4, 20


def boosted_fits(rows: DataFrame, features: list[str], target: str, k: int = 5, trees: int = 300, step: float = 0.05) -> DataFrame:
    """outer_fold and ``trees``, the nodes of the boosted trees fitted on the fold's training rows (see packed()). Rows of
    equal features always share a leaf, and squared error splits by sums and counts alone, so each such set is one row:
    its mean, weighted by its size. Rows that lack a value are left out."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    known = rows.where("not test").na.drop(subset=[*features, target])
    cells = stored(known.groupBy("outer_fold", *features).agg(F.avg(target).alias("__y"), F.count("*").cast("double").alias("__n")))
    made = VectorAssembler(inputCols=features, outputCol="__x").transform(cells)
    total = {r["outer_fold"]: r["n"] for r in cells.groupBy("outer_fold").agg(F.sum("__n").alias("n")).collect()}  # k rows

    def fit(f: int) -> DataFrame:
        # A leaf holds at least LEAF rows: a share of the fold's, as cells are not counted but weighed.
        n = total.get(f, 0)
        share, depth = ((LEAF - 0.5) / n, DEPTH) if n >= 2 * LEAF else (0.0, 0)
        model = GBTRegressor(featuresCol="__x", labelCol="__y", weightCol="__n", maxIter=trees, stepSize=step, maxDepth=depth, minInstancesPerNode=1, minWeightFractionPerNode=share, seed=7)
        return packed(node_table(model.fit(made.where(F.col("outer_fold") == f)))).withColumn("outer_fold", F.lit(f))

    # One fit for each fold, of many short jobs, side by side.
    with ThreadPool(k) as pool:
        fits = pool.map(inheritable_thread_target(rows.sparkSession)(fit), range(k))
    out = fits[0]
    for one in fits[1:]:
        out = out.unionByName(one)
    return stored(out)


def node_table(model) -> DataFrame:
    """A fitted tree ensemble of pyspark.ml as a table: tree, node, feature (-1 in a leaf), threshold, left and right node,
    and value, the prediction times the tree's weight."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = scratch(spark)
    model.write().save(path)
    weight = F.get(F.array(*[F.lit(float(w)) for w in model.treeWeights]), F.col("treeID"))
    n = F.col("nodeData")
    split = n["split"]
    return spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), n["id"].alias("node"), split["featureIndex"].alias("feature"), F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), (n["prediction"] * weight).alias("value"))


def packed(nodes: DataFrame) -> DataFrame:
    """A node table as one row: ``trees``, an array with an array of nodes for each tree. At most 2 ** (depth + 1) nodes
    a tree."""
    names = ["node", "feature", "threshold", "left", "right", "value"]
    one = nodes.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("nodes"))
    return one.agg(F.sort_array(F.collect_list(F.struct("tree", "nodes"))).alias("t")).select(F.col("t.nodes").alias("trees"))


def tree_sum(trees: Column, features: list[str | Column], depth: int = DEPTH) -> Column:
    """The sum over trees of the value of the leaf that a row's features lead to; a column expression."""
    x = F.array(*[(F.col(f) if isinstance(f, str) else f).cast("double") for f in features])

    def leaf(nodes):
        def down(at, _):
            node = F.get(nodes, at)
            return F.when(node["feature"] < 0, at).when(F.get(x, node["feature"]) <= node["threshold"], node["left"]).otherwise(node["right"])

        return F.get(nodes, F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down))["value"]

    return F.aggregate(trees, F.lit(0.0), lambda total, nodes: total + leaf(nodes))


def poisson_weight(key: Column, repeat: Column, seed: int) -> Column:
    """How often a row is drawn in a bootstrap sample: Poisson with mean 1, from a hash of key, repeat and seed. Its first
    eight hex digits, as a share of 2 ** 32, are held against the distribution in their written form."""
    digits = F.md5(F.concat_ws(":", key.cast("string"), repeat.cast("string"), F.lit(str(seed))))
    cut, total, term = [], 0.0, math.exp(-1)
    for i in range(1, 9):
        total += term
        cut.append(f"{math.ceil(total * 2.0**32):08x}")
        term /= i
    return sum(((digits >= c).cast("int") for c in cut), F.lit(0))


def bootstrap_intervals(df: DataFrame, key: str, features: list[str], target: str, repeats: int = 300, seed: int = 7, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """term, low, high: quantiles of least-squares coefficients over bootstrap samples. Rows are weighted, not copied
    by drawing, so samples are the same on any partitioning; sums are taken before the shuffle. Weights of 0 become null,
    which sums leave out: a filter on them would hash once for each of its comparisons."""
    each = spread(df.select(key, *features, target).na.drop(subset=[*features, target]))
    drawn = each.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("rep")).withColumn("w", F.nullif(poisson_weight(F.col(key), F.col("rep"), seed), F.lit(0)))
    fits = least_squares(drawn, ["rep"], features, target, F.col("w"))
    terms = F.explode(F.arrays_zip(F.array(*[F.lit(t) for t in ("intercept", *features)]).alias("term"), F.col("beta").alias("value")))
    q = F.percentile("value", F.array(F.lit(low), F.lit(high)))
    return fits.select(terms.alias("t")).select("t.term", "t.value").groupBy("term").agg(q.alias("q")).select("term", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def permutation_importance(df: DataFrame, key: str, features: list[str], target: str, predict, repeats: int = 10, seed: int = 7, within: list[str] | None = None, models: DataFrame | None = None) -> DataFrame:
    """feature, drop: how much R2 falls on average when a feature's values are dealt anew among the rows, with
    ``within`` among those that agree on these columns, such as the fold. predict maps {feature: column} to a
    prediction; it may use columns of models, a small table joined on ``within`` (the fitted models of folds). Keys are
    distinct. Predictions are made once for equal features: the squared errors of such rows follow from their number,
    mean and variance."""
    within = within or []
    fitted = lambda rows: rows if models is None else rows.join(F.broadcast(models), within)
    from .quality import numbered

    rows = stored(numbered(df.select(*within, key, *features, target), [*within, key], "__i"))
    names = [f"__x{i}" for i in range(len(features))]  # of the features' values, as they are or dealt anew

    def errors(both: DataFrame, variants: dict[str, list[Column]]) -> DataFrame:
        """feature, r2 of the predictions for each variant of the features' values."""
        one = [F.struct(F.lit(f).alias("feature"), *[c.alias(n) for c, n in zip(values, names, strict=True)]) for f, values in variants.items()]
        each = both.select(*within, F.col(target).alias("__y"), F.explode(F.array(*one)).alias("__v")).select(*within, "__y", "__v.*")
        cells = each.groupBy(*within, "feature", *names).agg(F.count("__y").alias("__n"), F.avg("__y").alias("__m"), (F.var_pop("__y") * F.count("__y")).alias("__s"))
        off = F.col("__m") - predict(dict(zip(features, map(F.col, names), strict=True)))
        sums = fitted(cells).groupBy("feature").agg(F.sum(F.col("__s") + F.col("__n") * off * off).alias("e"))
        return sums.crossJoin(whole).select("feature", (1 - F.col("e") / F.col("__whole")).alias("r2"))

    whole = rows.agg((F.var_pop(target) * F.count("*")).alias("__whole"))
    base = errors(rows, {"": [F.col(f) for f in features]}).select(F.col("r2").alias("base"))
    out = None
    for r in range(1, repeats + 1):
        order = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(r)), F.lit(str(seed))))
        # Both orders begin with the columns of ``within``, so equal numbers are of one group.
        dealt = numbered(rows.select(*within, order.alias("__o"), key, *[F.col(f).alias(f"__{f}") for f in features]), [*within, "__o", key], "__i").drop("__o", key, *within)
        one = errors(rows.join(dealt, "__i"), {f: [F.col(f"__{g}" if g == f else g) for g in features] for f in features})
        out = one if out is None else out.unionByName(one)
    return out.crossJoin(base).groupBy("feature").agg(F.avg(F.col("base") - F.col("r2")).alias("drop"))


def estimate(homes: DataFrame, factors: list[str], roll: str, band: dict[str, float]) -> DataFrame:
    """homes with a price anchored at their place's level: price_m2 of the place times its typical size (``level``,
    ``size0``), moved by exp of the sum of b_f * (f - f0) over factors (columns f, f0 and b_f; sizes in logs), rolled
    forward by a share; with the band of error quantiles, and the price per square metre for ``size``."""
    shift = F.lit(0.0)
    for f in factors:
        shift = shift + F.col(f"b_{f}") * (F.col(f) - F.col(f"{f}0"))
    price = F.col("level") * F.col("size0") * F.exp(shift) * (1 + F.col(roll))
    out = homes.withColumn("price", price)
    return out.withColumns({n: F.col("price") * q for n, q in band.items()} | {"price_m2": F.try_divide(F.col("price"), F.col("size"))})


def factor_steps(homes: DataFrame, keys: list[str], factors: list[str], roll: str) -> DataFrame:
    """The estimate's factors as (keys, place in the chain, factor, log step), for a waterfall; the roll comes last."""
    steps = [F.struct(F.lit(i).alias("i"), F.lit(f).alias("factor"), (F.col(f"b_{f}") * (F.col(f) - F.col(f"{f}0"))).alias("step")) for i, f in enumerate(factors, 1)]
    steps.append(F.struct(F.lit(len(factors) + 1).alias("i"), F.lit("roll").alias("factor"), F.log1p(F.col(roll)).alias("step")))
    return homes.select(*keys, F.explode(F.array(*steps)).alias("s")).select(*keys, "s.*")


def band_position(value: Column, low: Column, high: Column) -> Column:
    """Where a value stands against a band: below, inside or above."""
    return F.when(value < low, "below").when(value > high, "above").when(value.isNotNull() & low.isNotNull() & high.isNotNull(), "inside")
