"""Points, polygons and centroids. Polygons and centroids are reference tables; they are broadcast only where
the planner's size check allows, and met through grid cells, not by crossing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.sources.tables import stored


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd ray test; edges: array<struct<x1,y1,x2,y2>>."""
    crossed = F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    return F.size(crossed) % 2 == 1


def cells(low: Column, high: Column, size) -> Column:
    return F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))


def _touching(edges: Column, x0: Column, y0: Column, size: Column) -> Column:
    """The edges that meet the closed square at (x0, y0)."""

    def meets(e):
        side = lambda x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        corners = [side(x, y) for x in (x0, x0 + size) for y in (y0, y0 + size)]
        near = (F.least(e["x1"], e["x2"]) <= x0 + size) & (F.greatest(e["x1"], e["x2"]) >= x0) & (F.least(e["y1"], e["y2"]) <= y0 + size) & (F.greatest(e["y1"], e["y2"]) >= y0)
        return near & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)

    return F.filter(edges, meets)


def _odd(edges: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a path from one point to another, first along x and then along y, crosses an odd number of edges."""
    along_x = lambda e: ((e["y1"] > y1) != (e["y2"] > y1)) & ((x1 < (at := (e["x2"] - e["x1"]) * (y1 - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])) != (x2 < at))
    along_y = lambda e: ((e["x1"] > x2) != (e["x2"] > x2)) & ((y1 < (at := (e["y2"] - e["y1"]) * (x2 - e["x1"]) / (e["x2"] - e["x1"]) + e["y1"])) != (y2 < at))
    return (F.size(F.filter(edges, along_x)) + F.size(F.filter(edges, along_y))) % 2 == 1


def _mark(cell: Column, axis: str, size: Column) -> Column:
    """A square's point of reference: near its middle, but on no line that drawn shapes are likely to have."""
    return (cell + (0.4371 if axis == "cx" else 0.5613)) * size


def cover(polygons: DataFrame, most_edges: int = 16, deepest: int = 24) -> DataFrame:
    """polygons (poly, edges and box) as squares of sides 2 ** level: poly, level, cx, cy, ``held`` (whether the square's
    mark is inside) and the ``edges`` that meet the square, none in a square that is wholly inside.

    A polygon starts with the at most four squares that its box touches. A square that more than ``most_edges`` edges
    meet is split into four, at most ``deepest`` times; each takes those of its parent's edges that meet it, and whether
    its mark is inside follows from the parent's mark and the edges between the two. So the number of squares grows
    with the number of edges, not with the area, and a point is held against a few edges only."""
    wide = F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"), F.lit(1e-9))
    side = F.pow(F.lit(2.0), F.col("level"))
    start = polygons.select("poly", F.col("edges").alias("all"), F.ceil(F.log2(wide)).cast("int").alias("level"), "x_min", "x_max", "y_min", "y_max")
    start = start.withColumn("cx", F.explode(cells(F.col("x_min"), F.col("x_max"), side))).withColumn("cy", F.explode(cells(F.col("y_min"), F.col("y_max"), side)))
    middle = lambda c: _mark(F.col(c), c, side)
    made = start.select("poly", "level", "cx", "cy", inside(middle("cx"), middle("cy"), F.col("all")).alias("held"), _touching(F.col("all"), F.col("cx") * side, F.col("cy") * side, side).alias("edges"))
    done, todo, many = None, stored(made), F.size("edges") > most_edges
    for _ in range(deepest):
        ready = todo.where(~many & (F.col("held") | (F.size("edges") > 0)))
        done = ready if done is None else done.unionByName(ready)
        split = todo.where(many)
        if split.isEmpty():
            return done
        half = F.pow(F.lit(2.0), F.col("level") - 1)
        child = split.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("dx", F.col("cx") * 2 + F.col("q") % 2).withColumn("dy", F.col("cy") * 2 + F.floor(F.col("q") / 2))
        crossed = _odd(F.col("edges"), middle("cx"), middle("cy"), _mark(F.col("dx"), "cx", half), _mark(F.col("dy"), "cy", half))
        child = child.withColumn("crossed", crossed).withColumn("near", _touching(F.col("edges"), F.col("dx") * half, F.col("dy") * half, half)).withColumn("down", F.col("level") - 1)
        todo = stored(child.select("poly", F.col("down").alias("level"), F.col("dx").alias("cx"), F.col("dy").alias("cy"), (F.col("held") != F.col("crossed")).alias("held"), F.col("near").alias("edges")))
    return done.unionByName(todo.where(F.col("held") | (F.size("edges") > 0)))


def covered(points: DataFrame, squares: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """points (a table or a stream) with ``poly``, a row for each polygon that holds them; squares as cover() gives them,
    looked up once on each of their levels."""
    levels = sorted(r[0] for r in squares.select("level").distinct().collect())  # few: powers of two
    if not levels:
        return points.join(squares.select("poly"), F.lit(False))
    size = F.pow(F.lit(2.0), F.col("__level"))
    at = points.withColumn("__level", F.explode(F.array(*[F.lit(v) for v in levels]))).withColumn("__cx", F.floor(F.col(x) / size).cast("long")).withColumn("__cy", F.floor(F.col(y) / size).cast("long"))
    known = squares.select("poly", *[F.col(c).alias(f"__{c}") for c in ("level", "cx", "cy", "held", "edges")])
    crossed = _odd(F.col("__edges"), _mark(F.col("__cx"), "cx", size), _mark(F.col("__cy"), "cy", size), F.col(x), F.col(y))
    found = at.join(known, ["__level", "__cx", "__cy"]).where(F.when(F.size("__edges") == 0, F.col("__held")).otherwise(F.col("__held") != crossed))
    return found.select(*points.columns, "poly")


def locate(points: DataFrame, polygons: DataFrame, most_edges: int = 16) -> DataFrame:
    """points (id, x, y) x polygons (poly, edges, x_min, x_max, y_min, y_max) -> id, poly: the least polygon that
    holds the point (null: none)."""
    hits = covered(points.select("id", "x", "y"), cover(polygons, most_edges)).groupBy("id").agg(F.min("poly").alias("poly"))
    return points.join(hits, "id", "left").select("id", "poly")


def segment_distance(x: Column, y: Column, e: Column) -> Column:
    """Distance of a point to an edge."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((x - e["x1"]) * dx + (y - e["y1"]) * dy, dx * dx + dy * dy))), F.lit(0.0))
    return F.sqrt(F.pow(x - e["x1"] - t * dx, 2) + F.pow(y - e["y1"] - t * dy, 2))


def snap(points: DataFrame, polygons: DataFrame, within: float) -> DataFrame:
    """Nearest polygon within a distance for points outside all; nulls: no_coordinates; else outside."""
    gridded = polygons.withColumn("cx", F.explode(cells(F.col("x_min") - within, F.col("x_max") + within, within))).withColumn("cy", F.explode(cells(F.col("y_min") - within, F.col("y_max") + within, within)))
    at = points.withColumn("cx", F.floor(F.col("x") / within)).withColumn("cy", F.floor(F.col("y") / within))
    d = F.array_min(F.transform("edges", lambda e: segment_distance(F.col("x"), F.col("y"), e)))
    near = at.join(gridded, ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= within).groupBy("id").agg(F.min(F.struct("d", "poly")).alias("b"))
    status = F.when(F.col("x").isNull() | F.col("y").isNull(), "no_coordinates").when(F.col("b").isNull(), "outside").otherwise("snapped")
    return points.join(near, "id", "left").select("id", F.col("b.poly").alias("poly"), status.alias("status"))


def nearest_centroid(points: DataFrame, centroids: DataFrame, cell: float, extent: float, x_scale: float = 1.0) -> DataFrame:
    """points (id, x, y), centroids (name, cx, cy): the nearest name, the least on ties, and the squared distance.
    ``cell`` is a common distance to the nearest and ``extent`` at least the largest possible one. A point is held
    against the centroids of the nine cells around it; where none of them is as near as a cell is wide, the search
    goes on in cells four times as wide, up to the extent. Null coordinates give no name."""
    todo, found, size = points.where("x is not null and y is not null"), None, cell
    at = lambda c, scale: F.floor(c * scale / size).cast("long")
    while True:
        last = size >= extent
        sides = F.sequence(F.lit(-1), F.lit(1))
        dealt = centroids.select("name", "cx", "cy", F.explode(sides).alias("i")).select("*", F.explode(sides).alias("j"))
        dealt = dealt.select("name", "cx", "cy", (at(F.col("cx"), x_scale) + F.col("i")).alias("gx"), (at(F.col("cy"), 1.0) + F.col("j")).alias("gy"))
        near = todo.withColumn("gx", at(F.col("x"), x_scale)).withColumn("gy", at(F.col("y"), 1.0)).join(dealt, ["gx", "gy"])
        d2 = F.pow((F.col("x") - F.col("cx")) * x_scale, 2) + F.pow(F.col("y") - F.col("cy"), 2)
        best = near.groupBy("id").agg(F.min(F.struct(d2.alias("d2"), F.col("name"))).alias("b"))
        sure = best if last else best.where(F.col("b.d2") <= size * size)
        found = sure if found is None else found.unionByName(sure)
        if last:
            break
        todo, size = todo.join(sure, "id", "left_anti"), size * 4
    return points.join(found, "id", "left").select("id", F.col("b.name").alias("name"), F.col("b.d2").alias("d2"))


def verified(points: DataFrame, places: DataFrame, tolerance: float, cell: float, extent: float, x_scale: float = 1.0) -> DataFrame:
    """points (id, x, y, tag), places (name, cx, cy and box) -> id, name, ok: the given tag where the point is in
    that place's box, with a tolerance; else the nearest place. ok says whether the tag was kept."""
    box = places.select(F.col("name").alias("tag"), "x_min", "x_max", "y_min", "y_max")
    inside_ = F.col("x").between(F.col("x_min") - tolerance, F.col("x_max") + tolerance) & F.col("y").between(F.col("y_min") - tolerance, F.col("y_max") + tolerance)
    held = points.join(box, "tag", "left").select("id", "x", "y", "tag", F.coalesce(inside_, F.lit(False)).alias("ok"))
    near = nearest_centroid(held.where("not ok").select("id", "x", "y"), places.select("name", "cx", "cy"), cell, extent, x_scale)
    return held.join(near.select("id", F.col("name").alias("nearest")), "id", "left").select("id", F.when(F.col("ok"), F.col("tag")).otherwise(F.col("nearest")).alias("name"), "ok")


def majority_label(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """poly -> the most frequent label of the points (id, x, y, label) it holds, the least on ties; null if none."""
    inside_ = points.join(locate(points.select("id", "x", "y"), polygons), "id").where("poly is not null")
    votes = inside_.groupBy("poly", "label").count().groupBy("poly").agg(F.min_by("label", F.struct((-F.col("count")).alias("n"), F.col("label").alias("l"))).alias("label"))
    return polygons.select("poly").join(votes, "poly", "left")


def rounded_rings(rings: Column, places: int = 4) -> Column:
    """array<array<array<double>>> with every coordinate rounded."""
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: F.transform(p, lambda c: F.round(c, places))))


def projection(box: DataFrame, width: float, pad: float = 10.0) -> DataFrame:
    """One row of an equirectangular projection that fits a box (x_min, x_max, y_min, y_max in degrees) to a width:
    lon0, lat1, kx, scale, pad and the height."""
    kx = F.cos(F.radians((F.col("y_min") + F.col("y_max")) / 2))
    out = box.select(F.col("x_min").alias("lon0"), F.col("y_max").alias("lat1"), "y_min", kx.alias("kx"), (F.lit(width - 2 * pad) / ((F.col("x_max") - F.col("x_min")) * kx)).alias("scale"), F.lit(float(pad)).alias("pad"))
    return out.withColumn("height", F.round(2 * F.col("pad") + (F.col("lat1") - F.col("y_min")) * F.col("scale"), 1)).drop("y_min")


def projected(df: DataFrame, fitted: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """df with px, py by a projection() row."""
    made = df.crossJoin(fitted.select("lon0", "lat1", "kx", "scale", "pad"))  # one row
    return made.withColumn("px", F.col("pad") + (F.col(x) - F.col("lon0")) * F.col("kx") * F.col("scale")).withColumn("py", F.col("pad") + (F.col("lat1") - F.col(y)) * F.col("scale")).drop("lon0", "lat1", "kx", "scale", "pad")
