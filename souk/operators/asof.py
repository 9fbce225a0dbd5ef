"""As-of join: to each row the last row of another table at or before its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.sources.tables import stored


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], order: list[str] | None = None, tolerance: Column | None = None, strict: bool = False, prefix: str = "as_of_") -> DataFrame:
    """left with right's ``values`` and ``time`` (names with the prefix) of the row of equal keys with the greatest time at
    or before left's (strict: before). Of right rows with equal keys and time the greatest by ``order`` (default: by the
    values) counts. With a tolerance, such as an interval, older rows do not count. Every left row stays; those without
    a match, or with a null key or time, have nulls.

    Both tables are put in one order by keys and time, parted into ranges, and written once. Inside a range the last
    known row is carried on; what is carried from range to range is one row for each range, since only a range's first
    key can have begun before it. So a key's history is never in one task, however long it is."""
    struct = lambda cols: F.struct(*[F.col(c) for c in cols])
    known = right.where(F.col(time).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    best = known.groupBy(*keys, time).agg(F.max_by(struct(values), struct(order or values)).alias("__v"))
    last = F.struct(F.col(time).alias("t"), F.col("__v").alias("v"))
    theirs = best.select(struct(keys).alias("k"), F.col(time).alias("t"), F.lit(1 if strict else 0).alias("side"), last.alias("r"), F.lit(0).cast("long").alias("salt"))
    own = left.select(struct(keys).alias("k"), F.col(time).alias("t"), F.lit(0 if strict else 1).alias("side"), struct(left.columns).alias("l"))
    own = own.withColumn("salt", F.xxhash64("l"))  # many rows of one key and time are parted as well
    both = theirs.unionByName(own, allowMissingColumns=True)
    ranged = stored(both.repartitionByRange("k", "t", "side", "salt").withColumn("p", F.spark_partition_id()))
    end = Window.orderBy("p")  # one row a range
    ends = ranged.groupBy("p").agg(F.max("k").alias("k"), F.max_by("r", F.when(F.col("r").isNotNull(), F.struct("k", "t"))).alias("r"), F.max(F.when(F.col("r").isNotNull(), F.col("k"))).alias("of"))
    carried = ends.select((F.lead("p").over(end)).alias("p"), F.last(F.when(F.col("r").isNotNull(), F.struct(F.col("of").alias("k"), "r")), ignorenulls=True).over(end.rowsBetween(Window.unboundedPreceding, 0)).alias("before")).where("p is not null and before is not null")
    inside = F.last("r", ignorenulls=True).over(Window.partitionBy("p", "k").orderBy("t", "side", "salt").rowsBetween(Window.unboundedPreceding, 0))
    out = ranged.withColumn("own", inside).where("l is not null").join(F.broadcast(carried), "p", "left")
    found = F.coalesce("own", F.when(F.col("k") == F.col("before.k"), F.col("before.r")))
    if tolerance is not None:
        found = F.when(found["t"] + tolerance >= F.col("t"), found)
    picked = out.select("l", found.alias("r"))
    return picked.select("l.*", F.col("r.t").alias(f"{prefix}{time}"), *[F.col(f"r.v.{v}").alias(f"{prefix}{v}") for v in values])
