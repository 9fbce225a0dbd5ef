"""Linking and set operations on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cascade_link(df: DataFrame, name: str, overrides: DataFrame, keys: DataFrame, key_of) -> DataFrame:
    """df with target and link: an override (name, target) first, else the reference (key, target) that has the
    name's normalised key, else none. Linked once for each distinct name; the largest target on collisions."""
    names = df.select(name).distinct()
    once = keys.groupBy("key").agg(F.max("target").alias("by_key"))
    hand = overrides.groupBy("name").agg(F.max("target").alias("by_hand"))
    linked = names.join(hand, names[name] == hand["name"], "left").drop("name") if name != "name" else names.join(hand, "name", "left")
    linked = linked.withColumn("key", key_of(F.col(name))).join(once, "key", "left")
    linked = linked.select(F.col(name).alias("__n"), F.coalesce("by_hand", "by_key").alias("target"), F.when(F.col("by_hand").isNotNull(), "override").when(F.col("by_key").isNotNull(), "key").otherwise("none").alias("link"))
    return df.join(linked, F.col(name).eqNullSafe(F.col("__n")), "left").drop("__n")


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old whose key new lacks, and all of new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def table_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has (with repetition), and which."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def only_in(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    return new.join(old, key, "left_anti")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, those whose hash of key and seed is least; the same on any partitioning. The
    limit is the operator: each task keeps n rows and these are merged."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old, and those rows of new whose key old lacks; columns of one side only are null on the other."""
    return old.unionByName(only_in(new, old.select(key), key), allowMissingColumns=True)
