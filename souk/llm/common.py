"""What the operators of this subpackage share: reading tables, cutting lineage, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only where none is named, as in
    tests on one machine, is a temporary folder set."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if found is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        found = tempfile.mkdtemp(prefix="spark-souk-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage with a reliable checkpoint; lost executors do not lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: column pruning works on it, and
    later stages do not depend on executors that wrote it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/souk-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the whole text (null: empty); other columns, whatever their names, stay behind."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def let(value: Column, then) -> Column:
    """then(value), where value stands in the plan once however often it is used."""
    return F.transform(F.array(value), then)[0]


class Memo(dict):
    """make(key), kept for the last keys seen: once it holds ``most`` entries they become the older generation,
    from which keys in use come back; so a worker's memory is bounded while the frequent keys stay at hand.
    Workers serve one stage after another, so caches of another module are emptied once one is filled."""

    made: ClassVar[list] = []
    filling: ClassVar[str | None] = None

    def __init__(self, make, most: int = 400_000, longest: int = 48):
        super().__init__()
        self.make, self.most, self.longest, self.owner, self.old = make, most // 2, longest, make.__module__, {}
        Memo.made.append(self)

    @staticmethod
    def fill(owner: str) -> None:
        import pyarrow as pa

        if Memo.filling != owner:
            Memo.filling = owner
            for other in Memo.made:
                if other.owner != owner:
                    other.forget()
            pa.default_memory_pool().release_unused()

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            Memo.fill(self.owner)
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def entering(owner: str) -> None:
    """Said by operators without caches of their own, so that those of the stage before do not stay."""
    Memo.fill(owner)


class Recent:
    """Two generations of known values, for callers that learn many keys at once: after missing(keys) and once
    the keys it returns are put into ``young``, all keys are there."""

    def __init__(self, owner: str, most: int):
        self.owner, self.most, self.young, self.old = owner, most, {}, {}
        Memo.made.append(self)

    def forget(self) -> None:
        self.young, self.old = {}, {}

    def missing(self, keys: set) -> list:
        Memo.fill(self.owner)
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        fresh = keys.difference(self.young)
        for k in fresh.intersection(self.old):
            self.young[k] = self.old[k]
        return list(fresh.difference(self.young))
