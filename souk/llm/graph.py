"""Connected components of an edge table: alternating star contractions in DataFrame operations, or, where the
edges are counted to be few, one bounded task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Up to so many different edges are joined in one task; each of the many small shuffles of a round costs more.
FEW_EDGES = 200_000


def components(edges: DataFrame, most_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """edges (a, b) of any orderable type -> (node, component), component the least node reachable; only nodes
    with an edge are listed. Rows with a null end and loops are ignored, repeated rows count once.

    A large-star round hangs each node's larger neighbours on its least neighbour, a small-star round does so
    with the smaller ones; the rounds needed grow with the logarithm of the size. Each round ends in a
    checkpoint, so a lost executor costs at most one round."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if e.limit(few + 1).count() <= few:
        return _in_one_task(e)
    while not _settled(e):
        if not most_rounds:
            raise RuntimeError("components did not settle")
        most_rounds -= 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _in_one_task(e: DataFrame) -> DataFrame:
    """Components of a table of edges (u, v) of checked size."""
    kind = e.schema["u"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        ends = pa.chunked_array([*table.column("u").chunks, *table.column("v").chunks]).combine_chunks()
        nodes = ends.unique()
        nodes = nodes.take(pa.compute.sort_indices(nodes))  # strings by their bytes, as Spark orders them
        at = pa.compute.index_in(ends, nodes).to_numpy()
        u, v = at[: table.num_rows], at[table.num_rows :]
        root = np.arange(len(nodes))
        while True:
            a, b = root[u], root[v]
            low, high = np.minimum(a, b), np.maximum(a, b)
            if (low == high).all():
                break
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(root))], ["node", "component"])

    return cut(e.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}"))


def _settled(e: DataFrame) -> bool:
    """Whether every node hangs on one other only, and that one on none: then it is its component's least."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")), F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))).alias("s")).select("s.*")
    return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs + holds > 1").isEmpty()
