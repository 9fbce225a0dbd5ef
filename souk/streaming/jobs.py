"""Structured Streaming jobs over arriving listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from souk.sources.tables import write_history


def dedup(stream: DataFrame, key: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """First of each key within the watermark's delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def append_job(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there and stops; a later run goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history_job(stream: DataFrame, summarise, path: str, checkpoint: str, key: str = "collected_on") -> StreamingQuery:
    """Each batch's summary replaces its dates' partitions. Statistics that need all of a date (medians) are of
    the batch, so a date should arrive in one batch; see counting_job() for dates that come in parts."""
    return stream.writeStream.foreachBatch(lambda batch, _: write_history(summarise(batch), path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_counts(batch: DataFrame, batch_id: int, path: str, keys: list[str], value: str) -> None:
    """Writes how often each value came in a batch, by keys (the first is the folder), in the batch's own place: a
    batch that is run again, after a failure, replaces what it wrote before."""
    counts = batch.groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    counts.write.mode("overwrite").partitionBy(keys[0]).parquet(f"{path.rstrip('/')}/batch={batch_id}")


def counting_job(stream: DataFrame, path: str, checkpoint: str, keys: list[str], value: str, merge=merge_counts) -> StreamingQuery:
    """Counts of values that add up over batches, so the rows of a date may come in any number of them."""
    return stream.writeStream.foreachBatch(lambda batch, i: merge(batch, i, path, keys, value)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted_history(spark: SparkSession, path: str, keys: list[str], level: str = "level", n: str = "listings") -> DataFrame:
    """keys, the number of rows and the exact median of their values so far, from merge_counts(). Null values count as
    rows only."""
    from souk.operators.selection import Values, joined

    counts = spark.read.parquet(path)
    median = Values(counts, keys, "value", "n").percentiles({level: 0.5})
    return joined(counts.groupBy(*keys).agg(F.sum("n").alias(n)), median, keys, "left")


SNAPSHOT = "scope string, collected_on date, listings long, incomplete boolean"


def flag_incomplete(stream: DataFrame, scope: str = "scope", time: str = "collected_on", n: str = "listings", back: int = 4, keep_days: int = 365) -> DataFrame:
    """incomplete() for arriving snapshots: each is flagged against the last ``back`` of its scope before it, which are
    the only state; a scope is forgotten when keep_days have passed since its last one, by the dates of what arrives.
    Snapshots of a scope should come in the order of their dates; those of one batch are put in order, a repeated date
    replaces the one before it, a late one is held against the earlier ones among those kept, and one that is keep_days
    late is dropped."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def arrived(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        frame = pd.concat(frames)
        rows = sorted(zip(frame[time], frame[n], strict=True))
        out = []
        for day, count in rows:
            counts = sorted(held[d] for d in sorted(d for d in held if d < day)[-back:])
            middle = (counts[(len(counts) - 1) // 2] + counts[len(counts) // 2]) / 2 if counts else None
            out.append((key[0], day, count, middle is not None and count < 0.5 * middle))
            held[day] = int(count)
            held = {d: held[d] for d in sorted(held)[-back - 1 :]}  # one more, in case the last date is repeated
        state.update((sorted(held), [held[d] for d in sorted(held)]))
        state.setTimeoutTimestamp(max(int(pd.Timestamp(max(held)).timestamp() + keep_days * 86_400) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["scope", "collected_on", "listings", "incomplete"])

    known = stream.where(F.col(scope).isNotNull() & F.col(time).isNotNull() & F.col(n).isNotNull()).select(F.col(scope).cast("string").alias(scope), F.col(time).cast("date").alias(time), F.col(n).cast("long").alias(n))
    known = known.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", f"{keep_days} days")
    return known.groupBy(scope).applyInPandasWithState(arrived, SNAPSHOT, "days array<date>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def incomplete(history: DataFrame, scope: str = "scope", time: str = "collected_on", n: str = "listings", back: int = 4) -> DataFrame:
    """history with ``incomplete``: fewer than half the median of the ``back`` snapshots before."""
    from pyspark.sql import Window

    w = Window.partitionBy(scope).orderBy(time).rowsBetween(-back, -1)
    # At most ``back`` values; the middle one, or the mean of the middle two.
    before = F.sort_array(F.collect_list(n).over(w))
    middle = (F.get(before, F.floor((F.size(before) - 1) / 2).cast("int")) + F.get(before, F.floor(F.size(before) / 2).cast("int"))) / 2
    return history.withColumn("incomplete", F.coalesce(F.col(n) < 0.5 * middle, F.lit(False)))


def weekly_levels(history: DataFrame, scope: str = "scope", time: str = "collected_on", n: str = "listings", level: str = "level") -> DataFrame:
    """(scope, week, n, level): the weighted mean of a week's snapshots; weeks start on Monday."""
    known = history.where(F.col(level).isNotNull())
    return known.groupBy(scope, F.date_trunc("week", time).cast("date").alias("week")).agg(F.sum(n).alias("n"), (F.sum(F.col(n) * F.col(level)) / F.sum(n)).alias("level"))


def located_ads(payloads: DataFrame, polygons: DataFrame, sizes: tuple[float, float], prices: tuple[float, float]) -> DataFrame:
    """Ads of a stream (or table) of card payloads within the size and price ranges, with a row for each polygon
    (poly, edges and box) that holds them. A stream-static join on squares; no state is kept."""
    from souk.operators import geo
    from souk.sources import tables

    ads = tables.ads(tables.cards(payloads)).where(F.col("size_m2").between(*sizes) & F.col("price_m2").between(*prices))
    return geo.covered(ads, geo.cover(polygons), "lon", "lat").select("token", "lat", "lon", "price", "price_m2", "size_m2", "rooms", "poly")
