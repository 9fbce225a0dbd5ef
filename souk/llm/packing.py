"""Mixture-controlled packing by deficit round-robin (operator 1).

Each source is a queue of its documents' tokens. Every round gives each queue a quantum, its share of one
sequence, and serves as many tokens as its quanta so far cover; documents are cut there. A queue whose quantum
is under ``packet`` tokens is served when its deficit covers a packet, so its deficit stands over several rounds.
The k-th packet of a queue is served in round ceil(tokens up to its end / quantum), so rounds follow from prefix
sums and no state passes from task to task: deficits carry across sequences and partitions by arithmetic.
Packets in order of (round, source, place in the queue) are cut into sequences of ``size`` tokens. So each
sequence holds the target shares, off by a token for each queue (by a packet where the quantum is smaller), and
only the last one needs padding.

Without targets a source's share is its share of all tokens, so that all queues end in the last round. A
source with a target gets that weight instead; others keep their natural weight, and all weights together fill a
sequence. Once a queue has run out the others share what follows. A target of 0 puts a source behind all others.

Ids come from the compiled automaton of the tokenizer file, which gives what the tokenizers library gives.

Cases: null text is empty (a document of one token, the end mark); a null source is a source of its own;
very long texts are cut; rows with equal ids, or wholly equal ones, are packed each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stored
from .word_tokens import word_tokens


def tokenized(df: DataFrame, path: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """A table in the shared folder: part and idx (which row of which task), doc_id, source, n tokens, ``before``
    (tokens of its source earlier in the task), and the ids as bytes. A task that runs again writes the same rows."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.concat(F.lit("="), F.col(source_col).cast("string")).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("source", F.coalesce("source", F.lit("")))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        words, part, idx, queues = word_tokens(path), TaskContext.get().partitionId(), 0, {}
        end = np.array([end_id], dtype=words.kind).tobytes()
        for b in batches:
            ids = [x + end for x in words.encode_many(b.column("text").to_pylist())]
            sizes, before = [len(x) // words.kind.itemsize for x in ids], []
            for source, n in zip(b.column("source").to_pylist(), sizes, strict=True):
                before.append(queues.get(source, 0))
                queues[source] = before[-1] + n
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array(range(idx, idx + n), pa.int64()), b.column("doc_id"), b.column("source"), pa.array(sizes, pa.int64()), pa.array(before, pa.int64()), pa.array(ids, pa.binary())],
                ["part", "idx", "doc_id", "source", "n", "before", "ids"],
            )
            idx += n

    return stored(rows.mapInArrow(run, "part int, idx long, doc_id long, source string, n long, before long, ids binary"), "none")


def queues(docs: DataFrame, size: int, packet: int, targets: dict[str, float] | None) -> DataFrame:
    """docs (source, part, n, before) -> a row for each source and part: base (tokens of the queue before the
    part), total, quantum (null: behind all others), step (tokens of a packet), and last, the round in which the
    last queue with a quantum ends."""
    parts = stored(docs.groupBy("source", "part").agg(F.sum("n").alias("t")))
    queue = Window.partitionBy("source")
    parts = parts.select("source", "part", (F.sum("t").over(queue.orderBy("part")) - F.col("t")).alias("base"), F.sum("t").over(queue).alias("total"))
    each = parts.groupBy("source").agg(F.max("total").cast("double").alias("total"))
    weight = F.col("total")
    for name, share in (targets or {}).items():
        weight = F.when(F.col("source") == f"={name}", F.col("all") * float(share)).otherwise(weight)
    each = each.withColumn("all", each.agg(F.sum("total")).scalar()).withColumn("w", weight)
    each = each.withColumn("quantum", F.when(F.col("w") > 0, F.col("w") * size / each.agg(F.sum("w")).scalar()))
    each = each.withColumn("last", each.agg(F.coalesce(F.max(F.ceil(F.col("total") / F.col("quantum"))), F.lit(0))).scalar())
    step = F.when(F.col("quantum").isNull(), F.lit(float(size))).otherwise(F.col("quantum") * F.ceil(packet / F.col("quantum")))
    return parts.join(each.select("source", "quantum", step.alias("step"), "last"), "source")


def schedule(docs: DataFrame, size: int, packet: int, targets: dict[str, float] | None) -> DataFrame:
    """docs (part, idx, source, n, before) -> a row for each piece: part, idx, start, length, sequence_id, offset."""
    of = queues(docs, size, packet, targets)
    placed = docs.join(of, ["source", "part"]).withColumn("at", F.col("base") + F.col("before"))
    # The k-th packet of a queue ends at floor((k + 1) * step); which packet holds a place is that formula's
    # inverse, put right where rounding is off.
    edge = lambda k: F.floor(k * F.col("step"))

    def holder(x):
        guess = F.greatest(F.ceil((x + 1) / F.col("step")) - 1, F.lit(0))
        return guess - F.when(edge(guess) > x, 1).otherwise(0) + F.when(edge(guess + 1) <= x, 1).otherwise(0)

    k = F.explode(F.sequence(holder(F.col("at")), holder(F.col("at") + F.col("n") - 1)))
    pieces = placed.select("*", k.alias("k"))
    low, high = F.greatest(F.col("at"), edge(F.col("k"))), F.least(F.col("at") + F.col("n"), edge(F.col("k") + 1))
    served = F.ceil(F.least(edge(F.col("k") + 1), F.col("total")) / F.col("quantum"))
    packets = pieces.select("part", "idx", "source", (low - F.col("at")).alias("start"), (high - low).alias("length"), low.alias("at"), F.coalesce(served, F.col("last") + 1 + F.col("k")).cast("long").alias("round"))
    # Place in the stream of all packets: sums by blocks of rounds, in three levels, so that no task has more
    # than a block; the top level has a row for each 65,536 rounds.
    packets = packets.withColumn("b1", F.expr("round div 64")).withColumn("b2", F.expr("round div 65536"))
    first = packets.groupBy("b1", "b2").agg(F.sum("length").alias("t"))
    second = first.groupBy("b2").agg(F.sum("t").alias("t"))
    second = second.select("b2", (F.sum("t").over(Window.orderBy("b2")) - F.col("t")).alias("o2"))
    first = first.select("b1", "b2", (F.sum("t").over(Window.partitionBy("b2").orderBy("b1")) - F.col("t")).alias("o1")).join(second, "b2").select("b1", (F.col("o1") + F.col("o2")).alias("o1"))
    inner = Window.partitionBy("b1").orderBy("round", "source", "at").rowsBetween(Window.unboundedPreceding, -1)
    stream = packets.withColumn("o", F.coalesce(F.sum("length").over(inner), F.lit(0))).join(first, "b1").withColumn("pos", F.col("o") + F.col("o1"))
    # Cut where a sequence ends.
    s = F.explode(F.sequence(F.expr(f"pos div {size}"), F.expr(f"(pos + length - 1) div {size}")))
    cut = stream.select("part", "idx", "start", "length", "pos", s.alias("sequence_id"))
    low, high = F.greatest(F.col("pos"), F.col("sequence_id") * size), F.least(F.col("pos") + F.col("length"), (F.col("sequence_id") + 1) * size)
    return cut.select("part", "idx", (F.col("start") + low - F.col("pos")).alias("start"), (high - low).alias("length"), "sequence_id", (low - F.col("sequence_id") * size).alias("offset"))


def pack(df: DataFrame, path: str, end_id: int, size: int = 4096, packet: int = 64, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_ids: bool = False) -> DataFrame:
    """Packs every token of df's documents into sequences of ``size``; one row for each piece: doc_id, source,
    start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves if keep_ids."""
    table = tokenized(df, path, end_id, id_col, text_col, source_col)
    pieces = schedule(table.select("part", "idx", "source", "n", "before"), size, packet, targets)
    by_doc = pieces.groupBy("part", "idx").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))  # as many as the document's length gives
    joined = table.join(by_doc, ["part", "idx"]).select("doc_id", "source", "n", "ids", "pieces")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute

        for b in batches:
            if not b.num_rows:
                continue
            n, ids, cuts = b.column("n").to_numpy(), b.column("ids"), b.column("pieces")
            row = np.repeat(np.arange(len(n)), cuts.value_lengths().to_numpy())
            start, length, sequence, offset = (x.to_numpy() for x in cuts.flatten().flatten())
            order = np.lexsort((start, row))
            row, start, length = row[order], start[order], length[order]
            stops = np.cumsum(n)
            raw = b"".join(x.as_py() for x in ids)
            wide = np.frombuffer(raw, dtype=f"<u{len(raw) // int(stops[-1])}").astype("<u4")
            low = stops[row] - n[row] + start
            view = memoryview(wide).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * z]) for a, z in zip(low.tolist(), (low + length).tolist(), strict=True)]
            sources = b.column("source").take(pa.array(row))
            sources = pa.compute.if_else(pa.compute.equal(sources, ""), None, pa.compute.utf8_slice_codeunits(sources, 1))
            out = [b.column("doc_id").take(pa.array(row)), sources, *map(pa.array, (start, length)), pa.array(crc, pa.int64()), *map(pa.array, (n[row], sequence[order], offset[order]))]
            if keep_ids:
                ends = np.concatenate([[0], np.cumsum(length)])
                at = np.repeat(low - ends[:-1], length) + np.arange(ends[-1])
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(wide[at].astype("i4"))))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids])

    kept = ", ids array<int>" * keep_ids
    return joined.mapInArrow(run, f"doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{kept}")


def op1_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2)
