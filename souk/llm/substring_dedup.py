"""Exact removal of repeated word windows behind a count-min prefilter (operator 3).

A window is ``size`` consecutive words. First pass: every task counts, in a count-min sketch, in how many
documents each window's minimiser occurs (the least hash among the window's runs of size / 2 words, so that
neighbouring windows share one and equal windows have equal ones); the sketches are merged by adding their
cells. A window's estimate is the least of its minimiser's cells, never below its true count of documents.
Second pass: only windows estimated in two documents or more are grouped, exactly, by 96-bit hashes; each
word covered by a window that also starts in a document with a smaller id goes. A window that repeats is never
lost, whatever the sketch's size; a crowded sketch only lets more windows through to the second pass.

Cases: null text has no words; texts shorter than a window keep all; very long texts are judged whole;
rows with equal ids are one document's and never remove each other; rows with a null id keep all words and
remove none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, entering, stored

DEPTH = 2


def _hashes(text: str, size: int):
    """Per window of a text: 64 and 32 bits of hash, and the minimiser's hash."""
    import numpy as np

    from .sketch import _SEQUENCE, mixed, window_hashes, word_bounds, word_hashes

    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    starts, ends = word_bounds(raw)
    if len(starts) < size:
        return None
    words = word_hashes(raw, starts, ends)
    half = max(1, size // 2)
    runs = mixed(window_hashes(words, half) ^ np.uint64(0x5BD1E995))
    width, least, have = size - half + 1, runs, 1
    while 2 * have <= width:  # sliding minimum by doubling
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    return window_hashes(words, size), (window_hashes(mixed(words + np.uint64(1)), size) >> np.uint64(32)).astype(np.uint32), least


def _cells(values, log_width: int, row: int):
    import numpy as np

    return (values * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[row]) >> np.uint64(64 - log_width)).astype(np.int64)


def repeated_cells(rows: DataFrame, size: int, log_width: int) -> list[bytes]:
    """For each row of the merged sketch, a bitmap of the cells that count two documents or more."""

    def sketch(batches):
        import numpy as np
        import pyarrow as pa

        entering(__name__)

        held, have = [], 0

        def flush():
            values = np.concatenate(held)
            for r in range(DEPTH):
                cells, n = np.unique(_cells(values, log_width, r), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells + (r << log_width), pa.int64()), pa.array(np.minimum(n, 2).astype(np.int32))], ["cell", "n"])

        for b in batches:
            for text in b.column("text").to_pylist():
                if (found := _hashes(text, size)) is not None:
                    own = np.unique(found[2])
                    held.append(own)
                    have += len(own)
            if have > 1_000_000:
                yield from flush()
                held, have = [], 0
        if held:
            yield from flush()

    # Merged by adding cells; then as bitmaps, a chunk of 2**16 cells to a row, of which there are as many as
    # the sketch's width allows, however large the input.
    merged = rows.mapInArrow(sketch, "cell long, n int").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")
    chunks = merged.groupBy(F.shiftright("cell", 16).alias("chunk")).agg(F.collect_list(F.col("cell").bitwiseAND(F.lit(0xFFFF)).cast("int")).alias("cells"))

    def bitmap(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            maps = []
            for cells in b.column("cells"):
                bits = np.zeros(1 << 16, dtype=bool)
                bits[cells.values.to_numpy()] = True
                maps.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("chunk"), pa.array(maps, pa.binary())], ["chunk", "bits"])

    out = [bytearray(1 << log_width >> 3) for _ in range(DEPTH)]
    for chunk, bits in chunks.mapInArrow(bitmap, "chunk long, bits binary").toLocalIterator():
        row, at = chunk >> (log_width - 16), chunk & ((1 << (log_width - 16)) - 1)
        out[row][at << 13 : (at + 1) << 13] = bits
    return [bytes(x) for x in out]


def repeated_windows(rows: DataFrame, size: int, log_width: int) -> DataFrame:
    """rows (doc_id, tag, text) -> (doc_id, tag, starts): the windows that also start in a document with a
    smaller id. A row's list is as long as its text at most."""
    bitmaps = rows.sparkSession.sparkContext.broadcast([zlib.compress(x, 1) for x in repeated_cells(rows.select("text"), size, log_width)])

    def windows(batches):
        import numpy as np
        import pyarrow as pa

        entering(__name__)

        maps = [np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in bitmaps.value]
        for b in batches:
            out = []
            for doc_id, tag, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tag", "text")), strict=True):
                if (found := _hashes(text, size)) is None:
                    continue
                maybe = np.ones(len(found[0]), dtype=bool)
                for r in range(DEPTH):
                    cells = _cells(found[2], log_width, r)
                    maybe &= (maps[r][cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)
                at = np.flatnonzero(maybe)
                if n := len(at):
                    out.append((found[0][at].view(np.int64), found[1][at].view(np.int32), np.full(n, doc_id), np.full(n, tag, dtype=np.int32), at.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["h1", "h2", "doc_id", "tag", "start"])

    maybe = stored(rows.mapInArrow(windows, "h1 long, h2 int, doc_id long, tag int, start int"))
    # Partial sums first, so a window that a third of all documents have costs each task one row; written, so
    # that the join's sides are dealt anew and a hot window's occurrences can be split.
    first = stored(maybe.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"))
    later = maybe.join(first, ["h1", "h2"]).where("doc_id > least")
    return later.groupBy("doc_id", "tag").agg(F.collect_list("start").alias("starts"))


def dedup_substrings(df: DataFrame, size: int = 50, log_width: int = 26, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept for each row of df, and a struct ``carried`` of the columns in carry.
    kept is the text without the removed words and the white space after each; with digest, the sha256 of the
    kept words joined by single spaces. A text that loses nothing stays as it is (null stays null)."""
    rows = df.select(F.struct(*[F.col(c) for c in carry or []] or [F.lit(0).alias("none")]).alias("carried"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("tag", F.hash("text"))  # tells texts of equal ids apart
    starts = repeated_windows(rows.where("doc_id is not null and text is not null").select("doc_id", "tag", "text"), size, log_width)
    kind = rows.schema["carried"].dataType.simpleString()

    def squeeze(batches):  # texts cross the network compressed
        import pyarrow as pa
        import zstandard

        small = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            texts = [None if x is None else small(x.encode()) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("carried"), b.column("doc_id"), b.column("tag"), pa.array(texts, pa.binary())], ["carried", "doc_id", "tag", "text"])

    packed = rows.select("carried", "doc_id", "tag", "text").mapInArrow(squeeze, f"carried {kind}, doc_id long, tag int, text binary")
    joined = packed.join(starts, ["doc_id", "tag"], "left").select("doc_id", "text", "starts", "carried")

    def apply(batches):
        import numpy as np
        import pyarrow as pa

        entering(__name__)
        import zstandard

        from .sketch import word_bounds

        plain = zstandard.ZstdDecompressor().decompress
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for squeezed, at in zip(b.column("text").to_pylist(), b.column("starts"), strict=True):
                raw = b"" if squeezed is None else plain(squeezed)
                if not at.is_valid and not digest:
                    n_words.append(len(raw.split()))
                    n_removed.append(0)
                    kept.append(None if squeezed is None else raw.decode())
                    continue
                words, gone = raw.split(), None
                if at.is_valid:
                    step = np.zeros(len(words) + size + 1, dtype=np.int64)
                    starts_here = np.unique(at.values.to_numpy())
                    np.add.at(step, starts_here, 1)
                    np.add.at(step, starts_here + size, -1)
                    gone = np.cumsum(step)[: len(words)] > 0
                n_words.append(len(words))
                n_removed.append(0 if gone is None else int(gone.sum()))
                if digest:
                    if gone is not None:
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
                else:
                    begin = word_bounds(np.frombuffer(raw, dtype=np.uint8))[0]
                    until = np.append(begin[1:], len(raw))
                    head = raw[: begin[0]]
                    kept.append((head + b"".join([raw[a:z] for a, z, g in zip(begin.tolist(), until.tolist(), gone.tolist(), strict=True) if not g])).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), b.column("carried")], ["doc_id", "n_words", "n_removed", "kept", "carried"])

    return joined.mapInArrow(apply, f"doc_id long, n_words long, n_removed long, kept string, carried {kind}")


def op3_countmin_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir), digest=True).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


#: SQL for op3: every window of 50 words as text, its least document, and the words that a window covers.
OP3_SQL = r"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
p as (select doc_id, len(w) n, unnest(w) word, generate_subscripts(w, 1) i from d),
s as (select doc_id, i, word, case when i + 49 <= n then string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 49 following) end win from p),
f as (select win, min(doc_id) first_doc from s where win is not null group by 1),
c as (select s.doc_id, i, word, max(case when first_doc < s.doc_id then i end) over (partition by s.doc_id order by i rows between 49 preceding and current row) is not null gone from s left join f using (win)),
k as (select doc_id, count(*) n_words, count(*) filter (where gone) n_removed, string_agg(word, ' ' order by i) filter (where not gone) kept from c group by 1)
select d.doc_id, coalesce(n_words, 0) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join k using (doc_id)
"""
