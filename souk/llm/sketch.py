"""Threshold-scaled sketches: every shingle hash below a fixed fraction is kept (operator 8).

A text's sketch is the sorted set of those 64-bit hashes of its five-word shingles (fewer words: the whole
sequence; none: an empty sketch) that lie below ``fraction`` of the hash range. The choice depends on the hash
alone, so sketches of parts merge by union and a short text's sketch can be held against a long one's:
containment of A in B is estimated as common / size of A.

Where no hash lies below the fraction, the least one is kept in its place, so only a text without words has an empty
sketch. Such a least hash is dropped when sketches are merged and others lie below the fraction. Sketches are compared
as sets: the likeness of two is the share of the smaller that the larger has, 0 if they share nothing.

Cases: null text counts as empty; equal texts have equal sketches; only a text without words has an empty sketch;
two empty sketches have likeness 1, an empty and another 0; very long texts are hashed whole; a table of one row follows on itself; an empty table gives an
empty result; rows with equal ids follow each other in an order that their lengths and texts decide; rows with
a null id come last; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text

WORDS, FRACTION = 5, 0.25
_M = np.uint64(0x9E3779B97F4A7C15)
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (constants of the splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, made longer when needed."""

    def __init__(self, m: int):
        self.m = m
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, x % 2**64, dtype=np.uint64))]) for x in (self.m, pow(self.m, -1, 2**64)))
        return self.up, self.down


_BYTES, _SEQUENCE = Powers(0x5851F42D4C957F2D), Powers(0x2545F4914F6CDD1D)


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of other bytes than ASCII white space) of UTF-8 bytes."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACES[raw]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers = _BYTES) -> np.ndarray:
    """A 64-bit hash of each word, from one prefix sum over the bytes."""
    up, down = powers.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int, powers: Powers = _SEQUENCE) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words; fewer words: none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers.upto(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mixed((sums[size:] - sums[:n]) * down[:n])


def sketch(text: str, size: int = WORDS, fraction: float = FRACTION) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    starts, ends = word_bounds(raw)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    hashes = window_hashes(word_hashes(raw, starts, ends), min(size, len(starts)))
    kept = np.unique(below(hashes, fraction))
    return kept if len(kept) else hashes.min(keepdims=True)


def merged(parts: list[np.ndarray], fraction: float = FRACTION) -> np.ndarray:
    """The sketch of all shingles of several texts, from their sketches."""
    every = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))
    kept = below(every, fraction)
    return kept if len(kept) else every[:1]


def below(hashes: np.ndarray, fraction: float) -> np.ndarray:
    return hashes if fraction >= 1 else hashes[hashes < np.uint64(int(fraction * 2**64))]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment of the smaller in the larger."""
    return containment(a, b) if len(a) <= len(b) else containment(b, a)


def written(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def read_back(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), dtype=">u8").astype(np.uint64)


def sketches(df: DataFrame, size: int = WORDS, fraction: float = FRACTION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (the kept hashes as ascending hex of 16 digits each) for each row of df."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([written(sketch(x, size, fraction)) for x in b.column("text").to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def range_edges(df: DataFrame, column: str, rows_each: int, most: int = 50_000) -> list[int]:
    """At most ``most`` values that part df into ranges of about ``rows_each`` rows, by an approximate
    percentile whose size is bounded too."""
    n = min(most, df.count() // rows_each)
    if n < 1:
        return []
    found = df.select(F.percentile_approx(column, [i / (n + 1) for i in range(1, n + 1)], max(10_000, 10 * n))).first()[0]
    return sorted(set(found or []))


def bucket_of(column: str, edges: list[int]):
    """How many of the ascending edges lie below the column: a binary search in one expression."""
    if not edges:
        return F.lit(0)
    array, steps = "array(" + ",".join(f"{e}L" for e in edges) + ")", len(edges).bit_length() + 1
    step = f"if(s.lo >= s.hi, s, if(element_at({array}, (s.lo + s.hi) div 2 + 1) < {column}, struct(cast((s.lo + s.hi) div 2 + 1 as int) as lo, s.hi as hi), struct(s.lo as lo, cast((s.lo + s.hi) div 2 as int) as hi)))"
    step = step.replace("(s.lo + s.hi) div 2 + 1)", "cast((s.lo + s.hi) div 2 + 1 as int))", 1)
    return F.expr(f"aggregate(sequence(1, {steps}), struct(0 as lo, {len(edges)} as hi), (s, i) -> {step}, s -> s.lo)")


def edited_sketches(df: DataFrame, size: int = WORDS, fraction: float = FRACTION, id_col: str = "doc_id", text_col: str = "text", rows_a_bucket: int = 1000) -> DataFrame:
    """Each text's sketch beside that of its edited text (its last half replaced by the start of the text that
    follows by descending id; after the last: the first) and of the text that follows.

    Rows are dealt once to buckets of id ranges and sorted there. The first row of each bucket also goes, as a
    copy, to the end of the bucket before it, so neighbours meet without any task seeing more than its share."""
    rows = id_text(df, id_col, text_col)
    edges = range_edges(rows.select("doc_id"), "doc_id", rows_a_bucket)
    keyed = rows.select("doc_id", "text", F.length("text").alias("n"), F.xxhash64("text").alias("h"), F.when(F.col("doc_id").isNull(), -1).otherwise(bucket_of("doc_id", edges)).alias("bucket"))
    # One row for each bucket, so as few as there are edges.
    heads = keyed.groupBy("bucket").agg(F.min(F.struct((-F.col("doc_id")).alias("d"), "n", "h")).alias("head")).collect()
    heads = sorted(((r["bucket"], *r["head"]) for r in heads), reverse=True)
    before = [(b, d, n, h, heads[i - 1][0]) for i, (b, d, n, h) in enumerate(heads)]
    firsts = df.sparkSession.createDataFrame(before, "at int, d long, fn int, fh long, goes_to int")
    is_head = (F.col("bucket") == F.col("at")) & (-F.col("doc_id")).eqNullSafe(F.col("d")) & (F.col("n") == F.col("fn")) & (F.col("h") == F.col("fh"))
    none, copy = F.lit(None).cast("int"), F.array(F.lit(None).cast("int"), F.col("goes_to"))
    dealt = keyed.join(F.broadcast(firsts), is_head, "left").withColumn("to", F.explode(F.when(F.col("goes_to").isNull(), F.array(none)).otherwise(copy)))
    dealt = dealt.select(F.coalesce("to", "bucket").alias("bucket"), F.col("to").isNotNull().alias("copy"), "doc_id", "n", "h", "text")
    # Equal first rows make equal copies, of which any serves.
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "copy", F.col("doc_id").desc(), "n", "h").select("bucket", "copy", "doc_id", "text")

    def run(batches):
        import pyarrow as pa

        held = None

        def row(following, its_sketch):
            doc_id, text, own = held[1:]
            cut_at = len(text) - len(text) // 2
            edited = text[:cut_at] + following[: len(text) - cut_at]
            of_edited = sketch(edited, size, fraction)
            return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(of_edited), likeness(own, of_edited), likeness(own, its_sketch)

        for b in batches:
            out = []
            for bucket, is_copy, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "copy", "doc_id", "text")), strict=True):
                own = sketch(text, size, fraction)
                if held is not None and held[0] == bucket:
                    out.append(row(text, own))
                held = None if is_copy else (bucket, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8_threshold_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_sketches(documents(spark, sf_dir))
