"""Quality classifier: ordinal cumulative-link regression on hashed text (operator 9).

A document's grade is ordered: here 0 for low quality, 1 for good but toxic, 2 for good. One weight vector over
hashed features is shared by all grades, P(grade >= k) = sigmoid(w.x - t_k) with ordered thresholds t_1 < t_2,
so the model gives an expected grade and tail probabilities for selection. Features are the presence of each
lower-cased word and of its first letters, and the shares of word shapes (what punctuation or digits surround the letters, all capitals).

The weights are fitted on at most ``most_rows`` labelled documents (those of least hashed id, so any size of
table gives the same kind of sample), in one task; only the weights reach the driver. Scoring covers every whole
text in one pass without a shuffle.

Cases: null text counts as empty; an empty text is scored by the thresholds alone; labels of one id count once,
at the least grade; labels without a quality or a document are ignored, a null toxicity is none; without any
usable label every document gets a null score and is kept; repeated rows and null keys give one result each; an
empty table an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import string
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, documents, id_text

LOG_FEATURES, MOST_ROWS = 18, 4000
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
_SHAPE_ROOM = 1 << 10  # the last features are shapes
_NONE = (1 << LOG_FEATURES) - 1


_shapes = Memo(lambda shape: crc32(shape.encode()) % _SHAPE_ROOM, most=20_000)


def _chunk(chunk: str) -> int:
    """Features of a run of other characters than white space, in one number of 64 bits: its word, the word's first
    five and four letters (18 bits each, all set: none) and its shape (10 bits)."""
    size = (1 << LOG_FEATURES) - _SHAPE_ROOM
    word = chunk.strip(string.punctuation)
    if word.isalpha():  # most chunks
        around = "a" if word == chunk else chunk.replace(word, "a", 1)
    else:
        word = max(_LETTERS.findall(chunk), key=len, default="")
        around = _DIGITS.sub("0", _LETTERS.sub("a", chunk))
    shape = around[:8] + ("^" if len(word) > 1 and word.isupper() else "")
    low = word.lower()
    names = [low, *(f"{low[:k]}-" if len(low) > k else "" for k in (5, 4))]
    packed = _shapes[shape]
    for x in names:
        packed = packed << LOG_FEATURES | (crc32(x.encode()) % size if x else _NONE)
    return packed


_chunks = Memo(_chunk, most=160_000)


def features(text: str):
    """(indices, values) of a text, each index once."""
    import numpy as np

    chunks = text.split()
    if not chunks:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
    found = np.fromiter(map(_chunks.__getitem__, chunks), dtype=np.uint64, count=len(chunks))
    kinds = np.unique(found)
    words = np.unique(np.concatenate([kinds >> np.uint64(i * LOG_FEATURES) & np.uint64(_NONE) for i in range(3)]))
    words = words[words != _NONE]
    shapes, n = np.unique(found >> np.uint64(3 * LOG_FEATURES), return_counts=True)
    shapes = shapes + np.uint64((1 << LOG_FEATURES) - _SHAPE_ROOM)
    return np.concatenate([words, shapes]).astype(np.int32), np.concatenate([np.ones(len(words)), 10.0 * n / len(found)]).astype(np.float32)


class CumulativeLink:
    """w and ordered thresholds, fitted by proximal adaptive gradient steps with an L1 penalty, which leaves
    words without evidence at zero."""

    def __init__(self, weights, thresholds):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, rows: list[tuple], grades, l1: float = 1e-3, l2: float = 1e-5, steps: int = 400, rate: float = 0.1) -> CumulativeLink:
        """rows: (indices, values); grades: ints from 0."""
        import numpy as np

        y = np.asarray(grades)
        top = int(y.max())
        lengths = np.array([len(i) for i, _ in rows])
        idx, val = np.concatenate([i for i, _ in rows]).astype(np.int64), np.concatenate([v for _, v in rows]).astype(np.float64)
        row = np.repeat(np.arange(len(rows)), lengths)
        common = np.bincount(idx, minlength=1 << LOG_FEATURES)[idx] >= 3  # rarer ones get no weight
        idx, val, row = idx[common], val[common], row[common]
        w, seen_w = np.zeros(1 << LOG_FEATURES), np.full(1 << LOG_FEATURES, 1e-8)
        # Thresholds as the first and logs of the gaps, so they stay in order; from the grades' shares at first.
        share = np.clip([(y >= k).mean() for k in range(1, top + 1)], 1e-3, 1 - 1e-3)
        t = -np.log(share / (1 - share))
        for k in range(1, top):
            t[k] = max(t[k], t[k - 1] + 0.05)
        par = np.concatenate([t[:1], np.log(np.diff(t))])
        seen_p = np.full(len(par), 1e-8)
        sig = lambda z: 0.5 * (1 + np.tanh(z / 2))
        at = np.arange(len(y))
        for _ in range(steps):
            t = np.cumsum(np.concatenate([par[:1], np.exp(par[1:])]))
            z = np.bincount(row, weights=w[idx] * val, minlength=len(rows))
            s = sig(z[:, None] - t[None, :])  # P(y >= k), k = 1..top
            full = np.concatenate([np.ones((len(y), 1)), s, np.zeros((len(y), 1))], axis=1)
            p = np.maximum(full[at, y] - full[at, y + 1], 1e-12)
            slope = full * (1 - full)
            up, low = slope[at, y], slope[at, y + 1]
            gz = -(up - low) / p / len(y)
            gt = np.zeros((len(y), top + 2))
            gt[at, y] += up / p / len(y)
            gt[at, y + 1] -= low / p / len(y)
            gt = gt[:, 1:-1].sum(axis=0)
            gw = np.bincount(idx, weights=gz[row] * val, minlength=len(w)) + l2 * w
            seen_w += gw * gw
            step = rate / np.sqrt(seen_w)
            w = w - step * gw
            w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(step, 1e3) * l1, 0)
            gp = np.concatenate([[gt.sum()], [gt[k:].sum() * np.exp(par[k]) for k in range(1, top)]])
            seen_p += gp * gp
            par = par - rate / np.sqrt(seen_p) * gp
        return cls(w, np.cumsum(np.concatenate([par[:1], np.exp(par[1:])])))

    def tails(self, text: str):
        """P(grade >= k) for each k from 1."""
        import numpy as np

        i, v = features(text)
        return 0.5 * (1 + np.tanh((float(self.weights[i] @ v) - self.thresholds) / 2))


def graded(labels: DataFrame) -> DataFrame:
    """labels (doc_id, quality, toxic) -> (doc_id, grade)."""
    usable = labels.where("doc_id is not null and quality is not null")
    grade = F.when(F.col("quality") < 1, 0).when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2)
    return usable.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit(docs: DataFrame, grades: DataFrame, most_rows: int = MOST_ROWS) -> CumulativeLink | None:
    """docs (doc_id, text), grades (doc_id, grade); at most most_rows labels are used."""
    sample = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = id_text(docs).join(F.broadcast(sample), "doc_id")  # at most most_rows labels

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [features(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], ["doc_id", "grade", "i", "v"])

    def fitted(batches):
        import numpy as np
        import pyarrow as pa

        got = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["doc_id"], r["i"]))
        if len({r["grade"] for r in got}) < 2:
            return
        made = CumulativeLink.fit([(np.frombuffer(r["i"], np.int32), np.frombuffer(r["v"], np.float32)) for r in got], [r["grade"] for r in got])
        at = np.flatnonzero(made.weights)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (at, made.weights[at], made.thresholds)], ["at", "weights", "thresholds"])

    import numpy as np

    got = rows.select("doc_id", "text", "grade").mapInArrow(run, "doc_id long, grade int, i binary, v binary")
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)  # repeated ids: still at most most_rows
    found = got.coalesce(1).mapInArrow(fitted, "at binary, weights binary, thresholds binary").first()
    if found is None:
        return None
    weights = np.zeros(1 << LOG_FEATURES)
    weights[np.frombuffer(found["at"], np.int64)] = np.frombuffer(found["weights"])
    return CumulativeLink(weights, np.frombuffer(found["thresholds"]))


def score(df: DataFrame, model: CumulativeLink | None, keep_from: float = 0.5, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, expected_grade, p_top (probability of the highest grade) and keep (p_top >= keep_from) for each
    row of df; with carry, a struct of those columns beside."""
    rows = id_text(df, id_col, text_col) if not carry else df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.struct(*[F.col(c) for c in carry]).alias("carried"))
    if carry and text_col in carry:  # a batch holds each text once
        rows = rows.drop("text")
    at = None if model is None else model.weights.nonzero()[0]  # few: the penalty leaves most at zero
    packed = None if model is None else (at, model.weights[at].astype("f4"), model.thresholds)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = None
        if packed:
            weights = np.zeros(1 << LOG_FEATURES, dtype="f4")
            weights[packed[0]] = packed[1]
            own = CumulativeLink(weights, packed[2])
        for b in batches:
            texts = b.column("carried").field(text_col) if carry and text_col in carry else b.column("text")
            tails = [own.tails(x.as_py() or "") if own else None for x in texts]
            columns = [b.column("doc_id"), pa.array([None if t is None else float(t.sum()) for t in tails], pa.float64()), pa.array([None if t is None else float(t[-1]) for t in tails], pa.float64()), pa.array([t is None or bool(t[-1] >= keep_from) for t in tails], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*columns, *([b.column("carried")] if carry else [])], ["doc_id", "expected_grade", "p_top", "keep", *["carried"] * bool(carry)])

    kind = f", carried {rows.schema['carried'].dataType.simpleString()}" if carry else ""
    return rows.mapInArrow(run, f"doc_id long, expected_grade double, p_top double, keep boolean{kind}")


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(id_text(docs), graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, model)
