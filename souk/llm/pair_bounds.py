"""Ranked lexical search by MaxScore with bounds of term pairs (operator 12).

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case, held as they are.
All arithmetic is in whole numbers: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its impact in a document
10**9 tf div (1000 tf + 8 m), where m is 10 + 90 n N div L; N, L and df are taken over all documents.

The task that reads documents builds shards of bounded numbers of documents and postings: inverted lists in document
order, one row for each shard. A query's terms form a chain by descending weight. For the neighbours in the chains of
a log of queries (the most frequent ``MOST_PAIRS``; by default the queries themselves are the log) each shard then
stores the intersection of the two lists and the highest joint impact there. Of a pair a document has both terms (at
most the joint maximum) or one (at most its own maximum), so the pair's bound is the largest of the three, less than
the sum of the two maxima. The bound of the end of a chain is the least sum over all ways to part it into single terms
and such pairs, found by one pass from its end.

For a query, the documents of its best pairs give a first threshold, the k-th best score. The longest end of the
chain whose bound is below the threshold is not read: only documents in the lists before it can still enter, and they
go on to the next list of that end only while their score and the bound of what is left reach the threshold. A
threshold found in one shard holds in the task's next shards. Each task's top k are merged, so the result is exact.

Queries meet shards in blocks: chunks of queries, in groups of about ``GROUP_BYTES``, are broadcast one group at a
time; neither queries nor postings pass through the driver.

Cases: null or empty texts have no terms; a query without known terms has no result; scores of 0 are no results;
equal scores go by ascending doc_id, null ids last; repeated rows are documents (or queries) of their own; an empty
table gives an empty result; very long texts are indexed whole; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, entering, stored

SHARD_ROWS, SHARD_POSTINGS = 32768, 4_000_000
#: Queries and terms of a chunk (of one query there may be more); bytes of a broadcast group of chunks; pairs kept.
CHUNK_QUERIES, CHUNK_TERMS, GROUP_BYTES, MOST_PAIRS = 512, 32768, 32_000_000, 50_000
#: Documents scored ahead of the lists for a first threshold.
AHEAD = 200

_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_KEPT).split()


def _raw(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias(name), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))


class Builder:
    """A shard in the making."""

    def __init__(self):
        self.ids, self.lengths, self.places, self.found, self.often, self.postings = [], [], {}, [], [], 0

    def add(self, doc_id, raw: bytes) -> None:
        import numpy as np

        words, places = terms_of(raw), self.places
        own = np.fromiter((places.setdefault(w, len(places)) for w in words), np.int32, len(words))
        kinds, n = np.unique(own, return_counts=True)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.found.append(kinds)
        self.often.append(n.astype(np.int32))
        self.postings += len(kinds)

    def row(self) -> dict:
        import numpy as np
        import zstandard

        names = sorted(self.places)
        rank = np.empty(len(names), np.int32)
        rank[np.fromiter((self.places[x] for x in names), np.int64, len(names))] = np.arange(len(names), dtype=np.int32)
        doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), [len(x) for x in self.found])
        term = rank[np.concatenate(self.found)] if self.postings else np.zeros(0, np.int32)
        order = np.argsort(term, kind="stable")
        stops = np.cumsum(np.bincount(term, minlength=len(names)))
        doc, tf = doc[order], (np.concatenate(self.often)[order] if self.postings else np.zeros(0, np.int32))
        steps = np.diff(doc, prepend=np.int32(0))  # of a list; its first is whole
        firsts = np.r_[0, stops[:-1]].astype(np.int64)[: len(names)]
        steps[firsts] = doc[firsts]
        lengths, text = np.array(self.lengths, np.int64), b"\n".join(names)
        nulls = np.array([i is None for i in self.ids], np.int64)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        head = np.array([len(ids), len(names), len(doc), len(text)], np.int64)
        blob = b"".join(x.tobytes() for x in (head, ids, nulls, lengths, stops.astype(np.int64), steps, tf)) + text
        return {"docs": int((lengths > 0).sum()), "words": int(lengths.sum()), "blob": zstandard.ZstdCompressor(level=3).compress(blob)}


def shards(rows: DataFrame, most_rows: int = SHARD_ROWS, most_postings: int = SHARD_POSTINGS) -> DataFrame:
    """rows (doc_id, raw) -> docs (with a term), words and ``blob`` of each shard, which ends at so many rows or
    with the document that reaches so many postings."""

    def run(batches):
        import pyarrow as pa

        entering(__name__)
        schema = pa.schema([("docs", pa.int64()), ("words", pa.int64()), ("blob", pa.binary())])
        made = Builder()
        for b in batches:
            for i, raw in zip(b.column("doc_id").to_pylist(), b.column("raw"), strict=True):
                made.add(i, raw.as_py())
                if len(made.ids) >= most_rows or made.postings >= most_postings:
                    yield pa.RecordBatch.from_pylist([made.row()], schema)
                    made = Builder()
        if made.ids:
            yield pa.RecordBatch.from_pylist([made.row()], schema)

    return rows.mapInArrow(run, "docs long, words long, blob binary").withColumn("shard", F.monotonically_increasing_id())


class Shard:
    """A shard as Builder writes it; with N and L it gives impacts."""

    def __init__(self, blob: bytes, n: int = 1, words: int = 1):
        import numpy as np
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(blob)
        docs, terms, postings, size = np.frombuffer(raw, np.int64, 4).tolist()
        self.ids, self.nulls, self.lengths = np.frombuffer(raw, np.int64, 3 * docs, 32).reshape(3, docs)
        at = 32 + 24 * docs
        self.stops = np.frombuffer(raw, np.int64, terms, at)
        self.steps, self.tf = np.frombuffer(raw, np.int32, 2 * postings, at + 8 * terms).reshape(2, postings)
        self.names = raw[len(raw) - size :].split(b"\n") if terms else []
        self.m8 = 8 * (10 + 90 * self.lengths * n // words)
        self.held = {}

    def place(self, term: bytes) -> int:
        """The term's place in this shard, or -1."""
        i = bisect.bisect_left(self.names, term)
        return i if i < len(self.names) and self.names[i] == term else -1

    def list(self, i: int):
        """(documents, impacts, the highest) of the term at place i."""
        found = self.held.get(i)
        if found is None:
            a, z = int(self.stops[i - 1]) if i else 0, int(self.stops[i])
            docs, tf = self.steps[a:z].cumsum(dtype="i4"), self.tf[a:z].astype("i8")
            impact = 1_000_000_000 * tf // (1000 * tf + self.m8[docs])
            found = self.held[i] = docs, impact, int(impact.max())
        return found

    def common(self, i: int, j: int):
        """(documents that hold both terms, the impacts of each there)."""
        a, b = self.list(i), self.list(j)
        if len(a[0]) > len(b[0]):
            docs, y, x = self.common(j, i)
            return docs, x, y
        at = b[0].searchsorted(a[0])
        at[at == len(b[0])] = 0
        both = b[0][at] == a[0]
        return a[0][both], a[1][both], b[1][at[both]]


def pair_lists(shard: Shard, pairs: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """The stored intersections: places of both terms, the highest joint impact, documents, list by list."""
    import numpy as np
    import zstandard

    heads, lists, place = [], [], {}
    for a, b, v, w in pairs:
        i, j = (place[x] if x in place else place.setdefault(x, shard.place(x)) for x in (a, b))
        if i >= 0 and j >= 0:
            docs, x, y = shard.common(i, j)
            heads.append((i, j, int((v * x + w * y).max()) if len(docs) else 0, len(docs)))
            lists.append(np.diff(docs, prepend=np.int32(0)).astype(np.int32))
    head = np.array(heads, np.int64).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=3).compress(b"".join([len(head).to_bytes(8, "little"), head.tobytes(), *(x.tobytes() for x in lists)]))


class Pairs:
    def __init__(self, blob: bytes):
        import numpy as np
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int.from_bytes(raw[:8], "little")
        head = np.frombuffer(raw, np.int64, 4 * n, 8).reshape(n, 4)
        self.steps = np.frombuffer(raw, np.int32, -1, 8 + 32 * n)
        stops = head[:, 3].cumsum()
        #: (place, place) -> (joint maximum, where its list begins and ends)
        self.of = {(i, j): (joint, z - k, z) for (i, j, joint, k), z in zip(head.tolist(), stops.tolist(), strict=True)}

    def docs(self, a: int, z: int):
        return self.steps[a:z].cumsum(dtype="i4")


def chain_bounds(most: list[int], joint: list[int | None]) -> list[int]:
    """The least bound of each end of a chain: of terms i and on, parted into single terms (most[i]) and pairs of
    neighbours (joint[i] for i and i + 1, None where no pair is stored)."""
    out = [0] * (len(most) + 2)
    for i in range(len(most) - 1, -1, -1):
        out[i] = most[i] + out[i + 1]
        if i + 1 < len(most) and joint[i] is not None:
            out[i] = min(out[i], max(joint[i], most[i], most[i + 1]) + out[i + 2])
    return out[:-1]


def best_of(shard: Shard, pairs: Pairs, places: list[int], weights: list[int], k: int, floor: int = 0):
    """(places of documents, scores): those of the k best of the shard with scores of at least floor, and maybe
    more; places and weights of the query's terms in chain order."""
    import numpy as np

    chain = [(i, w) for i, w in zip(places, weights, strict=True) if i >= 0]
    most = [w * shard.list(i)[2] for i, w in chain]
    stored_ = [pairs.of.get((a[0], b[0])) for a, b in zip(chain, chain[1:], strict=False)]
    bounds = chain_bounds(most, [None if p is None else p[0] for p in stored_])
    floor = max(floor, 1)
    if bounds[0] < floor:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(docs, scores, i, w):
        own, impact, _ = shard.list(i)
        at = own.searchsorted(docs)
        at[at == len(own)] = 0
        return scores + np.where(own[at] == docs, w * impact[at], 0)

    # A first threshold from the documents of the pairs of the highest joint impact.
    ahead, some = [], 0
    for joint, a, z in sorted((p for p in stored_ if p and p[0] and p[2] > p[1]), reverse=True):
        if some >= AHEAD:
            break
        ahead.append(pairs.docs(a, z)[: 4 * AHEAD])
        some += len(ahead[-1])
    if some >= k:
        docs = np.unique(np.concatenate(ahead))
        scores = np.zeros(len(docs), np.int64)
        for i, w in chain:
            scores = add(docs, scores, i, w)
        if len(docs) >= k:
            floor = max(floor, int(np.partition(scores, -k)[-k]))
    end = next(i for i, x in enumerate(bounds) if x < floor)
    total = np.zeros(len(shard.ids), np.int64)
    for i, w in chain[:end]:
        docs, impact, _ = shard.list(i)
        total[docs] += w * impact
    docs = np.flatnonzero(total + bounds[end] >= floor)
    scores = total[docs]
    for at in range(end, len(chain)):
        if len(docs) >= k:
            floor = max(floor, int(np.partition(scores, -k)[-k]))
        alive = scores + bounds[at] >= floor
        docs, scores = docs[alive], scores[alive]
        if not len(docs):
            break
        scores = add(docs, scores, *chain[at])
    alive = scores >= floor
    return docs[alive], scores[alive]


def frequencies(index: DataFrame) -> DataFrame:
    """(term, df) of each shard."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for blob in b.column("blob"):
                s = Shard(blob.as_py())
                df = np.diff(s.stops, prepend=0)
                for a in range(0, len(s.names), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(s.names[a : a + 50_000], pa.binary()), pa.array(df[a : a + 50_000])], ["term", "df"])

    return index.select("blob").mapInArrow(run, "term binary, df long")


def asked_terms(queries: DataFrame) -> DataFrame:
    """(q, item_id, raw) -> (q, item_id, term), each term once."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [sorted(set(terms_of(x.as_py()))) for x in b.column("raw")]
            at = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("q").take(at), b.column("item_id").take(at), pa.array([t for x in found for t in x], pa.binary())], ["q", "item_id", "term"])

    return queries.mapInArrow(run, "q long, item_id long, term binary")


CHUNK_SCHEMA = "qs array<long>, item_ids array<long>, ends array<long>, terms array<binary>, weights array<long>"


def chunks(known: DataFrame, n: int, most_queries: int = CHUNK_QUERIES, most_terms: int = CHUNK_TERMS) -> DataFrame:
    """known (q, item_id, found array<(df, term)>) -> rows of CHUNK_SCHEMA; terms of weight 0 are left out."""

    def run(batches):
        import pyarrow as pa

        kind = pa.schema([("qs", pa.list_(pa.int64())), ("item_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("weights", pa.list_(pa.int64()))])
        held = {x: [] for x in kind.names}
        for b in batches:
            for q, item, found in zip(b.column("q").to_pylist(), b.column("item_id").to_pylist(), b.column("found"), strict=True):
                weighed = sorted((-math.floor(1000 * math.log((2 * n + 2) / (2 * x["df"] + 1))), x["term"]) for x in found.as_py())
                weighed = [x for x in weighed if x[0]]
                if not weighed:
                    continue
                held["terms"] += [t for _, t in weighed]
                held["weights"] += [-w for w, _ in weighed]
                held["qs"].append(q)
                held["item_ids"].append(item)
                held["ends"].append(len(held["terms"]))
                if len(held["qs"]) >= most_queries or len(held["terms"]) >= most_terms:
                    yield pa.RecordBatch.from_pylist([held], kind)
                    held = {x: [] for x in kind.names}
        if held["qs"]:
            yield pa.RecordBatch.from_pylist([held], kind)

    return known.mapInArrow(run, CHUNK_SCHEMA)


def chain_pairs(asked: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """Chunks -> one row of arrays a, b (terms), v, w (their weights): the neighbours in chains, the most frequent
    ``most`` of them."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for c in b.to_pylist():
                t, w, ends = c["terms"], c["weights"], set(c["ends"])
                at = [i for i in range(1, len(t)) if i not in ends]
                yield pa.RecordBatch.from_arrays([pa.array([t[i - 1] for i in at], pa.binary()), pa.array([t[i] for i in at], pa.binary()), pa.array([w[i - 1] for i in at], pa.int64()), pa.array([w[i] for i in at], pa.int64())], ["a", "b", "v", "w"])

    found = asked.mapInArrow(run, "a binary, b binary, v long, w long").groupBy("a", "b", "v", "w").count()
    kept = found.orderBy(F.col("count").desc(), "a", "b").limit(most)
    return kept.agg(F.collect_list(F.struct("a", "b", "v", "w")).alias("p")).select("p.a", "p.b", "p.v", "p.w")


def with_pairs(index: DataFrame, pairs: DataFrame, n: int, words: int) -> DataFrame:
    """Each shard's row with its pair lists; pairs is one row of bounded size."""

    def run(batches):
        import pyarrow as pa

        entering(__name__)
        for batch in batches:
            for c in range(batch.num_rows):
                row = batch.slice(c, 1).to_pylist()[0]
                made = pair_lists(Shard(row["blob"], n, words), list(zip(row["a"], row["b"], row["v"], row["w"], strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int64()), pa.array([row["blob"]], pa.binary()), pa.array([made], pa.binary())], ["shard", "blob", "pairs"])

    # One row beside each shard: no rows are multiplied.
    return index.select("shard", "blob").crossJoin(F.broadcast(pairs)).mapInArrow(run, "shard long, blob binary, pairs binary")


def scored(index: DataFrame, asked: DataFrame, n: int, words: int, k: int) -> DataFrame:
    """(q, item_id, doc_id, score) of each task's k best; asked: chunks of a bounded total size."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        entering(__name__)
        best, items, shard, lists, own, place = {}, {}, None, None, None, {}
        for batch in batches:
            for c in range(batch.num_rows):
                row = batch.slice(c, 1)
                if row.column("shard")[0].as_py() != own:
                    own, place = row.column("shard")[0].as_py(), {}
                    shard, lists = Shard(row.column("blob")[0].as_py(), n, words), Pairs(row.column("pairs")[0].as_py())
                qs, item_ids, ends, terms, weights = (row.column(x)[0].as_py() for x in ("qs", "item_ids", "ends", "terms", "weights"))
                start = 0
                for q, item, end in zip(qs, item_ids, ends, strict=True):
                    for t in terms[start:end]:
                        if t not in place:
                            place[t] = shard.place(t)
                    before = best.get(q)
                    at, scores = best_of(shard, lists, [place[t] for t in terms[start:end]], weights[start:end], k, int(before[2][-1]) if before and len(before[2]) == k else 0)
                    start = end
                    if not len(at):
                        continue
                    ids, nulls = shard.ids[at], shard.nulls[at]
                    if before:
                        ids, nulls, scores = (np.concatenate(x) for x in zip(before, (ids, nulls, scores), strict=True))
                    order = np.lexsort((ids, nulls, -scores))[:k]
                    best[q], items[q] = (ids[order], nulls[order], scores[order]), item
        for some in (list(best)[i : i + 1000] for i in range(0, len(best), 1000)):
            counts = [len(best[q][0]) for q in some]
            ids, nulls, scores = (np.concatenate([best[q][x] for q in some]) for x in range(3))
            at = pa.array(np.repeat(np.arange(len(some)), counts))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()).take(at), pa.array([items[q] for q in some], pa.int64()).take(at), pa.array(ids, mask=nulls.astype(bool)), pa.array(scores)], ["q", "item_id", "doc_id", "score"])

    # The stated queries against all shards, a broadcast group of chunks at a time.
    return index.crossJoin(F.broadcast(asked)).mapInArrow(run, "q long, item_id long, doc_id long, score long")


def ranked(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_rows: int = SHARD_ROWS, shard_postings: int = SHARD_POSTINGS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """The k best documents of df for each row of queries: item_id, rank, doc_id, score."""
    spark = df.sparkSession
    none = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    index = stored(shards(_raw(df, id_col, text_col, "doc_id"), shard_rows, shard_postings), "none")
    n, words = index.agg(F.sum("docs"), F.sum("words")).first()
    if not n:
        return none
    numbered = _raw(queries, item_col, item_text_col, "item_id").withColumn("q", F.monotonically_increasing_id())
    asked = stored(asked_terms(numbered.select("q", "item_id", "raw")))
    df_of = frequencies(index).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    known = asked.join(df_of, "term").groupBy("q", "item_id").agg(F.collect_list(F.struct("df", "term")).alias("found"))  # terms of one query
    asked = stored(chunks(known, n, chunk_queries))
    size = asked.agg(F.sum(F.size("terms") * 24 + F.size("qs") * 24 + F.aggregate("terms", F.lit(0).cast("long"), lambda x, t: x + F.length(t)))).first()[0]
    if not size:
        return none
    index = stored(with_pairs(index, chain_pairs(asked), n, words), "none")
    groups = -(-size // GROUP_BYTES)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))  # k of each task
    out = None
    for g in range(groups):
        own = asked.where(F.pmod(F.xxhash64(F.col("qs")[0]), F.lit(groups)) == g)
        top = stored(scored(index, own, n, words, k).withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
        out = top if out is None else out.unionByName(top)
    return out


def op12_pair_bound_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: SQL for op12: every score of every item, ranked.
OP12_SQL = r"""
with a as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') t from documents),
g as (select count(*) n, sum(len(t))::bigint l from a where len(t) > 0),
tf as (select rid, term, count(*) tf from (select rid, unnest(t) term from a) group by 1, 2),
w as (select term, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::bigint w from tf, g group by term, n),
q as (select distinct qid, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term
      from (select row_number() over () qid, * from benchmark)),
s as (select qid, item_id, doc_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(t) * n) // l))))::bigint score
      from q join w using (term) join tf using (term) join a using (rid), g group by 1, 2, 3, 4),
r as (select item_id, cast(row_number() over (partition by qid order by score desc, doc_id nulls last) as int) "rank", doc_id, score from s where score > 0)
select * from r where "rank" <= 10
"""
