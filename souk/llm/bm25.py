"""Exact BM25 top-k search by block-max WAND per shard (operator 7).

Words are lower-cased runs of other characters than ASCII white space. Document frequencies, the number of
documents and their mean length are taken over all documents. The task that reads documents also builds its
shards of bounded size: inverted lists in document order, cut into blocks of documents. The index is written once,
one row for each shard, and never copied. When a shard is loaded the impacts and each list's maximum in each block
follow from the global mean length.

Queries come past the shards in chunks of bounded size. For a query the sum of its lists' maxima in a block bounds
every score there. The cursors go through the blocks in document order: the pivot is the next block whose bound
reaches the threshold, the k-th best score so far, and all postings before it are skipped. The best block is
scored first and a threshold found in one shard holds in the next shards of the task; between batches of blocks, which
grow, the threshold is looked at again. For queries of a few words most blocks are skipped; for whole documents as
queries, as in op7, few.

So whole documents are scored many at a time. Documents and queries lie in an order in which like vocabularies and
lengths meet. For each block that some of the queries can reach, the lists that are frequent in both are multiplied as
matrices of single precision; the postings of the others are read. What comes within rounding of the threshold is
scored again in double precision, and only those scores count.
The tasks' top k are merged, so the result is exact.

Cases: null or empty texts match nothing; a query without known words has no result; ties, of scores rounded to
six places, go to the smaller id; a document matches itself; repeated rows are documents of their own, and each
row of queries is answered by itself, also where ids are repeated; rows with a null id are left out; an empty
table gives an empty result; very long texts are indexed whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, entering, id_text, stored

K1, B = 1.2, 0.75
#: Documents and postings of a shard, documents of a block; queries of a chunk and their terms (of one query there may
#: be more).
SHARD_ROWS, SHARD_POSTINGS, BLOCK, QUERY_ROWS, QUERY_TERMS = 32768, 4_000_000, 2048, 8192, 4_000_000
#: Bytes of a shard's lists that are also held as rows of matrices, the least share of a block's documents that such a list
#: has, the least of them that a query needs to be scored by matrices, how many queries are multiplied at once, how many
#: products cost as much as a posting read by itself, and how many sums of such postings are held at once.
DENSE_BYTES, DENSE_SHARE, DENSE_TERMS, TOGETHER, PRODUCTS, SUMS = 64 << 20, 1 / 16, 4, 256, 280, 1 << 17
#: Groups of like vocabulary, the frequent terms they are told by, and rounds of looking for them.
ALIKE, ALIKE_TERMS, ALIKE_ROUNDS = 8, 256, 4


def counted(text: str):
    """(hashes of a text's words, ascending, how often each occurs)."""
    from collections import Counter

    import numpy as np
    import xxhash

    words = Counter(text.encode().lower().split())
    found, at = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64).view(np.int64), return_inverse=True)
    return found, np.bincount(at, weights=np.fromiter(words.values(), dtype=np.float64), minlength=len(found)).astype(np.int64)


def side_by_side(terms, n, ids):
    """An order of texts (the terms of one after another, and how many each has) in which those of like vocabulary lie
    together: groups by k-means on the most frequent terms, in them the short ones first. Only speed depends on it."""
    import numpy as np

    own, t, df = np.unique(terms, return_inverse=True, return_counts=True)
    often = np.argsort(-df, kind="stable")[:ALIKE_TERMS]
    column = np.full(len(own), -1)
    column[often] = np.arange(len(often))
    t, text = column[t], np.repeat(np.arange(len(n)), n)
    ok = t >= 0
    x = np.zeros((len(n), len(often)), dtype=np.float32)
    x[text[ok], t[ok]] = np.log1p(len(n) / df[often])[t[ok]]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    group, some = np.zeros(len(n), dtype=np.int64), np.flatnonzero(x.any(axis=1))
    if len(some) > ALIKE:
        centres = x[np.random.default_rng(7).choice(some, ALIKE, replace=False)]
        for _ in range(ALIKE_ROUNDS):
            group = np.argmax(x @ centres.T, axis=1)
            centres = np.stack([x[group == g].sum(axis=0) for g in range(ALIKE)])
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        group = np.argmax(x @ centres.T, axis=1)
    return np.lexsort((ids, n, group))


def shards(rows: DataFrame, most_rows: int | None = None, most_postings: int = SHARD_POSTINGS) -> DataFrame:
    """rows (doc_id, text) -> n, words and ``blob`` of each shard: ids and lengths of documents, the terms, where
    each term's postings end, and the postings' places and counts. A shard ends at so many documents (SHARD_ROWS), or
    with the one that reaches so many postings."""
    most_rows = most_rows or SHARD_ROWS

    def packed(ids, terms, tfs):
        import numpy as np
        import zstandard

        n, ids = np.array([len(t) for t in terms]), np.array(ids, dtype=np.int64)
        lengths = np.array([x.sum() for x in tfs], dtype=np.int64)
        term, tf = np.concatenate(terms), np.concatenate(tfs).astype(np.int32)
        order = side_by_side(term, n, ids)
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order))
        doc = np.repeat(place, n)
        by = np.lexsort((doc, term))
        own, stops = np.unique(term, return_counts=True)
        parts = [ids[order], lengths[order], own, np.cumsum(stops), doc[by], tf[by]]
        head = np.array([len(ids), len(own), len(term)], dtype=np.int64)
        return len(ids), int(lengths.sum()), zstandard.ZstdCompressor(level=3).compress(b"".join(x.tobytes() for x in (head, *parts)))

    def run(batches):
        import pyarrow as pa

        entering(__name__)
        ids, terms, tfs, postings = [], [], [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(packed(ids, terms, tfs), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["n", "words", "blob"])  # noqa: E731
        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                t, n = counted(text.as_py())
                ids.append(i)
                terms.append(t)
                tfs.append(n)
                postings += len(t)
                if len(ids) >= most_rows or postings >= most_postings:
                    yield batch()
                    ids, terms, tfs, postings = [], [], [], 0
        if ids:
            yield batch()

    return rows.mapInArrow(run, "n long, words long, blob binary")


class Shard:
    """A shard as shards() writes it."""

    def __init__(self, blob: bytes):
        import numpy as np
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, m, p = np.frombuffer(raw, np.int64, 3).tolist()
        at = 24

        def take(count, kind):
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.lengths, self.terms, self.stops = (take(k, np.int64) for k in (n, n, m, m))
        self.doc, self.tf = take(p, np.int32), take(p, np.int32)

    def ready(self, mean: float) -> Shard:
        """With impacts, which hold everything but the query's weight, and lists' maxima in blocks."""
        import numpy as np

        size, tf = self.lengths[self.doc], self.tf.astype(np.float64)
        self.impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
        self.begins = begins = self.stops - np.diff(self.stops, prepend=0)
        block = self.doc // BLOCK
        fresh = np.r_[True, block[1:] != block[:-1]] if len(block) else np.zeros(0, bool)
        fresh[begins] = True
        self.start = np.flatnonzero(fresh)  # of the runs: a list's postings in a block
        self.stop = np.r_[self.start[1:], len(block)]
        self.block = block[self.start]
        self.most = np.maximum.reduceat(self.impact, self.start) if len(block) else np.zeros(0)
        self.to = np.searchsorted(self.start, self.stops)  # each term's runs
        self.from_ = self.to - np.diff(self.to, prepend=0)
        self.blocks = -(-len(self.doc_ids) // BLOCK)
        # Blocks' longest lists once more as a matrix of each block: lists by places.
        n, long = len(self.doc_ids), self.stop - self.start
        size = np.minimum(n - np.arange(self.blocks) * BLOCK, BLOCK)
        share = long / size[self.block]
        often = np.flatnonzero(share >= DENSE_SHARE)
        often = often[np.argsort(-share[often], kind="stable")]
        often = often[np.cumsum(size[self.block[often]]) <= DENSE_BYTES // 12]
        often = often[np.argsort(self.block[often], kind="stable")]
        term = np.searchsorted(self.to, often, side="right")
        frequent, column = np.unique(term, return_inverse=True)
        self.column = np.full(len(self.terms), -1, dtype=np.int32)
        self.column[frequent] = np.arange(len(frequent))
        self.run_of, self.most_of = np.full((len(frequent), self.blocks), -1, dtype=np.int64), np.zeros((len(frequent), self.blocks), dtype=np.float32)
        all_runs = self._ranges(self.from_[frequent], self.to[frequent])
        at = np.repeat(np.arange(len(frequent)), self.to[frequent] - self.from_[frequent]), self.block[all_runs]
        self.run_of[at], self.most_of[at] = all_runs, self.most[all_runs]
        self.dense = []  # of each block: lists' columns, how long they are, the matrix: by lists, and by places in double precision
        ends = np.searchsorted(self.block[often], np.arange(self.blocks + 1))
        for b in range(self.blocks):
            mine = often[ends[b] : ends[b + 1]]
            posts, matrix = self._ranges(self.start[mine], self.stop[mine]), np.zeros((size[b], len(mine)))
            matrix[self.doc[posts] - b * BLOCK, np.repeat(np.arange(len(mine)), long[mine])] = self.impact[posts]
            self.dense.append((column[ends[b] : ends[b + 1]], long[mine], np.ascontiguousarray(matrix.T, dtype=np.float32), matrix))
        return self

    def find(self, terms):
        """The shard's numbers of those terms, -1 where it has none."""
        import numpy as np

        if not len(self.terms):
            return np.full(len(terms), -1)
        i = np.searchsorted(self.terms, terms)
        i[i == len(self.terms)] = 0
        return np.where(self.terms[i] == terms, i, -1)

    @staticmethod
    def _ranges(a, z):
        import numpy as np

        n = z - a
        return np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())

    def top(self, terms, weights, k: int, floor: float = 0.0):
        """(doc_ids, scores) of the k best with scores, rounded to six places, of at least floor; ties by id."""
        i = self.find(terms)
        return self.best(i[i >= 0], weights[i >= 0], k, floor)

    def best(self, i, w, k: int, floor: float = 0.0):
        """top() for numbers of terms."""
        import numpy as np

        if not len(i):
            return np.zeros(0, np.int64), np.zeros(0)
        runs = self._ranges(self.from_[i], self.to[i])
        run_w = np.repeat(w, self.to[i] - self.from_[i])
        run_block = self.block[runs]
        bound = np.bincount(run_block, weights=self.most[runs] * run_w, minlength=self.blocks) * (1 + 1e-12) + 6e-7
        places, scores = [], []

        def score(chosen):
            nonlocal floor
            if len(chosen) < self.blocks:
                wanted = np.zeros(self.blocks, dtype=bool)
                wanted[chosen] = True
                mine = np.flatnonzero(wanted[run_block])
                r, v = runs[mine], run_w[mine]
                a, z = self.start[r], self.stop[r]
            else:  # whole lists
                a, z, v = self.begins[i], self.stops[i], w
            posts = self._ranges(a, z)
            got = np.bincount(self.doc[posts], weights=self.impact[posts] * np.repeat(v, z - a))
            # Rounding keeps order: only scores near the threshold or above are rounded.
            found = np.flatnonzero(got >= max(floor, 1e-6) - 1e-6)
            got = np.round(got[found], 6)
            keep = got >= max(floor, 1e-6)
            places.append(found[keep])
            scores.append(got[keep])
            if sum(map(len, scores)) >= k:
                every = np.concatenate(scores)
                floor = max(floor, float(np.partition(every, -k)[-k]))

        first, cursor, step = int(bound.argmax()), 0, 4
        if bound[first] >= floor:
            score(np.array([first]))
        while cursor < self.blocks:
            pivots = np.flatnonzero((bound[cursor:] >= floor) & (bound[cursor:] > 6e-7))[: step + 1] + cursor
            pivots = pivots[pivots != first][:step]
            if not len(pivots):
                break
            score(pivots)
            cursor, step = int(pivots[-1]) + 1, step * 8
        if not places:
            return np.zeros(0, np.int64), np.zeros(0)
        ids, got = self.doc_ids[np.concatenate(places)], np.concatenate(scores)
        best = np.lexsort((ids, -got))[:k]
        return ids[best], got[best]

    def together(self, q, i, w, floors, k: int):
        """What best() finds for several queries, and maybe more than k of each: their numbers, doc_ids, scores. q, i, w:
        query, term and weight of each query's terms, ascending by query."""
        import numpy as np

        n, several, floors = len(self.doc_ids), len(floors), np.maximum(floors, 1e-6)
        column = self.column[i]
        often = column >= 0
        fq, fc, fw = q[often], column[often], w[often]
        weights = np.zeros((len(self.run_of), several))
        weights[fc, fq] = fw
        single = weights.astype(np.float32)
        # All summands are positive, so a sum in single precision is off by at most this share of itself.
        off = (2 * np.bincount(q, minlength=several).max() + 16) * 2.0**-24
        rare = ~often
        length = self.to[i[rare]] - self.from_[i[rare]]
        runs, run_q, run_w = self._ranges(self.from_[i[rare]], self.to[i[rare]]), np.repeat(q[rare], length), np.repeat(w[rare], length)
        bound = (single.T @ self.most_of).astype(np.float64) * (1 + 2 * off)
        bound += np.bincount(run_q * self.blocks + self.block[runs], weights=self.most[runs] * run_w, minlength=several * self.blocks).reshape(several, -1)
        alive = bound * (1 + 1e-12) + 6e-7 >= floors[:, None]
        about, in_batch, rows = np.zeros((several, n), dtype=np.float32), np.bincount(fc, minlength=len(weights)), []
        left = np.repeat(alive.any(axis=0)[None], len(weights), axis=0)  # of a frequent term's blocks, those where postings are read
        for b, (columns, long, matrix, _) in enumerate(self.dense):
            live, width = np.flatnonzero(alive[:, b]), matrix.shape[1]
            rows.append(np.flatnonzero(in_batch[columns] * long * PRODUCTS >= max(len(live), 1) * width))
            if len(live) and len(rows[b]):
                left[columns[rows[b]], b] = False
                scores = single[columns[rows[b]]].T @ matrix[rows[b]]
                about[live, b * BLOCK : b * BLOCK + width] = scores[live]
        # The other lists, of each term's runs those side by side as one.
        at = np.zeros(len(self.terms), dtype=np.int64)
        at[i] = 1
        terms = np.flatnonzero(at)
        at[terms] = np.arange(len(terms))
        length = self.to[terms] - self.from_[terms]
        runs, term, column = self._ranges(self.from_[terms], self.to[terms]), np.repeat(np.arange(len(terms)), length), np.repeat(self.column[terms], length)
        keep = np.flatnonzero(np.where(column >= 0, left[column, self.block[runs]], alive.any(axis=0)[self.block[runs]]))
        runs, term = runs[keep], term[keep]
        first = np.flatnonzero((np.diff(runs, prepend=-2) > 1) | (np.diff(term, prepend=-1) > 0))
        last = np.append(first[1:], len(runs)) - 1 if len(first) else first
        start, stop = self.start[runs[first]], self.stop[runs[last]]
        begin, end = (np.searchsorted(term[first], np.arange(len(terms)), side=x)[at[i]] for x in ("left", "right"))
        r, of_r, v_r = self._ranges(begin, end), np.repeat(q, end - begin), np.repeat(w, end - begin)
        found = []
        for low in range(0, several, step := max(1, SUMS // n)):
            high = min(low + step, several)
            here = slice(*np.searchsorted(of_r, (low, high)))
            a, z = start[r[here]], stop[r[here]]
            posts = self._ranges(a, z)
            sums = np.bincount(np.repeat((of_r[here] - low) * n, z - a) + self.doc[posts], weights=self.impact[posts] * np.repeat(v_r[here], z - a), minlength=(high - low) * n)
            got = sums.astype(np.float32).reshape(-1, n)
            got += about[low:high]
            least = np.maximum(floors[low:high] * (1 - 2 * off) - 1e-6, 4e-7).astype(np.float32)
            cell = np.flatnonzero(got >= least[:, None])
            of, value = cell // n, got.ravel()[cell]
            # Where no threshold is known yet, the k-th best of these is one.
            ends = np.searchsorted(of, np.arange(high - low + 1))
            for j in np.flatnonzero(np.diff(ends) > 2 * k).tolist():
                own = value[ends[j] : ends[j + 1]]
                least[j] = max(least[j], np.partition(own, -k)[-k] * (1 - 4 * off) - 2e-6)
            ok = value >= least[of]
            found.append((of[ok] + low, cell[ok] % n, sums[cell[ok]].astype(np.float64)))
        of, place, score = (np.concatenate(x) for x in zip(*found, strict=True))
        # Rows of matrices in double precision, for these only.
        block = place // BLOCK
        for b in np.unique(block).tolist():
            here, (columns, _, _, matrix) = np.flatnonzero(block == b), self.dense[b]
            if len(rows[b]):
                by_query = np.zeros((several, len(columns)))
                by_query[:, rows[b]] = weights[columns[rows[b]]].T
                score[here] += np.einsum("ij,ij->i", by_query[of[here]], matrix[place[here] - b * BLOCK])
        score = np.round(score, 6)
        keep = score >= floors[of]
        return of[keep], self.doc_ids[place[keep]], score[keep]


def frequencies(index: DataFrame) -> DataFrame:
    """(term, df) over all shards."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for blob in b.column("blob"):
                s = Shard(blob.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(s.terms), pa.array(np.diff(s.stops, prepend=0))], ["term", "df"])

    return index.select("blob").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, text) -> q, a number of the row, query_id, term, tf."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        q = TaskContext.get().partitionId() << 40
        for b in batches:
            found = [counted(t.as_py()) for t in b.column("text")]
            n = [len(t) for t, _ in found]
            cat = lambda i: np.concatenate([x[i] for x in found]).astype(np.int64) if found else np.zeros(0, np.int64)  # noqa: E731
            ids = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(q, q + len(n)), n)), b.column("query_id").take(ids), pa.array(cat(0)), pa.array(cat(1))], ["q", "query_id", "term", "tf"])
            q += len(n)

    return queries.mapInArrow(run, "q long, query_id long, term long, tf long")


def search(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k best documents of df for each row of queries (query_id, text): query_id, doc_id, rank, score."""
    spark = df.sparkSession
    index = stored(shards(id_text(df, id_col, text_col).where("doc_id is not null")), "none")
    total, words = index.agg(F.sum("n"), F.sum("words")).first()
    none = spark.createDataFrame([], "query_id long, doc_id long, rank int, score double")
    if not total or not words:
        return none
    asked = stored(query_terms(queries.select(F.col("query_id").cast("long").alias("query_id"), F.coalesce("text", F.lit("")).alias("text")).where("query_id is not null")))
    known = asked.join(frequencies(index), "term").withColumn("w", F.col("tf") * F.log1p((F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    ready = stored(known.groupBy("q", "query_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("t")).select("q", "query_id", F.col("t.term").alias("terms"), F.col("t.w").alias("ws")))
    n, terms = ready.agg(F.count("*"), F.sum(F.size("terms"))).first()
    chunks = max(-(-n // QUERY_ROWS), -(-(terms or 0) // QUERY_TERMS))
    out = [_chunk(index, ready.where(F.pmod(F.xxhash64("q"), F.lit(chunks)) == c), words / total, k) for c in range(chunks)]
    if not out:
        return none
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _chunk(index: DataFrame, ready: DataFrame, mean: float, k: int) -> DataFrame:
    """Answers of one chunk of queries, whose size is bounded, over all shards."""
    import numpy as np

    spark = index.sparkSession
    rows = [(r["q"], r["query_id"], np.array(r["terms"], dtype=np.int64), np.array(r["ws"])) for r in ready.toLocalIterator()]
    cat = lambda j, kind: np.concatenate([np.zeros(0, kind), *(x[j] for x in rows)])  # noqa: E731
    order = side_by_side(cat(2, np.int64), np.array([len(x[2]) for x in rows], dtype=np.int64), np.array([x[0] for x in rows], dtype=np.int64))
    rows = [rows[j] for j in order.tolist()]
    own, term = np.unique(cat(2, np.int64), return_inverse=True)
    numbers, names, stops = (np.array(x, dtype=np.int64) for x in ([x[0] for x in rows], [x[1] for x in rows], np.cumsum([len(x[2]) for x in rows])))
    held = spark.sparkContext.broadcast((numbers, names, stops, own, term.astype(np.int32), cat(3, np.float64)))
    del rows

    def run(batches):
        import pyarrow as pa

        numbers, names, stops, own, term, weight = held.value
        of = np.repeat(np.arange(len(numbers)), np.diff(stops, prepend=0))
        floors, best = np.zeros(len(numbers)), {}  # best: of each lot of queries, query, doc_id and score over the task's shards so far
        for b in batches:
            for blob in b.column("blob"):
                shard = None  # the one before goes first
                shard = Shard(blob.as_py()).ready(mean)
                at = shard.find(own)
                for low in range(0, len(numbers), TOGETHER):
                    high = min(low + TOGETHER, len(numbers))
                    entries = slice(stops[low - 1] if low else 0, stops[high - 1])
                    i = at[term[entries]]
                    ok = i >= 0
                    i, q, w = i[ok], of[entries][ok] - low, weight[entries][ok]
                    many = np.bincount(q[shard.column[i] >= 0], minlength=high - low) >= DENSE_TERMS
                    more = [best[low]] if low in best else []
                    if many.any():
                        # Only these, under numbers without gaps.
                        own_q, mine = np.flatnonzero(many), many[q]
                        x, ids, scores = shard.together(np.cumsum(many)[q[mine]] - 1, i[mine], w[mine], floors[low + own_q], k)
                        more.append((own_q[x], ids, scores))
                    ends = np.searchsorted(q, np.arange(high - low + 1))
                    for j in np.flatnonzero(~many & (np.diff(ends) > 0)).tolist():
                        ids, scores = shard.best(i[ends[j] : ends[j + 1]], w[ends[j] : ends[j + 1]], k, floors[low + j])
                        more.append((np.full(len(ids), j), ids, scores))
                    if not more:
                        continue
                    x, ids, scores = (np.concatenate(c) for c in zip(*more, strict=True))
                    order = np.lexsort((ids, -scores, x))
                    rank = np.arange(len(x)) - np.searchsorted(x[order], x[order])
                    x, ids, scores = (c[order[rank < k]] for c in (x, ids, scores))
                    best[low] = x, ids, scores
                    full = rank[rank < k] == k - 1
                    floors[low + x[full]] = scores[full]
        for low, (x, ids, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(numbers[low + x]), pa.array(names[low + x]), pa.array(ids), pa.array(scores)], ["q", "query_id", "doc_id", "score"])

    # As many tasks as cores, whatever the input: each answers with k rows a query, and thresholds hold for all its shards.
    tasks = max(spark.sparkContext.defaultParallelism, 1)
    found = index.select("blob").coalesce(tasks).mapInArrow(run, "q long, query_id long, doc_id long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "doc_id"))  # k of each task
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "1")  # a task has many shards, but holds one at a time
    try:
        out = stored(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "doc_id", "rank", "score"))
    finally:
        spark.conf.set(size, before)
        held.destroy()
    return out


def op7_blockmax_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return search(docs, docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text"))


#: SQL for op7: every score of every query, ranked.
OP7_SQL = r"""
with w as (select doc_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	

]+'), lambda x: x <> '')) term from documents where doc_id is not null),
t as (select doc_id, term, count(*) tf from w group by 1, 2),
l as (select doc_id, count(*) size from w group by 1),
g as (select (select count(*) from documents where doc_id is not null) n, (select count(*) from w) / (select count(*) from documents where doc_id is not null) mean),
f as (select term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) idf from t, g group by term, n),
s as (select q.doc_id query_id, d.doc_id, round(sum(q.tf * idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) score
      from t q join f using (term) join t d using (term) join l on l.doc_id = d.doc_id, g where q.doc_id % 50 = 0 group by 1, 2),
r as (select query_id, doc_id, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) "rank", score from s)
select * from r where "rank" <= 10
"""
