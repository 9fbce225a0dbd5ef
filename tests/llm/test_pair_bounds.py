"""Ranked search with pair bounds against every score in plain Python, and against its SQL."""

import collections
import itertools
import math
import random
import re

import duckdb
import pytest

from souk.llm import pair_bounds as B

DOCS = "doc_id long, text string, item_id long, raw string, shard int, pairs string, q int, term string, score int"
ITEMS = "item_id long, text string, doc_id long, raw string, q int, qs string, shard string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(i, collections.Counter(t), len(t)) for i, text in docs for t in [terms(text)]]
    n, words = sum(x[2] > 0 for x in held), sum(x[2] for x in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    weight = lambda t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
    out = []
    for item, text in items:
        scores = [(sum(weight(t) * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * size * n // words))) for t in set(terms(text)) if t in c), i) for i, c, size in held]
        best = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1]))[:k]
        out += [(item, r, i, s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out, key=str)


def rows(seed, n=300):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "日本", "a1", "THE", "the"]
    word = lambda: vocabulary[min(int(rnd.expovariate(0.09)), len(vocabulary) - 1)]
    text = lambda most: rnd.choice([" ", "-", "\x00", "\n"]).join(word() for _ in range(rnd.randint(1, most)))
    docs = [(i, text(40)) for i in range(n)] + [(None, text(30)), (None, text(30)), (7, text(20)), (900, None), (901, ""), (902, " .,!"), (903, text(4000))]
    docs += [(i, docs[5][1]) for i in range(910, 930)]  # ties
    items = [(i, text(25)) for i in range(12)] + [(3, docs[10][1]), (50, None), (51, ""), (52, "unknown words"), (None, docs[12][1]), (53, docs[5][1]), (54, "the The THE")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*r, 1, "x", 1, "x", 1, "x", 1) for r in docs], DOCS).repartition(3), spark.createDataFrame([(*r, 1, "x", 1, "x", "x") for r in items], ITEMS)


@pytest.mark.parametrize(("shard", "chunk", "group", "most_pairs", "k"), [(32768, 512, 10**8, 50_000, 10), (16, 2, 600, 50_000, 3), (40, 5, 10**8, 8, 1), (25, 512, 10**8, 0, 10)])
def test_against_every_score(spark, monkeypatch, shard, chunk, group, most_pairs, k):
    monkeypatch.setattr(B, "GROUP_BYTES", group)
    pairs = B.chain_pairs
    monkeypatch.setattr(B, "chain_pairs", lambda asked: pairs(asked, most_pairs))
    docs, items = rows(shard)
    got = [tuple(r) for r in B.ranked(*frames(spark, docs, items), k=k, shard_rows=shard, chunk_queries=chunk).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == brute(docs, items, k)


def test_shards_close_at_their_postings(spark):
    docs, items = rows(1, 60)
    index = B.shards(B._raw(frames(spark, docs, items)[0].coalesce(1), "doc_id", "text", "doc_id"), most_postings=50)
    assert index.count() > 10
    got = [tuple(r) for r in B.ranked(*frames(spark, docs, items), shard_postings=50).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == brute(docs, items, 10)


def test_empty_tables(spark):
    docs, items = rows(2, 20)
    some, asked = frames(spark, docs, items)
    assert B.ranked(some.limit(0), asked).isEmpty()
    assert B.ranked(some, asked.limit(0)).isEmpty()
    assert B.ranked(some.where("text = ''"), asked).isEmpty()


def test_bounds_of_a_chain_are_the_best_parting():
    rnd = random.Random(3)
    for _ in range(200):
        n = rnd.randint(0, 7)
        most = [rnd.randint(0, 50) for _ in range(n)]
        joint = [rnd.choice([None, rnd.randint(0, 60)]) for _ in range(max(n - 1, 0))]
        for start in range(n + 1):
            best = sum(most[start:])
            for chosen in itertools.product([0, 1], repeat=max(n - 1 - start, 0)):
                at = [start + i for i, x in enumerate(chosen) if x]
                if all(b - a > 1 for a, b in itertools.pairwise(at)) and all(joint[i] is not None for i in at):
                    paired = {j for i in at for j in (i, i + 1)}
                    best = min(best, sum(max(joint[i], most[i], most[i + 1]) for i in at) + sum(most[i] for i in range(start, n) if i not in paired))
            assert B.chain_bounds(most, joint)[start] == best


def test_pairs_let_more_lists_be_skipped():
    """Two rare terms that never meet bound a document by the larger of them, not by their sum."""
    made = B.Builder()
    for i in range(100):
        made.add(i, (b"rare " if i == 0 else b"odd " if i == 1 else b"") + b"filler " * (i % 7 + 1))
    shard = B.Shard(made.row()["blob"], 100, 400)
    places = [shard.place(x) for x in (b"odd", b"rare")]
    pairs = B.Pairs(B.pair_lists(shard, [(b"odd", b"rare", 3000, 3000)]))
    most = [3000 * shard.list(i)[2] for i in places]
    joint, a, z = pairs.of[tuple(places)]
    assert (joint, z - a) == (0, 0)
    assert B.chain_bounds(most, [joint])[0] == max(most) < sum(most)


def test_against_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    want = con.execute(f'select item_id, "rank", doc_id, score from ({B.OP12_SQL})').fetchall()
    got = [tuple(r) for r in B.op12_pair_bound_maxscore(spark, "/root/testdata/sf0.001").select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got) == sorted(want)
