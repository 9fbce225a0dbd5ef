"""The prefix trie against plain dictionaries of prefixes, and against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from souk.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, ids string, sizes int, shard string"


def rebuilt(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    turns = {c: [x[1:] for x in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100 if c >= 0 else c + (-c) % 100, [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items()}


def made(seed):
    rnd = random.Random(seed)
    rows = []
    for c in [*rnd.sample(range(1000), 60), 0, 100, 200]:
        for t in range(rnd.randint(1, 7)):
            rows.append((c, t, rnd.choice(["user", "bot", None]), rnd.choice(["a", "bb", "é", "", None, "ccc" * 9])))
    rows += [(c, t, "user", "copy") for c in range(300, 360) for t in range(3)]  # copies
    rows += [(-7, 1, "user", "b"), (-7, None, "user", "a"), (-7, 1, "user", "b"), (None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(c, t, "user", f"t{t}" if t < 60 + c else "end") for c in (401, 402, 403) for t in range(90)]  # long ones that part late
    rows += [(710, 0, "user", "only")]  # no first of its block: what is left may be nothing
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("small", "large", "piece"), [(20_000, 10**6, 2000), (30, 40, 3), (3, 3, 1)])
def test_against_dictionaries(spark, monkeypatch, small, large, piece):
    monkeypatch.setattr(T, "SMALL_SHARD", small)
    monkeypatch.setattr(T, "LARGE_SHARD", large)
    rows = made(small)
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got = [tuple(r) for r in T.trie(T.joined_starts(T.sequences(df)), piece).select(T.RESULT).collect()]
    want = brute(rebuilt(rows))
    assert len(got) == len(want) and set(got) == want


def test_plain_conversations_share_their_own_starts(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "b", "c"), (2, 0, "u", "a"), (3, 0, "u", "z")]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got = {tuple(r) for r in T.trie(T.sequences(df)).select(T.RESULT).collect()}
    assert got == brute({1: [("u", "a"), ("b", "c")], 2: [("u", "a")], 3: [("u", "z")]})


def test_empty_table(spark):
    assert T.trie(T.sequences(spark.createDataFrame([], SCHEMA))).isEmpty()


def test_turnless_conversation_ends_at_the_root(spark):
    c = next(x for x in range(1, 99) if zlib.crc32(str(x).encode()) % 6 >= 2)
    df = spark.createDataFrame([(c, 0, "u", "a", "x", 1, "y")], SCHEMA)
    got = [tuple(r) for r in T.trie(T.joined_starts(T.sequences(df))).select(T.RESULT).collect()]
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    names = sorted(T.RESULT)
    want = con.execute(f"select {','.join(names)} from ({T.OP11_SQL})").fetchall()
    got = [tuple(r) for r in T.op11_prefix_trie(spark, "/root/testdata/sf0.001").select(names).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
