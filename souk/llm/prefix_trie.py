"""Prefix trie of conversations by padded turn-id matrices (operator 11).

A turn's id is 128 bits of two differently seeded hashes of role and text, so texts do not travel. Conversations,
one row of ids each, are dealt to shards by ranges of their id sequences (copies by their key), so that the members
of a node lie side by side. A shard pads its sequences to matrices of at most ``COLUMNS`` columns (longer sequences
go on in the next matrix), orders them by lexsort, and marks where a column differs from the row before; the marks,
OR-ed from column to column, are the starts of nodes, over which reduceat counts members and sums up subtrees.

Nodes on a shard's first or last path may go on in the next shard. Of these only partial counts leave the shard,
without what hangs below other such nodes; they are added up by key and, since they form a tree of their own, summed
up along it by doubling steps, whose number is the logarithm of the depth. All other nodes are final at once.

Cases: a null role or text is empty; null turns come first, turns of equal number are ordered by their hashes;
repeated rows are turns of their own; rows with a null conv_id are left out; a conversation without turns ends at
the root; an empty table has no nodes, not even a root; texts of any length count whole; other columns are ignored.
One conversation's ids (20 bytes a turn) are one row; however many conversations share a prefix or are copies, no
task sees more than its shard.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, entering, stored

COLUMNS = 32
#: Turns of a shard: wanted while there are fewer shards than shuffle partitions, and at most on average.
SMALL_SHARD, LARGE_SHARD = 20_000, 1_000_000
#: Ids in one piece of the list of those that end at a node.
PIECE = 2000
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, ids (two longs a turn) and sizes (code points) of each conversation's turns in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    turn = F.struct(F.col(turn_col).alias("t"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"), F.length(text).alias("n"))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("turn"))
    of_conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return of_conv.select("conv_id", F.flatten(F.transform("turns", lambda x: F.array(x["a"], x["b"]))).alias("ids"), F.col("turns.n").alias("sizes"))


def joined_starts(seqs: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Sequences whose first h turns are those of the conversation of the least id in their block of ``group`` ids
    (as many as it has; none if it is absent), h being the crc32 of the decimal id modulo ``most``."""
    c = F.col("conv_id")
    starts = seqs.where(c % group == 0).select(c.alias("start_id"), F.slice("ids", 1, 2 * (most - 1)).alias("start_ids"), F.slice("sizes", 1, most - 1).alias("start_sizes"))
    both = seqs.withColumn("start_id", c - c % group).withColumn("h", (F.crc32(c.cast("string")) % most).cast("int")).join(starts, "start_id", "left")
    none = lambda kind: F.array().cast(kind)
    rest = lambda name, each: F.slice(name, F.col("h") * each + 1, F.greatest(F.size(name), F.lit(1)))
    ids = F.concat(F.coalesce(F.slice("start_ids", F.lit(1), F.col("h") * 2), none("array<long>")), rest("ids", 2))
    sizes = F.concat(F.coalesce(F.slice("start_sizes", F.lit(1), F.col("h")), none("array<int>")), rest("sizes", 1))
    return both.select("conv_id", ids.alias("ids"), sizes.alias("sizes"))


class Shard:
    """The trie of the sequences of one shard: convs, lengths, starts of their turns in ids (turns, 2) and sizes."""

    def __init__(self, convs, lengths, ids, sizes):
        import numpy as np

        self.np, self.convs, self.lengths = np, convs, lengths
        at = np.cumsum(lengths) - lengths
        #: Of each depth: its nodes' parents (places in the depth above), members, least member, last turn, enders.
        self.depths = [{"parent": np.zeros(1, np.int64), "n": np.array([len(convs)]), "low": np.array([convs.min()]), "id": np.zeros((1, 2), np.int64), "size": np.zeros(1, np.int64)}]
        self._ends(0, np.flatnonzero(lengths == 0), np.zeros(int((lengths == 0).sum()), np.int64))
        rows, group = np.flatnonzero(lengths), None
        group = np.zeros(len(rows), np.int64)
        while len(rows):
            rows, group = self._matrix(rows, group, at, ids, sizes)

    def _ends(self, depth, rows, nodes):
        """Keeps which node each row ends at, in ascending order of node and key."""
        order = self.np.lexsort((self.convs[rows], nodes))
        self.depths[depth]["ends"] = (nodes[order], self.convs[rows][order])

    def _matrix(self, rows, group, at, ids, sizes):
        """Adds the depths of the next COLUMNS turns of rows, which all have at least one more; group is each one's
        node at the depth so far."""
        np, base = self.np, len(self.depths) - 1
        left = self.lengths[rows] - base
        width = int(min(COLUMNS, left.max()))
        held = np.minimum(left, width)
        matrix = np.full((len(rows), width, 2), np.iinfo(np.int64).min)
        turn_size = np.zeros((len(rows), width), np.int64)
        row = np.repeat(np.arange(len(rows)), held)
        column = np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)
        source = np.repeat(at[rows] + base, held) + column
        matrix[row, column], turn_size[row, column] = ids[source], sizes[source]
        order = np.lexsort([self.convs[rows], *matrix.reshape(len(rows), -1).T[::-1], group])
        rows, group, left, matrix, turn_size = rows[order], group[order], left[order], matrix[order], turn_size[order]
        changes = np.r_[True, group[1:] != group[:-1]]
        above = group  # each row's node in the depth above
        for j in range(width):
            changes = changes | np.r_[True, (matrix[1:, j] != matrix[:-1, j]).any(axis=1)]
            starts = np.flatnonzero(changes)
            real = left[starts] > j  # others are padding of sequences that have ended
            counts, low = np.diff(np.r_[starts, len(rows)]), np.minimum.reduceat(self.convs[rows], starts)
            own = np.where(real, np.cumsum(real) - 1, -1)
            mine = np.repeat(own, counts)
            starts = starts[real]
            self.depths.append({"parent": above[starts], "n": counts[real], "low": low[real], "id": matrix[starts, j], "size": turn_size[starts, j]})
            done = np.flatnonzero(left == j + 1)
            self._ends(len(self.depths) - 1, rows[done], mine[done])
            above = mine
        more = left > width
        return rows[more], above[more]

    def open_paths(self):
        """At each depth, the places of the nodes on the first and last path: a path goes down to the first (last)
        child; the first ends where a sequence does, since that one comes before all longer ones."""
        np, depths = self.np, self.depths
        out = [np.zeros(len(d["n"]), bool) for d in depths]
        for d in out[:1]:
            d[0] = True
        node = 0
        for k in range(1, len(depths)):
            if (depths[k - 1]["ends"][0] == node).any():
                break
            node = int(np.searchsorted(depths[k]["parent"], node))
            out[k][node] = True
        node = 0
        for k in range(1, len(depths)):
            child = int(np.searchsorted(depths[k]["parent"], node, "right")) - 1
            if child < 0 or depths[k]["parent"][child] != node:
                break
            node = child
            out[k][node] = True
        return out

    def sums(self, is_open):
        """Of each depth's nodes: children, leaves and saved tokens of the subtree; for open nodes without what
        lies at or below other open nodes, and for the last two without their own share."""
        np, out, below = self.np, [], None
        for k in range(len(self.depths) - 1, -1, -1):
            d, shut = self.depths[k], ~is_open[k]
            kids, leaves, saved = (np.zeros(len(d["n"]), np.int64) for _ in range(3))
            if below is not None and len(below[0]):
                parent = self.depths[k + 1]["parent"]
                first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
                for into, values in zip((kids, leaves, saved), below, strict=True):
                    into[parent[first]] = np.add.reduceat(values, first)
            leaves += shut & (kids == 0)
            saved += np.where(shut, (d["n"] - 1) * d["size"], 0)
            out.append((kids, leaves, saved))
            below = (shut.astype(np.int64), np.where(shut, leaves, 0), np.where(shut, saved, 0))
        return out[::-1]

    def nodes(self, piece: int):
        """Rows of SHARD_SCHEMA but for the shard, a depth at a time."""
        np = self.np
        is_open = self.open_paths()
        sums = self.sums(is_open)
        keys = {0: hashlib.blake2b(digest_size=16)}  # of the open nodes of the depth above
        for k, d in enumerate(self.depths):
            if k:
                above, keys = keys, {}
                for x in np.flatnonzero(is_open[k]).tolist():
                    keys[x] = above[int(d["parent"][x])].copy()
                    keys[x].update(d["id"][x].tobytes())
            enders, convs = d["ends"]
            first = np.searchsorted(enders, np.arange(len(d["n"])))
            last = np.searchsorted(enders, np.arange(len(d["n"])), "right")
            text = convs.astype(str)
            parents = self.depths[k - 1] if k else None
            kids, leaves, saved = sums[k]
            for x in range(len(d["n"])):
                key = keys[x].digest() if x in keys else None
                hung = k and is_open[k - 1][d["parent"][x]]
                up = above[int(d["parent"][x])].digest() if hung else None
                up_conv = int(parents["low"][d["parent"][x]]) if k and not hung else None
                a, z = int(first[x]), int(last[x])
                ends = hashlib.sha256(",".join(text[a:z]).encode()).hexdigest() if z > a and key is None else None
                yield "open" if key else "hung" if hung else "shut", key, up, int(d["low"][x]), k, up_conv, int(d["n"][x]), int(kids[x]), int(leaves[x]), int(saved[x]), int(d["size"][x]), ends
                for i in range(a, z if key else a, piece):
                    yield "ends", key, None, int(convs[i]), k, None, min(piece, z - i), 0, 0, 0, 0, ",".join(text[i : min(i + piece, z)])


SHARD_SCHEMA = "kind string, key binary, up binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends string, shard int"
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _shard_rows(batches, piece: int):
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    entering(__name__)
    convs, lengths, ids, sizes = [], [], [], []
    for b in batches:
        if b.num_rows:
            convs.append(b.column("conv_id").to_numpy())
            lengths.append(np.diff(b.column("sizes").offsets.to_numpy()))
            ids.append(b.column("ids").flatten().to_numpy())
            sizes.append(b.column("sizes").flatten().to_numpy())
    if not convs:
        return
    convs, lengths, ids, sizes = (np.concatenate(x) for x in (convs, lengths, ids, sizes))
    made = Shard(convs, lengths.astype(np.int64), ids.reshape(-1, 2), sizes.astype(np.int64))
    kinds = [pa.string(), pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.string(), pa.int32()]
    names = [x.split()[0] for x in SHARD_SCHEMA.split(", ")]
    shard, held = TaskContext.get().partitionId(), []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*held, strict=True), [shard] * len(held)], kinds, strict=True)], names)

    for row in made.nodes(piece):
        held.append(row)
        if len(held) == 5000:
            yield batch()
            held.clear()
    if held:
        yield batch()


def _hashed_ends(batches):
    """Rows (key, ends) in order -> (key, ends_sha256), fed piece by piece."""
    import pyarrow as pa

    key = digest = None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])
    for b in batches:
        for k, piece in zip(b.column("key").to_pylist(), b.column("ends"), strict=True):
            if k != key:
                if key is not None:
                    yield out()
                key, digest = k, hashlib.sha256(piece.as_py().encode())
            else:
                digest.update(b"," + piece.as_py().encode())
    if key is not None:
        yield out()


def subtree_sums(tree: DataFrame, columns: list[str], depth: int) -> DataFrame:
    """tree (key, up, columns) -> (key, columns), each summed over the node and all below it. After j steps a node
    holds what lies less than 2**j below it, and ``up`` names the node 2**j above."""
    held, reach = tree.select("key", "up", *columns), 1
    while reach <= depth:
        given = held.where("up is not null").groupBy("up").agg(*[F.sum(c).alias(f"more_{c}") for c in columns]).withColumnRenamed("up", "key")
        over = held.select(F.col("key").alias("up"), F.col("up").alias("over"))
        held = cut(held.join(given, "key", "left").join(over, "up", "left").select("key", F.col("over").alias("up"), *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in columns]))
        reach *= 2
    return held.select("key", *columns)


def trie(seqs: DataFrame, piece: int = PIECE) -> DataFrame:
    """seqs (conv_id distinct, ids, sizes) -> one row for each distinct prefix, as RESULT has it; piece: how many ids
    of those that end at an open node are sent on together."""
    seqs = stored(seqs)
    spark = seqs.sparkSession
    rows, turns = seqs.agg(F.count("*"), F.sum(F.size("sizes") + 1)).first()
    if not rows:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    shards = max(min(-(-turns // SMALL_SHARD), int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-turns // LARGE_SHARD))
    found = stored(seqs.repartitionByRange(shards, "ids", "conv_id").mapInArrow(lambda batches: _shard_rows(batches, piece), SHARD_SCHEMA))
    # Open nodes: at most two paths of each shard.
    parts = found.where("kind = 'open'").groupBy("key").agg(F.first("up").alias("up"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.first("size").alias("size"))
    kids = parts.groupBy("up").agg(F.count("*").alias("kids")).withColumnRenamed("up", "key")
    tree = parts.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    tree = tree.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size"))
    tree = cut(tree)
    sums = subtree_sums(tree, ["n_leaves", "saved_tokens"], tree.agg(F.max("depth")).first()[0])
    above = tree.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    pieces = found.where("kind = 'ends'").select("key", "conv_id", "ends").repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ends")
    ends = pieces.mapInArrow(_hashed_ends, "key binary, ends_sha256 string")
    open_ = tree.drop("n_leaves", "saved_tokens").join(sums, "key").join(above, "up", "left").join(ends, "key", "left")
    # A hung node's parent is open: its key is looked up once for each shard, so that no key is met too often.
    lowest = cut(found.where("kind = 'open'").select("key", "shard").join(tree.select("key", F.col("conv_id").alias("low")), "key").select("shard", F.col("key").alias("up"), "low"))
    hung = found.where("kind = 'hung'").join(lowest, ["shard", "up"]).withColumn("parent_conv_id", F.col("low"))
    final = lambda df, sha: df.select(*RESULT[:-1], F.coalesce(sha, F.lit(NO_ENDS)).alias("ends_sha256"))
    return final(found.where("kind = 'shut'"), F.col("ends")).unionByName(final(hung, F.col("ends"))).unionByName(final(open_, F.col("ends_sha256")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(joined_starts(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: SQL for op11: every prefix of every rebuilt conversation, grouped; crc32 by its polynomial, a bit at a time.
OP11_SQL = r"""
with own as (select conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first) turns from conversations where conv_id is not null group by conv_id),
h as (select *, xor(list_reduce(list_prepend(4294967295::bigint, flatten([[ascii(x), 0, 0, 0, 0, 0, 0, 0] for x in string_split(conv_id::varchar, '')])::bigint[]),
               lambda a, x: case when xor(a, x) & 1 = 1 then xor(xor(a, x) >> 1, 3988292384) else xor(a, x) >> 1 end), 4294967295::bigint) % 6 as h from own),
built as (select c.conv_id, list_concat(coalesce(list_slice(b.turns, 1, c.h), []), list_slice(c.turns, c.h + 1, len(c.turns))) turns
          from h c left join own b on b.conv_id = c.conv_id - c.conv_id % 100),
p as (select conv_id, d as depth, list_slice(turns, 1, d) pre, len(turns) = d ends from (select *, unnest(range(0, len(turns) + 1)) d from built)),
n as (select pre, depth, min(conv_id) conv_id, count(*) n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '') ends from p group by pre, depth),
k as (select c.depth - 1 depth, list_slice(c.pre, 1, c.depth - 1) pre, count(*) kids from n c where c.depth > 0 group by 1, 2),
v as (select n.*, coalesce(kids, 0) n_children, case when depth = 0 then 0 else (n_convs - 1) * length(pre[depth].t) end saved from n left join k using (depth, pre)),
s as (select a.depth, a.pre, sum((b.n_children = 0)::int) leaves, sum(b.saved) saved from v a join (select *, unnest(range(0, depth + 1)) d from v) b on a.depth = b.d and a.pre = list_slice(b.pre, 1, b.d) group by 1, 2)
select v.conv_id, v.depth::bigint depth, u.conv_id parent_conv_id, v.n_convs, v.n_children::bigint n_children, s.leaves::bigint n_leaves, s.saved::bigint saved_tokens, sha256(v.ends) ends_sha256
from v join s on s.depth = v.depth and s.pre = v.pre left join v u on u.depth = v.depth - 1 and u.pre = list_slice(v.pre, 1, v.depth - 1)
"""
