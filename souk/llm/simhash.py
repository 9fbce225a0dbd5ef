"""SimHash near-duplicate groups by pigeonring filtering (operator 4).

Fingerprints of 64 bits are cut into segments on a ring. If two differ in at most r bits, then (pigeonring
principle) some chain of consecutive segments starts where the running difference never exceeds the
proportional budget: at most l * r / m over its first l segments, for every l. With more segments than r the
first segment of such a chain is equal, so only fingerprints that share a segment's value are held against each
other, and a pair goes on to the full Hamming check only if its chain stays within budget.

Equal fingerprints are one node, however many documents have them. A segment value that more than ``crowd``
different fingerprints share is not expanded to pairs: its members are linked exactly through the fingerprints
at one flipped bit (two that differ in at most two bits have such a neighbour in common), a fixed number of keys
each, and every such key is shared by few.

Cases: null and empty texts have fingerprint 0 and link like any other; texts with fewer words than a shingle
are one shingle; texts of any length are hashed whole; rows that repeat are kept and share a group; a null id
never names a group unless all its rows have none; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, entering, id_text, stored
from .graph import components


PERMUTATIONS, BANDS, BAND_ROWS = 256, 10, 3
#: Keys of members of crowds: how many, and least hashes in each. Two texts alike by 0.8 share one with over 99.9 %.
FINER = (40, 6)
#: An estimate this far from the least similarity (0.12 is over 4.5 standard deviations at 0.8) settles a pair.
FAR = 0.12


def shingle_hashes(text: str, shingle: int):
    """XXH64 (seed 42) of a text's word shingles, repeats included; none for a text without words."""
    import numpy as np
    import xxhash

    words = text.encode().lower().split()  # of bytes: only A-Z change, only ASCII white space parts
    if not words:
        return np.zeros(0, "<u8")
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.array([len(w) + 1 for w in words]))
    starts = [0, *ends[: len(words) - min(shingle, len(words))].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    return np.array([h(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], dtype="<u8")


def simhash(hashes) -> int:
    """64-bit SimHash as a signed number: a bit is 1 if set in over half the hashes."""
    import numpy as np

    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint(text: str, shingle: int = 3) -> int:
    return simhash(shingle_hashes(text, shingle))


def least_hashes(hashes, times):
    """(keys, signature) of a set of hashes: its least value under each multiplier, cut to a byte for the
    signature and joined band by band for the keys; nothing for an empty set."""
    import numpy as np
    import xxhash

    if not len(hashes):
        return [], b""
    least = np.full(len(times), 2**64 - 1, dtype="<u8")
    for i in range(0, len(hashes), 512):
        least = np.minimum(least, (hashes[i : i + 512] * times[:, None]).min(axis=1))
    keys = [xxhash.xxh64_intdigest(least[b * BAND_ROWS : (b + 1) * BAND_ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(keys, dtype="<u8").view("<i8"), (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8).tobytes()


def sketches(df: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As fingerprints(), but of the set of shingles, repeats once; with keys array<long> and sig binary of that set."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        entering(__name__)
        times = np.random.default_rng(42).integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for b in batches:
            fps, keys, sigs = [], [], []
            for x in b.column("text").to_pylist():
                hashes = np.unique(shingle_hashes(x, shingle))
                k, s = least_hashes(hashes, times)
                fps.append(simhash(hashes))
                keys.append(k)
                sigs.append(s)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64()), b.column("h"), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["doc_id", "fp", "h", "keys", "sig"])

    return id_text(df, id_col, text_col).withColumn("h", F.xxhash64("text")).mapInArrow(run, "doc_id long, fp long, h long, keys array<long>, sig binary")


def fingerprints(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp long and h, a hash of the text, for each row of df."""

    def run(batches):
        import pyarrow as pa

        entering(__name__)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([fingerprint(x, shingle) for x in b.column("text").to_pylist()], pa.int64()), b.column("h")], ["doc_id", "fp", "h"])

    return id_text(df, id_col, text_col).withColumn("h", F.xxhash64("text")).mapInArrow(run, "doc_id long, fp long, h long")


def segments(m: int) -> list[tuple[int, int]]:
    """(shift, width) of m segments of 64 bits."""
    at = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def links(nodes: DataFrame, most_bits: int = 2, m: int = 3, crowd: int = 64) -> DataFrame:
    """nodes (fp, rep), fp distinct -> edges (a, b) between reps that join all nodes within most_bits of each
    other: every such pair, or, in crowded segment values, a star of at most two steps in its place."""
    if not 0 <= most_bits <= 2 or m <= most_bits:
        raise ValueError("at most 2 bits, and more segments than bits")
    cuts = segments(m)
    part = lambda x, i: F.shiftrightunsigned(x, cuts[i][0]).bitwiseAND(F.lit((1 << cuts[i][1]) - 1))
    fp = F.col("fp")
    keyed = nodes.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), part(fp, i).alias("v")) for i in range(m)])).alias("s")).select("fp", "rep", "s.i", "s.v")
    sizes = cut(keyed.groupBy("i", "v").count().where("count > 1").select("i", "v", (F.col("count") > crowd).alias("crowded")))
    shared = keyed.join(sizes, ["i", "v"])
    few = shared.where("not crowded").drop("crowded")
    a, b = few.select("i", "v", F.col("fp").alias("x"), F.col("rep").alias("a")), few.select("i", "v", F.col("fp").alias("y"), F.col("rep").alias("b"))
    # The chain from segment i on: running differences within l * most_bits / m, for each l up to m.
    differ = lambda j: F.bit_count(part(F.col("x"), j).bitwiseXOR(part(F.col("y"), j)))

    def chain(i: int):
        run, ok = F.lit(0), F.lit(True)
        for step in range(1, m):
            run = run + differ((i + step) % m)
            ok = ok & (run * m <= (step + 1) * most_bits)
        return ok

    held = F.lit(False)
    for i in range(m):
        held = held | ((F.col("i") == i) & chain(i))
    full = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= most_bits
    pairs = a.join(b, ["i", "v"]).where(F.col("x") < F.col("y")).where(held).where(full).select("a", "b").distinct()
    # Crowded values: each member under itself and its one-bit neighbours; a key's members link to its least.
    flips = F.concat(F.array(F.lit(0).cast("long")), F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)]))
    many = shared.where("crowded").select("fp", "rep").distinct()
    near = many.select("fp", "rep", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("key"))
    stars = near.groupBy("key").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("all")).where("size(all) > 1")  # at most 65 to a key
    return pairs.unionByName(stars.select("a", F.explode("all").alias("b")).where("a <> b").distinct())


def ring(x, y, most_bits: int, m: int):
    """Whether some chain of the m segments of x and y keeps its running difference within l * most_bits / m."""
    differ = [F.bit_count(F.shiftrightunsigned(x, a).bitwiseAND(F.lit((1 << n) - 1)).bitwiseXOR(F.shiftrightunsigned(y, a).bitwiseAND(F.lit((1 << n) - 1)))) for a, n in segments(m)]
    held = F.lit(False)
    for i in range(m):
        run, ok = F.lit(0), F.lit(True)
        for step in range(m):
            run = run + differ[(i + step) % m]
            ok = ok & (run * m <= (step + 1) * most_bits)
        held = held | ok
    return held


def shingle_sets(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """texts (h, text), wanted (k, h) -> (k, set), the distinct shingle hashes of each wanted text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        entering(__name__)
        for b in batches:
            sets = [np.unique(shingle_hashes(x, shingle)).view("<i8") for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(sets, pa.list_(pa.int64()))], ["k", "set"])

    return texts.dropDuplicates(["h"]).join(wanted, "h").select("k", "text").mapInArrow(run, "k long, set array<long>")


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """pairs (x, y, a, b), sets (k, set) -> (a, b) of pairs whose sets have ``least`` or more in common."""
    both = pairs.join(sets.select(F.col("k").alias("x"), F.col("set").alias("s")), "x").join(sets.select(F.col("k").alias("y"), F.col("set").alias("t")), "y")
    common = F.size(F.array_intersect("s", "t"))
    counted = both.select("a", "b", common.alias("common"), (F.size("s") + F.size("t")).alias("n"))
    return counted.where(F.col("common") >= least * (F.col("n") - F.col("common"))).select("a", "b")


def exact_links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """pairs (x, y, a, b) of nodes (k, h) -> (a, b) of those whose shingle sets have ``least`` or more in common."""
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("k")).distinct()
    return alike(pairs, cut(shingle_sets(texts, nodes.select("k", "h").join(wanted, "k"), shingle)), least)


def prefix_links(open_: DataFrame, nodes: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """open_ (k, c) -> (a, b) between the components c of all its members alike by ``least`` or more. Exact: with
    the shingles in one order for all, the rarest first, two sets of that likeness share one of the first
    n - ceil(least * n) + 1 of each, and from the first they share on both have enough left. A shingle of one text
    only takes its place there without any partner, so a large family whose texts share less than ``least`` hardly
    meets."""
    sets = stored(shingle_sets(texts, nodes.select("k", "h").join(open_.select("k"), "k"), shingle))
    each = sets.select("k", F.explode("set").alias("s"))
    shared = each.groupBy("s").agg(F.count("*").alias("often")).where("often > 1")
    sizes = sets.select("k", F.size("set").alias("n"))
    ranked = each.join(shared, "s").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("often", "s"))).alias("own"))  # of one text
    alone = F.col("n") - F.size("own")
    room = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1 - alone
    first = ranked.join(sizes, "k").join(open_, "k").withColumn("alone", alone).withColumn("room", room.cast("int")).where("room > 0")
    first = cut(first.select("k", "c", "n", "alone", F.posexplode(F.slice("own", F.lit(1), F.col("room"))).alias("i", "p")).select("k", "c", "n", (F.col("n") - F.col("alone") - F.col("i")).alias("left"), "p.s"))
    side = lambda k, c, n, left: first.select(F.col("k").alias(k), F.col("c").alias(c), F.col("n").alias(n), F.col("left").alias(left), "s")
    # From the first shingle in common on, each has at most so many left to share.
    enough = F.least("p", "q") + 1e-9 >= least / (1 + least) * (F.col("n") + F.col("m"))
    pairs = side("x", "a", "n", "p").join(side("y", "b", "m", "q"), "s").where("x < y and a <> b").where((F.least("n", "m") + 1e-9) >= least * F.greatest("n", "m")).where(enough)
    pairs = pairs.select("x", "y", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return alike(pairs, sets, least).distinct()


def similar_links(nodes: DataFrame, keyed: DataFrame, texts: DataFrame, least: float, shingle: int, most_bits: int, m: int, crowd: int, anchors: int = 4) -> tuple[DataFrame, DataFrame]:
    """nodes (k, h, sig), keyed (k, fp, c, i, v) -> edges (a, b) between the components c of nodes whose shingle sets
    are alike by ``least`` or more, and the rows (k, i, v) of crowded keys. Candidates share a key and are of
    different components; they are pruned by the ring, then by the whole Hamming distance; signatures settle those
    far from ``least``, the shingle sets of texts (h, text) all others. Where more than ``crowd`` share a key, only
    a few of them are held against all others."""
    sizes = keyed.groupBy("i", "v").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("i", "v", "n")
    shared = cut(keyed.join(sizes, ["i", "v"]))  # few of all keys
    few, many = shared.where(F.col("n") <= crowd), shared.where(F.col("n") > crowd)
    side = lambda rows, *names: rows.select("i", "v", *[F.col(n).alias(m) for n, m in zip(("k", "fp", "c"), names, strict=True)])
    ends = ["x", "f", "a", "y", "g", "b"]
    small = side(few, "x", "f", "a").join(side(few, "y", "g", "b"), ["i", "v"]).where("x < y and a <> b").select(ends)
    # Only three orders for all keys, so that keys with the same members pick the same few of them.
    picks = [F.min(F.struct(F.xxhash64(F.lit(j), F.col("i") % 3, "k").alias("o"), F.col("k").alias("y"), F.col("fp").alias("g"), F.col("c").alias("b"))).alias(f"p{j}") for j in range(anchors)]
    chosen = many.groupBy("i", "v").agg(*picks).select("i", "v", F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"p{j}.{n}") for n in "ygb"]) for j in range(anchors)]))).alias("p")).select("i", "v", "p.*")
    large = side(many, "x", "f", "a").join(chosen, ["i", "v"]).where("x <> y and a <> b").select(ends)
    order = [pick(p, q).alias(n) for pick, p, q, n in ((F.least, "x", "y", "x"), (F.greatest, "x", "y", "y"), (F.least, "a", "b", "a"), (F.greatest, "a", "b", "b"))]
    f, g = F.col("f"), F.col("g")
    pairs = small.unionByName(large).where(ring(f, g, most_bits, m)).where(F.bit_count(f.bitwiseXOR(g)) <= most_bits).select(*order).distinct()
    both = pairs.join(nodes.select(F.col("k").alias("x"), F.col("sig").alias("s")), "x").join(nodes.select(F.col("k").alias("y"), F.col("sig").alias("t")), "y")

    def estimated(batches):
        import numpy as np
        import pyarrow as pa

        for c in batches:
            s, t = (np.frombuffer(b"".join(c.column(n).to_pylist()), dtype=np.uint8).reshape(-1, PERMUTATIONS) for n in ("s", "t"))
            found = ((s == t).mean(axis=1) - 1 / 256) / (1 - 1 / 256)  # unlike bytes are equal once in 256
            yield pa.RecordBatch.from_arrays([*(c.column(n) for n in ("x", "y", "a", "b")), pa.array(found >= least + FAR)], ["x", "y", "a", "b", "sure"]).filter(pa.array(found >= least - FAR))

    held = cut(both.select("x", "y", "a", "b", "s", "t").mapInArrow(estimated, "x long, y long, a long, b long, sure boolean"))
    exact = exact_links(held.where("not sure").drop("sure"), nodes, texts, least, shingle)
    return held.where("sure").select("a", "b").unionByName(exact).distinct(), many.select("k", "i", "v")


def finer_keys(rows: DataFrame, bands: int, width: int) -> DataFrame:
    """rows (k, fp, c, sig) -> (k, fp, c, i, v): keys of ``width`` bytes of the signature, chosen anew for each band."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        entering(__name__)
        rng = np.random.default_rng(width)
        chosen = np.stack([rng.choice(PERMUTATIONS, width, replace=False) for _ in range(bands)])
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, PERMUTATIONS)
            raw = sig[:, chosen].reshape(-1, width)
            v = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in raw], dtype="<u8").view("<i8")
            at = pa.array(np.repeat(np.arange(len(sig)), bands))
            yield pa.RecordBatch.from_arrays([*(b.column(n).take(at) for n in ("k", "fp", "c")), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(sig))), pa.array(v)], ["k", "fp", "c", "i", "v"])

    return rows.where("length(sig) > 0").mapInArrow(run, "k long, fp long, c long, i int, v long")


def similar_components(nodes: DataFrame, texts: DataFrame, least: float = 0.8, shingle: int = 5, most_bits: int = 20, m: int = 4, crowd: int = 16) -> DataFrame:
    """nodes (k, fp, h, keys, sig), k distinct, and texts (h, text) -> (k, c), the least k reachable over
    fingerprints at two bits or fewer and over shingle sets alike by ``least`` or more.

    At that distance fingerprints share no segment that tells them from others, so candidates share a key of
    three least hashes. A key that more than ``crowd`` share is held against a few of its members first, which
    joins groups of near copies in one step. If members of different components remain, they get new keys of six
    least hashes; those that still share a crowded key and are not joined are searched exactly by prefixes of their
    shingle sets."""
    labels = nodes.select("k", "fp", F.col("k").alias("c"))
    keyed = nodes.select("k", "fp", F.col("k").alias("c"), F.posexplode("keys").alias("i", "v"))
    of_fp = cut(nodes.groupBy("fp").agg(F.min("k").alias("rep")))
    more = links(of_fp).unionByName(nodes.select("fp", F.col("k").alias("a")).join(of_fp, "fp").select("a", F.col("rep").alias("b")).where("a <> b"))
    for finer in (FINER, None):
        edges, crowds = similar_links(nodes.select("k", "h", "sig"), keyed, texts, least, shingle, most_bits, m, crowd)
        labels = relabelled(labels, edges if more is None else edges.unionByName(more))
        more = None
        crowded = crowds.join(labels, "k")
        mixed = crowded.groupBy("i", "v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("i", "v")
        open_ = cut(crowded.join(mixed, ["i", "v"], "left_semi").select("k", "fp", "c").distinct())
        if open_.isEmpty():
            return labels
        if finer:
            keyed = stored(finer_keys(open_.join(nodes.select("k", "sig"), "k").select("k", "fp", "c", "sig"), *finer))
    return relabelled(labels, prefix_links(open_.select("k", "c"), nodes, texts, least, shingle))


def relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (k, fp, c) with the components that edges (a, b) between them join."""
    found = components(edges)
    return cut(labels.join(found, F.col("c") == F.col("node"), "left").select("k", "fp", F.coalesce("component", "c").alias("c")))


def similar_groups(df: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As near_groups(), also joining documents whose shingle sets are alike by ``least`` or more; with c, the
    group's own key, also where none of its rows has an id."""
    own = stored(sketches(df, shingle, id_col, text_col).withColumn("k", F.xxhash64("fp", "sig")))
    same = own.groupBy("k").agg(F.min("doc_id").alias("rep"), F.min("h").alias("h"), F.first(F.struct("fp", "keys", "sig")).alias("s"))  # equal for all of a k
    nodes = stored(same.select("k", "rep", "h", "s.*"))
    texts = id_text(df, id_col, text_col).select(F.xxhash64("text").alias("h"), "text")
    found = similar_components(nodes.drop("rep"), texts, least, shingle)
    ids = found.join(nodes.select("k", "rep"), "k").groupBy("c").agg(F.min("rep").alias("component_id"))
    of_k = cut(found.select("k", "c").join(ids, "c"))
    return own.select("doc_id", "fp", "h", "k").join(of_k, "k").select("doc_id", "fp", "h", "component_id", "c")


def near_groups(df: DataFrame, shingle: int = 3, most_bits: int = 2, m: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, h, component_id (the least doc_id reachable over links) for each row of df."""
    own = cut(fingerprints(df, shingle, id_col, text_col))
    nodes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    edges = links(nodes.where("rep is not null"), most_bits, m)
    found = components(edges)
    of_fp = cut(nodes.join(found, nodes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id")))
    return own.join(of_fp, "fp").select("doc_id", "fp", "h", "component_id")


def first_of_groups(df: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without near duplicates: of each group the row with the least id stays (of rows with
    equal ids the one whose text hashes least, of wholly repeated rows one; a null id only where the group has
    no other)."""
    own = cut(similar_groups(df, shingle, least, id_col, text_col))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("h").alias("h")))
    winners = cut(own.groupBy("c").agg(best.alias("b")).select(F.col("b.d").alias("__d"), F.col("b.h").alias("__h")))
    key = df[id_col].cast("long").eqNullSafe(winners["__d"]) & (F.xxhash64(F.coalesce(df[text_col], F.lit(""))) == winners["__h"])
    kept = df.join(winners, key, "left_semi")
    # A second pass over the texts only where rows repeat as a whole.
    again = own.join(winners, own.doc_id.eqNullSafe(winners["__d"]) & (own.h == winners["__h"]), "left_semi").groupBy("doc_id", "h").count().where("count > 1")
    return kept if again.isEmpty() else kept.dropDuplicates([id_col, text_col])


def op4_pigeonring_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
