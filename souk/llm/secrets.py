"""Secret scans: fixed patterns, and a randomness test battery with false-discovery control (operator 2).

Pattern spans are leftmost and non-overlapping for each kind. Beside them, every run of 20 or more letters,
digits and +/_- (with padding) is a candidate. Its encoding is inferred (digits, letters of one case or of both,
hex, base32, else base64), its symbols become numbers in that alphabet, and three tests ask whether a uniform random
string would look so: chi-squared over the alphabet's symbols, the number of runs above and below the middle, and the
lag-one serial correlation, all from one pass over the symbols. The least of the three p-values, times three, is the
candidate's p-value. A discovery is a candidate shown not to be random; over all candidates of the table
discoveries are controlled by a weighted Benjamini-Hochberg rule at level ``fdr``, a candidate's weight in
proportion to its length, since short strings have little power to show anything. Candidates that are not
discovered to be ordinary are reported as ``random`` spans unless a pattern span covers them.

The rule needs only counts of candidates by their p-value on a grid (a bounded number of rows), found in a first
pass; no candidate leaves its task. Everything is DataFrame expressions.

Cases: null text counts as empty; an empty text has no spans; texts of any length are scanned whole; repeated
rows and null keys give one result each; an empty table, or one without candidates, gives no random spans;
other columns are kept by ``scan`` unless they are named like its results, which replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, let

#: The base patterns, in their listed order, with the group and least length that count.
PATTERNS = {
    "assign": (r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # runs of [0-9a-f]+ are maximal, so those of 24+ are the same
}
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABETS = {"digits": "0123456789", "letter": "abcdefghijklmnopqrstuvwxyz", "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Tried in this order; base64 if none fits.
ENCODINGS = {"digits": "^[0-9]+$", "hex": "^([0-9a-f]+|[0-9A-F]+)$", "letter": "^([a-z]+|[A-Z]+)$", "letters": "^[A-Za-z]+$", "base32": "^[A-Z2-7]+$"}
GRID, MOST = 50, 2000


def _found(text: Column, pattern: str) -> Column:
    """Matches as array<struct<start,end,value>>: what stands between them gives their places."""
    lit = F.lit(pattern)
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, lit, F.lit(0)).alias("value"))
    zero = F.array().cast("array<struct<start:int,end:int,value:string>>")
    state = F.struct(F.lit(0).alias("at"), zero.alias("spans"))

    def step(s, x):
        start = s["at"] + F.length(x["gap"])
        return F.when(x["value"].isNull(), s).otherwise(F.struct((start + F.length(x["value"])).alias("at"), F.concat(s["spans"], F.array(F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value")))).alias("spans")))

    return F.when(text.rlike(pattern), F.aggregate(zipped, state, step, lambda s: s["spans"])).otherwise(zero)


def base_spans(text: Column, kind: str) -> Column:
    pattern, group, least = PATTERNS[kind]
    found = _found(text, pattern)
    if kind == "assign":
        found = F.filter(found, lambda x: F.length(F.regexp_extract(x["value"], pattern, group)) >= least)
    else:
        found = F.filter(found, lambda x: F.length(x["value"]) >= least)
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(list(PATTERNS).index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def upper_tail(z: Column) -> Column:
    """1 - Phi(z) by Abramowitz and Stegun's formula 26.2.17 (error below 1e-7)."""

    def tail(x):
        t = x["t"]
        out = F.exp(-x["z"] * x["z"] / 2) * 0.3989422804014327 * t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return let(out, lambda y: F.when(x["z"] >= 0, y).otherwise(1 - y))

    return let(z, lambda v: let(F.struct(v.alias("z"), (F.lit(1.0) / (F.lit(1.0) + F.abs(v) * 0.2316419)).alias("t")), tail))


def battery(value: Column) -> Column:
    """struct<n, p> of a candidate string: its symbols and the p-value of being uniformly random. Work and memory
    grow in proportion to its length."""

    def kind(name: str) -> Column:
        return F.struct(F.lit(ALPHABETS[name]).alias("alphabet"), F.lit(name in ("hex", "letter")).alias("folds"))

    def encoded(body: Column) -> Column:
        found = F
        for name, pattern in ENCODINGS.items():
            found = found.when(body.rlike(pattern), kind(name))
        return let(F.struct(body.alias("body"), found.otherwise(kind("base64")).alias("kind")), folded)

    def folded(x: Column) -> Column:
        text = F.when(x["kind"]["folds"], F.lower(x["body"])).otherwise(x["body"])
        return let(F.struct(text.alias("text"), x["kind"]["alphabet"].alias("alphabet")), counted)

    def counted(x: Column) -> Column:
        size = F.length(x["alphabet"]).cast("double")
        # One pass over the symbols as halves of the unit interval: what runs and serial correlation need.
        u = F.transform(F.split(x["text"], ""), lambda c: (F.position(c, x["alphabet"]) - 0.5) / F.length(x["alphabet"]))
        names = ("n", "high", "runs", "s", "s2", "s12", "first", "last")
        start = F.struct(*[F.lit(0.0).alias(n) for n in names[:6]], *[F.lit(None).cast("double").alias(n) for n in names[6:]])

        def step(a, v):
            turned = F.coalesce(((v >= 0.5) != (a["last"] >= 0.5)).cast("double"), F.lit(1.0))
            now = (a["n"] + 1, a["high"] + (v >= 0.5).cast("double"), a["runs"] + turned, a["s"] + v, a["s2"] + v * v, a["s12"] + F.coalesce(a["last"] * v, F.lit(0.0)), F.coalesce(a["first"], v), v)
            return F.struct(*[c.alias(n) for c, n in zip(now, names, strict=True)])

        squares = F.aggregate(F.split(x["alphabet"], ""), F.lit(0.0), lambda a, c: a + F.pow(F.length(x["text"]) - F.length(F.replace(x["text"], c, F.lit(""))), F.lit(2.0)))
        return let(F.struct(F.aggregate(u, start, step).alias("a"), squares.alias("squares"), size.alias("size")), _tests)

    return let(F.translate(F.rtrim(value, F.lit("=")), "-_", "+/"), encoded)


def _tests(x: Column) -> Column:
    a, df = x["a"], x["size"] - 1
    n = a["n"]
    chi = x["size"] / n * x["squares"] - n  # over the alphabet's symbols
    z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))  # Wilson-Hilferty
    mean = 2 * a["high"] * (n - a["high"]) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    z_runs = F.when(var > 0, F.abs(a["runs"] - mean) / F.sqrt(var))
    mid = a["s"] / n
    around = a["s2"] - n * mid * mid
    along = a["s12"] - mid * (2 * a["s"] - a["first"] - a["last"]) + (n - 1) * mid * mid
    z_serial = F.when(around > n * 1e-12, F.abs(along / around + 1 / n) * F.sqrt(n))
    two = lambda z: F.when(z.isNotNull(), 2 * upper_tail(z)).otherwise(0.0)
    bound = let(F.struct(z_chi.alias("chi"), z_runs.alias("runs"), z_serial.alias("serial"), n.alias("n")), lambda z: F.struct(z["n"].alias("n"), F.least(F.lit(1.0), 3 * F.least(upper_tail(z["chi"]), two(z["runs"]), two(z["serial"]))).alias("p")))
    return bound


def candidates(text: Column) -> Column:
    """array<struct<start,end,n,place>>; place is where p / n stands on a grid of logarithms (higher: less
    random)."""
    place = lambda t: F.least(F.lit(MOST), F.floor(-GRID * F.log10(F.greatest(t["p"], F.lit(1e-30)) / t["n"])).cast("int"))
    return F.transform(_found(text, CANDIDATE), lambda x: let(battery(x["value"]), lambda t: F.struct(x["start"].alias("start"), x["end"].alias("end"), t["n"].alias("n"), place(t).alias("place"))))


def ordinary_from(found: DataFrame, fdr: float) -> DataFrame:
    """found (candidates) -> one row, ``least``: candidates at this place of the grid or above are discovered
    to be ordinary (null: none is)."""
    counts = found.select(F.explode("candidates").alias("c")).groupBy("c.place").agg(F.count("*").alias("k"), F.sum("c.n").alias("n"))
    # As many rows as the grid has places, at most.
    every = Window.partitionBy(F.lit(0))
    cumulated = counts.withColumn("m", F.sum("k").over(every)).withColumn("mean", F.sum("n").over(every) / F.col("m")).withColumn("at_most", F.sum("k").over(every.orderBy(F.col("place").desc())))
    # Weight n / mean: the weighted p-value is p * mean / n, at its largest within a place of the grid.
    weighted = F.pow(F.lit(10.0), -F.col("place") / GRID) * F.col("mean")
    return cumulated.where(weighted <= fdr * F.col("at_most") / F.col("m")).agg(F.min("place").alias("least"))


def scan(df: DataFrame, text_col: str = "text", fdr: float = 0.05) -> DataFrame:
    """df with ``spans``: array<struct<start,rank,end,kind>> of code points (end exclusive), by start, then in
    the order assign, access, hex, random; and ``base``, the pattern spans among them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    least = ordinary_from(df.select(candidates(text).alias("candidates")).where("size(candidates) > 0"), fdr)
    kept = df.drop("spans", "base")
    base = F.array_sort(F.concat(*[base_spans(text, k) for k in PATTERNS]))
    out = kept.withColumns({"base": base, "__candidates": candidates(text)})
    limit = least.scalar()
    random = F.filter("__candidates", lambda c: (c["place"] < F.coalesce(F.col("__least"), F.lit(MOST + 1))) & ~F.exists("base", lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"])))
    spans = F.array_sort(F.concat("base", F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(len(PATTERNS)).alias("rank"), c["end"].alias("end"), F.lit("random").alias("kind")))))
    return out.withColumn("__least", limit).withColumn("spans", spans).drop("__candidates", "__least")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", fdr: float = 0.05) -> DataFrame:
    """df with every span of its texts replaced by mark (overlapping spans by one); a null text stays null."""
    text = F.col(text_col)
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s, x):
        fresh = F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark)).alias("out"), x["end"].alias("at"))
        return F.when(x["start"] >= s["at"], fresh).otherwise(F.struct(s["out"].alias("out"), F.greatest(s["at"], x["end"]).alias("at")))

    clean = F.aggregate("spans", state, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return scan(df, text_col, fdr).withColumn(text_col, F.when(F.size("spans") > 0, clean).otherwise(text)).drop("spans", "base")


def op2_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[n(k) for k in PATTERNS], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
