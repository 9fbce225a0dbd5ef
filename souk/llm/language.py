"""Language identification by segmentation-marginalised unigrams (operator 13).

Words are runs of letters in lower case behind a word mark. Every language has its own probabilities of the pieces of
one fixed public vocabulary (those of letters only, in lower case; one more piece stands for any letter that is no
piece). A word's probability is the sum over all its segmentations into pieces of the product of their probabilities,
by a forward pass; a text's is the product over its words, times the language's share of the documents learned from.

The probabilities are fitted by expectation maximisation from uniform ones: each round a forward and a backward pass
over the counted words of every language give the expected number of each piece, added up in Spark. Words are counted
in at most ``docs_a_lang`` documents of each of the ``most_langs`` most frequent languages, those of least hashed id,
so any size of table gives the same kind of sample. Scoring covers every whole text in one pass without a shuffle.

Cases: a null text, or one without letters, is ``und`` with score 0, and so is every text if nothing can be learned;
rows with null text, null id or null language teach nothing; an empty language is one like any other; a null id is not
held out; words and texts of any length count whole; equal likelihoods go to the lesser name; repeated rows are kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, entering, stored

DOCS_A_LANG, MOST_LANGS, ROUNDS, SMOOTH = 400, 256, 4, 0.1
MARK, UNKNOWN = "▁", ""
#: Longer words pass one by one; words of a slice are scored at once, and this many are remembered.
LONG, SLICE, KEPT = 60, 2_000_000, 300_000
#: Odd, so that no letter of a run is lost from its 64-bit hash.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = re.compile(r"[^\W\d_]+")


def pieces(path: str) -> list[str]:
    """The vocabulary's pieces of letters in lower case; the first, empty, stands for unknown letters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    return [UNKNOWN, *sorted(x for x in found if x == MARK or x.removeprefix(MARK).isalpha())]


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, in lower case."""
    found = _LETTERS.findall(text.lower())
    if not "".join(found).isalpha():  # digits that are no decimals count as word characters there
        found = [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]
    return found


class Unigrams:
    """Piece probabilities of each language (rows: pieces, columns: languages) with the passes over words."""

    def __init__(self, vocabulary: list[str], table):
        self.place = {x: i for i, x in enumerate(vocabulary)}
        self.longest = max(map(len, vocabulary))
        self.none = len(vocabulary)  # a last row of zeros: no such piece
        self.table = np.vstack([table, np.zeros((1, table.shape[1]))])
        hashes = np.array([self._hash(x) for x in vocabulary], np.uint64)
        self.rows = hashes.argsort().astype(np.int32)
        self.hashes = np.append(hashes[self.rows], np.uint64(2**64 - 1))
        self.rows = np.append(self.rows, np.int32(self.none))

    @staticmethod
    def _hash(piece: str) -> int:
        out = 0
        for c in piece:
            out = (out * int(_BASE) + ord(c)) % 2**64
        return out

    def lattice(self, words: list[str], size: int):
        """For each span of _spans(size) the piece's row in each of words, all of ``size`` letters with the mark."""
        letters = np.full((size, len(words)), ord(MARK), np.uint64)
        letters[1:] = np.array(words, f"U{size - 1}").view(np.uint32).reshape(len(words), size - 1).T
        out, hashes = {}, np.zeros((size + 1, len(words)), np.uint64)
        for k in range(1, min(size, self.longest) + 1):
            hashes = hashes[: size - k + 1] * _BASE + letters[k - 1 :]  # of the runs of k letters, by their start
            at = self.hashes.searchsorted(hashes)
            found = np.where(self.hashes[at] == hashes, self.rows[at], self.none if k > 1 else 0)
            for start in range(size - k + 1):
                out[start + k, k] = found[start]
        return out

    def _groups(self, words):
        by = defaultdict(list)
        for i, w in enumerate(words):
            by[len(w) + 1].append(i)
        for size, own in sorted(by.items()):
            step = max(1, 200_000 // size)
            for a in range(0, len(own), step):
                yield size, own[a : a + step]

    def _spans(self, size: int):
        """(end, length) of all pieces that may be in a word of that size, by ascending end."""
        return [(end, k) for end in range(1, size + 1) for k in range(1, min(end, self.longest) + 1)]

    def forward(self, words: list[str]):
        """Log probability of each word in each language."""
        out = np.empty((len(words), self.table.shape[1]))
        for size, own in self._groups(words):
            if size > LONG:
                for i in own:
                    out[i] = self.forward_long(words[i])
                continue
            lattice = self.lattice([words[i] for i in own], size)
            alpha = np.zeros((size + 1, len(own), self.table.shape[1]))
            alpha[0] = 1
            for end, k in self._spans(size):
                row = lattice[end, k]
                some = np.flatnonzero(row != self.none)
                if len(some):
                    alpha[end, some] += alpha[end - k, some] * self.table[row[some]]
            out[own] = np.log(np.maximum(alpha[size], 1e-300))
        return out

    def forward_long(self, word: str):
        """As forward(), for one word of any length, with the last few sums kept in range."""
        x = MARK + word
        recent, log = [np.ones(self.table.shape[1])], np.zeros(self.table.shape[1])
        for end in range(1, len(x) + 1):
            sums = recent[-1] * self.table[self.place.get(x[end - 1], 0)]
            for k in range(2, min(len(recent), self.longest) + 1):
                row = self.place.get(x[end - k : end])
                if row is not None:
                    sums = sums + recent[-k] * self.table[row]
            recent = [*recent[-self.longest + 1 :], sums]
            if sums.min() < 1e-100:
                scale = np.maximum(sums, 1e-280)
                recent, log = [r / scale for r in recent], log + np.log(scale)
        return log + np.log(np.maximum(recent[-1], 1e-300))

    def expected(self, words: list[str], counts, lang: int):
        """The expected number of each piece over all segmentations of words, each counted so many times."""
        table, out = self.table[:, lang], np.zeros(self.none + 1)
        for size, own in self._groups(words):
            lattice, spans = self.lattice([words[i] for i in own], size), self._spans(size)
            held = {x: some for x in spans if len(some := np.flatnonzero(lattice[x] != self.none))}
            alpha, beta = np.zeros((2, size + 1, len(own)))
            alpha[0] = beta[size] = 1
            p = {x: table[lattice[x][some]] for x, some in held.items()}
            for (end, k), some in held.items():
                alpha[end, some] += alpha[end - k, some] * p[end, k]
            for (end, k), some in reversed(held.items()):
                beta[end - k, some] += beta[end, some] * p[end, k]
            share = np.asarray(counts)[own] / np.maximum(alpha[size], 1e-300)
            rows = np.concatenate([lattice[x][some] for x, some in held.items()])
            weights = np.concatenate([alpha[end - k, some] * p[end, k] * beta[end, some] * share[some] for (end, k), some in held.items()])
            out += np.bincount(rows, weights=weights, minlength=len(out))
        return out[:-1]


class Model:
    """Languages in order of their names, log shares, vocabulary and probabilities."""

    def __init__(self, langs: list[str], prior, vocabulary: list[str], table):
        self.langs, self.prior, self.vocabulary, self.table = langs, prior, vocabulary, table


def held_out(id_: Column) -> Column:
    """Whether crc32 of the decimal id leaves 2 modulo 4; not for a null id."""
    return F.coalesce(F.crc32(id_.cast("long").cast("string")) % 4 == 2, F.lit(False))


def learned_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, text) of the rows that may teach."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))


def counted_words(rows: DataFrame, langs: dict[str, int], docs_a_lang: int) -> DataFrame:
    """(lang, word, n) in at most docs_a_lang rows of each language; langs: how many rows each has."""
    # First a share of about twice as many, then the least hashes among these few.
    share = F.element_at(F.create_map(*[F.lit(x) for name, n in langs.items() for x in (name, min(1.0, (2 * docs_a_lang + 50) / n))]), F.col("lang"))
    order = F.xxhash64("doc_id")
    some = rows.where(F.col("lang").isin(list(langs))).where(F.pmod(order, F.lit(1 << 30)) < share * (1 << 30))
    number = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id", F.xxhash64("text")))
    chosen = some.withColumn("number", number).where(F.col("number") <= docs_a_lang).select("lang", "text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            by = defaultdict(Counter)
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                by[lang].update(w for w in words_of(text.as_py()) if len(w) < LONG)
            rows = [(lang, w, n) for lang, found in by.items() for w, n in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    return chosen.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, path: str, docs_a_lang: int = DOCS_A_LANG, most_langs: int = MOST_LANGS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The model learned from df's rows; None if no row can teach. Only its table, pieces by languages, reaches the
    driver."""
    rows = learned_rows(df, id_col, text_col, lang_col)
    found = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(most_langs).collect()}
    if not found:
        return None
    langs, vocabulary = sorted(found), pieces(path)
    prior = np.log(np.array([found[x] for x in langs]) / sum(found.values()))
    column = {x: i for i, x in enumerate(langs)}
    counted = stored(counted_words(rows, found, docs_a_lang))
    table = np.full((len(vocabulary), len(langs)), 1 / len(vocabulary))
    for _ in range(rounds):

        def run(batches, table=table):
            import pyarrow as pa

            own, total = Unigrams(vocabulary, table), np.zeros(table.shape)
            for b in batches:
                names, words, n = b.column("lang").to_pylist(), b.column("word").to_pylist(), b.column("n").to_numpy()
                by = defaultdict(list)
                for i, name in enumerate(names):
                    by[name].append(i)
                for name, at in by.items():
                    total[:, column[name]] += own.expected([words[i] for i in at], n[at], column[name])
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype("i4")), pa.array(lang.astype("i4")), pa.array(np.round(total[piece, lang] * 2**20).astype("i8"))], ["piece", "lang", "n"])

        # Whole numbers, so that the sum does not depend on its order.
        sums = counted.mapInArrow(run, "piece int, lang int, n long").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        table = np.full(table.shape, SMOOTH)
        table[sums["piece"], sums["lang"]] += sums["n"] / 2**20
        table /= table.sum(axis=0)
    return Model(langs, prior, vocabulary, table)


class Known:
    """Log probabilities of the words met so far; all are dropped when they are too many."""

    def __init__(self, unigrams: Unigrams, most: int = KEPT):
        self.unigrams, self.most = unigrams, most
        self.forget()

    def forget(self) -> None:
        self.row, self.logs = {}, np.zeros((0, self.unigrams.table.shape[1]))

    def sums(self, texts: list[list[str]]):
        """The sum of the words' logs of each text."""
        if len(self.row) > self.most:
            self.forget()
        fresh = list(set().union(*texts).difference(self.row))
        if fresh:
            self.row.update(zip(fresh, range(len(self.row), len(self.row) + len(fresh)), strict=True))
            self.logs = np.concatenate([self.logs, self.unigrams.forward(fresh)])
        get = self.row.__getitem__
        return np.array([self.logs[np.fromiter(map(get, x), np.int64, len(x))].sum(axis=0) for x in texts])


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the language's probability given the text) and n_words for each row of df."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_words"))

    def run(batches):
        import pyarrow as pa

        entering(__name__)
        known = Known(Unigrams(model.vocabulary, model.table))

        def batch(ids, texts):
            sums = known.sums(texts) + model.prior if texts else np.zeros((0, len(model.langs)))
            best = sums.argmax(axis=1)
            score = 1 / np.exp(np.minimum(sums - sums.max(axis=1, keepdims=True), 0)).sum(axis=1)
            langs = [model.langs[i] if x else "und" for i, x in zip(best, texts, strict=True)]
            scores = np.where([len(x) > 0 for x in texts], score, 0.0).astype(float)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(scores), pa.array([len(x) for x in texts], pa.int64())], ["doc_id", "lang_pred", "score", "n_words"])

        for b in batches:
            ids, texts, size = [], [], 0
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = text.as_py() or ""
                ids.append(i)
                texts.append(words_of(text))
                size += len(text)
                if size > SLICE:
                    yield batch(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield batch(ids, texts)

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, n_words long")


def op13_segmentation_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
