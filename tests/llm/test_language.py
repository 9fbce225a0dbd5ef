"""Language identification: the forward pass against every segmentation, expected counts likewise, held-out accuracy."""

import itertools
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from souk.llm import language as L

PATH = P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, n_words long, score string, piece string, word int, n string"


def segmentations(marked, place):
    for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(marked)]
        parts = [marked[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        rows = [place.get(x, 0 if len(x) == 1 else None) for x in parts]
        if None not in rows:
            yield rows


@pytest.fixture(scope="module")
def unigrams():
    vocabulary = ["", *sorted({L.MARK, L.MARK + "th", "th", "h", "he", "the", "e", "t", "r", "er", "ere", L.MARK + "t", "é", "ßh"})]
    table = np.random.default_rng(1).random((len(vocabulary), 3))
    return L.Unigrams(vocabulary, table / table.sum(axis=0))


WORDS = ["the", "there", "é", "t", "zzz", "thßhe", "eeee", "日本", "hethere"]


def test_forward_sums_all_segmentations(unigrams):
    want = [np.log(sum(np.prod(unigrams.table[rows], axis=0) for rows in segmentations(L.MARK + w, unigrams.place))) for w in WORDS]
    assert np.allclose(unigrams.forward(WORDS), want)
    assert np.allclose([unigrams.forward_long(w) for w in WORDS], want)


def test_long_words_do_not_underflow(unigrams):
    one, two = (unigrams.forward_long("there" * n) for n in (300, 600))
    assert np.isfinite(one).all() and np.allclose(two / one, 2, rtol=0.01)
    assert np.isfinite(unigrams.forward(["x" * 10_000, "the"])).all()


def test_expected_counts_over_all_segmentations(unigrams):
    counts = [3, 1, 2, 5, 1, 1, 1, 4, 2]
    want = np.zeros(unigrams.none)
    for w, n in zip(WORDS, counts, strict=True):
        found = list(segmentations(L.MARK + w, unigrams.place))
        p = np.array([np.prod(unigrams.table[rows, 1]) for rows in found])
        for rows, x in zip(found, n * p / p.sum(), strict=True):
            np.add.at(want, rows, x)
    assert np.allclose(unigrams.expected(WORDS, counts, 1), want)


def test_words():
    assert L.words_of("The ²³ a²b x_y 12c Ünï-日本") == ["the", "a", "b", "x", "y", "c", "ünï", "日本"]
    assert L.words_of("² 12 _ !") == []


def test_vocabulary_is_lower_case_letters():
    found = L.pieces(PATH)
    assert found[0] == "" and len(found) == len(set(found)) > 20_000
    assert all(x == x.lower() for x in found) and L.MARK + "the" in found


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.op13_segmentation_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    tested = [r for r in got if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert len(tested) > 150 and sum(r.lang == r.lang_pred for r in tested) >= 0.97 * len(tested)


def test_only_rows_that_may_teach_are_learned_from(spark):
    ids = range(400)
    out = [i for i in ids if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "le la de une que" if i % 2 else "the of and with", "held" if i in out else "fr" if i % 2 else "en") for i in ids]
    rows += [(None, "zz", "none"), (1000, None, "empty"), (1004, "the", None)]
    df = spark.createDataFrame([(*r, 1, "x", "x", 1, "x") for r in rows], SCHEMA)
    model = L.fit(df, PATH)
    assert model.langs == ["en", "fr"]
    again = L.fit(df.repartition(5), PATH)
    assert np.array_equal(model.table, again.table)
    got = L.predict(df, model).collect()
    assert len(got) == len(rows)
    assert all(r.lang_pred == ("fr" if r.doc_id % 2 else "en") for r in got if r.doc_id is not None and r.doc_id < 400)


def test_sample_is_bounded_and_the_same_for_any_partitioning(spark):
    df = spark.createDataFrame([(i, f"word{'abc'[i % 3]} x", "a" if i % 3 else "b", 1, "x", "x", 1, "x") for i in range(3000)], SCHEMA)
    rows = L.learned_rows(df)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    some = L.counted_words(rows, counts, 50).collect()
    assert {lang: sum(r.n for r in some if r.lang == lang) for lang in "ab"} == {"a": 100, "b": 100}
    assert sorted(some) == sorted(L.counted_words(rows.repartition(7), counts, 50).collect())


def test_odd_texts_and_no_labels(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (4, "the " * 50_000, "en"), (None, "the of", "en"), (5, "x" * 70_000, None), (5, "x" * 70_000, None), (0, "the cat", "en")]
    df = spark.createDataFrame([(*r, 1, "x", "x", 1, "x") for r in rows], SCHEMA)
    got = L.predict(df, L.fit(df, PATH)).collect()
    assert len(got) == len(rows)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3)} == {("und", 0.0)}
    assert {r.lang_pred for r in got if r.doc_id not in (1, 2, 3)} == {"en"}
    none = L.predict(df, L.fit(df.where("lang is null"), PATH)).collect()
    assert len(none) == len(rows) and {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert L.predict(df.limit(0), None).isEmpty() and L.fit(df.limit(0), PATH) is None
