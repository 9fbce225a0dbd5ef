"""BPE encoding and decoding by a tokenization automaton (operator 10).

The automaton's arcs are labelled with tokens and its paths spell exactly the correct tokenizations. It starts
as one state with a loop for every base symbol. Each merge (u, v) -> w, in rank order, adds a gadget: the state
that u leads to loses its arc v (it is split off first where other tokens lead to it too), and every state that
has u gains the arc w, to where v led. So the state after a token depends on the token alone.

The finished automaton is compiled into arrays once for each worker: a bit for every state and token that says
whether the arc is there, the state that each token leads to, and a trie of the arcs' labels over bytes. Words
are encoded by stepping through these tables, all new words of a batch at once: each prefix of a word has one
correct tokenization, so each place of a word is reached by one arc. Decoding emits the labels of the arcs,
joined as the tokenizer file says (no decoder: by spaces).

Cases: null text is empty; empty text has no ids and decodes to the empty string; texts of any length are
encoded whole; repeated rows and null keys give one result each; an empty table an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import documents, id_text
from .word_tokens import WordTokens, word_tokens


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> and decoded string for each row of df."""

    def run(batches):
        import pyarrow as pa

        t = word_tokens(path)
        for batch in batches:
            ids = t.encode_many(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.numbers(x) for x in ids], pa.list_(pa.int32())), pa.array(map(t.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode(), with digests made where the ids are, so that neither ids nor texts leave the worker:
    doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit), decoded_sha256."""

    def run(batches):
        import pyarrow as pa

        t: WordTokens = word_tokens(path)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for ids in t.encode_many(batch.column("text").to_pylist()):
                wide = t.numbers(ids).astype("<u4")
                n.append(len(wide))
                of_ids.append(hashlib.sha256(wide.tobytes()).hexdigest())
                of_text.append(hashlib.sha256(t.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
