"""Token counts by heap-and-linked-list byte-pair merging (operator 5).

The initial symbols of a chunk of text are its characters, chained in a linked list. A heap holds every
adjacent pair that the vocabulary can merge; the pair of lowest rank (leftmost on ties) is popped again and
again. Each pop removes one symbol, so the count is the initial symbols less the merges; a character that the
vocabulary lacks counts as its UTF-8 bytes. No identifiers are made.

Cases: null text counts as empty; an empty text has 0 tokens; texts of any length are counted whole; rows that
repeat and null keys are kept, one result for each row; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, documents, id_text

SPACE = "▁"


class PieceCounter:
    """Counts what a sentencepiece BPE model with byte fallback would give for a text."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if model.normalize(" a  b\n") != f"{SPACE}{SPACE}a{SPACE}{SPACE}b\n":
            raise ValueError("only models that keep text as it is and put one space before it are counted here")
        pieces = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in pieces}
        # A chunk ends where no piece can go on: before a space that follows other text, and at a line end.
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in self.rank):
            raise ValueError("this vocabulary has pieces that cross a space or a line end")
        self.chunks = re.compile(f"[ {SPACE}]+[^ {SPACE}\n]*|[^ {SPACE}\n]+")
        self.memo = Memo(self.count_chunk, most=100_000)
        self.memo_parts = Memo(self.count_part, most=400_000)

    def count_chunk(self, chunk: str) -> int:
        symbols: list[str] = list(chunk.replace(" ", SPACE))
        rank, n = self.rank, len(symbols)
        extra = sum(len(c.encode()) - 1 for c in symbols if c not in rank)
        if n == 1:
            return 1 + extra
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, len(p)) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in rank]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, size = heapq.heappop(heap)
            j = following[i]
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one of the two was merged meanwhile
            symbols[i] += symbols[j]
            symbols[j] = ""
            merges += 1
            following[i] = k = following[j]
            if k < n:
                before[k] = i
                if (p := symbols[i] + symbols[k]) in rank:
                    heapq.heappush(heap, (rank[p], i, len(p)))
            if (h := before[i]) >= 0 and (p := symbols[h] + symbols[i]) in rank:
                heapq.heappush(heap, (rank[p], h, len(p)))
        return n + extra - merges

    def count_part(self, part: str) -> int:
        """Of what stands between two single spaces; a line end starts a part of its own, without a space."""
        if part[:1] == "\n":
            return 1 + (self.count_chunk(part[1:]) if len(part) > 1 else 0)
        return self.count_chunk(" " + part)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if text[0] != " " and "  " not in text and SPACE not in text:
            return sum(map(self.memo_parts.__getitem__, text.replace("\n", " \n").split(" ")))
        return text.count("\n") + sum(map(self.memo.__getitem__, self.chunks.findall(" " + text)))


_counters: dict[str, PieceCounter] = {}


def counter(model_path: str) -> PieceCounter:
    """One counter for each worker process."""
    if model_path not in _counters:
        _counters[model_path] = PieceCounter(model_path)
    return _counters[model_path]


def token_counts(df: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). model_path must
    be readable on every executor."""

    def count(batches):
        import pyarrow as pa

        count_text = counter(model_path).count
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(map(count_text, texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = id_text(df, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
