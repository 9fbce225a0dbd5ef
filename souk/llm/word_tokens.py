"""Words of a text as a lower-casing word-BPE tokenizer file pre-splits them, and their ids.

The file's normalisation (NFC, white space, lower case) and split pattern are applied by one regular
expression where every character is ASCII, a Latin letter or common punctuation; a text with other characters
goes through the library's own normaliser and splitter. Words get their ids from the compiled automaton.
"""

from __future__ import annotations

import json
import re
from functools import cached_property

import numpy as np

from .automaton import MergeAutomaton
from .common import Memo, Recent, entering

#: The split pattern and the normaliser that a tokenizer file must have for the fast path.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = ["NFC", "Replace", "Lowercase"]

_LATIN = "a-zß-öø-ɏ"
#: Characters for which Python's lower() and white space agree with the library, and which NFC leaves alone.
_PLAIN = re.compile("[^\\x00-\\x1b\\x20-\\x7eÀ-ÖØ-öø-įı-ɏ‐-‧‰-⁞]")
_WORDS = re.compile(f"[{_LATIN}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\\s{_LATIN}0-9]+")

#: Characters of text that are encoded at once, and how many chunks are kept for later ones.
SLICE, KEPT, LONGEST = 2_000_000, 150_000, 48


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the rest follow from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordSplitter:
    """Splits texts into words; added tokens of the file stand alone."""

    def __init__(self, path: str, spec: dict):
        self.path = path
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        if kinds != NORMAL or splits[0].get("pattern", {}).get("Regex") != SPLIT or spec["model"]["end_of_word_suffix"] != "</w>":
            raise ValueError("not a lower-casing word-BPE tokenizer file")
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added_re = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        self.letters = byte_letters()
        self.byte = {c: i for i, c in enumerate(self.letters)}
        self.size = max(max(spec["model"]["vocab"].values()), *self.added.values(), 0) + 1

    @cached_property
    def library(self):
        """Loaded only where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def parts(self, text: str) -> list[str]:
        """The text around added tokens and those tokens, in turn."""
        return self.added_re.split(text) if any(x in text for x in self.added) else [text]

    def plain(self, text: str) -> bool:
        return _PLAIN.search(text) is None

    @staticmethod
    def words(text: str) -> list[str]:
        return _WORDS.findall(text)

    def library_words(self, text: str) -> list[bytes]:
        """The library's own words, in bytes."""
        return [bytes(map(self.byte.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]


class WordTokens:
    """Ids of whole texts, as bytes of unsigned 16- or 32-bit numbers, and back."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.split = WordSplitter(path, spec)
        model = spec["model"]
        if spec["decoder"] is not None:
            raise ValueError("only files without a decoder are decoded here")
        self.kind = np.dtype("<u2" if self.split.size <= 1 << 16 else "<u4")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, self.split.letters, model["end_of_word_suffix"])
        self.labels = [""] * self.split.size
        for t, i in (model["vocab"] | self.split.added).items():
            self.labels[i] = t
        self.chunks = Recent(__name__, KEPT)  # what stands between white space; words never reach across it

    def _learn(self, chunks: list[str]) -> list[str]:
        """Puts chunks into the memo, all their new words through the automaton at once; the long ones, which
        are not to stay there."""
        known = self.chunks.young
        single = [c for c in chunks if c.isalpha()]
        mixed = [c for c in chunks if not c.isalpha()]
        words = list(map(self.split.words, mixed))
        new = {w for ws in words for w in ws if w not in known}
        new.difference_update(single)
        single.extend(new)
        known.update(zip(single, self.automaton.encode_words([w.encode() for w in single], self.kind), strict=True))
        find = known.__getitem__
        known.update([(c, b"".join(map(find, ws))) for c, ws in zip(mixed, words, strict=True)])
        return [c for c in (*single, *mixed) if len(c) > LONGEST]

    def _slice(self, texts: list[str]) -> list[bytes]:
        todo = []  # of each text: (kind, value) of its parts
        every: set[str] = set()
        strange: list[list[bytes]] = []
        for text in texts:
            parts = []
            for part in self.split.parts(text):
                if part in self.split.added:
                    parts.append(np.array([self.split.added[part]], dtype=self.kind).tobytes())
                elif self.split.plain(part):
                    chunks = part.lower().split()
                    every.update(chunks)
                    parts.append(chunks)
                else:
                    strange.append(self.split.library_words(part))
                    parts.append(len(strange) - 1)
            todo.append(parts)
        fresh = self.chunks.missing(every)
        long = self._learn(fresh)
        ids = self.automaton.encode_words([w for ws in strange for w in ws], self.kind) if strange else []
        ends = np.cumsum([0, *map(len, strange)]).tolist()
        find = self.chunks.young.__getitem__
        out = [b"".join([p if isinstance(p, bytes) else b"".join(ids[ends[p] : ends[p + 1]]) if isinstance(p, int) else b"".join(map(find, p)) for p in parts]) for parts in todo]
        for c in long:
            del self.chunks.young[c]
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        out, held, size = [], [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= SLICE:
                out += self._slice(held)
                held, size = [], 0
        return out + self._slice(held)

    def encode(self, text: str) -> bytes:
        return self._slice([text])[0]

    def numbers(self, ids: bytes):
        return np.frombuffer(ids, dtype=self.kind)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.labels.__getitem__, self.numbers(ids).tolist()))


class Loaded(dict):
    """Tokenizers by path, one for each worker process; dropped when another operator's stage begins."""

    owner = __name__

    def __missing__(self, path: str) -> WordTokens:
        self[path] = made = WordTokens(path)
        return made

    def forget(self) -> None:
        self.clear()


_loaded = Loaded()
Memo.made.append(_loaded)


def word_tokens(path: str) -> WordTokens:
    entering(__name__)
    return _loaded[path]
