"""Text to token ids with public vocabularies, fast enough for whole corpora.

A text is cut where no token of the vocabulary can cross, each piece is encoded once and remembered in a bounded
memo, and a text's ids are the pieces' packed ids joined.  Results equal the libraries' on the whole text.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from pathlib import Path

import numpy as np
import regex
import tiktoken
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

#: The pre-tokenisation patterns that the two vocabularies were made with (fixed values).
BYTE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


def printable_bytes() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else the next free one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Memo:
    """A bounded memo of two generations: when the young one is full it becomes the old one, and hits come back."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.young, self.old = make, limit, {}, {}

    def __getitem__(self, key):
        if (got := self.young.get(key)) is None:
            if (got := self.old.get(key)) is None:
                got = self.make(key)
            if len(self.young) >= self.limit:
                self.young, self.old = {}, self.young
            self.young[key] = got
        return got

    def all(self, keys: list) -> list:
        got = list(map(self.young.get, keys))
        if None in got:
            find = self.__getitem__
            got = [find(keys[i]) if v is None else v for i, v in enumerate(got)]
        return got


def packing(size: int):
    """The little-endian unsigned type that holds ids below ``size``, and a function from a list of ids to its bytes."""
    dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
    code = "H" if dtype.itemsize == 2 else "I"
    if array(code).itemsize != dtype.itemsize or sys.byteorder != "little":
        return dtype, lambda ids: np.array(ids, dtype=dtype).tobytes()
    return dtype, lambda ids: array(code, ids).tobytes()


class ByteBpe:
    """Byte-level BPE of a ``tokenizers`` file.  ``encode`` gives little-endian unsigned 16-bit ids, ``width`` bytes each.

    Cuts lie before each space that follows a non-space: the pre-tokens of this pattern never cross there.
    """

    _cut = re.compile(r"(?<=\S)(?= )")
    _odd = re.compile(r"\s ")

    def __init__(self, raw: bytes, limit: int = 150_000):
        spec = json.loads(raw)
        model, back = spec["model"], {c: b for b, c in enumerate(printable_bytes())}
        self.whole = Tokenizer.from_str(raw.decode())
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        if any(model["vocab"]["".join(m)] != 256 + i for i, m in enumerate(model["merges"])) or spec["normalizer"]:
            raise ValueError("expected a byte-level vocabulary whose ids follow its merges")
        self.size = max([*ranks.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.dtype, self.pack = packing(self.size)
        self.plain = tiktoken.Encoding("plain", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memo = Memo(self._chunk, limit)
        #: Pre-tokens of their own after a letter, and a line end before a non-space.
        self.stop = {c: self.pack(self.plain.encode_ordinary(c)) for c in ".,;:!?\n"}

    def _chunk(self, key: str) -> bytes:
        if key[-1:] in self.stop and key[:-1].isalpha():
            return self.memo[key[:-1]] + self.stop[key[-1]]
        a, line, b = key.partition("\n")
        if line and a and b and not a[-1].isspace() and not b[0].isspace():
            return self.memo[a] + self.stop["\n"] + self.memo["\0" + b]
        text = key[1:] if key[:1] == "\0" else " " + key
        if any(s in text for s in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        elif key.isalpha():
            ids = self.plain._encode_single_piece(text.encode())
        else:
            ids = self.plain.encode_ordinary(text)
        return self.pack(ids)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=self.dtype)
        if self._odd.search(text) or "\0" in text:
            keys = ["\0" + x for x in self._cut.split(text)]
        else:
            keys = text.split(" ")
            keys[0] = "\0" + keys[0]
        return np.frombuffer(b"".join(self.memo.all(keys)), dtype=self.dtype)


class WordBpe:
    """Lower-case BPE with word ends of a ``tokenizers`` file; white space parts tokens and is dropped."""

    _words = regex.compile(WORD_PATTERN)

    def __init__(self, raw: bytes, limit: int = 400_000):
        spec = json.loads(raw)
        self.whole = Tokenizer.from_str(raw.decode())
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.dtype, self.pack = packing(self.size)
        self.shown = printable_bytes()
        self.memo, self.words = Memo(self._chunk, limit), Memo(self._word, limit)

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join(map(self.shown.__getitem__, word.encode()))
        return self.pack([t.id for t in self.whole.model.tokenize(word)])

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if not chunk.isprintable() or "Σ" in chunk or any(s in chunk for s in self.special):
            return self.pack(self.whole.encode(chunk, add_special_tokens=False).ids)
        low = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).lower()
        if low.isalpha():
            return self.words[low]
        return b"".join(map(self.words.__getitem__, self._words.findall(low)))

    def encode_bytes(self, text: str) -> bytes:
        return b"".join(self.memo.all(text.replace("\n", " ").split(" ")))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype=self.dtype)


_loaded: dict[tuple, object] = {}


def load_once(kind: type, raw: bytes):
    """One encoder for each Python worker and vocabulary, kept between its tasks."""
    key = (kind.__name__, hashlib.sha256(raw).digest())
    if key not in _loaded:
        _loaded[key] = kind(raw)
    return _loaded[key]


def ship(spark: SparkSession, path: str):
    """The vocabulary file's bytes as a broadcast.  Its size is that of one vocabulary and checked here."""
    raw = Path(path).read_bytes()
    if len(raw) > 64 << 20:
        raise ValueError("a vocabulary file of at most 64 MB is expected")
    return spark.sparkContext.broadcast(raw)
