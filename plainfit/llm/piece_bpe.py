"""SentencePiece encoding and decoding of merge-type (BPE) models.

``encode_pieces`` adds exact ids to a table of texts, ``decode_pieces`` turns ids into text again.  The encoder
does not merge pairs over the whole text.  It walks the text with the longest pieces that an Aho-Corasick automaton
finds, checks that each piece may stand beside the one before it (re-merging just those two yields just those two),
tries shorter pieces where it may not, and steps back where none fits, with a bitfield of the positions from which
no encoding continues.  The merge result of a text is the only sequence whose neighbours are all compatible.

Null and empty texts have no ids and decode to the empty text.  Characters without a piece become byte pieces.
Repeated rows give repeated results; further columns of the input are kept, but for those that the result names.  An
empty table gives an empty result.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from .common import text_or_empty, with_columns
from .tokens import Memo, load_once, packing, ship

SPACE = "▁"


class PieceBpe:
    """One model's pieces, read from its file; the library's encoder is not used."""

    _runs = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def __init__(self, raw: bytes, limit: int = 400_000):
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(raw)
        spec, kind = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if model.trainer_spec.model_type != model.trainer_spec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("expected a BPE model with byte fallback and the identity normaliser")
        self.prefix = spec.add_dummy_prefix
        self.piece = [p.piece for p in model.pieces]
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.score = {i: model.pieces[i].score for i in self.id.values()}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.byte_of = {i: b for b, i in self.byte.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.id) or any(c not in self.id for p in self.id for c in p):
            raise ValueError("expected pieces with spaces in front only, whose characters are pieces")
        self.beside = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.fits = Memo(self._fits, 500_000)
        #: Pieces that their own characters merge to; no other piece can stand in a result.
        self.own = {p: i for p, i in self.id.items() if self._fits((-1, i))}
        self.known = frozenset(p for p in self.own if len(p) == 1)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.own.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.size = {i: len(p) for p, i in self.own.items()}
        self.shorter = {i: self._shorter(p) for p, i in self.own.items()}
        self.parts, self.chunks = Memo(self._part, limit), Memo(self._chunk, limit)
        self.text = [(" " * (len(p) - len(q)) + q) if i in self.score else "" for i, p in enumerate(self.piece) for q in [p.lstrip(SPACE)]]
        self.decimal = list(map(str, range(len(self.piece))))
        self.has_bytes = frozenset(self.byte_of)
        self.dtype, self.pack = packing(len(self.piece))

    def _shorter(self, p: str) -> int:
        """The longest piece that is a proper prefix of this one, or -1."""
        return next((self.own[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.own), -1)

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether merging the characters of both pieces, best score first and leftmost at ties, ends in just these two."""
        left, right = pair
        cut = len(self.piece[left]) if left >= 0 else 0
        s = (self.piece[left] if left >= 0 else "") + self.piece[right]
        at = list(range(len(s) + 1))
        while len(at) > 2:
            best, where = None, -1
            for k in range(len(at) - 2):
                if (i := self.id.get(s[at[k] : at[k + 2]])) is not None and (best is None or self.score[i] > best):
                    best, where = self.score[i], k + 1
            if where < 0:
                break
            if at[where] == cut:
                return False
            del at[where]
        return at == ([0, cut, len(s)] if cut else [0, len(s)])

    def merge_free(self, s: str) -> list[int]:
        """Exact ids of a run of known characters by backtracking."""
        if (i := self.own.get(s)) is not None:
            return [i]
        n = len(s)
        longest = [-1] * n
        for end, (size, i) in self.automaton.iter(s):
            longest[end - size + 1] = i
        alive, tokens, pos, token = bytearray(b"\xff") * ((n >> 3) + 1), [], 0, longest[0]
        known, fits, shorter, sizes = self.fits.young, self.fits, self.shorter, self.size
        while pos < n:
            last = tokens[-1] if tokens else -1
            while token >= 0:
                end = pos + sizes[token]
                if alive[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    if (ok := known.get((last, token))) is None:
                        ok, known = fits[last, token], fits.young
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                pos, token = end, longest[end] if end < n else -1
            else:
                alive[pos >> 3] &= ~(1 << (pos & 7))
                if not tokens:
                    raise ValueError("no encoding")
                pos -= sizes[tokens.pop()]
                token = shorter[last]
        return tokens

    def _part(self, part: str) -> bytes:
        if self.known.issuperset(part):
            return self.pack(self.merge_free(part))
        ids, run = [], []
        for c in part:
            if c in self.id:
                run.append(c)
            else:
                ids += self.merge_free("".join(run)) if run else []
                ids += [self.byte[b] for b in c.encode()]
                run = []
        ids += self.merge_free("".join(run)) if run else []
        return self.pack(ids)

    def _chunk(self, chunk: str) -> bytes:
        """A chunk parted where no piece has its two characters side by side."""
        parts, begin, beside = [], 0, self.beside
        for i in range(len(chunk) - 1):
            if chunk[i : i + 2] not in beside:
                parts.append(chunk[begin : i + 1])
                begin = i + 1
        return b"".join(map(self.parts.__getitem__, [*parts, chunk[begin:]]))

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=self.dtype)
        s = ((" " if self.prefix else "") + text).replace(" ", SPACE)
        if SPACE * 2 in s or SPACE in text or not self.prefix:
            keys = self._runs.findall(s)
        else:
            keys = [SPACE + x for x in s[1:].split(SPACE)]
        return np.frombuffer(b"".join(self.chunks.all(keys)), dtype=self.dtype)

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids`` as the library gives it: the dummy space goes, bad bytes become U+FFFD one by one."""
        if not len(ids):
            return ""
        if self.has_bytes.isdisjoint(ids):
            out = "".join(map(self.text.__getitem__, ids))
        else:
            parts, run = [], bytearray()
            for i in [*ids, -1]:
                if (b := self.byte_of.get(i)) is not None:
                    run.append(b)
                    continue
                if run:
                    parts.append(self._bytes(bytes(run)))
                    run.clear()
                if i >= 0:
                    parts.append(self.text[i])
            out = "".join(parts)
        return out[1:] if self.prefix and self.piece[ids[0]].startswith(SPACE) else out

    @staticmethod
    def _bytes(run: bytes) -> str:
        try:
            return run.decode()
        except UnicodeDecodeError:
            out, i = [], 0
            while i < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[i : i + size].decode())
                        i += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    i += 1
            return "".join(out)


def encode_pieces(df: DataFrame, model_path: str, column: str = "text", to: str = "ids") -> DataFrame:
    """``df`` with the exact ids of ``column`` as ``to`` array<int>."""
    raw = ship(df.sparkSession, model_path)

    def make(texts):
        model = load_once(PieceBpe, raw.value)
        return [[model.encode(x).astype(np.int32) for x in texts]]

    return with_columns(df, text_or_empty(column), make, [(to, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))])


def decode_pieces(df: DataFrame, model_path: str, column: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the text of the id array ``column`` as ``to``; null ids give the empty text."""
    raw = ship(df.sparkSession, model_path)

    def make(arrays):
        model = load_once(PieceBpe, raw.value)
        return [[model.decode(x or []) for x in arrays]]

    return with_columns(df, F.col(f"`{column}`"), make, [(to, T.StringType(), pa.string())])
