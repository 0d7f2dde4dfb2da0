"""SentencePiece encoding and decoding through a merge-type prefix table.

For every prefix of a segment the table stores the one piece that ends the prefix's encoding. A piece that an
automaton finds to end at position i and to start at j can be that piece only if it may stand right of the piece
stored for prefix j, which a pair-compatibility test decides by undoing the merges at the border. The ids are then
read off backwards. The work is linear in the text (times the pieces that end at a position).

White space starts a segment: no piece of the vocabularies accepted here has the space mark after another
character, so nothing merges across such a border and segments can be encoded apart and remembered.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fathomline.llm.common import column_values, give_back, per_row

#: How SentencePiece writes a space, and the types of pieces in its model format. Fixed values of the format.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_ATOM = -1


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(data):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        else:
            if kind == 2:
                size, at = number(at)
            else:
                size = {1: 8, 5: 4}[kind]
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class PieceModel:
    """A byte-fallback BPE vocabulary from the bytes of a ``.model`` file, with an encoder and a decoder."""

    def __init__(self, data: bytes, remembered: int = 300_000):
        message = list(_fields(data))
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        for number, value in message:
            if number == 1:
                got = dict(_fields(value))
                self.pieces.append(got.get(1, b"").decode())
                scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
                self.kinds.append(got.get(3, NORMAL))
        norm = dict(next((_fields(v) for n, v in message if n == 3), iter(())))
        trainer = dict(next((_fields(v) for n, v in message if n == 2), iter(())))
        if trainer.get(3) != 2 or norm.get(2) or norm.get(4, 1):
            raise ValueError("only BPE models with the identity normalizer that keep all white space are supported")
        if USER_DEFINED in self.kinds:
            raise ValueError("models with user-defined pieces aren't supported")
        self.prefix = MARK if norm.get(3, 1) else ""
        self.bytes_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes_ids.items()}
        if len(self.bytes_ids) != 256:
            raise ValueError("the model has no byte fallback")
        usable = [(i, p) for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL]
        if any(MARK in p.lstrip(MARK) for _, p in usable):
            raise ValueError("a piece crosses a space")
        self.id_of = {p: i for i, p in usable}
        # Merges happen from the best score down; single characters exist from the start.
        order = sorted((i for i, p in usable if len(p) > 1), key=lambda i: -scores[i])
        self.rank = {p: _ATOM for _, p in usable if len(p) == 1} | {self.pieces[i]: r for r, i in enumerate(order)}
        self.split: dict[str, tuple[str, str]] = {}
        for i in order:
            piece = self.pieces[i]
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if self._known(left) and self._known(right) and self._apart(left, right, self.rank[piece]):
                    self.split[piece] = (left, right)
                    break
        self.automaton = ahocorasick.Automaton()
        for piece in self.rank:
            if self._known(piece):
                self.automaton.add_word(piece, (self.id_of[piece], len(piece)))
        self.automaton.make_automaton()
        self.characters = frozenset(p for p in self.id_of if len(p) == 1)
        self.spaced = [p.replace(MARK, " ") if k != CONTROL else "" for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.lengths, self.names = list(map(len, self.pieces)), list(map(str, range(len(self.pieces))))
        self.byte_ids = frozenset(self.byte_of)
        #: Pairs that were tested; segments that were encoded lately, and those before them. Of a segment its ids as text
        #: are kept, and what they decode to only if that isn't the segment itself.
        self.fits: dict[int, bool] = {}
        self.remembered = remembered
        self.memory: dict[str, str | tuple[str, str]] = {}
        self.older: dict[str, str | tuple[str, str]] = {}

    def forget(self, most: int = 50_000) -> None:
        """Lets go of what was learned from texts, if that is over ``most`` segments or pairs: Python workers live on for
        the tasks of other operators."""
        if max(len(self.fits), len(self.memory) + len(self.older)) > most:
            self.fits, self.memory, self.older = {}, {}, {}

    def _known(self, piece: str) -> bool:
        """A character of the vocabulary, or a piece that its own characters merge to."""
        return self.rank.get(piece) == _ATOM or piece in self.split

    def _apart(self, left: str, right: str, limit: float = float("inf")) -> bool:
        """Whether no merge of a rank under ``limit`` crosses the border, found by undoing the latest merge again and again."""
        rank, split = self.rank, self.split
        while True:
            joined = rank.get(left + right)
            if joined is not None and joined < limit:
                return False
            a, b = rank[left], rank[right]
            if a == b == _ATOM:
                return True
            if a > b:
                limit, left = a, split[left][1]
            else:  # of two equal merges the left one happens first
                limit, right = b + 1, split[right][0]

    def may_follow(self, left: int, right: int) -> bool:
        """Pair compatibility: the text of the two pieces is encoded as these two pieces."""
        key = left << 32 | right
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= 8 * self.remembered:
                self.fits.clear()
            found = self.fits[key] = self._apart(self.pieces[left], self.pieces[right])
        return found

    def _runs(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that consist of characters of the vocabulary, each encoded apart, in one pass of the automaton.

        The texts stand in a row: where one begins any piece may. All but a single text begin with the mark of a space
        and end otherwise, so no piece reaches from one into the next."""
        row = "".join(texts)
        last, opens, at = [-1] * (len(row) + 1), bytearray(len(row) + 1), 0
        for t in texts:
            opens[at] = 1
            at += len(t)
        known, follow = self.fits.get, self.may_follow
        for end, (piece, size) in self.automaton.iter(row):
            end += 1
            if last[end] < 0:
                start = end - size
                if opens[start]:
                    last[end] = piece
                elif (before := last[start]) >= 0:
                    fits = known(before << 32 | piece)
                    if fits or fits is None and follow(before, piece):
                        last[end] = piece
        out, lengths, at = [], self.lengths, 0
        for t in texts:
            start, at = at, at + len(t)
            ids, k = [], at
            while k > start:
                piece = last[k]
                ids.append(piece)
                k -= lengths[piece]
            ids.reverse()
            out.append(ids)
        return out

    def _run(self, text: str) -> list[int]:
        return self._runs([text])[0]

    def _segment(self, text: str) -> list[int]:
        if self.characters.issuperset(text):
            return self._run(text)
        ids: list[int] = []
        start = 0
        for at, char in enumerate(text):
            if char not in self.characters:
                if at > start:
                    ids += self._run(text[start:at])
                ids += [self.bytes_ids[b] for b in char.encode()]
                start = at + 1
        return ids + self._run(text[start:]) if start < len(text) else ids

    def _pieces_text(self, ids: Iterable[int]) -> str:
        """Text of ids with each mark turned into a space; the bytes of a run of byte pieces are decoded together."""
        ids = list(ids)
        if self.byte_ids.isdisjoint(ids):
            return "".join([self.spaced[i] for i in ids])
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run.clear()
            out.append(self.spaced[i])
        if run:
            out.append(run.decode(errors="replace"))
        return "".join(out)

    def _remember(self, segment: str, ids: list[int]) -> str | tuple[str, str]:
        names = self.names
        found, decoded = ",".join([names[i] for i in ids]), self._pieces_text(ids)
        if decoded != segment.replace(MARK, " "):
            found = (found, decoded)
        if len(segment) <= 64:  # long segments are rare and would fill the memory
            if len(self.memory) >= self.remembered:
                self.older, self.memory = self.memory, {}
            self.memory[segment] = found
        return found

    def _learned(self, segments: set[str]) -> dict[str, str | tuple[str, str]]:
        """What segments that aren't remembered give: those of known characters together, but for what doesn't begin with
        a space or ends with one, over whose end a piece of several spaces could reach."""
        older, known = self.older.get, self.characters.issuperset
        out: dict[str, str | tuple[str, str]] = {}
        together = []
        for s in segments:
            found = older(s)
            if found is not None:
                out[s] = self.memory[s] = found
            elif s[0] == MARK != s[-1] and known(s):
                together.append(s)
            else:
                out[s] = self._remember(s, self._segment(s))
        for s, ids in zip(together, self._runs(together), strict=True):
            out[s] = self._remember(s, ids)
        return out

    def _whole(self, text: str) -> tuple[str, str]:
        """(the ids joined by commas, the text they decode to with the prefix)."""
        if not text:
            return "", ""
        marked = self.prefix + text.replace(" ", MARK)
        segments = _SEGMENT.findall(marked)
        parts = list(map(self.memory.get, segments))
        if None in parts:
            new = self._learned({s for s, p in zip(segments, parts, strict=True) if p is None})
            parts = [new[s] if p is None else p for s, p in zip(segments, parts, strict=True)]
        if set(map(type, parts)) == {str}:
            return ",".join(parts), marked.replace(MARK, " ")
        pairs = [(p, s.replace(MARK, " ")) if isinstance(p, str) else p for s, p in zip(segments, parts, strict=True)]
        return ",".join([p[0] for p in pairs]), "".join([p[1] for p in pairs])

    def _without_prefix(self, text: str) -> str:
        return text[1:] if self.prefix and text[:1] == " " else text

    def encode(self, text: str) -> list[int]:
        joined = self._whole(text)[0]
        return list(map(int, joined.split(","))) if joined else []

    def decode(self, ids: Iterable[int]) -> str:
        return self._without_prefix(self._pieces_text(ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, the ids joined by commas, the text they decode to)."""
        joined, decoded = self._whole(text)
        return joined.count(",") + 1 if joined else 0, joined, self._without_prefix(decoded)


_loaded: dict[str, PieceModel] = {}
#: Names of the models that the driver found to be supported; it holds no model itself.
_accepted: set[str] = set()


def model(data: bytes) -> PieceModel:
    """The vocabulary of a model file's bytes, made once in each Python process."""
    name = hashlib.sha256(data).hexdigest()
    if name not in _loaded:
        _loaded[name] = PieceModel(data)
    return _loaded[name]


def file_bytes(spark: SparkSession, path: str) -> bytes:
    """The bytes of a model file: the driver's own, else one that Spark can read."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def shared_model(docs: DataFrame, path: str):
    """The model file's bytes on all executors: a vocabulary, of a size that doesn't depend on the documents."""
    data = file_bytes(docs.sparkSession, path)
    name = hashlib.sha256(data).hexdigest()
    if name not in _accepted:
        PieceModel(data)  # a model that isn't supported is refused here
        _accepted.add(name)
        give_back()
    return docs.sparkSession.sparkContext.broadcast(data)


def encoded(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, input_ids array<int>, decoded string) of every text; a null text has no ids and decodes to the empty string.

    Rows are independent: no shuffle, repeated rows stay repeated, other columns of ``docs`` are not read.
    """
    kind, shared = dict(docs.dtypes)[id_col], shared_model(docs, model_path)

    def rows(batch: pa.RecordBatch) -> dict:
        m = model(shared.value)
        ids = [m.encode(t) for t in column_values(batch, text_col, "")]
        return {id_col: batch.column(0), "input_ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array([m.decode(x) for x in ids], pa.string())}

    return per_row(docs, [id_col, text_col], f"`{id_col}` {kind}, input_ids array<int>, decoded string", rows, lambda: model(shared.value).forget())


def digests(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text, by the same encoder and decoder as ``encoded``."""
    kind, shared = dict(docs.dtypes)[id_col], shared_model(docs, model_path)

    def rows(batch: pa.RecordBatch) -> dict:
        m = model(shared.value)
        n, ids, back = [], [], []
        for text in column_values(batch, text_col, ""):
            count, joined, decoded = m.digest(text)
            n.append(count)
            ids.append(hashlib.sha256(joined.encode()).hexdigest())
            back.append(hashlib.sha256(decoded.encode()).hexdigest())
        return {id_col: batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(back, pa.string())}

    return per_row(docs, [id_col, text_col], f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", rows, lambda: model(shared.value).forget())
