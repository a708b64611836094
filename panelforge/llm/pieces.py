"""SentencePiece encoding and decoding of a byte-pair model, by backtracking instead of a merge queue.

Merging is deterministic (best score first, then the leftmost pair), so a sequence of pieces is the encoding of a text
exactly if re-merging every two neighbours gives these two back: the first merge across a border of the sequence would
also be made in the text of the two pieces beside it. For the same reason at most one such sequence ends at each place.
So the text is read once from the left: an Aho-Corasick automaton gives all pieces that start at a place, the longest
that is compatible with the piece before is taken, and a place from which nothing fits is marked in a bit field and
never tried again. Checks of neighbours are remembered, as are the encodings of short stretches of text.

A text is cut first where no piece can reach across: before a space sign that follows another character, and around
characters that occur in no piece of several characters. No merge crosses such a place, so the cuts change nothing.

The vocabulary reaches the workers with the task's code; ``Vocabulary.load`` refuses files above 64 MB.

Defined cases: a null text is encoded as the empty one (begin and end only); characters outside the vocabulary become
bytes where the model has byte pieces, else the unknown id; texts are taken whole, a long stretch without a cut needs
a few hundred bytes a character while it is encoded; decoding null ids gives null, an id outside the vocabulary raises,
as the library does; repeated rows each get a row; clashing columns of the input are replaced.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without

SIGN = "▁"
#: Kinds of pieces in a model file: fixed values of its format.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
LARGEST_FILE = 64 << 20
#: Stretches and pairs that a worker remembers before it forgets those not met since the last time: about 80 and 50 MB.
REMEMBERED, REMEMBERED_PAIRS = 1 << 18, 1 << 19
SHORT = 48
OUTSIDE = 1 << 21  # beyond all ids; a symbol has 22 bits
ROWS = 512


def _each_byte(e: UnicodeError):
    """Every byte that is not part of a character becomes U+FFFD."""
    return "�", e.start + 1


codecs.register_error("panelforge_each_byte", _each_byte)


@dataclass(frozen=True)
class Vocabulary:
    """The pieces of a model file by id, with what encoding needs beside them."""

    pieces: tuple
    scores: tuple
    kinds: tuple
    unknown: int
    begin: int
    end: int
    prefix: bool
    unknown_surface: str
    mark: str = field(default="")

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Reads a byte-pair model with the identity normaliser; other models raise."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            raw = f.read(LARGEST_FILE + 1)
        if len(raw) > LARGEST_FILE:
            raise ValueError("a model of more than 64 MB")
        model = proto.ModelProto()
        model.ParseFromString(raw)
        train, norm = model.trainer_spec, model.normalizer_spec
        kinds = tuple(p.type for p in model.pieces)
        plain = train.model_type == 2 and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces and not train.treat_whitespace_as_suffix and not model.denormalizer_spec.precompiled_charsmap
        if not plain or len(kinds) >= OUTSIDE or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("not a plain byte-pair model")
        return Vocabulary(tuple(p.piece for p in model.pieces), tuple(p.score for p in model.pieces), kinds, kinds.index(UNKNOWN), train.bos_id, train.eos_id, norm.add_dummy_prefix, train.unk_surface, hashlib.sha256(raw).hexdigest())


class Quads(dict):
    """Symbols as their ids' little-endian bytes; a character that is no piece becomes its bytes' ids, or the unknown id."""

    def __init__(self, v: Vocabulary, of_byte: dict):
        super().__init__((i, i.to_bytes(4, "little")) for i in range(len(v.pieces)))
        self.unknown, self.of_byte = v.unknown, of_byte

    def __missing__(self, symbol: int) -> bytes:
        raw = chr(symbol - OUTSIDE).encode()
        return b"".join([self[self.of_byte[b]] for b in raw]) if self.of_byte else self[self.unknown]


class Decoder:
    """Decodes in one worker."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.surface = [b"" if k == CONTROL else bytes([int(p[1:-1], 16)]) if k == BYTE else v.unknown_surface.encode() if k == UNKNOWN else p.replace(SIGN, " ").encode() for p, k in zip(v.pieces, v.kinds)]
        self.control = np.array(v.kinds) == CONTROL

    def decode(self, packed: bytes) -> str:
        """Joins surfaces; the space that encoding put before the text goes, broken bytes become U+FFFD."""
        ids, kinds = np.frombuffer(packed, "<u4"), self.v.kinds
        if len(ids) and ids.max() >= len(kinds):
            raise ValueError(f"no piece has the id {ids.max()}")
        runs = [r.tolist() for r in np.split(ids, np.flatnonzero(self.control[ids]))]  # a control id ends a run of bytes
        texts = [b"".join(map(self.surface.__getitem__, r)).decode("utf-8", "panelforge_each_byte") for r in runs]
        first = next((i for r in runs for i in r if kinds[i] != CONTROL), None)
        out = "".join(texts)
        return out[1:] if self.v.prefix and first is not None and kinds[first] == NORMAL and self.v.pieces[first].startswith(SIGN) else out


class Encoder:
    """Encodes in one worker. A symbol is the id of a piece, or ``OUTSIDE`` plus the code of another character."""

    def __init__(self, v: Vocabulary):
        self.v = v
        normal = [i for i, k in enumerate(v.kinds) if k == NORMAL]
        self.score = {v.pieces[i]: v.scores[i] for i in normal}
        self.single = {v.pieces[i]: i for i in normal if len(v.pieces[i]) == 1}
        self.quads = Quads(v, {int(v.pieces[i][1:-1], 16): i for i, k in enumerate(v.kinds) if k == BYTE})
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            if len(v.pieces[i]) > 1:
                self.automaton.add_word(v.pieces[i], (len(v.pieces[i]), i))
        self.automaton.make_automaton()
        joined = {c for p in self.score if len(p) > 1 for c in p}
        if any(re.search(f"[^{SIGN}]{SIGN}", p) for p in self.score):
            self.cuts = re.compile("[" + re.escape("".join(sorted(joined))) + "]+|.", re.S)
        else:
            self.cuts = re.compile(f"{SIGN}*[" + re.escape("".join(sorted(joined - {SIGN}))) + f"]+|{SIGN}+|.", re.S)
        self.known, self.older, self.pairs = {}, {}, {}

    def text(self, symbol: int) -> str:
        return self.v.pieces[symbol] if symbol < OUTSIDE else chr(symbol - OUTSIDE)

    def survive(self, a: str, b: str) -> bool:
        """Whether merging the characters of both, best score first and of equal ones the leftmost, ends in a and b."""
        parts, border, score = [*a, *b], len(a), self.score.get
        while True:
            best, at = None, -1
            for i, (x, y) in enumerate(zip(parts, parts[1:])):
                s = score(x + y)
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return len(parts) == (2 if a else 1)
            if at + 1 == border:
                return False
            border -= at + 1 < border
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, before: int, symbol: int) -> bool:
        """Whether two neighbours survive re-merging; at the begin, whether the piece is what its own characters merge to."""
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        found = self.pairs[before << 22 | symbol] = self.survive(self.text(before) if before >= 0 else "", self.text(symbol))
        return found

    def split(self, text: str) -> list[int]:
        """The one sequence of symbols whose neighbours are all compatible.

        A place is entered once at most: whoever comes to it has the same pieces before it, and leaves it for good."""
        single, pairs, places = self.single, self.pairs, {}
        for last, (size, piece) in self.automaton.iter(text):
            at = last - size + 1
            if at in places:
                places[at].append((last + 1, piece))
            else:  # the ends of what may start at a place, shortest first; a character always may
                c = text[at]
                places[at] = [(at + 1, single[c] if c in single else OUTSIDE + ord(c)), (last + 1, piece)]
        n, at, before, taken = len(text), 0, -1, []
        failed = bytearray((n >> 3) + 1)
        while at < n:
            if at not in places:
                c = text[at]
                places[at] = [(at + 1, single[c] if c in single else OUTSIDE + ord(c))]
            options = places[at]
            while options:
                end, symbol = options.pop()
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                fits = pairs.get(before << 22 | symbol)
                if fits or fits is None and self.compatible(before, symbol):
                    taken.append((at, before))
                    at, before = end, symbol
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at, before = taken.pop()
        return [t[1] for t in taken[1:]] + [before] if n else []

    def pack(self, stretch: str) -> bytes:
        """The ids of a stretch without cuts, as little-endian unsigned 32-bit integers."""
        packed = self.older.get(stretch)
        if packed is None:
            quads = self.quads
            packed = b"".join([quads[s] for s in self.split(stretch)])
        if len(stretch) <= SHORT:
            self.known[stretch] = packed
        return packed

    def encode(self, text: str | None, begin: bool = True, end: bool = True) -> bytes:
        signs = ((SIGN if self.v.prefix else "") + text.replace(" ", SIGN)) if text else ""
        if len(self.known) >= REMEMBERED:
            self.known, self.older = {}, self.known
        known, pack = self.known.get, self.pack
        out = b"".join([known(s) or pack(s) for s in self.cuts.findall(signs)])
        sides = [np.array([i], "<u4").tobytes() if on else b"" for i, on in ((self.v.begin, begin), (self.v.end, end))]
        return sides[0] + out + sides[1]


_MADE: dict = {}


def made(kind: type, v: Vocabulary):
    """The worker's encoder or decoder of a vocabulary, made once a process."""
    if kind not in _MADE or _MADE[kind].v.mark != v.mark:
        _MADE[kind] = kind(v)
    return _MADE[kind]


def _mapped(df: DataFrame, source: str, added: dict[str, T.DataType], keep: list[str] | None, convert) -> DataFrame:
    """``df`` (or its columns ``keep``) with the columns ``added``: what ``convert`` makes of a slice of the column ``source``."""
    rest = without(df, *added)
    kept = rest.columns if keep is None else [c for c in keep if c.lower() not in added]
    columns = [*[F.col(f"`{c}`") for c in kept], F.col(f"`{source}`").alias("__source")]
    shape = T.StructType([*rest.select(*[f"`{c}`" for c in kept]).schema.fields, *[T.StructField(n, t) for n, t in added.items()]])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                *own, values = batch.slice(at, ROWS).columns
                yield pa.RecordBatch.from_arrays([*own, *convert(values)], names=[*kept, *added])

    return df.select(*columns).mapInArrow(run, shape)


def encode(docs: DataFrame, model: str, *, text: str = "text", keep: list[str] | None = None, begin: bool = True, end: bool = True, packed: bool = False, decoded: bool = False) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``ids``: an array of ints, or, ``packed``, their little-endian bytes; with
    ``decoded`` also the text that these ids decode to, made in the same pass."""
    vocabulary = Vocabulary.load(model)
    added = {"ids": T.BinaryType() if packed else T.ArrayType(T.IntegerType())} | ({"decoded": T.StringType()} if decoded else {})

    def convert(texts):
        c = made(Encoder, vocabulary)
        found = [c.encode(x.as_py(), begin, end) for x in texts]
        if packed:
            yield pa.array(found, pa.binary())
        else:
            offsets = np.cumsum([0, *[len(x) // 4 for x in found]]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32)))
        if decoded:
            d = made(Decoder, vocabulary)
            yield pa.array([d.decode(x) for x in found], pa.string())

    return _mapped(docs, text, added, keep, convert)


def decode(docs: DataFrame, model: str, *, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``decoded``, the text of a column of ids, an array or packed."""
    vocabulary = Vocabulary.load(model)
    packed = isinstance(docs.schema[ids].dataType, T.BinaryType)

    def convert(values):
        d = made(Decoder, vocabulary)
        found = [x.as_py() for x in values]
        raw = found if packed else [None if x is None else np.array(x, "<u4").tobytes() for x in found]
        yield pa.array([None if x is None else d.decode(x) for x in raw], pa.string())

    return _mapped(docs, ids, {"decoded": T.StringType()}, keep, convert)


def digest(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, number of ids, and SHA-256 of the packed ids and of the decoded text."""
    return decoded.select(key, F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
