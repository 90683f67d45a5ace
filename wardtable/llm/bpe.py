"""Byte-level BPE: a rank file turned into a sentencepiece model, for encoding and decoding.

Each byte stands for one printable character, each ranked piece for a piece whose score is its
negative rank, so that the piece merged first is the one with the lowest rank, leftmost first.
Normalisation is the identity: nothing is added, joined or dropped. A text is cut by the
pre-token pattern; distinct stretches of it are encoded once
per task and looked up after that. Decoding maps ids back to
pieces and characters to bytes.

Null and empty texts give no ids. Very long texts are encoded whole. Repeated rows are encoded as
often as they occur, other columns are left alone, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
import regex
import sentencepiece
from pyspark.sql import DataFrame

from wardtable.llm.common import map_text

#: Distinct stretches that a task remembers; beyond it the memory is emptied and filled anew.
REMEMBERED = 60_000
#: Stretches of visible characters with the white space before them.
STRETCHES = r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a text file of base64 pieces and numbers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is visible, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One protobuf field."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of the pieces; piece number i has the i-th lowest rank, the last is <unk>."""
    names = byte_characters()
    ordered = sorted(ranks, key=ranks.get)
    pieces = [
        _field(1, _field(1, "".join(names[b] for b in piece)) + _field(2, -float(ranks[piece]))) for piece in ordered
    ]
    unknown = _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    # Fixed values of the format: model type 2 is BPE; 3, 4 and 5 turn off what would change white space.
    trainer = _field(2, _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)))
    normaliser = _field(3, _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return b"".join(pieces) + unknown + trainer + normaliser


class Codec:
    """Encodes and decodes with a serialised model; ids are ranks.

    ``stretches`` cuts a text where no pre-token can cross: before a space or line feed that follows
    something visible. It holds for patterns whose matches never go from visible characters on to
    white space; without it whole texts go to the pattern.
    """

    def __init__(self, model: bytes, pattern: str, stretches: str | None = STRETCHES):
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(model)
        names = byte_characters()
        self.to_characters = dict(enumerate(names))
        back = {c: b for b, c in enumerate(names)}
        size = self.model.get_piece_size() - 1
        # Scores are negative ranks, exact as 32-bit floats up to 2 ** 24.
        self.ranks = np.array([-self.model.get_score(i) for i in range(size)]).astype("<u4")
        pieces = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(size)]
        self.place = np.zeros(int(self.ranks.max(initial=0)) + 1, dtype="i8")
        self.place[self.ranks] = np.arange(size)
        self.lengths = np.array([len(p) for p in pieces], dtype="i8")
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), dtype="u1")
        self.find = regex.compile(pattern).findall
        self.cut = re.compile(stretches).findall if stretches else lambda text: [text] if text else []
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.cut(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self._learn(list(set().union(*cut).difference(self.known)))
        return [b"".join(map(self.known.__getitem__, stretches)) for stretches in cut]

    def _learn(self, stretches: list[str]) -> None:
        tokens = [self.find(s) for s in stretches]
        every = list({t for found in tokens for t in found})
        mapped = [t.encode("utf-8", "replace").decode("latin-1").translate(self.to_characters) for t in every]
        ids = self.model.encode(mapped, num_threads=1) if mapped else []
        made = {t: self.ranks[i].tobytes() for t, i in zip(every, ids, strict=True)}
        self.known.update((s, b"".join(map(made.__getitem__, found))) for s, found in zip(stretches, tokens, strict=True))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids given as ``encode`` returns them."""
        places = self.place[np.frombuffer(ids, dtype="<u4")]
        lengths = self.lengths[places]
        shift = self.starts[places] - (np.cumsum(lengths) - lengths)
        return self.bytes[np.arange(lengths.sum()) + np.repeat(shift, lengths)].tobytes()


@lru_cache(1)
def _codec(model: bytes, pattern: str) -> Codec:
    """One codec for all tasks of a worker process."""
    return Codec(model, pattern)


def encode_texts(
    df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``keep`` columns (all by default), ``ids`` (array of ranks) and ``decoded`` (binary) for every row."""

    def result(codec: Codec, raw: bytes) -> tuple:
        return np.frombuffer(raw, dtype="<u4").astype("i8"), codec.decode(raw)

    return _mapped(df, ranks_path, pattern, text, keep, "ids array<bigint>, decoded binary", result)


def encode_digests(
    df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """As ``encode_texts``, with the number of ids and the digests of ids and decoded bytes instead."""

    def result(codec: Codec, raw: bytes) -> tuple:
        return len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(codec.decode(raw)).hexdigest()

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _mapped(df, ranks_path, pattern, text, keep, schema, result)


def _mapped(df, ranks_path, pattern, text, keep, schema, result) -> DataFrame:
    model = serialise(read_ranks(ranks_path))  # about a megabyte: it travels with the tasks

    def work():
        codec = _codec(model, pattern)
        return lambda texts: [result(codec, raw) for raw in codec.encode(texts)]

    return map_text(df, text, schema, work, df.columns if keep is None else keep)
