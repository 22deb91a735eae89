"""Byte-level BPE encoding and decoding through a sentencepiece model built from the ranks.

The vocabulary file lists byte strings with ranks.  Each byte becomes one character (U+0100
plus the byte), each vocabulary entry one piece whose score is its negative rank, and the
model proto is serialised here field by field with identity normalisation.  sentencepiece's
BPE then merges the pair with the best score, leftmost first, which is the lowest rank.

Defined results: a null text is the empty text; an empty text has no ids; extra columns are
ignored; repeated rows give repeated results; null ids are kept as null.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ChunkCache, long_id, read_table, text_groups, trimmed

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_SHIFT = {b: 0x100 + b for b in range(256)}
_UNK = "⁇"


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def to_chars(data: bytes) -> str:
    """One character above U+00FF for each byte."""
    return data.decode("latin-1").translate(_SHIFT)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(k): int(v) for k, v in (line.split() for line in f if line.strip())}


def serialise(ranks: dict[bytes, int]) -> bytes:
    """ModelProto bytes: pieces in rank order, then the unknown piece; id i is the i-th rank."""
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = _field(1, to_chars(token).encode()) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, 1)
        out += _field(1, piece)
    out += _field(1, _field(1, _UNK.encode()) + b"\x15" + struct.pack("<f", -float(len(ranks) + 1)) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(ranks) + 1) + _number(35, 0) + _number(40, len(ranks))
    trainer += b"".join(_number(n, (1 << 64) - 1) for n in (41, 42, 43)) + _field(45, _UNK.encode())
    normal = _field(1, b"identity") + _field(2, b"") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    out += _field(2, trainer) + _field(3, normal)
    return bytes(out)


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, pattern: str):
        import numpy as np
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        ordered = sorted(self.ranks.items(), key=lambda x: x[1])
        self.rank_of = np.array([r for _, r in ordered] + [0], dtype="<u4")
        self.bytes_of = {r: t for t, r in ordered}
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.split = regex.compile(pattern).findall
        self.cut = pattern == default_pattern()  # only of this pattern it is known that texts may be cut at spaces
        self.inner_space = re.compile(r" \s").search
        self.plain = ChunkCache(self._fill)
        self.spaced = ChunkCache(lambda chunks: self._fill([" " + c for c in chunks]))

    def _fill(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, split by the pattern; a whole match in the vocabulary is one id."""
        ranks, rank_of = self.ranks, self.rank_of
        split = [[m.encode() for m in self.split(c)] for c in chunks]
        rest = [m for ms in split for m in ms if m not in ranks]
        found = iter(self.processor.encode([to_chars(m) for m in rest], out_type=int, num_threads=1)) if rest else iter(())
        pack = struct.Struct("<I").pack
        return [b"".join(pack(ranks[m]) if m in ranks else rank_of[next(found)].tobytes() for m in ms) for ms in split]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        A single space before a non-space always begins a match of the bundled pattern, so the
        text is cut there and each cut is looked up; a text with a longer run of spaces inside
        goes through whole, and so does every text under another pattern.
        """
        out: list[bytes] = []
        for a, b in text_groups(texts):
            whole, cuts = {}, {}
            for i in range(a, b):
                t = texts[i] or ""
                if not self.cut or not t or t[-1] == " " or self.inner_space(t):
                    whole[i] = t
                else:
                    cuts[i] = t.split(" ")
            plain = self.plain.resolve({c[0] for c in cuts.values()})
            spaced = self.spaced.resolve(set().union(*(c[1:] for c in cuts.values())))
            for i in range(a, b):
                if i in cuts:
                    c = cuts[i]
                    out.append(plain(c[0]) + b"".join(map(spaced, c[1:])))
                else:
                    out.append(self._fill([whole[i]])[0] if whole[i] else b"")
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode_decode(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``id_col``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` (binary) of each row.

    ``path`` is the rank file on each machine and ``pattern`` the pre-token pattern; both
    default to those of the installed public_tokenizers.  No shuffle; memory is bounded by
    the batch and the two chunk caches.
    """
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_groups(texts, 8_000_000):
                ids = codec.encode_many(texts[a:b])
                decoded = [codec.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], [id_col, "ids", "decoded"])

    rows = df.select(long_id(id_col), F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(trimmed(run), f"{id_col} long, ids binary, decoded binary")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(read_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
