"""Packing documents into fixed-length sequences along a space-filling curve.

A document's token ids are hashed to signed random directions and averaged: a hashed
document vector projected to three dimensions.  Its Hilbert key orders the documents, a
range partitioning by that key sends neighbours to the same task, and each task cuts its
stream of documents every ``length`` ids, so that only the last sequence of a range is
short.  Range bounds come from approximate quantiles of the keys of a hash sample; they
decide balance only, never which rows are packed.  Keys end in hashed document bits, so
copies of one text spread over ranges.

Defined results: a null text is the empty text, which is the end id alone; repeated rows
are packed as often as they occur; a null id keeps its rows; other columns are ignored;
an empty table gives no pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ChunkCache, input_bytes, long_id, read_table, text_groups, trimmed

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
LENGTH = 2048
BITS = 10
#: Letters of one script block that lower-case to one letter each, then ASCII marks.
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)?([!-&(-/:-@\\[-`{-~]+)?").fullmatch


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class WordBpe:
    """Ids of whole texts as little-endian unsigned 16-bit integers, by the tokenizers library.

    The vocabulary drops white space and never merges across it, so ids are remembered by
    chunk between spaces.  Unseen plain chunks are encoded in joined groups and cut apart
    at word-end tokens; a group whose word count disagrees, and any other chunk, goes alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) > 0xFFFF:
            raise ValueError("the vocabulary has ids beyond 16 bits")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.cache = ChunkCache(self._fill, 500_000)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u2") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fill(self, chunks: list[str]) -> list[bytes]:
        out = [b""] * len(chunks)
        at, simple, counts, other = [], [], [], []
        for i, c in enumerate(chunks):
            m = _SIMPLE(c)
            if m and c:
                at.append(i)
                simple.append(c)
                counts.append(m.lastindex - (m.start(1) < 0))
            else:
                other.append(i)
        for k in range(0, len(simple), 500):
            ids = self._encode([" ".join(simple[k : k + 500])])[0]
            ends = np.flatnonzero(self.ends[ids]) + 1
            words = np.cumsum(counts[k : k + 500])
            if len(ends) != words[-1]:
                other += at[k : k + 500]
                continue
            raw, begin = ids.tobytes(), 0
            for i, end in zip(at[k : k + 500], (ends[words - 1] * 2).tolist(), strict=True):
                out[i] = raw[begin:end]
                begin = end
        for i, x in zip(other, self._encode([chunks[i] for i in other]), strict=True):
            out[i] = x.tobytes()
        return out

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for a, b in text_groups(texts, 3_000_000):
            cuts = [(t or "").replace("\n", " ").split(" ") for t in texts[a:b]]
            get = self.cache.resolve(set().union(*cuts))
            out += [b"".join(map(get, c)) for c in cuts]
        return out


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(maxsize=2)
def _directions(size: int, seed: int) -> np.ndarray:
    """A signed row of a 256 x 3 random projection for each token id, hashed."""
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(256, 3))[rng.integers(0, 256, size)] * rng.choice((-1.0, 1.0), (size, 1))).astype("f4")


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points of shape (n, d) below 2**bits."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations of every level
        low = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(ids: list[bytes], doc_ids: np.ndarray, seed: int) -> np.ndarray:
    """30 bits of Hilbert index, then 32 hashed bits of the document's id, of each document."""
    n = np.array([len(x) // 2 for x in ids], np.int64)
    flat = np.frombuffer(b"".join(ids), "<u2")
    sums = np.zeros((len(ids), 3))
    full = np.flatnonzero(n)
    if len(full):
        starts = (np.cumsum(n) - n)[full]
        table = _directions(1 << 16, seed)
        for k in range(3):
            sums[full, k] = np.add.reduceat(table[:, k][flat], starts)
    means = sums / np.maximum(n, 1)[:, None]
    cells = np.clip((np.tanh(means * 2) + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1)
    tie = (doc_ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return hilbert_key(cells) << 32 | tie.astype(np.int64)


def tokenise(df: DataFrame, *, id_col: str, text_col: str, path: str, seed: int, bounds: list[int] | None = None) -> DataFrame:
    """``id_col``, ``key`` and, given bounds, the range ``at`` of the key and ``ids``.

    ``ids`` is binary, unsigned 16-bit, the end id included.
    """
    end = np.array([END_ID], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_groups(texts, 4_000_000):
                ids = tokenizer.encode_many(texts[a:b])
                docs = batch.column(0).slice(a, b - a)
                keys = curve_keys(ids, docs.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), seed)
                columns = [docs, pa.array(keys, pa.int64())]
                if bounds is not None:
                    at = np.searchsorted(np.array(bounds, np.int64), keys, side="right")
                    columns += [pa.array(at, pa.int32()), pa.array([x + end for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "key", "at", "ids"][: len(columns)])

    rows = df.select(long_id(id_col), F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(trimmed(run), f"{id_col} long, key long" + ", at int, ids binary" * (bounds is not None))


def pack(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    path: str | None = None,
    seed: int = 17,
    range_mb: float = 16.0,
    sample_rows: int = 100,
) -> DataFrame:
    """Pieces of sequences: id_col, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` is binary, unsigned 32-bit little-endian.  ``range_mb`` is the input that goes
    to one range, ``sample_rows`` how many keys for each range the bounds are estimated
    from; a task is a range, so a very large corpus takes larger ones.  Ranges number their own sequences: the range's number times 2**32, plus a count.
    """
    path = path or default_path()
    size = input_bytes(df, text_col)
    parts = max(1, round(size / (range_mb * 1e6)))
    bounds: list[int] = []
    if parts > 1:
        # at about 2 KB a document this share gives sample_rows keys a range
        share = max(1, int(size / 2000 / (parts * sample_rows)))
        some = df.where(F.pmod(F.xxhash64(id_col), F.lit(share)) == 0)
        keys = tokenise(some, id_col=id_col, text_col=text_col, path=path, seed=seed)
        found = keys.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], max(20_000, 20 * parts)).alias("q")).first()["q"]
        bounds = sorted(set(found or []))
    rows = tokenise(df, id_col=id_col, text_col=text_col, path=path, seed=seed, bounds=bounds)
    dealt = rows.repartitionById(len(bounds) + 1, F.col("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0  # ids packed in this range so far
        for batch in batches:
            docs, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = batch.column(2).to_pylist()
            out: list[tuple] = []
            held = 0
            for doc, raw, part in zip(docs, ids, at, strict=True):
                wide = np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                n, start = len(raw) // 2, 0
                while start < n:
                    offset = done % length
                    take = min(n - start, length - offset)
                    out.append((doc, start, take, wide[4 * start : 4 * (start + take)], n, (part << 32) + done // length, offset))
                    start += take
                    done += take
                held += len(wide)
                if held > 16_000_000:
                    yield _pieces(out, id_col)
                    out, held = [], 0
            if out:
                yield _pieces(out, id_col)

    ordered = dealt.sortWithinPartitions("key", id_col).select(id_col, "ids", "at")
    return ordered.mapInArrow(trimmed(run), f"{id_col} long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _pieces(rows: list[tuple], id_col: str) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns: the ids' CRC-32 instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(read_table(spark, sf_dir, "documents")))
