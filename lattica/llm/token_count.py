"""Token counts under a unigram model by count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates every piece that ends at a
position; dynamic programming keeps, for each position, the best score, where the best
last piece begins, and how many pieces lead there.  No segmentation is stored.

Tie rules are those of the tokenizers library's unigram model: of equal scores the piece
that begins first stays; a character that is no piece of its own may be an unknown of ten
below the least score, and an unknown character counts as its bytes.  Scores are added in
double precision; those of the bundled vocabulary are whole numbers, so sums are exact.

The pieces and scores are read from a sentencepiece model file.  Spaces become U+2581, one
more is put before the text; no piece crosses from another character to U+2581, so a text
is counted by chunks that begin there, and counts of chunks are remembered.

Defined results: null and empty texts have no tokens; white space alone is counted as it
is; extra columns are ignored; repeated rows give repeated results; texts are read whole.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ChunkCache, long_id, read_table, text_groups, trimmed

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Stands for the unknown piece in the vocabulary; no text can be taken for it.
UNKNOWN = "\U0010ffff<unk>"
PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protocol buffer message: number, and its bytes or integer."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        elif tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = 4 if tag & 7 == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Normal and byte pieces with their scores, after the unknown piece; control pieces are left out."""
    with open(path, "rb") as f:
        data = f.read()
    out = [(UNKNOWN, 0.0)]
    for number, body in _fields(data):
        if number == 1:
            piece = dict(_fields(body))
            if piece.get(3, 1) in (1, 6):
                out.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0]))
    return out


def normalise(text: str | None) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


class Counter:
    """Counts tokens under one vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary[1:]:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - PENALTY
        pieces = [p for p, _ in vocabulary[1:]]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece crosses into white space")
        self.breaks = all(p == "\n" or "\n" not in p for p in pieces)
        self.chunks = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.cache = ChunkCache(lambda found: map(self.viterbi, found))

    def viterbi(self, chunk: str) -> int:
        """Number of pieces on the best path through a chunk."""
        n = len(chunk)
        best = [0.0] + [None] * n
        count = [0] * (n + 1)
        begins = [0] * (n + 1)
        done = 0

        def unknowns(up_to: int) -> None:
            """Characters that no piece of one character covers, up to a position."""
            nonlocal done
            for i in range(done, up_to):
                if i + 1 not in single:
                    score = best[i] + self.unknown
                    if best[i + 1] is None or score > best[i + 1]:
                        best[i + 1], begins[i + 1], count[i + 1] = score, i, count[i] + len(chunk[i].encode())
            done = max(done, up_to)

        single: set[int] = set()
        at = -1
        for last, (size, score) in self.automaton.iter(chunk):
            end = last + 1
            if end != at:
                unknowns(at if at > done else done)
                if at < end - 1:
                    unknowns(end - 1)
                at = end
            start = end - size
            if size == 1:
                single.add(end)
            total = best[start] + score
            if best[end] is None or total > best[end] or (total == best[end] and start < begins[end]):
                best[end], begins[end], count[end] = total, start, count[start] + 1
        unknowns(n)
        return count[n]

    def count_many(self, texts: list[str | None]) -> list[int]:
        out: list[int] = []
        for a, b in text_groups(texts, 3_000_000):
            cuts = [self.cut(normalise(t)) for t in texts[a:b]]
            get = self.cache.resolve(set().union(*cuts))
            out += [sum(map(get, c)) for c in cuts]
        return out

    def cut(self, text: str) -> list[str]:
        """Chunks whose counts add up to the text's."""
        if self.breaks and "\n" in text:
            return [c for part in text.split("\n") for c in (*self.chunks(part), "\n")][:-1]
        return self.chunks(text)


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(read_vocabulary(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def count_tokens(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col`` and ``n_tokens`` of each row.  No shuffle; memory is the automaton, a batch and the memo."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            counts = counter.count_many(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], [id_col, "n_tokens"])

    rows = df.select(long_id(id_col), F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(trimmed(run), f"{id_col} long, n_tokens long")


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))
