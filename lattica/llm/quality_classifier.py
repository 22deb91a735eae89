"""Quality classifier: nearest-neighbour voting in a latent semantic space.

A text becomes a sparse count vector of character-class trigrams (a fixed space of
``CLASSES ** 3`` cells) and of a few word-pattern cells: repeats of the previous word,
share of new words, shapes.  On a bounded sample of labelled rows the counts are weighted
by tf-idf and reduced by a truncated SVD to ``rank`` dimensions.  The labelled vectors, at
most ``sample_bound`` of them, are broadcast; every document's exact cosine with all of
them is a blocked matrix product, and the ``neighbours`` nearest vote with their labels,
weighted by a power of their similarity.  Votes are shrunk towards the label's share in
the sample, so that an empty text scores that share.

Defined results: a null text is the empty text; rows of labels with a null label or id are
not learnt from; with no labelled row at all every score is 0.5; extra columns are ignored
and never inputs; repeated rows give repeated results; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import long_id, read_table, text_groups, trimmed

FOLDS = 5
THRESHOLD = 0.3
CLASSES = 24
PATTERNS = 64
CELLS = CLASSES**3 + PATTERNS


def _class_table() -> np.ndarray:
    """A class for each byte: vowels and consonants by case, digits, space, line end, marks one by one or in groups."""
    table = np.zeros(256, np.uint8)
    groups = ["aeiou", "AEIOU", "bcdfghjklmnpqrstvwxyz", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!", "?", ":;", "'\"`", "-_", "#", "*", "$", "%", "&", "|", "<>{}[]()/\\", "@+=~^"]
    for k, chars in enumerate(groups, 1):
        table[[ord(c) for c in chars]] = k
    table[128:] = len(groups) + 1
    return table


_TABLE = _class_table()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Cells and counts of one text."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    kinds = _TABLE[raw].astype(np.int64)
    if len(kinds) >= 3:
        grams = (kinds[:-2] * CLASSES + kinds[1:-1]) * CLASSES + kinds[2:]
        counts = np.bincount(grams, minlength=CLASSES**3)
        cells = np.flatnonzero(counts)
        values = counts[cells].astype(np.float64)
    else:
        cells, values = np.zeros(0, np.int64), np.zeros(0)
    more = word_patterns(raw)
    at = np.flatnonzero(more)
    return np.concatenate([cells, CLASSES**3 + at]), np.concatenate([values, more[at]])


def word_patterns(raw: np.ndarray) -> np.ndarray:
    """Weights of pattern cells: how often words repeat the one before, or come back, in eighths of the words."""
    out = np.zeros(PATTERNS)
    inside = np.concatenate([[False], (raw > 32), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[0::2], edge[1::2]
    n = len(starts)
    if n < 2:
        return out
    sizes = ends - starts
    # a word's hash: its bytes weighted by place, summed over the word
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw)))) if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))])
    mixed = (raw.astype(np.uint64) + np.uint64(1)) * (np.uint64(0x9E3779B97F4A7C15) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
    mixed ^= mixed >> np.uint64(29)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
    codes = total[ends] - total[starts]
    same = (codes[1:] == codes[:-1]).sum() / n
    distinct = len(np.unique(codes)) / n
    weight = float(n)
    out[min(15, int(16 * same))] = weight * (same > 0.05)
    out[16 + min(15, int(16 * distinct))] = weight * 0.1
    out[32 + min(15, int(sizes.mean()))] = weight * 0.1
    return out


#: A neighbour's vote weighs its cosine to this power, so that the nearest decide; the label's share in the sample has this weight.
POWER, SHRINK = 8, 0.1


class Voter:
    """The fitted space, the labelled vectors and their labels."""

    def __init__(self, found: list[tuple[np.ndarray, np.ndarray]], labels: list[int], rank: int, neighbours: int, seed: int):
        n = len(found)
        self.neighbours = min(neighbours, n)
        self.labels = np.array(labels, np.float32)
        self.prior = float(self.labels.mean()) if n else 0.5
        if not n:
            return
        df = np.bincount(np.concatenate([c for c, _ in found]), minlength=CELLS)
        self.used = np.flatnonzero(df >= min(2, n))
        self.column = np.full(CELLS, -1, np.int64)
        self.column[self.used] = np.arange(len(self.used))
        self.idf = np.log((1 + n) / (1 + df[self.used])) + 1
        matrix = np.zeros((n, len(self.used)), np.float32)
        for i, f in enumerate(found):
            self._row(matrix, i, f)
        self.basis = self._svd(matrix, min(rank, n, len(self.used)), seed)
        self.vectors = _unit(matrix @ self.basis)

    def _row(self, matrix: np.ndarray, i: int, found: tuple[np.ndarray, np.ndarray]) -> None:
        cells, counts = found
        at = self.column[cells]
        ok = at >= 0
        value = np.log1p(counts[ok]) * self.idf[at[ok]]
        matrix[i, at[ok]] = value / (np.sqrt((value**2).sum()) or 1)

    @staticmethod
    def _svd(matrix: np.ndarray, rank: int, seed: int) -> np.ndarray:
        """Right singular vectors, by subspace iteration on a random start."""
        rng = np.random.default_rng(seed)
        basis = rng.normal(size=(matrix.shape[1], min(matrix.shape[1], rank + 8))).astype(np.float32)
        for _ in range(6):
            basis, _ = np.linalg.qr(matrix.T @ (matrix @ basis))
        _, _, right = np.linalg.svd(matrix @ basis, full_matrices=False)
        return np.ascontiguousarray(basis @ right.T[:, :rank])

    def score(self, texts: list[str | None], block: int = 256) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        for a in range(0, len(texts), block):
            part = texts[a : a + block]
            matrix = np.zeros((len(part), len(self.used)), np.float32)
            for i, t in enumerate(part):
                self._row(matrix, i, features(t))
            vectors = _unit(matrix @ self.basis)
            cosine = vectors @ self.vectors.T
            k = self.neighbours
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < cosine.shape[1] else np.broadcast_to(np.arange(k), cosine.shape)
            weight = np.maximum(np.take_along_axis(cosine, near, 1).astype(np.float64), 0) ** POWER
            votes = (weight * self.labels[near]).sum(1)
            out[a : a + len(part)] = (votes + SHRINK * self.prior) / (weight.sum(1) + SHRINK)
        return np.clip(out, 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.ascontiguousarray(x / np.where(norm > 0, norm, 1))


def held_out(column):
    return (F.coalesce(F.crc32(column.cast("string").cast("binary")), F.lit(0)) % FOLDS) == 0


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_bound: int = 3000, rank: int = 48, neighbours: int = 15, seed: int = 7) -> Voter:
    """Learn from at most ``sample_bound`` labelled rows outside the held-out fold, half of each label where there are enough.

    The rows are the first of each label in hash order of their ids; an id with several
    labels counts once for each, and of rows that repeat an id the least text is learnt from.
    """
    known = labels.select(long_id(id_col), F.col(label_col).cast("int").alias("__y")).where(F.col(id_col).isNotNull() & F.col("__y").isNotNull() & ~held_out(F.col(id_col)))
    per = sample_bound // 2
    picked = None
    for y in (0, 1):
        some = known.where(F.col("__y") == y).select(id_col, "__y", F.xxhash64(id_col).alias("__h")).orderBy("__h", id_col).limit(per)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(long_id(id_col), F.col(text_col).cast("string").alias("__t"))
    # one text an id, so that repeated rows cannot pass the bound
    rows = texts.join(F.broadcast(picked), id_col).groupBy("__h", id_col, "__y").agg(F.min("__t").alias("__t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(3).to_pylist()]
            columns = [batch.column(i) for i in range(3)] + [pa.array([list(f[k]) for f in found], pa.list_(t)) for k, t in ((0, pa.int32()), (1, pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["h", "id", "y", "cells", "counts"])

    learnt = rows.mapInArrow(trimmed(run), "h long, id long, y int, cells array<int>, counts array<double>").toArrow()
    order = sorted(range(learnt.num_rows), key=lambda i: tuple(learnt.column(c)[i].as_py() for c in range(3)))
    found = [tuple(np.array(learnt.column(c)[i].as_py(), t) for c, t in ((3, np.int64), (4, np.float64))) for i in order]
    return Voter(found, [learnt.column(2)[i].as_py() for i in order], rank, neighbours, seed)


def classify(docs: DataFrame, voter: Voter, *, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """``id_col`` and ``score`` of each row; with ``keep_columns`` the rows that score ``threshold`` or more, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(voter)
    rows = docs if keep_columns else docs.select(long_id(id_col), F.col(text_col).cast("string").alias(text_col))
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in text_groups(texts, 4_000_000):
                score = model.score(texts[a:b])
                if keep_columns:
                    yield batch.slice(a, b - a).filter(pa.array(score >= threshold))
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score, pa.float64())], [id_col, "score"])

    return rows.mapInArrow(trimmed(run), docs.schema if keep_columns else f"{id_col} long, score double")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = classify(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
