"""Near-duplicate embeddings by sorted projection passes.

Equal vectors are one class first, told by 128 bits of hash.  In each pass a class gets a
128-bit code, the signs of its products with random directions, and classes are ordered by
it: lexicographically by concatenated hashes.  A pass ships codes and ids, never vectors.
Within the order every row is compared with its own block and the one before, a window of
one to two blocks, also across the ends of ranges.  Rows whose codes differ in few bits are
candidates; a row with few of them gives all, and in a dense run a minimum spanning forest
of the window stands for the rest, so that what a pass emits is bounded by its rows.
Candidates of all passes are verified in double precision, those that earlier links already
connect left out, and verified pairs are united.

The links of a component are then counted exactly, which no forest could: a small component
whole; of a large one, all rows within half the threshold's angle of its centre link with
each other and are counted by their number alone, and the others are compared with all
rows, in tiles.  No list of links is ever written.

The number of passes is measured: blocks of the first passes tell how many leading bits a
window's rows have in common, each of which two vectors at the threshold share with
probability 1 - angle / pi, and passes are repeated until a link at the threshold would be
missed with probability 1 - ``recall`` at most, on average over rows outside dense runs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing and are kept; vectors of different lengths never link; equal vectors link
whatever their ids; rows that repeat an id count as other vectors of the same id; a null id
is returned with a null component; an empty table gives no rows; labels are not read.
Memory of a task: two blocks of codes, or the tiles of ``tile_mb`` it compares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import drop_tables, long_id, materialize, read_table, trimmed
from .components import connected_components, rekeyed
from .jaccard_join import mix

THRESHOLD = 0.9
BLOCK = 1024
#: A row with so few candidates in a window gives them all; one with more gives a forest of its NEAR nearest.
FEW, NEAR = 4, 16
#: Passes whose blocks tell how many passes are needed.
FIRST = 4
MOST_PASSES = 4096
_CODE = "lane long, hi long, lo long, id long"
_SIGN = np.uint64(1 << 63)


def units(raws: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length at length one in double precision; rows without a direction are nan."""
    x = np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1).astype(np.float64)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        x = x / np.abs(x).max(1, initial=0.0)[:, None]
        return x / np.sqrt((x * x).sum(1))[:, None]


def by_length(raws: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.array([len(r) for r in raws])
    for n in np.unique(sizes).tolist():
        yield n, np.flatnonzero(sizes == n)


def _hash(raw: bytes) -> tuple[int, int]:
    words = np.frombuffer(raw + b"\0" * (-len(raw) % 8), np.uint64)
    place = np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first = mix(words ^ place)
    both = mix(np.array([first.sum(dtype=np.uint64), mix(first ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64)).view(np.int64)
    return int(both[0]), int(both[1])


def _prepare(kind: str):
    """Id, hash of the direction and the vector as bytes of the table's own type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [np.array(v, kind).tobytes() if v and None not in v else None for v in batch.column(1).to_pylist()]
            keys: list[tuple[int | None, int | None]] = [(None, None)] * len(raws)
            at = [i for i, r in enumerate(raws) if r is not None]
            for _, some in by_length([raws[i] for i in at]) if at else ():
                rows = [at[i] for i in some]
                for i, u in zip(rows, units([raws[i] for i in rows], kind), strict=True):
                    if np.isfinite(u).all():
                        keys[i] = _hash(u.tobytes())
            raws = [r if k[0] is not None else None for r, k in zip(raws, keys, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(raws, pa.binary())], ["id", "k1", "k2", "raw"])

    return run


def _codes(passes: range, seed: int, kind: str):
    """Each class once for each pass, with its code; sign bits are flipped so that signed order is code order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(1).to_pylist()
            for n, at in by_length(raws) if raws else ():
                x, ids = units([raws[i] for i in at], kind), batch.column(0).take(pa.array(at))
                for p in passes:
                    directions = np.random.default_rng((seed, p, n)).normal(size=(x.shape[1], 128))
                    code = np.packbits(x @ directions > 0, axis=1).view(">u8").astype(np.uint64) ^ _SIGN
                    lane = np.full(len(at), p << 32 | n)
                    yield pa.RecordBatch.from_arrays([pa.array(lane), pa.array(code[:, 0].view(np.int64)), pa.array(code[:, 1].view(np.int64)), ids], ["lane", "hi", "lo", "id"])

    return run


def _forest(label: np.ndarray, i: np.ndarray, j: np.ndarray, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a minimum spanning forest; ``label`` becomes the least row reachable."""
    order = np.argsort(h, kind="stable")
    i, j = i[order], j[order]
    out = []
    while True:
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return out
        e = np.arange(len(i))
        best = np.full((2, len(label)), len(i))
        best[0, a[::-1]] = e[::-1]
        best[1, b[::-1]] = e[::-1]
        pick = np.unique(best.min(0))
        pick = pick[pick < len(i)]
        out.append((i[pick], j[pick]))
        to = np.arange(len(label))
        while True:
            new = to.copy()
            np.minimum.at(new, a[pick], to[b[pick]])
            np.minimum.at(new, b[pick], to[a[pick]])
            new = new[new]
            if (new == to).all():
                break
            to = new
        label[:] = to[label]


def window_edges(new: np.ndarray, old: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Candidate pairs of rows of ``new`` with rows of ``new`` and ``old`` (numbered after them), and how many rows are in a dense run."""
    both = np.concatenate([new, old])
    hi, lo = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
    step = 32
    word, bits, more = np.empty((step, len(both)), np.uint64), np.empty((step, len(both)), np.uint8), np.empty((step, len(both)), np.uint8)

    def distances(rows: np.ndarray) -> np.ndarray:
        n = len(rows)
        np.bitwise_count(np.bitwise_xor(hi[rows, None], hi, out=word[:n]), out=bits[:n])
        np.bitwise_count(np.bitwise_xor(lo[rows, None], lo, out=word[:n]), out=more[:n])
        np.add(bits[:n], more[:n], out=bits[:n])
        bits[np.arange(n), rows] = 255
        return bits[:n]

    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    all_of: list[tuple[np.ndarray, np.ndarray]] = []
    dense: list[np.ndarray] = []
    for k in range(0, len(new), step):
        rows = np.arange(k, min(k + step, len(new)))
        h = distances(rows)
        near = h <= limit
        count = np.count_nonzero(near, axis=1)
        if not count.any():
            continue
        near[count > NEAR] = False
        i, j = np.nonzero(near)
        found.append((rows[i], j, h[i, j]))
        few = count[i] <= FEW
        all_of.append((rows[i[few]], j[few]))
        many = np.flatnonzero(count > NEAR)
        if len(many):
            j = np.argpartition(h[many], NEAR, axis=1)[:, :NEAR]
            found.append((np.repeat(rows[many], NEAR), j.reshape(-1), np.take_along_axis(h[many], j, 1).reshape(-1)))
            dense.append(rows[many])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    label = np.arange(len(both))
    edges = all_of + _forest(label, *(np.concatenate(x) for x in zip(*found, strict=True)))
    if dense:  # pairs beyond the nearest ones count where they join what those left apart
        found = []
        rows_of = np.concatenate(dense)
        for k in range(0, len(rows_of), step):
            rows = rows_of[k : k + step]
            h = distances(rows)
            i, j = np.nonzero((h <= limit) & (label[rows, None] != label))
            if len(i):
                found.append((rows[i], j, h[i, j]))
        if found:
            edges += _forest(label, *(np.concatenate(x) for x in zip(*found, strict=True)))
    return np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]), sum(map(len, dense))


_FOUND = "a long, b long, bits int, rows long, border long, lane long, hi long, lo long"


def _windows(limit: int, block: int, borders: bool):
    """Rows in order: candidate pairs, figures of blocks, and the first and last block of the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[list[np.ndarray]] = [[], [], [], []]
        lane, first, past = None, None, None
        held: list[np.ndarray] = []

        def record(columns: dict[str, np.ndarray], n: int) -> pa.RecordBatch:
            kinds = [(x.split()[0], pa.int32() if x.endswith(" int") else pa.int64()) for x in _FOUND.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in kinds], [k for k, _ in kinds])

        def edge_rows(at: int, rows: np.ndarray) -> pa.RecordBatch:
            return record({"a": rows[:, 3].view(np.int64), "lane": rows[:, 0].view(np.int64), "hi": rows[:, 1].view(np.int64), "lo": rows[:, 2].view(np.int64), "border": np.full(len(rows), at)}, len(rows))

        def close(rows: np.ndarray) -> None:
            nonlocal past, first
            code = rows[:, 1:3] ^ _SIGN
            before = rows[:0] if past is None else past
            i, j, dense = window_edges(code, before[:, 1:3] ^ _SIGN, limit)
            ids = np.concatenate([rows[:, 3], before[:, 3]]).view(np.int64)
            a, b = ids[i], ids[j]
            differ = [int(code[0, k] ^ code[-1, k]) for k in (0, 1)]
            same = 64 - differ[0].bit_length() if differ[0] else 128 - differ[1].bit_length()
            for to, x in zip(out, (np.minimum(a, b), np.maximum(a, b), [same], [len(rows) - dense]), strict=True):
                to.append(np.asarray(x))
            first = rows if first is None else first
            past = rows

        def flush() -> Iterator[pa.RecordBatch]:
            if out[0]:
                pairs = np.unique(np.stack([np.concatenate(out[0]), np.concatenate(out[1])], 1), axis=0)
                yield record({"a": pairs[:, 0], "b": pairs[:, 1]}, len(pairs))
                bits, rows = np.concatenate(out[2]), np.concatenate(out[3])
                known, group = np.unique(bits, return_inverse=True)
                yield record({"bits": known, "rows": np.bincount(group, rows).astype(np.int64)}, len(known))
            for to in out:
                to.clear()

        def end_lane() -> None:
            nonlocal held, past
            if held and sum(map(len, held)):
                close(np.concatenate(held))
            held = []

        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy() for k in range(4)], 1).view(np.uint64)
            cuts = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
            for piece in np.split(rows, cuts):
                if not len(piece):
                    continue
                if int(piece[0, 0]) != lane:
                    end_lane()
                    lane, past = int(piece[0, 0]), None
                held.append(piece)
                if sum(map(len, held)) >= block:
                    full = np.concatenate(held)
                    whole = len(full) // block * block
                    for k in range(0, whole, block):
                        close(full[k : k + block])
                    held = [full[whole:]]
            if sum(map(len, out[0])) > 200_000:
                yield from flush()
        end_lane()
        yield from flush()
        if borders and first is not None:
            yield edge_rows(part - 1, first)
            yield edge_rows(part, past)

    return run


def _true_links(threshold: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones, others = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = np.zeros(len(ones), bool)
            for n, at in by_length(ones) if ones else ():
                at = np.array([i for i in at if len(others[i]) == n], np.int64)
                if len(at):
                    good[at] = (units([ones[i] for i in at], kind) * units([others[i] for i in at], kind)).sum(1) >= threshold
            keep = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return run


def verified(pairs: DataFrame, classes: DataFrame, threshold: float, kind: str) -> DataFrame:
    """Those of distinct pairs a, b whose vectors link."""
    one = classes.select(F.col("rep").alias("a"), F.col("raw").alias("one"))
    two = classes.select(F.col("rep").alias("b"), F.col("raw").alias("two"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(trimmed(_true_links(threshold, kind)), "a long, b long")


def _count_small(threshold: float, kind: str):
    """Rows sorted by component: of each, the copies of the others that link with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        out: tuple[list[int], list[int]] = ([], [])

        def close() -> None:
            if len(held) > 1:
                x, copies = units([h[2] for h in held], kind), np.array([h[1] for h in held])
                for k in range(0, len(held), 256):
                    links = x[k : k + 256] @ x.T >= threshold
                    links[np.arange(len(links)), k + np.arange(len(links))] = False
                    out[0].extend(h[0] for h in held[k : k + 256])
                    out[1].extend((links @ copies).tolist())

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["node", "others"])
            out[0].clear()
            out[1].clear()
            return batch

        for batch in batches:
            for c, *row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if c != key:
                    close()
                    key, held = c, []
                held.append(row)
            if len(out[0]) > 100_000:
                yield flush()
        close()
        yield flush()

    return run


def _centre_sums(kind: str):
    """Sums of a task's unit vectors by component; large components only, whose number is small against the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["component", "part"])
            sums.clear()
            return batch

        for batch in batches:
            keys, raws = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for _, at in by_length(raws) if raws else ():
                x = units([raws[i] for i in at], kind)
                for c in np.unique(keys[at]).tolist():
                    s = x[keys[at] == c].sum(0)
                    sums[c] = sums[c] + s if c in sums else s
            if len(sums) > 5_000:
                yield flush()
        yield flush()

    return run


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by component: its parts added up."""
    key, total = None, None
    for batch in batches:
        out: tuple[list[int], list[bytes]] = ([], [])
        for c, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(raw, np.float64)
            if c != key and total is not None:
                out[0].append(key)
                out[1].append(total.tobytes())
            key, total = c, part if c != key else total + part
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["component", "centre"])
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["component", "centre"])


def _is_core(threshold: float, kind: str):
    """Whether a row is so near the centre that any two such rows link."""
    most = math.acos(threshold) / 2 - 1e-7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, centres = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            core = np.zeros(len(raws), bool)
            for _, at in by_length(raws) if raws else ():
                x, c = units([raws[i] for i in at], kind), units([centres[i] for i in at], "<f8")
                core[at] = np.arccos(np.clip((x * c).sum(1), -1, 1)) <= most
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(4)] + [pa.array(core)], ["component", "node", "copies", "raw", "core"])

    return run


def _count_tiles(threshold: float, kind: str):
    """Rows sorted by tile, those of the fringe first: links of the fringe with all rows, of core rows with the fringe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        fringe: list[tuple] = []
        x = weights = counts = names = None

        def settle() -> pa.RecordBatch | None:
            nonlocal x
            if x is None:
                return None
            at = np.flatnonzero(counts)
            batch = pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(counts[at])], ["node", "others"])
            x = None
            return batch

        for batch in batches:
            rows: list[tuple] = list(zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True))
            i = 0
            while i < len(rows):
                if rows[i][:3] != key:
                    if (done := settle()) is not None:
                        yield done
                    key, fringe = rows[i][:3], []
                end = i
                while end < len(rows) and rows[end][:3] == key:
                    end += 1
                group = rows[i:end]
                i = end
                fringe += [r for r in group if r[3] == 0]
                members = [r for r in group if r[3] == 1]
                if not members:
                    continue
                if x is None:
                    x, weights, names = units([r[6] for r in fringe], kind), np.array([r[5] for r in fringe]), np.array([r[4] for r in fringe])
                    counts = np.zeros(len(x), np.int64)
                for k in range(0, len(members), 512):
                    some = members[k : k + 512]
                    links = x @ units([r[6] for r in some], kind).T >= threshold
                    ids, copies, core = (np.array([r[c] for r in some]) for c in (4, 5, 7))
                    links &= names[:, None] != ids
                    counts += links @ copies
                    own = (weights @ links)[core]
                    at = np.flatnonzero(own)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[core][at], pa.int64()), pa.array(own[at], pa.int64())], ["node", "others"])
        if (done := settle()) is not None:
            yield done

    return run


def link_counts(labels: DataFrame, classes: DataFrame, threshold: float, kind: str, tile_mb: float = 16.0, small: int = 512) -> DataFrame:
    """``node, others``: the copies of the other classes of its component that link with each class.

    A component of at most ``small`` rows and ``tile_mb`` is compared whole.
    """
    sized = labels.groupBy("component").agg(F.count("*").alias("s")).select(rekeyed("component"), "s")
    members = labels.select(rekeyed("component"), "component", "node").join(sized, "key").join(classes, F.col("node") == classes["rep"])
    width = F.octet_length("raw") * (8 // int(kind[-1]))
    members = materialize(members.select("component", "node", "copies", "raw", "s", ((F.col("s") > small) | (F.col("s") * width > tile_mb * 1e6)).alias("large")), "members")
    row = "component", "node", "copies", "raw"
    out = members.where("not large").select(*row).repartition("component").sortWithinPartitions("component").mapInArrow(trimmed(_count_small(threshold, kind)), "node long, others long")
    large = members.where("large")
    if large.isEmpty():
        return out
    sums = large.select("component", "raw").mapInArrow(trimmed(_centre_sums(kind)), "component long, part binary")
    centres = sums.repartition("component").sortWithinPartitions("component").mapInArrow(_centres, "component long, centre binary")
    placed = large.select(rekeyed("component"), *row).join(centres.select(rekeyed("component"), "centre"), "key").select(*row, "centre")
    placed = materialize(placed.mapInArrow(trimmed(_is_core(threshold, kind)), "component long, node long, copies long, raw binary, core boolean"), "placed")
    tile = F.greatest(F.lit(16), F.floor(F.lit(tile_mb * 1e6) / F.max(width)))
    figures = placed.groupBy("component").agg(
        F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("sure"),
        F.ceil(F.sum(F.when(F.col("core"), 0).otherwise(1)) / tile).cast("int").alias("blocks"),
        F.ceil(F.count("*") / tile).cast("int").alias("tiles"),
    ).select(rekeyed("component"), "sure", "blocks", "tiles")
    placed = placed.withColumn("key", rekeyed("component")).join(figures, "key")
    core = placed.where("core").select("node", (F.col("sure") - F.col("copies")).alias("others"))
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = "node", "copies", "raw", "core"
    one = placed.where("not core").select("component", mine("blocks").alias("q"), each("tiles").alias("t"), F.lit(0).alias("role"), *rest)
    two = placed.where("blocks > 0").select("component", each("blocks").alias("q"), mine("tiles").alias("t"), F.lit(1).alias("role"), *rest)
    tiles = one.unionAll(two).repartition("component", "q", "t").sortWithinPartitions("component", "q", "t", "role")
    counted = tiles.mapInArrow(trimmed(_count_tiles(threshold, kind)), "node long, others long")
    return out.unionAll(counted.unionAll(core).groupBy("node").agg(F.sum("others").alias("others")))


def passes_for(spread: dict[int, int], threshold: float = THRESHOLD, recall: float = 0.99, within: float = 1.0) -> int:
    """Passes after which a link at the threshold is found with probability ``recall``.

    ``spread``: rows by the leading bits that the rows of a window share.  ``within``: the
    probability that two linked codes of one window differ in few enough bits.
    """
    total = sum(spread.values())
    if not total:
        return 1
    same = 1 - math.acos(threshold) / math.pi
    meet = {b: same**b * within for b in spread}
    missed = lambda p: sum(n * (1 - meet[b]) ** p for b, n in spread.items()) / total
    p = 1
    while missed(p) > 1 - recall and p < MOST_PASSES:
        p += max(1, p // 16)
    return p


def near_duplicates(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK, recall: float = 0.99, seed: int = 11, rows_a_part: int = 100_000, rows_a_job: int = 2_000_000_000, tile_mb: float = 16.0) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id`` and ``kept`` of every row.

    ``rows_a_part``: rows of a range; ``rows_a_job``: rows that one job orders, which bounds
    its tasks and its disk; ``tile_mb``: vectors a task compares at a time.
    """
    kind = "<f4" if isinstance(df.schema[vector_col].dataType, ArrayType) and isinstance(df.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    vector = F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>")
    prepared = df.select(long_id(id_col).alias("id"), vector.alias("v")).mapInArrow(trimmed(_prepare(kind)), "id long, k1 long, k2 long, raw binary")
    keys = materialize(prepared, "vectors")
    # a class is represented by its least id; a null id only joins its class's count
    classes = materialize(keys.where("k1 is not null and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("raw").alias("raw")), "classes")
    n = classes.count()
    angle = math.acos(threshold) / math.pi
    limit = math.floor(128 * angle + 1.5 * math.sqrt(128 * angle * (1 - angle)))
    found: list[DataFrame] = []
    done, wanted = 0, FIRST
    spread: dict[int, int] = {}
    while done < wanted and n:
        some = range(done, min(wanted, done + max(1, rows_a_job // n)))
        parts = max(1, math.ceil(n * len(some) / rows_a_part))
        coded = classes.select("rep", "raw").mapInArrow(trimmed(_codes(some, seed, kind)), _CODE)
        tie = F.xxhash64("id", "lane")  # rows of one code are cut elsewhere in each pass
        ordered = coded.repartitionByRange(parts, "lane", "hi", "lo", tie).sortWithinPartitions("lane", "hi", "lo", tie)
        seen = materialize(ordered.mapInArrow(trimmed(_windows(limit, block, True)), _FOUND), "windows")
        ends = seen.where("border is not null").select("border", "lane", "hi", "lo", F.col("a").alias("id"))
        # both sides of an end are one block of a lane of their own
        across = ends.repartition("border").sortWithinPartitions("border", "lane", "hi", "lo").select(F.xxhash64("border", "lane").alias("lane"), "hi", "lo", "id")
        across = across.mapInArrow(trimmed(_windows(limit, 2 * block, False)), _FOUND)
        found.append(seen.where("b is not null").unionAll(across.where("b is not null")).select("a", "b", F.lit(some.start > 0).alias("later")))
        if not spread:
            spread = {r["bits"]: r["n"] for r in seen.where("bits is not null").groupBy("bits").agg(F.sum("rows").alias("n")).collect()}
            wanted = max(wanted, passes_for(spread, threshold, recall, within=0.93))
        done = some.stop
    pairs = None
    for x in found:
        pairs = x if pairs is None else pairs.unionAll(x)
    if pairs is None:
        pairs = classes.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(False).alias("later")).limit(0)
    pairs = materialize(pairs.groupBy("a", "b").agg(F.min("later").alias("later")), "pairs")
    links = materialize(verified(pairs.where("not later").select("a", "b"), classes, threshold, kind), "verified")
    labels = connected_components(links)
    if len(found) > 1:
        labels = materialize(labels, "labels")
        of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias("of_" + x))
        open_pairs = pairs.where("later").join(of("a"), "a", "left").join(of("b"), "b", "left").where("not coalesce(of_a = of_b, false)").select("a", "b")
        more = verified(open_pairs, classes, threshold, kind)
        labels = connected_components(more.unionAll(labels.select(F.col("component").alias("a"), F.col("node").alias("b"))))
    labels = materialize(labels, "labels")
    counts = link_counts(labels, classes, threshold, kind, tile_mb)
    described = classes.select("k1", "k2", "rep", "copies").join(labels, F.col("rep") == labels["node"], "left").drop("node")
    described = described.join(counts, described["rep"] == counts["node"], "left").select("k1", "k2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = keys.select("id", "k1", "k2").join(described, ["k1", "k2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
