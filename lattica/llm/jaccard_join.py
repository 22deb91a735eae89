"""Exact Jaccard join of word-shingle sets by a partition of the universe.

Sets are put into size bands.  For a band, two sets that link differ in at most H elements,
so of more than H parts of a partition of all shingles at least one agrees.  Every set
indexes its non-empty parts; sets of small bands also index a coarser partition with the
one-deletion neighbourhood of each part, where a part that differs in one element still
meets.  How many sets share a signature is counted over the whole corpus, and each set
then allocates its own H + 1 among its cheapest signatures: a part costs what its rarest
level costs, and with H + 1 signatures that nobody shares a set provably links with none.
Should a set have too few non-empty parts in every partition, its band is indexed again
with twice the parts, until none has.

Only sets that share an allocated signature are compared, exactly, and only while they are
not connected yet.  First each set is compared with the hub of its lists, the least set of
a list, which settles groups of near copies with one comparison a set; then with its other
hubs.  A group of candidates that still holds several components is then compared whole, if
it is no more than a block; a larger one by the lists that its sets share, without those of
one component and those that repeat another's members, or whole if that costs less; what
is more than a block is compared pair by pair of blocks.
What is returned is a spanning set of the links, never the links of a clique one by one.

Equal sets are one class: they are found by 128 bits of hash before anything is joined,
and sent once from each task.  Shingles are compared by 64-bit hashes of their words.
Signatures travel as packed binary rows, one for each task and target; a target of more
than ``part_mb`` of input is worked off in pieces, and a signature too frequent for memory
counts as frequent without its sets being held.

Defined results: null or empty texts, and texts of white space alone, have an empty set and
link with nothing; a text of fewer words than the width is one shingle; rows that
repeat an id are one node, linked if any of its texts is; a null id is returned with a
null component and links with nothing; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_tables, input_bytes, long_id, materialize, read_table, release, text_groups, trimmed
from .components import connected_components, rekeyed

WIDTH = 5
NUM, DEN = 75, 100
U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C13
#: Bands up to this size also index one-deletion neighbourhoods.
SMALL = 48
FINE = 4096


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    both = []
    for base in (_BASE, inverse):
        x = np.full(size, base, U64)
        x[0] = 1
        both.append(np.multiply.accumulate(x))
    return both[0], both[1]


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    out: list[np.ndarray] = []
    for a, b in text_groups(texts, 800_000):
        raws = [(t or "").encode().lower() for t in texts[a:b]]
        raw = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        ends_of = np.cumsum([len(r) + 1 for r in raws])
        size = 1 << max(20, int(len(raw)).bit_length())
        power, inverse = _powers(size)
        inside = np.concatenate([[False], ~_SPACE[raw]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[0::2], edge[1::2]
        total = np.cumsum(_BYTES[raw] * power[: len(raw)], dtype=U64)
        total = np.concatenate([np.zeros(1, U64), total])
        words = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))
        per_text = np.searchsorted(starts, ends_of)
        counts = np.diff(np.concatenate([[0], per_text]))
        if len(words) >= width:
            n = len(words) - width + 1
            grams = words[:n].copy()
            for k in range(1, width):
                grams = (grams ^ (grams >> U64(29))) * U64(0xBF58476D1CE4E5B9) + words[k : n + k]
            grams = mix(grams)
        first = 0
        for c in counts.tolist():
            if c >= width:
                out.append(np.unique(grams[first : first + c - width + 1]))
            elif c:
                h = U64(c)
                for w in words[first : first + c]:
                    h = mix(np.array([h * U64(0x94D049BB133111EB) + w], U64))[0]
                out.append(np.array([h], U64))
            else:
                out.append(np.zeros(0, U64))
            first += c
    return out


np.seterr(over="ignore")


def largest_partner(a: int) -> int:
    return a * DEN // NUM


def differ(a: int, c: int) -> int:
    """Most elements by which linked sets of sizes a and c can differ."""
    return a + c - 2 * math.ceil(NUM * (a + c) / (NUM + DEN))


def _band_edges(top: int) -> list[int]:
    edges = [1, 2, 3]
    while edges[-1] <= top:
        edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2 if edges[-1] > 3 else 4))
    return edges


_EDGES = np.array(_band_edges(1 << 40), np.int64)


@lru_cache(maxsize=None)
def band(k: int, again: int = 0, scale: float = 1.0) -> tuple[int, int, int, int]:
    """Least size, end of sizes, parts of the fine and of the coarse partition (0: none) of band k.

    ``again``: how often the band was indexed before; its parts double, without a coarse partition.
    """
    low, high = int(_EDGES[k]), int(_EDGES[k + 1])
    need = (high - 1 + largest_partner(high - 1)) // 7 + 1
    if high - 1 <= SMALL:
        return low, high, FINE << again, 0 if again else max(2, math.ceil(0.7 * need))
    return low, high, math.ceil(scale * (2.6 if high <= 70 else 2.2 if high <= 200 else 1.6) * need) << again, 0


def memberships(size: int) -> list[tuple[int, int]]:
    """(band, which): its own band, and the one below if a linked set can lie there; sizes 1 and 2 only link with equals."""
    if size < 3:
        return []
    k = int(np.searchsorted(_EDGES, size, side="right")) - 1
    out = [(k, 0)]
    least = -(-size * NUM // DEN)
    if least < _EDGES[k] and _EDGES[k - 1] >= 3:
        out.append((k - 1, 1))
    return out


def needed(size: int, which: int) -> int:
    """H + 1 of a set of this size in its own band, or as the larger one in the band below."""
    if not which:
        return (size + largest_partner(size)) // 7 + 1
    k = int(np.searchsorted(_EDGES, size, side="right")) - 1
    return (size + int(_EDGES[k]) - 1) // 7 + 1


def _parts(elements: np.ndarray, parts: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Part numbers, hash sums of the non-empty parts, sizes, and each element's part row and value."""
    value = mix(elements + U64(salt))
    part = ((value >> U64(40)) * U64(parts) >> U64(24)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    value, part = value[order], part[order]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    sums = np.add.reduceat(value, first)
    sizes = np.diff(np.append(first, len(part)))
    return part[first], sums, sizes, value


def signatures(elements: np.ndarray, again: int = 0, scale: float = 1.0, bands: frozenset[int] | None = None) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """64-bit signatures, their 8 bits of meaning, and for each ``which`` the parts a set has; of all bands or of ``bands``.

    Meaning: which << 7 | coarse << 6 | deletion << 5 | part (coarse only).  A figure holds the
    fine parts in its low 32 bits, then the coarse ones, then those of two elements or more.
    """
    sigs, kinds, figures = [], [], [0, 0]
    for k, which in memberships(len(elements)):
        if bands is not None and k not in bands:
            continue
        _, _, fine, coarse = band(k, again, scale)
        salt_of = 2 * k + 1 + (again << 20)
        seg, sums, sizes, _ = _parts(elements, fine, salt_of)
        sigs.append(mix(sums ^ mix(seg.astype(U64) + U64(salt_of << 40))))
        kinds.append(np.full(len(sums), which << 7, np.uint8))
        figures[which] = len(sums)
        if coarse:
            seg, sums, sizes, value = _parts(elements, coarse, 2 * k + 2)
            salt = mix(seg.astype(U64) + U64((2 * k + 2) << 40))
            sigs.append(mix(sums ^ salt))
            kinds.append((which << 7 | 1 << 6 | seg).astype(np.uint8))
            row = np.repeat(np.arange(len(sums)), sizes)
            row, value = row[sizes[row] > 1], value[sizes[row] > 1]
            sigs.append(mix((sums[row] - value) ^ salt[row]))
            kinds.append((which << 7 | 1 << 6 | 1 << 5 | seg[row]).astype(np.uint8))
            figures[which] |= len(sums) << 32 | int((sizes > 1).sum()) << 48
    if not sigs:
        return np.zeros(0, U64), np.zeros(0, np.uint8), figures
    return np.concatenate(sigs), np.concatenate(kinds), figures


#: What travels between stages: signatures of sets, figures of sets, shared signatures, allocations.
_ENTRY = np.dtype([("set", "<u8"), ("sig", "<u4"), ("kind", "u1")])
_FIGURE = np.dtype([("set", "<u8"), ("size", "<i8"), ("fig", "<i8", 2), ("label", "<i8")])
_SHARED = np.dtype([("set", "<u8"), ("sig", "<u8"), ("kind", "u1"), ("count", "<i8")])
_CHOSEN = np.dtype([("set", "<u8"), ("sig", "<u8")])
_LABELLED = np.dtype([("set", "<u8"), ("sig", "<u8"), ("label", "<i8")])


def set_hash(elements: np.ndarray) -> int:
    """A hash of the whole set, as a signed 64-bit number; 0 for the empty set."""
    return int(mix(np.array([elements.sum(dtype=U64) + U64(len(elements))], U64)).view(np.int64)[0]) if len(elements) else 0


def second_hash(elements: np.ndarray) -> int:
    """64 bits more, from other sums."""
    return int(mix(elements ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).view(np.int64)) if len(elements) else 0


#: Targets of an exchange at most; beyond, a target's rows are cut into pieces where they lie.
TARGETS = 20_000
#: Entries of one piece that a task holds before it takes its frequent signatures out.
HELD = 8_000_000
OFTEN = 1 << 40


@dataclass(frozen=True)
class Exchange:
    """``parts`` targets of ``pieces`` each."""

    parts: int
    pieces: int = 1
    held: int = HELD

    @classmethod
    def of(cls, size: int, part_mb: float, targets: int = TARGETS, held: int = HELD) -> Exchange:
        wanted = max(1, round(size / (part_mb * 1e6)))
        return cls(min(wanted, targets), -(-wanted // targets), held)

    def deal(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        return _deal(keys, self.parts)

    def send(self, rows: DataFrame, schema: str, *steps) -> DataFrame:
        """Rows ``at, blob`` to their targets, cut into pieces there, through ``steps``, each on the result of the one before."""
        out = rows.repartitionById(self.parts, F.col("at"))
        if self.pieces > 1:  # packed anew where they lie, and sorted by Spark, which spills
            out = out.mapInArrow(trimmed(_cut(self)), "at int, blob binary").sortWithinPartitions("at")
        else:
            out = out.sortWithinPartitions(F.substring("blob", 1, 1))
        for step in steps:
            out = out.mapInArrow(trimmed(step), schema)
        return out


def _deal(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, row numbers) of keys dealt by their value."""
    at = (keys % U64(parts)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    bounds = np.searchsorted(at[order], np.arange(parts + 1))
    for p in range(parts):
        if bounds[p] < bounds[p + 1]:
            yield p, order[bounds[p] : bounds[p + 1]]


def _blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["at", "blob"])


def _index(ex: Exchange, width: int, again: int, scale: float, bands: frozenset[int] | None):
    """Stage 1: signatures of each task's distinct sets to the signatures' targets, figures to the sets'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, labels = (batch.column(k).to_pylist() for k in range(3))
            for a, b in text_groups(texts, 8_000_000):
                sets, label_of = {}, {}
                for d, s, label in zip(docs[a:b], shingle_sets(texts[a:b], width), labels[a:b], strict=True):
                    if d is not None and len(s) > 2:
                        name = set_hash(s) % 2**64
                        sets[name], label_of[name] = s, label
                if not sets:
                    continue
                names = np.array(list(sets), U64)
                found = [signatures(s, again, scale, bands) for s in sets.values()]
                figures = np.zeros(len(sets), _FIGURE)
                figures["set"], figures["size"] = names, [len(s) for s in sets.values()]
                figures["fig"], figures["label"] = [f[2] for f in found], list(label_of.values())
                entries = np.zeros(sum(len(f[0]) for f in found), _ENTRY)
                sig = np.concatenate([f[0] for f in found])
                entries["set"] = np.repeat(names, [len(f[0]) for f in found])
                entries["sig"] = sig & U64(0xFFFFFFFF)
                entries["kind"] = np.concatenate([f[1] for f in found])
                del found, sets
                rows = [(p, b"E" + entries[at].tobytes()) for p, at in ex.deal(sig >> U64(32))]
                rows += [(p, b"F" + figures[at].tobytes()) for p, at in ex.deal(mix(names))]
                yield _blobs(rows)

    return run


#: Kinds of rows: their arrays, and what says the piece of an entry.
_KINDS = {
    b"A": (_CHOSEN, lambda e: mix(e["sig"])),  # allocations come before the entries that share their signatures
    b"B": (_LABELLED, lambda e: mix(e["sig"])),
    b"C": (_CHOSEN, lambda e: mix(e["sig"])),
    b"D": (_LABELLED, lambda e: mix(e["sig"])),
    b"E": (_ENTRY, lambda e: e["sig"].astype(U64)),
    b"F": (_FIGURE, lambda e: mix(e["set"])),
    b"S": (_SHARED, lambda e: mix(e["set"])),
}


def _cut(ex: Exchange):
    """Rows of a target as rows of its pieces: ``at`` is piece and kind, so that sorting brings both together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list[bytes]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            batch = _blobs([(piece << 8 | tag[0], tag + b"".join(parts)) for (piece, tag), parts in held.items()])
            held.clear()
            size = 0
            return batch

        for batch in batches:
            for blob in batch.column(1):
                raw = blob.as_buffer()
                tag = raw[:1].to_pybytes()
                kind, of = _KINDS[tag]
                e = np.frombuffer(raw, kind, offset=1)
                for piece, at in _deal(of(e) // U64(ex.parts), ex.pieces):
                    part = e[at].tobytes()
                    held.setdefault((piece, tag), []).append(part)
                    size += len(part)
            if size > 64_000_000:
                yield flush()
        yield flush()

    return run


def _pieces(ex: Exchange, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(piece, kind, array) of rows in order of piece and kind."""
    for batch in batches:
        for at, blob in zip(batch.column(0), batch.column(1), strict=True):
            raw = blob.as_buffer()
            tag = raw[:1].to_pybytes()
            yield (at.as_py() >> 8 if ex.pieces > 1 else 0), tag, np.frombuffer(raw, _KINDS[tag][0], offset=1)


def _count(ex: Exchange):
    """Stage 2: how many sets share each signature; entries of shared ones go to their sets, figures go on.

    Entries beyond ``held`` are thinned: signatures that hold most of them count as OFTEN, and
    their entries pass at once.
    """

    def counted(e: np.ndarray) -> np.ndarray:
        sig = whole(e)
        order = np.argsort(sig)
        sig = sig[order]
        same = np.zeros(len(sig) + 1, bool)
        same[1:-1] = sig[1:] == sig[:-1]
        shared = same[1:] | same[:-1]
        e, sig = e[order[shared]], sig[shared]
        order = np.lexsort((e["kind"], e["set"], sig))
        e, sig = e[order], sig[order]
        if not len(e):
            return np.zeros(0, _SHARED)
        new_sig = np.concatenate([[True], sig[1:] != sig[:-1]])
        new_set = new_sig.copy()
        new_set[1:] |= e["set"][1:] != e["set"][:-1]
        new_kind = new_set.copy()
        new_kind[1:] |= e["kind"][1:] != e["kind"][:-1]
        group = np.cumsum(new_sig) - 1
        count = np.bincount(group, new_set.astype(np.float64)).astype(np.int64)[group]
        return shared_rows(e, sig, count, new_kind & (count > 1))

    def shared_rows(e: np.ndarray, sig: np.ndarray, count: np.ndarray, stay: np.ndarray) -> np.ndarray:
        out = np.zeros(int(stay.sum()), _SHARED)
        out["set"], out["kind"], out["count"], out["sig"] = e["set"][stay], e["kind"][stay], count[stay], sig[stay]
        return out

    def whole(e: np.ndarray) -> np.ndarray:
        """Signatures, the target in place of the bits that led there; two that then are equal only cost comparisons."""
        return e["sig"].astype(U64) | U64(TaskContext.get().partitionId() << 32)

    def often(e: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of frequent signatures as shared ones, the other entries, and the frequent signatures known now."""
        sig = whole(e)
        values, counts = np.unique(sig, return_counts=True)
        known = np.union1d(known, values[counts > max(1000, len(e) // 1000)])
        hit = np.isin(sig, known)
        return shared_rows(e, sig, np.full(len(e), OFTEN), hit), e[~hit], known

    def sent(out: np.ndarray) -> list[tuple[int, bytes]]:
        return [(p, b"S" + out[at].tobytes()) for p, at in ex.deal(mix(out["set"]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        piece, held, size, known = -1, [], 0, np.zeros(0, U64)
        for at, tag, e in _pieces(ex, batches):
            if tag == b"F":
                yield _blobs([(part, b"F" + e.tobytes())])
                continue
            if at != piece:
                if held:
                    yield _blobs(sent(counted(np.concatenate(held))))
                piece, held, size, known = at, [], 0, known[:0]
            if len(known):
                hit = np.isin(whole(e), known)
                if hit.any():
                    yield _blobs(sent(shared_rows(e, whole(e), np.full(len(e), OFTEN), hit)))
                    e = e[~hit]
            held.append(e)
            size += len(e)
            if size > ex.held:
                out, rest, known = often(np.concatenate(held), known)
                yield _blobs(sent(out))
                held, size = [rest], len(rest)
        if held:
            yield _blobs(sent(counted(np.concatenate(held))))

    return run


def _choose(entries: np.ndarray, size: int, figures: np.ndarray) -> tuple[int, np.ndarray]:
    """Cost and allocation over the shared signatures of one set in one band and partition.

    ``entries`` are those with a count of two or more; all other parts cost one.
    """
    coarse = bool(entries["kind"][0] >> 6 & 1)
    which = int(entries["kind"][0] >> 7)
    need, fig = needed(size, which), int(figures[which])
    if not coarse:
        free = (fig & 0xFFFFFFFF) - len(entries)
        if free >= need:
            return 1, np.zeros(len(entries), bool)
        costs = np.sort(entries["count"])
        if need - free > len(costs):
            return -1, np.ones(len(entries), bool)
        cost = int(costs[need - free - 1])
        return cost, entries["count"] <= cost
    seg, deletion = entries["kind"] & 31, (entries["kind"] >> 5 & 1).astype(bool)
    full = np.ones(32, np.int64)
    np.maximum.at(full, seg[~deletion], entries["count"][~deletion])
    both = full.copy()
    np.maximum.at(both, seg[deletion], entries["count"][deletion])
    # parts whose signatures nobody shares cost one; of those with shared ones it is not known
    # here whether they have two elements, but deletion entries say so; unshared ones are in fig
    named = np.zeros(32, bool)
    named[seg] = True
    pairs = np.zeros(32, bool)
    pairs[seg[deletion]] = True
    singles, doubles = fig >> 32 & 0xFFFF, fig >> 48
    events = [*([1] * (singles - int(named.sum())))]
    events += full[named].tolist() + both[pairs].tolist()
    events += [1] * max(0, doubles - int(pairs.sum()) - int((named & ~pairs).sum()))
    events.sort()
    if len(events) < need:
        return -1, np.ones(len(entries), bool)
    cost = events[need - 1]
    return cost, np.where(deletion, both[seg] <= cost, full[seg] <= cost)


def free_elsewhere(entry: np.void, size: int, figures: np.ndarray) -> bool:
    """Whether the band's other partition, none of whose signatures is shared, has parts enough."""
    which = int(entry["kind"]) >> 7
    fig = int(figures[which])
    have = fig & 0xFFFFFFFF if entry["kind"] >> 6 & 1 else (fig >> 32 & 0xFFFF) + (fig >> 48)
    return have >= needed(size, which)


def _allocate(ex: Exchange, lists: bool):
    """Stage 3: each set allocates H + 1 among its cheapest signatures.

    A set whose allocation nobody shares links with none in that band and is left out.  The
    sizes of sets with too few parts in every partition go to target -1.
    """

    def chosen(e: np.ndarray, figures: np.ndarray) -> list[tuple[int, bytes]]:
        figures = figures[np.argsort(figures["set"], kind="stable")]
        e = e[np.lexsort((e["kind"] >> 6, e["set"]))]
        own = figures[np.searchsorted(figures["set"], e["set"])]
        key = e["kind"] >> 6
        first = np.flatnonzero(np.concatenate([[True], (e["set"][1:] != e["set"][:-1]) | (key[1:] != key[:-1])]))
        end = np.append(first[1:], len(e))
        on = np.zeros(len(e), bool)
        alone = np.zeros(len(e), bool)  # entries of sets that link with none in their band
        failed: set[int] = set()
        i = 0
        while i < len(first):
            a, b = first[i], end[i]
            size, figs = int(own["size"][a]), own["fig"][a]
            found = [(a, b, *_choose(e[a:b], size, figs))]
            if i + 1 < len(first) and e["set"][first[i + 1]] == e["set"][a] and key[first[i + 1]] >> 1 == key[a] >> 1:
                i += 1
                found.append((first[i], end[i], *_choose(e[first[i] : end[i]], size, figs)))
            elif free_elsewhere(e[a], size, figs):
                found.append((a, a, 1, on[:0]))
            good = [c for c in found if c[2] > 0]
            if good:
                best = min(good, key=lambda c: c[2])
                on[best[0] : best[1]] = best[3]
                alone[a : end[i]] = best[2] == 1
            else:
                failed.add(memberships(size)[-1 if key[a] >> 1 else 0][0])
            i += 1
        rows = [(-1, b"X" + np.array(sorted(failed), "<i4").tobytes())] if failed else []
        for tag, keep in ((b"B" if lists else b"A", on & ~alone), (b"D" if lists else b"C", ~on & ~alone)):
            out = np.zeros(int(keep.sum()), _KINDS[tag][0])
            out["set"], out["sig"] = e["set"][keep], e["sig"][keep]
            if lists:
                out["label"] = own["label"][keep]
            rows += [(p, tag + out[at].tobytes()) for p, at in ex.deal(mix(out["sig"]))]
        return rows

    def few_parts(f: np.ndarray) -> list[tuple[int, bytes]]:
        """Bands of sets that have too few parts in both partitions, whether they share any or not."""
        size = f["size"]
        own = np.searchsorted(_EDGES, size, side="right") - 1
        need = np.stack([(size + size * DEN // NUM) // 7 + 1, (size + _EDGES[own] - 1) // 7 + 1], 1)
        fig = f["fig"]
        have = np.maximum(fig & 0xFFFFFFFF, (fig >> 32 & 0xFFFF) + (fig >> 48))
        short = (fig != 0) & (have < need)
        failed = np.unique(np.concatenate([own[short[:, 0]], own[short[:, 1]] - 1]))
        return [(-1, b"X" + failed.astype("<i4").tobytes())] if len(failed) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, entries, figures = -1, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if not figures:
                return
            f = np.concatenate(figures)
            yield _blobs(few_parts(f))
            if entries:
                yield _blobs(chosen(np.concatenate(entries), f))

        for at, tag, e in _pieces(ex, batches):
            if at != piece:
                yield from close()
                piece, entries, figures = at, [], []
            (figures if tag == b"F" else entries).append(e)
        yield from close()

    return run


def _connect(ex: Exchange, lists: bool):
    """Stage 4: of the signatures that some set allocated, ``a, b, n``: hub, other set, and how often.

    With ``lists`` instead the members of each list of several labels: ``a`` the signature, ``b``
    the set, ``n`` its label.  What does not fit in memory goes out early, of whatever labels;
    its signatures keep their hubs.
    """

    def rows_of(held: list[np.ndarray], known: tuple[np.ndarray, np.ndarray], whole: bool) -> tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray]]:
        """Rows of what is held, and the hubs of its signatures beside those ``known`` (signatures in order, hubs)."""
        e = np.concatenate(held)
        name = e["set"].astype(np.int64)
        order = np.lexsort((name, e["sig"]))
        sig, name = e["sig"][order], name[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (name[1:] != name[:-1])
        sig, name, order = sig[new], name[new], order[new]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(sig))))
        values, hubs = sig[first], name[first].copy()
        if len(known[0]):
            at = np.minimum(np.searchsorted(known[0], values), len(known[0]) - 1)
            hubs = np.where(known[0][at] == values, known[1][at], hubs)
        if lists:
            n = e["label"][order]
            keep = np.ones(len(sig), bool)
            if whole:
                keep = (np.minimum.reduceat(n, first) != np.maximum.reduceat(n, first))[group]
            pairs, n = np.stack([sig.view(np.int64), name], 1)[keep], n[keep]
        else:
            keep = hubs[group] != name
            pairs, n = np.unique(np.stack([hubs[group][keep], name[keep]], 1), axis=0, return_counts=True)
        both, where = np.unique(np.concatenate([known[0], values]), return_index=True)
        batch = pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n, pa.int64())], ["a", "b", "n"])
        return batch, (both, np.concatenate([known[1], hubs])[where])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(0, U64), np.zeros(0, np.int64)
        piece, held, size, active, hubs = -1, [], 0, nothing[0], nothing
        for at, tag, e in _pieces(ex, batches):
            if at != piece:
                if size:
                    yield rows_of(held, hubs, not len(hubs[0]))[0]
                piece, held, size, active, hubs = at, [], 0, nothing[0], nothing
            if tag in b"AB":  # all allocations of the piece come first
                active = np.union1d(active, e["sig"])
            else:
                e = e[np.isin(e["sig"], active)]
            held.append(e)
            size += len(e)
            if size > ex.held:
                batch, hubs = rows_of(held, hubs, False)
                yield batch
                held, size = [], 0
        if size:
            yield rows_of(held, hubs, not len(hubs[0]))[0]

    return run


def candidates(texts: DataFrame, width: int, ex: Exchange, lists: bool = False, scale: float = 1.0) -> DataFrame:
    """``a, b, n`` of _connect() over ``texts`` (id, text, label): every pair of linked, different sets shares a list.

    Bands in which a set has too few parts are indexed again, with more.
    """
    blob = "at int, blob binary"
    out, bands, again = None, None, 0
    while True:
        rows = texts.mapInArrow(trimmed(_index(ex, width, again, scale, bands)), blob)
        rows = ex.send(rows, blob, _count(ex))
        rows = materialize(ex.send(rows, blob, _allocate(ex, lists)), "allocated")
        found = ex.send(rows.where("at >= 0"), "a long, b long, n long", _connect(ex, lists))
        found = found.groupBy("a", "b").agg(F.sum("n").alias("n")) if not lists else found
        found = materialize(found, "candidates")
        failed = rows.where("at < 0").select("blob").distinct()  # at most as many rows as combinations of bands that failed
        bands = frozenset(int(k) for r in failed.toLocalIterator() for k in np.frombuffer(r["blob"][1:], "<i4"))
        drop_tables(texts.sparkSession, rows)
        release(texts.sparkSession)
        out = found if out is None else out.unionAll(found)
        if not bands:
            return out
        again += 1


def block_links(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets link, as a symmetric matrix.

    Elements of many sets are counted by a matrix product, the others pair by pair.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    counts = np.diff(np.append(first, len(flat)))
    often = counts > max(4, n // 32)
    common = np.zeros((n, n), np.float32)
    upper = common.reshape(-1)
    for c in np.unique(counts[~often & (counts > 1)]).tolist():
        i, j = np.triu_indices(c, 1)
        at = first[~often & (counts == c)]
        step = max(1, 2_000_000 // len(i))
        for k in range(0, len(at), step):
            rows = owner[at[k : k + step, None] + np.arange(c)]
            np.add.at(upper, (rows[:, i] * n + rows[:, j]).reshape(-1), 1)
    common += common.T.copy()
    cells = np.repeat(np.cumsum(often) - 1, counts)
    mask = np.repeat(often, counts)
    for a in range(0, int(often.sum()), 2048):
        part = mask & (cells >= a) & (cells < a + 2048)
        dense = np.zeros((n, 2048), np.float32)
        dense[owner[part], cells[part] - a] = 1
        common += dense @ dense.T
    union = sizes[:, None] + sizes[None, :] - common
    links = DEN * common.astype(np.float64) >= NUM * union
    np.fill_diagonal(links, False)
    return links


def forest(links: np.ndarray) -> np.ndarray:
    """The least row reachable from each row of a symmetric matrix of links."""
    label = np.arange(len(links))
    while True:
        low = np.where(links, label[None, :], len(label)).min(1, initial=len(label))
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _sets(width: int):
    """Rows group, role, node, label and text as rows with the set in place of the text; empty sets are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(5).to_pylist()
            for a, b in text_groups(texts, 4_000_000):
                raws = [x.tobytes() for x in shingle_sets(texts[a:b], width)]
                keep = pa.array([i for i, r in enumerate(raws) if r])
                rows = [batch.column(k).slice(a, b - a).take(keep) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*rows, pa.array([r for r in raws if r], pa.binary())], ["cluster", "pair", "role", "node", "label", "raw"])

    return run


def _pairs_batch(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _with_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, the hub's sets first: members that link with the hub."""
    key, hubs = None, []
    for batch in batches:
        a: list[int] = []
        b: list[int] = []
        for c, p, role, node, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(5), strict=True):
            if (c, p) != key:
                key, hubs = (c, p), []
            x = np.frombuffer(raw.as_buffer(), U64)
            if role == 0:
                hubs.append(x)
                continue
            for hub in hubs:
                if NUM * len(x) <= DEN * len(hub) and NUM * len(hub) <= DEN * len(x):
                    at = np.searchsorted(hub, x)
                    common = int((hub[np.minimum(at, len(hub) - 1)] == x).sum())
                    if DEN * common >= NUM * (len(x) + len(hub) - common):
                        a.append(c)
                        b.append(node)
                        break
        yield _pairs_batch(a, b)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by list and pair of blocks: what links of sets of different labels connect, as a forest."""

    def settle(group: list[tuple[int, int, bytes]]) -> tuple[list[int], list[int]]:
        rows = sorted(set(group))
        if len({label for _, label, _ in rows}) < 2:
            return [], []
        label = forest(block_links([np.frombuffer(raw, U64) for _, _, raw in rows]))
        nodes = np.array([n for n, _, _ in rows], np.int64)
        at = np.flatnonzero(nodes[label] != nodes)
        return nodes[label[at]].tolist(), nodes[at].tolist()

    key, group = None, []
    for batch in batches:
        a: list[int] = []
        b: list[int] = []
        for c, p, _, node, label, raw in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if (c, p) != key:
                for to, found in zip((a, b), settle(group), strict=True):
                    to += found
                key, group = (c, p), []
            group.append((node, label, raw))
        yield _pairs_batch(a, b)
    yield _pairs_batch(*settle(group))


def compared(rows: DataFrame, held: DataFrame, width: int, parts: int, run) -> DataFrame:
    """Links ``a, b`` found by ``run`` in the groups of ``rows`` (cluster, pair, role, node, label), texts taken from ``held`` (id, text)."""
    # the same plan at every size: texts are never weighed against a broadcast
    texts = rows.hint("merge").join(held, rows["node"] == held["id"]).select("cluster", "pair", "role", "node", "label", "text")
    sets = texts.mapInArrow(trimmed(_sets(width)), "cluster long, pair long, role int, node long, label long, raw binary")
    return sets.repartition(max(parts, 12), "cluster", "pair").sortWithinPartitions("cluster", "pair", "role").mapInArrow(trimmed(run), "a long, b long")


def with_hubs(edges: DataFrame, held: DataFrame, width: int, parts: int, block: int) -> DataFrame:
    """Those of the edges ``a, b`` that link; members of a hub are dealt over blocks, the hub goes to each."""
    sized = edges.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = edges.select(rekeyed("a"), "a", "b").join(sized.select(rekeyed("a"), "blocks"), "key")
    zero = F.lit(0).cast("long").alias("label")
    rows = members.select(F.col("a").alias("cluster"), F.pmod(F.xxhash64("b"), F.col("blocks")).alias("pair"), F.lit(1).alias("role"), F.col("b").alias("node"), zero)
    hubs = sized.select(F.col("a").alias("cluster"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("pair"), F.lit(0).alias("role"), F.col("a").alias("node"), zero)
    return compared(rows.unionAll(hubs), held, width, parts, _with_hub)


def within_lists(lists: DataFrame, held: DataFrame, width: int, parts: int, block_docs: int, block_shingles: int) -> DataFrame:
    """Links that connect labels within lists: rows ``a`` (the list), ``node``, ``label``, ``n`` (the set's size).

    Lists of one label are left out, and of lists with the same members all but one.
    """
    figures = lists.groupBy("a").agg(
        F.count_distinct("label").alias("labels"),
        F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks"),
        F.count("*").alias("size"),
        F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members"),
    )
    one_each = figures.where("labels > 1").groupBy("size", "members").agg(F.min(F.struct("a", "blocks")).alias("m")).select(F.col("m.a").alias("a"), F.col("m.blocks").alias("blocks"))
    kept = lists.select(rekeyed("a"), "a", "node", "label").join(one_each.select(rekeyed("a"), "blocks"), "key")
    dealt = kept.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.least("mine", "other") * F.col("blocks").cast("long") + F.greatest("mine", "other")
    rows = each.select(F.col("a").alias("cluster"), pair.alias("pair"), F.lit(1).alias("role"), "node", "label")
    return compared(rows, held, width, parts, _blocks)


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_groups(texts, 12_000_000):
                found = shingle_sets(texts[a:b], width)
                columns = [pa.array([f(s) for s in found], pa.int64()) for f in (len, set_hash, second_hash)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], ["id", "n_shingles", "set_hash", "set_hash2"])

    return run


def jaccard_components(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, part_mb: float = 10.0, block_docs: int = 768, block_shingles: int = 300_000, targets: int = TARGETS, held: int = HELD, scale: float = 1.0
) -> DataFrame:
    """``id_col``, ``n_shingles``, ``set_hash``, ``class_id`` (least id with the same set) and ``component_id``.

    ``part_mb`` is the input behind one piece of the signature exchange, ``targets`` how many
    targets it has at most, ``held`` the entries of a piece in memory; ``block_docs`` and
    ``block_shingles`` bound the sets compared at a time; ``scale`` is that of the number of
    parts, of which sets that have too few get more.
    """
    texts = df.select(long_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ex = Exchange.of(input_bytes(df, text_col), part_mb, targets, held)
    sizes = materialize(texts.mapInArrow(trimmed(_describe(width)), "id long, n_shingles long, set_hash long, set_hash2 long"), "sets")
    hubs = candidates(texts.withColumn("label", F.lit(0).cast("long")), width, ex, scale=scale)
    present = sizes.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    same_set = "set_hash", "set_hash2", "n_shingles"
    classes = materialize(present.groupBy(*same_set).agg(F.min("id").alias("class_id")), "classes")
    named = lambda x: classes.select(F.col("set_hash").alias("__" + x), F.col("class_id").alias(x))
    edges = hubs.join(named("hub"), hubs["a"] == F.col("__hub")).join(named("node"), hubs["b"] == F.col("__node"))
    edges = materialize(edges.where("hub <> node").groupBy("hub", "node").agg(F.sum("n").alias("n")), "edges")
    wanted = edges.select(F.explode(F.array("hub", "node")).alias("id")).distinct()
    near = materialize(texts.join(wanted.hint("merge"), "id", "left_semi"), "near")
    release(df.sparkSession)
    # one comparison with the hub of most lists; then with the other hubs; then within lists
    best = edges.groupBy("node").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub"))
    first = materialize(with_hubs(best.select(F.col("hub").alias("a"), F.col("node").alias("b")), near, width, ex.parts, block_docs), "links")
    release(df.sparkSession)
    labels = materialize(connected_components(first), "labels")

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        of = lambda x: labels.select(F.col("node").alias("__" + x), F.col("component").alias("of_" + x))
        both = pairs.join(of("hub"), pairs["hub"] == F.col("__hub"), "left").join(of("node"), pairs["node"] == F.col("__node"), "left")
        return both.where("not coalesce(of_hub = of_node, false)").select(*pairs.columns)

    rest = apart(edges.join(best, ["hub", "node"], "left_anti").select("hub", "node"), labels)
    second = with_hubs(rest.select(F.col("hub").alias("a"), F.col("node").alias("b")), near, width, ex.parts, block_docs)
    stars = lambda found: found.select(F.col("component").alias("a"), F.col("node").alias("b"))
    labels = materialize(connected_components(second.unionAll(stars(labels))), "labels")
    release(df.sparkSession)
    # sets whose candidates are not all one component yet: groups of one block are compared whole, others by the lists they share
    groups = connected_components(edges.select(F.col("hub").alias("a"), F.col("node").alias("b")))
    own = groups.join(labels.select(F.col("node").alias("__n"), F.col("component").alias("label")), groups["node"] == F.col("__n"), "left").select("node", "component", F.coalesce("label", "node").alias("label"))
    own = materialize(own.join(classes.select(F.col("class_id").alias("__c"), F.col("n_shingles").alias("n")), own["node"] == F.col("__c")).select("node", "component", "label", "n"), "groups")
    blocks = F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_shingles)).alias("blocks")
    unsettled = own.groupBy("component").agg(F.count("*").alias("size"), F.count_distinct("label").alias("labels"), blocks).where("size > 2 and labels > 1")
    open_nodes = materialize(own.withColumn("key", rekeyed("component")).join(unsettled.select(rekeyed("component"), "size", "blocks"), "key").drop("key"), "open")
    whole = open_nodes.where("blocks = 1").select(F.col("component").alias("a"), "node", "label", "n")
    large = open_nodes.where("blocks > 1")
    if not large.isEmpty():
        again = near.join(large.select(F.col("node").alias("id"), "label").hint("merge"), "id").select("id", "text", "label")
        found = candidates(again, width, ex, lists=True, scale=scale).select("a", "b").distinct()
        members = classes.select("set_hash", F.col("class_id").alias("__c"))
        lists = found.join(members, F.col("b") == members["set_hash"]).select("a", F.col("__c").alias("m"))
        lists = materialize(lists.join(large, F.col("m") == large["node"]).select("a", "node", "label", "n", "component"), "lists")
        # what lists cost, as sets sent, against the group as one list
        sent = lists.groupBy("a").agg(blocks).select(rekeyed("a"), "blocks")
        costs = lists.select(rekeyed("a"), "component").join(sent, "key").groupBy("component").agg(F.sum("blocks").alias("cost"))
        dear = large.groupBy("component").agg(F.first(F.col("size") * F.col("blocks")).alias("all")).join(costs, "component", "left").where("cost >= all").select(rekeyed("component"))
        kept = lists.withColumn("key", rekeyed("component")).join(dear, "key", "left_anti").select("a").distinct()
        whole = whole.unionAll(large.withColumn("key", rekeyed("component")).join(dear, "key", "left_semi").select(F.col("component").alias("a"), "node", "label", "n"))
        whole = whole.unionAll(lists.join(kept, "a", "left_semi").select("a", "node", "label", "n"))
    links = stars(labels).unionAll(within_lists(whole, near, width, ex.parts, block_docs, block_shingles))
    linked = connected_components(links)
    labelled = classes.join(linked, classes["class_id"] == linked["node"], "left").select(*same_set, "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = sizes.join(labelled, list(same_set), "left")
    alone = F.when(F.col("id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")))
    own_class = F.when(F.col("id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "set_hash", own_class.alias("class_id"), alone.alias("component_id"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
