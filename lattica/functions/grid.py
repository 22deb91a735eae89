"""Grid arithmetic: cells, bins, keys and neighbours as column expressions.

A cell is floor(position / size) of a position in double precision, so cells may be
negative and a position on a boundary lies in the upper cell.  Division of negative
numbers floors everywhere; neither ``div`` nor ``%`` is used, both of which truncate.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def cell(position: str | Column, size: float) -> Column:
    c = F.col(position) if isinstance(position, str) else position
    return F.floor(c.cast("double") / F.lit(float(size))).cast("long")


def cells(sizes: Sequence[float], axes: Sequence[str] = AXES, prefix: str = "c") -> list[Column]:
    """One cell column for each axis: cx, cy, cz."""
    return [cell(a, s).alias(prefix + a) for a, s in zip(axes, sizes, strict=False)]


def floor_div(value: Column, by: int) -> Column:
    """Integer division towards minus infinity."""
    return F.floor(value / F.lit(by)).cast("long")


def local_bin(axes: Sequence[str], chunk: Sequence[float], bins: Sequence[float]) -> Column:
    """Row-major number of a position's bin within its chunk; bins must tile the chunk."""
    shape = bins_per_chunk(chunk, bins)
    out = F.lit(0).cast("long")
    for a, b, n in zip(axes, bins, shape, strict=True):
        out = out * n + F.pmod(cell(a, b), F.lit(n).cast("long"))
    return out


def bins_per_chunk(chunk: Sequence[float], bins: Sequence[float]) -> tuple[int, ...]:
    out = []
    for c, b in zip(chunk, bins, strict=True):
        n = round(c / b)
        if n < 1 or not math.isclose(n * b, c, rel_tol=1e-9):
            raise ValueError(f"bins of {b} don't tile a chunk of {c}")
        out.append(n)
    return tuple(out)


def in_box(lo: Sequence[float], hi: Sequence[float], axes: Sequence[str] = AXES) -> Column:
    """Inside a box, both ends included on every axis."""
    out = F.lit(True)
    for a, l, h in zip(axes, lo, hi, strict=False):
        out = out & F.col(a).cast("double").between(float(l), float(h))
    return out


def box_cells(lo: Sequence[float], hi: Sequence[float], sizes: Sequence[float], axes: Sequence[str] = AXES, prefix: str = "c") -> Column:
    """Cells a box touches: a conjunct on cell columns that prunes partitions and row groups."""
    out = F.lit(True)
    for a, l, h, s in zip(axes, lo, hi, sizes, strict=False):
        out = out & F.col(prefix + a).between(math.floor(l / s), math.floor(h / s))
    return out


def box_bins(lo: Sequence[float], hi: Sequence[float], sizes: Sequence[float], bins: Sequence[float], axes: Sequence[str] = AXES, column: str = "bin") -> Column:
    """Bins a box touches, by the number of a bin within its chunk: never fewer rows than the box holds.

    Where the box lies in one cell, the least and the greatest bin are plain bounds that
    prune row groups.
    """
    shape = bins_per_chunk(sizes, bins)
    out, low, high = F.lit(True), 0, 0
    stride = math.prod(shape)
    one_cell = all(math.floor(l / s) == math.floor(h / s) for l, h, s in zip(lo, hi, sizes, strict=True))
    for a, l, h, b, n in zip(axes, lo, hi, bins, shape, strict=True):
        stride //= n
        local = F.pmod(F.floor(F.col(column) / stride).cast("long"), F.lit(n).cast("long"))
        out = out & (F.col("c" + a) * n + local).between(math.floor(l / b), math.floor(h / b))
        low, high = low * n + math.floor(l / b) % n, high * n + math.floor(h / b) % n
    return out & F.col(column).between(low, high) if one_cell else out


def in_ball(centre: Sequence[float], radius: float, axes: Sequence[str] = AXES) -> Column:
    """At most ``radius`` from ``centre``, in double precision."""
    return squared_distance(centre, axes) <= float(radius) * float(radius)


def squared_distance(centre: Sequence[float], axes: Sequence[str] = AXES) -> Column:
    out = F.lit(0.0)
    for a, c in zip(axes, centre, strict=False):
        d = F.col(a).cast("double") - F.lit(float(c))
        out = out + d * d
    return out


def step_length(axes: Sequence[str], window) -> Column:
    """Distance from the row before in a window; null on its first row."""
    total = F.lit(0.0)
    for a in axes:
        d = F.col(a).cast("double") - F.lag(F.col(a).cast("double")).over(window)
        total = total + d * d
    return F.sqrt(total)


def offsets(dimensions: int, halo: int = 1, centre: bool = True) -> list[tuple[int, ...]]:
    """Cell offsets within a Chebyshev distance, the centre first, then in sorted order."""
    around = [o for o in itertools.product(range(-halo, halo + 1), repeat=dimensions) if any(o)]
    return ([(0,) * dimensions] if centre else []) + around


def morton(columns: Sequence[str | Column], bits: int) -> Column:
    """Interleaved bits of non-negative integer columns, the first column's the highest of each group."""
    out = F.lit(0).cast("long")
    d = len(columns)
    for b in range(bits):
        for i, c in enumerate(columns):
            value = (F.col(c) if isinstance(c, str) else c).cast("long")
            bit = F.shiftright(value, b).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.shiftleft(bit, b * d + d - 1 - i))
    return out


def affine(matrix: Sequence[Sequence[float]], axes: Sequence[str] = AXES) -> list[Column]:
    """p @ M[:D, :D].T + M[:D, D] as one column for each axis."""
    d = len(axes)
    out = []
    for i, a in enumerate(axes):
        value = F.lit(float(matrix[i][d]))
        for j, other in enumerate(axes):
            value = value + F.col(other).cast("double") * float(matrix[i][j])
        out.append(value.alias(a))
    return out


def anchor(cell_column: Column, source: int, target: int) -> Column:
    """Cell of another grid that holds a cell's lower corner: floor(c * source / target)."""
    return floor_div(cell_column * source, target)


def next_with_residue(lower: Column, residue: int, modulus: int) -> Column:
    """The least n >= lower with n = residue modulo ``modulus``."""
    return lower + F.pmod(F.lit(residue) - lower, F.lit(modulus))


def residue_of(name: Column, modulus: int) -> Column:
    """The first eight bytes of a name's SHA-256, little-endian, modulo ``modulus``."""
    digest = F.sha2(name.cast("binary"), 256)
    out = F.lit(0).cast("decimal(38,0)")
    for i in range(7, -1, -1):
        byte = F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("decimal(38,0)")
        out = (out * 256 + byte).cast("decimal(38,0)")
    return (out % modulus).cast("long")


def lehmer(permutation: Sequence[int]) -> int:
    """Rank of a permutation of 0..n-1 in lexicographic order."""
    rank = 0
    for i, p in enumerate(permutation):
        rank = rank * (len(permutation) - i) + sum(q < p for q in permutation[i + 1 :])
    return rank


def from_lehmer(rank: int, n: int) -> list[int]:
    digits = []
    for base in range(1, n + 1):
        digits.append(rank % base)
        rank //= base
    left = list(range(n))
    return [left.pop(d) for d in reversed(digits)]


@dataclass(frozen=True)
class Grid:
    """Chunks of ``sizes`` over ``bounds``; driver arithmetic alone."""

    sizes: tuple[float, ...]
    bounds: tuple[tuple[float, ...], tuple[float, ...]]

    def key(self, position: Sequence[float]) -> tuple[int, ...]:
        return tuple(math.floor(p / s) for p, s in zip(position, self.sizes, strict=True))

    def shape(self) -> tuple[int, ...]:
        """Cells allocated on each axis, the one of the upper bound included."""
        lo, hi = map(self.key, self.bounds)
        return tuple(h - l + 1 for l, h in zip(lo, hi, strict=True))

    def capacity(self, bytes_a_row: int, target_bytes: int = 64 << 20) -> int:
        """Rows a cell may hold to stay below the target."""
        return max(1, target_bytes // max(1, bytes_a_row))

    def sized_for(self, cells_wanted: int) -> tuple[float, ...]:
        """Cell sizes that cut the bounds into about as many cells."""
        lo, hi = self.bounds
        volume = math.prod(max(h - l, 1e-300) for l, h in zip(lo, hi, strict=True))
        side = (volume / max(1, cells_wanted)) ** (1 / len(lo))
        return tuple(min(side, h - l) if h > l else side for l, h in zip(lo, hi, strict=True))


def nearest_scale(scales: Sequence[Sequence[float]], scale: float) -> int:
    """The level whose mean cell size is nearest to ``scale``, the first of equals."""
    means = [sum(s) / len(s) for s in scales]
    return min(range(len(means)), key=lambda i: abs(means[i] - scale))
