"""Lines, polylines and streamlines: splitting, bridges, cropping, lengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions import grid

CELL = ("cx", "cy", "cz")


def _same(names: Sequence[str], window) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.lag(n).over(window).eqNullSafe(F.col(n))
    return out


def split_at_cells(vertices: DataFrame, cells: Sequence[str] = CELL, oid: str = "oid", order: Sequence[str] = ("seq",)) -> DataFrame:
    """Vertices with ``segment``: the run of consecutive vertices in one cell, from 0 for each object."""
    w = W.partitionBy(oid).orderBy(*order)
    moved = F.when(F.row_number().over(w) == 1, 0).otherwise(F.when(_same(cells, w), 0).otherwise(1))
    flagged = vertices.withColumn("__moved", moved)
    return flagged.withColumn("segment", F.sum("__moved").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("__moved")


def bridges(vertices: DataFrame, cells: Sequence[str] = CELL, oid: str = "oid", order: Sequence[str] = ("seq",), vid: str = "vid") -> DataFrame:
    """Links ``src, dst`` from the last vertex of a segment to the first of the next."""
    w = W.partitionBy(oid).orderBy(*order)
    moved = F.lit(False)
    for c in cells:
        moved = moved | ~F.lead(c).over(w).eqNullSafe(F.col(c))
    ahead = vertices.select(oid, F.col(vid).alias("src"), F.lead(vid).over(w).alias("dst"), moved.alias("__moved"))
    return ahead.where(F.col("__moved") & F.col("dst").isNotNull()).drop("__moved")


def manifest(segmented: DataFrame, cells: Sequence[str] = CELL, oid: str = "oid") -> DataFrame:
    """An object's fragments in order: ``seq`` and the cell, a row for each segment."""
    return segmented.groupBy(oid, F.col("segment").alias("seq")).agg(*(F.first(c).alias(c) for c in cells), F.count("*").alias("n_vertices"))


def crop(segmented: DataFrame, inside: Column, oid: str = "oid", order: Sequence[str] = ("seq",)) -> DataFrame:
    """Vertices in cells that ``inside`` accepts, with ``part``: the maximal run they belong to, from 0."""
    w = W.partitionBy(oid).orderBy(*order)
    flagged = segmented.withColumn("__in", F.coalesce(inside, F.lit(False)))
    begins = F.col("__in") & ~F.coalesce(F.lag("__in").over(w), F.lit(False))
    runs = flagged.withColumn("__begins", begins.cast("int")).withColumn("part", (F.sum("__begins").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("long"))
    return runs.where("__in").drop("__in", "__begins")


def whole_in_cells(vertices: DataFrame, touched: Column, oid: str = "oid") -> DataFrame:
    """All vertices of the objects with a vertex in a touched cell: the chunk-granular box rule."""
    hit = vertices.where(touched).select(oid).distinct()
    return vertices.join(hit, oid, "left_semi")


def lengths(vertices: DataFrame, axes: Sequence[str] = grid.AXES, oid: str = "oid", order: Sequence[str] = ("seq",)) -> DataFrame:
    """``length`` and ``n_vertices`` of each object; a single vertex has length 0."""
    w = W.partitionBy(oid).orderBy(*order)
    steps = vertices.select(oid, grid.step_length(axes, w).alias("__step"))
    return steps.groupBy(oid).agg(F.coalesce(F.sum("__step"), F.lit(0.0)).alias("length"), F.count("*").alias("n_vertices"))


def between_lengths(vertices: DataFrame, low: float, high: float, **how) -> DataFrame:
    """Objects whose length lies in [low, high]."""
    return lengths(vertices, **how).where(F.col("length").between(low, high))


def endpoints(vertices: DataFrame, axes: Sequence[str] = grid.AXES, oid: str = "oid", order: str = "seq") -> DataFrame:
    """First and last position of each object with two vertices or more: ax.., bx.."""
    place = F.struct(*axes)
    ends = vertices.groupBy(oid).agg(F.min_by(place, F.col(order)).alias("a"), F.max_by(place, F.col(order)).alias("b"), F.count("*").alias("__n"))
    return ends.where("__n >= 2").select(oid, *(F.col(f"{e}.{x}").alias(e + x) for e in "ab" for x in axes))


def lines_in_box(lines: DataFrame, lo: Sequence[float], hi: Sequence[float], axes: Sequence[str] = grid.AXES) -> DataFrame:
    """Lines with either end in the box; a line that only crosses it is not kept."""
    sides = [grid.in_box(lo, hi, [e + a for a in axes]) for e in "ab"]
    return lines.where(sides[0] | sides[1])


def line_vertices(lines: DataFrame, axes: Sequence[str] = grid.AXES, oid: str = "oid") -> DataFrame:
    """Two vertices for each line: seq 0 and 1."""
    ends = F.array(*(F.struct(F.lit(k).alias("seq"), *(F.col(e + a).alias(a) for a in axes)) for k, e in enumerate("ab")))
    return lines.select(oid, F.explode(ends).alias("v")).select(oid, "v.*")


def sequential_edges(vertices: DataFrame, oid: str = "oid", order: Sequence[str] = ("seq",), vid: str = "vid") -> DataFrame:
    """``child, parent`` of consecutive vertices."""
    w = W.partitionBy(oid).orderBy(*order)
    return vertices.select(oid, F.col(vid).alias("child"), F.lag(vid).over(w).alias("parent")).where("parent is not null")


def assembled(vertices: DataFrame, axes: Sequence[str] = grid.AXES, oid: str = "oid", order: Sequence[str] = ("seq",)) -> DataFrame:
    """One row an object with its positions in order, as an array of structs."""
    key = F.struct(*order, *axes)
    return vertices.groupBy(oid).agg(F.array_sort(F.collect_list(key)).alias("path"))
