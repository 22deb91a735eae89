"""Readers that combine operators: mesh patches, skeletons by segment, octree reads, object context, appends."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions import grid

from . import links as L
from . import paths

CELL = ("cx", "cy", "cz")


def owned_patch(faces: DataFrame, vertices: DataFrame, cells: DataFrame, names: Sequence[str] = CELL, vid: str = "vid") -> tuple[DataFrame, DataFrame]:
    """Faces owned by the given cells, and every vertex they name, wherever it lies."""
    owners = L.owner_cell(faces, vertices, names, vid).join(cells.select(*names).distinct(), list(names), "left_semi")
    owned = faces.join(owners.select("face"), "face", "left_semi")
    named = owned.select(F.explode("ends").alias(vid)).distinct()
    return owned, vertices.join(named, vid, "left_semi")


def owner_bounds(faces: DataFrame, vertices: DataFrame, axes: Sequence[str] = grid.AXES, names: Sequence[str] = CELL, vid: str = "vid") -> DataFrame:
    """The box around all vertices of the faces that a cell owns."""
    bounds = [(f"{n}_{a}", f, a) for a in axes for n, f in (("min", F.min), ("max", F.max))]
    ends = L.placed_ends(faces, vertices, list(dict.fromkeys((*names, *axes))), vid)
    each = ends.groupBy("face").agg(F.min(F.struct(*names, "__v")).alias("m"), *(f(a).alias(b) for b, f, a in bounds))
    return each.groupBy(*(F.col(f"m.{c}").alias(c) for c in names)).agg(*(f(b).alias(b) for b, f, _ in bounds))


def skeleton_by_segment(objects: DataFrame, vertices: DataFrame, records: DataFrame, segment: int, axes: Sequence[str] = grid.AXES, offset: Sequence[float] | None = None, fragment: Sequence[str] = (*CELL, "frag")) -> tuple[DataFrame, DataFrame]:
    """Vertices (offset added) and ``child, parent`` edges of one segment; both empty if it is unknown."""
    wanted = objects.where(F.col("segment_id") == segment).select("oid")
    own = vertices.join(F.broadcast(wanted.limit(1)), "oid", "left_semi")
    if offset is not None:
        own = own.withColumns({a: F.col(a) + F.lit(float(o)) for a, o in zip(axes, offset, strict=True)})
    return own, L.skeleton_parents(own, records, fragment)


def leaves_in_box(leaves: DataFrame, lo: Sequence[float], hi: Sequence[float], sizes: Sequence[float], depth: int, origin: Sequence[int] = (0, 0, 0), axes: Sequence[str] = ("i", "j", "k")) -> DataFrame:
    """Octree leaves that meet a box, by integer comparison of their cells."""
    out = F.lit(True)
    side = F.expr(f"shiftleft(1L, greatest(0, {depth} - depth))")  # a filter may be pushed to rows below full depth
    for a, l, h, s, o in zip(axes, lo, hi, sizes, origin, strict=True):
        first, last = math.floor(l / s) - o, math.floor(h / s) - o
        anchor = F.col(a) * side
        out = out & (anchor <= last) & (anchor + side - 1 >= first)
    return leaves.where(out)


def leaf_neighbours(leaves: DataFrame, depth: int, axes: Sequence[str] = ("i", "j", "k")) -> DataFrame:
    """Pairs of keys of different leaves that share a face, an edge or a corner, each once in both directions.

    A leaf asks for its 26 neighbours at its own depth; whoever owns such a place, at any
    depth above, is found by an equi-join on exploded ancestors, and finer leaves find it.
    """
    at = leaves.select("depth", *axes, "key")
    steps = F.array(*(F.struct(*(F.lit(o).alias(a) for a, o in zip(axes, offset, strict=True))) for offset in grid.offsets(3, 1, centre=False)))
    places = at.select(F.col("key").alias("a"), F.col("depth").alias("d"), *axes, F.explode(steps).alias("o"))
    moved = places.select("a", "d", *((F.col(x) + F.col(f"o.{x}")).alias(x) for x in axes))
    inside = moved.where(" and ".join(f"{x} >= 0 and {x} < shiftleft(1L, d)" for x in axes))
    up = inside.select("a", "d", *axes, F.explode(F.sequence(F.lit(0), F.col("d"))).alias("depth"))
    keyed = up.select("a", "depth", *(F.expr(f"shiftright({x}, d - depth)").alias(x) for x in axes))
    found = keyed.join(at.select("depth", *axes, F.col("key").alias("b")), ["depth", *axes]).select("a", "b")
    return found.unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()


def seams(edges: DataFrame, placed: DataFrame, vid: str = "vid") -> DataFrame:
    """Edges between different leaves: ``placed`` has vid and the key of its leaf."""
    a = placed.select(F.col(vid).alias("src"), F.col("key").alias("src_key"))
    b = placed.select(F.col(vid).alias("dst"), F.col("key").alias("dst_key"))
    return edges.join(a, "src").join(b, "dst").where("src_key <> dst_key")


def links_of_cells(edges: DataFrame, vertices: DataFrame, tuple_of_cells: Sequence[Sequence[int]], names: Sequence[str] = CELL, vid: str = "vid") -> DataFrame:
    """Faces whose ends lie in exactly the given cells, as a set."""
    ends = edges.select("face", F.explode("ends").alias("__v")).join(vertices.select(F.col(vid).alias("__v"), F.concat_ws(".", *names).alias("__c")), "__v")
    wanted = F.array_sort(F.array(*(F.lit(".".join(map(str, c))) for c in {tuple(c) for c in tuple_of_cells})))
    hit = ends.groupBy("face").agg(F.array_sort(F.collect_set("__c")).alias("__s")).where(F.col("__s") == wanted)
    return edges.join(hit.select("face"), "face", "left_semi")


def object_links(edges: DataFrame, vertices: DataFrame, oids: Sequence[int], every: bool = True, vid: str = "vid") -> DataFrame:
    """Edges with both ends (or any) among the rows of the named objects."""
    own = vertices.where(F.col("oid").isin(list(oids))).select(vid)
    return L.induced(own, edges, vid) if every else L.touching(own, edges, vid)


def selection_context(vertices: DataFrame, axes: Sequence[str] = grid.AXES, oid: str = "oid", order: Sequence[str] = ("seq",)) -> DataFrame:
    """What an object selection may look at: middle vertex (index n // 2), path length, number of vertices."""
    w = W.partitionBy(oid).orderBy(*order)
    n = F.count("*").over(W.partitionBy(oid))
    numbered = vertices.withColumn("__k", F.row_number().over(w) - 1).withColumn("__n", n)
    middle = numbered.where(F.col("__k") == F.floor(F.col("__n") / 2)).select(oid, *(F.col(a).alias("m" + a) for a in axes))
    return middle.join(paths.lengths(vertices, axes, oid, order), oid)


def append_objects(existing: DataFrame, new: DataFrame, *, bins: DataFrame | None = None, bin_column: str | None = None) -> DataFrame:
    """Existing and new vertices; new ids must lie above all existing ones, and bin values must be known ones.

    Both rules are checked as part of the job: the first row that breaks one fails it.
    """
    top = existing.agg(F.coalesce(F.max("oid"), F.lit(-1)).alias("top")).first()["top"]
    fresh = F.when(F.col("oid") > top, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("object id in use: "), F.col("oid").cast("string"))).cast("boolean"))
    checked = new.where(fresh)
    if bins is not None and bin_column:
        known = bins.select(bin_column).distinct().withColumn("__known", F.lit(True))
        ok = F.when(F.col("__known"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no such bin: "), F.coalesce(F.col(bin_column).cast("string"), F.lit("null")))).cast("boolean"))
        checked = checked.join(known, bin_column, "left").where(ok).drop("__known")
    return existing.unionByName(checked.select(*existing.columns), allowMissingColumns=True)


def reorder_depth_first(vertices: DataFrame, parents: DataFrame, vid: str = "vid", oid: str = "oid") -> DataFrame:
    """Vertices with ``row`` from the depth-first order of their tree, so that most parents are the row before."""
    ranks = L.depth_first(parents, oid).select("vid", F.col("rank").alias("row"))
    return vertices.drop("row").join(ranks.withColumnRenamed("vid", vid), vid)


def explicit_after_reorder(parents: DataFrame, ordered: DataFrame, vid: str = "vid", oid: str = "oid") -> DataFrame:
    """The parent records that the implicit rule (the row before) does not give."""
    w = W.partitionBy(oid).orderBy("row")
    implied = ordered.select(F.col(vid).alias("child"), F.lag(vid).over(w).alias("__before"))
    return parents.join(implied, "child").where(~F.col("parent").eqNullSafe(F.col("__before"))).select("child", "parent")


def offsets_name(offsets: Sequence[Sequence[int]] | Sequence[int]) -> str:
    """Link offsets as a path segment: signs on all but zeros, dots between axes, underscores between ends."""
    if offsets and not isinstance(offsets[0], (tuple, list)):
        offsets = [offsets]
    return "_".join(".".join(f"{o:+d}" if o else "0" for o in part) for part in offsets)


def parse_offsets(name: str) -> list[tuple[int, ...]]:
    return [tuple(int(o) for o in part.split(".")) for part in name.split("_")]


def halo_cells(cells: DataFrame, wanted: Column, halo: int = 1, axes: Sequence[str] = grid.AXES) -> DataFrame:
    """Occupied cells at most ``halo`` from a wanted one, with ``ring``, their distance from the nearest."""
    names = ["c" + a for a in axes]
    occupied = cells.select(*names).distinct()
    steps = F.array(*(F.struct(F.lit(max(map(abs, o))).alias("r"), *(F.lit(v).cast("long").alias(a) for a, v in zip(axes, o, strict=True))) for o in grid.offsets(len(axes), halo)))
    around = occupied.where(wanted).select(*names, F.explode(steps).alias("o")).select(F.col("o.r").alias("r"), *((F.col("c" + a) + F.col(f"o.{a}")).alias("c" + a) for a in axes))
    return occupied.join(around.groupBy(*names).agg(F.min("r").alias("ring")), names)
