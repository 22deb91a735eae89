"""Objects, groups, fragments and their manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL = ("cx", "cy", "cz")
#: Owner of a fragment that several objects refer to, and of one that none does.
SHARED, NONE = -2, -1


def fragment_rank(vertices: DataFrame, cells: Sequence[str] = CELL, oid: str = "oid") -> DataFrame:
    """``frag``: the dense rank of an object among those of its cell, from 0.

    Ranks are taken over distinct (cell, object) pairs, so a crowded cell costs its objects,
    not its vertices.
    """
    pairs = vertices.select(*cells, oid).distinct()
    ranked = pairs.withColumn("frag", (F.row_number().over(W.partitionBy(*cells).orderBy(oid)) - 1).cast("long"))
    return vertices.join(ranked, [*cells, oid])


def object_manifest(ranked: DataFrame, cells: Sequence[str] = CELL, oid: str = "oid") -> DataFrame:
    """Fragments of each object in cell order: ``seq`` from 0."""
    fragments = ranked.select(oid, *cells, "frag").distinct()
    return fragments.withColumn("seq", (F.row_number().over(W.partitionBy(oid).orderBy(*cells, "frag")) - 1).cast("long"))


def in_object_order(manifest: DataFrame, vertices: DataFrame, cells: Sequence[str] = CELL, oid: str = "oid") -> DataFrame:
    """Vertices of each manifest entry; revisited fragments give their rows again."""
    own = vertices.drop(oid) if oid in vertices.columns else vertices
    return manifest.join(own, [*cells, "frag"])


def row_offsets(vertices: DataFrame, cells: Sequence[str] = CELL) -> DataFrame:
    """Rows of each cell and the rows before it in cell order."""
    from lattica.operators.points import prefix_sums

    counts = vertices.groupBy(*cells).agg(F.count("*").alias("n_rows"))
    return prefix_sums(counts, list(cells), F.col("n_rows"), "offset")


def fragment_owner(manifest: DataFrame, fragments: DataFrame | None = None, cells: Sequence[str] = CELL, oid: str = "oid") -> DataFrame:
    """The object a fragment belongs to, SHARED if several, NONE for fragments no manifest names."""
    key = [*cells, "frag"]
    owners = manifest.groupBy(*key).agg(F.min(oid).alias("__lo"), F.max(oid).alias("__hi"))
    owned = owners.select(*key, F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).otherwise(F.lit(SHARED)).alias("owner"))
    if fragments is None:
        return owned
    return fragments.select(*key).distinct().join(owned, key, "left").withColumn("owner", F.coalesce("owner", F.lit(NONE)))


def touching_cells(manifest: DataFrame, wanted: DataFrame, cells: Sequence[str] = CELL, oid: str = "oid") -> DataFrame:
    """Ids of objects with a manifest entry in a wanted cell."""
    return manifest.join(wanted.select(*cells).distinct(), list(cells), "left_semi").select(oid).distinct()


def vertex_at(ordered: DataFrame, index: int, oid: str = "oid", order: Sequence[str] = ("seq", "row")) -> DataFrame:
    """The vertex at a place, from 0, in each object's manifest order."""
    w = W.partitionBy(oid).orderBy(*order)
    return ordered.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == index + 1).drop("__n")


def catalogue(objects: DataFrame, manifest: DataFrame, oid: str = "oid") -> DataFrame:
    """Every object slot with ``present``: whether it holds geometry."""
    there = manifest.select(oid).distinct().withColumn("present", F.lit(True))
    return objects.join(there, oid, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def group_members(groups: DataFrame, gids: Sequence[int] | None = None) -> DataFrame:
    """``gid, oid`` of each group's members."""
    chosen = groups if gids is None else groups.where(F.col("gid").isin(list(gids)))
    return chosen.select("gid", F.explode("members").alias("oid"))


def build_groups(members: DataFrame, by: str, oid: str = "oid") -> DataFrame:
    """Groups from a column of objects: ``name`` and sorted ``members``; an object may be in many groups."""
    return members.groupBy(F.col(by).alias("name")).agg(F.array_sort(F.collect_set(oid)).alias("members"))


def fragment_rows(fragments: DataFrame) -> DataFrame:
    """Rows of range (start, n) or explicit (rows) fragments, with their place."""
    listed = F.when(F.col("rows").isNotNull(), F.col("rows")).otherwise(F.when(F.col("n") > 0, F.sequence("start", F.col("start") + F.col("n") - 1)).otherwise(F.array().cast("array<long>")))
    return fragments.select("frag", F.posexplode(listed).alias("place", "row"))


def tiles(fragments: DataFrame, total: int) -> bool:
    """Whether range fragments cover rows 0..total-1 once each, in order."""
    w = W.orderBy("start", "n")
    checked = fragments.where("n > 0").withColumn("__gap", F.col("start") != F.coalesce(F.lag(F.col("start") + F.col("n")).over(w), F.lit(0)))
    row = checked.agg(F.coalesce(F.max(F.col("__gap").cast("int")), F.lit(0)).alias("gap"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    return not row["gap"] and row["n"] == total
