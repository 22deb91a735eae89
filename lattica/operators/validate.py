"""Validation in five levels; every check is a query that returns its violations."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions import grid
from lattica.sources.store import KINDS, Dataset, SchemaConflict


def violation(df: DataFrame, level: int, check: str, detail: Column, severity: str = "error") -> DataFrame:
    return df.select(F.lit(level).alias("level"), F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))


def not_finite(vertices: DataFrame, axes: Sequence[str] = grid.AXES) -> DataFrame:
    bad = reduce(lambda a, b: a | b, (F.col(a).isNull() | F.isnan(F.col(a).cast("double")) | (F.abs(F.col(a).cast("double")) == float("inf")) for a in axes))
    return violation(vertices.where(bad), 3, "finite positions", F.col("vid"), "warning")


def misplaced(vertices: DataFrame, sizes: Sequence[float], axes: Sequence[str] = grid.AXES) -> DataFrame:
    """Vertices whose cell columns don't hold their position."""
    wrong = reduce(lambda a, b: a | b, (F.col("c" + a) != grid.cell(a, s) for a, s in zip(axes, sizes, strict=True)))
    return violation(vertices.where(wrong), 3, "vertices in their cells", F.col("vid"))


def misbinned(vertices: DataFrame, chunk: Sequence[float], bins: Sequence[float], axes: Sequence[str] = grid.AXES) -> DataFrame:
    """Vertices whose bin doesn't hold their position."""
    wrong = ~F.col("bin").eqNullSafe(grid.local_bin(axes, chunk, bins))
    return violation(vertices.where(wrong), 3, "vertices in their bins", F.col("vid"))


def unlisted(vertices: DataFrame, manifests: DataFrame, key: Sequence[str]) -> DataFrame:
    """Fragments of objects that their manifests don't name."""
    own = vertices.where("oid is not null").select(*key).distinct()
    return violation(own.join(manifests.select(*key), list(key), "left_anti"), 3, "manifests are whole", F.concat_ws(" ", *key))


def dangling_parents(parents: DataFrame, vertices: DataFrame) -> DataFrame:
    """Cross-level links whose ends are no vertices of their levels."""
    known = vertices.select("level", "vid").distinct()
    low = parents.join(known, ["level", "vid"], "left_anti").select("vid")
    high = parents.select((F.col("level") + F.col("delta")).cast("int").alias("level"), F.col("parent").alias("vid")).join(known, ["level", "vid"], "left_anti").select("vid")
    return violation(low.unionByName(high), 3, "parents name vertices", F.col("vid"))


def dangling_manifests(manifest: DataFrame, fragments: DataFrame, key: Sequence[str] = ("cx", "cy", "cz", "frag")) -> DataFrame:
    return violation(manifest.join(fragments.select(*key).distinct(), list(key), "left_anti"), 3, "manifests name fragments", F.col("oid"))


def dangling_links(edges: DataFrame, vertices: DataFrame, vid: str = "vid") -> DataFrame:
    """Ends of links that are no vertex, once for each link and end."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("end"))
    return violation(ends.join(vertices.select(F.col(vid).alias("end")), "end", "left_anti"), 3, "links name vertices", F.col("end"))


def uncanonical(faces: DataFrame) -> DataFrame:
    """Links whose stored ends are not in order."""
    return violation(faces.where("sorted <> array_sort(sorted)"), 3, "links are canonical", F.col("face"))


def mixed_bins(vertices: DataFrame, column: str, oid: str = "oid") -> DataFrame:
    """Objects whose vertices hold several values of the column that chunks are cut by."""
    values = vertices.groupBy(oid).agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    return violation(values.where(F.col("__lo") != F.col("__hi")), 4, "one bin for an object", F.col(oid))


def wrong_counts(vertices: DataFrame, declared: DataFrame) -> DataFrame:
    """Levels whose declared vertex count (level, n_vertices) is not the number of rows."""
    real = vertices.groupBy("level").agg(F.count("*").alias("__n"))
    both = declared.join(real, "level", "full")
    return violation(both.where(~F.col("n_vertices").eqNullSafe(F.col("__n"))), 3, "counts are right", F.col("level"))


def untied_leaves(cells: DataFrame, leaves: DataFrame, depth: int, axes: Sequence[str] = ("i", "j", "k")) -> DataFrame:
    """Octree cells that lie in no leaf, or in several."""
    from lattica.operators.layout import in_leaf

    found = in_leaf(cells, leaves, depth, axes).groupBy(*axes).agg(F.count("*").alias("__n"))
    missing = cells.select(*axes).distinct().join(found, list(axes), "left").where("coalesce(__n, 0) <> 1")
    return violation(missing, 3, "leaves tile the cells", F.concat_ws(".", *axes))


def pyramid_counts(levels: DataFrame) -> DataFrame:
    """Levels (level, n_vertices, bin_volume) with more vertices, or smaller bins, than the one below, or a gap before."""
    w = W.orderBy("level")
    seen = levels.select("level", "n_vertices", "bin_volume", F.lag("level").over(w).alias("__l"), F.lag("n_vertices").over(w).alias("__n"), F.lag("bin_volume").over(w).alias("__v"))
    bad = (F.col("n_vertices") > F.col("__n")) | (F.col("bin_volume") < F.col("__v")) | (F.col("level") != F.col("__l") + 1)
    return violation(seen.where(bad), 5, "pyramid narrows", F.concat_ws(" ", "level", "n_vertices"))


def conventions(kind: str, widths: set[int], has_links: bool) -> list[str]:
    """What a geometry kind requires of links."""
    found = []
    if kind not in KINDS:
        found.append(f"no such kind: {kind}")
    if kind == "point_cloud" and has_links:
        found.append("a point cloud has no links")
    if kind in ("graph", "skeleton", "mesh") and not has_links:
        found.append(f"a {kind} needs links")
    if kind == "mesh" and any(w < 3 for w in widths):
        found.append("faces have three ends at least")
    return found


def validate(dataset: Dataset, level: int = 5) -> DataFrame:
    """Violations of all checks up to a level: columns level, check, severity, detail; no rows if all is well.

    Beside vertices and links these tables are checked where a dataset has them: ``levels``
    (level, n_vertices), ``manifest`` and ``fragments`` (cells, frag), ``faces`` (face,
    sorted), ``leaves`` and ``leaf_cells`` (i, j, k; depth in the user block ``octree``).
    """
    spark = dataset.spark
    rows: list[tuple[int, str, str, str]] = []
    schema = dataset.schema
    has = {name: dataset.has(name) for name in ("vertices", "links", "levels", "manifest", "fragments", "faces", "leaves", "leaf_cells")}
    declared = dataset.snapshot()["levels"]
    lacking = []
    if has["vertices"]:
        lacking = [c for c in ("level", "vid", *schema.axes, *("c" + a for a in schema.axes)) if c not in dataset.table("vertices").columns]
        rows += [(1, "structure", "error", f"vertices lack {c}") for c in lacking]
    elif declared:
        rows.append((1, "structure", "error", "levels without vertices"))
    if has["manifest"] != has["fragments"]:
        rows.append((1, "structure", "error", "manifest and fragments go together"))
    if level >= 2:
        try:
            schema.check()
        except (SchemaConflict, ValueError) as e:
            rows.append((2, "schema", "error", str(e)))
    found = [spark.createDataFrame(rows, "level int, check string, severity string, detail string")]
    if not has["vertices"] or lacking:
        return found[0]
    vertices = dataset.table("vertices")
    written = spark.createDataFrame([(k,) for k in declared], "level int")
    real = vertices.groupBy(F.col("level").cast("int").alias("level")).agg(F.count("*").alias("n_vertices"))
    both = written.withColumn("__w", F.lit(True)).join(real, "level", "full")
    found.append(violation(both.where("__w is null or n_vertices is null"), 1, "levels have vertices", F.col("level")))
    settings = dataset.user("pyramid") or {}
    grids = {k: dataset.grid(k) for k in declared}
    if level >= 3:
        found.append(not_finite(vertices, schema.axes))
        for k, (chunk, bins) in grids.items():
            rows = dataset.table("vertices", level=k)
            found.append(misplaced(rows, chunk, schema.axes))
            if bins and "bin" in rows.columns:
                found.append(misbinned(rows, chunk, bins, schema.axes))
        if dataset.has("manifests"):
            cells = ["level", *("c" + a for a in schema.axes), "frag"]
            found.append(dangling_manifests(dataset.table("manifests"), vertices, cells))
            found.append(unlisted(vertices, dataset.table("manifests"), [*cells, "oid"]))
        if dataset.has("parents"):
            found.append(dangling_parents(dataset.table("parents"), vertices))
        if has["links"]:
            found.append(dangling_links(dataset.table("links"), vertices))
        if has["levels"]:
            found.append(wrong_counts(vertices, dataset.table("levels")))
        if has["manifest"] and has["fragments"]:
            found.append(dangling_manifests(dataset.table("manifest"), dataset.table("fragments"), [*("c" + a for a in schema.axes), "frag"]))
        if has["faces"]:
            found.append(uncanonical(dataset.table("faces")))
        if has["leaves"] and has["leaf_cells"]:
            found.append(untied_leaves(dataset.table("leaf_cells"), dataset.table("leaves"), (dataset.user("octree") or {})["depth"]))
    if level >= 4:
        widths = {r["n"] for r in dataset.table("faces").select(F.size("sorted").alias("n")).distinct().collect()} if has["faces"] else set()
        for text in conventions(schema.kind, widths, has["links"] or has["faces"]):
            found.append(spark.createDataFrame([(4, "conventions", "error", text)], found[0].schema))
        if schema.chunk_by and schema.chunk_by in vertices.columns:
            found.append(mixed_bins(vertices, schema.chunk_by))
    if level >= 5:
        # bins that coarse levels were made of; without a pyramid, those of the grids
        sizes, scale, volumes = settings.get("bins"), 1.0, []
        factors = [1.0, *(f for f, _ in settings.get("factors", []))]
        for k in declared:
            scale *= factors[k] if k < len(factors) else 1.0
            own = [x * scale for x in sizes] if sizes else grids[k][1] or grids[k][0]
            volumes.append((k, float(math.prod(own))))
        found.append(pyramid_counts(real.join(spark.createDataFrame(volumes, "level int, bin_volume double"), "level", "left")))
    return reduce(DataFrame.unionByName, found)
