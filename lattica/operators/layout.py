"""Layout: rechunking, rebinning, octrees and chunk sizing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions import grid


def edge_bins(value: Column, edges: Sequence[float]) -> Column:
    """Number of edges at or below a value, less one, clipped to the bins between the edges."""
    below = sum((F.when(value >= float(e), 1).otherwise(0) for e in edges), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(len(edges) - 2), below - 1)).cast("long")


def quartile_edges(df: DataFrame, column: str) -> list[float]:
    """Distinct exact quartiles of a column; no task holds all its values."""
    from lattica.operators.points import exact_quantiles

    return sorted(set(exact_quantiles(df, column, (0.0, 0.25, 0.5, 0.75, 1.0))))


def rechunk_by_value(df: DataFrame, column: str, *, edges: Sequence[float] | None = None, categorical_up_to: int = 10) -> DataFrame:
    """``bin`` of each row by an attribute: given edges, or one bin a value if there are few, or quartiles."""
    if edges is None:
        few = df.select(column).distinct().limit(categorical_up_to + 1).count() <= categorical_up_to
        if few:
            values = df.where(F.col(column).isNotNull()).select(column).distinct()
            table = values.withColumn("bin", (F.row_number().over(W.orderBy(column)) - 1).cast("long"))
            return df.join(F.broadcast(table), column, "left")
        edges = quartile_edges(df, column)
    if len(edges) < 2:
        return df.withColumn("bin", F.lit(0).cast("long"))
    return df.withColumn("bin", F.when(F.col(column).isNotNull(), edge_bins(F.col(column), edges)))


def rechunk_by_group(objects: DataFrame, groups: DataFrame, oid: str = "oid") -> DataFrame:
    """``bin`` of each object by its group: the last listed group wins; ungrouped objects come last.

    ``groups``: gid, position in the list, members.
    """
    members = groups.select("gid", "position", F.explode("members").alias(oid))
    won = members.groupBy(oid).agg(F.max_by("gid", "position").alias("gid"))
    dense = won.select("gid").distinct().withColumn("bin", (F.row_number().over(W.orderBy("gid")) - 1).cast("long"))
    placed = objects.join(won, oid, "left").join(dense, "gid", "left")
    return placed.withColumn("bin", F.coalesce("bin", F.lit(dense.count()).cast("long")))


def dense_bins(df: DataFrame, column: str = "bin") -> DataFrame:
    """Renumber the bins that hold rows from 0, in order."""
    table = df.select(column).distinct().withColumn("__dense", (F.row_number().over(W.orderBy(column)) - 1).cast("long"))
    return df.join(table, column).drop(column).withColumnRenamed("__dense", column)


def rechunk(vertices: DataFrame, sizes: Sequence[float], axes: Sequence[str] = grid.AXES) -> DataFrame:
    """The same vertices on another grid, range-partitioned and sorted by the new cells."""
    names = ["c" + a for a in axes]
    moved = vertices.drop(*names).select("*", *grid.cells(sizes, axes))
    return moved.repartitionByRange(*names).sortWithinPartitions(*names)


def rebin(vertices: DataFrame, chunk: Sequence[float], bins: Sequence[float], axes: Sequence[str] = grid.AXES) -> DataFrame:
    """Vertices with the number of their bin in their chunk, sorted by it where they lie."""
    binned = vertices.drop("bin").withColumn("bin", grid.local_bin(axes, chunk, bins))
    return binned.sortWithinPartitions(*("c" + a for a in axes), "bin")


def suggest_chunk(worst_links: int, sizes: Sequence[float], target: int) -> tuple[float, ...]:
    """Halve a chunk, eight times at most, until the densest cell is expected to hold the target."""
    out, worst = tuple(map(float, sizes)), float(worst_links)
    for _ in range(8):
        if worst <= target:
            break
        out, worst = tuple(s / 2 for s in out), worst / 2 ** len(out)
    return out


def densest(edges: DataFrame, cells: Sequence[str]) -> DataFrame:
    """The most intra-cell links of any cell."""
    return edges.groupBy(*cells).agg(F.count("*").alias("n")).agg(F.max("n").alias("worst"))


def node_weights(cells: DataFrame, depth: int, axes: Sequence[str] = ("i", "j", "k"), weight: str = "weight") -> DataFrame:
    """Weight of every octree node above the cells: depth and address, all depths from one pass.

    Cells are summed at full depth first; each cell then gives a row for each depth.
    """
    full = cells.groupBy(*axes).agg(F.sum(weight).alias(weight))
    levels = full.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"), *axes, weight)
    moved = [F.expr(f"shiftright({a}, {depth} - depth)").alias(a) for a in axes]
    return levels.select("depth", *moved, weight).groupBy("depth", *axes).agg(F.sum(weight).alias(weight))


def leaves(cells: DataFrame, depth: int, target: float, axes: Sequence[str] = ("i", "j", "k"), weight: str = "weight", widest: int | None = None) -> DataFrame:
    """Leaves of the adaptive octree: nodes at full depth, or within target (and ``widest`` cells) whose parent is not.

    No empty node is a leaf; a cell is never split.  Leaves carry their Morton key at full depth.
    """
    nodes = node_weights(cells, depth, axes, weight)
    side = F.expr(f"shiftleft(1L, {depth} - depth)")
    light = F.col(weight) <= target
    if widest is not None:
        light = light & (side <= widest)
    fits = nodes.withColumn("fits", light | (F.col("depth") == depth))
    above = fits.select((F.col("depth") + 1).alias("depth"), *(F.col(a).alias("__" + a) for a in axes), F.col("fits").alias("__fits"))
    parents = fits.select("*", *(F.shiftright(a, 1).alias("__" + a) for a in axes))
    joined = parents.join(above, ["depth", *("__" + a for a in axes)], "left")
    # fits is monotone down the tree, so a leaf is a fitting node whose parent does not fit
    found = joined.where(F.col("fits") & ~F.coalesce("__fits", F.lit(False)))
    anchors = [F.expr(f"shiftleft(cast({a} as bigint), {depth} - depth)") for a in axes]
    return found.select("depth", *axes, weight, grid.morton(anchors, depth).alias("key"))


def balance(leaf_table: DataFrame, cells: DataFrame, depth: int, axes: Sequence[str] = ("i", "j", "k")) -> DataFrame:
    """Split leaves until touching ones differ by one depth at most; children without cells are left out.

    Each round finds the leaves that are two depths or more above a neighbour, by an equi-join
    of places around leaves with leaf addresses, and replaces them by their children.  There
    are as many rounds as depths at most.
    """
    from lattica.sources.store import materialize

    nodes = node_weights(cells.withColumn("__w", F.lit(1)), depth, axes, "__w").select("depth", *axes)
    found = materialize(leaf_table.select("depth", *axes), "leaves")
    steps = F.array(*(F.struct(*(F.lit(o).cast("long").alias(a) for a, o in zip(axes, offset, strict=True))) for offset in grid.offsets(3, 1, centre=False)))
    while True:
        places = found.select(F.col("depth").alias("d"), *axes, F.explode(steps).alias("o")).select("d", *((F.col(a) + F.col(f"o.{a}")).alias(a) for a in axes))
        inside = places.where(" and ".join(f"{a} >= 0 and {a} < shiftleft(1L, d)" for a in axes)).distinct()
        up = inside.where("d >= 2").select("d", *axes, F.explode(F.sequence(F.lit(0), F.col("d") - 2)).alias("depth"))
        above = up.select("depth", *(F.expr(f"shiftright({a}, d - depth)").alias(a) for a in axes)).distinct()
        coarse = materialize(found.join(above, ["depth", *axes], "left_semi"), "coarse")
        if coarse.isEmpty():
            return found.select("*", grid.morton([F.expr(f"shiftleft(cast({a} as bigint), {depth} - depth)") for a in axes], depth).alias("key"))
        parents = coarse.select((F.col("depth") + 1).alias("depth"), *(F.col(a).alias("__" + a) for a in axes))
        children = nodes.select("*", *(F.shiftright(a, 1).alias("__" + a) for a in axes)).join(parents, ["depth", *("__" + a for a in axes)], "left_semi").select("depth", *axes)
        found = materialize(found.join(coarse, ["depth", *axes], "left_anti").unionByName(children), "leaves")


def in_leaf(vertices: DataFrame, leaf_table: DataFrame, depth: int, axes: Sequence[str] = ("i", "j", "k")) -> DataFrame:
    """Vertices (with full-depth cells) and the depth and key of their leaf.

    Leaves are found for distinct cells, by an equi-join on exploded ancestors; vertices meet them by cell.
    """
    up = vertices.select(*axes).distinct().withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    keyed = up.select("*", *(F.expr(f"shiftright({a}, {depth} - depth)").alias("__" + a) for a in axes))
    table = leaf_table.select("depth", *(F.col(a).alias("__" + a) for a in axes), "key")
    owners = keyed.join(table, ["depth", *("__" + a for a in axes)]).select(*axes, "depth", "key")
    return vertices.join(owners, list(axes))


def address(depth: int, ijk: Sequence[int]) -> str:
    return f"{depth}/{'.'.join(map(str, ijk))}"


def parse_address(text: str) -> tuple[int, int, int, int]:
    """Depth and coordinates of "d/i.j.k", or of octants such as "111/001"; the root's are "" and "0/0.0.0"."""
    if "." in text:
        d, _, rest = text.partition("/")
        i, j, k = map(int, rest.split("."))
        return int(d), i, j, k
    steps = [s for s in text.split("/") if s]
    i = j = k = 0
    for s in steps:
        i, j, k = i << 1 | int(s[0]), j << 1 | int(s[1]), k << 1 | int(s[2])
    return len(steps), i, j, k
