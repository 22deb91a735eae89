"""Links: graphs, skeletons, meshes, their scoping and their canonical form."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import forest


def induced(nodes: DataFrame, edges: DataFrame, vid: str = "vid") -> DataFrame:
    """Edges with both ends among the nodes; repeated edges stay."""
    kept = nodes.select(F.col(vid).alias("__v"))
    first = edges.join(kept, edges["src"] == F.col("__v"), "left_semi")
    return first.join(kept, first["dst"] == F.col("__v"), "left_semi")


def touching(nodes: DataFrame, edges: DataFrame, vid: str = "vid") -> DataFrame:
    """Edges with an end among the nodes."""
    kept = nodes.select(F.col(vid).alias("__v"))
    by_src = edges.join(kept, edges["src"] == F.col("__v"), "left_semi")
    rest = edges.join(kept, edges["src"] == F.col("__v"), "left_anti")
    return by_src.unionByName(rest.join(kept, rest["dst"] == F.col("__v"), "left_semi"))


def degrees(edges: DataFrame) -> DataFrame:
    """Ends of edges at each node: an edge counts at both, a loop twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("vid"))
    return ends.groupBy("vid").agg(F.count("*").alias("degree"))


def faces_within(vertices: DataFrame, faces: DataFrame, width: int | None = None, vid: str = "vid") -> DataFrame:
    """Faces (``face``, ``ends``: array of ids) whose every end is among the vertices.

    Ends are exploded with their position, joined and counted, whatever the number of ends;
    a face that names a vertex twice needs it once.
    """
    ends = faces.select("face", F.size("ends").alias("__n"), F.posexplode("ends").alias("__pos", "__v"))
    kept = ends.join(vertices.select(F.col(vid).alias("__v")).distinct(), "__v", "left_semi")
    whole = kept.groupBy("face", "__n").agg(F.count("*").alias("__k")).where("__k = __n")
    if width is not None:
        whole = whole.where(F.col("__n") == width)
    return faces.join(whole.select("face"), "face", "left_semi")


def placed_ends(faces: DataFrame, vertices: DataFrame, columns: Sequence[str], vid: str = "vid") -> DataFrame:
    """``face, __v`` and columns of the vertex for each end, a face's ends together: minima of structs sort their rows, so a task gets a bounded part."""
    from lattica.sources.store import by_key

    ends = faces.select("face", F.explode("ends").alias("__v"))
    return by_key(ends.join(vertices.select(F.col(vid).alias("__v"), *columns), "__v"), "face")


def owner_cell(faces: DataFrame, vertices: DataFrame, cells: Sequence[str] = ("cx", "cy", "cz"), vid: str = "vid") -> DataFrame:
    """The cell that owns each face: that of its lexicographically least end by (cell, vid)."""
    least = placed_ends(faces, vertices, cells, vid).groupBy("face").agg(F.min(F.struct(*cells, "__v")).alias("m"))
    return least.select("face", *(F.col(f"m.{c}").alias(c) for c in cells))


def partition_links(edges: DataFrame, vertices: DataFrame, cells: Sequence[str] = ("cx", "cy", "cz"), vid: str = "vid") -> DataFrame:
    """Edges with ``intra`` (both ends in one cell) and the offset of cells from source to target."""
    a = vertices.select(F.col(vid).alias("src"), *(F.col(c).alias("s" + c) for c in cells))
    b = vertices.select(F.col(vid).alias("dst"), *(F.col(c).alias("d" + c) for c in cells))
    both = edges.join(a, "src").join(b, "dst")
    same = F.lit(True)
    for c in cells:
        same = same & (F.col("s" + c) == F.col("d" + c))
    return both.select("*", same.alias("intra"), *((F.col("d" + c) - F.col("s" + c)).alias("o" + c[1:]) for c in cells))


def canonical(ends: str = "ends") -> Column:
    """Ends in sorted order, each with the place it had: direction and winding can be restored."""
    return F.expr(f"array_sort(transform({ends}, (v, i) -> named_struct('vid', v, 'pos', i)))")


def restored(sorted_ends: str = "sorted") -> Column:
    """The ends as they were before canonical()."""
    return F.expr(f"transform(array_sort(transform({sorted_ends}, e -> named_struct('pos', e.pos, 'vid', e.vid))), e -> e.vid)")


def placements(faces: DataFrame, vertices: DataFrame, cells: Sequence[str] = ("cx", "cy", "cz"), vid: str = "vid") -> DataFrame:
    """A row for each face and distinct cell of its ends: where a duplicating store keeps copies."""
    return placed_ends(faces, vertices, cells, vid).select("face", *cells).distinct()


def within_cells(faces: DataFrame, vertices: DataFrame, accepted: Column, every: bool = True, cells: Sequence[str] = ("cx", "cy", "cz"), vid: str = "vid") -> DataFrame:
    """Faces all (or any) of whose ends lie in accepted cells."""
    ends = faces.select("face", F.explode("ends").alias("__v")).join(vertices.select(F.col(vid).alias("__v"), *cells), "__v")
    test = (F.min if every else F.max)(F.coalesce(accepted, F.lit(False)).cast("int"))
    hit = ends.groupBy("face").agg(test.alias("__ok")).where("__ok = 1")
    return faces.join(hit.select("face"), "face", "left_semi")


def skeleton_parents(vertices: DataFrame, records: DataFrame, fragment: Sequence[str] = ("cx", "cy", "cz", "frag"), vid: str = "vid", row: str = "row") -> DataFrame:
    """``child, parent`` of a branched skeleton: the row before in a fragment, unless stored records name parents.

    One record replaces the implicit parent (a null parent makes a root), several all hold;
    parents that are not among the vertices are left out, and their child is a root.
    """
    w = W.partitionBy(*fragment).orderBy(row)
    implied = vertices.select(F.col(vid).alias("child"), F.lag(vid).over(w).alias("__implied"))
    named = records.select(F.col("child").alias("__c"), F.col("parent").alias("__p"), F.lit(True).alias("__r"))
    both = implied.join(named, implied["child"] == F.col("__c"), "left")
    chosen = both.select("child", F.when(F.col("__r"), F.col("__p")).otherwise(F.col("__implied")).alias("parent"))
    read = vertices.select(F.col(vid).alias("parent"))
    return chosen.join(read, "parent", "left_semi").select("child", "parent")


def roots(vertices: DataFrame, parents: DataFrame, vid: str = "vid") -> DataFrame:
    """Vertices without a parent."""
    return vertices.join(parents.select(F.col("child").alias(vid)), vid, "left_anti")


def forests(vertices: DataFrame, parents: DataFrame, vid: str = "vid", oid: str = "oid") -> DataFrame:
    """Objects with more than one root: a skeleton must not have them."""
    return roots(vertices, parents, vid).groupBy(oid).agg(F.count("*").alias("n_roots")).where("n_roots > 1")


def restrict(edges: DataFrame, kept: DataFrame, vid: str = "vid", number: str = "row") -> DataFrame:
    """Edges among kept vertices, their ends replaced by the vertices' row numbers."""
    a = kept.select(F.col(vid).alias("src"), F.col(number).alias("__a"))
    b = kept.select(F.col(vid).alias("dst"), F.col(number).alias("__b"))
    return edges.join(a, "src").join(b, "dst").select(F.col("__a").alias("src_row"), F.col("__b").alias("dst_row"), *[c for c in edges.columns if c not in ("src", "dst")])


def per_tree(parents: DataFrame, walk: Callable[[pd.DataFrame], pd.DataFrame], schema: str, oid: str = "oid") -> DataFrame:
    """Run ``walk`` on the rows of one tree at a time; a tree is what one task must hold."""
    return parents.groupBy(oid).applyInPandas(walk, schema)


def depth_first(parents: DataFrame, oid: str = "oid") -> DataFrame:
    """``rank`` of each node in depth-first order: roots and children by id; nodes of cycles come last, by id.

    ``parents``: oid, child, parent (null for roots).  Small trees are walked by one task
    each, larger ones are contracted by rounds (see forest).
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        children: dict[int, list[int]] = {}
        heads = []
        for child, parent in sorted(zip(rows["child"], rows["parent"], strict=True), key=lambda r: r[0]):
            heads.append(child) if pd.isna(parent) else children.setdefault(int(parent), []).append(child)
        order, seen = [], set()
        stack = heads[::-1]
        while stack:
            v = stack.pop()
            if v not in seen:
                seen.add(v)
                order.append(v)
                stack += children.get(v, [])[::-1]
        order += sorted(set(rows["child"]) - seen)
        return pd.DataFrame({oid: rows[oid].iloc[0], "vid": order, "rank": range(len(order))})

    small, large = forest.split(parents, oid)
    out = per_tree(small, walk, f"{oid} long, vid long, rank long", oid)
    if large is None:
        return out
    found = forest.ranks(large)
    reached = found.where("rank is not null")
    rest = found.where("rank is null")  # of cycles
    if not rest.isEmpty():
        numbered = rest.withColumn("rank", (F.row_number().over(W.partitionBy("o").orderBy("v")) - 1).cast("long"))
        before = reached.groupBy("o").agg(F.count("*").alias("n"))
        last = numbered.join(before, "o", "left").withColumn("rank", F.col("rank") + F.coalesce("n", F.lit(0))).drop("n")
        reached = reached.unionByName(last)
    return out.unionByName(reached.select(F.col("o").alias(oid), F.col("v").alias("vid"), "rank"))


def maximal_paths(parents: DataFrame, oid: str = "oid") -> DataFrame:
    """Cut each tree into paths: the first child goes on, every other opens a path of its own.

    Columns: oid, path, seq, vid, and ``branch_of``, the node a path's first vertex hangs on.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        children: dict[int, list[int]] = {}
        heads = []
        for child, parent in sorted(zip(rows["child"], rows["parent"], strict=True), key=lambda r: r[0]):
            heads.append((child, None)) if pd.isna(parent) else children.setdefault(int(parent), []).append(child)
        out, paths = [], 0
        stack = heads[::-1]
        while stack:
            v, above = stack.pop()
            seq = 0
            while True:
                out.append((rows[oid].iloc[0], paths, seq, v, above if seq == 0 else None))
                below = children.get(v, [])
                stack += [(c, v) for c in below[:0:-1]]
                if not below:
                    break
                v, seq = below[0], seq + 1
            paths += 1
        return pd.DataFrame(out, columns=[oid, "path", "seq", "vid", "branch_of"]).astype({"branch_of": "Int64"})

    from .points import prefix_sums

    small, large = forest.split(parents, oid)
    out = per_tree(small, walk, f"{oid} long, path long, seq long, vid long, branch_of long", oid)
    if large is None:
        return out
    # a path lies without gaps in depth-first order, and so its number is that of the heads before it
    found = forest.ranks(large).where("rank is not null").withColumn("head", F.when(F.col("first"), 0).otherwise(1))
    counted = prefix_sums(found, ["o", "rank"], F.col("head"), "path").withColumn("path", F.col("path") + F.col("head"))
    base = counted.where("rank = 0").select("o", F.col("path").alias("__base"))
    heads = counted.where("head = 1").select("o", "path", F.col("rank").alias("__head"))
    rows = counted.join(heads, ["o", "path"]).join(base, "o")
    branch = F.when(F.col("head") == 1, F.col("q")).alias("branch_of")
    return out.unionByName(rows.select(F.col("o").alias(oid), (F.col("path") - F.col("__base")).alias("path"), (F.col("rank") - F.col("__head")).alias("seq"), F.col("v").alias("vid"), branch))
