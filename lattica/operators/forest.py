"""Depth-first ranks in trees that no task can hold.

Trees are contracted by rounds: every leaf goes into its parent, and where leaves are few,
vertices with one child go into the edge above, no two neighbours in one round.  Rounds grow
as the logarithm of the vertices, and each holds a share of the one before, until a bounded
number of vertices is left for the driver.  Then rounds are undone, the last one first: once
for sizes of subtrees, and, since a child's rank is its parent's, one, and the sizes of the
siblings before it, once for ranks.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of the largest tree that is walked by one task, and of what the driver is left with.
TREE_ROWS = 50_000

KEY = ["o", "v"]


def split(parents: DataFrame, oid: str, bound: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of trees that one task walks, and those of larger ones as ``o, v, q``, None if there are none.

    A tree in which a vertex has several parents is walked whole, whatever its size: its
    order depends on what was visited before.
    """
    from lattica.sources.store import materialize

    rows = materialize(parents.select(*(F.col(c).cast("long").alias(c) for c in (oid, "child", "parent"))), "trees")
    each = rows.groupBy(oid, "child").agg(F.count("*").alias("n")).groupBy(oid).agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    large = materialize(each.where((F.col("n") > (TREE_ROWS if bound is None else bound)) & (F.col("most") == 1)).select(oid), "large")
    if large.isEmpty():
        return rows, None
    return rows.join(large, oid, "left_anti"), rows.join(large, oid, "left_semi").select(F.col(oid).alias("o"), F.col("child").alias("v"), F.col("parent").alias("q"))


def _by_round(df: DataFrame) -> DataFrame:
    """df written with a folder for each ``gone``, and read back."""
    from lattica.sources.store import shared_folder

    path = f"{shared_folder(df.sparkSession)}/rounds-{uuid.uuid4().hex}"
    df.write.partitionBy("gone").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _from_above(rows: Iterable[Row]) -> list[Row]:
    """Rows (o, v, p) with parents before children; those of cycles are left out."""
    rows = list(rows)
    at = {(r.o, r.v): r for r in rows}
    below = defaultdict(list)
    for r in rows:
        below[r.o, r.p].append(r)
    out = [r for k, found in below.items() if k not in at for r in found]
    for r in out:  # grows
        out += below.get((r.o, r.v), ())
    return out


def ranks(trees: DataFrame, bound: int | None = None) -> DataFrame:
    """``o, v, q, first, rank`` of trees ``o, v, q`` (q: the parent, null for roots): the place in depth-first order, from 0.

    Roots and children go by id; ``first`` is true of the first child of a parent.  Vertices
    that no root reaches have no rank.  A vertex occurs once in its tree.
    """
    from lattica.sources.store import materialize

    spark, bound = trees.sparkSession, TREE_ROWS if bound is None else bound
    # p: the parent in the contracted tree; e: vertices gone into the edge to it, w: into the vertex, itself among them
    live = materialize(trees.select("o", "v", "q", F.col("q").alias("p"), F.lit(0).cast("long").alias("e"), F.lit(1).cast("long").alias("w")), "forest")
    gone: list[DataFrame] = []
    chains: dict[int, DataFrame] = {}
    inner = F.col("p").isNotNull()
    left = live.where(inner).count()
    while left > bound:
        above = live.where("p <> v").select("o", F.col("p").alias("v"), F.lit(True).alias("has")).distinct()
        marked = materialize(live.join(above, KEY, "left").withColumn("leaf", inner & F.col("has").isNull()).drop("has"), "marked")
        leaves = marked.where("leaf")
        gone.append(leaves.select("o", "v", "q", "p", F.col("w").alias("s")))
        sums = leaves.groupBy("o", "p").agg(F.sum(F.col("e") + F.col("w")).alias("more")).withColumnRenamed("p", "v")
        rest = marked.where("not leaf").join(sums, KEY, "left").withColumn("w", F.col("w") + F.coalesce("more", F.lit(0)))
        live = materialize(rest.select("o", "v", "q", "p", "e", "w"), "forest")
        before, left = left, live.where(inner).count()
        if left <= bound or left <= before // 2:
            continue
        coin = lambda c: F.xxhash64("o", c, F.lit(len(gone))).bitwiseAND(F.lit(1).cast("long"))  # noqa: E731, B023
        single = live.where("p <> v").select("o", F.col("p").alias("v"), F.col("v").alias("c"), F.col("e").alias("ec"))
        single = single.groupBy(*KEY).agg(F.count("*").alias("k"), F.max("c").alias("c"), F.max("ec").alias("ec")).where("k = 1").drop("k")
        cut = materialize(live.where(inner & (coin("v") == 1) & (coin("p") == 0)).join(single, KEY), "chain")
        chains[len(gone)] = cut
        gone.append(cut)
        below = cut.select("o", F.col("c").alias("v"), F.col("p").alias("to"), (F.col("e") + F.col("w")).alias("more"))
        rest = live.join(cut.select(*KEY), KEY, "left_anti").join(below, KEY, "left")
        live = materialize(rest.select("o", "v", "q", F.coalesce("to", "p").alias("p"), (F.col("e") + F.coalesce("more", F.lit(0))).alias("e"), "w"), "forest")
        left = live.where(inner).count()

    few = live.where(inner).collect()  # at most bound
    heavier: dict[tuple[int, int], int] = defaultdict(int)
    size = {(r.o, r.v): r.w for r in few}
    for r in reversed(_from_above(few)):
        size[r.o, r.v] = r.w + heavier.pop((r.o, r.v), 0)
        heavier[r.o, r.p] += r.e + size[r.o, r.v]
    last = spark.createDataFrame([(r.o, r.v, r.q, r.p, size[r.o, r.v]) for r in few], "o long, v long, q long, p long, s long")
    sums = spark.createDataFrame([(o, v, n) for (o, v), n in heavier.items()], "o long, v long, more long")
    tops = live.where(~inner).join(sums, KEY, "left").select("o", "v", "q", "p", (F.col("w") + F.coalesce("more", F.lit(0))).alias("s"))

    n = len(gone)
    known = tops.unionByName(last).select("o", "v", "s")
    for k in reversed(range(n)):
        if k in chains:
            below = known.select("o", F.col("v").alias("c"), F.col("s").alias("sc"))
            gone[k] = materialize(gone[k].join(below, ["o", "c"]).select("o", "v", "q", "p", (F.col("w") + F.col("ec") + F.col("sc")).alias("s")), "sizes")
        known = known.unionByName(gone[k].select("o", "v", "s"))

    rows = None
    for k, part in enumerate([*gone, last, tops]):
        part = part.withColumn("gone", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    w = W.partitionBy("o", "q").orderBy("v")
    earlier = F.coalesce(F.sum("s").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    steps = rows.select("o", "v", "q", "p", (earlier + F.col("q").isNotNull().cast("long")).alias("d"), (F.col("q").isNotNull() & (F.row_number().over(w) == 1)).alias("first"), "gone")
    steps = _by_round(steps)  # d: from the parent's rank to the vertex's
    parts = []
    for k in range(n):
        parts.append(steps.where(F.col("gone") == k))
        if k in chains:
            over = chains[k].select("o", "v", "c").join(parts[k].select("o", "v", F.col("d").alias("more")), KEY).select("o", F.col("c").alias("v"), "more")
            moved = steps.where(F.col("gone") > k).join(over, KEY, "left").withColumn("d", F.col("d") + F.coalesce("more", F.lit(0)))
            steps = _by_round(moved.select(*steps.columns))

    known = steps.where(F.col("gone") == n + 1).select("o", "v", "q", "first", F.col("d").alias("rank"))
    few = steps.where(F.col("gone") == n).collect()
    if few:
        named = spark.createDataFrame(sorted({(r.o, r.p) for r in few}), "o long, v long")
        rank = {(r.o, r.v): r.rank for r in known.join(F.broadcast(named), KEY, "left_semi").select("o", "v", "rank").collect()}
        for r in _from_above(few):
            if (r.o, r.p) in rank:
                rank[r.o, r.v] = rank[r.o, r.p] + r.d
        known = known.unionByName(spark.createDataFrame([(r.o, r.v, r.q, r.first, rank.get((r.o, r.v))) for r in few], "o long, v long, q long, first boolean, rank long"))
    for k in reversed(range(n)):
        above = known.select("o", F.col("v").alias("p"), F.col("rank").alias("from"))
        known = known.unionByName(materialize(parts[k].join(above, ["o", "p"], "left").select("o", "v", "q", "first", (F.col("from") + F.col("d")).alias("rank")), "ranks"))
    return known
