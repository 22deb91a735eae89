"""Points: selection, projection, counting, limits and cells."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import grid

STORAGE_ORDER = ("cx", "cy", "cz", "frag", "row")


class SelectionError(ValueError):
    """A selection that the data cannot answer."""


def assign_cells(vertices: DataFrame, sizes: Sequence[float], axes: Sequence[str] = grid.AXES) -> DataFrame:
    """Vertices with the cell they lie in."""
    return vertices.drop(*("c" + a for a in axes)).select("*", *grid.cells(sizes, axes))


def id_frame(spark: SparkSession, ids: Iterable[int], name: str = "oid") -> DataFrame:
    """Requested ids with their place in the request; repeats keep the first place."""
    rows = [(int(i), k) for k, i in enumerate(dict.fromkeys(ids))]
    return spark.createDataFrame(rows, T.StructType([T.StructField(name, T.LongType()), T.StructField("asked", T.LongType())]))


@dataclass(frozen=True)
class Selection:
    """An immutable filter; later terms are added to earlier ones.

    Boxes intersect, id lists intersect in the order of the first, ``where`` terms join
    (the later value of a key holds), limits take the least, and a later ``near`` or
    ``cells`` replaces the earlier.  An unset term selects all, an empty one nothing.
    """

    box: tuple[tuple[float, ...], tuple[float, ...]] | None = None
    near: tuple[tuple[float, ...], float] | None = None
    objects: tuple[int, ...] | None = None
    groups: tuple[int, ...] | None = None
    cells: tuple[tuple[int, ...], ...] | None = None
    where: tuple[tuple[str, Any], ...] = ()
    limit: int | None = None
    attributes: tuple[str, ...] | None = None

    def and_(self, other: Selection) -> Selection:
        def ids(a, b):
            if a is None or b is None:
                return b if a is None else a
            other_ids = set(b)
            return tuple(i for i in a if i in other_ids)

        box = other.box if self.box is None else self.box
        if self.box and other.box:
            box = tuple(map(max, self.box[0], other.box[0])), tuple(map(min, self.box[1], other.box[1]))
        limits = [x for x in (self.limit, other.limit) if x is not None]
        return replace(
            self,
            box=box,
            near=other.near or self.near,
            objects=ids(self.objects, other.objects),
            groups=ids(self.groups, other.groups),
            cells=self.cells if other.cells is None else other.cells,
            where=tuple((dict(self.where) | dict(other.where)).items()),
            limit=min(limits) if limits else None,
            attributes=self.attributes if other.attributes is None else other.attributes,
        )

    def predicate(self, sizes: Sequence[float] | None, axes: Sequence[str], bins: Sequence[float] | None = None) -> Column:
        """Row terms as one column; a box or ball also bounds the cell and bin columns, so that scans prune."""
        out = F.lit(True)
        if self.box:
            out = out & grid.in_box(*self.box, axes)
            if sizes:
                out = out & grid.box_cells(*self.box, sizes, axes)
                if bins:
                    out = out & grid.box_bins(*self.box, sizes, bins, axes)
        if self.near:
            centre, r = self.near
            lo, hi = [c - r for c in centre], [c + r for c in centre]
            out = out & grid.in_box(lo, hi, axes) & grid.in_ball(centre, r, axes)
            if sizes:
                out = out & grid.box_cells(lo, hi, sizes, axes)
                if bins:
                    out = out & grid.box_bins(lo, hi, sizes, bins, axes)
        if self.cells is not None:  # bounds for the scan; the cells themselves are joined
            out = out & (F.lit(bool(self.cells)))
            for a, values in zip(axes, zip(*self.cells, strict=True), strict=False):
                out = out & F.col("c" + a).between(int(min(values)), int(max(values)))
        for name, value in self.where:
            out = out & (F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
        return out


class Query:
    """A lazy selection over vertices; each call gives a new query.

    ``sizes`` are the sizes of the cells in columns cx, cy, cz, where there are any, ``bins``
    those of column bin.  ``groups`` has ``gid`` and ``members``.  A vertex belongs to one
    object; a level without ``oid`` refuses object terms.
    """

    def __init__(self, vertices: DataFrame, *, sizes: Sequence[float] | None = None, bins: Sequence[float] | None = None, axes: Sequence[str] = grid.AXES, groups: DataFrame | None = None, order: Sequence[str] = ("vid",), selection: Selection | None = None):
        self.vertices, self.sizes, self.bins, self.axes, self.groups, self.order = vertices, sizes, bins, tuple(axes), groups, tuple(order)
        self.selection = selection or Selection()

    def select(self, **terms) -> Query:
        terms = {k: tuple(v.items()) if k == "where" else v for k, v in terms.items()}
        if isinstance(terms.get("attributes"), str):
            terms["attributes"] = (terms["attributes"],)
        for k in ("objects", "groups", "cells", "attributes"):
            if terms.get(k) is not None:
                terms[k] = tuple(terms[k])
        merged = self.selection.and_(Selection(**terms))
        return Query(self.vertices, sizes=self.sizes, bins=self.bins, axes=self.axes, groups=self.groups, order=self.order, selection=merged)

    def dataframe(self) -> DataFrame:
        """The rows selected, narrowed to the attributes asked for; ordered only where a limit needs it."""
        s, df = self.selection, self.vertices
        if (s.objects is not None or s.groups is not None) and "oid" not in df.columns:
            raise SelectionError("this level has no object ids")
        df = self._chosen(df)
        if s.limit is not None:
            df = self._leading(df).orderBy(*self.order).limit(s.limit)
        if s.attributes is not None:
            fixed = [c for c in df.columns if c in {"vid", "oid", "seq", *self.axes, *("c" + a for a in self.axes)}]
            df = df.select(*fixed, *(a for a in s.attributes if a not in fixed))
        return df

    def _chosen(self, df: DataFrame) -> DataFrame:
        """Rows under all terms but the limit; ids and cells beyond what a plan should hold are joined."""
        s, spark = self.selection, df.sparkSession
        df = df.where(s.predicate(self.sizes, self.axes, self.bins))
        if s.cells:
            names = ["c" + a for a in self.axes]
            wanted = spark.createDataFrame(sorted({tuple(map(int, c)) for c in s.cells}), ", ".join(f"{n} long" for n in names))
            df = df.join(wanted, names, "left_semi")
        if s.objects is not None:
            df = df.where(F.col("oid").isin(list(s.objects))) if len(s.objects) <= 1000 else df.join(id_frame(spark, s.objects), "oid", "left_semi")
        if s.groups is not None:
            df = df.join(self._members(), "oid", "left_semi")
        return df

    def _members(self) -> DataFrame:
        """gid and oid of the groups asked for; a group there is not is an error."""
        if self.groups is None:
            raise SelectionError("this level has no groups")
        asked = {int(g) for g in self.selection.groups}
        chosen = self.groups.where(F.col("gid").isin(list(asked)))
        if missing := asked - {r["gid"] for r in chosen.select("gid").collect()}:  # as many as were asked for
            raise SelectionError(f"no group {', '.join(map(str, sorted(missing)))}")
        return chosen.select("gid", F.explode("members").alias("oid"))

    def _leading(self, df: DataFrame, least: int = 10_000) -> DataFrame:
        """Without the cells on the first axis that a large limit can't reach: their counts say how far it goes."""
        first = "c" + self.axes[0]
        if self.selection.limit < least or self.order[0] != first:
            return df
        counts = df.groupBy(first).count().orderBy(first).limit(self.selection.limit)  # each has a row at least
        total, last = 0, None
        for row in counts.toLocalIterator():
            total, last = total + row["count"], row[first]
            if total >= self.selection.limit:
                return df.where(F.col(first) <= last)
        return df

    def truncated(self) -> bool:
        """Whether the limit leaves out rows that are selected."""
        limit = self.selection.limit
        return limit is not None and self._chosen(self.vertices).limit(limit + 1).count() > limit

    def in_request_order(self) -> DataFrame:
        """Rows grouped by object in the order in which ids were asked for, in storage order within; ``asked`` is the place."""
        if self.selection.objects is None:
            raise SelectionError("no objects were asked for")
        df = self.dataframe()
        return df.join(id_frame(df.sparkSession, self.selection.objects), "oid").orderBy("asked", *(c for c in self.order if c in df.columns))

    def count(self) -> int:
        return self.dataframe().count()

    def cost(self) -> dict[str, int]:
        """What a read would scan at most, from file listings and statistics alone: files, and bytes by the optimizer's estimate."""
        df = self._chosen(self.vertices)
        return {"files": len(df.inputFiles()), "bytes": int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))}

    def object_ids(self) -> DataFrame:
        """Distinct ids with at least one vertex selected, sorted."""
        if "oid" not in self.vertices.columns:
            raise SelectionError("this level has no object ids")
        return self.dataframe().where("oid is not null").select("oid").distinct().orderBy("oid")

    def cells(self) -> DataFrame:
        """Occupied cells the selection touches, at cell granularity: the box prunes cells, not vertices."""
        names = ["c" + a for a in self.axes]
        df = self.vertices
        if self.selection.box and self.sizes:
            df = df.where(grid.box_cells(*self.selection.box, self.sizes, self.axes))
        if self.selection.near and self.sizes:
            centre, r = self.selection.near
            df = df.where(grid.box_cells([c - r for c in centre], [c + r for c in centre], self.sizes, self.axes))
        if self.selection.cells is not None:
            df = Query(df, axes=self.axes, selection=Selection(cells=self.selection.cells))._chosen(df)
        return df.select(*names).distinct()

    def iter_cells(self):
        """(cell, rows) in sorted order of cells; all rows selected pass through the driver, one partition at a time."""
        names = ["c" + a for a in self.axes]
        current, rows = None, []
        for row in self.dataframe().orderBy(*names, *self.order).toLocalIterator(prefetchPartitions=True):
            key = tuple(row[n] for n in names)
            if key != current and rows:
                yield current, rows
                rows = []
            current = key
            rows.append(row)
        if rows:
            yield current, rows

    def explain(self, mode: str = "formatted") -> None:
        self.dataframe().explain(mode)

    def plan(self) -> str:
        """The physical plan as text, without running it."""
        return self.dataframe()._jdf.queryExecution().executedPlan().toString()


def bounds(vertices: DataFrame, axes: Sequence[str] = grid.AXES, empty: str = "null") -> DataFrame:
    """Least and greatest position on each axis; no vertices give nulls, or fail the job with ``empty="raise"``."""
    found = vertices.agg(*(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))), F.count("*").alias("__n"))
    if empty == "raise":
        found = found.where(F.when(F.col("__n") > 0, F.lit(True)).otherwise(F.raise_error(F.lit("no vertices")).cast("boolean")))
    return found.drop("__n")


def occupied(vertices: DataFrame, axes: Sequence[str] = grid.AXES) -> DataFrame:
    """Vertices and objects of each occupied cell."""
    names = ["c" + a for a in axes]
    objects = [F.countDistinct("oid").alias("n_objects")] if "oid" in vertices.columns else []
    return vertices.groupBy(*names).agg(F.count("*").alias("n_vertices"), *objects)


def clip(vertices: DataFrame, lo: Sequence[float], hi: Sequence[float], policy: str, axes: Sequence[str] = grid.AXES) -> DataFrame:
    """Out-of-bounds policy: ``ignore`` drops rows outside, ``expand`` keeps them, ``raise`` fails the job at the first."""
    if policy == "expand":
        return vertices
    inside = grid.in_box(lo, hi, axes)
    if policy == "ignore":
        return vertices.where(inside)
    if policy != "raise":
        raise ValueError(f"no such policy: {policy}")
    check = F.when(F.coalesce(inside, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("a vertex lies out of bounds")).cast("boolean"))
    return vertices.where(check)


def read_cells(vertices: DataFrame, keys: DataFrame, axes: Sequence[str] = grid.AXES) -> DataFrame:
    """Rows of requested cells in the order of the request, ``pos``; repeats are kept, empty cells give no rows."""
    return keys.join(vertices, ["c" + a for a in axes])


def neighbours(cells: DataFrame, halo: int = 1, axes: Sequence[str] = grid.AXES, centre: bool = True) -> DataFrame:
    """Each cell with the occupied cells within ``halo`` of it, as an equi-join on exploded offsets.

    Columns: the cell, and nx, ny, nz of its neighbour.
    """
    names = ["c" + a for a in axes]
    steps = F.array(*(F.struct(*(F.lit(o).cast("long").alias(a) for a, o in zip(axes, offset, strict=True))) for offset in grid.offsets(len(axes), halo, centre)))
    own = cells.select(*names).distinct()
    around = own.select(*names, F.explode(steps).alias("o")).select(*names, *((F.col("c" + a) + F.col(f"o.{a}")).alias("n" + a) for a in axes))
    there = own.select(*(F.col("c" + a).alias("n" + a) for a in axes))
    return around.join(there, ["n" + a for a in axes], "left_semi")


def nearest_in_cell(targets: DataFrame, vertices: DataFrame, axes: Sequence[str] = grid.AXES, others: bool = False, tol: float | None = None) -> DataFrame:
    """For each target (``tid``, position tx, ty, tz and its cell) the nearest vertex of the same cell, least vid on ties.

    With ``others`` the vertex whose vid is the tid is not a candidate; with ``tol`` a target
    whose nearest vertex is farther fails the job.
    """
    names = ["c" + a for a in axes]
    d2 = sum(((F.col(a).cast("double") - F.col("t" + a).cast("double")) * (F.col(a).cast("double") - F.col("t" + a).cast("double")) for a in axes), F.lit(0.0))
    candidates = vertices.select("vid", *names, *axes)
    wanted = targets.select("tid", *names, *("t" + a for a in axes))

    def pairs(near: DataFrame) -> DataFrame:
        both = near.join(candidates, names)
        return both.where("vid <> tid") if others else both

    # numbers alone are aggregated by hash: minima of structs would sort all pairs, which grow as the square of a cell
    least = pairs(wanted).select("tid", d2.alias("d2")).groupBy("tid").agg(F.min("d2").alias("d2"))
    best = pairs(wanted.join(least, "tid")).where(d2 == F.col("d2"))
    found = best.groupBy("tid").agg(F.min("vid").alias("vid"), F.min("d2").alias("d2"))
    if tol is None:
        return found
    near = F.when(F.col("d2") <= float(tol) ** 2, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no vertex near target "), F.col("tid").cast("string"))).cast("boolean"))
    return found.where(near)


def encode_categories(df: DataFrame, column: str, fill: int = -1) -> tuple[DataFrame, DataFrame]:
    """``code`` of each row's value, in sorted order of the distinct values, ``fill`` for null; and the value table."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    table = number_rows(values, [column], "code")
    return df.join(table, column, "left").withColumn("code", F.coalesce("code", F.lit(fill)).cast("long")), table


def decode_categories(df: DataFrame, table: DataFrame, column: str, code: str = "code") -> DataFrame:
    """``column`` of each row's code; codes that the table doesn't have, such as the fill, give null."""
    return df.drop(column).join(table.select(code, column), code, "left")


def prefix_sums(df: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows before each in a global order, without one task that holds all rows.

    Rows are range-partitioned and summed where they lie; the sums of the partitions before,
    a row for each partition, are added.  The frame is written first, because this reads it
    twice and both readings must see the same partitions.
    """
    from lattica.sources.store import materialize

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("__value", value.cast("long")).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    running = F.coalesce(F.sum("__value").over(W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    local = materialize(ranged.withColumn("__sum", running), "prefix")
    sums = local.groupBy("__part").agg(F.sum("__value").alias("__rows"))
    before = sums.select("__part", F.coalesce(F.sum("__rows").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    joined = local.join(F.broadcast(before), "__part")
    return joined.withColumn(name, (F.col("__sum") + F.col("__before")).cast("long")).drop("__part", "__value", "__sum", "__before")


def number_rows(df: DataFrame, order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """Dense numbers from ``start`` in a global order."""
    return prefix_sums(df, order, F.lit(1), name).withColumn(name, F.col(name) + start)


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """Interpolated quantiles of the non-null values, from three aggregations and no sort of the table.

    Approximate quantiles around each rank bound a slice that holds it; how many rows lie
    below a slice is counted, and the values in it, a few hundredths of a per cent of the
    table, are counted by value and ranked.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    n = values.count()
    if not n:
        return []
    wanted = [s * (n - 1) for s in shares]
    places = sorted({i for w in wanted for i in (math.floor(w), math.ceil(w))})
    margin = 2e-4
    edges = sorted({min(1.0, max(0.0, (i + d) / n + m)) for i in places for d, m in ((0, -margin), (1, margin))})
    low, high = values.agg(F.min("v"), F.max("v")).first()
    near = values.agg(F.percentile_approx("v", [float(e) for e in edges], 100_000).alias("q")).first()["q"]
    cuts = dict(zip(edges, near, strict=True))
    slices = []
    for i in places:
        a, b = (min(1.0, max(0.0, (i + d) / n + m)) for d, m in ((0, -margin), (1, margin)))
        slices.append((i, low if a <= 0 else cuts[a], high if b >= 1 else cuts[b]))
    below = values.agg(*(F.count(F.when(F.col("v") < a, 1)).alias(f"n{k}") for k, (_, a, _) in enumerate(slices))).first()
    inside = F.lit(False)
    for _, a, b in slices:
        inside = inside | F.col("v").between(a, b)
    counted = values.where(inside).groupBy("v").count()
    at: dict[int, float] = {}
    for k, (i, a, b) in enumerate(slices):
        ranked = prefix_sums(counted.where(F.col("v").between(a, b)), ["v"], F.col("count"), "before")
        row = ranked.where((F.col("before") + below[f"n{k}"] <= i) & (F.col("before") + F.col("count") + below[f"n{k}"] > i)).first()
        if row is None:
            raise ValueError(f"rank {i} is not where its bounds say")
        at[i] = row["v"]
    return [at[math.floor(w)] + (at[math.ceil(w)] - at[math.floor(w)]) * (w - math.floor(w)) for w in wanted]
