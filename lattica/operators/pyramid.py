"""Resolution pyramids: coarse levels of centroids, their manifests and links across levels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions import grid

#: Declared attribute aggregations.
AGGREGATIONS = {"mean": F.avg, "sum": F.sum, "mode": F.mode, "count": F.count, "min": F.min, "max": F.max}

Strategy = Callable[..., DataFrame]
_coarsen: dict[str, Strategy] = {}
_select: dict[str, Strategy] = {}


class CoarseningError(ValueError):
    """An unknown method, or factors that make no coarser level."""


def register(registry: dict[str, Strategy], name: str, fn: Strategy) -> None:
    if name in ("per_object", "random"):
        raise CoarseningError(f"{name} is built in")
    registry[name] = fn


def register_coarsen(name: str, fn: Strategy) -> None:
    """Add a method: a function of the vertices and the keyword arguments of coarsen()."""
    register(_coarsen, name, fn)


def register_selection(name: str, fn: Strategy) -> None:
    """Add an object selection: a function of (objects, target, **context) that returns kept ids."""
    register(_select, name, fn)


def methods() -> list[str]:
    return ["per_object", *sorted(_coarsen)]


def coarsen(vertices: DataFrame, bins: Sequence[float], *, axes: Sequence[str] = grid.AXES, by: Sequence[str] = (), aggregate: dict[str, str] | None = None, method: str = "per_object") -> DataFrame:
    """One metavertex for each occupied bin: its bin (bx, by, bz), centroid, and how many vertices it stands for.

    The centroid is a double-precision mean.  ``aggregate`` names attributes to carry.
    Sums are partial before the shuffle, so a crowded bin is as cheap as any other.
    """
    if method != "per_object":
        if method not in _coarsen:
            raise CoarseningError(f"no such method: {method}")
        return _coarsen[method](vertices, bins=bins, axes=axes, by=by, aggregate=aggregate)
    if min(bins) <= 0:
        raise CoarseningError("bins must be wider than nothing")
    keys = [*by, *("b" + a for a in axes)]
    binned = vertices.drop(*("b" + a for a in axes)).select("*", *grid.cells(bins, axes, "b"))
    carried = [AGGREGATIONS[how](name).alias(name) for name, how in (aggregate or {}).items()]
    return binned.groupBy(*keys).agg(*(F.avg(F.col(a).cast("double")).alias(a) for a in axes), F.count("*").alias("n_vertices"), *carried)


def coarse_manifest(vertices: DataFrame, bins: Sequence[float], *, axes: Sequence[str] = grid.AXES, oid: str = "oid", order: Sequence[str] = ("seq",)) -> DataFrame:
    """Each object's path through bins, consecutive repeats dropped and revisits kept: ``pos`` from 0."""
    names = ["b" + a for a in axes]
    w = W.partitionBy(oid).orderBy(*order)
    binned = vertices.select(oid, *order, *grid.cells(bins, axes, "b"))
    same = F.lit(True)
    for n in names:
        same = same & F.lag(n).over(w).eqNullSafe(F.col(n))
    first = F.row_number().over(w) == 1
    entered = binned.withColumn("__new", first | ~same).where("__new").drop("__new")
    return entered.select(oid, (F.row_number().over(w) - 1).cast("long").alias("pos"), *names)


def cross_level_parents(fine: DataFrame, coarse: DataFrame, bins: Sequence[float], *, axes: Sequence[str] = grid.AXES, by: Sequence[str] = (), vid: str = "vid", meta: str = "mvid") -> DataFrame:
    """``vid, parent``: the metavertex of each fine vertex's bin; vertices of bins without one have no row."""
    names = [*by, *("b" + a for a in axes)]
    return fine.select(F.col(vid).alias("vid"), *by, *grid.cells(bins, axes, "b")).join(coarse.select(*names, F.col(meta).alias("parent")), names).select("vid", "parent")


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """Parents two links up: first's parents looked up in second."""
    up = second.select(F.col("vid").alias("__mid"), F.col("parent").alias("__top"))
    return first.join(up, first["parent"] == F.col("__mid")).select("vid", F.col("__top").alias("parent"))


def sparsify(objects: DataFrame, sparsity: float, *, oid: str = "oid", seed: int = 0, strategy: str = "random", count: int | None = None, **context) -> DataFrame:
    """Ids kept at ``sparsity``: max(1, round(n * sparsity)) of those present, in the order of a seeded hash.

    The order is that of md5(seed:id), which does not depend on the sparsity, so a coarser
    level keeps a subset of a finer one's.  A lone object is never dropped.
    """
    if not 0 < sparsity <= 1:
        raise CoarseningError("sparsity lies in (0, 1]")
    n = objects.count() if count is None else count
    if n == 0:
        return objects.select(oid)
    target = max(1, round(n * sparsity))
    if strategy != "random":
        if strategy not in _select:
            raise CoarseningError(f"no such selection: {strategy}")
        return _select[strategy](objects, target, oid=oid, seed=seed, **context)
    from lattica.operators.points import number_rows

    hashed = objects.select(oid, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(oid).cast("string"))).alias("__hash"))
    return number_rows(hashed, ["__hash", oid], "__n").where(F.col("__n") < target).select(oid)


def build_pyramid(vertices: DataFrame, bins: Sequence[float], factors: Sequence[tuple[float, float]], *, axes: Sequence[str] = grid.AXES, seed: int = 0, first_level: int = 1) -> list[tuple[DataFrame, DataFrame]]:
    """(vertices, bins) of each coarser level, for (coarsening, sparsity) factors that compound.

    Vertices have ``vid``, ``oid``, ``seq`` and the centroid; bins (bx, by, bz) have the
    ``mvid`` that is the vid of their vertices.  Bins are numbered densely within a level, the
    level in the bits above 44, so that ids never meet.  Objects keep their ids on all levels.
    """
    from lattica.operators.points import number_rows

    out: list[tuple[DataFrame, DataFrame]] = []
    current, sizes = vertices, [float(b) for b in bins]
    for level, (factor, sparsity) in enumerate(factors, first_level):
        if factor < 1:
            raise CoarseningError("a level cannot be finer than its parent")
        sizes = [s * factor for s in sizes]
        if sparsity < 1:
            kept = sparsify(current.select("oid").distinct(), sparsity, seed=seed)
            current = current.join(kept, "oid", "left_semi")
        names = ["b" + a for a in axes]
        coarse = number_rows(coarsen(current, sizes, axes=axes), names, "mvid", start=level << 44)
        path = coarse_manifest(current, sizes, axes=axes)
        placed = path.join(coarse, names).select("oid", F.col("pos").alias("seq"), F.col("mvid").alias("vid"), *axes)
        out.append((placed, coarse.select(*names, "mvid")))
        current = placed
    return out


def sparse_attributes(objects: DataFrame, kept: DataFrame, columns: Sequence[str], fill: dict | None = None, oid: str = "oid") -> DataFrame:
    """Every object with ``kept`` and its attributes, which dropped ones have as null, or as a sentinel of ``fill``."""
    marked = objects.join(kept.select(oid, F.lit(True).alias("kept")), oid, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    values = {c: F.when(F.col("kept"), F.col(c)).otherwise(F.lit((fill or {}).get(c))).cast(objects.schema[c].dataType) for c in columns}
    return marked.withColumns(values)
