"""Pyramids, rewrites and attributes of stored datasets; each change is one snapshot."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import grid
from lattica.operators import layout, objects, pyramid
from lattica.sources.store import Dataset, StoreError

_SETTINGS = "pyramid"


def build_pyramid(ds: Dataset, factors: Sequence[tuple[float, float]], *, bins: Sequence[float] | None = None, seed: int = 0, depth: int = 1, mirrored: bool = False) -> int:
    """Coarser levels of level 0 and their parent links, in one commit: all levels appear or none.

    ``factors`` are (coarsening, sparsity) of each level over the one below.  ``depth`` is how
    many levels up parents are composed (-1: all); ``mirrored`` also stores each link at its
    coarse level, with a negative delta.  Settings are kept for refresh_pyramid().
    """
    schema = ds.schema
    if max(ds.snapshot()["levels"], default=-1) != 0:
        raise StoreError("a pyramid is built on level 0 alone")
    sizes = tuple(bins or schema.bins or schema.chunk)
    settings = {"factors": [list(f) for f in factors], "bins": list(sizes), "seed": seed, "depth": depth, "mirrored": mirrored}
    new = _rebuild(ds, settings, 0, f"pyramid of {len(factors)} levels")
    ds.set_user(_SETTINGS, settings)
    return new


def _rebuild(ds: Dataset, settings: Mapping[str, Any], source: int, message: str) -> int:
    """Write all levels above ``source`` from it, each with a grid as much coarser as its bins."""
    current = ds.snapshot()
    axes, chunk = ds.schema.axes, ds.grid(source)[0]
    factors = settings["factors"][source:]
    scale = 1.0
    for factor, _ in settings["factors"][:source]:
        scale *= factor
    sizes = [b * scale for b in settings["bins"]]
    base = ds.table("vertices", current["id"], level=source)
    found = pyramid.build_pyramid(base.select("vid", "oid", "seq", *axes), sizes, factors, axes=axes, seed=settings["seed"], first_level=source + 1)
    tables: dict[str | tuple[str, int], DataFrame] = {}
    grids: dict[int, dict] = {}
    steps: dict[int, DataFrame] = {}
    below, scale = base, 1.0
    for k, ((rows, metas), (factor, _)) in enumerate(zip(found, factors, strict=True), source + 1):
        scale *= factor
        cell, bins = [c * scale for c in chunk], [s * scale for s in sizes]
        grids[k] = {"chunk": cell, "bins": None}
        placed = rows.select("*", *grid.cells(cell, axes))
        if "manifests" in current["tables"]:
            names = ["c" + a for a in axes]
            placed = objects.fragment_rank(placed, names)
            tables["manifests", k] = objects.object_manifest(placed, names)
        tables["vertices", k] = ds.clustered(placed)
        single = below if k == source + 1 else below.dropDuplicates(["vid"])
        steps[k - 1] = pyramid.cross_level_parents(single, metas, bins, axes=axes)
        below = rows
    kept = {k: ds.table("parents", current["id"], level=k) for k in range(source) if "parents" in current["tables"]}
    one_up = {k: t.where("delta = 1").select("vid", "parent") for k, t in kept.items()} | steps
    reach = len(settings["factors"]) if settings["depth"] < 0 else settings["depth"]
    up: dict[int, list[DataFrame]] = {}
    for k in range(len(settings["factors"])):
        chain = None
        for delta in range(1, reach + 1):
            if k + delta - 1 not in one_up:
                break
            chain = one_up[k] if chain is None else pyramid.compose(chain, one_up[k + delta - 1])
            up.setdefault(k, []).append(chain.withColumn("delta", F.lit(delta)))
            if settings.get("mirrored"):
                up.setdefault(k + delta, []).append(chain.select(F.col("parent").alias("vid"), F.col("vid").alias("parent")).withColumn("delta", F.lit(-delta)))
    for k, parts in up.items():
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        tables["parents", k] = out
    return ds.commit(tables, message, levels=grids, grids=grids, expected=current["id"])


def refresh_pyramid(ds: Dataset, source_level: int = 0) -> int:
    """Build the levels above ``source_level`` again, with the factors they were built with."""
    settings = ds.user(_SETTINGS)
    if not settings:
        raise StoreError("no pyramid was built")
    return _rebuild(ds, settings, source_level, "pyramid refreshed")


def reshard(ds: Dataset, files: int) -> int:
    """The same rows in another number of files a level; answers never change."""
    current = ds.snapshot()
    tables = {("vertices", k): ds.clustered(ds.table("vertices", current["id"], level=k), files) for k in current["levels"]}
    return ds.commit(tables, f"{files} files", expected=current["id"])


def rebin(ds: Dataset, bins: Sequence[float], level: int = 0) -> int:
    """Other bins for a level of a point cloud; they must tile its chunks.  Other levels keep theirs."""
    if ds.schema.kind != "point_cloud":
        raise StoreError("only point clouds are binned anew")
    current = ds.snapshot()
    chunk = ds.grid(level)[0]
    grid.bins_per_chunk(chunk, bins)
    rows = ds.placed(ds.table("vertices", current["id"], level=level), level, chunk, bins)
    grids = {level: {"chunk": list(chunk), "bins": list(map(float, bins))}}
    return ds.commit({("vertices", level): ds.clustered(rows)}, "rebinned", grids=grids, expected=current["id"])


def rechunk(ds: Dataset, root: str, sizes: Sequence[float]) -> Dataset:
    """A new dataset with another grid: coarser levels keep their ratio to level 0, manifests follow, other tables are carried over."""
    schema, current = ds.schema, ds.snapshot()
    changed = json.loads(json.dumps(schema.to_dict())) | {"chunk": [float(s) for s in sizes], "bins": None}
    out = Dataset.create(ds.spark, root, type(schema).from_dict(changed))
    names = ["c" + a for a in schema.axes]
    tables: dict[str | tuple[str, int], DataFrame] = {name: ds.table(name, current["id"]) for name in current["tables"] if name not in ("vertices", "manifests", "parents")}
    grids = {}
    for k in current["levels"]:
        cell = [s * c / b for s, c, b in zip(sizes, ds.grid(k)[0], schema.chunk, strict=True)]
        grids[k] = {"chunk": cell, "bins": None}
        rows = layout.rechunk(ds.table("vertices", current["id"], level=k).drop("bin"), cell, schema.axes)
        if "manifests" in current["tables"]:
            rows = objects.fragment_rank(rows.drop("frag"), names)
            tables["manifests", k] = objects.object_manifest(rows, names)
        tables["vertices", k] = out.clustered(rows)
        if any(p.endswith(f"/level={k}") for p in current["tables"].get("parents", ())):
            tables["parents", k] = ds.table("parents", current["id"], level=k)
    out.commit(tables, f"rechunked from {ds.root}", levels=current["levels"], grids=grids)
    if ds.user(_SETTINGS):
        out.set_user(_SETTINGS, ds.user(_SETTINGS))
    return out


def add_attribute(ds: Dataset, table: str, values: DataFrame, key: str, *, fill: Mapping[str, Any] | None = None, place: bool = False) -> int:
    """Join new columns to a table by key; rows without a value get null, or ``fill``.

    With ``place`` columns may exist, and rows that ``values`` names get its value there.
    """
    current = ds.snapshot()["id"]
    have = ds.table(table, current)
    clash = [c for c in values.columns if c != key and c in have.columns]
    if clash and not place:
        raise StoreError(f"{table} has {', '.join(clash)}")
    if clash:
        from lattica.operators.edits import update_rows

        have = update_rows(have, values.select(key, *clash), key)
    out = have.join(values.drop(*clash), key, "left")
    return ds.commit({table: out.fillna(dict(fill)) if fill else out}, f"attributes of {table}", expected=current)


def remove_attribute(ds: Dataset, table: str, name: str) -> int:
    current = ds.snapshot()["id"]
    have = ds.table(table, current)
    if name not in have.columns:
        raise StoreError(f"{table} has no {name}")
    return ds.commit({table: have.drop(name)}, f"{name} removed", expected=current)
