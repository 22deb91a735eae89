"""Edits as snapshots: changes gather in a session and become one commit.

Every change is a DataFrame operation: a join with the few changed rows, an anti-join with
removed ones, a union with new ones.  Only levels that a change touches are written again,
each with its own grid; cells and bins are computed for the rows that moved alone.  Nothing
is visible before flush().

Where a dataset stores manifests, those of the objects an edit touches are replaced; links
and cross-level parents of removed vertices go with them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import grid
from lattica.sources.store import Dataset, StoreError, materialize


class EditError(StoreError):
    """An edit that names what is not there, or that cannot be merged."""


@dataclass
class Report:
    """What an edit did."""

    snapshot: int | None = None
    moved: int = 0
    added: int = 0
    removed: int = 0
    remap: dict[int, int] = field(default_factory=dict)
    touched: set[tuple] = field(default_factory=set)

    def merge(self, later: Report) -> Report:
        """Both reports as one; renamings are composed."""
        names = {a: later.remap.get(b, b) for a, b in self.remap.items()}
        names |= {a: b for a, b in later.remap.items() if a not in names and a not in self.remap.values()}
        return Report(later.snapshot or self.snapshot, self.moved + later.moved, self.added + later.added, self.removed + later.removed, names, self.touched | later.touched)


def update_rows(table: DataFrame, changes: DataFrame, key: str | Sequence[str], given: str | None = None) -> DataFrame:
    """Table with the non-key columns of ``changes`` in the rows that they name.

    ``given`` is a column of ``changes`` with the names it sets, whose values hold even if
    null; without it nulls leave a value as it is.
    """
    keys = [key] if isinstance(key, str) else list(key)
    names = [c for c in changes.columns if c not in keys and c != given]
    new = changes.select(*keys, *(F.col(c).alias(f"__new_{c}") for c in names), *([F.col(given).alias("__given")] if given else []))
    joined = table.join(new, keys, "left")

    def value(c: str):
        if c not in names:
            return F.col(c)
        kept = F.when(F.array_contains("__given", c), F.col(f"__new_{c}")).otherwise(F.col(c)) if given else F.coalesce(f"__new_{c}", c)
        return kept.cast(table.schema[c].dataType).alias(c)

    return joined.select(*(value(c) for c in table.columns))


def replace_manifests(manifests: DataFrame, patch: DataFrame, named: DataFrame, oid: str = "oid") -> DataFrame:
    """Manifests in which the objects in ``named`` have the rows of ``patch``, and no others."""
    return manifests.join(named.select(oid).distinct(), oid, "left_anti").unionByName(patch, allowMissingColumns=True)


class EditSession:
    """Edits of one dataset; use as a context manager: an exception discards them all.

    With ``copy_on_write`` an object that an edit touches stays as it was, and the edited
    one gets a new id, to which ``report.remap`` leads.
    """

    def __init__(self, dataset: Dataset, message: str = "", copy_on_write: bool = False):
        self.dataset, self.message, self.copy_on_write = dataset, message, copy_on_write
        self.base = dataset.snapshot()["id"]
        self.report = Report()
        self._moves: dict[int, dict[str, Any]] = {}
        self._added: list[dict[str, Any]] = []
        self._removed: set[int] = set()
        self._gone_objects: set[int] = set()
        self._gone_fragments: list[tuple] = []
        self._fragment_values: list[tuple[tuple, dict[str, Any]]] = []
        self._splits: list[tuple[tuple, list[int]]] = []
        self._links_added: list[dict[str, Any]] = []
        self._links_removed: set[tuple[int, int]] = set()
        self._links_changed: dict[tuple[int, int], dict[str, Any]] = {}
        self._relabel: set[int] = set()
        self._object_values: dict[int, dict[str, Any]] = {}

    def __enter__(self) -> EditSession:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.flush()

    # Vertices

    def edit_vertex(self, vid: int, *, position: Iterable[float] | None = None, attributes: Mapping[str, Any] | None = None) -> None:
        """Move a vertex, change its attributes (None sets null), or both; its cell follows."""
        change = self._moves.setdefault(int(vid), {})
        if position is not None:
            change.update(zip(self.dataset.schema.axes, map(float, position), strict=True))
        change.update(attributes or {})

    def add_vertex(self, vid: int, oid: int, seq: int, position: Iterable[float], level: int = 0, **attributes: Any) -> None:
        """Add a vertex at a place of an object; later places move up."""
        self._added.append({"vid": int(vid), "oid": int(oid), "seq": int(seq), "level": level, **dict(zip(self.dataset.schema.axes, map(float, position), strict=True)), **attributes})

    def remove_vertex(self, vid: int) -> None:
        """Take a vertex and its links away."""
        self._removed.add(int(vid))

    # Objects

    def add_object(self, oid: int, vertices: Sequence[Mapping[str, Any]], level: int = 0, **values: Any) -> None:
        """A new object: rows with vid, the axes and attributes, in order; ``values`` are its attributes."""
        for seq, row in enumerate(vertices):
            rest = {k: v for k, v in row.items() if k not in ("vid", *self.dataset.schema.axes)}
            self.add_vertex(row["vid"], oid, seq, [row[a] for a in self.dataset.schema.axes], level, **rest)
        if values:
            self.set_object(oid, **values)

    def edit_object(self, oid: int, vertices: Sequence[Mapping[str, Any]], level: int = 0, **values: Any) -> None:
        """Other geometry for an object."""
        self.remove_object(oid)
        self.add_object(oid, vertices, level, **values)

    def remove_object(self, oid: int) -> None:
        """Take an object's geometry and its links away; earlier snapshots still have it."""
        self._gone_objects.add(int(oid))

    def set_object(self, oid: int, **values: Any) -> None:
        self._object_values.setdefault(int(oid), {}).update(values)

    # Fragments: (level, cell, frag)

    def add_fragment(self, oid: int, vertices: Sequence[Mapping[str, Any]], level: int = 0, first_seq: int = 1 << 30) -> None:
        """Rows of one cell as a fragment of their own, at the end of an object."""
        axes, sizes = self.dataset.schema.axes, self.dataset.grid(level)[0]
        if len({grid.Grid(sizes, (sizes, sizes)).key([row[a] for a in axes]) for row in vertices}) != 1:
            raise EditError("a fragment lies in one cell")
        mark = len(self._splits) + len(self._added)
        for k, row in enumerate(vertices):
            rest = {c: v for c, v in row.items() if c not in ("vid", *axes)}
            self.add_vertex(row["vid"], oid, first_seq + k, [row[a] for a in axes], level, __apart=mark, **rest)

    def edit_fragment(self, cell: Sequence[int], frag: int, attributes: Mapping[str, Any], level: int = 0) -> None:
        """Attributes of all vertices of a fragment."""
        self._fragment_values.append(((level, *map(int, cell), int(frag)), dict(attributes)))

    def split_fragment(self, cell: Sequence[int], frag: int, vids: Iterable[int], level: int = 0) -> None:
        """Make some vertices of a fragment a fragment of their own."""
        self._splits.append(((level, *map(int, cell), int(frag)), [int(v) for v in vids]))

    def remove_fragment(self, cell: Sequence[int], frag: int, level: int = 0) -> None:
        """Take all vertices of a fragment away."""
        self._gone_fragments.append((level, *map(int, cell), int(frag)))

    # Links

    def add_link(self, src: int, dst: int, update_objects: bool = False, **attributes: Any) -> None:
        """``update_objects``: objects that the link joins become the one with the least id."""
        self._links_added.append({"src": int(src), "dst": int(dst), **attributes})
        self._relabel |= {int(src), int(dst)} if update_objects else set()

    def edit_link(self, src: int, dst: int, **attributes: Any) -> None:
        self._links_changed.setdefault((int(src), int(dst)), {}).update(attributes)

    def remove_link(self, src: int, dst: int, update_objects: bool = False) -> None:
        """``update_objects``: an object that falls apart keeps its id for the part with its least vertex."""
        self._links_removed.add((int(src), int(dst)))
        self._relabel |= {int(src), int(dst)} if update_objects else set()

    def _endpoints(self, endpoints: Sequence[tuple[Sequence[int], int]], level: int) -> tuple[int, int]:
        """Vertices named by (cell, vid), which must lie there, in different cells."""
        names = ["c" + a for a in self.dataset.schema.axes]
        vids = [int(v) for _, v in endpoints]
        rows = self.dataset.table("vertices", self.base, level=level).where(F.col("vid").isin(vids)).select("vid", *names).collect()
        at = {r["vid"]: tuple(r[n] for n in names) for r in rows}
        if any(at.get(v) != tuple(c) for c, v in zip([c for c, _ in endpoints], vids, strict=True)) or at[vids[0]] == at[vids[1]]:
            raise EditError("a cross link joins vertices of two cells, each named by its own")
        return vids[0], vids[1]

    def add_cross_link(self, endpoints: Sequence[tuple[Sequence[int], int]], level: int = 0, **attributes: Any) -> None:
        """add_link() for ends given as (cell, vid) in two cells; edit_cross_link() and remove_cross_link() likewise."""
        self.add_link(*self._endpoints(endpoints, level), **attributes)

    def edit_cross_link(self, endpoints: Sequence[tuple[Sequence[int], int]], level: int = 0, **attributes: Any) -> None:
        self.edit_link(*self._endpoints(endpoints, level), **attributes)

    def remove_cross_link(self, endpoints: Sequence[tuple[Sequence[int], int]], level: int = 0) -> None:
        self.remove_link(*self._endpoints(endpoints, level))

    # What the tables become

    def _frame(self, rows: Sequence[Mapping[str, Any]], like: DataFrame, extra: Mapping[str, T.DataType] | None = None) -> DataFrame:
        fields = [T.StructField(f.name, f.dataType) for f in like.schema.fields if any(f.name in r for r in rows)]
        fields += [T.StructField(n, t) for n, t in (extra or {}).items()]
        unknown = {k for r in rows for k in r} - {f.name for f in fields} - {"__apart", "level"}
        if unknown:
            raise EditError(f"no such column: {', '.join(sorted(unknown))}")
        return self.dataset.spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], T.StructType(fields))

    def _ids(self, ids: Iterable[int], name: str) -> DataFrame:
        return self.dataset.spark.createDataFrame([(int(i),) for i in ids], f"{name} long")

    def _without_removed(self, level: int, rows: DataFrame) -> DataFrame | None:
        """The rows of a level that stay; None if the session removes nothing there."""
        out = rows
        if self._removed:
            out = out.join(self._ids(self._removed, "vid"), "vid", "left_anti")
        if self._gone_objects and "oid" in rows.columns:
            out = out.join(self._ids(self._gone_objects, "oid"), "oid", "left_anti")
        own = [f for f in self._gone_fragments if f[0] == level]
        if own:
            names = ["c" + a for a in self.dataset.schema.axes]
            keys = self.dataset.spark.createDataFrame([f[1:] for f in own], ", ".join(f"{n} long" for n in (*names, "frag")))
            out = out.join(keys, [*names, "frag"], "left_anti")
        return None if out is rows else out.select(*rows.columns)

    def _gone(self, level: int) -> DataFrame | None:
        """Vertices of a level that no row has any more; a coarse vertex of several objects stays with the others."""
        rows = self.dataset.table("vertices", self.base, level=level)
        kept = None if self.copy_on_write else self._without_removed(level, rows)
        return None if kept is None else rows.select("vid").distinct().join(kept.select("vid"), "vid", "left_anti")

    def _numbered_fragments(self, rows: DataFrame, names: Sequence[str], apart: DataFrame) -> DataFrame:
        """``rows`` in which the vertices of ``apart`` (vid, mark) open fragments beyond those of their cell, one for each mark."""
        hit = rows.join(apart, "vid", "left")
        top = hit.where("mark is null").groupBy(*names).agg(F.max("frag").alias("__top"))
        w = W.partitionBy(*names).orderBy("mark")
        new = hit.where("mark is not null").withColumn("__n", F.dense_rank().over(w) - 1).join(top, list(names), "left")
        new = new.withColumn("frag", (F.coalesce("__top", F.lit(-1)) + 1 + F.col("__n")).cast(rows.schema["frag"].dataType))
        return hit.where("mark is null").select(*rows.columns).unionByName(new.select(*rows.columns))

    def level_vertices(self, level: int) -> tuple[DataFrame, DataFrame] | None:
        """A level's vertices as they will be, and the ids of the objects that change; None if nothing does."""
        ds, axes = self.dataset, self.dataset.schema.axes
        names = ["c" + a for a in axes]
        chunk, bins = ds.grid(level, self.base)
        before = out = ds.table("vertices", self.base, level=level)
        objects: list[DataFrame] = []
        apart: list[DataFrame] = []
        kept = self._without_removed(level, before)
        if kept is not None:
            keys = [c for c in ("vid", "oid") if c in before.columns]
            gone = before.select(*keys).exceptAll(kept.select(*keys))
            if not gone.isEmpty():
                out = kept
                objects.append(gone)
        moves = self._frame([{"vid": v, **c, "__set": list(c)} for v, c in self._moves.items()], before, {"__set": T.ArrayType(T.StringType())}) if self._moves else None
        if moves is not None:
            hit = out.join(moves.select("vid"), "vid", "left_semi")
            if not hit.isEmpty():
                out = update_rows(out, moves, "vid", given="__set")
                objects.append(hit.select(*(c for c in ("vid", "oid") if c in hit.columns)))
                position = [c for c in axes if c in moves.columns]
                if position:
                    out = out.join(moves.select("vid", F.lit(True).alias("__moved")), "vid", "left")
                    new = dict(zip(names, grid.cells(chunk, axes), strict=True))
                    crossed = reduce(lambda a, b: a | b, (F.col(n) != c for n, c in new.items()))
                    if bins and "bin" in out.columns:
                        new["bin"] = grid.local_bin(axes, chunk, bins)
                    out = out.withColumn("__crossed", F.coalesce(F.col("__moved") & crossed, F.lit(False)))
                    out = out.withColumns({n: F.when(F.col("__moved"), c.cast(before.schema[n].dataType)).otherwise(F.col(n)) for n, c in new.items()})
                    out = materialize(out.drop("__moved"), "moved")
                    apart.append(out.where("__crossed").select("vid", F.concat(F.lit("m"), F.col("vid").cast("string")).alias("mark")))
                    out = out.drop("__crossed")
        values = [(f, v) for f, v in self._fragment_values if f[0] == level]
        if values:
            keyed = self._frame([{**dict(zip((*names, "frag"), f[1:], strict=True)), **v, "__set": list(v)} for f, v in values], before, {"__set": T.ArrayType(T.StringType())})
            out = update_rows(out, keyed, [*names, "frag"], given="__set")
        for k, (f, vids) in enumerate(x for x in self._splits if x[0][0] == level):
            inside = reduce(lambda a, b: a & b, (F.col(n) == v for n, v in zip((*names, "frag"), f[1:], strict=True)))
            part = out.where(inside).join(self._ids(vids, "vid"), "vid", "left_semi")
            apart.append(part.select("vid", F.lit(f"s{k}").alias("mark")))
            objects.append(part.select("vid", "oid"))
        added = [r for r in self._added if r["level"] == level]
        if added:
            new = ds.placed(self._frame(added, before), level)
            marks = [(r["vid"], f"a{r['__apart']}" if "__apart" in r else f"o{r['oid']}") for r in added]
            apart.append(ds.spark.createDataFrame(marks, "vid long, mark string"))
            objects.append(new.select("vid", "oid"))
            # an added vertex takes its place before the one that had it
            both = out.withColumn("__new", F.lit(1)).unionByName(new.withColumn("__new", F.lit(0)), allowMissingColumns=True)
            oids = self._ids({r["oid"] for r in added}, "oid")
            w = W.partitionBy("oid").orderBy("seq", "__new", "vid")
            hit = both.join(oids, "oid", "left_semi").withColumn("seq", (F.row_number().over(w) - 1).cast(before.schema["seq"].dataType))
            out = both.join(oids, "oid", "left_anti").unionByName(hit).drop("__new")
        if not objects and not values:
            return None
        if apart and "frag" in out.columns:
            out = self._numbered_fragments(out, names, reduce(DataFrame.unionByName, apart).groupBy("vid").agg(F.max("mark").alias("mark")))
        out = out.withColumn("level", F.lit(level)).select(*before.columns)
        touched = reduce(DataFrame.unionByName, [o.select("oid") for o in objects if "oid" in o.columns] or [before.select("oid").limit(0)]).where("oid is not null").distinct()
        if self.copy_on_write and "oid" in out.columns:
            return self._copied(before, out, touched)
        return out, touched

    def _copied(self, before: DataFrame, after: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The level as it was, and the touched objects as edited under new ids and with new vertex ids."""
        from lattica.operators.points import number_rows

        tops = before.agg(F.max("oid").alias("o"), F.max("vid").alias("v")).first()
        old = sorted(r["oid"] for r in touched.collect())  # as many as edits name, at most
        for o in old:
            self.report.remap.setdefault(o, tops["o"] + 1 + len(self.report.remap))
        names = self.dataset.spark.createDataFrame([(o, self.report.remap[o]) for o in old], "oid long, __to long")
        new = after.join(names, "oid").withColumn("oid", F.col("__to")).drop("__to")
        new = number_rows(new, ["oid", "seq", "vid"], "__n", start=tops["v"] + 1).withColumn("vid", F.col("__n")).drop("__n")
        return before.unionByName(new.select(*before.columns)), names.select(F.col("__to").alias("oid"))

    def links(self) -> DataFrame:
        """The links as they will be."""
        out = self.dataset.table("links", self.base)
        if self._links_removed:
            out = out.join(self._frame([{"src": s, "dst": d} for s, d in self._links_removed], out), ["src", "dst"], "left_anti")
        for gone in filter(None, map(self._gone, self.dataset.snapshot(self.base)["levels"])):
            out = out.join(gone.select(F.col("vid").alias("src")), "src", "left_anti").join(gone.select(F.col("vid").alias("dst")), "dst", "left_anti")
        if self._links_changed:
            rows = [{"src": s, "dst": d, **v, "__set": list(v)} for (s, d), v in self._links_changed.items()]
            out = update_rows(out, self._frame(rows, out, {"__set": T.ArrayType(T.StringType())}), ["src", "dst"], given="__set")
        if self._links_added:
            out = out.unionByName(self._frame(self._links_added, out), allowMissingColumns=True)
        return out.select(*self.dataset.table("links", self.base).columns)

    def _relabelled(self, vertices: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Level 0 with the objects of relabelled links joined or cut, and the ids that changed."""
        named = vertices.join(self._ids(self._relabel, "vid"), "vid", "left_semi").select("oid").distinct()
        own = materialize(vertices.join(named, "oid", "left_semi").select("vid", "oid"), "own")
        inside = links.join(own.select(F.col("vid").alias("src")), "src", "left_semi").join(own.select(F.col("vid").alias("dst")), "dst", "left_semi")
        label = relabel_by_links(own.select("vid"), inside.select("src", "dst")).withColumnRenamed("oid", "__part")
        parts = own.join(label, "vid").groupBy("__part").agg(F.min("oid").alias("least"), F.collect_set("oid").alias("__were"))
        parts = parts.collect()  # components of the objects that the session's links name
        top = vertices.agg(F.max("oid").alias("top")).first()["top"]
        to, used = [], set()
        for r in sorted(parts, key=lambda r: r["__part"]):
            if r["least"] in used:
                top += 1
                to.append((r["__part"], top))
            else:
                to.append((r["__part"], r["least"]))
            used.add(r["least"])
            self.report.remap |= {o: r["least"] for o in r["__were"] if o != r["least"]}
        new = label.join(self.dataset.spark.createDataFrame(to, "__part long, __oid long"), "__part").select("vid", "__oid")
        out = vertices.join(new, "vid", "left").withColumn("oid", F.coalesce("__oid", "oid")).select(*vertices.columns)
        return out, own.select("oid").unionByName(new.select(F.col("__oid").alias("oid"))).distinct()

    def flush(self) -> Report:
        """Commit what was staged as one snapshot; StoreError if another commit came first."""
        from lattica.operators import objects as O

        ds = self.dataset
        tables: dict[str | tuple[str, int], DataFrame] = {}
        names = ["c" + a for a in ds.schema.axes]
        if ds.has("links") and (self._links_added or self._links_removed or self._links_changed or self._removed or self._gone_objects or self._gone_fragments):
            tables["links"] = self.links()
        elif self._links_added or self._links_changed or self._links_removed:
            raise EditError("the dataset stores no links")
        for level in ds.snapshot(self.base)["levels"]:
            changed = self.level_vertices(level)
            if level == 0 and self._relabel:
                now, ids = self._relabelled(changed[0] if changed else ds.table("vertices", self.base, level=0), tables["links"])
                changed = now, ids.unionByName(changed[1]).distinct() if changed else ids
            if changed is None:
                continue
            rows, ids = materialize(changed[0], "edited"), materialize(changed[1], "touched")
            self.report.touched |= {(level, r["oid"]) for r in ids.collect()}  # as many as edits name
            tables["vertices", level] = ds.clustered(rows)
            if any(p.endswith(f"/level={level}") for p in ds.snapshot(self.base)["tables"].get("manifests", ())):
                stored = ds.table("manifests", self.base, level=level)
                patch = O.object_manifest(rows.join(ids, "oid", "left_semi"), names).withColumn("level", F.lit(level))
                tables["manifests", level] = replace_manifests(stored, patch, ids)
        for level in {int(p.rpartition("=")[2]) for p in ds.snapshot(self.base)["tables"].get("parents", ())}:
            gone = self._gone(level)
            links = ds.table("parents", self.base, level=level)
            if gone is not None and not links.join(gone, "vid", "left_semi").isEmpty():
                tables["parents", level] = links.join(gone, "vid", "left_anti")
        if self._object_values:
            objects = ds.table("objects", self.base)
            rows = [{"oid": self.report.remap.get(o, o) if self.copy_on_write else o, **v, "__set": list(v)} for o, v in self._object_values.items()]
            frame = self._frame(rows, objects, {"__set": T.ArrayType(T.StringType())})
            fresh = frame.join(objects.select("oid"), "oid", "left_anti").drop("__set")
            tables["objects"] = update_rows(objects, frame, "oid", given="__set").unionByName(fresh, allowMissingColumns=True)
        if tables:
            self.report.snapshot = ds.commit(tables, self.message, expected=self.base)
        self.report.moved, self.report.added, self.report.removed = len(self._moves), len(self._added), len(self._removed)
        return self.report


def split_fragment(vertices: DataFrame, oid: int | None, parts: DataFrame) -> DataFrame:
    """Renumber an object's fragments by a table of ``vid, frag``."""
    own = parts if oid is None else parts.join(vertices.where(F.col("oid") == oid).select("vid"), "vid", "left_semi")
    return update_rows(vertices, own, "vid")


def relabel_by_links(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``vid, oid`` after links changed: the least vertex reachable.

    Each round links all larger neighbours of a vertex to its least one, then all smaller
    ones.  Minima are aggregated before the shuffle; the joins exchange both sides by a key
    of their own, so that adaptive execution can split a hub.  Rounds grow as the square of
    the logarithm of the vertices at most; each drops the table of the one before.
    """
    from lattica.sources.store import drop_tables

    key = lambda c: F.col(c).bitwiseXOR(F.lit(1).cast("long")).alias("key")
    known = vertices.select(F.col("vid").alias("v"))
    ends = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    ends = ends.join(known, "v", "left_semi").join(known.select(F.col("v").alias("u")), "u", "left_semi")
    stars, before = materialize(ends.select("u", "v"), "labels"), None
    while True:
        figure = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if figure == before or not figure[0]:
            break
        before = figure
        both = stars.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(stars.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select(key("x"), F.least("m", "x").alias("m"))
        large = both.where("y > x").select(key("x"), "y").join(least, "key").select(F.col("y").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.select(key("u"), "v").join(lowest.select(key("u"), "m"), "key").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionAll(lowest.select("u", F.col("m").alias("v"))).distinct(), "labels")
        drop_tables(stars.sparkSession, stars)
        stars = after
    return vertices.select("vid").join(stars.select(F.col("u").alias("vid"), F.col("v").alias("oid")), "vid", "left").select("vid", F.coalesce("oid", "vid").alias("oid"))


def compact_ids(objects: DataFrame, manifest: DataFrame, oid: str = "oid") -> DataFrame:
    """``oid, new_oid``: present objects numbered densely in id order."""
    from lattica.operators.points import number_rows

    live = objects.join(manifest.select(oid).distinct(), oid, "left_semi").select(oid)
    return number_rows(live, [oid], "new_oid")


def unreferenced(fragments: DataFrame, manifest: DataFrame, key: tuple[str, ...] = ("cx", "cy", "cz", "frag")) -> DataFrame:
    """Fragments that no manifest names."""
    return fragments.join(manifest.select(*key).distinct(), list(key), "left_anti")


def vacuum(ds: Dataset, *, dry_run: bool = False, message: str = "vacuum") -> dict[str, Any]:
    """Number the objects that hold vertices densely, in id order, in every table, as one commit.

    Returns ``remap`` (a DataFrame of oid and new_oid), how many objects are live, and the
    fragments that no manifest names, which are reported and kept.  ``dry_run`` writes nothing.
    """
    from lattica.operators.points import number_rows

    snapshot = ds.snapshot()
    names = ["c" + a for a in ds.schema.axes]
    live = ds.table("vertices", snapshot["id"]).where("oid is not null").select("oid").distinct()
    remap = materialize(number_rows(live, ["oid"], "new_oid"), "remap")
    loose = None
    if "manifests" in snapshot["tables"]:
        fragments = ds.table("vertices", snapshot["id"]).select("level", *names, "frag").distinct()
        loose = unreferenced(fragments, ds.table("manifests", snapshot["id"]), ("level", *names, "frag"))
    if not dry_run:
        renamed = lambda df, how="inner": df.join(remap, "oid", how).withColumn("oid", F.col("new_oid")).select(*df.columns)
        tables: dict[str | tuple[str, int], DataFrame] = {}
        for level in snapshot["levels"]:
            tables["vertices", level] = ds.clustered(renamed(ds.table("vertices", snapshot["id"], level=level), "left"))
            if loose is not None:
                tables["manifests", level] = renamed(ds.table("manifests", snapshot["id"], level=level))
        if "objects" in snapshot["tables"]:
            tables["objects"] = renamed(ds.table("objects", snapshot["id"]))
        if "groups" in snapshot["tables"]:
            groups = ds.table("groups", snapshot["id"])
            members = groups.select("gid", F.explode("members").alias("oid")).join(remap, "oid").groupBy("gid").agg(F.array_sort(F.collect_set("new_oid")).alias("__members"))
            joined = groups.join(members, "gid", "left").withColumn("members", F.coalesce("__members", F.array().cast("array<bigint>")))
            tables["groups"] = joined.select(*groups.columns)
        ds.commit(tables, message, expected=snapshot["id"])
    return {"remap": remap, "live": remap.count(), "unreferenced": loose}


def residues_disjoint(*writers: tuple[int, int]) -> bool:
    """Whether writers (residue, modulus) can never allocate the same id."""
    from math import gcd

    return all((a - c) % gcd(b, d) for i, (a, b) in enumerate(writers) for c, d in writers[i + 1 :])
