"""Writers and readers of geometry kinds on stored datasets.

A writer checks what its kind asks for before anything is committed, and commits all tables
of a level at once.  Readers scope the vertices first, then the links among them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import grid
from lattica.operators import links as L
from lattica.operators import objects as O
from lattica.operators import paths, points, readers
from lattica.sources.store import PARAMETRIC, Dataset, StoreError, by_key, materialize, parametric
from lattica.streaming.ingest import Appender, LinkAppender


class GeometryError(StoreError):
    """Geometry that its kind does not allow."""


def _refuse(bad: DataFrame, text: str, column: str) -> None:
    """Raise if there is a row, and name the first."""
    row = bad.select(column).first()
    if row is not None:
        raise GeometryError(f"{text}: {row[0]}")


def _names(ds: Dataset) -> list[str]:
    return ["c" + a for a in ds.schema.axes]


def _commit_level(ds: Dataset, placed: DataFrame, level: int, tables: Mapping[str, DataFrame], manifest: DataFrame | None) -> int:
    if level in ds.snapshot()["levels"]:
        raise StoreError(f"level {level} is written")
    out: dict[str | tuple[str, int], DataFrame] = {("vertices", level): ds.clustered(placed)}
    if manifest is not None:
        out["manifests", level] = manifest
    return ds.commit(out | {(k, level): v for k, v in tables.items()}, f"{ds.schema.kind} level {level}", levels=[level])


def _fragments(ds: Dataset, vertices: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Vertices with one fragment for each object and cell, and the manifest."""
    placed = materialize(O.fragment_rank(ds.placed(vertices, level), _names(ds)), "placed")
    return placed, O.object_manifest(placed, _names(ds))


def write_mesh(ds: Dataset, vertices: DataFrame, faces: DataFrame, *, level: int = 0) -> int:
    """Vertices (vid, oid, axes) and faces (``face``, ``ends``: three ids or more, and attributes).

    Faces are stored with their canonical ends and the cell that owns them.  All ends must be
    vertices, and an object lie in one bin of the attribute that chunks are cut by.
    """
    by = ds.schema.chunk_by
    _refuse(faces.where("coalesce(size(ends), 0) < 3"), "a face has three ends at least", "face")
    ends = faces.select("face", F.explode("ends").alias("vid"))
    _refuse(ends.join(vertices.select("vid"), "vid", "left_anti"), "a face names no vertex", "face")
    if by:
        mixed = vertices.groupBy("oid").agg(F.min(by).alias("lo"), F.max(by).alias("hi")).where("lo <> hi")
        _refuse(mixed, "an object lies in several bins", "oid")
    placed, manifest = _fragments(ds, vertices, level)
    owned = faces.join(L.owner_cell(faces, placed, _names(ds)), "face").withColumn("sorted", L.canonical())
    return _commit_level(ds, placed, level, {"faces": owned.sortWithinPartitions(*_names(ds))}, manifest)


def read_mesh(ds: Dataset, level: int = 0, **terms) -> tuple[DataFrame, DataFrame]:
    """Selected vertices with their ``row``, and faces all of whose ends are among them, with ``rows`` in the order of their ends."""
    kept = points.number_rows(ds.level(level).select(**terms).dataframe(), ["vid"], "row")
    faces = L.faces_within(kept, ds.table("faces", level=level))
    ends = faces.select("face", F.posexplode("ends").alias("pos", "vid")).join(kept.select("vid", "row"), "vid")
    rows = by_key(ends, "face").groupBy("face").agg(F.array_sort(F.collect_list(F.struct("pos", "row"))).alias("r"))
    return kept, faces.join(rows.select("face", F.expr("transform(r, x -> x.row)").alias("rows")), "face")


def write_graph(ds: Dataset, vertices: DataFrame, edges: DataFrame, *, level: int = 0) -> int:
    """Nodes and explicit edges ``src, dst`` with their attributes; both ends must be nodes."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("vid"))
    _refuse(ends.join(vertices.select("vid"), "vid", "left_anti"), "an edge names no node", "vid")
    placed, manifest = _fragments(ds, vertices, level) if "oid" in vertices.columns else (ds.placed(vertices, level), None)
    return _commit_level(ds, placed, level, {"links": edges}, manifest)


def read_graph(ds: Dataset, level: int = 0, **terms) -> tuple[DataFrame, DataFrame]:
    """Selected nodes with their ``row``, and the edges among them, ends as rows."""
    kept = points.number_rows(ds.level(level).select(**terms).dataframe(), ["vid"], "row")
    return kept, L.restrict(ds.table("links", level=level).drop("level"), kept)


def write_skeleton(ds: Dataset, vertices: DataFrame, parents: DataFrame, *, level: int = 0) -> int:
    """Trees ``child, parent``: vertices are stored in depth-first order, and only parents that are not the vertex before as links.

    An object with several roots is refused, and so is a parent that is no vertex or of another object.
    """
    own = vertices.select(F.col("vid").alias("child"), "oid")
    named = parents.where("parent is not null")
    up = vertices.select(F.col("vid").alias("parent"), F.col("oid").alias("__o"))
    _refuse(named.join(own, "child").join(up, "parent", "left").where("not coalesce(__o = oid, false)"), "a parent is no vertex of the object", "child")
    _refuse(L.forests(vertices, named), "several roots in object", "oid")
    tree = own.join(named, "child", "left")
    ordered = materialize(readers.reorder_depth_first(vertices, tree), "ordered")
    explicit = readers.explicit_after_reorder(tree.select("child", "parent"), ordered)
    placed = ordered.drop("seq").withColumnRenamed("row", "seq")
    placed, manifest = _fragments(ds, placed, level)
    return _commit_level(ds, placed, level, {"links": explicit.select(F.col("child").alias("src"), F.col("parent").alias("dst"))}, manifest)


def read_skeleton(ds: Dataset, level: int = 0, **terms) -> tuple[DataFrame, DataFrame]:
    """Selected vertices and ``child, parent`` among them; the implicit rule is applied to whole objects first."""
    rows = ds.table("vertices", level=level)
    records = ds.table("links", level=level).select(F.col("src").alias("child"), F.col("dst").alias("parent"))
    parents = L.skeleton_parents(rows, records, ("oid",), row="seq")
    kept = ds.level(level).select(**terms).dataframe()
    scope = kept.select("vid")
    return kept, parents.join(scope.select(F.col("vid").alias("child")), "child", "left_semi").join(scope.select(F.col("vid").alias("parent")), "parent", "left_semi")


def write_polylines(ds: Dataset, vertices: DataFrame, *, level: int = 0) -> int:
    """Vertices (vid, oid, seq, axes): cut where they leave a cell, with the cuts' bridges as links and the segments as manifest."""
    names = _names(ds)
    cut = materialize(paths.split_at_cells(ds.placed(vertices, level), names), "split")
    manifest = paths.manifest(cut, names)
    bridges = paths.bridges(cut, names)
    return _commit_level(ds, cut, level, {"links": bridges}, manifest.withColumn("frag", F.col("seq")))


def read_polylines(ds: Dataset, level: int = 0, box: tuple | None = None, crop: bool = False) -> DataFrame:
    """Whole objects with a vertex in a cell the box touches; with ``crop`` only the runs inside those cells, as ``part``."""
    rows = ds.table("vertices", level=level)
    if box is None:
        return rows
    touched = grid.box_cells(*box, ds.grid(level)[0], ds.schema.axes)
    return paths.crop(rows, touched) if crop else paths.whole_in_cells(rows, touched)


def write_lines(ds: Dataset, lines: DataFrame, *, level: int = 0) -> int:
    """Segments ``oid, ax.., bx..`` as two vertices each (vid: 2 oid + seq); those that cross cells get a link."""
    attributes = [c for c in lines.columns if c not in ("oid", *(e + a for e in "ab" for a in ds.schema.axes))]
    two = paths.line_vertices(lines, ds.schema.axes).withColumn("vid", F.col("oid") * 2 + F.col("seq"))
    if attributes:
        two = two.join(lines.select("oid", *attributes), "oid")
    placed, manifest = _fragments(ds, two, level)
    return _commit_level(ds, placed, level, {"links": paths.bridges(placed, _names(ds))}, manifest)


def read_lines(ds: Dataset, level: int = 0, box: tuple | None = None) -> DataFrame:
    """Lines with either end in the box."""
    found = paths.endpoints(ds.table("vertices", level=level), ds.schema.axes)
    return found if box is None else paths.lines_in_box(found, *box, ds.schema.axes)


class SkeletonStream:
    """A skeleton store filled chunk by chunk: batches of vertices, then links across chunks, then one commit."""

    def __init__(self, ds: Dataset, work: str):
        self.ds, self.work = ds, work.rstrip("/")
        self.vertices = Appender(ds.spark, f"{self.work}/vertices", ds.grid(0)[0], ds.schema.axes)
        self._links: LinkAppender | None = None

    def write_chunk(self, vertices: DataFrame, number: int) -> None:
        self.vertices.write(vertices, number)

    def write_cross_links(self, links: DataFrame, number: int) -> None:
        """Links ``src, dst`` between chunks, after the chunks they join."""
        if self._links is None:
            self._links = LinkAppender(self.ds.spark, f"{self.work}/links", self.vertices.read(), self.ds.schema.axes)
        self._links.write(links, number)

    def finalize(self) -> int:
        """Commit vertices, manifests, links and counts, and tell from the links which capabilities the store has."""
        rows = self.vertices.read().drop("batch")
        placed, manifest = _fragments(self.ds, rows, 0)
        tables: dict[str, DataFrame] = {}
        if self._links is not None:
            tables["links"] = self._links.read().select("src", "dst")
        found = _commit_level(self.ds, placed, 0, tables, manifest)
        self.ds.set_user("counts", {"vertices": placed.count(), "objects": manifest.select("oid").distinct().count(), "links": tables["links"].count() if tables else 0, "cross_links": bool(tables)})
        return found


def write_parametric(ds: Dataset, objects: DataFrame, *, types: Mapping[str, int] | None = None, groups: DataFrame | None = None) -> int:
    """Rows of id, name, type, coefficients (and attributes); types beyond the built-in ones are kept with the dataset.

    A type that is unknown, an arity that differs, or a repeated id or name is refused.
    """
    known = PARAMETRIC | dict(types or {})
    for column in ("id", "name"):
        if column in objects.columns:
            _refuse(objects.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1"), f"repeated {column}", column)
    checked = materialize(parametric(objects, known), "parametric")
    tables = {"parametric": checked} | ({"groups": groups} if groups is not None else {})
    found = ds.commit(tables, "parametric objects")
    ds.set_user("parametric", {"types": known})
    return found


def read_parametric(ds: Dataset, *, type: str | None = None, names: Sequence[str] | None = None, groups: Sequence[int] | None = None) -> DataFrame:
    rows = ds.table("parametric")
    if type is not None:
        if type not in ds.user("parametric")["types"]:
            raise GeometryError(f"no such type: {type}")
        rows = rows.where(F.col("type") == type)
    if names is not None:
        rows = rows.where(F.col("name").isin(list(names)))
    if groups is not None:
        members = O.group_members(ds.table("groups"), groups).select(F.col("oid").alias("id"))
        rows = rows.join(members, "id", "left_semi")
    return rows


class Composite:
    """Several kinds of geometry in one dataset, each in tables of its own, listed in the user block ``geometry``."""

    def __init__(self, ds: Dataset):
        self.ds = ds

    def kinds(self) -> dict[str, list[str]]:
        return self.ds.user("geometry")

    def add(self, kind: str, tables: Mapping[str, DataFrame]) -> int:
        """Tables of a kind (vertices and, say, links or faces), as one commit."""
        if kind in self.kinds():
            raise StoreError(f"there is a {kind}")
        found = self.ds.commit({f"{kind}.{name}": df for name, df in tables.items()}, f"added {kind}")
        self.ds.set_user("geometry", self.kinds() | {kind: sorted(tables)})
        return found

    def read(self, kinds: Sequence[str] | None = None, where: Callable[[DataFrame], DataFrame] | None = None) -> tuple[dict[str, dict[str, DataFrame]], dict[str, str]]:
        """Tables by kind, and what kept a kind from being read, by kind."""
        found: dict[str, dict[str, DataFrame]] = {}
        errors: dict[str, str] = {}
        index = self.kinds()
        for kind in kinds or index:
            try:
                if kind not in index:
                    raise StoreError(f"no {kind}")
                tables = {name: self.ds.table(f"{kind}.{name}") for name in index[kind]}
                found[kind] = {n: where(t) if where and n == "vertices" else t for n, t in tables.items()}
            except Exception as e:
                errors[kind] = str(e).splitlines()[0]
        return found, errors

    def vertices(self) -> DataFrame:
        """Vertices of all kinds, with ``kind``; columns that a kind lacks are null."""
        found, _ = self.read()
        out = None
        for kind, tables in found.items():
            part = tables["vertices"].withColumn("kind", F.lit(kind))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if out is None:
            raise StoreError("no geometry")
        return out


class OctreeError(StoreError):
    """A read that octree levels don't offer."""


class OctreeLevel:
    """Vertices stored by octree leaf: reads by leaf, box, object and halo.

    ``cells`` gives the full-depth cell of a vertex as columns i, j, k (see layout.in_leaf).
    """

    def __init__(self, vertices: DataFrame, leaves: DataFrame, depth: int, sizes: Sequence[float], *, links: DataFrame | None = None, origin: Sequence[int] = (0, 0, 0), axes: Sequence[str] = grid.AXES):
        self.vertices, self.leaves, self.links, self.depth, self.sizes, self.origin, self.axes = vertices, leaves, links, depth, tuple(sizes), tuple(origin), tuple(axes)

    def cells(self) -> list[Column]:
        return [(grid.cell(a, s) - int(o)).alias(n) for a, s, o, n in zip(self.axes, self.sizes, self.origin, "ijk", strict=True)]

    def placed(self, leaves: DataFrame | None = None) -> DataFrame:
        """Vertices of leaves, with the leaf's depth and key."""
        from lattica.operators.layout import in_leaf

        return in_leaf(self.vertices.select("*", *self.cells()), self.leaves if leaves is None else leaves, self.depth)

    def read_points(self, *, box: tuple | None = None, object_ids: Sequence[int] | None = None, leaves: Sequence[int] | None = None, halo: bool = False, chunks=None, attribute_names=None, attribute_filter=None) -> DataFrame:
        """Vertices of the leaves that a box meets, or that are named by key (and their neighbours, with ``halo``), masked exactly by box and objects."""
        for name, value in (("chunks", chunks), ("attribute_filter", attribute_filter), ("attribute_names", attribute_names)):
            if value is not None:
                raise OctreeError(f"octree levels are not read by {name}")
        found = self.leaves
        if box is not None:
            found = readers.leaves_in_box(found, *box, self.sizes, self.depth, self.origin)
        if leaves is not None:
            keys = {int(k) for k in leaves}
            if halo:
                near = readers.leaf_neighbours(self.leaves, self.depth).where(F.col("a").isin(list(keys))).select(F.col("b").alias("key"))
                wanted = near.unionAll(self.leaves.where(F.col("key").isin(list(keys))).select("key")).distinct()
                found = found.join(wanted, "key", "left_semi")
            else:
                found = found.where(F.col("key").isin(list(keys)))
        out = self.placed(found)
        if box is not None:
            out = out.where(grid.in_box(*box, self.axes))
        if object_ids is not None:
            out = out.join(points.id_frame(out.sparkSession, object_ids).select("oid"), "oid", "left_semi")
        return out

    def read_graph(self, **terms) -> tuple[DataFrame, DataFrame]:
        """Vertices as read_points() gives them, and the links both of whose ends are read."""
        if self.links is None:
            raise OctreeError("this level has no links")
        kept = self.read_points(**terms)
        return kept, L.induced(kept, self.links)

    def seams(self, key: int) -> DataFrame:
        """Links between a leaf and other leaves, with both keys."""
        if self.links is None:
            raise OctreeError("this level has no links")
        return readers.seams(self.links, self.placed().select("vid", "key")).where((F.col("src_key") == key) | (F.col("dst_key") == key))


def read_cells_of(tables: Mapping[str, DataFrame], keys: DataFrame, axes: Sequence[str] = grid.AXES, on_error: str = "raise") -> tuple[dict[str, tuple[DataFrame, DataFrame]], dict[str, str]]:
    """For each table its rows of requested cells (``pos`` and the cell) and the offsets of each request, and errors by table.

    Offsets are ``pos, n_rows, offset`` for every request, empty cells included; a table
    without cell columns is an error, which is raised or recorded.
    """
    names = ["c" + a for a in axes]
    found: dict[str, tuple[DataFrame, DataFrame]] = {}
    errors: dict[str, str] = {}
    for name, table in tables.items():
        if missing := [n for n in names if n not in table.columns]:
            if on_error == "raise":
                raise GeometryError(f"{name} lacks {', '.join(missing)}")
            errors[name] = f"lacks {', '.join(missing)}"
            continue
        rows = points.read_cells(table, keys, axes)
        counts = keys.join(table.groupBy(*names).agg(F.count("*").alias("n")), names, "left").select("pos", F.coalesce("n", F.lit(0)).alias("n_rows"))
        found[name] = rows, points.prefix_sums(counts, ["pos"], F.col("n_rows"), "offset")
    return found, errors


def open_level(spark: SparkSession, root: str, level: int = 0):
    """A query over a level of a stored dataset."""
    return Dataset.open(spark, root).level(level)
