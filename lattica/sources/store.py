"""Datasets: a folder of Parquet tables and logs of snapshots.

A log is a folder of numbered files, and its newest file is what readers see.  A commit
writes its tables first and then creates the next number, which can succeed only once, so
that of two writers one wins and the other is refused, and readers see all of a commit or
none.  On HDFS and local disks creation is atomic; an object store must offer a rename that
fails on an existing target.

Level tables (vertices, parents and whatever else has a ``level``) lie in one folder a level;
a commit writes the levels it changes and refers to the others.  Every level has its own
grid, kept in the snapshot.  Paths may be on any Hadoop file system.
"""

from __future__ import annotations

import json
import math
import tempfile
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import grid

KINDS = ("point_cloud", "line", "polyline", "streamline", "graph", "skeleton", "mesh", "parametric")
TABLES = ("vertices", "objects", "manifests", "groups", "links", "leaves", "parametric")


class StoreError(RuntimeError):
    """A dataset that is missing, present when it must not be, or closed to a write."""


class SchemaConflict(StoreError):
    """A declared schema that disagrees with the stored one."""


class MetadataConflict(StoreError):
    """A compare-and-set whose expected value was not the stored one."""


#: Temporary folders of local sessions, by application.
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which a cluster must set: its machines share no local disk.

    A session with a local master that has none gets a temporary one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    if context.master.split("[")[0] != "local":
        raise StoreError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="lattica-")
    return _LOCAL_FOLDERS[context.applicationId]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, *dfs: DataFrame) -> None:
    """Remove what materialize() wrote for dfs; only for tables nothing lazy still reads."""
    jvm = spark.sparkContext._jvm
    for df in dfs:
        for f in df.inputFiles()[:1]:
            p = jvm.org.apache.hadoop.fs.Path(f).getParent()
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_bytes(df: DataFrame) -> int:
    """What df reads, in bytes; sources of unknown size count nothing.

    Spark's own estimate multiplies the sizes of the two sides of a join.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return sum(n for n in sizes if n < 1 << 56)


#: Bytes of files behind one partition of by_key().
PART_BYTES = 4 << 20


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key in so many partitions that what a task sorts does not grow with what df reads, whatever the session's number."""
    parts = math.ceil(read_bytes(df) / PART_BYTES)
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


class Files:
    """Small files on the file system of a path."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """A new file with all of its text, or False if there is one of this name."""
        part = f"{name.rpartition('/')[0]}/.part-{uuid.uuid4().hex}"
        self._create(part, text)
        try:
            if self.fs.getScheme() == "file":  # a local rename would replace; a link never does
                at = lambda x: self.jvm.java.io.File(self.path(x).toUri().getPath()).toPath()
                try:
                    self.jvm.java.nio.file.Files.createLink(at(name), at(part))
                except Exception as e:
                    if "FileAlreadyExists" in str(e):
                        return False
                    raise
                return True
            return not self.exists(name) and bool(self.fs.rename(self.path(part), self.path(name)))
        finally:
            self.fs.delete(self.path(part), False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Log:
    """Numbered JSON files; the newest counts."""

    def __init__(self, files: Files, folder: str):
        self.files, self.folder = files, folder

    def head(self) -> tuple[int, dict]:
        """The newest number and what it holds; (-1, {}) for an empty log."""
        numbers = [int(n[:-5]) for n in self.files.names(self.folder) if n.endswith(".json") and n[0] != "."]
        return (max(numbers), self.at(max(numbers))) if numbers else (-1, {})

    def at(self, number: int) -> dict:
        return json.loads(self.files.read(f"{self.folder}/{number:012}.json"))

    def append(self, number: int, value: dict) -> bool:
        """Whether ``value`` became the entry of this number: only the first to try it wins."""
        return self.files.create(f"{self.folder}/{number:012}.json", json.dumps(value))


@dataclass(frozen=True)
class Schema:
    """What a dataset declares; checked before the first write, never inferred."""

    kind: str
    axes: tuple[str, ...] = grid.AXES
    chunk: tuple[float, ...] = (1.0, 1.0, 1.0)
    bins: tuple[float, ...] | None = None
    bounds: tuple[tuple[float, ...], tuple[float, ...]] | None = None
    attributes: Mapping[str, str] = field(default_factory=dict)
    chunk_by: str | None = None

    def check(self) -> None:
        if self.kind not in KINDS:
            raise SchemaConflict(f"no such kind: {self.kind}")
        if not self.axes or len(self.axes) != len(self.chunk) or min(self.chunk) <= 0:
            raise SchemaConflict("every axis needs a chunk size above zero")
        if self.bins:
            grid.bins_per_chunk(self.chunk, self.bins)
        if self.bounds and any(l > h for l, h in zip(*self.bounds, strict=True)):
            raise SchemaConflict("bounds are the wrong way round")

    def diff(self, other: Schema) -> list[str]:
        """Names of the fields on which two schemas disagree."""
        a, b = self.to_dict(), other.to_dict()
        return [k for k in a if a[k] != b[k]]

    def to_dict(self) -> dict:
        listed = lambda x: None if x is None else [list(y) if isinstance(y, (tuple, list)) else y for y in x]
        return {"kind": self.kind, "axes": list(self.axes), "chunk": [float(c) for c in self.chunk], "bins": listed(self.bins), "bounds": listed(self.bounds), "attributes": dict(self.attributes), "chunk_by": self.chunk_by}

    @classmethod
    def from_dict(cls, d: dict) -> Schema:
        pair = d.get("bounds")
        return cls(d["kind"], tuple(d["axes"]), tuple(d["chunk"]), tuple(d["bins"]) if d.get("bins") else None, (tuple(pair[0]), tuple(pair[1])) if pair else None, d.get("attributes") or {}, d.get("chunk_by"))


class Dataset:
    """One dataset folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self._meta = Log(self.files, "meta")

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: Schema) -> Dataset:
        schema.check()
        ds = cls(spark, root)
        if not ds._meta.append(0, {"schema": schema.to_dict(), "user": {}, "headers": {}}):
            raise StoreError(f"{root} holds a dataset")
        Log(ds.files, "log/CURRENT").append(0, {"id": 0, "parent": None, "message": "created", "tables": {}, "schemas": {}, "levels": [], "grids": {}})
        return ds

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Dataset:
        ds = cls(spark, root)
        if ds._meta.head()[0] < 0:
            raise StoreError(f"{root} holds no dataset")
        return ds

    @classmethod
    def open_or_create(cls, spark: SparkSession, root: str, schema: Schema, on_conflict: str = "raise") -> Dataset:
        ds = cls(spark, root)
        if ds._meta.head()[0] < 0:
            return cls.create(spark, root, schema)
        if on_conflict == "raise" and (fields := ds.schema.diff(schema)):
            raise SchemaConflict(f"the stored schema differs in {', '.join(fields)}")
        return ds

    @property
    def meta(self) -> dict:
        return self._meta.head()[1]

    def _change_meta(self, change, name: str = "metadata") -> None:
        """Apply ``change`` to the newest metadata; again if another writer came between."""
        for _ in range(100):
            number, meta = self._meta.head()
            change(meta)
            if self._meta.append(number + 1, meta):
                return
        raise MetadataConflict(name)

    @property
    def schema(self) -> Schema:
        return Schema.from_dict(self.meta["schema"])

    def snapshot(self, snapshot_id: int | None = None, branch: str = "CURRENT") -> dict:
        if snapshot_id is None:
            number, found = Log(self.files, f"log/{branch}").head()
            if number < 0:
                raise StoreError(f"no branch {branch}")
            return found
        if snapshot_id == 0:
            return Log(self.files, "log/CURRENT").at(0)
        return json.loads(self.files.read(f"snapshots/{snapshot_id}.json"))

    def history(self, branch: str = "CURRENT") -> list[dict]:
        """Snapshots from the newest to the first."""
        out, at = [], self.snapshot(branch=branch)
        while True:
            out.append(at)
            if at["parent"] is None:
                return out
            at = self.snapshot(at["parent"])

    def branch(self, name: str, snapshot_id: int | None = None) -> None:
        """A second log, to which commits with ``branch="branch-name"`` go."""
        if not Log(self.files, f"log/branch-{name}").append(0, self.snapshot(snapshot_id)):
            raise StoreError(f"there is a branch {name}")

    def rollback(self, snapshot_id: int) -> None:
        """Make an earlier snapshot the current one; later ones stay on disk."""
        log = Log(self.files, "log/CURRENT")
        if not log.append(log.head()[0] + 1, self.snapshot(snapshot_id)):
            raise StoreError("another commit came first")

    def commit(
        self,
        tables: Mapping[str | tuple[str, int], DataFrame],
        message: str = "",
        levels: Sequence[int] | None = None,
        expected: int | None = None,
        branch: str = "CURRENT",
        grids: Mapping[int, Mapping] | None = None,
        drop: Sequence[str | tuple[str, int]] = (),
    ) -> int:
        """Write tables to a new snapshot that keeps all others; all become visible at once.

        A key ``(table, level)`` replaces one level of a table, a name all of it.  ``drop`` takes
        tables or levels away.  ``expected`` is the snapshot the change was made on: if another
        commit came between, StoreError is raised and nothing is visible; without it the
        change is put on top of whatever is newest.
        """
        import time

        new_id = time.time_ns()
        written: dict[str | tuple[str, int], list[str]] = {}
        schemas = {}
        if expected is not None and self.snapshot(branch=branch)["id"] != expected:
            raise StoreError(f"snapshot {expected} is no longer current")
        for key, df in tables.items():
            name, level = key if isinstance(key, tuple) else (key, None)
            place = f"{name}/commit={new_id}"
            if level is not None:
                df = df.drop("level")
                place += f"/level={level}"
            by = [c for c in ("level", "attr_bin") if c in df.columns]
            (df.write.mode("error").partitionBy(*by) if by else df.write.mode("error")).parquet(f"{self.root}/{place}")
            fields = json.loads(df.schema.json())["fields"]
            schemas[key] = fields if level is None else [*fields, {"name": "level", "type": "integer", "nullable": True, "metadata": {}}]
            inner = [n for n in self.files.names(place) if n.startswith("level=")] if "level" in by else []
            written[key] = [f"{place}/{n}" for n in inner] or [place]
        log = Log(self.files, f"log/{branch}")
        while True:
            number, current = log.head()
            if expected is not None and current["id"] != expected:
                raise StoreError(f"snapshot {expected} is no longer current")
            places, known = {k: list(v) for k, v in current["tables"].items()}, dict(current["schemas"])
            gone = {k[1] for k in drop if isinstance(k, tuple) and k[0] == "vertices"}
            for key in [*drop, *written]:
                name, level = key if isinstance(key, tuple) else (key, None)
                kept = [p for p in places.get(name, []) if level is not None and not p.endswith(f"/level={level}")]
                places[name] = kept + written.get(key, [])
                if not places[name]:
                    del places[name]
                    known.pop(name, None)
                elif key in schemas:
                    have = {f["name"]: f for f in (known.get(name, []) if kept else [])}
                    known[name] = list((have | {f["name"]: f for f in schemas[key]}).values())
            found = sorted((set(current["levels"]) | set(levels or ())) - gone)
            all_grids = {k: v for k, v in (current["grids"] | {str(k): dict(v) for k, v in (grids or {}).items()}).items() if int(k) not in gone}
            snapshot = {"id": new_id, "parent": current["id"], "message": message, "tables": places, "schemas": known, "levels": found, "grids": all_grids}
            self.files._create(f"snapshots/{new_id}.json", json.dumps(snapshot))
            if log.append(number + 1, snapshot):
                return new_id

    def table(self, name: str, snapshot_id: int | None = None, branch: str = "CURRENT", level: int | None = None) -> DataFrame:
        """A stored table, or one level of it; columns that a level lacks are null there."""
        from pyspark.sql.types import StructType

        snapshot = self.snapshot(snapshot_id, branch)
        places = snapshot["tables"].get(name)
        if not places:
            raise StoreError(f"no table {name}")
        schema = StructType.fromJson({"type": "struct", "fields": snapshot["schemas"][name]})
        names = schema.names
        if level is not None:
            places = [p for p in places if p.endswith(f"/level={level}")]
            if not places:
                return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}")
        return read.parquet(*(f"{self.root}/{p}" for p in places)).select(*names)

    def has(self, name: str) -> bool:
        return name in self.snapshot()["tables"]

    def grid(self, level: int = 0, snapshot_id: int | None = None) -> tuple[tuple[float, ...], tuple[float, ...] | None]:
        """Sizes of a level's chunks and bins: its own where it has them, else the schema's."""
        own = self.snapshot(snapshot_id)["grids"].get(str(level), {})
        schema = self.schema
        bins = own["bins"] if "bins" in own else schema.bins
        return tuple(own.get("chunk", schema.chunk)), tuple(bins) if bins else None

    def placed(self, vertices: DataFrame, level: int = 0, chunk: Sequence[float] | None = None, bins: Sequence[float] | None = None) -> DataFrame:
        """Vertices with the cells, and the bins if there are any, of a level's grid."""
        axes = self.schema.axes
        chunk, bins = (chunk, bins) if chunk else self.grid(level)
        out = vertices.drop(*("c" + a for a in axes), "bin").select("*", *grid.cells(chunk, axes))
        return out.withColumn("bin", grid.local_bin(axes, chunk, bins)) if bins else out

    def clustered(self, placed: DataFrame, files: int | None = None) -> DataFrame:
        """Rows ranged by cell and sorted: row-group statistics stay tight and files about 128 MB, whatever the number of cells."""
        names = ["c" + a for a in self.schema.axes]
        inner = [c for c in ("bin", "oid", "seq", "vid") if c in placed.columns]
        wanted = math.ceil(read_bytes(placed) / (128 << 20))
        if files or wanted > int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            ranged = placed.repartitionByRange(files or wanted, *names, *inner[-1:])
        else:  # adaptive execution joins small ranges
            ranged = placed.repartitionByRange(*names, *inner[-1:])
        return ranged.sortWithinPartitions(*names, *inner)

    def write_vertices(
        self,
        vertices: DataFrame,
        *,
        level: int = 0,
        out_of_bounds: str = "raise",
        objects: DataFrame | None = None,
        groups: DataFrame | None = None,
        links: DataFrame | None = None,
        files: int | None = None,
        chunk: Sequence[float] | None = None,
        bins: Sequence[float] | None = None,
        manifests: bool = False,
    ) -> int:
        """Bin, cluster and store a level's vertices; a level can be written once.

        ``chunk`` and ``bins`` are the level's own grid, if it is not the schema's.  With
        ``manifests`` vertices get the fragment of their object and cell, and the table
        ``manifests`` each object's fragments in order.
        """
        from lattica.operators.points import clip

        schema = self.schema
        if level in self.snapshot()["levels"]:
            raise StoreError(f"level {level} is written")
        missing = [c for c in (*schema.axes, *schema.attributes) if c not in vertices.columns]
        if missing:
            raise SchemaConflict(f"vertices lack {', '.join(missing)}")
        wrong = [c for c, t in schema.attributes.items() if not same_type(t, vertices.schema[c].dataType.simpleString())]
        if wrong:
            raise SchemaConflict(f"types differ from the schema's: {', '.join(wrong)}")
        if schema.bounds:
            if out_of_bounds == "expand":
                self._expand_bounds(vertices)
            elif out_of_bounds == "ignore" and schema.kind in ("polyline", "streamline", "line", "mesh", "skeleton"):
                raise StoreError(f"a {schema.kind} with vertices left out would be another one")
            vertices = clip(vertices, *schema.bounds, out_of_bounds, schema.axes)
        grids = None
        if chunk or bins:
            chunk = tuple(chunk or schema.chunk)
            grids = {level: {"chunk": list(map(float, chunk)), "bins": list(map(float, bins)) if bins else None}}
            if bins:
                grid.bins_per_chunk(chunk, bins)
        placed = self.placed(vertices, level, chunk if grids else None, bins)
        tables: dict[str | tuple[str, int], DataFrame] = {}
        if manifests:
            from lattica.operators import objects as O

            names = ["c" + a for a in schema.axes]
            placed = O.fragment_rank(placed, names)
            tables["manifests", level] = O.object_manifest(placed, names)
        tables["vertices", level] = self.clustered(placed, files)
        tables |= {k: v for k, v in (("objects", objects), ("groups", groups), ("links", links)) if v is not None}
        return self.commit(tables, f"level {level}", levels=[level], grids=grids)

    def _expand_bounds(self, vertices: DataFrame) -> None:
        from lattica.operators.points import bounds

        schema = self.schema
        found = bounds(vertices, schema.axes).first()
        lo, hi = ([found[f"{n}_{a}"] for a in schema.axes] for n in ("min", "max"))
        if lo[0] is not None:
            self._set_bounds([min(a, float(b)) for a, b in zip(schema.bounds[0], lo, strict=True)], [max(a, float(b)) for a, b in zip(schema.bounds[1], hi, strict=True)])

    def _set_bounds(self, lo: Sequence[float], hi: Sequence[float]) -> None:
        def change(meta: dict) -> None:
            meta["schema"]["bounds"] = [list(map(float, lo)), list(map(float, hi))]

        self._change_meta(change, "bounds")

    def set_bounds(self, lo: Sequence[float], hi: Sequence[float], *, force: bool = False) -> None:
        """New bounds; vertices outside are dropped if ``force``, else an error."""
        schema, current = self.schema, self.snapshot()
        outside = ~F.coalesce(grid.in_box(lo, hi, schema.axes), F.lit(False))
        changed = {}
        for level in current["levels"]:
            rows = self.table("vertices", current["id"], level=level)
            if not rows.where(outside).isEmpty():
                changed["vertices", level] = rows.where(~outside)
        if changed:
            if not force:
                raise StoreError("vertices lie outside; use force to drop them")
            self.commit(changed, "bounds drawn in", expected=current["id"])
        self._set_bounds(lo, hi)

    def level(self, level: int = 0):
        """A query over the vertices of a level, with that level's grid."""
        from lattica.operators.points import Query

        schema = self.schema
        df = self.table("vertices", level=level)
        groups = self.table("groups") if self.has("groups") else None
        order = [c for c in (*("c" + a for a in schema.axes), "oid", "seq", "vid") if c in df.columns]
        chunk, bins = self.grid(level)
        return Query(df, sizes=chunk, bins=bins if "bin" in df.columns else None, axes=schema.axes, groups=groups, order=order)

    def level_near_scale(self, scale: float) -> int:
        """The level whose mean cell size is nearest to ``scale``."""
        found = self.snapshot()["levels"]
        return found[grid.nearest_scale([self.grid(k)[0] for k in found], scale)]

    def remove_level(self, level: int) -> int:
        """Drop the coarsest level, its manifests and the links to it, in one commit."""
        current = self.snapshot()
        if not current["levels"] or level != max(current["levels"]):
            raise StoreError("only the coarsest level can be removed")
        drop = [(name, level) for name, places in current["tables"].items() if any(p.endswith(f"/level={level}") for p in places)]
        changed = {}
        for k in [x for x in current["levels"] if x < level]:
            if any(p.endswith(f"/level={k}") for p in current["tables"].get("parents", ())):
                parents = self.table("parents", current["id"], level=k)
                changed["parents", k] = parents.where(F.lit(k) + F.col("delta") != level)
        return self.commit(changed, f"removed level {level}", expected=current["id"], drop=drop)

    def user(self, namespace: str) -> dict:
        return self.meta["user"].get(namespace, {})

    def set_user(self, namespace: str, value: dict, expected: dict | None = None) -> None:
        """Replace a namespace of user metadata, if it still is what was expected."""

        def change(meta: dict) -> None:
            if expected is not None and meta["user"].get(namespace, {}) != expected:
                raise MetadataConflict(namespace)
            meta["user"][namespace] = value

        self._change_meta(change, namespace)

    def header(self, name: str, block: dict | None = None) -> dict | None:
        """An opaque header block of a file format, kept for a round trip."""
        if block is not None:
            self._change_meta(lambda meta: meta["headers"].update({name: block}), name)
        return self.meta["headers"].get(name)


#: Names of attribute types and Spark's names for them.
TYPES = {"float32": "float", "float64": "double", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "bool": "boolean", "str": "string"}


def same_type(declared: str, found: str) -> bool:
    return TYPES.get(declared, declared) == found


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Rows, and the sum of their hashes: equal for equal bags of rows in any order."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(20,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def union_sources(parts: Iterable[tuple[DataFrame, Sequence[Sequence[float]]]], axes: Sequence[str] = grid.AXES, fingerprints: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """Vertices of several datasets in one space: each affinely moved, with its number as ``source``.

    With ``fingerprints`` a source that is not what it was when they were taken is an error.
    """
    out = None
    for k, (df, matrix) in enumerate(parts):
        if fingerprints is not None and fingerprint(df) != tuple(fingerprints[k]):
            raise StoreError(f"source {k} has changed")
        moved = df.select(F.lit(k).alias("source"), *[c for c in df.columns if c not in axes], *grid.affine(matrix, axes))
        out = moved if out is None else out.unionByName(moved, allowMissingColumns=True)
    if out is None:
        raise StoreError("no sources")
    return out


#: Parametric types and how many coefficients they take: Ax + By + Cz + D, origin and direction, centre and radius.
PARAMETRIC = {"plane": 4, "line": 6, "sphere": 4}


def parametric(df: DataFrame, types: Mapping[str, int] = PARAMETRIC) -> DataFrame:
    """Rows of id, type, coefficients; a type that is unknown or an arity that differs fails the job."""
    arity = F.create_map(*(x for k, v in types.items() for x in (F.lit(k), F.lit(v))))
    values = F.filter("coefficients", lambda c: c.isNotNull() & ~F.isnan(c))
    known = F.coalesce(F.size(values) == arity[F.col("type")], F.lit(False))
    checked = F.when(known, values).otherwise(F.raise_error(F.concat(F.lit("bad parametric object "), F.col("id").cast("string"))).cast("array<double>"))
    return df.withColumn("coefficients", checked)
