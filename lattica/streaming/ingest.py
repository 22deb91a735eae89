"""Incremental ingest: each micro-batch is committed once, whatever is replayed.

A try of a batch writes a folder of its own and then creates the batch's mark, which names
it; the first mark stays.  A batch that is replayed after its mark is left as it is, and
readers take what marks name alone, so that no reader sees a batch half written or a hole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.functions import grid
from lattica.sources.store import Dataset, Files, StoreError


class BatchLog:
    """Batches of one table under ``root``; subclasses say how rows are placed."""

    def __init__(self, spark: SparkSession, root: str, observer: Callable[[int, int], None] | None = None):
        self.spark, self.root, self.observer = spark, root.rstrip("/"), observer
        self.files = Files(spark, root)

    def placed(self, batch: DataFrame) -> DataFrame:
        return batch

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """One batch, exactly once; the observer gets its number and rows, counted as they are written."""
        if self.files.exists(f"marks/{batch_id}"):
            return
        place = f"data/batch={batch_id}/try={uuid.uuid4().hex}"
        seen = Observation()
        rows = self.placed(batch).observe(seen, F.count(F.lit(1)).alias("n"))
        rows.write.parquet(f"{self.root}/{place}")
        n = seen.get["n"]
        if self.files.create(f"marks/{batch_id}", json.dumps({"place": place, "rows": n})) and self.observer:
            self.observer(batch_id, n)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def batches(self) -> list[int]:
        return sorted(int(n) for n in self.files.names("marks") if n.isdigit())

    def read(self) -> DataFrame:
        """Rows of all marked batches, with the batch's number, as one scan."""
        found = self.batches()
        if not found:
            raise FileNotFoundError(f"{self.root} holds no batch")
        places = [json.loads(self.files.read(f"marks/{k}"))["place"] for k in found]
        scan = self.spark.read.option("basePath", f"{self.root}/data").option("mergeSchema", "true")
        return scan.parquet(*(f"{self.root}/{p}" for p in places)).drop("try")

    def finalize(self, ds: Dataset, table: str, level: int | None = None, message: str = "") -> int:
        """Commit all rows as a table, or one level of it, of a dataset; the count is kept in its user block ``ingest``."""
        rows = self.read().drop("batch")
        key = table if level is None else (table, level)
        found = ds.commit({key: rows}, message or f"{table} from {len(self.batches())} batches", levels=[level] if level is not None and table == "vertices" else None)
        name = table if level is None else f"{table}/{level}"
        ds.set_user("ingest", ds.user("ingest") | {name: {"rows": sum(json.loads(self.files.read(f"marks/{k}"))["rows"] for k in self.batches())}})
        return found


class Appender(BatchLog):
    """Appends streamed vertices, cells assigned."""

    def __init__(self, spark: SparkSession, root: str, sizes: Sequence[float], axes: Sequence[str] = grid.AXES, observer: Callable[[int, int], None] | None = None):
        super().__init__(spark, root, observer)
        self.sizes, self.axes = tuple(sizes), tuple(axes)
        self.names = ["c" + a for a in axes]

    def placed(self, batch: DataFrame) -> DataFrame:
        return batch.drop(*self.names).select("*", *grid.cells(self.sizes, self.axes)).sortWithinPartitions(*self.names)

    def reconcile(self, declared: DataFrame | None = None) -> DataFrame:
        """Rows and batches of each occupied cell: what a coordinator derives after workers wrote.

        With ``declared`` (cells and ``n_rows``) only cells where the two differ, ``declared`` null or a number.
        """
        real = self.read().groupBy(*self.names).agg(F.count("*").alias("n_rows"), F.countDistinct("batch").alias("n_batches"))
        if declared is None:
            return real
        said = declared.select(*self.names, F.col("n_rows").alias("declared"))
        both = real.join(said, self.names, "full")
        return both.where(~F.col("n_rows").eqNullSafe(F.col("declared")))


class ManifestAppender(BatchLog):
    """Appends manifest rows (oid and what else they hold); ids of later batches may not fall below ``base``.

    Opening with a ``base_oid`` cuts what was appended before to the ids below it, so that a
    run that resumes there appends the rest once.
    """

    def __init__(self, spark: SparkSession, root: str, base_oid: int | None = None, observer: Callable[[int, int], None] | None = None):
        super().__init__(spark, root, observer)
        if base_oid is not None:
            cuts = self.files.names("cuts")
            value = json.dumps({"base": int(base_oid), "batches": self.batches()})
            if not self.files.create(f"cuts/{len(cuts):09}", value):
                raise StoreError("another writer opened the table")

    def placed(self, batch: DataFrame) -> DataFrame:
        order = [c for c in ("oid", "seq") if c in batch.columns]
        return batch.sortWithinPartitions(*order)

    def read(self) -> DataFrame:
        rows = super().read()
        for name in self.files.names("cuts"):
            cut = json.loads(self.files.read(f"cuts/{name}"))
            if cut["batches"]:
                rows = rows.where((F.col("batch") > max(cut["batches"])) | (F.col("oid") < cut["base"]))
        return rows

    def lengths(self) -> DataFrame:
        """Entries of each object."""
        return self.read().groupBy("oid").agg(F.count("*").alias("n_fragments"))


class LinkAppender(BatchLog):
    """Appends links with the cells of their ends, sorted by the first end's cell: a batch opens files of its own cells alone."""

    def __init__(self, spark: SparkSession, root: str, vertices: DataFrame, axes: Sequence[str] = grid.AXES, observer: Callable[[int, int], None] | None = None):
        super().__init__(spark, root, observer)
        self.vertices, self.names = vertices, ["c" + a for a in axes]

    def placed(self, batch: DataFrame) -> DataFrame:
        from lattica.operators.links import partition_links

        return partition_links(batch, self.vertices, self.names).sortWithinPartitions(*("s" + c for c in self.names))

    def counts(self) -> DataFrame:
        """Links of each pair of cells, by offset: what finalize() is checked against."""
        return self.read().groupBy(*("s" + c for c in self.names), *("o" + c[1:] for c in self.names)).agg(F.count("*").alias("n_links"))


def reserve(spark: SparkSession, sizes: Sequence[int]) -> DataFrame:
    """Disjoint id ranges for writers that bring so many rows each: writer, first, end."""
    rows, at = [], 0
    for k, n in enumerate(sizes):
        rows.append((k, at, at + int(n)))
        at += int(n)
    return spark.createDataFrame(rows, "writer int, first long, end long")


def place(rows: DataFrame, writer: int, ranges: DataFrame, order: Sequence[str], name: str = "oid") -> DataFrame:
    """A writer's rows numbered inside its reserved range."""
    from lattica.operators.points import number_rows

    first = ranges.where(F.col("writer") == writer).first()["first"]
    return number_rows(rows, order, name, start=first)
