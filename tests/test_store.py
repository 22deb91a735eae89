import pytest

from lattica.operators.edits import EditSession, Report
from lattica.operators import layout
from lattica.operators.validate import mixed_bins, untied_leaves, validate, wrong_counts
from lattica.sources.store import Dataset, MetadataConflict, Schema, SchemaConflict, StoreError, fingerprint, parametric, union_sources
from lattica.streaming.ingest import Appender, place, reserve

SCHEMA = Schema("point_cloud", ("x", "y"), (10.0, 10.0), (5.0, 5.0), ((0.0, 0.0), (100.0, 100.0)), {"w": "float64"})


def rows(spark, n=50):
    return spark.createDataFrame([(i, i % 5, i // 5, float(i), float(2 * i % 100), i / 2) for i in range(n)], "vid long, oid long, seq long, x double, y double, w double")


@pytest.fixture()
def ds(spark, tmp_path):
    found = Dataset.create(spark, f"file://{tmp_path}/ds", SCHEMA)
    found.write_vertices(rows(spark), groups=spark.createDataFrame([(1, [0, 1])], "gid long, members array<long>"), objects=spark.createDataFrame([(i, 1.0) for i in range(5)], "oid long, score double"))
    return found


def test_create_open_conflict(spark, ds):
    with pytest.raises(StoreError):
        Dataset.create(spark, ds.root, SCHEMA)
    with pytest.raises(StoreError):
        Dataset.open(spark, ds.root + "-none")
    with pytest.raises(SchemaConflict, match="chunk"):
        Dataset.open_or_create(spark, ds.root, Schema("point_cloud", ("x", "y"), (20.0, 10.0), (5.0, 5.0), SCHEMA.bounds, SCHEMA.attributes))
    assert Dataset.open_or_create(spark, ds.root, SCHEMA).schema.diff(SCHEMA) == []


def test_write_once_and_read(spark, ds):
    assert ds.level().count() == 50
    assert ds.level().select(groups=(1,)).count() == 20
    assert ds.level().select(box=((10, 0), (20, 100))).count() == 11
    with pytest.raises(StoreError):
        ds.write_vertices(rows(spark))
    with pytest.raises(SchemaConflict):
        ds.write_vertices(rows(spark).drop("w"), level=1)
    with pytest.raises(Exception, match="out of bounds"):
        ds.write_vertices(rows(spark, 200), level=1)
    ds.write_vertices(rows(spark, 200), level=1, out_of_bounds="ignore")
    assert ds.level(1).count() == 101
    assert "PushedFilters" in ds.level().select(box=((10, 0), (20, 100))).plan() or "Pushed" in ds.level().select(box=((10, 0), (20, 100))).plan()
    with pytest.raises(StoreError):
        ds.remove_level(0)
    ds.remove_level(1)
    assert ds.snapshot()["levels"] == [0] and ds.level(1).count() == 0


def test_edits_are_one_snapshot(spark, ds):
    before = ds.snapshot()["id"]
    with EditSession(ds, "move and drop") as e:
        e.edit_vertex(3, position=(55.0, 66.0), attributes={"w": 9.0})
        e.remove_vertex(4)
        e.add_vertex(900, 0, 1, (1.0, 1.0), w=0.0)
        e.remove_object(2)
        e.set_object(1, score=5.0)
    now = {r["vid"]: r for r in ds.table("vertices").collect()}
    assert (now[3]["x"], now[3]["y"], now[3]["w"], now[3]["cx"]) == (55.0, 66.0, 9.0, 5)
    assert 4 not in now and 2 not in now and now[900]["seq"] == 1 and now[5]["seq"] == 2
    assert ds.table("vertices", before).count() == 50
    assert {r["oid"]: r["score"] for r in ds.table("objects").collect()}[1] == 5.0
    assert len(ds.history()) >= 3
    with pytest.raises(RuntimeError), EditSession(ds) as e:
        e.remove_vertex(3)
        raise RuntimeError
    assert 3 in {r["vid"] for r in ds.table("vertices").collect()}
    ds.rollback(before)
    assert ds.table("vertices").count() == 50


def test_concurrent_edit_is_refused(spark, ds):
    one, two = EditSession(ds), EditSession(ds)
    one.remove_vertex(1)
    two.remove_vertex(2)
    one.flush()
    with pytest.raises(StoreError):
        two.flush()


def test_branches(spark, ds):
    ds.branch("try")
    ds.commit({"vertices": ds.table("vertices").limit(3)}, branch="branch-try")
    assert ds.table("vertices", branch="branch-try").count() == 3 and ds.table("vertices").count() == 50


def test_metadata(ds):
    ds.set_user("lab", {"a": 1}, expected={})
    with pytest.raises(MetadataConflict):
        ds.set_user("lab", {"a": 2}, expected={})
    assert ds.user("lab") == {"a": 1}
    ds.header("trk", {"voxel": [1, 2]})
    assert ds.header("trk") == {"voxel": [1, 2]}


def test_validate_clean_and_broken(spark, ds):
    assert validate(ds).count() == 0
    broken = ds.table("vertices").selectExpr("* except (cx)", "cx + 1 as cx")
    ds.commit({"vertices": broken})
    assert validate(ds).count() == 50


def test_validate_calls_every_check(spark, tmp_path):
    mesh = Dataset.create(spark, f"file://{tmp_path}/mesh", Schema("mesh", ("x", "y"), (10.0, 10.0), chunk_by="w", attributes={"w": "float64"}))
    mesh.write_vertices(rows(spark))
    df = spark.createDataFrame
    mesh.commit(
        {
            "levels": df([(0, 49)], "level int, n_vertices long"),
            "fragments": df([(0, 0, 0)], "cx long, cy long, frag long"),
            "manifest": df([(7, 0, 0, 0), (8, 0, 0, 1)], "oid long, cx long, cy long, frag long"),
            "faces": df([(1, [1, 2, 3]), (2, [5, 4])], "face long, sorted array<long>"),
            "leaf_cells": df([(0, 0, 0)], "i long, j long, k long"),
        },
        levels=[1],
    )
    mesh.set_user("pyramid", {"factors": [[0.5, 1.0]], "bins": [5.0, 5.0]})
    coarse = mesh.table("vertices").selectExpr("* except (level, cx, cy)", "1 as level", "cast(floor(x / 5) as bigint) cx", "cast(floor(y / 5) as bigint) cy").limit(9)
    found = [(r["level"], r["check"]) for r in validate(mesh).collect()]
    assert {(1, "levels have vertices"), (3, "counts are right"), (3, "manifests name fragments"), (3, "links are canonical"), (4, "conventions"), (4, "one bin for an object")} <= set(found)
    mesh.commit({"vertices": mesh.table("vertices").unionByName(coarse)}, grids={1: {"chunk": [5.0, 5.0], "bins": None}})
    found = [(r["level"], r["check"]) for r in validate(mesh).collect()]
    assert (5, "pyramid narrows") in found and (1, "levels have vertices") not in found and (3, "vertices in their cells") not in found


def test_report_merge():
    a, b = Report(remap={1: 5}, moved=1), Report(remap={5: 8, 2: 3}, added=2, snapshot=9)
    both = a.merge(b)
    assert both.remap == {1: 8, 2: 3} and both.moved == 1 and both.added == 2 and both.snapshot == 9


def test_sources_and_parametric(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "vid long, x double, y double")
    moved = union_sources([(df, [[1, 0, 0], [0, 1, 0]]), (df, [[0, 1, 10], [1, 0, 0]])], "xy").orderBy("source").collect()
    assert (moved[1]["x"], moved[1]["y"]) == (12.0, 1.0)
    bad = spark.createDataFrame([(1, "sphere", [1.0, 2.0])], "id long, type string, coefficients array<double>")
    with pytest.raises(Exception, match="bad parametric object"):
        parametric(bad).collect()


def test_bounds_expand_and_contract(spark, ds):
    ds.write_vertices(rows(spark, 200), level=1, out_of_bounds="expand")
    assert ds.level(1).count() == 200 and ds.schema.bounds == ((0.0, 0.0), (199.0, 100.0))
    with pytest.raises(StoreError):
        ds.set_bounds((0, 0), (50, 100))
    ds.set_bounds((0, 0), (50, 100), force=True)
    assert ds.level(1).count() == 51 and ds.schema.bounds[1] == (50.0, 100.0)


def test_changed_sources_are_refused(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "vid long, x double, y double")
    same = [[1, 0, 0], [0, 1, 0]]
    mark = fingerprint(df.orderBy("y", ascending=False))
    assert union_sources([(df, same)], "xy", [mark]).count() == 2
    with pytest.raises(StoreError):
        union_sources([(df.limit(1), same)], "xy", [mark])


def test_more_checks(spark):
    v = spark.createDataFrame([(0, 1, "a"), (0, 1, "b"), (1, 2, "a")], "level int, oid long, k string")
    assert [r["detail"] for r in mixed_bins(v, "k").collect()] == ["1"]
    declared = spark.createDataFrame([(0, 2), (1, 5), (2, 1)], "level int, n_vertices long")
    assert sorted(r["detail"] for r in wrong_counts(v, declared).collect()) == ["1", "2"]
    cells = spark.createDataFrame([(0, 0, 0, 9), (3, 3, 3, 1)], "i long, j long, k long, weight long")
    leaves = layout.leaves(cells, 2, 5)
    assert untied_leaves(cells, leaves, 2).count() == 0
    assert [r["detail"] for r in untied_leaves(cells, leaves.where("i = 0"), 2).collect()] == ["3.3.3"]


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    source = str(tmp_path / "in")
    rows(spark, 30).write.parquet(source + "/a")
    appender = Appender(spark, f"file://{tmp_path}/out", (10.0, 10.0), "xy")
    stream = spark.readStream.schema(rows(spark).schema).parquet(source + "/*")
    appender.start(stream, str(tmp_path / "check")).awaitTermination()
    assert appender.read().count() == 30
    appender.write(rows(spark, 30), appender.batches()[0])  # a replay
    assert appender.read().count() == 30
    assert appender.reconcile().agg({"n_rows": "sum"}).first()[0] == 30


def test_reserved_ranges(spark):
    ranges = reserve(spark, [3, 0, 2])
    assert [(r["first"], r["end"]) for r in ranges.collect()] == [(0, 3), (3, 3), (3, 5)]
    df = spark.createDataFrame([(9.0,), (7.0,)], "x double")
    assert sorted((r["x"], r["oid"]) for r in place(df, 2, ranges, ["x"]).collect()) == [(7.0, 3), (9.0, 4)]


def test_joined_rows_are_ranged_by_what_they_read(spark, tmp_path):
    v = spark.range(20_000).selectExpr("id AS vid", "id % 7000 AS oid", "id % 7000 * 1.0D AS x", "id * 1.0D AS y", "id * 0.5D AS w")
    v.write.parquet(f"file://{tmp_path}/v")
    stored = spark.read.parquet(f"file://{tmp_path}/v")
    names = stored.groupBy("oid").count()
    ds = Dataset.create(spark, f"file://{tmp_path}/ds", Schema("point_cloud", ("x", "y"), (10.0, 10.0)))
    joined = ds.clustered(ds.placed(stored.join(stored.selectExpr("vid", "w AS other"), "vid").join(names, "oid")))
    assert joined.rdd.getNumPartitions() <= 4  # the product of the sizes asks for hundreds
    assert joined.count() == 20_000
