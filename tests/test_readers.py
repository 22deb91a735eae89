import pytest
from pyspark.sql import functions as F

from lattica.operators import layout, links, readers


def test_append_rules_fail_the_job(spark):
    old = spark.createDataFrame([(1, "a"), (4, "b")], "oid long, k string")
    good = spark.createDataFrame([(5, "a")], "oid long, k string")
    assert readers.append_objects(old, good, bins=old, bin_column="k").count() == 3
    with pytest.raises(Exception, match="object id in use"):
        readers.append_objects(old, spark.createDataFrame([(4, "a")], "oid long, k string")).collect()
    with pytest.raises(Exception, match="no such bin"):
        readers.append_objects(old, spark.createDataFrame([(9, "z")], "oid long, k string"), bins=old, bin_column="k").collect()


def test_seams_join_different_leaves(spark):
    placed = spark.createDataFrame([(0, 10), (1, 10), (2, 20)], "vid long, key long")
    edges = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    assert [(r["src"], r["dst"]) for r in readers.seams(edges, placed).collect()] == [(1, 2)]


def test_leaf_neighbours_across_depths(spark):
    cells = spark.createDataFrame([(0, 0, 0, 9), (1, 0, 0, 9), (2, 0, 0, 1), (3, 3, 3, 1)], "i long, j long, k long, weight long")
    leaves = layout.leaves(cells, 2, 10)
    at = {(r["depth"], r["i"], r["j"], r["k"]): r["key"] for r in leaves.collect()}
    assert set(at) == {(2, 0, 0, 0), (2, 1, 0, 0), (1, 1, 0, 0), (1, 1, 1, 1)}
    pairs = {(r["a"], r["b"]) for r in readers.leaf_neighbours(leaves, 2).collect()}
    one, two, big, far = at[(2, 0, 0, 0)], at[(2, 1, 0, 0)], at[(1, 1, 0, 0)], at[(1, 1, 1, 1)]
    assert pairs == {(one, two), (two, one), (two, big), (big, two), (big, far), (far, big)}


def test_unknown_segment_is_empty(spark):
    objs = spark.createDataFrame([(1, 77)], "oid long, segment_id long")
    v = spark.createDataFrame([(0, 1, 0, 0, 1.0), (1, 1, 0, 1, 2.0)], "vid long, oid long, frag long, row long, x double")
    named = spark.createDataFrame([], "child long, parent long")
    own, edges = readers.skeleton_by_segment(objs, v, named, 77, "x", (10.0,), ("frag",))
    assert [r["x"] for r in own.orderBy("vid").collect()] == [11.0, 12.0] and edges.count() == 1
    own, edges = readers.skeleton_by_segment(objs, v, named, 78, "x", (10.0,), ("frag",))
    assert own.count() == edges.count() == 0


def test_offset_names_round_trip():
    for offsets in ([(0, 0, 1)], [(-2, 0, 0), (1, 1, 0)]):
        assert readers.parse_offsets(readers.offsets_name(offsets)) == offsets
    assert readers.offsets_name((0, 0, 1)) == "0.0.+1"


def test_halo_rings(spark):
    cells = spark.createDataFrame([(x, 0) for x in range(-3, 4)], "cx long, cy long")
    rings = {r["cx"]: r["ring"] for r in readers.halo_cells(cells, F.col("cx") == 0, 2, "xy").collect()}
    assert rings == {-2: 2, -1: 1, 0: 0, 1: 1, 2: 2}


def test_entry_and_contract(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    known, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 100


def test_ends_of_faces_are_dealt_by_size(spark, tmp_path, monkeypatch):
    from lattica.sources import store

    monkeypatch.setattr(store, "PART_BYTES", 2_000)
    spark.range(600).selectExpr("id AS face", "array(id % 89, id * 7 % 89, id * 31 % 89) AS ends").write.parquet(f"file://{tmp_path}/f")
    faces = spark.read.parquet(f"file://{tmp_path}/f")
    v = spark.createDataFrame([(i, i % 7, i % 3, float(i % 7) + 0.5, float(i)) for i in range(89)], "vid long, cx long, cy long, x double, y double")
    at = {r["vid"]: r for r in v.collect()}
    own, copies, box = {}, set(), {}
    for r in faces.collect():
        ends = [at[e] for e in r["ends"]]
        own[r["face"]] = min((e["cx"], e["cy"], e["vid"]) for e in ends)[:2]
        copies |= {(r["face"], e["cx"], e["cy"]) for e in ends}
        box.setdefault(own[r["face"]], []).extend(e["y"] for e in ends)
    owners, placed = links.owner_cell(faces, v, ("cx", "cy")), links.placements(faces, v, ("cx", "cy"))
    assert {r["face"]: (r["cx"], r["cy"]) for r in owners.collect()} == own
    assert {tuple(r) for r in placed.collect()} == copies
    found = readers.owner_bounds(faces, v, "xy", ("cx", "cy")).collect()
    assert {(r["cx"], r["cy"]): (r["min_y"], r["max_y"]) for r in found} == {k: (min(y), max(y)) for k, y in box.items()}
    assert min(df.rdd.getNumPartitions() for df in (owners, placed)) > 4  # the session's number
