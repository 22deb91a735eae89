import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import edits, layout, links, objects, paths, points, pyramid, validate
from lattica.operators.points import Query, Selection, SelectionError


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(42)
    xyz = rng.uniform(-100, 100, (400, 3))
    rows = [(i, i % 17, i // 17, *map(float, p)) for i, p in enumerate(xyz)]
    return points.assign_cells(spark.createDataFrame(rows, "vid long, oid long, seq long, x double, y double, z double"), (50, 50, 50))


def vids(df):
    return sorted(r["vid"] for r in df.select("vid").collect())


def test_boxes_intersect_and_prune(spark, cloud):
    q = Query(cloud, sizes=(50, 50, 50)).select(box=((-60, -60, -60), (60, 60, 60))).select(box=((-10, -100, -100), (100, 100, 0)))
    rows = cloud.toPandas()
    inside = rows[rows.x.between(-10, 60) & rows.y.between(-60, 60) & rows.z.between(-60, 0)]
    assert vids(q.dataframe()) == sorted(inside.vid)
    assert q.count() == len(inside)
    assert "cx" in q.plan()


def test_selection_terms():
    a = Selection(objects=(5, 3, 9), where=(("k", 1),), limit=10, cells=((0,),))
    b = Selection(objects=(9, 5), where=(("k", 2), ("m", None)), limit=4, cells=((1,),))
    both = a.and_(b)
    assert both.objects == (5, 9) and dict(both.where) == {"k": 2, "m": None} and both.limit == 4 and both.cells == ((1,),)
    assert Selection().and_(a) == a


def test_ball_boundary_is_inside(spark):
    df = spark.createDataFrame([(0, 3.0, 4.0), (1, 3.0, 4.1)], "vid long, x double, y double")
    assert vids(Query(df, axes="xy").select(near=((0, 0), 5)).dataframe()) == [0]


def test_empty_and_unknown_selections(cloud):
    q = Query(cloud, sizes=(50, 50, 50))
    assert q.select(objects=()).count() == 0 and q.select(cells=()).count() == 0
    assert q.select(objects=(999,)).count() == 0
    assert q.select(limit=7).count() == 7
    with pytest.raises(SelectionError):
        Query(cloud.drop("oid")).select(objects=(1,)).dataframe()
    with pytest.raises(SelectionError):
        q.select(groups=(1,)).dataframe()


def test_iter_cells_covers_all(cloud):
    seen = list(Query(cloud, sizes=(50, 50, 50)).iter_cells())
    assert [k for k, _ in seen] == sorted({tuple(r) for r in cloud.select("cx", "cy", "cz").distinct().collect()})
    assert sum(len(r) for _, r in seen) == 400


def test_clip_policies(cloud):
    assert points.clip(cloud, (-50,) * 3, (50,) * 3, "ignore").count() < 400
    assert points.clip(cloud, (-50,) * 3, (50,) * 3, "expand").count() == 400
    with pytest.raises(Exception, match="out of bounds"):
        points.clip(cloud, (-50,) * 3, (50,) * 3, "raise").collect()


def test_numbering_is_dense(cloud):
    rows = points.number_rows(cloud, ["x"], "n").orderBy("x").select("n").collect()
    assert [r["n"] for r in rows] == list(range(400))


def test_categories_round_trip(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "k string")
    coded, table = points.encode_categories(df, "k")
    assert sorted((r["k"], r["code"]) for r in coded.collect() if r["k"]) == [("a", 0), ("b", 1), ("b", 1)]
    assert [r["code"] for r in coded.where("k is null").collect()] == [-1]
    assert table.count() == 2


def test_split_bridges_and_crop(spark):
    xs = [1.0, 2.0, 11.0, 12.0, 3.0, 25.0]
    df = spark.createDataFrame([(i, 1, i, x, int(x // 10)) for i, x in enumerate(xs)], "vid long, oid long, seq long, x double, cx long")
    split = paths.split_at_cells(df, ["cx"])
    assert [r["segment"] for r in split.orderBy("seq").collect()] == [0, 0, 1, 1, 2, 3]
    assert sorted((r["src"], r["dst"]) for r in paths.bridges(df, ["cx"]).collect()) == [(1, 2), (3, 4), (4, 5)]
    cropped = paths.crop(df, F.col("cx") == 0).orderBy("seq").collect()
    assert [(r["vid"], r["part"]) for r in cropped] == [(0, 0), (1, 0), (4, 1)]
    assert paths.lengths(df, "x").first()["length"] == pytest.approx(1 + 9 + 1 + 9 + 22)


def test_lines_keep_either_end(spark):
    df = spark.createDataFrame([(1, -5.0, 5.0), (2, -5.0, 15.0), (3, 2.0, 99.0)], "oid long, ax double, bx double")
    assert sorted(r["oid"] for r in paths.lines_in_box(df, (0,), (10,), "x").collect()) == [1, 3]


@pytest.mark.parametrize("width", [2, 3, 4])
@pytest.mark.parametrize("n", [4, 5])
def test_faces_of_any_width_and_count(spark, width, n):
    faces = spark.createDataFrame([(f, [f + k for k in range(width)]) for f in range(n)], "face long, ends array<long>")
    kept = spark.createDataFrame([(v,) for v in range(n)], "vid long")
    whole = sorted(r["face"] for r in links.faces_within(kept, faces).collect())
    assert whole == [f for f in range(n) if f + width - 1 < n]


def test_canonical_keeps_winding(spark):
    df = spark.createDataFrame([([7, 3, 5],), ([1, 2],)], "ends array<long>")
    back = df.select(links.canonical().alias("sorted"), "ends").select("ends", links.restored().alias("again")).collect()
    assert all(r["ends"] == r["again"] for r in back)


def test_skeleton_records_override(spark):
    v = spark.createDataFrame([(i, 0, i) for i in range(5)], "vid long, f long, row long")
    named = spark.createDataFrame([(2, 0), (3, None), (4, 1), (4, 2)], "child long, parent long")
    found = sorted((r["child"], r["parent"]) for r in links.skeleton_parents(v, named, ("f",)).collect())
    assert found == [(1, 0), (2, 0), (4, 1), (4, 2)]


def test_depth_first_and_paths(spark):
    rows = [(1, 0, None), (1, 1, 0), (1, 2, 1), (1, 3, 0), (1, 4, 1)]
    df = spark.createDataFrame(rows, "oid long, child long, parent long")
    assert [r["vid"] for r in links.depth_first(df).orderBy("rank").collect()] == [0, 1, 2, 4, 3]
    found = links.maximal_paths(df).orderBy("path", "seq").collect()
    assert [(r["path"], r["vid"], r["branch_of"]) for r in found] == [(0, 0, None), (0, 1, None), (0, 2, None), (1, 4, 1), (2, 3, 0)]


def test_large_trees_are_contracted(spark, monkeypatch):
    rng = random.Random(5)
    up = {0: None, **{v: rng.randrange(v) for v in range(1, 40)}, **{v: v - 1 for v in range(40, 90)}, 200: 201, 201: 202, 202: 200, 203: 202, 204: 999}
    small = [(2, v, v - 1 if v else None) for v in range(5)]
    df = spark.createDataFrame([(1, v, p) for v, p in up.items()] + small, "oid long, child long, parent long")
    order, paths, stack = [], [], [(0, None)]
    while stack:
        v, above = stack.pop()
        paths.append([above])
        while v is not None:
            order.append(v)
            paths[-1].append(v)
            below = sorted(c for c, p in up.items() if p == v)
            stack += [(c, v) for c in below[:0:-1]]
            v = below[0] if below else None
    walked, per_tree = [], links.per_tree
    monkeypatch.setattr(links.forest, "TREE_ROWS", 12)
    monkeypatch.setattr(links, "per_tree", lambda df, *a: walked.append(df.groupBy("oid").count().agg({"count": "max"}).first()[0]) or per_tree(df, *a))
    found = links.depth_first(df).collect()
    assert [r["vid"] for r in sorted(found, key=lambda r: r["rank"]) if r["oid"] == 1] == order + [200, 201, 202, 203, 204]
    assert sorted(r["rank"] for r in found if r["oid"] == 1) == list(range(len(up)))
    assert [r["vid"] for r in sorted(found, key=lambda r: r["rank"]) if r["oid"] == 2] == [0, 1, 2, 3, 4]
    rows = links.maximal_paths(df).where("oid = 1").orderBy("path", "seq").collect()
    assert [(r["path"], r["seq"], r["vid"], r["branch_of"]) for r in rows] == [(k, i, v, p[0] if i == 0 else None) for k, p in enumerate(paths) for i, v in enumerate(p[1:])]
    assert max(walked) <= 12


def test_fragment_owner_sentinels(spark):
    man = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 0, 1)], "oid long, c long, frag long")
    frags = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "c long, frag long")
    found = {r["frag"]: r["owner"] for r in objects.fragment_owner(man, frags, ["c"]).collect()}
    assert found == {0: objects.SHARED, 1: 3, 2: objects.NONE}


def test_fragment_tiles(spark):
    good = spark.createDataFrame([(0, 0, 3), (1, 3, 2)], "frag long, start long, n long")
    assert objects.tiles(good, 5) and not objects.tiles(good, 6)
    assert not objects.tiles(spark.createDataFrame([(0, 0, 3), (1, 2, 2)], "frag long, start long, n long"), 5)


def test_pyramid_invariants(spark, cloud):
    levels = [rows for rows, _ in pyramid.build_pyramid(cloud, (25.0,) * 3, [(2, 1.0), (2, 0.5)])]
    sizes = [cloud.count(), *(x.count() for x in levels)]
    assert sizes == sorted(sizes, reverse=True)
    ids = [{r["oid"] for r in x.select("oid").distinct().collect()} for x in (cloud, *levels)]
    assert ids[2] < ids[1] == ids[0] and len(ids[2]) == 8
    for x in levels:
        again = x.groupBy("oid").agg(F.array_sort(F.collect_list(F.struct("seq", "vid"))).alias("p")).collect()
        assert all(a["vid"] != b["vid"] for r in again for a, b in zip(r["p"], r["p"][1:], strict=False))


def test_sparsity_is_nested_and_never_empty(spark):
    objs = spark.range(1, 101).withColumnRenamed("id", "oid")
    half, tenth = ({r["oid"] for r in pyramid.sparsify(objs, s).collect()} for s in (0.5, 0.1))
    assert len(half) == 50 and len(tenth) == 10 and tenth < half
    assert pyramid.sparsify(objs.limit(1), 0.01).count() == 1
    with pytest.raises(pyramid.CoarseningError):
        pyramid.register_coarsen("per_object", lambda *a, **k: None)
    with pytest.raises(pyramid.CoarseningError):
        pyramid.coarsen(objs, (1.0,), method="nothing")


def test_coarsen_is_the_mean(spark, cloud):
    got = {(r["bx"], r["by"], r["bz"]): (r["x"], r["n_vertices"]) for r in pyramid.coarsen(cloud, (50.0,) * 3).collect()}
    rows = cloud.toPandas()
    key = [np.floor(rows[a] / 50.0).astype(int) for a in "xyz"]
    for k, part in rows.groupby(key):
        assert got[k][0] == pytest.approx(part.x.mean()) and got[k][1] == len(part)


def test_octree_leaves_partition_the_cells(spark):
    rng = np.random.default_rng(0)
    cells = [(int(a), int(b), int(c), int(w)) for a, b, c, w in zip(*rng.integers(0, 16, (3, 200)), rng.integers(1, 9, 200), strict=True)]
    df = spark.createDataFrame(cells, "i long, j long, k long, weight long")
    found = layout.leaves(df, 4, 40).collect()
    assert sum(r["weight"] for r in found) == sum(c[3] for c in cells)
    assert all(r["weight"] <= 40 or r["depth"] == 4 for r in found)
    placed = layout.in_leaf(df, layout.leaves(df, 4, 40), 4)
    assert placed.count() == len(cells)
    even = [(r["depth"], r["i"], r["j"], r["k"]) for r in layout.balance(layout.leaves(df, 4, 40), df, 4).collect()]
    assert layout.in_leaf(df, layout.balance(layout.leaves(df, 4, 40), df, 4), 4).count() == len(cells) and len(even) >= len(found)
    for d, *ijk in even:
        for e, *other in even:
            if e < d - 1:
                s = 4 - d, 4 - e
                gap = max(max((o << s[1]) - ((i + 1) << s[0]), (i << s[0]) - ((o + 1) << s[1])) for i, o in zip(ijk, other, strict=True))
                assert gap >= 0 and not (gap == 0), "touching leaves differ by more than a depth"


def test_addresses():
    assert layout.parse_address(layout.address(3, (1, 2, 5))) == (3, 1, 2, 5)
    assert layout.parse_address("111/001/010") == (3, 4, 5, 6)


def test_rechunk_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in range(40)] + [(None,)], "v double")
    counts = {r["bin"]: r["n"] for r in layout.rechunk_by_value(df, "v").groupBy("bin").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 10, 1: 10, 2: 10, 3: 10, None: 1}
    groups = spark.createDataFrame([(7, 0, [1, 2]), (9, 1, [2, 3])], "gid long, position long, members array<long>")
    objs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "oid long")
    assert {r["oid"]: r["bin"] for r in layout.rechunk_by_group(objs, groups).collect()} == {1: 0, 2: 1, 3: 1, 4: 2}


def test_suggest_chunk():
    assert layout.suggest_chunk(100, (8.0, 8.0), 100) == (8.0, 8.0)
    assert layout.suggest_chunk(1600, (8.0, 8.0), 100) == (2.0, 2.0)


def test_relabel_and_residues(spark):
    v = spark.range(8).withColumnRenamed("id", "vid")
    e = spark.createDataFrame([(0, 1), (1, 2), (5, 4), (6, 7), (7, 5)], "src long, dst long")
    assert {r["vid"]: r["oid"] for r in edits.relabel_by_links(v, e).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 4, 7: 4}
    assert edits.residues_disjoint((0, 4), (1, 4), (2, 4)) and not edits.residues_disjoint((0, 4), (2, 6))


def test_validation_finds_planted_faults(spark):
    v = spark.createDataFrame([(0, 0.5, 0), (1, float("nan"), 0), (2, 1.5, 0)], "vid long, x double, cx long")
    assert [r["detail"] for r in validate.not_finite(v, "x").collect()] == ["1"]
    assert "2" in [r["detail"] for r in validate.misplaced(v, (1.0,), "x").collect()]
    assert validate.conventions("mesh", {2, 3}, True) and not validate.conventions("mesh", {3}, True)


def test_nearest_in_cell_never_sorts_pairs(spark):
    rows = [(i, 0, float(i // 2 % 5)) for i in range(20)]
    v = spark.createDataFrame(rows, "vid long, cx long, x double")
    found = points.nearest_in_cell(v.selectExpr("vid AS tid", "cx", "x + 0.25 AS tx"), v, ("x",), others=True)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    expected = {i: min(((x + 0.25 - y) ** 2, j) for j, _, y in rows if j != i)[::-1] for i, _, x in rows}
    assert {r["tid"]: (r["vid"], r["d2"]) for r in found.collect()} == expected
