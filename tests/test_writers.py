"""Writers, readers and sessions on stored datasets: what SQL in the catalogue does not reach."""

import json

import pytest

from lattica.operators import edits, layout
from lattica.operators.edits import EditError, EditSession
from lattica.operators.points import Query, SelectionError, nearest_in_cell
from lattica.operators.validate import validate
from lattica.sources import levels, writers
from lattica.sources.store import Dataset, Log, Schema, StoreError, shared_folder
from lattica.streaming.ingest import ManifestAppender


@pytest.fixture()
def lines(spark, tmp_path):
    """Four objects of six vertices each, 2 apart, with manifests and links."""
    ds = Dataset.create(spark, f"file://{tmp_path}/ds", Schema("graph", ("x", "y"), (4.0, 4.0), (2.0, 2.0), attributes={"w": "float64"}))
    rows = [(o * 10 + k, o, k, 2.0 * k, 4.0 * o, float(k)) for o in range(4) for k in range(6)]
    links = spark.createDataFrame([(o * 10 + k, o * 10 + k + 1, 1.0) for o in range(4) for k in range(5)], "src long, dst long, c double")
    objects = spark.createDataFrame([(o, o / 2) for o in range(4)], "oid long, score double")
    ds.write_vertices(spark.createDataFrame(rows, "vid long, oid long, seq long, x double, y double, w double"), links=links, objects=objects, manifests=True)
    return ds


def state(ds):
    return {r["vid"]: r for r in ds.table("vertices").collect()}


def test_session_edits_everything_at_once(spark, lines):
    with EditSession(lines) as e:
        e.edit_vertex(1, position=(9.0, 9.0), attributes={"w": None})
        e.remove_vertex(12)
        e.add_link(3, 5, c=2.0)  # links of removed vertices go although another is added
        e.edit_link(0, 1, c=7.0)
        e.remove_object(3)
        e.add_object(8, [{"vid": 80, "x": 0.5, "y": 0.5, "w": 1.0}, {"vid": 81, "x": 1.0, "y": 0.5, "w": 1.0}], score=9.0)
        e.edit_object(2, [{"vid": 90, "x": 5.0, "y": 5.0, "w": 0.0}])
        e.edit_fragment((0, 0), 0, {"w": 55.0})
    now = state(lines)
    assert (now[1]["cx"], now[1]["cy"], now[1]["bin"], now[1]["w"]) == (2, 2, 0, None)
    assert now[0]["w"] == 55.0 and 12 not in now and {r["oid"] for r in now.values()} == {0, 1, 2, 8} and now[90]["oid"] == 2
    links = {(r["src"], r["dst"]): r["c"] for r in lines.table("links").collect()}
    assert links[0, 1] == 7.0 and links[3, 5] == 2.0 and (11, 12) not in links and (12, 13) not in links
    assert not any(20 <= a < 40 for ends in links for a in ends)
    assert {r["oid"]: r["score"] for r in lines.table("objects").collect()} == {0: 0.0, 1: 0.5, 2: 1.0, 3: 1.5, 8: 9.0}
    assert validate(lines).count() == 0
    named = {(r["oid"], r["cx"], r["cy"], r["frag"]) for r in lines.table("manifests").collect()}
    assert named == {(r["oid"], r["cx"], r["cy"], r["frag"]) for r in now.values()}


def test_fragments(spark, lines):
    with EditSession(lines) as e:
        e.split_fragment((0, 0), 0, [1])
        e.add_fragment(0, [{"vid": 70, "x": 0.1, "y": 0.1, "w": 0.0}, {"vid": 71, "x": 0.2, "y": 0.1, "w": 0.0}])
        with pytest.raises(EditError):
            e.add_fragment(0, [{"vid": 72, "x": 0.1, "y": 0.1}, {"vid": 73, "x": 9.0, "y": 0.1}])
    now = state(lines)
    assert now[0]["frag"] != now[1]["frag"] and now[70]["frag"] == now[71]["frag"] not in (now[0]["frag"], now[1]["frag"])
    assert [now[v]["seq"] for v in (5, 70, 71)] == [5, 6, 7] and validate(lines).count() == 0
    with EditSession(lines) as e:
        e.remove_fragment((0, 0), now[70]["frag"])
    assert 70 not in state(lines) and validate(lines).count() == 0


def test_copy_on_write_keeps_the_old_object(spark, lines):
    e = EditSession(lines, copy_on_write=True)
    e.edit_vertex(2, position=(0.0, 0.0))
    report = e.flush()
    now = state(lines)
    assert report.remap == {0: 4} and now[2]["x"] == 4.0
    copies = sorted((r for r in now.values() if r["oid"] == 4), key=lambda r: r["seq"])
    assert [r["x"] for r in copies] == [0.0, 2.0, 0.0, 6.0, 8.0, 10.0] and len(now) == 30


def test_links_join_and_cut_objects(spark, lines):
    with EditSession(lines) as e:
        e.add_link(5, 10, update_objects=True)
        e.remove_link(22, 23, update_objects=True)
    now = state(lines)
    assert {now[v]["oid"] for v in (0, 5, 10, 15)} == {0} and now[20]["oid"] == 2 and now[23]["oid"] == now[25]["oid"] not in (0, 1, 2, 3)
    assert e.report.remap[1] == 0
    with EditSession(lines) as e:
        e.add_cross_link((((0, 0), 0), ((2, 0), 4)))
        with pytest.raises(EditError):
            e.remove_cross_link((((0, 0), 0), ((0, 0), 1)))
    assert lines.table("links").where("src = 0 and dst = 4").count() == 1


def test_edits_of_coarse_levels(spark, lines):
    levels.build_pyramid(lines, [(2, 1.0), (2, 1.0)], depth=-1, mirrored=True)
    assert validate(lines).count() == 0
    assert [lines.grid(k)[0] for k in range(3)] == [(4.0, 4.0), (8.0, 8.0), (16.0, 16.0)]
    before = {k: sorted(map(str, lines.table("vertices", level=k).collect())) for k in (1, 2)}
    with EditSession(lines) as e:
        e.edit_vertex(1, position=(3.5, 0.5))
    assert {k: sorted(map(str, lines.table("vertices", level=k).collect())) for k in (1, 2)} == before
    places = lines.snapshot()["tables"]["vertices"]
    assert len({p.split("/")[1] for p in places}) == 2  # levels 1 and 2 lie where they lay
    for k in range(3):
        rows = lines.table("vertices", level=k)
        inside = rows.where("x between 1 and 7 and y between 0 and 9").count()
        assert lines.level(k).select(box=((1, 0), (7, 9))).count() == inside > 0
    levels.refresh_pyramid(lines, 1)
    levels.refresh_pyramid(lines)
    assert validate(lines).count() == 0
    lines.remove_level(2)
    assert lines.snapshot()["levels"] == [0, 1] and lines.table("parents").where("level + delta > 1").count() == 0
    assert lines.level_near_scale(7.0) == 1


def test_one_of_two_writers_wins(spark, lines):
    log = Log(lines.files, "log/CURRENT")
    number, head = log.head()
    assert log.append(number + 1, head | {"message": "one"}) and not log.append(number + 1, head | {"message": "two"})
    assert lines.snapshot()["message"] == "one"
    stale = EditSession(lines)
    lines.commit({"groups": spark.createDataFrame([(1, [0, 1])], "gid long, members array<long>")})
    stale.remove_vertex(0)
    with pytest.raises(StoreError):
        stale.flush()


def test_vacuum_renames_everywhere(spark, lines):
    lines.commit({"groups": spark.createDataFrame([(1, [0, 3])], "gid long, members array<long>")})
    with EditSession(lines) as e:
        e.remove_object(1)
    assert edits.vacuum(lines, dry_run=True)["live"] == 3 and {r["oid"] for r in lines.table("vertices").collect()} == {0, 2, 3}
    found = edits.vacuum(lines)
    assert {r["oid"]: r["new_oid"] for r in found["remap"].collect()} == {0: 0, 2: 1, 3: 2} and found["unreferenced"].count() == 0
    assert {r["oid"] for r in lines.table("vertices").collect()} == {0, 1, 2} == {r["oid"] for r in lines.table("objects").collect()}
    assert lines.table("groups").first()["members"] == [0, 2] and validate(lines).count() == 0


def test_selection_details(spark, lines):
    lines.commit({"groups": spark.createDataFrame([(1, [0, 3])], "gid long, members array<long>")})
    q = lines.level()
    assert [r["oid"] for r in q.select(objects=(3, 1)).in_request_order().collect()] == [3] * 6 + [1] * 6
    with pytest.raises(SelectionError):
        q.select(groups=(1, 2)).dataframe()
    assert q.select(limit=5).truncated() and not q.select(limit=24).truncated()
    big = q.select(limit=7)
    assert [r["vid"] for r in big._leading(q.vertices, 1).orderBy(*q.order).limit(7).collect()] == [r["vid"] for r in big.dataframe().collect()]
    assert q.cost()["files"] >= 1 and q.select(cells=()).count() == 0
    assert q.select(cells=((0, 0), (1, 1))).count() == 4 and q.select(near=((0, 0), 2.0)).cells().count() == 1
    for lo, hi in (((0, 0), (1, 1)), ((1, 1), (7, 9)), ((2.5, 4.5), (3.5, 6.0))):
        assert q.select(box=(lo, hi)).count() == Query(q.vertices, axes=("x", "y")).select(box=(lo, hi)).count()
    targets = spark.createDataFrame([(0, 0, 0, 0.1, 0.0)], "tid long, cx long, cy long, tx double, ty double")
    assert nearest_in_cell(targets, q.vertices, ("x", "y"), tol=0.5).first()["vid"] == 0
    with pytest.raises(Exception, match="no vertex near"):
        nearest_in_cell(targets, q.vertices, ("x", "y"), tol=0.01).collect()


def test_writers_refuse(spark, tmp_path):
    make = lambda kind, **k: Dataset.create(spark, f"file://{tmp_path}/{kind}", Schema(kind, ("x",), (4.0,), **k))
    v = spark.createDataFrame([(i, i // 3, i, float(i), "a" if i < 5 else "b") for i in range(6)], "vid long, oid long, seq long, x double, k string")
    face = lambda *rows: spark.createDataFrame(list(rows), "face long, ends array<long>")
    mesh = make("mesh", chunk_by="k")
    for bad in (face((1, [0, 1])), face((1, [0, 1, 77])), face((1, [0, 1, 2]))):
        with pytest.raises(writers.GeometryError):
            writers.write_mesh(mesh, v, bad)
    pairs = lambda *rows: spark.createDataFrame(list(rows), "child long, parent long")
    skeleton = make("skeleton")
    for bad in (pairs((1, 0), (4, 3), (5, 3)), pairs((1, 0), (2, 0), (4, 3), (5, 2)), pairs((1, 9), (2, 0))):
        with pytest.raises(writers.GeometryError):
            writers.write_skeleton(skeleton, v, bad)
    with pytest.raises(StoreError):
        make("polyline", bounds=((0.0,), (3.0,))).write_vertices(v, out_of_bounds="ignore")
    with pytest.raises(writers.GeometryError):
        writers.write_parametric(make("parametric"), spark.createDataFrame([(1, "p", "line", [0.0] * 6), (2, "p", "line", [0.0] * 6)], "id long, name string, type string, coefficients array<double>"))


def test_skeleton_stream_and_composite(spark, tmp_path):
    ds = Dataset.create(spark, f"file://{tmp_path}/sk", Schema("skeleton", ("x",), (4.0,)))
    stream = writers.SkeletonStream(ds, f"file://{tmp_path}/work")
    v = spark.createDataFrame([(i, 0, i, float(i)) for i in range(8)], "vid long, oid long, seq long, x double")
    stream.write_chunk(v.where("x < 4"), 0)
    stream.write_chunk(v.where("x >= 4"), 1)
    stream.write_cross_links(spark.createDataFrame([(4, 3)], "src long, dst long"), 0)
    stream.finalize()
    assert ds.user("counts") == {"vertices": 8, "objects": 1, "links": 1, "cross_links": True} and ds.level().count() == 8
    both = writers.Composite(ds)
    both.add("mesh", {"vertices": v})
    found, errors = both.read(["mesh", "line"])
    assert found["mesh"]["vertices"].count() == 8 and "line" in errors
    with pytest.raises(StoreError):
        both.add("mesh", {"vertices": v})


def test_octree_reads(spark):
    rows = [(i, i % 3, float(i % 16), float(i // 16), 0.0) for i in range(256)]
    v = spark.createDataFrame(rows, "vid long, oid long, x double, y double, z double")
    cells = v.selectExpr("cast(x as bigint) i", "cast(y as bigint) j", "0L k", "1L weight")
    links = spark.createDataFrame([(i, i + 1) for i in range(255)], "src long, dst long")
    level = writers.OctreeLevel(v, layout.leaves(cells, 4, 16), 4, (1.0,) * 3, links=links)
    box = ((3, 3, 0), (9, 6, 0))
    kept, inside = level.read_graph(box=box, object_ids=[1])
    ids = {i for i, o, x, y, _ in rows if o == 1 and 3 <= x <= 9 and 3 <= y <= 6}
    assert {r["vid"] for r in kept.collect()} == ids and inside.count() == 0
    key = level.leaves.orderBy("key").first()["key"]
    one, more = level.read_points(leaves=[key]), level.read_points(leaves=[key], halo=True)
    assert one.count() == 16 < more.count() and level.seams(key).count() > 0
    with pytest.raises(writers.OctreeError):
        level.read_points(chunks=[(0, 0, 0)])


def test_manifest_appender_resumes(spark, tmp_path):
    df = lambda *rows: spark.createDataFrame(list(rows), "oid long, seq long")
    root, seen = f"file://{tmp_path}/m", []
    first = ManifestAppender(spark, root, observer=lambda k, n: seen.append((k, n)))
    first.write(df((0, 0), (1, 0), (1, 1)), 0)
    again = ManifestAppender(spark, root, base_oid=1)
    again.write(df((1, 0), (2, 0)), 1)
    assert {r["oid"]: r["n_fragments"] for r in again.lengths().collect()} == {0: 1, 1: 1, 2: 1} and seen == [(0, 3)]
    assert json.loads(again.files.read("marks/0"))["rows"] == 3


def test_no_machine_local_folder_on_a_cluster():
    class Session:
        def __init__(self, master, folder=None):
            self.conf = type("Conf", (), {"get": lambda _, key, default: folder})()
            self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})()

    with pytest.raises(StoreError, match="checkpoint"):
        shared_folder(Session("spark://host:7077"))
    with pytest.raises(StoreError, match="checkpoint"):
        shared_folder(Session("local-cluster[3,2,3000]"))
    assert shared_folder(Session("yarn", "hdfs:///work/")) == "hdfs:///work"
    assert shared_folder(Session("local[4]")) == shared_folder(Session("local[4]"))
