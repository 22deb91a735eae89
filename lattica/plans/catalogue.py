"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions import grid
from lattica.operators import edits, layout, links, objects, paths, points, pyramid, readers, validate
from lattica.sources import levels, store, writers
from lattica.streaming import ingest

from . import frames as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The frames of frames.py in SQL.
LARGE = """large AS (SELECT l_orderkey AS oid, CAST(l_linenumber AS BIGINT) AS seq, l_partkey AS part, l_quantity AS x, l_discount * 100.0::DOUBLE AS y,
  l_tax * 100.0::DOUBLE AS z, l_returnflag AS flag, l_extendedprice AS price, CAST(floor(l_quantity / 10.0::DOUBLE) AS BIGINT) AS cx,
  CAST(floor(l_discount * 100.0::DOUBLE / 2.0::DOUBLE) AS BIGINT) AS cy, CAST(floor(l_tax * 100.0::DOUBLE / 2.0::DOUBLE) AS BIGINT) AS cz FROM lineitem)"""
DENSE = """dense AS (SELECT *, CAST(floor(x / 0.05::DOUBLE) AS BIGINT) AS cx, CAST(floor(y / 0.05::DOUBLE) AS BIGINT) AS cy, CAST(floor(z / 0.05::DOUBLE) AS BIGINT) AS cz
  FROM (SELECT vec_id AS vid, CAST(label AS BIGINT) AS oid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings))"""
STREAM = """stream AS (SELECT *, CAST(floor(x / 5.0::DOUBLE) AS BIGINT) AS cx, CAST(floor(y / 6.0::DOUBLE) AS BIGINT) AS cy
  FROM (SELECT event_id AS vid, user_id AS oid, ts, value AS x, CAST(hour(ts) AS DOUBLE) AS y, event_type AS kind FROM events))"""
SPLIT = (
    STREAM
    + """, flagged AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN lag(cx) OVER w = cx AND lag(cy) OVER w = cy THEN 0 ELSE 1 END AS moved
  FROM stream WINDOW w AS (PARTITION BY oid ORDER BY ts, vid)),
  split AS (SELECT *, CAST(sum(moved) OVER (PARTITION BY oid ORDER BY ts, vid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM flagged)"""
)
LINES = """lines AS (SELECT o_orderkey AS oid, c_acctbal AS ax, CAST(c_nationkey AS DOUBLE) AS ay, o_totalprice AS bx, CAST(c_nationkey AS DOUBLE) AS by
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
NODES = """nodes AS (SELECT *, CAST(floor(x / 1000.0::DOUBLE) AS BIGINT) AS cx, CAST(floor(y / 5.0::DOUBLE) AS BIGINT) AS cy FROM (
  SELECT c_custkey * 2 AS vid, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer UNION ALL
  SELECT s_suppkey * 2 + 1, s_acctbal, CAST(s_nationkey AS DOUBLE) FROM supplier)),
  edges AS (SELECT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst, count(*) AS n_items FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
MESH = """verts AS (SELECT *, CAST(floor(x / 10.0::DOUBLE) AS BIGINT) AS cx, CAST(floor(y / 100.0::DOUBLE) AS BIGINT) AS cy
  FROM (SELECT p_partkey AS vid, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part)),
  ends AS (SELECT face, unnest([a, b, c]) AS v FROM (SELECT l_orderkey * 100 + row_number() OVER w AS face, l_partkey AS a, lead(l_partkey, 1) OVER w AS b, lead(l_partkey, 2) OVER w AS c
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) WHERE c IS NOT NULL),
  faces AS (SELECT face, count(*) AS n FROM ends GROUP BY face)"""
TREE = """tree AS (SELECT CAST(r_regionkey AS BIGINT) AS oid, CAST(r_regionkey AS BIGINT) AS child, CAST(NULL AS BIGINT) AS parent FROM region UNION ALL
  SELECT n_regionkey, n_nationkey + 100, n_regionkey FROM nation UNION ALL
  SELECT n_regionkey, c_custkey + 1000, c_nationkey + 100 FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL
  SELECT n_regionkey, o_orderkey + 10000000000, c_custkey + 1000 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
  walk AS (SELECT t.oid, t.child, t.parent, row_number() OVER (PARTITION BY t.oid ORDER BY
    CASE WHEN t.child < 100 THEN -1 WHEN t.child < 1000 THEN t.child WHEN t.child < 10000000000 THEN t.parent ELSE p.parent END,
    CASE WHEN t.child < 1000 THEN -1 WHEN t.child < 10000000000 THEN t.child ELSE t.parent END,
    CASE WHEN t.child < 10000000000 THEN -1 ELSE t.child END) - 1 AS rank FROM tree t LEFT JOIN tree p ON t.parent = p.child)"""
BOX_LARGE = "x BETWEEN 10 AND 30 AND y BETWEEN 2 AND 6 AND z BETWEEN 0 AND 4"
LO, HI = (10.0, 2.0, 0.0), (30.0, 6.0, 4.0)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def _large(spark, d) -> points.Query:
    return points.Query(V.large_points(spark, d), sizes=V.CELL_LARGE, order=("oid", "seq", "part"), groups=V.brand_groups(spark, d))


def _dense(spark, d) -> points.Query:
    return points.Query(V.dense_points(spark, d), sizes=V.CELL_DENSE)


# Points


@query("points_bbox", f"WITH {LARGE} SELECT oid, seq, part, x, y, z, price FROM large WHERE {BOX_LARGE}")
def points_bbox(spark, d):
    return _large(spark, d).select(box=(LO, HI)).dataframe().select("oid", "seq", "part", "x", "y", "z", "price")


@query("points_near", f"WITH {DENSE} SELECT vid, oid FROM dense WHERE (x-0.0::DOUBLE)*(x-0.0::DOUBLE)+(y-0.05::DOUBLE)*(y-0.05::DOUBLE)+(z-0.0::DOUBLE)*(z-0.0::DOUBLE) <= 0.15::DOUBLE*0.15::DOUBLE")
def points_near(spark, d):
    return _dense(spark, d).select(near=((0.0, 0.05, 0.0), 0.15)).dataframe().select("vid", "oid")


@query("points_by_object", f"WITH {LARGE} SELECT oid, seq, part, x FROM large WHERE oid IN (7, 3, 11, 100, 99999999)")
def points_by_object(spark, d):
    return _large(spark, d).select(objects=(7, 3, 11, 100, 99999999)).dataframe().select("oid", "seq", "part", "x")


@query("points_by_group", "SELECT l_partkey AS oid, l_orderkey AS ord, l_quantity AS x FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN ('Brand#2', 'Brand#17')")
def points_by_group(spark, d):
    vertices = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("oid"), F.col("l_orderkey").alias("ord"), F.col("l_quantity").alias("x"))
    return points.Query(vertices, axes=("x",), groups=V.brand_groups(spark, d)).select(groups=(2, 17)).dataframe()


@query("points_where", f"WITH {LARGE} SELECT oid, seq, part, price FROM large WHERE flag = 'R' AND {BOX_LARGE}")
def points_where(spark, d):
    return _large(spark, d).select(where={"flag": "R"}).select(box=(LO, HI)).dataframe().select("oid", "seq", "part", "price")


@query("points_bbox_and_object", f"WITH {LARGE} SELECT oid, seq, part FROM large WHERE {BOX_LARGE} AND oid BETWEEN 100 AND 399")
def points_bbox_and_object(spark, d):
    return _large(spark, d).select(objects=range(400)).select(box=(LO, HI), objects=range(100, 1500)).dataframe().select("oid", "seq", "part")


@query("points_cells", f"WITH {LARGE} SELECT oid, seq, part, cx, cy, cz FROM large WHERE (cx, cy, cz) IN ((1, 2, 1), (3, 0, 0))")
def points_cells(spark, d):
    return _large(spark, d).select(cells=((1, 2, 1), (3, 0, 0))).dataframe().select("oid", "seq", "part", "cx", "cy", "cz")


@query("points_projection", f"WITH {DENSE} SELECT vid, oid, x, y, z, cx, cy, cz FROM dense WHERE oid = 3")
def points_projection(spark, d):
    return _dense(spark, d).select(objects=[3], attributes=()).dataframe()


@query("points_limit_ordered", f"WITH {DENSE} SELECT vid, oid FROM dense WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -1 AND 1 AND z BETWEEN -1 AND 1 ORDER BY vid LIMIT 25")
def points_limit_ordered(spark, d):
    return _dense(spark, d).select(box=((-0.1, -1, -1), (0.1, 1, 1)), limit=40).select(limit=25).dataframe().select("vid", "oid")


@query("points_count", f"WITH {LARGE} SELECT count(*) AS n FROM large WHERE {BOX_LARGE}")
def points_count(spark, d):
    return _large(spark, d).select(box=(LO, HI)).dataframe().agg(F.count("*").alias("n"))


@query("points_object_ids", f"WITH {LARGE} SELECT DISTINCT oid FROM large WHERE {BOX_LARGE} AND flag = 'A'")
def points_object_ids(spark, d):
    return _large(spark, d).select(box=(LO, HI), where={"flag": "A"}).object_ids()


@query("points_general_predicate", f"WITH {LARGE} SELECT oid, seq, part FROM large WHERE price > 50000 AND x + y > 50")
def points_general_predicate(spark, d):
    return V.large_points(spark, d).where((F.col("price") > 50000) & (F.col("x") + F.col("y") > 50)).select("oid", "seq", "part")


@query("occupied_cells", f"WITH {LARGE} SELECT cx, cy, cz, count(*) AS n_vertices, count(DISTINCT oid) AS n_objects FROM large GROUP BY ALL")
def occupied_cells(spark, d):
    return points.occupied(V.large_points(spark, d))


@query("cells_in_box", f"WITH {LARGE} SELECT DISTINCT cx, cy, cz FROM large WHERE cx BETWEEN 1 AND 3 AND cy BETWEEN 1 AND 3 AND cz BETWEEN 0 AND 2")
def cells_in_box(spark, d):
    return _large(spark, d).select(box=(LO, HI)).cells()


@query("read_cells_in_order", f"WITH {DENSE} SELECT r.pos, d.vid FROM dense d JOIN (VALUES (0, 0, 0, 0), (1, -1, 0, 0), (2, 0, 0, 0), (3, 99, 0, 0)) r(pos, cx, cy, cz) USING (cx, cy, cz)")
def read_cells_in_order(spark, d):
    keys = spark.createDataFrame([(0, 0, 0, 0), (1, -1, 0, 0), (2, 0, 0, 0), (3, 99, 0, 0)], "pos int, cx long, cy long, cz long")
    return points.read_cells(V.dense_points(spark, d), keys).select("pos", "vid")


@query("neighbour_cells", f"WITH {DENSE}, c AS (SELECT DISTINCT cx, cy, cz FROM dense) SELECT a.cx, a.cy, a.cz, b.cx AS nx, b.cy AS ny, b.cz AS nz FROM c a JOIN c b ON abs(a.cx-b.cx) <= 1 AND abs(a.cy-b.cy) <= 1 AND abs(a.cz-b.cz) <= 1")
def neighbour_cells(spark, d):
    return points.neighbours(V.dense_points(spark, d))


@query("nearest_in_chunk", f"WITH {DENSE} SELECT t.vid AS tid, min_by(v.vid, (v.x-t.x)*(v.x-t.x)+(v.y-t.y)*(v.y-t.y)+(v.z-t.z)*(v.z-t.z)) AS vid FROM dense t JOIN dense v USING (cx, cy, cz) WHERE v.vid <> t.vid GROUP BY t.vid")
def nearest_in_chunk(spark, d):
    dense = V.dense_points(spark, d)
    targets = dense.select(F.col("vid").alias("tid"), "cx", "cy", "cz", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))
    return points.nearest_in_cell(targets, dense, others=True).select("tid", "vid")


@query("nearest_vertex", f"WITH {DENSE}, t(tid, tx, ty, tz) AS (VALUES (0, 0.01::DOUBLE, 0.01::DOUBLE, 0.01::DOUBLE), (1, -0.02::DOUBLE, 0.03::DOUBLE, 0.04::DOUBLE), (2, 9.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE)) SELECT tid, min_by(vid, (x-tx)*(x-tx)+(y-ty)*(y-ty)+(z-tz)*(z-tz)) AS vid FROM t JOIN dense ON cx = floor(tx/0.05::DOUBLE) AND cy = floor(ty/0.05::DOUBLE) AND cz = floor(tz/0.05::DOUBLE) GROUP BY tid")
def nearest_vertex(spark, d):
    targets = spark.createDataFrame([(0, 0.01, 0.01, 0.01), (1, -0.02, 0.03, 0.04), (2, 9.0, 0.0, 0.0)], "tid int, tx double, ty double, tz double")
    placed = targets.select("*", *(grid.cell("t" + a, s).alias("c" + a) for a, s in zip("xyz", V.CELL_DENSE, strict=True)))
    return points.nearest_in_cell(placed, V.dense_points(spark, d)).select("tid", "vid")


@query("bounds", f"WITH {DENSE} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM dense")
def bounds(spark, d):
    return points.bounds(V.dense_points(spark, d))


@query("out_of_bounds_ignore", f"WITH {DENSE} SELECT vid FROM dense WHERE x BETWEEN -0.2 AND 0.2 AND y BETWEEN -0.2 AND 0.2 AND z BETWEEN -0.2 AND 0.2")
def out_of_bounds_ignore(spark, d):
    return points.clip(V.dense_points(spark, d), (-0.2,) * 3, (0.2,) * 3, "ignore").select("vid")


# Chunks, bins, fragments, objects


@query("chunk_assign", f"WITH {DENSE} SELECT vid, cx, cy, cz FROM dense")
def chunk_assign(spark, d):
    return V.dense_points(spark, d).select("vid", "cx", "cy", "cz")


@query("bin_fragment_index", f"WITH {DENSE}, b AS (SELECT vid, CAST(floor(x/0.025::DOUBLE) AS BIGINT) AS bx, CAST(floor(y/0.025::DOUBLE) AS BIGINT) AS \"by\", CAST(floor(z/0.025::DOUBLE) AS BIGINT) AS bz FROM dense) SELECT vid, (((bx % 2) + 2) % 2 * 2 + ((\"by\" % 2) + 2) % 2) * 2 + ((bz % 2) + 2) % 2 AS bin FROM b")
def bin_fragment_index(spark, d):
    return V.dense_points(spark, d).select("vid", grid.local_bin(grid.AXES, V.CELL_DENSE, (0.025,) * 3).alias("bin"))


@query("dense_attr_bins", f"WITH {LARGE} SELECT flag, dense_rank() OVER (ORDER BY flag) - 1 AS code, count(*) AS n FROM large GROUP BY flag")
def dense_attr_bins(spark, d):
    coded, _ = points.encode_categories(V.large_points(spark, d), "flag")
    return coded.groupBy("flag", "code").agg(F.count("*").alias("n"))


@query("fragment_rank", f"WITH {DENSE} SELECT vid, dense_rank() OVER (PARTITION BY cx, cy, cz ORDER BY oid) - 1 AS frag FROM dense")
def fragment_rank(spark, d):
    return objects.fragment_rank(V.dense_points(spark, d)).select("vid", "frag")


MANIFEST = f"WITH {DENSE}, ranked AS (SELECT *, dense_rank() OVER (PARTITION BY cx, cy, cz ORDER BY oid) - 1 AS frag FROM dense), man AS (SELECT oid, cx, cy, cz, frag, row_number() OVER (PARTITION BY oid ORDER BY cx, cy, cz, frag) - 1 AS seq FROM (SELECT DISTINCT oid, cx, cy, cz, frag FROM ranked))"


@query("object_manifest", MANIFEST + " SELECT oid, seq, cx, cy, cz, frag FROM man")
def object_manifest(spark, d):
    return objects.object_manifest(objects.fragment_rank(V.dense_points(spark, d))).select("oid", "seq", "cx", "cy", "cz", "frag")


@query("manifest_join", MANIFEST + " SELECT man.oid, man.seq, ranked.vid FROM man JOIN ranked USING (cx, cy, cz, frag)")
def manifest_join(spark, d):
    ranked = objects.fragment_rank(V.dense_points(spark, d))
    return objects.in_object_order(objects.object_manifest(ranked), ranked).select("oid", "seq", "vid")


@query("object_touches_cells", MANIFEST + " SELECT DISTINCT oid FROM man WHERE cx = 0 AND cy = 0 AND cz IN (0, 1)")
def object_touches_cells(spark, d):
    wanted = spark.createDataFrame([(0, 0, 0), (0, 0, 1)], "cx long, cy long, cz long")
    return objects.touching_cells(objects.object_manifest(objects.fragment_rank(V.dense_points(spark, d))), wanted)


@query("vertex_by_index", f"WITH {STREAM} SELECT oid, vid FROM (SELECT oid, vid, row_number() OVER (PARTITION BY oid ORDER BY ts, vid) AS n FROM stream) WHERE n = 3")
def vertex_by_index(spark, d):
    return objects.vertex_at(V.streamlines(spark, d), 2, order=V.ORDER).select("oid", "vid")


@query("fragment_owner", f"WITH {LARGE} SELECT cx, cy, cz, part % 3 AS frag, CASE WHEN count(DISTINCT oid) > 1 THEN -2 ELSE min(oid) END AS owner FROM large GROUP BY ALL")
def fragment_owner(spark, d):
    return objects.fragment_owner(V.large_points(spark, d).withColumn("frag", F.col("part") % 3).select("oid", "cx", "cy", "cz", "frag").distinct())


@query("row_offsets", f"WITH {LARGE}, n AS (SELECT cx, cy, cz, count(*) AS n_rows FROM large GROUP BY ALL) SELECT cx, cy, cz, n_rows, CAST(coalesce(sum(n_rows) OVER (ORDER BY cx, cy, cz ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM n")
def row_offsets(spark, d):
    return objects.row_offsets(V.large_points(spark, d))


@query("object_counts", "SELECT count(*) AS slots, count(l.l_orderkey) AS present FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45) l ON l_orderkey = o_orderkey")
def object_counts(spark, d):
    slots = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("oid"))
    held = objects.catalogue(slots, V.large_points(spark, d).where("x > 45"))
    return held.agg(F.count("*").alias("slots"), F.sum(F.col("present").cast("long")).alias("present"))


@query("group_members", "SELECT CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS gid, p_partkey AS oid FROM part WHERE p_brand IN ('Brand#1', 'Brand#3')")
def group_members(spark, d):
    return objects.group_members(V.brand_groups(spark, d), [1, 3])


@query("global_row_numbers", "SELECT o_orderkey AS oid, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row FROM orders")
def global_row_numbers(spark, d):
    rows = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("oid"), "o_totalprice")
    return points.number_rows(rows, ["o_totalprice", "oid"], "row").select("oid", "row")


@query("ragged_fragments", "SELECT s_suppkey AS frag, CAST(i AS BIGINT) AS \"row\" FROM supplier, unnest(range(s_suppkey * 10, s_suppkey * 10 + s_nationkey)) AS t(i)")
def ragged_fragments(spark, d):
    rows = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("frag"), (F.col("s_suppkey") * 10).alias("start"), F.col("s_nationkey").cast("long").alias("n"), F.lit(None).cast("array<long>").alias("rows"))
    return objects.fragment_rows(rows).select("frag", "row")


# Lines and polylines


@query("lines_bbox_either_endpoint", f"WITH {LINES} SELECT oid, ax, ay, bx, \"by\" FROM lines WHERE (ax BETWEEN 0 AND 1000 AND ay BETWEEN 3 AND 9) OR (bx BETWEEN 0 AND 1000 AND \"by\" BETWEEN 3 AND 9)")
def lines_bbox_either_endpoint(spark, d):
    return paths.lines_in_box(V.lines(spark, d), (0, 3), (1000, 9), "xy")


@query("lines_cross_chunk", f"WITH {LINES} SELECT oid FROM lines WHERE floor(ax/50000.0::DOUBLE) <> floor(bx/50000.0::DOUBLE)")
def lines_cross_chunk(spark, d):
    ends = paths.line_vertices(V.lines(spark, d), "xy").select("oid", "seq", grid.cell("x", 50000.0).alias("cx"))
    return paths.bridges(ends.withColumn("vid", F.col("oid") * 2 + F.col("seq")), ["cx"]).select("oid")


@query("line_endpoints", f"WITH {STREAM} SELECT oid, arg_min(x, seq) AS ax, arg_min(y, seq) AS ay, arg_max(x, seq) AS bx, arg_max(y, seq) AS \"by\" FROM (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY ts, vid) AS seq FROM stream) GROUP BY oid HAVING count(*) >= 2")
def line_endpoints(spark, d):
    w = W.partitionBy("oid").orderBy(*V.ORDER)
    return paths.endpoints(V.streamlines(spark, d).withColumn("seq", F.row_number().over(w)), "xy")


@query("polyline_split", f"WITH {SPLIT} SELECT oid, vid, segment FROM split")
def polyline_split(spark, d):
    return paths.split_at_cells(V.streamlines(spark, d), ("cx", "cy"), order=V.ORDER).select("oid", "vid", "segment")


@query("polyline_manifest", f"WITH {SPLIT} SELECT oid, segment AS seq, min(cx) AS cx, min(cy) AS cy, count(*) AS n_vertices FROM split GROUP BY oid, segment")
def polyline_manifest(spark, d):
    return paths.manifest(paths.split_at_cells(V.streamlines(spark, d), ("cx", "cy"), order=V.ORDER), ("cx", "cy"))


@query("polyline_bridges", f"WITH {STREAM} SELECT oid, src, dst FROM (SELECT oid, vid AS src, lead(vid) OVER w AS dst, cx, cy, lead(cx) OVER w AS nx, lead(cy) OVER w AS ny FROM stream WINDOW w AS (PARTITION BY oid ORDER BY ts, vid)) WHERE dst IS NOT NULL AND (nx <> cx OR ny <> cy)")
def polyline_bridges(spark, d):
    return paths.bridges(V.streamlines(spark, d), ("cx", "cy"), order=V.ORDER)


@query("polyline_bbox_chunk_rule", f"WITH {STREAM} SELECT oid, vid FROM stream WHERE oid IN (SELECT oid FROM stream WHERE cx BETWEEN 20 AND 24 AND cy BETWEEN 0 AND 0)")
def polyline_bbox_chunk_rule(spark, d):
    touched = grid.box_cells((101.0, 0.0), (123.0, 5.0), V.CELL_STREAM, "xy")
    return paths.whole_in_cells(V.streamlines(spark, d), touched).select("oid", "vid")


@query("polyline_crop_runs", f"WITH {STREAM}, f AS (SELECT *, cx <= 1 AS inside FROM stream), g AS (SELECT *, CASE WHEN inside AND NOT coalesce(lag(inside) OVER (PARTITION BY oid ORDER BY ts, vid), false) THEN 1 ELSE 0 END AS begins FROM f), r AS (SELECT *, CAST(sum(begins) OVER (PARTITION BY oid ORDER BY ts, vid ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS part FROM g) SELECT oid, vid, part FROM r WHERE inside")
def polyline_crop_runs(spark, d):
    return paths.crop(V.streamlines(spark, d), F.col("cx") <= 1, order=V.ORDER).select("oid", "vid", "part")


LENGTH = f"WITH {STREAM}, s AS (SELECT oid, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step FROM stream WINDOW w AS (PARTITION BY oid ORDER BY ts, vid)), l AS (SELECT oid, round(coalesce(sum(step), 0), 4) AS length, count(*) AS n_vertices FROM s GROUP BY oid)"


@query("polyline_path_length", LENGTH + " SELECT * FROM l")
def polyline_path_length(spark, d):
    return paths.lengths(V.streamlines(spark, d), "xy", order=V.ORDER).withColumn("length", F.round("length", 4))


@query("polyline_length_range", LENGTH + " SELECT oid FROM l WHERE length BETWEEN 500 AND 2000")
def polyline_length_range(spark, d):
    return paths.between_lengths(V.streamlines(spark, d), 500.0, 2000.0, axes="xy", order=V.ORDER).select("oid")


@query("polyline_assembled", f"WITH {STREAM} SELECT oid, count(*) AS n, list_first(list(vid ORDER BY ts, vid)) AS head, list_last(list(vid ORDER BY ts, vid)) AS tail FROM stream GROUP BY oid")
def polyline_assembled(spark, d):
    whole = paths.assembled(V.streamlines(spark, d), ("x", "y"), order=V.ORDER)
    return whole.select("oid", F.size("path").cast("long").alias("n"), F.col("path")[0]["vid"].alias("head"), F.element_at("path", -1)["vid"].alias("tail"))


@query("path_sequential_edges", f"WITH {STREAM} SELECT * FROM (SELECT oid, vid AS child, lag(vid) OVER (PARTITION BY oid ORDER BY ts, vid) AS parent FROM stream) WHERE parent IS NOT NULL")
def path_sequential_edges(spark, d):
    return paths.sequential_edges(V.streamlines(spark, d), order=V.ORDER)


# Links


@query("graph_induced_bbox", f"WITH {NODES}, n AS (SELECT vid FROM nodes WHERE x BETWEEN 0 AND 5000 AND y BETWEEN 0 AND 12) SELECT src, dst, n_items FROM edges WHERE src IN (SELECT vid FROM n) AND dst IN (SELECT vid FROM n)")
def graph_induced_bbox(spark, d):
    kept = V.graph_nodes(spark, d).where(grid.in_box((0, 0), (5000, 12), "xy"))
    return links.induced(kept, V.graph_edges(spark, d))


@query("graph_touching", f"WITH {NODES}, n AS (SELECT vid FROM nodes WHERE x < 0) SELECT src, dst, n_items FROM edges WHERE src IN (SELECT vid FROM n) OR dst IN (SELECT vid FROM n)")
def graph_touching(spark, d):
    return links.touching(V.graph_nodes(spark, d).where("x < 0"), V.graph_edges(spark, d))


@query("graph_intra_cross_partition", f"WITH {NODES} SELECT a.cx = b.cx AND a.cy = b.cy AS intra, b.cx - a.cx AS ox, b.cy - a.cy AS oy, count(*) AS n FROM edges JOIN nodes a ON src = a.vid JOIN nodes b ON dst = b.vid GROUP BY ALL")
def graph_intra_cross_partition(spark, d):
    cut = links.partition_links(V.graph_edges(spark, d), V.graph_nodes(spark, d), ("cx", "cy"))
    return cut.groupBy("intra", "ox", "oy").agg(F.count("*").alias("n"))


@query("graph_degree", f"WITH {NODES} SELECT vid, count(*) AS degree FROM (SELECT src AS vid FROM edges UNION ALL SELECT dst FROM edges) GROUP BY vid")
def graph_degree(spark, d):
    return links.degrees(V.graph_edges(spark, d))


@query("restrict_renumber", f"WITH {NODES}, n AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS row FROM nodes WHERE y <= 8) SELECT a.row AS src_row, b.row AS dst_row, n_items FROM edges JOIN n a ON src = a.vid JOIN n b ON dst = b.vid")
def restrict_renumber(spark, d):
    kept = points.number_rows(V.graph_nodes(spark, d).where("y <= 8").select("vid"), ["vid"], "row")
    return links.restrict(V.graph_edges(spark, d), kept)


@query("skeleton_implicit_parents", f"WITH {STREAM}, i AS (SELECT vid AS child, lag(vid) OVER (PARTITION BY oid ORDER BY ts, vid) AS parent FROM stream), r AS (SELECT vid AS child, CASE WHEN vid % 21 = 0 THEN NULL ELSE vid - 1 END AS parent FROM stream WHERE vid % 7 = 0) SELECT i.child, CASE WHEN r.child IS NULL THEN i.parent ELSE r.parent END AS parent FROM i LEFT JOIN r ON i.child = r.child WHERE CASE WHEN r.child IS NULL THEN i.parent ELSE r.parent END IN (SELECT vid FROM stream)")
def skeleton_implicit_parents(spark, d):
    s = V.streamlines(spark, d)
    named = s.where("vid % 7 = 0").select(F.col("vid").alias("child"), F.when(F.col("vid") % 21 != 0, F.col("vid") - 1).alias("parent"))
    w = W.partitionBy("oid").orderBy(*V.ORDER)
    return links.skeleton_parents(s.withColumn("row", F.row_number().over(w)), named, ("oid",))


@query("skeleton_roots", f"WITH {TREE} SELECT oid, child AS vid FROM tree WHERE parent IS NULL")
def skeleton_roots(spark, d):
    rows = V.tree(spark, d)
    return links.roots(rows.select("oid", F.col("child").alias("vid")), rows.where("parent is not null")).select("oid", "vid")


@query("skeleton_depth_first", f"WITH {TREE} SELECT oid, child AS vid, rank FROM walk")
def skeleton_depth_first(spark, d):
    return links.depth_first(V.tree(spark, d))


@query("skeleton_paths", f"WITH {TREE}, k AS (SELECT oid, child, parent, row_number() OVER (PARTITION BY parent ORDER BY child) AS nth FROM tree) SELECT child AS vid, parent AS branch_of FROM k WHERE parent IS NOT NULL AND nth > 1")
def skeleton_paths(spark, d):
    return links.maximal_paths(V.tree(spark, d)).where("branch_of is not null").select("vid", "branch_of")


@query("mesh_faces_in_box", f"WITH {MESH} SELECT e.face, count(*) AS n FROM ends e JOIN faces f USING (face) JOIN verts v ON v.vid = e.v WHERE v.x BETWEEN 5 AND 45 AND v.y BETWEEN 900 AND 2100 GROUP BY e.face, f.n HAVING count(*) = f.n")
def mesh_faces_in_box(spark, d):
    kept = V.mesh_vertices(spark, d).where(grid.in_box((5, 900), (45, 2100), "xy"))
    return links.faces_within(kept, V.mesh_faces(spark, d)).select("face", F.size("ends").cast("long").alias("n"))


@query("mesh_owner_cell", f"WITH {MESH}, o AS (SELECT e.face, v.cx, v.cy, row_number() OVER (PARTITION BY e.face ORDER BY v.cx, v.cy, v.vid) AS k FROM ends e JOIN faces USING (face) JOIN verts v ON v.vid = e.v) SELECT face, cx, cy FROM o WHERE k = 1")
def mesh_owner_cell(spark, d):
    return links.owner_cell(V.mesh_faces(spark, d), V.mesh_vertices(spark, d), ("cx", "cy"))


@query("mesh_placements", f"WITH {MESH} SELECT DISTINCT e.face, v.cx, v.cy FROM ends e JOIN faces USING (face) JOIN verts v ON v.vid = e.v")
def mesh_placements(spark, d):
    return links.placements(V.mesh_faces(spark, d), V.mesh_vertices(spark, d), ("cx", "cy"))


@query("mesh_faces_within_cells", f"WITH {MESH} SELECT e.face FROM ends e JOIN faces USING (face) JOIN verts v ON v.vid = e.v GROUP BY e.face HAVING min(CASE WHEN v.cx <= 3 THEN 1 ELSE 0 END) = 1")
def mesh_faces_within_cells(spark, d):
    return links.within_cells(V.mesh_faces(spark, d), V.mesh_vertices(spark, d), F.col("cx") <= 3, cells=("cx", "cy")).select("face")


@query("mesh_object_faces", f"WITH {MESH} SELECT e.face FROM ends e JOIN faces f USING (face) JOIN part p ON p.p_partkey = e.v WHERE p.p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6', 'Brand#7', 'Brand#8', 'Brand#9') GROUP BY e.face, f.n HAVING count(*) = f.n")
def mesh_object_faces(spark, d):
    members = objects.group_members(V.brand_groups(spark, d), range(1, 10)).select(F.col("oid").alias("vid"))
    return links.faces_within(members, V.mesh_faces(spark, d)).select("face")


@query("canonical_links", "SELECT l_orderkey * 10 + l_linenumber AS link, least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi, CAST(CASE WHEN l_partkey <= l_suppkey THEN 0 ELSE 1 END AS INTEGER) AS first_pos FROM lineitem")
def canonical_links(spark, d):
    rows = V.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("link"), F.array("l_partkey", "l_suppkey").alias("ends"))
    s = rows.select("link", links.canonical().alias("sorted"))
    return s.select("link", F.col("sorted")[0]["vid"].alias("lo"), F.col("sorted")[1]["vid"].alias("hi"), F.col("sorted")[0]["pos"].alias("first_pos"))


# Pyramids


BIN1, BIN2 = (10.0, 2.0, 2.0), (20.0, 4.0, 4.0)


def _coarse_sql(name: str, source: str, sizes) -> str:
    keys = ", ".join(f"CAST(floor({a} / {s}::DOUBLE) AS BIGINT) AS b{a}" for a, s in zip("xyz", sizes, strict=True))
    return f"{name} AS (SELECT {keys}, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, count(*) AS n_vertices FROM {source} GROUP BY 1, 2, 3)"


ROUNDED = "bx, \"by\", bz, round(mx, 6) AS x, round(my, 6) AS y, round(mz, 6) AS z, n_vertices"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("bx", "by", "bz", *(F.round(a, 6).alias(a) for a in "xyz"), "n_vertices")


@query("coarsen_level1", f"WITH {LARGE}, {_coarse_sql('c', 'large', BIN1)} SELECT {ROUNDED} FROM c")
def coarsen_level1(spark, d):
    return _rounded(pyramid.coarsen(V.large_points(spark, d), BIN1))


@query("coarsen_level2", f"WITH {DENSE}, {_coarse_sql('c1', 'dense', (0.05,) * 3)}, p AS (SELECT mx AS x, my AS y, mz AS z FROM c1), {_coarse_sql('c2', 'p', (0.1,) * 3)} SELECT {ROUNDED} FROM c2")
def coarsen_level2(spark, d):
    return _rounded(pyramid.coarsen(pyramid.coarsen(V.dense_points(spark, d), (0.05,) * 3), (0.1,) * 3))


@query("coarsen_with_attributes", f"WITH {LARGE} SELECT flag, CAST(floor(x / 10.0::DOUBLE) AS BIGINT) AS bx, count(*) AS n_vertices, round(sum(price), 2) AS price FROM large GROUP BY 1, 2")
def coarsen_with_attributes(spark, d):
    found = pyramid.coarsen(V.large_points(spark, d), (10.0,), axes=("x",), by=("flag",), aggregate={"price": "sum"})
    return found.select("flag", "bx", "n_vertices", F.round("price", 2).alias("price"))


@query("coarse_manifest", f"WITH {STREAM}, b AS (SELECT oid, ts, vid, CAST(floor(x / 20.0::DOUBLE) AS BIGINT) AS bx, CAST(floor(y / 6.0::DOUBLE) AS BIGINT) AS \"by\" FROM stream), e AS (SELECT *, lag(bx) OVER w AS px, lag(\"by\") OVER w AS py FROM b WINDOW w AS (PARTITION BY oid ORDER BY ts, vid)) SELECT oid, row_number() OVER (PARTITION BY oid ORDER BY ts, vid) - 1 AS pos, bx, \"by\" FROM e WHERE px IS NULL OR px <> bx OR py <> \"by\"")
def coarse_manifest(spark, d):
    return pyramid.coarse_manifest(V.streamlines(spark, d), (20.0, 6.0), axes="xy", order=V.ORDER)


META = f"WITH {DENSE}, m AS (SELECT bx, \"by\", bz, dense_rank() OVER (ORDER BY bx, \"by\", bz) - 1 AS mvid, mx AS x, my AS y, mz AS z FROM (SELECT CAST(floor(x / 0.1::DOUBLE) AS BIGINT) AS bx, CAST(floor(y / 0.1::DOUBLE) AS BIGINT) AS \"by\", CAST(floor(z / 0.1::DOUBLE) AS BIGINT) AS bz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM dense GROUP BY 1, 2, 3)), up1 AS (SELECT vid, mvid AS parent FROM dense JOIN m ON bx = floor(dense.x / 0.1::DOUBLE) AND \"by\" = floor(dense.y / 0.1::DOUBLE) AND bz = floor(dense.z / 0.1::DOUBLE))"


def _meta(spark, d):
    dense = V.dense_points(spark, d)
    coarse = points.number_rows(pyramid.coarsen(dense, (0.1,) * 3), ["bx", "by", "bz"], "mvid")
    return coarse, pyramid.cross_level_parents(dense, coarse, (0.1,) * 3)


@query("cross_level_parent", META + " SELECT vid, parent FROM up1")
def cross_level_parent(spark, d):
    return _meta(spark, d)[1]


@query("cross_level_parent2", META + ", m2 AS (SELECT bx, \"by\", bz, row_number() OVER (ORDER BY bx, \"by\", bz) - 1 AS top FROM (SELECT DISTINCT CAST(floor(x / 0.2::DOUBLE) AS BIGINT) AS bx, CAST(floor(y / 0.2::DOUBLE) AS BIGINT) AS \"by\", CAST(floor(z / 0.2::DOUBLE) AS BIGINT) AS bz FROM m)), up2 AS (SELECT mvid, top FROM m JOIN m2 ON m2.bx = floor(m.x / 0.2::DOUBLE) AND m2.by = floor(m.y / 0.2::DOUBLE) AND m2.bz = floor(m.z / 0.2::DOUBLE)) SELECT vid, top AS parent FROM up1 JOIN up2 ON parent = mvid")
def cross_level_parent2(spark, d):
    coarse, up1 = _meta(spark, d)
    second = points.number_rows(pyramid.coarsen(coarse.drop("bx", "by", "bz", "n_vertices"), (0.2,) * 3), ["bx", "by", "bz"], "mvid2")
    up2 = pyramid.cross_level_parents(coarse.drop("bx", "by", "bz"), second, (0.2,) * 3, vid="mvid", meta="mvid2")
    return pyramid.compose(up1, up2)


@query("sparsity_keep", "SELECT o_orderkey AS oid FROM orders ORDER BY md5('3:' || o_orderkey), o_orderkey LIMIT (SELECT CAST(greatest(1, round(count(*) * 0.25)) AS BIGINT) FROM orders)")
def sparsity_keep(spark, d):
    return pyramid.sparsify(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("oid")), 0.25, seed=3)


@query("sparsity_keep_count", "SELECT CAST(greatest(1, round(count(*) * 0.25)) AS BIGINT) AS n FROM orders")
def sparsity_keep_count(spark, d):
    return sparsity_keep(spark, d).agg(F.count("*").alias("n"))


@query("sparse_object_attributes", "SELECT o_orderkey AS oid, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END AS price FROM orders")
def sparse_object_attributes(spark, d):
    rows = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("oid"), F.col("o_totalprice").alias("price"))
    pyramid.register_selection("every_fourth", lambda objs, target, oid, **_: objs.where(F.col(oid) % 4 == 0).select(oid))
    kept = pyramid.sparsify(rows, 0.25, strategy="every_fourth", count=1)
    return pyramid.sparse_attributes(rows, kept, ["price"]).select("oid", "price")


@query("level_counts", f"WITH {DENSE} SELECT 0 AS level, count(*) AS n FROM dense UNION ALL SELECT 1, count(*) FROM (SELECT DISTINCT floor(x / 0.1::DOUBLE), floor(y / 0.1::DOUBLE), floor(z / 0.1::DOUBLE) FROM dense) UNION ALL SELECT 2, count(*) FROM (SELECT DISTINCT floor(x / 0.2::DOUBLE), floor(y / 0.2::DOUBLE), floor(z / 0.2::DOUBLE) FROM dense)")
def level_counts(spark, d):
    dense = V.dense_points(spark, d)
    rows = dense.agg(F.count("*").alias("n")).select(F.lit(0).alias("level"), "n")
    for k, size in ((1, 0.1), (2, 0.2)):
        rows = rows.unionByName(pyramid.coarsen(dense, (size,) * 3).agg(F.count("*").alias("n")).select(F.lit(k).alias("level"), "n"))
    return rows


# Layout


@query("rechunk_quartile", "WITH q AS (SELECT quantile_cont(l_extendedprice, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM lineitem) SELECT least(3, greatest(0, (CASE WHEN l_extendedprice >= e[1] THEN 1 ELSE 0 END + CASE WHEN l_extendedprice >= e[2] THEN 1 ELSE 0 END + CASE WHEN l_extendedprice >= e[3] THEN 1 ELSE 0 END + CASE WHEN l_extendedprice >= e[4] THEN 1 ELSE 0 END + CASE WHEN l_extendedprice >= e[5] THEN 1 ELSE 0 END) - 1))::BIGINT AS bin, count(*) AS n FROM lineitem, q GROUP BY 1")
def rechunk_quartile(spark, d):
    return layout.rechunk_by_value(V.large_points(spark, d), "price").groupBy("bin").agg(F.count("*").alias("n"))


@query("rechunk_edges", "SELECT CAST(least(2, greatest(0, (CASE WHEN l_quantity >= 5 THEN 1 ELSE 0 END + CASE WHEN l_quantity >= 20 THEN 1 ELSE 0 END + CASE WHEN l_quantity >= 35 THEN 1 ELSE 0 END + CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END) - 1)) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def rechunk_edges(spark, d):
    return layout.rechunk_by_value(V.large_points(spark, d), "x", edges=[5, 20, 35, 45]).groupBy("bin").agg(F.count("*").alias("n"))


@query("rechunk_categorical", "SELECT dense_rank() OVER (ORDER BY l_returnflag) - 1 AS bin, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def rechunk_categorical(spark, d):
    return layout.rechunk_by_value(V.large_points(spark, d), "flag").groupBy("bin").agg(F.count("*").alias("n"))


@query("rechunk_group", "WITH g AS (SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) END AS gid FROM part), b AS (SELECT gid, row_number() OVER (ORDER BY gid) - 1 AS bin FROM (SELECT DISTINCT gid FROM g WHERE gid IS NOT NULL)) SELECT p_partkey AS oid, coalesce(bin, (SELECT count(*) FROM b)) AS bin FROM g LEFT JOIN b USING (gid)")
def rechunk_group(spark, d):
    parts = V.table(spark, d, "part").select(F.col("p_partkey").alias("oid"))
    return layout.rechunk_by_group(parts, V.brand_groups(spark, d).where("gid <= 3")).select("oid", "bin")


@query("rechunk_spatial", f"WITH {LARGE} SELECT CAST(floor(x / 25.0::DOUBLE) AS BIGINT) AS cx, CAST(floor(y / 5.0::DOUBLE) AS BIGINT) AS cy, CAST(floor(z / 4.0::DOUBLE) AS BIGINT) AS cz, count(*) AS n FROM large GROUP BY 1, 2, 3")
def rechunk_spatial(spark, d):
    return layout.rechunk(V.large_points(spark, d), (25.0, 5.0, 4.0)).groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"))


@query("rebin", f"WITH {DENSE} SELECT vid, ((CAST(floor(x / 0.01::DOUBLE) AS BIGINT) % 5) + 5) % 5 AS bin FROM dense")
def rebin(spark, d):
    return layout.rebin(V.dense_points(spark, d).select("vid", "x", "cx"), (0.05,), (0.01,), ("x",)).select("vid", "bin")


@query("suggest_chunk_shape", f"WITH {NODES} SELECT max(n) AS worst FROM (SELECT count(*) AS n FROM edges JOIN nodes a ON src = a.vid JOIN nodes b ON dst = b.vid WHERE a.cx = b.cx AND a.cy = b.cy GROUP BY a.cx, a.cy)")
def suggest_chunk_shape(spark, d):
    cut = links.partition_links(V.graph_edges(spark, d), V.graph_nodes(spark, d), ("cx", "cy")).where("intra")
    return layout.densest(cut, ("scx", "scy"))


OCTREE = f"WITH RECURSIVE {LARGE}, cells AS (SELECT least(7, cx) AS i, least(7, cy) AS j, least(7, cz) AS k, count(*) AS weight FROM large GROUP BY 1, 2, 3), nodes AS (SELECT d AS depth, i >> (3 - d) AS i, j >> (3 - d) AS j, k >> (3 - d) AS k, CAST(sum(weight) AS BIGINT) AS weight FROM cells, (VALUES (0), (1), (2), (3)) t(d) GROUP BY ALL)"


def _octree_cells(spark, d):
    rows = V.large_points(spark, d)
    return rows.groupBy(*(F.least(F.lit(7).cast("long"), F.col(c)).alias(a) for c, a in (("cx", "i"), ("cy", "j"), ("cz", "k")))).agg(F.count("*").alias("weight"))


@query("octree_node_weights", OCTREE + " SELECT depth, i, j, k, weight FROM nodes")
def octree_node_weights(spark, d):
    return layout.node_weights(_octree_cells(spark, d), 3)


@query("octree_leaves", OCTREE + ", f AS (SELECT *, weight <= 1500 OR depth = 3 AS fits FROM nodes) SELECT c.depth, c.i, c.j, c.k, c.weight FROM f c LEFT JOIN f p ON p.depth = c.depth - 1 AND p.i = c.i >> 1 AND p.j = c.j >> 1 AND p.k = c.k >> 1 WHERE c.fits AND NOT coalesce(p.fits, false)")
def octree_leaves(spark, d):
    return layout.leaves(_octree_cells(spark, d), 3, 1500).select("depth", "i", "j", "k", "weight")


@query("octree_vertices", OCTREE + ", f AS (SELECT *, weight <= 1500 OR depth = 3 AS fits FROM nodes), l AS (SELECT c.* FROM f c LEFT JOIN f p ON p.depth = c.depth - 1 AND p.i = c.i >> 1 AND p.j = c.j >> 1 AND p.k = c.k >> 1 WHERE c.fits AND NOT coalesce(p.fits, false)) SELECT depth, i, j, k, weight AS n FROM l")
def octree_vertices(spark, d):
    cells = _octree_cells(spark, d)
    found = layout.leaves(cells, 3, 1500)
    rows = V.large_points(spark, d).select(*(F.least(F.lit(7).cast("long"), F.col(c)).alias(a) for c, a in (("cx", "i"), ("cy", "j"), ("cz", "k"))))
    placed = layout.in_leaf(rows, found, 3)
    counted = placed.groupBy("depth", "key").agg(F.count("*").alias("n"))
    return found.join(counted, ["depth", "key"]).select("depth", "i", "j", "k", "n")


@query("morton_order", f"WITH {LARGE}, c AS (SELECT DISTINCT cx, cy, cz FROM large) SELECT cx, cy, cz, " + " + ".join(f"(((cx >> {b}) & 1) << {3 * b + 2}) + (((cy >> {b}) & 1) << {3 * b + 1}) + (((cz >> {b}) & 1) << {3 * b})" for b in range(4)) + " AS key FROM c")
def morton_order(spark, d):
    return V.large_points(spark, d).select("cx", "cy", "cz").distinct().select("cx", "cy", "cz", grid.morton(["cx", "cy", "cz"], 4).alias("key"))


@query("cell_anchors", f"WITH {DENSE} SELECT DISTINCT cx, CAST(floor(cx * 3 / 2.0::DOUBLE) AS BIGINT) AS anchor FROM dense")
def cell_anchors(spark, d):
    return V.dense_points(spark, d).select("cx").distinct().select("cx", grid.anchor(F.col("cx"), 3, 2).alias("anchor"))


# Sources, functions, edits, validation


@query("composite_union", "SELECT 'point_cloud' AS kind, count(*) AS n FROM embeddings UNION ALL SELECT 'streamline', count(*) FROM events UNION ALL SELECT 'mesh', count(*) FROM part")
def composite_union(spark, d):
    kinds = {"point_cloud": V.dense_points, "streamline": V.streamlines, "mesh": V.mesh_vertices}
    rows = None
    for kind, fn in kinds.items():
        part = fn(spark, d).select(F.lit(kind).alias("kind"), "vid", "x", "y")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


@query("composite_sources", f"WITH {DENSE} SELECT 0 AS source, vid, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z FROM dense UNION ALL SELECT 1, vid, round(2 * x + 1, 9), round(y + 0.5 * z, 9), round(z - 3, 9) FROM dense")
def composite_sources(spark, d):
    dense = V.dense_points(spark, d).select("vid", "x", "y", "z")
    same = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]]
    moved = [[2, 0, 0, 1], [0, 1, 0.5, 0], [0, 0, 1, -3]]
    return store.union_sources([(dense, same), (dense, moved)]).select("source", "vid", *(F.round(a, 9).alias(a) for a in "xyz"))


@query("parametric_spheres", "SELECT s_suppkey AS id, CAST(s_nationkey AS DOUBLE) AS x, s_acctbal AS r FROM supplier WHERE s_acctbal > 0 AND abs(s_nationkey - 10) <= s_acctbal / 1000")
def parametric_spheres(spark, d):
    rows = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("sphere").alias("type"), F.array(F.col("s_nationkey").cast("double"), F.lit(0.0), F.lit(0.0), F.col("s_acctbal"), F.lit(float("nan"))).alias("coefficients"))
    found = store.parametric(rows).select("id", F.col("coefficients")[0].alias("x"), F.col("coefficients")[3].alias("r"))
    return found.where((F.col("r") > 0) & (F.abs(F.col("x") - 10) <= F.col("r") / 1000))


@query("affine_transform", f"WITH {DENSE} SELECT vid, round(0.5 * x + 2 * y - 1, 9) AS x, round(3 * z + 4, 9) AS y, round(x - y, 9) AS z FROM dense")
def affine_transform(spark, d):
    moved = V.dense_points(spark, d).select("vid", *grid.affine([[0.5, 2, 0, -1], [0, 0, 3, 4], [1, -1, 0, 0]]))
    return moved.select("vid", *(F.round(a, 9).alias(a) for a in "xyz"))


@query("oid_prefix_next", "SELECT o_orderkey AS oid, o_orderkey + ((5 - o_orderkey) % 7 + 7) % 7 AS next_id FROM orders")
def oid_prefix_next(spark, d):
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("oid"), grid.next_with_residue(F.col("o_orderkey"), 5, 7).alias("next_id"))


@query("set_operations", f"WITH {LARGE}, a AS (SELECT DISTINCT cx, cy FROM large WHERE flag = 'A' AND x < 25), b AS (SELECT DISTINCT cx, cy FROM large WHERE flag = 'R' AND x > 15) SELECT 'both' AS part, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', * FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'first', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def set_operations(spark, d):
    rows = V.large_points(spark, d)
    a = rows.where("flag = 'A' and x < 25").select("cx", "cy").distinct()
    b = rows.where("flag = 'R' and x > 15").select("cx", "cy").distinct()
    parts = {"both": a.intersect(b), "either": a.union(b).distinct(), "first": a.subtract(b)}
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("part"), "cx", "cy")
        out = part if out is None else out.unionByName(part)
    return out


@query("edit_vertices", f"WITH {DENSE} SELECT vid, CASE WHEN vid % 50 = 0 THEN x + 1 ELSE x END AS x, CASE WHEN vid % 50 = 0 THEN CAST(floor((x + 1) / 0.05::DOUBLE) AS BIGINT) ELSE cx END AS cx FROM dense")
def edit_vertices(spark, d):
    dense = V.dense_points(spark, d).select("vid", "x")
    changes = dense.where("vid % 50 = 0").select("vid", (F.col("x") + 1).alias("x"))
    return edits.update_rows(dense, changes, "vid").select("vid", "x", grid.cell("x", 0.05).alias("cx"))


@query("vacuum_remap", "SELECT o_orderkey AS oid, row_number() OVER (ORDER BY o_orderkey) - 1 AS new_oid FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)")
def vacuum_remap(spark, d):
    slots = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("oid"))
    return edits.compact_ids(slots, V.large_points(spark, d).where("x > 48").select("oid"))


@query("unreferenced_fragments", "SELECT p_partkey AS frag FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def unreferenced_fragments(spark, d):
    fragments = V.table(spark, d, "part").select(F.col("p_partkey").alias("frag"))
    named = V.large_points(spark, d).where("x > 40").select(F.col("part").alias("frag"))
    return edits.unreferenced(fragments, named, ("frag",))


@query("validate_dangling", f"WITH {NODES} SELECT CAST(dst AS VARCHAR) AS detail, count(*) AS n FROM edges WHERE dst NOT IN (SELECT vid FROM nodes WHERE y < 20) GROUP BY 1 UNION ALL SELECT CAST(src AS VARCHAR), count(*) FROM edges WHERE src NOT IN (SELECT vid FROM nodes WHERE y < 20) GROUP BY 1")
def validate_dangling(spark, d):
    bad = validate.dangling_links(V.graph_edges(spark, d), V.graph_nodes(spark, d).where("y < 20"))
    return bad.groupBy("detail").agg(F.count("*").alias("n"))


@query("validate_misplaced", f"WITH {DENSE} SELECT CAST(vid AS VARCHAR) AS detail FROM dense WHERE vid % 97 = 0")
def validate_misplaced(spark, d):
    rows = V.dense_points(spark, d).withColumn("cx", F.when(F.col("vid") % 97 == 0, F.col("cx") + 1).otherwise(F.col("cx")))
    return validate.misplaced(rows, V.CELL_DENSE).select("detail")


@query("validate_pyramid_counts", f"WITH {DENSE}, l AS (SELECT 0 AS level, count(*) AS n FROM dense UNION ALL SELECT 1, count(DISTINCT oid) FROM dense UNION ALL SELECT 2, count(*) FROM dense) SELECT CAST(level || ' ' || n AS VARCHAR) AS detail FROM (SELECT level, n, lag(n) OVER (ORDER BY level) AS p FROM l) WHERE n > p")
def validate_pyramid_counts(spark, d):
    dense = V.dense_points(spark, d)
    counts = [dense.agg(F.count("*").alias("n")), dense.agg(F.countDistinct("oid").alias("n")), dense.agg(F.count("*").alias("n"))]
    rows = None
    for k, c in enumerate(counts):
        part = c.select(F.lit(k).alias("level"), F.col("n").alias("n_vertices"), F.lit(float(k + 1)).alias("bin_volume"))
        rows = part if rows is None else rows.unionByName(part)
    return validate.pyramid_counts(rows).select("detail")


@query("relabel_by_links", f"WITH {STREAM}, e AS (SELECT vid, lag(vid) OVER w AS p, cx = lag(cx) OVER w AS same FROM stream WINDOW w AS (PARTITION BY oid ORDER BY ts, vid)), s AS (SELECT st.oid, st.vid, CAST(sum(CASE WHEN e.p IS NOT NULL AND e.same THEN 0 ELSE 1 END) OVER (PARTITION BY st.oid ORDER BY st.ts, st.vid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM stream st JOIN e USING (vid)) SELECT vid, min(vid) OVER (PARTITION BY oid, run) AS oid FROM s")
def relabel_by_links(spark, d):
    s = V.streamlines(spark, d)
    w = W.partitionBy("oid").orderBy(*V.ORDER)
    edges = s.select(F.col("vid").alias("src"), F.lag("vid").over(w).alias("dst"), (F.lag("cx").over(w) == F.col("cx")).alias("same")).where("same").select("src", "dst")
    return edits.relabel_by_links(s, edges)


# Readers


@query("mesh_owned_patch", f"WITH {MESH}, o AS (SELECT e.face, v.cx, v.cy, row_number() OVER (PARTITION BY e.face ORDER BY v.cx, v.cy, v.vid) AS k FROM ends e JOIN faces USING (face) JOIN verts v ON v.vid = e.v), own AS (SELECT face FROM o WHERE k = 1 AND cx = 0 AND cy IN (9, 10)) SELECT DISTINCT vid, x, y FROM verts JOIN ends ON v = vid JOIN own USING (face)")
def mesh_owned_patch(spark, d):
    wanted = spark.createDataFrame([(0, 9), (0, 10)], "cx long, cy long")
    _, vertices = readers.owned_patch(V.mesh_faces(spark, d), V.mesh_vertices(spark, d), wanted, ("cx", "cy"))
    return vertices.select("vid", "x", "y")


@query("mesh_owner_bounds", f"WITH {MESH}, o AS (SELECT e.face, v.cx, v.cy, row_number() OVER (PARTITION BY e.face ORDER BY v.cx, v.cy, v.vid) AS k FROM ends e JOIN faces USING (face) JOIN verts v ON v.vid = e.v) SELECT o.cx, o.cy, min(v.x) AS min_x, max(v.x) AS max_x, min(v.y) AS min_y, max(v.y) AS max_y FROM o JOIN ends e USING (face) JOIN verts v ON v.vid = e.v WHERE k = 1 GROUP BY o.cx, o.cy")
def mesh_owner_bounds(spark, d):
    return readers.owner_bounds(V.mesh_faces(spark, d), V.mesh_vertices(spark, d), "xy", ("cx", "cy"))


@query("mesh_of_cell_set", f"WITH {MESH} SELECT e.face FROM ends e JOIN faces USING (face) JOIN verts v ON v.vid = e.v GROUP BY e.face HAVING count(DISTINCT (v.cx, v.cy)) = 2 AND min(CASE WHEN (v.cx, v.cy) IN ((1, 9), (3, 9)) THEN 1 ELSE 0 END) = 1")
def mesh_of_cell_set(spark, d):
    return readers.links_of_cells(V.mesh_faces(spark, d), V.mesh_vertices(spark, d), [(1, 9), (3, 9)], ("cx", "cy")).select("face")


@query("skeleton_by_segment", f"WITH {STREAM}, i AS (SELECT oid, vid AS child, lag(vid) OVER (PARTITION BY oid ORDER BY ts, vid) AS parent, x + 100.5::DOUBLE AS x FROM stream) SELECT child, parent, x FROM i WHERE oid = (SELECT user_id FROM events GROUP BY user_id HAVING user_id * 11 + 7 = 62) AND parent IS NOT NULL")
def skeleton_by_segment(spark, d):
    s = V.streamlines(spark, d)
    segments = s.select("oid").distinct().withColumn("segment_id", F.col("oid") * 11 + 7)
    w = W.partitionBy("oid").orderBy(*V.ORDER)
    nothing = spark.createDataFrame([], "child long, parent long")
    own, edges = readers.skeleton_by_segment(segments, s.withColumn("row", F.row_number().over(w)), nothing, 62, "xy", (100.5, 0.0), ("oid",))
    return edges.join(own.select(F.col("vid").alias("child"), "x"), "child").select("child", "parent", "x")


@query("graph_object_links", f"WITH {NODES}, n AS (SELECT vid FROM nodes WHERE vid % 5 IN (1, 3)) SELECT src, dst, n_items FROM edges WHERE src IN (SELECT vid FROM n) AND dst IN (SELECT vid FROM n)")
def graph_object_links(spark, d):
    nodes = V.graph_nodes(spark, d).withColumn("oid", F.col("vid") % 5)
    return readers.object_links(V.graph_edges(spark, d), nodes, [1, 3])


@query("selection_context", f"WITH {STREAM}, s AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY oid) AS n, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step FROM stream WINDOW w AS (PARTITION BY oid ORDER BY ts, vid)) SELECT oid, max(CASE WHEN k = n // 2 THEN x END) AS mx, max(CASE WHEN k = n // 2 THEN y END) AS my, round(coalesce(sum(step), 0), 4) AS length, count(*) AS n_vertices FROM s GROUP BY oid")
def selection_context(spark, d):
    return readers.selection_context(V.streamlines(spark, d), "xy", order=V.ORDER).withColumn("length", F.round("length", 4))


@query("halo_cells", f"WITH {DENSE}, c AS (SELECT DISTINCT cx, cy, cz FROM dense) SELECT a.cx, a.cy, a.cz, CAST(min(greatest(abs(a.cx - b.cx), abs(a.cy - b.cy), abs(a.cz - b.cz))) AS INTEGER) AS ring FROM c a JOIN c b ON abs(a.cx - b.cx) <= 2 AND abs(a.cy - b.cy) <= 2 AND abs(a.cz - b.cz) <= 2 WHERE b.cx = 2 AND b.cy >= 1 GROUP BY ALL")
def halo_cells(spark, d):
    return readers.halo_cells(V.dense_points(spark, d), (F.col("cx") == 2) & (F.col("cy") >= 1), 2)


LEAVES = OCTREE + ", f AS (SELECT *, weight <= 1500 OR depth = 3 AS fits FROM nodes), l AS (SELECT c.depth, c.i, c.j, c.k, c.i << (3 - c.depth) AS ai, c.j << (3 - c.depth) AS aj, c.k << (3 - c.depth) AS ak, 1 << (3 - c.depth) AS side FROM f c LEFT JOIN f p ON p.depth = c.depth - 1 AND p.i = c.i >> 1 AND p.j = c.j >> 1 AND p.k = c.k >> 1 WHERE c.fits AND NOT coalesce(p.fits, false))"


@query("octree_leaves_in_box", LEAVES + " SELECT depth, i, j, k FROM l WHERE ai <= 2 AND ai + side - 1 >= 1 AND aj <= 3 AND aj + side - 1 >= 1 AND ak <= 2 AND ak + side - 1 >= 0")
def octree_leaves_in_box(spark, d):
    found = layout.leaves(_octree_cells(spark, d), 3, 1500)
    return readers.leaves_in_box(found, (10.0, 2.0, 0.0), (29.0, 6.0, 4.0), V.CELL_LARGE, 3).select("depth", "i", "j", "k")


@query("octree_leaf_neighbours", LEAVES + " SELECT a.depth AS da, a.i AS ai, a.j AS aj, a.k AS ak, count(*) AS n FROM l a JOIN l b ON (a.depth, a.i, a.j, a.k) <> (b.depth, b.i, b.j, b.k) AND a.ai <= b.ai + b.side AND b.ai <= a.ai + a.side AND a.aj <= b.aj + b.side AND b.aj <= a.aj + a.side AND a.ak <= b.ak + b.side AND b.ak <= a.ak + a.side GROUP BY ALL")
def octree_leaf_neighbours(spark, d):
    found = layout.leaves(_octree_cells(spark, d), 3, 1500)
    pairs = readers.leaf_neighbours(found, 3).groupBy(F.col("a").alias("key")).agg(F.count("*").alias("n"))
    return found.join(pairs, "key").select(F.col("depth").alias("da"), F.col("i").alias("ai"), F.col("j").alias("aj"), F.col("k").alias("ak"), "n")


@query("append_objects", "SELECT count(*) AS n, count(DISTINCT oid) AS n_objects, max(oid) AS top FROM (SELECT o_orderkey AS oid FROM orders UNION ALL SELECT o_orderkey + (SELECT max(o_orderkey) + 1 FROM orders) FROM orders WHERE o_orderstatus = 'F')")
def append_objects(spark, d):
    orders = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("oid"), F.col("o_orderstatus").alias("status"))
    shift = orders.agg(F.max("oid").alias("top")).first()["top"] + 1
    new = orders.where("status = 'F'").select((F.col("oid") + shift).alias("oid"), "status")
    both = readers.append_objects(orders, new, bins=orders.select("status").distinct(), bin_column="status")
    return both.agg(F.count("*").alias("n"), F.countDistinct("oid").alias("n_objects"), F.max("oid").alias("top"))


@query("explicit_parent_records", f"WITH {TREE}, r AS (SELECT child, parent, lag(child) OVER (PARTITION BY oid ORDER BY rank) AS before FROM walk) SELECT child, parent FROM r WHERE parent IS DISTINCT FROM before")
def explicit_parent_records(spark, d):
    rows = V.tree(spark, d)
    ordered = readers.reorder_depth_first(rows.select("oid", F.col("child").alias("vid")), rows)
    return readers.explicit_after_reorder(rows.select("child", "parent"), ordered)


@query("group_catalogue", "SELECT c_mktsegment AS name, count(*) AS n_members, min(c_custkey) AS first_member FROM customer GROUP BY 1")
def group_catalogue(spark, d):
    members = V.table(spark, d, "customer").select(F.col("c_custkey").alias("oid"), "c_mktsegment")
    built = objects.build_groups(members, "c_mktsegment")
    return built.select("name", F.size("members").cast("long").alias("n_members"), F.col("members")[0].alias("first_member"))


# Stored datasets: written to the shared folder, read back


def _folder(spark) -> str:
    """A new folder for a dataset, beside the session's checkpoints."""
    return V.work_folder(spark)


STREAM_LEVEL1 = f"""{STREAM}, m AS (SELECT bx, "by", avg(x) AS x, avg(y) AS y FROM (SELECT x, y, CAST(floor(x / 20.0::DOUBLE) AS BIGINT) AS bx, CAST(floor(y / 6.0::DOUBLE) AS BIGINT) AS "by" FROM stream) GROUP BY 1, 2),
  e AS (SELECT *, lag(bx) OVER w AS px, lag("by") OVER w AS py FROM (SELECT oid, ts, vid, CAST(floor(x / 20.0::DOUBLE) AS BIGINT) AS bx, CAST(floor(y / 6.0::DOUBLE) AS BIGINT) AS "by" FROM stream) WINDOW w AS (PARTITION BY oid ORDER BY ts, vid)),
  up AS (SELECT e.oid, row_number() OVER (PARTITION BY e.oid ORDER BY e.ts, e.vid) - 1 AS seq, m.x, m.y FROM e JOIN m ON m.bx = e.bx AND m."by" = e."by" WHERE e.px IS NULL OR e.px <> e.bx OR e.py <> e."by")"""


def _stored_streams(spark, d, pyramid_of=((2, 1.0),), manifests: bool = False) -> store.Dataset:
    """Events as streamlines with cells of (50, 12) and bins of (10, 3), and a pyramid over them."""
    ds = store.Dataset.create(spark, _folder(spark), store.Schema("streamline", ("x", "y"), (50.0, 12.0), (10.0, 3.0)))
    w = W.partitionBy("oid").orderBy(*V.ORDER)
    rows = V.streamlines(spark, d).select("vid", "oid", (F.row_number().over(w) - 1).cast("long").alias("seq"), "x", "y")
    ds.write_vertices(rows, manifests=manifests)
    if pyramid_of:
        levels.build_pyramid(ds, pyramid_of)
    return ds


@query("stored_box_level0", f"WITH {STREAM} SELECT vid, oid FROM stream WHERE x BETWEEN 12 AND 47 AND y BETWEEN 3 AND 11")
def stored_box_level0(spark, d):
    return _stored_streams(spark, d, ()).level(0).select(box=((12, 3), (47, 11))).dataframe().select("vid", "oid")


@query("stored_box_level1", f"WITH {STREAM_LEVEL1} SELECT oid, seq, round(x, 6) AS x, round(y, 6) AS y FROM up WHERE x BETWEEN 12 AND 147 AND y BETWEEN 3 AND 19")
def stored_box_level1(spark, d):
    found = _stored_streams(spark, d).level(1).select(box=((12, 3), (147, 19))).dataframe()
    return found.select("oid", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("stored_cells_level1", f"WITH {STREAM_LEVEL1} SELECT CAST(floor(x / 100.0::DOUBLE) AS BIGINT) AS cx, CAST(floor(y / 24.0::DOUBLE) AS BIGINT) AS cy, count(*) AS n FROM up GROUP BY 1, 2")
def stored_cells_level1(spark, d):
    return _stored_streams(spark, d).table("vertices", level=1).groupBy("cx", "cy").agg(F.count("*").alias("n"))


EDITED = f"WITH {STREAM}, e AS (SELECT vid, oid, CASE WHEN vid = 7 THEN 77.5 ELSE x END AS x, CASE WHEN vid = 7 THEN 20.5 ELSE y END AS y FROM stream WHERE vid <> 12 AND oid <> 3), f AS (SELECT vid, oid, x, y, CAST(floor(x / 50.0::DOUBLE) AS BIGINT) AS cx, CAST(floor(y / 12.0::DOUBLE) AS BIGINT) AS cy FROM e)"


def _edited(spark, d, pyramid_of=()) -> store.Dataset:
    ds = _stored_streams(spark, d, pyramid_of, manifests=True)
    with edits.EditSession(ds) as session:
        session.edit_vertex(7, position=(77.5, 20.5))
        session.remove_vertex(12)
        session.remove_object(3)
    return ds


@query("stored_edit", EDITED + " SELECT vid, oid, x, y, cx, cy, ((CAST(floor(x / 10.0::DOUBLE) AS BIGINT) % 5 + 5) % 5) * 4 + (CAST(floor(y / 3.0::DOUBLE) AS BIGINT) % 4 + 4) % 4 AS bin FROM f")
def stored_edit(spark, d):
    return _edited(spark, d).level(0).dataframe().select("vid", "oid", "x", "y", "cx", "cy", "bin")


@query("stored_edit_keeps_levels", f"WITH {STREAM_LEVEL1} SELECT CAST(floor(x / 100.0::DOUBLE) AS BIGINT) AS cx, CAST(floor(y / 24.0::DOUBLE) AS BIGINT) AS cy, count(*) AS n FROM up WHERE oid <> 3 GROUP BY 1, 2")
def stored_edit_keeps_levels(spark, d):
    return _edited(spark, d, ((2, 1.0),)).table("vertices", level=1).groupBy("cx", "cy").agg(F.count("*").alias("n"))


@query("stored_edit_manifests", EDITED + " SELECT oid, cx, cy FROM f GROUP BY ALL")
def stored_edit_manifests(spark, d):
    return _edited(spark, d).table("manifests", level=0).select("oid", "cx", "cy").distinct()


@query("stored_validate_clean", "SELECT CAST(1 AS INTEGER) AS level, '' AS \"check\" WHERE false")
def stored_validate_clean(spark, d):
    return validate.validate(_edited(spark, d, ((2, 1.0),))).select("level", "check")


@query("stored_vacuum", EDITED + ", r AS (SELECT oid, row_number() OVER (ORDER BY oid) - 1 AS new_oid FROM (SELECT DISTINCT oid FROM f)) SELECT vid, new_oid AS oid FROM f JOIN r USING (oid)")
def stored_vacuum(spark, d):
    ds = _edited(spark, d)
    edits.vacuum(ds)
    return ds.table("vertices", level=0).select("vid", "oid")


@query("stored_rebin", f"WITH {DENSE} SELECT vid, (CAST(floor(x / 0.025::DOUBLE) AS BIGINT) % 8 + 8) % 8 AS bin FROM dense")
def stored_rebin(spark, d):
    ds = store.Dataset.create(spark, _folder(spark), store.Schema("point_cloud", ("x",), (0.2,), (0.1,)))
    ds.write_vertices(V.dense_points(spark, d).select("vid", "oid", "x"))
    levels.rebin(ds, (0.025,))
    return ds.level(0).dataframe().select("vid", "bin")


@query("stored_mesh", f"WITH {MESH}, k AS (SELECT *, row_number() OVER (ORDER BY vid) - 1 AS \"row\" FROM verts WHERE x BETWEEN 5 AND 45 AND y BETWEEN 900 AND 2100), c AS (SELECT l_orderkey * 100 + row_number() OVER w AS face, l_partkey AS a, lead(l_partkey, 1) OVER w AS b, lead(l_partkey, 2) OVER w AS c FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) SELECT face, ka.row AS r0, kb.row AS r1, kc.row AS r2 FROM c JOIN k ka ON ka.vid = a JOIN k kb ON kb.vid = b JOIN k kc ON kc.vid = c")
def stored_mesh(spark, d):
    ds = store.Dataset.create(spark, _folder(spark), store.Schema("mesh", ("x", "y"), (10.0, 100.0)))
    vertices = V.mesh_vertices(spark, d).select("vid", (F.col("vid") % 16).alias("oid"), "x", "y")
    writers.write_mesh(ds, vertices, V.mesh_faces(spark, d))
    _, faces = writers.read_mesh(ds, box=((5, 900), (45, 2100)))
    return faces.select("face", *(F.col("rows")[k].alias(f"r{k}") for k in range(3)))


@query("stored_graph", f"WITH {NODES}, n AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS \"row\" FROM nodes WHERE x BETWEEN 0 AND 5000 AND y BETWEEN 0 AND 12) SELECT a.row AS src_row, b.row AS dst_row, n_items FROM edges JOIN n a ON src = a.vid JOIN n b ON dst = b.vid")
def stored_graph(spark, d):
    ds = store.Dataset.create(spark, _folder(spark), store.Schema("graph", ("x", "y"), (1000.0, 5.0)))
    writers.write_graph(ds, V.graph_nodes(spark, d).select("vid", "x", "y"), V.graph_edges(spark, d))
    return writers.read_graph(ds, box=((0, 0), (5000, 12)))[1]


@query("stored_skeleton", f"WITH {TREE} SELECT child, parent FROM tree WHERE parent IS NOT NULL")
def stored_skeleton(spark, d):
    ds = store.Dataset.create(spark, _folder(spark), store.Schema("skeleton", ("x",), (100.0,)))
    rows = V.tree(spark, d)
    writers.write_skeleton(ds, rows.select(F.col("child").alias("vid"), "oid", (F.col("child") % 997).cast("double").alias("x")), rows.select("child", "parent"))
    return writers.read_skeleton(ds)[1]


@query("stored_polylines", f"WITH {SPLIT} SELECT oid, segment AS seq, min(cx) AS cx, min(cy) AS cy, count(*) AS n_vertices FROM split GROUP BY oid, segment")
def stored_polylines(spark, d):
    ds = store.Dataset.create(spark, _folder(spark), store.Schema("polyline", ("x", "y"), V.CELL_STREAM))
    w = W.partitionBy("oid").orderBy(*V.ORDER)
    writers.write_polylines(ds, V.streamlines(spark, d).select("vid", "oid", F.row_number().over(w).alias("seq"), "x", "y"))
    return ds.table("manifests", level=0).select("oid", "seq", "cx", "cy", "n_vertices")


@query("stored_lines", f"WITH {LINES} SELECT oid, ax, ay, bx, \"by\" FROM lines WHERE (ax BETWEEN 0 AND 1000 AND ay BETWEEN 3 AND 9) OR (bx BETWEEN 0 AND 1000 AND \"by\" BETWEEN 3 AND 9)")
def stored_lines(spark, d):
    ds = store.Dataset.create(spark, _folder(spark), store.Schema("line", ("x", "y"), (50000.0, 5.0)))
    writers.write_lines(ds, V.lines(spark, d))
    return writers.read_lines(ds, box=((0, 3), (1000, 9)))


@query("stored_parametric", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS r FROM supplier WHERE s_nationkey = 3")
def stored_parametric(spark, d):
    ds = store.Dataset.create(spark, _folder(spark), store.Schema("parametric"))
    rows = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("sphere").alias("type"), F.array(F.col("s_nationkey").cast("double"), F.lit(0.0), F.lit(0.0), F.col("s_acctbal")).alias("coefficients"))
    groups = V.table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("gid")).agg(F.collect_list("s_suppkey").alias("members"))
    writers.write_parametric(ds, rows, groups=groups)
    return writers.read_parametric(ds, type="sphere", groups=[3]).select("id", "name", F.col("coefficients")[3].alias("r"))


@query("stored_composite", f"WITH {NODES} SELECT 'graph' AS kind, count(*) AS n FROM nodes UNION ALL SELECT 'mesh', count(*) FROM part")
def stored_composite(spark, d):
    both = writers.Composite(store.Dataset.create(spark, _folder(spark), store.Schema("point_cloud", ("x", "y"), (1.0, 1.0))))
    both.add("graph", {"vertices": V.graph_nodes(spark, d).select("vid", "x", "y"), "links": V.graph_edges(spark, d)})
    both.add("mesh", {"vertices": V.mesh_vertices(spark, d).select("vid", "x", "y"), "faces": V.mesh_faces(spark, d)})
    return both.vertices().groupBy("kind").agg(F.count("*").alias("n"))


@query("stored_batches", f"WITH {STREAM} SELECT cx, cy, count(*) AS n_rows, count(DISTINCT vid % 3) AS n_batches FROM stream GROUP BY cx, cy")
def stored_batches(spark, d):
    appender = ingest.Appender(spark, _folder(spark), V.CELL_STREAM, "xy")
    rows = V.streamlines(spark, d).select("vid", "oid", "x", "y")
    for k in range(3):
        appender.write(rows.where(F.col("vid") % 3 == k), k)
        appender.write(rows.where(F.col("vid") % 3 == k), k)  # a replay
    return appender.reconcile()


@query("stored_link_batches", f"WITH {NODES} SELECT a.cx AS scx, a.cy AS scy, b.cx - a.cx AS ox, b.cy - a.cy AS oy, count(*) AS n_links FROM edges JOIN nodes a ON src = a.vid JOIN nodes b ON dst = b.vid GROUP BY ALL")
def stored_link_batches(spark, d):
    appender = ingest.LinkAppender(spark, _folder(spark), V.graph_nodes(spark, d), "xy")
    edges = V.graph_edges(spark, d)
    for k in range(2):
        appender.write(edges.where(F.col("src") % 4 == 2 * k), k)
    return appender.counts()


@query("stored_manifest_batches", MANIFEST + " SELECT oid, count(*) AS n_fragments FROM man GROUP BY oid")
def stored_manifest_batches(spark, d):
    folder = _folder(spark)
    rows = objects.object_manifest(objects.fragment_rank(V.dense_points(spark, d)))
    first = ingest.ManifestAppender(spark, folder)
    first.write(rows.where("oid < 6"), 0)
    again = ingest.ManifestAppender(spark, folder, base_oid=4)  # a run that resumes at 4
    again.write(rows.where("oid >= 4"), 1)
    return again.lengths()


@query("octree_box_points", f"WITH {LARGE} SELECT oid, seq, part FROM large WHERE {BOX_LARGE}")
def octree_box_points(spark, d):
    rows = V.large_points(spark, d)
    cells = rows.groupBy(*(F.col("c" + a).alias(i) for a, i in zip("xyz", "ijk", strict=True))).agg(F.count("*").alias("weight"))
    level = writers.OctreeLevel(rows, layout.leaves(cells, 3, 1500), 3, V.CELL_LARGE)
    return level.read_points(box=(LO, HI)).select("oid", "seq", "part")


@query("octree_seams", f"WITH {NODES}, p AS (SELECT vid, least(7, greatest(0, cx)) AS i, least(7, cy) AS j FROM nodes) SELECT a.i AS ai, a.j AS aj, count(*) AS n FROM edges JOIN p a ON src = a.vid JOIN p b ON dst = b.vid WHERE (a.i, a.j) <> (b.i, b.j) GROUP BY 1, 2")
def octree_seams(spark, d):
    nodes = V.graph_nodes(spark, d).select("vid", *(F.least(F.lit(7), F.greatest(F.lit(0), F.col(c))).cast("long").alias(n) for c, n in (("cx", "i"), ("cy", "j"))), F.lit(0).cast("long").alias("k"))
    cells = nodes.groupBy("i", "j", "k").agg(F.count("*").alias("weight"))
    placed = layout.in_leaf(nodes, layout.leaves(cells, 3, 0), 3)
    cut = readers.seams(V.graph_edges(spark, d), placed)
    return cut.join(placed.select(F.col("vid").alias("src"), "i", "j"), "src").groupBy(F.col("i").alias("ai"), F.col("j").alias("aj")).agg(F.count("*").alias("n"))


@query("decoded_categories", "SELECT l_orderkey AS oid, l_linenumber AS line, l_returnflag AS flag FROM lineitem")
def decoded_categories(spark, d):
    rows = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("oid"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"))
    coded, values = points.encode_categories(rows, "flag")
    return points.decode_categories(coded.drop("flag"), values, "flag").select("oid", "line", "flag")


@query("objects_in_request_order", f"WITH {LARGE} SELECT a.asked, oid, seq, part FROM large JOIN (VALUES (0, 7), (1, 3), (2, 100)) a(asked, oid) USING (oid)")
def objects_in_request_order(spark, d):
    found = _large(spark, d).select(objects=(7, 3, 7, 100, 99999999)).in_request_order()
    return found.select(F.dense_rank().over(W.orderBy("asked")).cast("int").alias("asked"), "oid", "seq", "part").withColumn("asked", F.col("asked") - 1)


@query("cells_of_many_tables", f"WITH {DENSE}, r(pos, cx, cy, cz) AS (VALUES (0, 0, 0, 0), (1, 99, 0, 0), (2, -1, 0, 0)), n AS (SELECT pos, count(vid) AS n_rows FROM r LEFT JOIN dense USING (cx, cy, cz) GROUP BY pos) SELECT pos, n_rows, CAST(coalesce(sum(n_rows) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM n")
def cells_of_many_tables(spark, d):
    keys = spark.createDataFrame([(0, 0, 0, 0), (1, 99, 0, 0), (2, -1, 0, 0)], "pos int, cx long, cy long, cz long")
    found, _ = writers.read_cells_of({"vertices": V.dense_points(spark, d), "names": V.table(spark, d, "region")}, keys, on_error="record")
    return found["vertices"][1].select("pos", "n_rows", "offset")
