"""The bundled tables seen as geometry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions import grid
from lattica.sources.store import by_key

#: Cell sizes of the large and of the dense point cloud.
CELL_LARGE = (10.0, 2.0, 2.0)
CELL_DENSE = (0.05, 0.05, 0.05)
#: Streamlines: value and hour of the day.
CELL_STREAM = (5.0, 6.0)


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir for a dataset that a query writes and reads back."""
    from lattica.sources.store import shared_folder

    return f"{shared_folder(spark)}/dataset-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def large_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points: quantity, discount and tax; the order is the object."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("oid"),
        F.col("l_linenumber").cast("long").alias("seq"),
        F.col("l_partkey").alias("part"),
        F.col("l_quantity").alias("x"),
        (F.col("l_discount") * F.lit(100.0)).alias("y"),
        (F.col("l_tax") * F.lit(100.0)).alias("z"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_extendedprice").alias("price"),
    )
    return rows.select("*", *grid.cells(CELL_LARGE))


def dense_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points: their first three components; the label is the object."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("vid"),
        F.col("label").cast("long").alias("oid"),
        *(F.element_at("embedding", k + 1).cast("double").alias(a) for k, a in enumerate("xyz")),
    )
    return rows.select("*", *grid.cells(CELL_DENSE))


def streamlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as streamlines of users: value and hour, in order of time."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("vid"),
        F.col("user_id").alias("oid"),
        F.col("ts"),
        F.col("value").alias("x"),
        F.hour("ts").cast("double").alias("y"),
        F.col("event_type").alias("kind"),
    )
    return rows.select("*", *grid.cells(CELL_STREAM, "xy"))


ORDER = ("ts", "vid")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as segments from the customer's balance to the price."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    both = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    return both.select(F.col("o_orderkey").alias("oid"), F.col("c_acctbal").alias("ax"), F.col("nation").alias("ay"), F.col("o_totalprice").alias("bx"), F.col("nation").alias("by"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (even ids) and suppliers (odd ids) at (balance, nation)."""
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("vid"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("vid"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return c.unionByName(s).select("*", *grid.cells((1000.0, 5.0), "xy"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who bought from whom, once a pair, with the number of line items."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    pairs = items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
    return pairs.groupBy((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).agg(F.count("*").alias("n_items"))


def mesh_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts at (size, price)."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vid"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return rows.select("*", *grid.cells((10.0, 100.0), "xy"))


def mesh_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each three consecutive lines of an order as a triangle; a part may be named twice."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    ends = F.array("l_partkey", F.lead("l_partkey", 1).over(w), F.lead("l_partkey", 2).over(w))
    items = by_key(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey")
    rows = items.select((F.col("l_orderkey") * 100 + F.row_number().over(w)).alias("face"), ends.alias("ends"))
    return rows.where(F.col("ends")[2].isNotNull())


#: Order nodes of the tree begin here.
ORDER_NODES = 10_000_000_000


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of regions, nations, customers and orders: oid, child, parent; ids do not overlap."""
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("oid"), F.col("r_regionkey").cast("long").alias("child"), F.lit(None).cast("long").alias("parent"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("oid"), (F.col("n_nationkey") + 100).cast("long").alias("child"), F.col("n_regionkey").cast("long").alias("parent"))
    of = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("oid"))
    customers = table(spark, sf_dir, "customer").join(of, F.col("c_nationkey") == of["n_nationkey"])
    buyers = customers.select("oid", (F.col("c_custkey") + 1000).alias("child"), (F.col("c_nationkey") + 100).cast("long").alias("parent"))
    orders = table(spark, sf_dir, "orders").join(customers.select("oid", "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    bought = orders.select("oid", (F.col("o_orderkey") + ORDER_NODES).alias("child"), (F.col("c_custkey") + 1000).alias("parent"))
    return regions.unionByName(nations).unionByName(buyers).unionByName(bought)


def brand_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as groups of parts: gid, position, members."""
    parts = table(spark, sf_dir, "part")
    rows = parts.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_partkey")).alias("members"))
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")
    return rows.select(number.alias("gid"), number.alias("position"), "members", F.col("p_brand").alias("name"))
