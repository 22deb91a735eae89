import numpy as np
import pytest

from lattica.sources import levels
from lattica.sources.store import Dataset, Schema, StoreError
from lattica.operators.edits import EditSession


@pytest.fixture()
def ds(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = []
    for o in range(20):
        walk = np.clip(np.cumsum(rng.normal(0, 4, (30, 2)), 0) + rng.uniform(20, 80, 2), 0.0, 99.9)
        rows += [(o * 30 + k, o, k, *map(float, p)) for k, p in enumerate(walk)]
    found = Dataset.create(spark, f"file://{tmp_path}/ds", Schema("streamline", ("x", "y"), (20.0, 20.0), (5.0, 5.0)))
    found.write_vertices(spark.createDataFrame(rows, "vid long, oid long, seq long, x double, y double"))
    return found


def test_pyramid_is_one_snapshot_and_composes(spark, ds):
    before = ds.snapshot()["id"]
    levels.build_pyramid(ds, [(2, 1.0), (2, 1.0)], depth=-1)
    assert ds.snapshot()["parent"] == before and ds.snapshot()["levels"] == [0, 1, 2]
    counts = [ds.level(k).count() for k in range(3)]
    assert counts == sorted(counts, reverse=True) and counts[0] == 600
    parents = ds.table("parents").toPandas()
    one = dict(parents[(parents.level == 0) & (parents.delta == 1)][["vid", "parent"]].values)
    two = dict(parents[(parents.level == 1) & (parents.delta == 1)][["vid", "parent"]].values)
    far = dict(parents[(parents.level == 0) & (parents.delta == 2)][["vid", "parent"]].values)
    assert len(one) == 600 and far == {v: two[p] for v, p in one.items()}
    assert set(one.values()) == {r["vid"] for r in ds.level(1).dataframe().select("vid").distinct().collect()}
    with pytest.raises(StoreError):
        levels.build_pyramid(ds, [(2, 1.0)])


def test_refresh_follows_edits(spark, ds):
    levels.build_pyramid(ds, [(4, 1.0)])
    old = ds.level(1).count()
    with EditSession(ds) as e:
        for o in range(10):
            e.remove_object(o)
    levels.refresh_pyramid(ds)
    assert ds.level(0).count() == 300 and 0 < ds.level(1).count() < old


def test_rewrites_keep_the_rows(spark, ds, tmp_path):
    rows = sorted(map(tuple, ds.level().dataframe().select("vid", "x", "y").collect()))
    levels.reshard(ds, 3)
    assert len(ds.table("vertices").inputFiles()) <= 3
    again = levels.rechunk(ds, f"file://{tmp_path}/other", (50.0, 50.0))
    for d in (ds, again):
        assert sorted(map(tuple, d.level().dataframe().select("vid", "x", "y").collect())) == rows
    assert again.level().cells().count() <= 4
    assert again.level().select(box=((0, 0), (40, 40))).count() == ds.level().select(box=((0, 0), (40, 40))).count()


def test_attributes(spark, ds):
    levels.add_attribute(ds, "vertices", spark.createDataFrame([(3, 1.5)], "vid long, w double"), "vid")
    assert ds.table("vertices").where("w = 1.5").count() == 1 and ds.level().count() == 600
    with pytest.raises(StoreError):
        levels.add_attribute(ds, "vertices", spark.createDataFrame([(3, 1.5)], "vid long, w double"), "vid")
    levels.remove_attribute(ds, "vertices", "w")
    assert "w" not in ds.table("vertices").columns
    with pytest.raises(StoreError):
        levels.remove_attribute(ds, "vertices", "w")
