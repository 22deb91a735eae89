import itertools
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.functions import grid


@given(st.permutations(range(5)))
def test_lehmer_round_trip(p):
    assert grid.from_lehmer(grid.lehmer(p), len(p)) == list(p)


def test_lehmer_is_lexicographic_rank():
    assert [grid.lehmer(p) for p in itertools.permutations(range(4))] == list(range(24))


def test_cells_floor_towards_minus_infinity(spark):
    df = spark.createDataFrame([(v,) for v in (-7.0, -0.5, 0.0, 4.999, 5.0)], "x double")
    assert [r[0] for r in df.select(grid.cell("x", 5.0)).collect()] == [-2, -1, 0, 0, 1]


def test_local_bin_of_negative_positions(spark):
    df = spark.createDataFrame([(-0.01, 0.0), (0.99, 0.51)], "x double, y double")
    found = [r[0] for r in df.select(grid.local_bin("xy", (1.0, 1.0), (0.5, 0.5))).collect()]
    assert found == [2, 3]


def test_bins_must_tile():
    with pytest.raises(ValueError):
        grid.bins_per_chunk((1.0,), (0.3,))


def test_morton(spark):
    df = spark.createDataFrame([(1, 0, 0), (0, 1, 0), (0, 0, 1), (3, 3, 3)], "a long, b long, c long")
    assert [r[0] for r in df.select(grid.morton(["a", "b", "c"], 2)).collect()] == [4, 2, 1, 63]


def test_residue_of_name(spark):
    import hashlib

    names = ["a", "writer-7", "é"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    expected = [int.from_bytes(hashlib.sha256(n.encode()).digest()[:8], "little") % 1009 for n in names]
    assert [r[0] for r in df.select(grid.residue_of(F.col("n"), 1009)).collect()] == expected


def test_offsets_and_grid():
    assert len(grid.offsets(3)) == 27 and grid.offsets(3)[0] == (0, 0, 0)
    g = grid.Grid((10.0, 10.0), ((-5.0, 0.0), (25.0, 9.0)))
    assert g.key((-5, 9)) == (-1, 0) and g.shape() == (4, 1)
    assert grid.nearest_scale([(1, 1), (4, 4), (16, 16)], 5) == 1
    assert math.isclose(math.prod(g.sized_for(27)), 30 * 9 / 27)
