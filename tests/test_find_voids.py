"""The synthetic survey with four carved spheres, against values worked out beforehand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators.grid import empty_cells, hole_grid
from lacuna.operators.growth import grow_spheres
from lacuna.operators.mask import Footprint
from lacuna.plans.find_voids import find_voids

# Carved spheres (x, y, z, radius), and the expected maximal spheres with their numbers of holes.
CARVED = [(24.0, 7.9, 0.1, 2.0), (10.5, 3.2, -0.5, 0.5), (25.0, 8.0, 0.0, 2.5), (10.0, 3.0, -1.0, 1.5)]
MAXIMALS = [(25.0170169, 7.9964706, 0.0073449, 2.4859291, 26), (9.9562288, 2.9713455, -1.0526692, 1.4448846, 4)]


@pytest.fixture(scope="module")
def survey(spark):
    ra, dec, z = np.meshgrid(np.arange(10, 30, 0.5), np.arange(-10, 10, 0.5), np.arange(0.0005, 0.011, 0.0001), indexing="ij")
    r = 299792.0 * z.reshape(-1) / 100.0
    a, d = np.radians(ra.reshape(-1)), np.radians(dec.reshape(-1))
    xyz = np.stack((r * np.cos(a) * np.cos(d), r * np.sin(a) * np.cos(d), r * np.sin(d)), axis=1)
    xyz = np.concatenate((xyz, np.zeros((1, 3))))
    carved = np.zeros(len(xyz), bool)
    for x, y, w, radius in CARVED:
        carved |= ((xyz - (x, y, w)) ** 2).sum(axis=1) < radius * radius
    import pandas as pd

    frame = spark.createDataFrame(pd.DataFrame(np.column_stack((xyz, carved)), columns=["x", "y", "z", "c"])).checkpoint()
    cells = spark.range(20).select((F.col("id") + 10).cast("int").alias("ra_idx"), F.explode(F.expr("sequence(80, 99)")).alias("dec_idx"))
    footprint = Footprint("sky", cells, 1, 0.0, 299792.0 * 0.0109 / 100.0)
    return frame.filter("c = 0").drop("c"), frame.filter("c = 1").drop("c"), footprint


def test_survey_and_grid(survey):
    wall, field, footprint = survey
    assert wall.count() == 158_636
    grid = hole_grid(wall.unionByName(field), 1.0)
    assert grid.shape == (33, 17, 12)
    cells = empty_cells(wall, grid)
    assert cells.count() == 4881
    assert footprint.inside(cells).count() == 33


def test_find_voids(survey):
    wall, field, footprint = survey
    voids = find_voids(wall, footprint, field, hole_grid_edge_length=1.0, min_maximal_radius=1.0)
    maximals = {r["void"]: r for r in voids.maximals.collect()}
    holes = [r["void"] for r in voids.holes.collect()]
    assert len(holes) == 30
    for void, (x, y, z, radius, n) in enumerate(MAXIMALS):
        got = maximals[void]
        assert got["x"] == pytest.approx(x, abs=1e-6) and got["y"] == pytest.approx(y, abs=1e-6)
        assert got["z"] == pytest.approx(z, abs=1e-6) and got["radius"] == pytest.approx(radius, abs=1e-6)
        assert holes.count(void) == n
    assert [maximals[v]["edge"] for v in (0, 1)] == [0, 1]


def test_blocks_give_what_broadcast_gives(spark, survey):
    wall, field, footprint = survey
    cells = footprint.inside(empty_cells(wall, hole_grid(wall.unionByName(field), 1.0)))
    near = wall.filter("x > 18")
    whole = {r["cell"]: r["radius"] for r in grow_spheres(cells.filter("x > 20"), near, footprint, 1.0).collect()}
    blocks = {r["cell"]: r["radius"] for r in grow_spheres(cells.filter("x > 20"), near, footprint, 1.0, broadcast_points=10, block=8.0).collect()}
    assert whole.keys() == blocks.keys() and len(whole) > 10
    assert all(whole[k] == pytest.approx(blocks[k], abs=1e-9) for k in whole)
