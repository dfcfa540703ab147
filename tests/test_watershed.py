"""Invariants of cells, zones and nested voids on random points in a box."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.operators import prune, watershed
from lacuna.operators.neighbors import periodic_images
from lacuna.operators.voronoi import adjacency, voronoi
from lacuna.plans.watershed import Watershed, WatershedConfig


@pytest.fixture(scope="module")
def points(spark):
    xyz = np.random.default_rng(3).uniform(0, 10, (250, 3))
    return spark.createDataFrame(pd.DataFrame({"gal": np.arange(250), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})).checkpoint()


def test_cells_fill_the_box(points):
    cells = voronoi(points, [0.0] * 3, [10.0] * 3, whole_box=True).checkpoint()
    volume = [r["volume"] for r in cells.collect()]
    assert min(volume) > 0 and sum(volume) == pytest.approx(1000.0, rel=1e-9)
    edges = adjacency(cells)
    there, back = edges.select("src", "dst"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    assert there.exceptAll(back).isEmpty() and back.exceptAll(there).isEmpty()


def test_periodic_cells_fill_the_box(points):
    images = periodic_images(points, (10.0,) * 3, 5.0).filter("image").drop("image")
    cells = voronoi(points, [-10.0] * 3, [20.0] * 3, images=images)
    assert cells.agg(F.sum("volume")).first()[0] == pytest.approx(1000.0, rel=1e-9)


def test_zones(points):
    run = Watershed(points, WatershedConfig(xyz=True, min_radius=0.0, low=(0.0,) * 3, high=(10.0,) * 3))
    members = {r["gal"]: r for r in run.members.collect()}
    zones = {r["zone"]: r for r in run.zones.collect()}
    assert len(members) == 250
    for z, row in zones.items():
        own = [m for m in members.values() if m["zone"] == z]
        assert row["zvol"] == max(m["volume"] for m in own) and members[row["core"]]["depth"] == 0
        assert sum(m["depth"] == 0 for m in own) == 1
    assert [zones[z]["zvol"] for z in range(len(zones))] == sorted((r["zvol"] for r in zones.values()), reverse=True)
    for r in run.links.collect():
        assert r["link"] <= min(zones[r["z1"]]["zvol"], zones[r["z2"]]["zvol"])
    assert len(run.voids) == len(zones)
    for method in ("VIDE", "ZOBOV", "ZOBOV2", "REVOLVER", "REVOLVER2"):
        tables = run.sort_voids(method, minsig=0.0)
        found = tables["voids"].collect()
        for v in found:
            sides = [np.linalg.norm([v[f"{c}{k}"] for c in "xyz"]) for k in (1, 2, 3)]
            assert np.prod(sides) == pytest.approx(v["radius"] ** 3, rel=1e-6)
        assert tables["galzone"].count() == 250
    assert run.sort_voids("REVOLVER")["voids"].count() == len(zones)


def test_principal_axes():
    """Four points with axes worked out beforehand; the sign of an axis is free."""
    p = np.array([1000.0] * 3) + np.array([[0, 0, 0], [100, 0, 0], [0, 100, -100], [-300, 100, 0]], float)
    axes = prune.principal_axes(10.0, (p**2).sum() * np.eye(3) - p.T @ p)
    want = np.array([-12.3314653, 7.39154934, 4.1289785])
    assert min(min(np.abs(a - want).max(), np.abs(a + want).max()) for a in axes) < 1e-6


def test_nested_voids():
    """Three zones: 1 and 2 join at 3, then both 0 at 2."""
    voids = watershed.nested_voids([9.0, 7.0, 5.0], [(1, 2, 3.0), (0, 1, 2.0)])
    assert voids == [
        {"groups": [[2]], "overflow": [5.0, 3.0], "mvol": 5.0},
        {"groups": [[1], [2]], "overflow": [7.0, 3.0, 2.0], "mvol": 7.0},
        {"groups": [[0], [1, 2]], "overflow": [9.0, 2.0, 0.0], "mvol": 9.0},
    ]
    assert prune.void_zones(voids, 3, 1, 1.0) == [[2], [1, 2], [0, 1, 2]]
    assert prune.void_zones(voids, 3, 4, 1.0) == [[0], [1], [2]]
    assert prune.void_zones(voids, 3, 0, 0.5)[1] == [1, 2]
    assert watershed.nested_voids([], []) == []
