"""Slices and boundary cuts on small cases worked out by hand."""

import math

import numpy as np
import pytest

from lacuna.operators import holes, slices, volume
from lacuna.operators.mask import Footprint
from lacuna.operators.prune import void_zones


def test_cone_segments(spark):
    rng = np.random.default_rng(0)
    rows = [tuple(rng.uniform(-1, 1, 3).tolist() for _ in range(3)) for _ in range(300)]
    triangles = spark.createDataFrame(rows, "p1 array<double>, p2 array<double>, p3 array<double>")
    for dec in (20.0, -35.0):
        found = slices.cone_segments(triangles, dec).collect()
        assert len(found) > 30
        for r in found:
            for end in "ab":
                x, y, z = r[end]
                assert math.degrees(math.atan2(z, math.hypot(x, y))) == pytest.approx(dec, abs=1e-6)
                assert r[f"r_{end}"] == pytest.approx(math.dist((x, y, z), (0, 0, 0)))


def test_plane_segments_chain(spark):
    """The cut through a pyramid is one closed loop."""
    apex, base = [0.0, 0.0, 1.0], [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [-1.0, 0.0, 0.0], [0.0, -1.0, 0.0]]
    rows = [(1, apex, base[k], base[(k + 1) % 4]) for k in range(4)]
    cut = slices.plane_segments(spark.createDataFrame(rows, "void long, p1 array<double>, p2 array<double>, p3 array<double>"), 2, 0.5)
    path = slices.chain_segments(cut).orderBy("nth").collect()
    assert len(path) == 5 and {r["loop"] for r in path} == {0}
    assert (path[0]["x"], path[0]["y"]) == (path[-1]["x"], path[-1]["y"])


def test_outlines(spark):
    circles = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (0, 1.0, 0.0, 1.0)], "void long, u double, v double, circle double")
    points = slices.outlines(circles).collect()
    assert 0 < len(points) < 200
    assert all(math.hypot(p["u"] - c, p["v"]) >= 1 - 1e-9 for p in points for c in (0.0, 1.0))


def test_boundary_cuts(spark):
    box = Footprint("box", low=(0.0,) * 3, high=(20.0,) * 3)
    rows = [(0, 10.0, 10.0, 10.0, 5.0), (1, 10.0, 10.0, 2.0, 6.0), (2, 10.0, 10.0, 5.9, 6.0)]
    spheres = spark.createDataFrame(rows, "hole long, x double, y double, z double, radius double")
    plain = {r["hole"] for r in holes.cut_by_axis_caps(spheres, box).collect()}
    assert plain == {0, 2}
    found = {r["hole"]: r["boundary"] for r in holes.check_bounds(spheres, box, points_per_volume=5.0).collect()}
    assert found[0] is False and 1 not in found and found.get(2) in (True, False)


def test_volumes(spark):
    one = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 3.0), (0, 1.0, 0.0, 0.0, 3.0), (1, 9.0, 0.0, 0.0, 2.0)], "void long, x double, y double, z double, radius double")
    found = {r["void"]: r for r in volume.sphere_volumes(one, samples=100_000).collect()}
    whole = 4 / 3 * math.pi * 8
    assert found[1]["union"] == pytest.approx(whole, rel=0.02) and found[1]["common"] == pytest.approx(whole, rel=0.02)
    assert found[0]["union"] > found[0]["common"] > 0
    assert volume.union_volume_grid(one.filter("void = 1"), 0.1) == pytest.approx(whole, rel=0.01)
    radii = {r["void"]: r["r_eff"] for r in volume.effective_radii(one, samples=100_000).collect()}
    assert radii[1] == pytest.approx(2.0, rel=0.01)


def test_growing_rule():
    void = {"groups": [[0], [1]], "overflow": [9.0, 8.0, 1.0], "mvol": 9.0}
    assert void_zones([void], 2, 3, 1.0, cores=[9.0, 8.5], max_link={0: 8.0, 1: 8.0}) == [[0, 1]]
    void = {"groups": [[0], [1]], "overflow": [9.0, 8.0, 8.9], "mvol": 9.0}
    assert void_zones([void], 2, 3, 1.0, cores=[9.0, 8.5], max_link={0: 1.0, 1: 1.0}) == [[0]]
