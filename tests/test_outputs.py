"""Sinks with header values, runs that go on where they stopped, and tables for pictures."""

import math

import numpy as np
import pytest

from lacuna.operators import mask
from lacuna.operators.mask import Footprint
from lacuna.plans.find_voids import find_voids
from lacuna.plans.watershed import Watershed, WatershedConfig
from lacuna.sources import outputs, tables


@pytest.fixture(scope="module")
def box(spark):
    rng = np.random.default_rng(4)
    rows = [(k, *map(float, p)) for k, p in enumerate(rng.uniform(0, 20, (400, 3)))]
    return spark.createDataFrame(rows, "gal long, x double, y double, z double").checkpoint(), Footprint("box", low=(0.0,) * 3, high=(20.0,) * 3)


def test_names_of_catalogues():
    assert outputs.catalogue_path("o", "s") == "o/s_spheres"
    assert {outputs.catalogue_path("o", "s", m) for m in (1, 2, 3, "zobov2")} == {"o/s_zones_ZOBOV"}
    assert outputs.catalogue_path("o", "s", "VIDE") == outputs.catalogue_path("o", "s", 0) == "o/s_zones_VIDE"


def test_catalogue_grows(spark, tmp_path, box):
    points, footprint = box
    path = outputs.catalogue_path(str(tmp_path), "survey")
    outputs.save_preprocessing(spark, path, {"ZLIML": 0.1, "ZLIMU": 0.2})
    outputs.save_selection(path, points.filter("gal % 3 > 0"), points.filter("gal % 3 = 0"), outputs.separation_info(spark.createDataFrame([(1.0,), (3.0,)], "dist double")), -20.0)
    cells, n = mask.sky_mask(spark.createDataFrame([(float(r) + 0.5, float(d) + 0.5) for r in range(40) for d in range(30)], "ra double, dec double"), 1), 1
    sky = Footprint("sky", cells, n, 10.0, 50.0)
    outputs.save_mask(spark, path, sky)
    found = find_voids(points, footprint, hole_grid_edge_length=4.0, min_maximal_radius=1.0)
    outputs.save_voids(path, found.maximals, found.holes, footprint, found.info)
    back = tables.Catalog.read(spark, path)
    assert set(back.tables) == {"wall", "field", "mask", "maximals", "holes"}
    assert back.info["ZLIMU"] == 0.2 and back.info["AVSEP"] == 2.0 and back.info["SEPLIM"] == 3.5 and back.info["MAGLIM"] == -20.0
    exact = math.radians(40) * (math.sin(math.radians(30)) + math.sin(math.radians(1)))  # the first row of cells spans the equator
    assert back.info["COVSTR"] == pytest.approx(exact, rel=0.02)
    assert back.info["VOLUME"] == pytest.approx(8000.0) and back.info["HOLE"] == back["holes"].count()
    assert back.info["VOID"] == back.info["VOID0"] + back.info["VOID1"] + back.info["VOID2"] == back["maximals"].count()
    assert back["wall"].count() + back["field"].count() == 400


def test_names_of_columns_are_kept(spark, tmp_path):
    tables.Catalog({"t": spark.createDataFrame([(1, 2)], "RA long, dec long")}).save(str(tmp_path / "a"))
    back = tables.Catalog.read(spark, str(tmp_path / "a"))
    assert back["t"].columns == ["ra", "dec"]
    back.save(str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b" / "t")).columns == ["RA", "dec"]


def test_growth_goes_on(spark, tmp_path, box):
    points, footprint = box
    options = {"hole_grid_edge_length": 4.0, "min_maximal_radius": 1.0}
    path = str(tmp_path / "grown")
    want = sorted(map(repr, find_voids(points, footprint, **options).holes.collect()))
    assert sorted(map(repr, find_voids(points, footprint, resume_path=path, batch_cells=40, **options).holes.collect())) == want
    kept = sorted(p.name for p in (tmp_path / "grown").iterdir() if p.name.startswith("batch="))
    assert len(kept) > 1
    assert sorted(map(repr, find_voids(points, footprint, resume_path=path, batch_cells=40, **options).holes.collect())) == want


def test_stages_and_pictures(spark, tmp_path, box, monkeypatch):
    points, _ = box
    config = WatershedConfig(xyz=True, min_radius=0.0, low=(0.0,) * 3, high=(20.0,) * 3)
    folder = str(tmp_path / "stages")
    run = Watershed(points.limit(150), config, folder)
    assert set(r["nnls"] for r in run.tracers().collect()) <= {-1, *range(400)}
    voids = run.sort_voids("REVOLVER")
    monkeypatch.setattr(Watershed, "_tessellate", lambda self: pytest.fail("the cells were there"))
    again = Watershed(points.limit(150), config, folder)
    assert sorted(map(repr, again.zones.collect())) == sorted(map(repr, run.zones.collect()))
    pictures = run.pictures(voids["zonevoid"])
    rows = pictures["triangle"].collect()
    assert rows
    for r in rows[:200]:
        n = np.array([r["n_x"], r["n_y"], r["n_z"]])
        p = [np.array([r[f"p{k}_{c}"] for c in "xyz"]) for k in (1, 2, 3)]
        assert np.linalg.norm(n) == pytest.approx(1.0) or np.linalg.norm(np.cross(p[1] - p[0], p[2] - p[0])) < 1e-9
        assert abs(n @ (p[1] - p[0])) < 1e-6 and abs(n @ (p[2] - p[0])) < 1e-6
    seen = {r["gid"]: r for r in pictures["galviz"].collect()}
    own = {r["gal"]: r["zone"] for r in run.members.collect()}
    void = {r["zone"]: r["void1"] for r in voids["zonevoid"].collect()}
    places = {r["gal"]: np.array([r["x"], r["y"], r["z"]]) for r in run.kept.collect()}
    for g in list(seen)[:40]:
        near = min((o for o in places if o != g), key=lambda o: (float(((places[o] - places[g]) ** 2).sum()), o))
        assert seen[g]["g2v"] == void.get(own[g], -1) and seen[g]["g2v2"] == void.get(own[near], -1)


def test_volume_of_all_spheres(spark):
    from lacuna.operators.volume import volume_of_spheres

    two = spark.createDataFrame([(0.0, 0.0, 0.0, 2.0), (1.0, 0.0, 0.0, 2.0)], "x double, y double, z double, radius double")
    ball, lens = 4 / 3 * math.pi * 8, math.pi * (4 * 2 + 1) * (2 * 2 - 1) ** 2 / 12
    r = volume_of_spheres(two, 20_000).first()
    assert abs(r["common"] - lens) < 4 * r["common_error"] and abs(r["union"] - (2 * ball - lens)) < 4 * r["union_error"]
    assert volume_of_spheres(two.limit(0), 100).first()["union"] == 0.0
