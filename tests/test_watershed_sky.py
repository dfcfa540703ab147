"""The watershed finder on a sky survey and in a periodic box, from the command line."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna import cli
from lacuna.plans.watershed import Watershed, WatershedConfig
from lacuna.sources.tables import Catalog

INI = """[Paths]
Input Catalog = none
[Cosmology]
H_0 = 100
Omega_m = 0.3
[Settings]
redshift_min = 0.03
redshift_max = 0.1
rabsmag_min = -18
radius_min = 1
nside = 4
"""


@pytest.fixture(scope="module")
def sky(spark):
    rng = np.random.default_rng(4)
    n = 220
    frame = pd.DataFrame({"gal": np.arange(n), "ra": rng.uniform(100, 150, n), "dec": rng.uniform(0, 40, n), "redshift": rng.uniform(0.02, 0.11, n), "rabsmag": rng.uniform(-22, -17, n)})
    return spark.createDataFrame(frame).checkpoint()


def test_sky_survey(sky):
    run = Watershed(sky, WatershedConfig(zmin=0.03, zmax=0.1, maglim=-18.0, min_radius=1.0, nside=4))
    kept = sky.filter("redshift > 0.03 and redshift < 0.1 and rabsmag < -18").count()
    assert run.kept.count() == kept
    cells = run.cells.collect()
    assert len(cells) == kept and any(c["volume"] > 0 for c in cells) and any(c["volume"] == 0 for c in cells)
    tables = run.sort_voids("ZOBOV")
    galzone = tables["galzone"]
    assert galzone.count() == sky.count()
    assert galzone.filter("out = 1").count() == sky.count() - kept
    assert galzone.filter("edge = 1").count() == sum(c["volume"] == 0 for c in cells)
    for v in tables["voids"].collect():
        assert 0 <= v["ra"] < 360 and v["redshift"] < 0.12 and v["radius"] > 1


def test_command_line(spark, sky, tmp_path):
    (tmp_path / "c.ini").write_text(INI)
    sky.drop("gal").withColumnRenamed("redshift", "z").write.parquet(str(tmp_path / "sky.parquet"))
    cli.main([str(tmp_path / "c.ini"), str(tmp_path / "sky.parquet"), str(tmp_path / "out"), "-m", "VIDE"])
    assert set(Catalog.read(spark, str(tmp_path / "out")).tables) == {"voids", "zonevoid", "galzone"}


def test_periodic_box(spark):
    xyz = np.random.default_rng(5).uniform(0, 10, (120, 3))
    box = spark.createDataFrame(pd.DataFrame({"gal": np.arange(120), **{c: xyz[:, k] for k, c in enumerate("xyz")}}))
    run = Watershed(box, WatershedConfig(periodic=True, min_radius=0.0, low=(0.0,) * 3, high=(10.0,) * 3, buffer=6.0))
    assert run.cells.agg(F.sum("volume")).first()[0] == pytest.approx(1000.0, rel=1e-9)
    assert run.members.filter("zone < 0").count() == 0
