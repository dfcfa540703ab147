"""Formulas against values worked out beforehand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions import cosmology, geometry
from lacuna.functions.sky import to_radec_unsigned


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize("z, want", [(0.1, 418.45448763), (0.2, 816.72323905), (0.5, 1888.62539593), (1.0, 3303.82880589)])
def test_comoving_distance(spark, z, want):
    assert one(spark, cosmology.comoving_distance(F.col("z"), 0.3, 0.7, cosmology.C_WATERSHED), z=z) == pytest.approx(want, abs=1e-6)
    assert float(cosmology.distances(z, 0.3, 0.7, cosmology.C_WATERSHED)) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("xyz, want", [((500.0, 0.0, 0.0), 0.12006335), ((1000.0, 0.0, 0.0), 0.2478459), ((1500.0, 0.0, 0.0), 0.38520913), ((0.0, 1000.0, 1000.0), 0.36086924)])
def test_redshift_at(spark, xyz, want):
    assert one(spark, cosmology.redshift_at(F.lit(math.dist(xyz, (0, 0, 0))), 0.3, 0.7), a=1) == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("ratio, want", [(1.1, 0.599029897), (2.0, 0.00451658094), (3.0, 5.08084353e-06), (10.0, 7.30041296e-78)])
def test_fake_void_probability(spark, ratio, want):
    assert geometry.fake_void_chance(ratio) == pytest.approx(want, rel=1e-6)
    assert one(spark, geometry.fake_void_probability(F.col("r")), r=ratio) == pytest.approx(want, rel=1e-6)


def test_lens_volume(spark):
    whole = 4.0 * math.pi / 3.0
    lens = geometry.lens_volume(F.col("a"), F.col("b"), F.col("d"))
    assert one(spark, lens, a=1.0, b=1.0, d=2.5) == 0.0
    assert one(spark, lens, a=1.0, b=3.0, d=0.5) == pytest.approx(whole)
    assert one(spark, lens, a=1.0, b=1.0, d=1.0) == pytest.approx(math.pi * 5.0 / 12.0)


def test_right_ascension_of_the_axes(spark):
    def ra(x, y):
        return one(spark, to_radec_unsigned(F.lit(x), F.lit(y), F.lit(0.0))[1], a=1)

    assert [ra(1.0, 0.0), ra(0.0, 1.0), ra(-1.0, 0.0), ra(0.0, -1.0)] == [0.0, 90.0, 0.0, 270.0]


def test_small_arithmetic():
    assert geometry.header_number(0.123456) == 0.123 and geometry.header_number(12.3456) == 12.35
    assert geometry.common_divisors([12, 18, 24]) == [1, 2, 3]
    assert geometry.flatten([[0, [1, 2]], [3], 4]) == [0, 1, 2, 3, 4]
    assert np.allclose(np.linalg.norm(geometry.spiral_sphere(20), axis=1), 1.0)
    square = np.array([[0, 0, 1.0], [2, 0, 1], [2, 2, 1], [0, 2, 1]])
    assert geometry.polygon_area(square) == pytest.approx(4.0)
    assert np.allclose(np.ptp(geometry.into_plane(square), axis=0), 2.0)
    assert geometry.significance(0.0455) == pytest.approx(2.0, abs=1e-3)
