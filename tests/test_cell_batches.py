"""Cells cut in batches against cells cut one by one."""

import numpy as np
import pyarrow as pa
import pytest

from lacuna.operators import voronoi as vor
from lacuna.operators.grid import XYZ
from lacuna.operators.growth import PointIndex


def cloud(n: int) -> np.ndarray:
    """Dense in the middle, with far points and wide cells around."""
    return np.clip(np.random.default_rng(5).normal(0.0, 0.15, (n, 3)), -0.99, 0.99)


def batches(xyz: np.ndarray, whole_box: bool = False) -> dict[int, dict]:
    home = np.arange(len(xyz)) * 10
    found = vor._batches(xyz, home, 0.2, (), home, xyz, (-1.0,) * 3, (1.0,) * 3, whole_box, None)
    return {r["gal"]: r for t in found for r in t.to_pylist()}


def one_by_one(xyz: np.ndarray, k: int) -> tuple[float, dict[int, float], bool]:
    index = PointIndex(xyz, 0.2)
    faces = vor.voronoi_cell(index, int(np.flatnonzero(index.order == k)[0]), xyz[k], np.full(3, -1.0), np.full(3, 1.0))
    bounded = all(name >= 0 for name, _ in faces)
    return vor.cell_volume(xyz[k], faces), {int(index.order[name]) * 10: vor.polygon_area(f) for name, f in faces if name >= 0}, bounded


def test_points_in_general_position_are_cut_in_batches(monkeypatch):
    xyz = cloud(700)
    table = pa.table({"gal": np.arange(len(xyz)), **{c: xyz[:, k] for k, c in enumerate(XYZ)}})

    def single(*_):
        raise AssertionError("cut one by one")

    monkeypatch.setattr(vor, "voronoi_cell", single)
    made = vor._block_cells(table, table, 0.2, (None, None), (-1.0,) * 3, (1.0,) * 3, True, None)
    assert sum(made.column("volume").to_pylist()) == pytest.approx(8.0, rel=1e-9)


def test_batches_give_the_cells_that_are_cut_one_by_one():
    xyz = cloud(500)
    boxed, free = batches(xyz, True), batches(xyz)
    for k in range(0, 500, 5):
        volume, near, bounded = one_by_one(xyz, k)
        assert boxed[10 * k]["volume"] == pytest.approx(volume, rel=1e-9)
        assert {n["gal"]: n["area"] for n in boxed[10 * k]["neighbours"]} == pytest.approx(near, rel=1e-6, abs=1e-9)
        assert free[10 * k]["bounded"] == bounded and free[10 * k]["volume"] == (boxed[10 * k]["volume"] if bounded else 0.0)
        for n in boxed[10 * k]["neighbours"]:
            corners = np.array(n["polygon"])
            assert vor.polygon_area(corners) == pytest.approx(n["area"], rel=1e-6, abs=1e-12)
            assert np.linalg.norm(corners - xyz[k], axis=1) == pytest.approx(np.linalg.norm(corners - xyz[n["gal"] // 10], axis=1), rel=1e-6)


@pytest.mark.parametrize("n", [1, 2, 27])
def test_lattices_and_few_points(n):
    grid = np.stack(np.meshgrid(*[np.arange(3)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)[:n] / 3.0 - 1.0 / 3.0
    made = batches(grid, True)
    assert len(made) == n and sum(r["volume"] for r in made.values()) == pytest.approx(8.0, rel=1e-9)


def test_repeated_points_share_a_cell():
    xyz = cloud(60)
    made = batches(np.concatenate((xyz, xyz[:7])), True)
    alone = batches(xyz, True)
    for k in range(7):
        assert made[10 * k]["volume"] == made[10 * (60 + k)]["volume"] == pytest.approx(alone[10 * k]["volume"], rel=1e-9)
