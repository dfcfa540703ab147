"""Contained spheres: clear ones are swept, the rest are compared."""

import numpy as np

from lacuna.operators import neighbors


def test_contained_against_all_pairs(spark, monkeypatch):
    """Nested, equal, touching and crowded spheres, some larger than the box; few pairs are left to compare."""
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.integers(-1000, 1000, 3) / 10.0), float(rng.choice([1.0, 8.0, 8.5, 23.0, 60.0, 92.0]) + rng.integers(0, 20) / 10.0)) for i in range(1500)]
    rows += [(2000 + i, x, y, z, r) for i, (_, x, y, z, r) in enumerate(rows[:200])]
    rows += [(3000, 500.0, 0.0, 0.0, 10.0), (3001, 504.0, 0.0, 0.0, 6.0), (3002, 504.5, 0.0, 0.0, 6.0), (3003, 900.0, 0.0, 0.0, 0.0), (3004, 900.0, 0.0, 0.0, 0.0), (3005, 950.0, 0.0, 0.0, -1.0)]
    ids = np.array([r[0] for r in rows])
    xyz, radius = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows])
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
    inside = (d + radius[:, None] <= radius[None]) & ((radius[:, None] < radius[None]) | (ids[:, None] > ids[None])) & (ids[:, None] != ids[None])
    sizes, real = [], neighbors.pairs_within

    def pairs_within(small, large, reach):
        sizes.append(small.count() + large.count())
        return real(small, large, reach)

    monkeypatch.setattr(neighbors, "pairs_within", pairs_within)
    own = spark.createDataFrame(rows, "hole long, x double, y double, z double, radius double").coalesce(1)
    got = neighbors.contained_spheres(own)
    assert sorted(r["hole"] for r in got.collect()) == ids[inside.any(axis=1)].tolist()
    assert max(sizes) < len(rows)  # before, both sides were all spheres
