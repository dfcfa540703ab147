"""Steps that are ordered passes by definition give what the pass gives, cut into runs."""

import math

import numpy as np
import pytest

from lacuna.operators import holes, prune, watershed


def _pass(rows, tolerance):
    kept, last = [], None
    for r in sorted(rows, key=lambda r: (-r[4], r[1], r[2], r[3])):
        if last is None or math.dist(r[1:4], last[1:4]) > tolerance or last[4] - r[4] > tolerance:
            last = r
            kept.append(r[0])
    return sorted(kept)


@pytest.mark.parametrize("block", [7, 100_000])
def test_duplicate_holes(spark, monkeypatch, block):
    monkeypatch.setattr(holes, "RUN_BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.uniform(-5, 5, (12, 4))
    rows = []
    for k in range(250):
        x, y, z, r = centres[k % 12] + rng.normal(0, (0.04, 0.4)[k % 5 == 0], 4)
        rows.append((k, float(x), float(y), float(z), float(abs(r) + 8)))
    rows += [(1000 + k, 0.05 * k, 0.0, 0.0, 9.0 - 0.01 * k) for k in range(40)]  # a chain whose ends are apart
    df = spark.createDataFrame(rows, "hole long, x double, y double, z double, radius double").repartition(5)
    assert sorted(r["hole"] for r in holes.remove_duplicates(df, 0.1).collect()) == _pass(rows, 0.1)
    assert holes.remove_duplicates(df.limit(0), 0.1).collect() == []


def _flooded(cores, links):
    """Voids by relabelling every zone of a set that joins another."""
    label, core, over = list(range(len(cores))), list(cores), list(cores)
    out = []

    def close(zones, last, volume):
        levels = sorted({over[z] for z in zones}, reverse=True)
        out.append({"groups": [[z for z in sorted(zones) if over[z] == v] for v in levels], "overflow": [*levels, last], "mvol": volume})

    for volume in sorted({v for *_, v in links}, reverse=True):
        touched = sorted({z for a, b, v in links if v == volume for z in (a, b)})
        top = max(touched, key=lambda z: (core[z], -z))
        best, into = core[top], label[top]
        for z in touched:
            if core[z] < best:
                own = [m for m in range(len(cores)) if label[m] == label[z]]
                close(own, volume, core[z])
                for m in own:
                    label[m], core[m], over[m] = into, best, volume
    close(range(len(cores)), 0.0, core[0])
    return out


def test_merge_tree():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 10))
        cores = sorted((float(c) for c in rng.choice([1, 2, 3, 4, 5, 6, 7.5, 9], n)), reverse=True)
        links = [(a, b, float(min(rng.choice([0.5, 1, 1.5, 2, 2.5]), cores[a], cores[b]))) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]
        assert watershed.nested_voids(cores, links) == _flooded(cores, links)
    assert watershed.nested_voids([], []) == []


def test_long_chains_of_zones():
    """Zones that join one after the other, each below the last."""
    n = 3000
    cores = [float(2 * n - k) for k in range(n)]
    tree = watershed.MergeTree(cores, [(k, k + 1, float(n - k)) for k in range(n - 1)])
    assert tree.roots == [0] and len(tree.zones(0)) == n and tree.zones(n - 1) == [n - 1]


def test_the_growing_rule():
    void = {"groups": [[0], [1, 2], [3]], "overflow": [9.0, 5.0, 2.0, 0.0], "mvol": 9.0}
    chance = prune._chance
    got = prune._grown(void, [9.0, 6.0, 6.0, 2.1], {0: 5.0, 1: 4.0, 2: 4.0, 3: 2.0})
    first = chance(9.0, 2.0) > chance(9.0, 5.0) * chance(6.0, 4.0) ** 2
    second = chance(9.0, 0.0) > chance(9.0, 2.0) * chance(2.1, 2.0)
    assert got == ([0] if first else [0, 1, 2] if second else [0, 1, 2, 3])
    assert prune._grown({"groups": [[4]], "overflow": [3.0, 0.0], "mvol": 3.0}, [0] * 5, {}) == [4]


def test_cells_in_blocks(spark):
    """The same volumes and neighbours for one region and for many blocks, periodic images included."""
    from lacuna.operators.neighbors import periodic_images
    from lacuna.operators.voronoi import voronoi

    rng = np.random.default_rng(11)
    rows = [(k, *map(float, p)) for k, p in enumerate(rng.uniform(0, 10, (160, 3)))]
    df = spark.createDataFrame(rows, "gal long, x double, y double, z double").repartition(3)
    images = periodic_images(df, (10.0, 10.0, 10.0), 5.0).filter("image").drop("image")

    def cells(**options):
        found = voronoi(df, [-10.0] * 3, [20.0] * 3, images=images, **options).collect()
        return {r["gal"]: (round(r["volume"], 9), sorted((n["gal"], round(n["area"], 9)) for n in r["neighbours"])) for r in found}

    whole = cells()
    assert cells(max_points=100, block=4.0) == whole
    assert abs(sum(v for v, _ in whole.values()) - 1000.0) < 1e-6


def test_halos_hold_what_is_within_reach(spark):
    from lacuna.operators.grid import CELL_KEY
    from lacuna.operators.growth import with_halo

    rng = np.random.default_rng(1)
    pts = rng.uniform(-20, 20, (300, 3))
    df = spark.createDataFrame([tuple(map(float, p)) for p in pts], "x double, y double, z double")
    blocks = [(0, 0, 0), (-2, 1, 3), (3, 3, -4)]
    got = with_halo(df, spark.createDataFrame(blocks, ", ".join(f"{k} long" for k in CELL_KEY)), 5.0, 3.0)
    found = {(tuple(r[k] for k in CELL_KEY), r["x"]) for r in got.collect()}
    want = {(b, float(p[0])) for b in blocks for p in pts if all(5 * k - 3 <= c < 5 * (k + 1) + 3 for k, c in zip(b, p, strict=True))}
    assert found == want
