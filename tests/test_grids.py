"""Distances on label grids, resilience, and sweeps of a parameter, against plain NumPy."""

import numpy as np
import pytest

from orbitlake import functions as fn
from orbitlake.functions.distances import envelope

RNG = np.random.default_rng(6)


def test_envelope_is_the_least_parabola():
    for n in (1, 2, 3, 17, 60):
        for step in (1.0, 0.3, 2.5):
            h = RNG.integers(0, 40, n).astype(float) ** 2
            p = np.arange(n)
            assert np.allclose(envelope(h, step), (h[None] + (step * (p[:, None] - p[None])) ** 2).min(axis=1))


GRIDS = {"noise": RNG.integers(0, 3, (13, 17)), "disc": (np.add.outer((np.arange(21) - 10) ** 2, (np.arange(21) - 8) ** 2) < 60).astype(int), "one": np.zeros((5, 4), int), "cell": np.zeros((1, 1), int), "stripes": np.tile([1, 1, 1, 2], (6, 5))}


def grid_of(spark, labels="int"):
    return spark.createDataFrame([(b, x - 3, y + 2, int(v)) for b, m in GRIDS.items() for (x, y), v in np.ndenumerate(m)], f"b string, x long, y long, label {labels}").repartition(3)


def edges_of(m, sx, sy):
    out, wide = np.empty(m.shape), np.pad(m, 1, constant_values=-9)
    where = np.indices(wide.shape).reshape(2, -1).T - 1
    for (x, y), v in np.ndenumerate(m):
        other = where[wide.ravel() != v]
        out[x, y] = np.sqrt(((other[:, 0] - x) * sx) ** 2 + ((other[:, 1] - y) * sy) ** 2).min()
    return out


@pytest.mark.parametrize("spacing", [(1.0, 1.0), (0.5, 2.0)])
def test_edge_distances(spark, spacing):
    got = {(r["b"], r["x"], r["y"]): (r["distance"], r["label"]) for r in fn.edge_distance(grid_of(spark), spacing).collect()}
    assert len(got) == sum(m.size for m in GRIDS.values())
    for b, m in GRIDS.items():
        want = edges_of(m, *spacing)
        assert all(abs(got[b, x - 3, y + 2][0] - want[x, y]) < 1e-9 and got[b, x - 3, y + 2][1] == m[x, y] for x, y in np.ndindex(*m.shape))
    with pytest.raises(ValueError):
        fn.edge_distance(grid_of(spark), (0, 1))


def test_resilience(spark):
    disc = edges_of(GRIDS["disc"], 1, 1)
    rows = [
        ("disc", 1, 7.2, 10.0, False), ("disc", 1, 5.0, 12.4, False), ("disc", 1, -3.0, 2.0, False),  # the third is outside its basin
        ("stripes", 2, 0.0, 4.0, False), ("stripes", 2, 1.0, 5.0, True),  # all outside: the centre tells
        ("one", 0, 500.0, -500.0, False), ("noise", 9, 0.0, 4.0, False),
    ]
    attractors = spark.createDataFrame(rows, "b string, label int, u double, v double, centre boolean")
    got = {(r["b"], r["label"]): r["resilience"] for r in fn.resilience(grid_of(spark), attractors).collect()}
    assert abs(got["disc", 1] - min(disc[10, 8], disc[8, 10])) < 1e-9
    assert got["stripes", 2] == edges_of(GRIDS["stripes"], 1, 1)[4, 3] and GRIDS["stripes"][4, 3] == 2
    assert got["one", 0] == 1.0 and got["noise", 9] is None


def clusters(v, rtol):
    s = np.sort([x for x in v if x is not None and np.isfinite(x)])
    if len(s) <= 1:
        return len(s)
    span = s[-1] - s[0]
    return 1 if span <= rtol * max(s[-1] - s.mean(), s.mean() - s[0], 1.0) else 1 + int((np.diff(s) > rtol * span).sum())


def period_of(v, most, rtol):
    p = clusters(v, rtol)
    if p == 0:
        return -1
    if p == 1:
        return 1
    if p > most or len(v) <= p or any(x is None or not np.isfinite(x) for x in v):
        return 0
    tol = rtol * max(max(v) - min(v), 1.0)
    return p if all(abs(a - b) <= tol for a, b in zip(v, v[p:], strict=False)) else 0


@pytest.mark.parametrize(("most", "rtol"), [(16, 0.01), (4, 0.01), (16, 0.2)])
def test_sweeps(spark, most, rtol):
    orbit = {}
    for k, a in enumerate(np.linspace(2.8, 3.9, 23)):
        a, x = float(a), 0.3
        for _ in range(3000):
            x = a * x * (1 - x)
        seen = []
        for _ in range(60):
            x = a * x * (1 - x)
            seen.append(100 * x)
        orbit["map", float(k)] = seen
    orbit |= {("odd", 0.0): [None, None], ("odd", 1.0): [5.0], ("odd", 2.0): [1.0, 2.0, 1.0, 2.0, None], ("odd", 3.0): [1.0, float("inf"), 1.0], ("odd", 4.0): [7.0] * 9, ("odd", 5.0): [1000.0, 1000.5] * 4, ("odd", 6.0): [0.0, 0.001] * 5}
    sweep = spark.createDataFrame([(g, p, 10 * i, v) for (g, p), vs in orbit.items() for i, v in enumerate(vs)], "g string, parameter double, i long, v double").repartition(3)
    count = {(r["g"], r["parameter"]): r["branches"] for r in fn.branches(sweep, rtol).collect()}
    found = fn.periods(sweep, most, rtol)
    period = {(r["g"], r["parameter"]): r["period"] for r in found.collect()}
    assert count == {k: clusters(v, rtol) for k, v in orbit.items()}
    assert period == {k: period_of(v, most, rtol) for k, v in orbit.items()}
    points = sorted((r["g"], r["at"], r["before"], r["after"]) for r in fn.bifurcation_points(found).collect())
    want = []
    for g in ("map", "odd"):
        ps = sorted(p for h, p in orbit if h == g)
        want += [(g, (a + b) / 2, period[g, a], period[g, b]) for a, b in zip(ps, ps[1:], strict=False) if period[g, a] != period[g, b] and -1 not in (period[g, a], period[g, b])]
    assert points == want
    if most == 16 and rtol == 0.01:
        assert {1, 2, 4, 0} <= {v for (g, _), v in period.items() if g == "map"}
