"""Queries whose SQL both engines run, against plain NumPy on the smallest data."""

from collections import defaultdict

import numpy as np
import pytest

from orbitlake import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def held(spark):
    out = {}
    for key in ("user_id", "event_type"):
        by = defaultdict(list)
        for r in catalog.series(spark, SF, key).collect():
            by[r["g"]].append((r["i"], r["v"]))
        out[key] = {g: np.array([v for _, v in sorted(x)]) for g, x in by.items()}
    return out


def runs(mask):
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(int), [0]))))
    return (edge[1::2] - edge[::2]).tolist()


def test_rqa(spark, held):
    got = {r["g"]: r for r in catalog.QUERIES["rqa"](spark, SF).collect()}
    for g, r in got.items():
        x = held["user_id"][g]
        m = np.abs(x[:, None] - x[None]) <= 0.5 * x.std()
        np.fill_diagonal(m, False)
        diagonal = [n for k in range(1, len(x)) for n in runs(np.diagonal(m, k))]
        vertical = [n for k in range(len(x)) for n in runs(m[:, k])]
        share = lambda z: sum(n for n in z if n >= 2) / sum(z)
        assert abs(r["recurrence_rate"] - m.sum() / len(x) ** 2) < 1e-7 and abs(r["determinism"] - share(diagonal)) < 1e-7 and abs(r["laminarity"] - share(vertical)) < 1e-7
        assert (r["l_max"], r["v_max"]) == (max(diagonal), max(vertical))


def test_box_occupancy_and_extrema(spark, held):
    for r in catalog.QUERIES["box_occupancy"](spark, SF).collect():
        x = held["event_type"][r["g"]]
        z = np.floor((np.column_stack([x[:-1], x[1:]]) - x.min()) / np.ptp(x) * r["parts"])
        p = np.unique(z, axis=0, return_counts=True)[1] / len(z)
        assert r["boxes"] == len(p) and abs(r["information"] - (p * np.log(p)).sum()) < 1e-6 and abs(r["correlation"] - np.log((p * p).sum())) < 1e-6
    got = {(r["g"], r["i"], r["kind"]) for r in catalog.QUERIES["local_extrema"](spark, SF).collect()}
    want = set()
    for g, x in held["user_id"].items():
        for i in range(1, len(x) - 1):
            if x[i] > max(x[i - 1], x[i + 1]) or x[i] < min(x[i - 1], x[i + 1]):
                want.add((g, i, "max" if x[i] > x[i - 1] else "min"))
    assert got == want


def test_power_spectral_density(spark, held):
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)
    got = {(r["g"], r["k"]): r["psd"] for r in catalog.QUERIES["power_spectral_density"](spark, SF).collect()}
    for g, x in held["event_type"].items():
        parts = [x[a : a + 64] for a in range(0, len(x) - 63, 32)]
        power = np.mean([np.abs(np.fft.rfft((p - p.mean()) * window)) ** 2 / (window**2).sum() for p in parts], axis=0)
        power[1:-1] *= 2
        assert all(abs(got[g, k] - power[k]) < 1e-4 * max(1, power[k]) for k in range(33))


def test_approximate_entropy(spark, held):
    got = {r["g"]: r["approximate_entropy"] for r in catalog.QUERIES["approximate_entropy"](spark, SF).collect()}
    for g, x in held["user_id"].items():
        def phi(m, x=x):
            t = np.column_stack([x[k : len(x) - m + 1 + k] for k in range(m)])
            return np.log((np.abs(t[:, None] - t[None]).max(axis=2) <= 0.2 * x.std()).mean(axis=1)).mean()

        assert abs(got[g] - (phi(2) - phi(3))) < 1e-6
