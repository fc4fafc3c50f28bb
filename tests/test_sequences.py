"""Factors of sequences, periods, and outcome spaces, estimators and measures of one's own, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitlake import functions as fn
from orbitlake.functions.entropy import _factors

RNG = np.random.default_rng(9)


def rows_of(spark, series, kind="double"):
    return spark.createDataFrame([(g, i, v) for g, x in series.items() for i, v in enumerate(x)], f"g string, i long, v {kind}").repartition(3)


def naive(text):
    """Each factor is the shortest run that does not occur before its own last symbol."""
    starts, at = [], 0
    while at < len(text):
        starts.append(at)
        size = 1
        while at + size <= len(text) and text.find(text[at : at + size], 0, at + size - 1) >= 0:
            size += 1
        at += size
    return starts


def test_factors_by_automaton():
    rng = random.Random(4)
    for _ in range(1500):
        text = "".join(rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.3:
            text = text * 3
        assert _factors(list(text)) == naive(text)
    assert len(_factors(["ab"] * 200_000)) == 2  # linear


def test_factors_of_series(spark):
    series = {"bits": RNG.normal(size=300).tolist(), "flat": [1.0] * 20, "one": [2.0]}
    got = {}
    for r in fn.lz76_factors(rows_of(spark, series)).orderBy("g", "factor").collect():
        got.setdefault(r["g"], []).append(r["start"])
    bits = "".join("1" if v > np.median(series["bits"]) else "0" for v in series["bits"])
    assert got == {"bits": naive(bits), "flat": [0, 1], "one": [0]}
    words = {"text": ["to", "be", "or", "not", "to", "be", "or", "to"] * 5}
    r = fn.lz76_complexity(rows_of(spark, words, "string"), None).first()
    c = len(naive("".join("tbon"[["to", "be", "or", "not"].index(w)] for w in words["text"])))
    assert (r["factors"], r["n"]) == (c, 40) and math.isclose(r["density"], c * math.log(40) / math.log(4) / 40)


def acf(x, hi):
    y = x - x.mean()
    return np.array([(y[: len(y) - k] * y[k:]).sum() for k in range(hi)]) / (y * y).sum()


PERIODIC = {"wave": np.sin(np.arange(400) * 2 * np.pi / 23.7) + 0.1 * RNG.normal(size=400), "noise": RNG.normal(size=101), "walk": np.cumsum(np.ones(50)), "flat": np.ones(40), "short": np.arange(5.0)}


@pytest.mark.parametrize(("block", "delay"), [(None, None), (64, None), (64, 90), (50, 7)])
def test_periods(spark, block, delay):
    s = rows_of(spark, {g: x.tolist() for g, x in PERIODIC.items()})
    curve = {(r["g"], r["k"]): r["value"] for r in fn.period_curve(s, max_delay=delay, dt=0.5, block=block).collect()}
    period = {r["g"]: r["period"] for r in fn.estimate_period(s, max_delay=delay, dt=0.5, block=block).collect()}
    assert {g for g, _ in curve} == {"wave", "noise", "walk"} and set(period) == set(PERIODIC)
    for g in ("wave", "noise", "walk"):
        x = PERIODIC[g]
        hi = len(x) // 2 if delay is None else min(delay, len(x) - 2)
        want = acf(x, hi)
        assert sum(1 for h, _ in curve if h == g) == hi and all(abs(curve[g, k] - v) < 1e-9 for k, v in enumerate(want))
        zero = next((k for k in range(1, hi) if want[k] < 0), None)
        if zero is None:
            assert period[g] is None
            continue
        peak = zero + int(np.argmax(want[zero:]))
        bend = want[peak - 1] - 2 * want[peak] + want[peak + 1] if peak < hi - 1 else 0
        shift = 0.5 * (want[peak - 1] - want[peak + 1]) / bend if bend else 0
        assert abs(period[g] - 0.5 * (peak + shift)) < 1e-6
    assert period["flat"] is None and period["short"] is None
    if delay is None:
        assert abs(period["wave"] - 0.5 * 23.7) < 0.3


def test_periods_by_spectrum(spark):
    s = rows_of(spark, {g: x.tolist() for g, x in PERIODIC.items()})
    period = {r["g"]: r["period"] for r in fn.estimate_period(s, "fft", dt=2.0).collect()}
    curve = {(r["g"], r["k"]): r for r in fn.period_curve(s, "fft", dt=2.0).collect()}
    x = PERIODIC["wave"]
    power = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(400))) ** 2
    assert all(abs(curve["wave", k]["value"] - v) < 1e-6 for k, v in enumerate(power) if k) and curve["wave", 10]["x"] == 10 / 800
    k = 1 + int(np.argmax(power[1:]))
    at = k + 0.5 * (power[k - 1] - power[k + 1]) / (power[k - 1] - 2 * power[k] + power[k + 1])
    assert abs(period["wave"] - 2.0 * 400 / at) < 1e-6 and abs(period["wave"] - 2 * 23.7) < 1 and period["flat"] is None
    with pytest.raises(ValueError):
        fn.period_curve(s, "none")


class Parity:
    """Odd and even samples, each with weight 2."""

    def __init__(self, most):
        self.most = most

    def symbols(self, s):
        return s.select("g", (F.col("v").cast("long") % 2).alias("symbol"), F.lit(2.0).alias("w"))

    def cardinality(self):
        return self.most


def test_spaces_estimators_and_measures_of_ones_own(spark):
    s = rows_of(spark, {"a": [1.0, 2.0, 4.0, 6.0], "b": [2.0, 2.0], "c": [1.0]})
    hist = {(r["g"], r["symbol"]): (r["n"], r["cardinality"]) for r in fn.histogram(s, Parity(3)).collect()}
    assert hist == {("a", 1): (2.0, 3.0), ("a", 0): (6.0, 3.0), ("b", 0): (4.0, 3.0), ("c", 1): (2.0, 3.0)}
    assert {r["cardinality"] for r in fn.histogram(s, Parity(None)).where("g = 'a'").collect()} == {2.0}
    gini = (lambda p: p * p, lambda t, k: (1 - t, 1 - 1 / k))
    got = {r["g"]: r["entropy"] for r in fn.entropy(fn.histogram(s, Parity(3)), gini, normalize=True).collect()}
    assert math.isclose(got["a"], (1 - (0.0625 + 0.5625)) / (2 / 3)) and got["b"] == got["c"] == 0
    halved = lambda n, total, seen, k: (0.5 * n / total + 0.5 / k, 0.5 / k)
    for measure in ("shannon", "renyi", "tsallis"):
        own = {r["g"]: r["entropy"] for r in fn.entropy(fn.histogram(s, Parity(2)), measure, smoothing=halved).collect()}
        p = np.array([0.5 * 0.25 + 0.25, 0.5 * 0.75 + 0.25])
        want = {"shannon": -(p * np.log2(p)).sum(), "renyi": -np.log2((p * p).sum()), "tsallis": 1 - (p * p).sum()}[measure]
        assert math.isclose(own["a"], want)
    with pytest.raises(TypeError):
        fn.histogram(s, "unique")
    with pytest.raises(ValueError):
        fn.entropy(fn.histogram(s, fn.Unique()), "none")
