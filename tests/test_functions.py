"""The operators of orbitlake.functions against plain NumPy, on series with ties, nulls, constants and few samples."""

import itertools
import math
from collections import Counter
from statistics import NormalDist

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orbitlake import catalog
from orbitlake import functions as fn
from orbitlake.functions import blocks
from orbitlake.functions import series as series_module
from orbitlake.functions.surrogates import _surrogate

RNG = np.random.default_rng(21)
SERIES = {
    "noise": RNG.normal(size=300),
    "wave": np.sin(np.arange(400) * 0.13) + 0.05 * RNG.normal(size=400),
    "ties": RNG.integers(0, 4, 250).astype(float),
    "walk": np.cumsum(RNG.normal(size=200)),
    "flat": np.full(60, 2.5),
    "short": np.array([3.0, 1.0, 2.0]),
}
LONG = [k for k in SERIES if k not in ("flat", "short")]


@pytest.fixture(scope="module")
def s(spark):
    rows = [(g, float(t), float(v)) for g, x in SERIES.items() for t, v in enumerate(x)]
    # values that are no numbers leave no gap
    rows += [(g, t + 0.5, v) for g in SERIES for t, v in ((0, None), (1, float("nan")), (2, float("inf")))]
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "name string, at double, value double, id int").repartition(5)
    return fn.as_series(table, "name", ["at", "id"], "value").cache()


def by(rows, *keys):
    out = {}
    for r in rows.collect():
        out[tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]] = r
    return out


def near(a, b, rel=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return a == b or abs(a - b) <= rel * max(1, abs(a), abs(b))


def ordered(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r["g"], []).append((r["i"], r["v"]))
    return {g: np.array([v for _, v in sorted(x)]) for g, x in out.items()}


def test_series_are_numbered_alike_in_chunks(spark, s):
    got = ordered(s)
    assert all(np.array_equal(got[g], SERIES[g]) for g in SERIES)
    table = spark.createDataFrame([(t, float(v)) for t, v in enumerate(SERIES["noise"])], "at int, value double").withColumn("name", F.lit("a"))
    parts = fn.as_series(table, "name", ["at"], "value", chunk=F.floor(F.col("at") / 37))
    assert np.array_equal(ordered(parts)["a"], SERIES["noise"]) and parts.select("i").distinct().count() == 300


def test_segments_do_not_show(s, monkeypatch):
    monkeypatch.setattr(series_module, "SEGMENT", 16)
    rows = by(fn.ahead(s, [1, 7, 30], segment=16), "g", "i")
    assert len(rows) == sum(map(len, SERIES.values()))
    for (g, i), r in rows.items():
        for k in (1, 7, 30):
            assert r[f"a{k}"] == (SERIES[g][i + k] if i + k < len(SERIES[g]) else None)


def patterns(x, m, tau):
    return Counter(tuple(np.argsort(x[i : i + (m - 1) * tau + 1 : tau], kind="stable")) for i in range(len(x) - (m - 1) * tau))


@pytest.mark.parametrize("m,tau", [(3, 1), (4, 2), (5, 3)])
def test_permutation_entropy(s, m, tau):
    got, weighted = by(fn.permutation_entropy(s, m, tau), "g"), by(fn.permutation_entropy(s, m, tau, weighted=True), "g")
    for g, x in SERIES.items():
        c = patterns(x, m, tau)
        if not c:
            assert g not in got
            continue
        p = np.array(list(c.values())) / sum(c.values())
        assert near(got[g]["entropy"], -(p * np.log(p)).sum() / math.log(math.factorial(m)))
        w = Counter()
        for i in range(len(x) - (m - 1) * tau):
            part = x[i : i + (m - 1) * tau + 1 : tau]
            w[tuple(np.argsort(part, kind="stable"))] += part.var()
        p = np.array([v for v in w.values() if v > 1e-12])
        p = p / p.sum() if len(p) else p
        assert near(weighted[g]["entropy"], -(p * np.log(p)).sum() / math.log(math.factorial(m)) if len(p) else 0.0, 1e-7)


def test_entropies_compose(s):
    spaces = {"amplitude": (fn.Amplitude(7), 7), "unique": (fn.Unique(), None), "dispersion": (fn.Dispersion(5, 3, 2), 125), "ordinal": (fn.Ordinal(3, 2), 6)}
    for name, (space, k) in spaces.items():
        hist = fn.histogram(s, space)
        want = {}
        for g, x in SERIES.items():
            if name == "amplitude":
                want[g] = Counter(np.minimum((x - x.min()) / (np.ptp(x) or 1) * 7, 6).astype(int).tolist())
            elif name == "unique":
                want[g] = Counter(x.tolist())
            elif name == "ordinal":
                want[g] = patterns(x, 3, 2)
            else:
                z = np.array([NormalDist().cdf(v) for v in (x - x.mean()) / x.std()]) if x.std() > 0 else None
                d = np.clip(np.floor(5 * z).astype(int) + 1, 1, 5) if z is not None else np.full(len(x), 3)
                want[g] = Counter(tuple(d[i : i + 5 : 2]) for i in range(len(x) - 4))
        for measure, q, smooth, normal in [("shannon", 1, 0, True), ("renyi", 2, 0, False), ("tsallis", 3, 0, True), ("shannon", 1, 0.5, False), ("renyi", 0.5, 1.0, True)]:
            got = by(fn.entropy(hist, measure, q, 2.0, normal, smooth), "g")
            for g, c in want.items():
                if not c:
                    assert g not in got
                    continue
                kk = k or len(c)
                n = np.array([*c.values(), *[0] * (kk - len(c))], float)
                p = (n + smooth) / (n.sum() + smooth * kk)
                p = p[p > 0]
                if measure == "shannon":
                    value, most = -(p * np.log2(p)).sum(), math.log2(kk)
                elif measure == "renyi":
                    value, most = np.log2((p**q).sum()) / (1 - q), math.log2(kk)
                else:
                    value, most = (1 - (p**q).sum()) / (q - 1), (1 - kk ** (1 - q)) / (q - 1)
                value = (value / most if kk > 1 else 0.0) if normal else value
                assert abs(got[g]["entropy"] - value) < 1e-9, (name, measure, g)
    p = by(fn.probabilities(fn.histogram(s, fn.Unique())), "g", "symbol")
    assert near(sum(r["p"] for k, r in p.items() if k[0] == "ties"), 1.0)


@pytest.mark.parametrize("m,tau,r", [(2, 1, None), (1, 2, 0.3), (3, 1, None)])
def test_sample_entropy(s, m, tau, r):
    got = by(fn.sample_entropy(s, m, r, tau), "g")
    assert set(got) == set(SERIES)
    for g, x in SERIES.items():
        n, rad = len(x) - m * tau, r or 0.2 * x.std()
        a = b = 0
        for i, j in itertools.combinations(range(max(0, n)), 2) if rad > 0 else ():
            d = [abs(x[i + k * tau] - x[j + k * tau]) for k in range(m + 1)]
            b += max(d[:m]) <= rad
            a += max(d) <= rad
        want = math.log(b / a) if a else math.inf if b else None
        assert (got[g]["b_pairs"], got[g]["a_pairs"]) == (b, a) and near(got[g]["sample_entropy"], want)


def test_multiscale_and_coarse_grain(s):
    got = by(fn.multiscale_entropy(s, [1, 3]), "g", "scale")
    x = SERIES["noise"]
    y = x[:300].reshape(-1, 3).mean(axis=1)
    assert np.allclose(ordered(fn.coarse_grain(s, 3))["noise"], y)
    pairs = [max(abs(y[i + k] - y[j + k]) for k in range(2)) <= 0.15 * x.std() for i, j in itertools.combinations(range(98), 2)]
    assert got["noise", 3]["b_pairs"] == sum(pairs) and len(got) == 2 * len(SERIES)
    other = by(fn.multiscale_entropy(s, 2, entropy_fn=lambda z: fn.permutation_entropy(z, 3)), "g", "scale")
    assert near(other["noise", 1]["entropy"], by(fn.permutation_entropy(s, 3), "g")["noise"]["entropy"])


def plan(df):
    return df._jdf.queryExecution().toString()


def test_scales_of_coarse_graining_take_one_pass(s):
    got = catalog._grained(s)
    assert "Union" not in plan(got)
    got = by(got, "g", "scale")
    for g, x in SERIES.items():
        for k in range(1, 6):
            y = x[: len(x) // k * k].reshape(-1, k).mean(axis=1)
            assert ((g, k) in got) == (len(y) > 0)
            assert not len(y) or (got[g, k]["n"] == len(y) and abs(got[g, k]["std"] - y.std()) < 1e-6)


def test_multiscale_entropy_in_rows_and_by_cells(s, monkeypatch):
    want = {k: tuple(r) for k, r in by(fn.multiscale_entropy(s, 3), "g", "scale").items()}
    assert "MapInArrow" in plan(fn.multiscale_entropy(s, 3))
    monkeypatch.setattr(blocks, "BLOCK", 220)  # some series are longer than this, others not
    got = {k: tuple(r) for k, r in by(fn.multiscale_entropy(s, 3), "g", "scale").items()}
    assert got.keys() == want.keys() == {(g, k) for g in SERIES for k in (1, 2, 3)}
    for k, r in want.items():
        assert got[k][:3] == r[:3] and near(got[k][3], r[3])


@pytest.mark.parametrize("method", ["fourier", "aaft", "iaaft"])
def test_surrogates_of_many_rows_are_those_of_each(s, method):
    x = RNG.normal(size=(7, 45)).round(1)
    rngs = lambda: [np.random.default_rng(k) for k in range(len(x))]
    many = _surrogate(x, method, rngs(), 200)
    for k, (v, rng) in enumerate(zip(x, rngs(), strict=True)):
        assert (_surrogate(v[None], method, [rng], 200)[0] == many[k]).all()
    assert "InPandas" not in plan(fn.surrogates(s, method, 2))


def test_lz76(spark, s):
    # the worked example of the 1976 paper: 0|001|10|100|1000|101
    bits = spark.createDataFrame([("a", i, float(c)) for i, c in enumerate("0001101001000101")], "g string, i long, v double")
    assert fn.lz76_complexity(bits, 0.5).first()["factors"] == 6
    got = by(fn.lz76_complexity(s), "g")
    assert got["flat"]["factors"] == 2 and got["flat"]["density"] == 0
    x = (SERIES["noise"] > np.median(SERIES["noise"])).astype(int)
    text, at, n = "".join(map(str, x)), 0, 0
    while at < len(text):
        k = 1
        while at + k <= len(text) and text[at : at + k] in text[: at + k - 1]:
            k += 1
        at, n = at + k, n + 1
    assert got["noise"]["factors"] == n and near(got["noise"]["density"], n * math.log2(300) / 300)


def test_delays(s):
    acf, mi = by(fn.autocorrelation(s, 20), "g", "lag"), by(fn.mutual_information(s, 20), "g", "lag")
    curves = {}
    for g in SERIES:
        x = SERIES[g]
        d = x - x.mean()
        for k in range(21):
            want = (d[: len(d) - k] * d[k:]).sum() / (d * d).sum() if (d * d).sum() > 0 and k < len(d) else None
            assert near(acf[g, k]["acf"], want, 1e-8)
        if x.std() == 0:
            assert (g, 0) not in mi
            continue
        bins = int(min(128, max(16, np.sqrt(len(x) / 5))))
        c = np.minimum(((x - x.min()) / np.ptp(x) * bins).astype(int), bins - 1)
        for k in range(min(21, len(x))):
            joint = np.zeros((bins, bins))
            np.add.at(joint, (c[: len(c) - k], c[k:]), 1)
            p = joint / joint.sum()
            outer = p.sum(1)[:, None] * p.sum(0)[None]
            want = (p[p > 0] * np.log(p[p > 0] / outer[p > 0])).sum()
            assert abs(mi[g, k]["mutual_information"] - want) < 1e-9
            curves.setdefault(g, []).append(want)
    best = {m: by(fn.optimal_delay(s, m, 20), "g") for m in ("mi", "acf", "acf_zero")}
    for g in LONG:
        y = curves[g]
        first = next((k for k in range(1, 20) if y[k] < y[k - 1] and y[k] <= y[k + 1]), None)
        assert best["mi"][g]["delay"] == (first or 1 + int(np.argmin(y[1:])))
        r = [acf[g, k]["acf"] for k in range(21)]
        assert best["acf"][g]["delay"] == next((k for k in range(1, 21) if r[k] <= math.exp(-1)), 20)
        assert best["acf_zero"][g]["delay"] == next((k for k in range(1, 21) if r[k] <= 0), 20)
    assert best["mi"]["flat"]["delay"] is None and best["acf"]["flat"]["delay"] is None


def embedded(x, m, tau):
    return np.column_stack([x[k * tau : len(x) - (m - 1 - k) * tau] for k in range(m)])


def far(p, order):
    d = np.abs(p[:, None] - p[None])
    return d.max(axis=2) if order == math.inf else (d**order).sum(axis=2) ** (1 / order)


@pytest.mark.parametrize("block", [blocks.BLOCK, 70])
def test_pairs_of_points(s, monkeypatch, block):
    """One block, and several."""
    monkeypatch.setattr(blocks, "BLOCK", block)
    some = s.where(F.col("g").isin("noise", "ties", "short", "flat"))
    points = fn.embed(some, 2, 1)
    got = by(fn.nearest(points, 3, 2), "g", "i", "rank")
    p = embedded(SERIES["ties"], 2, 1)
    d = far(p, 2)
    d[np.abs(np.subtract.outer(np.arange(len(p)), np.arange(len(p)))) <= 2] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    assert all(got["ties", i, k + 1]["j"] == order[i, k] and near(got["ties", i, k + 1]["distance"], d[i, order[i, k]]) for i in range(len(p)) for k in range(3))
    sums = by(fn.correlation_sum(points, [0.1, 0.5, 1.0], theiler=1), "g", "radius")
    for g in ("noise", "ties"):
        d = far(embedded(SERIES[g], 2, 1), 2)[np.triu_indices(len(SERIES[g]) - 1, 2)]
        assert all(near(sums[g, r]["correlation_sum"], (d <= r).mean()) for r in (0.1, 0.5, 1.0))
    fnn, cao = by(fn.false_nearest_neighbours(some, 2, 4), "g", "d"), by(fn.cao_dimension(some, 2, 4), "g", "d")
    x = SERIES["noise"]
    rows = len(x) - 8
    cols = np.column_stack([x[k * 2 : k * 2 + rows] for k in range(5)])
    for k in range(1, 5):
        d = far(cols[:, :k], 2)
        np.fill_diagonal(d, np.inf)
        j = d.argmin(axis=1)
        e, r = np.abs(cols[:, k] - cols[j, k]), d.min(axis=1)
        assert near(fnn["noise", k]["fraction"], ((e > 15 * r) | (np.sqrt(r * r + e * e) > 2 * x.std())).mean())
    rows = len(x) - 10
    cols, e, star = np.column_stack([x[k * 2 : k * 2 + rows] for k in range(6)]), [], []
    for k in range(1, 6):
        d = far(cols[:, :k], math.inf)
        np.fill_diagonal(d, np.inf)
        j, r = d.argmin(axis=1), d.min(axis=1)
        off = np.abs(cols[:, k] - cols[j, k])
        e.append((np.maximum(r, off) / r).mean())
        star.append(off.mean())
    assert all(near(cao["noise", k]["e1"], e[k] / e[k - 1]) and near(cao["noise", k]["e2"], star[k] / star[k - 1]) for k in range(1, 5))
    assert not any(g == "flat" for g, _ in fnn)
    one = by(fn.embedding_dimension(some, "cao", delay=2, max_dim=4), "g")
    assert one["noise"]["dimension"] == cao["noise", 1]["dimension"]
    error = by(fn.prediction_error(some, 3, 1), "g")
    n = len(x) - 3
    p, y = embedded(x, 3, 1)[:n], x[3:]
    d = far(p, 2)
    d[np.abs(np.subtract.outer(np.arange(n), np.arange(n))) <= 1] = np.inf
    said = y[np.argsort(d, axis=1, kind="stable")[:, :4]].mean(axis=1)
    assert near(error["noise"]["error"], np.sqrt(np.mean((said - y) ** 2)) / x.std()) and error["flat"]["error"] == 0


@pytest.mark.parametrize("block", [16, 2048])
@pytest.mark.parametrize("name", ["lyapunov_rosenstein", "nonlinear_prediction_error", "lyapunov_rate", "false_nearest_neighbours"])
def test_nearly_equal_distances_go_as_in_sql(spark, monkeypatch, name, block):
    # on hundredths many squares differ by their last bit only, and have one root
    monkeypatch.setattr(blocks, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(g, i, float(v)) for g in range(200) for i, v in enumerate(np.round(rng.integers(0, 20, 30) / 100, 2))]
    operator, _, text = catalog.CALLED[name]
    got = operator(spark.createDataFrame(rows, "g long, i long, v double"))
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["g", "i", "v"])
    con.register("s", frame)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({text.replace('{s}', 's')}) z").fetchall()
    assert len(want) >= 200
    for a, b in zip(sorted(map(tuple, got.collect())), sorted(want), strict=True):
        assert a == pytest.approx(b, abs=1e-6)


def test_scaling_fits(spark):
    rng = np.random.default_rng(4)
    curves = {"line": 2 * np.linspace(0, 1, 20) + 0.5, "bent": np.minimum(np.linspace(0, 3, 24), 2) + 0.01 * rng.normal(size=24), "noisy": rng.normal(size=12)}
    rows = [(g, float(k) ** 1.2, float(v)) for g, y in curves.items() for k, v in enumerate(y)]
    table = spark.createDataFrame(rows, "g string, x double, y double")
    got, slopes, lines = by(fn.scaling_region(table), "g"), by(fn.local_slopes(table), "g", "x"), by(fn.line_fit(table), "g")
    for g, y in curves.items():
        x = np.array([float(k) ** 1.2 for k in range(len(y))])
        runs = []
        for a in range(len(y) - 4):
            for z in range(a + 4, len(y)):
                m, b = np.polyfit(x[a : z + 1], y[a : z + 1], 1)
                runs.append((np.sqrt(((y[a : z + 1] - m * x[a : z + 1] - b) ** 2).sum() / (z - a - 1)), z - a + 1, a, z, m))
        if g != "line":
            least = min(r[0] for r in runs)
            want = max((r for r in runs if r[0] <= 1.5 * least), key=lambda r: (r[1], -r[0]))
            assert (got[g]["n"], got[g]["low"], got[g]["high"]) == (want[1], want[2], want[3]) and near(got[g]["slope"], want[4], 1e-7)
        assert np.allclose([slopes[g, float(v)]["slope"] for v in x], np.gradient(y, x))
        m, b = np.polyfit(x, y, 1)
        assert near(lines[g]["slope"], m, 1e-8) and near(lines[g]["stderr"], np.sqrt(((y - m * x - b) ** 2).sum() / (len(y) - 2) / ((x - x.mean()) ** 2).sum()), 1e-6)
    rise = spark.createDataFrame([("a", k, float(min(k, 8)) * 0.3) for k in range(20)], "g string, x int, y double")
    assert near(fn.divergence_rate(rise, dt=0.5).first()["rate"], 0.6) and fn.divergence_rate(rise).first()["n"] == 9


def test_transforms(s):
    for method, f in {"zscore": lambda x: (x - x.mean()) / (x.std() or 1), "minmax": lambda x: (x - x.min()) / (np.ptp(x) or 1), "demean": lambda x: x - x.mean(), "l2": lambda x: x / np.linalg.norm(x)}.items():
        got = ordered(fn.normalize(s, method))
        assert all(np.allclose(got[g], f(x)) for g, x in SERIES.items())
    got = ordered(fn.detrend(s))
    assert all(np.allclose(got[g], x - np.polyval(np.polyfit(np.arange(len(x)), x, 1), np.arange(len(x))), atol=1e-9) for g, x in SERIES.items())
    assert np.allclose(ordered(fn.detrend(s, "constant"))["walk"], SERIES["walk"] - SERIES["walk"].mean())
    for how, level in {"median": np.median, "mean": np.mean, 0.5: lambda _: 0.5}.items():
        assert all((ordered(fn.binarize(s, how))[g] == (x > level(x))).all() for g, x in SERIES.items())
    rank = by(fn.ranks(s), "g", "i")
    assert all(rank["ties", int(i)]["r"] == k for k, i in enumerate(np.argsort(SERIES["ties"], kind="stable")))
    assert np.array_equal(ordered(fn.after(s, 100))["noise"], SERIES["noise"][100:]) and "flat" not in ordered(fn.after(s, 100))
    low = by(fn.minmax(s), "g")
    assert all(low[g]["low"] == x.min() and low[g]["high"] == x.max() for g, x in SERIES.items())
    fit = series_module.stats(s.where("g = 'noise'")).withColumn("g", F.lit("walk"))
    assert np.allclose(ordered(fn.scaler(s.where("g = 'walk'"), fit))["walk"], (SERIES["walk"] - SERIES["noise"].mean()) / SERIES["noise"].std())
    points = fn.embed(s, 2, 3)
    p = embedded(SERIES["walk"], 2, 3)
    assert fn.in_box(points, [-1, -2], [2, 3]).where("g = 'walk'").count() == ((p[:, 0] >= -1) & (p[:, 0] <= 2) & (p[:, 1] >= -2) & (p[:, 1] <= 3)).sum()
    assert fn.in_ball(points, [0.5, 0], 2.0).where("g = 'walk'").count() == (np.hypot(p[:, 0] - 0.5, p[:, 1]) <= 2).sum()
    cross = sorted((r["at"], r["direction"]) for r in fn.crossings(s, 0.1).where("g = 'walk'").collect())
    x = SERIES["walk"] - 0.1
    want = [(i + x[i] / (x[i] - x[i + 1]), "up" if x[i] < 0 else "down") for i in range(len(x) - 1) if (x[i] < 0 <= x[i + 1]) or (x[i] > 0 >= x[i + 1])]
    assert [d for _, d in cross] == [d for _, d in want] and np.allclose([a for a, _ in cross], [a for a, _ in want])


def test_crossings_right_at_the_level(spark):
    x = [1.0] * 29 + [-7e-15, 79.02]
    s = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "g string, i long, v double")
    # the crossing lies on sample 29 in double precision, and is one between 29 and 30
    assert [(r["i"], r["at"], r["direction"]) for r in fn.crossings(s, 0.0).orderBy("i").collect()] == [(29, 29.0 - 7e-15, "down"), (30, 29.0, "up")]


def test_a_sample_at_the_mean_is_told_by_the_order_of_the_series(spark):
    rng, held = np.random.default_rng(4), {}
    for g in range(200):  # cents, one sample of which is their mean
        c = rng.integers(1, 20_000, 30)
        c[-1] = 30 * c[7] - c[:-1].sum()
        held[g] = c / 100
    # the rows lie backwards in three parts, and every part has some of each series
    rows = [(g, t, float(v)) for g, x in held.items() for t, v in enumerate(x)]
    table = spark.createDataFrame(rows[::-1], "name int, at int, value double").repartition(3, "at").sortWithinPartitions(F.desc("at"))
    s = fn.as_series(table, "name", ["at"], "value")
    rate, features = by(fn.zero_crossing_rate(s), "g"), by(fn.extract_features(s, ["zero_crossing_rate"]), "g")
    above, passed = ordered(fn.binarize(s, "mean")), by(fn.crossings(s).groupBy("g").agg(F.count("*").alias("n")), "g")
    for g, x in held.items():
        d = x - np.cumsum(x)[-1] / 30  # added one by one
        want = int(((d[1:] < 0) != (d[:-1] < 0)).sum())
        assert rate[g]["zero_crossing_rate"] == want / 29 == features[g]["zero_crossing_rate"]
        assert (above[g] == (d > 0)).all()
        assert (passed[g]["n"] if g in passed else 0) == (((d[:-1] < 0) & (d[1:] >= 0)) | ((d[:-1] > 0) & (d[1:] <= 0))).sum()
    parts = {r["g"]: r["mean"] for r in series_module.means(s, 8).collect()}
    assert parts == {g: float(np.cumsum([np.cumsum(x[k : k + 8])[-1] for k in range(0, 30, 8)])[-1] / 30) for g, x in held.items()}


def test_rounding_goes_by_doubles_as_in_duckdb(spark):
    values = [32.2453125, 64.6090625, 0.8353125, -0.8353125, 2.5e-7, 0.5e-6, 1e300, -1e-9, 0.0]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", catalog._round("v", 6).alias("r")).orderBy("k").collect()
    assert [r["r"] for r in got] == [r[0] for r in duckdb.sql(f"SELECT round(unnest({values}::DOUBLE[]), 6)").fetchall()]


def test_features(s):
    got = by(fn.extract_features(s), "g")
    for g, x in SERIES.items():
        d = x - x.mean()
        v, v1, v2 = d.var(), np.diff(x).var(), np.diff(x, 2).var()
        mob = math.sqrt(v1 / v) if v > 0 else 0.0
        want = {
            "mean": x.mean(), "std": x.std(), "var": x.var(), "rms": math.sqrt((x * x).mean()), "ptp": np.ptp(x), "skewness": (d**3).mean() / v**1.5 if v > 0 else 0.0,
            "kurtosis": (d**4).mean() / v**2 - 3 if v > 0 else 0.0, "zero_crossing_rate": ((d[1:] < 0) != (d[:-1] < 0)).mean(), "activity": v, "mobility": mob,
            "complexity": math.sqrt(v2 / v1) / mob if mob > 0 and v1 > 0 else 0.0,
        }
        assert all(near(got[g][k], w, 1e-7) for k, w in want.items()), (g, want)
    assert fn.extract_features(s, ["ptp", "mean"]).columns == ["g", "ptp", "mean"]
    with pytest.raises(ValueError):
        fn.extract_features(s, ["nothing"])
    assert near(by(fn.zero_crossing_rate(s), "g")["ties"]["zero_crossing_rate"], got["ties"]["zero_crossing_rate"])


def test_surrogates_keep_what_they_should(s):
    some = s.where(F.col("g").isin("wave", "walk", "short"))
    for method in ("shuffle", "fourier", "aaft", "iaaft"):
        rows = fn.surrogates(some, method, 2, seed=3).collect()
        assert sorted(map(tuple, rows)) == sorted(map(tuple, fn.surrogates(some.repartition(3), method, 2, seed=3).collect()))
        for g in ("wave", "walk"):
            x = SERIES[g]
            y = [np.array([v for _, v in sorted((r["i"], r["v"]) for r in rows if r["g"] == g and r["k"] == k)]) for k in (1, 2)]
            assert not np.array_equal(y[0], y[1])
            for z in y:
                if method == "fourier":
                    assert np.allclose(np.abs(np.fft.rfft(z)), np.abs(np.fft.rfft(x)))
                else:
                    assert np.array_equal(np.sort(z), np.sort(x)) and not np.array_equal(z, x)
                if method == "iaaft":
                    assert np.linalg.norm(np.abs(np.fft.rfft(z)) - np.abs(np.fft.rfft(x))) < 0.1 * np.linalg.norm(np.fft.rfft(x))


def test_surrogate_test_tells_asymmetry_from_noise(spark):
    rng = np.random.default_rng(5)
    x, saw = rng.normal(size=600), []
    for _ in range(600):
        saw.append(saw[-1] + 0.1 if saw and saw[-1] < 1 else rng.random() * 0.1)
    rows = [(g, i, float(v)) for g, y in (("noise", x), ("saw", saw)) for i, v in enumerate(y)]
    table = spark.createDataFrame(rows, "g string, i long, v double")
    got = by(fn.surrogate_test(table, method="aaft", n=39), "g")
    assert got["saw"]["rejected"] and not got["noise"]["rejected"] and abs(got["saw"]["z_score"]) > 3 and near(got["saw"]["p_value"], 0.05)
    spread = by(fn.surrogate_test(table, lambda z: z.groupBy("g").agg(F.stddev_pop("v").alias("value")), "shuffle", 9, "greater"), "g")
    assert all(r["p_value"] > 0.05 for r in spread.values())


def test_filters_pass_and_stop(spark):
    t = np.arange(4000)
    slow, fast = np.sin(2 * np.pi * 0.01 * t), np.sin(2 * np.pi * 0.2 * t)
    table = spark.createDataFrame([("a", int(i), float(v)) for i, v in enumerate(slow + fast)], "g string, i long, v double")
    inner = slice(500, -500)
    for cut, kind, want in ((0.05, "low", slow), (0.05, "high", fast), ((0.1, 0.3), "band", fast), ((0.1, 0.3), "stop", slow)):
        assert np.abs(ordered(fn.butter_filter(table, cut, kind))["a"] - want)[inner].max() < 0.02, kind
    # the cutoff's amplitude is halved by two passes
    edge = spark.createDataFrame([("a", int(i), float(v)) for i, v in enumerate(slow)], "g string, i long, v double")
    assert abs(np.abs(ordered(fn.butter_filter(edge, 0.01, "low"))["a"][inner]).max() - 0.5) < 0.01
    with pytest.raises(ValueError):
        fn.butter_filter(table, 0.7, "low")


def test_basins(spark):
    rng = np.random.default_rng(7)
    smooth = np.fromfunction(lambda x, y: 1 + (x > 11) + (y > 17), (24, 33)).astype(int)
    wild = rng.integers(1, 4, (24, 33))
    wild[rng.random(wild.shape) < 0.1] = -1
    grids = {"smooth": smooth, "wild": wild, "one": np.ones((10, 10), int)}
    table = spark.createDataFrame([(b, x, y, int(a[x, y])) for b, a in grids.items() for x in range(a.shape[0]) for y in range(a.shape[1])], "b string, x int, y int, label int")
    part, h, u, w = by(fn.basin_fractions(table), "b", "label"), by(fn.basin_entropy(table, 5), "b"), by(fn.uncertainty_exponent(table, (1, 2, 3)), "b"), by(fn.wada(table, (1, 3)), "b", "radius")
    for b, a in grids.items():
        for label in np.unique(a):
            p = (a == label).mean()
            assert near(part[b, label]["fraction"], p) and near(part[b, label]["stderr"], math.sqrt(p * (1 - p) / a.size))
        boxes = [a[i : i + 5, j : j + 5] for i in range(0, a.shape[0] - 4, 5) for j in range(0, a.shape[1] - 4, 5)]
        value, edge = [], []
        for box in boxes:
            n = np.array(list(Counter(box[box != -1].tolist()).values()), float)
            e = -(n / n.sum() * np.log(n / n.sum())).sum() if len(n) else 0.0
            value.append(e)
            edge += [e] if len(n) > 1 else []
        assert near(h[b]["sb"], np.mean(value)) and h[b]["boxes"] == len(boxes) and near(h[b]["sbb"], np.mean(edge) if edge else None) and h[b]["boundary_boxes"] == len(edge)

        def differs(a, m):
            out = np.zeros(a.shape, bool)
            for axis in (0, 1):
                p, q = (np.take(a, range(m, a.shape[axis]), axis), np.take(a, range(a.shape[axis] - m), axis))
                off = (p != q) & (p != -1) & (q != -1)
                for start in (m, 0):
                    cut = [slice(None)] * 2
                    cut[axis] = slice(start, start + off.shape[axis])
                    out[tuple(cut)] |= off
            return out

        shares = [differs(a, m).sum() / (a != -1).sum() for m in (1, 2, 3)]
        if min(shares) > 0:
            assert near(u[b]["alpha"], np.polyfit(np.log([1, 2, 3]), np.log(shares), 1)[0], 1e-7)
        else:
            assert b not in u
        edge = differs(a, 1)
        for r in (1, 3):
            hit = [len({int(c) for c in a[max(0, x - r) : x + r + 1, max(0, y - r) : y + r + 1].ravel() if c >= 1}) == 3 for x, y in zip(*np.nonzero(edge), strict=True)]
            assert near(w[b, r]["fraction"], np.mean(hit) if hit and b != "one" else 0.0), (b, r)
    assert w["wild", 3]["is_wada"] and not w["smooth", 3]["is_wada"] and not w["one", 1]["is_wada"]


def test_set_distances_and_kaplan_yorke(spark):
    rng = np.random.default_rng(8)
    sets = {g: rng.normal(size=(n, 3)) + k for k, (g, n) in enumerate((("a", 40), ("b", 60), ("c", 1)))}
    table = spark.createDataFrame([(g, x.tolist()) for g, p in sets.items() for x in p], "g string, x array<double>")
    got = {m: by(fn.set_distance(table, m), "a", "b") for m in ("centroid", "minimum", "hausdorff")}
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        d = np.linalg.norm(sets[a][:, None] - sets[b][None], axis=2)
        assert near(got["centroid"][a, b]["distance"], np.linalg.norm(sets[a].mean(0) - sets[b].mean(0)))
        assert near(got["minimum"][a, b]["distance"], d.min()) and near(got["hausdorff"][a, b]["distance"], max(d.min(0).max(), d.min(1).max()))
    spectra = {"lorenz": [-14.57, 0.906, 0.0], "sink": [-1.0, -2.0], "open": [0.5, -0.2], "tie": [1.0, -1.0, -3.0]}
    got = by(fn.kaplan_yorke(spark.createDataFrame([(g, v) for g, x in spectra.items() for v in x], "g string, value double")), "g")
    assert near(got["lorenz"]["dimension"], 2 + 0.906 / 14.57) and got["sink"]["dimension"] == 0 and got["open"]["dimension"] == 2 and got["tie"]["dimension"] == 2
