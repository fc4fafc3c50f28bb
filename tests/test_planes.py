"""Recurrence plots, spectra, filters and box dimensions against plain NumPy, in one block and in several."""

import numpy as np
import pytest

from orbitlake import functions as fn
from orbitlake.functions import filters, near, spectral

RNG = np.random.default_rng(3)
HENON = [0.1]
for _ in range(2499):
    HENON.append(1 - 1.4 * HENON[-1] ** 2 + 0.3 * (HENON[-2] if len(HENON) > 1 else 0))
SERIES = {"noise": RNG.normal(size=150), "wave": np.sin(np.arange(130) * 0.3), "ties": RNG.integers(0, 5, 90).astype(float), "flat": np.ones(30), "one": np.ones(1)}


def rows_of(spark, series):
    return spark.createDataFrame([(g, i, float(v)) for g, x in series.items() for i, v in enumerate(x)], "g string, i long, v double").repartition(3)


def plot(x, eps, rate, theiler):
    p = np.column_stack([x[:-1], x[1:]])
    n = len(p)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    if rate is not None:
        valid = d[np.triu_indices(n, theiler + 1)]
        eps = np.quantile(valid, min(1, rate * n * n / (2 * len(valid))))
    return eps, (d <= eps) & (np.abs(np.subtract.outer(np.arange(n), np.arange(n))) > theiler)


def runs(bits):
    edges = np.flatnonzero(np.diff(np.concatenate([[0], bits.astype(int), [0]])))
    return (edges[1::2] - edges[::2]).tolist()


def measures(x, eps, rate, theiler, low=2):
    eps, r = plot(x, eps, rate, theiler)
    n = len(r)
    diag = sum((runs(np.diagonal(r, k)) for k in range(1, n)), [])
    vert = sum((runs(r[:, j]) for j in range(n)), [])
    d, v = [k for k in diag if k >= low], [k for k in vert if k >= low]
    share = np.unique(d, return_counts=True)[1] / max(1, len(d))
    mean = lambda z: np.mean(z) if z else 0
    det = sum(d) / max(1, sum(diag))
    return [n, eps, r.mean(), det, sum(v) / max(1, sum(vert)), mean(d), max(diag, default=0), -(share * np.log(share)).sum(), mean(v), max(vert, default=0)]


MEASURES = ["size", "epsilon", "recurrence_rate", "determinism", "laminarity", "mean_diagonal", "l_max", "diagonal_entropy", "trapping_time", "v_max"]


@pytest.mark.parametrize(("block", "theiler", "eps", "rate", "low"), [(None, 0, 0.5, None, 2), (40, 2, 0.5, None, 3), (None, 3, None, 0.08, 2), (40, 0, None, 0.08, 2), (33, 3, None, 0.3, 4)])
def test_recurrence(spark, block, theiler, eps, rate, low):
    points = fn.embed(rows_of(spark, SERIES), 2)
    got = {r["g"]: r for r in fn.rqa(points, eps, rate, theiler, low, low, block=block).collect()}
    assert set(got) == set(SERIES) - {"one"}
    for g, r in got.items():
        want = measures(SERIES[g], eps, rate, theiler, low)
        assert np.allclose([r[c] for c in MEASURES], want), g
        assert (r["ratio"] is None) == (want[2] == 0) and (r["divergence"] is None) == (want[6] == 0)


def test_recurrence_of_nothing_and_windows(spark):
    s = rows_of(spark, SERIES)
    none = {r["g"]: r for r in fn.rqa(fn.embed(s, 1), 0.4, theiler=500).collect()}
    assert all(r["recurrence_rate"] == 0 and r["determinism"] == 0 and r["l_max"] == 0 and r["ratio"] is None for r in none.values()) and set(none) == set(SERIES)
    assert fn.rqa(fn.embed(s.where("g = 'none'"), 2), recurrence_rate=0.1).count() == 0
    got = {(r["g"], r["w"]): r for r in fn.windowed_rqa(fn.embed(s, 2), 40, 15, threshold=0.5).collect()}
    assert {w for g, w in got if g == "ties"} == set(range((89 - 40) // 15 + 1)) and not any(g == "flat" for g, _ in got)
    assert np.allclose([got["ties", 2][c] for c in MEASURES], measures(SERIES["ties"][30:71], 0.5, None, 0)) and got["ties", 2]["start"] == 30
    for wrong in ({}, {"threshold": 1, "recurrence_rate": 0.1}, {"recurrence_rate": 1.5}, {"threshold": 1, "min_diagonal": 0}):
        with pytest.raises(ValueError):
            fn.rqa(fn.embed(s, 2), **wrong)


def powers(x, fs, nper, share, window, detrend, scaling):
    nper = min(nper, len(x))
    w, out = spectral.taper(window, nper), []
    for a in range(0, len(x) - nper + 1, nper - nper // share if share else nper):
        z, t = x[a : a + nper].copy(), np.arange(nper)
        if detrend:
            z = z - z.mean()
        if detrend == "linear" and nper > 1:
            z = z - np.polyval(np.polyfit(t, z, 1), t)
        p = np.abs(np.fft.rfft(z * w)) ** 2 / (fs * (w * w).sum() if scaling == "density" else w.sum() ** 2)
        p[1 : (nper + 1) // 2] *= 2
        out.append(p)
    return np.array(out)


LONGER = {"trend": RNG.normal(size=1500) + np.arange(1500) * 0.01, "wave": np.sin(np.arange(700) * 0.3), "short": RNG.normal(size=91), "flat": np.ones(30), "one": np.ones(1)}


@pytest.mark.parametrize(("span", "nper", "window", "detrend", "scaling"), [(1 << 15, 256, "hann", "constant", "density"), (300, 256, "hann", "constant", "density"), (300, 64, "hamming", "linear", "spectrum"), (100, 50, "blackman", False, "density")])
def test_spectra(spark, monkeypatch, span, nper, window, detrend, scaling):
    monkeypatch.setattr(spectral, "SPAN", span)
    s, options = rows_of(spark, LONGER), {"window": window, "nperseg": nper, "detrend": detrend, "scaling": scaling}
    got = {(r["g"], r["k"]): r for r in fn.power_spectral_density(s, 4.0, **options).collect()}
    image = {(r["g"], r["segment"], r["k"]): r for r in fn.spectrogram(s, 4.0, **options).collect()}
    for g, x in LONGER.items():
        all_of = powers(x, 4.0, nper, 2, window, detrend, scaling)
        n = min(nper, len(x))
        assert all(abs(got[g, k]["psd"] - v) < 1e-9 and got[g, k]["frequency"] == 4.0 * k / n and got[g, k]["segments"] == len(all_of) for k, v in enumerate(all_of.mean(axis=0)))
        parts = powers(x, 4.0, nper, 8, window, detrend, scaling)
        assert all(abs(image[g, m, k]["power"] - v) < 1e-9 for m, p in enumerate(parts) for k, v in enumerate(p)) and image[g, 0, 0]["time"] == n / 8
        assert sum(1 for h, *_ in image if h == g) == parts.size


def test_spectra_of_whole_series_rates_and_features(spark):
    s = rows_of(spark, LONGER)
    got = {(r["g"], r["k"]): r["psd"] for r in fn.power_spectral_density(s, method="periodogram", window="boxcar").collect()}
    assert all(abs(got[g, k] - v) < 1e-9 for g, x in LONGER.items() for k, v in enumerate(powers(x, 1.0, len(x), 0, "boxcar", "constant", "density")[0]))
    assert abs(sum(v for (g, _), v in got.items() if g == "short") / 91 - LONGER["short"].var()) < 1e-9  # power adds up to the variance
    times = s.selectExpr("g", "i", "timestamp_micros(i * 250000 + IF(g = 'short' AND i > 5, 1000, 0)) AS t")
    rates = {r["g"]: r["fs"] for r in fn.sampling_rate(times).collect()}
    assert rates["trend"] == rates["wave"] == 4.0 and rates["short"] is None and rates["one"] is None
    f = {r["g"]: r for r in fn.spectral_features(s, fn.sampling_rate(times), nperseg=700, normalize=False, base=2.0, window="boxcar").collect()}
    assert set(f) == {"trend", "wave", "flat"}
    p = powers(LONGER["wave"], 4.0, 700, 2, "boxcar", "constant", "density")[0]
    q, hz = p / p.sum(), np.arange(len(p)) * 4.0 / 700
    assert np.isclose(f["wave"]["spectral_entropy"], -(q[q > 0] * np.log2(q[q > 0])).sum()) and np.isclose(f["wave"]["spectral_centroid"], (q * hz).sum()) and f["wave"]["dominant_frequency"] == hz[1 + p[1:].argmax()]
    assert f["flat"]["spectral_entropy"] == 0 and f["flat"]["spectral_centroid"] == 0 and np.isclose(f["flat"]["dominant_frequency"], 4.0 / 30)
    every = {r["g"]: r for r in fn.extract_features(s).collect()}
    alone = {r["g"]: r for r in fn.spectral_features(s).collect()}
    assert set(every) == set(LONGER) and len(every["short"]) == 15 and all(every[g][f] == alone[g][f] for g in LONGER for f in ("spectral_entropy", "spectral_centroid", "dominant_frequency"))
    assert abs(every["short"]["std"] - LONGER["short"].std()) < 1e-9
    for wrong in ({"window": "none"}, {"fs": 0}, {"scaling": "x"}, {"nperseg": 8, "noverlap": 8}, {"method": "x"}):
        with pytest.raises(ValueError):
            fn.power_spectral_density(s, **wrong)


BANDS = [("low", [0.1]), ("high", [0.1]), ("band", [0.1, 0.2]), ("stop", [0.1, 0.2]), ("band", [0.001, 0.002]), ("low", [0.0005]), ("band", [0.05, 0.45]), ("stop", [0.001, 0.002])]


@pytest.mark.parametrize(("kind", "cut"), BANDS)
@pytest.mark.parametrize("order", [1, 2, 3, 4, 5, 8])
def test_filters_have_the_butterworth_gain(kind, cut, order):
    """At the cutoffs and elsewhere, from the analog filter at warped frequencies; and all poles are inside the unit circle."""
    sos = filters.sections(order, cut, kind, 1.0)
    f = np.array([1e-4, *cut, 0.49, np.sqrt(np.prod(cut)) * 1.01 if len(cut) > 1 else cut[0] / 2])
    z = np.exp(-2j * np.pi * f)
    gain = np.prod([np.abs((b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)) for b0, b1, b2, _, a1, a2 in sos], axis=0)
    t, c = np.tan(np.pi * f), np.tan(np.pi * np.array(cut))
    r = {"low": lambda: t / c[0], "high": lambda: c[0] / t, "band": lambda: (t * t - c[0] * c[-1]) / (t * (c[-1] - c[0])), "stop": lambda: t * (c[-1] - c[0]) / (t * t - c[0] * c[-1])}[kind]()
    assert np.allclose(gain, 1 / np.sqrt(1 + r ** (2 * order)), atol=1e-5)
    assert max(np.abs(np.roots(s[3:])).max() for s in sos) < 1


def test_sections_in_rows_equal_a_loop():
    x = RNG.normal(size=1000)
    y = want = x
    for s in filters.sections(4, [0.05, 0.2], "band", 1.0):
        y, out, s0, s1 = filters._run(s, y, np.zeros(2)), [], 0.0, 0.0
        for v in want:
            q = s[0] * v + s0
            s0, s1 = s[1] * v - s[4] * q + s1, s[2] * v - s[5] * q
            out.append(q)
        want = np.array(out)
    assert np.abs(y - want).max() < 1e-12


def test_narrow_filters_on_series(spark):
    t = np.arange(20_000)  # the band rings for some thousand samples at the ends
    series = {"slow": np.sin(2 * np.pi * 0.0014 * t), "fast": np.sin(2 * np.pi * 0.1 * t), "level": np.full(50, 3.0), "one": np.ones(1)}
    s = rows_of(spark, series)
    of = lambda df: {g: np.array([v for _, v in sorted((r["i"], r["v"]) for r in rows)]) for g, rows in _by(df).items()}
    band, low = of(fn.band_pass(s, 0.001, 0.002)), of(fn.low_pass(s, 0.01))
    assert np.abs(band["slow"] - series["slow"])[5000:15_000].max() < 0.01 and np.abs(band["slow"]).max() < 1.2 and np.abs(band["fast"])[5000:15_000].max() < 2e-3
    assert np.abs(low["fast"])[500:-500].max() < 1e-3 and np.allclose(low["level"], 3) and low["one"].tolist() == [1.0]
    assert np.allclose(of(fn.high_pass(s, 0.01))["level"], 0) and np.abs(of(fn.band_stop(s, 0.05, 0.2))["fast"])[500:-500].max() < 1e-2
    with pytest.raises(ValueError):
        fn.band_pass(s, 0.2, 0.1)


def _by(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["g"], []).append(r)
    return out


@pytest.mark.parametrize("block", [None, 300])
def test_box_curves(spark, block):
    series = {"henon": np.array(HENON), "noise": RNG.random(700), "flat": np.ones(20)}
    points = fn.embed(rows_of(spark, series), 2)
    got = {(r["g"], r["scale"], r["q"]): r for r in fn.box_curve(points, block=block).collect()}
    assert {g for g, _, _ in got} == {"henon", "noise"}
    for g in ("henon", "noise"):
        p = np.column_stack([series[g][:-1], series[g][1:]])
        low = p.min(axis=0)
        size = np.sqrt(((p.max(axis=0) - low) ** 2).sum())
        for k, share in enumerate(fn.scale_shares()):
            n = min((np.unique(np.floor((p - low) / (size * share) + o), axis=0, return_counts=True)[1] for o in (0, 0.2, 0.4, 0.6, 0.8)), key=len)
            q = n / len(p)
            for order in (0.0, 1.0, 2.0, 5.0):
                want = (q * np.log(q)).sum() if order == 1 else np.log((q**order).sum()) / (order - 1)
                assert got[g, k, order]["boxes"] == len(n) and abs(got[g, k, order]["value"] - want) < 1e-9


def test_dimensions(spark):
    points = spark.createDataFrame([("line", i, [i / 4000, 2 * i / 4000, 0.0]) for i in range(4000)] + [("square", 64 * a + b, [a / 64, b / 64, 1.0]) for a in range(64) for b in range(64)], "g string, i long, x array<double>")
    fit = {(r["g"], r["q"]): r["dimension"] for r in fn.dimension_spectrum(points, (0, 1, 2)).collect()}
    assert all(abs(fit["line", q] - 1) < 0.05 and abs(fit["square", q] - 2) < 0.25 for q in (0, 1, 2))
    assert fn.box_counting_dimension(points, scales=[0.1, 0.2]).count() == 0  # too few scales
    with pytest.raises(ValueError):
        fn.generalized_dimension(points, -1)


POINTS = {"noise": RNG.normal(size=(700, 2)), "ties": RNG.integers(0, 5, (300, 2)).astype(float), "few": RNG.normal(size=(4, 2)), "same": np.ones((90, 2))}


def points_of(spark, points):
    return spark.createDataFrame([(g, i, [float(z) for z in v]) for g, x in points.items() for i, v in enumerate(x)], "g string, i long, x array<double>").repartition(3)


@pytest.mark.parametrize(("theiler", "p"), [(0, 2.0), (3, np.inf)])
def test_neighbours_by_cells(spark, monkeypatch, theiler, p):
    monkeypatch.setattr(near, "CELL", 32)
    monkeypatch.setattr(near, "ROW", 200)
    ks = (1, 2, 7, 60)
    got = {(r["g"], r["i"], r["k"]): (r["j"], r["distance"]) for r in fn.neighbours(points_of(spark, POINTS), ks, theiler, p).collect()}
    n = 0
    for g, x in POINTS.items():
        e = np.abs(x[:, None] - x[None])
        d = np.sqrt((e**2).sum(axis=2)) if p == 2 else e.max(axis=2)
        d[np.abs(np.subtract.outer(np.arange(len(x)), np.arange(len(x)))) <= theiler] = np.inf
        order = np.argsort(d, axis=1, kind="stable")
        for i in range(len(x)):
            for k in ks:
                if k <= len(x) and np.isfinite(d[i, order[i, k - 1]]):
                    n += 1
                    assert got[g, i, k][0] == order[i, k - 1] and abs(got[g, i, k][1] - d[i, order[i, k - 1]]) < 1e-12
    assert n == len(got)


def test_outside_points_and_fixed_mass(spark, monkeypatch):
    monkeypatch.setattr(near, "CELL", 64)
    points, outside = points_of(spark, POINTS), RNG.normal(size=(40, 2))
    asks = spark.createDataFrame([("noise", -10 - i, [float(z) for z in x]) for i, x in enumerate(outside)], "g string, i long, x array<double>")
    got = {(r["i"], r["k"]): r["distance"] for r in fn.neighbours(points, (1, 5), queries=asks).collect()}
    for i, x in enumerate(outside):
        d = np.sort(np.sqrt(((POINTS["noise"] - x) ** 2).sum(axis=1)))
        assert abs(got[-10 - i, 1] - d[0]) < 1e-12 and abs(got[-10 - i, 5] - d[4]) < 1e-12
    plane = {"plane": RNG.random((3000, 2)), "line": np.column_stack([np.arange(1500.0), np.arange(1500.0)])}
    fit = {r["g"]: r["slope"] for r in fn.fixed_mass_dimension(points_of(spark, plane), fn.default_masses(1500), n_ref=700).collect()}
    assert abs(fit["plane"] - 2) < 0.15 and 0.85 < fit["line"] < 1.35
    curve = {r["k"]: r for r in fn.fixed_mass_curve(points_of(spark, plane).where("g = 'line'"), (1, 2, 3), n_ref=None).collect()}
    assert abs(curve[2]["y"] - (1 - 0.5772156649015329)) < 1e-12 and curve[1]["points"] == 1500 and abs(curve[1]["x"] - np.log(2**0.5)) < 1e-12
    assert fn.default_masses(50)[0] == 1 and fn.default_masses(50)[-1] == 6
    with pytest.raises(ValueError):
        fn.neighbours(points, ())


def test_series_shorter_than_the_theiler_window_have_no_threshold(spark):
    rows = [("two", i, [float(i)]) for i in range(2)] + [("long", i, [float(i * i % 17)]) for i in range(40)]
    points = spark.createDataFrame(rows, "g string, i long, x array<double>")
    x = np.array([i * i % 17 for i in range(40)], float)
    d = np.sort([abs(x[i] - x[j]) for i in range(40) for j in range(i + 4, 40)])
    got = {r["g"]: r["epsilon"] for r in fn.rate_threshold(points, 0.1, theiler=3).collect()}
    assert got.keys() == {"long"} and abs(got["long"] - np.quantile(d, 0.1 * 1600 / (2 * len(d)))) < 1e-9
