"""Merging, thinning and matching of attractors, and sagitta steps, against plain Python."""

import numpy as np
import pytest

from orbitlake import functions as fn
from orbitlake.functions.sagitta import quantile

RNG = np.random.default_rng(11)
POINTS = "g string, i long, x array<double>"


def rows_of(**series):
    return [(g, i, None if x is None else [None if v is None else float(v) for v in x]) for g, xs in series.items() for i, x in enumerate(xs)]


def test_components(spark):
    edges = [("chain", k, k + 1) for k in range(40)] + [("star", 7, k) for k in range(20)] + [("two", 1, 2), ("two", 2, 1), ("two", 4, 3), ("two", 3, 3)]
    nodes = {(g, v) for g, a, b in edges for v in (a, b)} | {("alone", 5)}
    got = fn.components(spark.createDataFrame(sorted(nodes), "g string, node long"), spark.createDataFrame(edges, "g string, a long, b long"))
    want = {(g, v): {"chain": 0, "star": 0, "alone": 5}.get(g, 1 if v <= 2 else 3) for g, v in nodes}
    assert {(r["g"], r["node"]): r["component"] for r in got.collect()} == want
    assert fn.components(spark.createDataFrame([], "g string, node long"), spark.createDataFrame([], "g string, a long, b long")).count() == 0


def test_close_pairs_and_merging(spark):
    cloud = rows_of(a=RNG.normal(size=(60, 2)), b=[[0.0]] * 30 + [[0.3], [0.1 + 0.2], [1.0]], c=RNG.normal(size=(25, 5)), d=[[1.0, None], None, [float("nan")], [2.0]])
    near = {(r["g"], r["a"], r["b"]) for r in fn.close_pairs(spark.createDataFrame(cloud, POINTS).withColumnRenamed("i", "node"), 0.3).collect()}
    by = {(g, i): x for g, i, x in cloud if x is not None and None not in x and not np.isnan(x).any()}
    close = {(g, i, j) for (g, i), x in by.items() for (h, j), y in by.items() if g == h and i < j and np.linalg.norm(np.subtract(x, y)) <= 0.3}
    assert {p for p in near if p[0] in "ac"} == {p for p in close if p[0] in "ac"} and near <= close
    merged = {(r["g"], r["label"]): r["merged"] for r in fn.merge_map(spark.createDataFrame(cloud, "g string, label long, x array<double>"), 0.3).collect()}
    for g in "abcd":  # the least label that can be reached
        least = {i: i for h, i in by if h == g}
        for _ in least:
            for h, i, j in close:
                if h == g:
                    least[i] = least[j] = min(least[i], least[j])
        assert {i: m for (h, i), m in merged.items() if h == g} == least


def test_pooling_and_labels(spark):
    clouds = spark.createDataFrame([("a", 1, [0.0, 0.0]), ("a", 1, [2.0, 0.0]), ("a", 2, [1.0, 0.5]), ("a", 9, [8.0, 8.0]), ("a", 4, None)], "g string, label int, x array<double>")
    merged = fn.merge_map(clouds, 0.6)
    pooled = {r["label"]: (r["points"], [round(v, 9) for v in r["x"]]) for r in fn.centres(fn.apply_merge(clouds, merged)).collect()}
    assert pooled == {1: (3, [1.0, round(0.5 / 3, 9)]), 9: (1, [8.0, 8.0])}
    grid = spark.createDataFrame([("a", 0, 0, 2), ("a", 0, 1, 9), ("a", 1, 0, -1), ("z", 0, 0, 2)], "b string, x int, y int, label int")
    got = fn.apply_merge(grid, merged, "b")
    assert got.columns == grid.columns and {tuple(r) for r in got.collect()} == {("a", 0, 0, 1), ("a", 0, 1, 9), ("a", 1, 0, -1), ("z", 0, 0, 2)}


@pytest.mark.parametrize("wide, shown", [(8, 64), (3, 2)])
def test_dedup_keeps_the_first(spark, wide, shown):
    data = rows_of(a=RNG.normal(size=(120, 2)), b=[[k * 0.11] for k in range(12)], c=[[k % 3] for k in range(30)] + [None, [None], [float("inf")]], d=RNG.normal(size=(40, 4)) * 0.2)
    want = set()
    for g in "abcd":
        kept = []
        for h, i, x in data:
            if h == g and x is not None and None not in x and np.isfinite(x).all() and not any(np.linalg.norm(np.subtract(x, y)) < 0.3 for y in kept):
                kept.append(x)
                want.add((g, i))
    got = fn.dedup_points(spark.createDataFrame(data, POINTS).repartition(3), 0.3, wide, shown)
    assert {(r["g"], r["i"]) for r in got.collect()} == want


@pytest.mark.parametrize("whole", [0, 50, 2048])
def test_dedup_of_short_series_takes_no_rounds(spark, whole):
    data = rows_of(**{f"s{k}": RNG.normal(size=(20 + k, 2)) for k in range(40)}, mixed=[[0.0], [0.1], [0.0, 0.1], [0.0, 0.0], [1.0]])
    want = set()
    for g in {r[0] for r in data}:
        kept = []
        for h, i, x in data:
            if h == g and not any(len(x) == len(y) and np.linalg.norm(np.subtract(x, y)) < 0.3 for y in kept):
                kept.append(x)
                want.add((g, i))
    got = fn.dedup_points(spark.createDataFrame(data, POINTS).repartition(3), 0.3, whole=whole)
    assert {(r["g"], r["i"]) for r in got.collect()} == want


def test_dedup_of_nothing(spark):
    assert fn.dedup_points(spark.createDataFrame([], POINTS), 0.3).collect() == []
    assert fn.dedup_points(spark.createDataFrame(rows_of(a=[[1.0], [1.0]]), POINTS), 0).count() == 2


def plain_match(values, threshold, least):
    """The pass in order of distance, one parameter value after another."""
    out, before, new = {}, {}, 1
    for p, sets in values:
        sets = {k: (x, f) for k, (x, f) in sorted(sets.items()) if f >= least}
        pairs = sorted((float(np.linalg.norm(np.subtract(y, x))), q, k) for q, (y, _) in before.items() for k, (x, _) in sets.items())
        ids, used = {}, set()
        for d, q, k in pairs:
            if q not in used and k not in ids and (threshold is None or d <= threshold):
                ids[k] = out[prior, q][0]
                used.add(q)
        for k in sets:
            if k not in ids:
                ids[k], new = new, new + 1
        out |= {(p, k): (ids[k], sets[k][1]) for k in sets}
        before, prior = sets, p
    return out


@pytest.mark.parametrize("threshold, least", [(None, 0.0), (0.8, 0.2)])
def test_matching_and_tipping(spark, threshold, least):
    runs = {}
    for g in ("plain", "ties"):
        draw = (lambda: RNG.normal(size=2)) if g == "plain" else (lambda: RNG.integers(0, 3, 2).astype(float))
        runs[g] = [(float(p), {k: (list(map(float, draw())), float(RNG.integers(0, 10)) / 10) for k in range(RNG.integers(0 if g == "plain" else 1, 5))}) for p in range(14)]
    rows = [(g, p, k, x, f) for g, values in runs.items() for p, sets in values for k, (x, f) in sets.items()]
    rows += [(g, p, None, None, None) for g, values in runs.items() for p, sets in values if not sets]
    found = fn.match_attractors(spark.createDataFrame(rows, "g string, parameter double, label int, x array<double>, fraction double").repartition(3), threshold, least)
    got = {(r["g"], r["parameter"], r["label"]): (r["id"], r["fraction"]) for r in found.collect()}
    tips = {(r["g"], r["value"], r["id"], r["kind"], r["before"], r["after"]) for r in fn.tipping_points(found, 0.25).collect()}
    for g, values in runs.items():
        want = plain_match(values, threshold, least)
        assert {(p, k): v for (h, p, k), v in got.items() if h == g and k is not None} == want
        assert {p for h, p, k in got if h == g and k is None} == {p for p, _ in values} - {p for p, _ in want}
        share = {(i, p): f for (p, _), (i, f) in want.items()}
        steps, events = [p for p, _ in values], set()
        for i in {i for i, _ in share}:
            for a, b in zip(steps, steps[1:], strict=False):
                was, now = share.get((i, a), 0.0), share.get((i, b), 0.0)
                if (was > 0.25) != (now > 0.25):
                    events.add((g, b, i, "appear" if now > was else "disappear", was, now))
        assert {t for t in tips if t[0] == g} == events


def test_quantiles_by_counts(spark):
    groups = {"normal": RNG.normal(size=500), "ties": RNG.integers(0, 4, 400).astype(float), "one": np.array([3.5]), "tail": np.exp(RNG.normal(size=300) * 9), "flat": np.full(200, 2.0), "two": np.array([1.0] * 50 + [9.0] * 51)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double").repartition(4)
    for share in (0.0, 0.37, 0.5, 0.95, 1.0):
        got = {r["g"]: r["value"] for r in quantile(df, share, ["g"], most=10, bins=8).collect()}
        assert all(np.isclose(got[g], np.percentile(v, 100 * share), rtol=1e-12) for g, v in groups.items()), share


def bows(x, centres, span):
    a, b, c = x[centres - span], x[centres], x[centres + span]
    chord = np.linalg.norm(c - a, axis=1)
    with np.errstate(all="ignore"):
        unit = (c - a) / chord[:, None]
        bow = np.linalg.norm(b - a - ((b - a) * unit).sum(axis=1)[:, None] * unit, axis=1)
    return np.where(chord > 0, bow, 0.0), chord


def scaled(x):
    std = x.std(axis=0, ddof=1)
    return x / np.where(std > 0, std, 1.0)


def plain_step(x, eps, share, relative, least, growth):
    n, x = len(x), scaled(x)

    def value(span):
        centres = np.arange(span, n - span, span)
        if len(centres) < least:
            return None
        bow, chord = bows(x, centres, span)
        if not (chord > 0).any():
            return 0.0
        bow, mid = np.percentile(bow[chord > 0], share), np.median(chord[chord > 0])
        return bow / (mid if mid > 1e-12 else 1.0) if relative else bow

    ok = lambda span: (v := value(span)) is not None and v <= eps
    if not ok(1):
        return 1, value(1), False
    good, bad, top = 1, None, max(s for s in range(1, n) if s == 1 or len(range(s, n - s, s)) >= least)
    while bad is None and (after := max(int(good * growth), good + 1)) <= top:
        good, bad = (after, None) if ok(after) else (good, after)
    bad = bad or top + 1
    while bad - good > 1:
        mid = (good + bad) // 2
        good, bad = (mid, bad) if ok(mid) else (good, mid)
    return good, value(good), True


CURVES = {
    "circle": np.c_[np.cos(np.arange(400) / 30), np.sin(np.arange(400) / 30)], "walk": np.cumsum(np.cumsum(RNG.normal(size=(150, 2)), axis=0), axis=0), "noise": RNG.normal(size=(90, 2)),
    "line": np.c_[np.arange(50.0), 2 * np.arange(50.0)], "still": np.ones((20, 2)), "five": RNG.normal(size=(5, 2)), "cycle": np.c_[np.arange(60) % 2, np.zeros(60)],
}


@pytest.mark.parametrize("eps, share, relative", [(0.05, 95.0, False), (0.4, 80.0, True)])
def test_sagitta_step(spark, eps, share, relative):
    points = spark.createDataFrame(rows_of(**CURVES, four=CURVES["noise"][:4]), POINTS).repartition(3)
    steps = fn.sagitta_step(points, eps, 0.5, share, relative)
    got = {r["g"]: r for r in steps.collect()}
    assert got["four"]["stride"] == 1 and got["four"]["value"] is None and not got["four"]["fits"]
    for g, x in CURVES.items():
        stride, value, fits = plain_step(x, eps, share, relative, 3, 1.5)
        assert (got[g]["stride"], got[g]["fits"], got[g]["delta_t"]) == (stride, fits, 0.5 * stride), (g, got[g], stride, value)
        assert np.isclose(got[g]["value"], value, atol=1e-9)
    kept = {}
    for r in fn.decimate(points, steps).collect():
        kept.setdefault(r["g"], []).append(r["i"])
    assert sorted(kept["circle"]) == sorted({*range(0, 400, got["circle"]["stride"]), 399})
    with pytest.raises(ValueError):
        fn.sagitta_step(points, -1)


@pytest.mark.parametrize("span, relative, normalize", [(1, True, True), (4, False, True), (2, True, False)])
def test_sagitta_profile(spark, span, relative, normalize):
    got = {}
    for r in fn.sagitta_profile(spark.createDataFrame(rows_of(**CURVES), POINTS), span, relative, normalize).collect():
        got.setdefault(r["g"], {})[r["i"]] = r["sagitta"]
    for g, x in CURVES.items():
        want, x = np.zeros(len(x)), scaled(x) if normalize else x
        if len(x) > 2 * span:
            at = np.arange(span, len(x) - span)
            bow, chord = bows(x, at, span)
            want[at] = bow / np.where(chord > 0, chord, 1) if relative else bow
        assert np.allclose([got[g][i] for i in range(len(x))], want, atol=1e-9), g
