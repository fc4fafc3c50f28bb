"""Entropies composed of an outcome space, an estimator and a measure.

A histogram has rows (g, symbol, n, cardinality); every entropy is an aggregate of it, so
the work on the samples ends in map-side counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from statistics import NormalDist
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import by_blocks, long_series, packed
from .series import ahead, binarize, coarse_grain, stats


@dataclass(frozen=True)
class Ordinal:
    """Order patterns of `order` samples `delay` apart; of equal samples the earlier ranks first. Weighted by the windows' variance if asked."""

    order: int = 3
    delay: int = 1
    weighted: bool = False


@dataclass(frozen=True)
class Dispersion:
    """Patterns of m samples, each as one of c classes by the normal distribution of the series' mean and deviation."""

    c: int = 6
    m: int = 2
    delay: int = 1


@dataclass(frozen=True)
class Amplitude:
    """Equal-width bins between the smallest and the largest value."""

    bins: int = 16


@dataclass(frozen=True)
class Unique:
    """The values as they are."""


@runtime_checkable
class Outcomes(Protocol):
    """Any other outcome space: from series (g, i, v) to rows (g, symbol, w), and the number of possible symbols (a column over g, a number, or None: those that occur)."""

    def symbols(self, s: DataFrame) -> DataFrame: ...

    def cardinality(self) -> Column | float | None: ...


def histogram(s: DataFrame, outcomes: Ordinal | Dispersion | Amplitude | Unique | Outcomes) -> DataFrame:
    """(g, symbol, n, cardinality): how often each outcome of a space occurs (or its weights, summed), and how many there can be."""
    if isinstance(outcomes, Ordinal):
        if not 2 <= outcomes.order <= 11:
            raise ValueError("order must be from 2 to 11")
        rows = ahead(s, [k * outcomes.delay for k in range(1, outcomes.order)])
        x = [F.col("v"), *[F.col(f"a{k * outcomes.delay}") for k in range(1, outcomes.order)]]
        # the bits of all inversions name a pattern
        pairs = [(a, b) for a in range(len(x)) for b in range(a + 1, len(x))]
        symbol = sum(((x[a] > x[b]).cast("long") * (1 << k) for k, (a, b) in enumerate(pairs)), F.lit(0).cast("long"))
        mean = sum(x[1:], x[0]) / len(x)
        weight = sum((F.pow(c - mean, 2) for c in x), F.lit(0.0)) / len(x) if outcomes.weighted else F.lit(1.0)
        rows = rows.where(x[-1].isNotNull()).select("g", symbol.alias("symbol"), weight.alias("w"))
        cardinality = F.lit(float(math.factorial(outcomes.order)))
    elif isinstance(outcomes, Dispersion):
        z = F.when(F.col("std") > 0, (F.col("v") - F.col("mean")) / F.col("std"))
        marks = [NormalDist().inv_cdf(k / outcomes.c) for k in range(1, outcomes.c)]
        digit = F.coalesce(sum(((z >= m).cast("long") for m in marks), F.lit(0)), F.lit((outcomes.c + 1) // 2 - 1)).cast("long")
        rows = ahead(s.join(stats(s), "g").withColumn("d", digit), [k * outcomes.delay for k in range(1, outcomes.m)], "d")
        x = [F.col("d"), *[F.col(f"a{k * outcomes.delay}") for k in range(1, outcomes.m)]]
        symbol = sum((c * outcomes.c ** (outcomes.m - 1 - k) for k, c in enumerate(x)), F.lit(0).cast("long"))
        rows = rows.where(x[-1].isNotNull()).select("g", symbol.alias("symbol"), F.lit(1.0).alias("w"))
        cardinality = F.lit(float(outcomes.c**outcomes.m))
    elif isinstance(outcomes, Amplitude):
        at = F.floor((F.col("v") - F.col("low")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0) * outcomes.bins)
        rows = s.join(stats(s), "g").select("g", F.least(at, F.lit(outcomes.bins - 1)).cast("long").alias("symbol"), F.lit(1.0).alias("w"))
        cardinality = F.lit(float(outcomes.bins))
    elif isinstance(outcomes, Unique):
        counts = s.groupBy("g", F.col("v").alias("symbol")).agg(F.count("*").cast("double").alias("n"))
        return counts.join(counts.groupBy("g").agg(F.count("*").cast("double").alias("cardinality")), "g").select("g", "symbol", "n", "cardinality")
    elif isinstance(outcomes, Outcomes):
        rows, most = outcomes.symbols(s), outcomes.cardinality()
        if most is None:
            counts = rows.groupBy("g", "symbol").agg(F.sum("w").cast("double").alias("n"))
            return counts.join(counts.groupBy("g").agg(F.count("*").cast("double").alias("cardinality")), "g").select("g", "symbol", "n", "cardinality")
        cardinality = most if isinstance(most, Column) else F.lit(float(most))
    else:
        raise TypeError(f"not an outcome space: {outcomes!r}")
    return rows.groupBy("g", "symbol").agg(F.sum("w").alias("n")).select("g", "symbol", "n", cardinality.alias("cardinality"))


def probabilities(hist: DataFrame, smoothing: float = 0.0) -> DataFrame:
    """(g, symbol, p, rest, unseen): n over the sum, or with `smoothing` added to every outcome; `unseen` outcomes have `rest` each."""
    total = hist.groupBy("g").agg(F.sum("n").alias("all"), F.max("cardinality").alias("k"), F.count("*").alias("seen"))
    mass = F.col("all") + smoothing * F.col("k")
    p = F.when(mass > 0, (F.col("n") + smoothing) / mass)
    return hist.drop("cardinality").join(total, "g").select("g", "symbol", p.alias("p"), (F.lit(smoothing) / mass).alias("rest"), (F.col("k") - F.col("seen")).alias("unseen"), "k")


def entropy(hist: DataFrame, measure: str | Measure = "shannon", q: float = 2.0, base: float = 2.0, normalize: bool = False, smoothing: float | Estimator = 0.0) -> DataFrame:
    """(g, entropy): Shannon, Renyi or Tsallis of order q, or a measure of one's own. Normalised: over the largest value that the number of outcomes allows (0 with one outcome). Without any mass: 0.

    measure: or a pair of functions of Columns, (p -> term, (sum of terms, number of outcomes) -> (value, largest value)). smoothing: what is added to every outcome, or an estimator:
    a function from (n, sum of n, outcomes that occur, possible outcomes) to (p of one that occurs, p of one that doesn't)."""
    if callable(smoothing) or not isinstance(measure, str):
        return _own_entropy(hist, measure, q, base, normalize, smoothing)
    if measure not in ("shannon", "renyi", "tsallis"):
        raise ValueError(f"unknown measure {measure!r}")
    shannon = measure == "shannon" or q == 1
    term = (lambda p: F.when(p > 0, -p * F.ln(p)).otherwise(0.0)) if shannon else (lambda p: F.when(p > 0, F.pow(p, F.lit(float(q)))).otherwise(0.0))
    rows = probabilities(hist, smoothing)
    total = rows.groupBy("g").agg(F.sum(term(F.col("p"))).alias("seen"), F.max(F.col("unseen") * term(F.col("rest"))).alias("unseen"), F.max("k").alias("k"))
    t = F.coalesce(F.col("seen"), F.lit(0.0)) + (F.coalesce(F.col("unseen"), F.lit(0.0)) if smoothing else F.lit(0.0))
    if shannon and measure != "tsallis":
        value, most = t / math.log(base), F.ln("k") / math.log(base)
    elif measure == "renyi":
        value, most = F.when(t > 0, F.ln(t) / ((1 - q) * math.log(base))).otherwise(0.0), F.ln("k") / math.log(base)
    else:
        value, most = (t, F.ln("k")) if q == 1 else (F.when(t > 0, (1 - t) / (q - 1)).otherwise(0.0), (1 - F.pow("k", F.lit(1.0 - q))) / (q - 1))
    return total.select("g", (F.when(F.col("k") > 1, value / most).otherwise(0.0) if normalize else value).alias("entropy"))


#: A measure and an estimator of one's own, as columns.
Measure = tuple[Callable[[Column], Column], Callable[[Column, Column], tuple[Column, Column]]]
Estimator = Callable[[Column, Column, Column, Column], tuple[Column, Column]]


def _named(measure: str, q: float, base: float) -> Measure:
    """The known measures in the form of one's own."""
    if measure not in ("shannon", "renyi", "tsallis"):
        raise ValueError(f"unknown measure {measure!r}")
    log = math.log(base)
    if measure == "shannon" or q == 1:
        unit = 1.0 if measure == "tsallis" else log
        return lambda p: F.when(p > 0, -p * F.ln(p)).otherwise(0.0), lambda t, k: (t / unit, F.ln(k) / unit)
    power = lambda p: F.when(p > 0, F.pow(p, F.lit(float(q)))).otherwise(0.0)
    if measure == "renyi":
        return power, lambda t, k: (F.when(t > 0, F.ln(t) / ((1 - q) * log)).otherwise(0.0), F.ln(k) / log)
    return power, lambda t, k: (F.when(t > 0, (1 - t) / (q - 1)).otherwise(0.0), (1 - F.pow(k, F.lit(1.0 - q))) / (q - 1))


def _own_entropy(hist: DataFrame, measure: str | Measure, q: float, base: float, normalize: bool, smoothing: float | Estimator) -> DataFrame:
    term, value = _named(measure, q, base) if isinstance(measure, str) else measure
    add = 0.0 if callable(smoothing) else float(smoothing)
    estimate = smoothing if callable(smoothing) else lambda n, total, seen, k: ((n + add) / (total + add * k), F.lit(add) / (total + add * k))
    sums = hist.groupBy("g").agg(F.sum("n").alias("total"), F.count("*").alias("seen"), F.max("cardinality").alias("k"))
    held, rest = estimate(F.col("n"), F.col("total"), F.col("seen"), F.col("k"))
    told = hist.drop("cardinality").join(sums.where("total > 0"), "g").groupBy("g").agg(F.sum(term(held)).alias("t"), F.max((F.col("k") - F.col("seen")) * term(rest)).alias("u"), F.max("k").alias("k"))
    got, most = value(F.col("t") + F.coalesce(F.col("u"), F.lit(0.0)), F.col("k"))
    out = told.select("g", (F.when(F.col("k") > 1, got / most).otherwise(0.0) if normalize else got).alias("entropy"))
    return sums.select("g").join(out, "g", "left").select("g", F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def permutation_entropy(s: DataFrame, order: int = 3, delay: int = 1, base: float = 2.0, normalize: bool = True, weighted: bool = False) -> DataFrame:
    return entropy(histogram(s, Ordinal(order, delay, weighted)), base=base, normalize=normalize)


def sample_entropy(s: DataFrame, m: int = 2, r: float | None = None, delay: int = 1, factor: float = 0.2, scale: DataFrame | None = None) -> DataFrame:
    """(g, b_pairs, a_pairs, sample_entropy) of templates within r in all of their m coordinates, and in the next one too.

    r: by default `factor` standard deviations of the series (or of rows (g, std) in `scale`). No longer match: infinity;
    no match, a constant or too short series: null. Series of one block are compared in one row, longer ones by cells.
    """
    if scale is not None:
        pairs = s.select("g").distinct().join(_by_cells(s, m, r, delay, factor, scale), "g", "left").select("g", F.lit(1).alias("scale"), "b", "a")
    else:
        pairs = _matches(s, [1], m, r, delay, factor)
    return _sample_value(pairs).drop("scale")


def _sample_value(pairs: DataFrame) -> DataFrame:
    b, a = F.coalesce("b", F.lit(0)).alias("b_pairs"), F.coalesce("a", F.lit(0)).alias("a_pairs")
    value = F.when(F.col("a") > 0, F.ln(F.col("b") / F.col("a"))).when(F.col("b") > 0, float("inf"))
    return pairs.select("g", "scale", b, a, value.alias("sample_entropy"))


def _matches(s: DataFrame, scales: Sequence[int], m: int, r: float | None, delay: int, factor: float) -> DataFrame:
    """(g, scale, b, a): matches of m and of m + 1 samples of each series, coarse-grained to each scale; the radius is of the series itself. All scales of a series of one block in one row."""

    def count(x: np.ndarray, radius: float) -> tuple[int, int]:
        n = len(x) - m * delay
        if n < 2 or not radius > 0:
            return 0, 0
        near = np.ones((n, n), bool)
        for k in range(m):
            y = x[k * delay : k * delay + n]
            near &= np.abs(y[:, None] - y[None]) <= radius
        y = x[m * delay :]
        both = near & (np.abs(y[:, None] - y[None]) <= radius)
        return (int(near.sum()) - n) // 2, (int(both.sum()) - n) // 2  # each pair twice, each template with itself

    def compare(i, x, j, y, own):
        radius = r if r is not None else factor * own["std"]
        found = [(k, *count(sum(x[c : len(x) // k * k : k] for c in range(k)) / k, radius)) for k in scales if len(x) >= k]
        return dict(zip(("scale", "b", "a"), np.array(found, np.int64).reshape(-1, 3).T, strict=True))

    short = by_blocks(packed(s, "v", own=[F.stddev_pop("v").alias("std")]), "scale long, b long, a long", compare, pairs=False)
    out = short.select("g", F.col("scale").cast("int").alias("scale"), "b", "a")
    long = s.join(F.broadcast(long_series(s).select("g")), "g", "left_semi")
    spread = stats(long).select("g", "std")
    for k in scales:
        pairs = _by_cells(long if k == 1 else coarse_grain(long, k), m, r, delay, factor, spread)
        out = out.unionByName(long.select("g").distinct().join(pairs, "g", "left").select("g", F.lit(k).alias("scale"), "b", "a"))
    return out


def _by_cells(s: DataFrame, m: int, r: float | None, delay: int, factor: float, scale: DataFrame) -> DataFrame:
    """(g, b, a): matches by a join of templates in cells of r in their first two coordinates."""
    own = scale.select("g", (F.lit(float(r)) if r is not None else factor * F.col("std")).alias("r"))
    rows = ahead(s, [k * delay for k in range(1, m + 1)])
    names = ["v", *[f"a{k * delay}" for k in range(1, m + 1)]]
    t = rows.where(F.col(names[-1]).isNotNull()).join(own, "g").where("r > 0").select("g", "i", "r", F.array(*names).alias("x"))
    cells = [F.floor(F.col("x")[k] / F.col("r")) for k in range(min(m, 2))]
    placed = t.withColumns({f"c{k}": c for k, c in enumerate(cells)})
    near = placed
    for k in range(len(cells)):
        near = near.withColumn(f"c{k}", F.explode(F.array(*[F.col(f"c{k}") + d for d in (-1, 0, 1)])))
    x, y = near.alias("x"), placed.alias("y")
    on = (F.col("x.g") == F.col("y.g")) & (F.col("x.i") < F.col("y.i"))
    for k in range(len(cells)):
        on &= F.col(f"x.c{k}") == F.col(f"y.c{k}")
    far = [F.abs(F.col("x.x")[k] - F.col("y.x")[k]) for k in range(m + 1)]
    for k in range(m):
        on &= far[k] <= F.col("x.r")
    return x.join(y, on).groupBy(F.col("x.g").alias("g")).agg(F.count("*").alias("b"), F.sum((far[m] <= F.col("x.r")).cast("long")).alias("a"))


def multiscale_entropy(s: DataFrame, scales: int | Sequence[int] = 20, factor: float = 0.15, entropy_fn: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(g, scale, ...): the entropy of the coarse-grained series, by default sample entropy with the radius of the original one.

    entropy_fn: any function from a series to rows (g, ...).
    """
    every = range(1, scales + 1) if isinstance(scales, int) else scales
    if entropy_fn is None:
        return _sample_value(_matches(s, every, 2, None, 1, factor)).select("g", "b_pairs", "a_pairs", "sample_entropy", "scale")
    out = None
    for k in every:
        one = entropy_fn(coarse_grain(s, k)).withColumn("scale", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


class _Automaton:
    """All substrings of a text that grows at its end (a suffix automaton): linear in the text."""

    def __init__(self):
        self.next, self.link, self.size, self.last = [{}], [-1], [0], 0

    def extend(self, symbol) -> None:
        new = len(self.next)
        self.next.append({})
        self.size.append(self.size[self.last] + 1)
        self.link.append(0)
        p = self.last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            if self.size[p] + 1 < self.size[q]:
                copy = len(self.next)
                self.next.append(dict(self.next[q]))
                self.link.append(self.link[q])
                self.size.append(self.size[p] + 1)
                while p >= 0 and self.next[p].get(symbol) == q:
                    self.next[p][symbol] = copy
                    p = self.link[p]
                self.link[q] = q = copy
            self.link[new] = q
        self.last = new


def _factors(symbols: list) -> list[int]:
    """Starts of the factors of the exhaustive history: each the shortest run not found before its own last symbol."""
    seen, starts, state, length = _Automaton(), [], 0, 0
    for at, symbol in enumerate(symbols):
        if not length:
            starts.append(at)
        state = seen.next[state].get(symbol)
        seen.extend(symbol)
        if state is None:
            state = length = 0
        else:
            length += 1
            while seen.size[seen.link[state]] >= length:  # a longer text was split off
                state = seen.link[state]
    return starts


def _symbols(s: DataFrame, threshold: str | float | None) -> DataFrame:
    return s.select("g", "i", "v") if threshold is None else binarize(s, threshold)


def lz76_factors(s: DataFrame, threshold: str | float | None = "median") -> DataFrame:
    """(g, factor, start): where each factor of the exhaustive history begins. threshold: median, mean or a number to make bits of values; None: v holds symbols
    (numbers or strings) already. A factor depends on all symbols before, so one series is one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        starts = _factors(pdf.sort_values("i")["v"].tolist())
        return pd.DataFrame({"g": [pdf["g"].iloc[0]] * len(starts), "factor": range(len(starts)), "start": starts})

    symbols = _symbols(s, threshold)
    return symbols.groupBy("g").applyInPandas(run, f"g {symbols.schema['g'].dataType.simpleString()}, factor long, start long")


def lz76_complexity(s: DataFrame, threshold: str | float | None = "median") -> DataFrame:
    """(g, factors, density, n): the number of factors of lz76_factors(), and the entropy rate: that times log_k(n) / n for k different symbols (0 for one)."""
    symbols = _symbols(s, threshold)
    size = symbols.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("v").alias("k"))
    count = lz76_factors(symbols, None).groupBy("g").agg(F.count("*").alias("factors"))
    density = F.when((F.col("n") > 1) & (F.col("k") > 1), F.col("factors") * F.ln("n") / F.ln("k") / F.col("n")).otherwise(0.0)
    return size.join(count, "g").select("g", "factors", density.alias("density"), "n")
