"""Periods of series (g, i, v), with the curves that they are read from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import by_blocks, each_block, packed

#: Samples of a block whose products with another block are summed by one transform.
SAMPLES = 1 << 14
METHODS = ("autocorrelation", "fft")
#: Fewer samples tell no period.
LEAST = 8


def period_curve(s: DataFrame, method: str = "autocorrelation", max_delay: int | None = None, dt: float = 1.0, detrend: bool = True, block: int | None = None) -> DataFrame:
    """(g, k, x, value): by `autocorrelation` the lag k, its time and the sum of products k apart over that of squares, for lags below half of the series (or min(max_delay, n - 2));
    by `fft` the bin k, its frequency and its power (mean removed if `detrend`, one Hann taper; that of bin 0 is 0). Series under LEAST samples and constant ones have no rows.

    Products are summed by transforms of pairs of blocks within reach of each other; the spectrum of one series is one task.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    n = s.groupBy("g").agg(F.count("*").alias("size"), F.avg("v").alias("mean"), F.max("v").alias("high"), F.min("v").alias("low")).where(f"size >= {LEAST}")
    n = n.where("high > low" if detrend else "high <> 0 OR low <> 0").select("g", "size", (F.col("mean") if detrend else F.lit(0.0)).alias("mean"))
    if method == "fft":

        def whole(_, x, own):
            power = np.abs(np.fft.rfft((x - own["mean"]) * np.hanning(len(x)))) ** 2
            power[0] = 0.0
            k = np.arange(len(power))
            return {"k": k, "x": k / (len(x) * dt), "value": power}

        return each_block(packed(s, "v", extra=n, block=1 << 62), "k long, x double, value double", whole, block=1 << 62)
    hi = F.floor(F.col("size") / 2) if max_delay is None else F.least(F.lit(int(max_delay)).cast("long"), F.col("size") - 2)
    size = block or SAMPLES

    def products(i, x, j, y, own):
        first, last = int(j[0] - i[-1]), int(j[-1] - i[0])
        if first >= own["hi"]:
            return {"k": np.zeros(0, np.int64), "sum": np.zeros(0)}
        wide = 1 << int(np.ceil(np.log2(len(x) + len(y))))
        both = np.fft.irfft(np.conj(np.fft.rfft(x - own["mean"], wide)) * np.fft.rfft(y - own["mean"], wide), wide)
        k = np.arange(max(0, first), min(last, own["hi"] - 1) + 1)
        return {"k": k, "sum": both[(k - int(j[0] - i[0])) % wide]}

    sums = by_blocks(packed(s, "v", extra=n.withColumn("hi", hi).where("hi > 0"), block=size), "k long, sum double", products, block=size).groupBy("g", "k").agg(F.sum("sum").alias("sum"))
    zero = sums.where("k = 0").select("g", F.col("sum").alias("energy")).where("energy > 0")
    return sums.join(zero, "g").select("g", "k", (F.col("k") * dt).alias("x"), (F.col("sum") / F.col("energy")).alias("value"))


def estimate_period(s: DataFrame, method: str = "autocorrelation", max_delay: int | None = None, dt: float = 1.0, detrend: bool = True, block: int | None = None) -> DataFrame:
    """(g, period), in units of dt; null where none can be told.

    autocorrelation: the largest value from the first one below 0 on (ties: the smallest lag); fft: the bin of most power (the lowest of equal ones).
    Both are refined by a parabola through the two neighbours, if there are two.
    """
    curve = period_curve(s, method, max_delay, dt, detrend, block)
    own, along = Window.partitionBy("g"), Window.partitionBy("g").orderBy("k")
    below = F.min(F.when((F.col("k") >= 1) & (F.col("value") < 0), F.col("k"))).over(own) if method == "autocorrelation" else F.lit(1)
    rows = curve.select("g", "k", "value", below.alias("start"), F.lag("value").over(along).alias("a"), F.lead("value").over(along).alias("c"))
    best = rows.where("k >= start").groupBy("g").agg(F.max(F.struct("value", -F.col("k"), "a", "c")).alias("b"), F.max("k").alias("last"))
    b = best.select("g", F.col("b.value").alias("b"), (-F.col("b.col2")).alias("k"), "b.a", "b.c")
    bend = F.col("a") - 2 * F.col("b") + F.col("c")
    at = F.col("k") + F.when(bend != 0, 0.5 * (F.col("a") - F.col("c")) / bend).otherwise(0.0)
    n = s.groupBy("g").agg(F.count("*").alias("size"))
    period = at * dt if method == "autocorrelation" else F.when(F.col("b") > 0, F.col("size") * dt / at)
    return n.join(b, "g", "left").select("g", period.alias("period"))

