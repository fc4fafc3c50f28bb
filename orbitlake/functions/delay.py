"""Delay selection: autocorrelation, mutual information and the delay that they suggest."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import ahead, stats


def _unpivoted(rows: DataFrame, columns: dict[int, str], name: str) -> DataFrame:
    return rows.select("g", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(c).alias(name)) for k, c in columns.items()])).alias("z")).select("g", "z.lag", f"z.{name}")


def autocorrelation(s: DataFrame, max_delay: int = 50) -> DataFrame:
    """(g, lag, acf), lags 0 to max_delay: the biased estimator. Null for constant series and for lags beyond the end. One look ahead, no join of samples."""
    d = s.join(stats(s).select("g", "mean"), "g").select("g", "i", (F.col("v") - F.col("mean")).alias("v"))
    sums = ahead(d, range(1, max_delay + 1)).groupBy("g").agg(F.sum(F.col("v") * F.col("v")).alias("s0"), *[F.sum(F.col("v") * F.col(f"a{k}")).alias(f"s{k}") for k in range(1, max_delay + 1)])
    ratio = sums.select("g", *[F.when(F.col("s0") > 0, F.col(f"s{k}") / F.col("s0")).alias(f"r{k}") for k in range(max_delay + 1)])
    return _unpivoted(ratio, {k: f"r{k}" for k in range(max_delay + 1)}, "acf")


def mutual_information(s: DataFrame, max_delay: int = 50, bins: int | None = None, base: float = math.e) -> DataFrame:
    """(g, lag, mutual_information), lags 0 to max_delay, of equal-width bins over the series' range (by default sqrt(n / 5), from 16 to 128 of them).

    Constant series have no rows. Each sample is binned once; pairs become map-side counts.
    """
    n = F.lit(bins) if bins else F.least(F.lit(128), F.greatest(F.lit(16), F.floor(F.sqrt(F.col("n") / 5))))
    at = F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * n)
    binned = s.join(stats(s), "g").where("high > low").select("g", "i", F.least(at, n - 1).cast("int").alias("b"))
    rows = ahead(binned, range(1, max_delay + 1), "b").withColumn("a0", F.col("b"))
    far = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"a{k}").alias("c")) for k in range(max_delay + 1)]))
    pairs = rows.select("g", "b", far.alias("z")).where("z.c is not null").groupBy("g", "z.lag", "b", "z.c").agg(F.count("*").alias("n"))
    own = lambda *c: F.sum("n").over(Window.partitionBy("g", "lag", *c))
    p = F.col("n") / F.col("all")
    mi = F.sum(p * F.ln(p * F.col("all") * F.col("all") / (F.col("nb") * F.col("nc").cast("double")))) / math.log(base)
    return pairs.select("*", own().alias("all"), own("b").alias("nb"), own("c").alias("nc")).groupBy("g", "lag").agg(mi.alias("mutual_information"))


def first_local_minimum(curve: DataFrame, value: str) -> DataFrame:
    """(g, lag): the first inner lag whose value is below the one before and not above the next; null if there is none."""
    w = Window.partitionBy("g").orderBy("lag")
    rows = curve.select("g", "lag", F.col(value).alias("y"), F.lag(value).over(w).alias("p"), F.lead(value).over(w).alias("q"))
    return rows.groupBy("g").agg(F.min(F.when((F.col("y") < F.col("p")) & (F.col("y") <= F.col("q")), F.col("lag"))).alias("lag"))


def optimal_delay(s: DataFrame, method: str = "mi", max_delay: int = 50, bins: int | None = None) -> DataFrame:
    """(g, delay), at least 1: the first minimum of mutual information (else its smallest lag from 1), or the first lag with an
    autocorrelation of 1/e at most (`acf`) or of 0 at most (`acf_zero`), else max_delay. Null for constant series."""
    if method == "mi":
        curve = mutual_information(s, max_delay, bins)
        least = curve.where("lag >= 1").groupBy("g").agg(F.min_by("lag", F.struct("mutual_information", "lag")).alias("least"))
        found = first_local_minimum(curve, "mutual_information").join(least, "g", "left").select("g", F.coalesce("lag", "least").alias("delay"))
    elif method in ("acf", "acf_zero"):
        level = math.exp(-1) if method == "acf" else 0.0
        curve = autocorrelation(s, max_delay).where("lag >= 1 or acf is not null")
        found = curve.groupBy("g").agg(F.coalesce(F.min(F.when((F.col("acf") <= level) & (F.col("lag") >= 1), F.col("lag"))), F.when(F.count("acf") > 0, max_delay)).alias("delay"))
    else:
        raise ValueError(f"unknown method {method!r}")
    return s.select("g").distinct().join(found, "g", "left")


def zero_one_test(s: DataFrame, frequencies: Sequence[float], max_lag: int = 10) -> DataFrame:
    """(g, k): the median over frequencies of the correlation of lags with the mean square displacement of the turned sums, less its oscillation."""
    cs = F.array(*[F.lit(float(c)) for c in frequencies])
    rows = s.select("g", "i", "v", F.explode(cs).alias("c"))
    w = Window.partitionBy("g", "c").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    path = rows.select(F.struct("g", "c").alias("g"), "i", F.sum(F.col("v") * F.cos(F.col("c") * F.col("i"))).over(w).alias("p"), F.sum(F.col("v") * F.sin(F.col("c") * F.col("i"))).over(w).alias("q"))
    lags = range(1, max_lag + 1)
    moved = ahead(path.withColumn("z", F.struct("p", "q")), lags, "z")
    msd = moved.groupBy("g").agg(*[F.avg(F.pow(F.col(f"a{k}.p") - F.col("p"), 2) + F.pow(F.col(f"a{k}.q") - F.col("q"), 2)).alias(f"m{k}") for k in lags])
    curve = _unpivoted(msd, {k: f"m{k}" for k in lags}, "m").select(F.col("g.g").alias("g"), F.col("g.c").alias("c"), "lag", "m")
    curve = curve.join(stats(s).select("g", "mean"), "g").withColumn("d", F.col("m") - F.col("mean") ** 2 * (1 - F.cos(F.col("lag") * F.col("c"))) / (1 - F.cos("c")))
    return curve.groupBy("g", "c").agg(F.corr("lag", "d").alias("k")).groupBy("g").agg(F.median("k").alias("k"))
