"""Series as rows (g, i, v): coercion, selection, scaling, embedding, features.

`g` names the series, `i` is a dense index from 0, `v` a finite value. What looks ahead does
so within segments that hold a halo of the next one, so a long series is many tasks; what
needs a mean or a range takes it from map-side sums that are joined back.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 65_536


def as_series(df: DataFrame, key: str, order: Sequence[str], value: str, chunk: Column | None = None) -> DataFrame:
    """Rows (g, i, v) of the finite values of a table, ordered by `order`; null, NaN and infinite values are left out.

    `chunk` (a column that never falls along the order, such as a day) lets a series be numbered in parts.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value).cast("double")) < float("inf")))
    rows = rows.select(F.col(key).alias("g"), *order, F.col(value).cast("double").alias("v"), *([chunk.alias("chunk")] if chunk is not None else []))
    if chunk is None:
        return rows.select("g", (F.row_number().over(Window.partitionBy("g").orderBy(*order)) - 1).cast("long").alias("i"), "v")
    counts = rows.groupBy("g", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("g", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("g", "chunk").orderBy(*order)) - 1
    return rows.withColumn("at", at).join(before, ["g", "chunk"]).select("g", (F.col("before") + F.col("at")).cast("long").alias("i"), "v")


def stats(s: DataFrame) -> DataFrame:
    return s.groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"))


def means(s: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(g, mean), the values added one by one in the order of `i`, then the sums of segments in theirs.

    Whether a sample lies below the mean can hang on the mean's last bit; it must not change with the order in which the rows lie.
    """
    upto = lambda order, *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = s.select("g", F.floor(F.col("i") / segment).alias("seg"), "i", "v").withColumn("sum", F.sum("v").over(upto("i", "g", "seg")))
    parts = rows.groupBy("g", "seg").agg(F.max_by("sum", "i").alias("sum"), F.count("v").alias("n"))
    return parts.withColumn("sum", F.sum("sum").over(upto("seg", "g"))).groupBy("g").agg((F.max_by("sum", "seg") / F.sum("n")).alias("mean"))


def ahead(s: DataFrame, offsets: Iterable[int], column: str = "v", segment: int = SEGMENT) -> DataFrame:
    """s with columns a<k>: the value k steps later, or null after the end. One shuffle by (series, segment)."""
    offsets = sorted({*offsets} - {0})
    reach = max(offsets, default=0)
    segment = max(segment, reach)
    own = F.floor(F.col("i") / segment)
    first = F.col("i") % segment < reach  # rows that the segment before sees too
    copies = s.withColumn("seg", F.explode(F.when(first & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))))
    w = Window.partitionBy("g", "seg").orderBy("i")
    seen = copies.select("*", *[F.lead(column, k).over(w).alias(f"a{k}") for k in offsets])
    return seen.where(F.col("seg") == own).drop("seg")


def after(s: DataFrame, start: int) -> DataFrame:
    """Without the first `start` samples of each series, numbered anew."""
    return s.where(F.col("i") >= start).withColumn("i", F.col("i") - start)


def in_box(points: DataFrame, low: Sequence[float], high: Sequence[float], column: str = "x") -> DataFrame:
    """Points within a closed box; points of another length or with a null are outside."""
    inside = [(F.col(column)[k] >= a) & (F.col(column)[k] <= b) for k, (a, b) in enumerate(zip(low, high, strict=True))]
    out = F.size(column) == len(low)
    for test in inside:
        out &= test
    return points.where(F.coalesce(out, F.lit(False)))


def in_ball(points: DataFrame, centre: Sequence[float], radius: float, column: str = "x") -> DataFrame:
    """Points within a closed ball."""
    far = sum((F.pow(F.col(column)[k] - c, 2) for k, c in enumerate(centre)), F.lit(0.0))
    return points.where(F.coalesce((F.size(column) == len(centre)) & (F.sqrt(far) <= radius), F.lit(False)))


def minmax(s: DataFrame) -> DataFrame:
    return s.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def scaler(s: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """(g, i, v) less the mean over the standard deviation (0: one) of `fitted` (rows of stats(); by default of s itself)."""
    f = (stats(s) if fitted is None else fitted).select("g", "mean", "std")
    return s.join(f, "g").select("g", "i", ((F.col("v") - F.col("mean")) / F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)).alias("v"))


def normalize(s: DataFrame, method: str = "zscore") -> DataFrame:
    """zscore, minmax, demean or l2; a constant series gives zeros (l2: itself over its norm)."""
    if method == "zscore":
        return scaler(s)
    if method == "demean":
        return s.join(means(s), "g").select("g", "i", (F.col("v") - F.col("mean")).alias("v"))
    f = s.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    one = lambda c: F.when(c > 0, c).otherwise(1.0)
    ways = {"minmax": (F.col("v") - F.col("low")) / one(F.col("high") - F.col("low")), "l2": F.col("v") / one(F.col("norm"))}
    return s.join(f, "g").select("g", "i", ways[method].alias("v"))


def detrend(s: DataFrame, method: str = "linear") -> DataFrame:
    """Less the mean (`constant`) or the least-squares line (`linear`)."""
    if method == "constant":
        return normalize(s, "demean")
    centre = s.groupBy("g").agg(F.avg("v").alias("mv"), F.avg("i").alias("mi"), F.covar_pop("i", "v").alias("c"), F.var_pop("i").alias("d"))
    slope = F.when(F.col("d") > 0, F.col("c") / F.col("d")).otherwise(0.0)
    return s.join(centre, "g").select("g", "i", (F.col("v") - F.col("mv") - slope * (F.col("i") - F.col("mi"))).alias("v"))


def binarize(s: DataFrame, threshold: str | float = "median") -> DataFrame:
    """(g, i, v): 1 above the median, the mean or a number, else 0."""
    if not isinstance(threshold, str):
        return s.select("g", "i", (F.col("v") > threshold).cast("int").alias("v"))
    level = s.groupBy("g").agg(F.median("v").alias("level")) if threshold == "median" else means(s).withColumnRenamed("mean", "level")
    return s.join(level, "g").select("g", "i", (F.col("v") > F.col("level")).cast("int").alias("v"))


def ranks(s: DataFrame) -> DataFrame:
    """(g, i, r): the position of each value in its sorted series, ties by index."""
    return s.select("g", "i", (F.row_number().over(Window.partitionBy("g").orderBy("v", "i")) - 1).alias("r"))


def coarse_grain(s: DataFrame, scale: int) -> DataFrame:
    """Means of `scale` samples after another; a shorter rest goes."""
    return s.groupBy("g", F.floor(F.col("i") / scale).alias("i")).agg(F.avg("v").alias("v"), F.count("*").alias("n")).where(F.col("n") == scale).select("g", "i", "v")


def embed(s: DataFrame, dimension: int, delay: int = 1) -> DataFrame:
    """Points (g, i, x) of a delay embedding, x an array."""
    rows = ahead(s, [k * delay for k in range(1, dimension)])
    last = f"a{(dimension - 1) * delay}" if dimension > 1 else "v"
    return rows.where(F.col(last).isNotNull()).select("g", "i", F.array("v", *[f"a{k * delay}" for k in range(1, dimension)]).alias("x"))


def crossings(s: DataFrame, level: float | None = None) -> DataFrame:
    """Where a series passes a level (by default its mean): (g, i, at, direction), i the sample behind it, `at` by linear interpolation."""
    x = s.withColumn("x", F.col("v") - level) if level is not None else normalize(s, "demean").withColumnRenamed("v", "x")
    rows = ahead(x, [1], "x")
    up, down = (F.col("x") < 0) & (F.col("a1") >= 0), (F.col("x") > 0) & (F.col("a1") <= 0)
    return rows.where(up | down).select("g", (F.col("i") + 1).alias("i"), (F.col("i") + F.col("x") / (F.col("x") - F.col("a1"))).alias("at"), F.when(up, "up").otherwise("down").alias("direction"))


def zero_crossing_rate(s: DataFrame) -> DataFrame:
    """(g, zero_crossing_rate): sign changes about the mean a step; null for series of one sample."""
    rows = ahead(normalize(s, "demean"), [1])
    return rows.groupBy("g").agg((F.sum(((F.col("v") < 0) != (F.col("a1") < 0)).cast("int")) / F.count("a1")).alias("zero_crossing_rate"))


#: Names that extract_features knows.
FEATURES = ("mean", "std", "var", "rms", "ptp", "skewness", "kurtosis", "zero_crossing_rate", "activity", "mobility", "complexity", "spectral_entropy", "spectral_centroid", "dominant_frequency")


def extract_features(s: DataFrame, features: Sequence[str] = FEATURES, fs: float | DataFrame = 1.0) -> DataFrame:
    """One row (g, features) a series. Ratios over a variance of 0 are 0; what a series is too short for is null. fs: samples a unit of time, for the spectral ones."""
    if unknown := set(features) - set(FEATURES):
        raise ValueError(f"unknown features {sorted(unknown)}")
    from .spectral import SPECTRAL, spectral_features  # which packs series by other functions of this module

    spectral, plain = [f for f in features if f in SPECTRAL], [f for f in features if f not in SPECTRAL]
    if spectral:
        found = spectral_features(s, fs, spectral)
        return (extract_features(s, plain).join(found, "g", "left") if plain else found).select("g", *features)
    centre = means(s) if "zero_crossing_rate" in plain else stats(s).select("g", "mean")  # only a sample's side of the mean hangs on its last bit
    rows = ahead(s.join(centre, "g").withColumn("v0", F.col("v")).withColumn("v", F.col("v") - F.col("mean")), [1, 2])
    d1, d2 = F.col("a1") - F.col("v"), F.col("a2") - 2 * F.col("a1") + F.col("v")
    m = {k: F.avg(F.pow("v", F.lit(k))) for k in (2, 3, 4)}
    agg = rows.groupBy("g").agg(
        F.max("mean").alias("mean"), m[2].alias("var"), F.sqrt(F.avg(F.col("v0") * F.col("v0"))).alias("rms"), (F.max("v0") - F.min("v0")).alias("ptp"), m[3].alias("m3"), m[4].alias("m4"),
        (F.sum(((F.col("v") < 0) != (F.col("a1") < 0)).cast("int")) / F.count("a1")).alias("zero_crossing_rate"), F.var_pop(d1).alias("vd1"), F.var_pop(d2).alias("vd2"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).when(b == 0, 0.0)
    mobility = F.sqrt(ratio(F.col("vd1"), F.col("var")))
    ways = {
        "mean": F.col("mean"), "std": F.sqrt("var"), "var": F.col("var"), "rms": F.col("rms"), "ptp": F.col("ptp"), "skewness": ratio(F.col("m3"), F.pow("var", F.lit(1.5))),
        "kurtosis": F.when(F.col("var") > 0, F.col("m4") / F.pow("var", F.lit(2)) - 3).otherwise(0.0), "zero_crossing_rate": F.col("zero_crossing_rate"), "activity": F.col("var"),
        "mobility": mobility, "complexity": ratio(F.sqrt(ratio(F.col("vd2"), F.col("vd1"))), mobility),
    }
    return agg.select("g", *[ways[f].alias(f) for f in features])
