"""Straight lines through short curves (g, x, y): fits with errors, scaling regions, local slopes, divergence rates.

Curves have a few dozen points a series, so all windows of one are a small join on the series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _line() -> list[Column]:
    n, sx, sy = F.count("*"), F.avg("x"), F.avg("y")
    return [n.alias("n"), sx.alias("mx"), sy.alias("my"), (F.covar_pop("x", "y") * n).alias("sxy"), (F.var_pop("x") * n).alias("sxx"), (F.var_pop("y") * n).alias("syy")]


def _fitted(rows: DataFrame) -> DataFrame:
    """slope, intercept, sigma (of residuals, n - 2 degrees; 0 with two points) and the slope's standard error."""
    rows = rows.where("n >= 2 and sxx > 0").withColumn("slope", F.col("sxy") / F.col("sxx"))
    left = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy"))
    left = F.when(left <= 1e-14 * F.col("syy"), 0.0).otherwise(left)  # rounding of a perfect line
    rows = rows.withColumn("sigma", F.when(F.col("n") > 2, F.sqrt(left / (F.col("n") - 2))).otherwise(0.0))
    return rows.withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx")).withColumn("stderr", F.when(F.col("n") > 2, F.col("sigma") / F.sqrt("sxx")).otherwise(0.0))


def line_fit(curve: DataFrame) -> DataFrame:
    """(g, slope, intercept, stderr, n) of least squares over all points; a curve without spread in x has no row."""
    return _fitted(curve.groupBy("g").agg(*_line())).select("g", "slope", "intercept", "stderr", "n")


def scaling_region(curve: DataFrame, min_window: int = 5, tol: float = 1.5) -> DataFrame:
    """(g, slope, intercept, stderr, n, low, high): the widest run of points whose residuals are at most `tol` times the smallest of any run
    (of three points or more), ties to the smaller residuals. low and high count points by x from 0."""
    if min_window < 2:
        raise ValueError("min_window must be at least 2")
    p = curve.select("g", "x", "y", (F.row_number().over(Window.partitionBy("g").orderBy("x")) - 1).alias("at"))
    ends = p.select("g", F.col("at").alias("low")).join(p.select("g", F.col("at").alias("high")), "g").where(F.col("high") - F.col("low") >= min_window - 1)
    inside = ends.join(p, "g").where("at between low and high")
    runs = _fitted(inside.groupBy("g", "low", "high").agg(*_line()))
    own = Window.partitionBy("g")
    least = F.coalesce(F.min(F.when(F.col("n") >= 3, F.col("sigma"))).over(own), F.min("sigma").over(own))
    kept = runs.withColumn("least", least).where(F.col("sigma") <= F.col("least") * tol)
    best = F.max_by(F.struct("slope", "intercept", "stderr", "n", "low", "high"), F.struct("n", -F.col("sigma"), -F.col("low")))
    return kept.groupBy("g").agg(best.alias("b")).select("g", "b.*")


def local_slopes(curve: DataFrame) -> DataFrame:
    """(g, x, slope): second-order differences within, one-sided at the ends."""
    w = Window.partitionBy("g").orderBy("x")
    a, b = F.col("x") - F.lag("x").over(w), F.lead("x").over(w) - F.col("x")
    da, db = (F.col("y") - F.lag("y").over(w)) / a, (F.lead("y").over(w) - F.col("y")) / b
    return curve.select("g", "x", F.coalesce((b * da + a * db) / (a + b), da, db).alias("slope"))


def divergence_rate(curve: DataFrame, dt: float = 1.0, min_len: int = 4) -> DataFrame:
    """(g, rate, stderr, n): the slope of a divergence curve (x the step, y the mean log distance) from its start to its knee, where the step's
    rise falls below half of the slope of the first `min_len` points; without a rising start, over all of it."""
    own, w = Window.partitionBy("g"), Window.partitionBy("g").orderBy("x")
    p = curve.select("g", "x", "y", (F.row_number().over(w) - 1).alias("at"), F.count("*").over(own).alias("size"), (F.lead("y").over(w) - F.col("y")).alias("rise"))
    first = _fitted(p.where(F.col("at") < min_len).groupBy("g").agg(*_line())).select("g", F.col("slope").alias("start"))
    p = p.join(first, "g", "left")
    # the first rise, counted from the last of the first points on, that is too small
    knee = F.min(F.when((F.col("at") >= min_len - 1) & (F.col("rise") < 0.5 * F.col("start")), F.col("at"))).over(own)
    stop = F.when((F.col("size") <= min_len) | F.col("start").isNull() | (F.col("start") <= 0), F.col("size") - 1).otherwise(F.greatest(F.coalesce(knee, F.col("size") - 1), F.lit(min_len - 1)))
    used = p.withColumn("stop", stop).where("at <= stop")
    return _fitted(used.groupBy("g").agg(*_line())).select("g", (F.col("slope") / dt).alias("rate"), (F.col("stderr") / dt).alias("stderr"), "n")
