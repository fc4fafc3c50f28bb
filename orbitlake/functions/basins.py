"""Label grids, point sets and exponent spectra: measures of basins, distances of sets, Kaplan-Yorke dimension.

A grid has rows (b, x, y, label): b names the grid, x and y are whole cell numbers from 0,
labels from 1 are basins, -1 stands for escape. Neighbours meet by equi-joins on cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import distances
from .fits import line_fit


def basin_fractions(grid: DataFrame) -> DataFrame:
    """(b, label, n, fraction, stderr): the share of each label, with its binomial error."""
    n = grid.groupBy("b", "label").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("b"))
    return n.select("b", "label", "n", p.alias("fraction"), F.sqrt(p * (1 - p) / F.sum("n").over(Window.partitionBy("b"))).alias("stderr"))


def basin_entropy(grid: DataFrame, box: int = 5, base: float = math.e, escaped: bool = False) -> DataFrame:
    """(b, sb, sbb, boxes, boundary_boxes, fractal): mean entropy of the labels in full boxes of `box` cells a side, of all and of those on a boundary.

    Without `escaped`, cells of escape are no label; a box of nothing else has entropy 0.
    """
    size = grid.groupBy("b").agg(F.floor((F.max("x") + 1) / box).alias("nx"), F.floor((F.max("y") + 1) / box).alias("ny"))
    cells = grid.join(size, "b").withColumn("u", F.floor(F.col("x") / box)).withColumn("w", F.floor(F.col("y") / box)).where("u < nx and w < ny")
    seen = F.lit(1) if escaped else (F.col("label") != -1).cast("int")
    counts = cells.groupBy("b", "u", "w", "label").agg(F.sum(seen).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("b", "u", "w"))
    boxes = counts.withColumn("h", F.when(F.col("n") > 0, -p * F.ln(p) / math.log(base)).otherwise(0.0)).groupBy("b", "u", "w").agg(F.sum("h").alias("h"), F.sum((F.col("n") > 0).cast("int")).alias("labels"))
    out = boxes.groupBy("b").agg(F.avg("h").alias("sb"), F.avg(F.when(F.col("labels") > 1, F.col("h"))).alias("sbb"), F.count("*").alias("boxes"), F.sum((F.col("labels") > 1).cast("int")).alias("boundary_boxes"))
    return out.withColumn("fractal", F.coalesce(F.col("sbb") > math.log(2) / math.log(base), F.lit(False)))


def _differs(grid: DataFrame, m: int) -> DataFrame:
    """(b, x, y): cells that differ from one m cells away along an axis; both are meant."""
    found = None
    for axis in ("x", "y"):
        far = grid.select("b", *[(F.col(c) - (m if c == axis else 0)).alias(c) for c in ("x", "y")], F.col("label").alias("other"))
        pairs = grid.join(far, ["b", "x", "y"]).where("label <> other")
        ends = pairs.select("b", "x", "y").unionByName(pairs.select("b", *[(F.col(c) + (m if c == axis else 0)).alias(c) for c in ("x", "y")]))
        found = ends if found is None else found.unionByName(ends)
    return found.distinct()


def uncertainty_exponent(grid: DataFrame, radii: Sequence[int] = (1, 2, 3, 4, 5), cell: float = 1.0, escaped: bool = False) -> DataFrame:
    """(b, alpha, stderr, boundary_dimension): the slope of the log share of uncertain cells over the log distance; grids with under two shares above 0 have no row."""
    held = grid if escaped else grid.where("label <> -1")
    all_ = held.groupBy("b").agg(F.count("*").alias("n"))
    curve = None
    for m in radii:
        share = _differs(held, m).groupBy("b").agg(F.count("*").alias("k")).join(all_, "b").select(F.col("b").alias("g"), F.lit(math.log(m * cell)).alias("x"), F.ln(F.col("k") / F.col("n")).alias("y"))
        curve = share if curve is None else curve.unionByName(share)
    return line_fit(curve).select(F.col("g").alias("b"), F.col("slope").alias("alpha"), "stderr", (2 - F.col("slope")).alias("boundary_dimension"))


def wada(grid: DataFrame, radii: Sequence[int] = (1, 2, 3, 4, 5), threshold: float = 0.9, escaped: bool = False) -> DataFrame:
    """(b, radius, fraction, basins, is_wada): the share of boundary cells that have every basin within `radius` cells; Wada if the last share reaches `threshold`. Grids of under three basins are none."""
    held = grid if escaped else grid.where("label <> -1")
    basins = grid.where("label >= 1").groupBy("b").agg(F.count_distinct("label").alias("basins"))
    edge = _differs(held, 1)
    out = None
    for r in radii:
        steps = F.sequence(F.lit(-r), F.lit(r))
        near = edge.select("b", "x", "y", F.explode(steps).alias("dx")).select("b", "x", "y", "dx", F.explode(steps).alias("dy"))
        placed = grid.where("label >= 1").select("b", F.col("x").alias("u"), F.col("y").alias("w"), "label")
        met = near.select("b", "x", "y", (F.col("x") + F.col("dx")).alias("u"), (F.col("y") + F.col("dy")).alias("w")).join(placed, ["b", "u", "w"])
        seen = met.groupBy("b", "x", "y").agg(F.count_distinct("label").alias("k"))
        share = edge.join(seen, ["b", "x", "y"], "left").join(basins, "b").groupBy("b", "basins").agg(F.avg(F.coalesce(F.col("k") == F.col("basins"), F.lit(False)).cast("double")).alias("fraction"))
        rows = basins.join(share.drop("basins"), "b", "left").select("b", F.lit(r).alias("radius"), F.when(F.col("basins") >= 3, F.coalesce("fraction", F.lit(0.0))).otherwise(0.0).alias("fraction"), "basins")
        out = rows if out is None else out.unionByName(rows)
    last = F.max_by("fraction", "radius").over(Window.partitionBy("b"))
    return out.withColumn("is_wada", (last >= threshold) & (F.col("basins") >= 3))


def set_distance(points: DataFrame, method: str = "centroid") -> DataFrame:
    """(a, b, distance) of each two sets with a < b; points are rows (g, x), sets few: centroid, minimum or hausdorff (Euclidean).

    For minimum and hausdorff the points of two sets meet in blocks, reduced to nearest distances by Spark.
    """
    if method == "centroid":
        mean = points.select("g", F.posexplode("x").alias("k", "v")).groupBy("g", "k").agg(F.avg("v").alias("v"))
        both = mean.alias("p").join(mean.alias("q"), (F.col("p.k") == F.col("q.k")) & (F.col("p.g") < F.col("q.g")))
        return both.groupBy(F.col("p.g").alias("a"), F.col("q.g").alias("b")).agg(F.sqrt(F.sum(F.pow(F.col("p.v") - F.col("q.v"), 2))).alias("distance"))
    if method not in ("minimum", "hausdorff"):
        raise ValueError(f"unknown method {method!r}")
    parts = max(1, math.ceil(points.count() / 2048))
    own = F.pmod(F.xxhash64("x"), F.lit(parts))
    dealt = points.select("g", "x", own.alias("own"), F.monotonically_increasing_id().alias("i"))
    sets = [r[0] for r in points.select("g").distinct().collect()]
    others = F.array(*[F.lit(x) for x in sets]) if sets else F.array()
    rows = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("h", F.explode(others)).where("g <> h")
    asks = rows.select("g", "h", F.col("own").alias("q"), F.col("other").alias("t"), "x", "i")
    told = rows.select(F.col("h").alias("g"), F.col("g").alias("h"), F.col("other").alias("q"), F.col("own").alias("t"), "x", "i")

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame({"g": [], "h": [], "i": [], "d": []})
        return q[["g", "h", "i"]].assign(d=distances(np.array(q["x"].tolist()), np.array(t["x"].tolist()), 2.0).min(axis=1))

    kind = points.schema["g"].dataType.simpleString()
    keys = ["g", "h", "q", "t"]
    near = asks.groupBy(*keys).cogroup(told.groupBy(*keys)).applyInPandas(run, f"g {kind}, h {kind}, i long, d double").groupBy("g", "h", "i").agg(F.min("d").alias("d"))
    way = near.groupBy("g", "h").agg((F.min("d") if method == "minimum" else F.max("d")).alias("d"))
    return way.groupBy(F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b")).agg((F.min("d") if method == "minimum" else F.max("d")).alias("distance"))


def kaplan_yorke(spectra: DataFrame) -> DataFrame:
    """(g, dimension) of exponents (g, value): how many of the largest sum to 0 at least, and the part of the next that closes the sum; 0 if the largest is negative."""
    w = Window.partitionBy("g").orderBy(F.desc("value"), "at").rowsBetween(Window.unboundedPreceding, 0)
    rows = spectra.select("g", "value", F.monotonically_increasing_id().alias("at"))
    rows = rows.select("g", "value", F.sum("value").over(w).alias("sum"), F.count("*").over(w).alias("j"), F.lead("value").over(Window.partitionBy("g").orderBy(F.desc("value"), "at")).alias("next"))
    last = F.max_by(F.struct("sum", "j", "next"), F.when(F.col("sum") >= 0, F.col("j"))).alias("z")
    out = rows.groupBy("g").agg(F.max("value").alias("high"), last)
    d = F.when(F.col("high") < 0, 0.0).when(F.col("z.next").isNull(), F.col("z.j").cast("double")).otherwise(F.col("z.j") + F.col("z.sum") / F.abs("z.next"))
    return out.select("g", d.alias("dimension"))
