"""Sweeps of a parameter, held as rows (g, parameter, i, v): what a quantity v did at each value of the parameter, in order of i.

Branches are clusters of the sorted values, periods are branches that are visited in turn, and bifurcations stand where
the period changes. All of it is windows over (g, parameter), so a sweep is as many groups as it has values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def branches(sweep: DataFrame, rtol: float = 0.01) -> DataFrame:
    """(g, parameter, branches): clusters of the finite values of each parameter value, a new one where the gap to the next smaller value is over rtol of their range;
    one where the range is within rtol of the largest distance from their mean (or of 1, if that is less). Without finite values: 0."""
    one = Window.partitionBy("g", "parameter")
    v = F.when(_finite(F.col("v")), F.col("v"))
    rows = sweep.select("g", "parameter", v.alias("v")).withColumn("gap", F.col("v") - F.lag("v").over(one.orderBy(F.col("v").asc_nulls_last())))
    rows = rows.withColumn("low", F.min("v").over(one)).withColumn("high", F.max("v").over(one)).withColumn("mean", F.avg("v").over(one))
    span, scale = F.col("high") - F.col("low"), F.greatest(F.col("high") - F.col("mean"), F.col("mean") - F.col("low"), F.lit(1.0))
    found = rows.groupBy("g", "parameter").agg(F.count("v").alias("n"), F.max(span <= rtol * scale).alias("tight"), F.sum((F.col("gap") > rtol * span).cast("long")).alias("gaps"))
    count = F.when(F.col("n") <= 1, F.col("n")).when(F.col("tight"), F.lit(1)).otherwise(1 + F.coalesce("gaps", F.lit(0)))
    return found.select("g", "parameter", count.cast("long").alias("branches"))


def periods(sweep: DataFrame, max_period: int = 16, rtol: float = 0.01) -> DataFrame:
    """(g, parameter, period): the number of branches, if it is 1 or values that many steps apart agree within rtol of the range (or of 1, if that is less), and it is
    max_period at most; else 0 (aperiodic). -1 where a parameter value has no finite value (a row with a null v says that there is none)."""
    if max_period < 1:
        raise ValueError("max_period must be at least 1")
    one = Window.partitionBy("g", "parameter")
    numbered = sweep.select("g", "parameter", "i", "v").withColumn("at", F.row_number().over(one.orderBy("i")) - 1)
    count = branches(sweep, rtol).where(F.col("branches").between(2, max_period))
    held = numbered.join(count, ["g", "parameter"]).withColumn("n", F.count("*").over(one)).withColumn("bad", F.max((~_finite(F.col("v"))).cast("int")).over(one))
    held = held.withColumn("span", F.greatest(F.max("v").over(one) - F.min("v").over(one), F.lit(1.0)))
    # places a period apart are neighbours among those of equal remainder
    turn = Window.partitionBy("g", "parameter", F.col("at") % F.col("branches")).orderBy("at")
    off = F.abs(F.col("v") - F.lag("v").over(turn)) > rtol * F.col("span")
    cyclic = held.withColumn("off", off).groupBy("g", "parameter").agg((F.max((F.coalesce("off", F.lit(False)) | (F.col("bad") > 0) | (F.col("n") <= F.col("branches"))).cast("int")) == 0).alias("cyclic"))
    every = branches(sweep, rtol).join(cyclic, ["g", "parameter"], "left")
    b = F.col("branches")
    return every.select("g", "parameter", F.when(b == 0, -1).when(b == 1, 1).when((b <= max_period) & F.coalesce("cyclic", F.lit(False)), b).otherwise(0).cast("long").alias("period"))


def bifurcation_points(found: DataFrame) -> DataFrame:
    """(g, at, before, after): the middles between neighbouring parameter values of periods() whose periods differ; those next to a value without any are left out."""
    w = Window.partitionBy("g").orderBy("parameter")
    rows = found.select("g", ((F.lag("parameter").over(w) + F.col("parameter")) / 2).alias("at"), F.lag("period").over(w).alias("before"), F.col("period").alias("after"))
    return rows.where("before <> after AND before <> -1 AND after <> -1")
