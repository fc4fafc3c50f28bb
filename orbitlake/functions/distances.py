"""Exact Euclidean distances on label grids (b, x, y, label), and how far an attractor is from the edge of its basin.

The transform is separable: a row pass gives each cell its distance to the end of its label along the row, a column
pass takes the least of those over the column, as the lower envelope of parabolas. A task holds one row, or one column.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import kind_of


def envelope(height: np.ndarray, step: float) -> np.ndarray:
    """For each place p the least of height[q] + (step * (p - q))**2, in linear time."""
    n, square = len(height), step * step
    centre, left = [0], [-np.inf]
    for q in range(1, n):
        while True:
            p = centre[-1]
            meet = ((height[q] - height[p]) / square + q * q - p * p) / (2 * (q - p))
            if meet > left[-1]:
                break
            centre.pop()
            left.pop()
        centre.append(q)
        left.append(meet)
    place = np.arange(n)
    at = np.array(centre)[np.searchsorted(np.array(left), place, side="right") - 1]
    return height[at] + square * (place - at) ** 2


def edge_distance(grid: DataFrame, spacing: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(b, x, y, label, distance): how far each cell's centre is from that of the nearest cell of another label; all around the grid is another label too.

    The grid of a `b` must be whole: cells from the least to the largest x and y, each once.
    """
    if min(spacing) <= 0:
        raise ValueError("spacing must be positive")
    row, ahead = Window.partitionBy("b", "y").orderBy("x"), Window.partitionBy("b", "y").orderBy(F.desc("x"))
    label = F.coalesce(F.col("label").cast("string"), F.lit(""))
    cells = grid.select("b", "x", "y", "label").withColumn("new", F.lag(label).over(row) != label).withColumn("ends", F.lead(label).over(row) != label)
    # the first and the last cell of each stretch of one label
    begin = F.last(F.when(F.coalesce("new", F.lit(True)), F.col("x")), ignorenulls=True).over(row)
    end = F.last(F.when(F.coalesce("ends", F.lit(True)), F.col("x")), ignorenulls=True).over(ahead)
    wide = cells.withColumn("side", (F.least(F.col("x") - begin, end - F.col("x")) + 1) * float(spacing[0])).select("b", "x", "y", "label", "side")

    def column(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("y")
        code = pdf["label"].astype(str).to_numpy()
        side, out = pdf["side"].to_numpy(float) ** 2, np.empty(len(pdf))
        cut = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]]))
        for a, z in zip(cut, cut[1:], strict=False):  # beyond the ends of a stretch nothing is nearer than the ends
            out[a:z] = envelope(np.concatenate([[0.0], side[a:z], [0.0]]), float(spacing[1]))[1:-1]
        return pdf.assign(distance=np.sqrt(out))[["b", "x", "y", "label", "distance"]]

    kinds = ", ".join(f"{c} {kind_of(grid, c)}" for c in ("b", "x", "y", "label"))
    return wide.groupBy("b", "x").applyInPandas(column, f"{kinds}, distance double")


def resilience(grid: DataFrame, attractors: DataFrame, spacing: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(b, label, resilience): the least distance from an attractor to the edge of its basin.

    attractors: rows (b, label, u, v, centre), u and v in cells, counted as x and y are; places beyond the grid count as its nearest cell. Points outside their basin are left out;
    if none is inside, the row marked `centre` (true) tells, whatever its cell's label. Null if there is none.
    """
    near = edge_distance(grid, spacing)
    box = grid.groupBy("b").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    at = lambda c, low, high: F.least(F.greatest(F.rint(c).cast("long"), F.col(low)), F.col(high))
    placed = attractors.join(box, "b").select("b", "label", F.coalesce("centre", F.lit(False)).alias("centre"), at("u", "x0", "x1").alias("x"), at("v", "y0", "y1").alias("y"))
    met = placed.join(near.select("b", "x", "y", F.col("label").alias("held"), "distance"), ["b", "x", "y"], "left")
    inside = F.min(F.when((F.col("held") == F.col("label")) & ~F.col("centre"), F.col("distance")))
    # the centre of another basin's cell has no way to go
    centre = F.min(F.when(F.col("centre"), F.when(F.col("held") == F.col("label"), F.col("distance")).otherwise(0.0)))
    return met.groupBy("b", "label").agg(F.coalesce(inside, centre).alias("resilience"))
