"""Generalised dimensions of points (g, i, x) by boxes: minimal covers over grid offsets, shared by all orders q.

Points are packed into blocks; a block counts its points by box at every scale and offset at once, so
what is shuffled are occupied boxes, not points. Series of one block are finished where they are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import each_block, packed
from .fits import scaling_region

#: Points of a block.
POINTS = 1 << 15
OFFSETS = (0.0, 0.2, 0.4, 0.6, 0.8)
ORDERS = (0.0, 1.0, 2.0, 3.0, 4.0, 5.0)
#: Shares of the diameter that default scales go from and to.
FINEST, COARSEST = 1 / 200, 1 / 4


def scale_shares(n: int = 18) -> list[float]:
    """Default scales as shares of the diagonal of the points' box, in equal ratios."""
    return [FINEST * (COARSEST / FINEST) ** (k / (n - 1)) for k in range(n)]


def extent(points: DataFrame) -> DataFrame:
    """(g, size, low, diameter): the number of points, the least of each coordinate, and the diagonal of their box."""
    sides = points.select("g", F.posexplode("x").alias("k", "v")).groupBy("g", "k").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    whole = sides.groupBy("g").agg(F.max("n").alias("size"), F.sort_array(F.collect_list(F.struct("k", "low"))).alias("lows"), F.sqrt(F.sum(F.pow(F.col("high") - F.col("low"), F.lit(2)))).alias("diameter"))
    return whole.select("g", "size", F.col("lows.low").alias("low"), "diameter")


def _cells(x: np.ndarray, low: np.ndarray, eps: float, offset: float) -> tuple[np.ndarray, np.ndarray]:
    """Two whole numbers that name the box of each point."""
    at = np.floor((x - low) / eps + offset)
    sides = at.max(axis=0) + 1.0
    half = (x.shape[1] + 1) // 2
    if max(math.prod(sides[:half]), math.prod(sides[half:])) >= 2**62:
        raise ValueError("too many boxes to number: scales are too fine for this many coordinates")
    out = []
    for part in (range(half), range(half, x.shape[1])):
        code = np.zeros(len(x), np.int64)
        for k in part:
            code = code * int(sides[k]) + at[:, k].astype(np.int64)
        out.append(code)
    return out[0], out[1]


def _occupied(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    opens = np.ones(len(a), bool)
    opens[1:] = (np.diff(a) != 0) | (np.diff(b) != 0)
    at = np.flatnonzero(opens)
    return a[at], b[at], np.diff(np.append(at, len(a)))


def box_curve(points: DataFrame, orders: Sequence[float] = ORDERS, scales: Sequence[float] | None = None, n_scales: int = 18, offsets: Sequence[float] = OFFSETS, block: int | None = None) -> DataFrame:
    """(g, scale, epsilon, size, boxes, q, value): for each box size the cover of fewest boxes (ties: the first offset), and its ordinate for each order:
    the sum of p ln p for q = 1, else ln of the sum of p**q, over q - 1. scales: box sizes; by default shares of the diameter. Points without extent have no rows."""
    if not orders or any(q < 0 for q in orders):
        raise ValueError("orders must not be negative")
    if scales is not None and not all(e > 0 for e in scales):
        raise ValueError("scales must be positive")
    qs, shifts = [float(q) for q in orders], [float(o) for o in offsets]
    shares = None if scales is not None else scale_shares(n_scales)
    fixed = None if scales is None else sorted(float(e) for e in scales)
    size = block or POINTS
    table = packed(points, "x", extra=extent(points).where("diameter > 0"), block=size)
    sizes = lambda own: fixed if shares is None else [own["diameter"] * r for r in shares]

    def ordinates(n: np.ndarray, total: int) -> list[float]:
        p = n / total
        return [float((p * np.log(p)).sum()) if q == 1 else float(np.log((p**q).sum()) / (q - 1)) for q in qs]

    def at_once(_, x, own):
        rows, low = [], np.array(own["low"])
        for k, eps in enumerate(sizes(own)):
            n = min((_occupied(*_cells(x, low, eps, o))[2] for o in shifts), key=len)
            rows += [(k, eps, own["size"], len(n), q, v) for q, v in zip(qs, ordinates(n, own["size"]), strict=True)]
        return dict(zip(("scale", "epsilon", "size", "boxes", "q", "value"), map(np.array, zip(*rows, strict=True)), strict=True))

    def counted(_, x, own):
        out, low = [], np.array(own["low"])
        for k, eps in enumerate(sizes(own)):
            for m, o in enumerate(shifts):
                a, b, n = _occupied(*_cells(x, low, eps, o))
                out.append((np.full(len(n), k), np.full(len(n), eps), np.full(len(n), own["size"]), np.full(len(n), m), a, b, n))
        return dict(zip(("scale", "epsilon", "size", "shift", "a", "b", "n"), map(np.concatenate, zip(*out, strict=True)), strict=True))

    schema = "scale long, epsilon double, size long, boxes long, q double, value double"
    short = each_block(table.where("parts = 1"), schema, at_once, block=size)
    cells = each_block(table.where("parts > 1"), "scale long, epsilon double, size long, shift long, a long, b long, n long", counted, block=size)
    cells = cells.groupBy("g", "scale", "epsilon", "size", "shift", "a", "b").agg((F.sum("n") / F.col("size")).alias("p"))
    sums = [F.sum(F.col("p") * F.ln("p")) if q == 1 else F.ln(F.sum(F.pow("p", F.lit(q)))) / (q - 1) for q in qs]
    covers = cells.groupBy("g", "scale", "epsilon", "size", "shift").agg(F.count("*").alias("boxes"), F.array(*sums).alias("values"))
    best = covers.groupBy("g", "scale", "epsilon", "size").agg(F.min(F.struct("boxes", "shift", "values")).alias("b"))
    each = best.select("g", "scale", "epsilon", "size", F.col("b.boxes").alias("boxes"), F.explode(F.arrays_zip(F.lit(qs).alias("q"), F.col("b.values").alias("value"))).alias("z"))
    return short.unionByName(each.select("g", "scale", "epsilon", "size", "boxes", "z.q", "z.value"))


def dimension_spectrum(points: DataFrame, orders: Sequence[float] = ORDERS, min_window: int = 5, tol: float = 1.5, sat_frac: float = 0.85, **options) -> DataFrame:
    """(g, q, dimension, stderr, n, low, high): the slope of each order's curve over its scaling region, among the scales with two boxes at least and sat_frac * size at most.
    low and high count those scales from 0. Series with fewer than min_window of them have no rows. options: those of box_curve()."""
    curve = box_curve(points, orders, **options).where((F.col("boxes") >= 2) & (F.col("boxes") <= sat_frac * F.col("size")))
    fit = scaling_region(curve.select(F.struct("g", "q").alias("g"), F.ln("epsilon").alias("x"), F.col("value").alias("y")), min_window, tol)
    return fit.select("g.g", "g.q", F.col("slope").alias("dimension"), "stderr", "n", "low", "high")


def generalized_dimension(points: DataFrame, q: float = 2.0, **options) -> DataFrame:
    return dimension_spectrum(points, (q,), **options)


def box_counting_dimension(points: DataFrame, **options) -> DataFrame:
    return generalized_dimension(points, 0.0, **options)


def information_dimension(points: DataFrame, **options) -> DataFrame:
    return generalized_dimension(points, 1.0, **options)
