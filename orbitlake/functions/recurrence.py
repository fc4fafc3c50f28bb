"""Recurrence quantification of points (g, i, x): thresholds for a rate, lines of the recurrence plot, measures.

Two points recur when they are within a threshold and more than `theiler` steps apart. The plot is never
written: each pair of blocks gives its lines. A line that ends inside the pair is counted there; one that touches the
border of its blocks goes on in a neighbouring pair, so its pieces are joined by their places. Diagonal lines
are those above the main diagonal, vertical ones those of the whole plot, which is symmetric.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import save
from . import blocks
from .blocks import by_blocks, distances, packed

#: Bits of a distance (as a double, whose bits order as its value does) that are settled in each round.
_ROUNDS = ((42, 22), (21, 21), (0, 21))


def _sizes(points: DataFrame) -> DataFrame:
    return points.groupBy("g").agg(F.count("*").alias("size"))


def _valid_pairs(n: Column, theiler: int) -> Column:
    """Unordered pairs more than `theiler` steps apart."""
    return F.greatest(F.lit(0.0), (n - theiler) * (n - theiler - 1) / 2.0)


def rate_threshold(points: DataFrame, rate: float, theiler: int = 0, p: float = 2.0, block: int | None = None) -> DataFrame:
    """(g, epsilon): the radius within which a share `rate` of the size * size cells of the plot recur; null without valid pairs.

    That is a quantile of the distances of all valid pairs (linear between two of them), found without writing pairs: series of one block have it at once;
    for longer ones three rounds of counts settle the bits of the distance of that rank, each by one look at all pairs. A round's result, one row a series, is saved.
    """
    if not 0 < rate < 1:
        raise ValueError("rate must be between 0 and 1")
    n = F.col("size").cast("double")
    m = _valid_pairs(n, theiler)
    place = F.least(F.lit(1.0), rate * n * n / (2 * m)) * (m - 1)
    ranks = _sizes(points).withColumn("m", m).where("m > 0").select("g", "size", F.floor(place).alias("low"), (place - F.floor(place)).alias("part"))
    table = packed(points, "x", block=block, own=[F.count("*").alias("size")])

    def of(x, y, i, j):
        d = distances(x, y, p)
        return d[j[None] - i[:, None] > theiler]

    def at_once(i, x, j, y, own):
        d, size = of(x, y, i, j), float(own["size"])
        if not len(d):
            return {"epsilon": np.empty(0)}
        place = min(1.0, rate * size * size / (2 * float(len(d)))) * (len(d) - 1)
        low = int(place)
        high = min(low + 1, len(d) - 1)
        d = np.partition(d, [low, high])
        return {"epsilon": np.array([d[low] + (place - low) * (d[high] - d[low])])}

    short = by_blocks(table, "epsilon double", at_once, block=block, pairs=False)
    largest = ranks.agg(F.max("size")).first()[0] or 0
    if largest <= (block or blocks.BLOCK):
        return save(short)
    long = table.where("parts > 1").drop("size").join(ranks, "g")
    known = None  # (g, prefix, rank): the bits settled so far, and the rank among distances that begin with them
    for shift, width in _ROUNDS:

        def counted(i, x, j, y, own, shift=shift, width=width):
            bits = of(x, y, i, j).view(np.uint64)
            begin = bits >> np.uint64(shift + width) if shift + width < 64 else np.zeros(len(bits), np.uint64)
            mine = begin == np.uint64(own.get("prefix", 0))
            after = bits[begin > np.uint64(own.get("prefix", 0))] if "prefix" in own else bits[:0]
            value, n = np.unique(bits[mine] >> np.uint64(shift), return_counts=True)
            # n = 0: the next distance beyond the prefix
            if len(after):
                value, n = np.append(value, after.min()), np.append(n, 0)
            return {"value": value.astype(np.int64), "n": n.astype(np.int64)}

        source = long if known is None else long.join(known, "g")
        bins = by_blocks(source, "value long, n long", counted, block=block, alone=False).groupBy("g", (F.col("n") == 0).alias("beyond"), "value").agg(F.sum("n").alias("n"))
        inside = bins.where("NOT beyond").join(ranks.withColumn("rank", F.col("low")) if known is None else known, "g")
        w = Window.partitionBy("g").orderBy("value")
        upto = inside.withColumn("upto", F.sum("n").over(w)).withColumn("next", F.lead("value").over(w)).where(F.col("upto") > F.col("rank"))
        found = upto.groupBy("g").agg(F.min(F.struct("value", "upto", "n", "rank", "next")).alias("b"))
        if shift:
            known = save(found.select("g", F.col("b.value").alias("prefix"), (F.col("b.rank") - F.col("b.upto") + F.col("b.n")).alias("rank")))
        else:
            beyond = bins.where("beyond").groupBy("g").agg(F.min("value").alias("after"))
            following = F.when(F.col("b.upto") > F.col("b.rank") + 1, F.col("b.value")).otherwise(F.coalesce("b.next", "after", "b.value"))
            settled = found.join(beyond, "g", "left").select("g", F.col("b.value").alias("a"), following.alias("b"))

    values = settled.join(ranks, "g").mapInPandas(lambda parts: (_from_bits(p) for p in parts), f"g {points.schema['g'].dataType.simpleString()}, epsilon double")
    return save(short.unionByName(values))


def _from_bits(pdf):
    a, b = (pdf[c].to_numpy(np.int64).view(np.float64) for c in ("a", "b"))
    return pdf.assign(epsilon=a + pdf["part"].to_numpy() * (b - a))[["g", "epsilon"]]


def _lines(line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, start, length) of stretches of neighbouring places on one line."""
    order = np.lexsort((at, line))
    line, at = line[order], at[order]
    opens = np.ones(len(at), bool)
    opens[1:] = (np.diff(line) != 0) | (np.diff(at) != 1)
    first = np.flatnonzero(opens)
    return line[first], at[first], np.diff(np.append(first, len(at)))


def line_lengths(points: DataFrame, threshold: float | DataFrame, theiler: int = 0, p: float = 2.0, block: int | None = None) -> DataFrame:
    """(g, kind, length, n): how many lines of each length there are, kind `diagonal` or `vertical`. threshold: a number, or rows (g, epsilon)."""
    table = packed(points, "x", block=block, own=[F.count("*").alias("size")])
    table = table.join(threshold.select("g", "epsilon"), "g") if isinstance(threshold, DataFrame) else table.withColumn("epsilon", F.lit(float(threshold)))

    def compare(i, x, j, y, own):
        close = distances(x, y, p) <= (own["epsilon"] if own["epsilon"] is not None else -1.0)
        gap = j[None] - i[:, None]
        a, b = np.nonzero(close & (gap > theiler))
        a, b = i[a], j[b]
        whole = y is x and len(i) == own["size"]
        last = own["size"] - 1
        out = []

        def add(kind, line, start, length, cut):
            """Lines that are cut go on as they are, the others as counts."""
            n = np.bincount(length[~cut])
            n_at = np.flatnonzero(n)
            zero = np.full(len(n_at), -1)
            out.append((np.full(len(n_at), kind), zero, zero, n_at, n[n_at]))
            out.append((np.full(cut.sum(), kind), line[cut], start[cut], length[cut], np.ones(cut.sum(), np.int64)))

        line, start, length = _lines(b - a, a)  # along i, on the diagonal j - i
        stop = start + length - 1
        # a line may go on where it begins at the first row or column of the pair, or ends at the last one
        goes = ((start == i[0]) | (start + line == j[0])) & (start > 0) | ((stop == i[-1]) | (stop + line == j[-1])) & (stop + line < last)
        add(0, line, start, length, goes & (not whole))
        if y is x:
            sides = [(np.concatenate([b, a]), np.concatenate([a, b]), i)]
        else:
            sides = [(b, a, i), (a, b, j)]
        for line, at, rows in sides:
            line, start, length = _lines(line, at)  # noqa: PLW2901
            stop = start + length - 1
            add(1, line, start, length, ((start == rows[0]) & (start > 0) | (stop == rows[-1]) & (stop < last)) & (not whole))
        return dict(zip(("kind", "line", "start", "length", "n"), (np.concatenate(z).astype(np.int64) for z in zip(*out, strict=True)), strict=True))

    schema = "kind long, line long, start long, length long, n long"
    short = by_blocks(table, schema, compare, block=block, pairs=False)  # a whole plot has no cut lines
    found = by_blocks(table.where("parts > 1").drop("size").join(_sizes(points), "g"), schema, compare, block=block, alone=False)
    counted = short.unionByName(found.where("line < 0")).select("g", "kind", "length", "n")
    w = Window.partitionBy("g", "kind", "line").orderBy("start")
    opens = F.coalesce(F.col("start") != F.lag(F.col("start") + F.col("length")).over(w), F.lit(True))
    part = F.sum(F.col("opens").cast("long")).over(w)
    joined = found.where("line >= 0").withColumn("opens", opens).withColumn("part", part).groupBy("g", "kind", "line", "part").agg(F.sum("length").alias("length"))
    every = counted.unionByName(joined.select("g", "kind", "length", F.lit(1).cast("long").alias("n")))
    return every.groupBy("g", F.when(F.col("kind") == 0, "diagonal").otherwise("vertical").alias("kind"), "length").agg(F.sum("n").alias("n"))


def rqa(points: DataFrame, threshold: float | DataFrame | None = None, recurrence_rate: float | None = None, theiler: int = 0, min_diagonal: int = 2, min_vertical: int = 2, p: float = 2.0, block: int | None = None) -> DataFrame:
    """One row a series: g, size, epsilon, recurrence_rate (of size * size cells), determinism, laminarity, mean_diagonal, l_max, divergence (1 / l_max, null without lines),
    diagonal_entropy (nats, of lengths from min_diagonal on), trapping_time, v_max, ratio (determinism over rate; null without recurrences).

    Exactly one of threshold (a number, or rows (g, epsilon)) and recurrence_rate. Shares and means are over lines from min_diagonal or min_vertical on; the longest lines over all.
    Series without a recurrence have zeros.
    """
    if (threshold is None) == (recurrence_rate is None):
        raise ValueError("exactly one of threshold and recurrence_rate")
    if min_diagonal < 1 or min_vertical < 1 or theiler < 0:
        raise ValueError("min_diagonal and min_vertical must be at least 1, theiler at least 0")
    eps: float | DataFrame = rate_threshold(points, recurrence_rate, theiler, p, block) if threshold is None else threshold
    hist = line_lengths(points, eps, theiler, p, block)
    diag, cut = F.col("kind") == "diagonal", F.when(F.col("kind") == "diagonal", min_diagonal).otherwise(min_vertical)
    long, points_of = F.col("length") >= cut, F.col("length") * F.col("n")
    of = lambda kind, value: F.coalesce(F.sum(F.when(kind, value)), F.lit(0))
    sums = hist.groupBy("g").agg(
        of(diag, points_of).alias("d"), of(diag & long, points_of).alias("d_long"), of(diag & long, F.col("n")).alias("d_n"), F.max(F.when(diag, F.col("length"))).alias("l_max"),
        F.sum(F.when(diag & long, F.col("n") * F.ln("n"))).alias("nln"), of(~diag, points_of).alias("v"), of(~diag & long, points_of).alias("v_long"), of(~diag & long, F.col("n")).alias("v_n"), F.max(F.when(~diag, F.col("length"))).alias("v_max"),
    )
    sized = _sizes(points)
    sized = sized.join(eps.select("g", "epsilon"), "g", "left") if isinstance(eps, DataFrame) else sized.withColumn("epsilon", F.lit(float(eps)))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = sized.join(sums, "g", "left").select(
        "g", "size", "epsilon", F.coalesce(2 * F.col("d") / (F.col("size").cast("double") * F.col("size")), F.lit(0.0)).alias("recurrence_rate"), share("d_long", "d").alias("determinism"), share("v_long", "v").alias("laminarity"),
        share("d_long", "d_n").alias("mean_diagonal"), F.coalesce("l_max", F.lit(0)).cast("long").alias("l_max"), (1 / F.col("l_max")).alias("divergence"),
        F.when(F.col("d_n") > 0, F.ln("d_n") - F.col("nln") / F.col("d_n")).otherwise(0.0).alias("diagonal_entropy"), share("v_long", "v_n").alias("trapping_time"), F.coalesce("v_max", F.lit(0)).cast("long").alias("v_max"),
    )
    return out.withColumn("ratio", F.when(F.col("recurrence_rate") > 0, F.col("determinism") / F.col("recurrence_rate")))


def windows(rows: DataFrame, window: int, step: int | None = None, column: str = "x") -> DataFrame:
    """Rows of whole windows as series of their own: g becomes (g, w), the w-th window begins at w * step (default: window)."""
    step = window if step is None else step
    if window < 1 or step < 1:
        raise ValueError("window and step must be at least 1")
    last = rows.groupBy("g").agg(F.max("i").alias("last"))
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("i") - window + 1) / step))
    end = F.least(F.floor(F.col("i") / step), F.floor((F.col("last") + 1 - window) / step))
    spread = rows.join(last, "g").where(F.col("last") + 1 >= window).select("g", "i", column, F.explode(F.when(first <= end, F.sequence(first, end)).otherwise(F.array().cast("array<bigint>"))).alias("w"))
    return spread.select(F.struct("g", "w").alias("g"), (F.col("i") - F.col("w") * step).alias("i"), column)


def windowed_rqa(points: DataFrame, window: int, step: int | None = None, **options) -> DataFrame:
    """rqa() of each window: g, w, start, and the measures; options as of rqa()."""
    step = window if step is None else step
    found = rqa(windows(points, window, step), **options)
    return found.select("g.g", "g.w", (F.col("g.w") * step).alias("start"), *[c for c in found.columns if c != "g"])

