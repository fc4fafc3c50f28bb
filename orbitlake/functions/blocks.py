"""Operators on pairs of points of one series: nearest neighbours, correlation sums, embedding dimensions, divergence.

Points have rows (g, i, x), x an array; operators on series take rows (g, i, v) and cut their windows themselves. A
series is packed into rows of BLOCK points, one shuffle; every unordered pair of blocks is one row of a table, compared in
NumPy and reduced at once. Short series are one block and need no second shuffle. So work is spread over
tasks however long a series is, and a task holds two blocks of a long one at a time. All pairs are compared:
the work is quadratic in the length of one series. `near.py` has the way for long series whose neighbours only are wanted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fits import scaling_region
from .series import stats

BLOCK = 2048
#: Rows that a task gives on at once: what a batch of series gives may be many times its size.
GIVEN = 1 << 16
#: Rows of one series that stand for its pairs where percentiles of distances are wanted.
SAMPLE = 90

#: (indices, points) of a block, those of another one or the same ones, and the series' own parameters.
Compare = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[str, float]], dict[str, np.ndarray]]


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def long_series(rows: DataFrame, block: int | None = None) -> DataFrame:
    """(g, parts) of the series of more than one block: at most one row for each `block` samples of the table, so that it can be broadcast."""
    return rows.groupBy("g").agg((F.floor(F.max("i") / (block or BLOCK)) + 1).alias("parts")).where("parts > 1")


def packed(rows: DataFrame, value: str, reach: int = 0, extra: DataFrame | None = None, block: int | None = None, own: Sequence[Column] = ()) -> DataFrame:
    """(g, block, rows, parts, extra columns): each block's (i, value), with the `reach` samples after its end; parts is the number of blocks.

    Only the series of several blocks are listed and broadcast, at most one row for each `block` samples; all others are packed as they stand. own: aggregates of the rows of
    a block, which are those of its series where that is one block."""
    size = block or BLOCK
    at = F.floor(F.col("i") / size)
    spread = F.explode(F.sequence(F.greatest(F.floor((F.col("i") - reach) / size), F.lit(0).cast("long")), at)) if reach else at
    cut = rows.where("g IS NOT NULL").select("g", "i", value, spread.alias("block")).join(F.broadcast(long_series(rows, size)), "g", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    out = cut.groupBy("g", "block", "parts").agg(F.collect_list(F.struct("i", F.col(value).alias("x"))).alias("rows"), *own)
    return out if extra is None else out.join(extra, "g")


def each_block(table: DataFrame, schema: str, see: Callable[[np.ndarray, np.ndarray, dict[str, float]], dict[str, np.ndarray]], block: int | None = None) -> DataFrame:
    """Rows g and what see(indices, values, parameters) makes of each block by itself; `parts` and `block` are among the parameters."""
    own = table.withColumns({"parts_": F.col("parts"), "block_": F.col("block"), "parts": F.lit(1)})
    return by_blocks(own, schema, lambda i, x, j, y, p: see(i, x, p | {"parts": p["parts_"], "block": p["block_"]}), block=block, pairs=False)


def by_blocks(table: DataFrame, schema: str, compare: Compare, window: int = 0, block: int | None = None, pairs: bool = True, alone: bool = True) -> DataFrame:
    """Rows g and what `compare` makes of each pair of blocks (each block with itself alone, unless `pairs`; not those that are a whole series, unless `alone`). window: points are windows of that many samples of a series, else what stands in x."""
    size = block or BLOCK
    extra = [c for c in table.columns if c not in ("g", "block", "rows", "parts")]
    one = table.where("parts = 1").select("g", *extra, F.array(F.struct("block", "rows")).alias("both"))
    spread = table.where("parts > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pair = [F.least("block", "other").alias("first_"), F.greatest("block", "other").alias("last_")]
    two = spread.groupBy("g", *pair).agg(*[F.first(c).alias(c) for c in extra], F.collect_list(F.struct("block", "rows")).alias("both")).drop("first_", "last_")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def points(held: pa.StructArray, at: int) -> tuple[int, np.ndarray, np.ndarray]:
        """(block, indices, points) of one element."""
        rows = held.field("rows")
        a, b = rows.offsets[at].as_py(), rows.offsets[at + 1].as_py()
        index = rows.values.field("i").slice(a, b - a).to_numpy(zero_copy_only=False)
        x = rows.values.field("x").slice(a, b - a)
        if pa.types.is_floating(x.type):
            x = x.to_numpy(zero_copy_only=False)
        else:
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(index), -1)
        order = np.argsort(index, kind="stable")
        index, x, number = index[order], x[order], held.field("block")[at].as_py()
        if window:
            n = max(0, min(len(x) - window + 1, int(np.searchsorted(index, (number + 1) * size))))
            index, x = index[:n], np.lib.stride_tricks.sliding_window_view(x, window)[:n] if n else np.zeros((0, window))
        return number, index, x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, taken, out, held = batch.column(batch.schema.get_field_index("both")), [], [], 0
            params = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in extra]

            def made(batch=batch):
                g = batch.column(0).take(pa.array(np.concatenate(taken)))  # noqa: B023
                return pa.RecordBatch.from_arrays([g, *(pa.array(np.concatenate([o[n] for o in out])) for n in names)], names=["g", *names])  # noqa: B023

            for r in range(len(batch)):
                a, b = both.offsets[r].as_py(), both.offsets[r + 1].as_py()
                parts = sorted((points(both.values, k) for k in range(a, b)), key=lambda p: p[0])
                (_, i, x), (_, j, y) = parts[0], parts[-1]
                if len(i) and len(j):
                    found = compare(i, x, j, y, dict(zip(extra, (p[r] for p in params), strict=True)))
                    taken.append(np.full(len(found[names[0]]), r))
                    out.append(found)
                    held += len(taken[-1])
                if held >= GIVEN:
                    yield made()
                    taken, out, held = [], [], 0
            if out:
                yield made()

    return (one.unionByName(two) if pairs and alone else two if pairs else one).mapInArrow(run, f"g {kind_of(table, 'g')}, {schema}")


def by_series(table: DataFrame, schema: str, compare: Compare, short: str, finish: Callable[[dict[str, np.ndarray], dict[str, float]], dict[str, np.ndarray]], merge: Callable[[DataFrame], DataFrame], window: int = 0, stats: DataFrame | None = None) -> DataFrame:
    """Rows (g, those of `short`). A series of one block is reduced where it is compared, by `finish` (what compare gave, parameters), so no row a point leaves the task; for longer ones `merge`
    makes the same rows of what all pairs of blocks give. stats: the parameters of the longer ones, in place of the block's own."""
    one = by_blocks(table, short, lambda i, x, j, y, own: finish(compare(i, x, j, y, own), own), window, pairs=False)
    long = table.where("parts > 1")
    if stats is not None:
        long = long.drop(*[c for c in stats.columns if c != "g"]).join(stats, "g")
    return one.unionByName(merge(by_blocks(long, schema, compare, window, alone=False)))


def distances(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    d = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        e = np.abs(a[:, k, None] - b[None, :, k])
        d = np.maximum(d, e) if p == math.inf else d + (e if p == 1 else e * e if p == 2 else e**p)
    return d if p in (1, math.inf) else np.sqrt(d) if p == 2 else d ** (1 / p)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances. What is nearest is told by these: a root makes equal what differs by the last bit."""
    return sum((a[:, k, None] - b[None, :, k]) ** 2 for k in range(a.shape[1]))


def _std() -> Column:
    return F.stddev_pop("v").alias("std")


def _both_ways(i: np.ndarray, j: np.ndarray, same: bool, d: np.ndarray, find: Callable[[np.ndarray, np.ndarray, np.ndarray, bool], tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """find(own indices, other indices, distances, turned) for the points of a block, and for those of the other one."""
    own = find(i, j, d, False)
    return own if same else tuple(np.concatenate(z) for z in zip(own, find(j, i, d.T, True), strict=True))


def nearest(points: DataFrame, k: int = 1, theiler: int = 0, p: float = 2.0) -> DataFrame:
    """(g, i, rank, j, distance): the k nearest points more than `theiler` steps away, ties to the smaller j."""

    def compare(i, x, j, y, _):
        def find(own, other, d, _):
            d = np.where(np.abs(own[:, None] - other[None]) <= theiler, np.inf, d)
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            far = np.take_along_axis(d, order, axis=1).ravel()
            use = np.isfinite(far)
            return np.repeat(own, order.shape[1])[use], other[order.ravel()][use], far[use]

        return dict(zip(("i", "j", "distance"), _both_ways(i, j, y is x, distances(x, y, p), find), strict=True))

    found = by_blocks(packed(points, "x"), "i long, j long, distance double", compare)
    rank = F.row_number().over(Window.partitionBy("g", "i").orderBy("distance", "j"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("g", "i", "rank", "j", "distance")


def prediction_error(s: DataFrame, dimension: int = 3, delay: int = 1, horizon: int = 1, k: int = 4, theiler: int = 1) -> DataFrame:
    """(g, error, n): each point's value `horizon` steps on is told by the mean of its k nearest points'; root mean square over the standard deviation (constant series: 0)."""
    span = (dimension - 1) * delay + horizon
    at = [m * delay for m in range(dimension)]

    def compare(i, x, j, y, _):
        def find(own, other, d, turned):
            d = np.where(np.abs(own[:, None] - other[None]) <= theiler, np.inf, d)
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            far = np.take_along_axis(d, order, axis=1).ravel()
            use = np.isfinite(far)
            of, there = (x, y) if not turned else (y, x)
            rows = np.repeat(np.arange(len(own)), order.shape[1])[use]
            return own[rows], far[use], other[order.ravel()][use], there[order.ravel()[use], span], of[rows, span]

        return dict(zip(("i", "distance", "j", "told", "y"), _both_ways(i, j, y is x, squares(x[:, at], y[:, at]), find), strict=True))

    def finish(found, _):
        start, m = np.unique(found["i"], return_index=True, return_counts=True)[1:]
        start = start[m == k]
        off = sum(found["told"][start + r] for r in range(k)) / k - found["y"][start] if len(start) else start
        return {"squares": np.array([(off**2).sum()], float)[: len(off)], "n": np.array([len(off)])[: len(off)]}

    def merge(found):
        rank = F.row_number().over(Window.partitionBy("g", "i").orderBy("distance", "j"))
        told = found.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("g", "i").agg(F.avg("told").alias("said"), F.first("y").alias("y"), F.count("*").alias("m")).where(F.col("m") == k)
        return told.groupBy("g").agg(F.sum(F.pow(F.col("said") - F.col("y"), F.lit(2))).alias("squares"), F.count("*").alias("n")).join(spread, "g")

    spread = stats(s).select("g", "std")
    own = lambda found, p: (got := finish(found, p)) | {"std": np.full(len(got["n"]), p["std"], float)}
    error = by_series(packed(s, "v", span, own=[_std()]), "i long, distance double, j long, told double, y double", compare, "squares double, n long, std double", own, merge, span + 1)
    return error.select("g", F.when(F.col("std") > 0, F.sqrt(F.col("squares") / F.col("n")) / F.col("std")).otherwise(0.0).alias("error"), "n")


def _all_dimensions(s: DataFrame, columns: int, delay: int, theiler: int, p: float, short: str, finish: Callable, merge: Callable) -> DataFrame:
    """What finish and merge make of (d, distance, extra) of each point, for d from 1 to columns - 1: the nearest point in the first d coordinates, and how far the next one is off."""
    span = (columns - 1) * delay

    def compare(i, x, j, y, _):
        near = np.abs(i[:, None] - j[None]) <= theiler
        d, out = np.zeros((len(i), len(j))), []
        for k in range(columns - 1):
            e = np.abs(x[:, k * delay, None] - y[None, :, k * delay])
            d = np.maximum(d, e) if p == math.inf else d + e * e
            masked = np.where(near, np.inf, d if p == math.inf else np.sqrt(d))  # distances that are equal as such go to the smaller j, in a block as between blocks

            def find(own, other, m, turned, k=k):
                of, there = (x, y) if not turned else (y, x)
                best = m.argmin(axis=1)
                far = m[np.arange(len(own)), best]
                use = np.isfinite(far)
                extra = np.abs(of[:, (k + 1) * delay] - there[best, (k + 1) * delay])
                return np.full(use.sum(), k + 1), own[use], other[best][use], far[use], extra[use]

            out.append(_both_ways(i, j, y is x, masked, find))
        return dict(zip(("d", "i", "j", "distance", "extra"), map(np.concatenate, zip(*out, strict=True)), strict=True))

    def best(found):
        return merge(found.groupBy("g", "d", "i").agg(F.min(F.struct("distance", "j", "extra")).alias("b")).select("g", "d", "i", "b.distance", "b.extra"))

    return by_series(packed(s, "v", span, own=[_std()]), "d long, i long, j long, distance double, extra double", compare, short, finish, best, span + 1)


def false_nearest_neighbours(s: DataFrame, delay: int = 1, max_dim: int = 10, rtol: float = 15.0, atol: float = 2.0, threshold: float = 0.01, theiler: int = 0) -> DataFrame:
    """(g, d, fraction, dimension): the share of false neighbours in each dimension, and the first dimension with `threshold` of them at most (else that with fewest). Constant and too short series have no rows."""

    def finish(found, own):
        false = (found["extra"] > rtol * found["distance"]) | (np.sqrt(found["distance"] ** 2 + found["extra"] ** 2) > atol * own["std"])
        n = np.bincount(found["d"] if own["std"] > 0 else [], minlength=1)
        d = np.flatnonzero(n)
        return {"d": d, "fraction": np.bincount(found["d"], false)[d] / n[d]}

    def merge(rows):
        false = (F.col("extra") > rtol * F.col("distance")) | (F.sqrt(F.pow("distance", F.lit(2)) + F.pow("extra", F.lit(2))) > atol * F.col("std"))
        return rows.join(stats(s).where("std > 0").select("g", "std"), "g").groupBy("g", "d").agg(F.avg(false.cast("double")).alias("fraction"))

    curve = _all_dimensions(s, max_dim + 1, delay, theiler, 2.0, "d long, fraction double", finish, merge)
    own = Window.partitionBy("g")
    least = F.min(F.when(F.col("fraction") <= threshold, F.col("d"))).over(own)
    return curve.select("g", "d", "fraction", F.coalesce(least, F.min_by("d", F.struct("fraction", "d")).over(own)).alias("dimension"))


def cao_dimension(s: DataFrame, delay: int = 1, max_dim: int = 10, threshold: float = 0.9, theiler: int = 0) -> DataFrame:
    """(g, d, e1, e2, dimension): Cao's ratios, and the first dimension whose e1 reaches `threshold` (else that with the largest). Pairs without distance are left out."""

    def finish(found, _):
        use = found["distance"] > 0
        at, far, extra = found["d"][use], found["distance"][use], found["extra"][use]
        n = np.bincount(at)
        d = np.flatnonzero(n)
        return {"d": d, "e": np.bincount(at, np.maximum(far, extra) / far)[d] / n[d], "s": np.bincount(at, extra)[d] / n[d]}

    def merge(rows):
        return rows.where("distance > 0").groupBy("g", "d").agg(F.avg(F.greatest("distance", "extra") / F.col("distance")).alias("e"), F.avg("extra").alias("s"))

    e = _all_dimensions(s, max_dim + 2, delay, theiler, math.inf, "d long, e double, s double", finish, merge)
    own, next_ = Window.partitionBy("g"), Window.partitionBy("g").orderBy("d")
    ratio = e.select("g", "d", (F.lead("e").over(next_) / F.col("e")).alias("e1"), F.when(F.col("s") > 0, F.lead("s").over(next_) / F.col("s")).alias("e2")).where(F.col("d") <= max_dim)
    first = F.min(F.when(F.col("e1") >= threshold, F.col("d"))).over(own)
    return ratio.select("g", "d", "e1", "e2", F.coalesce(first, F.max_by("d", F.struct("e1", -F.col("d"))).over(own)).alias("dimension"))


def embedding_dimension(s: DataFrame, method: str = "cao", **options: float) -> DataFrame:
    """(g, dimension) by `cao` or `fnn`."""
    if method not in ("cao", "fnn"):
        raise ValueError(f"unknown method {method!r}")
    return (cao_dimension if method == "cao" else false_nearest_neighbours)(s, **options).groupBy("g").agg(F.max("dimension").alias("dimension"))


def correlation_sum(points: DataFrame, radii: Sequence[float] | None = None, theiler: int = 0, p: float = 2.0, n_radii: int = 24) -> DataFrame:
    """(g, radius, pairs, valid, correlation_sum): of pairs more than `theiler` steps apart, the share within each radius.

    By default `n_radii` radii in equal ratios from the 1st to the 50th percentile of the distances between SAMPLE points, those
    with the smallest hashes (where both agree: from half of that to that, where all are 0: one radius of 1): only the choice of radii is sampled, all pairs are counted.
    """
    extra = None
    if radii is None:
        drawn = points.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("g", "i"), "i"))).where(F.col("r") <= SAMPLE)
        both = drawn.alias("a").join(drawn.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.i") < F.col("b.i")))
        off = F.zip_with("a.x", "b.x", lambda x, y: F.abs(x - y))
        far = F.array_max(off) if p == math.inf else F.pow(F.aggregate(off, F.lit(0.0), lambda t, x: t + F.pow(x, F.lit(p))), F.lit(1 / p))
        q = both.select(F.col("a.g").alias("g"), far.alias("d")).groupBy("g").agg(F.percentile(F.when(F.col("d") > 0, F.col("d")), F.array(F.lit(0.01), F.lit(0.5))).alias("q"))
        low, high = F.coalesce(F.col("q")[0], F.lit(1.0)), F.coalesce(F.col("q")[1], F.lit(1.0))
        extra = q.select("g", F.when(low < high, low).otherwise(F.when(F.col("q").isNull(), high).otherwise(high / 2)).alias("low"), high.alias("high"))
        steps = np.linspace(0, 1, n_radii)
    else:
        fixed = np.sort(np.asarray(radii, float))

    def compare(i, x, j, y, own):
        r = fixed if radii is not None else np.unique(own["low"] * (own["high"] / own["low"]) ** steps)
        d = distances(x, y, p)[j[None] - i[:, None] > theiler]
        within = np.cumsum(np.bincount(np.searchsorted(r, d, side="left"), minlength=len(r) + 1))[: len(r)]
        return {"radius": r, "pairs": within, "valid": np.full(len(r), len(d))}

    schema = "radius double, pairs long, valid long"
    total = by_series(packed(points, "x", extra=extra), schema, compare, schema, lambda found, _: found, lambda found: found.groupBy("g", "radius").agg(F.sum("pairs").alias("pairs"), F.sum("valid").alias("valid")))
    return total.select("g", "radius", "pairs", "valid", F.when(F.col("valid") > 0, F.col("pairs") / F.col("valid")).alias("correlation_sum"))


def correlation_dimension(points: DataFrame, min_window: int = 5, tol: float = 1.5, **options: float) -> DataFrame:
    """(g, slope, ...): the scaling region of log correlation sums over log radii."""
    sums = correlation_sum(points, **options).where("correlation_sum > 0")
    return scaling_region(sums.select("g", F.ln("radius").alias("x"), F.ln("correlation_sum").alias("y")), min_window, tol)


def divergence(s: DataFrame, dimension: int = 3, delay: int = 1, theiler: int | None = None, k_max: int = 20, method: str = "kantz", eps: float | None = None, neighbours: int = 1, squared: bool = True) -> DataFrame:
    """(g, k, divergence, points): mean log distance k steps after two points were near, and the number of points it is of. `rosenstein`: of each point and its nearest; `kantz`: the log of the mean
    distance to the points within eps (by default 0.1 standard deviations), of points with `neighbours` of these at least. squared: the nearest is told by squared distances, else by their roots, of which more are equal (ties to the smaller index). divergence_rate() gives the exponent."""
    if method not in ("kantz", "rosenstein"):
        raise ValueError(f"unknown method {method!r}")
    apart = (dimension - 1) * delay if theiler is None else theiler
    span = (dimension - 1) * delay + k_max
    at = np.arange(dimension) * delay
    steps = np.arange(k_max + 1)
    follow = at[None] + steps[:, None]  # columns of the point k steps on
    rosenstein = method == "rosenstein"
    log = lambda d: np.log(np.maximum(d, 1e-12))

    def later(of: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Distances of pairs of windows at each step."""
        off = (of - there) ** 2
        return np.sqrt(sum(off[:, follow[:, m]] for m in range(dimension)))

    def compare(i, x, j, y, own):
        d = squares(x[:, at], y[:, at])
        if not (rosenstein and squared):
            d = np.sqrt(d)
        near = -1.0 if not own["std"] > 0 else eps if eps else 0.1 * own["std"]

        def find(mine, other, d, turned):
            of, there = (x, y) if not turned else (y, x)
            valid = np.abs(mine[:, None] - other[None]) > apart
            if rosenstein:
                m = np.where(valid, d, np.inf)
                best = m.argmin(axis=1)
                use = np.flatnonzero(np.isfinite(m[np.arange(len(mine)), best]))
                best = best[use]
                curve = log(later(of[use], there[best]))
                return mine[use], m[use, best], other[best], np.ones(len(use), np.int64), curve
            a, b = np.nonzero(valid & (d <= near))
            sums = np.zeros((len(mine), k_max + 1))
            for start in range(0, len(a), 1 << 16):
                part = slice(start, start + (1 << 16))
                np.add.at(sums, a[part], later(of[a[part]], there[b[part]]))
            n = np.bincount(a, minlength=len(mine))
            use = np.flatnonzero(n)
            return mine[use], np.zeros(len(use)), np.zeros(len(use), np.int64), n[use], sums[use]

        index, far, partner, n, curve = _both_ways(i, j, y is x, d, find)
        k = np.tile(steps, len(index))
        return {"i": np.repeat(index, k_max + 1), "k": k, "distance": np.repeat(far, k_max + 1), "j": np.repeat(partner, k_max + 1), "n": np.repeat(n, k_max + 1), "value": curve.ravel()}

    def finish(found, _):
        curve, n = found["value"].reshape(-1, k_max + 1), found["n"][:: k_max + 1]
        if not rosenstein:
            use = n >= neighbours
            curve, n = log(curve[use] / n[use, None]), n[use]
        some = slice(None if len(n) else 0)
        return {"k": steps[some].astype(np.int32), "divergence": (curve.sum(axis=0) / max(len(n), 1))[some], "points": np.full(k_max + 1, len(n))[some]}

    def merge(found):
        if rosenstein:
            each = found.groupBy("g", "k", "i").agg(F.min(F.struct("distance", "j", "value")).alias("b")).select("g", "k", F.col("b.value").alias("value"))
        else:
            each = found.groupBy("g", "k", "i").agg(F.sum("value").alias("sum"), F.sum("n").alias("n")).where(F.col("n") >= neighbours)
            each = each.select("g", "k", F.ln(F.greatest(F.col("sum") / F.col("n"), F.lit(1e-12))).alias("value"))
        return each.groupBy("g", F.col("k").cast("int").alias("k")).agg(F.avg("value").alias("divergence"), F.count("*").alias("points"))

    schema = "i long, k long, distance double, j long, n long, value double"
    return by_series(packed(s, "v", span, own=[_std()]), schema, compare, "k int, divergence double, points long", finish, merge, span + 1, None if rosenstein else stats(s).select("g", "std"))
