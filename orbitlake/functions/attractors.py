"""Attractors held as tables: merging, pooling, thinning, matching along a parameter, tipping points.

Clouds are rows (g, label, x), one for each point, x an array; `g` names a system, a run or a series. Points that lie
close to each other are found by cells, equal points are one point first, and what depends on an order (the greedy
choices) is settled in rounds whose result equals that of one pass in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import save
from .blocks import kind_of

#: Cells take the first coordinates; distances always take all.
CELLED = 3


def _distance(a: str, b: str) -> Column:
    return F.expr(f"sqrt(aggregate(zip_with({a}, {b}, (u, w) -> (u - w) * (u - w)), 0D, (s, t) -> s + t))")


def _sound(x: str = "x") -> Column:
    return F.coalesce(F.col(x).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def _cells(side: float, shift: tuple[float, ...] = (0.0,) * CELLED, x: str = "x") -> list[Column]:
    """Cells of a side as doubles, which do not overflow; a coordinate that a point lacks is 0."""
    return [(F.floor(F.coalesce(F.get(x, F.lit(k)), F.lit(0.0)) / side).cast("double") + d).alias(f"c{k}") for k, d in enumerate(shift)]


def _around(points: DataFrame, side: float) -> DataFrame:
    """Each point once for each cell that it may reach over one side."""
    own = F.struct(*_cells(side))
    to = lambda d: F.struct(*[(own[f"c{k}"] + d[k]).alias(f"c{k}") for k in range(CELLED)])
    # no step along a coordinate that the point lacks
    steps = [F.when(F.size("x") > max((k for k in range(CELLED) if d[k]), default=-1), to(d)) for d in product((-1.0, 0.0, 1.0), repeat=CELLED)]
    return points.withColumn("cell", F.explode(F.array_compact(F.array(*steps)))).select("*", *[f"cell.c{k}" for k in range(CELLED)]).drop("cell")


def close_pairs(points: DataFrame, tol: float) -> DataFrame:
    """(g, a, b): nodes a < b of rows (g, node, x) that lie within tol. Equal points are linked to the least of them only; points without a finite x to no other."""
    if tol < 0:
        raise ValueError("tol must not be negative")
    sound = points.where(_sound()).select("g", "node", "x")
    first = sound.groupBy("g", "x").agg(F.min("node").alias("first"))
    same = sound.join(first, ["g", "x"]).where("node <> first").select("g", F.col("first").alias("a"), F.col("node").alias("b"))
    side = tol * (1 + 1e-6) if tol > 0 else 1.0  # a little more, so that rounding leaves none out
    left = _around(first.select("g", F.col("first").alias("a"), F.col("x").alias("x")), side).withColumnRenamed("x", "xa")
    right = first.select("g", F.col("first").alias("b"), F.col("x").alias("xb"), *_cells(side))
    met = left.join(right, ["g", *[f"c{k}" for k in range(CELLED)]]).where("a < b AND size(xa) = size(xb)")
    return met.where(_distance("xa", "xb") <= tol).select("g", "a", "b").unionByName(same)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, node, component): the least node that can be reached, for nodes (g, node) and edges (g, a, b) between them.

    Parents move to the least grandparent of a neighbour, of which there is one row a node, so a node with many edges is no
    large group; chains take a number of rounds that grows with the logarithm of their length. Runs jobs when called.
    """
    one = edges.select("g", "a", "b").where("a <> b")
    both = save(one.unionByName(one.select("g", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    tree = save(nodes.select("g", "node").distinct().withColumn("p", F.col("node")))
    while True:
        seen = tree.join(tree.select("g", F.col("node").alias("p"), F.col("p").alias("up")), ["g", "p"])
        least = both.join(seen.select("g", F.col("node").alias("b"), "up"), ["g", "b"]).groupBy("g", F.col("a").alias("node")).agg(F.min("up").alias("m"))
        none = F.lit(None).cast(kind_of(tree, "p"))
        offer = lambda node, p, old: F.struct(F.col(node).alias("node"), F.col(p).alias("p"), old.alias("old"))
        offers = seen.join(least, ["g", "node"], "left").select("g", F.explode(F.array(offer("node", "up", F.col("p")), offer("node", "m", none), offer("p", "m", none))).alias("o")).select("g", "o.*")
        moved = save(offers.groupBy("g", "node").agg(F.min("p").alias("p"), F.max("old").alias("old")))
        tree = moved.select("g", "node", "p")
        if moved.where("p <> old").isEmpty():
            return tree.withColumnRenamed("p", "component")


def centres(clouds: DataFrame) -> DataFrame:
    """(g, label, points, x): the centroid of each cloud over its points of finite coordinates."""
    parts = clouds.where(_sound()).select("g", "label", F.posexplode("x").alias("k", "v"))
    means = parts.groupBy("g", "label", "k").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    x = F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda e: e["v"])  # one entry a coordinate
    return means.groupBy("g", "label").agg(F.max("n").alias("points"), x.alias("x"))


def merge_map(clouds: DataFrame, tol: float) -> DataFrame:
    """(g, label, merged): clouds whose centroids lie within tol, directly or by way of others, take the least of their labels."""
    nodes = save(centres(clouds).select("g", F.col("label").alias("node"), "x"))
    return components(nodes, close_pairs(nodes, tol)).select("g", F.col("node").alias("label"), F.col("component").alias("merged"))


def apply_merge(table: DataFrame, merged: DataFrame, g: str = "g") -> DataFrame:
    """A table with a column `label` (clouds, a label grid with g="b") whose labels are replaced by merge_map(); others stay."""
    new = merged.select(F.col("g").alias(g), "label", F.col("merged").alias("__merged"))
    return table.join(new, [g, "label"], "left").withColumn("label", F.coalesce("__merged", "label")).drop("__merged").select(*table.columns)


def _thinned(rows: DataFrame, tol: float, kinds: str) -> DataFrame:
    """dedup_points() of series that are one row each, (g, held) with held the sorted (i, x): one pass, in which each kept point drops what follows near it."""

    def kept(x: list[np.ndarray]) -> np.ndarray:
        sizes, stay = np.array([len(v) for v in x]), np.zeros(len(x), bool)
        for size in np.unique(sizes):  # points of another length do not meet
            at = np.flatnonzero(sizes == size)
            p = np.stack([x[n] for n in at]).astype(float)
            while len(at):
                stay[at[0]] = True
                off = np.zeros(len(at))
                for k in range(size):
                    off += (p[:, k] - p[0, k]) ** 2
                far = np.sqrt(off) >= tol
                at, p = at[far], p[far]
        return np.flatnonzero(stay)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, held = batch.column(0), batch.column(1)
            ends, points, xs = held.offsets.to_numpy(), held.values, held.values.field("x")
            coordinates, starts = xs.values.to_numpy(zero_copy_only=False), xs.offsets.to_numpy()
            of, use = [], []
            for r in range(len(batch)):
                a, b = ends[r], ends[r + 1]
                stay = kept([coordinates[starts[n] : starts[n + 1]] for n in range(a, b)]) + a
                use.append(stay)
                of.append(np.full(len(stay), r))
            if use:
                left = points.take(pa.array(np.concatenate(use)))
                yield pa.RecordBatch.from_arrays([g.take(pa.array(np.concatenate(of))), left.field("i"), left.field("x")], names=["g", "i", "x"])

    return rows.mapInArrow(run, kinds)


def dedup_points(points: DataFrame, tol: float, wide: int = 8, shown: int = 64, whole: int = 2048) -> DataFrame:
    """(g, i, x): points kept by one pass in the order of i that drops each one closer than tol to one kept before; equal i are ordered by x.

    Series of up to `whole` points take that pass as it is, each in one row, many to a task, without rounds. For longer ones a round gives each box, `wide` tol to a side, the first `shown` undecided points of each of its cells and those of its rim. What follows from
    them is kept; then everything near a kept point goes, wherever it stands. The first undecided point is always settled, and a
    cell's points mostly by one that is kept, so dense cells take few rounds and a task holds a bounded number of points. Runs jobs when
    called. Points without finite coordinates are left out; a tol of 0 keeps every other point.
    """
    rest = points.where(_sound()).select("g", "i", "x")
    if tol <= 0:
        return rest
    keys, side = ["g", *[f"c{k}" for k in range(CELLED)]], tol / CELLED**0.5 * (1 - 1e-9)
    kinds = ", ".join(f"{c} {kind_of(rest, c)}" for c in ("g", "i", "x"))
    sizes = rest.groupBy("g").agg(F.count("*").alias("size"))
    few = rest.join(sizes.where(F.col("size") <= whole).select("g"), "g")
    short = _thinned(few.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("held")), tol, kinds)
    rest, kept, box = save(rest.join(sizes.where(F.col("size") > whole).select("g"), "g").groupBy("g", "x").agg(F.min("i").alias("i"))), [short], wide * tol
    cols = [f"b{k}" for k in range(CELLED)]

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(t=[tuple(x) for x in pdf["x"]]).sort_values(["i", "t"], kind="stable").reset_index(drop=True)
        x = [np.asarray(t, float) for t in pdf["t"]]
        cell = [tuple(np.floor(np.pad(v[:CELLED], (0, max(0, CELLED - len(v)))) / side).astype(int)) for v in x]
        own, more = pdf["own"].to_numpy(bool), pdf["more"].to_numpy(bool)
        place = list(zip(pdf["i"], pdf["t"], strict=True))
        end: dict[tuple, tuple] = {}  # cells with points that are not shown, and the last one shown
        for c, p, m in zip(cell, place, more, strict=True):
            if m:
                end[c] = max(end.get(c, p), p)
        used = min(CELLED, max(map(len, x)))
        reach, held, stay = [d + (0,) * (CELLED - used) for d in product(range(-2, 3), repeat=used)], {}, []  # cells have under 0.58 tol to a side
        for n, (c, v) in enumerate(zip(cell, x, strict=True)):
            near = [tuple(a + b for a, b in zip(c, d, strict=True)) for d in reach]
            ways = [sure for k in near for sure, w in held.get(k, ()) if len(w) == len(v) and np.sqrt(((w - v) ** 2).sum()) < tol]
            if any(ways):
                continue
            sure = not ways and bool(own[n]) and all(place[n] <= end[k] for k in near if k in end)
            held.setdefault(c, []).append((sure, v))
            if sure:
                stay.append(n)
        return pdf.loc[stay, ["g", "i", "x"]]

    while not rest.isEmpty():
        order = Window.partitionBy(*keys).orderBy("i", "x")
        ranked = rest.select("*", *_cells(side)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= shown).withColumn("more", F.col("n") == shown).drop(*keys[1:], "n")
        at = [F.coalesce(F.get("x", F.lit(k)), F.lit(0.0)) + box / 2 for k in range(CELLED)]  # a lacking coordinate is in the middle of its box
        spots = F.array(*[F.struct(*[F.floor((at[k] + d[k] * 1.001 * tol) / box).cast("double").alias(f"b{k}") for k in range(CELLED)]) for d in product((-1.0, 0.0, 1.0), repeat=CELLED)])
        mine = F.struct(*[F.floor(at[k] / box).cast("double").alias(f"b{k}") for k in range(CELLED)])
        boxed = ranked.withColumn("mine", mine).withColumn("spot", F.explode(F.array_distinct(spots))).withColumn("own", F.col("spot") == F.col("mine")).select("g", "i", "x", "more", "own", *[f"spot.{c}" for c in cols])
        new = save(boxed.groupBy("g", *cols).applyInPandas(settle, kinds))
        kept.append(new)
        wider = tol * (1 + 1e-6)
        gone = _around(new.select("g", F.col("x").alias("y"), "x"), wider).select("g", "y", *keys[1:])
        left = rest.select("*", *_cells(wider)).join(gone, keys, "left").withColumn("off", F.coalesce((F.size("x") == F.size("y")) & (_distance("x", "y") < tol), F.lit(False)))
        rest = save(left.groupBy("g", "i", "x").agg(F.max("off").alias("off")).where("NOT off").select("g", "i", "x"))
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def match_attractors(table: DataFrame, threshold: float | None = None, min_fraction: float = 0.0) -> DataFrame:
    """(g, parameter, label, id, fraction): ids that go on from one parameter value to the next, for rows (g, parameter, label, x, fraction), x a centroid.

    The nearest pair of neighbouring values is matched first, then the nearest of those left, and so on; none over `threshold`; ties by the label before, then the label after.
    What is left begins an id; ids are numbered from 1 in the order of parameter, then label. Rows of a fraction under min_fraction (null: 0) are left out; a value
    that keeps none, or has only a row with a null label, gives one row of nulls. Matches of all values are settled at once, in rounds that take every pair which is the
    nearest one to both of its sides: that equals the pass in order of distance. A value's pairs are as many as its attractors times those before. Runs jobs when called.
    """
    every = table.select("g", "parameter").distinct().withColumn("step", F.row_number().over(Window.partitionBy("g").orderBy("parameter")))
    sets = table.where(F.col("label").isNotNull() & (F.coalesce(F.col("fraction").cast("double"), F.lit(0.0)) >= min_fraction)).join(every, ["g", "parameter"])
    sets = save(sets.select("g", "step", "label", "x", "fraction"))
    before = sets.select("g", (F.col("step") + 1).alias("step"), F.col("label").alias("p"), F.col("x").alias("y"))
    pairs = before.join(sets.select("g", "step", F.col("label").alias("c"), "x"), ["g", "step"]).where("size(x) = size(y)").withColumn("d", _distance("x", "y")).where("d IS NOT NULL AND NOT isnan(d)")
    free = save((pairs if threshold is None else pairs.where(F.col("d") <= threshold)).select("g", "step", "p", "c", "d"))
    links = free.select("g", "step", "p", "c").limit(0)
    while not free.isEmpty():
        of = lambda a, b: free.groupBy("g", "step", a).agg(F.min(F.struct("d", b)).alias("m")).select("g", "step", a, F.col(f"m.{b}").alias(b))
        hit = save(of("p", "c").join(of("c", "p"), ["g", "step", "p", "c"]))
        links = links.unionByName(hit)
        free = save(free.join(hit.select("g", "step", "p"), ["g", "step", "p"], "left_anti").join(hit.select("g", "step", "c"), ["g", "step", "c"], "left_anti"))
    # each attractor points at the one before; pointers double until they reach the first
    way = sets.select("g", "step", F.col("label").alias("c")).join(links, ["g", "step", "c"], "left")
    way = save(way.select("g", "step", "c", F.when(F.col("p").isNull(), F.col("step")).otherwise(F.col("step") - 1).alias("s"), F.coalesce("p", "c").alias("p")))
    while True:
        far = way.join(way.select("g", F.col("step").alias("s"), F.col("c").alias("p"), F.col("s").alias("s2"), F.col("p").alias("p2")), ["g", "s", "p"])
        done = far.where("s <> s2").isEmpty()
        if done:
            break
        way = save(far.select("g", "step", "c", F.col("s2").alias("s"), F.col("p2").alias("p")))
    heads = way.where("step = s").select("g", "s", "p", F.row_number().over(Window.partitionBy("g").orderBy("s", "p")).cast("long").alias("id"))
    named = way.join(heads, ["g", "s", "p"]).select("g", "step", F.col("c").alias("label"), "id")
    full = sets.select("g", "step", "label", "fraction").join(named, ["g", "step", "label"])
    return every.join(full, ["g", "step"], "left").select("g", "parameter", "label", "id", "fraction")


def tipping_points(tracked: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(g, value, id, kind, before, after): where the fraction of an id of match_attractors() passes the threshold between neighbouring parameter values.

    `disappear`: over it before, at most at it after; `appear`: the other way round. An id that a value lacks has a fraction of 0 there, as a null one has. Nothing appears at the first value.
    """
    steps = tracked.select("g", "parameter").distinct().withColumn("step", F.row_number().over(Window.partitionBy("g").orderBy("parameter")))
    f = F.coalesce(F.nanvl(F.col("fraction").cast("double"), F.lit(0.0)), F.lit(0.0))
    held = tracked.where("id IS NOT NULL").join(steps, ["g", "parameter"]).select("g", "id", "step", f.alias("f"))
    # an id's share changes only at values that have it and at those after them
    met = held.select("g", "id", "step", F.col("f").alias("after"), F.lit(None).cast("double").alias("before")).unionByName(held.select("g", "id", (F.col("step") + 1).alias("step"), F.lit(None).cast("double").alias("after"), F.col("f").alias("before")))
    turn = met.groupBy("g", "id", "step").agg(F.coalesce(F.max("before"), F.lit(0.0)).alias("before"), F.coalesce(F.max("after"), F.lit(0.0)).alias("after")).where("step > 1")
    kind = F.when((F.col("before") > threshold) & (F.col("after") <= threshold), "disappear").when((F.col("before") <= threshold) & (F.col("after") > threshold), "appear")
    return turn.join(steps, ["g", "step"]).select("g", F.col("parameter").alias("value"), "id", kind.alias("kind"), "before", "after").where("kind IS NOT NULL")
