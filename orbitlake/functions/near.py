"""Neighbours of points (g, i, x) by space-partitioned cells: for series that are too long for all pairs.

1. A sample of each series (about SAMPLE points, by hash) gives a k-d tree of medians with cells of about CELL points,
   and every point goes to its cell: one shuffle, of packed rows.
2. The distance of a query's k-th neighbour is bounded from above by that within its own cell, and by the farthest corners of
   the nearest boxes that hold k admissible points together (cells tell their true boxes and counts).
3. A query is sent to the cells whose boxes are within that bound, and to no others, together with the
   other queries of its cell. What they find is merged by query: exact, the sample only shapes the cells.

Queries that reach few cells cost a few cells each, so time grows with n log n, not with n squared; the table of cells of a series (at most
2**DEPTH boxes) goes along with its packed rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import distances, kind_of, packed
from .fits import scaling_region

CELL, DEPTH, SAMPLE = 512, 12, 32_768
#: Points of a row before they have a cell.
ROW = 1 << 15
#: Reference points of a fixed-mass dimension.
REFERENCES = 1500


def _trees(points: DataFrame) -> DataFrame:
    """(g, size, depth, tree): a heap of (coordinate, cut) for each series, from sampled medians."""
    sizes = points.groupBy("g").agg(F.count("*").alias("size")).withColumn("depth", F.least(F.lit(DEPTH), F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / CELL)))).cast("int"))
    share = F.xxhash64("g", "i").cast("double") / 2.0**64 + 0.5 < F.lit(float(SAMPLE)) / F.col("size")
    drawn = points.join(sizes, "g").where((F.col("depth") > 0) & share).select("g", "depth", "x")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        depth, x = int(pdf["depth"].iloc[0]), np.array(pdf["x"].tolist())
        tree = np.zeros((1 << depth, 2))
        parts = {1: x}
        for node in range(1, 1 << depth):
            own = parts.pop(node, x[:0])
            if len(own):
                k = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                cut = float(np.median(own[:, k]))
                tree[node] = k, cut
                right = own[:, k] > cut
                parts[2 * node], parts[2 * node + 1] = own[~right], own[right]
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "tree": [tree.tobytes()]})

    grown = drawn.groupBy("g").applyInPandas(grow, f"g {kind_of(points, 'g')}, tree binary")
    return sizes.join(grown, "g", "left").select("g", "size", "depth", F.coalesce("tree", F.lit(b"")).alias("tree"))


def _cell_of(x: np.ndarray, tree: np.ndarray, depth: int) -> np.ndarray:
    node = np.ones(len(x), np.int64)
    for _ in range(depth):
        k, cut = tree[node, 0].astype(np.int64), tree[node, 1]
        node = 2 * node + (x[np.arange(len(x)), k] > cut)
    return node - (1 << depth)


def _table(out: dict[str, list], g: pa.Array, rows: list[int], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([g.take(pa.array(rows, pa.int64())), *(pa.array(out[c], k) for c, k in kinds.items())], names=["g", *kinds])


def cells(points: DataFrame) -> DataFrame:
    """(g, cell, m, i, x, low, high): packed cells of m points, their indices and coordinates as bytes, and their box."""
    table = packed(points, "x", extra=_trees(points), block=ROW)
    kinds = {"cell": pa.int64(), "m": pa.int64(), "i": pa.binary(), "x": pa.binary(), "low": pa.list_(pa.float64()), "high": pa.list_(pa.float64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            lists, out, rows = col("rows"), {c: [] for c in kinds}, []
            for r in range(len(batch)):
                a, b = lists.offsets[r].as_py(), lists.offsets[r + 1].as_py()
                index = lists.values.field("i").slice(a, b - a).to_numpy(zero_copy_only=False)
                x = lists.values.field("x").slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(len(index), -1)
                depth = col("depth")[r].as_py()
                cell = _cell_of(x, np.frombuffer(col("tree")[r].as_py()).reshape(-1, 2), depth) if depth else np.zeros(len(x), np.int64)
                order = np.lexsort((index, cell))
                for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                    rows.append(r)
                    for c, v in zip(kinds, (int(cell[part[0]]), len(part), index[part].tobytes(), np.ascontiguousarray(x[part]).tobytes(), x[part].min(axis=0), x[part].max(axis=0)), strict=True):
                        out[c].append(v)
            yield _table(out, batch.column(0), rows, kinds)

    pieces = table.select("g", "rows", "depth", "tree").mapInArrow(run, f"g {kind_of(points, 'g')}, cell long, m long, i binary, x binary, low array<double>, high array<double>")
    least = lambda f, c: F.aggregate(c, F.element_at(c, 1), lambda s, y: F.zip_with(s, y, f))
    whole = pieces.groupBy("g", "cell").agg(F.sum("m").alias("m"), F.collect_list(F.struct("i", "x", "low", "high")).alias("b"))
    whole = whole.select("g", "cell", "m", F.col("b.i").alias("is"), F.col("b.x").alias("xs"), F.col("b.low").alias("lows"), F.col("b.high").alias("highs"))
    joined = [F.aggregate(c, F.lit(b""), lambda s, y: F.concat(s, y)).alias(n) for c, n in (("is", "i"), ("xs", "x"))]
    return whole.select("g", "cell", "m", *joined, least(lambda s, y: F.least(s, y), "lows").alias("low"), least(lambda s, y: F.greatest(s, y), "highs").alias("high"))


def _norm(gap: np.ndarray, p: float) -> np.ndarray:
    return gap.max(axis=-1) if p == math.inf else (gap**p).sum(axis=-1) ** (1 / p)


def _asked(held: DataFrame, k: int, theiler: int, p: float, queries: DataFrame, inside: bool) -> DataFrame:
    """(g, cell, m, i, x, r): queries of one row that go to a cell together, with their bounds as bytes. inside: the rows are cells of the points themselves."""
    plan = held.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("cell", "m", "low", "high"))).alias("b"))  # 2**DEPTH boxes at most
    plan = plan.select("g", F.col("b.cell").alias("name"), F.col("b.m").alias("count"), F.flatten("b.low").alias("low"), F.flatten("b.high").alias("high"))
    kinds = {"cell": pa.int64(), "m": pa.int64(), "i": pa.binary(), "x": pa.binary(), "r": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            out, rows = {c: [] for c in kinds}, []
            for r in range(len(batch)):
                name, count, low, high = (col(c)[r].values.to_numpy(zero_copy_only=False) for c in ("name", "count", "low", "high"))
                low, high = low.reshape(len(name), -1), high.reshape(len(name), -1)
                index = np.frombuffer(col("i")[r].as_py(), np.int64)
                x = np.frombuffer(col("x")[r].as_py()).reshape(len(index), -1)
                goes: dict[int, list] = {}
                for a in range(0, len(index), 256):
                    y = x[a : a + 256, None]
                    far = _norm(np.maximum(np.abs(y - low), np.abs(y - high)), p)
                    near = _norm(np.maximum(0, np.maximum(low - y, y - high)), p)
                    order = np.argsort(far, axis=1)
                    enough = np.cumsum(count[order], axis=1) >= k + 2 * theiler + 1
                    at = np.where(enough.any(axis=1), enough.argmax(axis=1), far.shape[1] - 1)
                    bound = np.take_along_axis(far, np.take_along_axis(order, at[:, None], axis=1), axis=1)[:, 0]
                    bound = np.where(enough.any(axis=1), bound * (1 + 1e-12), np.inf)
                    if inside and k < len(x):
                        d = distances(x[a : a + 256], x, p)
                        d[np.abs(index[a : a + 256, None] - index[None]) <= theiler] = np.inf
                        bound = np.minimum(bound, np.partition(d, k - 1, axis=1)[:, k - 1])
                    of, to = np.nonzero((near <= bound[:, None]).T)
                    for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1):
                        goes.setdefault(int(of[part[0]]), []).append((a + to[part], bound[to[part]]))
                for c, asks in goes.items():
                    at, bound = (np.concatenate(z) for z in zip(*asks, strict=True))
                    rows.append(r)
                    for name_of, v in zip(kinds, (int(name[c]), len(at), index[at].tobytes(), np.ascontiguousarray(x[at]).tobytes(), bound.tobytes()), strict=True):
                        out[name_of].append(v)
            yield _table(out, batch.column(0), rows, kinds)

    return queries.select("g", "i", "x").join(plan, "g").mapInArrow(run, f"g {kind_of(held, 'g')}, cell long, m long, i binary, x binary, r binary")


def _met(held: DataFrame, asked: DataFrame, k: int, theiler: int, p: float) -> DataFrame:
    """(g, i, far, j): of each query and cell it went to the k nearest admissible distances there, and whose they are, as bytes."""
    both = asked.join(held.select("g", "cell", F.col("i").alias("j"), F.col("x").alias("y")), ["g", "cell"])
    kinds = {"i": pa.int64(), "far": pa.binary(), "j": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            for r in range(len(batch)):
                out, rows = {c: [] for c in kinds}, []
                i, j = (np.frombuffer(col(c)[r].as_py(), np.int64) for c in ("i", "j"))
                x, y = (np.frombuffer(col(c)[r].as_py()).reshape(n, -1) for c, n in (("x", len(i)), ("y", len(j))))
                bound = np.frombuffer(col("r")[r].as_py())
                for a in range(0, len(i), 1024):
                    part = slice(a, a + 1024)
                    d = distances(x[part], y, p)
                    d[(np.abs(i[part, None] - j[None]) <= theiler) | (d > bound[part, None])] = np.inf
                    n = np.minimum(np.isfinite(d).sum(axis=1), k)
                    most = int(n.max(initial=0))
                    if not most:
                        continue
                    if most < d.shape[1] // 4:  # all that are no farther than the last one wanted, so that ties go to the smaller j
                        last = np.partition(d, most - 1, axis=1)[:, most - 1]
                        wide = int((d <= last[:, None]).sum(axis=1).max()) if np.isfinite(last).any() else most
                        some = np.sort(np.argpartition(d, min(wide, d.shape[1]) - 1, axis=1)[:, :wide], axis=1)
                        order = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, axis=1), axis=1, kind="stable"), axis=1)[:, :most]
                    else:
                        order = np.argsort(d, axis=1, kind="stable")[:, :most]
                    far = np.take_along_axis(d, order, axis=1)
                    for q in np.flatnonzero(n):
                        rows.append(r)
                        for c, v in zip(kinds, (int(i[a + q]), far[q, : n[q]].tobytes(), j[order[q, : n[q]]].tobytes()), strict=True):
                            out[c].append(v)
                yield _table(out, batch.column(0), rows, kinds)

    return both.mapInArrow(run, f"g {kind_of(held, 'g')}, i long, far binary, j binary")


def neighbours(points: DataFrame, ks: Sequence[int] = (1,), theiler: int = 0, p: float = 2.0, queries: DataFrame | None = None) -> DataFrame:
    """(g, i, k, j, distance): the k-th nearest point more than `theiler` steps away, for each k of ks, ties to the smaller j. queries: points (g, i, x) that ask, by default all;
    an index outside the series (with theiler = 0: one below -1) is a point of none. Where fewer are admissible there is no row."""
    wanted = np.array(sorted({int(k) for k in ks}), np.int64)
    if not len(wanted) or wanted[0] < 1 or theiler < 0:
        raise ValueError("ks must be positive, theiler at least 0")
    top = int(wanted[-1])
    held = cells(points)
    # outside points ask from one row for each 512 of them
    asks = held if queries is None else queries.groupBy("g", F.floor(F.col("i") / 512).alias("part")).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("q"))
    asks = asks if queries is None else _as_bytes(asks, kind_of(points, "g"))
    met = _met(held, _asked(held, top, theiler, p, asks, queries is None), top, theiler, p)
    merged = met.groupBy("g", "i").agg(F.collect_list(F.struct("far", "j")).alias("parts"))
    kinds = {"i": pa.int64(), "k": pa.int64(), "j": pa.int64(), "distance": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, rows = {c: [] for c in kinds}, []
            for r, (i, parts) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                far = np.concatenate([np.frombuffer(z["far"]) for z in parts])
                j = np.concatenate([np.frombuffer(z["j"], np.int64) for z in parts])
                order = np.lexsort((j, far))
                have = wanted[wanted <= len(far)]
                at = order[have - 1]
                rows += [r] * len(have)
                for c, v in zip(kinds, ([i] * len(have), have.tolist(), j[at].tolist(), far[at].tolist()), strict=True):
                    out[c] += v
            yield _table(out, batch.column(0), rows, kinds)

    return merged.mapInArrow(run, f"g {kind_of(points, 'g')}, i long, k long, j long, distance double")


def _as_bytes(asks: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("q")).to_pylist()
            i = [np.array([z["i"] for z in r], np.int64).tobytes() for r in rows]
            x = [np.array([z["x"] for z in r], float).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(i, pa.binary()), pa.array(x, pa.binary())], names=["g", "i", "x"])

    return asks.mapInArrow(run, f"g {kind}, i binary, x binary")


def _digamma(k: int) -> float:
    return sum(1 / m for m in range(1, k)) - 0.5772156649015329


def fixed_mass_curve(points: DataFrame, ks: Sequence[int], theiler: int = 0, p: float = 2.0, n_ref: int | None = REFERENCES) -> DataFrame:
    """(g, k, x, y, points): x the mean log distance of the k-th neighbour (0 left out), y the digamma function of k. n_ref: about so many reference points of each series, by hash; None: all."""
    refs = None
    if n_ref is not None:
        sizes = points.groupBy("g").agg(F.count("*").alias("size"))
        refs = points.join(sizes, "g").where(F.xxhash64("g", "i", F.lit(7)).cast("double") / 2.0**64 + 0.5 < F.lit(float(n_ref)) / F.col("size")).select("g", "i", "x")
    found = neighbours(points, ks, theiler, p, refs).where("distance > 0")
    told = F.element_at(F.create_map(*[F.lit(z) for k in sorted({*ks}) for z in (int(k), _digamma(int(k)))]), F.col("k").cast("int"))
    return found.groupBy("g", "k").agg(F.avg(F.ln("distance")).alias("x"), F.count("*").alias("points")).select("g", "k", "x", told.alias("y"), "points")


def default_masses(size: int, n_ks: int = 16, min_window: int = 5) -> list[int]:
    """Masses in about equal ratios from 1 to a tenth of `size`."""
    top = max(size // 10, min_window + 1)
    return sorted({min(size - 1, round(top ** (k / (n_ks - 1)))) for k in range(n_ks)} - {0})


def fixed_mass_dimension(points: DataFrame, ks: Sequence[int], min_window: int = 5, tol: float = 1.5, **options) -> DataFrame:
    """(g, slope, intercept, stderr, n, low, high): the scaling region of fixed_mass_curve(); the slope is the dimension."""
    return scaling_region(fixed_mass_curve(points, ks, **options).select("g", "x", "y"), min_window, tol)
