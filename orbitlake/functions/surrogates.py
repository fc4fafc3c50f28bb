"""Surrogate series, tests against them, and zero-phase filters.

A series is one row, whose surrogates are made together with those of other series of its length. Random numbers come from seeds made of the
seed, the series and the surrogate's number, so results do not depend on partitioning.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import GIVEN
from .series import ahead


def _ranks(x: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, np.int64)
    np.put_along_axis(out, np.argsort(x, axis=1, kind="stable"), np.arange(x.shape[1])[None], axis=1)
    return out


def _phases(x: np.ndarray, rngs: list[np.random.Generator]) -> np.ndarray:
    """The same magnitudes with drawn phases; the mean and, for even lengths, the last frequency stay real."""
    turned = np.fft.rfft(x)
    angle = np.stack([rng.uniform(0, 2 * np.pi, turned.shape[1]) for rng in rngs])
    angle[:, 0] = 0
    if x.shape[1] % 2 == 0:
        angle[:, -1] = 0
    return np.fft.irfft(turned * np.exp(1j * angle), n=x.shape[1])


def _surrogate(x: np.ndarray, method: str, rngs: list[np.random.Generator], most: int) -> np.ndarray:
    """A surrogate of each row; rows are series of one length, and each comes out as it would alone."""
    if method == "fourier":
        return _phases(x, rngs)
    order = np.sort(x, axis=1)
    if method == "aaft":
        normal = np.sort(np.stack([rng.standard_normal(x.shape[1]) for rng in rngs]), axis=1)
        return np.take_along_axis(order, _ranks(_phases(np.take_along_axis(normal, _ranks(x), axis=1), rngs)), axis=1)
    size, out = np.abs(np.fft.rfft(x)), np.stack([rng.permutation(v) for rng, v in zip(rngs, x, strict=True)])
    going, before = np.arange(len(x)), None  # the rows that still change
    for _ in range(most):
        place = _ranks(np.fft.irfft(size[going] * np.exp(1j * np.angle(np.fft.rfft(out[going]))), n=x.shape[1]))
        out[going] = np.take_along_axis(order[going], place, axis=1)
        if before is not None:
            moved = (place != before).any(axis=1)
            going, place = going[moved], place[moved]
            if not len(going):
                break
        before = place
    return out


def surrogates(s: DataFrame, method: str = "iaaft", n: int = 1, seed: int = 0, max_iter: int = 1000) -> DataFrame:
    """(g, k, i, v) for k from 1 to n: `shuffle`, `fourier` (random phases), `aaft` or `iaaft` (same values, about the same spectrum)."""
    if method not in ("shuffle", "fourier", "aaft", "iaaft"):
        raise ValueError(f"unknown method {method!r}")
    if method == "shuffle":
        rows = s.select("g", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k"), "i", "v")
        w = Window.partitionBy("g", "k").orderBy(F.xxhash64(F.lit(seed), "g", "k", "i"), "i")
        return rows.select("g", "k", (F.row_number().over(w) - 1).cast("long").alias("i"), "v")

    def made(g: pa.Array, rows: list[int], index: np.ndarray, x: np.ndarray, k: int) -> pa.RecordBatch:
        """The k-th surrogates of some rows of a batch, series of one length."""
        rngs = [np.random.default_rng([seed, k, zlib.crc32(str(g[r].as_py()).encode())]) for r in rows]
        y = _surrogate(x, method, rngs, max_iter)
        of = g.take(pa.array(np.repeat(rows, x.shape[1])))
        return pa.RecordBatch.from_arrays([of, pa.array(np.full(y.size, k, np.int32)), pa.array(index.ravel()), pa.array(y.ravel())], names=["g", "k", "i", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, held = batch.column(0), batch.column(1)
            ends, every = held.offsets.to_numpy(), held.values
            index, values = every.field("i").to_numpy(), every.field("v").to_numpy()
            size = np.diff(ends)
            for length in np.unique(size[size > 0]):
                rows = np.flatnonzero(size == length)
                many = max(1, GIVEN // int(length))
                for start in range(0, len(rows), many):
                    part = rows[start : start + many]
                    at = ends[part][:, None] + np.arange(length)
                    for k in range(1, n + 1):
                        yield made(g, part.tolist(), index[at], values[at], k)

    whole = s.select("g", "i", F.col("v").cast("double").alias("v")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("held"))
    return whole.mapInArrow(run, f"g {s.schema['g'].dataType.simpleString()}, k int, i long, v double")


def time_reversal(s: DataFrame, delay: int = 1) -> DataFrame:
    """(g, value): the mean cube of differences over the mean square to the power 1.5; null without change."""
    d = F.col(f"a{delay}") - F.col("v")
    sums = ahead(s, [delay]).groupBy("g").agg(F.avg(F.pow(d, F.lit(3))).alias("c"), F.avg(d * d).alias("q"))
    return sums.select("g", F.when(F.col("q") > 0, F.col("c") / F.pow("q", F.lit(1.5))).alias("value"))


def surrogate_test(s: DataFrame, statistic: Callable[[DataFrame], DataFrame] = time_reversal, method: str = "iaaft", n: int = 39, tail: str = "auto", alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(g, statistic, z_score, p_value, rejected, n): a statistic of the series against its surrogates'.

    statistic: any function from series (g, i, v) to rows (g, value), run once over all series and surrogates together. tail: two, greater or less, or auto: what the
    statistic names as its `tail` (a prediction error: less), else two.
    """
    if tail == "auto":
        tail = getattr(statistic, "tail", "two")
    if tail not in ("two", "greater", "less"):
        raise ValueError(f"unknown tail {tail!r}")
    both = s.select("g", F.lit(0).alias("k"), "i", "v").unionByName(surrogates(s, method, n, seed))
    values = statistic(both.select(F.struct("g", "k").alias("g"), "i", "v")).select("g.g", "g.k", "value").where("value is not null")
    own = values.where("k = 0").select("g", F.col("value").alias("statistic"))
    t = values.where("k > 0").join(own, "g").groupBy("g", "statistic").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.sum((F.col("value") >= F.col("statistic")).cast("int")).alias("above"), F.sum((F.col("value") <= F.col("statistic")).cast("int")).alias("below")
    )
    share = lambda c: (1 + F.col(c)) / (F.col("n") + 1)
    p = {"greater": share("above"), "less": share("below"), "two": F.least(F.lit(1.0), 2 * F.least(share("above"), share("below")))}[tail]
    z = F.when((F.col("n") > 1) & (F.col("std") > 0), (F.col("statistic") - F.col("mean")) / F.col("std")).otherwise(0.0)
    return t.select("g", "statistic", z.alias("z_score"), p.alias("p_value"), (p <= alpha).alias("rejected"), "n")
