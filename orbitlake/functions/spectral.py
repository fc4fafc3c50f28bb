"""Spectra of series (g, i, v): segments through windows and fast Fourier transforms, their means and features.

A series is packed into blocks that also hold the samples of the segments that begin in them, so a long series is many
tasks and one shuffle; all segments of a block are transformed at once, and only their sums leave it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import each_block, packed

#: Samples that one block of segments holds, besides those that reach into the next one.
SPAN = 1 << 15
#: Samples of a segment, if the series has as many.
SEGMENT = 256
WINDOWS = ("hann", "hamming", "blackman", "boxcar")


def taper(name: str, n: int) -> np.ndarray:
    """A window of n samples that goes on periodically."""
    if name not in WINDOWS:
        raise ValueError(f"unknown window {name!r}; known are {', '.join(WINDOWS)}")
    if n == 1:
        return np.ones(1)
    t = 2 * np.pi * np.arange(n) / n
    # The windows' cosine terms.
    terms = {"hann": (0.5, -0.5), "hamming": (0.54, -0.46), "blackman": (0.42, -0.5, 0.08), "boxcar": (1.0,)}[name]
    return sum(c * np.cos(k * t) for k, c in enumerate(terms)) + np.zeros(n)


def sampling_rate(s: DataFrame, time: str = "t", tolerance: float = 1e-3) -> DataFrame:
    """(g, fs) from the times (numbers, or time stamps in seconds) of rows (g, i, time): samples a unit of time; null for one sample or where steps differ by more than `tolerance` of their mean."""
    kind = s.schema[time].dataType.typeName()
    at = F.unix_micros(time) / 1e6 if kind in ("timestamp", "timestamp_ntz") else F.col(time).cast("double")
    step = F.lead("at").over(Window.partitionBy("g").orderBy("i")) - F.col("at")
    steps = s.select("g", "i", at.alias("at")).withColumn("step", step).groupBy("g").agg(F.avg("step").alias("mean"), F.min("step").alias("low"), F.max("step").alias("high"))
    even = (F.col("mean") > 0) & (F.col("high") - F.col("low") <= tolerance * F.col("mean"))
    return steps.select("g", F.when(even, 1 / F.col("mean")).alias("fs"))


def _with_rate(s: DataFrame, fs: float | DataFrame) -> DataFrame:
    n = s.groupBy("g").agg(F.count("*").alias("size"))
    if isinstance(fs, DataFrame):
        return n.join(fs.select("g", "fs"), "g").where("fs > 0")
    if not (fs > 0 and math.isfinite(fs)):
        raise ValueError("fs must be positive and finite")
    return n.withColumn("fs", F.lit(float(fs)))


def _segments(s: DataFrame, fs: float | DataFrame, window: str, nperseg: int | None, overlap: float | int | None, share: int, detrend: str | bool, scaling: str, whole: bool, sums: bool) -> DataFrame:
    """One-sided power of each segment (or their sums by block): (g, segment, start, nper, fs, k, power, n)."""
    if scaling not in ("density", "spectrum"):
        raise ValueError(f"unknown scaling {scaling!r}")
    if detrend not in ("constant", "linear", False):
        raise ValueError(f"unknown detrend {detrend!r}")
    taper(window, 4)
    most = nperseg or SEGMENT
    if most < 1 or (overlap is not None and not 0 <= overlap < most):
        raise ValueError("nperseg must be positive, and noverlap from 0 to less than that")

    def see(i, x, own):
        n = own["size"]
        nper = n if whole else min(most, n)
        step = max(1, nper - (min(int(overlap), nper - 1) if overlap is not None else nper // share))
        first = -(-int(i[0]) // step) * step
        end = n if whole else min((own["block"] + 1) * SPAN, n - nper + 1)
        starts = np.arange(first, end, step)
        starts = starts[starts + nper <= n]
        if not len(starts):
            return {c: np.zeros(0, kind) for c, kind in (("segment", np.int64), ("start", np.int64), ("nper", np.int64), ("fs", float), ("k", np.int64), ("power", float), ("n", np.int64))}
        w = taper(window, nper)
        scale = 1 / (own["fs"] * (w * w).sum()) if scaling == "density" else 1 / w.sum() ** 2
        fold = np.full(nper // 2 + 1, 2.0)
        fold[0] = 1.0
        if nper % 2 == 0:
            fold[-1] = 1.0
        power, at = [], np.arange(nper) - (nper - 1) / 2
        for a in range(0, len(starts), max(1, (1 << 18) // nper)):
            some = starts[a : a + max(1, (1 << 18) // nper)]
            z = np.lib.stride_tricks.sliding_window_view(x, nper)[some - int(i[0])]
            if detrend:
                z = z - z.mean(axis=1, keepdims=True)
            if detrend == "linear" and nper > 1:
                z = z - (z @ at)[:, None] / (at @ at) * at
            p = np.abs(np.fft.rfft(z * w, axis=1)) ** 2 * scale * fold
            power.append(p.sum(axis=0, keepdims=True) if sums else p)
        p = np.concatenate(power)
        rows, n_of = (1, len(starts)) if sums else (len(starts), 1)
        p = p.sum(axis=0, keepdims=True) if sums else p
        of = np.repeat(starts[:rows], p.shape[1])
        full = np.ones(len(of), np.int64)
        return {"segment": of // step, "start": of, "nper": full * nper, "fs": full * float(own["fs"]), "k": np.tile(np.arange(p.shape[1]), rows), "power": p.ravel(), "n": full * n_of}

    size = 1 << 62 if whole else SPAN
    table = packed(s, "v", 0 if whole else most - 1, _with_rate(s, fs), block=size)
    return each_block(table, "segment long, start long, nper long, fs double, k long, power double, n long", see, block=size)


def power_spectral_density(s: DataFrame, fs: float | DataFrame = 1.0, method: str = "welch", window: str = "hann", nperseg: int | None = None, noverlap: int | None = None, detrend: str | bool = "constant", scaling: str = "density") -> DataFrame:
    """(g, k, frequency, psd, segments): one-sided power, frequencies in the units of fs (samples a unit of time; a number, or rows (g, fs)).

    welch: the mean over segments of min(nperseg, size) samples (256 unless given), half of each shared unless noverlap is given.
    periodogram: the whole series as one segment, in one task. window: hann, hamming, blackman or boxcar; detrend: constant, linear or False;
    scaling: density (its integral is the variance) or spectrum (its sum is). All power but that at 0 and half of fs is doubled.
    """
    if method not in ("welch", "periodogram"):
        raise ValueError(f"unknown method {method!r}")
    parts = _segments(s, fs, window, nperseg, noverlap, 2, detrend, scaling, method == "periodogram", True)
    return parts.groupBy("g", "k").agg((F.max("k") * F.max("fs") / F.max("nper")).alias("frequency"), (F.sum("power") / F.sum("n")).alias("psd"), F.sum("n").alias("segments"))


def spectrogram(s: DataFrame, fs: float | DataFrame = 1.0, window: str = "hann", nperseg: int | None = None, noverlap: int | None = None, detrend: str | bool = "constant", scaling: str = "density") -> DataFrame:
    """(g, segment, time, k, frequency, power): the power of each segment; time is that of its middle, and an eighth of it is shared unless noverlap is given."""
    parts = _segments(s, fs, window, nperseg, noverlap, 8, detrend, scaling, False, False)
    return parts.select("g", "segment", ((F.col("start") + F.col("nper") / 2) / F.col("fs")).alias("time"), "k", (F.col("k") * F.col("fs") / F.col("nper")).alias("frequency"), "power")


#: Names that spectral_features knows.
SPECTRAL = ("spectral_entropy", "spectral_centroid", "dominant_frequency")


def spectral_features(s: DataFrame, fs: float | DataFrame = 1.0, features: Sequence[str] = SPECTRAL, normalize: bool = True, base: float = 2.0, exclude_dc: bool = True, **options) -> DataFrame:
    """(g, features): entropy of the normalised spectrum (over that of an even one if `normalize`, else with logarithms to `base`), the power-weighted mean frequency, and that of most power
    (the lowest of equal ones; 0 left out if exclude_dc and there are others). Without power: 0, 0 and the lowest. options: those of power_spectral_density."""
    if unknown := set(features) - set(SPECTRAL):
        raise ValueError(f"unknown features {sorted(unknown)}")
    psd = power_spectral_density(s, fs, **options)
    own = Window.partitionBy("g")
    p = psd.withColumn("total", F.sum("psd").over(own)).withColumn("bins", F.count("*").over(own)).withColumn("share", F.when(F.col("total") > 0, F.col("psd") / F.col("total")).otherwise(0.0))
    entropy: Column = F.lit(0.0) - F.sum(F.when(F.col("share") > 0, F.col("share") * F.ln("share")).otherwise(0.0))
    unit = F.when(F.max("bins") > 1, F.ln(F.max("bins"))).otherwise(math.log(base)) if normalize else F.lit(math.log(base))
    used = F.when((F.col("k") > 0) | (F.col("bins") == 1) | F.lit(not exclude_dc), F.struct("psd", -F.col("k"), "frequency"))
    ways = {"spectral_entropy": entropy / unit, "spectral_centroid": F.sum(F.col("share") * F.col("frequency")), "dominant_frequency": F.max(used)["frequency"]}
    return p.groupBy("g").agg(*[ways[f].alias(f) for f in features])
