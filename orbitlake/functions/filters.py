"""Butterworth filters run forward and backward over series (g, i, v), as cascades of second-order sections.

Sections keep poles close to the unit circle apart, so narrow and low bands stay stable at orders where one
polynomial would not. A section runs over rows of CHUNK samples: their response from rest is one matrix product for all rows, and
only two numbers of state are carried from row to row. A recursion over one series is one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

CHUNK = 128
KINDS = ("low", "high", "band", "stop")


def sections(order: int, cutoff: list[float], kind: str, fs: float) -> np.ndarray:
    """Rows (b0, b1, b2, 1, a1, a2) of a digital Butterworth filter, by the bilinear transform of the analog one."""
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    w = 2 * fs * np.tan(np.pi * np.asarray(cutoff) / fs)
    if kind in ("low", "high"):
        p, z, gain = (poles * w[0], np.zeros(0), w[0] ** order) if kind == "low" else (w[0] / poles, np.zeros(order), 1.0)
    else:
        middle, width = np.sqrt(w[0] * w[1]), w[1] - w[0]
        half = poles * width / 2 if kind == "band" else width / 2 / poles
        root = np.sqrt(half**2 - middle**2 + 0j)
        p = np.concatenate([half + root, half - root])
        z, gain = (np.zeros(order), width**order) if kind == "band" else (np.repeat([1j * middle, -1j * middle], order), 1.0)
    move = lambda x: (2 * fs + x) / (2 * fs - x)
    gain = np.real(gain * np.prod((2 * fs - z) / (2 * fs - p[: len(z)])) / np.prod(2 * fs - p[len(z) :]))
    p, z = move(p), np.concatenate([move(z), -np.ones(len(p) - len(z))])
    turning, real = p[p.imag > 1e-12], np.sort(p[np.abs(p.imag) <= 1e-12].real)
    pairs = [(q, q.conj()) for q in sorted(turning, key=lambda q: abs(1 - abs(q)), reverse=True)] + [tuple(real[k : k + 2]) for k in range(0, len(real), 2)]
    pairs.sort(key=len)
    up, down = z[z.imag > 1e-12], np.sort(z[np.abs(z.imag) <= 1e-12].real)
    if len(up):
        zeros = [(q, q.conj()) for q in up]
    elif kind == "band":  # one zero at each end of the spectrum
        zeros = list(zip(down[: len(down) // 2], down[len(down) // 2 :], strict=True))
    else:
        zeros = [(down[0],) * len(q) for q in pairs]
    out = []
    for q, r in zip(pairs, zeros, strict=True):
        b, a = np.real(np.poly(r)), np.real(np.poly(q))
        out.append([*b, *[0.0] * (3 - len(b)), *a, *[0.0] * (3 - len(a))])
    sos = np.array(out)
    sos[0, :3] *= gain
    return sos


def _run(section: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """One section over a series, from a state."""
    b0, b1, b2, _, a1, a2 = section
    step, push = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    seen, pushed = np.zeros((CHUNK + 1, 2)), np.zeros((CHUNK, 2))  # what a state, and an input some samples ago, do
    seen[0], power = (1.0, 0.0), push
    for k in range(CHUNK):
        seen[k + 1] = seen[k] @ step
        pushed[k] = power
        power = step @ power
    reply = np.concatenate([[b0], pushed[:-1, 0]])
    lag = np.arange(CHUNK)[:, None] - np.arange(CHUNK)[None]
    matrix = np.where(lag >= 0, reply[np.maximum(lag, 0)], 0.0)
    rows = np.concatenate([x, np.zeros(-len(x) % CHUNK)]).reshape(-1, CHUNK)
    y, ends = rows @ matrix.T, rows @ pushed[::-1]
    over = np.linalg.matrix_power(step, CHUNK)
    states = np.empty((len(rows), 2))
    for r, end in enumerate(ends):
        states[r] = state
        state = over @ state + end
    return (y + states @ seen[:CHUNK].T).ravel()[: len(x)]


def both_ways(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward over a series whose ends are mirrored about their points, from the steady state of the first sample."""
    short = min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum())
    pad = min(3 * (2 * len(sos) + 1 - int(short)), len(x) - 1)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        level = y[0]
        for s in sos:
            b, a = s[:3], s[3:]
            steady = np.linalg.solve(np.array([[1 + a[1], -1.0], [a[2], 1.0]]), np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]]))
            y = _run(s, y, steady * level)
            level = level * b.sum() / a.sum()
        y = y[::-1]
    return y[pad : pad + len(x)]


def butter_filter(s: DataFrame, cutoff: float | tuple[float, float], kind: str, fs: float = 1.0, order: int = 4) -> DataFrame:
    """(g, i, v) through a Butterworth filter run both ways, so without shift: kind `low`, `high`, `band` (pass) or `stop`; cutoffs between 0 and fs / 2. Series of one sample stay as they are."""
    edges = [float(c) for c in (cutoff if isinstance(cutoff, tuple) else (cutoff,))]
    if kind not in KINDS or len(edges) != (1 if kind in ("low", "high") else 2) or sorted({*edges}) != edges or not all(0 < c < fs / 2 for c in edges):
        raise ValueError("cutoffs must rise between 0 and fs / 2: one for low and high, two for band and stop")
    if order < 1:
        raise ValueError("order must be at least 1")
    sos = sections(order, edges, kind, fs)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        x = pdf["v"].to_numpy(float)
        return pdf.assign(v=both_ways(sos, x) if len(x) > 1 else x)[["g", "i", "v"]]

    return s.select("g", "i", "v").groupBy("g").applyInPandas(run, f"g {s.schema['g'].dataType.simpleString()}, i long, v double")


def low_pass(s: DataFrame, cutoff: float, fs: float = 1.0, order: int = 4) -> DataFrame:
    return butter_filter(s, cutoff, "low", fs, order)


def high_pass(s: DataFrame, cutoff: float, fs: float = 1.0, order: int = 4) -> DataFrame:
    return butter_filter(s, cutoff, "high", fs, order)


def band_pass(s: DataFrame, low: float, high: float, fs: float = 1.0, order: int = 4) -> DataFrame:
    return butter_filter(s, (low, high), "band", fs, order)


def band_stop(s: DataFrame, low: float, high: float, fs: float = 1.0, order: int = 4) -> DataFrame:
    return butter_filter(s, (low, high), "stop", fs, order)
