"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Pivots are a bounded sample
(`PIVOTS` distinct vectors of the `POOL` rows with the smallest hashes of their ids). The
index is dealt to blocks of about `BLOCK` rows; a block keeps an inverted file for each
pivot, with the rows that have it among their `POSTED` nearest and its place there. A query
reads the files of its `VISITED` nearest pivots only, and sums the footrule distance of the
orders from what it reads (a pivot that a row has not posted counts as place POSTED). The
nearest share `RERANK` of a block, `LEAST` times k rows at least, is ranked again by inner product;
no other row's vector is looked at. Every row is indexed; blocks of queries meet blocks of rows.

Vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, nor do null ids. Ties go to the smaller id; rows that share an id
are rows of their own, and none of them is a candidate of a query with that id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIVOTS, POOL, POSTED, VISITED, RERANK, LEAST = 1024, 4096, 64, 64, 0.25, 8
BLOCK, QUERIES = 8192, 32_768


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (vec_id, v) that take part."""
    v = F.col(vec_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)")
    dim = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (dim["d"] if dim else 0))


def pivots(rows: DataFrame) -> np.ndarray:
    """Distinct vectors of unit length from a bounded sample."""
    pool = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(POOL).collect()
    found: dict[bytes, np.ndarray] = {}
    for r in pool:
        x = np.array(r["v"])
        found.setdefault(x.tobytes(), x / np.linalg.norm(x))
        if len(found) == PIVOTS:
            break
    return np.array(list(found.values()), np.float32)


def orders(v: np.ndarray, p: np.ndarray, most: int) -> np.ndarray:
    """The `most` nearest pivots of each row, nearest first, ties by number."""
    out = np.empty((len(v), min(most, len(p))), np.int32)
    for a in range(0, len(v), 2048):
        far = -(v[a : a + 2048].astype(np.float32) @ p.T)
        out[a : a + 2048] = np.argsort(far, axis=1, kind="stable")[:, : out.shape[1]]
    return out


class Files:
    """The inverted files of a block: of each pivot the rows that posted it, and its place in their orders."""

    def __init__(self, order: np.ndarray, pivots: int):
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.n = len(order)
        self.row, self.place = by // max(1, order.shape[1]), by % max(1, order.shape[1])
        self.start = np.searchsorted(flat[by], np.arange(pivots + 1))

    def gains(self, asked: np.ndarray) -> np.ndarray:
        """How much nearer by footrule each row is than one that posted none of the asked pivots."""
        cut = [slice(self.start[p], self.start[p + 1]) for p in asked]
        at = np.repeat(np.arange(len(asked)), [s.stop - s.start for s in cut])
        row, place = (np.concatenate([x[s] for s in cut]) for x in (self.row, self.place))
        return np.bincount(row, weights=POSTED - at - np.abs(place - at), minlength=self.n)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of row pairs in double precision, summed in order, so equal vectors give equal values."""
    total = np.zeros(len(b))
    for d in range(b.shape[1]):
        total += a[..., d] * b[:, d]
    return total


def _searched(p, k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(rows) and len(queries):
            ids, v = rows["vec_id"].to_numpy(), np.array(rows["v"].tolist())
            qids, q = queries["vec_id"].to_numpy(), np.array(queries["v"].tolist())
            files, asked = Files(orders(v, p.value, POSTED), len(p.value)), orders(q, p.value, VISITED)
            want = min(len(v), max(LEAST * (k + 1), math.ceil(RERANK * len(v))))
            for i in range(len(q)):
                gain = files.gains(asked[i])
                near = np.argpartition(-gain, want - 1)[:want]
                near = near[ids[near] != qids[i]]
                s = exact(q[i], v[near])
                best = np.lexsort((ids[near], -s))[:k]
                out.append((np.full(len(best), qids[i]), ids[near[best]], s[best]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def search(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k nearest found.

    `queries`: rows like `vectors`; by default those whose id is divisible by `every`.
    """
    sc = vectors.sparkSession.sparkContext
    rows = usable(vectors, id_col, vec_col)
    asked = rows.where(F.col("vec_id") % every == 0) if queries is None else usable(queries, id_col, vec_col)
    p = sc.broadcast(pivots(rows))
    n, m = rows.count(), asked.count()
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-m // QUERIES))
    deal = lambda salt, parts: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(parts)).cast("int")
    index = rows.withColumn("block", deal(1, blocks)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    questions = asked.withColumn("part", deal(2, groups)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = index.groupBy("block", "part").cogroup(questions.groupBy("block", "part")).applyInPandas(_searched(p, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
