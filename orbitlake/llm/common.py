"""Helpers of the training-data operators: cuts of lineage, text batches, hashing, components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text, and rows, that one vectorised step inside a task works on.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 16_384


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, a temporary one on a local master, else an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="orbitlake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def save(df: DataFrame) -> DataFrame:
    """Cuts the lineage through reliable storage that survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of one run in the shared folder, as Parquet: they cut the lineage, and go when no later step reads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.names = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", []

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in {*names} & {*self.names}:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.names.remove(name)

    def keep(self, *names: str) -> None:
        self.drop(*[x for x in self.names if x not in names])


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """Spark removes the shuffle files of each query planned inside when it has ended; for steps that write their result."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def slices(batch: pa.RecordBatch, text: int | pa.Array, most: int = SLICE_BYTES, rows: int = SLICE_ROWS):
    """Parts of a batch of at most `rows` rows whose texts (a column, or given) hold about `most` bytes; a longer text stands alone."""
    texts = batch.column(text) if isinstance(text, int) else text
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, base + most, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants) over a uint64 array."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def cut_keys(keys: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of 64-bit keys."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def whole_keys(packed: bytes | memoryview, width: int) -> np.ndarray:
    wide = np.zeros((len(packed) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(packed, np.uint8).reshape(-1, width)
    return wide.view("<u8").ravel()


def word_hashes(words: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the words of a flat array, the distinct words, and a stable 64-bit hash of each of those."""
    coded = words.dictionary_encode()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, hashed


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (ASCII white space between them, A-Z lower-cased) of all texts in one array, and the count of each text; null is empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, of = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.not_equal(flat, "")
    return flat.filter(full), np.bincount(of.filter(full).to_numpy(zero_copy_only=False), minlength=len(texts)).astype(np.int64)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) edges: rows (node, component), the component being its smallest node.

    Alternates large-star and small-star steps, each a shuffle on the node with
    map-side minima; stops when the edge set no longer changes. Nodes are never
    gathered on the driver: only a count and a checksum come back per round.
    """
    undirected = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def starred(e: DataFrame) -> DataFrame:
        # large star: every larger neighbour points at the smallest neighbour
        u = undirected(e)
        least = u.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = u.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every smaller-or-equal neighbour points at the smallest one
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        return small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()

    e, mark = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    for _ in range(most_rounds):
        e = save(starred(e))
        now = tuple(e.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(a, b)), 0)")).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    low = e.groupBy("a").agg(F.min("b").alias("component"))
    return low.select(F.col("a").alias("node"), "component").unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
