"""Hierarchical language identification.

Texts become hashed byte-trigram frequencies (whole texts, lower-cased, ASCII characters
that are not letters as one blank). A linear support vector machine for each language
family, one against the rest, picks the family; inside it one-versus-one machines vote.
They learn from a bounded sample (parameters of `fit`): at most `per_lang` labelled rows a
language, and `sample_rows` in all, those with the smallest hashes of their ids. The sample
has rows of the `most_langs` most frequent labels, ties by name; others, rare or misspelt,
have none there, are not learned and never predicted. Only this sample's features reach
the driver; predictions are made in the tasks, on ROWS texts at a time.

Null texts and texts without any letter give `und` with score 0, as does a training set
without rows. Other columns are never read for a prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

DIM = 4096
#: Texts whose features (4 x DIM bytes each) are held at once.
ROWS = 512
# ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa si ur",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "semitic": "am ar he mt",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "dravidian": "kn ml ta te",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_TABLE = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint32)


def features(texts: pa.Array) -> np.ndarray:
    """Rows of unit length: square roots of hashed trigram counts."""
    lower = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.binary())
    sizes = np.asarray(pc.binary_length(lower).to_numpy(zero_copy_only=False), np.int64)
    raw = _TABLE[np.frombuffer(b"".join(lower.to_pylist()), np.uint8)]
    out = np.zeros((len(texts), DIM), np.float32)
    if len(raw) >= 3:
        gram = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
        slot = (gram * np.uint32(2654435761)) >> np.uint32(20)
        of = np.repeat(np.arange(len(sizes)), sizes)
        inside = (of[:-2] == of[2:]) & ~((raw[:-2] == 32) & (raw[1:-1] == 32))
        out = np.sqrt(np.bincount(of[:-2][inside] * DIM + slot[inside], minlength=len(texts) * DIM).reshape(len(texts), DIM)).astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """A linear machine (squared hinge, accelerated gradient) for labels of -1 and 1, classes weighted alike."""
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * c
    w = v = np.zeros(x1.shape[1], np.float32)
    rate = 1 / (1e-2 + 4 * c)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        new = v - rate * (1e-2 * v - 2 * x1.T @ (share * y * slack))
        v = new + t / (t + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


class Hierarchy:
    """The machines of both levels, as small arrays that go to the tasks."""

    def __init__(self, langs: list[str], x: np.ndarray):
        y = np.array(langs)
        self.langs = sorted(set(langs))
        family = np.array([FAMILY.get(z, "other") for z in y]) if len(y) else y
        self.families = sorted(set(family.tolist()))
        self.inside = {f: [z for z in self.langs if FAMILY.get(z, "other") == f] for f in self.families}
        machines = [svm(x, np.where(family == f, 1, -1).astype(np.float32)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = []
        for f in self.families:
            for i, a in enumerate(self.inside[f]):
                for b in self.inside[f][i + 1 :]:
                    use = (y == a) | (y == b)
                    machines.append(svm(x[use], np.where(y[use] == a, 1, -1).astype(np.float32)))
                    self.pairs.append((f, a, b))
        self.w = np.array([m[0] for m in machines], np.float32).reshape(-1, DIM).T.copy()
        self.b = np.array([m[1] for m in machines], np.float32)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(x), np.zeros(len(x))
        margin = x @ self.w + self.b
        n = len(self.families) if len(self.families) > 1 else 0
        first = margin[:, :n].argmax(axis=1) if n else np.zeros(len(x), np.int64)
        sure = 1 / (1 + np.exp(-3.0 * margin[np.arange(len(x)), first])) if n else np.ones(len(x))
        said = [""] * len(x)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(first == k)
            own = self.inside[f]
            votes = np.zeros((len(rows), len(own)))
            soft = np.ones((len(rows), len(own)))
            for j, (g, a, b) in enumerate(self.pairs):
                if g == f:
                    m = margin[rows, n + j]
                    p = 1 / (1 + np.exp(-3.0 * m))
                    for z, q in ((a, p), (b, 1 - p)):
                        votes[:, own.index(z)] += (q > 0.5) + q * 1e-3
                        soft[:, own.index(z)] = np.minimum(soft[:, own.index(z)], q)
            best = votes.argmax(axis=1)
            for r, z in zip(rows, best, strict=True):
                said[r] = own[z]
            sure[rows] = np.minimum(sure[rows], soft[np.arange(len(rows)), best])
        return said, np.clip(sure, 0, 1)


def _featured(batches):
    for batch in batches:
        for part in slices(batch, 1, rows=ROWS):
            x = features(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], names=["lang", "x"])


def fit(labelled: DataFrame, per_lang: int = 300, sample_rows: int = 1200, most_langs: int = 300, key: Column | None = None) -> Hierarchy:
    """Fits on a bounded sample of rows with text and non-null lang; `key` (default: all their columns) orders the sample."""
    rows = labelled.where("text is not null and lang is not null").select("lang", "text", F.xxhash64(*([key] if key is not None else ["lang", "text"])).alias("h"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    if not counts:
        return Hierarchy([], np.zeros((0, DIM), np.float32))
    most = max(2, min(per_lang, sample_rows // len(counts)))
    below = F.lit(None).cast("double")
    for lang, n in counts.items():
        below = F.when(F.col("lang") == lang, F.lit(min(1.0, (1.5 * most + 20) / n))).otherwise(below)
    drawn = rows.where((F.col("h").cast("double") / 2.0**64 + 0.5) < below)
    drawn = drawn.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= most)
    got = drawn.select("lang", "text").mapInArrow(_featured, "lang string, x binary").collect()
    got.sort(key=lambda r: (r[0], bytes(r[1])))
    x = np.zeros((len(got), DIM), np.float32)
    for i, r in enumerate(got):
        x[i] = np.frombuffer(r[1], np.float16)
    return Hierarchy([r[0] for r in got], x)


def _predicted(model, field: int | None):
    def run(batches):
        for batch in batches:
            text = batch.column(1) if field is None else batch.column(0).field(field)
            at = 0
            for part in slices(batch, text, rows=ROWS):
                texts = text.slice(at, part.num_rows)
                at += part.num_rows
                said, sure = model.value.predict(features(texts))
                letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([s if ok else "und" for s, ok in zip(said, letter, strict=True)], pa.string()), pa.array(np.where(letter & (np.array(said) != "und"), sure, 0.0), pa.float64())],
                    names=["row", "lang_pred", "score"],
                )

    return run


def identify(docs: DataFrame, model: Hierarchy, keep: list[str], text_col: str = "text") -> DataFrame:
    """Rows of the `keep` columns with lang_pred and score appended; every row of docs, whole texts."""
    row = F.struct(*keep).alias("row")
    # a text that is kept anyway is sent once
    field = keep.index(text_col) if text_col in keep and docs.schema[text_col].dataType.simpleString() == "string" else None
    sent = docs.select(row) if field is not None else docs.select(row, F.col(text_col).cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = sent.mapInArrow(_predicted(held, field), f"row {sent.schema['row'].dataType.simpleString()}, lang_pred string, score double")
    return out.select("row.*", "lang_pred", "score")
