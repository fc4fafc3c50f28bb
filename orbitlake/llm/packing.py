"""Packing by cutting-stock column generation.

Token ids of each text (with an end id) are cut at whole sequences; what is left of each
text, shorter than a sequence, is a piece of one of `BINS` length bins. The bins' counts -
a histogram of fixed size whatever the input - give the linear program: the fewest
sequences over patterns of bins. Columns are generated: a revised simplex holds one
pattern for each bin, a knapsack by dynamic programming prices new ones with the duals. The
patterns are rounded down and what remains goes first-fit by decreasing length, in counts.

Pieces are ranked within their bin, tasks counting in parallel from offsets that a window
over (task, bin) counts gives; a piece's rank says its pattern copy and so its sequence.
Nothing but the histogram reaches the driver. Null texts count as empty; each text has the
end id at least, so each row gives one piece or more. A null id is kept as it is.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, slices

LENGTH = 4096
UNIT = 16
#: Words whose ids a worker keeps; beyond that it forgets them all and begins anew, with the same result.
CACHE_WORDS = 250_000
#: Bytes of text that a worker codes at once.
CODE_BYTES = 1 << 20


class WordTokenizer:
    """Token ids of texts by one encoding of each distinct word, kept for later batches up to `CACHE_WORDS` words.

    For tokenizers that drop white space, part words as PARTS says and mark the last token
    of each part with `</w>`: words are encoded many at a time and the marks tell them apart.
    """

    # How the tokenizer parts normalised text.
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.cache: dict[str, int] = {}
        self.pool, self.start, self.size = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _parts(self, word: str) -> int:
        if word.isalpha() and word.isascii():
            return 1
        word = unicodedata.normalize("NFC", word).lower()
        return 1 if word.isalpha() else len(self.PARTS.findall(word))

    def _alone(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint16) for w in words]

    def _new(self, words: list[str]) -> None:
        found, sizes = [], []
        parts = np.fromiter((0 if "<|" in w else self._parts(w) for w in words), np.int64, len(words))
        for i in range(0, len(words), 8000):
            cuts = [(j, min(j + 500, len(words))) for j in range(i, min(i + 8000, len(words)), 500)]
            for (a, b), e in zip(cuts, self.tokenizer.encode_batch_fast([" ".join(words[a:b]) for a, b in cuts], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint16)
                ends = np.flatnonzero(self.last[ids])
                if parts[a:b].all() and parts[a:b].sum() == len(ends):
                    sizes.append(np.diff(ends[np.cumsum(parts[a:b]) - 1], prepend=-1))
                else:  # some word parts otherwise, or holds a special token's name
                    alone = self._alone(words[a:b])
                    ids, at = np.concatenate(alone), np.fromiter(map(len, alone), np.int64, b - a)
                    sizes.append(at)
                found.append(ids)
        first = len(self.cache)
        self.cache.update(zip(words, range(first, first + len(words)), strict=True))
        self.pool = np.concatenate([self.pool, *found])
        self.size = np.concatenate([self.size, *sizes])
        self.start = np.cumsum(self.size) - self.size

    def __call__(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        # lower-casing first shares work; a special token's name must keep its case
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)
        # a word and the marks after it are parted anyway: apart, they are fewer different words
        texts = pc.replace_substring_regex(texts, r"(\pL)([.,!?:;*&$%#]+)([ \n]|$)", r"\1 \2\3")
        lists = pc.ascii_split_whitespace(texts)
        flat, of = lists.flatten(), pc.list_parent_indices(lists)
        full = pc.not_equal(flat, "")
        flat, of = flat.filter(full), of.filter(full).to_numpy(zero_copy_only=False)
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self._clear()
            new = words
        if new:
            self._new(new)
        known = np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))
        codes = known[coded.indices.to_numpy(zero_copy_only=False)] if words else np.zeros(0, np.int64)
        n = self.size[codes]
        ends = np.cumsum(n)
        every = self.pool[np.repeat(self.start[codes] - (ends - n), n) + np.arange(int(n.sum()))]
        per = np.bincount(of, weights=n, minlength=len(texts)).astype(np.int64)
        stop = np.cumsum(per)
        return [np.append(every[b - a : b], np.uint16(end)) for a, b in zip(per, stop, strict=True)]


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a worker, so that many small tasks don't load it again and again."""
    return WordTokenizer(path)


def _cut(path: str, end: int, length: int):
    def run(batches):
        tokenizer = _tokenizer(path)
        for batch in batches:
            for part in slices(batch, 1, CODE_BYTES):
                cols = {c: [] for c in ("row", "start", "length", "ids_crc32", "doc_tokens")}
                for i, ids in enumerate(tokenizer(part.column(1), end)):
                    for a in range(0, len(ids), length):
                        piece = ids[a : a + length]
                        for c, v in zip(cols, (i, a, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), len(ids)), strict=True):
                            cols[c].append(v)
                own = part.column(0).take(pa.array(cols.pop("row"), pa.int64()))
                yield pa.RecordBatch.from_arrays([own, *(pa.array(v, pa.int64()) for v in cols.values())], names=["doc_id", *cols])

    return run


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best pattern of items of sizes 1, 2, ... (any number of each): its value and its counts."""
    n = len(values)
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        k = min(c, n)
        options = values[:k] + best[c - 1 :: -1][:k]
        i = int(options.argmax())
        if options[i] > best[c - 1]:
            best[c], took[c] = options[i], i + 1
        else:
            best[c], took[c] = best[c - 1], 0
    counts, c = np.zeros(n, np.int64), capacity
    while c > 0:
        if took[c]:
            counts[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[capacity]), counts


def cutting_stock(demand: np.ndarray, capacity: int, most: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Patterns (counts of sizes 1, 2, ...) with whole copies that cover the demand exactly.

    Column generation to optimality (or `most` columns), rounded down; the rest first-fit by decreasing size.
    """
    n = len(demand)
    used = np.flatnonzero(demand > 0)
    left = demand.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []
    if len(used):
        need = demand[used].astype(float)
        basis = np.diag(np.maximum(1, capacity // (used + 1)).astype(float))
        inverse = np.diag(1 / np.diag(basis))
        # einsum, not BLAS: its threads cost more than these small products
        apply = lambda m, v: np.einsum("ij,j->i", m, v)
        x = apply(inverse, need)
        best, idle = x.sum(), 0
        for turn in range(most):
            duals = np.zeros(n)
            duals[used] = np.maximum(inverse.sum(axis=0), 0)
            value, column = knapsack(duals, capacity)
            if value <= 1 + 1e-9 or idle > 200:
                break
            column = column[used].astype(float)
            d = apply(inverse, column)
            ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
            r = int(ratio.argmin())
            if not np.isfinite(ratio[r]):
                break
            step = ratio[r]
            x = x - step * d
            x[r] = step
            basis[:, r] = column
            row = inverse[r] / d[r]
            inverse = inverse - np.outer(d, row)
            inverse[r] = row
            if turn % 200 == 199:
                inverse = np.linalg.inv(basis)
                x = np.maximum(apply(inverse, need), 0)
            best, idle = (x.sum(), 0) if x.sum() < best - 1e-9 else (best, idle + 1)
        full = np.zeros((n, len(used)), np.int64)
        full[used] = basis.astype(np.int64)
        basis = full
        for j in np.argsort(-x, kind="stable"):
            pattern = basis[:, j]
            has = pattern > 0
            copies = int(min(np.floor(x[j] + 1e-7), (left[has] // pattern[has]).min() if has.any() else 0))
            if copies > 0:
                out.append((pattern, copies))
                left -= pattern * copies
    while left.any():  # greedy patterns of what is left, largest first, as often as they fit
        pattern, room = np.zeros(n, np.int64), capacity
        for i in np.flatnonzero(left)[::-1]:
            k = min(int(left[i]), room // (i + 1))
            pattern[i], room = k, room - k * (i + 1)
        has = pattern > 0
        copies = int((left[has] // pattern[has]).min())
        out.append((pattern, copies))
        left -= pattern * copies
    return out


def _slots(patterns: list[tuple[np.ndarray, int]], n: int) -> list[tuple[np.ndarray, ...]]:
    """For each bin: where the ranks of each pattern begin, the pattern's first sequence, and the pieces a sequence takes."""
    per = [([], [], []) for _ in range(n)]
    have, sequence = np.zeros(n, np.int64), 0
    for pattern, copies in patterns:
        for i in np.flatnonzero(pattern):
            for store, v in zip(per[i], (have[i], sequence, pattern[i]), strict=True):
                store.append(int(v))
            have[i] += pattern[i] * copies
        sequence += copies
    return [tuple(np.array(v, np.int64) for v in p) for p in per]


def _placed(slots):
    """The sequence of each piece, from its rank in its bin."""

    def run(batches):
        for batch in batches:
            bins, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (5, 6))
            sequence = np.zeros(len(bins), np.int64)
            for b in np.unique(bins):
                at = np.flatnonzero(bins == b)
                low, base, each = slots.value[int(b)]
                j = np.searchsorted(low, rank[at], side="right") - 1
                sequence[at] = base[j] + (rank[at] - low[j]) // each[j]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"])

    return run


def pack(docs: DataFrame, tokenizer: str, end: int = 2, length: int = LENGTH, unit: int = UNIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for each piece.

    `tokenizer`: path of a tokenizers file, the same on every machine.
    """
    spark = docs.sparkSession
    n = length // unit
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = source.mapInArrow(_cut(tokenizer, end, length), schema)
    pieces = save(pieces.withColumn("pid", F.spark_partition_id()).withColumn("bin", F.ceil(F.col("length") / unit).cast("long") - 1))
    counts = save(pieces.groupBy("pid", "bin").agg(F.count("*").alias("c")))
    demand = np.zeros(n, np.int64)
    for r in counts.groupBy("bin").agg(F.sum("c").alias("c")).collect():
        demand[r["bin"]] = r["c"]
    patterns = cutting_stock(demand, n)
    before = counts.withColumn("first", F.sum("c").over(Window.partitionBy("bin").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)))
    firsts = before.select("pid", "bin", F.coalesce("first", F.lit(0)).alias("first"))
    held = spark.sparkContext.broadcast(_slots(patterns, n))
    own = Window.partitionBy("pid", "bin").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1).join(firsts, ["pid", "bin"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", (F.col("first") + F.col("own")).alias("rank"))
    placed = ranked.mapInArrow(_placed(held), f"{schema}, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
