"""Cross-entropy difference of documents under matched bigram models.

Target: texts whose ids are in a given set (by default, labelled of high quality);
background: all texts. Both models share one vocabulary - every word of all texts, told
apart by 64-bit hashes - the same order and the same smoothing:
p(b | a) = (c(a b) + MU p(b)) / (c(a) + MU), p(b) = (c(b) + 1) / (N + vocabulary).
Background counts are scaled to the target's number of words, so neither model is sharper
only for having seen more. Counts are of all texts.

Passes over the texts: word counts; counts of pairs of hot words (those with over 1 /
HOT_SHARE of all words, or over MOST_COLD of a bucket); and scoring. A pair's loss is
log(c(a) + MU) - log(c(a b) + MU p(b)). Terms of hot words and pairs are summed in place;
where hot words have more than (HOT_SHARE + 1)**2 different pairs, the rarer of these go to
buckets too. So no word or pair brings more than MOST_COLD of a bucket to one group.
Every other pair goes once to a bucket: by its second word if that is cold, so that the
bucket counts that word too and gives its terms, else by the pair. Words are never sent
to all tasks but for the hot ones. Buckets follow the number of words; each sends its sums
by document, packed, to groups of documents.

Null or blank texts have no words: null scores. Rows with a null id have no scores; rows
that share an id are scored as one document.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_keys, mix, save, slices, split_words, whole_keys, word_hashes

#: The vocabulary has no other bound than the hashes' number.
VOCAB = 1 << 64
HOT_SHARE = 512
MU = 200.0
PAIRS_PER_BUCKET = 5_000_000
#: Share of a bucket that one cold word or pair may fill.
MOST_COLD = 1 / 8
#: Bytes of a first word's hash that tell apart the words before one second word.
FIRST_BYTES = 6
#: Rows of hot pairs that a task holds before it sends them on.
HELD_PAIRS = 1 << 20
#: Target ids up to this number (8 bytes each) are sent to every task; more are joined.
SENT_IDS = 4_000_000
#: Stands before the first word.
START = np.uint64(0x9E3779B97F4A7C15)


def _in_target(batch, target) -> np.ndarray:
    if batch.num_columns > 2:
        return pc.fill_null(batch.column(2), False).to_numpy(zero_copy_only=False)
    ids = pc.fill_null(batch.column(0), -1).to_numpy(zero_copy_only=False)
    held = target.value
    at = np.minimum(np.searchsorted(held, ids), len(held) - 1)
    return held[at] == ids if len(held) else np.zeros(len(ids), bool)


def _counted(target):
    """Rows (word, all, in target), one for each word of a part, by hash; word null counts texts with words."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                words, per = split_words(part.column(1))
                codes, _, hashed = word_hashes(words)
                inside = _in_target(part, target)
                of = np.repeat(inside, per)
                n = len(hashed)
                nb, nt = np.bincount(codes, minlength=n), np.bincount(codes[of], minlength=n)
                word = pa.array(np.append(hashed.view(np.int64), 0), mask=np.arange(n + 1) == n)
                yield pa.RecordBatch.from_arrays([word, pa.array(np.append(nb, (per > 0).sum())), pa.array(np.append(nt, (inside & (per > 0)).sum()))], names=["word", "nb", "nt"])

    return run


class Model:
    """Totals of both sides (target, background) and the hot words: codes from 1 by hash, 0 before the first word."""

    def __init__(self, rows: list[tuple[int, int, int]], n: tuple[int, int], starts: tuple[int, int], distinct: int):
        rows = sorted((r[0] & 0xFFFFFFFFFFFFFFFF, r[1], r[2]) for r in rows)
        self.hashes = np.array([r[0] for r in rows], np.uint64)
        self.counts = np.array([[starts[0], *(r[2] for r in rows)], [starts[1], *(r[1] for r in rows)]], float)
        self.n, self.distinct = n, distinct
        self.rate = (1.0, n[0] / n[1] if n[0] and n[1] else 1.0)

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Of each hash; -1 for cold words."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, -1)

    def before(self, side: int, count: np.ndarray) -> np.ndarray:
        """The term of a first word of this count."""
        return np.log(count * self.rate[side] + MU)

    def after(self, side: int, pair: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The term of a pair whose second word has this count."""
        p = (count * self.rate[side] + 1) / (self.n[side] * self.rate[side] + self.distinct)
        return -np.log(pair * self.rate[side] + MU * p)


class Pairs:
    """The pairs of a part: hashes and hot codes of both words, the row of each, whether its second word is a text's last."""

    def __init__(self, part, model: Model):
        flat, self.per = split_words(part.column(1))
        at, _, hashed = word_hashes(flat)
        self.second = hashed[at] if len(at) else np.zeros(0, np.uint64)
        self.second_code = model.codes(hashed)[at] if len(at) else np.zeros(0, np.int64)
        self.first, self.first_code = np.roll(self.second, 1), np.roll(self.second_code, 1)
        ends = np.cumsum(self.per)[self.per > 0]
        begin = np.append(0, ends[:-1])[: len(ends)]
        self.first[begin], self.first_code[begin] = START, 0
        self.row = np.repeat(np.arange(len(self.per)), self.per)
        self.last = np.zeros(len(self.row), bool)
        self.last[ends - 1] = True
        #: of pairs of hot words, else -1
        self.hot = np.where((self.first_code >= 0) & (self.second_code >= 0), self.first_code * (len(model.hashes) + 1) + self.second_code, -1)


def _hot_counted(model, target):
    """Rows (pair, all, in target) of pairs of hot words."""

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        out = lambda: pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in held], names=["pair", "nb", "nt"])
        for batch in batches:
            for part in slices(batch, 1):
                p = Pairs(part, model.value)
                use = p.hot >= 0
                rows = p.hot[use], np.ones(use.sum(), np.int64), _in_target(part, target)[p.row[use]].astype(np.int64)
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
                pair, at = np.unique(rows[0], return_inverse=True)
                held = [pair, *(np.bincount(at, weights=x, minlength=len(pair)) for x in rows[1:])]
                if len(pair) > HELD_PAIRS:
                    yield out()
                    held = [np.zeros(0, np.int64)] * 3
        yield out()

    return run


def _spread(keys: np.ndarray, seed: int, groups: int) -> np.ndarray:
    return ((mix(keys, seed) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def _dealt(model, table, buckets: int, target):
    """Rows of pairs for each bucket: distinct second words, how many first words each has, those, how often each pair stands,
    the places (2 * document + whether the word is a text's last), documents, whether these are in the target.
    Bucket -1: the sums that need no bucket."""

    def run(batches):
        m, (keys, terms) = model.value, table.value
        names = ("bucket", "second", "firsts", "first", "times", "places", "docs", "inside", "n", "t", "b")
        for batch in batches:
            for part in slices(batch, 1):
                p = Pairs(part, m)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                inside = _in_target(part, target)
                at = np.minimum(np.searchsorted(keys, p.hot), max(0, len(keys) - 1))
                here = (p.hot >= 0) & (keys[at] == p.hot) if len(keys) else np.zeros(len(p.hot), bool)
                lead = p.first_code >= 0
                sums = [np.bincount(p.row[lead], weights=m.before(s, m.counts[s])[p.first_code[lead]], minlength=len(ids)) + np.bincount(p.row[here], weights=terms[s][at[here]], minlength=len(ids)) for s in (0, 1)]
                cols: dict[str, list] = {c: [] for c in names}
                add = lambda **x: [cols[c].append(x.get(c)) for c in names]  # noqa: B023, E731
                add(bucket=-1, docs=ids.tobytes(), n=p.per.astype("<i8").tobytes(), t=sums[0].tobytes(), b=sums[1].tobytes())
                first, second, place = p.first[~here], p.second[~here], p.row[~here] << 1 | p.last[~here]
                with np.errstate(over="ignore"):
                    key = np.where(p.second_code[~here] < 0, second, mix(first, 7) + second)
                bucket = _spread(key, 3, buckets)
                order = np.lexsort((first, second, bucket))
                first, second, place, bucket = first[order], second[order], place[order], bucket[order]
                new_bucket = np.concatenate(([True], bucket[1:] != bucket[:-1]))[: len(bucket)]
                new_second = new_bucket | np.concatenate(([True], second[1:] != second[:-1]))[: len(bucket)]
                new_pair = new_second | np.concatenate(([True], first[1:] != first[:-1]))[: len(bucket)]
                cut = np.flatnonzero(new_bucket)
                for a, z in zip(cut, np.append(cut[1:], len(bucket))[: len(cut)], strict=True):
                    pairs = a + np.flatnonzero(new_pair[a:z])
                    seconds = np.flatnonzero(new_second[pairs])
                    docs, of = np.unique(place[a:z] >> 1, return_inverse=True)
                    add(
                        bucket=int(bucket[a]), second=second[pairs[seconds]].astype("<u8").tobytes(), firsts=np.diff(np.append(seconds, len(pairs))).astype("<u4").tobytes(), first=cut_keys(first[pairs], FIRST_BYTES),
                        times=np.diff(np.append(pairs, z)).astype("<u4").tobytes(), places=(of << 1 | place[a:z] & 1).astype("<u2").tobytes(), docs=ids[docs].tobytes(), inside=np.packbits(inside[docs]).tobytes(),
                    )
                yield pa.RecordBatch.from_pydict(cols, schema=pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in names[1:]]))

    return run


def _joined(pdf: pd.DataFrame, column: str, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in pdf[column]])


def _by_doc(docs: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    ids, at = np.unique(docs, return_inverse=True)
    return ids, *(np.bincount(at, weights=v, minlength=len(ids)) for v in values)


def _summed(model, groups: int):
    """Of one bucket: the counts and terms of its pairs and words, and the sums by document, packed for each group of documents."""

    def packed(ids, n, t, b) -> pd.DataFrame:
        to = _spread(ids.view(np.uint64), 9, groups)
        order = np.argsort(to, kind="stable")
        to, *values = (x[order] for x in (to, ids, n, t, b))
        cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        ends = np.append(cut[1:], len(to))
        return pd.DataFrame({"to": to[cut]} | {c: [v[a:z].tobytes() for a, z in zip(cut, ends, strict=True)] for c, v in zip(("docs", "n", "t", "b"), values, strict=True)})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if int(pdf["bucket"].iloc[0]) < 0:
            return packed(*_by_doc(_joined(pdf, "docs", "<i8"), _joined(pdf, "n", "<i8"), _joined(pdf, "t", "<f8"), _joined(pdf, "b", "<f8")))
        m = model.value
        docs = [np.frombuffer(x, "<i8") for x in pdf["docs"]]
        inside = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(d)) for x, d in zip(pdf["inside"], docs, strict=True)])
        base = np.cumsum([0, *map(len, docs)])
        place = [np.frombuffer(x, "<u2") for x in pdf["places"]]
        doc = np.concatenate([(x >> 1).astype(np.int64) + base[i] for i, x in enumerate(place)])
        leads = np.concatenate(place) & 1 == 0
        times = _joined(pdf, "times", "<u4").astype(np.int64)
        seconds = _joined(pdf, "second", "<u8")
        firsts = _joined(pdf, "firsts", "<u4").astype(np.int64)
        word, of_word = np.unique(seconds, return_inverse=True)
        word_of = np.repeat(of_word, firsts)
        with np.errstate(over="ignore"):
            pair, pair_of = np.unique(mix(whole_keys(b"".join(pdf["first"]), FIRST_BYTES), 7) + mix(seconds, 8).repeat(firsts), return_inverse=True)
        counts = np.add.reduceat(inside[doc].astype(np.int64), np.cumsum(times) - times), times
        code = m.codes(word)
        cold = code < 0
        second_of = np.zeros(len(pair), np.int64)
        second_of[pair_of] = word_of
        values = []
        for s in (0, 1):
            # a hot word's pairs are in many buckets, so its count is not to be had from this one
            n = np.where(cold, np.bincount(word_of, weights=counts[s], minlength=len(word)), m.counts[s][np.maximum(code, 0)])
            after = m.after(s, np.bincount(pair_of, weights=counts[s], minlength=len(pair)), n[second_of])
            before = np.where(cold, m.before(s, n), 0.0)
            values.append(np.bincount(doc, weights=np.repeat(after[pair_of], times) + np.where(leads, np.repeat(before[word_of], times), 0.0), minlength=base[-1]))
        return packed(*_by_doc(np.concatenate(docs), np.zeros(base[-1]), *values))

    return run


def _gathered(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, n, t, b = _by_doc(_joined(pdf, "docs", "<i8"), *(_joined(pdf, c, "<f8") for c in ("n", "t", "b")))
    return pd.DataFrame({"doc_id": ids, "n_tokens": n.astype(np.int64), "t": t, "b": b})


def score(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, xent_target, xent_background, xent_diff), one for each row of docs; nats a word, lower differences nearer the target.

    `target_ids`: a DataFrame whose first column holds the target's ids.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    few = wanted.limit(SENT_IDS + 1).count() <= SENT_IDS
    target = sc.broadcast(np.sort(wanted.toArrow().column(0).to_numpy()) if few else None)
    source = texts.where("doc_id is not null")
    if not few:
        source = source.join(wanted.withColumn("inside", F.lit(True)), "doc_id", "left")

    counted = save(source.mapInArrow(_counted(target), "word long, nb long, nt long").groupBy("word").agg(F.sum("nb").alias("nb"), F.sum("nt").alias("nt")))
    both = {r["starts"]: (r["nt"] or 0, r["nb"] or 0, r["n"]) for r in counted.groupBy(F.col("word").isNull().alias("starts")).agg(F.sum("nb").alias("nb"), F.sum("nt").alias("nt"), F.count("*").alias("n")).collect()}
    total, starts = both.get(False, (0, 0, 0)), both.get(True, (0, 0, 0))
    most = PAIRS_PER_BUCKET * MOST_COLD
    rows = counted.where(F.col("word").isNotNull() & (F.col("nb") > min(total[1] / HOT_SHARE, most))).collect()
    held = Model([tuple(r) for r in rows], total[:2], starts[:2], total[2])
    model = sc.broadcast(held)

    hot = source.mapInArrow(_hot_counted(model, target), "pair long, nb long, nt long").groupBy("pair").agg(F.sum("nb").alias("nb"), F.sum("nt").alias("nt"))
    if len(rows) > HOT_SHARE:
        hot = save(hot)
        if hot.count() > (HOT_SHARE + 1) ** 2:
            hot = hot.where(F.col("nb") > min(total[1] / HOT_SHARE**2, most))
    pair, nb, nt = (c.to_numpy() for c in hot.toArrow().sort_by("pair").columns)
    second = pair % (len(held.hashes) + 1)
    table = sc.broadcast((pair, [held.after(s, n, held.counts[s][second]) for s, n in enumerate((nt, nb))]))
    buckets = groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total[1] / PAIRS_PER_BUCKET))
    binary = ", ".join(f"{c} binary" for c in ("second", "firsts", "first", "times", "places", "docs", "inside", "n", "t", "b"))
    blocks = source.mapInArrow(_dealt(model, table, buckets, target), f"bucket int, {binary}")
    # sums that need no bucket are dealt over as many groups
    spread = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("docs"), F.lit(groups))).otherwise(F.lit(-1))
    sums = blocks.groupBy("bucket", spread.alias("spread")).applyInPandas(_summed(model, groups), "to int, docs binary, n binary, t binary, b binary")
    scored = sums.groupBy("to").applyInPandas(_gathered, "doc_id long, n_tokens long, t double, b double")
    mean = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens"))
    out = scored.select("doc_id", "n_tokens", mean("t").alias("xent_target"), mean("b").alias("xent_background"))
    out = out.select("doc_id", "n_tokens", "xent_target", "xent_background", (F.col("xent_target") - F.col("xent_background")).alias("xent_diff"))
    return texts.select("doc_id").join(out, "doc_id", "left").withColumnRenamed("doc_id", id_col)
