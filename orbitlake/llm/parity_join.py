"""Word-shingle Jaccard join by parity sketches.

A text's set holds its distinct shingles of `k` words, as 64-bit hashes. Sets are
dealt to size bands whose bounds grow by the inverse of the threshold, so a linked
pair lies in one band or two neighbouring ones. Each band has a sketch layout: the
universe is hashed into pieces, and a piece of a set's sketch is the XOR of codes of
the shingles in it (a parity sketch over very many virtual positions, of which
an unequal piece costs at least one differing shingle). A pair over the threshold
differs in at most D = (den - num) / (den + num) * (a + b) shingles; a set with P > D non-empty
pieces shares at least P - D whole pieces with every partner (pigeonhole), so
equal (band, piece, XOR) keys give all candidates. Bands of short sets use one piece
per shingle, which makes that exact; in the others the number of pieces is set so that
too few non-empty ones are over 8 standard deviations away.

Steps, each written to the shared folder:

1. one pass over the texts makes sets and keys; equal sets become one node;
2. keys meet in buckets; those that one node holds alone go. Keys that fill over an
   eighth of a bucket, by a sample, are counted by Spark's own shuffle instead;
3. as linked nodes share P - D keys, each node keeps only the D + 1 rarest of its keys
   (those it holds alone among them): two linked nodes still share one. Nodes that are
   left without any have no link;
4. each key names one of its nodes as hub, so nodes that share a key meet at a hub. Hubs are
   compared with their nodes (stars); links join components. Then hubs whose nodes still
   are in several components compare nodes of different ones, in blocks: first a forest of
   pairs, then, exactly, all pairs that are left. A comparison is of packed parity sketches
   first (their Hamming distance is never above the symmetric difference); what these leave
   is verified on whole sets, in integers.

Pairs inside a component are not compared any more, for these would grow with the square of a
family's size: `n_verified_links` counts links that were verified on the way, and the
component is what is exact.

Null or blank texts have empty sets and link with nothing. Rows with a null id are
returned with a null component. Equal sets count as linked; ids are expected to be
unique, rows that share one are one node. Only the id and text columns are read.
Two different sets are taken as one node only if two independent 64-bit hashes and the
sizes agree. The result reads tables in the shared folder, which are left there.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, cut_keys, mix, slices, split_words, tidy_shuffles, whole_keys, word_hashes

SHORT = 64
KEYS_PER_BUCKET = 4_000_000
#: Share of a bucket that one key may fill, and the number of such keys that are sent to every task (8 bytes each).
MOST_KEY, MOST_SENT = 1 / 8, 1_000_000
#: Ids (24 bytes each) of texts to fetch are broadcast up to this number; more are joined by a shuffle.
SENT_IDS = 1_000_000
#: Nodes of a hub that one task compares with as many others.
BLOCK = 1024


class Bands:
    """Size bands for a threshold num/den, with the pieces and the bits of the packed sketch of each, and the differences allowed."""

    def __init__(self, num: int, den: int, largest: int = 1 << 31):
        self.num, self.den = num, den
        low = [1]
        while low[-1] <= largest:
            low.append(low[-1] * den // num + 1)
        self.low = np.array(low, dtype=np.int64)
        top = self.low[1:] - 1
        # 1.2 x the differences allowed, and room for the empty pieces of small sets; 0: one piece a shingle
        pieces = np.ceil(1.2 * top * (den - num) / den + 1.5 * np.sqrt(top) + 8 + 0.1 * top).astype(np.int64)
        self.pieces = np.where(top < SHORT, 0, pieces)
        self.bits = np.clip(1 << np.ceil(np.log2(4 * top)).astype(np.int64), 512, 1 << 17)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, side="right") - 1

    def differ(self, a, b):
        """The largest symmetric difference of linked sets of these sizes."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    words, counts = split_words(texts)
    codes, _, hashed = word_hashes(words)
    h = hashed[codes] if len(codes) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        roll = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            roll = roll * np.uint64(0x100000001B3) + mix(h[j : j + len(roll)], j)
        roll = mix(roll, 77)
    sets, at = [], 0
    for c in counts.tolist():
        if c >= k:
            sets.append(np.unique(roll[at : at + c - k + 1]))
        elif c:
            one = np.uint64(c)
            with np.errstate(over="ignore"):
                for j in range(c):
                    one = mix(np.array([one * np.uint64(0x100000001B3) + mix(h[at + j : at + j + 1], j)[0]]), 78)[0]
            sets.append(np.array([one], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += c
    return sets


def set_hash(s: np.ndarray, seed: int) -> int:
    """Of a whole set, as a signed 64-bit integer."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s, seed).sum(dtype=np.uint64) + np.uint64(len(s))]), seed + 1).view(np.int64)[0])


def parity(s: np.ndarray, bits: int) -> np.ndarray:
    """The packed sketch, as bytes: each shingle flips one of the bits, whose number is a power of two."""
    return np.packbits((np.bincount((mix(s, 5) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def folded(sketch: np.ndarray, bits: int) -> np.ndarray:
    """The sketch of the same set with fewer bits."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, bits // 8), axis=0)


def piece_keys(sets: list[np.ndarray], bands: Bands, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the non-empty pieces of each set under its band's layout, or the next lower one's; and the index of the set of each key."""
    sizes = np.array([len(s) for s in sets], np.int64)
    band = bands.of(np.maximum(sizes, 1)) - int(lower)
    use = (sizes > 0) & (band >= 0)
    if lower:  # only sets that a member of that band can reach
        use &= sizes * bands.num <= (bands.low[np.maximum(band, 0) + 1] - 1) * bands.den
    chosen = np.flatnonzero(use)
    if not len(chosen):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    flat = np.concatenate([sets[i] for i in chosen])
    of = np.repeat(chosen, sizes[chosen])
    b = band[of].astype(np.uint64)
    k = bands.pieces[band[of]].astype(np.uint64)
    piece = np.where(k > 0, ((mix(flat ^ (b << np.uint64(40)), 11) >> np.uint64(32)) * k) >> np.uint64(32), np.arange(len(flat), dtype=np.uint64))
    code = mix(flat, 12)
    where = of.astype(np.uint64) << np.uint64(33) | piece
    order = np.argsort(where, kind="stable")
    where = where[order]
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    value = np.bitwise_xor.reduceat(code[order], first)
    layout, slot = b[order][first], np.where(k[order][first] > 0, piece[order][first], np.uint64(0))
    with np.errstate(over="ignore"):
        return mix(value + mix(layout << np.uint64(32) | slot, 13), 14), of[order][first]


def _features(k: int, bands: Bands, width: int):
    """Of each text its set's size, hashes and, for the first of equal sets of a part, keys of `width` bytes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingle_sets(part.column(1), k)
                h1 = np.array([set_hash(s, 21) for s in sets], np.int64)
                named = np.flatnonzero(part.column(0).is_valid().to_numpy(zero_copy_only=False))
                once = named[np.unique(h1[named], return_index=True)[1]]
                packed = []
                for lower in (False, True):
                    key, of = piece_keys([sets[i] for i in once], bands, lower)
                    cut = np.searchsorted(of, np.arange(len(once) + 1))
                    out = [None] * len(sets)
                    for at, a, z in zip(once.tolist(), cut[:-1], cut[1:], strict=True):
                        out[at] = cut_keys(key[a:z], width)
                    packed.append(pa.array(out, pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1), pa.array([set_hash(s, 31) for s in sets], pa.int64()), *packed],
                    names=["id", "n", "h1", "h2", "own", "below"],
                )

    return run


def _blocks(buckets: int, width: int, hot):
    """Blocks of keys for each bucket: 4-byte keys (their high part is in the bucket), and of each the place of its node after `base`."""

    def run(batches):
        skip = hot.value
        for batch in batches:
            nid = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(nid >> 16)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(nid)], strict=True):
                rows = {"bucket": [], "part": [], "base": [], "keys": [], "nodes": []}
                for lower in (0, 1) if z > a else ():
                    held = [whole_keys(x.as_buffer(), width) for x in batch.column(1 + lower).slice(a, z - a)]
                    key, node = np.concatenate(held), np.repeat(nid[a:z], [len(x) for x in held])
                    if len(skip):
                        at = np.minimum(np.searchsorted(skip, key), len(skip) - 1)
                        key, node = key[skip[at] != key], node[skip[at] != key]
                    if not len(key):
                        continue
                    bucket = ((key >> np.uint64(8 * width - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    key, node, bucket = key[order], node[order], bucket[order]
                    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                    base = int(nid[a]) >> 16 << 16
                    for s, e in zip(first, [*first[1:], len(key)], strict=True):
                        rows["bucket"].append(int(bucket[s]))
                        rows["part"].append(lower)
                        rows["base"].append(base)
                        rows["keys"].append(key[s:e].astype("<u4").tobytes())
                        rows["nodes"].append((node[s:e] - base).astype("<u2").tobytes())
                if rows["bucket"]:
                    yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("base", pa.int64()), ("keys", pa.binary()), ("nodes", pa.binary())]))

    return run


def _some_keys(width: int, share: int):
    """The keys of one node of `share`."""

    def run(batches):
        for batch in batches:
            use = pa.array((mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), 61) % np.uint64(share)) == 0)
            keys = [whole_keys(x.as_buffer(), width) for column in (1, 2) for x in batch.column(column).filter(use)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64))], names=["key"])

    return run


def _hot_members(width: int, hot):
    """Rows (k, node, part) of keys that are too frequent for a bucket."""

    def run(batches):
        for batch in batches:
            for lower in (0, 1):
                held = [whole_keys(x.as_buffer(), width) for x in batch.column(1 + lower)]
                key, node = np.concatenate([np.zeros(0, np.uint64), *held]), np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in held])
                at = np.minimum(np.searchsorted(hot.value, key), len(hot.value) - 1)
                use = hot.value[at] == key
                yield pa.RecordBatch.from_arrays([pa.array(mix(key[use], 62).view(np.int64)), pa.array(node[use]), pa.array(np.full(use.sum(), lower, np.int32))], names=["k", "node", "part"])

    return run


def _members():
    """Of one bucket: the keys that several nodes hold, and how many do. Keys with the same nodes count once, with their number."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["keys"]])
        each = [len(x) // 4 for x in pdf["keys"]]
        order = np.argsort(key, kind="stable")
        key = key[order]
        again = np.zeros(len(key), bool)
        same = key[1:] == key[:-1]
        again[1:] |= same
        again[:-1] |= same
        order, key = order[again], key[again]
        node = np.concatenate([np.frombuffer(x, "<u2") for x in pdf["nodes"]])[order] + np.repeat(pdf["base"].to_numpy(np.int64), each)[order]
        part = np.repeat(pdf["part"].to_numpy(np.int8), each)[order]
        order = np.lexsort((part, node, key))
        key, node, part = key[order], node[order], part[order]
        if len(key):
            keep = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
            key, node, part = key[keep], node[keep], part[keep]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        first, size = first[size > 1], size[size > 1]
        if not len(first):
            return pd.DataFrame({"k": [], "node": [], "part": [], "w": [], "size": []})
        each = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        node, part = node[each], part[each].astype(np.int32)
        at = np.cumsum(size) - size
        with np.errstate(over="ignore"):
            group = np.add.reduceat(mix(node.view(np.uint64) << np.uint64(1) | part.astype(np.uint64), 41), at)
        kept, index, count = np.unique(group, return_index=True, return_counts=True)
        s = size[index]
        each = np.repeat(at[index], s) + np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
        return pd.DataFrame({"k": np.repeat(kept.view(np.int64), s), "node": node[each], "part": part[each], "w": np.repeat(count, s), "size": np.repeat(s, s)})

    return run


def _sets(k: int, bands: Bands):
    """Whole sets and packed sketches of the nodes' texts; a text that shares its id with the node's, but is another, goes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingle_sets(part.column(1), k)
                part = part.filter(pa.array([set_hash(s, 21) == h for s, h in zip(sets, part.column(2).to_pylist(), strict=True)], pa.bool_()))  # noqa: PLW2901
                sets = shingle_sets(part.column(1), k) if len(part) < len(sets) else sets
                sketch = [parity(s, int(b)).tobytes() for s, b in zip(sets, bands.bits[bands.of(np.maximum([len(s) for s in sets], 1))], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sketch, pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["node", "n", "sketch", "hashes"])

    return run


def _near(bands: Bands):
    """Of pairs (a, b, na, nb, sketch of a, of b): those whose packed sketches do not rule them out."""

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            most, keep = bands.differ(na, nb), np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                bits = 8 * min(len(x), len(y))
                keep[i] = int(np.bitwise_count(folded(x, bits) ^ folded(y, bits)).sum(dtype=np.int64)) <= most[i]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    return run


def _forest(c: np.ndarray, i: np.ndarray, j: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Of pairs (i, j): those of a spanning forest over the components c, cheapest first (Boruvka's steps)."""
    label, taken, alive = c.copy(), [], np.arange(len(i))
    order = np.argsort(cost, kind="stable")
    alive = alive[order]
    while len(alive):
        x, y = label[i[alive]], label[j[alive]]
        alive, x, y = alive[x != y], x[x != y], y[x != y]
        if not len(alive):
            break
        both, at = np.concatenate((x, y)), np.concatenate((np.arange(len(alive)),) * 2)
        rank = np.lexsort((at, both))
        first = rank[np.concatenate(([True], both[rank][1:] != both[rank][:-1]))]
        chosen = np.unique(at[first])
        for e in chosen.tolist():
            p, q = label[i[alive[e]]], label[j[alive[e]]]
            if p != q:
                taken.append(alive[e])
                label[label == max(p, q)] = min(p, q)
    return np.array(taken, np.int64)


def _compared(bands: Bands, all_pairs: bool):
    """Of blocks of hubs' nodes: pairs in different components that sketches do not rule out; a forest of them, or all."""

    def pairs(node, part, n, c, block, sketch):
        order = np.lexsort((node, c))
        node, part, n, c, block = (x[order] for x in (node, part, n, c, block))
        sketch = np.stack([sketch[i] for i in order]).view("<u8")
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        step = max(1, (16 << 20) // (len(node) * sketch.shape[1] * 8))
        last = np.searchsorted(c, c, side="right")  # nodes of later components only
        for s in range(0, len(node), step):
            i, j = np.nonzero(np.arange(len(node)) >= last[s : s + step, None])
            i += s
            # of two blocks, only pairs between these; the layout of the smaller one's band is enough
            use = (node[i] != node[j]) & ((block[i] != block[j]) | (block[0] == block).all()) & (np.minimum(n[i], n[j]) * bands.den >= np.maximum(n[i], n[j]) * bands.num)
            use &= np.where(n[i] < n[j], part[i], np.where(n[j] < n[i], part[j], part[i] + part[j])) == 0
            i, j = i[use], j[use]
            d, most = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64), bands.differ(n[i], n[j])
            for held, v in zip(found, (i, j, d / most.clip(1)), strict=True):
                held.append(v[d <= most])
        i, j, cost = map(np.concatenate, found)
        if not all_pairs:
            taken = _forest(c, i, j, cost)
            i, j = i[taken], j[taken]
        return np.minimum(node[i], node[j]), np.maximum(node[i], node[j])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "band", "low", "high"])
        where = pdf[["h", "band", "low", "high"]].to_numpy(np.int64)
        columns = [pdf[x].to_numpy(np.int64) for x in ("node", "part", "n", "c", "block")]
        first = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]).any(axis=1))))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(first.tolist(), [*first[1:].tolist(), len(pdf)], strict=True):
            c = columns[3][s:e]
            if (c != c[0]).any():
                bits = int(bands.bits[where[s, 1]])
                x, y = pairs(*[v[s:e] for v in columns], [folded(np.frombuffer(x, np.uint8), bits) for x in pdf["sketch"].iloc[s:e]])
                a.append(x)
                b.append(y)
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    return run


def _linked(num: int, den: int):
    """Exact: den * intersection >= num * union, in integers."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                both = np.concatenate((np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")))
                both.sort(kind="stable")
                meet = int((both[1:] == both[:-1]).sum())
                keep.append(den * meet >= num * (len(both) - meet))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return run


def parity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """Rows (id, n_shingles, component_id, n_verified_links): one for each row of docs, as the module says.

    component_id: the smallest id reachable over links; n_verified_links: links of the row's set to different
    sets that were verified on the way. Reads docs twice and shuffles keys, not texts.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with tidy_shuffles(docs.sparkSession):
        ids, classes = _classes(texts, k, Bands(num, den), Scratch(docs.sparkSession, "jaccard"))
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.when(F.col("id").isNotNull(), F.col("component_id")))
    out = ids.join(classes, ["h1", "h2", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_verified_links", F.lit(0)).cast("long").alias("n_verified_links"))


def _members_of(keyed: DataFrame, own: Scratch, total: int, width: int) -> DataFrame:
    """Rows (k, node, part, w, size) of keys that several nodes hold."""
    spark = keyed.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / KEYS_PER_BUCKET))
    most = max(KEYS_PER_BUCKET * MOST_KEY, total / MOST_SENT)
    share = max(1, int(most // 256))
    frequent = keyed.mapInArrow(_some_keys(width, share), "key long").groupBy("key").count().where(F.col("count") * share > most / 2)
    hot = spark.sparkContext.broadcast(np.sort(frequent.select("key").toArrow().column(0).to_numpy().view(np.uint64)))
    blocks = keyed.mapInArrow(_blocks(buckets, width, hot), "bucket int, part int, base long, keys binary, nodes binary")
    members = blocks.groupBy("bucket").applyInPandas(_members(), "k long, node long, part int, w long, size long")
    if len(hot.value):
        far = own.put("hot", keyed.mapInArrow(_hot_members(width, hot), "k long, node long, part int"))
        far = far.join(far.groupBy("k").agg(F.count("*").alias("size")).where("size > 1"), "k")
        members = members.unionByName(far.select("k", "node", "part", F.lit(1).cast("long").alias("w"), "size"))
    members = own.put("members", members)
    own.drop("hot")
    return members


def _classes(texts: DataFrame, k: int, bands: Bands, own: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (id, n, h1, h2) of all texts, and (h1, h2, n, component_id, n_verified_links) of distinct sets."""
    spark, num, den = texts.sparkSession, bands.num, bands.den
    # 40 bits tell up to 10**11 keys apart well enough; more get 48. There are fewer keys than bytes of text.
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    width = 5 if size < 10**11 else 6
    feat = own.put("feat", texts.mapInArrow(_features(k, bands, width), "id long, n long, h1 long, h2 long, own binary, below binary"))
    ids = own.put("ids", feat.select("id", "n", "h1", "h2"))
    # one node for each distinct set, with its smallest id
    keyed = feat.where("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.first("own", True).alias("own"), F.first("below", True).alias("below"))
    keyed = own.put("keyed", keyed.select(F.monotonically_increasing_id().alias("node"), "own", "below", "h1", "h2", "n", "rep"))
    own.drop("feat")
    nodes = own.put("nodes", keyed.select("node", "h1", "h2", "n", "rep", *[(F.octet_length(c) / width).cast("long").alias(f"{c}_pieces") for c in ("own", "below")]))
    total = nodes.agg(F.coalesce(F.sum(F.col("own_pieces") + F.col("below_pieces")), F.lit(0))).first()[0]
    members = _members_of(keyed.select("node", "own", "below"), own, total, width)
    own.drop("keyed")

    # of each node the rarest keys, as many as a link cannot leave out
    pieces = F.when(F.col("part") == 0, F.col("own_pieces")).otherwise(F.col("below_pieces"))
    top = F.floor(F.when(F.col("part") == 0, F.col("n") + F.floor(F.col("n") * den / num)).otherwise(2 * F.col("n")) * (den - num) / (den + num))
    spread = members.join(nodes.select("node", "n", "own_pieces", "below_pieces"), "node").withColumn("alone", pieces - F.expr("sum(w) over (partition by node, part)"))
    spread = spread.withColumn("before", F.expr("coalesce(sum(w) over (partition by node, part order by size, k rows between unbounded preceding and 1 preceding), 0)"))
    rare = own.put("rare", spread.where(F.col("before") < top + 1 - F.col("alone")).select("k", "node", "part", "n"))
    own.drop("members")
    # the band of a layout, from the size and the part
    band = F.expr(f"size(filter(array({', '.join(f'{x}L' for x in bands.low.tolist())}), x -> x <= n)) - 1 - part")
    hubs = rare.groupBy("k").agg(F.min_by("node", F.xxhash64("node")).alias("h"), F.min("node").alias("least"), F.max("node").alias("most"), F.min("part").alias("first")).where("least <> most and first = 0").select("k", "h")
    star = own.put("star", rare.join(hubs, "k").select("h", band.alias("band"), "node", "part", "n").distinct())
    own.drop("rare")

    wanted = own.put("wanted", star.select("node").distinct().join(nodes.select("node", "rep", "h1"), "node"))
    many = wanted.count()
    chosen = texts.join(wanted if many > SENT_IDS else F.broadcast(wanted), F.col("id") == F.col("rep")).select("node", "text", "h1")
    sets = own.put("sets", chosen.mapInArrow(_sets(k, bands), "node long, n long, sketch binary, hashes binary"))
    if sets.count() > many:  # rows that share id and text
        sets = own.put("once", sets.dropDuplicates(["node"]))
    sketches = sets.select("node", "n", "sketch")

    def verified(name: str, near: DataFrame) -> DataFrame:
        """Of pairs (a, b) with a < b: the links."""
        near = own.put(f"near_{name}", near.distinct())
        ends = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
        whole = sets.select("node", "hashes").join(ends, "node", "left_semi")
        pairs = near.join(whole.toDF("a", "xa"), "a").join(whole.toDF("b", "xb"), "b").select("a", "b", "xa", "xb")
        return own.put(f"links_{name}", pairs.mapInArrow(_linked(num, den), "a long, b long"))

    pairs = star.where("h <> node").select(F.least("h", "node").alias("a"), F.greatest("h", "node").alias("b")).distinct()
    pairs = pairs.join(sketches.toDF("a", "na", "sa"), "a").join(sketches.toDF("b", "nb", "sb"), "b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    links = verified("star", pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near(bands), "a long, b long"))

    for name in ("forest", "all"):
        found = own.put(f"found_{name}", components(links))
        placed = star.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        apart = placed.groupBy("h", "band").agg(F.count("*").alias("rows"), F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most")
        apart = own.put(f"apart_{name}", apart.select("h", "band", F.col("rows"), F.ceil(F.col("rows") / BLOCK).cast("int").alias("parts")))
        dealt = apart.agg(F.coalesce(F.sum(F.col("rows") * F.col("parts")), F.lit(0))).first()[0]
        groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(dealt / (16 * BLOCK)))
        rows = placed.join(apart, ["h", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), "parts").cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(sketches.select("node", "sketch"), "node")
        rows = rows.select("h", "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "part", "n", "c", "block", "sketch")
        near = rows.groupBy(F.pmod(F.xxhash64("h", "band", "low", "high"), F.lit(groups)).alias("group")).applyInPandas(_compared(bands, name == "all"), "a long, b long")
        links = links.unionByName(verified(name, near)).distinct()
    found = components(links)

    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_verified_links"))
    node = nodes.select("node", "h1", "h2", "n", "rep").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = node.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = own.put("classes", node.join(least, "component").join(degree, "node", "left").select("h1", "h2", "n", "component_id", F.coalesce("n_verified_links", F.lit(0)).alias("n_verified_links")))
    own.keep("ids", "classes")
    return ids, classes
