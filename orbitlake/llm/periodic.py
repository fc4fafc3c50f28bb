"""Periodic runs of words by the linear-time tandem-repeat method of Gusfield and Stoye.

A run is a stretch of words with smallest period q (words q apart are the same), at least
`exponent` * q and `shortest` words long, that no neighbouring word extends.

1. A word inside a run occurs `exponent` times in it (rounded down), so words that stand less often in their stretch
   cut it; what is left in pieces under `shortest` goes. This is repeated while it pays, over all texts of a slice
   at once. It loses nothing and leaves few words of most texts.
2. The pieces stand after another, each ended by a symbol of its own. Classes of equal substrings of 1, 2, 4, ... words
   give the suffix array, and common extensions of any two places to the right and to the left.
3. Blocks of the Lempel-Ziv decomposition: from each block border, squares of half-length k are those whose extensions
   to both sides add up to k. These pairs (start, k) cover the leftmost occurrence of every square.
4. Suffix-link walks complete the vocabulary: from the locus of a square in the suffix tree (an interval of the suffix
   array with a depth) to that of the square one word on, as long as it turns. A locus counts once. Squares of
   a half that is itself a repetition are left out, as the shorter half finds the same words.
5. All leaves below each locus are its occurrences. Occurrences of one half-length at consecutive places
   merge into one run.

Texts are rows of a map: nothing is shuffled, and a slice holds about SLICE_WORDS words, or one longer text. Memory and time of
a slice are linear in its words but for a logarithm. Null texts have no words; each row of docs gives one row.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that one vectorised step inside a task works on.
SLICE_WORDS = 1 << 19
#: Of those, after step 1, the words that steps 2 to 5 work on at once.
TREE_WORDS = 1 << 17


def words(text: Column) -> Column:
    """What stands between ASCII white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _pieces(codes: np.ndarray, owner: np.ndarray, occur: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of stretches that can hold a run: each word in them stands there `occur` times."""
    at = np.arange(len(codes))
    piece = owner
    size = len(codes) + 1
    while len(at):
        before = len(at)
        _, kind, n = np.unique(piece * size + codes[at], return_inverse=True, return_counts=True)
        at, piece = (x[n[kind] >= occur] for x in (at, piece))
        cut = np.ones(len(at), bool)
        cut[1:] = (np.diff(at) != 1) | (np.diff(piece) != 0)
        piece = np.cumsum(cut) - 1
        long = np.bincount(piece)[piece] >= shortest if len(piece) else cut
        at, piece = at[long], piece[long]
        if len(at) > 0.9 * before:
            break
    cut = np.flatnonzero(np.diff(piece, prepend=-1, append=-1)) if len(at) else np.zeros(1, np.int64)
    return at[cut[:-1]], at[cut[1:] - 1] + 1 if len(at) else at


class Substrings:
    """Classes of equal substrings of a text of 2**t words, its suffix array, and common extensions."""

    def __init__(self, text: np.ndarray):
        n = self.n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        self.levels = [np.append(rank, -1)]
        step = 1
        while rank.max() < n - 1:
            later = np.full(n, -1, np.int64)
            later[: max(0, n - step)] = rank[step:]
            rank = np.unique(rank * (n + 1) + later + 1, return_inverse=True)[1].astype(np.int64)
            self.levels.append(np.append(rank, -1))
            step *= 2
        self.levels = [x.astype(np.int32) for x in self.levels]
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of what text[i:] and text[j:] begin with in common, for i other than j."""
        i, j = i.copy(), j.copy()
        done = np.zeros(len(i), np.int64)
        for t in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[t][i] == self.levels[t][j]) * (1 << t)
            i += step
            j += step
            done += step
        return done

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of what text[:i] and text[:j] end with in common, for i other than j."""
        i, j = i.copy(), j.copy()
        done = np.zeros(len(i), np.int64)
        for t in range(len(self.levels) - 1, -1, -1):
            w = 1 << t
            far = np.minimum(i, j) >= w
            step = (far & (self.levels[t][np.where(far, i - w, 0)] == self.levels[t][np.where(far, j - w, 0)])) * w
            i -= step
            j -= step
            done += step
        return done

    def longest_before(self) -> np.ndarray:
        """Of each place the longest match with an earlier place; the best ones stand nearest in the suffix array."""
        best = np.zeros(self.n, np.int64)
        for order in (self.order, self.order[::-1]):
            # the nearest entry to the left that is smaller, by jumps over larger ones
            value = np.append(order, -1)
            last = np.append(np.arange(-1, self.n - 1), -1)
            todo = np.arange(self.n)
            while len(todo := todo[value[last[todo]] > value[todo]]):
                last[todo] = last[last[todo]]
            known = last[:-1] >= 0
            own, other = order[known], order[last[:-1][known]]
            best[own] = np.maximum(best[own], self.ahead(own, other))
        return best


def _covering(s: Substrings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (start, k) of squares of half-length k that cover the leftmost occurrence of each square."""
    n, reach = s.n, s.longest_before().tolist()
    borders, at = [], 0
    while at < n:
        borders.append(at)
        at += max(1, reach[at])
    h = np.array(borders)
    h1 = np.append(h[1:], n)
    size = h1 - h

    def pairs(counts):
        of = np.repeat(np.arange(len(counts)), counts)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + 1

    # a square that begins inside the block and ends in the next one
    of, k = pairs(np.where(h1 < n, size, 0))
    q, end = h1[of] - k, h1[of]
    a, b = s.ahead(end, q), s.behind(end, q)
    ok = (a + b >= k) & (a > 0)
    first, half = [np.maximum(q - b, q - k + 1)[ok]], [k[ok]]
    # a square that begins before the block and has its centre in it
    of, k = pairs(np.minimum(size + np.append(size[1:], 0), n - 1 - h))
    begin, q = h[of], h[of] + k
    a, b = s.ahead(begin, q), s.behind(begin, q)
    start = np.maximum(begin - b, begin - k + 1)
    ok = (a + b >= k) & (a > 0) & (b > 0) & (start + k <= h1[of])
    first.append(start[ok])
    half.append(k[ok])
    return np.concatenate(first), np.concatenate(half)


def _primitive(s: Substrings, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether text[start:start + k] is no repetition of a shorter text: it has no period k / p, p a prime that divides k."""
    ok, rest, p = np.ones(len(k), bool), k.copy(), 2
    top = int(k.max(initial=1))
    while p * p <= top and (rest > 1).any():
        divides = rest % p == 0
        at = np.flatnonzero(divides)
        if len(at):
            part = k[at] // p
            ok[at] &= s.ahead(start[at], start[at] + part) < k[at] - part
            while divides.any():
                rest[divides] //= p
                divides = rest % p == 0
        p += 1
    at = np.flatnonzero(rest > 1)
    part = k[at] // rest[at]
    ok[at] &= s.ahead(start[at], start[at] + part) < k[at] - part
    return ok


def _loci(s: Substrings, start: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) ends of the suffix-array intervals of text[start:start + depth]."""
    shared = np.zeros(s.n + 1, np.int64)
    shared[1 : s.n] = s.ahead(s.order[:-1], s.order[1:])  # of each entry and the one before
    low = [shared]
    while (1 << len(low)) <= s.n:
        w = 1 << (len(low) - 1)
        low.append(np.minimum(low[-1], np.append(low[-1][w:], np.zeros(w, np.int64))))
    left = s.rank[start]
    right = left.copy()
    for t in range(len(low) - 1, -1, -1):
        w = 1 << t
        ok = left - w >= 0
        left = left - (ok & (low[t][np.where(ok, left - w + 1, 0)] >= depth)) * w
        ok = right + w < s.n
        right = right + (ok & (low[t][np.where(ok, right + 1, 0)] >= depth)) * w
    return left, right


def runs(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of two periods and more, by period, then start. The last symbol must occur once."""
    s = Substrings(text)
    start, k = _covering(s)
    # of pairs in one stretch of period k the first one leads to all others
    begin = start - s.behind(start, start + k)
    order = np.lexsort((start, k, begin))
    start, k, begin = start[order], k[order], begin[order]
    lead = np.ones(len(k), bool)
    lead[1:] = (np.diff(k) != 0) | (np.diff(begin) != 0)
    start, k = start[lead], k[lead]
    whole = _primitive(s, start, k)
    start, k = start[whole], k[whole]
    turns = s.ahead(start, start + k) - k + 1
    of = np.repeat(np.arange(len(k)), turns)
    start = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(turns) - turns, turns)
    k = k[of]
    left, right = _loci(s, start, 2 * k)
    once = np.unique(left * (s.n + 1) + k, return_index=True)[1]
    left, k, count = left[once], k[once], right[once] - left[once] + 1
    of = np.repeat(np.arange(len(k)), count)
    place = s.order[left[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)]
    k = k[of]
    order = np.lexsort((place, k))
    place, k = place[order], k[order]
    opens = np.ones(len(k), bool)
    opens[1:] = (np.diff(k) != 0) | (np.diff(place) != 1)
    at = np.flatnonzero(opens)
    period, begin = k[at], place[at]
    last = place[np.append(at[1:], len(k)) - 1] if len(at) else place
    return begin, last + 2 * period - begin, period


def runs_of_texts(codes: np.ndarray, counts: np.ndarray, exponent: float = 4, shortest: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in it, length, period) of the runs of texts that stand after another, sorted."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    begin, end = _pieces(codes, owner, max(2, math.floor(exponent)), shortest)
    size = np.cumsum(end - begin + 1)
    top = int(codes.max(initial=-1)) + 1
    out: list[list[np.ndarray]] = [[], [], []]
    at = 0
    while at < len(begin):
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TREE_WORDS, side="right")))
        b, n = begin[at:stop], end[at:stop] - begin[at:stop]
        ends = np.cumsum(n + 1) - 1  # places of the symbols that end the pieces
        place = np.arange(ends[-1] + 1) + np.repeat(b - (ends - n), n + 1)
        text = codes[np.minimum(place, len(codes) - 1)].astype(np.int64)
        text[ends] = top + np.arange(len(ends))
        for x, y in zip(out, runs(text), strict=True):
            x.append(place[y] if x is out[0] else y)
        at = stop
    start, length, period = (np.concatenate([np.zeros(0, np.int64), *x]) for x in out)
    keep = (length >= shortest) & (length >= exponent * period)
    start, length, period = start[keep], length[keep], period[keep]
    of = owner[start] if len(start) else start
    order = np.lexsort((period, start, of))
    return tuple(x[order] for x in (of, start - first[of] if len(start) else start, length, period))


def _rows(part: pa.RecordBatch, exponent: float, shortest: int) -> dict[str, pa.Array]:
    lists = part.column(1)
    flat = lists.flatten()
    counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of, start, length, period = runs_of_texts(codes, counts, exponent, shortest)
    first = np.cumsum(counts) - counts
    edges = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edges, first[of] + start + period, 1)
    np.add.at(edges, first[of] + start + length, -1)
    kept = np.cumsum(edges[:-1]) == 0
    sums = np.concatenate([[0], np.cumsum(kept)])
    offsets = np.append(sums[first], sums[-1]).astype(np.int64)
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), flat.filter(pa.array(kept))), " ")
    bounds = np.searchsorted(of, np.arange(len(counts) + 1))
    shape = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    found = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(shape)))
    best = [max(range(a, b), key=lambda r: (Fraction(int(length[r]), int(period[r])), -start[r], -period[r]), default=-1) for a, b in zip(bounds, bounds[1:], strict=False)]
    longest = pa.array([None if r < 0 else {"start": int(start[r]), "length": int(length[r]), "period": int(period[r])} for r in best], shape)
    return {"n": pa.array(counts), "runs": found, "best": longest, "collapsed": collapsed.cast(pa.string())}


def find(docs: DataFrame, exponent: float = 4, shortest: int = 6, id_col: str = "doc_id", words_col: str = "words") -> DataFrame:
    """One row for each row of docs, whose `words` is an array of strings (see words()): doc_id, n, runs (array of (start, length, period), by start, then period),
    best (the run of most periods; ties: smallest start, then period; null without runs), collapsed (the words joined by blanks, without those that a run holds after its first period)."""
    if exponent < 2 or shortest < 1:
        raise ValueError("a run has two periods at least")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(words_col).cast("array<string>").alias("words"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sizes = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch.column(1)), 0), dtype=np.int64))
            at = 0
            while at < len(sizes):
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_WORDS, side="right")))
                part = batch.slice(at, stop - at)
                cols = _rows(part, exponent, shortest)
                yield pa.RecordBatch.from_arrays([part.column(0), *cols.values()], names=["doc_id", *cols])
                at = stop

    run_type = "struct<start:bigint,length:bigint,period:bigint>"
    return source.mapInArrow(run, f"doc_id {kind}, n long, runs array<{run_type}>, best {run_type}, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """The best run in columns, runs and words as hashes."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words): the words of the texts; of documents whose h = crc32 of the decimal id ends in 0, word i from a on is word a + (i - a) % p
    (g = h // 10, a = g % n, p = 1 + (n - a) // (3 + g % 8)). Null ids are as they are."""
    own = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col).cast("string")).alias("words"), F.crc32(F.col(id_col).cast("string").cast("binary")).alias("h"))
    a, p = "(h div 10) % size(words)", "1 + (size(words) - a) div (3 + (h div 10) % 8)"
    turned = F.expr(f"transform(array(named_struct('w', words, 'a', cast({a} AS int))), s -> transform(array(cast({p.replace('words', 's.w').replace('- a', '- s.a')} AS int)), p -> transform(s.w, (w, i) -> IF(i < s.a, w, s.w[s.a + (i - s.a) % p])))[0])[0]")
    return own.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.size("words") > 0), turned).otherwise(F.col("words")).alias("words"))
