"""Fill-in-middle transformation: texts cut at unit boundaries that a table-driven byte DFA finds.

One automaton reads the UTF-8 bytes of many texts and tells three things at once: where a code point begins
(continuation bytes don't), where a unit ends (a unit is a line with its line feed, or the rest after the
last one), and where a sentinel is complete. Its states are pairs of (continuation bytes still due, longest part of a sentinel
read so far); a byte that no UTF-8 text holds stands between texts and leads back to the start, so nothing is found across two texts.

The state after any byte depends on the few bytes before it alone (three, or a sentinel less one byte). So the bytes
are read in rows of equal width, each with that many bytes of the row before in front: one table look-up a column
serves all rows. The first pass writes the kind of each transition and counts kinds by text; the second one goes to the
counted unit end of each cut.

The cuts, the form and the order come from numbers 0 to 2**32 - 1 in columns h1 to h4 (see `drawn`): the prefix ends
after the smaller of h1 % (n + 1) and h2 % (n + 1) of the n units, the middle after the larger one. Form `plain`: texts
that are empty or hold a sentinel, and the share 1 - rate of the others (h3). `spm`: a share (h4), else `psm`. Null texts count as
empty; a row whose numbers are null (a null id) stays plain. Each row of docs gives one row; a map, nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

# Sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Kinds of transitions, as bits.
CHAR, UNIT, SENTINEL = 1, 2, 4
RESET = 0xFF


class Automaton:
    """Tables by state * 256 + byte: the next state (times 256), and the kind of the transition."""

    def __init__(self, sentinels: Sequence[str] = SENTINELS):
        patterns = [s.encode() for s in sentinels]
        if not all(patterns) or b"\n" in b"".join(patterns):
            raise ValueError("a sentinel must not be empty or hold a line feed")
        parts = sorted({p[:n] for p in patterns for n in range(len(p) + 1)}, key=len)  # "" comes first
        longest = lambda read: next(read[i:] for i in range(len(read) + 1) if read[i:] in parts)
        states = {(0, parts[0]): 0}
        steps, kinds, todo = [], [], [(0, parts[0])]
        for due, read in todo:  # grows
            row, kind = np.zeros(256, np.int32), np.zeros(256, np.uint8)
            for byte in range(256):
                goes = byte & 0xC0 == 0x80
                more = max(due - 1, 0) if goes else 1 if 0xC2 <= byte <= 0xDF else 2 if 0xE0 <= byte <= 0xEF else 3 if 0xF0 <= byte <= 0xF4 else 0
                now = (0, parts[0]) if byte == RESET else (more, longest(read + bytes([byte])))
                if now not in states:
                    states[now] = len(states)
                    todo.append(now)
                row[byte] = states[now] * 256
                if byte != RESET:
                    kind[byte] = CHAR * (not goes) | UNIT * (byte == 10) | SENTINEL * any(now[1].endswith(p) for p in patterns)
            steps.append(row)
            kinds.append(kind)
        self.next, self.kind = np.concatenate(steps), np.concatenate(kinds)
        self.memory = max(3, *(len(p) - 1 for p in patterns))

    def kinds(self, data: np.ndarray) -> np.ndarray:
        """The kind of the transition at each byte."""
        n = len(data)
        width = max(64, int(n**0.5))
        rows = -(-n // width)
        wide = np.full(self.memory + rows * width, RESET, np.uint8)
        wide[self.memory : self.memory + n] = data
        columns = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, self.memory + width)[::width].T)
        out = np.empty((width, rows), np.uint8)
        state = np.zeros(rows, np.int32)
        for at, column in enumerate(columns):
            step = state + column
            if at >= self.memory:
                out[at - self.memory] = self.kind[step]
            state = self.next[step]
        return out.T.ravel()[:n]


def drawn(seed: str, of: Column) -> list[Column]:
    """h1 to h4: the first four 8-digit groups of the hex SHA-256 of `seed:value`, as numbers; null for null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), of.cast("string")), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def _cut(part: pa.RecordBatch, automaton: Automaton, sentinels: Sequence[bytes], rate: int, spm: int) -> dict[str, list]:
    texts = pc.fill_null(part.column(1), "").cast(pa.binary()).to_pylist()
    h = [np.asarray(pc.fill_null(part.column(2 + k), -1)) for k in range(4)]
    data = np.frombuffer(bytes([RESET]).join(texts) + bytes([RESET]), np.uint8)
    kind = automaton.kinds(data)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    chars = np.concatenate([[0], np.cumsum(kind & CHAR)])
    ends = np.flatnonzero(kind & UNIT)
    first = np.searchsorted(ends, starts)
    lines = np.searchsorted(ends, starts + sizes) - first
    n = lines + ((sizes > 0) & (data[np.maximum(starts + sizes - 1, 0)] != 10))
    marks = np.searchsorted(np.flatnonzero(kind & SENTINEL), np.stack([starts, starts + sizes]))
    moved = (sizes > 0) & (marks[0] == marks[1]) & (h[0] >= 0) & (h[2] % 100 < rate)
    p, s, m = sentinels
    out: dict[str, list] = {c: [] for c in ("form", "prefix_chars", "middle_chars", "output")}
    for k, text in enumerate(texts):
        if not moved[k]:
            values = ("plain", None, None, text)
        else:
            units = sorted((int(h[0][k] % (n[k] + 1)), int(h[1][k] % (n[k] + 1))))
            a, b = (0 if not u else int(ends[first[k] + u - 1] + 1 - starts[k]) if u <= lines[k] else len(text) for u in units)
            at = starts[k]
            turned = h[3][k] % 100 < spm
            whole = b"".join((s, text[b:], p, text[:a], m, text[a:b]) if turned else (p, text[:a], s, text[b:], m, text[a:b]))
            values = ("spm" if turned else "psm", int(chars[at + a] - chars[at]), int(chars[at + b] - chars[at + a]), whole)
        for c, v in zip(out, values, strict=True):
            out[c].append(v)
    total = chars[starts + sizes] - chars[starts]
    return {"n": n, "chars": total, "sentinels": marks[1] - marks[0], **out}


def transform(docs: DataFrame, seed: str = "7", rate: int = 100, spm: int = 50, sentinels: Sequence[str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n (units), chars, sentinels (found in the text), form, prefix_chars, middle_chars, output.

    rate: of a hundred texts, those that are moved; spm: of a hundred of those, those whose suffix stands first.
    """
    if len(sentinels) != 3 or len({*sentinels}) != 3:
        raise ValueError("three sentinels are needed")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *drawn(seed, F.col(id_col)))
    kind = source.schema["doc_id"].dataType.simpleString()
    encoded, kinds = [x.encode() for x in sentinels], {"form": pa.string(), "output": pa.binary()}

    def run(batches):
        automaton = Automaton(sentinels)
        for batch in batches:
            for part in slices(batch, 1):
                cols = {c: pa.array(v, kinds.get(c, pa.int64())) for c, v in _cut(part, automaton, encoded, rate, spm).items()}
                cols["output"] = cols["output"].cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *cols.values()], names=["doc_id", *cols])

    return source.mapInArrow(run, f"doc_id {kind}, n long, chars long, sentinels long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text from what transform() made of it: no part of a moved text holds a sentinel, so the first of each is the one that was put in."""
    p, s, m = sentinels
    before = lambda c, x: F.substring_index(c, x, 1)
    rest = lambda c, x: F.substring_index(c, x, -1)
    middle = rest(output, m)
    psm = F.concat(rest(before(output, s), p), middle, rest(before(output, m), s))
    spm = F.concat(rest(before(output, m), p), middle, rest(before(output, p), s))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(made: DataFrame, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """The texts as their hashes."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form"), sentinels), 256).alias("restored_sha256"))


def sql(seed: str = "7", rate: int = 100, spm: int = 50) -> str:
    """digest() of the whole documents, for DuckDB, from the definition."""
    p, s, m = SENTINELS
    h = ", ".join(f"('0x' || substr(x, {1 + 8 * k}, 8))::BIGINT AS h{k + 1}" for k in range(4))
    held = " OR ".join(f"contains(text, '{x}')" for x in SENTINELS)
    cut = lambda low, high: f"array_to_string(list_slice(u, {low}, {high}), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('{seed}:' || doc_id::VARCHAR) AS x FROM documents),
h AS (SELECT *, len(u) AS n, {h} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
  CASE WHEN h1 IS NULL OR text = '' OR {held} OR h3 % 100 >= {rate} THEN 'plain' WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, {cut("1", "i")} AS a, {cut("i + 1", "j")} AS b, {cut("j + 1", "n")} AS c FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || a || '{s}' || c || '{m}' || b ELSE '{s}' || c || '{p}' || a || '{m}' || b END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""
