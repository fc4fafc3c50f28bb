"""License scan: an exact set-similarity join of text blocks with license templates.

A block of a template of L words is a window of L consecutive words of a text, line breaks
as blanks; its set holds its distinct words. A block meets the template when it holds at
least `threshold` of the template's distinct words, o of them. The join orders a template's
words by their frequency over all texts, rarest first. Of a meeting block and the template, the rarest
common word w is among the template's first |T| - o + 1 (prefix filter); the text has o words at
least (length filter); and o - 1 common words rank after w, both in the template and in the words
that stand within L of that place of w (positional filter). Blocks around places that pass are counted
whole, so the result is exact. Templates are a fixed list, so their
index goes to every task; texts are read twice (word counts, scan) and never shuffled.

Base labels come from places where a phrase's words stand consecutively. Null texts count
as empty. Scores: 1 where a base phrase stands, else the best share of a template that one
meeting block holds, else 0.
"""

from __future__ import annotations

import bisect
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# License notices and texts, and their labels.
TEMPLATES = {
    "t-mit": "released under the mit license",
    "t-apache": "licensed under the apache license version 2 0",
    "t-bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "t-gpl": "this work is licensed under the gnu general public license",
    "t-cc": "this work is licensed under a creative commons attribution license",
    "t-reserved": "copyright all rights reserved",
    "t-public": "this work is in the public domain",
    "t-mpl": "this file is subject to the terms of the mozilla public license",
    "t-mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "t-bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "t-apache-text": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "t-gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "t-isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "t-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
}
THRESHOLD = 0.9
#: Bytes: A-Z in lower case, digits, a-z and all beyond ASCII are word bytes, a line feed stays, the rest part words.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 10 else 32 for c in range(256))


def _normal(batch, column: int):
    return (x.translate(_BYTES) for x in pc.fill_null(batch.column(column), "").cast(pa.binary()).to_pylist())


def word_counts(docs: DataFrame, words: list[str], text_col: str = "text") -> dict[str, int]:
    """How often each of a fixed list of words stands in all texts; at most one row for each word and task is shuffled."""
    wanted = [w.encode() for w in words]
    parts = re.compile(rb"(?<![^ \n])(?:" + b"|".join(sorted(wanted, key=len, reverse=True)) + rb")(?![^ \n])")

    def run(batches):
        seen: dict[bytes, int] = dict.fromkeys(wanted, 0)
        for batch in batches:
            for t in _normal(batch, 0):
                for w in parts.findall(t):
                    seen[w] += 1
        yield pa.RecordBatch.from_pydict({"w": [w.decode() for w in seen], "n": pa.array(list(seen.values()), pa.int64())})

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(words, 0) | {r["w"]: r["n"] for r in rows}


class Index:
    """Templates by their prefix words, for a global order of words."""

    def __init__(self, templates: dict[str, str], counts: dict[str, int], threshold: float):
        self.templates, self.prefix = [], {}
        for label, text in templates.items():
            order = sorted({w.encode() for w in text.split()}, key=lambda w: (counts[w.decode()], w))
            need = max(1, math.ceil(threshold * len(order) - 1e-9))
            for w in order[: len(order) - need + 1]:
                self.prefix.setdefault(w, []).append(len(self.templates))
            self.templates.append((label, {w: i for i, w in enumerate(order)}, need, len(text.split())))
        self.any = re.compile(rb"(?<![^ \n])(?:" + b"|".join(sorted(self.prefix, key=len, reverse=True)) + rb")(?![^ \n])") if self.prefix else None

    def met(self, text: bytes) -> list[tuple[str, float]]:
        """(label, best share) of each template that a block of the text meets."""
        if self.any is None or not self.any.search(text):
            return []
        words = text.split()
        held = set(words)
        out = []
        for i in sorted({i for w in held & self.prefix.keys() for i in self.prefix[w]}):
            label, rank, need, size = self.templates[i]
            if len(words) >= need and len(held & rank.keys()) >= need:
                best = self._best([(at, rank[w]) for at, w in enumerate(words) if w in rank], len(rank), need, size)
                if best >= need:
                    out.append((label, best / len(rank)))
        return out

    @staticmethod
    def _best(spots: list[tuple[int, int]], words: int, need: int, size: int) -> int:
        """The most distinct words of the template in one block, of blocks whose rarest common word passes the filters."""
        places = [at for at, _ in spots]
        best = 0
        for place, r in spots:
            if words - r < need:  # not in the prefix
                continue
            near = spots[bisect.bisect_left(places, place - size + 1) : bisect.bisect_left(places, place + size)]
            if 1 + len({x for _, x in near if x > r}) < max(need, best + 1):
                continue
            start, seen = 0, {}
            for at, x in near:
                seen[x] = seen.get(x, 0) + 1
                while near[start][0] <= at - size:
                    seen[near[start][1]] -= 1
                    if not seen[near[start][1]]:
                        del seen[near[start][1]]
                    start += 1
                best = max(best, len(seen))
        return best


def _scanned(index, phrases: dict[str, str]):
    spots = [(re.compile(rb"(?<![^ \n])" + rb"[ \n]+".join(p.encode().split()) + rb"(?![^ \n])"), p.encode().split()[-1], label) for p, label in phrases.items()]

    def run(batches):
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
            for t in _normal(batch, 1):
                at, base = [], set()
                for spot, last, label in spots:
                    if last in t:
                        for m in spot.finditer(t):
                            at.append(m.start())
                            base.add(label)
                first = last = None
                if at:
                    first, last = len(t[: min(at)].split()), len(t[: max(at)].split())
                labels, score = set(base), 1.0 if base else 0.0
                for label, share in index.value.met(t):
                    labels.add(label)
                    score = max(score, share)
                for c, v in zip(cols, (len(t.split()), len(at), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score), strict=True):
                    cols[c].append(v)
            kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kinds.get(c, pa.int64())) for c, v in cols.items())], names=["doc_id", *cols])

    return run


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    counts = word_counts(docs, sorted({w for t in templates.values() for w in t.split()}), text_col)
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, counts, threshold))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_scanned(index, phrases), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def sql(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same for DuckDB."""
    words = "regexp_extract_all(lower_az, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    rows = ", ".join(f"('{label}', {sorted(set(text.split()))!r}, {max(1, math.ceil(threshold * len(set(text.split())) - 1e-9))}, {len(text.split())})" for label, text in templates.items())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hit = lambda *w: " AND ".join(f"ws[i + {j}] = '{x}'" for j, x in enumerate(w))
    tests = {label: hit(*phrase.split()) for phrase, label in PHRASES.items()}
    places = " || ".join(f"[{{'p': i - 1, 'l': '{label}'}} FOR i IN range(1, len(ws) + 1) IF {test}]" for label, test in tests.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS lower_az FROM documents),
w AS (SELECT r, doc_id, lower_az, {words} AS ws FROM d),
b AS (SELECT *, {places} AS spots FROM w),
t(label, need_words, need, size) AS (VALUES {rows}),
able AS (SELECT r, ws, t.* FROM b, t WHERE len(list_intersect(ws, need_words)) >= need),
windows AS (SELECT r, label, need_words, need, unnest([list_slice(ws, i, i + size - 1) FOR i IN range(1, len(ws) + 1) IF list_contains(need_words, ws[i])]) AS block FROM able),
met AS (SELECT r, label, len(list_intersect(list_distinct(block), need_words)) / len(need_words) AS share, len(list_intersect(list_distinct(block), need_words)) >= need AS ok FROM windows),
best AS (SELECT r, list(DISTINCT label) AS ls, max(share) AS share FROM met WHERE ok GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(spots)::BIGINT AS n_base,
  list_min([x.p FOR x IN spots])::BIGINT AS first_word, list_max([x.p FOR x IN spots])::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(list_distinct([x.l FOR x IN spots])), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct([x.l FOR x IN spots] || coalesce(ls, []))), ','), '') AS labels,
  CASE WHEN len(spots) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM b LEFT JOIN best USING (r)"""
