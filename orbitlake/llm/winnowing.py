"""Benchmark decontamination by winnowing, with DataFrame functions only.

A document word is hit when it stands inside an occurrence of a window: `window` consecutive
words of a benchmark item (an item of fewer words, but not none, is one window). The fingerprint of a
window of L words is the smallest hash of its k-grams, k the greatest power of two up to L (of 10: 8; shorter ones are
too common to tell texts apart). Winnowing keeps the minimum of each sliding window of L - k + 1 k-grams, so texts
that share L consecutive words share a fingerprint, always.

1. Windows of the items, with fingerprints, are a table of distinct rows. Each carries the class of the items that
   hold it, two 64-bit sums of their ids, so no list of items is gathered for a window.
2. Fingerprints set bits in a map of fixed size (64 * SLOTS bits, at any size of the benchmark), which goes to
   each task; of a document only places whose fingerprint has its bit are kept. The map lets through all that
   match, and the fewer others the smaller the benchmark is.
3. Those places are joined to the table on fingerprint and words: exact, hash collisions make no hits.
4. Hits of a document extend to spans (places that touch or overlap are one). Documents are known by the
   SHA-256 of their text: copies are one group. Items of equal sets of classes are listed once.

Everything shuffled is of the size of the hits; texts are read twice, and never shuffled. The tables of
steps 1, 3 and 4 are written to reliable storage, so a lost executor costs its tasks only, and joins on them are split where one key is hot.

Null texts have no words. Each row of docs gives one row, whatever its doc_id. A null item_id marks
words as hit, but is in no list of items. Items of equal ids are one item.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

WINDOW = 10
#: 64-bit words of the map of fingerprints.
SLOTS = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words. Splitting is some 20 times faster than regexp_extract_all, and lower() than translate().
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def cased_words(text: Column) -> Column:
    """Runs of digits, ASCII letters and characters beyond ASCII."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def lowered(w: Column) -> Column:
    """With A-Z lower-cased, no other letters."""
    return F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.transform(cased_words(text), lowered)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row however often it is used."""
    return F.transform(F.array(value), use)[0]


def _doubled(values: Column, width: int, join: Callable[[Column, Column], Column]) -> Column:
    """join() over each `width` values, by runs of 1, 2, 4, ... values; what starts in the last width - 1 places is of no use."""

    def paired(step: int) -> Callable[[Column], Column]:
        return lambda v: F.zip_with(v, F.slice(v, step + 1, 1 << 30), join)

    have = 1
    while have < width:
        step = min(have, width - have)
        values = _let(values, paired(step))
        have += step
    return values


def fingerprints(hashes: Column, length: int) -> Column:
    """Of an array of hashes of words: the fingerprint of each window of `length` words, in order."""
    k = 1 << (length.bit_length() - 1)
    grams = _doubled(hashes, k, lambda a, b: F.xxhash64(a, b))
    least = _doubled(grams, length - k + 1, lambda a, b: F.least(a, b))
    return F.slice(least, 1, F.greatest(F.size(hashes) - (length - 1), F.lit(0)))


def windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """Distinct (item, length, words, h) of a benchmark, and the lengths there are (`window` values at most)."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col).cast("string")).alias("ws"))
    sized = items.withColumn("length", F.least(F.size("ws"), F.lit(window))).where("length > 0")
    lengths = sorted(r["length"] for r in sized.select("length").distinct().collect())
    cut = sized.select("item", "length", F.explode(F.expr("transform(sequence(1, size(ws) - length + 1), s -> slice(ws, s, length))")).alias("ws"))
    hashed = cut.withColumn("hs", F.transform("ws", lambda w: F.xxhash64(w)))
    h = F.coalesce(*[F.when(F.col("length") == n, fingerprints(F.col("hs"), n)[0]) for n in lengths], F.lit(0).cast("long"))
    return hashed.select("item", "length", F.array_join("ws", " ").alias("words"), h.alias("h")).distinct(), lengths


def _bitmap(known: DataFrame) -> Column:
    """One array of SLOTS longs in which every fingerprint has set a bit, as a scalar subquery."""
    bits = known.groupBy(F.pmod("h", F.lit(SLOTS)).alias("id")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(shiftrightunsigned(h, {SLOTS.bit_length() - 1}), 64L) AS int)))").alias("bits"))
    full = known.sparkSession.range(SLOTS).join(bits, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return full.agg(F.array_sort(F.collect_list(F.struct("id", "bits")))["bits"].alias("map")).scalar()


def _places(cased: Column, lengths: list[int], bitmap: Column) -> Column:
    """Places of a document that may hold a window: an array of (start, length, words, h), null without any."""
    none = "array<struct<start:int,length:int,words:string,h:bigint>>"

    def of(c: Column, hashes: Column, m: Column, length: int) -> Column:
        held = lambda h: F.getbit(m[F.pmod(h, F.lit(SLOTS)).cast("int")], F.pmod(F.shiftrightunsigned(h, SLOTS.bit_length() - 1), F.lit(64)).cast("int")) == 1
        place = lambda s, h: F.struct(s.alias("start"), F.lit(length).alias("length"), F.array_join(F.transform(F.slice(c, s + 1, length), lowered), " ").alias("words"), h.alias("h"))
        kept = lambda h: F.transform(F.filter(F.transform(h, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: held(p["x"])), lambda p: place(p["i"], p["x"]))
        return _let(fingerprints(hashes, length), lambda h: F.when(F.exists(h, held), kept(h)).otherwise(F.array().cast(none)))

    hashes = lambda c: F.transform(c, lambda w: F.xxhash64(lowered(w)))
    # the map is named once, so that its scalar goes to each task and not into each row
    return _let(bitmap, lambda m: _let(cased, lambda c: _let(hashes(c), lambda x: F.concat(*[of(c, x, m, n) for n in lengths]))))


def _spans() -> Column:
    """The sorted column `hits` of (start, end) as spans that neither touch nor overlap."""
    empty = "cast(array() AS array<struct<start:bigint,end:bigint>>)"
    return F.expr(
        f"aggregate(hits, struct({empty} AS done, cast(null AS struct<start:bigint,end:bigint>) AS open), "
        "(s, x) -> CASE WHEN s.open IS NULL THEN struct(s.done AS done, x AS open) "
        "WHEN x.start <= s.open.end THEN struct(s.done AS done, struct(s.open.start AS start, greatest(s.open.end, x.end) AS end) AS open) "
        "ELSE struct(concat(s.done, array(s.open)) AS done, x AS open) END, s -> concat(s.done, array(s.open)))"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, spans (array of (start, end) in words, end exclusive), items (array of ids as strings, sorted), contaminated."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.sha2("text", 256)
    held, lengths = windows(benchmark, window, item_col, item_text_col)
    held = save(held)
    known = save(held.groupBy("length", "words", "h").agg(F.bit_xor(F.xxhash64("item")).alias("c1"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("c2")))
    own = source.select("doc_id", key.alias("key"), F.size(cased_words(F.col("text"))).cast("long").alias("n_words"))
    if not lengths:
        return own.selectExpr("doc_id", "n_words", "0L AS n_hit", "cast(array() AS array<struct<start:bigint,end:bigint>>) AS spans", "cast(array() AS array<string>) AS items", "false AS contaminated")
    mapped = source.select("text", key.alias("key"), _bitmap(known).alias("map"))
    places = mapped.select("key", _places(cased_words(F.col("text")), lengths, F.col("map")).alias("ps"))
    # explode() would have the places computed twice more, to filter out rows without any
    seen = places.select("key", F.explode_outer("ps").alias("p")).where("p IS NOT NULL").select("key", "p.*")
    hits = save(seen.join(known, ["h", "length", "words"]).selectExpr("key", "cast(start AS bigint) AS start", "cast(start + length AS bigint) AS end", "c1", "c2").distinct())
    # of one document, so no longer than it
    grouped = hits.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("hits"), F.sort_array(F.collect_set(F.struct("c1", "c2"))).alias("classes"))
    found = save(grouped.select("key", _spans().alias("spans"), "classes", F.xxhash64("classes").alias("d1"), F.xxhash64(F.lit(1), "classes").alias("d2")))
    classes = held.where("item IS NOT NULL").join(known, ["length", "words", "h"]).select("c1", "c2", "item").distinct()
    sets = found.select("d1", "d2", F.explode("classes").alias("c")).distinct().select("d1", "d2", "c.*").join(classes, ["c1", "c2"])
    listed = save(sets.select("d1", "d2", "item").distinct().groupBy("d1", "d2").agg(F.sort_array(F.collect_list("item")).alias("items")))
    told = found.select("key", "spans", "d1", "d2").join(listed, ["d1", "d2"], "left").drop("d1", "d2")
    n_hit = F.coalesce(F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"), F.lit(0).cast("long"))
    none = F.array()
    return own.join(told, "key", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("spans", none.cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        F.coalesce("items", none.cast("array<string>")).alias("items"), F.col("spans").isNotNull().alias("contaminated"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The lists as their sizes and hashes."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def sql(window: int = WINDOW) -> str:
    """digest() of the whole tables, for DuckDB, from the definition."""
    ws = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    cut = "[array_to_string(list_slice(ws, i, i + size - 1), ' ') FOR i IN range(1, len(ws) - size + 2)]"
    leads = "w" + "".join(f" || CASE WHEN size > {k} THEN ' ' || lead(w, {k}) OVER here ELSE '' END" for k in range(1, window))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {ws} AS ws FROM documents),
b AS (SELECT *, least(len(ws), {window}) AS size FROM (SELECT item_id::VARCHAR AS item, {ws} AS ws FROM benchmark) WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item, size, unnest({cut}) AS win FROM b),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
dn AS (SELECT r, size, i, {leads} AS win FROM dw, sizes WINDOW here AS (PARTITION BY r, size ORDER BY i)),
hit AS (SELECT r, i, size, item FROM dn JOIN bw USING (size, win)),
places AS (SELECT DISTINCT r, unnest(range(i, i + size)) AS p FROM hit),
n AS (SELECT r, count(*) AS n_hit FROM places GROUP BY r),
items AS (SELECT r, list(DISTINCT item) AS ids FROM hit WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(list_sort(ids), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN items USING (r)"""
