"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions alone.

Rows fall into cells of (source, lang, topic); a cell's weight is its number of words. The
weights are raked until the shares of sources, languages and topics meet their targets,
each round one window sum for each of the three. Cells that no longer move end the work;
the loop looks at one number each STEP rounds. A row's sampling probability is
its cell's raked weight over its words, scaled so that the highest is one at most and the
expected words are `keep` of all where that is possible. Sampling compares the
probability with a hash of the row's id, so it repeats exactly and needs no shuffle.

Nulls in a key form a cell value of their own (`(none)`); empty texts have no words and
their cell's probability, or, in a cell without any words, that of weight one; rows are never dropped: they are marked.
`mix_miss` says how far, at most, a value's share was from its target in the last round: where no
weights meet all targets it stays above `tolerance` after `rounds` rounds.
Targets are relative; by default a key's value gets its words to the power `temper`, which
lifts small sources. Values whose target has no words in the data are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: Cells (under 200 bytes each) are broadcast up to this number.
SENT_CELLS = 100_000
#: Rounds of raking between two looks at how far the shares are off.
STEP = 3
KEYS = ("mix_source", "mix_lang", "mix_topic")


def topic(text: Column) -> Column:
    """A coarse kind of content by its marks: table, noisy, shouted, list or prose."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.contains(" | "), "table")
        .when(t.contains("%%%") | t.contains("***") | t.contains("###"), "noisy")
        .when(t.contains("!! "), "shouted")
        .when(t.rlike(r"(?m)^[0-9]+\.( |$)"), "list")
        .otherwise("prose")
    )


def described(docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """docs with the three keys and mix_words; columns of docs whose names begin with mix_ are replaced or dropped."""
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.lit("(none)")
    return docs.withColumns(
        {
            "mix_source": F.coalesce(F.col(source_col).cast("string"), none),
            "mix_lang": F.coalesce(F.col(lang_col).cast("string"), none),
            "mix_topic": topic(F.col(text_col).cast("string")),
            "mix_words": F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]++")).cast("double"),
        }
    )


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 90, tolerance: float = 1e-6) -> DataFrame:
    """Cells (keys, mix_words) with `w`, whose shares by key meet `targets` (rows key, share).

    Every value of a key has to have a target; where no cell can meet them all, the last round's weights stand.
    Each STEP rounds cut the lineage; their windows run over cells, which map-side sums made from all rows.
    """
    wanted = reduce(lambda d, k: d.join(targets[k].select(k, F.col("share").alias(f"t_{k}")), k), KEYS, cells.where("mix_words > 0"))
    w, worst = save(wanted.withColumn("w", F.col("mix_words"))), None
    for _ in range(-(-rounds // STEP)):
        for _ in range(STEP):
            off = F.lit(0.0)
            for k in KEYS:
                w = w.withColumn(f"r_{k}", F.col(f"t_{k}") / F.sum("w").over(Window.partitionBy(k))).withColumn("w", F.col("w") * F.col(f"r_{k}"))
                off = F.greatest(off, F.abs(F.col(f"r_{k}") - 1))
            w = w.withColumn("off", off).drop(*[f"r_{k}" for k in KEYS])
        w = save(w)
        worst = w.agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    return w.select(*KEYS, "mix_words", "w", F.lit(worst).cast("double").alias("mix_miss"))


def tempered(cells: DataFrame, key: str, temper: float) -> DataFrame:
    """Target shares of a key: its words to a power, over their sum."""
    words = cells.where("mix_words > 0").groupBy(key).agg(F.pow(F.sum("mix_words"), F.lit(temper)).alias("p"))
    return words.crossJoin(words.agg(F.sum("p").alias("all"))).select(key, (F.col("p") / F.col("all")).alias("share"))


def mix(docs: DataFrame, keep: float = 0.6, temper: float = 0.85, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", seed: int = 11, **columns: str) -> DataFrame:
    """docs with mix_source, mix_lang, mix_topic, mix_words, mix_weight (a word's), mix_miss, mix_p and mix_kept.

    Two passes over docs; only cells are shuffled (map-side sums make them at most one
    row for each cell and task). The cells come back to the rows by a broadcast join up to
    SENT_CELLS of them, else by a shuffle.
    """
    rows = described(docs, **columns)
    cells = save(rows.groupBy(*KEYS).agg(F.sum("mix_words").alias("mix_words")))
    raked = rake(cells, targets or {k: tempered(cells, k, temper) for k in KEYS})
    rate = save(raked.withColumn("mix_weight", F.col("w") / F.col("mix_words")).select(*KEYS, "mix_words", "mix_weight", "mix_miss"))
    bounds = rate.agg(F.max("mix_weight").alias("high"), F.sum("mix_words").alias("words"), F.sum(F.col("mix_weight") * F.col("mix_words")).alias("mass")).first()
    scale = min(1 / bounds["high"], keep * bounds["words"] / bounds["mass"]) if bounds["high"] else 0.0
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)
    p = F.coalesce(F.col("mix_weight") * F.lit(scale), F.lit(scale))
    back = rate.drop("mix_words")
    if rate.count() <= SENT_CELLS:
        back = F.broadcast(back)
    return (
        rows.join(back, list(KEYS), "left")
        .withColumn("mix_p", F.least(F.lit(1.0), p))
        .withColumn("mix_kept", u < F.col("mix_p"))
    )
