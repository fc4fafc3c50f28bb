"""The bow of a curve off its chord (sagitta), and the largest step at which a sampled curve keeps its shape.

Points are rows (g, i, x), i dense from 0. Every span-th point is a curve of its own, so all triples of a span are
three neighbours of that curve; many series are searched at once, each within bounds of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import save
from .series import ahead

#: Fixed value: a median chord of at most this counts as none, and bows are then not divided.
NO_CHORD = 1e-12


def quantile(rows: DataFrame, share: float, keys: list[str], most: int = 100_000, bins: int = 1024, largest: int | None = None) -> DataFrame:
    """(keys, value): the exact quantile of v over the keys, between the two nearest places by linear interpolation. Runs jobs when called, unless no group is over `largest` rows, and that is at most `most`.

    Groups of over `most` rows are counted by bins, and the bin that holds the place is counted again, so that no task holds more than `most` values of a group.
    """
    if largest is not None and largest <= most:
        return rows.groupBy(*keys).agg(F.percentile("v", F.lit(float(share))).alias("value"))
    place = share * (F.col("n") - 1)
    state = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).where("n > 0")
    state = state.withColumn("k", F.floor(place)).withColumn("part", place - F.floor(place)).withColumn("under", F.lit(0).cast("long")).withColumn("inside", F.col("n"))
    state = save(state.withColumn("a", F.lit(None).cast("double")).withColumn("b", F.lit(None).cast("double")))
    large = (F.col("inside") > most) & (F.col("low") < F.col("high")) & F.col("a").isNull()
    while not state.where(large).isEmpty():
        wide = rows.join(state.where(large), keys).where("v BETWEEN low AND high")
        # halves, as a range itself may overflow
        at = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * bins), F.lit(bins - 1))
        counts = wide.groupBy(*keys, "k", "n", "under", at.alias("bin")).agg(F.count("*").alias("m"), F.min("v").alias("least"), F.max("v").alias("largest"))
        upto = F.col("under") + F.sum("m").over(Window.partitionBy(*keys).orderBy("bin"))
        counts = counts.withColumn("upto", upto)
        hit = lambda k: (F.col("upto") > k) & (F.col("upto") - F.col("m") <= k)
        k, after = F.col("k"), F.least(F.col("k") + 1, F.col("n") - 1)
        of = lambda k, c: F.max(F.when(hit(k), F.col(c)))
        new = counts.groupBy(*keys).agg(of(k, "bin").alias("bin1"), of(after, "bin").alias("bin2"), of(k, "least").alias("l1"), of(k, "largest").alias("h1"), of(after, "least").alias("l2"), of(k, "m").alias("m1"), F.max(F.when(hit(k), F.col("upto") - F.col("m"))).alias("u1"))
        met, apart = state.join(new, keys, "left"), F.col("bin1") != F.col("bin2")
        pick = lambda way, other: F.when(F.col("bin1").isNull(), F.col(other)).otherwise(way)
        state = save(met.select(
            *keys, "n", "k", "part", pick(F.col("l1"), "low").alias("low"), pick(F.col("h1"), "high").alias("high"), pick(F.col("u1"), "under").alias("under"), pick(F.col("m1"), "inside").alias("inside"),
            pick(F.when(apart, F.col("h1")), "a").alias("a"), pick(F.when(apart, F.col("l2")), "b").alias("b"),
        ))
    open_ = state.where("a IS NULL AND low < high")
    few = rows.join(open_, keys).where("v BETWEEN low AND high").groupBy(*keys).agg(F.sort_array(F.collect_list("v")).alias("z"))  # `most` values
    met = state.join(few, keys, "left")
    pick = lambda k: F.get("z", (k - F.col("under")).cast("int"))
    flat = F.col("low") == F.col("high")
    a = F.coalesce("a", F.when(flat, F.col("low")).otherwise(pick(F.col("k"))))
    b = F.coalesce("b", F.when(flat, F.col("high")).otherwise(pick(F.least(F.col("k") + 1, F.col("n") - 1))))
    return met.select(*keys, (a + (b - a) * F.col("part")).alias("value"))


def _scaled(points: DataFrame) -> DataFrame:
    """Each coordinate over its standard deviation (of n - 1; one where that is 0, null or not finite)."""
    parts = points.select("g", F.posexplode("x").alias("k", "v")).groupBy("g", "k").agg(F.stddev_samp("v").alias("s"))
    size = F.when((F.col("s") > 0) & (F.col("s") < float("inf")), F.col("s")).otherwise(1.0)
    sizes = parts.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", size.alias("s")))), lambda e: e["s"]).alias("sizes"))  # one entry a coordinate
    return points.join(sizes, "g").withColumn("x", F.zip_with("x", "sizes", lambda v, s: v / s)).drop("sizes")


def _bow(a: str, b: str, c: str) -> tuple[Column, Column]:
    """How far b is from the line through a and c, and the distance of a and c; a chord of 0 has no bow."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, w: u * w), F.lit(0.0), lambda s, t: s + t)
    ac, ab = F.zip_with(c, a, lambda u, w: u - w), F.zip_with(b, a, lambda u, w: u - w)
    chord = F.sqrt(dot(ac, ac))
    off = F.zip_with(ab, F.transform(ac, lambda u: u / chord * (dot(ab, ac) / chord)), lambda u, w: u - w)
    return F.when(chord > 0, F.sqrt(dot(off, off))).otherwise(0.0), chord


def sagitta_profile(points: DataFrame, span: int = 1, relative: bool = True, normalize: bool = True) -> DataFrame:
    """(g, i, sagitta): how far each point is from the chord of those `span` before and after it, by default over the chord, coordinates scaled by their deviations.

    0 for the first and the last `span` points, and where the chord is 0.
    """
    if span < 1:
        return points.select("g", "i", F.lit(0.0).alias("sagitta"))
    rows = ahead((_scaled(points) if normalize else points).select("g", "i", "x"), [span, 2 * span], "x")
    bow, chord = _bow("x", f"a{span}", f"a{2 * span}")
    value = F.when(chord > 0, bow / chord).otherwise(0.0) if relative else bow
    found = rows.where(F.col(f"a{2 * span}").isNotNull()).select("g", (F.col("i") + span).alias("i"), value.alias("sagitta"))
    return points.select("g", "i").join(found, ["g", "i"], "left").select("g", "i", F.coalesce("sagitta", F.lit(0.0)).alias("sagitta"))


def _measure(curves: DataFrame, share: float, relative: bool, largest: int) -> DataFrame:
    """(g, span, value) of rows (g, span, i, x), every span-th point numbered anew: the share's quantile of the bows, over the median chord if relative. Triples without a chord are left out; 0 if none is left."""
    rows = ahead(curves.select(F.struct("g", "span").alias("g"), "i", "x"), [1, 2], "x").where("a2 IS NOT NULL")
    bow, chord = _bow("x", "a1", "a2")
    all_ = rows.select("g.g", "g.span", bow.alias("bow"), chord.alias("chord"))
    sound = all_.where("chord > 0")
    value = quantile(sound.select("g", "span", F.col("bow").alias("v")), share, ["g", "span"], largest=largest)
    if relative:
        mid = quantile(sound.select("g", "span", F.col("chord").alias("v")), 0.5, ["g", "span"], largest=largest).withColumnRenamed("value", "mid")
        value = value.join(mid, ["g", "span"]).select("g", "span", (F.col("value") / F.when(F.col("mid") > NO_CHORD, F.col("mid")).otherwise(1.0)).alias("value"))
    return all_.select("g", "span").distinct().join(value, ["g", "span"], "left").select("g", "span", F.coalesce("value", F.lit(0.0)).alias("value"))


def sagitta_step(points: DataFrame, epsilon: float, dt: float = 1.0, percentile: float = 95.0, relative: bool = False, min_triples: int = 3, growth: float = 1.5) -> DataFrame:
    """(g, stride, delta_t, value, fits): the largest stride found at which the percentile of the bows is at most epsilon; coordinates are scaled by their deviations.

    Spans grow by `growth` until one fails, then the bounds are halved; a relative measure need not rise with the span, so the search, not the best span, defines the result. All growing
    spans are measured in one pass, as they hold about three times the points; a halving is a pass over each series' own span. A span needs min_triples. `fits` is false where
    a span of 1 fails or has too few triples (value null): stride 1. Under five points: stride 1, value null. A plain series is embedded first (`embed`), and then `relative` is usual. Runs jobs when called.
    """
    if not (dt > 0 and epsilon > 0 and 0 < percentile <= 100 and growth > 1 and min_triples >= 1):
        raise ValueError("dt and epsilon must be positive, percentile in (0, 100], growth over 1 and min_triples at least 1")
    points = save(_scaled(points.select("g", "i", "x")))
    sizes = points.groupBy("g").agg(F.count("*").alias("n")).withColumn("top", F.greatest(F.least(F.floor((F.col("n") - 1) / 2), F.floor((F.col("n") - 1) / (min_triples + 1))), F.lit(1)))
    sizes = save(sizes.withColumn("triples", F.col("n") - 2))
    limit, largest = (x or 1 for x in sizes.agg(F.max("top"), F.max("n")).first())
    spans = [1]
    while (after := max(int(spans[-1] * growth), spans[-1] + 1)) <= limit:
        spans.append(after)
    each = F.explode(F.filter(F.array(*[F.lit(k).cast("long") for k in spans]), lambda k: (F.col("i") % k == 0) & (k <= F.col("top"))))
    usable = (F.col("n") >= 5) & (F.col("triples") >= min_triples)
    curves = points.join(sizes.where(usable), "g").select("g", each.alias("span"), "i", "x").withColumn("i", F.floor(F.col("i") / F.col("span")))
    tried = save(_measure(curves, percentile / 100, relative, largest))
    fails = tried.groupBy("g").agg(F.min(F.when(F.col("value") > epsilon, F.col("span"))).alias("fail"))
    best = tried.join(fails, "g").where("fail IS NULL OR span < fail").groupBy("g").agg(F.max(F.struct("span", "value")).alias("best"))
    first = tried.where("span = 1").select("g", F.col("value").alias("first"))
    state = sizes.join(fails, "g", "left").join(best, "g", "left").join(first, "g", "left")
    # without a failure the search goes on up to the largest span
    state = save(state.select("g", F.col("best.span").alias("ok"), F.coalesce("best.value", "first").alias("value"), F.coalesce("fail", F.col("top") + 1).alias("fail")))
    while True:
        ask = state.where("fail - ok > 1").select("g", F.floor((F.col("ok") + F.col("fail")) / 2).alias("span"))
        if ask.isEmpty():
            break
        curves = points.join(ask, "g").where("i % span = 0").select("g", "span", F.floor(F.col("i") / F.col("span")).alias("i"), "x")
        got = _measure(curves, percentile / 100, relative, largest).withColumnRenamed("value", "got")
        met, good = state.join(got, "g", "left"), F.col("got") <= epsilon
        state = save(met.select("g", F.when(good, F.col("span")).otherwise(F.col("ok")).alias("ok"), F.when(good, F.col("got")).otherwise(F.col("value")).alias("value"), F.when(F.col("got") > epsilon, F.col("span")).otherwise(F.col("fail")).alias("fail")))
    stride = F.coalesce("ok", F.lit(1)).cast("long")
    return state.select("g", stride.alias("stride"), (stride * float(dt)).alias("delta_t"), "value", F.col("ok").isNotNull().alias("fits"))


def decimate(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """The rows (g, i, ...) at every stride-th i of sagitta_step(), and the last one of each series."""
    last = rows.groupBy("g").agg(F.max("i").alias("last")).join(steps.select("g", "stride"), "g")
    return rows.join(last, "g").where("i % stride = 0 OR i = last").select(*rows.columns)
