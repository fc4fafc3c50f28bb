"""Registered queries of the library, and SQL for DuckDB.

Most queries call the operators of `functions`; their SQL is written apart, from the
definition. The rest (`PLAIN`) are SQL texts that both engines run; box occupancy, extrema and
approximate entropy are held against NumPy in the tests, the others are not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from .operators import oracles, series_models, series_sql
from .session import table


def series(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """The events as series (g, i, v), ordered by time, then id."""
    # a type holds a large share of all events, so it is numbered by days
    return fn.as_series(table(spark, sf_dir, "events"), key, ["ts", "event_id"], "value", F.to_date("ts") if key == "event_type" else None)


def _round(column: str | Column, digits: int) -> Column:
    """Rounded as DuckDB does it, by the double times a power of ten; Spark's own round goes by the decimal digits, which tell another side of a half."""
    c = F.col(column) if isinstance(column, str) else column
    at = F.abs(c) * 10.0**digits
    # beyond 2^52 and for NaN there is nothing to round; + 0.0: no negative zeros
    return F.when(at < 2.0**52, F.signum(c) * (F.floor(at) + F.when(at - F.floor(at) >= 0.5, 1).otherwise(0)) / 10.0**digits + 0.0).otherwise(c)


def _r(column: str | Column, digits: int, name: str | None = None) -> Column:
    return _round(column, digits).alias(name or column)


def _permutation(s: DataFrame, order: int, delay: int) -> DataFrame:
    hist = fn.histogram(s, fn.Ordinal(order, delay))
    n = hist.groupBy("g").agg(F.sum("n").cast("long").alias("n_windows"))
    return fn.entropy(hist, normalize=True).join(n, "g").select("g", _r("entropy", 8, "permutation_entropy"), "n_windows")


def _amplitude(s: DataFrame) -> DataFrame:
    hist = fn.histogram(s, fn.Amplitude(16))
    ways = [fn.entropy(hist, m).select("g", _r("entropy", 8, name)) for m, name in (("shannon", "shannon"), ("renyi", "renyi2"), ("tsallis", "tsallis2"))]
    return ways[0].join(ways[1], "g").join(ways[2], "g").join(hist.groupBy("g").agg(F.count("*").alias("bins_used")), "g")


def _smoothed(s: DataFrame) -> DataFrame:
    hist = fn.histogram(s, fn.Ordinal(3, 1))
    return fn.entropy(hist, normalize=True, smoothing=1.0).select("g", _r("entropy", 8, "smoothed_entropy")).join(hist.groupBy("g").agg(F.count("*").alias("patterns")), "g")


def _unique(s: DataFrame) -> DataFrame:
    hist = fn.histogram(s, fn.Unique())
    return fn.entropy(hist).select("g", _r("entropy", 8, "shannon")).join(hist.groupBy("g").agg(F.count("*").alias("outcomes")), "g")


def _delays(s: DataFrame) -> DataFrame:
    ways = [fn.optimal_delay(s, m, 50).select("g", F.col("delay").cast("int").alias(m)) for m in ("mi", "acf", "acf_zero")]
    return ways[0].join(ways[1], "g").join(ways[2], "g")


def _normalized(s: DataFrame) -> DataFrame:
    ways = [fn.normalize(s, m).select("g", "i", _r("v", d, m)) for m, d in (("minmax", 7), ("demean", 10), ("l2", 7))]
    return ways[0].join(ways[1], ["g", "i"]).join(ways[2], ["g", "i"])


def _grained(s: DataFrame) -> DataFrame:
    """All scales in one pass over windows of five samples, with one row a series in the aggregate."""
    rows, scales = fn.ahead(s, range(1, 5)), range(1, 6)
    samples = [F.col("v"), *[F.col(f"a{k}") for k in range(1, 5)]]
    # the mean of the `k` samples that begin here; null where fewer are left
    means = {k: F.when(F.col("i") % k == 0, sum(samples[1:k], samples[0]) / k) for k in scales}
    sums = rows.groupBy("g").agg(*[f.alias(f"{name}{k}") for k, m in means.items() for name, f in (("n", F.count(m)), ("std", F.stddev_pop(m)))])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("scale"), F.col(f"n{k}").alias("n"), F.col(f"std{k}").alias("std")) for k in scales]))
    return sums.select("g", each.alias("e")).where("e.n > 0").select("g", "e.n", _r("e.std", 6, "std"), "e.scale")


def _label_grid(s: DataFrame) -> DataFrame:
    """Events of a series on cells of 8 by 8 steps of its time and value: the kind of cell by its count, 0 to 3."""
    z = s.join(s.groupBy("g").agg(F.max("i").alias("last"), F.min("v").alias("low"), F.max("v").alias("high")), "g").where("high > low")
    cell = z.select(F.col("g").alias("b"), F.floor(F.col("i") * 32 / (F.col("last") + 1)).cast("int").alias("x"), F.least(F.floor((F.col("v") - F.col("low")) * 32 / (F.col("high") - F.col("low"))), F.lit(31)).cast("int").alias("y"))
    counts = cell.groupBy("b", "x", "y").agg(F.count("*").alias("n"))
    steps = F.sequence(F.lit(0), F.lit(31))
    every = z.select(F.col("g").alias("b")).distinct().select("b", F.explode(steps).alias("x")).select("b", "x", F.explode(steps).alias("y"))
    return every.join(counts, ["b", "x", "y"], "left").select("b", "x", "y", F.least(F.coalesce("n", F.lit(0)), F.lit(3)).cast("int").alias("label"))


def _basins(s: DataFrame) -> DataFrame:
    grid = _label_grid(s)
    h = fn.basin_entropy(grid, 4, escaped=True).select("b", _r("sb", 7), _r("sbb", 7), "boxes", "boundary_boxes")
    share = fn.basin_fractions(grid).where("label = 0").select("b", _r("fraction", 8, "empty"), _r("stderr", 8))
    return h.join(share, "b").join(fn.uncertainty_exponent(grid, (1, 2, 3), escaped=True).select("b", _r("alpha", 6)), "b").withColumnRenamed("b", "g")


def _rosenstein(s: DataFrame) -> DataFrame:
    return fn.divergence(s, 2, 1, 1, 5, "rosenstein").select("g", "k", _r("divergence", 6))


def _rate(s: DataFrame) -> DataFrame:
    return fn.line_fit(fn.divergence(s, 2, 1, 1, 5, "rosenstein", squared=False).select("g", F.col("k").alias("x"), F.col("divergence").alias("y"))).select("g", _r("slope", 5, "rate"))


def _lines(found: DataFrame, g: str = "g") -> DataFrame:
    return found.select(F.expr(g).alias("g"), *[_r(c, 8) for c in ("recurrence_rate", "determinism", "laminarity")], "l_max", "v_max", *[_r(c, 7) for c in ("mean_diagonal", "trapping_time", "diagonal_entropy")])


def _windowed(s: DataFrame) -> DataFrame:
    """Recurrence of windows of 50 samples, each scaled by itself."""
    return _lines(fn.rqa(fn.embed(fn.scaler(fn.windows(s, 50, column="v")), 1), 0.5), "concat(g.g, '/', g.w)")


def _features_of_spectra(s: DataFrame) -> DataFrame:
    f = fn.spectral_features(s, nperseg=64)
    return f.select("g", _r("spectral_centroid", 7, "centroid"), F.round(F.col("dominant_frequency") * 64).cast("int").alias("dominant_bin"), _r("spectral_entropy", 7))


def _boxes(s: DataFrame) -> DataFrame:
    return fn.box_curve(fn.embed(s, 2), (0, 1, 2)).select("g", "scale", "boxes", "q", _r("value", 8))


def _spectrum(s: DataFrame) -> DataFrame:
    return fn.dimension_spectrum(fn.embed(s, 2), (0, 1, 2)).select("g", "q", _r("dimension", 6), "low", "high")


def _sweep(s: DataFrame) -> DataFrame:
    """Every 20 events of a type as one value of a parameter: a cycle of four, a fixed point, or the values by quarters."""
    p = F.floor(F.col("i") / 20)
    v = F.when(p % 3 == 0, F.col("i") % 4).when(p % 3 == 1, 7).otherwise(F.floor(F.col("v") / 25)).cast("double")
    return s.select("g", p.cast("double").alias("parameter"), "i", v.alias("v"))


def _edges(s: DataFrame) -> DataFrame:
    d = fn.edge_distance(_label_grid(s))
    return d.groupBy(F.col("b").alias("g"), "label").agg(F.count("*").alias("cells"), _round(F.max("distance"), 8).alias("deepest"), _round(F.sum("distance"), 6).alias("total"))


def _correlation_dimension(s: DataFrame) -> DataFrame:
    sums = fn.correlation_sum(fn.embed(fn.scaler(s), 2), [0.1, 0.2, 0.4, 0.8, 1.6]).withColumn("correlation_sum", _round("correlation_sum", 8)).where("correlation_sum > 0 AND correlation_sum < 1")
    fit = fn.line_fit(sums.select("g", F.ln("radius").alias("x"), F.ln("correlation_sum").alias("y")))
    count = sums.groupBy("g").agg(F.count("*").alias("radii"))
    return count.join(fit, "g", "left").select("g", "radii", _r("slope", 5, "dimension"))


def _kept(s: DataFrame) -> DataFrame:
    rows = None
    for method in ("shuffle", "fourier", "aaft", "iaaft"):
        # copies are numbered from 1
        one = fn.surrogates(s, method, 2).groupBy("g", "k").agg(F.count("*").alias("n"), _round(F.avg("v"), 10).alias("mean"), _round(F.stddev_pop("v"), 7).alias("std")).withColumn("method", F.lit(method))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _slopes(s: DataFrame) -> DataFrame:
    curve = fn.box_curve(fn.embed(s, 2), (2,)).withColumn("x", F.ln("epsilon"))
    slopes = fn.local_slopes(curve.select("g", "x", F.col("value").alias("y")))
    return curve.select("g", "x", "scale").join(slopes, ["g", "x"]).select("g", "scale", _r("slope", 7))


def _clouds(s: DataFrame) -> DataFrame:
    """Four embedded samples after another are a cloud."""
    return fn.embed(s, 2).select("g", F.floor(F.col("i") / 4).alias("label"), "x")


def _pooled(s: DataFrame) -> DataFrame:
    clouds = _clouds(s)
    c = fn.centres(fn.apply_merge(clouds, fn.merge_map(clouds, 9.0)))
    return c.select("g", "label", "points", *[_round(F.col("x")[k], 7).alias(f"x{k}") for k in range(2)])


def _tracked(s: DataFrame) -> DataFrame:
    """Twelve samples are a parameter value with three sets of four; a set's share is that of its values."""
    p, label = F.floor(F.col("i") / 12), F.floor(F.col("i") % 12 / 4)
    sets = s.groupBy("g", p.cast("double").alias("parameter"), label.alias("label")).agg(F.array(F.avg("v")).alias("x"), F.sum("v").alias("w"))
    total = sets.groupBy("g", "parameter").agg(F.sum("w").alias("t")).where("t <> 0")
    sets = sets.join(total, ["g", "parameter"]).select("g", "parameter", "label", "x", _round(F.col("w") / F.col("t"), 9).alias("fraction"))
    return fn.match_attractors(sets, 20.0, 0.15)


def _steps(s: DataFrame) -> DataFrame:
    return fn.sagitta_step(fn.embed(s, 2), 0.9, 0.5, 75.0, relative=True).select("g", "stride", "delta_t", _r("value", 6), "fits")


#: Name: (the operator with its parameters, the series it runs on: by user or by event type, SQL for DuckDB over s(g, i, v)).
CALLED: dict[str, tuple[Callable[[DataFrame], DataFrame], str, str]] = {
    "permutation_entropy": (lambda s: _permutation(s, 3, 1), "user_id", series_sql.PERMUTATION_ENTROPY),
    "permutation_entropy_4_2": (lambda s: _permutation(s, 4, 2), "user_id", oracles.PERMUTATION_4_2),
    "weighted_permutation_entropy": (lambda s: fn.permutation_entropy(s, weighted=True).select("g", _r("entropy", 8, "weighted_permutation_entropy")), "user_id", series_sql.WEIGHTED_PERMUTATION_ENTROPY),
    "amplitude_entropy": (_amplitude, "user_id", series_sql.AMPLITUDE_ENTROPY),
    "smoothed_ordinal_entropy": (_smoothed, "user_id", series_models.SMOOTHED_ORDINAL_ENTROPY),
    "unique_value_entropy": (_unique, "event_type", oracles.UNIQUE),
    "dispersion_entropy": (lambda s: fn.entropy(fn.histogram(s, fn.Dispersion(3, 2)), normalize=True).select("g", _r("entropy", 8, "dispersion_entropy")), "user_id", oracles.DISPERSION),
    "lz76_complexity": (lambda s: fn.lz76_complexity(s).select("g", "factors", "n"), "user_id", oracles.LZ76),
    "sample_entropy": (lambda s: fn.sample_entropy(s).select("g", "b_pairs", "a_pairs", _r("sample_entropy", 7)), "user_id", oracles.SAMPLE),
    "multiscale_entropy": (lambda s: fn.multiscale_entropy(s, 5).select("g", "scale", "b_pairs", "a_pairs", _r("sample_entropy", 7)), "user_id", oracles.MULTISCALE),
    "coarse_grain": (_grained, "user_id", series_sql.COARSE_GRAIN),
    "series_features": (lambda s: fn.extract_features(s, ["mean", "std", "var", "rms", "ptp", "skewness", "kurtosis"]).join(s.groupBy("g").agg(F.count("*").alias("n")), "g").select("g", "n", _r("mean", 10), _r("std", 6), _r("var", 5), _r("rms", 6), _r("ptp", 6), _r("skewness", 6), _r("kurtosis", 6)), "user_id", series_sql.FEATURES),
    "zero_crossing_rate": (lambda s: fn.zero_crossing_rate(s).where("zero_crossing_rate is not null").select("g", _r("zero_crossing_rate", 8)), "user_id", series_sql.ZERO_CROSSING_RATE),
    "hjorth_parameters": (lambda s: fn.extract_features(s, ["activity", "mobility", "complexity"]).select("g", _r("activity", 5), _r("mobility", 6), _r("complexity", 6)), "user_id", series_sql.HJORTH),
    "autocorrelation": (lambda s: fn.autocorrelation(s, 50).select("g", "lag", _r("acf", 7)), "event_type", oracles.AUTOCORRELATION),
    "mutual_information": (lambda s: fn.mutual_information(s, 50).select("g", "lag", _r("mutual_information", 7)), "event_type", oracles.MUTUAL_INFORMATION),
    "optimal_delay": (_delays, "event_type", oracles.OPTIMAL_DELAY),
    "zero_one_test": (lambda s: fn.zero_one_test(s, [0.7, 1.1, 1.5, 1.9, 2.3], 10).select("g", _r("k", 5, "k_median")), "event_type", series_models.ZERO_ONE_TEST),
    "correlation_sum": (lambda s: fn.correlation_sum(fn.embed(fn.scaler(s), 2), [0.1, 0.2, 0.4, 0.8, 1.6]).select("g", F.col("radius").alias("radius_std"), _r("correlation_sum", 8)), "user_id", series_sql.CORRELATION_SUM),
    "false_nearest_neighbours": (lambda s: fn.false_nearest_neighbours(s, 1, 4).select("g", "d", _r("fraction", 7), "dimension"), "user_id", oracles.FALSE_NEIGHBOURS),
    "cao_dimension": (lambda s: fn.cao_dimension(s, 1, 4).select("g", "d", _r("e1", 6), _r("e2", 6)), "user_id", oracles.CAO),
    "nonlinear_prediction_error": (lambda s: fn.prediction_error(s, 2).select("g", "n", _r("error", 6)), "user_id", series_models.PREDICTION_ERROR),
    "lyapunov_rosenstein": (_rosenstein, "user_id", series_sql.ROSENSTEIN),
    "lyapunov_rate": (_rate, "user_id", oracles.RATE),
    "lyapunov_kantz": (lambda s: fn.divergence(s, 2, 1, 1, 4, eps=5.0).select("g", "k", _r("divergence", 6)), "user_id", oracles.KANTZ),
    "detrend": (lambda s: fn.detrend(s).select("g", "i", _r("v", 6, "residual")), "user_id", series_sql.DETREND),
    "zscore": (lambda s: fn.scaler(s).select("g", "i", _r("v", 7, "z")), "user_id", series_sql.ZSCORE),
    "normalize": (_normalized, "user_id", series_models.NORMALIZE),
    "binarize": (lambda s: fn.binarize(s).select("g", "i", F.col("v").alias("above_median")), "user_id", series_models.BINARIZE),
    "rank_transform": (lambda s: fn.ranks(s).select("g", "i", F.col("r").cast("long").alias("position")), "user_id", series_models.RANKS),
    "delay_embedding": (lambda s: fn.embed(s, 3, 2).select("g", "i", *[F.col("x")[k].alias(f"x{k}") for k in range(3)]), "user_id", series_sql.DELAY_EMBEDDING),
    "time_reversal_asymmetry": (lambda s: fn.time_reversal(s).where("value is not null").select("g", _r("value", 7, "asymmetry")), "user_id", series_sql.TIME_REVERSAL),
    "transient_and_box": (lambda s: fn.in_box(fn.embed(fn.after(s, 10), 2, 1), [10.0, 10.0], [80.0, 90.0]).groupBy("g").agg(F.count("*").alias("inside")), "user_id", oracles.BOX),
    "embedding_dimension": (lambda s: fn.embedding_dimension(s, "fnn", delay=1, max_dim=4), "user_id", f"SELECT DISTINCT g, dimension FROM ({oracles.FALSE_NEIGHBOURS}) z"),
    "rqa": (lambda s: _lines(fn.rqa(fn.embed(fn.scaler(s), 1), 0.5)), "user_id", series_sql.RQA),
    "rqa_rate": (lambda s: _lines(fn.rqa(fn.embed(s, 2), recurrence_rate=0.05, theiler=2)), "user_id", series_sql.RQA_RATE),
    "windowed_rqa": (_windowed, "event_type", series_models.WINDOWED_RQA),
    "spectrogram": (lambda s: fn.spectrogram(s, nperseg=64, noverlap=32).select("g", F.col("segment").alias("seg"), "k", _r("power", 4)), "event_type", series_models.SPECTROGRAM),
    "power_spectral_density": (lambda s: fn.power_spectral_density(s, nperseg=64).select("g", "k", "frequency", _r("psd", 5), "segments"), "event_type", series_models.WELCH),
    "spectral_features": (_features_of_spectra, "event_type", series_models.SPECTRAL_FEATURES),
    "nearest_neighbours": (lambda s: fn.neighbours(fn.embed(s, 2), (1, 3), theiler=1).select("g", "i", "k", "j", _r("distance", 8)), "user_id", oracles.NEIGHBOURS),
    "fixed_mass": (lambda s: fn.fixed_mass_curve(fn.embed(s, 2), (1, 2, 4, 8, 16), theiler=1, n_ref=None).select("g", "k", _r("x", 7), "points"), "user_id", oracles.FIXED_MASS),
    "lz76_factors": (lambda s: fn.lz76_factors(s), "user_id", oracles.LZ76_FACTORS),
    "period_curve": (lambda s: fn.period_curve(s, max_delay=30).select("g", "k", _r("value", 9)), "user_id", oracles.PERIOD_CURVE),
    "estimate_period": (lambda s: fn.estimate_period(s, max_delay=30).select("g", _r("period", 6)), "user_id", oracles.PERIOD),
    "sweep_periods": (lambda s: fn.periods(_sweep(s)).join(fn.branches(_sweep(s)), ["g", "parameter"]), "event_type", oracles.SWEEP),
    "bifurcation_points": (lambda s: fn.bifurcation_points(fn.periods(_sweep(s))), "event_type", oracles.BIFURCATIONS),
    "edge_distance": (_edges, "event_type", oracles.EDGES),
    "crossings": (lambda s: fn.crossings(s).select("g", "i", _r("at", 6), "direction"), "user_id", series_sql.CROSSINGS),
    "correlation_dimension": (_correlation_dimension, "user_id", series_models.CORRELATION_DIMENSION),
    "surrogates": (_kept, "user_id", oracles.KEPT),
    "local_slopes": (_slopes, "event_type", oracles.boxes(fn.scale_shares()).rstrip() + oracles.LOCAL_SLOPES),
    "wada": (lambda s: fn.wada(_label_grid(s), (1, 2), escaped=True).select(F.col("b").alias("g"), "radius", "basins", _r("fraction", 8)), "event_type", oracles.WADA),
    "box_curve": (_boxes, "event_type", oracles.boxes(fn.scale_shares()) + "SELECT g, scale, boxes, q, round(y, 8) AS value FROM l"),
    "dimension_spectrum": (_spectrum, "event_type", oracles.boxes(fn.scale_shares()).rstrip() + ", curve AS (SELECT g, q, x, y FROM l WHERE boxes >= 2 AND boxes <= 85e-2 * n)," + oracles.SCALING + "SELECT g, q, round(slope, 6) AS dimension, low, high FROM w WHERE best = 1"),
    "merge_map": (lambda s: fn.merge_map(_clouds(s), 9.0), "user_id", oracles.MERGED),
    "pooled_clouds": (_pooled, "user_id", oracles.POOLED),
    "dedup_points": (lambda s: fn.dedup_points(fn.embed(s, 2), 12.0).select("g", "i"), "user_id", oracles.THINNED),
    "tracked_attractors": (_tracked, "user_id", oracles.TRACKED),
    "tipping_points": (lambda s: fn.tipping_points(_tracked(s), 0.3), "user_id", oracles.TIPPING),
    "sagitta_profile": (lambda s: fn.sagitta_profile(fn.embed(s, 2)).select("g", "i", _r("sagitta", 7)), "user_id", oracles.SAGITTA),
    "sagitta_step": (_steps, "user_id", oracles.SAGITTA_STEP),
    "label_grid_measures": (_basins, "event_type", oracles.GRID),
}

#: SQL texts that both engines run.
PLAIN = {name: spec for name, spec in (series_sql.ALL | series_models.ALL).items() if name not in CALLED}


def _called(operator: Callable[[DataFrame], DataFrame], key: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(series(spark, sf_dir, key))


def _query(text: str, key: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.sql(text, s=series(spark, sf_dir, key))


def _oracle(text: str, key: str) -> str:
    own = f"s AS MATERIALIZED (SELECT {key} AS g, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) - 1 AS i, value AS v FROM events WHERE value IS NOT NULL AND isfinite(value))"
    text = text.strip().replace("{s}", "s")
    if text.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {own}, {text[15:]}"
    return f"WITH {own}, {text[5:]}" if text.startswith("WITH ") else f"WITH {own} {text}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _called(op, key) for name, (op, key, _) in CALLED.items()} | {name: _query(*spec) for name, spec in PLAIN.items()}
ORACLE_SQL: dict[str, str] = {name: _oracle(text, key) for name, (_, key, text) in CALLED.items()} | {name: _oracle(*spec) for name, spec in PLAIN.items()}
