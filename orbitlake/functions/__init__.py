"""Operators of ordered series as functions of DataFrames, with the usual parameters and defaults."""

from .attractors import apply_merge, centres, close_pairs, components, dedup_points, match_attractors, merge_map, tipping_points
from .basins import basin_entropy, basin_fractions, kaplan_yorke, set_distance, uncertainty_exponent, wada
from .blocks import cao_dimension, correlation_dimension, correlation_sum, divergence, embedding_dimension, false_nearest_neighbours, nearest, prediction_error
from .delay import autocorrelation, first_local_minimum, mutual_information, optimal_delay, zero_one_test
from .dimensions import box_counting_dimension, box_curve, dimension_spectrum, generalized_dimension, information_dimension, scale_shares
from .distances import edge_distance, resilience
from .entropy import Amplitude, Dispersion, Ordinal, Unique, entropy, histogram, lz76_complexity, lz76_factors, multiscale_entropy, permutation_entropy, probabilities, sample_entropy
from .filters import band_pass, band_stop, butter_filter, high_pass, low_pass
from .fits import divergence_rate, line_fit, local_slopes, scaling_region
from .near import default_masses, fixed_mass_curve, fixed_mass_dimension, neighbours
from .periods import estimate_period, period_curve
from .recurrence import line_lengths, rate_threshold, rqa, windowed_rqa, windows
from .sagitta import decimate, quantile, sagitta_profile, sagitta_step
from .series import after, ahead, as_series, binarize, coarse_grain, crossings, detrend, embed, extract_features, in_ball, in_box, minmax, normalize, ranks, scaler, zero_crossing_rate
from .spectral import power_spectral_density, sampling_rate, spectral_features, spectrogram
from .surrogates import surrogate_test, surrogates, time_reversal
from .sweeps import bifurcation_points, branches, periods

__all__ = [
    "Amplitude", "Dispersion", "Ordinal", "Unique", "after", "ahead", "apply_merge", "as_series", "autocorrelation", "band_pass", "band_stop", "basin_entropy", "basin_fractions", "bifurcation_points", "binarize", "box_counting_dimension", "box_curve", "branches", "butter_filter", "cao_dimension",
    "centres", "close_pairs", "coarse_grain", "components", "decimate", "dedup_points", "match_attractors", "merge_map", "quantile", "sagitta_profile", "sagitta_step", "tipping_points", "correlation_dimension", "correlation_sum", "crossings", "default_masses", "detrend", "dimension_spectrum", "divergence", "divergence_rate", "edge_distance", "embed", "embedding_dimension", "entropy", "estimate_period", "extract_features", "false_nearest_neighbours",
    "first_local_minimum", "fixed_mass_curve", "fixed_mass_dimension", "generalized_dimension", "high_pass", "histogram", "in_ball", "in_box", "information_dimension", "kaplan_yorke", "line_fit", "line_lengths", "local_slopes", "low_pass", "lz76_complexity", "lz76_factors", "minmax", "multiscale_entropy", "mutual_information",
    "nearest", "neighbours", "normalize", "optimal_delay", "period_curve", "periods", "permutation_entropy", "power_spectral_density", "prediction_error", "probabilities", "ranks", "rate_threshold", "resilience", "rqa", "sample_entropy", "sampling_rate", "scale_shares", "scaler",
    "scaling_region", "set_distance", "spectral_features", "spectrogram", "surrogate_test", "surrogates", "time_reversal", "uncertainty_exponent", "wada", "windowed_rqa", "windows", "zero_crossing_rate", "zero_one_test",
]
