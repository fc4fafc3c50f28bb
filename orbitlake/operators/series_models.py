"""More quantifiers of ordered series as SQL over s(g, i, v): entropies of templates, spectra, surrogates, predictors, dimensions.

Conventions as in series_sql. Spectra are cut into segments of fixed length, so their
cost is linear in the length of a series; template joins run within buckets of a radius.
"""

from __future__ import annotations

from . import series_sql


def _values(numbers: object) -> str:
    return "(VALUES " + ", ".join(f"({n})" for n in numbers) + ")"


APPROXIMATE_ENTROPY = """
WITH t AS (SELECT g, i, a, b, c, r, CAST(floor(a / r) AS BIGINT) AS cell FROM (
  SELECT g, i, v AS a, lead(v, 1) OVER (PARTITION BY g ORDER BY i) AS b, lead(v, 2) OVER (PARTITION BY g ORDER BY i) AS c, 0.2 * stddev_pop(v) OVER (PARTITION BY g) AS r FROM {s}) q
  WHERE b IS NOT NULL AND r > 0),
p AS (SELECT x.g, x.i, count(*) AS n2, sum(CASE WHEN abs(x.c - y.c) <= x.r THEN 1 ELSE 0 END) AS n3
  FROM (SELECT t.*, cell + d AS near FROM t CROSS JOIN (VALUES (-1), (0), (1)) k(d)) x JOIN t y ON x.g = y.g AND x.near = y.cell
  WHERE abs(x.a - y.a) <= x.r AND abs(x.b - y.b) <= x.r GROUP BY x.g, x.i)
SELECT g, round(avg(ln(n2 / CAST(n AS DOUBLE))) - avg(CASE WHEN n3 > 0 THEN ln(n3 / CAST(n - 1 AS DOUBLE)) END), 7) AS approximate_entropy
FROM (SELECT g, n2, n3, count(*) OVER (PARTITION BY g) AS n FROM p) q GROUP BY g"""

SMOOTHED_ORDINAL_ENTROPY = """
SELECT g, count(*) AS patterns, round(-(sum((n + 1) / (total + 6) * ln((n + 1) / (total + 6))) + (6 - count(*)) / (max(total) + 6) * ln(1 / (max(total) + 6))) / ln(6), 8) AS smoothed_entropy FROM (
  SELECT g, n, CAST(sum(n) OVER (PARTITION BY g) AS DOUBLE) AS total FROM (
    SELECT g, a > b AS x, a > c AS y, b > c AS z, count(*) AS n FROM (
      SELECT g, v AS a, lead(v, 1) OVER (PARTITION BY g ORDER BY i) AS b, lead(v, 2) OVER (PARTITION BY g ORDER BY i) AS c FROM {s}) w
    WHERE c IS NOT NULL GROUP BY g, a > b, a > c, b > c) h) q GROUP BY g"""

NORMALIZE = """
SELECT g, i, round((v - min(v) OVER (PARTITION BY g)) / coalesce(nullif(max(v) OVER (PARTITION BY g) - min(v) OVER (PARTITION BY g), 0), 1), 7) AS minmax,
  round(v - avg(v) OVER (PARTITION BY g), 10) AS demean, round(v / coalesce(nullif(sqrt(sum(v * v) OVER (PARTITION BY g)), 0), 1), 7) AS l2 FROM {s}"""

BINARIZE = "SELECT g, i, CASE WHEN v > m THEN 1 ELSE 0 END AS above_median FROM {s} JOIN (SELECT g AS h, median(v) AS m FROM {s} GROUP BY g) k ON g = h"

RANKS = "SELECT g, i, row_number() OVER (PARTITION BY g ORDER BY v, i) - 1 AS position FROM {s}"

_SEGMENTS = f"""
WITH f AS (SELECT g, seg, i - 32 * seg AS j, v FROM (
  SELECT g, i, v, count(*) OVER (PARTITION BY g, d) AS n, CAST(floor(i / 32) AS BIGINT) - d AS seg FROM {{s}} CROSS JOIN (VALUES (0), (1)) k(d)) a WHERE seg >= 0 AND 32 * seg + 64 <= n),
h AS (SELECT g, seg, j, (v - avg(v) OVER (PARTITION BY g, seg)) * (0.5 - 0.5 * cos(2 * pi() * j / 64)) AS w FROM f),
p AS (SELECT g, seg, k, (CASE WHEN k = 0 OR k = 32 THEN 1 ELSE 2 END) * (pow(sum(w * cos(2 * pi() * k * j / 64)), 2) + pow(sum(w * sin(2 * pi() * k * j / 64)), 2)) / 24 AS power
  FROM h CROSS JOIN {_values(range(33))} z(k) GROUP BY g, seg, k)"""

#: Segments of 64 with half of them shared, periodic Hann window (its squares sum to 24), mean removed.
SPECTROGRAM = _SEGMENTS + " SELECT g, seg, k, round(power, 4) AS power FROM p"
WELCH = _SEGMENTS + " SELECT g, k, k / 64 AS frequency, round(avg(power), 5) AS psd, count(*) AS segments FROM p GROUP BY g, k"
SPECTRAL_FEATURES = (
    _SEGMENTS
    + """, m AS (SELECT g, k, avg(power) AS psd FROM p GROUP BY g, k)
SELECT g, round(sum(k * psd) / nullif(sum(psd), 0) / 64, 7) AS centroid, max_by(k, CASE WHEN k > 0 THEN psd ELSE -1 END) AS dominant_bin,
  round(-sum(CASE WHEN share > 0 THEN share * ln(share) ELSE 0 END) / ln(33), 7) AS spectral_entropy
FROM (SELECT g, k, psd, psd / nullif(sum(psd) OVER (PARTITION BY g), 0) AS share FROM m) z GROUP BY g"""
)

ZERO_ONE_TEST = f"""
WITH w AS (SELECT g, i, c, sum(v * cos(c * i)) OVER (PARTITION BY g, c ORDER BY i ROWS UNBOUNDED PRECEDING) AS p, sum(v * sin(c * i)) OVER (PARTITION BY g, c ORDER BY i ROWS UNBOUNDED PRECEDING) AS q
  FROM {{s}} CROSS JOIN (VALUES (7e-1), (11e-1), (15e-1), (19e-1), (23e-1)) k(c)),
m AS (SELECT x.g, x.c, l.n, avg(pow(y.p - x.p, 2) + pow(y.q - x.q, 2)) AS msd
  FROM w x CROSS JOIN {_values(range(1, 11))} l(n) JOIN w y ON x.g = y.g AND x.c = y.c AND y.i = x.i + l.n GROUP BY x.g, x.c, l.n),
e AS (SELECT g AS h, avg(v) AS mean FROM {{s}} GROUP BY g)
SELECT g, round(median(k), 5) AS k_median FROM (
  SELECT g, c, corr(n, msd - mean * mean * (1 - cos(n * c)) / (1 - cos(c))) AS k FROM m JOIN e ON g = h GROUP BY g, c) z GROUP BY g"""

WINDOWED_RQA = series_sql.RQA.replace(
    "{s}", "(SELECT concat(g, '/', b) AS g, i - 50 * b AS i, v FROM (SELECT g, i, v, b, count(*) OVER (PARTITION BY g, b) AS n FROM (SELECT g, i, v, CAST(floor(i / 50) AS BIGINT) AS b FROM {s}) x) y WHERE n = 50) t0"
)

RETURN_MAP = """
SELECT g, i, round(peak, 6) AS peak, round(following, 6) AS following FROM (
  SELECT g, i, peak, lead(peak) OVER (PARTITION BY g ORDER BY i) AS following FROM (
    SELECT g, i, v - (a - b) * (a - b) / (8 * (a - 2 * v + b)) AS peak FROM (
      SELECT g, i, v, lag(v) OVER (PARTITION BY g ORDER BY i) AS a, lead(v) OVER (PARTITION BY g ORDER BY i) AS b FROM {s}) q WHERE v > a AND v > b) r) z WHERE following IS NOT NULL"""

POINCARE_SECTION = """
SELECT g, i, round(y + (z - y) * (0 - x) / (nx - x), 6) AS u FROM (
  SELECT g, i, x, lead(x, 1) OVER (PARTITION BY g ORDER BY i) AS nx, lead(x, 1) OVER (PARTITION BY g ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY g ORDER BY i) AS z
  FROM (SELECT g, i, v - avg(v) OVER (PARTITION BY g) AS x FROM {s}) a) b WHERE x < 0 AND nx >= 0 AND z IS NOT NULL"""

GENERALIZED_DIMENSION = "SELECT g, round(regr_slope(ln(boxes), ln(parts)), 5) AS d0, round(-regr_slope(information, ln(parts)), 5) AS d1, round(-regr_slope(correlation, ln(parts)), 5) AS d2 FROM (" + series_sql.BOX_OCCUPANCY + ") c GROUP BY g"

CORRELATION_DIMENSION = series_sql.CORRELATION_SUM.replace("\nSELECT p.g,", "\n, c AS (SELECT p.g,", 1) + ") SELECT g, count(*) AS radii, round(regr_slope(ln(correlation_sum), ln(radius_std)), 5) AS dimension FROM c WHERE correlation_sum > 0 AND correlation_sum < 1 GROUP BY g"

PREDICTION_ERROR = """
WITH t AS (SELECT g, i, a, b, c, s FROM (SELECT g, i, v AS a, lead(v, 1) OVER (PARTITION BY g ORDER BY i) AS b, lead(v, 2) OVER (PARTITION BY g ORDER BY i) AS c, stddev_pop(v) OVER (PARTITION BY g) AS s FROM {s}) q WHERE c IS NOT NULL AND s > 0),
p AS (SELECT x.g, x.i, x.c, x.s, y.c AS near, row_number() OVER (PARTITION BY x.g, x.i ORDER BY (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b), y.i) AS r FROM t x JOIN t y ON x.g = y.g AND abs(x.i - y.i) > 1)
SELECT g, count(*) AS n, round(sqrt(avg((c - said) * (c - said))) / max(s), 6) AS error FROM (SELECT g, i, max(c) AS c, max(s) AS s, avg(near) AS said FROM p WHERE r <= 4 GROUP BY g, i HAVING count(*) = 4) z GROUP BY g"""

#: 19 shuffles, ordered by a digest of series, shuffle and position: the same on every engine and partitioning.
SURROGATE_TEST = f"""
WITH p AS (SELECT g, k, v, row_number() OVER (PARTITION BY g, k ORDER BY CASE WHEN k = 0 THEN '' ELSE md5(concat(k, '|', g, '|', i)) END, i) AS o FROM {{s}} CROSS JOIN {_values(range(20))} z(k)),
d AS (SELECT g, k, v - lag(v) OVER (PARTITION BY g, k ORDER BY o) AS d FROM p),
t AS (SELECT g, k, avg(d * d * d) / pow(avg(d * d), 1.5) AS t FROM d WHERE d IS NOT NULL GROUP BY g, k HAVING avg(d * d) > 0),
c AS (SELECT a.g, max(a.t) AS statistic, avg(b.t) AS mean, stddev_samp(b.t) AS deviation, sum(CASE WHEN b.t >= a.t THEN 1 ELSE 0 END) AS above, sum(CASE WHEN b.t <= a.t THEN 1 ELSE 0 END) AS below, count(*) AS n
  FROM t a JOIN t b ON a.g = b.g AND a.k = 0 AND b.k > 0 GROUP BY a.g)
SELECT g, n, round(statistic, 6) AS statistic, round((statistic - mean) / nullif(deviation, 0), 5) AS z_score, round(least(1, 2 * (1 + least(above, below)) / CAST(n + 1 AS DOUBLE)), 6) AS p_value FROM c"""

#: Name: (SQL, the series it runs on in the registered query: by user or by event type).
ALL = {
    "approximate_entropy": (APPROXIMATE_ENTROPY, "user_id"),
    "return_map": (RETURN_MAP, "user_id"),
    "poincare_section": (POINCARE_SECTION, "user_id"),
    "generalized_dimension": (GENERALIZED_DIMENSION, "event_type"),
    "surrogate_test": (SURROGATE_TEST, "user_id"),
}
