"""Quantifiers of ordered series as SQL over a table s(g, i, v): g the series, i a dense index from 0, v the value.

Each text runs on Spark with a DataFrame bound to {s}. Windows are partitioned by
series, so many series run in parallel; joins of a series with itself are on its key
and, where a radius bounds them, on a bucket of the value.
"""

from __future__ import annotations

PERMUTATION_ENTROPY = """
SELECT g, round(-sum(p * ln(p)) / ln(6), 8) AS permutation_entropy, sum(n) AS n_windows FROM (
  SELECT g, n, n / CAST(sum(n) OVER (PARTITION BY g) AS DOUBLE) AS p FROM (
    SELECT g, a > b AS x, a > c AS y, b > c AS z, count(*) AS n FROM (
      SELECT g, v AS a, lead(v, 1) OVER (PARTITION BY g ORDER BY i) AS b, lead(v, 2) OVER (PARTITION BY g ORDER BY i) AS c FROM {s}) w
    WHERE c IS NOT NULL GROUP BY g, a > b, a > c, b > c) h) q GROUP BY g"""

WEIGHTED_PERMUTATION_ENTROPY = """
SELECT g, round(coalesce(-sum(CASE WHEN p > 0 THEN p * ln(p) END), 0) / ln(6), 8) AS weighted_permutation_entropy FROM (
  SELECT g, w / nullif(sum(w) OVER (PARTITION BY g), 0) AS p FROM (
    SELECT g, sum((a * a + b * b + c * c) / 3 - (a + b + c) * (a + b + c) / 9) AS w FROM (
      SELECT g, v AS a, lead(v, 1) OVER (PARTITION BY g ORDER BY i) AS b, lead(v, 2) OVER (PARTITION BY g ORDER BY i) AS c FROM {s}) w
    WHERE c IS NOT NULL GROUP BY g, a > b, a > c, b > c) h) q GROUP BY g"""

AMPLITUDE_ENTROPY = """
SELECT g, round(-sum(p * ln(p)) / ln(2), 8) AS shannon, round(-ln(sum(p * p)) / ln(2), 8) AS renyi2, round(1 - sum(p * p), 8) AS tsallis2, count(*) AS bins_used FROM (
  SELECT g, count(*) / CAST(max(n) AS DOUBLE) AS p FROM (
    SELECT g, n, least(15, CAST(floor((v - lo) / nullif(hi - lo, 0) * 16) AS INT)) AS bin FROM (
      SELECT g, v, min(v) OVER (PARTITION BY g) AS lo, max(v) OVER (PARTITION BY g) AS hi, count(*) OVER (PARTITION BY g) AS n FROM {s}) a) b
  GROUP BY g, bin) c GROUP BY g"""

FEATURES = """
SELECT g, count(*) AS n, round(avg(v), 10) AS mean, round(stddev_pop(v), 6) AS std, round(var_pop(v), 5) AS var, round(sqrt(avg(v * v)), 6) AS rms, round(max(v) - min(v), 6) AS ptp,
  round(CASE WHEN var_pop(v) > 0 THEN avg((v - m) * (v - m) * (v - m)) / pow(var_pop(v), 1.5) ELSE 0 END, 6) AS skewness,
  round(CASE WHEN var_pop(v) > 0 THEN avg((v - m) * (v - m) * (v - m) * (v - m)) / (var_pop(v) * var_pop(v)) - 3 ELSE 0 END, 6) AS kurtosis
FROM (SELECT g, v, avg(v) OVER (PARTITION BY g) AS m FROM {s}) a GROUP BY g"""

ZERO_CROSSING_RATE = """
SELECT g, round(sum(CASE WHEN (x < 0) <> (y < 0) THEN 1 ELSE 0 END) / CAST(count(y) AS DOUBLE), 8) AS zero_crossing_rate FROM (
  SELECT g, x, lag(x) OVER (PARTITION BY g ORDER BY i) AS y FROM (SELECT g, i, v - avg(v) OVER (PARTITION BY g) AS x FROM {s}) a) b GROUP BY g HAVING count(y) > 0"""

HJORTH = """
SELECT g, round(var_pop(v), 5) AS activity, round(sqrt(var_pop(d1) / nullif(var_pop(v), 0)), 6) AS mobility,
  round(sqrt(var_pop(d2) / nullif(var_pop(d1), 0)) / nullif(sqrt(var_pop(d1) / nullif(var_pop(v), 0)), 0), 6) AS complexity
FROM (SELECT g, v, d1, d1 - lag(d1) OVER (PARTITION BY g ORDER BY i) AS d2 FROM (
  SELECT g, i, v, v - lag(v) OVER (PARTITION BY g ORDER BY i) AS d1 FROM {s}) a) b GROUP BY g"""

COARSE_GRAIN = """
SELECT g, scale, count(*) AS n, round(stddev_pop(m), 6) AS std FROM (
  SELECT g, scale, CAST(floor(i / scale) AS BIGINT) AS b, avg(v) AS m FROM {s} CROSS JOIN (VALUES (1), (2), (3), (4), (5)) k(scale)
  GROUP BY g, scale, CAST(floor(i / scale) AS BIGINT) HAVING count(*) = scale) a GROUP BY g, scale"""

CORRELATION_SUM = """
WITH t AS (SELECT g, i, a, b, s FROM (SELECT g, i, v AS a, lead(v, 1) OVER (PARTITION BY g ORDER BY i) AS b, stddev_pop(v) OVER (PARTITION BY g) AS s FROM {s}) q WHERE b IS NOT NULL AND s > 0),
n AS (SELECT g, count(*) AS n FROM t GROUP BY g)
SELECT p.g, CAST(k.f AS DOUBLE) AS radius_std, round(2 * sum(CASE WHEN p.d <= CAST(k.f AS DOUBLE) THEN 1 ELSE 0 END) / CAST(max(n.n) * (max(n.n) - 1) AS DOUBLE), 8) AS correlation_sum
FROM (SELECT x.g, sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) / x.s AS d FROM t x JOIN t y ON x.g = y.g AND x.i < y.i) p
CROSS JOIN (VALUES (0.1), (0.2), (0.4), (0.8), (1.6)) k(f) JOIN n ON n.g = p.g GROUP BY p.g, k.f"""

#: From e (g, i, j: who recurs with whom, both ways) and z (g, n) to measures.
_LINES = """,
dl AS (SELECT g, count(*) AS len FROM (SELECT g, j - i AS k, i - row_number() OVER (PARTITION BY g, j - i ORDER BY i) AS isl FROM e WHERE j > i) a GROUP BY g, k, isl),
vl AS (SELECT g, count(*) AS len FROM (SELECT g, j, i - row_number() OVER (PARTITION BY g, j ORDER BY i) AS isl FROM e) a GROUP BY g, j, isl),
d AS (SELECT g, sum(CASE WHEN len >= 2 THEN len ELSE 0 END) / CAST(sum(len) AS DOUBLE) AS det, max(len) AS l_max, avg(CASE WHEN len >= 2 THEN len END) AS l_mean FROM dl GROUP BY g),
w AS (SELECT g, sum(CASE WHEN len >= 2 THEN len ELSE 0 END) / CAST(sum(len) AS DOUBLE) AS lam, max(len) AS v_max, avg(CASE WHEN len >= 2 THEN len END) AS tt FROM vl GROUP BY g),
hn AS (SELECT g, -sum(p * ln(p)) AS entropy FROM (SELECT g, count(*) / CAST(sum(count(*)) OVER (PARTITION BY g) AS DOUBLE) AS p FROM dl WHERE len >= 2 GROUP BY g, len) a GROUP BY g),
rr AS (SELECT g, count(*) AS ones FROM e GROUP BY g)
SELECT z.g, round(coalesce(ones / (z.n * CAST(z.n AS DOUBLE)), 0), 8) AS recurrence_rate, round(coalesce(det, 0), 8) AS determinism, round(coalesce(lam, 0), 8) AS laminarity, coalesce(l_max, 0) AS l_max, coalesce(v_max, 0) AS v_max,
  round(coalesce(l_mean, 0), 7) AS mean_diagonal, round(coalesce(tt, 0), 7) AS trapping_time, round(abs(coalesce(entropy, 0)), 7) AS diagonal_entropy
FROM z LEFT JOIN rr ON rr.g = z.g LEFT JOIN d ON d.g = z.g LEFT JOIN w ON w.g = z.g LEFT JOIN hn ON hn.g = z.g"""

RQA = """
WITH t AS (SELECT g, i, v, n, 0.5 * s AS r, CAST(floor(v / (0.5 * s)) AS BIGINT) AS cell FROM (
  SELECT g, i, v, count(*) OVER (PARTITION BY g) AS n, CASE WHEN stddev_pop(v) OVER (PARTITION BY g) > 0 THEN stddev_pop(v) OVER (PARTITION BY g) ELSE 1 END AS s FROM {s}) q),
z AS (SELECT g, max(n) AS n FROM t GROUP BY g),
e AS (SELECT x.g, x.i, y.i AS j FROM (SELECT t.*, cell + d AS near FROM t CROSS JOIN (VALUES (-1), (0), (1)) k(d)) x JOIN t y ON x.g = y.g AND x.near = y.cell WHERE x.i <> y.i AND abs(x.v - y.v) <= x.r)""" + _LINES

RQA_RATE = """
WITH p AS (SELECT g, i, a, b FROM (SELECT g, i, v AS a, lead(v) OVER (PARTITION BY g ORDER BY i) AS b FROM {s}) q WHERE b IS NOT NULL),
z AS (SELECT g, count(*) AS n FROM p GROUP BY g),
o AS (SELECT x.g, x.i, y.i AS j, sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) AS d FROM p x JOIN p y ON x.g = y.g AND y.i - x.i > 2),
r AS (SELECT g, d, row_number() OVER (PARTITION BY g ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY g) AS m FROM o),
h AS (SELECT z.g, least(1e0, 5e-2 * n * n / (2e0 * m)) * (m - 1) AS h FROM z JOIN (SELECT DISTINCT g, m FROM r) u ON u.g = z.g),
q AS (SELECT h.g, max(CASE WHEN k = floor(h) THEN d END) AS low, max(CASE WHEN k = least(floor(h) + 1, m - 1) THEN d END) AS high, max(h - floor(h)) AS part FROM h JOIN r ON r.g = h.g GROUP BY h.g),
u AS (SELECT o.g, i, j FROM o JOIN q ON q.g = o.g WHERE d <= low + part * (high - low)),
e AS (SELECT g, i, j FROM u UNION ALL SELECT g, j AS i, i AS j FROM u)""" + _LINES

BOX_OCCUPANCY = """
SELECT g, parts, count(*) AS boxes, round(sum(p * ln(p)), 7) AS information, round(ln(sum(p * p)), 7) AS correlation FROM (
  SELECT g, parts, count(*) / CAST(max(n) AS DOUBLE) AS p FROM (
    SELECT g, parts, n, CAST(floor((v - lo) / nullif(hi - lo, 0) * parts) AS BIGINT) AS x, CAST(floor((u - lo) / nullif(hi - lo, 0) * parts) AS BIGINT) AS y FROM (
      SELECT g, v, u, lo, hi, count(*) OVER (PARTITION BY g) AS n FROM (
        SELECT g, v, lead(v) OVER (PARTITION BY g ORDER BY i) AS u, min(v) OVER (PARTITION BY g) AS lo, max(v) OVER (PARTITION BY g) AS hi FROM {s}) a WHERE u IS NOT NULL) b
    CROSS JOIN (VALUES (2), (4), (8), (16), (32)) k(parts)) c
  GROUP BY g, parts, x, y) d GROUP BY g, parts"""

CROSSINGS = """
SELECT g, i, round(i - 1 + y / (y - x), 6) AS at, CASE WHEN y < 0 THEN 'up' ELSE 'down' END AS direction FROM (
  SELECT g, i, x, lag(x) OVER (PARTITION BY g ORDER BY i) AS y FROM (SELECT g, i, v - avg(v) OVER (PARTITION BY g) AS x FROM {s}) a) b
WHERE (y < 0 AND x >= 0) OR (y > 0 AND x <= 0)"""

EXTREMA = """
SELECT g, i, round(v, 6) AS v, CASE WHEN v > a THEN 'max' ELSE 'min' END AS kind FROM (
  SELECT g, i, v, lag(v) OVER (PARTITION BY g ORDER BY i) AS a, lead(v) OVER (PARTITION BY g ORDER BY i) AS b FROM {s}) q
WHERE (v > a AND v > b) OR (v < a AND v < b)"""

TIME_REVERSAL = """
SELECT g, round(avg(d * d * d) / pow(avg(d * d), 1.5), 7) AS asymmetry FROM (
  SELECT g, v - lag(v) OVER (PARTITION BY g ORDER BY i) AS d FROM {s}) a WHERE d IS NOT NULL GROUP BY g HAVING avg(d * d) > 0"""

DETREND = """
SELECT g, i, round(v - (intercept + slope * i), 6) AS residual FROM {s} JOIN (
  SELECT g AS h, regr_slope(v, i) AS slope, regr_intercept(v, i) AS intercept FROM {s} GROUP BY g) f ON g = h"""

ZSCORE = """
SELECT g, i, round((v - avg(v) OVER (PARTITION BY g)) / nullif(stddev_pop(v) OVER (PARTITION BY g), 0), 7) AS z FROM {s}"""

DELAY_EMBEDDING = """
SELECT g, i, x0, x1, x2 FROM (
  SELECT g, i, v AS x0, lead(v, 2) OVER (PARTITION BY g ORDER BY i) AS x1, lead(v, 4) OVER (PARTITION BY g ORDER BY i) AS x2 FROM {s}) a WHERE x2 IS NOT NULL"""

ROSENSTEIN = """
WITH t AS (SELECT g, i, v AS a, lead(v, 1) OVER (PARTITION BY g ORDER BY i) AS b, count(*) OVER (PARTITION BY g) AS n FROM {s}),
u AS (SELECT * FROM t WHERE b IS NOT NULL),
p AS (SELECT x.g, x.i, y.i AS j, row_number() OVER (PARTITION BY x.g, x.i ORDER BY (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b), y.i) AS r
  FROM u x JOIN u y ON x.g = y.g AND abs(x.i - y.i) > 1 WHERE x.i <= x.n - 7 AND y.i <= y.n - 7),
q AS (SELECT p.g, k.k, p.i + k.k AS i, p.j + k.k AS j FROM p CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) k(k) WHERE r = 1)
SELECT q.g, q.k, round(avg(ln(greatest(sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)), 1e-12))), 6) AS divergence
FROM q JOIN u x ON x.g = q.g AND x.i = q.i JOIN u y ON y.g = q.g AND y.i = q.j GROUP BY q.g, q.k"""

#: Name: (SQL, the series it runs on in the registered query: by user or by event type).
ALL = {
    "box_occupancy": (BOX_OCCUPANCY, "event_type"),
    "local_extrema": (EXTREMA, "user_id"),
}
