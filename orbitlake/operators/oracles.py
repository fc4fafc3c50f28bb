"""SQL for DuckDB over s(g, i, v), from the definitions: what the operators of `functions` are held against."""

from __future__ import annotations

from statistics import NormalDist

PERMUTATION_4_2 = """
SELECT g, round(-sum(n / t * ln(n / t)) / ln(24), 8) AS permutation_entropy, max(t)::BIGINT AS n_windows FROM (
  SELECT g, n::DOUBLE AS n, (sum(n) OVER (PARTITION BY g))::DOUBLE AS t FROM (
    SELECT g, [z[2] FOR z IN list_sort([[a, 0], [b, 1], [c, 2], [d, 3]])] AS pattern, count(*) AS n FROM (
      SELECT g, v AS a, lead(v, 2) OVER w AS b, lead(v, 4) OVER w AS c, lead(v, 6) OVER w AS d FROM s WINDOW w AS (PARTITION BY g ORDER BY i)) WHERE d IS NOT NULL GROUP BY ALL)) GROUP BY g"""

UNIQUE = """
SELECT g, round(-sum(n / t * ln(n / t)) / ln(2), 8) AS shannon, count(*) AS outcomes FROM (
  SELECT g, v, count(*)::DOUBLE AS n, (sum(count(*)) OVER (PARTITION BY g))::DOUBLE AS t FROM s GROUP BY g, v) GROUP BY g"""

DISPERSION = f"""
WITH d AS (SELECT g, i, CASE WHEN sd = 0 THEN 2 WHEN (v - m) / sd < {NormalDist().inv_cdf(1 / 3)!r} THEN 1 WHEN (v - m) / sd < {NormalDist().inv_cdf(2 / 3)!r} THEN 2 ELSE 3 END AS class FROM (
  SELECT g, i, v, avg(v) OVER (PARTITION BY g) AS m, stddev_pop(v) OVER (PARTITION BY g) AS sd FROM s)),
n AS (SELECT a.g, a.class, b.class AS next, count(*)::DOUBLE AS n FROM d a JOIN d b ON a.g = b.g AND b.i = a.i + 1 GROUP BY ALL)
SELECT g, round(-sum(n / t * ln(n / t)) / ln(9), 8) AS dispersion_entropy FROM (SELECT g, n, sum(n) OVER (PARTITION BY g) AS t FROM n) GROUP BY g"""

LZ76 = """
WITH RECURSIVE b AS (SELECT g, string_agg(CASE WHEN v > m THEN '1' ELSE '0' END, '' ORDER BY i) AS t, count(*) AS n FROM (SELECT g, i, v, median(v) OVER (PARTITION BY g) AS m FROM s) GROUP BY g),
f(g, t, n, start, size, factors) AS (
  SELECT g, t, n, 0::BIGINT, 1::BIGINT, 0::BIGINT FROM b
  UNION ALL
  SELECT g, t, n, CASE WHEN start + size <= n AND contains(t[1:start + size - 1], t[start + 1:start + size]) THEN start ELSE start + size END,
    CASE WHEN start + size <= n AND contains(t[1:start + size - 1], t[start + 1:start + size]) THEN size + 1 ELSE 1 END,
    CASE WHEN start + size <= n AND contains(t[1:start + size - 1], t[start + 1:start + size]) THEN factors ELSE factors + 1 END
  FROM f WHERE start < n)
SELECT g, max(factors) AS factors, max(n) AS n FROM f GROUP BY g"""

_PAIRS = """
t AS (SELECT g, scale, i, v AS a, lead(v, 1) OVER w AS b, lead(v, 2) OVER w AS c FROM m WINDOW w AS (PARTITION BY g, scale ORDER BY i)),
p AS (SELECT x.g, x.scale, count(*) AS b_pairs, count(*) FILTER (abs(x.c - y.c) <= r) AS a_pairs FROM t x JOIN o ON x.g = o.g JOIN t y ON x.g = y.g AND x.scale = y.scale AND x.i < y.i
  WHERE r > 0 AND x.c IS NOT NULL AND y.c IS NOT NULL AND abs(x.a - y.a) <= r AND abs(x.b - y.b) <= r GROUP BY ALL),
k AS (SELECT DISTINCT g, scale FROM m)
SELECT g, scale, coalesce(b_pairs, 0) AS b_pairs, coalesce(a_pairs, 0) AS a_pairs, CASE WHEN a_pairs > 0 THEN round(ln(b_pairs / a_pairs), 7) WHEN b_pairs > 0 THEN 'inf'::DOUBLE END AS sample_entropy FROM k LEFT JOIN p USING (g, scale)"""

SAMPLE = "WITH m AS (SELECT g, 1 AS scale, i, v FROM s), o AS (SELECT g, 0.2 * stddev_pop(v) AS r FROM s GROUP BY g), " + _PAIRS.replace("SELECT g, scale, coalesce", "SELECT g, coalesce")

MULTISCALE = """WITH o AS (SELECT g, 0.15 * stddev_pop(v) AS r FROM s GROUP BY g),
m AS (SELECT g, scale::INT AS scale, i // scale AS i, avg(v) AS v FROM s, range(1, 6) z(scale) GROUP BY g, scale, i // scale HAVING count(*) = scale), """ + _PAIRS

AUTOCORRELATION = """
WITH d AS (SELECT g, i, v - avg(v) OVER (PARTITION BY g) AS d FROM s), q AS (SELECT g, sum(d * d) AS q FROM d GROUP BY g)
SELECT x.g, lag::INT AS lag, round(sum(x.d * y.d) / nullif(max(q), 0), 7) AS acf FROM d x, range(0, 51) z(lag) JOIN q ON q.g = x.g JOIN d y ON y.g = x.g AND y.i = x.i + lag GROUP BY x.g, lag"""

_MI = """
WITH b AS (SELECT g, i, least(floor((v - lo) / (hi - lo) * k), k - 1)::INT AS b FROM (
  SELECT g, i, v, min(v) OVER (PARTITION BY g) AS lo, max(v) OVER (PARTITION BY g) AS hi, least(128, greatest(16, floor(sqrt(count(*) OVER (PARTITION BY g) / 5)))) AS k FROM s) WHERE hi > lo),
j AS (SELECT x.g, lag::INT AS lag, x.b AS b, y.b AS c, count(*)::DOUBLE AS n FROM b x, range(0, 51) z(lag) JOIN b y ON y.g = x.g AND y.i = x.i + lag GROUP BY ALL),
l AS (SELECT g, lag, sum(n) AS n FROM j GROUP BY ALL), r AS (SELECT g, lag, b, sum(n) AS n FROM j GROUP BY ALL), c AS (SELECT g, lag, c, sum(n) AS n FROM j GROUP BY ALL),
mi AS (SELECT j.g, j.lag, sum(j.n / l.n * ln((j.n / l.n) / ((r.n / l.n) * (c.n / l.n)))) AS mi FROM j JOIN l USING (g, lag) JOIN r USING (g, lag, b) JOIN c USING (g, lag, c) GROUP BY ALL)"""

MUTUAL_INFORMATION = _MI + " SELECT g, lag, round(mi, 7) AS mutual_information FROM mi"

OPTIMAL_DELAY = (
    _MI
    + """, acf AS ("""
    + AUTOCORRELATION.strip().replace("WITH d AS", "WITH dd AS", 1).replace("FROM d GROUP BY g)", "FROM dd GROUP BY g)").replace("FROM d x", "FROM dd x").replace("JOIN d y", "JOIN dd y").replace("round(sum(x.d * y.d) / nullif(max(q), 0), 7)", "sum(x.d * y.d) / nullif(max(q), 0)")
    + """),
w AS (SELECT g, lag, mi, lag(mi) OVER u AS p, lead(mi) OVER u AS q FROM mi WINDOW u AS (PARTITION BY g ORDER BY lag))
SELECT g, (SELECT coalesce(min(lag) FILTER (mi < p AND mi <= q), arg_min(lag, mi) FILTER (lag > 0)) FROM w WHERE w.g = z.g)::INT AS mi,
  (SELECT coalesce(min(lag) FILTER (acf <= exp(-1) AND lag > 0), 50) FROM acf WHERE acf.g = z.g)::INT AS acf, (SELECT coalesce(min(lag) FILTER (acf <= 0 AND lag > 0), 50) FROM acf WHERE acf.g = z.g)::INT AS acf_zero
FROM (SELECT DISTINCT g FROM s) z"""
)

_NEIGHBOURS = """
WITH n AS (SELECT g, count(*) AS n, stddev_pop(v) AS sd FROM s GROUP BY g), e AS (SELECT g, list(v ORDER BY i) AS a FROM s GROUP BY g),
q AS (SELECT s.g, s.i, a[i + 1:i + {columns}] AS x, sd FROM s JOIN n USING (g) JOIN e USING (g) WHERE i < n - {span}),
c AS (SELECT x.g, x.i, d::INT AS d, y.i AS j, x.sd, {distance} AS r, abs(x.x[d + 1] - y.x[d + 1]) AS e FROM q x JOIN q y ON x.g = y.g AND x.i <> y.i, range(1, {columns}) z(d)),
f AS (SELECT g, i, d, any_value(sd) AS sd, min(r) AS r, arg_min(e, [r, j]) AS e FROM c GROUP BY ALL)"""

FALSE_NEIGHBOURS = (
    _NEIGHBOURS.format(columns=5, span=4, distance="sqrt(list_sum([(x.x[k] - y.x[k]) ** 2 FOR k IN range(1, d + 1)]))")
    + """, o AS (SELECT g, d, avg(CASE WHEN e > 15 * r OR sqrt(r * r + e * e) > 2 * sd THEN 1.0 ELSE 0 END) AS fraction FROM f WHERE sd > 0 GROUP BY ALL)
SELECT g, d::BIGINT AS d, round(fraction, 7) AS fraction, coalesce(min(d) FILTER (fraction <= 0.01) OVER (PARTITION BY g), arg_min(d, [fraction, d]) OVER (PARTITION BY g))::BIGINT AS dimension FROM o"""
)

CAO = (
    _NEIGHBOURS.format(columns=6, span=5, distance="list_max([abs(x.x[k] - y.x[k]) FOR k IN range(1, d + 1)])")
    + """, o AS (SELECT g, d, avg(greatest(r, e) / r) AS e, avg(e) AS z FROM f WHERE r > 0 GROUP BY ALL)
SELECT a.g, a.d::BIGINT AS d, round(b.e / a.e, 6) AS e1, round(b.z / nullif(a.z, 0), 6) AS e2 FROM o a JOIN o b ON a.g = b.g AND b.d = a.d + 1"""
)

_NEAR = """
WITH p AS (SELECT g, i, v AS a, lead(v) OVER (PARTITION BY g ORDER BY i) AS b FROM s), u AS (SELECT * FROM p WHERE b IS NOT NULL), l AS (SELECT g, max(i) AS last FROM u GROUP BY g),
f AS (SELECT x.g, x.i, y.i AS j, sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2) AS r FROM u x JOIN l ON l.g = x.g JOIN u y ON y.g = x.g AND abs(x.i - y.i) > 1 WHERE x.i <= last - {k} AND y.i <= last - {k})"""

_LATER = "JOIN u x ON x.g = f.g AND x.i = f.i + k JOIN u y ON y.g = f.g AND y.i = f.j + k"

RATE = _NEAR.format(k=5) + f""", m AS (SELECT g, i, arg_min(j, [r, j]) AS j FROM f GROUP BY ALL),
c AS (SELECT f.g, k, avg(ln(greatest(sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2), 1e-12))) AS y FROM m f, range(0, 6) z(k) {_LATER} GROUP BY ALL)
SELECT g, round(regr_slope(y, k), 5) AS rate FROM c GROUP BY g"""

KANTZ = _NEAR.format(k=4) + f""", d AS (SELECT f.g, f.i, k, avg(sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2)) AS d FROM f, range(0, 5) z(k) {_LATER} WHERE r <= 5 GROUP BY ALL)
SELECT g, k::INT AS k, round(avg(ln(greatest(d, 1e-12))), 6) AS divergence FROM d GROUP BY ALL"""

BOX = """
SELECT a.g, count(*) AS inside FROM s a JOIN s b ON a.g = b.g AND b.i = a.i + 1 WHERE a.i >= 10 AND a.v BETWEEN 10 AND 80 AND b.v BETWEEN 10 AND 90 GROUP BY a.g"""

GRID = """
WITH z AS (SELECT g, i, v, max(i) OVER (PARTITION BY g) AS last, min(v) OVER (PARTITION BY g) AS lo, max(v) OVER (PARTITION BY g) AS hi FROM s),
c AS (SELECT g, floor(i * 32 / (last + 1))::INT AS x, least(floor((v - lo) * 32 / (hi - lo)), 31)::INT AS y, count(*) AS n FROM z WHERE hi > lo GROUP BY ALL),
k AS (SELECT g, x::INT AS x, y::INT AS y FROM (SELECT DISTINCT g FROM z WHERE hi > lo), range(0, 32) a(x), range(0, 32) b(y)),
l AS (SELECT g, x, y, least(coalesce(n, 0), 3) AS label FROM k LEFT JOIN c USING (g, x, y)),
h AS (SELECT g, x // 4 AS u, y // 4 AS w, label, count(*) / 16.0::DOUBLE AS p FROM l GROUP BY ALL), e AS (SELECT g, u, w, -sum(p * ln(p)) AS h, count(*) AS k FROM h GROUP BY ALL),
b AS (SELECT g, round(avg(h), 7) AS sb, round(avg(h) FILTER (k > 1), 7) AS sbb, count(*) AS boxes, count(*) FILTER (k > 1) AS boundary_boxes FROM e GROUP BY g),
f AS (SELECT g, avg(CASE WHEN label = 0 THEN 1.0 ELSE 0 END) AS p FROM l GROUP BY g),
m AS (SELECT g, m, avg(CASE WHEN odd THEN 1.0 ELSE 0 END) AS share FROM (
  SELECT o.g, o.x, o.y, m, bool_or(o.label <> q.label) AS odd FROM l o, range(1, 4) r(m) JOIN l q ON q.g = o.g AND ((q.x = o.x AND abs(q.y - o.y) = m) OR (q.y = o.y AND abs(q.x - o.x) = m)) GROUP BY ALL) GROUP BY ALL)
SELECT b.*, round(p, 8) AS empty, round(sqrt(p * (1 - p) / 1024), 8) AS stderr, alpha FROM b JOIN f USING (g) JOIN (SELECT g, round(regr_slope(ln(share), ln(m)), 6) AS alpha FROM m WHERE share > 0 GROUP BY g) USING (g)"""


def boxes(shares: list[float]) -> str:
    """Covers of fewest boxes of 2-d delay points, for scales that are shares of the diameter: c (g, scale, x, n, boxes, q0, q1, q2)."""
    rows = ", ".join(f"({k}, {r!r}e0)" for k, r in enumerate(shares))
    return f"""
WITH p AS (SELECT g, a, b FROM (SELECT g, v AS a, lead(v) OVER (PARTITION BY g ORDER BY i) AS b FROM {{s}}) t WHERE b IS NOT NULL),
m AS (SELECT g, count(*) AS n, min(a) AS la, min(b) AS lb, sqrt(power(max(a) - min(a), 2) + power(max(b) - min(b), 2)) AS diameter FROM p GROUP BY g),
f AS (SELECT p.g, scale, shift, n, diameter * share AS eps, count(*) / n::DOUBLE AS p FROM p JOIN m USING (g), (VALUES {rows}) k(scale, share), (VALUES (0e0), (2e-1), (4e-1), (6e-1), (8e-1)) o(shift)
  WHERE diameter > 0 GROUP BY p.g, scale, shift, n, eps, floor((a - la) / (diameter * share) + shift), floor((b - lb) / (diameter * share) + shift)),
v AS (SELECT g, scale, shift, n, eps, count(*) AS boxes, -ln(count(*)) AS q0, sum(p * ln(p)) AS q1, ln(sum(p * p)) AS q2 FROM f GROUP BY g, scale, shift, n, eps),
c AS (SELECT g, scale, ln(eps) AS x, n, boxes, q0, q1, q2 FROM (SELECT *, row_number() OVER (PARTITION BY g, scale ORDER BY boxes, shift) AS r FROM v) WHERE r = 1),
l AS (SELECT g, scale, x, n, boxes, unnest([0e0, 1e0, 2e0]) AS q, unnest([q0, q1, q2]) AS y FROM c)
"""


#: Rows (g, q, x, y) to the widest run of points whose residuals are at most 1.5 times the smallest of any run, for curve c.
SCALING = """
n AS (SELECT g, q, x, y, row_number() OVER (PARTITION BY g, q ORDER BY x) - 1 AS at FROM curve),
r AS (SELECT a.g, a.q, a.at AS low, b.at AS high, b.at - a.at + 1 AS n, regr_slope(c.y, c.x) AS slope, regr_syy(c.y, c.x) AS syy, regr_sxy(c.y, c.x) AS sxy
  FROM n a JOIN n b ON a.g = b.g AND a.q = b.q AND b.at - a.at >= 4 JOIN n c ON c.g = a.g AND c.q = a.q AND c.at BETWEEN a.at AND b.at GROUP BY a.g, a.q, a.at, b.at),
s2 AS (SELECT *, sqrt(CASE WHEN syy - slope * sxy <= 1e-14 * syy THEN 0 ELSE syy - slope * sxy END / (n - 2)) AS sigma FROM r),
b AS (SELECT *, min(sigma) OVER (PARTITION BY g, q) AS least FROM s2),
w AS (SELECT *, row_number() OVER (PARTITION BY g, q ORDER BY n DESC, sigma, low) AS best FROM b WHERE sigma <= 1.5e0 * least)
"""

_RANKED = """
WITH p AS (SELECT g, i, a, b FROM (SELECT g, i, v AS a, lead(v) OVER (PARTITION BY g ORDER BY i) AS b FROM {s}) t WHERE b IS NOT NULL),
d AS (SELECT x.g, x.i, y.i AS j, sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) AS d FROM p x JOIN p y ON x.g = y.g AND abs(x.i - y.i) > 1),
r AS (SELECT g, i, j, d, row_number() OVER (PARTITION BY g, i ORDER BY d, j) AS k FROM d)
"""
NEIGHBOURS = _RANKED + "SELECT g, i, k, j, round(d, 8) AS distance FROM r WHERE k IN (1, 3)"
FIXED_MASS = _RANKED + "SELECT g, k, round(avg(ln(d)), 7) AS x, count(*) AS points FROM r WHERE k IN (1, 2, 4, 8, 16) AND d > 0 GROUP BY g, k"

LZ76_FACTORS = LZ76.replace("SELECT g, max(factors) AS factors, max(n) AS n FROM f GROUP BY g", "SELECT DISTINCT g, factors AS factor, start FROM f WHERE start < n")
_PERIOD = """
WITH y AS (SELECT g, i, v - avg(v) OVER (PARTITION BY g) AS v, count(*) OVER (PARTITION BY g) AS n FROM {s}),
c AS (SELECT x.g, y.i - x.i AS k, sum(x.v * y.v) AS s FROM y x JOIN y ON x.g = y.g AND y.i >= x.i AND y.i - x.i < least(30, x.n - 2) WHERE x.n >= 8 GROUP BY x.g, y.i - x.i),
a AS (SELECT g, k, s / sum(CASE WHEN k = 0 THEN s END) OVER (PARTITION BY g) AS value FROM c)
"""
PERIOD_CURVE = _PERIOD + "SELECT g, k, round(value, 9) AS value FROM a"
PERIOD = _PERIOD.rstrip() + """,
z AS (SELECT *, min(CASE WHEN k >= 1 AND value < 0 THEN k END) OVER (PARTITION BY g) AS start, lag(value) OVER w AS l, lead(value) OVER w AS r FROM a WINDOW w AS (PARTITION BY g ORDER BY k)),
b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY value DESC, k) AS best FROM z WHERE k >= start)
SELECT h.g, round(k + coalesce(5e-1 * (l - r) / nullif(l - 2 * value + r, 0), 0), 6) AS period FROM (SELECT DISTINCT g FROM {s}) h LEFT JOIN b ON b.g = h.g AND best = 1"""

#: Every 20 events of a type are one value of a parameter; what happens is the value by quarters.
_SWEEP = """
WITH w AS (SELECT g, CAST(i // 20 AS DOUBLE) AS p, i, CASE WHEN (i // 20) % 3 = 0 THEN i % 4 WHEN (i // 20) % 3 = 1 THEN 7 ELSE floor(v / 25) END AS v FROM {s}),
r AS (SELECT *, v - lag(v) OVER (PARTITION BY g, p ORDER BY v) AS gap, min(v) OVER (PARTITION BY g, p) AS low, max(v) OVER (PARTITION BY g, p) AS high, avg(v) OVER (PARTITION BY g, p) AS mean, row_number() OVER (PARTITION BY g, p ORDER BY i) AS at FROM w),
b AS (SELECT g, p, count(*) AS n, max(high - low) AS span, CASE WHEN count(*) = 1 OR max(high - low) <= 1e-2 * greatest(max(high - mean), max(mean - low), 1) THEN 1 ELSE 1 + count(*) FILTER (gap > 1e-2 * (high - low)) END AS branches FROM r GROUP BY g, p),
c AS (SELECT b.g, b.p, count(*) FILTER (abs(x.v - y.v) > 1e-2 * greatest(span, 1)) AS off FROM b JOIN r x ON x.g = b.g AND x.p = b.p JOIN r y ON y.g = b.g AND y.p = b.p AND y.at = x.at + branches GROUP BY b.g, b.p),
q AS (SELECT b.g, b.p AS parameter, branches, CASE WHEN branches = 1 THEN 1 WHEN branches <= 16 AND n > branches AND coalesce(off, 0) = 0 THEN branches ELSE 0 END AS period FROM b LEFT JOIN c ON c.g = b.g AND c.p = b.p)
"""
SWEEP = _SWEEP + "SELECT g, parameter, branches, period FROM q"
BIFURCATIONS = _SWEEP + "SELECT g, \"at\", before, after FROM (SELECT g, (lag(parameter) OVER w + parameter) / 2 AS \"at\", lag(period) OVER w AS before, period AS after FROM q WINDOW w AS (PARTITION BY g ORDER BY parameter)) z WHERE before <> after"
EDGES = (
    GRID[: GRID.index(",\nh AS")]
    + """,
o AS (SELECT o.g, o.x, o.y, o.label, min(sqrt((q.x - o.x) * (q.x - o.x) + (q.y - o.y) * (q.y - o.y))) AS m FROM l o LEFT JOIN l q ON q.g = o.g AND q.label <> o.label GROUP BY ALL),
p AS (SELECT g, label, least(coalesce(m, 99), x + 1, 32 - x, y + 1, 32 - y) AS d FROM o)
SELECT g, label, count(*) AS cells, round(max(d), 8) AS deepest, round(sum(d), 6) AS total FROM p GROUP BY g, label"""
)

#: What surrogates keep: sizes, means and deviations of the series itself, for each method and copy.
KEPT = """
WITH m AS (SELECT g, count(*) AS n, round(avg(v), 10) AS mean, round(stddev_pop(v), 7) AS std FROM {s} GROUP BY g)
SELECT g, method, k, n, mean, std FROM m, (VALUES ('shuffle'), ('fourier'), ('aaft'), ('iaaft')) a(method), (VALUES (1), (2)) b(k)"""

LOCAL_SLOPES = """,
d AS (SELECT g, scale, x - lag(x) OVER w AS a, lead(x) OVER w - x AS b, (y - lag(y) OVER w) / (x - lag(x) OVER w) AS da, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS db FROM l WHERE q = 2 WINDOW w AS (PARTITION BY g ORDER BY x))
SELECT g, scale, round(coalesce((b * da + a * db) / (a + b), da, db), 7) AS slope FROM d"""

WADA = (
    GRID[: GRID.index(",\nh AS")]
    + """,
e AS (SELECT DISTINCT o.g, o.x, o.y FROM l o JOIN l q ON q.g = o.g AND abs(q.x - o.x) + abs(q.y - o.y) = 1 AND q.label <> o.label),
n AS (SELECT g, count(DISTINCT label) AS basins FROM l WHERE label >= 1 GROUP BY g),
v AS (SELECT e.g, e.x, e.y, radius, count(DISTINCT q.label) AS met FROM e, (VALUES (1), (2)) r(radius), l q WHERE q.g = e.g AND abs(q.x - e.x) <= radius AND abs(q.y - e.y) <= radius AND q.label >= 1 GROUP BY ALL),
f AS (SELECT g, radius, basins, CASE WHEN basins >= 3 THEN count(*) FILTER (met = basins) / (SELECT count(*) FROM e WHERE e.g = v.g)::DOUBLE ELSE 0 END AS fraction FROM v JOIN n USING (g) GROUP BY g, radius, basins)
SELECT g, radius, basins, round(fraction, 8) AS fraction FROM f"""
)

_CLOUDS = """c AS (SELECT g, i // 4 AS label, count(*) AS points, avg(a) AS x, avg(b) AS y FROM (
  SELECT g, i, v AS a, lead(v) OVER (PARTITION BY g ORDER BY i) AS b FROM s) WHERE b IS NOT NULL GROUP BY g, i // 4),
l AS (SELECT p.g, p.label AS a, q.label AS b FROM c p JOIN c q ON p.g = q.g AND sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) <= 9),
r AS (SELECT * FROM l UNION SELECT r.g, r.a, l.b FROM r JOIN l ON r.g = l.g AND r.b = l.a),
m AS (SELECT g, a AS label, min(b) AS merged FROM r GROUP BY g, a)"""

MERGED = f"WITH RECURSIVE {_CLOUDS} SELECT g, label, merged FROM m"

POOLED = f"WITH RECURSIVE {_CLOUDS} SELECT g, merged AS label, sum(points)::BIGINT AS points, round(sum(x * points) / sum(points), 7) AS x0, round(sum(y * points) / sum(points), 7) AS x1 FROM c JOIN m USING (g, label) GROUP BY g, merged"

THINNED = """
WITH RECURSIVE e AS (SELECT g, i, a, b FROM (SELECT g, i, v AS a, lead(v) OVER (PARTITION BY g ORDER BY i) AS b FROM s) WHERE b IS NOT NULL),
k(g, i, kept) AS (
  SELECT g, i, [{'i': i, 'a': a, 'b': b}] FROM e WHERE i = 0
  UNION ALL
  SELECT e.g, e.i, CASE WHEN len(list_filter(k.kept, lambda z: sqrt((z.a - e.a) ** 2 + (z.b - e.b) ** 2) < 12)) > 0 THEN k.kept ELSE list_append(k.kept, {'i': e.i, 'a': e.a, 'b': e.b}) END
  FROM k JOIN e ON e.g = k.g AND e.i = k.i + 1)
SELECT g, unnest(arg_max(kept, i)).i AS i FROM k GROUP BY g"""

_TRACKED = """t AS (SELECT g, i // 12 AS k, (i % 12) // 4 AS label, avg(v) AS x, sum(v) AS w FROM s GROUP BY ALL),
f AS (SELECT g, k, label, x, round(w / t, 9) AS fraction FROM (SELECT *, sum(w) OVER (PARTITION BY g, k) AS t FROM t) WHERE t <> 0),
h AS (SELECT * FROM f WHERE fraction >= 0.15),
e AS (SELECT q.g, q.k, list({'d': abs(p.x - q.x), 'p': p.label, 'c': q.label} ORDER BY abs(p.x - q.x), p.label, q.label) AS z FROM h p JOIN h q ON p.g = q.g AND q.k = p.k + 1 WHERE abs(p.x - q.x) <= 20 GROUP BY q.g, q.k),
greedy(g, k, z, p, c) AS (
  SELECT g, k, z, NULL::BIGINT, NULL::BIGINT FROM e
  UNION ALL
  SELECT g, k, list_filter(z, lambda o: o.p <> z[1].p AND o.c <> z[1].c), z[1].p, z[1].c FROM greedy WHERE len(z) > 0),
link AS (SELECT g, k, p, c FROM greedy WHERE p IS NOT NULL),
head AS (SELECT g, k, label, row_number() OVER (PARTITION BY g ORDER BY k, label) AS id FROM h WHERE NOT EXISTS (SELECT 1 FROM link WHERE link.g = h.g AND link.k = h.k AND link.c = h.label)),
walk(g, k, label, id) AS (
  SELECT g, k, label, id FROM head
  UNION ALL
  SELECT l.g, l.k, l.c, w.id FROM walk w JOIN link l ON l.g = w.g AND l.k = w.k + 1 AND l.p = w.label),
tracked AS (SELECT v.g, v.k::DOUBLE AS parameter, w.label, w.id, h.fraction FROM (SELECT DISTINCT g, k FROM f) v LEFT JOIN walk w ON w.g = v.g AND w.k = v.k LEFT JOIN h ON h.g = w.g AND h.k = w.k AND h.label = w.label)"""

TRACKED = f"WITH RECURSIVE {_TRACKED} SELECT g, parameter, label, id, fraction FROM tracked"

TIPPING = f"""WITH RECURSIVE {_TRACKED},
wide AS (SELECT i.g, i.id, v.parameter, coalesce(t.fraction, 0) AS f, lag(coalesce(t.fraction, 0)) OVER (PARTITION BY i.g, i.id ORDER BY v.parameter) AS was
  FROM (SELECT DISTINCT g, id FROM tracked WHERE id IS NOT NULL) i JOIN (SELECT DISTINCT g, parameter FROM tracked) v ON v.g = i.g LEFT JOIN tracked t ON t.g = i.g AND t.id = i.id AND t.parameter = v.parameter)
SELECT g, parameter AS value, id, CASE WHEN f > was THEN 'appear' ELSE 'disappear' END AS kind, was AS before, f AS after FROM wide WHERE was IS NOT NULL AND (was > 0.3) <> (f > 0.3)"""

_SCALED = """e AS (SELECT g, i, a / coalesce(nullif(stddev_samp(a) OVER (PARTITION BY g), 0), 1) AS a, b / coalesce(nullif(stddev_samp(b) OVER (PARTITION BY g), 0), 1) AS b, count(*) OVER (PARTITION BY g) AS n FROM (
  SELECT g, i, v AS a, lead(v) OVER (PARTITION BY g ORDER BY i) AS b FROM s) WHERE b IS NOT NULL)"""

# the bow is twice the triangle's area over its base
_BOW = "abs((r.a - p.a) * (q.b - p.b) - (r.b - p.b) * (q.a - p.a)) / nullif(sqrt((r.a - p.a) ** 2 + (r.b - p.b) ** 2), 0)"

SAGITTA = f"""WITH {_SCALED}
SELECT q.g, q.i, round(coalesce({_BOW} / sqrt((r.a - p.a) ** 2 + (r.b - p.b) ** 2), 0), 7) AS sagitta FROM e q LEFT JOIN e p ON p.g = q.g AND p.i = q.i - 1 LEFT JOIN e r ON r.g = q.g AND r.i = q.i + 1"""

SAGITTA_STEP = f"""WITH RECURSIVE {_SCALED},
size AS (SELECT g, n, greatest(least((n - 1) // 2, (n - 1) // 4), 1) AS top FROM e GROUP BY g, n),
b AS (SELECT q.g, z.k, {_BOW} AS bow, sqrt((r.a - p.a) ** 2 + (r.b - p.b) ** 2) AS chord FROM size JOIN e q ON q.g = size.g, LATERAL (SELECT unnest(range(1, top + 1)) AS k) z
  JOIN e p ON p.g = q.g AND p.i = q.i - z.k JOIN e r ON r.g = q.g AND r.i = q.i + z.k WHERE q.i % z.k = 0 AND size.n >= 5),
m AS MATERIALIZED (SELECT g, k, coalesce(quantile_cont(bow, 0.75) / CASE WHEN quantile_cont(chord, 0.5) > 1e-12 THEN quantile_cont(chord, 0.5) ELSE 1 END, 0) AS value FROM b GROUP BY g, k),
grow(k) AS (SELECT 1::BIGINT UNION ALL SELECT greatest(floor(k * 1.5)::BIGINT, k + 1) FROM grow WHERE k < (SELECT max(top) FROM size)),
fails AS (SELECT size.g, min(grow.k) AS fail FROM size JOIN m USING (g) JOIN grow ON grow.k = m.k WHERE m.value > 0.9 GROUP BY size.g),
start AS (SELECT size.g, max(grow.k) AS ok, any_value(coalesce(fail, top + 1)) AS fail FROM size LEFT JOIN fails USING (g) JOIN grow ON grow.k <= top AND (fail IS NULL OR grow.k < fail) WHERE size.n >= 5 GROUP BY size.g),
halve(g, ok, fail) AS (
  SELECT g, ok, fail FROM start
  UNION ALL
  SELECT h.g, CASE WHEN m.value <= 0.9 THEN m.k ELSE h.ok END, CASE WHEN m.value <= 0.9 THEN h.fail ELSE m.k END FROM halve h JOIN m ON m.g = h.g AND m.k = (h.ok + h.fail) // 2 WHERE h.fail - h.ok > 1),
found AS (SELECT g, max(ok) AS ok FROM halve GROUP BY g)
SELECT size.g, coalesce(ok, 1) AS stride, 5e-1 * coalesce(ok, 1) AS delta_t, round(m.value, 6) AS value, ok IS NOT NULL AS fits FROM size LEFT JOIN found USING (g) LEFT JOIN m ON m.g = size.g AND m.k = coalesce(ok, 1)"""
