"""Queries on peaks, spacing, imputation and mobility as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import peaks as K
from ..operators import samples as P
from .queries import query, rounded


def peaks_sql(name: str, lane: str, distance: int, least: str, keys: str = "trace_id, ch") -> str:
    """Common table expressions that end in `name` (keys, pos, amp, prominence): the peaks of `lane` (keys, i, y). The
    expression `least` knows each lane's `top` and `p90`. By definition: runs of equal samples, a greedy choice in the order
    of heights, and for each peak all samples of its lane."""
    on = " AND ".join(f"p.{k.strip()} = l.{k.strip()}" for k in keys.split(","))
    of = lambda x: ", ".join(f"{x}.{k.strip()}" for k in keys.split(","))
    greedy = "" if distance <= 2 else f"""{name}_o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY amp DESC, pos DESC) AS r FROM {name}_c),
{name}_k AS (SELECT {keys}, r, [pos] AS kept FROM {name}_o WHERE r = 1 UNION ALL
 SELECT {of("l")}, l.r, CASE WHEN len(list_filter(p.kept, lambda x: abs(x - l.pos) < {distance})) = 0 THEN list_append(p.kept, l.pos) ELSE p.kept END FROM {name}_k p JOIN {name}_o l ON {on} AND l.r = p.r + 1),
{name}_f AS (SELECT p.* FROM {name}_c p JOIN (SELECT {keys}, max_by(kept, r) AS kept FROM {name}_k GROUP BY {keys}) l ON {on} AND list_contains(l.kept, p.pos)),"""
    found = f"{name}_c" if distance <= 2 else f"{name}_f"
    return f"""{name}_b AS (SELECT *, lag(y) OVER (PARTITION BY {keys} ORDER BY i) AS b FROM {lane}),
{name}_n AS (SELECT *, sum(CASE WHEN b IS NULL OR b <> y THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY i) AS run FROM {name}_b),
{name}_u AS (SELECT {keys}, run, min(i) AS a, max(i) AS z, any_value(y) AS y FROM {name}_n GROUP BY {keys}, run),
{name}_c AS (SELECT {keys}, (a + z) // 2 AS pos, y AS amp FROM (SELECT *, lag(y) OVER w AS b, lead(y) OVER w AS f FROM {name}_u WINDOW w AS (PARTITION BY {keys} ORDER BY run)) WHERE y > b AND y > f),
{greedy}
{name}_h AS (SELECT {of("p")}, pos, amp, coalesce(max(l.i) FILTER (WHERE l.i < pos AND l.y > amp), -1) AS lo, coalesce(min(l.i) FILTER (WHERE l.i > pos AND l.y > amp), 1000000000) AS hi FROM {found} p JOIN {lane} l ON {on} GROUP BY ALL),
{name}_p AS (SELECT {of("p")}, pos, amp, amp - greatest(min(l.y) FILTER (WHERE l.i > lo AND l.i <= pos), min(l.y) FILTER (WHERE l.i < hi AND l.i >= pos)) AS prominence FROM {name}_h p JOIN {lane} l ON {on} GROUP BY {of('p')}, pos, amp),
{name}_t AS (SELECT {keys}, max(y) AS top, quantile_cont(y, 0.9) AS p90 FROM {lane} GROUP BY {keys}),
{name} AS (SELECT p.* FROM {name}_p p JOIN {name}_t l ON {on} WHERE prominence >= {least})"""


_OUT = "SELECT trace_id, CAST(ch AS INT) AS ch, CAST(pos AS BIGINT) AS pos, round(amp, 6) AS amp, round(prominence, 6) AS prominence FROM pk"


@query("peaks_prominence", f"WITH RECURSIVE {A.SQL_LONG}, {peaks_sql('pk', 'long', 4, 'greatest(0.3 * top, 1e-6)')} {_OUT}")
def peaks_prominence(spark, sf_dir):
    return rounded(K.plain_peaks(P.long(A.samples(spark, sf_dir)), 0.3, 4))


_NORMAL = """env AS (SELECT *, greatest(max(y) OVER (PARTITION BY trace_id, ch ORDER BY i ROWS BETWEEN 150 PRECEDING AND 149 FOLLOWING), 0.03 * max(y) OVER (PARTITION BY trace_id, ch)) AS e FROM long),
norm AS (SELECT trace_id, ch, i, CASE WHEN e > 0 THEN y / e ELSE 0 END AS y FROM env)"""


@query("adaptive_peaks", f"WITH RECURSIVE {A.SQL_LONG}, {_NORMAL}, {peaks_sql('pk', 'norm', 6, '0.3')} {_OUT}")
def adaptive_peaks(spark, sf_dir):
    return rounded(K.adaptive_peaks(P.long(A.samples(spark, sf_dir)), 0.3, 6))


def polynomial_weight(n: str, j: str, t: str, cubic: bool = True) -> str:
    """The weight of place j in a window of n for the value at place t of its least-squares polynomial of degree 3 (2 without
    the cubic part), by orthogonal polynomials on equally spaced points."""
    x, z = (f"({p} - ({n} - 1) / 2.0)" for p in (j, t))
    square, third = f"(({n} * {n} - 1) / 12.0)", f"((3.0 * {n} * {n} - 7) / 20)"
    parts = [f"1.0 / {n}", f"12.0 * {x} * {z} / ({n} * ({n} * {n} - 1.0))", f"180.0 * ({x} * {x} - {square}) * ({z} * {z} - {square}) / ({n} * ({n} * {n} - 1.0) * ({n} * {n} - 4))"]
    last = f"2800.0 * ({x} * {x} * {x} - {x} * {third}) * ({z} * {z} * {z} - {z} * {third}) / ({n} * ({n} * {n} - 1.0) * ({n} * {n} - 4) * ({n} * {n} - 9))"
    return " + ".join(parts + ([f"CASE WHEN {n} > 3 THEN {last} ELSE 0 END"] if cubic else []))


#: Places of sure calls: samples where the first channel is near its largest value.
_SURE = "sure AS (SELECT trace_id, i AS pos FROM samples WHERE g >= 45)"


def _sure(spark, sf_dir):
    return A.samples(spark, sf_dir).filter("g >= 45").select("trace_id", F.col("i").alias("pos"))


_MODEL = f"""gap AS (SELECT trace_id, row_number() OVER w - 1 AS k, lead(pos) OVER w - pos AS d, (pos + lead(pos) OVER w) / 2.0 AS mid, count(*) OVER (PARTITION BY trace_id) - 1 AS m, max(pos) OVER (PARTITION BY trace_id) AS last FROM sure WINDOW w AS (PARTITION BY trace_id ORDER BY pos)),
wide AS (SELECT *, CAST(greatest(3, least(21, m - 1)) AS BIGINT) AS n FROM gap WHERE d IS NOT NULL AND m >= 5),
spot AS (SELECT *, CASE WHEN k < n // 2 THEN 0 WHEN k >= m - n // 2 THEN m - n ELSE k - n // 2 END AS s, CASE WHEN k < n // 2 THEN k WHEN k >= m - n // 2 THEN k - m + n ELSE (n - 1) / 2.0 END AS t FROM wide),
smooth AS (SELECT a.trace_id, a.k, any_value(a.mid) AS mid, any_value(a.last) AS last, sum(b.d * ({polynomial_weight("a.n", "(b.k - a.s)", "a.t")})) AS v FROM spot a JOIN spot b ON b.trace_id = a.trace_id AND b.k BETWEEN a.s AND a.s + a.n - 1 GROUP BY a.trace_id, a.k),
knot AS (SELECT *, max(v) OVER (PARTITION BY trace_id ORDER BY k) AS due, max(v) OVER (PARTITION BY trace_id) AS final, lead(mid) OVER (PARTITION BY trace_id ORDER BY k) AS mid2 FROM smooth),
span AS (SELECT *, lead(due) OVER (PARTITION BY trace_id ORDER BY k) AS due2 FROM knot),
grid AS (SELECT trace_id, unnest(range(CAST(any_value(last) + floor(any_value(final)) * 5 + 1 AS BIGINT))) AS i FROM knot GROUP BY trace_id),
model AS (SELECT g.trace_id, g.i, CASE WHEN g.i <= s.mid OR s.mid2 IS NULL THEN s.due ELSE (s.due2 - s.due) / (s.mid2 - s.mid) * (g.i - s.mid) + s.due END AS due
 FROM grid g JOIN span s ON s.trace_id = g.trace_id AND (s.k = 0 OR g.i >= s.mid) AND (s.mid2 IS NULL OR g.i < s.mid2))"""


@query("spacing_model", f"WITH {A.SQL_SAMPLES}, {_SURE}, {_MODEL} SELECT trace_id, i, round(due, 6) AS due FROM model")
def spacing_model(spark, sf_dir):
    return rounded(K.spacing_model(K.spacing_knots(_sure(spark, sf_dir))))


_IMPUTED = """size AS (SELECT trace_id, max(i) AS last, max(greatest(g, a, t, c)) AS top FROM samples GROUP BY trace_id),
hole AS (SELECT *, lead(pos) OVER (PARTITION BY trace_id ORDER BY pos) AS nxt, count(*) OVER (PARTITION BY trace_id) AS many FROM sure),
edge AS (SELECT trace_id, max(i) AS i FROM model GROUP BY trace_id),
due AS (SELECT h.trace_id, h.pos, h.nxt, m.due FROM hole h JOIN edge USING (trace_id) JOIN model m ON m.trace_id = h.trace_id AND m.i = least(h.pos, edge.i) WHERE nxt IS NOT NULL AND many >= 5),
want AS (SELECT *, CAST(round_even((nxt - pos) / due, 0) AS INT) - 1 AS missing FROM due WHERE due > 0 AND (nxt - pos) / due >= 1.6),
mid AS (SELECT w.trace_id, pos AS after, k, due, top, last, greatest(b, least(CAST(floor(pos + k * due) AS BIGINT), last)) AS mid, greatest(3, CAST(floor(due * 0.28) AS BIGINT)) AS half, b
 FROM want w JOIN size USING (trace_id) JOIN blob USING (trace_id), unnest(range(1, missing + 1)) AS r(k) WHERE missing BETWEEN 1 AND 3 AND top > 0),
inside AS (SELECT m.trace_id, after, k, s.i, greatest(g, a, t, c) AS y, due, top FROM mid m JOIN samples s ON s.trace_id = m.trace_id AND s.i BETWEEN greatest(b, mid - half) AND least(last, mid + half)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY trace_id, after, k ORDER BY i) AS run FROM (SELECT *, CASE WHEN y = lag(y) OVER (PARTITION BY trace_id, after, k ORDER BY i) THEN 0 ELSE 1 END AS new FROM inside)),
flat AS (SELECT trace_id, after, k, run, (min(i) + max(i)) // 2 AS i, any_value(y) AS y, any_value(due) AS due, any_value(top) AS top FROM runs GROUP BY ALL),
best AS (SELECT trace_id, after, k, any_value(due) AS due, any_value(top) AS top, min({'m': -y, 'i': i}) AS b FROM (SELECT *, lag(y) OVER w AS b, lead(y) OVER w AS f FROM flat WINDOW w AS (PARTITION BY trace_id, after, k ORDER BY run)) WHERE y > b AND y > f GROUP BY trace_id, after, k),
fill AS (SELECT trace_id, after, k, b.i AS pos, -b.m AS amplitude FROM best x WHERE -b.m >= 0.03 * top AND NOT EXISTS (SELECT 1 FROM sure c WHERE c.trace_id = x.trace_id AND abs(c.pos - x.b.i) < 0.4 * x.due))"""


@query("imputed_calls", f"""WITH {A.SQL_SAMPLES}, {_SURE}, {_MODEL}, blob AS (SELECT DISTINCT trace_id, 0 AS b FROM samples), {_IMPUTED}
SELECT trace_id, after, CAST(k AS INT) AS k, pos, CAST(list_position([g, a, t, c], greatest(g, a, t, c)) - 1 AS INT) AS channel, amplitude FROM fill JOIN samples USING (trace_id) WHERE samples.i = fill.pos""")
def imputed_calls(spark, sf_dir):
    sure = _sure(spark, sf_dir)
    return K.imputed_calls(sure, K.spacing_model(K.spacing_knots(sure)), A.samples(spark, sf_dir))


_LAGS = """total AS (SELECT trace_id, i, g + a + t + c AS y, max(i) OVER (PARTITION BY trace_id) + 1 AS n FROM samples),
across AS (SELECT l.trace_id, l.ch, l.i - s.i AS lag, any_value(s.n) AS n, sum(l.y * s.y) AS v FROM long l JOIN total s USING (trace_id) GROUP BY ALL),
lags AS (SELECT trace_id, CAST(ch AS INT) AS ch, CAST(any_value(n) AS INT) AS n, CAST(greatest(floor(-any_value(n) / 10), least(floor(any_value(n) / 10), min({'m': -v, 'lag': lag}).lag)) AS INT) AS lag FROM across GROUP BY trace_id, ch)"""


@query("mobility_lags", f"WITH {A.SQL_LONG}, {_LAGS} SELECT * FROM lags")
def mobility_lags(spark, sf_dir):
    return K.mobility_lags(A.samples(spark, sf_dir))


@query("mobility_pairs", f"""WITH RECURSIVE {A.SQL_LONG}, {_LAGS}, shifted AS (SELECT l.trace_id, l.ch, l.i, coalesce(m.y, 0) AS y FROM long l JOIN lags USING (trace_id, ch) LEFT JOIN long m ON m.trace_id = l.trace_id AND m.ch = l.ch AND m.i = l.i + lags.lag),
{peaks_sql('mk', 'total', 1, '0.3 * p90', 'trace_id')}, {peaks_sql('pk', 'shifted', 1, '0.3 * p90')},
ranked AS MATERIALIZED (SELECT trace_id, pos, row_number() OVER (PARTITION BY trace_id ORDER BY pos) AS r, count(*) OVER (PARTITION BY trace_id) AS n FROM mk),
lists AS MATERIALIZED (SELECT trace_id, ch, list(pos ORDER BY pos) AS free FROM pk GROUP BY trace_id, ch HAVING count(*) >= 4),
walk AS (SELECT trace_id, ch, CAST(0 AS BIGINT) AS r, free, CAST(NULL AS BIGINT) AS mark, CAST(NULL AS BIGINT) AS taken FROM lists
 UNION ALL SELECT trace_id, ch, r, list_filter(free, lambda x: x > mark - 20 AND x <> coalesce(near.p, -1)), mark, near.p FROM (
  SELECT w.trace_id, w.ch, m.r, w.free, m.pos AS mark, list_min(list_transform(list_filter(w.free, lambda x: abs(x - m.pos) < 20), lambda x: {{'d': abs(x - m.pos), 'p': x}})) AS near
  FROM walk w JOIN ranked m ON m.trace_id = w.trace_id AND m.r = w.r + 1 WHERE m.n >= 4))
SELECT trace_id, CAST(ch AS INT) AS ch, CAST(mark AS BIGINT) AS mark, CAST(taken - mark AS BIGINT) AS "offset" FROM walk WHERE taken IS NOT NULL""")
def mobility_pairs(spark, sf_dir):
    samples = A.samples(spark, sf_dir)
    return K.mobility_pairs(*K.mobility_peaks(samples, K.mobility_lags(samples), 0.3))
