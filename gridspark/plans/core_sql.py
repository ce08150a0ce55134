"""SQL for the queries p1_ to p6_, written independently of the operators."""

_PERIOD = "CAST(year(x) AS INT) * 92 + CAST(floor((dayofyear(x) - 1) / 4) AS INT)"


def _start(p: str) -> str:
    return f"(make_date(CAST(floor({p} / 92) AS INT), 1, 1) + CAST(({p} - 92 * CAST(floor({p} / 92) AS INT)) * 4 AS INT))"


def _end(p: str) -> str:
    return f"least({_start(p)} + 4, make_date(CAST(floor({p} / 92) AS INT) + 1, 1, 1))"


_GRID = f"""
WITH r AS (
  SELECT iy, ix, time, {_PERIOD.replace('x', 'time')} AS q,
         CASE WHEN LAI_flag = 1 AND isfinite(CAST(LAI_norm AS DOUBLE)) THEN CAST(LAI_norm AS DOUBLE) END AS y
  FROM lai_readings WHERE time IS NOT NULL),
span AS (SELECT iy, ix, min(q) AS lo, max(q) AS hi FROM r GROUP BY iy, ix),
spine AS (SELECT iy, ix, unnest(generate_series(lo, hi)) AS p FROM span),
once AS (SELECT iy, ix, q, date_diff('day', DATE '1970-01-01', CAST(time AS DATE)) + (hour(time) * 3600 + minute(time) * 60 + microsecond(time) /
    1e6::DOUBLE) / 86400.0::DOUBLE AS t, max(y) AS y
         FROM r WHERE y IS NOT NULL GROUP BY ALL),
mid AS (SELECT DISTINCT p, (date_diff('day', DATE '1970-01-01', {_start('p')}) + date_diff('day', DATE '1970-01-01', {_end('p')})) / 2.0::DOUBLE AS c
    FROM spine),
pairs AS (SELECT s.iy, s.ix, s.p, o.q, o.y, (o.t - m.c) / 14.0::DOUBLE AS x
          FROM spine s JOIN mid m USING (p) LEFT JOIN once o ON o.iy = s.iy AND o.ix = s.ix AND o.t BETWEEN m.c - 14 AND m.c + 14),
w AS (SELECT *, greatest(1 - x * x, 0) AS w FROM pairs),
g AS (SELECT iy, ix, p, coalesce(sum(CASE WHEN q = p THEN 1 ELSE 0 END), 0)::BIGINT AS n, sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) AS s2,
             sum(w * w) AS ww, sum(w * y) AS r0, sum(w * x * y) AS r1 FROM w GROUP BY iy, ix, p),
f AS (SELECT *, CASE WHEN ww > 0 THEN s0 * s0 / ww ELSE 0 END AS support, s0 * s2 - s1 * s1 AS det FROM g)
"""

_MISSING = {
    "prcp": "(prcp IS NULL OR NOT isfinite(prcp) OR prcp < 0 OR prcp > 2000)",
    "tmax": "(tmax IS NULL OR NOT isfinite(tmax) OR tmax < -90 OR tmax > 60)",
    "temp_flag": "(temp_flag IS NULL OR temp_flag NOT IN (0, 1))",
    "prcp_flag": "(prcp_flag IS NULL OR prcp_flag NOT IN (0, 1))",
}
_P2 = f"""
WITH d AS (SELECT iy, ix, time, max(CASE WHEN NOT {_MISSING['prcp']} THEN CAST(prcp AS DOUBLE) END) AS v FROM weather_daily GROUP BY iy, ix, time),
span AS (SELECT iy, ix, min(time) AS lo, max(time) AS hi FROM d GROUP BY iy, ix),
days AS (SELECT iy, ix, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
f AS (SELECT a.iy, a.ix, a.day, b.time IS NOT NULL AS has_row, b.v FROM days a LEFT JOIN d b ON b.iy = a.iy AND b.ix = a.ix AND b.time = a.day),
r AS (SELECT iy, ix, day, has_row,
    {', '.join(f"coalesce(sum(v) OVER w{w}, 0) AS total_{w}, CAST(count(v) OVER w{w} AS INT) AS n_{w}" for w in (14, 30, 60))}
      FROM f WINDOW {', '.join(f"w{w} AS (PARTITION BY iy, ix ORDER BY day ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in (14, 30, 60))})
"""
_RIGHT = "CASE WHEN n_{w} < {w} / 2.0 THEN 0 ELSE (total_{w} - (SELECT mean FROM norm_stats WHERE var = 'prcp_{w}d_norm')) / (SELECT std FROM norm_stats WHERE var = 'prcp_{w}d_norm') END"

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'


def _cell(n: int) -> str:
    x = f"regexp_extract(line, '^(?:{_FIELD},){{{n}}}({_FIELD})', 1)"
    return f"CASE WHEN {x} LIKE '\"%' THEN replace(substr({x}, 2, length({x}) - 2), '\"\"', '\"') ELSE {x} END"


_DEC = "'^-?[0-9]+(\\.[0-9]+)?$'"
_P5 = f"""
WITH c AS (SELECT line_id, coalesce(line, '') AS line, coalesce(lower(trim(file_name)) = 'stations.txt', false) AS fixed FROM raw_records),
k AS (SELECT *, regexp_matches(line, '^{_FIELD}(?:,{_FIELD})*$') AS sound,
             length(regexp_replace(regexp_replace(line, '"(?:[^"]|"")*"', 'Q', 'g'), '[^,]', '', 'g')) + 1 AS n, {_cell(1)} AS dt, {_cell(3)} AS val
    FROM c),
e AS (SELECT line_id, CASE
        WHEN fixed AND length(line) < 30 THEN 'columns'
        WHEN fixed AND NOT (regexp_matches(trim(substr(line, 12, 9), ' '), {_DEC}) AND regexp_matches(trim(substr(line, 21, 10), ' '), {_DEC})) THEN
    'coordinates'
        WHEN fixed AND NOT (trim(substr(line, 31, 7), ' ') = '' OR regexp_matches(trim(substr(line, 31, 7), ' '), {_DEC})) THEN 'elev'
        WHEN fixed THEN NULL
        WHEN NOT sound THEN 'quoting' WHEN n <> 8 THEN 'columns'
        WHEN NOT (regexp_matches(dt, '^[0-9]{{8}}$') AND try_strptime(dt, '%Y%m%d') IS NOT NULL) THEN 'date'
        WHEN NOT regexp_matches(trim(val, ' '), {_DEC}) THEN 'value' END AS reason FROM k)
"""
_P6 = " UNION ALL ".join(f"""
SELECT DISTINCT m.iy, m.ix, strftime(m.time, '%Y-%m-%d') AS day, '{f}' AS field
FROM weather_daily m WHERE {c}
AND NOT EXISTS (SELECT 1 FROM weather_daily s WHERE s.iy = m.iy AND s.ix = m.ix AND s.time = m.time AND NOT {c.replace(f, 's.' + f)})
AND (EXISTS (SELECT 1 FROM weather_daily v WHERE v.time = m.time AND v.iy BETWEEN m.iy - 2 AND m.iy + 2 AND v.ix BETWEEN m.ix - 2 AND m.ix + 2 AND NOT
    {c.replace(f, 'v.' + f)})
  OR EXISTS (SELECT 1 FROM weather_daily v WHERE v.iy = m.iy AND v.ix = m.ix AND v.time BETWEEN m.time - 3 AND m.time + 3 AND NOT
    {c.replace(f, 'v.' + f)}))
""" for f, c in _MISSING.items())



def _p6_observed() -> str:
    """Masks by neighbourhood counts, observed values as they are."""
    once = ", ".join(f"max(CASE WHEN NOT {c} THEN CAST({f} AS DOUBLE) END) AS {f}" for f, c in _MISSING.items())
    near = ", ".join(f"""n_{f} AS (SELECT m.iy, m.ix, m.time, 1 AS f_{f} FROM o m WHERE m.{f} IS NULL AND (
        EXISTS (SELECT 1 FROM o v WHERE v.time = m.time AND v.iy BETWEEN m.iy - 2 AND m.iy + 2 AND v.ix BETWEEN m.ix - 2 AND m.ix + 2 AND v.{f} IS NOT
    NULL)
        OR EXISTS (SELECT 1 FROM o v WHERE v.iy = m.iy AND v.ix = m.ix AND v.time BETWEEN m.time - 3 AND m.time + 3 AND v.{f} IS NOT NULL)))""" for f in _MISSING)
    joins = " ".join(f"LEFT JOIN n_{f} USING (iy, ix, time)" for f in _MISSING)
    return f"""WITH o AS (SELECT iy, ix, time, {once} FROM weather_daily GROUP BY 1, 2, 3), {near}
    SELECT o.iy, o.ix, o.time, {", ".join(f"round(o.{f}, 4) AS {f}, f_{f} IS NOT NULL AS {f}_filled" for f in _MISSING)} FROM o {joins}"""


def _p6_numeric(f: str, low: float, high: float) -> str:
    """y = mu + day effect + cell effect, both shrunk by variance ratios, step by step."""
    return f"""(WITH raw AS (SELECT iy, ix, time, CAST({f} AS DOUBLE) AS v FROM weather_daily WHERE NOT {_MISSING[f]}),
    c AS (SELECT sum(n * w) / sum(n) AS within FROM (SELECT count(*) AS n, var_pop(v) AS w FROM raw GROUP BY iy, ix)),
    t AS (SELECT sum(n * w) / sum(n) AS within FROM (SELECT count(*) AS n, var_pop(v) AS w FROM raw GROUP BY time)),
    m AS (SELECT avg(v) AS mu, var_pop(v) AS total FROM raw),
    k AS (SELECT mu, total, greatest(total - c.within, 0) AS cell, greatest(total - t.within, 0) AS day FROM m, c, t),
    l AS (SELECT mu, least(rest / greatest(cell, 1e-12), 1e6) AS lc, least(rest / greatest(day, 1e-12), 1e6) AS ld
          FROM (SELECT *, greatest(total - cell - day, 1e-6 * greatest(total, 1e-12), 1e-12) AS rest FROM k)),
    o AS (SELECT iy, ix, time, max(v) AS v FROM (SELECT iy, ix, time, NULL::DOUBLE AS v FROM weather_daily UNION ALL SELECT * FROM raw) GROUP BY 1, 2,
    3),
    gone AS (SELECT iy, ix, time FROM o WHERE v IS NULL),
    near AS (SELECT DISTINCT iy, ix, CAST(time + g.s AS DATE) AS day FROM gone, (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS s) g),
    e AS (SELECT n.iy, n.ix, n.day, sum(o.v - l.mu) / (count(*) + any_value(l.ld)) AS effect, count(*) AS n
          FROM near n JOIN o ON o.time = n.day AND o.iy BETWEEN n.iy - 2 AND n.iy + 2 AND o.ix BETWEEN n.ix - 2 AND n.ix + 2 CROSS JOIN l WHERE o.v IS
    NOT NULL GROUP BY 1, 2, 3),
    d AS (SELECT g.iy, g.ix, g.time, any_value(CASE WHEN e.day = g.time THEN e.effect END) AS own, coalesce(avg(e.effect), 0) AS around,
    coalesce(any_value(CASE WHEN e.day = g.time THEN e.n END), 0) AS nd
          FROM gone g LEFT JOIN e ON e.iy = g.iy AND e.ix = g.ix AND e.day BETWEEN g.time - 3 AND g.time + 3 GROUP BY 1, 2, 3),
    h AS (SELECT g.iy, g.ix, g.time, count(o.v) AS nc, coalesce(sum(o.v - l.mu - e.effect), 0) AS s
          FROM gone g LEFT JOIN o ON o.iy = g.iy AND o.ix = g.ix AND o.time BETWEEN g.time - 3 AND g.time + 3 AND o.v IS NOT NULL
          LEFT JOIN e ON e.iy = o.iy AND e.ix = o.ix AND e.day = o.time CROSS JOIN l GROUP BY 1, 2, 3)
    SELECT d.iy, d.ix, d.time, '{f}' AS field, round(greatest(least(l.mu + coalesce(d.own, d.around) + h.s / (h.nc + l.lc), {high}), {low}), 5) AS
    value
    FROM d JOIN h USING (iy, ix, time) CROSS JOIN l WHERE d.nd + h.nc > 0)"""


_P3 = """
WITH s AS (SELECT DISTINCT station_id, lat, lon FROM stations WHERE isfinite(lat) AND isfinite(lon) AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180
    AND 180),
p AS (SELECT a.station_id AS a, b.station_id AS b, 2 * 6371.0::DOUBLE * asin(least(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat))
    * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)), 1)) AS km
      FROM s a JOIN s b ON a.station_id < b.station_id AND abs(a.lat - b.lat) < 0.05)
"""


_P4_RULES = """
WITH r AS (SELECT station_id, element, date, max(TRY_CAST(trim(value) AS DOUBLE)) AS value FROM obs_by_year
           WHERE isfinite(TRY_CAST(trim(value) AS DOUBLE)) GROUP BY 1, 2, 3),
t AS (SELECT *, coalesce(CASE WHEN element IN ('TMAX', 'TMIN', 'TOBS') THEN value < -900 OR value > 600 WHEN element = 'PRCP' THEN value < 0 OR value
    > 20000 END, false) AS impossible FROM r),
s AS (SELECT *, CAST(try_strptime(date, '%Y%m%d') AS DATE) AS day FROM t WHERE NOT impossible AND try_strptime(date, '%Y%m%d') IS NOT NULL),
n AS (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY station_id, element ORDER BY day) THEN 0 ELSE 1 END AS starts FROM s),
g AS (SELECT *, sum(starts) OVER (PARTITION BY station_id, element ORDER BY day) AS run FROM n),
k AS (SELECT *, count(*) OVER (PARTITION BY station_id, element, run) AS length FROM g)
SELECT station_id, date, element, value, true AS stuck, false AS impossible FROM k WHERE length >= 7 AND value <> 0
UNION ALL SELECT station_id, date, element, value, false, true FROM t WHERE impossible"""


def _sectors() -> str:
    from gridspark.plans.core_found import SECTORS

    # a point lies inside where a ray meets an odd number of edges, those of the holes among them
    rows = [(n, x[k], y[k], x[(k + 1) % len(x)], y[(k + 1) % len(x)]) for n, *outer, holes in SECTORS for x, y in (outer, *holes) for k in range(len(x))]
    return ", ".join(f"('{n}', {a}, {b}, {c}, {e})" for n, a, b, c, e in rows)


_P3_REGIONS = f"""
WITH e(sector, x1, y1, x2, y2) AS (VALUES {_sectors()}),
s AS (SELECT station_id, min({{'lat': lat, 'lon': lon}}) AS pos FROM stations WHERE isfinite(lat) AND isfinite(lon) AND lat BETWEEN -90 AND 90 AND lon
    BETWEEN -180 AND 180 GROUP BY 1),
edge AS (SELECT station_id, sector, CASE WHEN (y1 > pos.lat) <> (y2 > pos.lat) AND pos.lon < (x2 - x1) * (pos.lat - y1) / (CASE WHEN y2 = y1 THEN 1
    ELSE y2 - y1 END) + x1 THEN 1 ELSE 0 END AS crossed FROM s CROSS JOIN e),
hit AS (SELECT station_id, sector FROM (SELECT station_id, sector, sum(crossed) AS n FROM edge GROUP BY station_id, sector) WHERE n % 2 = 1)
SELECT station_id, min(sector) AS sector FROM hit GROUP BY station_id"""

SQL = {
    "p1_found": _GRID + f"SELECT iy, ix, strftime({_start('p')}, '%Y-%m-%d') AS period_start FROM f WHERE n = 0",
    "p1_grid": _GRID + f"""SELECT iy, ix, {_start('p')} AS period_start, n AS n_readings, round(support, 6) AS support,
      CASE WHEN n > 0 THEN 'observed' WHEN support >= 1.5 THEN 'filled' ELSE 'missing' END AS mark,
      CASE WHEN n > 0 OR support >= 1.5 THEN round(CASE WHEN det > s0 * s0 * 1e-3::DOUBLE THEN (s2 * r0 - s1 * r1) / det ELSE r0 / s0 END, 6) END AS
    lai_norm FROM f""",
    "p2_totals": _P2 + "SELECT iy, ix, day, has_row, " + ", ".join(f"round(total_{w}, 3) AS total_{w}, n_{w}, CASE WHEN n_{w} > 0 THEN round(total_{w} / n_{w}, 4) END AS mean_{w}" for w in (14, 30, 60)) + " FROM r",
    "p2_found": _P2 + " UNION ALL ".join(f"""SELECT DISTINCT r.iy, r.ix, strftime(r.day, '%Y-%m-%d') AS day, {w} AS window_days FROM r JOIN weather_daily x ON x.iy = r.iy AND x.ix = r.ix AND
    x.time = r.day
      WHERE x.prcp_{w}d_norm IS NOT NULL AND abs(x.prcp_{w}d_norm - ({_RIGHT.format(w=w)})) > 0.01""" for w in (14, 30, 60)),
    "p3_found": _P3 + "SELECT DISTINCT a AS station_id_a, b AS station_id_b FROM p WHERE km <= 5",
    "p3_neighbours": """
WITH s AS (SELECT lat, lon, count(DISTINCT station_id) AS ids FROM stations WHERE isfinite(lat) AND isfinite(lon) AND lat BETWEEN -90 AND 90 AND lon
    BETWEEN -180 AND 180 GROUP BY 1, 2),
p AS (SELECT a.lat, a.lon, a.ids, b.ids AS n, 2 * 6371.0::DOUBLE * asin(least(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) *
    cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)), 1)) AS km
      FROM s a JOIN s b ON (a.lat <> b.lat OR a.lon <> b.lon) AND abs(a.lat - b.lat) < 0.05)
SELECT lat, lon, ids, count(*) AS positions, CAST(sum(n) AS BIGINT) AS neighbours, round(min(km), 5) AS nearest_km FROM p WHERE km <= 5 GROUP BY 1, 2,
    3""",
    "p3_regions": _P3_REGIONS,
    "p4_rules": _P4_RULES,
    "p5_found": _P5 + "SELECT line_id, reason FROM e WHERE reason IS NOT NULL",
    "p5_clean": _P5 + "SELECT c.line_id, CASE WHEN fixed THEN 'fixed' ELSE 'csv' END AS kind, CASE WHEN fixed THEN trim(substr(line, 1, 11), ' ') ELSE trim(" + _cell(0) + ", ' ') END AS station_id, "
    "CASE WHEN NOT fixed THEN CAST(try_strptime(" + _cell(1) + ", '%Y%m%d') AS DATE) END AS date, CASE WHEN NOT fixed THEN " + _cell(2) + " END AS element, CASE WHEN NOT fixed THEN TRY_CAST(trim(" + _cell(3) + ", ' ') AS DOUBLE) END AS value, "
    + ", ".join(f"CASE WHEN NOT fixed THEN nullif(trim({_cell(i)}, ' '), '') END AS {n}" for i, n in ((4, "mflag"), (5, "qflag"), (6, "sflag"), (7, "obs_time"))) + ", "
    + ", ".join(f"CASE WHEN fixed THEN TRY_CAST(trim(substr(line, {a}, {n}), ' ') AS DOUBLE) END AS {c}" for c, a, n in (("lat", 12, 9), ("lon", 21, 10), ("elev", 31, 7)))
    + ", CASE WHEN fixed THEN nullif(trim(substr(line, 39), ' '), '') END AS name FROM c JOIN e USING (line_id) WHERE e.reason IS NULL",
    "p6_found": _P6,
    "p6_observed": _p6_observed(),
    "p6_numeric": _p6_numeric("prcp", 0.0, 2000.0) + " UNION ALL " + _p6_numeric("tmax", -90.0, 60.0),
}
