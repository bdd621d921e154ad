"""The registered queries in SQL, over the test tables as views.

Written independently of the operators: rows are fanned out by plain joins, and trends are fitted
point by point.
"""

from __future__ import annotations

# The mapping of the test tables, and the prepared counts of each study.
_BASE = """
sample AS (
  SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS sample_date,
         o_orderpriority AS coverage, month(o_orderdate) AS mon,
         CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) <= 3 THEN 1 ELSE 0 END
              AS INTEGER) AS season_start
  FROM orders
  WHERE o_orderstatus <> 'P' AND o_orderpriority <> '4-NOT SPECIFIED'
    AND month(o_orderdate) IN (10, 11, 12, 1, 2, 3)
),
rounds(mon, round, round_order) AS (
  VALUES (10, 'Oktober', 1), (11, 'November', 2), (12, 'December', 3),
         (1, 'Januari', 4), (2, 'Februari', 5), (3, 'Maart', 6)
),
counts AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS location_code, n_name AS location, season_start,
         concat(CAST(season_start AS VARCHAR), '/',
                lpad(CAST((season_start + 1) % 100 AS VARCHAR), 2, '0')) AS season,
         CAST(mon AS VARCHAR) AS round_code, round, round_order, sample_date, coverage,
         p_name AS taxon, p_brand AS scientific_name,
         CAST(l_quantity AS BIGINT) AS individuals,
         p_type AS taxon_group_code, p_type AS taxon_group,
         c_mktsegment AS survey, r_name, r_regionkey, p_partkey
  FROM lineitem
  JOIN sample ON l_orderkey = o_orderkey
  JOIN rounds USING (mon)
  JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
  WHERE l_linenumber IN (1, 2, 3, 4, 5) AND CAST(l_quantity AS BIGINT) > 0
),
groups AS (
  SELECT CASE n_regionkey WHEN 0 THEN 'SEST' WHEN 1 THEN 'WETL' WHEN 2 THEN 'ZSVAL'
              WHEN 3 THEN 'ZS' END AS area_code, n_nationkey, n_name
  FROM nation WHERE n_regionkey <= 3
  UNION ALL
  SELECT 'NOH', n_nationkey, n_name FROM nation WHERE n_regionkey = 4 AND n_nationkey % 2 = 0
  UNION ALL
  SELECT 'ZR', n_nationkey, n_name FROM nation WHERE n_regionkey = 0 AND n_nationkey % 10 = 0
),
members AS (
  SELECT area_code,
         CASE area_code WHEN 'SEST' THEN 'Sigma-Estuarien' WHEN 'WETL' THEN 'Sigma-Wetland'
              ELSE area_code END AS area_name,
         'A' AS area_type_code, 'area' AS area_type,
         CAST(n_nationkey AS VARCHAR) AS location_code, n_name AS location,
         DATE '1990-01-01' AS valid_from,
         CASE WHEN n_nationkey % 3 = 0 THEN DATE '1998-03-31' END AS valid_to
  FROM groups
  UNION ALL
  SELECT 'ZSVAL', 'ZSVAL', 'A', 'area', '24_EXTRA', 'NATION_24_EXTRA', DATE '1990-01-01',
         DATE '1998-03-31'
),
classed AS (
  SELECT *, CASE WHEN area_code IN ('SEST', 'WETL') THEN 'Sigmagebied'
                 WHEN area_code = 'ZSVAL' THEN 'Valleigebied'
                 WHEN area_code IN ('ZS', 'ZR') THEN 'Estuarium'
                 WHEN area_code = 'NOH' THEN 'Haven' END AS area_class
  FROM members
),
cluster_names(i, area_code, area_name) AS (
  VALUES (0, 'BW', 'Burchtse Weel'), (1, 'DM', 'Dijlemonding'), (2, 'DU', 'Durme'),
         (3, 'KM', 'Kalkense Meersen'), (4, 'KBR', 'Polders Kruibeke'),
         (5, 'NG', 'Haven bij Kruibeke'), (6, 'OV', 'Overige'), (7, 'WZ', 'Elders')
),
clusters AS (
  SELECT area_code, area_name, 'A' AS area_type_code, 'area' AS area_type,
         CAST(n_nationkey AS VARCHAR) AS location_code, n_name AS location,
         DATE '1990-01-01' AS valid_from,
         CASE WHEN n_nationkey % 3 = 0 THEN DATE '1998-03-31' END AS valid_to
  FROM nation JOIN cluster_names ON n_nationkey % 8 = i
  UNION ALL
  SELECT 'OV', 'Overige', 'A', 'area', '24_EXTRA', 'NATION_24_EXTRA', DATE '1990-01-01',
         DATE '1998-03-31'
),
second AS (
  SELECT CASE l_returnflag WHEN 'R' THEN 'NORTH' ELSE 'SOUTH' END AS location,
         CASE l_returnflag WHEN 'R' THEN 'Sigma-Estuarien' ELSE 'Sigma-Wetland' END AS area_name,
         CAST(l_shipdate AS DATE) AS sample_date,
         CAST(year(l_shipdate) AS INTEGER) AS season_start,
         round, p_name AS taxon, CAST(l_quantity AS BIGINT) AS individuals,
         p_type AS taxon_group
  FROM lineitem JOIN part ON l_partkey = p_partkey
  LEFT JOIN rounds ON rounds.mon = month(l_shipdate)
  WHERE l_returnflag IN ('R', 'A')
),
period AS (
  SELECT * FROM counts
  WHERE taxon_group <> 'PROMO' AND season_start > 1994 AND season_start < 2001
),
later AS (
  SELECT * FROM counts
  WHERE taxon_group <> 'PROMO' AND season_start > 1996 AND season_start < 2001
),
valley AS (
  SELECT p.*, c.area_code, c.area_name, c.area_type_code, c.area_type,
         c.location_code AS location_code_area, c.valid_from, c.valid_to, c.area_class
  FROM period p JOIN classed c ON p.location IS NOT DISTINCT FROM c.location
),
valley_later AS (
  SELECT p.*, c.area_class
  FROM later p JOIN classed c ON p.location IS NOT DISTINCT FROM c.location
)
"""


_STAR = (
    "SELECT substr(survey, 1, 3) AS survey_code, survey, "
    "CAST(r_regionkey AS VARCHAR) AS region_code, r_name AS region, location_code, "
    "location, season, round_code, round, round_order, "
    "CAST(sample_date AS VARCHAR) AS sample_date, coverage, taxon, scientific_name, "
    "individuals FROM counts"
)

# Two readings of the counts: the present one and an earlier one.
_READINGS = (
    "now AS (SELECT location_code, location, season_start, season, round_code, round, round_order, "
    "CAST(sample_date AS VARCHAR) AS sample_date, coverage, taxon, scientific_name, individuals, "
    "taxon_group_code, taxon_group, survey FROM counts)",
    "earlier AS (SELECT * REPLACE (CASE WHEN round = 'Maart' THEN 'NATION_0' ELSE location END AS location, "
    "nullif(coverage, '5-LOW') AS coverage) FROM (FROM now WHERE taxon <> 'cold gear' UNION ALL FROM now WHERE taxon = 'blue bolt'))",
)


def _query(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([_BASE, *ctes]) + "\n" + body


_COUNT = (
    "location_code, location, season_start, season, round_code, round, round_order, "
    "CAST(sample_date AS VARCHAR) AS sample_date, coverage, taxon, scientific_name, individuals, "
    "taxon_group_code, taxon_group"
)
_MEMBER = (
    "area_code, area_name, area_type_code, area_type, location_code, location, "
    "CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to"
)


def _cells(region: str, valley: str) -> str:
    """Round totals of the three areas by full joins, with their shares."""
    return f"""
cells AS (
  WITH s AS (SELECT season_start, round, sum(individuals) AS t FROM {valley}
             WHERE area_class = 'Sigmagebied' GROUP BY ALL),
       v AS (SELECT season_start, round, sum(individuals) AS t FROM {valley} GROUP BY ALL),
       r AS (SELECT season_start, round, sum(individuals) AS t FROM {region} GROUP BY ALL)
  SELECT season_start, round, s.t AS site_total, v.t AS valley_total, r.t AS region_total,
         s.t / v.t AS site_valley_share, s.t / r.t AS site_region_share,
         v.t / r.t AS valley_region_share
  FROM s FULL JOIN v USING (season_start, round) FULL JOIN r USING (season_start, round)
)"""


_NO_WADERS = [
    "region_nw AS (SELECT * FROM period WHERE taxon_group_code <> 'SMALL')",
    "valley_nw AS (SELECT * FROM valley WHERE taxon_group_code <> 'SMALL')",
]
_CELLS = [*_NO_WADERS, _cells("region_nw", "valley_nw")]
_CELLS_LATER = [_cells("later", "valley_later")]


def _strict(function: str, c: str) -> str:
    return f"CASE WHEN count({c}) = count(*) THEN {function}({c}) END"


def _mean(c: str, name: str) -> str:
    return f"round({_strict('avg', c)}, 6) AS {name}"


_SHARE_MEANS = ", ".join(
    _mean(c, f"mean_{c}") for c in ("site_valley_share", "site_region_share", "valley_region_share")
)
_WINTER = (
    "SELECT season_start, "
    + ", ".join(_mean(f"{a}_total", f"mean_{a}") for a in ("site", "valley", "region"))
    + ", "
    + ", ".join(
        f"CAST({_strict('max', f'{a}_total')} AS DOUBLE) AS max_{a}"
        for a in ("site", "valley", "region")
    )
    + f", {_SHARE_MEANS} FROM cells GROUP BY season_start"
)
_ROUND_TOTALS = """
SELECT season_start, round, CAST(site_total AS DOUBLE) AS site_total,
       CAST(valley_total AS DOUBLE) AS valley_total, CAST(region_total AS DOUBLE) AS region_total,
       round(site_valley_share, 6) AS site_valley_share,
       round(site_region_share, 6) AS site_region_share,
       round(valley_region_share, 6) AS valley_region_share
FROM cells"""

_CLASS_CELLS = """
class_cells AS (
  SELECT area_class, season_start, round, sum(individuals) AS total FROM valley_nw GROUP BY ALL
)"""
_OVERLAP_CELLS = """
overlap_cells AS (
  SELECT 'Estuarium' AS area_class, season_start, round, sum(individuals) AS total
  FROM valley_nw WHERE area_class = 'Estuarium' GROUP BY ALL
  UNION ALL
  SELECT 'Estuarium + Sigma', season_start, round, sum(individuals)
  FROM valley_nw WHERE area_class IN ('Estuarium', 'Sigmagebied') GROUP BY ALL
)"""
_MOVING = """
moving AS (
  WITH w AS (SELECT area_class, season_start, avg(total) AS winter_mean
             FROM overlap_cells GROUP BY ALL)
  SELECT area_class, season_start, winter_mean,
         CASE WHEN count(winter_mean) OVER last5 = 5 THEN avg(winter_mean) OVER last5 END
           AS moving_mean
  FROM w
  WINDOW last5 AS (PARTITION BY area_class ORDER BY season_start
                   ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
)"""

_STATS = """
stats AS (
  SELECT taxon, season_start, count(*) AS n, CAST(sum(individuals) AS BIGINT) AS total,
         sum(individuals) / count(*) AS mean
  FROM valley GROUP BY ALL
)"""


def _top_rows(value: str) -> str:
    return (
        "top20 AS (SELECT * FROM stats "
        f"ORDER BY {value} DESC NULLS LAST, taxon, season_start LIMIT 20)"
    )


def _composition(where: str) -> str:
    return f"""
top10 AS (SELECT taxon FROM valley_later GROUP BY taxon
          ORDER BY sum(individuals) DESC NULLS LAST, taxon LIMIT 10),
composition AS (
  SELECT season_start,
         CASE WHEN taxon IN (SELECT taxon FROM top10) THEN taxon ELSE 'Andere' END AS species,
         sum(individuals) / 6 AS mean
  FROM valley_later WHERE {where} GROUP BY ALL
)"""


_SITE = "area_class = 'Sigmagebied'"
_SPECIES = """
species AS (
  SELECT taxon, 1994 AS after_season FROM (
    SELECT taxon FROM valley GROUP BY taxon
    ORDER BY sum(individuals) DESC NULLS LAST, taxon LIMIT 12)
  WHERE taxon NOT IN ('blue bolt', 'cold gear', 'red widget')
  UNION ALL SELECT 'cold gear', 1996
  UNION ALL SELECT 'red widget', 1997
),
listed_region AS (
  SELECT p.* FROM period p JOIN species s ON p.taxon = s.taxon AND season_start > after_season),
listed_valley AS (
  SELECT p.* FROM valley p JOIN species s ON p.taxon = s.taxon AND season_start > after_season)
"""
_CLUSTER_LEVEL = """CASE WHEN contains(k.area_name, 'Kruibeke') THEN 'KBR'
       WHEN k.area_name IN ('Burchtse Weel', 'Dijlemonding', 'Durme', 'Kalkense Meersen', 'KBR',
                            'Noordelijk Gebied', 'Wal-Zwijn', 'Overige') THEN k.area_name END"""
_CLUSTER_ORDER = """CASE cluster WHEN 'Burchtse Weel' THEN 1 WHEN 'Dijlemonding' THEN 2
       WHEN 'Durme' THEN 3 WHEN 'Kalkense Meersen' THEN 4 WHEN 'KBR' THEN 5
       WHEN 'Noordelijk Gebied' THEN 6 WHEN 'Wal-Zwijn' THEN 7 WHEN 'Overige' THEN 8 END"""

_MERGED = """
merged AS (
  SELECT location, season, season_start, round, sample_date, taxon, taxon_group, individuals
  FROM counts WHERE NOT (location = 'NATION_1' AND season_start > 1997)
  UNION ALL
  SELECT location, NULL, season_start, round, sample_date, taxon, taxon_group, individuals
  FROM second
),
members_all AS (
  SELECT location, area_name FROM members
  UNION ALL
  SELECT DISTINCT location, area_name FROM second
)"""


def _site_types(area_name: str) -> str:
    return _query(
        f"""
SELECT season_start, site_type, round(sum(individuals) / 6, 6) AS mean FROM (
  SELECT m.season_start, m.individuals, {area_name} AS site_type
  FROM merged m JOIN members_all a ON m.location IS NOT DISTINCT FROM a.location
  WHERE taxon_group <> 'PROMO' AND season_start > 1996 AND season_start < 2001)
WHERE site_type IN ('Sigma-Estuarien', 'Sigma-Wetland')
GROUP BY season_start, site_type""",
        _MERGED,
    )


def _ranked_cte(name: str, source: str, where: str) -> str:
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT taxon, t, row_number() OVER (ORDER BY t DESC NULLS LAST, taxon) AS position
    FROM (SELECT taxon, CAST(sum(individuals) AS BIGINT) AS t FROM {source}
          WHERE {where} GROUP BY taxon))
  WHERE position <= 20
)"""


def _points(source: str, by: str) -> str:
    return f"""
pts AS (
  SELECT {by}, CAST(season_start AS DOUBLE) AS x, CAST(total AS DOUBLE) AS y,
         row_number() OVER (PARTITION BY {by} ORDER BY season_start, total) AS i
  FROM {source} WHERE total IS NOT NULL
),
size AS (
  SELECT {by}, count(*) AS n, floor(count(*) * 0.75 + 1e-5) AS q, min(x) AS lo, max(x) AS hi,
         count(DISTINCT x) AS m
  FROM pts GROUP BY {by}
)"""


def _weights(name: str, places: str, by: str) -> str:
    """Weights of every point at the places (by, p, x0, q) of a relation."""
    return f"""
{name}_near AS (
  SELECT {by}, p, x0, q, i, x, y, abs(x - x0) AS d,
         row_number() OVER (PARTITION BY {by}, p ORDER BY abs(x - x0)) AS rn
  FROM {places} JOIN pts USING ({by})
),
{name}_reach AS (
  SELECT {by}, p, max(CASE WHEN rn = q THEN d END) AS h FROM {name}_near GROUP BY ALL
),
{name}_w AS (
  SELECT {by}, p, x0, i, x, y, x - x0 AS dx,
         CASE WHEN d < h THEN pow(1 - pow(d / h, 3), 3) ELSE 0 END AS w
  FROM {name}_near JOIN {name}_reach USING ({by}, p)
),
{name}_a AS (
  SELECT {by}, p, sum(w) AS a0, sum(w * dx) AS a1, sum(w * dx * dx) AS a2,
         sum(w * pow(dx, 3)) AS a3, sum(w * pow(dx, 4)) AS a4,
         count(DISTINCT CASE WHEN w > 0 THEN x END) AS support
  FROM {name}_w GROUP BY ALL
),
{name} AS (
  SELECT {by}, p, x0, i, y,
         CASE WHEN support >= 3 THEN
           w * ((a2 * a4 - a3 * a3) - (a1 * a4 - a2 * a3) * dx + (a1 * a3 - a2 * a2) * dx * dx)
           / (a0 * (a2 * a4 - a3 * a3) - a1 * (a1 * a4 - a2 * a3) + a2 * (a1 * a3 - a2 * a2))
         END AS l
  FROM {name}_w JOIN {name}_a USING ({by}, p)
)"""


def _trend_ctes(source: str, by: str) -> list[str]:
    grid = f"""
grid AS (
  SELECT {by}, p, lo + p * ((hi - lo) / 79) AS x0, q
  FROM size, (SELECT unnest(range(80)) AS p) WHERE m > 1
)"""
    return [_points(source, by), grid, _weights("gl", "grid", by)]


def _trend(source: str, by: str, *ctes: str) -> str:
    return _query(
        f"""
SELECT {by}, CAST(p AS INTEGER) AS step, round(x0, 4) AS x,
       round(CASE WHEN count(l) = count(*) THEN sum(l * y) END, 4) AS fit
FROM gl GROUP BY {by}, p, x0""",
        *ctes,
        *_trend_ctes(source, by),
    )


def _blended(source: str, by: str, *ctes: str) -> str:
    """Fits and slopes at the cells' ends, then cubics between them. Cells are ranges of sorted points."""
    cells = f"""
listed AS (
  SELECT {by}, list(x ORDER BY x) AS xs, count(*) AS n, floor(count(*) * 0.75 * 0.2 + 1e-5) AS room
  FROM pts GROUP BY {by} HAVING count(DISTINCT x) > 1
),
cell AS (
  SELECT {by}, xs, room, CAST(1 AS BIGINT) AS a, n AS b, 0 AS level, NULL::DOUBLE AS cut FROM listed
  UNION ALL
  SELECT {by}, xs, room, part.a, part.b, level + 1, v
  FROM (
    SELECT *, unnest([{{'a': a, 'b': k}}, {{'a': k + 1, 'b': b}}]) AS part
    FROM (
      SELECT *, a - 1 + len(list_filter(xs[a:b], lambda e: e <= v)) AS k
      FROM (SELECT *, (xs[a + (b - a) // 2] + xs[a + (b - a + 1) // 2]) / 2 AS v
            FROM cell WHERE b - a + 1 > room AND level < 6)
      WHERE xs[b] > v))
),
vertex AS (
  SELECT {by}, x0, q, row_number() OVER (PARTITION BY {by} ORDER BY x0) AS p
  FROM (
    SELECT DISTINCT {by}, cut AS x0 FROM cell WHERE cut IS NOT NULL
    UNION ALL SELECT {by}, lo - (hi - lo) * 0.1 FROM size WHERE m > 1
    UNION ALL SELECT {by}, hi + (hi - lo) * 0.1 FROM size WHERE m > 1)
  JOIN size USING ({by})
)"""
    ends = f"""
ends AS (
  SELECT {by}, p, x0, CASE WHEN count(l) = count(*) THEN sum(l * y) END AS f FROM vx GROUP BY ALL
),
slopes AS (
  SELECT {by}, p, CASE WHEN max(support) >= 3 THEN
    sum(w * y * (dx * (a0 * a4 - a2 * a2) - (a1 * a4 - a2 * a3) - dx * dx * (a0 * a3 - a1 * a2))
        / (a0 * (a2 * a4 - a3 * a3) - a1 * (a1 * a4 - a2 * a3) + a2 * (a1 * a3 - a2 * a2))) END AS s
  FROM vx_w JOIN vx_a USING ({by}, p) GROUP BY ALL
),
spans_ AS (
  SELECT {by}, p, x0 AS v0, f AS f0, s AS s0, lead(x0) OVER w AS v1, lead(f) OVER w AS f1, lead(s) OVER w AS s1
  FROM ends JOIN slopes USING ({by}, p) WINDOW w AS (PARTITION BY {by} ORDER BY p)
),
met AS (
  SELECT {by}, g.p, g.x0, v1 - v0 AS h, (g.x0 - v0) / (v1 - v0) AS t, f0, s0, f1, s1
  FROM grid g JOIN spans_ USING ({by}) WHERE g.x0 >= v0 AND g.x0 < v1
)"""
    base = _trend_ctes(source, by)[:2]
    return _query(
        f"""
SELECT {by}, CAST(p AS INTEGER) AS step, round(x0, 4) AS x,
       round((1 + 2 * t) * (1 - t) * (1 - t) * f0 + t * (1 - t) * (1 - t) * h * s0
             + t * t * (3 - 2 * t) * f1 - t * t * (1 - t) * h * s1, 4) AS fit
FROM met""",
        *ctes,
        *base,
        cells,
        _weights("vx", "vertex", by),
        ends,
    ).replace("WITH ", "WITH RECURSIVE ", 1)


_SERIES = """
series_points AS (
  SELECT 'site_total' AS series, season_start, site_total AS total FROM cells
  UNION ALL SELECT 'valley_total', season_start, valley_total FROM cells
  UNION ALL SELECT 'region_total', season_start, region_total FROM cells
)"""
_CENSORED = """
censored AS (
  SELECT series, season_start, CASE WHEN share BETWEEN 0 AND 0.5 THEN share END AS total
  FROM (SELECT 'site_valley_share' AS series, season_start, site_valley_share AS share FROM cells
        UNION ALL SELECT 'site_region_share', season_start, site_region_share FROM cells
        UNION ALL SELECT 'valley_region_share', season_start, valley_region_share FROM cells)
)"""
_WEEKLY = """
weekly AS (
  SELECT taxon_group, date_diff('day', DATE '1970-01-01', CAST(sample_date AS DATE)) // 7 AS season_start,
         sum(individuals) AS total
  FROM period GROUP BY ALL
)"""
_SPECIES_POINTS = """
species_points AS (
  SELECT taxon, season_start, round, sum(individuals) AS total FROM valley GROUP BY ALL
)"""


def _scale(by: str) -> list[str]:
    """Residual scale: L at the points themselves, M = I - L."""
    return [
        f"nodes AS (SELECT {by}, pts.i AS p, pts.x AS x0, q FROM pts JOIN size USING ({by}))",
        _weights("nl", "nodes", by),
        f"""
mm AS (
  SELECT {by}, p, i, y, CASE WHEN p = i THEN 1 ELSE 0 END - l AS m FROM nl
),
first_moment AS (
  SELECT {by}, CASE WHEN count(m) = count(*) THEN sum(m * m) END AS d1 FROM mm GROUP BY {by}
),
residuals AS (
  SELECT {by}, sum(r * r) AS rss FROM (
    SELECT {by}, p, sum(m * y) AS r FROM mm GROUP BY ALL) GROUP BY {by}
),
second_moment AS (
  SELECT {by}, sum(v * v) AS d2 FROM (
    SELECT {by}, a.p AS pa, b.p AS pb, sum(a.m * b.m) AS v
    FROM mm a JOIN mm b USING ({by}, i) GROUP BY ALL) GROUP BY {by}
),
scale AS (
  SELECT {by}, n, d1, d2, rss, CASE WHEN d1 > 1e-9 * n THEN sqrt(rss / d1) END AS s,
         CASE WHEN d1 > 1e-9 * n THEN d1 * d1 / d2 END AS df
  FROM size JOIN first_moment USING ({by}) JOIN second_moment USING ({by})
  JOIN residuals USING ({by})
)""",
    ]


def _quantile(by: str) -> str:
    """t as the angle at which the integral of cos^(df - 1) reaches 95% of that to a right angle.

    Midpoint sums, with the end correction of their error.
    """
    return f"""
angles AS (
  SELECT {by}, s, df, k, step, pow(cos((k - 0.5) * step), df - 1) AS f,
         0.475 * sqrt(pi()) * exp(lgamma(df / 2) - lgamma((df + 1) / 2)) AS wanted
  FROM scale, (SELECT unnest(range(1, 40001)) AS k, pi() / 80000 AS step) WHERE df IS NOT NULL
),
upto AS (
  SELECT *, step * sum(f) OVER (PARTITION BY {by} ORDER BY k) AS reached FROM angles
),
quantiles AS (
  SELECT {by}, s, t FROM scale LEFT JOIN (
    SELECT {by}, sqrt(df) * tan(e - over / pow(cos(e - over / f / 2), df - 1)) AS t
    FROM (SELECT *, step * k AS e, reached - wanted
                 - step * step / 24 * (df - 1) * pow(cos(step * k), df - 2) * sin(step * k) AS over
          FROM upto WHERE reached >= wanted AND reached - step * f < wanted)) USING ({by})
)"""


def _band(source: str, by: str, *ctes: str, digits: int = 4) -> str:
    return _query(
        f"""
SELECT {by}, CAST(p AS INTEGER) AS step, round(x0, {digits}) AS x, round(f, {digits}) AS fit,
       round(s * sqrt(sq), {digits}) AS se, round(f - t * s * sqrt(sq), {digits}) AS lower,
       round(f + t * s * sqrt(sq), {digits}) AS upper
FROM (SELECT {by}, p, x0, CASE WHEN count(l) = count(*) THEN sum(l * y) END AS f,
             CASE WHEN count(l) = count(*) THEN sum(l * l) END AS sq
      FROM gl GROUP BY {by}, p, x0)
JOIN quantiles USING ({by})""",
        *ctes,
        *_trend_ctes(source, by),
        *_scale(by),
        _quantile(by),
    )


def _spline(source: str, by: str, penalties: str, *ctes: str) -> str:
    """Normal equations from every point's four splines, solved by elimination for each penalty."""

    def splines(of: str) -> str:
        return f"""
  SELECT *, unnest([
    {{'j': cell + 1, 'v': pow(1 - t, 3) / 6}}, {{'j': cell + 2, 'v': (3 * pow(t, 3) - 6 * t * t + 4) / 6}},
    {{'j': cell + 3, 'v': (1 + 3 * t + 3 * t * t - 3 * pow(t, 3)) / 6}}, {{'j': cell + 4, 'v': pow(t, 3) / 6}}
  ], recursive := true)
  FROM (SELECT *, place - cell AS t
        FROM (SELECT *, CAST(least(floor(place), 9) AS BIGINT) AS cell FROM {of}))"""

    return _query(
        f"""
SELECT {by}, CAST(p AS INTEGER) AS step, round(any_value(x0), 4) AS x, round(sum(v * b), 4) AS fit,
       round(any_value(penalty), 4) AS penalty, round(any_value(edf), 4) AS edf
FROM on_grid JOIN taken USING ({by}) JOIN coefficients USING ({by}, penalty, j)
GROUP BY {by}, p""",
        *ctes,
        _points(source, by),
        f"""
on_points AS ({splines(f"(SELECT {by}, i, y, (x - lo) / (hi - lo) * 10 AS place FROM pts JOIN size USING ({by}) WHERE m > 1)")}
),
on_grid AS ({splines(f"(SELECT {by}, p, p / 79.0::DOUBLE * 10 AS place, lo + p * ((hi - lo) / 79) AS x0 FROM size, (SELECT unnest(range(80)) AS p) WHERE m > 1)")}
),
places AS (SELECT unnest(range(1, 14)) AS j),
bends AS (
  SELECT a.j, b.j AS k, sum(CASE r - a.j WHEN 0 THEN 1 WHEN -1 THEN -2 WHEN -2 THEN 1 ELSE 0 END
                          * CASE r - b.j WHEN 0 THEN 1 WHEN -1 THEN -2 WHEN -2 THEN 1 ELSE 0 END) AS bend
  FROM places a, places b, (SELECT unnest(range(1, 12)) AS r) GROUP BY ALL
),
products AS (
  SELECT {by}, a.j, b.j AS k, sum(a.v * b.v) AS v FROM on_points a JOIN on_points b USING ({by}, i) GROUP BY ALL
),
right_side AS (SELECT {by}, j, sum(v * y) AS r FROM on_points GROUP BY ALL),
matrix_rows AS (
  SELECT {by}, penalty, j, list(coalesce(v, 0) + penalty * bend ORDER BY k)
         || [coalesce(any_value(r), 0)] || list(coalesce(v, 0) ORDER BY k) AS cells
  FROM (SELECT DISTINCT {by} FROM on_points) CROSS JOIN bends
  CROSS JOIN (SELECT unnest({penalties}) AS penalty)
  LEFT JOIN products USING ({by}, j, k) LEFT JOIN right_side USING ({by}, j) GROUP BY {by}, penalty, j
),
eliminated AS (
  SELECT {by}, penalty, 1 AS p, list(cells ORDER BY j) AS m FROM matrix_rows GROUP BY ALL
  UNION ALL
  SELECT {by}, penalty, p + 1, list_transform(m, lambda own, i: CASE WHEN i = p
      THEN list_transform(own, lambda v: v / m[p][p])
      ELSE list_transform(own, lambda v, j: v - own[p] / m[p][p] * m[p][j]) END)
  FROM eliminated WHERE p <= 13
),
coefficients AS (
  SELECT {by}, penalty, j, m[j][14] AS b, m[j][14 + j] AS f FROM eliminated, places WHERE p = 14
),
scores AS (
  SELECT {by}, penalty, edf, n * rss / pow(n - edf, 2) AS score
  FROM (SELECT {by}, penalty, sum(f) AS edf FROM coefficients GROUP BY ALL)
  JOIN (SELECT {by}, penalty, sum(pow(y - fit, 2)) AS rss
        FROM (SELECT {by}, penalty, i, any_value(y) AS y, sum(v * b) AS fit
              FROM on_points JOIN coefficients USING ({by}, j) GROUP BY ALL) GROUP BY ALL) USING ({by}, penalty)
  JOIN size USING ({by})
),
taken AS (SELECT {by}, arg_min(penalty, score) AS penalty, arg_min(edf, score) AS edf FROM scores GROUP BY {by})""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)


# All seasons of the tables, for curves with one point per season.
_ALL = [
    "all_period AS (SELECT * FROM counts WHERE taxon_group <> 'PROMO')",
    """
all_valley AS (
  SELECT p.*, c.area_class
  FROM all_period p JOIN classed c ON p.location IS NOT DISTINCT FROM c.location
)""",
]
_ALL_NW = [
    *_ALL,
    "all_period_nw AS (SELECT * FROM all_period WHERE taxon_group_code <> 'SMALL')",
    "all_valley_nw AS (SELECT * FROM all_valley WHERE taxon_group_code <> 'SMALL')",
]
_ALL_CELLS = [*_ALL_NW, _cells("all_period_nw", "all_valley_nw")]
_MEAN_POINTS = f"""
mean_points AS (
  SELECT 'mean_site' AS series, season_start, {_strict('avg', 'site_total')} AS total
  FROM cells GROUP BY season_start
  UNION ALL
  SELECT 'mean_valley', season_start, {_strict('avg', 'valley_total')}
  FROM cells GROUP BY season_start
)"""
_SHARE_POINTS = f"""
share_points AS (
  SELECT series, season_start, CASE WHEN share BETWEEN 0 AND 0.5 THEN share END AS total
  FROM (SELECT 'mean_site_valley_share' AS series, season_start,
               {_strict('avg', 'site_valley_share')} AS share
        FROM cells GROUP BY season_start)
)"""
_CLASS_POINTS = """
class_points AS (
  SELECT area_class, season_start, avg(t) AS total FROM (
    SELECT area_class, season_start, round, sum(individuals) AS t
    FROM all_valley_nw GROUP BY ALL) GROUP BY ALL
)"""
_MOVING_POINTS = """
moving_points AS (
  SELECT area_class, season_start,
         CASE WHEN moving_mean BETWEEN 0 AND 2000 THEN moving_mean END AS total
  FROM moving
)"""


def _all_species(column: str) -> list[str]:
    """Points per species and season: of the sites, as a mean or as their share of the valley."""
    return [
        *_ALL,
        _SPECIES.replace("SELECT taxon, 1994", "SELECT taxon, 1993")
        .replace("FROM valley GROUP", "FROM all_valley GROUP")
        .replace("FROM period p", "FROM all_period p")
        .replace("FROM valley p", "FROM all_valley p"),
        f"""
species_season AS (
  SELECT taxon, season_start, {column} AS total
  FROM (SELECT taxon, season_start, sum(individuals) AS t FROM listed_valley
        WHERE area_class = 'Sigmagebied' GROUP BY ALL) s
  LEFT JOIN (SELECT taxon, season_start, sum(individuals) AS t FROM listed_valley GROUP BY ALL) v
  USING (taxon, season_start)
)""",
        """
species_class AS (
  SELECT taxon, area_class, season_start, sum(individuals) / 6 AS total
  FROM listed_valley GROUP BY ALL
)""",
    ]


_SITE_POINTS = """
site_points AS (
  SELECT site_type, season_start, CASE WHEN mean BETWEEN 0 AND 1500 THEN mean END AS total FROM (
    SELECT m.season_start, a.area_name AS site_type, sum(m.individuals) / 6 AS mean
    FROM merged m JOIN members_all a ON m.location IS NOT DISTINCT FROM a.location
    WHERE taxon_group <> 'PROMO' AND season_start > 1993 AND season_start < 2001
      AND a.area_name IN ('Sigma-Estuarien', 'Sigma-Wetland')
    GROUP BY ALL)
)"""


def oracle_sql() -> dict[str, str]:
    trend_points = [*_CELLS, _SERIES]
    return {
        "star_counts": _query(_STAR),
        "bucketed_star_counts": _query(_STAR),
        "counts_by_csv": _query(
            "SELECT * REPLACE (location || chr(10) || '\"plas\", deel ' || CAST(round_order AS VARCHAR) AS location) "
            f"FROM ({_STAR})"
        ),
        "ordered_counts": _query(
            "SELECT *, row_number() OVER (ORDER BY season NULLS LAST, individuals DESC NULLS LAST, "
            "survey_code NULLS LAST, survey NULLS LAST, region_code NULLS LAST, region NULLS LAST, "
            "location_code NULLS LAST, location NULLS LAST, round_code NULLS LAST, round NULLS LAST, "
            "round_order NULLS LAST, sample_date NULLS LAST, coverage NULLS LAST, taxon NULLS LAST, "
            f"scientific_name NULLS LAST) AS place FROM ({_STAR})"
        ),
        "changed_rows": _query(
            "SELECT *, count(*) AS n_gained, CAST(0 AS BIGINT) AS n_lost "
            "FROM (FROM now EXCEPT ALL FROM earlier) GROUP BY ALL UNION ALL "
            "SELECT *, CAST(0 AS BIGINT), count(*) FROM (FROM earlier EXCEPT ALL FROM now) GROUP BY ALL",
            *_READINGS,
        ),
        "changes_per_survey": _query(
            "SELECT b.survey, a.n AS n_old, b.n AS n_new, coalesce(g.n, 0) AS n_gained, coalesce(l.n, 0) AS n_lost "
            "FROM b LEFT JOIN a USING (survey) LEFT JOIN g USING (survey) LEFT JOIN l USING (survey)",
            *_READINGS,
            "g AS (SELECT survey, count(*) AS n FROM (FROM now EXCEPT ALL FROM earlier) GROUP BY 1)",
            "l AS (SELECT survey, count(*) AS n FROM (FROM earlier EXCEPT ALL FROM now) GROUP BY 1)",
            "a AS (SELECT survey, count(*) AS n FROM earlier GROUP BY 1)",
            "b AS (SELECT survey, count(*) AS n FROM now GROUP BY 1)",
        ),
        "changed_seasons": _query(
            "SELECT DISTINCT season_start FROM ("
            "(FROM now EXCEPT ALL FROM mixed) UNION ALL (FROM mixed EXCEPT ALL FROM now))",
            *_READINGS,
            "mixed AS (FROM earlier WHERE season_start % 2 = 1 UNION ALL FROM now WHERE season_start % 2 = 0)",
        ),
        "taxon_groups": "SELECT p_name AS taxon, p_type AS taxon_group_code, "
        "p_type AS taxon_group FROM part",
        "area_membership": _query(f"SELECT {_MEMBER} FROM members"),
        "cluster_membership": _query(f"SELECT {_MEMBER} FROM clusters"),
        "counts_with_group": _query(
            "SELECT location_code, location, season_start, season, round_code, round, "
            "round_order, CAST(sample_date AS VARCHAR) AS sample_date, coverage, taxon, "
            "scientific_name, individuals, substr(g, 1, 2) AS taxon_group_code, "
            "g AS taxon_group FROM counts LEFT JOIN ("
            "SELECT p_name, arg_min(p_type, part.p_partkey) AS g FROM part GROUP BY p_name "
            "HAVING g <> 'LARGE') ON taxon IS NOT DISTINCT FROM p_name"
        ),
        "exclude_groups": _query(
            f"SELECT {_COUNT} FROM counts "
            "WHERE taxon_group <> 'PROMO' AND taxon_group_code <> 'SMALL'"
        ),
        "period_counts": _query(f"SELECT {_COUNT} FROM period"),
        "period_counts_from_label": _query(
            f"SELECT {_COUNT} FROM period WHERE round <> 'Maart'"
        ),
        "unknown_groups": _query(f"SELECT {_COUNT} FROM counts WHERE taxon_group = 'STANDARD'"),
        "rows_per_survey": _query(
            "SELECT survey, count(*) AS n_rows FROM counts GROUP BY survey"
        ),
        "row_count_checks": _query(
            """
SELECT frame, n_rows, CAST(n_expected AS BIGINT) AS n_expected, n_rows = n_expected AS agrees
FROM (SELECT 'all' AS frame, count(*) AS n_rows, 11189 AS n_expected FROM counts
      UNION ALL SELECT 'period', count(*), 8603 FROM period
      UNION ALL SELECT 'valley', count(*), 7646 FROM valley)"""
        ),
        "completeness_check": _query(
            """
SELECT count(*) AS n_rows, count(*) - count(mean) AS n_missing,
       count(DISTINCT season_start) AS n_season_start,
       count(DISTINCT species) AS n_species,
       count(DISTINCT season_start) * count(DISTINCT species) AS n_complete,
       count(*) = count(DISTINCT season_start) * count(DISTINCT species) AS is_complete
FROM composition""",
            _composition(_SITE),
        ),
        "areas_without_counts": _query(
            f"SELECT {_MEMBER} FROM members WHERE location NOT IN (SELECT location FROM counts)"
        ),
        "area_classes": _query("SELECT DISTINCT area_code, area_class FROM classed"),
        "membership_summary": _query(
            """
SELECT min(n) AS minimum, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS median,
       round(avg(n), 6) AS mean, quantile_cont(n, 0.75) AS q3, max(n) AS maximum
FROM (SELECT location, count(*) AS n FROM members_all GROUP BY location)""",
            _MERGED,
        ),
        "valley_counts": _query(
            f"SELECT {_COUNT}, area_code, area_name, area_type_code, area_type, "
            "location_code_area, CAST(valid_from AS VARCHAR) AS valid_from, "
            "CAST(valid_to AS VARCHAR) AS valid_to, area_class FROM valley"
        ),
        "valley_counts_as_of": _query(
            f"SELECT {_COUNT}, area_code, area_name, area_type_code, area_type, "
            "location_code_area, CAST(valid_from AS VARCHAR) AS valid_from, "
            "CAST(valid_to AS VARCHAR) AS valid_to, area_class FROM valley v "
            "WHERE v.valid_from <= v.sample_date "
            "AND (v.valid_to IS NULL OR v.sample_date <= v.valid_to)"
        ),
        "area_right_join": _query(
            "SELECT m.location, area_code, CAST(season_start AS DOUBLE) AS season_start, round, "
            "taxon, CAST(individuals AS DOUBLE) AS individuals "
            "FROM counts c RIGHT JOIN members m ON c.location IS NOT DISTINCT FROM m.location"
        ),
        "folded_counts": _query(
            "SELECT season_start, round, location, taxon, taxon_group, taxon_group_code, "
            "CAST(sum(individuals) AS BIGINT) AS individuals, count(*) AS n_rows "
            "FROM counts GROUP BY ALL"
        ),
        "round_totals": _query(
            "SELECT season_start, round, CAST(sum(individuals) AS BIGINT) AS total "
            "FROM region_nw GROUP BY ALL",
            *_NO_WADERS,
        ),
        "area_round_totals": _query(_ROUND_TOTALS, *_CELLS),
        "joined_round_totals": _query(_ROUND_TOTALS, *_CELLS),
        "winter_means": _query(_WINTER, *_CELLS),
        "winter_means_with_waders": _query(_WINTER, *_CELLS_LATER),
        "winter_means_one_taxon": _query(
            _WINTER,
            "one_region AS (SELECT * FROM period "
            "WHERE taxon = 'cold gear' AND taxon_group_code <> 'SMALL')",
            "one_valley AS (SELECT * FROM valley "
            "WHERE taxon = 'cold gear' AND taxon_group_code <> 'SMALL')",
            _cells("one_region", "one_valley"),
        ),
        "long_area_means": _query(
            f"""
SELECT season_start, 'mean_site' AS name, {_mean('site_total', 'value')}
FROM cells GROUP BY season_start
UNION ALL
SELECT season_start, 'mean_valley', {_mean('valley_total', 'value')}
FROM cells GROUP BY season_start""",
            *_CELLS,
        ),
        "area_shares": _query(
            f"SELECT season_start, {_SHARE_MEANS} FROM cells GROUP BY season_start", *_CELLS
        ),
        "class_winter_means": _query(
            "SELECT area_class, season_start, round(avg(total), 6) AS winter_mean "
            "FROM class_cells GROUP BY ALL",
            *_NO_WADERS,
            _CLASS_CELLS,
        ),
        "overlapping_classes": _query(
            "SELECT area_class, season_start, round, CAST(total AS BIGINT) AS total "
            "FROM overlap_cells",
            *_NO_WADERS,
            _OVERLAP_CELLS,
        ),
        "moving_winter_mean": _query(
            "SELECT area_class, season_start, round(winter_mean, 6) AS winter_mean, "
            "round(moving_mean, 6) AS moving_mean FROM moving",
            *_NO_WADERS,
            _OVERLAP_CELLS,
            _MOVING,
        ),
        "target_gap": _query(
            "SELECT area_class, season_start, round(winter_mean, 6) AS winter_mean, "
            "round(moving_mean, 6) AS moving_mean, 500 AS target, "
            "round(moving_mean - 500, 6) AS gap FROM moving",
            *_NO_WADERS,
            _OVERLAP_CELLS,
            _MOVING,
        ),
        "counted_areas": _query(
            "SELECT season_start, count(*) AS n_areas FROM ("
            "SELECT DISTINCT season_start, location, area_class FROM valley) GROUP BY ALL"
        ),
        "counted_areas_by_class": _query(
            "SELECT season_start, area_class, count(*) AS n_areas FROM ("
            "SELECT DISTINCT season_start, location, area_class FROM valley) GROUP BY ALL"
        ),
        "species_season_stats": _query(
            "SELECT taxon, season_start, n, total, round(mean, 6) AS mean FROM stats", _STATS
        ),
        "top20_concentrations": _query(
            "SELECT taxon, season_start, n, total, round(mean, 6) AS mean FROM top20",
            _STATS,
            _top_rows("mean"),
        ),
        "top20_totals": _query(
            "SELECT taxon, season_start, n, total, round(mean, 6) AS mean FROM top20",
            _STATS,
            _top_rows("total"),
        ),
        "top20_species": _query("SELECT DISTINCT taxon FROM top20", _STATS, _top_rows("mean")),
        "top20_total_species": _query(
            "SELECT DISTINCT taxon FROM top20", _STATS, _top_rows("total")
        ),
        "top5_species": _query(
            "SELECT taxon, CAST(sum(individuals) AS BIGINT) AS total FROM valley GROUP BY taxon "
            "ORDER BY total DESC NULLS LAST, taxon LIMIT 5"
        ),
        "top_species_other": _query(
            "SELECT season_start, species, round(mean, 6) AS mean FROM composition",
            _composition(_SITE),
        ),
        "valley_composition": _query(
            "SELECT season_start, species, round(mean, 6) AS mean FROM composition",
            _composition("TRUE"),
        ),
        "stacked_composition": _query(
            """
SELECT season_start, species, round(mean, 6) AS mean, round(ymax, 6) AS ymax,
       round(ymax - mean, 6) AS ymin
FROM (SELECT *, sum(mean) OVER (PARTITION BY season_start ORDER BY species DESC
                                ROWS UNBOUNDED PRECEDING) AS ymax FROM composition)""",
            _composition(_SITE),
        ),
        "species_list": _query(
            "SELECT taxon, CAST(after_season AS INTEGER) AS after_season FROM species", _SPECIES
        ),
        "species_shares": _query(
            """
SELECT s.taxon, s.season_start, round(s.t / 6, 6) AS mean_site, round(v.t / 6, 6) AS mean_valley,
       round(r.t / 6, 6) AS mean_region, round((s.t / 6) / (v.t / 6), 6) AS site_valley_share,
       round((s.t / 6) / (r.t / 6), 6) AS site_region_share
FROM (SELECT taxon, season_start, sum(individuals) AS t FROM listed_valley
      WHERE area_class = 'Sigmagebied' GROUP BY ALL) s
LEFT JOIN (SELECT taxon, season_start, sum(individuals) AS t FROM listed_valley GROUP BY ALL) v
  ON s.taxon = v.taxon AND s.season_start = v.season_start
LEFT JOIN (SELECT taxon, season_start, sum(individuals) AS t FROM listed_region GROUP BY ALL) r
  ON s.taxon = r.taxon AND s.season_start = r.season_start""",
            _SPECIES,
        ),
        "species_by_class": _query(
            "SELECT taxon, season_start, area_class, round(sum(individuals) / 6, 6) AS mean "
            "FROM listed_valley GROUP BY ALL",
            _SPECIES,
        ),
        "species_by_cluster": _query(
            f"""
SELECT taxon, season_start, cluster, round(sum(individuals) / 6, 6) AS mean FROM (
  SELECT v.*, {_CLUSTER_LEVEL} AS cluster
  FROM listed_valley v JOIN clusters k ON v.location = k.location
  WHERE area_class = 'Sigmagebied')
GROUP BY taxon, season_start, cluster""",
            _SPECIES,
        ),
        "fixed_effort_means": _query(
            "SELECT taxon, season_start, round(sum(individuals) / 6, 6) AS mean "
            "FROM period GROUP BY ALL"
        ),
        "cluster_row_counts": _query(
            """
SELECT k.area_name AS cluster, count(*) AS n_rows,
       CASE WHEN contains(k.area_name, 'Kruibeke') THEN 'KBR' ELSE k.area_name END AS short_name
FROM valley_later v RIGHT JOIN clusters k ON v.location = k.location
GROUP BY k.area_name"""
        ),
        "cluster_counts_renamed": _query(
            """
SELECT CASE WHEN contains(k.area_name, 'Kruibeke') THEN 'KBR' ELSE k.area_name END AS cluster,
       count(*) AS n_rows
FROM valley_later v RIGHT JOIN clusters k ON v.location = k.location
GROUP BY ALL"""
        ),
        "cluster_means": _query(
            f"""
SELECT season_start, cluster, CAST({_CLUSTER_ORDER} AS DOUBLE) AS cluster_order,
       round(t / 6, 6) AS mean FROM (
  SELECT season_start, {_CLUSTER_LEVEL} AS cluster, sum(individuals) AS t
  FROM valley_later v RIGHT JOIN clusters k ON v.location = k.location
  WHERE area_class = 'Sigmagebied' GROUP BY ALL)"""
        ),
        "second_source": _query(
            "SELECT location, area_name, CAST(sample_date AS VARCHAR) AS sample_date, "
            "season_start, round, taxon, individuals, taxon_group FROM second"
        ),
        "second_source_winter_rule": _query(
            """
SELECT area_name,
       CAST(CASE WHEN month(sample_date) <= 3 THEN season_start - 1 ELSE season_start END
            AS INTEGER) AS season_start,
       round, CAST(sum(individuals) AS BIGINT) AS total
FROM second GROUP BY ALL"""
        ),
        "second_source_areas": _query("SELECT DISTINCT location, area_name FROM second"),
        "merge_sources": _query(
            "SELECT location, season, season_start, round, "
            "CAST(sample_date AS VARCHAR) AS sample_date, taxon, taxon_group, individuals "
            "FROM merged",
            _MERGED,
        ),
        "rank_side_by_side": _query(
            """
SELECT CAST(coalesce(a.position, b.position) AS INTEGER) AS position,
       a.taxon AS taxon_counts, CAST(a.t AS DOUBLE) AS total_counts,
       b.taxon AS taxon_second, CAST(b.t AS DOUBLE) AS total_second
FROM top_counts a FULL JOIN top_second b ON a.position = b.position""",
            _ranked_cte(
                "top_counts", "counts", "location = 'NATION_1' AND season_start > 1997"
            ),
            _ranked_cte("top_second", "second", "taxon <> 'blue anvil'"),
        ),
        "rows_per_area_name": _query(
            """
SELECT area_name, CAST(sum(b) AS BIGINT) AS n_before, CAST(sum(a) AS BIGINT) AS n_after FROM (
  SELECT area_name, 1 AS b, 0 AS a FROM joined
  UNION ALL
  SELECT CASE WHEN location = 'NATION_1' THEN 'Sigma-Estuarien' ELSE area_name END, 0, 1 FROM joined)
GROUP BY area_name""",
            _MERGED,
            "joined AS (SELECT m.location, a.area_name FROM merged m JOIN members_all a "
            "ON m.location IS NOT DISTINCT FROM a.location)",
        ),
        "replaced_location_rows": _query(
            "SELECT season_start, count(*) AS n_rows FROM counts WHERE location = 'NATION_1' "
            "GROUP BY season_start"
        ),
        "replaced_location_areas": _query(
            "SELECT DISTINCT area_name FROM members WHERE location = 'NATION_1'"
        ),
        "listings": _query(
            """
SELECT DISTINCT 'survey' AS listing, survey AS value FROM counts
UNION ALL SELECT DISTINCT 'group', p_type FROM part
UNION ALL SELECT DISTINCT 'family',
  CASE WHEN taxon_group = 'PROMO' THEN 'PROMO family' ELSE taxon_group END FROM second"""
        ),
        "site_type_totals": _site_types("a.area_name"),
        "reclassified_totals": _site_types(
            "CASE WHEN m.location = 'NATION_1' THEN 'Sigma-Estuarien' ELSE a.area_name END"
        ),
        "smoothed_trend": _trend("series_points", "series", *trend_points),
        "censored_trend": _trend("censored", "series", *_CELLS, _CENSORED),
        "class_trend": _trend("class_cells", "area_class", *_NO_WADERS, _CLASS_CELLS),
        "species_trend": _trend("species_points", "taxon", _SPECIES_POINTS),
        "blended_trend": _blended("series_points", "series", *trend_points),
        "blended_species_trend": _blended("species_points", "taxon", _SPECIES_POINTS),
        "smoothed_band": _band("series_points", "series", *trend_points),
        "weekly_spline": _spline(
            "weekly", "taxon_group", "list_transform(range(-4, 13), lambda k: pow(10, k / 2.0::DOUBLE))", _WEEKLY
        ),
        "round_spline": _spline("series_points", "series", "[1.0::DOUBLE]", *trend_points),
        "weekly_band": _band("weekly", "taxon_group", _WEEKLY, digits=3),
        "weekly_residual_scale": _query(
            "SELECT taxon_group, n AS n_points, round(d1, 4) AS d1, round(d2, 4) AS d2, "
            "round(rss, 4) AS rss, round(s, 4) AS s, round(df, 4) AS df FROM scale",
            _WEEKLY,
            _points("weekly", "taxon_group"),
            *_scale("taxon_group"),
        ),
        "residual_scale": _query(
            "SELECT series, n AS n_points, round(d1, 4) AS d1, round(d2, 4) AS d2, "
            "round(rss, 4) AS rss, round(s, 4) AS s, round(df, 4) AS df FROM scale",
            *trend_points,
            _points("series_points", "series"),
            *_scale("series"),
        ),
        "winter_mean_trend": _band("mean_points", "series", *_ALL_CELLS, _MEAN_POINTS),
        "share_mean_trend": _band("share_points", "series", *_ALL_CELLS, _SHARE_POINTS),
        "class_mean_trend": _band("class_points", "area_class", *_ALL_NW, _CLASS_POINTS),
        "moving_mean_trend": _band(
            "moving_points",
            "area_class",
            *_ALL_NW,
            _OVERLAP_CELLS.replace("valley_nw", "all_valley_nw"),
            _MOVING,
            _MOVING_POINTS,
        ),
        "species_mean_trend": _band("species_season", "taxon", *_all_species("s.t / 6")),
        "species_share_trend": _band(
            "species_season", "taxon", *_all_species("(s.t / 6) / (v.t / 6)")
        ),
        "species_class_trend": _band("species_class", "taxon, area_class", *_all_species("s.t")),
        "site_type_trend": _band("site_points", "site_type", _MERGED, _SITE_POINTS),
    }
