"""Independent SQL twins of the registered queries, on the order tables alone.

They take other routes than the Spark code on purpose: two aggregations and a union for national
totals, joins instead of windows for the redistribution, a self-join for cumulative sums, a
candidate list for the fit search, a recursion for extinct generations.
"""

from __future__ import annotations

import re

_PLACED = """FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def _counts(records: str) -> str:
    banded = f"""(SELECT year, geo_code, sex,
      CASE WHEN age >= 85 AND age < 125 THEN 85
           WHEN age >= 0 AND age < 85 THEN CAST(floor(age / 5) * 5 AS INTEGER) END AS age_band
      FROM {records})"""
    return f"""SELECT year, geo_code, sex, age_band, count(*) AS n FROM {banded} GROUP BY 1, 2, 3, 4
    UNION ALL
    SELECT year, 'BR', sex, age_band, count(*) FROM {banded} GROUP BY 1, 2, 3, 4"""


def _spread(counts: str) -> str:
    return f"""WITH s0 AS (
      SELECT year, geo_code, sex, age_band, CAST(n AS DOUBLE) AS v,
             CASE WHEN sex IS NULL AND age_band IS NULL THEN 0.0 ELSE CAST(n AS DOUBLE) END AS known
      FROM {counts}),
    t1 AS (SELECT year, geo_code, sum(known) AS nm, sum(v - known) AS m FROM s0 GROUP BY 1, 2),
    s1 AS (
      SELECT s0.year, s0.geo_code, s0.sex, s0.age_band,
             known + CASE WHEN nm > 0 THEN m * known / nm ELSE 0 END AS v
      FROM s0 JOIN t1 ON s0.year = t1.year AND s0.geo_code = t1.geo_code),
    t2 AS (
      SELECT year, geo_code, age_band, sum(CASE WHEN sex IS NOT NULL THEN v ELSE 0 END) AS nm,
             sum(CASE WHEN sex IS NULL THEN v ELSE 0 END) AS m FROM s1 GROUP BY 1, 2, 3),
    s2 AS (
      SELECT s1.year, s1.geo_code, s1.sex, s1.age_band,
             v + CASE WHEN sex IS NOT NULL AND nm > 0 THEN m * v / nm ELSE 0 END AS v
      FROM s1 JOIN t2 ON s1.year = t2.year AND s1.geo_code = t2.geo_code
        AND s1.age_band IS NOT DISTINCT FROM t2.age_band),
    t3 AS (
      SELECT year, geo_code, sex, sum(CASE WHEN age_band IS NOT NULL THEN v ELSE 0 END) AS nm,
             sum(CASE WHEN age_band IS NULL THEN v ELSE 0 END) AS m FROM s2 GROUP BY 1, 2, 3)
    SELECT s2.year, s2.geo_code, s2.sex, s2.age_band,
           v + CASE WHEN nm > 0 THEN m * v / nm ELSE 0 END AS n
    FROM s2 JOIN t3 ON s2.year = t3.year AND s2.geo_code = t3.geo_code AND s2.sex = t3.sex
    WHERE s2.sex IS NOT NULL AND s2.age_band IS NOT NULL"""


def _generations(rates: str) -> str:
    """N*(x) by the published backward recursion."""
    return f"""SELECT geo_code, sex, age_band, deaths * (exp(r * e_open) - (r * e_open) * (r * e_open) / 6) AS v
      FROM {rates} WHERE age_band = 80
    UNION ALL
    SELECT q.geo_code, q.sex, q.age_band, p.v * exp(5 * q.r) + q.deaths * exp(2.5 * q.r)
      FROM {rates}_gen p JOIN {rates} q
        ON p.geo_code = q.geo_code AND p.sex = q.sex AND q.age_band = p.age_band - 5"""


def _rates(pop1: str, source: str) -> str:
    return f"""SELECT a.geo_code, a.sex, a.age_band, a.deaths, e.e_open,
      CASE WHEN {pop1} > 0 AND a.pop2 > 0 THEN ln(a.pop2 / ({pop1})) / 4 ELSE 0 END AS r,
      CASE WHEN a.prev1 > 0 AND a.pop2 > 0 THEN sqrt(a.prev1 * a.pop2 / {'f.delta' if 'delta' in pop1 else '1.0'}) / 5 END AS arrivals
    FROM (SELECT x.*, y.pop1 AS prev1 FROM ddm_input x LEFT JOIN ddm_input y
            ON x.geo_code = y.geo_code AND x.sex = y.sex AND y.age_band = x.age_band - 5) a
    JOIN e_open e ON a.sex = e.sex {source}"""


def _fit(order: str) -> str:
    return f"""SELECT geo_code, sex, lo, hi, ggb, delta FROM (
      SELECT *, row_number() OVER (PARTITION BY geo_code, sex ORDER BY {order}, lo, hi) AS rank
      FROM fits WHERE points >= 8 AND slope > 0 AND r2 IS NOT NULL)
    WHERE rank = 1"""


CTES: dict[str, str] = {
    "raw_deaths": f"""SELECT CAST(11 + n_regionkey AS VARCHAR) || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS mun_code,
      CASE WHEN l_linenumber = 7 THEN '9' WHEN l_linestatus = 'F' THEN '2' ELSE '1' END AS sex_code,
      CASE WHEN l_linenumber >= 6 AND l_returnflag = 'R' THEN 'ign'
           ELSE CAST(CAST(floor((l_quantity - 1) * 1.8e0) AS INTEGER) AS VARCHAR) END AS age_years,
      CAST(o_orderdate AS DATE) AS death_date
    {_PLACED}""",
    "raw_births": """SELECT CAST(11 + n_regionkey AS VARCHAR) || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS mun_code,
      CASE o_orderstatus WHEN 'F' THEN '2' WHEN 'O' THEN '1' ELSE '9' END AS sex_code,
      CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 10 = 0 THEN 'ign'
           ELSE CAST(12 + o_orderkey % 36 AS VARCHAR) END AS mother_age,
      CAST(year(o_orderdate) AS INTEGER) AS year
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "death_records": """SELECT CAST(year(death_date) AS INTEGER) AS year, substr(mun_code, 1, 2) AS geo_code,
      CASE sex_code WHEN '1' THEN 'Masculino' WHEN '2' THEN 'Feminino' END AS sex,
      TRY_CAST(age_years AS DOUBLE) AS age FROM raw_deaths""",
    "birth_records": """SELECT year, substr(mun_code, 1, 2) AS geo_code,
      CASE sex_code WHEN '1' THEN 'Masculino' WHEN '2' THEN 'Feminino' END AS sex,
      TRY_CAST(mother_age AS DOUBLE) AS age FROM raw_births""",
    "dirty_records": f"""SELECT CASE WHEN key % 14 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year,
      CASE WHEN key % 11 NOT IN (0, 1, 3) THEN CAST(11 + n_regionkey AS VARCHAR) END AS geo_code, sex, age
    FROM (SELECT *, l_orderkey + l_linenumber AS key, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linestatus = 'F'
      THEN 'Feminino' ELSE 'Masculino' END AS sex, CASE WHEN l_linenumber < 6 OR l_returnflag <> 'R'
      THEN CAST(CAST(floor((l_quantity - 1) * 1.8e0) AS INTEGER) AS DOUBLE) END AS age {_PLACED})""",
    "dirty_counts": _counts("dirty_records"),
    "nation_records": f"""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS geo_code,
      CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linestatus = 'F' THEN 'Feminino' ELSE 'Masculino' END AS sex,
      CASE WHEN l_linenumber < 6 OR l_returnflag <> 'R' THEN CAST(CAST(floor((l_quantity - 1) * 1.8e0) AS INTEGER) AS DOUBLE) END AS age
    {_PLACED}""",
    "nation_counts": _counts("nation_records"),
    "death_counts": _counts("death_records"),
    "birth_counts": _counts("birth_records"),
    "deaths": _spread("death_counts"),
    "births": _spread("birth_counts"),
    "deaths_80": """SELECT year, geo_code, sex, least(age_band, 80) AS age_band, sum(n) AS n
      FROM deaths GROUP BY 1, 2, 3, 4""",
    "state_population": f"""SELECT CAST(year(o_orderdate) AS INTEGER) AS year,
      CAST(11 + n_regionkey AS VARCHAR) AS geo_code,
      CASE WHEN l_linestatus = 'F' THEN 'Feminino' ELSE 'Masculino' END AS sex,
      CAST(floor(least(floor((l_quantity - 1) * 1.8e0), 80) / 5) * 5 AS INTEGER) AS age_band,
      CAST(count(*) AS BIGINT) AS pop
    {_PLACED} GROUP BY 1, 2, 3, 4""",
    "population": """SELECT * FROM state_population UNION ALL
      SELECT year, 'BR', sex, age_band, CAST(sum(pop) AS BIGINT) FROM state_population GROUP BY 1, 2, 3, 4""",
    "deaths_population": """SELECT p.year, p.geo_code, p.sex, p.age_band, p.pop, coalesce(d.n, 0) AS deaths
      FROM population p LEFT JOIN deaths_80 d ON p.year = d.year AND p.geo_code = d.geo_code
        AND p.sex = d.sex AND p.age_band = d.age_band""",
    "bands": "SELECT CAST(5 * i AS INTEGER) AS age_band FROM range(0, 17) AS t(i)",
    "ddm_input": """SELECT k.geo_code, k.sex, b.age_band, 1996 AS year1, 2000 AS year2,
      CAST(coalesce(c1.pop, 0) AS DOUBLE) AS pop1, CAST(coalesce(c2.pop, 0) AS DOUBLE) AS pop2,
      (coalesce(c1.deaths, 0) + coalesce(c2.deaths, 0)) / 2 AS deaths
    FROM (SELECT DISTINCT geo_code, sex FROM deaths_population WHERE year IN (1996, 2000)) k
    CROSS JOIN bands b
    LEFT JOIN deaths_population c1 ON c1.year = 1996 AND c1.geo_code = k.geo_code AND c1.sex = k.sex
      AND c1.age_band = b.age_band
    LEFT JOIN deaths_population c2 ON c2.year = 2000 AND c2.geo_code = k.geo_code AND c2.sex = k.sex
      AND c2.age_band = b.age_band""",
    "cumulated": """SELECT x.geo_code, x.sex, x.age_band, x.pop1, x.pop2, x.deaths, sum(y.pop1) AS pop1_cum,
      sum(y.pop2) AS pop2_cum, sum(y.deaths) AS deaths_cum
    FROM ddm_input x JOIN ddm_input y ON x.geo_code = y.geo_code AND x.sex = y.sex AND y.age_band >= x.age_band
    GROUP BY ALL""",
    "growth": """SELECT geo_code, sex, age_band,
      CASE WHEN pop1_cum > 0 AND pop2_cum > 0 THEN ln(pop2_cum / pop1_cum) / 4 END AS rx FROM cumulated""",
    "mid_population": """SELECT x.geo_code, x.sex, x.age_band,
      CASE WHEN x.age_band < 75 THEN sqrt(x.pop1 * up.pop2) ELSE sqrt(dn.pop1 * x.pop2) END AS pop_mid
    FROM ddm_input x
    LEFT JOIN ddm_input up ON up.geo_code = x.geo_code AND up.sex = x.sex AND up.age_band = x.age_band + 10
    LEFT JOIN ddm_input dn ON dn.geo_code = x.geo_code AND dn.sex = x.sex AND dn.age_band = x.age_band - 10""",
    "points": """SELECT c.geo_code, c.sex, c.age_band,
      CASE WHEN q.pop1 > 0 AND c.pop2 > 0 THEN sqrt(q.pop1 * c.pop2) / 5 END AS arrivals,
      sqrt(c.pop1_cum * c.pop2_cum) AS exposure,
      CASE WHEN q.pop1 > 0 AND c.pop2 > 0 AND c.pop1_cum > 0
           THEN sqrt(q.pop1 * c.pop2) / 5 / sqrt(c.pop1_cum * c.pop2_cum) - g.rx END AS ggb_left,
      CASE WHEN c.pop1_cum > 0 AND c.pop2_cum > 0
           THEN c.deaths_cum / sqrt(c.pop1_cum * c.pop2_cum) END AS ggb_right
    FROM cumulated c JOIN growth g ON c.geo_code = g.geo_code AND c.sex = g.sex AND c.age_band = g.age_band
    LEFT JOIN cumulated q ON q.geo_code = c.geo_code AND q.sex = c.sex AND q.age_band = c.age_band - 5""",
    "spans": """SELECT a.age_band AS lo, b.age_band AS hi FROM bands a CROSS JOIN bands b
      WHERE a.age_band >= 15 AND b.age_band <= 75 AND b.age_band - a.age_band >= 35""",
    "moments": """SELECT geo_code, sex, lo, hi, count(*) AS points, var_samp(ggb_left) AS vl,
      var_samp(ggb_right) AS vr, covar_samp(ggb_left, ggb_right) AS cov, avg(ggb_left) AS ml, avg(ggb_right) AS mr
    FROM points CROSS JOIN spans
    WHERE age_band BETWEEN lo AND hi AND ggb_left IS NOT NULL AND ggb_right IS NOT NULL
    GROUP BY 1, 2, 3, 4""",
    "fits": """SELECT geo_code, sex, lo, hi, points, sqrt(vl) / sqrt(vr) AS slope, sqrt(vr) / sqrt(vl) AS ggb,
      exp((ml - sqrt(vl) / sqrt(vr) * mr) * 4) AS delta, round(cov * cov / (vl * vr), 12) AS r2,
      round(2 * vl - 2 * sqrt(vl) / sqrt(vr) * cov, 12) AS rms
    FROM moments WHERE vl > 0 AND vr > 0""",
    "fit_r2": _fit("r2 DESC"),
    "fit_rms": _fit("rms"),
    "e_open": """SELECT * FROM (VALUES ('Feminino', CAST(8 AS DOUBLE)), ('Masculino', CAST(7 AS DOUBLE))) AS t(sex, e_open)""",
    "rates_a": _rates("a.pop1", ""),
    "rates_a_gen": _generations("rates_a"),
    "rates_b": _rates(
        "a.pop1 / f.delta", "JOIN fit_r2 f ON a.geo_code = f.geo_code AND a.sex = f.sex"
    ),
    "rates_b_gen": _generations("rates_b"),
    "seg": """SELECT r.geo_code, r.sex, avg(g.v / r.arrivals) FILTER (WHERE r.age_band BETWEEN 15 AND 75) AS seg
      FROM rates_a r JOIN rates_a_gen g ON r.geo_code = g.geo_code AND r.sex = g.sex AND r.age_band = g.age_band
      GROUP BY 1, 2""",
    "ggbseg": """SELECT k.geo_code, k.sex,
      avg(g.v / r.arrivals) FILTER (WHERE r.age_band BETWEEN f.lo AND f.hi) AS ggbseg
      FROM (SELECT DISTINCT geo_code, sex FROM ddm_input) k
      LEFT JOIN rates_b r ON r.geo_code = k.geo_code AND r.sex = k.sex
      LEFT JOIN rates_b_gen g ON r.geo_code = g.geo_code AND r.sex = g.sex AND r.age_band = g.age_band
      LEFT JOIN fit_r2 f ON f.geo_code = k.geo_code AND f.sex = k.sex
      GROUP BY 1, 2""",
    "methods": """SELECT s.geo_code, s.sex, f.ggb, s.seg, b.ggbseg, (f.ggb + s.seg + b.ggbseg) / 3 AS mean_3,
      (f.ggb + b.ggbseg) / 2 AS mean_2
    FROM seg s JOIN ggbseg b ON s.geo_code = b.geo_code AND s.sex = b.sex
    LEFT JOIN fit_r2 f ON f.geo_code = s.geo_code AND f.sex = s.sex""",
    "chosen": """SELECT geo_code, sex, CASE WHEN mean_2 < 1 THEN mean_2 WHEN mean_2 > 1 AND ggbseg < 1 THEN ggbseg
      WHEN mean_2 > 1 AND ggbseg > 1 AND ggb < 1 THEN ggb ELSE seg END AS coverage FROM methods""",
    "adjusted": """SELECT d.geo_code, d.sex, d.age_band, d.deaths / c.coverage AS deaths_adj
      FROM ddm_input d LEFT JOIN chosen c ON d.geo_code = c.geo_code AND d.sex = c.sex""",
    "profile": """SELECT x.geo_code, x.sex, x.age_band, x.deaths_cum, x.pop_cum, x.deaths_cum / x.pop_cum AS cdr_adj,
      g.rx, x.deaths_cum / x.pop_cum + g.rx AS birth_rate_implied
    FROM (SELECT a.geo_code, a.sex, a.age_band, sum(b.deaths_adj) AS deaths_cum, sum(m.pop_mid) AS pop_cum
          FROM adjusted a JOIN adjusted b ON a.geo_code = b.geo_code AND a.sex = b.sex AND b.age_band >= a.age_band
          JOIN mid_population m ON b.geo_code = m.geo_code AND b.sex = m.sex AND b.age_band = m.age_band
          GROUP BY 1, 2, 3) x
    JOIN growth g ON x.geo_code = g.geo_code AND x.sex = g.sex AND x.age_band = g.age_band""",
    "births_by_year": "SELECT year, geo_code, sex, sum(n) AS births FROM births GROUP BY 1, 2, 3",
    "estimates": """SELECT p.geo_code, p.sex, y.year, b.births / p.pop_cum AS cbr, p.birth_rate_implied,
      p.birth_rate_implied / (b.births / p.pop_cum) AS coverage_b,
      (b.births / p.pop_cum) / p.birth_rate_implied AS completeness
    FROM profile p CROSS JOIN (VALUES (1996), (2000)) AS y(year)
    LEFT JOIN births_by_year b ON b.geo_code = p.geo_code AND b.sex = p.sex AND b.year = y.year
    WHERE p.age_band = 0""",
    "paired": """SELECT a.geo_code, a.sex, a.coverage_b AS coverage_y1, b.coverage_b AS coverage_y2,
      b.coverage_b / a.coverage_b AS ratio
    FROM estimates a JOIN estimates b ON a.geo_code = b.geo_code AND a.sex = b.sex
    WHERE a.year = 1996 AND b.year = 2000""",
    "geo_dim": """SELECT CAST(11 + r_regionkey AS VARCHAR) AS geo_code, r_name AS geo_name,
      CAST(r_regionkey AS INTEGER) AS geo_ord FROM region UNION ALL SELECT 'BR', 'TOTAL', 99""",
    "levels": """SELECT * FROM (VALUES ('Feminino', 0.5e0, 9e0), ('Feminino', 1e0, 8e0), ('Feminino', 1.5e0, 7e0),
      ('Feminino', 2.5e0, 5e0), ('Masculino', 0.5e0, 8e0), ('Masculino', 1e0, 7e0), ('Masculino', 1.5e0, 6.5e0),
      ('Masculino', 2.5e0, 4.5e0)) AS t(sex, ratio, e_open)""",
    "death_ratios": """SELECT x.geo_code, x.sex,
      sum(x.adjusted) FILTER (WHERE x.age_band BETWEEN 10 AND 39)
        / nullif(sum(x.adjusted) FILTER (WHERE x.age_band BETWEEN 40 AND 59), 0) AS death_ratio
    FROM (SELECT a.geo_code, a.sex, a.age_band,
            a.deaths * exp(5 * coalesce((SELECT sum(b.r) FROM rates_a b WHERE b.geo_code = a.geo_code
              AND b.sex = a.sex AND b.age_band < a.age_band), 0) + 2.5 * a.r) AS adjusted FROM rates_a a) x
    GROUP BY 1, 2""",
}

_ROUNDED = "round({0}, {1}) + 0.0 AS {0}"


def _r(digits: int, *cols: str) -> str:
    return ", ".join(_ROUNDED.format(c, digits) for c in cols)


_CELL = "year, geo_code, sex, age_band"
_KEY = "geo_code, sex, age_band"
_METHODS = ("ggb", "seg", "ggbseg", "mean_3", "mean_2")
_LONG = " UNION ALL ".join(f"SELECT geo_code, sex, '{m}' AS method, {m} AS coverage FROM methods" for m in _METHODS)
_DENSE = """(SELECT y.year, k.geo_code, k.sex, b.age_band, coalesce(c.n, 0) AS n
      FROM (SELECT DISTINCT geo_code, sex FROM {0}) k CROSS JOIN (SELECT DISTINCT year FROM {0}) y
      CROSS JOIN (SELECT CAST(5 * i AS INTEGER) AS age_band FROM range(0, 18) AS t(i)) b
      LEFT JOIN {0} c ON c.year = y.year AND c.geo_code = k.geo_code AND c.sex = k.sex AND c.age_band = b.age_band)"""
_SMOOTH = f"""WITH cells AS {_DENSE}
SELECT a.year, a.geo_code, a.sex, a.age_band, round(a.n, 6) + 0.0 AS n, round(avg(b.n), 6) + 0.0 AS n_smooth,
  CAST(count(*) AS INTEGER) AS n_years
FROM cells a JOIN cells b ON a.geo_code = b.geo_code AND a.sex = b.sex AND a.age_band = b.age_band
  AND b.year BETWEEN a.year - 1 AND a.year + 1
GROUP BY a.year, a.geo_code, a.sex, a.age_band, a.n"""

# the value that a model life table gives for the ratio of a place and sex
_LEVEL_VALUE = """SELECT d.geo_code, d.sex, d.death_ratio,
      CASE WHEN d.death_ratio <= lo.ratio THEN lo.e_open WHEN d.death_ratio > hi.ratio THEN hi.e_open
           ELSE s.e0 + (s.e1 - s.e0) / (s.r1 - s.r0) * (d.death_ratio - s.r0) END AS e_open
    FROM death_ratios d
    JOIN (SELECT sex, min(ratio) AS ratio, arg_min(e_open, ratio) AS e_open FROM levels GROUP BY 1) lo ON d.sex = lo.sex
    JOIN (SELECT sex, max(ratio) AS ratio, arg_max(e_open, ratio) AS e_open FROM levels GROUP BY 1) hi ON d.sex = hi.sex
    LEFT JOIN (SELECT a.sex, a.ratio AS r0, a.e_open AS e0, b.ratio AS r1, b.e_open AS e1 FROM levels a
               JOIN levels b ON a.sex = b.sex AND b.ratio = (SELECT min(c.ratio) FROM levels c
                 WHERE c.sex = a.sex AND c.ratio > a.ratio)) s
      ON s.sex = d.sex AND d.death_ratio > s.r0 AND d.death_ratio <= s.r1"""

# some places, one with a quote in its name, in their fixed order
_PLACES = """SELECT * FROM (VALUES ('11','Rondônia',1),('12','Acre',2),('13','Amazonas',3),('14','Roraima',4),('15','Pará',5),
  ('16','Amapá',6),('17','Tocantins',7),('21','Maranhão',8),('22','Piauí',9),('23','Ceará',10),('24','Rio Grande do Norte',11),
  ('25','Paraíba',12),('26','Pernambuco',13),('27','Alagoas',14),('28','Sergipe',15),('29','Bahia',16),('31','Minas Gerais',17),
  ('32','Espírito Santo',18),('33','Rio de Janeiro',19),('35','São Paulo',20),('41','Paraná',21),('42','Santa Catarina',22),
  ('43','Rio Grande do Sul',23),('50','Mato Grosso do Sul',24),('51','Mato Grosso',25),('52','Goiás',26),
  ('53','Distrito Federal',27),('BR','Brasil',28),('00','Sant''Ana d''Oeste',29)) AS t(geo_code, geo_name, geo_ord)"""

FINAL: dict[str, str] = {
    "scan_slim": "SELECT * FROM death_records",
    "scan_slim_births": "SELECT * FROM birth_records",
    "age_band": """SELECT year, geo_code, sex, CASE WHEN age < 0 OR age >= 125 THEN NULL WHEN age >= 85 THEN 85
      ELSE CAST(age AS INTEGER) - CAST(age AS INTEGER) % 5 END AS age_band FROM death_records""",
    "decode_labels": """SELECT g.geo_name, g.geo_ord, CASE b.sex WHEN 'Masculino' THEN 'm' WHEN 'Feminino' THEN 'f'
      ELSE 'unknown' END AS sex, count(*) AS n
    FROM birth_records b LEFT JOIN geo_dim g ON b.geo_code = g.geo_code GROUP BY 1, 2, 3""",
    "tabulate_deaths": "SELECT * FROM death_counts",
    "tabulate_births": "SELECT * FROM birth_counts",
    "tabulate_dirty": "SELECT * FROM dirty_counts",
    "tabulate_by_nation": "SELECT * FROM nation_counts",
    "missing_flags": f"""SELECT {_CELL}, n, CASE WHEN age_band IS NULL THEN 1 ELSE 0 END AS age_missing,
      CASE WHEN sex IS NULL THEN 1 ELSE 0 END AS sex_missing,
      CASE WHEN age_band IS NULL AND sex IS NULL THEN 1 ELSE 0 END AS both_missing FROM death_counts""",
    "split_measure": f"""SELECT {_CELL}, CAST(CASE WHEN sex IS NULL THEN 0 ELSE n END AS DOUBLE) AS n_known,
      CAST(CASE WHEN sex IS NULL THEN n ELSE 0 END AS DOUBLE) AS n_missing FROM death_counts""",
    "redistribute_deaths": f"SELECT {_CELL}, {_r(6, 'n')} FROM deaths",
    "redistribute_births": f"SELECT {_CELL}, {_r(6, 'n')} FROM births",
    "redistribution_mass": """SELECT c.year, c.geo_code, round(c.n, 4) + 0.0 AS n_before, round(d.n, 4) + 0.0 AS n_after,
      round(c.n - d.n, 4) + 0.0 AS n_lost
    FROM (SELECT year, geo_code, CAST(sum(n) AS DOUBLE) AS n FROM death_counts GROUP BY 1, 2) c
    LEFT JOIN (SELECT year, geo_code, sum(n) AS n FROM deaths GROUP BY 1, 2) d
      ON c.year = d.year AND c.geo_code = d.geo_code""",
    "population_total": "SELECT * FROM population",
    "reband_80": f"SELECT {_CELL}, {_r(6, 'n')} FROM deaths_80",
    "mean_deaths": f"""SELECT {_KEY}, round(sum(n) / 2, 6) + 0.0 AS n FROM deaths_80 WHERE year IN (1996, 2000)
      GROUP BY 1, 2, 3""",
    "mean_deaths_sparse": f"""WITH kept AS (SELECT year, geo_code, sex, least(age_band, 80) AS age_band, sum(n) AS n FROM deaths
        WHERE NOT (age_band % 25 = 10 AND year = CASE WHEN sex = 'Feminino' THEN 1996 ELSE 2000 END) GROUP BY 1, 2, 3, 4),
      once AS (SELECT {_KEY}, sum(n) / 2 AS n FROM kept WHERE year IN (1996, 2000) GROUP BY 1, 2, 3)
    SELECT i.geo_code, i.sex, i.age_band, round(o.n, 6) + 0.0 AS mean_deaths,
      round((SELECT coalesce(sum(k.n), 0) FROM kept k JOIN population p ON p.year = k.year AND p.geo_code = k.geo_code
        AND p.sex = k.sex AND p.age_band = k.age_band WHERE k.year IN (1996, 2000) AND k.geo_code = i.geo_code
        AND k.sex = i.sex AND k.age_band = i.age_band) / 2, 6) + 0.0 AS deaths
    FROM ddm_input i LEFT JOIN once o ON o.geo_code = i.geo_code AND o.sex = i.sex AND o.age_band = i.age_band""",
    "births_total": f"SELECT year, geo_code, sex, {_r(6, 'births')} FROM births_by_year",
    "deaths_population": f"SELECT {_CELL}, pop, {_r(6, 'deaths')} FROM deaths_population",
    "unmatched_keys": f"""WITH d AS (SELECT DISTINCT year, geo_code, sex,
        CASE WHEN age_band > 80 THEN 80 ELSE age_band END AS age_band FROM death_counts)
    SELECT {_CELL}, 'left' AS side FROM d WHERE NOT EXISTS (SELECT 1 FROM population p WHERE p.year = d.year
      AND p.geo_code = d.geo_code AND p.sex = d.sex AND p.age_band = d.age_band)
    UNION ALL
    SELECT {_CELL}, 'right' FROM population p WHERE NOT EXISTS (SELECT 1 FROM d WHERE p.year = d.year
      AND p.geo_code = d.geo_code AND p.sex = d.sex AND p.age_band = d.age_band)""",
    "missing_bands": """SELECT k.year, k.geo_code, k.sex, b.age_band
    FROM (SELECT DISTINCT year, geo_code, sex FROM birth_counts) k CROSS JOIN bands b
    WHERE NOT EXISTS (SELECT 1 FROM birth_counts c WHERE c.year = k.year AND c.geo_code = k.geo_code
      AND c.sex IS NOT DISTINCT FROM k.sex AND c.age_band = b.age_band)""",
    "densify": """SELECT k.year, k.geo_code, k.sex, b.age_band, round(coalesce(c.n, 0), 6) + 0.0 AS n
    FROM (SELECT DISTINCT year, geo_code, sex FROM births) k CROSS JOIN bands b
    LEFT JOIN births c ON c.year = k.year AND c.geo_code = k.geo_code AND c.sex = k.sex AND c.age_band = b.age_band""",
    "ddm_input": f"SELECT {_KEY}, year1, year2, pop1, pop2, {_r(6, 'deaths')} FROM ddm_input",
    "reverse_cumulative": f"""SELECT {_KEY}, 1996 AS year1, 2000 AS year2, pop1, pop2, pop1_cum, pop2_cum,
      {_r(6, 'deaths', 'deaths_cum')} FROM cumulated""",
    "growth_rates": f"SELECT {_KEY}, {_r(9, 'rx')} FROM growth",
    "mid_population": f"SELECT {_KEY}, {_r(6, 'pop_mid')} FROM mid_population",
    "moving_average_deaths": _SMOOTH.format("deaths"),
    "moving_average_births": _SMOOTH.format("births"),
    "ggb_points": f"SELECT {_KEY}, {_r(6, 'arrivals', 'exposure', 'ggb_left', 'ggb_right')} FROM points",
    "ggb_fit": f"""SELECT k.geo_code, k.sex, lo AS fit_lo, hi AS fit_hi, {_r(9, 'ggb', 'delta')}
      FROM (SELECT DISTINCT geo_code, sex FROM ddm_input) k
      LEFT JOIN fit_r2 f ON f.geo_code = k.geo_code AND f.sex = k.sex""",
    "ggb_fit_rms": f"""SELECT k.geo_code, k.sex, lo AS fit_lo, hi AS fit_hi, {_r(9, 'ggb', 'delta')}
      FROM (SELECT DISTINCT geo_code, sex FROM ddm_input) k
      LEFT JOIN fit_rms f ON f.geo_code = k.geo_code AND f.sex = k.sex""",
    "seg": f"SELECT geo_code, sex, {_r(6, 'seg')} FROM seg",
    "ggb_seg": f"SELECT geo_code, sex, {_r(9, 'ggbseg')} FROM ggbseg",
    "e_open_levels": f"SELECT geo_code, sex, {_r(6, 'death_ratio', 'e_open')} FROM ({_LEVEL_VALUE})",
    "death_coverage": f"SELECT geo_code, sex, {_r(6, *_METHODS)} FROM methods",
    "choose_coverage": f"SELECT geo_code, sex, {_r(6, 'coverage')} FROM chosen",
    "methods_long": f"SELECT geo_code, sex, method, {_r(6, 'coverage')} FROM ({_LONG})",
    "methods_long_short_list": f"""SELECT geo_code, sex, CASE method WHEN 'mean_2' THEN 'mean' ELSE method END AS method,
      {_r(6, 'coverage')} FROM ({_LONG}) WHERE method IN ('ggb', 'ggbseg', 'mean_2')""",
    "value_range": f"""SELECT round(min(coverage), 6) + 0.0 AS min_value, round(max(coverage), 6) + 0.0 AS max_value
      FROM ({_LONG})""",
    "adjust_deaths": f"SELECT {_KEY}, {_r(4, 'deaths_adj')} FROM adjusted",
    "adjust_deaths_joined": f"""SELECT {_KEY}, round(d.deaths / (SELECT max(c.deaths) / sum(c.deaths) FROM ddm_input c
      WHERE c.geo_code = d.geo_code AND c.sex = d.sex), 4) + 0.0 AS deaths_adj FROM ddm_input d""",
    "implied_birth_profile": f"""SELECT {_KEY}, {_r(4, 'deaths_cum', 'pop_cum')},
      {_r(6, 'cdr_adj', 'rx', 'birth_rate_implied')} FROM profile""",
    "implied_birth_rate": f"""SELECT geo_code, sex, {_r(4, 'deaths_cum', 'pop_cum')},
      {_r(6, 'cdr_adj', 'rx', 'birth_rate_implied')} FROM profile WHERE age_band = 0""",
    "birth_coverage": f"""SELECT geo_code, sex, year,
      {_r(6, 'cbr', 'birth_rate_implied', 'coverage_b', 'completeness')} FROM estimates""",
    "compare_years": f"SELECT geo_code, sex, {_r(6, 'coverage_y1', 'coverage_y2')} FROM paired",
    "coverage_ratio": f"""SELECT geo_code, sex, {_r(6, 'coverage_y1', 'coverage_y2', 'ratio')},
      CASE WHEN ratio < 1 THEN '2000 < 1996' WHEN ratio > 1 THEN '2000 > 1996' ELSE '2000 = 1996' END AS ratio_class,
      ratio IS NULL AS is_missing FROM paired""",
    "region_result": f"""SELECT p.geo_code, g.geo_name, r.r_name AS region, p.sex,
      CASE WHEN ratio < 1 THEN '2000 < 1996' WHEN ratio > 1 THEN '2000 > 1996' ELSE '2000 = 1996' END AS ratio_class,
      {_r(6, 'coverage_y1', 'coverage_y2', 'ratio')}, hex('region ' || r.r_regionkey) AS geometry
    FROM paired p LEFT JOIN geo_dim g ON p.geo_code = g.geo_code
    LEFT JOIN region r ON p.geo_code = CAST(11 + r.r_regionkey AS VARCHAR)
    WHERE p.geo_code <> 'BR'""",
    "display_order": f"""SELECT g.geo_ord, g.geo_name, e.sex, e.year, {_r(6, 'coverage_b')}
    FROM estimates e LEFT JOIN geo_dim g ON e.geo_code = g.geo_code ORDER BY g.geo_ord, e.sex, e.year""",
    "state_names": f"""SELECT p.geo_code, CAST(c.n AS BIGINT) AS n, p.geo_name, p.geo_ord FROM ({_PLACES}) p
    LEFT JOIN (SELECT geo_code, sum(n) AS n FROM birth_counts GROUP BY 1) c ON c.geo_code = p.geo_code""",
}


def _smoothed(plain: str) -> str:
    """Three-year means, with 0 for the years and bands a place and sex has no events in."""
    return f"""WITH cells AS {_DENSE.format(plain)}
    SELECT x.year, x.geo_code, x.sex, x.age_band, avg(y.n) AS n FROM cells x JOIN cells y
      ON x.geo_code = y.geo_code AND x.sex = y.sex AND x.age_band = y.age_band AND abs(x.year - y.year) <= 1
    GROUP BY 1, 2, 3, 4"""


# the same blocks with smoothed counts in the place of the yearly ones
SMOOTH_CTES: dict[str, str] = {}
for _name, _body in CTES.items():
    if _name in ("deaths", "births"):
        SMOOTH_CTES[f"yearly_{_name}"] = _body
        SMOOTH_CTES[_name] = _smoothed(f"yearly_{_name}")
    else:
        SMOOTH_CTES[_name] = _body


def _needed(sql: str, blocks: dict[str, str]) -> set[str]:
    """Every building block the text refers to, directly or through others."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in (words & blocks.keys()) - found:
            found.add(name)
            todo.append(blocks[name])
    return found


def sql_for(final: str, blocks: dict[str, str]) -> str:
    used = _needed(final, blocks)
    ctes = [f"{name} AS (\n    {body})" for name, body in blocks.items() if name in used]
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\nSELECT * FROM (\n    " + final + ")"


# and with the median over the fitted ages for both methods
MEDIAN_CTES = CTES | {
    "seg": """SELECT k.geo_code, k.sex,
      median(g.v / r.arrivals) FILTER (WHERE r.age_band BETWEEN f.lo AND f.hi) AS seg
      FROM (SELECT DISTINCT geo_code, sex FROM ddm_input) k
      LEFT JOIN rates_a r ON r.geo_code = k.geo_code AND r.sex = k.sex
      LEFT JOIN rates_a_gen g ON r.geo_code = g.geo_code AND r.sex = g.sex AND r.age_band = g.age_band
      LEFT JOIN fit_r2 f ON f.geo_code = k.geo_code AND f.sex = k.sex
      GROUP BY 1, 2""",
    "ggbseg": CTES["ggbseg"].replace("avg(g.v", "median(g.v"),
}

# and with the life expectancy of each place and sex read off the levels
LEVEL_CTES: dict[str, str] = {}
for _name, _body in CTES.items():
    if _name == "rates_a":
        LEVEL_CTES |= {
            "rates_0": _body,
            "levels": CTES["levels"],
            "death_ratios": CTES["death_ratios"].replace("rates_a", "rates_0"),
            "e_place": _LEVEL_VALUE,
        }
    if _name not in LEVEL_CTES:
        by_sex, by_place = "JOIN e_open e ON a.sex = e.sex", "JOIN e_place e ON a.sex = e.sex AND a.geo_code = e.geo_code"
        LEVEL_CTES[_name] = _body.replace(by_sex, by_place)

# the second census corrected, or both by half: the recursion on the rescaled counts
def _rescaled(first: str, second: str) -> dict[str, str]:
    return CTES | {
        "rates_b": f"""SELECT a.geo_code, a.sex, a.age_band, a.deaths, e.e_open,
      CASE WHEN a.pop1 > 0 AND a.pop2 > 0 THEN ln(a.pop2 * {second} / (a.pop1 * {first})) / 4 ELSE 0 END AS r,
      CASE WHEN q.pop1 > 0 AND a.pop2 > 0 THEN sqrt(q.pop1 * {first} * a.pop2 * {second}) / 5 END AS arrivals
    FROM ddm_input a JOIN e_open e ON a.sex = e.sex JOIN fit_r2 f ON a.geo_code = f.geo_code AND a.sex = f.sex
    LEFT JOIN ddm_input q ON q.geo_code = a.geo_code AND q.sex = a.sex AND q.age_band = a.age_band - 5"""
    }


# a fit by the mean distance of the points from the line
CUSTOM_CTES: dict[str, str] = {}
for _name, _body in CTES.items():
    if _name == "fit_r2":
        CUSTOM_CTES["distances"] = """SELECT m.geo_code, m.sex, m.lo, m.hi, round(avg(abs(p.ggb_left - sqrt(vl) / sqrt(vr) * p.ggb_right
        - (ml - sqrt(vl) / sqrt(vr) * mr))), 12) AS mad
      FROM moments m JOIN points p ON p.geo_code = m.geo_code AND p.sex = m.sex AND p.age_band BETWEEN m.lo AND m.hi
      WHERE vl > 0 AND vr > 0 AND p.ggb_left IS NOT NULL AND p.ggb_right IS NOT NULL GROUP BY 1, 2, 3, 4"""
        _body = """SELECT geo_code, sex, lo, hi, ggb, delta FROM (
      SELECT f.*, row_number() OVER (PARTITION BY f.geo_code, f.sex ORDER BY mad, f.lo, f.hi) AS rank
      FROM fits f JOIN distances d ON d.geo_code = f.geo_code AND d.sex = f.sex AND d.lo = f.lo AND d.hi = f.hi
      WHERE points >= 8 AND slope > 0) WHERE rank = 1"""
    CUSTOM_CTES[_name] = _body

# levels of each place: those by sex, moved by the last digit of its code
PLACE_CTES = CTES | {
    "place_levels": """SELECT k.geo_code, l.sex, l.ratio + k.shift AS ratio, l.e_open - k.shift AS e_open
      FROM (SELECT DISTINCT geo_code, sex, coalesce(TRY_CAST(geo_code AS INTEGER), 0) % 4 / 10 AS shift
            FROM population WHERE year IN (1996, 2000)) k JOIN levels l ON l.sex = k.sex""",
    "read_levels": """SELECT d.geo_code, d.sex, d.death_ratio,
      (SELECT max_by(e_open, ratio) FROM place_levels l WHERE l.geo_code = d.geo_code AND l.sex = d.sex AND l.ratio <= d.death_ratio) AS e0,
      (SELECT max(ratio) FROM place_levels l WHERE l.geo_code = d.geo_code AND l.sex = d.sex AND l.ratio <= d.death_ratio) AS r0,
      (SELECT min_by(e_open, ratio) FROM place_levels l WHERE l.geo_code = d.geo_code AND l.sex = d.sex AND l.ratio > d.death_ratio) AS e1,
      (SELECT min(ratio) FROM place_levels l WHERE l.geo_code = d.geo_code AND l.sex = d.sex AND l.ratio > d.death_ratio) AS r1
    FROM death_ratios d""",
}

# infants and children apart, and two bands of ten years
_UNEVEN = (0, 1, 5, 10, 15, 20, 25, 30, 35, 45, 55, 60, 65, 70, 75, 80)
_BREAKS = "[" + ", ".join(map(str, _UNEVEN)) + "]"
_BAND = f"CAST(list_max(list_filter({_BREAKS}, lambda x: x <= age)) AS INTEGER)"


def _uneven_counts(records: str) -> str:
    banded = f"(SELECT year, geo_code, sex, CASE WHEN age >= 0 AND age < 125 THEN {_BAND} END AS age_band FROM {records})"
    return f"""SELECT year, geo_code, sex, age_band, count(*) AS n FROM {banded} GROUP BY 1, 2, 3, 4
    UNION ALL SELECT year, 'BR', sex, age_band, count(*) FROM {banded} GROUP BY 1, 2, 3, 4"""


def _uneven_rates(first: str, source: str) -> str:
    """Growth and arrivals of the bands, the first count multiplied by ``first``."""
    return f"""SELECT a.geo_code, a.sex, a.age_band, a.deaths, e.e_open, g.w, g.next_age,
      CASE WHEN a.pop1 > 0 AND a.pop2 > 0 THEN ln(a.pop2 / (a.pop1 * {first})) / 4 ELSE 0 END AS r,
      CASE WHEN q.pop1 > 0 AND a.pop2 > 0 THEN sqrt(q.pop1 * {first} / g.w_prev * (a.pop2 / g.w))
        * CASE WHEN a.pop1 > 0 AND q.pop2 > 0 AND g.w <> g.w_prev
          THEN pow(q.pop1 * {first} / g.w_prev / (a.pop2 / g.w)
            * exp(2 * (ln(a.pop2 / (a.pop1 * {first})) / 4 + ln(q.pop2 / (q.pop1 * {first})) / 4)), g.w / (g.w + g.w_prev) - 0.5)
          ELSE 1 END END AS arrivals
    FROM ddm_input a JOIN grid g ON g.age_band = a.age_band JOIN e_open e ON a.sex = e.sex {source}
    LEFT JOIN ddm_input q ON q.geo_code = a.geo_code AND q.sex = a.sex AND q.age_band = g.prev_age"""


def _uneven_generations(rates: str) -> str:
    return f"""SELECT geo_code, sex, age_band, deaths * (exp(r * e_open) - (r * e_open) * (r * e_open) / 6) AS v
      FROM {rates} WHERE age_band = 80
    UNION ALL
    SELECT q.geo_code, q.sex, q.age_band, p.v * exp(q.w * q.r) + q.deaths * exp(q.w * q.r / 2)
      FROM {rates}_gen p JOIN {rates} q ON p.geo_code = q.geo_code AND p.sex = q.sex AND q.next_age = p.age_band"""


_PARTNER = """(SELECT sum(CASE WHEN gy.next_age IS NULL THEN y.{0}
        ELSE y.{0} * (least({1} + g.w, gy.next_age) - greatest({1}, y.age_band)) / gy.w END)
      FROM ddm_input y JOIN grid gy ON gy.age_band = y.age_band WHERE y.geo_code = x.geo_code AND y.sex = x.sex
        AND {1} >= 0 AND {1} + g.w > y.age_band AND (gy.next_age IS NULL OR gy.next_age > {1}))"""

UNEVEN_CTES: dict[str, str] = {}
for _name, _body in CTES.items():
    UNEVEN_CTES[_name] = {
        "death_counts": _uneven_counts("death_records"),
        "state_population": CTES["state_population"].replace("floor(least(floor((l_quantity - 1) * 1.8e0), 80) / 5) * 5", _BAND.replace("<= age", "<= floor((l_quantity - 1) * 1.8e0)")),
        "bands": f"SELECT CAST(unnest({_BREAKS}) AS INTEGER) AS age_band",
        "mid_population": f"""SELECT x.geo_code, x.sex, x.age_band,
      CASE WHEN x.age_band < 75 THEN sqrt(x.pop1 * {_PARTNER.format('pop2', '(x.age_band + 10)')})
           ELSE sqrt({_PARTNER.format('pop1', '(x.age_band - 10)')} * x.pop2) END AS pop_mid
    FROM ddm_input x JOIN grid g ON g.age_band = x.age_band""",
        "points": """SELECT c.geo_code, c.sex, c.age_band, r.arrivals, sqrt(c.pop1_cum * c.pop2_cum) AS exposure,
      CASE WHEN c.pop1_cum > 0 AND c.pop2_cum > 0 THEN r.arrivals / sqrt(c.pop1_cum * c.pop2_cum) - g.rx END AS ggb_left,
      CASE WHEN c.pop1_cum > 0 AND c.pop2_cum > 0 THEN c.deaths_cum / sqrt(c.pop1_cum * c.pop2_cum) END AS ggb_right
    FROM cumulated c JOIN growth g ON c.geo_code = g.geo_code AND c.sex = g.sex AND c.age_band = g.age_band
    JOIN rates_a r ON c.geo_code = r.geo_code AND c.sex = r.sex AND c.age_band = r.age_band""",
        "spans": "SELECT a.age_band AS lo, b.age_band AS hi FROM bands a CROSS JOIN bands b WHERE a.age_band >= 15 AND b.age_band <= 75 AND b.age_band > a.age_band",
        "rates_a_gen": _uneven_generations("rates_a"),
        "rates_b": _uneven_rates("(1 / f.delta)", "JOIN fit_r2 f ON a.geo_code = f.geo_code AND a.sex = f.sex"),
        "rates_b_gen": _uneven_generations("rates_b"),
    }.get(_name, _body)
    if _name == "bands":
        UNEVEN_CTES["grid"] = """SELECT age_band, lead(age_band) OVER (ORDER BY age_band) AS next_age, lag(age_band) OVER (ORDER BY age_band) AS prev_age,
      CAST(coalesce(lead(age_band) OVER (ORDER BY age_band) - age_band, age_band - lag(age_band) OVER (ORDER BY age_band)) AS DOUBLE) AS w,
      CAST(age_band - lag(age_band) OVER (ORDER BY age_band) AS DOUBLE) AS w_prev FROM bands"""
    if _name == "mid_population":  # growth of the bands comes before the points made of it
        UNEVEN_CTES["e_open"] = CTES["e_open"]
        UNEVEN_CTES["rates_a"] = _uneven_rates("1.0", "")
UNEVEN_CTES["rates_a"] = _uneven_rates("1.0", "")

DIRTY = f"""SELECT l_orderkey + l_linenumber AS key, o_orderdate, CAST(11 + n_regionkey AS VARCHAR) || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS code,
      l_linenumber, l_linestatus, l_returnflag, l_quantity {_PLACED}"""
HIERARCHY_CTES = CTES | {
    "placed_records": f"""SELECT CASE WHEN key % 14 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year,
      CASE WHEN key % 11 NOT IN (0, 1, 3) THEN code END AS code,
      CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linestatus = 'F' THEN 'Feminino' ELSE 'Masculino' END AS sex,
      CASE WHEN l_linenumber < 6 OR l_returnflag <> 'R' THEN CAST(floor((l_quantity - 1) * 1.8e0) AS INTEGER) END AS age FROM ({DIRTY})""",
    "placed_cells": """SELECT year, code, sex, CASE WHEN age >= 85 THEN 85 ELSE age - age % 5 END AS age_band FROM placed_records""",
    "faulty_deaths": DIRTY,
}

_LEVELS = {"municipality": "left(code, 6)", "state": "left(code, 2)", "region": "left(code, 1)", "country": "'BR'"}
MORE: dict[str, tuple[dict[str, str], str]] = {
    "age_band_breaks": (CTES, f"""SELECT r.year, r.geo_code, r.sex, b.lo AS age_band, CAST(b.hi - b.lo AS INTEGER) AS band_width FROM death_records r
      LEFT JOIN (SELECT CAST(unnest({_BREAKS}) AS INTEGER) AS lo, unnest([*({_BREAKS})[2:], NULL]) AS hi) b
        ON r.age >= b.lo AND r.age < coalesce(b.hi, 125)""".replace("[*(", "list_concat((").replace(")[2:], NULL]", ")[2:], [NULL])")),
    "tabulate_breaks": (UNEVEN_CTES, "SELECT * FROM death_counts"),
    "ggb_points_uneven": (UNEVEN_CTES, FINAL["ggb_points"]),
    "ggb_fit_uneven": (UNEVEN_CTES, FINAL["ggb_fit"]),
    "seg_uneven": (UNEVEN_CTES, FINAL["seg"]),
    "ggb_seg_uneven": (UNEVEN_CTES, FINAL["ggb_seg"]),
    "mid_population_uneven": (UNEVEN_CTES, FINAL["mid_population"]),
    "birth_coverage_uneven": (UNEVEN_CTES, FINAL["birth_coverage"]),
    "ggb_seg_second": (_rescaled("1", "f.delta"), FINAL["ggb_seg"]),
    "ggb_seg_both": (_rescaled("(1 / sqrt(f.delta))", "sqrt(f.delta)"), FINAL["ggb_seg"]),
    "ggb_fit_custom": (CUSTOM_CTES, FINAL["ggb_fit"]),
    "tabulate_hierarchy": (HIERARCHY_CTES, " UNION ALL ".join(
        f"SELECT year, sex, age_band, '{level}' AS level, {code} AS geo_code, count(*) AS n FROM placed_cells GROUP BY ALL" for level, code in _LEVELS.items())),
    "population_hierarchy": (CTES, " UNION ALL ".join(
        f"SELECT year, sex, age_band, '{level}' AS level, {code} AS geo_code, CAST(sum(pop) AS BIGINT) AS pop FROM state_population GROUP BY ALL"
        for level, code in {"state": "geo_code", "zone": "CASE WHEN CAST(geo_code AS INTEGER) % 2 = 0 THEN 'even' ELSE 'odd' END", "country": "'BR'"}.items())),
    "record_quality": (HIERARCHY_CTES, """SELECT 'deaths' AS kind, unnest(['records', 'no_age', 'bad_age', 'age_outside', 'bad_sex', 'bad_place', 'undated', 'filed_elsewhere']) AS metric,
        unnest([count(*), 0, count(*) FILTER (l_linenumber >= 6 AND l_returnflag = 'R'), 0, count(*) FILTER (l_linenumber = 7), count(*) FILTER (key % 11 IN (0, 1, 3)),
          count(*) FILTER (key % 7 = 0), count(*) FILTER (key % 7 <> 0 AND key % 17 = 0)]) AS n FROM faulty_deaths
      UNION ALL SELECT 'births', unnest(['records', 'no_age', 'bad_age', 'age_outside', 'bad_sex', 'bad_place']),
        unnest([count(*), 0, count(*) FILTER (mother_age = 'ign'), 0, count(*) FILTER (sex_code NOT IN ('1', '2')), 0]) FROM raw_births"""),
    "e_open_levels_by_place": (PLACE_CTES, f"""SELECT geo_code, sex, {_r(6, 'death_ratio', 'e_open')} FROM (SELECT geo_code, sex, death_ratio,
        CASE WHEN r0 IS NULL THEN e1 WHEN r1 IS NULL THEN e0 ELSE e0 + (e1 - e0) * (death_ratio - r0) / (r1 - r0) END AS e_open FROM read_levels)"""),
    "stored_deaths": (CTES, "SELECT *, CAST(year(death_date) AS INTEGER) AS year FROM raw_deaths WHERE year(death_date) IN (1996, 2000)"),
    "stored_births": (CTES, "SELECT * FROM raw_births WHERE year IN (1996, 2000)"),
    "stored_population": (CTES, """SELECT year, geo_code, CASE sex WHEN 'Feminino' THEN 'Female' ELSE 'Male' END AS sex_label,
        CASE WHEN age_band IS NULL THEN 'Total' WHEN age_band = 80 THEN 'From 80 years or more' ELSE 'From ' || age_band || ' to ' || (age_band + 4) || ' years' END AS age_label,
        CAST(sum(pop) AS BIGINT) AS pop
      FROM (SELECT * FROM state_population UNION ALL SELECT year, geo_code, sex, NULL, pop FROM state_population) WHERE year IN (1996, 2000) GROUP BY 1, 2, 3, 4"""),
    "stored_counts": (CTES, "SELECT * FROM death_counts WHERE year = 1996"),
}

ORACLES: dict[str, str] = {name: sql_for(final, CTES) for name, final in FINAL.items()}
ORACLES["birth_coverage_smoothed"] = sql_for(FINAL["birth_coverage"], SMOOTH_CTES)
ORACLES["birth_coverage_median"] = sql_for(FINAL["birth_coverage"], MEDIAN_CTES)
ORACLES["birth_coverage_levels"] = sql_for(FINAL["birth_coverage"], LEVEL_CTES)
ORACLES |= {name: sql_for(final, blocks) for name, (blocks, final) in MORE.items()}
