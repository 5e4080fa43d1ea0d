"""DuckDB SQL for the registered jobs."""

from __future__ import annotations

from dewfall.sources.observations import OBS_COLUMNS

_SVP = "CASE WHEN {0} >= 0 THEN 6.112::DOUBLE * exp(17.67::DOUBLE * {0} / ({0} + 243.5::DOUBLE)) WHEN {0} < 0 THEN 6.112::DOUBLE * exp(22.46::DOUBLE * {0} / ({0} + 272.62::DOUBLE)) END"
_MOIST = f"""
obs AS (SELECT {OBS_COLUMNS} FROM lineitem),
ep AS (SELECT *, {_SVP.format("td")} AS e, {_SVP.format("t")} AS es,
  CASE WHEN month(d) = 2 AND day(d) >= 28 THEN 60 WHEN dayofyear(d) < 59 THEN dayofyear(d)
       ELSE dayofyear(d) + CASE WHEN (year(d) % 4 = 0 AND year(d) % 100 <> 0) OR year(d) % 400 = 0 THEN 0 ELSE 1 END END AS slot,
  CASE WHEN year(d) >= 2001 THEN 2001 ELSE 1991 END AS decade FROM obs),
mr AS (SELECT *, CASE WHEN e > 0 AND p > 0 AND e < p THEN 0.622::DOUBLE * e / (p - e) END AS r, 100 * e / es AS rh_raw FROM ep),
moist AS (SELECT *, CASE WHEN rh_raw IS NOT NULL THEN least(greatest(rh_raw, 0), 100) END AS rh, r / (1 + r) AS q FROM mr)"""
MOIST = _MOIST
#: Each row of moist under the day, its three-hour bin and its hour.
LEVELS = "lev AS (SELECT *, unnest([0, 1 + h // 3, 9 + h]) AS level_bin FROM moist)"


def moist_from(changed: str) -> str:
    """The same columns over observations of which some are replaced."""
    return _MOIST.replace("obs AS (SELECT", "plain AS (SELECT").replace("ep AS (", f"obs AS (SELECT * REPLACE ({changed}) FROM plain),\nep AS (", 1)


LONG = ", long AS (SELECT *, unnest(['rh', 'e', 'r', 'q']) AS variable, unnest([rh, e, r, q]) AS x FROM moist)"


def _central(keys: str, x: str, source: str, extra: str = "") -> str:
    """Two passes: means first, then central sums."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""mu AS (SELECT {keys}, avg({x}) AS mean FROM {source} GROUP BY {keys}),
st AS (SELECT {", ".join("a." + k.strip() for k in keys.split(","))}, count(a.{x}) AS n, count(*) - count(a.{x}) AS missing, any_value(b.mean) AS mean,
  sum((a.{x} - b.mean) ** 2) AS m2, sum((a.{x} - b.mean) ** 3) AS m3, sum((a.{x} - b.mean) ** 4) AS m4, min(a.{x}) AS low, max(a.{x}) AS high
  FROM {source} a JOIN mu b ON {on} GROUP BY {", ".join("a." + k.strip() for k in keys.split(","))})"""


_LEVELS = f"WITH {_MOIST}{LONG}, lev AS (SELECT *, unnest([0, 1 + h // 3, 9 + h]) AS level_bin FROM long), {_central('slot, cy, cx, level_bin, variable', 'x', 'lev')}"
_SHOWN = """round(mean, 9) + 0 AS mean, round(m2, 9) + 0 AS m2, round(low, 9) AS low, round(high, 9) AS high,
  CASE WHEN high - low > 1e-9 * abs(high) THEN round(m3 / n / pow(m2 / n, 1.5), 6) + 0 END AS g1, CASE WHEN high - low > 1e-9 * abs(high) THEN round(n * m4 / (m2 * m2) - 3, 6) + 0 END AS g2,
  round(m3 / pow({0}, 3), 6) + 0 AS m3, round(m4 / pow({0}, 4), 6) + 0 AS m4"""
_UNIT = "CASE variable WHEN 'rh' THEN 100 WHEN 'e' THEN 10 ELSE 0.01 END::DOUBLE"
# Fixed values, written out apart from the code they check.
OVER = """count(*) FILTER (rh > 80) AS rh_over_0, count(*) FILTER (rh > 90) AS rh_over_1, count(*) FILTER (rh > 95) AS rh_over_2, count(*) FILTER (rh > 100) AS rh_over_3,
  count(*) FILTER (e > 10) AS e_over_0, count(*) FILTER (e > 15) AS e_over_1, count(*) FILTER (e > 20) AS e_over_2, count(*) FILTER (e > 25) AS e_over_3,
  count(*) FILTER (r > 0.008) AS r_over_0, count(*) FILTER (r > 0.010) AS r_over_1, count(*) FILTER (r > 0.012) AS r_over_2, count(*) FILTER (r > 0.015) AS r_over_3, count(*) FILTER (r > 0.020) AS r_over_4,
  count(*) FILTER (q > 0.008) AS q_over_0, count(*) FILTER (q > 0.010) AS q_over_1, count(*) FILTER (q > 0.012) AS q_over_2, count(*) FILTER (q > 0.015) AS q_over_3, count(*) FILTER (q > 0.020) AS q_over_4"""
_HOURS = "hours AS (SELECT event_type, date_trunc('hour', ts) AS hour, avg(value) AS v FROM events GROUP BY 1, 2)"

SQL: dict[str, str] = {
    "moments_l1": f"WITH {_MOIST}, {_central('slot, cy, cx', 'rh', 'moist')} SELECT slot, cy, cx, n, missing, {_SHOWN.format(100.0)} FROM st",
    "moments_levels": f"{_LEVELS} SELECT slot, cy, cx, level_bin, variable, n, {_SHOWN.format(_UNIT)} FROM st WHERE n > 0",
    "shared_mask": f"""WITH {_MOIST}{LONG}, sh AS (SELECT slot, cy, cx, variable, x, CASE WHEN rh IS NOT NULL AND e IS NOT NULL AND r IS NOT NULL AND q IS NOT NULL THEN x END AS y FROM long),
{_central('slot, cy, cx, variable', 'y', 'sh')}, own AS (SELECT slot, cy, cx, variable, count(x) - count(y) AS left_out FROM sh GROUP BY ALL)
SELECT slot, cy, cx, variable, n, missing, left_out, {_SHOWN.format(_UNIT)} FROM st JOIN own USING (slot, cy, cx, variable)""",
    "decades_merged": f"""WITH {_MOIST}{LONG} SELECT slot, cy, cx, variable, count(x) AS n, round(avg(x), 9) + 0 AS mean, round(stddev_samp(x), 9) + 0 AS std,
  CASE WHEN count(x) >= 3 AND max(x) - min(x) > 1e-9 * abs(max(x)) THEN round(skewness(x), 6) + 0 END AS skew, CASE WHEN count(x) >= 4 AND max(x) - min(x) > 1e-9 * abs(max(x)) THEN round(kurtosis(x), 6) + 0 END AS kurt
  FROM long GROUP BY ALL HAVING count(x) > 0""",
    "thresholds": f"""WITH {_MOIST} SELECT slot, cy, cx, {OVER}, count(*) FILTER (rh > 90 AND q > 0.012) AS rh90_q012,
  count(*) FILTER (rh_raw > 100) AS n_supersat, count(*) FILTER (e >= p) AS n_bad_ep FROM moist GROUP BY slot, cy, cx""",
    "pair_products": f"""WITH {_MOIST}, s AS (SELECT slot, cy, cx, regr_count(q, rh) AS n, regr_avgx(q, rh) AS mean_x, regr_avgy(q, rh) AS mean_y,
  regr_sxx(q, rh) AS m2_x, regr_syy(q, rh) AS m2_y, regr_sxy(q, rh) AS cxy FROM moist GROUP BY slot, cy, cx)
SELECT *, CASE WHEN n >= 2 THEN cxy / (n - 1) END AS cov,
  CASE WHEN n >= 2 AND m2_x > 1e-18 * n * mean_x ** 2 AND m2_y > 1e-18 * n * mean_y ** 2 THEN least(greatest(cxy / sqrt(m2_x * m2_y), -1), 1) END AS corr FROM s WHERE n > 0""",
    "histogram": f"""WITH {_MOIST} SELECT cy, cx, CAST(least(floor(rh / 130 * 8), 7) AS INTEGER) AS xb, CAST(least(floor(q / 0.030::DOUBLE * 8), 7) AS INTEGER) AS yb, count(*) AS n
  FROM moist WHERE rh BETWEEN 0 AND 130 AND q BETWEEN 0 AND 0.030 GROUP BY ALL""",
    "triplet": f"""WITH {_MOIST}, k AS (SELECT cy, cx, d, h, avg(t) AS t, avg(td) AS td, avg(p) AS p FROM obs GROUP BY ALL)
SELECT cy, cx, count(*) FILTER (t IS NOT NULL AND td IS NOT NULL AND p IS NOT NULL) AS aligned, count(*) FILTER (td IS NULL) AS no_td, count(*) FILTER (p IS NULL) AS no_p, avg(td - p) AS mean_gap FROM k GROUP BY cy, cx""",
    "centred_window": f"""WITH {_MOIST}, days AS (SELECT cy, cx, d, count(rh) AS n, sum(rh) AS s FROM moist GROUP BY ALL)
SELECT a.cy, a.cx, a.d AS target, CAST(sum(b.n) AS BIGINT) AS n, sum(b.s) / sum(b.n) AS mean_rh, count(*) / 5 AS completeness
FROM days a JOIN days b ON a.cy = b.cy AND a.cx = b.cx AND b.d BETWEEN a.d - 2 AND a.d + 2 GROUP BY ALL""",
    "pseudo_observations": f"""WITH {_MOIST}, k AS (SELECT month(d) AS month, cy, cx, t,
  rank() OVER (PARTITION BY month(d), cy, cx ORDER BY t) + (count(*) OVER (PARTITION BY month(d), cy, cx, t) - 1) / 2 AS rank_avg,
  count(*) OVER (PARTITION BY month(d), cy, cx) AS n FROM obs WHERE t IS NOT NULL)
SELECT month, cy, cx, t, rank_avg, (rank_avg - 0.5) / n AS u_engine, rank_avg / (n + 1) AS u_diagnostic FROM k""",
    "normal_fits": f"""WITH {_MOIST}{LONG}, f AS (SELECT month(d) AS month, cy, cx, variable, count(x) AS n, avg(x) AS loc, stddev_pop(x) AS scale FROM long GROUP BY ALL),
g AS (SELECT *, -n / 2 * (ln(2 * pi() * scale * scale) + 1) AS ll FROM f WHERE n >= 30 AND scale > 0)
SELECT *, 4 - 2 * ll AS aic, 2 * ln(n) - 2 * ll AS bic, 4 - 2 * ll + 12 / (n - 3) AS aicc FROM g""",
    "hourly_steps": f"""WITH {_HOURS}, w AS (SELECT *, lag(v) OVER o AS prev, lead(v) OVER o AS nxt FROM hours WINDOW o AS (PARTITION BY event_type ORDER BY hour))
SELECT event_type, count(*) AS hours, avg(abs(v - prev)) AS mean_step, max(abs(v - prev)) AS max_step,
  count(*) FILTER (abs(v - prev) > 5 AND abs(nxt - v) > 5) AS two_sided, avg(abs(v - (prev + nxt) / 2)) AS mean_midpoint FROM w GROUP BY event_type""",
    "missing_hours": f"""WITH {_HOURS}, due AS (SELECT event_type, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM hours GROUP BY event_type)
SELECT event_type, hour FROM due ANTI JOIN hours USING (event_type, hour)""",
    "step_percentiles": f"""WITH {_MOIST}, g AS (SELECT cy, cx, t, abs(t - td) AS gap FROM obs WHERE td IS NOT NULL)
SELECT cy, cx, avg(gap) AS mean, median(gap) AS median, quantile_cont(gap, 0.95) AS p95, quantile_cont(gap, 0.99) AS p99, max(gap) AS max, count(DISTINCT t) AS distinct_t,
  {", ".join(f"count(*) FILTER (gap > {k}) AS over_{k}" for k in (2, 5, 8, 10, 15))} FROM g GROUP BY cy, cx""",
    "dominance": f"WITH {_MOIST} SELECT CAST(month(d) AS INTEGER) AS month, code, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY month(d)) AS share FROM obs GROUP BY month(d), code",
    "modal_code": f"""WITH {_MOIST}, c AS (SELECT month(d) AS month, cy, cx, code, count(*) AS n FROM obs GROUP BY ALL)
SELECT month, cy, cx, code, n FROM c QUALIFY row_number() OVER (PARTITION BY month, cy, cx ORDER BY n DESC, code DESC) = 1""",
    "crosstab": f"WITH {_MOIST} SELECT month(d) AS month, {', '.join(f'count(*) FILTER (code = {c}) AS code_{c}' for c in range(1, 8))} FROM obs GROUP BY month(d)",
    "decade_change": f"""WITH {_MOIST}{LONG}, c AS (SELECT decade, slot, cy, cx, variable, count(x) AS n, avg(x) AS mean FROM long GROUP BY ALL HAVING count(x) > 0),
v AS (SELECT variable, count(*) AS cells, CAST(sum(n) AS BIGINT) AS support, sum(n * mean) FILTER (decade = 1991) / sum(n) FILTER (decade = 1991) AS base,
  sum(n * mean) FILTER (decade = 2001) / sum(n) FILTER (decade = 2001) AS latest FROM c GROUP BY variable)
SELECT *, latest - base AS change, CASE WHEN abs(base) > 0 THEN 100 * (latest - base) / abs(base) END AS percent FROM v""",
    "driver_state": f"""WITH {_MOIST}, g AS (SELECT cy, cx, t, td, CASE WHEN p > 0 THEN ln(p) END AS lnp FROM obs)
SELECT cy, cx, count(*) AS n, {", ".join(f"avg({c}) AS mean_{c}, var_pop({c}) AS var_{c}" for c in ("t", "td", "lnp"))},
  covar_pop(t, td) AS cov_t_td, covar_pop(t, lnp) AS cov_t_lnp, covar_pop(td, lnp) AS cov_td_lnp
FROM g WHERE t IS NOT NULL AND td IS NOT NULL AND lnp IS NOT NULL GROUP BY cy, cx""",
    "work_ids": f"""WITH {_MOIST} SELECT DISTINCT d, cy, cx, substr(sha256(strftime(d, '%Y-%m-%d') || printf('-Y%05d-X%05d', cy, cx)), 1, 32) AS txid FROM obs""",
    "calendar_slots": f"""WITH {_MOIST}, days AS (SELECT CAST(unnest(generate_series(DATE '2001-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS d),
cal AS (SELECT dayofyear(d) + CASE WHEN dayofyear(d) >= 59 THEN 1 ELSE 0 END AS slot, month(d) AS month, day(d) AS day,
  CASE WHEN month(d) = 2 AND day(d) = 28 THEN 'Feb-28/Feb-29' ELSE strftime(d, '%b-%d') END AS label, 0 AS reserved FROM days
  UNION ALL SELECT 59, -1, -1, 'RESERVED', 1), c AS (SELECT slot, count(*) AS n FROM ep GROUP BY slot)
SELECT CAST(cal.slot AS INTEGER) AS slot, CAST(month AS INTEGER) AS month, CAST(day AS INTEGER) AS day, label, reserved, coalesce(n, 0) AS n FROM cal LEFT JOIN c ON cal.slot = c.slot""",
    "level_audit": f"""{_LEVELS} SELECT variable, CAST(sum(n) FILTER (level_bin = 0) AS BIGINT) AS n_l1, CAST(sum(n) FILTER (level_bin BETWEEN 1 AND 8) AS BIGINT) AS n_l2, CAST(sum(n) FILTER (level_bin >= 9) AS BIGINT) AS n_l3,
  count(*) FILTER (low > high) AS out_of_order, count(*) FILTER (slot = 59) AS reserved FROM st WHERE n > 0 GROUP BY variable""",
}

_WINDOW_HOURS = f"""WITH {_MOIST}, own AS (SELECT DISTINCT cy, cx, d AS target FROM obs),
win AS (SELECT a.cy, a.cx, a.target, count(b.rh) AS n, avg(b.rh) AS mean_rh, count(DISTINCT CASE WHEN b.rh IS NOT NULL THEN b.d::VARCHAR || ' ' || b.h::VARCHAR END) AS hours
  FROM own a JOIN moist b ON a.cy = b.cy AND a.cx = b.cx AND b.d BETWEEN a.target - 2 AND a.target + 2 GROUP BY ALL)"""
SQL["window_hours"] = f"{_WINDOW_HOURS} SELECT *, hours / 120 AS completeness FROM win"
SQL["window_slots"] = f"""{_WINDOW_HOURS}, slots AS (SELECT DISTINCT d AS target, slot FROM ep)
SELECT slot, cy, cx, CAST(sum(n) AS BIGINT) AS n, sum(mean_rh * n) / nullif(sum(n), 0) AS mean_rh, count(*) AS windows, CAST(sum(hours) AS BIGINT) AS hours, sum(hours) / (120 * count(*)) AS completeness
FROM win JOIN slots USING (target) GROUP BY slot, cy, cx"""
