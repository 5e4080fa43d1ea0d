"""The full product set: thresholds, pairs and histograms by day of the calendar, level and cell, and input that is not finite.

Hours are aggregated once; the levels of three hours and of the day are merged from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dewfall.functions import calendar
from dewfall.functions.physics import VARIABLES, pressure_hpa, temperature_celsius, with_moisture
from dewfall.jobs.climatology import CELL, _levels, binned, moist
from dewfall.jobs.oracles import LEVELS, MOIST, OVER, moist_from
from dewfall.operators import moments
from dewfall.sources.observations import observations

LEVEL = (*CELL, "level_bin")


def threshold_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts above thresholds, joint counts, flags and their fractions at all 33 bins."""
    over = {f"{v}_over_{k}": F.col(v) > t for v, ts in moments.THRESHOLDS.items() for k, t in enumerate(ts)}
    joint = {f"joint_{k}": (F.col("rh") > a) & (F.col("q") > b) for k, (a, b) in enumerate(moments.JOINT)}
    counts = over | joint | {"n_supersat": F.col("supersat"), "n_bad_ep": F.col("bad_ep"), "n_rh": F.col("rh").isNotNull(), "n_q": F.col("q").isNotNull(), "hours": F.lit(True)}
    by_hour = moist(spark, sf_dir).groupBy(*CELL, "h").agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    out = _levels(by_hour).groupBy(*LEVEL).agg(*(F.sum(n).alias(n) for n in counts))
    share = lambda c: F.when(F.col("n_rh") > 0, F.col(c) / F.col("n_rh"))
    return out.select("*", share("n_supersat").alias("supersat_fraction"), share("n_bad_ep").alias("bad_ep_fraction"))


def pair_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of the four pairs of variables at all 33 bins; states are taken by hour and merged."""
    pairs = F.array(*(F.struct(F.lit(f"{x}-{y}").alias("pair"), F.col(x).alias("x"), F.col(y).alias("y")) for x, y in moments.PAIRS))
    long = moist(spark, sf_dir).select(*CELL, "h", F.explode(pairs).alias("s")).select(*CELL, "h", "s.*")
    hours = long.groupBy(*CELL, "h", "pair").agg(*moments.pair_state("x", "y"))
    return shown_pairs(moments.merge_pairs(_levels(hours), [*LEVEL, "pair"]))


def shown_pairs(states: DataFrame) -> DataFrame:
    """Pair products rounded in units of the variables."""
    unit = F.create_map(*(F.lit(x) for kv in moments.UNIT.items() for x in kv))
    ux, uy = unit[F.split("pair", "-")[0]], unit[F.split("pair", "-")[1]]
    sized = {"mean_x": ux, "mean_y": uy, "m2_x": ux * ux, "m2_y": uy * uy, "cxy": ux * uy, "cov": ux * uy}
    both = states.select("*", *moments.pair_products())
    return both.withColumns({c: F.round(F.col(c) / u, 9) + 0.0 for c, u in sized.items()} | {"corr": F.round("corr", 6) + 0.0})


def histogram_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative against specific humidity in 8 by 8 bins, by day of the calendar, the day and its three-hour bins, and cell."""
    inside = binned(spark, sf_dir).where("xb is not null and yb is not null")
    hours = inside.groupBy(*CELL, (1 + F.floor(F.col("h") / 3)).cast("int").alias("level_bin"), "xb", "yb").agg(F.count("*").alias("n"))
    both = hours.withColumn("level_bin", F.explode(F.array(F.lit(0), F.col("level_bin"))))
    return both.groupBy(*LEVEL, "xb", "yb").agg(F.sum("n").alias("n"))


def histogram_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's histogram with its total and the density of each bin: count over total times the bin's area."""
    bins = histogram_levels(spark, sf_dir).where("level_bin = 0").drop("level_bin")
    total = bins.groupBy(*CELL).agg(F.sum("n").alias("n_valid"))
    area = (moments.RH_RANGE[1] - moments.RH_RANGE[0]) / 8 * (moments.Q_RANGE[1] - moments.Q_RANGE[0]) / 8
    edge = lambda b, r: r[0] + F.col(b) * ((r[1] - r[0]) / 8)
    return bins.join(total, list(CELL)).select(
        *CELL, "xb", "yb", "n", "n_valid", (F.col("n") / (F.col("n_valid") * area)).alias("density"), edge("xb", moments.RH_RANGE).alias("x_left"), edge("yb", moments.Q_RANGE).alias("y_left")
    )


def density_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density of the bin that each observation falls in, averaged by cell; observations out of range have none."""
    points = binned(spark, sf_dir).groupBy(*CELL, "xb", "yb").agg(F.count("*").alias("rows"))
    found = points.join(histogram_density(spark, sf_dir).select(*CELL, "xb", "yb", "density"), [*CELL, "xb", "yb"], "left")
    return found.groupBy("cy", "cx").agg(
        F.sum("rows").alias("rows"), F.sum(F.when(F.col("density").isNotNull(), F.col("rows"))).alias("inside"), (F.sum(F.col("density") * F.col("rows")) / F.sum(F.when(F.col("density").isNotNull(), F.col("rows")))).alias("mean_density")
    )


def with_sea_mask(obs: DataFrame) -> DataFrame:
    """obs with NaN in one cell's temperatures and infinite dew points and pressures elsewhere, as masked grids have them."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return obs.withColumns(
        {
            "t": F.when((F.col("cy") == 0) & (F.col("cx") == 0), nan).otherwise(F.col("t")),
            "td": F.when(F.col("h") == 5, -inf).when(F.col("h") == 6, nan).otherwise(F.col("td")),
            "p": F.when(F.col("h") == 7, inf).when(F.col("h") == 8, nan).otherwise(F.col("p")),
        }
    )


def masked_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, extremes and flags by cell over observations with values that are not finite: they count as missing everywhere."""
    df = with_moisture(with_sea_mask(observations(spark, sf_dir)))
    of = lambda v: [F.count(v).alias(f"n_{v}"), F.min(v).alias(f"low_{v}"), F.max(v).alias(f"high_{v}"), F.avg(v).alias(f"mean_{v}")]
    return df.groupBy("cy", "cx").agg(F.count("*").alias("rows"), *reduce(list.__add__, map(of, VARIABLES)), F.count_if("supersat").alias("n_supersat"), F.count_if("bad_ep").alias("n_bad_ep"))


def storage_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stored variable, before anything is made null: rows, finite, null, NaN and infinite values, extremes and mean of the finite, and what its name says it is."""
    raw = moments.long_form(with_sea_mask(observations(spark, sf_dir)), [], ("t", "td", "p"))
    x, ok = F.col("x"), F.abs("x") < F.lit(float("inf"))
    of = F.when(ok, x)
    kind = F.when(F.col("variable") == "td", "dew point").when(F.col("variable") == "t", "temperature").otherwise("pressure")
    return raw.groupBy("variable").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("finite"), F.count_if(x.isNull()).alias("masked"), F.count_if(F.isnan(x)).alias("nans"), F.count_if(F.abs(x) == F.lit(float("inf"))).alias("infinite"),
        F.min(of).alias("low"), F.max(of).alias("high"), F.avg(of).alias("mean"),
    ).withColumn("kind", kind)


def year_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual moment and pair states merged into one for each cell, as restarts by year do."""
    df = moist(spark, sf_dir).withColumn("year", F.year("d"))
    years = moments.merge_moments(df.groupBy("year", "cy", "cx").agg(*moments.moment_state("rh")), ["cy", "cx"])
    pairs = moments.merge_pairs(df.groupBy("year", "cy", "cx").agg(*moments.pair_state("rh", "e")), ["cy", "cx"])
    shown = years.select("cy", "cx", "n", F.round("mean", 8).alias("mean"), *moments.finalized())
    shown = shown.withColumns({c: F.round(c, 6) + 0.0 for c in ("std", "skew", "kurt")})
    return shown.join(pairs.select("cy", "cx", F.col("n").alias("n_pair"), *moments.pair_products()).withColumns({"cov": F.round("cov", 6), "corr": F.round("corr", 6)}), ["cy", "cx"])


def calendar_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations and days of each period that a year belongs to: its decade and the full range."""
    periods = spark.createDataFrame([("1991-2000", 1991, 2000), ("2001-2010", 2001, 2010), ("FULL", 1991, 2010)], "period string, first int, last int")
    days = observations(spark, sf_dir).groupBy("d").agg(F.count("*").alias("n"))
    both = days.join(F.broadcast(periods), F.year("d").between(F.col("first"), F.col("last")))  # three rows: a fixed list
    return both.groupBy("period").agg(F.sum("n").alias("n"), F.count("*").alias("days"), F.count_distinct(calendar.slot(F.col("d"))).alias("slots"))


def histogram_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over the older ranges, relative humidity 0 to 100 and specific humidity 0 to 1, with each bin's share of its cell."""
    values = moist(spark, sf_dir).select("cy", "cx", F.inline(F.array(F.struct("rh", "q"))))
    bins = values.select("cy", "cx", moments.bin_of(F.col("rh"), 0, 100).alias("xb"), moments.bin_of(F.col("q"), 0, 1).alias("yb"))
    counts = bins.where("xb is not null and yb is not null").groupBy("cy", "cx", "xb", "yb").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("cy", "cx")))


def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean temperature and pressure by cell out of inputs in several units, one for each column of cells."""
    # Ways of writing the units.
    t_units = F.element_at(F.array(*map(F.lit, ("K", "°C", "degree Celsius", " kelvin "))), F.col("cx") + 1)
    p_units = F.element_at(F.array(*map(F.lit, ("Pa", "hPa", "mb", "Millibars"))), F.col("cx") + 1)
    given = observations(spark, sf_dir).select(
        "cy", "cx", t_units.alias("tu"), p_units.alias("pu"), F.when(F.col("cx").isin(0, 3), F.col("t") + 273.15).otherwise(F.col("t")).alias("t"), F.when(F.col("cx") == 0, F.col("p") * 100).otherwise(F.col("p")).alias("p")
    )
    same = given.select("cy", "cx", temperature_celsius(F.col("t"), F.col("tu")).alias("t"), pressure_hpa(F.col("p"), F.col("pu")).alias("p"))
    return same.groupBy("cy", "cx").agg(F.round(F.avg("t"), 8).alias("mean_t"), F.round(F.avg("p"), 8).alias("mean_p"), F.count("p").alias("n_p"))


def grid_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid: each cell's number row by row, its coordinates, its block of two by two cells, and its observations."""
    obs = observations(spark, sf_dir)
    cells = obs.groupBy("cy", "cx").agg(F.count("*").alias("n"))
    width = cells.agg((F.max("cx") + 1).alias("nx"))
    block = F.format_string("Y%05d-X%05d", F.floor(F.col("cy") / 2).cast("int"), F.floor(F.col("cx") / 2).cast("int"))
    return cells.crossJoin(F.broadcast(width)).select((F.col("cy") * F.col("nx") + F.col("cx")).alias("cell_id"), "cy", "cx", (50 - F.col("cy") / 10).alias("lat"), (35 + F.col("cx") / 10).alias("lon"), block.alias("block"), "n")  # one row


_BINS = "CASE WHEN rh BETWEEN 0 AND 130 THEN least(floor(rh / 130 * 8), 7) END AS xb, CASE WHEN q BETWEEN 0 AND 0.030 THEN least(floor(q / 0.030::DOUBLE * 8), 7) END AS yb"
_HIST = f"WITH {MOIST}, b AS (SELECT *, {_BINS}, unnest([0, 1 + h // 3]) AS level_bin FROM moist), hist AS (SELECT slot, cy, cx, level_bin, xb, yb, count(*) AS n FROM b WHERE xb IS NOT NULL AND yb IS NOT NULL GROUP BY ALL)"
_DENSITY = """, dens AS (SELECT slot, cy, cx, xb, yb, n, sum(n) OVER (PARTITION BY slot, cy, cx) AS n_valid, n / (sum(n) OVER (PARTITION BY slot, cy, cx) * (130.0::DOUBLE / 8 * 0.030::DOUBLE / 8)) AS density
  FROM hist WHERE level_bin = 0)"""
_COUNTS = {f"joint_{k}": f"rh > {a} AND q > {b}" for k, (a, b) in enumerate([(80, 0.012), (90, 0.012), (95, 0.015), (80, 0.012)])}
_COUNTS |= {"n_supersat": "rh_raw > 100", "n_bad_ep": "e >= p", "n_rh": "rh IS NOT NULL", "n_q": "q IS NOT NULL", "hours": "TRUE"}
_MASKED = """CASE WHEN cy = 0 AND cx = 0 THEN NULL ELSE t END AS t, CASE WHEN h IN (5, 6) THEN NULL ELSE td END AS td, CASE WHEN h IN (7, 8) THEN NULL ELSE p END AS p"""
_PAIRS = "SELECT *, unnest(['rh-q', 'rh-e', 'q-e', 'r-q']) AS pair, unnest([rh, rh, q, r]) AS x, unnest([q, e, e, q]) AS y, unnest([100, 100, 0.01, 0.01]::DOUBLE[]) AS ux, unnest([0.01, 10, 10, 0.01]::DOUBLE[]) AS uy FROM lev"
_CORR = "CASE WHEN n >= 2 AND m2_x > 1e-18 * n * mean_x ** 2 AND m2_y > 1e-18 * n * mean_y ** 2 THEN least(greatest(cxy / sqrt(m2_x * m2_y), -1), 1) END"

SQL: dict[str, str] = {
    "threshold_levels": f"""WITH {MOIST}, {LEVELS}, c AS (SELECT slot, cy, cx, level_bin, {OVER}, {", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in _COUNTS.items())} FROM lev GROUP BY ALL)
SELECT *, CASE WHEN n_rh > 0 THEN n_supersat / n_rh END AS supersat_fraction, CASE WHEN n_rh > 0 THEN n_bad_ep / n_rh END AS bad_ep_fraction FROM c""",
    "pair_levels": f"""WITH {MOIST}, {LEVELS}, pr AS ({_PAIRS}), mu AS (SELECT slot, cy, cx, level_bin, pair, avg(x) AS mean_x, avg(y) AS mean_y FROM pr WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
s AS (SELECT slot, cy, cx, level_bin, pair, any_value(ux) AS ux, any_value(uy) AS uy, count(*) AS n, any_value(mean_x) AS mean_x, any_value(mean_y) AS mean_y,
  sum((x - mean_x) ** 2) AS m2_x, sum((y - mean_y) ** 2) AS m2_y, sum((x - mean_x) * (y - mean_y)) AS cxy FROM pr JOIN mu USING (slot, cy, cx, level_bin, pair) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL)
SELECT slot, cy, cx, level_bin, pair, n, round(mean_x / ux, 9) + 0 AS mean_x, round(mean_y / uy, 9) + 0 AS mean_y, round(m2_x / ux / ux, 9) + 0 AS m2_x, round(m2_y / uy / uy, 9) + 0 AS m2_y, round(cxy / ux / uy, 9) + 0 AS cxy,
  CASE WHEN n >= 2 THEN round(cxy / (n - 1) / ux / uy, 9) + 0 END AS cov, round({_CORR}, 6) + 0 AS corr FROM s""",
    "histogram_levels": f"{_HIST} SELECT slot, cy, cx, level_bin, CAST(xb AS INTEGER) AS xb, CAST(yb AS INTEGER) AS yb, n FROM hist",
    "histogram_density": f"{_HIST}{_DENSITY} SELECT slot, cy, cx, CAST(xb AS INTEGER) AS xb, CAST(yb AS INTEGER) AS yb, n, CAST(n_valid AS BIGINT) AS n_valid, density, xb * 16.25 AS x_left, yb * 0.00375::DOUBLE AS y_left FROM dens",
    "density_lookup": f"""{_HIST}{_DENSITY}, obs2 AS (SELECT slot, cy, cx, {_BINS} FROM moist)
SELECT cy, cx, count(*) AS rows, count(density) AS inside, avg(density) AS mean_density FROM obs2 LEFT JOIN dens USING (slot, cy, cx, xb, yb) GROUP BY cy, cx""",
    "masked_input": f"""WITH {moist_from(_MASKED)} SELECT cy, cx, count(*) AS rows, {", ".join(f"count({v}) AS n_{v}, min({v}) AS low_{v}, max({v}) AS high_{v}, avg({v}) AS mean_{v}" for v in ("rh", "e", "r", "q"))},
  count(*) FILTER (rh_raw > 100) AS n_supersat, count(*) FILTER (e >= p) AS n_bad_ep FROM moist GROUP BY cy, cx""",
    "storage_profile": f"""WITH {MOIST}, raw AS (SELECT unnest(['t', 'td', 'p']) AS variable, unnest(['temperature', 'dew point', 'pressure']) AS kind,
  unnest([CASE WHEN cy = 0 AND cx = 0 THEN 'NaN'::DOUBLE ELSE t END, CASE WHEN h = 5 THEN '-Infinity'::DOUBLE WHEN h = 6 THEN 'NaN'::DOUBLE ELSE td END, CASE WHEN h = 7 THEN 'Infinity'::DOUBLE WHEN h = 8 THEN 'NaN'::DOUBLE ELSE p END]) AS x FROM obs)
SELECT variable, kind, count(*) AS total, count(*) FILTER (isfinite(x)) AS finite, count(*) FILTER (x IS NULL) AS masked, count(*) FILTER (isnan(x)) AS nans, count(*) FILTER (isinf(x)) AS infinite,
  min(x) FILTER (isfinite(x)) AS low, max(x) FILTER (isfinite(x)) AS high, avg(x) FILTER (isfinite(x)) AS mean FROM raw GROUP BY variable, kind""",
    "year_merge": f"""WITH {MOIST}, s AS (SELECT cy, cx, regr_count(e, rh) AS n, regr_avgx(e, rh) AS mean_x, regr_avgy(e, rh) AS mean_y, regr_sxx(e, rh) AS m2_x, regr_syy(e, rh) AS m2_y, regr_sxy(e, rh) AS cxy FROM moist GROUP BY cy, cx),
m AS (SELECT cy, cx, count(rh) AS n, round(avg(rh), 8) AS mean, round(stddev_samp(rh), 6) AS std, round(skewness(rh), 6) + 0 AS skew, round(kurtosis(rh), 6) + 0 AS kurt FROM moist GROUP BY cy, cx)
SELECT m.*, s.n AS n_pair, round(cxy / (s.n - 1), 6) AS cov, round({_CORR.replace("n >=", "s.n >=").replace("* n *", "* s.n *")}, 6) AS corr FROM m JOIN s USING (cy, cx)""",
    "histogram_shares": f"""WITH {MOIST}, b AS (SELECT cy, cx, CAST(least(floor(rh / 100 * 8), 7) AS INTEGER) AS xb, CAST(least(floor(q * 8), 7) AS INTEGER) AS yb, count(*) AS n FROM moist WHERE rh BETWEEN 0 AND 100 AND q BETWEEN 0 AND 1 GROUP BY ALL)
SELECT *, n / sum(n) OVER (PARTITION BY cy, cx) AS share FROM b""",
    "unit_conversion": f"WITH {MOIST} SELECT cy, cx, round(avg(t), 8) AS mean_t, round(avg(p), 8) AS mean_p, count(p) AS n_p FROM obs GROUP BY cy, cx",
    "grid_table": f"""WITH {MOIST} SELECT cy * 4 + cx AS cell_id, cy, cx, 50 - cy / 10 AS lat, 35 + cx / 10 AS lon, printf('Y%05d-X%05d', cy // 2, cx // 2) AS block, count(*) AS n FROM obs GROUP BY cy, cx""",
    "calendar_periods": f"""WITH {MOIST}, p(period, first, last) AS (VALUES ('1991-2000', 1991, 2000), ('2001-2010', 2001, 2010), ('FULL', 1991, 2010))
SELECT period, count(*) AS n, count(DISTINCT d) AS days, count(DISTINCT slot) AS slots FROM ep JOIN p ON year(d) BETWEEN first AND last GROUP BY period""",
}
