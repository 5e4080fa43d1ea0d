"""Checks of input before it is used: files, time axes, coordinates, alignment; and slots, windows and runs of the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dewfall.functions import calendar
from dewfall.jobs.oracles import MOIST
from dewfall.sources import listing
from dewfall.sources.observations import observations, table
from dewfall.sources.states import delete_folder, scratch


def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of a year's files: missing, single or duplicate, from a listing of files that observations are written to by month; months with a 31st have a second file."""
    folder = scratch(spark, "files")
    names = observations(spark, sf_dir).select("d", F.date_format("d", "yyyyMM").alias("ym"), F.explode(F.when(F.dayofmonth("d") == 31, F.array(F.lit(""), F.lit("_copy"))).otherwise(F.array(F.lit("")))).alias("copy"))
    named = names.select("d", F.concat(F.lit("T2m"), "ym", "copy", F.lit(".nc")).alias("file"))
    named.repartition("file").write.partitionBy("file").parquet(folder)
    # a file here is a folder of Spark's: its part files share its name
    files = listing.listed(spark, folder, "*.parquet").select(F.regexp_extract("path", "file=([^/]*)/", 1).alias("name")).distinct()
    year, month = listing.year_month(F.col("name"))
    out = listing.months(files.select(year.alias("year"), month.alias("month")))
    rows = written_rows(out, f"{folder}-rows")
    delete_folder(spark, folder)
    return rows


def written_rows(df: DataFrame, folder: str) -> DataFrame:
    """df as rows on disk, independent of what it was read from."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def time_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type: is the axis hourly, inside one month, complete? Steps other than an hour, and hours short of the month, are counted."""
    hours = table(spark, sf_dir, "events").select("event_type", F.date_trunc("hour", "ts").alias("hour")).distinct()
    before = F.lag("hour").over(Window.partitionBy("event_type").orderBy("hour"))
    step = F.timestamp_diff("SECOND", before, F.col("hour"))
    stepped = hours.withColumn("step", step)
    first, last = F.min("hour"), F.max("hour")
    due = 24 * F.dayofmonth(F.last_day(F.to_date(first)))
    return stepped.groupBy("event_type").agg(
        F.count("*").alias("hours"), F.count_if(F.col("step") != 3600).alias("bad_steps"), (F.date_trunc("month", first) == F.date_trunc("month", last)).alias("one_month"), (due - F.count("*")).cast("long").alias("short")
    ).withColumn("state", F.when(F.col("bad_steps") > 0, "not hourly").when(~F.col("one_month"), "crosses months").when(F.col("short") != 0, "incomplete").otherwise("ok"))


def input_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cell: hours that temperature has and another input lacks, and the other way round; aligned only without any."""
    obs, keys = observations(spark, sf_dir), ["cy", "cx", "d", "h"]
    of = lambda c: obs.where(F.col(c).isNotNull()).select(*keys).distinct()
    t, out = of("t"), obs.select("cy", "cx").distinct()
    for c in ("td", "p"):
        for name, gone in ((f"{c}_lacks", t.join(of(c), keys, "left_anti")), (f"{c}_extra", of(c).join(t, keys, "left_anti"))):
            out = out.join(gone.groupBy("cy", "cx").agg(F.count("*").alias(name)), ["cy", "cx"], "left")
    names = [c for c in out.columns if c not in ("cy", "cx")]
    out = out.na.fill(0, names)
    return out.withColumn("aligned", sum((F.col(c) for c in names), F.lit(0)) == 0)


def strict_alignment(obs: DataFrame) -> DataFrame:
    """The rows of obs(t, td, p); an error for the first that lacks a partner."""
    lacking = F.col("t").isNull() | F.col("td").isNull() | F.col("p").isNull()
    note = F.concat(F.lit("no partner at "), F.col("d").cast("string"), F.lit(" hour "), F.col("h").cast("string"))
    return obs.withColumn("t", F.when(lacking, F.raise_error(note).cast("double")).otherwise(F.col("t")))


def timestamp_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours in which an event type differs from the first type by name, by day: those that it lacks and those that it alone has (two anti joins)."""
    hours = table(spark, sf_dir, "events").select("event_type", F.date_trunc("hour", "ts").alias("hour")).distinct()
    first = hours.agg(F.min("event_type").alias("event_type"))
    axis = hours.join(F.broadcast(first), "event_type").select("hour")  # one row
    others = hours.join(F.broadcast(first), "event_type", "left_anti")
    due = others.select("event_type").distinct().join(F.broadcast(axis))  # an axis of hours: 8,766 to a year
    missing = due.join(others, ["event_type", "hour"], "left_anti").withColumn("state", F.lit("missing"))
    extra = others.join(axis, "hour", "left_anti").select("event_type", "hour", F.lit("extra").alias("state"))
    return missing.unionByName(extra).groupBy("event_type", "state", F.to_date("hour").alias("d")).agg(F.count("*").alias("n"), F.min("hour").alias("first"), F.max("hour").alias("last"))


def time_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of one quarter: the range is a filter on the stored column, so files and row groups outside it are not read."""
    raw = table(spark, sf_dir, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00' AND l_shipdate < TIMESTAMP_NTZ '1998-04-01 00:00:00'")
    return raw.groupBy(F.to_date("l_shipdate").alias("d")).agg(F.count("*").alias("n"))


def edge_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with the padding before the first year joined in: the padding has no pressure, and days that both hold count once."""
    obs = observations(spark, sf_dir)
    first = obs.where("year(d) = 1996").select("cy", "cx", "d", "h", "t", "td", "p")
    padding = obs.where("d in (DATE '1995-12-30', DATE '1995-12-31')").select("cy", "cx", "d", "h", "t", "td")
    both = first.unionByName(padding, allowMissingColumns=True)
    return both.groupBy(F.year("d").alias("year")).agg(F.count("*").alias("n"), F.count("t").alias("n_t"), F.count("p").alias("n_p"))


def axis_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second cell along x from 1 to 3, range ends included and given the wrong way round."""
    low, high, stride = sorted((3, 1))[0], sorted((3, 1))[1], 2
    obs = observations(spark, sf_dir)
    index = obs.where(F.col("cx").between(low, high)).select("cx").distinct().withColumn("k", F.row_number().over(Window.orderBy("cx")) - 1)  # a row for each place of one axis
    kept = index.where(F.pmod("k", F.lit(stride)) == 0).select("cx")
    return obs.join(F.broadcast(kept), "cx").groupBy("cy", "cx").agg(F.count("*").alias("n"))


def sample_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three places along each axis, ends included, halves rounded to even, crossed and numbered row by row; with what they hold."""
    obs = observations(spark, sf_dir)
    size = obs.agg((F.max("cy") + 1).alias("ny"), (F.max("cx") + 1).alias("nx"))
    along = lambda n: F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.bround(k * (F.col(n) - 1) / 2, 0).cast("int"))))
    grid = size.select("ny", "nx", F.posexplode(along("ny")).alias("j", "cy"), along("nx").alias("xs")).select("cy", "j", F.size("xs").alias("w"), F.posexplode("xs").alias("i", "cx"))
    points = grid.select((F.col("j") * F.col("w") + F.col("i")).cast("int").alias("point_id"), "cy", "cx")
    counts = obs.groupBy("cy", "cx").agg(F.count("*").alias("n"))
    return points.join(counts, ["cy", "cx"], "left").select("point_id", "cy", "cx", F.coalesce("n", F.lit(0)).alias("n"))


def slot_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates that each slot stands for in the years of the observations, the months its window of two days touches, and how many observations there are on them."""
    obs = observations(spark, sf_dir)
    years = obs.select(F.year("d").alias("year")).distinct()
    dates = years.select(F.explode(F.sequence(F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31)))).alias("d"))
    months = 12 * (F.year(F.date_add("d", 2)) - F.year(F.date_sub("d", 2))) + F.month(F.date_add("d", 2)) - F.month(F.date_sub("d", 2)) + 1
    counts = obs.groupBy("d").agg(F.count("*").alias("n"))
    return dates.join(counts, "d", "left").select(calendar.slot(F.col("d")).alias("slot"), "d", months.cast("int").alias("months"), F.coalesce("n", F.lit(0)).alias("n"))


def slot_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of slots with observations, in chunks of at most 60 that never cross the reserved slot, and whether each follows on the one before."""
    slots = observations(spark, sf_dir).select(calendar.slot(F.col("d")).alias("slot")).distinct().where(F.col("slot") != calendar.RESERVED)
    half = F.when(F.col("slot") < calendar.RESERVED, 0).otherwise(1)
    place = F.when(F.col("slot") < calendar.RESERVED, F.col("slot") - 1).otherwise(F.col("slot") - calendar.RESERVED - 1)
    runs = slots.groupBy(half.alias("half"), F.floor(place / 60).alias("chunk")).agg(F.min("slot").alias("first"), F.max("slot").alias("last"), F.count("*").cast("int").alias("slots"))
    before = F.lag("last").over(Window.orderBy("first"))  # at most 7 runs
    follows = F.when(before == calendar.RESERVED - 1, F.col("first") == calendar.RESERVED + 1).otherwise(F.col("first") == before + 1)
    return runs.select("first", "last", "slots", F.coalesce(follows, F.lit(True)).alias("follows"))


def mid_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of the 15th of each month, with its month's name and observations."""
    counts = observations(spark, sf_dir).groupBy(calendar.slot(F.col("d")).alias("slot")).agg(F.count("*").alias("n"))
    middle = calendar.calendar(spark).where("day = 15")
    return middle.join(counts, "slot", "left").select("slot", "month", F.date_format(F.make_date(F.lit(2001), "month", F.lit(15)), "MMM").alias("name"), F.coalesce("n", F.lit(0)).alias("n"))


def year_range(text: Column) -> Column:
    """Years of "a-b" (either way round), "a" or "a,b,c", ascending."""
    ends = F.transform(F.split(text, "-"), lambda x: F.trim(x).cast("int"))
    range_ = F.sequence(F.array_min(ends), F.array_max(ends))
    return F.when(F.contains(text, F.lit(",")), F.array_sort(F.transform(F.split(text, ","), lambda x: F.trim(x).cast("int")))).otherwise(range_)


def year_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations in the years that several ways of writing them name."""
    texts = spark.createDataFrame([(x,) for x in ("1996-1998", "1999-1997", "2000", "1995, 1998,2001")], "years string")
    named = texts.select("years", F.explode(year_range(F.col("years"))).alias("year"))
    counts = observations(spark, sf_dir).groupBy(F.year("d").alias("year")).agg(F.count("*").alias("n"))
    return named.join(counts, "year", "left").groupBy("years").agg(F.count("*").alias("named"), F.sum("n").alias("n"))


_SLOT = """CASE WHEN month(d) = 2 AND day(d) >= 28 THEN 60 WHEN dayofyear(d) < 59 THEN dayofyear(d)
  ELSE dayofyear(d) + CASE WHEN (year(d) % 4 = 0 AND year(d) % 100 <> 0) OR year(d) % 400 = 0 THEN 0 ELSE 1 END END"""
SQL: dict[str, str] = {
    "file_index": f"""WITH {MOIST}, n AS (SELECT DISTINCT year(d) AS y, month(d) AS m, day(d) = 31 AS twice FROM obs), f AS (SELECT y, m, count(*) AS files FROM n GROUP BY y, m),
due AS (SELECT DISTINCT y, unnest(range(1, 13)) AS m FROM n)
SELECT CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month, coalesce(files, 0) AS files, CASE WHEN files IS NULL THEN 'missing' WHEN files > 1 THEN 'duplicate' ELSE 'single' END AS state FROM due LEFT JOIN f USING (y, m)""",
    "time_axis": """WITH h AS (SELECT DISTINCT event_type, date_trunc('hour', ts) AS hour FROM events), s AS (SELECT *, date_diff('second', lag(hour) OVER (PARTITION BY event_type ORDER BY hour), hour) AS step FROM h),
a AS (SELECT event_type, count(*) AS hours, count(*) FILTER (step <> 3600) AS bad_steps, date_trunc('month', min(hour)) = date_trunc('month', max(hour)) AS one_month, 24 * day(last_day(min(hour))) - count(*) AS short FROM s GROUP BY event_type)
SELECT *, CASE WHEN bad_steps > 0 THEN 'not hourly' WHEN NOT one_month THEN 'crosses months' WHEN short <> 0 THEN 'incomplete' ELSE 'ok' END AS state FROM a""",
    "input_alignment": f"""WITH {MOIST}, k AS (SELECT cy, cx, d, h, count(t) > 0 AS t, count(td) > 0 AS td, count(p) > 0 AS p FROM obs GROUP BY ALL),
c AS (SELECT cy, cx, count(*) FILTER (t AND NOT td) AS td_lacks, count(*) FILTER (td AND NOT t) AS td_extra, count(*) FILTER (t AND NOT p) AS p_lacks, count(*) FILTER (p AND NOT t) AS p_extra FROM k GROUP BY cy, cx)
SELECT *, td_lacks + td_extra + p_lacks + p_extra = 0 AS aligned FROM c""",
    "timestamp_differences": """WITH h AS (SELECT DISTINCT event_type, date_trunc('hour', ts) AS hour FROM events), f AS (SELECT min(event_type) AS t FROM h), ax AS (SELECT hour FROM h, f WHERE event_type = t),
o AS (SELECT event_type, hour FROM h, f WHERE event_type <> t), x AS (SELECT event_type, hour, 'missing' AS state FROM (SELECT DISTINCT event_type FROM o), ax WHERE (event_type, hour) NOT IN (SELECT (event_type, hour) FROM o)
  UNION ALL SELECT event_type, hour, 'extra' FROM o WHERE hour NOT IN (SELECT hour FROM ax))
SELECT event_type, state, CAST(hour AS DATE) AS d, count(*) AS n, min(hour) AS first, max(hour) AS last FROM x GROUP BY ALL""",
    "time_slice": "SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-04-01' GROUP BY 1",
    "edge_padding": f"""WITH {MOIST} SELECT CAST(year(d) AS INTEGER) AS year, count(*) AS n, count(t) AS n_t, count(CASE WHEN year(d) = 1996 THEN p END) AS n_p FROM obs
WHERE year(d) = 1996 OR d IN (DATE '1995-12-30', DATE '1995-12-31') GROUP BY 1""",
    "axis_subset": f"WITH {MOIST} SELECT cy, cx, count(*) AS n FROM obs WHERE cx IN (1, 3) GROUP BY cy, cx",
    "sample_points": f"""WITH {MOIST}, c AS (SELECT cy, cx, count(*) AS n FROM obs GROUP BY cy, cx), ys AS (SELECT unnest([0, 1, 2]) AS cy), xs AS (SELECT unnest([0, 2, 3]) AS cx),
p AS (SELECT row_number() OVER (ORDER BY cy, cx) - 1 AS point_id, cy, cx FROM ys, xs) SELECT CAST(point_id AS INTEGER) AS point_id, CAST(p.cy AS INTEGER) AS cy, CAST(p.cx AS INTEGER) AS cx, coalesce(n, 0) AS n FROM p LEFT JOIN c USING (cy, cx)""",
    "slot_dates": f"""WITH {MOIST}, y AS (SELECT DISTINCT year(d) AS y FROM obs), dates AS (SELECT CAST(unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), INTERVAL 1 DAY)) AS DATE) AS d FROM y), c AS (SELECT d, count(*) AS n FROM obs GROUP BY d)
SELECT CAST({_SLOT} AS INTEGER) AS slot, d, CAST(date_diff('month', d - 2, d + 2) + 1 AS INTEGER) AS months, coalesce(n, 0) AS n FROM dates LEFT JOIN c USING (d)""",
    "slot_runs": f"""WITH {MOIST}, s AS (SELECT DISTINCT CAST(slot AS INTEGER) AS slot FROM ep), r AS (SELECT min(slot) AS first, max(slot) AS last, CAST(count(*) AS INTEGER) AS slots FROM s
  GROUP BY CASE WHEN slot < 59 THEN 0 ELSE 1 END, CASE WHEN slot < 59 THEN (slot - 1) // 60 ELSE (slot - 60) // 60 END)
SELECT *, coalesce(first = lag(last) OVER (ORDER BY first) + CASE WHEN lag(last) OVER (ORDER BY first) = 58 THEN 2 ELSE 1 END, TRUE) AS follows FROM r""",
    "mid_months": f"""WITH {MOIST}, c AS (SELECT slot, count(*) AS n FROM ep GROUP BY slot), m AS (SELECT unnest([15, 46, 75, 106, 136, 167, 197, 228, 259, 289, 320, 350]) AS slot, unnest(range(1, 13)) AS month)
SELECT CAST(m.slot AS INTEGER) AS slot, CAST(month AS INTEGER) AS month, strftime(make_date(2001, month, 15), '%b') AS name, coalesce(n, 0) AS n FROM m LEFT JOIN c USING (slot)""",
    "year_ranges": f"""WITH {MOIST}, c AS (SELECT year(d) AS y, count(*) AS n FROM obs GROUP BY 1),
t AS (SELECT unnest(['1996-1998', '1999-1997', '2000', '1995, 1998,2001']) AS years, unnest([[1996, 1997, 1998], [1997, 1998, 1999], [2000], [1995, 1998, 2001]]) AS ys), u AS (SELECT years, unnest(ys) AS y FROM t)
SELECT years, count(*) AS named, CAST(sum(n) AS BIGINT) AS n FROM u LEFT JOIN c USING (y) GROUP BY years""",
}
