"""Jobs over stored states: decades against the full period, products after a replay, a stream that ends with the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dewfall.jobs.climatology import moist
from dewfall.jobs.oracles import LONG, MOIST
from dewfall.operators import audits, moments
from dewfall.sources.observations import observations
from dewfall.sources.states import StateStore, scratch, work_id
from dewfall.streaming.accumulate import accumulate
from dewfall.streaming.windows import closed_windows, late_rows, run_windows


def stored(spark: SparkSession, sf_dir: str) -> StateStore:
    """A store filled year by year in two commits, the second of which repeats work of the first."""
    store, obs = StateStore(spark, scratch(spark, "states")), moist(spark, sf_dir)
    store.commit(obs.where("year(d) <= 1998"), "first")
    store.commit(obs.where("year(d) >= 1998"), "second")
    store.commit(obs.where("year(d) = 1998"), "again")
    return store


def merge_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per variable and level: decades merged again against the full period, over every key; differences beyond 1e-9 of their size are counted."""
    return audits.merge_differences(stored(spark, sf_dir).merged())


def stored_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-period means and deviations by slot and cell out of a store whose second and third commits repeat work: nothing counts twice."""
    full = stored(spark, sf_dir).merged().where("period = 'FULL' and level_bin = 0")
    return full.select("slot", "cy", "cx", "variable", "n", "mean", *moments.finalized()[:1]).select("slot", "cy", "cx", "variable", "n", F.round("mean", 9).alias("mean"), (F.round("std", 6) + 0.0).alias("std"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work per commit: days and blocks, rows, and the first and last id."""
    rows = stored(spark, sf_dir).ledger().withColumn("id", work_id())
    return rows.groupBy("commit").agg(F.count("*").alias("works"), F.sum("rows").alias("rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def _arrivals(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Observations below folder/in in three arrivals, hours 0 to 7, 8 to 15 and the rest, so that every day comes in parts."""
    obs = observations(spark, sf_dir)
    obs.withColumn("arrival", F.floor(F.col("h") / 8).cast("int")).write.partitionBy("arrival").parquet(f"{folder}/in")


def streamed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's states of relative humidity after a stream has read all observations, each day cut over three arrivals that are batches of their own."""
    folder = scratch(spark, "stream-states")
    _arrivals(spark, sf_dir, folder)
    store, schema = StateStore(spark, f"{folder}/store"), observations(spark, sf_dir).schema
    for arrival in range(3):
        raw = spark.readStream.schema(schema).parquet(f"{folder}/in/arrival={arrival}")
        accumulate(raw, store, f"{folder}/checkpoint-{arrival}", stream=f"arrival-{arrival}").awaitTermination()
    day = store.merged().where("period = 'FULL' and level_bin = 0 and variable = 'rh'")
    return day.select("slot", "cy", "cx", "n", F.round("mean", 9).alias("mean"), F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


def compacted_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-period means by slot, cell and variable out of a store that is filled a year at a time and merged whenever more than three parts are live; with the parts left to read."""
    store, obs = StateStore(spark, scratch(spark, "compacted"), parts=3), moist(spark, sf_dir)
    for row in observations(spark, sf_dir).select(F.year("d").alias("y")).distinct().orderBy("y").collect():  # one for each year
        store.commit(obs.where(F.year("d") == row.y), f"year-{row.y}")
    store.compact()
    store.vacuum()
    full = store.merged().where("period = 'FULL' and level_bin = 0")
    return full.select("slot", "cy", "cx", "variable", "n", F.round("mean", 9).alias("mean"), F.lit(len(store.live())).alias("parts"))


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema("event_id long, key string, ts timestamp, value double").parquet(folder)


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a windows stream over the events in three arrivals: by thirds of their time span, but each tenth event comes with the last."""
    folder = scratch(spark, "event-windows")
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    span = ev.agg(F.min(micros).alias("a"), F.max(micros).alias("b")).first()
    third = F.floor((F.col("us") - F.lit(span.a)) * 3 / (F.lit(span.b) - F.lit(span.a) + 1)).cast("int")
    plain = ev.select("event_id", F.col("event_type").alias("key"), micros.alias("us"), "value")
    arrival = F.when(F.col("event_id") % 10 == 0, 2).otherwise(third)
    plain.select("event_id", "key", F.timestamp_micros("us").alias("ts"), "value", arrival.alias("arrival")).write.partitionBy("arrival").parquet(f"{folder}/stage")
    for k in range(3):
        spark.read.parquet(f"{folder}/stage/arrival={k}").write.mode("append").parquet(f"{folder}/in")
        run_windows(_event_stream(spark, f"{folder}/in"), folder).awaitTermination()
    return folder


def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed windows of the event stream, restarted for each of three arrivals: three hours, a day, five days by the day.

    Rows that the watermark had passed are in none of them; they are counted by the three-hour bins that they missed, as kind late."""
    folder = _streamed(spark, sf_dir)
    bin_start = F.window("ts", "3 hours").start.alias("start")
    late = late_rows(spark, folder).groupBy(F.lit("late").alias("kind"), "key", bin_start).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    both = closed_windows(spark, folder).unionByName(late)
    start = F.expr("timestampadd(MICROSECOND, unix_micros(start), TIMESTAMP_NTZ '1970-01-01 00:00:00')")
    return both.select("kind", F.col("key").alias("event_type"), start.alias("start"), "n", F.round("total", 6).alias("total"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type in three-hour bins and in sliding five-day windows by the day: the batch form of the stream's windows."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "value")
    bins = ev.groupBy("event_type", F.window("ts", "3 hours").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("s")).withColumn("kind", F.lit("3 hours"))
    days = ev.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    wide = days.groupBy("event_type", F.window(F.col("d").cast("timestamp_ntz"), "5 days", "1 day").alias("w")).agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("kind", F.lit("5 days"))
    both = bins.unionByName(wide)
    return both.select("event_type", "kind", F.col("w.start").alias("start"), "n", (F.col("s") / F.col("n")).alias("mean"))


def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the states: each check with how many keys break it, and PASS or FAIL."""
    states = stored(spark, sf_dir).merged()
    hours = moist(spark, sf_dir).groupBy("slot", "cy", "cx").agg(F.count("*").alias("hours"))
    over = states.where("period = 'FULL' and level_bin = 0").join(hours, ["slot", "cy", "cx"], "left").where("hours is null or n > hours")
    within = over.agg(F.count("*").alias("broken")).select(F.lit("n within hours").alias("check"), "broken")
    return audits.verdict(audits.broken_invariants(states).unionByName(within))


#: Events with the arrival that they come in, and whether the newest of earlier arrivals is more than two days ahead of them.
_ARRIVED = """sp AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM events),
ar AS (SELECT event_id, event_type, ts, value, CASE WHEN event_id % 10 = 0 THEN 2 ELSE (epoch_us(ts) - a) * 3 // (b - a + 1) END AS k FROM events, sp),
mk AS (SELECT k, max(ts) AS newest FROM ar GROUP BY k),
ev AS (SELECT *, coalesce(ts <= (SELECT max(newest) FROM mk WHERE mk.k < ar.k) - INTERVAL 2 DAY, FALSE) AS late FROM ar)"""
_ID = "substr(sha256(strftime(d, '%Y-%m-%d') || printf('-Y%05d-X%05d', cy, cx)), 1, 32)"
SQL: dict[str, str] = {
    "merge_audit": f"""WITH {MOIST}{LONG}, lev AS (SELECT *, unnest([0, 1 + h // 3, 9 + h]) AS level_bin FROM long),
dec AS (SELECT decade, slot, level_bin, cy, cx, variable, count(x) AS n, avg(x) AS mean, var_pop(x) * count(x) AS m2, min(x) AS low, max(x) AS high FROM lev GROUP BY ALL HAVING count(x) > 0),
mu AS (SELECT slot, level_bin, cy, cx, variable, sum(n * mean) / sum(n) AS m FROM dec GROUP BY ALL),
mg AS (SELECT slot, level_bin, cy, cx, variable, sum(n) AS n, any_value(m) AS mean, sum(m2 + n * (mean - m) ** 2) AS m2, min(low) AS low, max(high) AS high FROM dec JOIN mu USING (slot, level_bin, cy, cx, variable) GROUP BY ALL),
fu AS (SELECT slot, level_bin, cy, cx, variable, count(x) AS fn, avg(x) AS fmean, var_pop(x) * count(x) AS fm2, min(x) AS flow, max(x) AS fhigh FROM lev GROUP BY ALL HAVING count(x) > 0)
SELECT variable, CASE WHEN level_bin = 0 THEN 'L1' WHEN level_bin < 9 THEN 'L2' ELSE 'L3' END AS level, count(*) AS keys, CAST(sum(n) AS BIGINT) AS n,
  count(*) FILTER (coalesce(abs(mean - fmean) > 1e-9 * abs(mean) OR abs(m2 - fm2) > 1e-9 * (n * mean * mean + m2) OR n <> fn OR low <> flow OR high <> fhigh, TRUE)) AS off
FROM mg FULL JOIN fu USING (slot, level_bin, cy, cx, variable) GROUP BY 1, 2""",
    "stored_products": f"WITH {MOIST}{LONG} SELECT slot, cy, cx, variable, count(x) AS n, round(avg(x), 9) AS mean, round(stddev_samp(x), 6) + 0 AS std FROM long GROUP BY ALL HAVING count(x) > 0",
    "ledger": f"""WITH {MOIST}, w AS (SELECT CASE WHEN year(d) <= 1998 THEN 'first' ELSE 'second' END AS commit, d, cy, cx, count(*) AS rows FROM obs GROUP BY ALL)
SELECT commit, count(*) AS works, CAST(sum(rows) AS BIGINT) AS rows, min({_ID}) AS first_id, max({_ID}) AS last_id FROM w GROUP BY commit""",
    "streamed_states": f"WITH {MOIST} SELECT slot, cy, cx, count(rh) AS n, round(avg(rh), 9) AS mean, round(min(rh), 9) AS low, round(max(rh), 9) AS high FROM moist GROUP BY slot, cy, cx HAVING count(rh) > 0",
    "compacted_products": f"WITH {MOIST}{LONG} SELECT slot, cy, cx, variable, count(x) AS n, round(avg(x), 9) AS mean, 1 AS parts FROM long GROUP BY ALL HAVING count(x) > 0",
    "streamed_windows": f"""WITH {_ARRIVED}, ok AS (SELECT * FROM ev WHERE NOT late), w AS (
  SELECT '3 hours' AS kind, event_type, time_bucket(INTERVAL 3 HOUR, ts) AS start, INTERVAL 3 HOUR AS width, value FROM ok
  UNION ALL SELECT '1 day', event_type, time_bucket(INTERVAL 1 DAY, ts), INTERVAL 1 DAY, value FROM ok
  UNION ALL SELECT '5 days', event_type, CAST(CAST(ts AS DATE) - unnest([0, 1, 2, 3, 4]) AS TIMESTAMP), INTERVAL 5 DAY, value FROM ok)
SELECT kind, event_type, start, count(*) AS n, round(sum(value), 6) AS total FROM w WHERE start + width <= (SELECT max(ts) - INTERVAL 2 DAY FROM ev) GROUP BY kind, event_type, start
UNION ALL SELECT 'late', event_type, time_bucket(INTERVAL 3 HOUR, ts), count(*), round(sum(value), 6) FROM ev WHERE late GROUP BY ALL""",
    "event_windows": """SELECT event_type, '3 hours' AS kind, time_bucket(INTERVAL 3 HOUR, ts) AS start, count(*) AS n, avg(value) AS mean FROM events GROUP BY ALL
UNION ALL SELECT event_type, '5 days', start, count(*), avg(value) FROM (SELECT event_type, value, CAST(CAST(ts AS DATE) - unnest([0, 1, 2, 3, 4]) AS TIMESTAMP) AS start FROM events) GROUP BY ALL""",
    "invariants": f"""WITH {MOIST}{LONG}, lev AS (SELECT *, unnest([0, 1 + h // 3, 9 + h]) AS level_bin, unnest([0, 1, 2]) AS lv FROM long), pl AS (SELECT *, unnest([CAST(decade AS VARCHAR), 'FULL']) AS period FROM lev),
st AS (SELECT period, slot, level_bin, lv, cy, cx, variable, count(x) AS n, avg(x) AS mean, var_pop(x) * count(x) AS m2, min(x) AS low, max(x) AS high FROM pl GROUP BY ALL HAVING count(x) > 0),
lm AS (SELECT period, slot, cy, cx, variable, sum(n) FILTER (lv = 0) AS a, sum(n) FILTER (lv = 1) AS b, sum(n) FILTER (lv = 2) AS c FROM st GROUP BY ALL), hc AS (SELECT slot, cy, cx, count(*) AS hours FROM moist GROUP BY ALL),
ch AS (SELECT 'mean between extremes' AS "check", count(*) AS broken FROM st WHERE low > high OR mean < low - 1e-9 * abs(low) OR mean > high + 1e-9 * abs(high)
  UNION ALL SELECT 'reserved slot empty', count(*) FROM st WHERE slot = 59 UNION ALL SELECT 'even moments not negative', count(*) FROM st WHERE m2 < 0 OR n <= 0
  UNION ALL SELECT 'levels agree in n', count(*) FROM lm WHERE a IS DISTINCT FROM b OR b IS DISTINCT FROM c
  UNION ALL SELECT 'n within hours', count(*) FROM st LEFT JOIN hc USING (slot, cy, cx) WHERE period = 'FULL' AND level_bin = 0 AND (hours IS NULL OR n > hours))
SELECT *, CASE WHEN broken = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ch""",
}
