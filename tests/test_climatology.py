import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from dewfall.functions import calendar, physics
from dewfall.jobs import catalog, climatology
from dewfall.operators import moments, windows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(compare, name):
    compare(SF, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def test_calendar_has_every_slot(spark):
    rows = {r.slot: r for r in calendar.calendar(spark).collect()}
    assert set(rows) == set(range(1, 367)) and [s for s, r in rows.items() if r.reserved] == [calendar.RESERVED]


def test_merge_equals_batch(spark):
    rng = random.Random(11)
    rows = [(k % 3, rng.gauss(0, 1)) for k in range(90)]
    df = spark.createDataFrame(rows, "part int, x double")
    whole = df.groupBy().agg(*moments.moment_state("x")).first()
    parts = df.groupBy("part").agg(*moments.moment_state("x")).withColumn("g", F.lit(1))
    merged = moments.merge_moments(parts, ["g"]).first()
    for c in ("n", "mean", "m2", "m3", "m4", "low", "high"):
        assert merged[c] == pytest.approx(whole[c], abs=1e-9)


def test_moments_by_hand(spark):
    rng = random.Random(77)
    xs = [round(rng.expovariate(0.2), 3) for _ in range(9)]
    mean = sum(xs) / len(xs)
    s = spark.createDataFrame([(x,) for x in xs], "x double").agg(*moments.moment_state("x")).first()
    for k, c in ((2, "m2"), (3, "m3"), (4, "m4")):
        assert s[c] == pytest.approx(sum((x - mean) ** k for x in xs))


def test_physics_by_hand(spark):
    """Water at and above 0 °C, ice below, by the input's own sign; pressure below vapour pressure gives no mixing ratio."""
    svp = lambda t: 6.112 * math.exp((17.67 * t / (t + 243.5)) if t >= 0 else (22.46 * t / (t + 272.62)))
    rng = random.Random(8)
    rows = [(t := rng.uniform(-30, 35), t - rng.uniform(-0.5, 9), rng.uniform(500, 1040)) for _ in range(40)] + [(0.0, -0.01, 1000.0), (None, 1.0, 900.0), (7.0, 6.5, 2.0)]
    got = physics.with_moisture(spark.createDataFrame(rows, "t double, td double, p double")).collect()
    for r, (t, td, p) in zip(got[:-2], rows[:-2]):
        e = svp(td)
        assert r.e == pytest.approx(e) and r.rh == pytest.approx(min(100, 100 * e / svp(t))) and r.supersat == (e > svp(t))
        assert r.r == pytest.approx(0.622 * e / (p - e)) and r.q == pytest.approx(r.r / (1 + r.r))
    assert got[-2].rh is None and got[-2].q is not None
    assert got[-1].bad_ep and got[-1].q is None


def test_units(spark):
    df = spark.createDataFrame([(300.0, " Kelvin "), (26.85, "°C")], "v double, u string")
    assert [round(r[0], 2) for r in df.select(physics.temperature_celsius(F.col("v"), F.col("u"))).collect()] == [26.85, 26.85]
    with pytest.raises(Exception, match="unknown"):
        df.select(physics.pressure_hpa(F.col("v"), F.col("u"))).collect()


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (130.0,), (130.1,), (None,), (65.0,)], "x double")
    assert [r[0] for r in df.select(moments.bin_of(F.col("x"), 0, 130)).collect()] == [0, 7, None, None, 4]


def test_average_rank_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 7.0), (1, None)], "g int, x double")
    assert sorted(r.rank_avg for r in windows.average_rank(df, ["g"], "x").collect()) == [1.5, 1.5, 3.0]


def test_ranks_hold_whatever_order_rows_arrive_in(spark):
    """Every time the rows are read they come in another order, as rows of a shuffle do on several machines."""

    def run(batches):
        for batch in batches:
            yield batch.take(random.SystemRandom().sample(range(batch.num_rows), batch.num_rows))

    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(600_000, numPartitions=8).selectExpr("1 as g", "cast(id * id as double) as x").mapInArrow(run, "g int, x double")
        wrong = windows.average_rank(df, ["g"], "x").where("rank_avg <> round(sqrt(x)) + 1 or n <> 600000").count()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert wrong == 0


def test_shared_mask_by_hand(spark, monkeypatch):
    """Four hours: one lacks its dew point, one its pressure, one is infinite; a cell without any whole row."""
    day = datetime.date(1996, 3, 1)
    rows = [(0, 0, day, h, t, td, p) for h, (t, td, p) in enumerate([(20.0, 10.0, 1000.0), (21.0, None, 1000.0), (22.0, 12.0, None), (float("inf"), 13.0, 1000.0), (24.0, 14.0, 990.0)])]
    rows += [(1, 0, day, 0, 20.0, 10.0, None)]
    obs = spark.createDataFrame(rows, "cy int, cx int, d date, h int, t double, td double, p double")
    monkeypatch.setattr(climatology, "observations", lambda *_: obs)
    got = {(r.cy, r.variable): r for r in climatology.shared_mask(spark, "").collect()}
    assert {k: (r.n, r.missing, r.left_out) for k, r in got.items() if k[0] == 0} == {(0, "rh"): (2, 3, 1), (0, "e"): (2, 3, 2), (0, "r"): (2, 3, 1), (0, "q"): (2, 3, 1)}
    assert got[1, "rh"].n == 0 and got[1, "rh"].left_out == 1 and got[1, "rh"].mean is None and got[1, "q"].left_out == 0
    both = spark.createDataFrame([(10.0,), (14.0,)], "td double").select(F.avg(physics.saturation_vapor_pressure(F.col("td")))).first()[0]
    assert got[0, "e"].mean == pytest.approx(both, abs=1e-8)
