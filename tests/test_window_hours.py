import datetime

from pyspark.sql import functions as F

from dewfall.jobs import climatology


def test_sparse_and_empty_days_are_not_complete(spark, monkeypatch):
    """One valid hour, and a day whose values are all null."""
    days = [datetime.date(1995, 6, k) for k in (1, 2)]
    rows = [(1, 1, days[0], 3, 20.0, 15.0, 1000.0), (1, 1, days[0], 3, 21.0, 15.0, 1000.0), (1, 1, days[1], 4, None, 15.0, 1000.0)]
    rows += [(1, 1, datetime.date(1996, 6, 1), h, 20.0, 15.0, 1000.0) for h in range(24)]
    obs = spark.createDataFrame(rows, "cy int, cx int, d date, h int, t double, td double, p double")
    monkeypatch.setattr(climatology, "observations", lambda *_: obs)
    got = {r.target: (r.n, r.hours, r.completeness) for r in climatology.window_hours(spark, "").collect()}
    assert got == {days[0]: (2, 1, 1 / 120), days[1]: (2, 1, 1 / 120), datetime.date(1996, 6, 1): (24, 24, 24 / 120)}
    slots = {r.windows: (r.n, r.hours, r.completeness) for r in climatology.window_slots(spark, "").where(F.col("windows") == 2).collect()}
    assert slots == {2: (26, 25, 25 / 240)}
