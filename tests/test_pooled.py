"""Window samples against an exploded join, fits with status, tiles, points and mid-months."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from dewfall.functions import calendar
from dewfall.jobs import pooling
from dewfall.operators import fits, pooled

rng = np.random.default_rng(9)
HOURS = "cy int, cx int, d date, h int, rh double, q double"


def hours(first=datetime.date(1999, 12, 25), days=100, cells=((0, 0), (0, 1), (2, 3))):
    rows = []
    for cy, cx in cells:
        for k in range(days):
            for h in range(0, 24, 8):
                x = float(rng.beta(4, 2))
                rows.append((cy, cx, first + datetime.timedelta(k), h, x if rng.random() > 0.05 else None, 0.01 * x + float(rng.normal(0, 0.001))))
    return rows


def slot_of(d):
    leap = d.year % 4 == 0 and (d.year % 100 != 0 or d.year % 400 == 0)
    n = d.timetuple().tm_yday
    return 60 if d.month == 2 and d.day >= 28 else n if n < 59 else n + (0 if leap else 1)


def exploded(rows, first, last):
    out = {}
    for cy, cx, d, _, rh, q in rows:
        for k in range(-2, 3):
            t = d + datetime.timedelta(k)
            if rh is not None and first <= t.year <= last:
                out.setdefault((cy, cx, slot_of(t)), []).append((rh, q))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("years", [(1999, 2000), (2000, 2000)])
def test_samples_equal_an_exploded_join(spark, years):
    rows = hours() + hours(datetime.date(2000, 12, 28), 6, ((0, 0),))
    dealt = pooled.dealt(pooled.day_blocks(spark.createDataFrame(rows, HOURS), ("rh", "q")), *years)
    assert dealt.count() < 1.4 * len({r[:3] for r in rows})
    got = pooled.grouped_samples(dealt, lambda key, x: [(*key, *map(float, r)) for r in x], "cy int, cx int, slot int, rh double, q double").collect()
    want = exploded(rows, *years)
    seen = {}
    for r in got:
        seen.setdefault((r.cy, r.cx, r.slot), []).append((r.rh, r.q))
    assert {k: sorted(v) for k, v in seen.items()} == want
    assert len(want[0, 0, 60]) > len(want[0, 0, 57])  # two dates in a leap year


def test_compact_slots(spark):
    df = calendar.calendar(spark).where("reserved = 0").select("slot", pooled.compact_slot(F.col("slot")).alias("c")).orderBy("slot").collect()
    assert [r.c for r in df] == list(range(365))


def test_statuses():
    x = rng.normal(0.6, 0.1, 200)
    n, name, params, q_name, q_params, rho, status = pooled.fit_sample(x, x**2, tuple(fits.MARGINALS))
    assert status == "ok" and n == 200 and len(params) == len(q_params) == pooled.PARAMS and rho == pytest.approx(0.9999, abs=1e-3)
    used = {"Normal": 2, "SkewNormalMoments": 3, "SkewNormal": 3, "PearsonIII": 3, "BimodalNormal": 5, "Beta": 2}
    assert sum(p is not None for p in params) == used[name] and sum(p is not None for p in q_params) == used[q_name]
    assert pooled.fit_sample(x[:29], x[:29], pooling.QUICK)[-1] == "insufficient_data"
    assert pooled.fit_sample(np.ones(50), x[:50], pooling.QUICK)[-1] == "fit_failed"
    assert pooled.fit_sample(x, x, ("no such family",))[-1].startswith("exception:KeyError")


def results(spark, cells, value):
    none = [None] * 3
    rows = [(y, x, s, 40, "Normal", [value, 0.1, *none], "Normal", [value, 0.2, *none], 0.5, "ok") for y, x in cells for s in (1, 30, 31, 58, 60, 61, 366)]
    return spark.createDataFrame(rows, pooled.FITTED)


def test_a_tile_replaces_itself_alone(spark, tmp_path):
    folder = f"file://{tmp_path}/tiles"
    cells = [(y, x) for y in range(4) for x in range(4)]
    pooled.write_tiles(results(spark, cells, 1.0), folder, 2)
    pooled.write_tiles(results(spark, [c for c in cells if c[0] < 2 and c[1] >= 2], 2.0).where("slot <= 30"), folder, 2)
    got = {(r.cy, r.cx, r.slot): (r.compact, r.rh_params[0]) for r in pooled.merge_tiles(spark, folder, 2).collect()}
    assert len(got) == 16 * 7
    for (y, x, s), (compact, value) in got.items():
        assert value == (2.0 if y < 2 <= x and s <= 30 else 1.0) and compact == (s - 1 if s < 59 else s - 2)


@pytest.mark.parametrize("bad", ["twice", "wrong tile", "short"])
def test_unsound_tiles_are_errors(spark, tmp_path, bad):
    folder = f"file://{tmp_path}/tiles"
    own = results(spark, [(0, 0)], 1.0)
    pooled.write_tiles(own, folder, 2)
    if bad == "twice":
        own.withColumns({"tile": F.lit("0-0"), "chunk": F.lit(0)}).where("slot = 1").write.mode("append").partitionBy("tile", "chunk").parquet(folder)
    elif bad == "wrong tile":
        own.withColumns({"tile": F.lit("1-0"), "chunk": F.lit(0), "cy": F.lit(1)}).where("slot = 1").write.mode("append").partitionBy("tile", "chunk").parquet(folder)
    else:
        pooled.write_tiles(own.withColumn("rh_params", F.slice("rh_params", 1, 3)), folder, 2)
    with pytest.raises(Exception, match="not one sound row at cell"):
        pooled.merge_tiles(spark, folder, 2).collect()


def test_five_years_are_needed(spark, monkeypatch):
    monkeypatch.setattr(pooling, "_years", lambda *_: (1995, 1998))
    with pytest.raises(ValueError, match="too few"):
        pooling.point_blocks(spark, "/root/testdata/sf0.001")
    assert pooling.sample_places(3, 3) == [0, 1, 2] and pooling.sample_places(4, 3) == [0, 2, 3] and pooling.sample_places(1, 3) == [0] and pooling.sample_places(6, 3) == [0, 2, 5]


def test_log_phi_is_smooth_and_exact():
    import math

    x = np.r_[np.linspace(-19.99, 19.99, 5_003), -20.0, 20.0, 35.0, 0.0]
    want = np.array([math.log(0.5 * math.erfc(-v / math.sqrt(2))) for v in x])
    assert fits.log_phi(x) == pytest.approx(want, rel=1e-10, abs=1e-10)
    assert fits.log_phi(np.array([-37.0]))[0] == pytest.approx(math.log(0.5 * math.erfc(37 / math.sqrt(2))), rel=1e-6)
