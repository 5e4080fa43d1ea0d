"""The steps of a climatology from files: validation, a run that is taken up again, audits, report, the command line."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from dewfall import __main__, climate


def tables(spark, folder, first=2001, years=2, change=None):
    """Inputs of two cells with every hour of the years, in K and Pa."""
    start = datetime.datetime(first, 1, 1, tzinfo=datetime.UTC)
    hours = int((datetime.datetime(first + years, 1, 1, tzinfo=datetime.UTC) - start).total_seconds() // 3600)
    base = spark.range(hours * 2).select(F.timestamp_seconds(F.lit(int(start.timestamp())) + F.floor(F.col("id") / 2) * 3600).alias("ts"), F.lit(0).alias("cy"), (F.col("id") % 2).cast("int").alias("cx"), F.floor(F.col("id") / 2).alias("k"))
    value = {"t2m": 280 + F.col("k") % 17, "d2m": 275 + F.col("k") % 11, "sp": 90_000 + F.col("k") % 1_000}
    for name, x in value.items():
        own = base
        if change == f"{name} lacks":
            own = own.where("not (cx = 1 and k between 100 and 104)")
        if change == f"{name} twice":
            own = own.unionByName(own.where("k = 7"))
        own.select("ts", "cy", "cx", x.cast("double").alias("value")).write.mode("overwrite").parquet(f"{folder}/{name}")
    return climate.Config(*(f"{folder}/{n}" for n in climate.INPUTS), store=f"{folder}/store", output=f"{folder}/out", first_year=first, last_year=first + years - 1, buckets=2)


def test_configurations_are_checked():
    with pytest.raises(ValueError, match="first_year"):
        climate.Config("a", "b", "c", "d", "e", first_year=2001, last_year=2000)
    with pytest.raises(ValueError, match="buckets"):
        climate.Config("a", "b", "c", "d", "e", buckets=0)


@pytest.mark.parametrize("change,broken", [(None, {}), ("d2m lacks", {"d2m: cells short of hours": 1, "d2m: hours apart from t2m": 5}), ("sp twice", {"sp: hours that come twice": 2})])
def test_validation(spark, tmp_path, change, broken):
    config = tables(spark, f"file://{tmp_path}", years=1, change=change)
    got = {r.check: (r.broken, r.verdict) for r in climate.validate(spark, config, 2001).collect()}
    assert len(got) == 8 and {k: v[0] for k, v in got.items() if v[1] == "FAIL"} == broken


def test_run_goes_on_and_reports(spark, tmp_path, capsys):
    config = tables(spark, f"file://{tmp_path}")
    one = climate.Config(**{**climate.asdict(config), "last_year": 2001})
    assert climate.run(spark, one) == [2001] and climate.run(spark, config) == [2002] and climate.run(spark, config) == []
    path = tmp_path / "config.json"
    path.write_text(json.dumps(climate.asdict(config)))
    for step, code in (("audit", 0), ("merge-audit", 0), ("report", 0), ("run", 0)):
        assert __main__.main([step, "--config", str(path)]) == code
    told = [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert [t.get("status") for t in told] == ["PASS", "PASS", None, None] and told[2]["rows"] == 2 * 730 * 24 and told[3] == {"added": []}
    products = spark.read.parquet(f"{config.output}/products").where("period = 'FULL' and level_bin = 0 and variable = 'e'")
    assert products.count() == 2 * 365 and products.agg(F.sum("n")).first()[0] == 2 * 730 * 24
    assert {r.n for r in products.collect()} == {48}


def test_inputs_apart_stop_a_run(spark, tmp_path):
    config = tables(spark, f"file://{tmp_path}", years=1, change="sp lacks")
    with pytest.raises(Exception, match="sp_.* lacks hours"):
        climate.run(spark, config)
    assert config.states(spark).live() == []
