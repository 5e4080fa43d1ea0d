"""Stored inputs: joined where they lie, turned to the reference's axes, errors for what lacks or adds an hour."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from dewfall.sources import triplets

SCHEMA = "cy int, cx int, d date, h int, x double"


def values(days=6, shift=0.0, flip=False):
    return [(y, 3 - x if flip else x, datetime.date(2001, 1, 1) + datetime.timedelta(d), h, shift + 1000 * y + 100 * x + d + h / 100 if h != 5 else None) for y in range(2) for x in range(4) for d in range(days) for h in range(0, 24, 5)]


@pytest.fixture
def inputs(spark, tmp_path):
    made = []

    def run(**rows):
        tag = uuid.uuid4().hex[:8]
        names = []
        for name, own in rows.items():
            triplets.store_input(spark.createDataFrame(own, SCHEMA), f"{name}_{tag}", f"file://{tmp_path}", 4)
            names.append(f"{name}_{tag}")
        made.extend(names)
        return names

    yield run
    for name in made:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_inputs_join_without_exchange(spark, inputs):
    names = inputs(t=values(), td=values(shift=0.25), p=values(shift=0.5))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = triplets.aligned(spark, names)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    got = {(r.cy, r.cx, r.d, r.h): (r.t, r.td, r.p) for r in df.collect()}
    assert got == {(y, x, d, h): (v, v + 0.25, v + 0.5) if v is not None else (None,) * 3 for y, x, d, h, v in values()}


@pytest.mark.parametrize("change", ["missing hour", "extra hour", "missing day", "extra day"])
def test_differences_are_errors(spark, inputs, change):
    whole = values()
    day = datetime.date(2001, 1, 3)
    here = lambda r: (r[0], r[1], r[2]) == (1, 2, day)
    new = datetime.date(2001, 2, 1)
    other = {
        "missing hour": [r for r in whole if not (here(r) and r[3] == 10)],
        "extra hour": [*whole, (1, 2, day, 11, 1.0)],
        "missing day": [r for r in whole if not here(r)],
        "extra day": [*whole, (1, 2, new, 0, 1.0)],
    }[change]
    names = inputs(t=whole, td=whole, p=other)
    named = "p_.* at cell 1,2 on " + str(new if change == "extra day" else day)
    with pytest.raises(Exception, match=named):
        triplets.aligned(spark, names).collect()
    r = triplets.alignment_report(spark, names).collect()
    counts = {"missing hour": (1, 0), "extra hour": (0, 1), "missing day": (5, 0), "extra day": (0, 1)}[change]
    assert [(x.cy, x.cx, x.input, x.days, (x.missing, x.extra)) for x in r] == [(1, 2, names[2], 1, counts)]


def test_an_hour_that_comes_twice_is_an_error(spark):
    rows = values(1)
    with pytest.raises(Exception, match="comes twice on 2001-01-01"):
        triplets.slabs(spark.createDataFrame([*rows, rows[3]], SCHEMA)).collect()


AXES = {
    "ref": [10.0, 10.1, 10.2, 10.3],
    "same": [10.0000004, 10.1, 10.2, 10.3],
    "back": [10.3, 10.2, 10.1, 10.0],
    "off": [10.0, 10.1, 10.2, 10.31],
    "short": [10.0, 10.1, 10.2],
    "flat": [10.0, 10.1, 10.1, 10.3],
    "gone": [10.0, None, 10.2, 10.3],
}


def test_relations_of_axes(spark):
    axes = spark.createDataFrame([(g, k, v) for g, vs in AXES.items() for k, v in enumerate(vs)], "grid string, k int, value double")
    got = {r.grid: (r.n, r.relation, r.monotonic) for r in triplets.axis_relations(axes, "ref").collect()}
    assert got == {
        "ref": (4, "exact", True), "same": (4, "exact", True), "back": (4, "reversed", True), "off": (4, "mismatch", True),
        "short": (3, "mismatch", True), "flat": (4, "mismatch", False), "gone": (4, "mismatch", False),
    }
    relations = triplets.axis_relations(axes, "ref")
    flipped = triplets.turned(spark.createDataFrame(values(1, flip=True), SCHEMA), relations, "back")
    assert sorted(flipped.where(F.col("x").isNotNull()).collect()) == sorted(spark.createDataFrame([v for v in values(1) if v[4] is not None], SCHEMA).collect())
    for grid, says in (("off", "not the reference"), ("flat", "not monotonic")):
        with pytest.raises(Exception, match=says):
            triplets.turned(spark.createDataFrame(values(1), SCHEMA), relations, grid).collect()
