"""Planted classic files: fixed and record variables, packing, fill values, slices, filters, errors."""

import datetime
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from dewfall.sources import grids

START = datetime.datetime(1998, 2, 27, 22, tzinfo=datetime.UTC)
LAT, LON = [31.5, 31.25, 31.0], [50.0, 50.25]
NUMBER = {"i2": 3, "i4": 4, "f4": 5, "f8": 6}


def text(s):
    raw = s.encode()
    return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def attributes(own):
    out = struct.pack(">ii", 12 if own else 0, len(own))
    for name, value in own.items():
        if isinstance(value, str):
            out += text(name) + struct.pack(">i", 2) + text(value)
        else:
            kind, number = value
            raw = np.array([number], ">" + kind).tobytes()
            out += text(name) + struct.pack(">ii", NUMBER[kind], 1) + raw + b"\0" * (-len(raw) % 4)
    return out


def planted(path, values, version=1, recorded=True, kind="f4", extra=None, packed=None):
    """A file over (time, latitude, longitude); with records, time and the variable are record variables."""
    n = len(values)
    variables = [("latitude", [1], {}, "f4", LAT), ("longitude", [2], {}, "f4", LON), ("time", [0], {"units": "hours since 1900-01-01 00:00:00"}, "i4", None), ("t2m", [0, 1, 2], extra or {}, kind, None)]
    hours = [int((START - datetime.datetime(1900, 1, 1, tzinfo=datetime.UTC)).total_seconds()) // 3600 + k for k in range(n)]
    data = {"time": np.array(hours, ">i4"), "t2m": np.array(packed if packed is not None else values, ">" + kind)}
    dims = struct.pack(">ii", 10, 3) + text("time") + struct.pack(">i", 0 if recorded else n) + text("latitude") + struct.pack(">i", 3) + text("longitude") + struct.pack(">i", 2)
    pad = lambda raw: raw + b"\0" * (-len(raw) % 4)

    def made(begins):
        out = b"CDF" + bytes([version]) + struct.pack(">i", n if recorded else 0) + dims + attributes({"title": "planted"}) + struct.pack(">ii", 11, 4)
        for (name, own, attrs, k, fixed), begin in zip(variables, begins, strict=True):
            count = int(np.prod([[n, 3, 2][d] for d in own if not (recorded and d == 0)]))
            size = count * np.dtype(k).itemsize
            out += text(name) + struct.pack(f">i{len(own)}i", len(own), *own) + attributes(attrs) + struct.pack(">ii", NUMBER[k], size + -size % 4)
            out += struct.pack(">i" if version == 1 else ">q", begin)
        return out

    start = len(made([0] * 4))
    blocks, begins = [], []
    for name, own, _, k, fixed in variables:
        begins.append(start + sum(map(len, blocks)))
        if fixed is not None:
            blocks.append(pad(np.array(fixed, ">" + k).tobytes()))
        elif not recorded:
            blocks.append(pad(data[name].tobytes()))
        elif name == "t2m":
            begins[-1] = begins[-2] + 4
    if recorded:
        blocks += [pad(data["time"][k : k + 1].tobytes()) + pad(data["t2m"][k].tobytes()) for k in range(n)]
    path.write_bytes(made(begins) + b"".join(blocks))


def expected(values):
    return {(START + datetime.timedelta(hours=k), y, x): (LAT[y], LON[x], v) for k, grid in enumerate(values) for y, row in enumerate(grid) for x, v in enumerate(row)}


def told(df):
    return {(r.ts.astimezone(datetime.UTC), r.y, r.x): (r.latitude, r.longitude, r.value) for r in df.collect()}


def values(n):
    return (np.arange(n * 6).reshape(n, 3, 2) / 4 + 270).tolist()


@pytest.mark.parametrize("version,recorded", [(1, True), (2, True), (1, False), (2, False)])
def test_round_trip(spark, tmp_path, version, recorded):
    grids.register(spark)
    planted(tmp_path / "a.nc", values(50), version, recorded)
    df = spark.read.format("classic_grid").option("variable", "t2m").option("steps", "7").load(f"{tmp_path}/*.nc")
    assert told(df) == expected(values(50)) and df.rdd.getNumPartitions() == 8


def test_packed_values_and_gaps(spark, tmp_path):
    grids.register(spark)
    own = values(4)
    packed = np.round((np.array(own) - 270) / 0.25).astype(int)
    packed[1, 2, 1] = -32767
    planted(tmp_path / "a.nc", own, kind="i2", packed=packed, extra={"scale_factor": ("f8", 0.25), "add_offset": ("f8", 270.0), "_FillValue": ("i2", -32767)})
    own[1][2][1] = None
    assert told(spark.read.format("classic_grid").option("variable", "t2m").load(f"{tmp_path}/a.nc")) == expected(own)


def test_filters_narrow_the_slices(spark, tmp_path):
    grids.register(spark)
    planted(tmp_path / "a.nc", values(60))
    (tmp_path / "b.nc").write_bytes((tmp_path / "a.nc").read_bytes())
    reader = grids.GridReader({"path": f"{tmp_path}/*.nc", "variable": "t2m", "steps": "5"})
    assert len(reader.partitions()) == 24
    first, last = START + datetime.timedelta(hours=10), START + datetime.timedelta(hours=18)
    kept = list(reader.pushFilters([grids.GreaterThanOrEqual(("ts",), first), grids.LessThan(("ts",), last)]))
    assert len(kept) == 2 and [(p.first, p.upto) for p in reader.partitions()] == [(10, 15), (15, 19)] * 2
    df = spark.read.format("classic_grid").option("variable", "t2m").load(f"{tmp_path}/a.nc").where((F.col("ts") >= F.lit(first)) & (F.col("ts") < F.lit(last)))
    assert {k for k in told(df)} == {k for k in expected(values(60)) if first <= k[0] < last}
    none = spark.read.format("classic_grid").option("variable", "t2m").load(f"{tmp_path}/a.nc").where(F.col("ts") < F.lit(START - datetime.timedelta(days=9)))
    assert none.count() == 0


def test_other_files_are_errors(spark, tmp_path):
    grids.register(spark)
    (tmp_path / "x.nc").write_bytes(b"\x89HDF\r\n")
    read = lambda name: spark.read.format("classic_grid").option("variable", "t2m").load(f"{tmp_path}/{name}").count()
    with pytest.raises(Exception, match="not a classic NetCDF file"):
        read("x.nc")
    with pytest.raises(Exception, match="FileNotFoundError|nothing.nc"):
        read("nothing.nc")
