"""Hourly grids in classic NetCDF files, as a data source: spark.read.format("classic_grid").option("variable", "t2m").load("/mounted/t2m_*.nc").

A partition is a slice of a file's time steps; a task reads the bytes of its steps alone. Filters on ts reach the reader: steps outside
are neither planned nor read. Packed values are unpacked (scale_factor, add_offset), fill values and NaN become null.

Files lie in folders that the driver and all executors mount. Parquet is what jobs read; this brings files into it. Only the published
classic format (versions 1 and 2) is read: fixed or record variables over (time, y, x)."""

from __future__ import annotations

import datetime
import glob
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

# Fixed values of the format: tags of its lists, and numpy's names of its types by number.
_DIMENSIONS, _VARIABLES, _ATTRIBUTES = 10, 11, 12
_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
SCHEMA = "ts timestamp, y int, x int, latitude double, longitude double, value double"
_UNITS = {"seconds": 1_000_000, "minutes": 60_000_000, "hours": 3_600_000_000, "days": 86_400_000_000}


@dataclass(frozen=True)
class Variable:
    dims: tuple[int, ...]
    attributes: dict
    kind: str
    begin: int
    recorded: bool


@dataclass(frozen=True)
class Header:
    """Lengths of dimensions (the record dimension's is the number of records), variables, and bytes from one record to the next."""

    lengths: tuple[int, ...]
    variables: dict[str, Variable]
    record: int


class _Bytes:
    def __init__(self, file):
        self.file = file

    def take(self, code: str) -> int:
        return struct.unpack(">" + code, self.file.read(struct.calcsize(code)))[0]

    def padded(self, n: int) -> bytes:
        out = self.file.read(n)
        self.file.read(-n % 4)
        return out

    def name(self) -> str:
        return self.padded(self.take("i")).decode()

    def count(self, tag: int) -> int:
        seen, n = self.take("i"), self.take("i")
        if seen not in (0, tag) or (seen == 0 and n):
            raise ValueError("not a classic NetCDF header")
        return n

    def attributes(self) -> dict:
        out = {}
        for _ in range(self.count(_ATTRIBUTES)):
            name, kind, n = self.name(), self.take("i"), self.take("i")
            values = np.frombuffer(self.padded(n * np.dtype(_TYPES[kind]).itemsize), _TYPES[kind])
            out[name] = values.tobytes().decode() if kind == 2 else values.tolist()
        return out


def header(file) -> Header:
    """The header of an open file; an error if it is no classic file."""
    data = _Bytes(file)
    magic = file.read(4)
    if magic[:3] != b"CDF" or magic[3:] not in (b"\x01", b"\x02"):
        raise ValueError("not a classic NetCDF file")
    records = data.take("i")
    names, lengths = [], []
    for _ in range(data.count(_DIMENSIONS)):
        names.append(data.name())
        lengths.append(data.take("i"))
    record_dim = lengths.index(0) if 0 in lengths else -1
    data.attributes()
    raw = {}
    for _ in range(data.count(_VARIABLES)):
        name = data.name()
        dims = tuple(data.take("i") for _ in range(data.take("i")))
        attributes, kind, size = data.attributes(), data.take("i"), data.take("i")
        raw[name] = Variable(dims, attributes, _TYPES[kind], data.take("i" if magic[3:] == b"\x01" else "q"), bool(dims) and dims[0] == record_dim), size
    sizes = [size for v, size in raw.values() if v.recorded]
    if len(sizes) == 1:  # a single record variable is not padded
        v = next(v for v, _ in raw.values() if v.recorded)
        sizes = [int(np.prod([lengths[d] for d in v.dims[1:]], dtype=np.int64)) * np.dtype(v.kind).itemsize]
    whole = tuple(records if k == record_dim else n for k, n in enumerate(lengths))
    return Header(whole, {name: v for name, (v, _) in raw.items()}, sum(sizes))


def steps(file, head: Header, name: str, first: int, upto: int) -> np.ndarray:
    """Values of a variable at steps first to upto - 1 of its first dimension, unpacked as doubles with NaN for what is missing; reads those bytes alone."""
    v = head.variables[name]
    shape = tuple(head.lengths[d] for d in v.dims[1:])
    kind = np.dtype(v.kind)
    size = int(np.prod(shape, dtype=np.int64)) * kind.itemsize
    out = np.empty((upto - first, *shape))
    for k in range(first, upto):
        file.seek(v.begin + k * (head.record if v.recorded else size))
        raw = np.frombuffer(file.read(size), kind).reshape(shape)
        x = raw.astype("f8")
        for fill in ("_FillValue", "missing_value"):
            if fill in v.attributes:
                x[raw == np.array(v.attributes[fill][0]).astype(kind)] = np.nan
        out[k - first] = x * v.attributes.get("scale_factor", [1.0])[0] + v.attributes.get("add_offset", [0.0])[0]
    return out


def times(file, head: Header, name: str) -> np.ndarray:
    """Microseconds since 1970 of the time variable, whose units read like "hours since 1900-01-01 00:00:00", in UTC."""
    unit, _, since = head.variables[name].attributes["units"].partition(" since ")
    start = datetime.datetime.fromisoformat(since.strip().removesuffix("Z").removesuffix(" UTC").split(".")[0]).replace(tzinfo=datetime.UTC)
    n = head.lengths[head.variables[name].dims[0]]
    first = (start - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)) // datetime.timedelta(microseconds=1)
    return first + np.round(steps(file, head, name, 0, n) * _UNITS[unit.strip()]).astype("i8")


@dataclass
class Slice(InputPartition):
    """Steps first to upto - 1 of a file."""

    path: str
    first: int
    upto: int


class GridReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = sorted(glob.glob(options["path"]))
        self.variable = options["variable"]
        self.width = int(options.get("steps", "24"))
        self.names = [options.get(k, k) for k in ("time", "latitude", "longitude")]
        self.low, self.high = -(1 << 62), 1 << 62
        if not self.paths:
            raise FileNotFoundError(options["path"])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of ts narrow the steps; Spark checks every filter again on what is read."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("ts",) and isinstance(f.value, datetime.datetime):
                at = int(f.value.timestamp()) * 1_000_000 + f.value.microsecond
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, at)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, at)
            yield f

    def partitions(self) -> Sequence[Slice]:
        out = []
        for path in self.paths:
            with open(path, "rb") as file:
                at = times(file, header(file), self.names[0])
            wanted = np.flatnonzero((at >= self.low) & (at <= self.high))
            if len(wanted):
                first, last = int(wanted[0]), int(wanted[-1]) + 1
                out += [Slice(path, k, min(k + self.width, last)) for k in range(first, last, self.width)]
        return out or [Slice(self.paths[0], 0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as file:
            head = header(file)
            at = times(file, head, self.names[0])
            lat, lon = (steps(file, head, n, 0, head.lengths[head.variables[n].dims[0]]) for n in self.names[1:])
            y, x = (k.ravel().astype("i4") for k in np.meshgrid(np.arange(len(lat)), np.arange(len(lon)), indexing="ij"))
            for k in range(partition.first, partition.upto):
                value = steps(file, head, self.variable, k, k + 1).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(value), at[k]), pa.timestamp("us", tz="UTC")), pa.array(y), pa.array(x), pa.array(lat[y]), pa.array(lon[x]), pa.array(value, mask=~np.isfinite(value))],
                    names=["ts", "y", "x", "latitude", "longitude", "value"],
                )


class ClassicGrid(DataSource):
    """Options: path (files or a pattern), variable, steps to a partition (24), and the names of the time, latitude and longitude variables where they differ from these."""

    @classmethod
    def name(cls) -> str:
        return "classic_grid"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GridReader:
        return GridReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ClassicGrid)
