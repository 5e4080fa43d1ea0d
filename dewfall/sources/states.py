"""Climatology states on disk: Parquet by period, a ledger of the work that they hold, merges that can be repeated.

A commit writes the states of its work and its ledger rows into folders named after it, then one row into the log; only what the log
names counts. So a commit that died half-way, or ran twice, changes nothing.

Work is a day and block. A commit either brings days whole, and then skips those that are in, or it brings a `source`, such as one batch of a stream: a
source counts once, and days that come in several sources add up. Rows of a day that is in the other way are neither added nor lost; they go to `refused`.

compact() merges what is live into one part, whose log row names the parts that it covers; readers then open that part and the
commits since. One writer at a time."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dewfall.functions import calendar
from dewfall.functions.physics import VARIABLES
from dewfall.operators import moments

#: Changes of the layout make old stores unreadable, rather than misread.
SCHEMA_VERSION = 2
KEYS = ("period", "slot", "level_bin", "cy", "cx", "variable")
LOG = "part string, source string, covers array<string>, config string"
LEDGER = "commit string, source string, d date, cy int, cx int, rows long"
STATES = "slot int, level_bin int, cy int, cx int, variable string, n long, mean double, m2 double, m3 double, m4 double, low double, high double, period string"
#: Parts that may be live before a commit merges them.
PARTS = 16


def work_id() -> F.Column:
    """The id of a day and block: 32 hexadecimal digits."""
    return F.substring(F.sha2(F.concat(F.date_format("d", "yyyy-MM-dd"), F.format_string("-Y%05d-X%05d", "cy", "cx")), 256), 1, 32)


def fingerprint(config: dict) -> str:
    """SHA-256 of the canonical JSON of a configuration."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder below spark.checkpoint.dir, or below a temporary one in a local session without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder through Hadoop; nothing happens where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class StateStore:
    """States below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, config: dict | None = None, parts: int = PARTS):
        self.spark, self.folder, self.most = spark, folder.rstrip("/"), parts
        self.config = fingerprint({"version": SCHEMA_VERSION} | (config or {}))

    def _read(self, schema: str, *folders: str) -> DataFrame:
        """The rows below these folders; none where the first is missing or there are none."""
        try:
            return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def log(self) -> list:
        """A row for each commit and each merge. A store with another configuration raises an error."""
        rows = self._read(LOG, f"{self.folder}/log").collect()  # as many as commits
        if any(r.config != self.config for r in rows):
            raise ValueError("the store was written with another configuration")
        return rows

    def live(self) -> list[str]:
        """The parts that count: in the log, and not covered by a merge."""
        rows = self.log()
        covered = {c for r in rows for c in r.covers or ()}
        return sorted({r.part for r in rows} - covered)

    def ledger(self, live: Sequence[str] | None = None) -> DataFrame:
        """The work that is done, of all live parts or those given; empty for a new store."""
        return self._read(LEDGER, *(f"{self.folder}/ledger/{p}" for p in (self.live() if live is None else live)))

    def refused(self) -> DataFrame:
        """Rows that a source brought for days that are in whole, with their source; empty for a new store."""
        try:
            return self.spark.read.parquet(f"{self.folder}/refused")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], LEDGER)

    def pending(self, obs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
        """The rows of obs whose day and block are not in the ledger."""
        return obs.join((ledger if ledger is not None else self.ledger()).select("d", "cy", "cx").distinct(), ["d", "cy", "cx"], "left_anti")

    def commit(self, obs: DataFrame, name: str, source: str | None = None) -> bool:
        """Add the states of obs(d, h, slot, cy, cx and variables); False where nothing of it was new.

        Without a source, days come whole, and those that are in are skipped. With one, such as a stream and its batch, all is added once;
        a source that is in adds nothing. Reads obs once; a second time only if a source meets days that came whole."""
        live = self.live()
        ledger = self.ledger(live)
        if source is not None and not ledger.where(F.col("source") == source).isEmpty():
            return False
        if not live:
            new = obs
        else:
            new = self.pending(obs, ledger) if source is None else self._beside_whole(obs, ledger, name, source)
        # hours are written once; states and ledger rows come from them, not from another pass over obs
        hours = f"{self.folder}/hours/{name}"
        hourly(new).write.mode("overwrite").parquet(hours)
        done = self.spark.read.parquet(hours)
        self._write(daily_states(done), f"states/part={name}", "period")
        work = done.groupBy("d", "cy", "cx").agg(F.sum("rows").alias("rows"))
        added = work.select(F.lit(name).alias("commit"), F.lit(source).cast("string").alias("source"), "d", F.col("cy").cast("int").alias("cy"), F.col("cx").cast("int").alias("cx"), "rows")
        self._write(added, f"ledger/{name}")
        any_new = not self.spark.read.schema(LEDGER).parquet(f"{self.folder}/ledger/{name}").isEmpty()
        if any_new:
            self._record(name, source, [])
        delete_folder(self.spark, hours)
        if any_new and len({*live, name}) > self.most:
            self.compact()
        return any_new

    def _beside_whole(self, obs: DataFrame, ledger: DataFrame, name: str, source: str) -> DataFrame:
        """obs without days that are in whole, which go to `refused`."""
        whole = ledger.where("source is null").select("d", "cy", "cx").distinct()
        if whole.isEmpty():
            return obs
        keys = ["d", "cy", "cx"]
        obs.join(whole, keys, "left_semi").withColumn("commit", F.lit(source)).write.mode("overwrite").parquet(f"{self.folder}/refused/commit_of={name}")
        return obs.join(whole, keys, "left_anti")

    def _write(self, df: DataFrame, kind: str, *by: str) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.folder}/{kind}")

    def _record(self, part: str, source: str | None, covers: list[str]) -> None:
        """The log row that makes a part count: one file, so it is there or not."""
        self.spark.createDataFrame([(part, source, covers, self.config)], LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def compact(self) -> str | None:
        """Merge the live parts into one, whose name is returned; the parts that it covers stay until vacuum()."""
        live = self.live()
        if len(live) < 2:
            return None
        name = f"merged-{uuid.uuid4().hex}"
        self._write(self.merged(), f"states/part={name}", "period")
        self._write(self.ledger(), f"ledger/{name}")
        self._record(name, None, live)
        return name

    def vacuum(self) -> int:
        """Delete the folders of covered parts, once no reader uses them; their number."""
        covered = sorted({c for r in self.log() for c in r.covers or ()})
        for part in covered:
            delete_folder(self.spark, f"{self.folder}/states/part={part}")
            delete_folder(self.spark, f"{self.folder}/ledger/{part}")
        return len(covered)

    def drop(self) -> None:
        """Delete the store."""
        delete_folder(self.spark, self.folder)

    def parts(self) -> DataFrame:
        """States of all live parts: at most one for each part and key."""
        paths = [f"{self.folder}/states/part={p}" for p in self.live()]
        if not paths:
            return self.spark.createDataFrame([], STATES)
        return self.spark.read.schema(STATES + ", part string").option("basePath", f"{self.folder}/states").parquet(*paths).drop("part")

    def merged(self) -> DataFrame:
        """One state for each key: all live parts merged, at most PARTS and one."""
        return moments.merge_moments(self.parts(), KEYS)

    def finish(self, folder: str) -> None:
        """Products of every period: Parquet by period, and a summary table as CSV."""
        products = self.merged().select(*KEYS, "n", "mean", *moments.finalized(), "low", "high")
        products.write.mode("overwrite").partitionBy("period").parquet(f"{folder}/products")
        summary = products.where("level_bin = 0").groupBy("period", "variable").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
        summary.orderBy("period", "variable").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/summary")  # a few rows

    def manifest(self) -> dict:
        """What the store holds: version, configuration, commits, days, rows."""
        told = self.ledger().agg(F.count_distinct("commit").alias("commits"), F.count_distinct("d").alias("days"), F.sum("rows").alias("rows")).first()
        return {"version": SCHEMA_VERSION, "config": self.config, **told.asDict()}


def hourly(obs: DataFrame) -> DataFrame:
    """A row for each day, cell and hour of obs: its rows, and a state for each variable beside the others, so that observations are not repeated by variable."""
    return obs.groupBy("d", "slot", "cy", "cx", "h").agg(F.count("*").alias("rows"), *moments.wide_states(VARIABLES))


def daily_states(hours: DataFrame) -> DataFrame:
    """States by period (the decade and FULL), slot, level bin, cell and variable out of hourly(); a day's states merge over years by slot and hour first."""
    decade = calendar.decade_start(F.col("d"))
    named = hours.withColumn("decade", F.concat(decade.cast("string"), F.lit("-"), (decade + 9).cast("string")))
    long = moments.stacked(named, ["decade", "slot", "cy", "cx", "h"], VARIABLES)
    pooled = moments.merge_moments(long, ["decade", "slot", "cy", "cx", "h", "variable"])
    bins = F.array(F.lit(0), (1 + F.floor(F.col("h") / 3)).cast("int"), F.col("h") + 9)
    both = pooled.withColumns({"level_bin": F.explode(bins)}).withColumn("period", F.explode(F.array("decade", F.lit("FULL"))))
    out = moments.merge_moments(both, KEYS)
    return out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(STATES)))


def follows(runs: DataFrame) -> DataFrame:
    """runs(first, last) with ok: each begins where the one before ended; the reserved slot between 58 and 60 is no gap."""
    before = F.lag("last").over(Window.orderBy("first"))  # a row for each run of a climatology
    due = F.when(before == calendar.RESERVED - 1, calendar.RESERVED + 1).otherwise(before + 1)
    return runs.withColumn("ok", F.coalesce(F.col("first") == due, F.lit(True)))


def merge_runs(parts: Sequence[DataFrame]) -> DataFrame:
    """Results of runs over parts of the calendar, by slot; an error unless they are contiguous."""
    runs = None
    for part in parts:
        one = part.agg(F.min("slot").alias("first"), F.max("slot").alias("last"))
        runs = one if runs is None else runs.unionByName(one)
    if runs is None or not follows(runs).where("not ok").isEmpty():
        raise ValueError("runs are not contiguous")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
