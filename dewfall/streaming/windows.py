"""Event-time windows as a stream, with rows that come too late kept aside.

A row is late if its time is not after the engine's watermark when its batch runs: the newest time of earlier batches less the delay. Late rows
go to a quarantine table, all others into windows of three hours, of a day, and of five days by the day; a window is
given out once the watermark passes its end, so its numbers never change. Late rows and windows come out of the same operator, which
alone knows the watermark that a batch ran under, so every row is counted in one of them.

State is small: a partial sum for each open three-hour bin and for each day that a window still needs. An observation is added once; its day's sum serves the
five windows over it. A key's rows are dealt over SALTS groups, so that one key may hold most rows; the
parts of a window are added up when it is read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Groups that a key's rows are dealt over.
SALTS = 8
#: Widths in microseconds; windows of SPAN days begin every day.
BIN, DAY, SPAN = 3 * 3_600_000_000, 86_400_000_000, 5
OUT = "kind string, key string, start long, n long, total double, event_id long, at long, value double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Stands for a time that is null: before any watermark.
NEVER = -(1 << 62)


class Windows(StatefulProcessor):
    """Sums of one salted key. Times are microseconds since 1970; bins and days begin at whole multiples."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bins = handle.getMapState("bins", "start long", "n long, total double")
        self.days = handle.getMapState("days", "start long", "n long, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        timers: set[int] = set()
        for part in rows:
            late = (part["at"] <= mark) | (part["at"] == NEVER)
            if late.any():
                out = part[late]
                yield _table(["late"] * len(out), out["key"], event_id=out["event_id"], at=out["at"].where(out["at"] != NEVER), value=out["value"])
            fresh = part[~late]
            for state, width, ends in ((self.bins, BIN, (1,)), (self.days, DAY, range(1, SPAN + 1))):
                sums = fresh.groupby(fresh["at"] // width * width)["value"].agg(["size", "sum"])
                for start, n, total in sums.itertuples():
                    held = state.getValue((int(start),)) if state.containsKey((int(start),)) else (0, 0.0)
                    state.updateValue((int(start),), (held[0] + int(n), held[1] + float(total)))
                    timers.update((int(start) + k * width) // 1000 for k in ends)
        if timers:
            known = set(self.handle.listTimers())
            for at in sorted(timers - known):
                self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        made = []
        if self.bins.containsKey((at - BIN,)):
            made.append(("3 hours", at - BIN, *self.bins.getValue((at - BIN,))))
            self.bins.removeKey((at - BIN,))
        if at % DAY == 0:
            held = [(s, self.days.getValue((s,))) for s in range(at - SPAN * DAY, at, DAY) if self.days.containsKey((s,))]
            made += [("1 day", s, *v) for s, v in held if s == at - DAY]
            if held:
                made.append(("5 days", at - SPAN * DAY, sum(v[0] for _, v in held), sum(v[1] for _, v in held)))
            if held and held[0][0] == at - SPAN * DAY:
                self.days.removeKey((held[0][0],))  # its last window is out
        if made:
            kind, start, n, total = zip(*made, strict=True)
            yield _table(kind, [key[0]] * len(made), start=start, n=n, total=total)

    def close(self) -> None:
        pass


def _table(kind, key, **columns) -> pd.DataFrame:
    """Rows of OUT; what is not given is null."""
    out = pd.DataFrame({"kind": list(kind), "key": list(key)})
    for name, dtype in (("start", "Int64"), ("n", "Int64"), ("total", "Float64"), ("event_id", "Int64"), ("at", "Int64"), ("value", "Float64")):
        out[name] = pd.Series(list(columns[name]) if name in columns else [None] * len(out), dtype=dtype)
    return out


def windowed(events: DataFrame, delay: str) -> DataFrame:
    """The stream of closed windows' parts and late rows of a stream of events(event_id, key, ts, value). A row without a time goes as late; one without a value counts in n alone."""
    # The processor gets the time as a number: the engine drops rows below the watermark only where the marked column goes on.
    rows = events.withWatermark("ts", delay).select(
        "key", "event_id", F.col("value").cast("double").alias("value"), F.pmod(F.xxhash64("event_id"), F.lit(SALTS)).cast("int").alias("salt"), F.coalesce(F.expr("unix_micros(ts)"), F.lit(NEVER)).alias("at")
    )
    return rows.groupBy("key", "salt").transformWithStateInPandas(Windows(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def run_windows(events: DataFrame, folder: str, delay: str = "2 days") -> StreamingQuery:
    """Start windowed() over all that is there, then stop. A batch's windows and late rows go below folder/out under its number, so one that is replayed replaces itself."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/out/batch={number}")

    return windowed(events, delay).writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def _given_out(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(OUT + ", batch long").option("basePath", f"{folder}/out").parquet(f"{folder}/out")


def closed_windows(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, key, start, n, total): the windows given out so far, their parts added up."""
    parts = _given_out(spark, folder).where("kind <> 'late'").groupBy("kind", "key", "start").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return parts.withColumn("start", F.timestamp_micros("start"))


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, key, ts, value, batch): the rows that came too late, and the batch that they came in."""
    return _given_out(spark, folder).where("kind = 'late'").select("event_id", "key", F.timestamp_micros("at").alias("ts"), "value", "batch")
