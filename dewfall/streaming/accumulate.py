"""Incremental accumulation as a stream: each micro-batch of observations is committed to a state store once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dewfall.functions import calendar
from dewfall.functions.physics import with_moisture
from dewfall.sources.states import StateStore


def committed(store: StateStore, stream: str = "stream") -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls. A batch is a source of its own: a day that comes in several batches adds up, and a batch that is replayed is in the ledger already and changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        moist = with_moisture(batch).withColumn("slot", calendar.slot(F.col("d")))
        store.commit(moist, f"{stream}-{number:08d}", source=f"{stream}/{number}")

    return run


def accumulate(obs: DataFrame, store: StateStore, checkpoint: str, stream: str = "stream") -> StreamingQuery:
    """Start a stream of obs(d, h, cy, cx, t, td, p) into the store, all that is there and then stop.

    `stream` names the checkpoint's batches in the store: streams with checkpoints of their own need different names."""
    return obs.writeStream.foreachBatch(committed(store, stream)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
