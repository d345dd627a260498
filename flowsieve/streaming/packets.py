"""Structured Streaming: packet source and windowed features.

Streams are read with an explicit schema; event time is a ``timestamp``
(``timestamp_ntz`` cannot carry a watermark).  Windows close by watermark, so
late packets beyond it are dropped -- the tool itself used arrival time.  How
late a packet may come is the caller's choice.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import MIN_WINDOW_PACKETS
from ..operators import windows

_STATE = "spark.sql.streaming.stateStore"
_IN_HEAP = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
#: State of open windows on the executors' disks, with so many MB in memory for all partitions of an executor.
STATE_ON_DISK = {f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
                 f"{_STATE}.rocksdb.boundedMemoryUsage": "true", f"{_STATE}.rocksdb.maxMemoryUsageMB": "128"}


@contextmanager
def state_on_disk(spark: SparkSession):
    """Streams started here keep their state out of the executors' heap, unless the session names a store of its own."""
    if spark.conf.get(f"{_STATE}.providerClass", _IN_HEAP) != _IN_HEAP:
        yield
        return
    before = {k: spark.conf.get(k, None) for k in STATE_ON_DISK}
    for k, v in STATE_ON_DISK.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_stream(spark: SparkSession, folder: str, glob: str, schema, max_files: int | None = None) -> DataFrame:
    """Parquet files arriving in ``folder`` as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def flow_windows_stream(packets: DataFrame, width: str, delay: str, keys: list[str] | None = None,
                        min_packets: int = MIN_WINDOW_PACKETS, with_event: bool = False) -> DataFrame:
    """The batch window features over a stream; append mode emits windows once ``delay`` has passed after them."""
    return windows.flow_window_features(packets.withWatermark("ts", delay), width, keys, min_packets, with_event=with_event)
