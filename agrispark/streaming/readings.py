"""Streams of readings: alerts, latest state, rolling windows and silent nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from agrispark import schemas
from agrispark.operators.alerts import threshold_alerts
from agrispark.operators.cleanse import with_node_id
from agrispark.rules import crop_profile as cp
from agrispark.rules import limits
from agrispark.sources.telemetry import EVENT_READING_EXPRS, readings_from_events

WATERMARK = "10 minutes"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLICE_ROWS = 1_000_000  # readings of a micro-batch when a table is streamed in time order, about
SLICE_ROWS_PER_NODE = 64  # and no fewer than this for each node: every node of a micro-batch costs calls to its state
WINDOWS_PER_FRAME = 4_096  # windows that a hot node hands over at once


def reading_stream(spark: SparkSession, path: str, fmt: str = "json", max_files: int = 100) -> DataFrame:
    """Readings appended to a folder, in canonical shape. The files per trigger bound the rows of a micro-batch."""
    return spark.readStream.schema(schemas.TELEMETRY).format(fmt).option("maxFilesPerTrigger", max_files).load(path)


def kafka_readings(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Readings from a Kafka topic of JSON messages; needs the Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schemas.TELEMETRY).alias("r")).select("r.*")


def table_pattern(path: str) -> str:
    """A pattern that only the table's own path matches: a stream reads a file or a folder of part files through it,
    while a plain path must be a folder."""
    return f"{path[:-1]}[{path[-1]}]"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, a file or a folder of part files, as a stream of readings.

    Files come in no order of time: for stateless and order-free streams only. With a watermark, ``drain_in_order``.
    """
    events = spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", 100).parquet(table_pattern(f"{sf_dir}/events.parquet"))
    return events.selectExpr(*[e.format(STR="string") for e in EVENT_READING_EXPRS])


def deduplicated(readings: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Replayed readings removed, as long as they arrive within the watermark."""
    stamped = readings.withColumn("event_time", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["event_id"]).drop("event_time")


def alert_stream(readings: DataFrame) -> DataFrame:
    """Alerts on every new reading; stateless."""
    return threshold_alerts(with_node_id(readings))


def latest_stream(readings: DataFrame) -> DataFrame:
    """Latest reading per node, updated as readings arrive; partial aggregation keeps hot nodes cheap."""
    rest = [c for c in readings.columns if c != "node_id"]
    return with_node_id(readings).groupBy("node_id").agg(
        F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("r")
    ).select("node_id", "r.*")


_VALUES = T.ArrayType(T.ArrayType(T.DoubleType()))
WINDOW_OUTPUT = T.StructType([
    T.StructField("node_id", T.StringType()), T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()), T.StructField("window", _VALUES),
])
_PACKED = T.StructType([T.StructField("places", T.BinaryType()), T.StructField("values", T.BinaryType())])
_TIMES = T.StructType([T.StructField("micros", T.BinaryType())])
SILENCE_OUTPUT = T.StructType([
    T.StructField("node_id", T.StringType()), T.StructField("event", T.StringType()),
    T.StructField("at", T.TimestampType()), T.StructField("last_seen", T.TimestampType()),
])
_SEEN = T.StructType([T.StructField("micros", T.LongType()), T.StructField("silent", T.BooleanType())])


def _micros(stamps: pd.Series) -> list[int]:
    return stamps.astype("datetime64[us]").astype("int64").tolist()


def _wake(handle: StatefulProcessorHandle, at: int) -> None:
    """One timer a key, at the given millisecond; an earlier one that is set already stays."""
    timers = list(handle.listTimers())
    if timers and min(timers) <= at:
        return
    for timer in timers:
        handle.deleteTimer(timer)
    handle.registerTimer(at)


class RollingWindows(StatefulProcessor):
    """Readings wait in a list until the watermark passes them; a value keeps the last ``length - 1`` that were sent.

    A call to the state costs far more than a reading, so what a batch brings for a node is one packed entry of the list:
    places (microsecond, whether it has an id, id) and measures, as whole numbers and doubles in little-endian order.
    """

    def __init__(self, length: int, features: list[str]):
        self.length, self.features = length, features

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getValueState("sent", _PACKED)
        self.waiting = handle.getListState("waiting", _PACKED)

    def _unpacked(self, entries: list) -> tuple[np.ndarray, np.ndarray]:
        places = np.frombuffer(b"".join(bytes(e[0]) for e in entries), "<i8").reshape(-1, 3)
        return places, np.frombuffer(b"".join(bytes(e[1]) for e in entries), "<f8").reshape(-1, len(self.features))

    def _sent(self) -> tuple[np.ndarray, np.ndarray]:
        sent = self.sent.get()
        return self._unpacked([] if sent is None else [sent])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, first = self._sent()[0], None
        for batch in rows:
            ids = batch["event_id"]
            places = np.column_stack([_micros(batch["ts"]), ids.notna(), ids.fillna(0)]).astype("<i8")
            new = ~(np.isin(places[:, 2], known[known[:, 1] == 1, 2]) & (places[:, 1] == 1))
            if new.any():
                values = batch[self.features].to_numpy("<f8")
                values = np.where(np.isnan(values), 0.0, values)
                self.waiting.appendValue((places[new].tobytes(), values[new].tobytes()))
                least = int(places[new, 0].min()) // 1000
                first = least if first is None else min(first, least)
        if first is not None:
            _wake(self.handle, first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        places, values = self._unpacked(list(self.waiting.get()))
        order = np.lexsort((places[:, 2], places[:, 1], places[:, 0]))
        places, values = places[order], values[order]
        newest = np.append((places[1:] != places[:-1]).any(axis=1), True)[:len(places)]  # of one place, what came last
        places, values = places[newest], values[newest]
        n = int(np.searchsorted(places[:, 0] // 1000, passed, side="right"))
        sent = self._sent()
        known = len(sent[0])
        if n:
            merged = np.concatenate([sent[0], places[:n]]), np.concatenate([sent[1], values[:n]])
            last = max(0, known + n - max(self.length - 1, 1))
            self.sent.update((merged[0][last:].tobytes(), merged[1][last:].tobytes()))
            if n < len(places):
                self.waiting.put([(places[n:].tobytes(), values[n:].tobytes())])
            else:
                self.waiting.clear()
        if n < len(places):
            self.handle.registerTimer(max(int(places[n, 0]) // 1000, passed + 1))
        for start in range(max(self.length - 1, known), known + n, WINDOWS_PER_FRAME):
            end = min(start + WINDOWS_PER_FRAME, known + n)
            steps = merged[1][start - self.length + 1:end].tolist()
            told = merged[0][start:end]
            ids = told[:, 2] if told[:, 1].all() else pd.arrays.IntegerArray(told[:, 2].copy(), told[:, 1] == 0)
            yield pd.DataFrame({
                "node_id": key[0], "event_id": ids, "ts": told[:, 0].astype("datetime64[us]"),
                "window": [steps[i:i + self.length] for i in range(len(told))],
            })

    def close(self) -> None:
        pass


def _stateful(readings: DataFrame, watermark: str, processor: StatefulProcessor, output: T.StructType, *columns: str) -> DataFrame:
    """Readings by node through a processor with event-time timers; its state lives in RocksDB."""
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    slim = with_node_id(readings).select("node_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), *columns).where("ts IS NOT NULL")
    return slim.withWatermark("ts", watermark).groupBy("node_id").transformWithStateInPandas(processor, output, "append", "EventTime")


def rolling_windows(readings: DataFrame, watermark: str, length: int = limits.SUITABILITY_HISTORY,
                    features: list[str] = cp.FEATURES) -> DataFrame:
    """The last ``length`` readings of a node for every reading, in time order, as the batch windows give them.

    A reading waits until the watermark passes it, so readings that come late by no more than the watermark are in
    their place; each reading emits once, replayed ones too. State per node is the last length - 1 sent readings and
    those that wait. Readings later than the watermark are dropped by Spark and counted in the query's progress
    (``numRowsDroppedByWatermark``).
    """
    return _stateful(readings, watermark, RollingWindows(length, list(features)), WINDOW_OUTPUT, *features)


class Silence(StatefulProcessor):
    """Readings' times wait until the watermark passes them and are then gone through in order, so what is told does not
    hang on how they were dealt to batches. The times that a batch brings are one packed entry of a list."""

    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", _SEEN)
        self.waiting = handle.getListState("waiting", _TIMES)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = np.unique(np.concatenate([np.array(_micros(batch["ts"]), "<i8") for batch in rows]))
        if len(times):
            self.waiting.appendValue((times.tobytes(),))
            _wake(self.handle, int(times[0]) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        last, silent = self.seen.get() or (None, False)
        out = []
        stamp = lambda micros: pd.Timestamp(micros, unit="us")
        times = np.unique(np.frombuffer(b"".join(bytes(e[0]) for e in self.waiting.get()), "<i8"))
        n = int(np.searchsorted(times // 1000, passed, side="right"))
        ready, following = times[:n].tolist(), times[n:n + 1].tolist()
        for micros in ready:
            if last is not None and micros > last + self.gap:
                if not silent:
                    out.append((key[0], "silent", stamp(last + self.gap), stamp(last)))
                out.append((key[0], "back", stamp(micros), stamp(last)))
            last, silent = max(micros, last or micros), False
        if n and following:
            self.waiting.put([(times[n:].tobytes(),)])
        elif n:
            self.waiting.clear()
        if last is not None and not silent and (last + self.gap) // 1000 <= passed and not (following and following[0] <= last + self.gap):
            out.append((key[0], "silent", stamp(last + self.gap), stamp(last)))
            silent = True
        if last is not None:
            self.seen.update((last, silent))
        ahead = [m // 1000 for m in following] + ([] if silent or last is None else [(last + self.gap) // 1000])
        if ahead:
            self.handle.registerTimer(max(min(ahead), passed + 1))
        if out:
            yield pd.DataFrame(out, columns=SILENCE_OUTPUT.fieldNames())

    def close(self) -> None:
        pass


def silence_stream(readings: DataFrame, gap_seconds: int, watermark: str = WATERMARK) -> DataFrame:
    """(node_id, event, at, last_seen): "silent" when a node has not been heard for longer than the gap, and "back" with
    its next reading, each once the watermark has passed it."""
    return _stateful(readings, watermark, Silence(gap_seconds), SILENCE_OUTPUT)


def run_to_end(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process everything available into a parquet folder next to its checkpoint, and read it back."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start(f"{path}/data")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Files of a folder into another one of the same file system, without copying them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    old, new = hadoop.Path(source), hadoop.Path(target)
    files = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(new)
    for status in files.listStatus(old):
        if status.getPath().getName().startswith("part-") and not files.rename(status.getPath(), hadoop.Path(new, f"{old.getName()}-{status.getPath().getName()}")):
            raise OSError(f"{status.getPath()} could not be moved to {target}")


def drain_in_order(
    spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame], path: str, slice_rows: int | None = None
) -> DataFrame:
    """The result of the stream ``build(readings)`` over the whole events table, whatever its files and their order.

    The table is written once in slices of time, about ``slice_rows`` each (``SLICE_ROWS``, more for very many nodes). One query runs on; slices are
    moved into its folder one after the other, when it has gone through those before, so no reading is ever behind the
    watermark. If Spark drops one nevertheless, the job fails.
    """
    readings = readings_from_events(spark, sf_dir)
    total = readings.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("node_id").alias("nodes")).first()
    slices = max(1, -(-total["rows"] // (slice_rows or max(SLICE_ROWS, total["nodes"] * SLICE_ROWS_PER_NODE))))
    ordered, arrived = f"{path}/ordered", f"{path}/arrived"
    placed = readings.repartitionByRange(slices, "ts").withColumn("slice", F.spark_partition_id())
    placed.write.partitionBy("slice").parquet(ordered)
    filled = spark.read.schema(placed.schema).parquet(ordered).select("slice").distinct().collect()
    readings.limit(0).write.parquet(arrived)
    stream = build(spark.readStream.schema(readings.schema).parquet(arrived))
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint").start(f"{path}/data")
    seen = -1
    try:
        for k in sorted(r["slice"] for r in filled):
            _move(spark, f"{ordered}/slice={k}", arrived)
            query.processAllAvailable()
            news = [p for p in query.recentProgress if p.batchId > seen]
            seen = max([seen, *(p.batchId for p in news)])
            if late := sum(s.numRowsDroppedByWatermark for p in news for s in p.stateOperators):
                raise RuntimeError(f"{late} readings of slice {k} came behind the watermark")
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def run_latest_to_end(stream: DataFrame, path: str) -> DataFrame:
    """Drain an update-mode state stream and read the newest row per node from its state store: no rows are written."""
    query = (
        stream.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return latest_from_state(stream.sparkSession, f"{path}/checkpoint")


def latest_from_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The latest reading of every node in the state of a ``latest_stream``, running or stopped."""
    state = spark.read.format("statestore").load(checkpoint)
    reading = state.schema["value"].dataType.names[0]  # the reading that has the greatest time so far, then that time
    return state.select(F.col("key")[state.schema["key"].dataType.names[0]].alias("node_id"), F.col("value")[reading].alias("r")).select("node_id", "r.*")
