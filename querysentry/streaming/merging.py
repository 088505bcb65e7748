"""Traces from streams: one statement's invocations are kept as keyed state until it is complete."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from querysentry.operators.traces import merge_traces
from querysentry.session import cut_lineage, shared_path

#: A state store that keeps the pieces on disk and sends only changes to the checkpoint.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What a key's state holds for each batch, and the time of an invocation that has none.
STATE = "at array<bigint>, row array<string>"
NEVER = -(1 << 62)
GIVEN = "_at bigint, _row string, _start bigint, _end bigint, _late boolean"
#: Times in rows keep their microseconds.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def runs(times: list[int], gap: int) -> list[tuple[int, int]]:
    """Borders (from, to) of the runs of ascending times whose pauses are shorter than ``gap``."""
    starts = [k for k in range(len(times)) if not k or times[k] - times[k - 1] >= gap]
    return list(zip(starts, [*starts[1:], len(times)]))


class Statements(StatefulProcessor):
    """Keeps a key's invocations; a timer gives those out whose statement has ended.

    An invocation is its time ``_at`` (microseconds, ``NEVER`` if it has none) and the text
    ``_row`` of all its columns. What comes of a key in a batch is one entry of its state.
    Rows come out with ``_start`` and ``_end`` of their statement, or ``_late`` if their
    statement was over when they came and none that is open takes them.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", STATE)
        self.due = handle.getValueState("due", "at long")

    def _call_at(self, micros: int) -> None:
        """See to it that a timer fires when the watermark has passed this time."""
        now = self.due.get() if self.due.exists() else None
        at = -(-micros // 1000)
        if now is None or now[0] > at:
            if now is not None:
                self.handle.deleteTimer(now[0])
            self.handle.registerTimer(at)
            self.due.update((at,))

    def _kept(self) -> tuple[list[int], list[str]]:
        times, rows = [], []
        if self.pieces.exists():
            for at, row in self.pieces.get():
                times += list(at)
                rows += list(row)
        return times, rows

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        # The columns come in order, under names of their own.
        new = pd.concat([frame.iloc[:, -2:].set_axis(["_at", "_row"], axis=1) for frame in rows], ignore_index=True)
        taken = (new["_at"] != NEVER) & (new["_at"] + self.gap > passed)
        if not taken.all():
            # Only such rows need a look at what is open.
            known = self._kept()[0]
            times = sorted({*known, *(t for t in new["_at"].tolist() if t != NEVER)})
            still = set(known)
            for a, b in runs(times, self.gap):
                if times[b - 1] + self.gap > passed or still.intersection(times[a:b]):
                    still.update(times[a:b])
            taken = new["_at"].isin(still)
            late = new[~taken]
            yield late.assign(_start=NEVER, _end=NEVER, _late=True)
            new = new[taken]
        if len(new):
            self.pieces.appendValue((new["_at"].tolist(), new["_row"].tolist()))
            self._call_at(int(new["_at"].min()) + self.gap)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        times, rows = self._kept()
        order = sorted(range(len(times)), key=times.__getitem__)
        times, rows = [times[i] for i in order], [rows[i] for i in order]
        left, start, end = [], [], []
        for a, b in runs(times, self.gap):
            if times[b - 1] + self.gap <= passed:
                start += [times[a]] * (b - a)
                end += [times[b - 1] + self.gap] * (b - a)
            else:
                left += range(a, b)
                start += [NEVER] * (b - a)
                end += [NEVER] * (b - a)
        given = pd.DataFrame({"_at": times, "_row": rows, "_start": start, "_end": end, "_late": False})
        given = given[given["_start"] != NEVER]
        if len(given):
            yield given
        self.due.clear()
        if left:
            first = [times[i] for i in left]
            if len(given):
                self.pieces.put([(first, [rows[i] for i in left])])
            self._call_at(first[runs(first, self.gap)[0][1] - 1] + self.gap)
        else:
            self.pieces.clear()


def _micros(spark: SparkSession, interval: str) -> int:
    return spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {interval}"))).first()[0]


def _merged(pieces: DataFrame, key: str, order: str) -> DataFrame:
    """The batch merge of pieces that bear their statement's ``_start`` and ``_end``."""
    named = pieces.withColumn(
        "_session", F.struct(key, F.timestamp_micros("_start").alias("start"), F.timestamp_micros("_end").alias("end"))
    )
    merged = merge_traces(named, "_session", order)
    return merged.select("_session.*", *[c for c in merged.columns if c != "_session"])


def _with_sessions(pieces: DataFrame, key: str, gap: int) -> DataFrame:
    """``_start`` and ``_end`` of each row's statement, among the given rows."""
    by_time = W.partitionBy(key).orderBy("_at")
    fresh = F.when(F.col("_at") - F.lag("_at").over(by_time) < gap, 0).otherwise(1)
    run = F.sum("_fresh").over(by_time.rowsBetween(W.unboundedPreceding, 0))
    numbered = pieces.withColumn("_fresh", fresh).withColumn("_run", run)
    own = W.partitionBy(key, "_run")
    return numbered.withColumn("_start", F.min("_at").over(own)).withColumn("_end", F.max("_at").over(own) + gap).drop("_fresh", "_run")


def stream_merge_invocations(
    stream: DataFrame,
    folder: str,
    key: str = "stmt_id",
    order: str = "seq",
    event_time: str = "ts",
    delay: str = "10 minutes",
    gap: str = "1 hour",
    flush: bool = False,
) -> DataFrame:
    """Merge what has arrived; one trace per statement, whatever hour borders it crosses.

    A statement is complete when the watermark is ``gap`` past its last invocation. Until
    then its invocations are state of its key, in a store on disk; they are read once when
    they come and given out once when the statement is complete, to the batch merge. Calls
    with the same folder continue where the last one stopped. ``flush`` merges the
    statements still open too, as they are now; they stay open.

    An invocation that comes after its statement was merged, or bears no time, is a row of
    ``late_invocations``; a key that was silent for ``gap`` starts another statement. A
    batch that is repeated after a failure overwrites its own output. One statement's
    invocations meet in a task, as their text is one value.
    """
    spark = stream.sparkSession
    wide = _micros(spark, gap)
    rest = T.StructType([f for f in stream.schema.fields if f.name != event_time])
    # The watermark is taken here. The time goes on as a number, so that the engine leaves it to
    # the processor to say what is late. A null key is a key too.
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("_key")
    timed = stream.withWatermark(event_time, delay).select(
        name, F.coalesce(F.unix_micros(event_time), F.lit(NEVER)).alias("_at"), F.to_json(F.struct(*rest.names), _JSON).alias("_row")
    )
    result = timed.groupBy("_key").transformWithStateInPandas(Statements(wide), GIVEN, "Append", "EventTime")

    def opened(pieces: DataFrame) -> DataFrame:
        """The columns of the invocations."""
        read = pieces.withColumn("_row", F.from_json("_row", rest, _JSON))
        return read.select("_row.*", *[c for c in pieces.columns if c != "_row"])

    when = F.when(F.col("_at") != NEVER, F.timestamp_micros("_at"))
    given_back = [when.alias(c) if c == event_time else F.col(c) for c in stream.columns]
    traces, late, checkpoint = (f"{folder}/{part}" for part in ("traces", "late", "checkpoint"))

    def write(batch: DataFrame, number: int) -> None:
        # Computed once: the state must not be asked twice for a batch.
        pieces = opened(cut_lineage(batch))
        _merged(pieces.filter("NOT _late"), key, order).write.mode("overwrite").parquet(f"{traces}/batch={number}")
        pieces.filter("_late").select(*given_back).write.mode("overwrite").parquet(f"{late}/batch={number}")

    # Written before the first batch, so that the folders are readable whatever is complete.
    write(spark.createDataFrame([], GIVEN), -1)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        query = (
            result.writeStream.outputMode("append").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    done = spark.read.parquet(traces).drop("batch")
    if not flush:
        return done
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "pieces").option("flattenCollectionTypes", True)
    pieces = state.load().select(F.inline(F.arrays_zip(F.col("list_element.at").alias("_at"), F.col("list_element.row").alias("_row"))))
    still_open = _with_sessions(opened(pieces.toDF("_at", "_row")), key, wide)
    path = shared_path(spark, "open-traces")
    _merged(still_open, key, order).write.parquet(path)
    return done.unionByName(spark.read.schema(done.schema).parquet(path))


def late_invocations(spark: SparkSession, folder: str) -> DataFrame:
    """The invocations that came after their statement was merged, or bore no time."""
    return spark.read.parquet(f"{folder}/late").drop("batch")
