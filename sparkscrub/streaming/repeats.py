"""Repeated rows and repeated ids of a stream (DET-2, DET-9), and dropping duplicates on a stream (GUI-11).

A key remembers the smallest row id it has been seen with. Of two ids that meet, the larger one is a repeat: it is given out and the smaller
one stays. Whatever the order in which files arrive, the rows given out in the end are those of the batch detectors: all but the first of
each key. Every task first compares the ids of its own chunk, so that a key that fills a third of the stream sends one candidate per task
and chunk to its state; ids that are repeats for certain pass by under salted keys and touch no state.

Keys live in the query's checkpoint and survive a restart. `keep` bounds them: a timer forgets a key that has not been seen for so many
seconds, after which its next row counts as first again; without it keys are kept for good, as the batch detectors do."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import is_blank
from ..operators.rows import q

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys that a task compares before it sends its candidates on; salts that certain repeats are dealt over.
LOCAL_KEYS, SALTS = 100_000, 512
WHOLE_ROW = "(fila completa)"
_CANDIDATES = "grupo string, clave string, columna string, fila long, seguro boolean"


def row_key(df: DataFrame, columns: list[str]) -> Column:
    """A digest of the named columns; equal where Spark's grouping finds the rows equal (NULL equals NULL, -0.0 equals 0.0)."""
    parts = [(q(c) + F.lit(0.0)).alias(c) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else q(c) for c in columns]
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def _in_chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The smallest id of each key of a chunk as candidate, all others as certain repeats."""

    def certain(columns: list, ids: list) -> pd.DataFrame:
        return pd.DataFrame({"grupo": "", "clave": [str(i % SALTS) for i in ids], "columna": columns, "fila": ids, "seguro": True})

    def candidates() -> pd.DataFrame:
        return pd.DataFrame([(c, k, c, i, False) for (c, k), i in best.items()], columns=["grupo", "clave", "columna", "fila", "seguro"])

    best: dict[tuple[str, str], int] = {}
    for frame in frames:
        columns, ids = [], []
        for column, key, row in zip(frame["columna"], frame["clave"], frame["fila"]):
            known = best.get((column, key))
            if known is None:
                best[column, key] = row
                continue
            best[column, key] = min(known, row)
            columns.append(column)
            ids.append(max(known, row))
        if ids:
            yield certain(columns, ids)
        if len(best) > LOCAL_KEYS:
            yield candidates()
            best = {}
    if best:
        yield candidates()


class FirstSeen(StatefulProcessor):
    """State of a key: its smallest row id so far. Gives out every larger one."""

    def __init__(self, keep: float | None = None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("primera", "fila long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        group, _ = key
        if not group:  # certain repeats
            for frame in rows:
                yield frame[["columna", "fila"]]
            return
        known = self.first.get()[0] if self.first.exists() else None
        start, repeats = known, []
        for frame in rows:
            for row in map(int, frame["fila"]):
                if known is None:
                    known = row
                elif row != known:
                    repeats.append(max(known, row))
                    known = min(known, row)
        if known != start:
            self.first.update((known,))
        if self.keep is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.keep * 1000))
        if repeats:
            yield pd.DataFrame({"columna": group, "fila": repeats})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        return iter([])

    def close(self) -> None:
        pass


def _repeats(cells: DataFrame, keep: float | None) -> DataFrame:
    """(columna, fila) of the repeats among (columna, clave, fila)."""
    narrow = cells.mapInPandas(_in_chunks, _CANDIDATES)
    return narrow.groupBy("grupo", "clave").transformWithStateInPandas(
        FirstSeen(keep), "columna string, fila long", "append", "none" if keep is None else "processingTime")


def repeated_rows(stream: DataFrame, keys: list[str], row_id: str, keep: float | None = None) -> DataFrame:
    """DET-2 on a stream: (columna, fila) of every row whose key has another row with a smaller id."""
    return _repeats(stream.select(F.lit(WHOLE_ROW).alias("columna"), row_key(stream, keys).alias("clave"), q(row_id).cast("long").alias("fila")), keep)


def repeated_cells(stream: DataFrame, columns: list[str], row_id: str, keep: float | None = None) -> DataFrame:
    """DET-9 on a stream: (columna, fila) of every cell that repeats a non-blank value of its column."""
    cells = F.array(*[F.struct(F.lit(c).alias("columna"), F.when(~is_blank(q(c)), q(c).cast("string")).alias("clave")) for c in columns])
    long = stream.select(q(row_id).cast("long").alias("fila"), F.explode(cells).alias("x")).select("x.columna", "x.clave", "fila")
    return _repeats(long.filter("clave is not null"), keep)


def _seen_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set = set()
    for batch in batches:
        fresh = []
        for digest in batch["__clave"].to_pylist():
            fresh.append(digest not in seen)
            seen.add(digest)
        if len(seen) > LOCAL_KEYS:
            seen = set()
        kept = batch.filter(pa.array(fresh))
        if kept.num_rows:
            yield kept.select(kept.schema.names[:-1])


def without_duplicates(stream: DataFrame) -> DataFrame:
    """GUI-11 on a stream: one of each group of equal rows. Repeats inside a task go first; Spark's own keyed state drops the rest."""
    once = stream.withColumn("__clave", row_key(stream, stream.columns)).mapInArrow(_seen_in_task, stream.schema)
    return once.dropDuplicates()


def start(findings: DataFrame, target: str, checkpoint: str, timers: bool = False) -> StreamingQuery:
    """Append the findings of a stream to Parquet files; the keyed state needs Spark's RocksDB store, which is set for this query alone.

    The query ends when all that has arrived is done. With timers it runs on until it is stopped: they need a clock that goes on."""
    conf = findings.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        writer = findings.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(processingTime="1 second") if timers else writer.trigger(availableNow=True)).start(target)
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)


def find_repeats(spark: SparkSession, source: str, schema: T.StructType, columns: list[str], row_id: str, target: str, checkpoint: str,
                 whole_rows: bool = False, keep: float | None = None, files_per_trigger: int = 1000) -> StreamingQuery:
    """Repeats among the Parquet files that arrive below `source`: of whole rows (all of `columns` equal) or of each column's values."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return start((repeated_rows if whole_rows else repeated_cells)(stream, columns, row_id, keep), target, checkpoint, keep is not None)
