"""Incremental jobs: new files or rows in, cleaned chunks appended or keyed tables updated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import sanitize
from ..operators.corpus import chunk_records
from ..operators.merge import keep_last


def stream_table(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 16, kind: str = "parquet") -> DataFrame:
    """``path``: a file or a folder; it is read as a pattern, which may name either."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(f"{path}*")


def run_available(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Handles all there is now, batch by batch, and stops; a later run goes on from the checkpoint."""
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ingest_corpus(stream: DataFrame, out: str, checkpoint: str, size: int = 2000, least: int = 100) -> None:
    """``stream(source_id, doc_id, text)`` -> cleaned chunks. Each batch has a folder of its own, so a
    batch that is run again replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        cleaned = rows.withColumn("text", sanitize(F.col("text")))
        chunk_records(cleaned, F.col("doc_id"), size, least).drop("text").write.mode("overwrite").parquet(f"{out}/batch={number}")

    run_available(stream, batch, checkpoint)


def ingest_upserts(stream: DataFrame, log: str, checkpoint: str, key: str, seq: str) -> None:
    """Appends each batch's last row per key to a log of batches; ``current_rows`` reads the table.

    No state is held between batches, and a batch that is run again replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        keep_last(rows, [key], [seq]).write.mode("overwrite").parquet(f"{log}/batch={number}")

    run_available(stream, batch, checkpoint)


def current_rows(spark: SparkSession, log: str, key: str, seq: str) -> DataFrame:
    return keep_last(spark.read.parquet(log).drop("batch"), [key], [seq])


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_seen(stream: DataFrame, key: str | list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen before. A key is held as state until the watermark, ``delay`` behind the
    newest event time, has passed its row by ``delay``; later it counts as new again. Rows behind the
    watermark are too late and dropped, and so are those without an event time."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key] if isinstance(key, str) else key)


class Runs:
    """Output and checkpoint of a stateful job, in generations: a resumed run goes on with the newest one, a
    fresh run begins another, while the old output stays readable."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _generations(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removeprefix("run-")) for n in names if n.startswith("run-"))

    def current(self, fresh: bool = False) -> str:
        known = self._generations()
        newest = known[-1] if known else 0
        return f"{self.path}/run-{newest + 1 if fresh or not known else newest}"

    def read(self, generation: int | None = None) -> DataFrame:
        """Rows of the newest or a given generation; files of batches that did not end are not read."""
        return self.spark.read.parquet(f"{self.current() if generation is None else f'{self.path}/run-{generation}'}/out")


def keep_first_seen(stream: DataFrame, runs: Runs, key: str | list[str], time: str, delay: str = "1 hour", fresh: bool = False) -> StreamingQuery:
    """Appends the first row of each key to the output of ``runs``, for all there is now, and stops. State
    lives in RocksDB on the executors and in the checkpoint, so it may be larger than memory, and a run
    that was stopped goes on where it was: no row is given twice."""
    spark, where = stream.sparkSession, runs.current(fresh)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        writer = first_seen(stream, key, time, delay).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/checkpoint")
        query = writer.outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return query
