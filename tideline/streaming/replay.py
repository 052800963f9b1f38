"""Stored rows through a stream: everything that is there, in an order of its own if the state needs one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import fresh_path
from tideline.streaming.conversation import ROCKSDB
from tideline.streaming.inbound import file_stream

ROWS_PER_BATCH = 2_000_000
ROW_GROUP = 4 << 20  # bytes of a file's row groups, so that several tasks read the one file of a batch
FIRST_TIME = 1_000_000_000_000  # of the first file, in milliseconds; the others follow a second apart


def run_to_end(spark, stream: DataFrame, write=None, mode: str = "append", path: str | None = None, progress: str | None = None) -> str:
    """Processes everything available and returns the path of the written rows; fails if a row came too late to count."""
    path = path or fresh_path(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", progress or fresh_path(spark, "progress")).trigger(availableNow=True)
    writer = writer.foreachBatch(lambda df, n: write(df, n, path)) if write else writer.format("parquet").option("path", path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", True)  # a batch stores what it changed, not all state
    done = writer.start()
    done.awaitTermination()
    late = sum(op.numRowsDroppedByWatermark for p in done.recentProgress for op in p.stateOperators)
    if late:
        raise RuntimeError(f"{late} rows came later than the watermark allows; order the source or raise the delay")
    return path


def _in_time_order(spark, folder: str, start: int = 0) -> int:
    """Gives the files of ``folder`` times that follow their names, from number ``start`` on; the number after the last."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*")
    system = pattern.getFileSystem(conf)
    files = sorted((f.getPath() for f in system.globStatus(pattern)), key=lambda f: f.getName())
    for at, file in enumerate(files, start):
        system.setTimes(file, FIRST_TIME + 1000 * at, -1)
        if system.getFileStatus(file).getModificationTime() != FIRST_TIME + 1000 * at:
            raise RuntimeError(f"files below {folder} keep no time that is set; a replay needs a store that does")
    return start + len(files)


def ordered_stream(spark, df: DataFrame, by: str, rows: int = ROWS_PER_BATCH, last: DataFrame | None = None) -> DataFrame:
    """``df`` as a stream whose batches follow ``by``: ranges of about ``rows`` rows, one file and one batch each; ``last`` comes after all.

    A stream over files takes them by their times, so each range is a file and the times follow the ranges. Rows of one
    value of ``by`` share a batch.
    """
    folder = fresh_path(spark, "log")
    ranges = max(1, -(-df.count() // rows))
    df.repartitionByRange(ranges, by).sortWithinPartitions(by).write.option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/rows")
    done = _in_time_order(spark, f"{folder}/rows")
    if last is not None:
        last.coalesce(1).write.parquet(f"{folder}/last")
        _in_time_order(spark, f"{folder}/last", done)
    return file_stream(spark, f"{folder}/*", df.schema, max_files=1)
