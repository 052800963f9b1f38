"""Sinks: split-partitioned tables, good and bad records, sorted corpora."""

from __future__ import annotations

import hashlib
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS_ORDER = ("split", "label", "group", "source_id", "text")


def write_split_partitioned(df: DataFrame, path: str, by: str = "split") -> DataFrame:
    """Writes one folder per split and returns the row counts per split and label.

    The counts are read back from what was written, so they describe the output.
    """
    df.write.mode("overwrite").partitionBy(by).parquet(path)
    return split_counts(df.sparkSession.read.parquet(path), by)


def split_counts(df: DataFrame, by: str = "split") -> DataFrame:
    return df.groupBy(by, "label").agg(F.count("*").alias("n"))


class BatchTable:
    """A table made of named batches, each of which counts once, for ``foreachBatch`` and stored data alike.

    A commit first writes the rows to a folder of its own, then takes the batch's name by a rename that fails if
    the name is taken. Readers follow the names, so rows of an attempt that was killed, or that lost against another one of the
    same batch, are never seen. A name must tell runs apart, as batch numbers of a stream start anew with a new checkpoint.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, by: tuple[str, ...] = ()):
        self.spark, self.path, self.by = spark, path, by
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _name(self, batch: str):
        """Where the manifest keeps ``batch``: any text may be a name, so the file is called by its hash."""
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/{hashlib.sha256(batch.encode()).hexdigest()}")

    def _take(self, attempt: str, batch: str) -> bool:
        """Whether ``batch`` is now the name of ``attempt``; false if it names another one."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self.spark.sparkContext._jsc.hadoopConfiguration())
        draft, name = fs.Path(f"{self.path}/drafts/{attempt}"), self._name(batch)
        option = getattr(fs, "Options$Rename")
        never_replace = self.spark.sparkContext._gateway.new_array(option, 1)
        never_replace[0] = option.valueOf("NONE")
        system = draft.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(name.getParent())
        out = system.create(draft)
        out.write(bytearray(f"{attempt} {batch}".encode()))
        out.close()
        try:
            context.rename(draft, name, never_replace)
        except Py4JJavaError as failed:
            if "FileAlreadyExistsException" not in failed.java_exception.getClass().getName():
                raise
            system.delete(draft, False)
            return False
        return True

    def committed(self) -> DataFrame:
        """(batch, attempt) of the batches that count."""
        names = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not names.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(names):
            return self.spark.createDataFrame([], "batch string, attempt string")
        found = self.spark.read.text(f"{self.path}/manifest", wholetext=True)
        return found.select(F.substring("value", 34, 1 << 30).alias("batch"), F.substring("value", 1, 32).alias("attempt"))

    def commit(self, df: DataFrame, batch: str) -> bool:
        """Adds ``df`` as ``batch``; false, and nothing added, if that batch is there."""
        known = self._name(batch)
        if known.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(known):
            return False
        attempt = uuid.uuid4().hex
        df.select(self.schema.names).write.partitionBy(*self.by).parquet(f"{self.path}/attempts/attempt={attempt}")
        return self._take(attempt, batch)

    def read(self) -> DataFrame:
        """The rows of all batches; the driver holds one short name for each batch."""
        folders = [f"{self.path}/attempts/attempt={r.attempt}" for r in self.committed().select("attempt").collect()]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        inside = [F.col(c) for c in self.schema.names]
        wide = T.StructType([*self.schema.fields, T.StructField("attempt", T.StringType())])
        return self.spark.read.schema(wide).option("basePath", f"{self.path}/attempts").parquet(*folders).select(*inside)


GOOD, BAD = "good", "bad"


def good_bad_table(spark: SparkSession, path: str, schema: T.StructType) -> BatchTable:
    """A table for ``write_good_bad``: the columns of the records, ``error`` and ``sink``."""
    return BatchTable(spark, path, T.StructType([*schema.fields, T.StructField("error", T.StringType()), T.StructField("sink", T.StringType())]), ("sink",))


def write_good_bad(df: DataFrame, reason: Column, to: BatchTable, batch: str) -> bool:
    """Records without a reason to the folder ``good``, the others with their reason to ``bad``, in one job that computes the reason once.

    Both become visible together; a batch that is there already changes nothing (false).
    """
    marked = df.withColumn("error", reason)
    return to.commit(marked.withColumn("sink", F.when(F.col("error").isNull(), GOOD).otherwise(BAD)), batch)


def write_sorted_corpus(df: DataFrame, path: str, order=CORPUS_ORDER, fmt: str = "json") -> None:
    """A total order over many files: range partitions, each sorted; file names follow the order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    out.write.mode("overwrite").format(fmt).save(path)


def erase_phone(df: DataFrame, phones: DataFrame, key: str = "phone") -> DataFrame:
    """The table without the rows of the given senders."""
    return df.join(phones.select(key).distinct(), key, "left_anti")
