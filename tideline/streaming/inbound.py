"""The inbound stream: files or Kafka to messages, each gateway id once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.sources.readers import inbound


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                max_files: int | None = None) -> DataFrame:
    """A folder (or glob) of files as a stream; ``max_files`` bounds one micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: T.StructType | str, max_offsets: int = 1_000_000) -> DataFrame:
    """JSON payloads of a Kafka topic; needs the Kafka connector of the cluster."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
           .option("maxOffsetsPerTrigger", max_offsets).load())
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("p"), "timestamp").select("p.*", F.col("timestamp").alias("ts"))


def inbound_stream(raw: DataFrame) -> DataFrame:
    """Payload stream to messages: sender from ``from`` or ``msisdn``, blank sender or text left out."""
    return inbound(raw)


def dedup_inbound(msgs: DataFrame, msg_id: str = "msg_id", ts: str = "ts", horizon: str | None = None) -> DataFrame:
    """Each gateway id once; a blank id is never a duplicate.

    Without ``horizon`` ids are kept for ever, as the service does. With it, an id is forgotten
    once the watermark has passed it by that much, which bounds the state.
    """
    blank = F.coalesce(F.trim(msg_id), F.lit("")) == ""
    named = msgs.filter(~blank)
    if not msgs.isStreaming:
        raise ValueError("a stored log is de-duplicated with first_per_key")
    if horizon:
        named = named.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([msg_id])
        return named.unionByName(msgs.filter(blank).withWatermark(ts, horizon))
    return named.dropDuplicates([msg_id]).unionByName(msgs.filter(blank))
