"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "tideline", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every job here relies on.

    Sizes (shuffle partitions, memory) belong to the cluster and are passed by the caller.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder of its own. On a cluster a
    machine-local folder would be lost with its machine, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tideline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_stages: list[str] = []


def cut_lineage(df):
    """Store ``df`` in the shared folder and go on from the stored copy.

    A written table survives the loss of executors, which cached blocks do not.
    """
    path = fresh_path(df.sparkSession, "stage")
    df.write.parquet(path)
    _stages.append(path)
    return df.sparkSession.read.parquet(path)


def drop_stages(spark: SparkSession) -> int:
    """Removes the intermediate tables of this process; call it once results are written."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    count = len(_stages)
    while _stages:
        path = hadoop(_stages.pop())
        path.getFileSystem(conf).delete(path, True)
    return count
