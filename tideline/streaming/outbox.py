"""What goes out: replies, welcomes, follow-ups and alerts, each under a key that is claimed before it is sent.

The outbox is a folder with two logs. A batch first writes the rows whose keys nobody has claimed to a new folder of ``claims``;
once that folder is complete its keys are taken for good. Then the rows are sent and written to a folder of the same name
in ``sent``. Keys name the message, not the batch, so a batch that runs again, a query that starts over without its
checkpoint and a repeated input send nothing twice. Folders without their commit file count for nothing.

Claims are partitioned by the day of what they answer, so a batch meets the claims of its own days only, however long the log. One writer
at a time fills an outbox, as one streaming query does.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.content import render_reply
from tideline.operators.dialog import ALERT_NOTES, alert_text
from tideline.session import cut_lineage

ROW = "kind string, phone long, key string, text string, day long"
DAY = 86400


def message_key() -> Column:
    """A reply, a welcome and an alert belong to a message, a follow-up to a sender and the time it is due."""
    part = lambda *cols: F.concat_ws(":", "kind", *cols)
    return F.when(F.col("kind") == "followup", part("phone", "due")).otherwise(part("id"))


def outbound(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """Output rows of the conversation as messages (``kind``, ``phone``, ``key``, ``text``, ``day``).

    Replies, welcomes and follow-ups carry their template's text in the sender's language, alerts what a human needs to act on. The reply to a
    first contact brings a welcome of its own. Muted rows and rows whose template has no text send nothing.
    """
    first = rows.filter("kind = 'reply' AND welcome").withColumns({"kind": F.lit("welcome"), "template_id": F.lit("welcome")})
    rows = rows.unionByName(first).withColumn("key", message_key()).withColumn("day", F.floor(F.col("epoch") / DAY).cast("long"))
    said = render_reply(rows.filter(F.col("kind").isin("reply", "welcome", "followup")), templates)
    note = F.coalesce(*[F.when(F.col("action") == a, F.lit(n)) for a, n in ALERT_NOTES.items()], F.lit(""))
    alerts = rows.filter("kind = 'alert'").withColumn("text", alert_text(F.col("phone"), note, *[F.col(c) for c in ("said", "english", "label", "proba", "reason")]))
    names = [f.split()[0] for f in ROW.split(", ")]
    return said.select(names).unionByName(alerts.select(names))


def sending(box: Outbox, templates: DataFrame) -> Callable[[DataFrame, int, str], None]:
    """Writes a batch of the conversation's output to ``box``. It is stored first, as each of its uses would run the conversations of the batch again."""
    return lambda rows, n, path: box.put(outbound(cut_lineage(rows), templates))


class Outbox:
    """``send`` gets the rows of a batch to hand to a gateway. Without it the log itself is the delivery.

    A batch that ends between claim and send leaves its rows in doubt. A gateway may have got some of them, so they are not sent again
    (``in_doubt`` lists them); a log is written from the claims when the outbox is opened next.
    """

    def __init__(self, spark: SparkSession, path: str, send: Callable[[DataFrame], None] | None = None):
        self.spark, self.path, self.send = spark, path, send
        if send is None:
            for attempt in self._committed("claims") - self._committed("sent"):
                self._log(attempt)

    def _committed(self, log: str) -> set[str]:
        """Names of the complete folders."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        marks = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{log}/attempt=*/_SUCCESS")
        found = marks.getFileSystem(conf).globStatus(marks) or []
        return {str(f.getPath().getParent().getName()) for f in found}

    def _read(self, log: str, attempts: set[str] | None = None) -> DataFrame:
        names = sorted(self._committed(log) if attempts is None else attempts)
        if not names:
            return self.spark.createDataFrame([], f"{ROW}, attempt string")
        return self.spark.read.schema(f"{ROW}, attempt string").option("basePath", f"{self.path}/{log}").parquet(*[f"{self.path}/{log}/{n}" for n in names])

    def _log(self, attempt: str) -> None:
        self._read("claims", {attempt}).drop("attempt").write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/sent/{attempt}")

    def claim(self, rows: DataFrame) -> str | None:
        """Takes the keys of ``rows`` that are free; the name of the claim, or None if there are none. Rows of one key are one message."""
        rows = cut_lineage(rows.groupBy("kind", "phone", "key", "day").agg(F.min("text").alias("text")))
        low, high = rows.agg(F.min("day"), F.max("day")).first()
        if low is None:
            return None
        new = cut_lineage(rows.join(self._read("claims").filter(F.col("day").between(low, high)).select("key"), "key", "left_anti").select("kind", "phone", "key", "text", "day"))
        if new.isEmpty():
            return None
        attempt = f"attempt={uuid.uuid4().hex}"
        new.write.partitionBy("day").parquet(f"{self.path}/claims/{attempt}")
        return attempt

    def put(self, rows: DataFrame) -> None:
        """Claims the keys of ``rows`` (as ``outbound`` gives them), then sends what was free."""
        attempt = self.claim(rows)
        if attempt is not None:
            if self.send is not None:
                self.send(self._read("claims", {attempt}).drop("attempt"))
            self._log(attempt)

    def sent(self) -> DataFrame:
        """All messages that went out: ``kind``, ``phone``, ``key``, ``text``, ``day``."""
        return self._read("sent").drop("attempt")

    def in_doubt(self) -> DataFrame:
        """Messages whose keys are claimed, but which are not known to have been sent."""
        return self._read("claims", self._committed("claims") - self._committed("sent")).drop("attempt")
