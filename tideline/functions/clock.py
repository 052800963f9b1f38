"""Local-time arithmetic in a fixed offset, independent of the session time zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.text import _col

DAY = 86400


def followup_due_epoch(epoch, days: int = 3, hour: int = 18, offset_hours: int = 3) -> Column:
    """Epoch second of ``hour`` o'clock local time, ``days`` local days after ``epoch``."""
    local = _col(epoch) + F.lit(days * DAY + offset_hours * 3600)
    return F.floor(local / F.lit(DAY)) * DAY + F.lit((hour - offset_hours) * 3600)


def followup_due(ts, **kw) -> Column:
    return F.timestamp_seconds(followup_due_epoch(F.unix_seconds(_col(ts).cast("timestamp")), **kw))


def epoch_of(ts) -> Column:
    return F.unix_seconds(_col(ts).cast("timestamp"))
