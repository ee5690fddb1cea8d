"""Times handed to Spark from Python."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def time_beside(df: DataFrame, ts: str, at) -> Column:
    """A literal to compare the column ts with. A plain datetime would be read in the zone of the Python process, not in the session's; beside a
    column without a zone it is written without one."""
    plain = isinstance(at, datetime.datetime) and at.tzinfo is None and isinstance(df.schema[ts].dataType, TimestampNTZType)
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz") if plain else F.lit(at)
