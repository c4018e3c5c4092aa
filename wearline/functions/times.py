"""UTC time parsing and rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_utc(time: Column) -> Column:
    """ISO-8601 text ending in Z; microseconds only when there are any."""
    stamp = time.cast("timestamp")
    whole = F.pmod(F.unix_micros(stamp), F.lit(1_000_000)) == 0
    return F.when(whole, F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    )


def parse_bound(text: Column) -> Column:
    """A time bound with a ``Z`` or numeric offset; null when it is neither."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXX")),
    )
