"""Column-expression helpers shared by the operators.

Everything here returns a ``Column`` so it composes into a single projection
and stays inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
MICROS_PER_SECOND = 1_000_000


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a naive (``timestamp_ntz``) or zoned timestamp.

    ``timestampdiff`` on ``timestamp_ntz`` is independent of the session time
    zone, so 1h / 24h / 7d windows never shift across daylight-saving changes.
    """
    ts = col_(ts).cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def r6(c: str | Column) -> Column:
    """Round a double to 6 decimals (engine-independent text/hash parity)."""
    return F.round(col_(c).cast("double"), 6)


def sha256_hex(c: str | Column) -> Column:
    return F.sha2(col_(c).cast("string"), 256)


def sha256_trimmed(c: str | Column) -> Column:
    """sha256 of the trimmed text; null for null or blank input."""
    t = F.trim(col_(c).cast("string"))
    return F.when(t.isNotNull() & (t != ""), F.sha2(t, 256))


def money_text(c: str | Column) -> Column:
    """Fixed two-decimal text of a money value (no exponent form)."""
    return col_(c).cast("decimal(18,2)").cast("string")


def ts_text(c: str | Column, sep: str = " ", micros: bool = True) -> Column:
    """Fixed text of a naive timestamp, ``yyyy-MM-dd HH:mm:ss.SSSSSS``.

    Cut from the text of the ``timestamp_ntz`` value, so it never passes
    through the session time zone (``date_format`` would, and shifts
    wall-clock times that fall into a daylight-saving gap).
    """
    s = col_(c).cast("timestamp_ntz").cast("string")  # yyyy-MM-dd HH:mm:ss, then .f with trailing zeros cut
    parts = [F.substring(s, 1, 10), F.lit(sep), F.substring(s, 12, 8)]
    if micros:
        parts += [F.lit("."), F.rpad(F.substring(s, 21, 6), 6, "0")]
    return F.concat(*parts)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km (same formula as the reference's helper)."""
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2.0), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2.0), 2)
    return 2.0 * EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))
