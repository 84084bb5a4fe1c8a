"""Column expressions.  All are built-in Spark functions, so they stay inside
whole-stage codegen; none is a Python UDF."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the analysed data's conventions.
BENIGN = "BENIGN"                 # the one non-attack label
INTERNAL_PREFIX = "192.168."      # internal subnet prefix of the testbed
EN_DASH_LATIN1 = "\u0096"         # Windows-1252 en-dash read as latin1

_UNIT_SECONDS = {
    "second": 1, "seconds": 1, "s": 1,
    "minute": 60, "minutes": 60, "min": 60,
    "hour": 3600, "hours": 3600, "h": 3600,
    "day": 86400, "days": 86400, "d": 86400,
    "week": 604800, "weeks": 604800,
}
_CALENDAR_UNITS = {"month", "quarter", "year"}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def width_seconds(width: str) -> int | None:
    """``"5 minutes"`` -> 300; calendar units (month, quarter, year) -> None."""
    parts = width.strip().lower().split()
    if len(parts) == 1:
        n, unit = 1, parts[0]
    else:
        n, unit = int(parts[0]), parts[1]
    if unit in _CALENDAR_UNITS:
        if n != 1:
            raise ValueError("calendar buckets support a width of 1 only")
        return None
    return n * _UNIT_SECONDS[unit]


_EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def bucket_floor(ts, width: str = "1 hour") -> Column:
    """Floor a ``timestamp_ntz`` to an epoch-aligned bucket of any fixed width
    (or to a calendar month / quarter / year).  Integer arithmetic on the wall-clock
    microseconds since the epoch: exact, also before 1970, independent of the session
    time zone, and the type stays ``timestamp_ntz``."""
    ts = _col(ts).cast("timestamp_ntz")
    secs = width_seconds(width)
    if secs is None:
        unit = width.strip().lower().split()[-1]
        return F.trunc(F.to_date(ts), unit).cast("timestamp_ntz")
    epoch = F.expr(_EPOCH_NTZ)
    us = F.lit(secs * 1_000_000)
    micros = F.timestamp_diff("MICROSECOND", epoch, ts)
    return F.timestamp_add("MICROSECOND", micros - F.pmod(micros, us), epoch)


def lit_as(value, dtype) -> Column:
    """A literal of a column's type.  ``timestamp_ntz`` values go through their ISO text
    (no time-zone conversion); others use the driver-side literal."""
    from pyspark.sql.types import TimestampNTZType
    if isinstance(dtype, TimestampNTZType) and value is not None:
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value).cast(dtype)


def seconds_between(start, end) -> Column:
    """Exact seconds from ``start`` to ``end`` (microsecond resolution, no rounding of either
    end); NULL when either is missing."""
    return F.timestamp_diff("MICROSECOND", start.cast("timestamp_ntz"), end.cast("timestamp_ntz")) / F.lit(1e6)


def parse_ambiguous_timestamp(s) -> Column:
    """``D/M/YYYY h:mm[:ss]`` on a 12-hour clock without am/pm -> ``timestamp_ntz``.

    Hour 12 stays 12, hours up to 7 are afternoon (+12), 8..11 stay; seconds default 0.
    ``get`` (not ``[]``) so a missing seconds field yields NULL instead of an error.
    """
    s = _col(s)
    halves = F.split(s, " ")
    dmy = F.split(F.get(halves, 0), "/")
    hms = F.split(F.get(halves, 1), ":")
    hour = F.get(hms, 0).cast("int")
    real_hour = (F.when(hour == 12, F.lit(12))
                 .when(hour <= 7, hour + 12)
                 .otherwise(hour))
    second = F.coalesce(F.get(hms, 2).cast("int"), F.lit(0))
    return F.make_timestamp_ntz(
        F.get(dmy, 2).cast("int"), F.get(dmy, 1).cast("int"), F.get(dmy, 0).cast("int"),
        real_hour, F.get(hms, 1).cast("int"), second)


def binary_label(label) -> Column:
    """0 for BENIGN, 1 otherwise (a missing label counts as an attack, like ``!=``)."""
    return F.when(_col(label).eqNullSafe(F.lit(BENIGN)), F.lit(0)).otherwise(F.lit(1))


def derived_bytes(forward, backward) -> Column:
    """Bytes of a flow in both directions; NULL if either is missing."""
    return _col(forward).cast("double") + _col(backward).cast("double")


def is_internal_ip(ip) -> Column:
    return _col(ip).startswith(INTERNAL_PREFIX)


def fix_label_encoding(label) -> Column:
    """en-dash byte -> '-', then strip surrounding whitespace."""
    return F.regexp_replace(F.replace(_col(label), F.lit(EN_DASH_LATIN1), F.lit("-")),
                            r"^\s+|\s+$", "")


def inf_to_null(c) -> Column:
    """+-Infinity and NaN -> NULL (Spark keeps one notion of missing)."""
    c = _col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def host_name(id_col) -> Column:
    """Synthetic host address for a numeric id: ids below 50 live on the internal subnet."""
    id_col = _col(id_col)
    return F.concat(F.when(id_col < 50, F.lit("192.168.10.")).otherwise(F.lit("10.0.0.")),
                    id_col.cast("string"))
