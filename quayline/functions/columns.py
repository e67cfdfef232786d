"""Column expressions used across the pipeline.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen; nothing runs in Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x) -> Column:
    """``NULLIF(TRIM(x), '')``; trim strips spaces only."""
    return F.nullif(F.trim(_c(x)), F.lit(""))


def is_digits(x) -> Column:
    """Raw text is a non-empty run of ASCII digits (after trim)."""
    t = F.trim(F.coalesce(_c(x), F.lit("")))
    return F.when(t.rlike("^[0-9]+$"), F.lit(1)).otherwise(F.lit(0))


def code_or_default(x, default: int = 0) -> Column:
    """Blank code -> default, digits -> int, junk -> NULL (caller quarantines)."""
    t = blank_to_null(x)
    return F.when(t.isNull(), F.lit(default)).otherwise(t.try_cast("int"))


def gtfs_date(x) -> Column:
    """``YYYYMMDD`` (maybe space padded) -> DateType; anything else NULL."""
    t = F.trim(_c(x))
    return F.when(F.length(t) == 8, F.try_to_date(t, "yyyyMMdd"))


def clock_secs(x) -> Column:
    """``HH:MM:SS`` -> seconds since the service day began. HH may pass 23."""
    t = F.trim(_c(x))
    hh = F.substring(t, 1, 2).try_cast("int")
    mm = F.substring(t, 4, 2).try_cast("int")
    ss = F.substring(t, 7, 2).try_cast("int")
    return F.when(F.length(t) == 8, hh * 3600 + mm * 60 + ss)


def clock_text(secs) -> Column:
    """Inverse of :func:`clock_secs` for non-negative seconds (hours keep 2+ digits)."""
    s = _c(secs)
    return F.concat_ws(
        ":",
        F.lpad((s / 3600).cast("long").cast("string"), 2, "0"),
        F.lpad(((s / 60).cast("long") % 60).cast("string"), 2, "0"),
        F.lpad((s % 60).cast("string"), 2, "0"),
    )


def hour_band(h, wide: bool = False) -> Column:
    """``'07:00'`` or ``'07:00-07:59'`` for an hour column."""
    h = _c(h)
    if wide:
        return F.format_string("%02d:00-%02d:59", h, h)
    return F.format_string("%02d:00", h)


def half_up(x, digits: int) -> Column:
    """Round a double half away from zero with plain IEEE steps.

    ``floor(|x| * 10^d + 0.5) / 10^d`` with the sign restored. The same steps in
    any engine give the same double, which keeps oracle comparisons exact.
    """
    x = _c(x)
    scale = float(10 ** digits)
    mag = F.floor(F.abs(x) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x < 0, -mag).otherwise(mag)


def ratio(num, den, digits: int, scale: float = 1.0) -> Column:
    """``ROUND(scale * num / den, digits)``; NULL when ``den`` is 0 or NULL."""
    num, den = _c(num), _c(den)
    q = (F.lit(float(scale)) * num.cast("double")) / F.nullif(den, F.lit(0)).cast("double")
    return half_up(q, digits)


def pct(num, den, digits: int = 2) -> Column:
    """Percentage ``ROUND(100.0 * num / den, digits)``."""
    return ratio(num, den, digits, scale=100.0)


def frequency_class(days) -> Column:
    """V04 thresholds: >=5 High, >=2 Medium, else Low/Special."""
    d = _c(days)
    return (
        F.when(d >= 5, F.lit("High Frequency"))
        .when(d >= 2, F.lit("Medium Frequency"))
        .otherwise(F.lit("Low Frequency/Special"))
    )


def frequency_class_order(cls) -> Column:
    c = _c(cls)
    return F.when(c == "High Frequency", 1).when(c == "Medium Frequency", 2).otherwise(3)
