"""Calendar features of an order date.

All are built-in expressions on a ``date`` column; the session zone is UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day names in Monday-first order, as pandas ``day_name()`` prints them.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
# Month abbreviations as ``strftime('%b')`` prints them (C locale).
MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def month_start(d) -> Column:
    """Period[M] as the first day of the month (``date``)."""
    return F.trunc(_c(d), "MM")


def quarter_label(d) -> Column:
    """``2024Q1`` (Period[Q] as string)."""
    return F.concat(F.year(_c(d)).cast("string"), F.lit("Q"), F.quarter(_c(d)).cast("string"))


def iso_week(d) -> Column:
    """ISO-8601 week number (2024-12-30 is week 1)."""
    return F.weekofyear(_c(d))


def day_name(d) -> Column:
    return F.date_format(_c(d), "EEEE")


def month_abbr(d) -> Column:
    return F.date_format(_c(d), "MMM")


def is_weekend(d) -> Column:
    return F.weekday(_c(d)) >= F.lit(5)


def month_diff(later, earlier) -> Column:
    """``(y2-y1)*12 + (m2-m1)`` — whole calendar months between two dates."""
    later, earlier = _c(later), _c(earlier)
    return (F.year(later) - F.year(earlier)) * F.lit(12) + (F.month(later) - F.month(earlier))


def time_features(df, date_col: str = "order_date"):
    """Append year, month, month_name, quarter, week, day_of_week, year_month, is_weekend."""
    d = F.col(date_col)
    return df.withColumns({
        "year": F.year(d),
        "month": F.month(d),
        "month_name": month_abbr(d),
        "quarter": quarter_label(d),
        "week": iso_week(d),
        "day_of_week": day_name(d),
        "year_month": month_start(d),
        "is_weekend": is_weekend(d),
    })


def in_years(d, *years: int) -> Column:
    """``year(d) IN years`` as date ranges, so the predicate reaches the scan
    (Parquet min/max pruning) instead of being evaluated after it."""
    import datetime as _dt
    cond = F.lit(False)
    for y in sorted(set(int(v) for v in years)):
        cond = cond | ((_c(d) >= F.lit(_dt.date(y, 1, 1))) & (_c(d) < F.lit(_dt.date(y + 1, 1, 1))))
    return cond
