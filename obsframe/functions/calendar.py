"""Calendar parts and cyclical encodings of a date."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_in_year(d: Column) -> Column:
    return F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31)))


def days_in_month(d: Column) -> Column:
    return F.dayofmonth(F.last_day(d))


def calendar_parts(d: Column) -> dict[str, Column]:
    return {
        "day_name": F.date_format(d, "EEEE"),
        "day_of_week": F.weekday(d),
        "day_of_month": F.dayofmonth(d),
        "day_of_year": F.dayofyear(d),
        "iso_week": F.weekofyear(d),
        "month": F.month(d),
        "month_name": F.date_format(d, "MMMM"),
        "quarter": F.quarter(d),
        "year": F.year(d),
    }


def cycles(d: Column, month_length: bool = False) -> dict[str, Column]:
    """Sine and cosine of six calendar cycles.

    The day-of-month cycle is 31 days, or the real month length on request.
    """
    parts = {
        "day_of_week": F.weekday(d) / 7.0,
        "day_of_month": (F.dayofmonth(d) - 1) / (days_in_month(d) if month_length else 31.0),
        "iso_week": (F.weekofyear(d) - 1) / 53.0,
        "month": (F.month(d) - 1) / 12.0,
        "quarter": (F.quarter(d) - 1) / 4.0,
        "day_of_year": (F.dayofyear(d) - 1) / days_in_year(d),
    }
    out = {}
    for name, part in parts.items():
        out[f"{name}_sin"] = F.sin(part * (2 * math.pi))
        out[f"{name}_cos"] = F.cos(part * (2 * math.pi))
    return out
