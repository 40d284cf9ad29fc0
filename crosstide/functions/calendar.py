"""Calendar, age and membership columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, functions as F

DAYS_PER_YEAR = 365.25


def calendar_columns(date: str = "date") -> dict[str, Column]:
    d = F.col(date)
    angle = F.month(d).cast("double") * F.lit(2 * math.pi / 12)
    month_end = F.last_day(d) == d
    return {
        "year": F.year(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
        "day_of_week": F.weekday(d),
        "is_month_end": month_end.cast("int"),
        "is_quarter_end": (month_end & (F.month(d) % 3 == 0)).cast("int"),
        "month_sin": F.sin(angle),
        "month_cos": F.cos(angle),
    }


def years_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier).cast("double") / F.lit(DAYS_PER_YEAR)


def age_columns(symbol: str = "symbol", date: str = "date") -> dict[str, Column]:
    """Ages at each row; membership age is NULL before entry, the flag is 0 without a date."""
    d = F.col(date)
    first_row = F.min(d).over(Window.partitionBy(symbol))
    member = d >= F.col("date_added")
    return {
        "first_trade_age_years": years_between(d, first_row),
        "firm_age_years": (F.year(d) - F.col("founded_year")).cast("double"),
        "legacy_firm_age_years": (F.year(d) - F.col("legacy_founded_year")).cast("double"),
        "sp500_membership_age_years": F.when(member, years_between(d, F.col("date_added"))),
        "sp500_member_asof": F.coalesce(member.cast("int"), F.lit(0)),
    }
