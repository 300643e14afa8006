"""Relative and fiscal dates, and cron fields, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms of a date expression. Anything else is null.
ISO = r"^\d{4}-\d{2}-\d{2}$"
DAYS = r"^(-?\d+)D$"
MONTHS = r"^(-?\d+)M$"
YEARS = r"^(-?\d+)Y$"
FISCAL_YEAR = r"^FY(-?\d+)$"
FISCAL_QUARTER = r"^FQ(-?\d+)$"


def fiscal_year(on: Column, end_month: int) -> Column:
    """The fiscal year of a date: the next calendar year after the closing month."""
    return F.year(on) + (F.month(on) > end_month).cast("int")


def fiscal_quarter(on: Column, end_month: int) -> Column:
    return F.floor(F.pmod(F.month(on) - F.lit(end_month % 12 + 1), F.lit(12)) / 3).cast("int") + 1


def year_end(year: Column, end_month: int) -> Column:
    return F.last_day(F.make_date(year, F.lit(end_month), F.lit(1)))


def quarter_end(year: Column, quarter: Column, end_month: int) -> Column:
    """The last day of a fiscal quarter; a quarter that ends after the closing month lies in the calendar year before."""
    month = F.pmod(F.lit(end_month % 12 + 1) + quarter * 3 - 2, F.lit(12)) + 1
    earlier = (month > end_month) & F.lit(end_month != 12)
    return F.last_day(F.make_date((year - earlier.cast("int")).cast("int"), month.cast("int"), F.lit(1)))


def resolve(expr: Column, on: Column, end_month: int = 12) -> Column:
    """A date for -3D, 2M, -1Y, FY0, FY2024, FQ-1, FQ12024 or an ISO date, seen from ``on``; null for anything else.
    Months and years are clamped to the month's end."""
    text = F.trim(expr)
    number = lambda pattern: F.regexp_extract(text, pattern, 1).try_cast("int")
    fy, fq = F.regexp_extract(text, FISCAL_YEAR, 1), F.regexp_extract(text, FISCAL_QUARTER, 1)
    year = F.when(F.length(fy) == 4, fy.try_cast("int")).otherwise(fiscal_year(on, end_month) + fy.try_cast("int"))
    count = fiscal_year(on, end_month) * 4 + fiscal_quarter(on, end_month) - 1 + fq.try_cast("int")
    absolute = F.length(fq) == 5
    q_year = F.when(absolute, F.substring(fq, 2, 4).try_cast("int")).otherwise(F.floor(count / 4).cast("int"))
    q_quarter = F.when(absolute, F.substring(fq, 1, 1).try_cast("int")).otherwise(F.pmod(count, F.lit(4)) + 1)
    return (
        F.when(text.rlike(ISO), F.try_to_date(text, "yyyy-MM-dd"))
        .when(text.rlike(DAYS), F.date_add(on, number(DAYS)))
        .when(text.rlike(MONTHS), F.add_months(on, number(MONTHS)))
        .when(text.rlike(YEARS), F.add_months(on, number(YEARS) * 12))
        .when(text.rlike(FISCAL_YEAR), year_end(year, end_month))
        .when(text.rlike(FISCAL_QUARTER), quarter_end(q_year, q_quarter, end_month))
    )


def is_expression(expr: Column) -> Column:
    """Whether a text has the form of a date expression, even if no such date exists."""
    text = F.trim(expr)
    return F.coalesce(text.rlike("|".join(f"(?:{p})" for p in (ISO, DAYS, MONTHS, YEARS, FISCAL_YEAR, FISCAL_QUARTER))), F.lit(False))


def equivalent(a: Column, b: Column, on: Column, end_month: int = 12) -> Column:
    """Whether both resolve, and to the same day."""
    return F.coalesce(resolve(a, on, end_month) == resolve(b, on, end_month), F.lit(False))


def normalized(expr: Column, on: Column, end_month: int = 12) -> Column:
    """The resolved date as text, or the expression where it doesn't resolve."""
    return F.coalesce(resolve(expr, on, end_month).cast("string"), expr)


def filing_quarter(form: Column, period_end: Column) -> Column:
    """1 to 4 by the month; null for annual forms."""
    return F.when(F.contains(form, F.lit("10-K")), None).otherwise(F.quarter(period_end))


def cron_field(field: str, low: int, high: int) -> set[int]:
    """The values of one cron field: *, numbers, ranges, lists and steps."""
    out: set[int] = set()
    for part in field.split(","):
        if part == "*":
            out |= set(range(low, high + 1))
        elif "-" in part:
            first, last = (int(x) for x in part.split("-"))
            out |= set(range(first, last + 1))
        elif "/" in part:
            base, step = part.split("/")
            out |= set(range(low if base == "*" else int(base), high + 1, int(step)))
        else:
            out.add(int(part))
    return out


def cron_matches(at: Column, expression: str) -> Column:
    """Whether a schedule runs in the minute of ``at``. Day 0 of the week is Monday, as the schedules are run in fact."""
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError(f"a cron expression has five fields: {expression!r}")
    parts = ((F.minute(at), 0, 59), (F.hour(at), 0, 23), (F.dayofmonth(at), 1, 31), (F.month(at), 1, 12), (F.weekday(at), 0, 6))
    out = F.lit(True)
    for field, (value, low, high) in zip(fields, parts, strict=True):
        allowed = cron_field(field, low, high)
        if len(allowed) < high - low + 1:
            out = out & value.isin(*sorted(allowed))
    return out
