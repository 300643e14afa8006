"""Expectations on rows before they are imported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Formats of identifiers and names that are placeholders.
LEI, CIK, FIGI, TICKER = r"^[A-Z0-9]{20}$", r"^\d{1,10}$", r"^BBG[A-Z0-9]{9}$", r"^[A-Z0-9][A-Z0-9.\-]{0,9}$"
PLACEHOLDER = r"^(?:test\s*|xxx+|n/?a|unknown|\?+|-+)$"


def _given(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def _bad(name: str, pattern: str, upper: bool = True) -> Column:
    value = F.trim(F.upper(name)) if upper else F.trim(name)
    return _given(name) & ~value.rlike(pattern)


def entity_issues(countries: list[str], least: int = 2, most: int = 500) -> tuple[Column, Column]:
    """(errors, warnings) as arrays of codes, for rows with lei, cik, figi, ticker, country_code, primary_name, data_source.
    Missing optional values are fine."""
    name = F.trim("primary_name")
    errors = {
        "no_name": ~_given("primary_name"), "no_source": ~_given("data_source"), "lei": _bad("lei", LEI), "cik": _bad("cik", CIK, False),
        "short_name": _given("primary_name") & (F.length(name) < least), "long_name": F.length(name) > most,
    }
    warnings = {
        "figi": _bad("figi", FIGI), "ticker": _bad("ticker", TICKER), "country": _given("country_code") & ~F.upper(F.trim("country_code")).isin(*countries),
        "placeholder": _given("primary_name") & F.lower(name).rlike(PLACEHOLDER),
    }
    listed = lambda issues: F.array_compact(F.array(*[F.when(cond, code) for code, cond in issues.items()]))
    return listed(errors), listed(warnings)


def validate_entities(rows: DataFrame, countries: list[str], strict: bool = False) -> DataFrame:
    """Add errors, warnings and valid; in strict mode a warning makes a row invalid too."""
    errors, warnings = entity_issues(countries)
    checked = rows.withColumns({"errors": errors, "warnings": warnings})
    valid = F.size("errors") == 0
    return checked.withColumn("valid", valid & (F.size("warnings") == 0) if strict else valid)


def split_valid(checked: DataFrame, max_errors: int) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows); an error where more than ``max_errors`` are rejected. The check stops at that many."""
    rejected = checked.where("NOT valid")
    if rejected.limit(max_errors + 1).count() > max_errors:
        raise ValueError(f"more than {max_errors} rows are invalid")
    return checked.where("valid"), rejected
