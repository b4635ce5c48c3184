"""Partial dates and durations as Column expressions. Partial dates are text: YYYY-MM or YYYY-MM-DD."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = {m: i + 1 for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))}


def normalize(text: Column) -> Column:
    """YYYY-MM-DD or YYYY-MM from d/m/Y, m/Y, ISO and "mon YYYY" forms; two-digit years pivot at 50; null if none fits."""
    t = F.lower(F.trim(text))
    part = lambda p, i: F.regexp_extract(t, p, i)
    two = lambda c: F.lpad(c, 2, "0")
    full = lambda y: F.when(F.length(y) == 4, y).when(y.try_cast("int") < 50, F.concat(F.lit("20"), y)).otherwise(F.concat(F.lit("19"), y))
    dmy, my, iso, im = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})$", r"^(\d{1,2})[/.-](\d{4})$", r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}$"
    word = r"^([a-z]{3})[a-z]*[ .-]+(\d{4}|\d{2})$"
    month = F.try_element_at(F.create_map(*(F.lit(x) for k, v in MONTHS.items() for x in (k, f"{v:02d}"))), part(word, 1))
    return (
        F.when(t.rlike(iso) | t.rlike(im), t)
        .when(t.rlike(dmy), F.concat_ws("-", full(part(dmy, 3)), two(part(dmy, 2)), two(part(dmy, 1))))
        .when(t.rlike(my), F.concat_ws("-", part(my, 2), two(part(my, 1))))
        .when(t.rlike(word) & month.isNotNull(), F.concat_ws("-", full(part(word, 2)), month))
    )


def derived_endpoint(start: Column, amount: Column, unit: Column, february_28: bool = False) -> Column:
    """`start` plus a duration, in start's own precision. Weeks are days; with february_28, February never has a 29th."""
    u = F.rtrim(F.lower(unit), F.lit("s"))
    months = F.when(u == "year", amount * 12).when(u == "month", amount)
    days = F.when(u == "week", amount * 7).when(u == "day", amount)
    day = F.when(F.length(start) == 10, start).otherwise(F.concat(start, F.lit("-01"))).try_cast("date")
    moved = F.when(months.isNotNull(), F.add_months(day, months.cast("int")))
    if february_28:
        moved = F.when((F.month(moved) == 2) & (F.dayofmonth(moved) == 29), F.date_sub(moved, 1)).otherwise(moved)
    whole = F.coalesce(moved, F.date_add(day, days.cast("int")))
    rounded = F.add_months(day, F.round(days / 30).cast("int"))
    return F.when(F.length(start) == 7, F.date_format(F.coalesce(moved, rounded), "yyyy-MM")).otherwise(F.date_format(whole, "yyyy-MM-dd"))


def implied_months(start: Column, end: Column) -> Column:
    ym = lambda c: F.substring(c, 1, 4).try_cast("int") * 12 + F.substring(c, 6, 2).try_cast("int")
    return (ym(end) - ym(start)).cast("double")


def consistency(made: Column, expires: Column, amount: Column, unit: Column) -> Column:
    """EXPIRY_BEFORE_MFD, DURATION_MISMATCH (over 1.5 months, the duration in months) or NONE; compared at common precision."""
    u = F.rtrim(F.lower(unit), F.lit("s"))
    months = F.when(u == "year", amount * 12).when(u == "month", amount).when(u == "week", amount * 7 / 30).when(u == "day", amount / 30)
    n = F.least(F.length(made), F.length(expires))
    return F.when(F.substring(expires, F.lit(1), n) < F.substring(made, F.lit(1), n), "EXPIRY_BEFORE_MFD").when(F.abs(implied_months(made, expires) - months) > 1.5, "DURATION_MISMATCH").otherwise("NONE")
