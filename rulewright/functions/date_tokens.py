"""Dates and durations in a line of text as Column expressions: what to look for, where it stands, and its value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulewright.functions.text import spans

# The forms of dates that are looked for, in the order in which they are tried at a place.
DAY_MONTH_YEAR = r"(?<!\d)(?<!\d-)\b\d{1,2}\s*[/.-]\s*\d{1,2}\s*[/.-]\s*(?:\d{4}|\d{2})(?!-\d)(?!\d)\b"
MONTH_NAME_YEAR = r"\b(?:\d{1,2}\s+)?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s*(?:[/.-]|\s+)?(?:\d{4}|\d{2})\b"
YEAR_MONTH_DAY = r"(?<!\d)(?<!\d-)\b(?:19[7-9]\d|20[0-4]\d)\s*[/.-]\s*\d{1,2}\s*[/.-]\s*\d{1,2}(?!-\d)(?!\d)\b"
MONTH_YEAR = r"(?<!\d)(?<!\d-)\b(?:0[1-9]|1[0-2]|[1-9])\s*[/.-]\s*(?:19[7-9]\d|20[0-4]\d)(?!-\d)(?!\d)\b"
MONTH_SHORT_YEAR = r"(?<!\d)(?<!\d-)\b(?:0[1-9]|1[0-2])\s*[/.-]\s*(?!00\b)\d{2}(?!\s*/\s*[a-zA-Z])(?!\s*g\b)(?!\s*kg\b)(?!\s*ml\b)(?!-\d)(?!\d)\b"
DURATION = r"\b(\d{1,2})\s+(months?|days?|weeks?|years?)(?:\s+(?:from|of)\s+(?:pkg\w*|pkd\w*|mfd\w*|mfg\w*|pack\w*|manufactur\w*|date|production))?\b"
# What makes a line one of a rate, or of a telephone, and what makes it one of dates all the same.
RATE_UNIT = r"/\s*(?:g|kg|gm|gms|grams?|ml|l|litres?|liters?|cm|m|piece|pieces|pcs?|pc|nos?|units?)\b"
PRICED = r"(?:₹|rs\.?|=|/)\s*\d+\.\d{2}\b"
ONLY_RATE = r"^\s*(?:usp|unit\s*price)?\s*[:=~]?\s*(?:₹|rs\.?|=|/)?\s*\d+(?:\.\d{1,2})?\s*/\s*[a-zA-Z]+\s*$"
TELEPHONE = r"\b(?:toll\s*free|helpline|consumer\s*care|call|phone|tel)\b"
DATED = r"\b(?:pkd|mfg|mfd|exp|use\s*by|best\s*before)\b"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

TOKENS = "array<struct<text: string, start: int, stop: int, value: string, is_duration: boolean>>"
CALENDAR = "(?i)" + "|".join(f"(?:{p})" for p in (DAY_MONTH_YEAR, MONTH_NAME_YEAR, YEAR_MONTH_DAY, MONTH_YEAR, MONTH_SHORT_YEAR))


def has(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


def _year(digits: Column) -> Column:
    """Four digits; of two, those under 50 are of this century."""
    n = digits.try_cast("int")
    return F.lpad(F.when(n < 50, n + 2000).when(n < 100, n + 1900).otherwise(n).cast("string"), 4, "0")


def _two(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def value(token: Column) -> Column:
    """YYYY-MM-DD or YYYY-MM of a date; a duration in lower case; null for what is neither, has no such month or day, or a year of 00 after a month only."""
    return F.when(has(F.trim(token), DURATION), F.lower(F.trim(token))).otherwise(date_value(token))


def _once(c: Column, f) -> Column:
    """f(c) by an array of one, so that c is made once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def number_value(token: Column) -> Column:
    """date_value() of what has no letters."""
    t = F.trim(token)

    def number(parts: Column) -> Column:
        def ordered(pattern: str, year: int, month: int, day: int | None = None) -> Column:
            y, m, d = (F.get(parts, F.lit(i)).try_cast("int") if i is not None else None for i in (year, month, day))
            fits = t.rlike(pattern) & m.between(1, 12) & (d.between(1, 31) if day is not None else (F.length(F.get(parts, F.lit(year))) == 4) | (y > 0))
            return F.when(fits, F.concat_ws("-", *([_year(F.get(parts, F.lit(year))), _two(m)] + ([_two(d)] if day is not None else []))))

        s = r"\s*[/.-]\s*"
        return F.coalesce(
            ordered(rf"^\d{{1,2}}{s}\d{{1,2}}{s}(?:\d{{4}}|\d{{2}})$", 2, 1, 0),
            ordered(rf"^\d{{1,2}}{s}(?:\d{{4}}|\d{{2}})$", 1, 0),
            ordered(rf"^\d{{4}}{s}\d{{1,2}}{s}\d{{1,2}}$", 0, 1, 2),
        )

    return _once(F.split(F.regexp_replace(t, r"\D+", "/"), "/"), number)


def date_value(token: Column) -> Column:
    """value() of what has no duration in it, as no match of CALENDAR has."""
    t = F.trim(token)

    def by_name(parts: Column) -> Column:
        day, name, year = (F.get(parts, F.lit(i)) for i in range(3))
        month = _two(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3))))
        return F.concat_ws("-", _year(year), month, F.when(day.try_cast("int").between(1, 31), _two(day.try_cast("int"))))

    named = rf"(?i)\b(?:(\d{{1,2}})\s+)?({'|'.join(MONTHS[:8])}|sept?|{'|'.join(MONTHS[9:])})[a-z]*\s*(?:[/.-]|\s+)?(\d{{2,4}})\b"
    names = _once(F.split(F.regexp_replace(t, rf"^(?s:.*?)(?:{named})(?s:.*)$", "$1/$2/$3"), "/"), by_name)
    return F.coalesce(number_value(token), F.when(t.rlike(named), names))


def date_tokens(text: Column) -> Column:
    """Durations, then dates that aren't part of one, of a line: array of (text, start, stop, value, is_duration). Null texts have none.

    A line that states only a rate has none, nor one of a telephone that names no date; a number before a rate's unit is none.
    """
    t = F.coalesce(text, F.lit(""))
    rate = has(t, ONLY_RATE) & (has(t, RATE_UNIT) | has(t, PRICED))
    call = has(t, TELEPHONE) & ~has(t, DATED)
    full = lambda found, to_value, lasts: F.transform(found, lambda s: F.struct(F.trim(s["text"]).alias("text"), s["start"].alias("start"), s["stop"].alias("stop"), to_value(s["text"]).alias("value"), F.lit(lasts).alias("is_duration")))

    def placed(found: Column) -> Column:
        dates = F.filter(found, lambda s: ~has(F.substring(t, s["stop"] + 1, F.lit(6)), "^" + RATE_UNIT))

        def with_dates(durations: Column) -> Column:
            inside = lambda s: F.exists(durations, lambda d: (d["start"] <= s["start"]) & (s["stop"] <= d["stop"]))
            return F.concat(full(durations, value, True), full(F.filter(dates, lambda s: ~inside(s)), date_value, False))

        # most lines have no duration; in others durations are looked for once
        with_durations = _once(spans(t, "(?i)" + DURATION), with_dates)
        # rates, telephones, durations and names of months have letters
        return F.when(~t.rlike("[a-zA-Z]"), full(found, number_value, False)).when(rate | call, F.array().cast(TOKENS)).when(has(t, DURATION), with_durations).otherwise(full(dates, date_value, False))

    # dates and durations have a digit
    return F.when(t.rlike(r"\d"), _once(spans(t, CALENDAR), placed)).otherwise(F.array().cast(TOKENS))
