"""Text extraction and normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"(?U)[\w()/-]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"1800[- ]?\d{3}[- ]?\d{3,4}|\+?\d{2,4}[- ]\d{3,5}[- ]\d{4,6}|\b[6-9]\d{9}\b"
PIN = r"\b[1-9]\d{5}\b"
_SPAN = "array<struct<text: string, start: int, stop: int>>"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))


def phones(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PHONE), F.lit(0))


def pin_codes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIN), F.lit(0))


def clean(text: Column) -> Column:
    """URLs removed, currency signs made "Rs ", white space collapsed."""
    no_urls = F.regexp_replace(text, r"https?://\S+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(no_urls, r"₹|INR|Rs\.?", "Rs "), r"\s+", " "))


def text_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length over letters and digits, case ignored; null if both are empty."""
    x, y = (F.regexp_replace(F.lower(c), "[^a-z0-9]", "") for c in (a, b))
    return 1 - F.try_divide(F.levenshtein(x, y).cast("double"), F.greatest(F.length(x), F.length(y)).cast("double"))


def numeric_signature(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))


def readings_agree(a: Column, b: Column, least: float = 0.86) -> Column:
    """The same digit runs in order, and similar text."""
    return (numeric_signature(a) == numeric_signature(b)) & (text_similarity(a, b) >= least)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def gtin_check_digit(body: Column) -> Column:
    """Check digit of a GTIN's other digits, weights 3 and 1 from the right."""
    digits = F.transform(F.split(F.reverse(body), ""), lambda d: d.try_cast("int"))
    weighted = F.transform(F.filter(digits, lambda d: d.isNotNull()), lambda d, i: F.when(i % 2 == 0, 3 * d).otherwise(d))
    total = F.aggregate(weighted, F.lit(0), lambda a, x: a + x)
    return F.pmod(10 - total % 10, F.lit(10))


def gtin_valid(code: Column) -> Column:
    body = F.substring(code, F.lit(1), F.length(code) - 1)
    return code.rlike(r"^(\d{8}|\d{12}|\d{13}|\d{14})$") & (gtin_check_digit(body) == F.substring(code, F.length(code), F.lit(1)).try_cast("int"))


def first_keyword(text: Column, cascade: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The first category one of whose keywords the text contains, case ignored."""
    low, out = F.lower(text), F.lit(otherwise)
    for name, words in reversed(cascade):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def money(text: Column) -> Column:
    """struct(amount, per): the first currency amount, and the unit it is a rate of, if any."""
    amount = r"(?i)(?:₹|rs\.?|inr)\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)(?:\s*(?:/|per)\s*([a-z]+))?"
    value = F.regexp_replace(F.regexp_extract(text, amount, 1), ",", "").try_cast("decimal(18,2)")
    return F.struct(value.alias("amount"), F.nullif(F.lower(F.regexp_extract(text, amount, 2)), F.lit("")).alias("per"))


def quantity(text: Column) -> Column:
    """struct(value, unit): the first positive quantity with a unit."""
    pattern = r"(?i)\b([0-9]+(?:[.,][0-9]+)?)\s*(kg|g|gm|mg|ml|l|litre|cm|mm|m|pcs)\b"
    value = F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.struct(F.when(value > 0, value).alias("value"), F.nullif(F.lower(F.regexp_extract(text, pattern, 2)), F.lit("")).alias("unit"))


def licence_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?<!\d)([12]\d{13})(?!\d)", 1), F.lit(""))


def spans(text: Column, pattern: str) -> Column:
    """The matches of a pattern, none of them empty, as (text, start, stop), from 0, left to right: where each stands is told by the length of all from the last match's end to its own.

    Both scans keep their compiled pattern from row to row; splitting at the pattern would compile it for every row.
    """
    reached = F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{pattern})"), F.lit(0))

    def add(done: Column, pair: Column) -> Column:
        stop = done["at"] + F.length(pair["reached"])
        return F.struct(stop.alias("at"), F.concat(done["out"], F.array(F.struct(pair["match"].alias("text"), (stop - F.length(pair["match"])).alias("start"), stop.alias("stop")))).alias("out"))

    def placed(found: Column) -> Column:
        pairs = F.zip_with(found, reached, lambda m, r: F.struct(m.alias("match"), r.alias("reached")))
        several = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")), add, lambda done: done["out"])
        # no match, and one of the whole text, need no second scan
        whole = F.array(F.struct(text.alias("text"), F.lit(0).alias("start"), F.length(text).alias("stop")))
        return F.when(F.size(found) == 0, F.array().cast(_SPAN)).when(found == F.array(text), whole).otherwise(several)

    # an array of one, so that matches are looked for once
    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), placed), F.lit(0))


def json_object(text: Column) -> Column:
    """The JSON object of a reply, as text: all of it but a code fence, or its first object whose braces balance, strings and escapes in them aside; null if that doesn't parse. An object that is cut off isn't mended."""
    fenced = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\n?", ""), r"\n?```\s*$", "")
    bare = F.trim(F.when(F.startswith(F.trim(text), F.lit("```")), fenced).otherwise(F.trim(text)), F.lit(" \n\r\t"))
    from_brace = F.substring(bare, F.locate("{", bare), F.length(bare))
    marks = spans(from_brace, r'(?s)"(?:\\.|[^"\\])*(?:"|$)|[{}]')

    def step(at: Column, mark: Column) -> Column:
        depth = at["depth"] + F.when(mark["text"] == "{", 1).when(mark["text"] == "}", -1).otherwise(0)
        return F.when(at["stop"] > 0, at).otherwise(F.struct(depth.alias("depth"), F.when((depth == 0) & (mark["text"] == "}"), mark["stop"]).otherwise(0).alias("stop")))

    stop = F.aggregate(marks, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("stop")), step, lambda at: at["stop"])
    first = F.when(F.contains(bare, F.lit("{")) & (stop > 0), F.substring(from_brace, F.lit(1), stop))
    return F.when(F.startswith(bare, F.lit("{")) & F.try_parse_json(bare).isNotNull(), bare).otherwise(F.when(F.try_parse_json(first).isNotNull(), first))
