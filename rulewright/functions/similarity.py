"""How alike a stated and a read value are: by their sequence, their words, and their sequence with glyphs that readers confuse made equal."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Currency marks, punctuation, abbreviations, and glyphs that are taken for one another.
CURRENCY = r"(?:rs\.?|inr|usd|eur|gbp|[\$])\s*"
PUNCTUATION = r"[\.,;:_\-\/\(\)\[\]\{\}\*\#\@\+\=\~\"\'`]"
ABBREVIATIONS = {"ltd": "limited", "pvt": "private", "mfg": "manufactured", "mfd": "manufactured", "pkd": "packed", "exp": "expiry", "qty": "quantity", "wt": "weight", "g": "grams", "gm": "grams", "gms": "grams", "ml": "millilitres"}
GLYPHS = {"0": "o", "O": "o", "Q": "o", "D": "o", "1": "i", "I": "i", "l": "i", "|": "i", "!": "i", "5": "s", "S": "s", "8": "b", "B": "b", "2": "z", "Z": "z", "6": "g", "G": "g", "9": "q"}


def normalised(text: Column) -> Column:
    """Lower case without currency marks and punctuation, abbreviations written out, words one space apart. Null counts as empty."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), CURRENCY, ""), PUNCTUATION, " ")
    whole = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))
    words = F.filter(F.split(plain, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(whole, w), w)), " ")


def glyphs_made_equal(text: Column) -> Column:
    return F.translate(text, "".join(GLYPHS), "".join(GLYPHS.values()))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words of all words; 1 for two texts without any."""
    words = lambda t: F.array_distinct(F.filter(F.split(t, " "), lambda w: w != ""))
    either = F.size(F.array_union(words(a), words(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(words(a), words(b))) / F.greatest(either, F.lit(1)))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff and Obershelp's ratio: twice the characters in the longest common blocks, found recursively, of all characters. Each pair once a batch."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a, b):
            if pair not in known:
                known[pair] = difflib.SequenceMatcher(None, *pair).ratio()
            out.append(known[pair])
        return pd.Series(out, dtype=float)

    return ratio(a, b)


def compare_values(rows: DataFrame, stated: str, read: str) -> DataFrame:
    """rows with raw_similarity, similarity (the best of three, both to 3 places) and diagnosis, from two text columns.

    EXACT and NORMALISED for texts that are equal as they stand, but for case, or once normalised; then GLYPHS, WORDS, ALIKE or
    DIFFERENT. Nulls count as empty texts. Pairs that are equal by then aren't compared by sequence; others that repeat are compared once.
    """
    plain = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    a, b = normalised(F.col(stated)), normalised(F.col(read))
    marked = rows.withColumns({"_exact": plain(stated) == plain(read), "_a": a, "_b": b})
    done = F.col("_exact") | (F.col("_a") == F.col("_b"))
    pairs = marked.where(~done).select("_a", "_b").distinct()
    pairs = pairs.withColumns({"_ratio": sequence_ratio(F.col("_a"), F.col("_b")), "_glyph": sequence_ratio(glyphs_made_equal(F.col("_a")), glyphs_made_equal(F.col("_b"))), "_words": word_overlap(F.col("_a"), F.col("_b"))})
    met = marked.join(pairs, ["_a", "_b"], "left")
    best = F.greatest("_ratio", "_glyph", "_words")
    diagnosis = F.when(F.col("_exact"), "EXACT").when(done, "NORMALISED").when((F.col("_glyph") >= 0.90) & (F.col("_ratio") < 0.90), "GLYPHS").when(F.col("_words") >= 0.85, "WORDS").when(best >= 0.80, "ALIKE").otherwise("DIFFERENT")
    raw = F.when(F.col("_exact"), 1.0).when(done, 0.95).otherwise(F.round("_ratio", 3))
    found = met.withColumns({"raw_similarity": raw, "similarity": F.when(done, 1.0).otherwise(F.round(best, 3)), "diagnosis": diagnosis})
    return found.select(*(rows.columns), "raw_similarity", "similarity", "diagnosis")
