"""Operator 5: quality rules by weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Three rules look for one defect each time,
in different ways: marks in place of words, repetition, shouting. Documents are counted by their votes on a
defect, of which there are at most 27 kinds, and expectation-maximisation over that small table estimates how
large a share of documents has the defect, and each rule's accuracy: how often it votes bad on documents with
the defect, and how often good on those without, where it votes. Rules on one defect overlap and so tell on
each other; rules on different defects don't, as a document with one defect is no likelier to have another.
A document's verdict is its posterior probability of having none. So a bad vote is outvoted by two good ones
of rules that have been right more often, and abstaining says nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import cut_lineage, without_rows

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _bind(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""

    def of_sorted(s: Column) -> Column:
        same = lambda i, x: F.coalesce(F.get(s, i)["w"] == x["w"], F.lit(False))
        places = F.filter(F.transform(s, lambda x, i: F.when(same(i - 1, x) | same(i + 1, x), x["p"])), lambda p: p.isNotNull())
        gaps = lambda at: F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return _bind(F.sort_array(places), lambda at: F.aggregate(gaps(at), F.lit(0), lambda a, x: a + x))

    def of_words(v: Column) -> Column:
        each = lambda body: F.transform(F.slice(v, 1, F.greatest(F.size(v) - 2, F.lit(0))), body)
        hashes = each(lambda x, i: F.xxhash64(x, F.get(v, i + 1), F.get(v, i + 2)))
        whole = each(lambda x, i: F.struct(F.concat(x, F.lit(" "), F.get(v, i + 1), F.lit(" "), F.get(v, i + 2)).alias("w"), i.alias("p")))
        # windows whose hashes all differ all differ; the others are compared themselves
        differ = _bind(hashes, lambda h: F.size(h) == F.size(F.array_distinct(h)))
        return F.when(differ, F.lit(0)).otherwise(_bind(F.sort_array(whole), of_sorted))

    return _bind(words, of_words)


def statistics(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, row_key (of doc_id and text) and the counts that rules look at, all long. Null texts count as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    words = F.array_remove(F.split("t", "[ \\x09-\\x0D]+"), "")
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")

    def counts(w: Column) -> Column:
        chars = F.length(F.array_join(w, ""))
        return F.struct(F.size(w).alias("n_words"), chars.alias("word_chars"), _repeat_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("n_distinct"))

    parts = rows.select(
        "doc_id",
        F.xxhash64("doc_id", "t").alias("row_key"),
        _bind(words, counts).alias("w"),
        _bind(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("l"),
        F.regexp_replace("t", f"[^{SYMBOLS}!?]+", "").alias("marks"),
        F.regexp_count("t", F.lit("\\p{Lu}")).alias("n_upper"),
        F.length(F.regexp_replace("t", "[^\\p{L}]+", "")).alias("n_letters"),
        F.regexp_count("t", F.lit("[^\\p{L} \\x09-\\x0D]{2,}")).alias("n_clusters"),
        F.regexp_count("t", F.lit("[.!?]+")).alias("n_stops"),
    )
    marks = F.regexp_replace("marks", "[!?]+", "")
    parts = parts.withColumns({"n_symbols": F.length(marks), "n_exclaim": F.length("marks") - F.length(marks)})
    names = ("w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "w.n_distinct", "l.n_lines", "n_exclaim", "n_upper", "n_letters", "n_clusters", "n_stops")
    return parts.select("doc_id", "row_key", *(F.col(c).cast("long").alias(c.split(".")[-1]) for c in names))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, dict[str, Column]]:
    """The votes over statistics(), by the defect that they look for. Between the two limits of a rule it abstains."""
    n, chars = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))
    kinds, most = 100 * F.col("n_distinct"), F.least(n, F.lit(400))
    return {
        "marks": {
            "symbols": _vote(20 * F.col("n_symbols") > n, 100 * F.col("n_symbols") <= n),
            "letters": _vote(100 * F.col("n_letters") < 88 * chars, 100 * F.col("n_letters") >= 93 * chars),
            "clusters": _vote(20 * F.col("n_clusters") > n, 50 * F.col("n_clusters") <= n),
        },
        "repetition": {
            "windows": _vote(100 * F.col("n_repeat_words") > 15 * n, 20 * F.col("n_repeat_words") <= n),
            "lines": _vote(5 * F.col("n_dup_lines") > F.col("n_lines"), 20 * F.col("n_dup_lines") <= F.col("n_lines")),
            "variety": _vote(kinds < 45 * most, kinds > 60 * most),
        },
        "shouting": {
            "capitals": _vote(10 * F.col("n_upper") > chars, 20 * F.col("n_upper") <= chars),
            "exclaim": _vote(20 * F.col("n_exclaim") > n, 100 * F.col("n_exclaim") <= n),
            "stops": _vote(100 * F.col("n_stops") > 40 * n, 4 * F.col("n_stops") <= n),
        },
    }


#: Where estimation starts, and what the start weighs against the data, in documents.
SHARE, FOUND, ALARM, WEIGHT = 0.1, 0.7, 0.05, 2.0


@dataclass
class Estimate:
    """Of one defect: the share of documents that have it, and of each rule how often its vote is bad on documents with it (found) and without (alarm)."""

    share: float
    found: list[float]
    alarm: list[float]

    def posterior(self, votes: tuple[int, ...]) -> float:
        """Probability of the defect."""
        odds = math.log(self.share / (1 - self.share))
        for v, f, a in zip(votes, self.found, self.alarm):
            odds += math.log(f / a) if v < 0 else math.log((1 - f) / (1 - a)) if v > 0 else 0.0
        return 1 / (1 + math.exp(-odds)) if odds > -700 else 0.0


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 5000, tolerance: float = 1e-9) -> Estimate:
    """Share and accuracies by expectation-maximisation over vote patterns and their counts.

    Start values weigh as much as WEIGHT documents, whatever the number of documents; with no patterns they are returned.
    """
    now = Estimate(SHARE, [FOUND] * n_rules, [ALARM] * n_rules)
    for _ in range(rounds if patterns else 0):
        weighed = [(votes, n, n * now.posterior(votes)) for votes, n in patterns]

        def rate(rule: int, start: float, mass) -> float:
            bad = sum(mass(n, x) for votes, n, x in weighed if votes[rule] < 0)
            return (bad + WEIGHT * start) / (sum(mass(n, x) for votes, n, x in weighed if votes[rule]) + WEIGHT)

        total = sum(n for _, n in patterns)
        new = Estimate(
            (sum(x for _, _, x in weighed) + WEIGHT * SHARE) / (total + WEIGHT),
            [rate(r, FOUND, lambda n, x: x) for r in range(n_rules)],
            [rate(r, ALARM, lambda n, x: n - x) for r in range(n_rules)],
        )
        moved = max(abs(x - y) for x, y in zip([new.share, *new.found, *new.alarm], [now.share, *now.found, *now.alarm]))
        now = new
        if moved < tolerance:
            break
    return now


def _defect(votes: list[str], found: Estimate) -> Column:
    """Probability of a defect, as a Column over the columns of votes on it: looked up by their code."""
    odds = [F.lit(found.posterior(v)) for v in product((-1, 0, 1), repeat=len(votes))]
    code = F.lit(0)
    for v in votes:
        code = 3 * code + F.col(v) + 1
    return F.get(F.array(*odds), code)


def estimates(voted: DataFrame) -> dict[str, Estimate]:
    """By defect its Estimate, from rows with a column `vote_<rule>` for each rule; a count a vote pattern reaches the driver, 3 ** rules at most."""
    named = rules()
    votes = [f"vote_{k}" for of in named.values() for k in of]
    patterns, out, at = voted.groupBy(*votes).agg(F.count("*").alias("n")).collect(), {}, 0
    for defect, of in named.items():
        counts: Counter = Counter()
        for r in patterns:
            counts[tuple(r[at : at + len(of)])] += r[-1]
        out[defect] = estimate(sorted(counts.items()), len(of))
        at += len(of)
    return out


def judge(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """statistics() with base_failed, posterior (of being good) and kept for every row.

    base_failed: fewer than 50 words, or over half of the words repeated. kept: not base_failed and a
    posterior of at least `threshold`. Null, empty and blank texts have no words and so fail. Repeated
    rows are judged each; extra columns are ignored; an empty table gives an empty result.
    """
    named = rules()
    stats = cut_lineage(statistics(documents))
    voted = stats.withColumns({f"vote_{k}": v for votes in named.values() for k, v in votes.items()})
    found = estimates(voted)
    none = F.lit(1.0)
    for defect, votes in named.items():
        none = none * (1 - _defect([f"vote_{k}" for k in votes], found[defect]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = voted.withColumn("base_failed", failed).withColumn("posterior", none)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).drop(*(f"vote_{k}" for votes in named.values() for k in votes))


def keep_good(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of `documents`, all columns kept, that judge() keeps."""
    bad = judge(documents, threshold).where("not kept").select(F.col("row_key").alias("_row_key"))
    return without_rows(documents, bad, F.xxhash64(documents["doc_id"].cast("long"), F.coalesce(documents["text"].cast("string"), F.lit(""))))
