"""States of amendments and versions, and which texts of law may answer a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states each state may go to; none leads to ACTIVE, which needs a person's authority
TRANSITIONS = {
    "DRAFT": ["EXTRACTED", "REJECTED"],
    "EXTRACTED": ["AI_PARSED", "PENDING_REVIEW", "REJECTED"],
    "AI_PARSED": ["PENDING_REVIEW", "REJECTED"],
    "PENDING_REVIEW": ["APPROVED", "REJECTED"],
    "APPROVED": ["SCHEDULED", "REJECTED"],
    "SCHEDULED": ["REJECTED"],
    "ACTIVE": ["SUPERSEDED"],
    "SUPERSEDED": [],
    "REJECTED": [],
}


def transition(state: Column, target: Column, authorized_by: Column) -> Column:
    """Struct of outcome and the state after it. Activation is from SCHEDULED alone and names who authorized it; illegal moves leave the state."""
    legal = F.lit(False)
    for a, targets in TRANSITIONS.items():
        if targets:
            legal |= (state == a) & target.isin(targets)
    named = F.coalesce(F.trim(authorized_by) != "", F.lit(False))
    outcome = (
        F.when((target == "ACTIVE") & ~named, "AUTHORITY_MISSING")
        .when((target == "ACTIVE") & (state == "SCHEDULED"), "APPLIED")
        .when(F.coalesce(legal, F.lit(False)), "APPLIED")
        .otherwise("ILLEGAL")
    )
    return F.struct(outcome.alias("outcome"), F.when(outcome == "APPLIED", target).otherwise(state).alias("state"))


def eligible_for_activation(versions: DataFrame, as_of: Column) -> DataFrame:
    """Scheduled versions whose start has come. Nothing is activated by a date."""
    return versions.where((F.col("approval_state") == "SCHEDULED") & (F.col("effective_from") <= as_of))


def eligible_texts(texts: DataFrame, as_of: Column, modules: list[str] | None = None, department: str | None = None, jurisdiction: str | None = None, commodity: str | None = None) -> DataFrame:
    """Texts in force on a date (half-open), published (ACTIVE, or without a publication state), of the modules and places asked for.

    A criterion of None doesn't restrict; a text without a commodity answers for all of them.
    """
    same = lambda c, v: F.lower(F.col(c)) == v.lower()
    keep = F.coalesce(F.upper("publication_state") == "ACTIVE", F.lit(True)) & (F.col("effective_from") <= as_of) & F.coalesce(as_of < F.col("effective_to"), F.lit(True))
    if modules:
        keep &= F.col("module").isin(modules)
    for column, value in (("department", department), ("jurisdiction", jurisdiction)):
        if value:
            keep &= same(column, value)
    if commodity:
        keep &= F.coalesce((F.col("commodity") == "") | same("commodity", commodity), F.lit(True))
    return texts.where(keep)


def grounded(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """Each question's grounding: GROUNDED with sorted distinct citations and the best score within 0 and 1, or NOT_FOUND.

    `asked` has query_id, `hits` query_id, score and source_reference, at most a search's k a question.
    """
    met = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.array_sort(F.collect_set("source_reference")).alias("citations"), F.max("score").alias("best"))
    return asked.select("query_id").join(met, "query_id", "left").select(
        "query_id",
        F.when(F.col("n_hits") > 0, "GROUNDED").otherwise("NOT_FOUND").alias("grounding"),
        F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
        F.coalesce("citations", F.array().cast("array<string>")).alias("citations"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("best", F.lit(0.0)))).alias("confidence"),
    )


def optional_filter(rows: DataFrame, equal: dict[str, str | None], within: dict[str, str | None] | None = None, hidden: Column | None = None) -> DataFrame:
    """Rows that meet every criterion given, without regard to case; None and ALL don't restrict. `hidden` rows go."""
    for c, v in equal.items():
        if v and v.upper() != "ALL":
            rows = rows.where(F.upper(F.col(c)) == v.upper())
    for c, v in (within or {}).items():
        if v and v.upper() != "ALL":
            rows = rows.where(F.contains(F.lower(F.col(c)), F.lit(v.lower())))
    return rows if hidden is None else rows.where(~F.coalesce(hidden, F.lit(False)))
