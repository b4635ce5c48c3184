"""Rulesets: loading, validation, dependency order, and compiling each rule to one Column of statuses.

A rule goes through date and status filter, scope, applicability, exemptions and requirements, in that
order; each stage is a branch of one expression, so a ruleset over any number of subjects is a single
projection, and the roll-up one aggregation.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.operators.conditions import ALIASES, LEAVES, Compiled, Evidence, RuleConfigurationError, compile_calculation, compile_condition

PASS, FAIL, UNCERTAIN, EXEMPTED, NOT_APPLICABLE, NOT_CONSIDERED, ENGINE_ERROR = "PASS", "FAIL", "UNCERTAIN", "EXEMPTED", "NOT_APPLICABLE", "NOT_CONSIDERED", "ENGINE_ERROR"
INACTIVE = ("not_implemented", "not_considered", "superseded")


@dataclass
class Rule:
    rule_id: str
    version: str = "1"
    severity: str = "major"
    status: str = "active"
    effective_from: str | None = None
    effective_to: str | None = None
    applies_to: dict[str, list[str]] = field(default_factory=dict)
    applicability: dict | None = None
    exemptions: list[dict] = field(default_factory=list)
    derived: list[dict] = field(default_factory=list)
    requirements: list[dict] = field(default_factory=list)
    condition: dict | None = None
    depends_on: list[str] = field(default_factory=list)
    extra: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, d: dict) -> Rule:
        known = {k: v for k, v in d.items() if k in cls.__dataclass_fields__ and v is not None}
        return cls(**known, extra={k: v for k, v in d.items() if k not in cls.__dataclass_fields__})


def load_ruleset(text: str) -> list[Rule]:
    found = json.loads(text)
    return [Rule.from_dict(r) for r in (found["rules"] if isinstance(found, dict) else found)]


def _walk(node):
    if isinstance(node, dict):
        yield node
        for k in ("args", "conditions"):
            for x in node.get(k, []):
                yield from _walk(x)
        if isinstance(node.get("condition"), dict):
            yield from _walk(node["condition"])


def validate(rules: list[Rule]) -> list[str]:
    """Every problem found; an empty list for a sound ruleset."""
    ids, out = [r.rule_id for r in rules], []
    out += [f"duplicate rule id {i}" for i in sorted({i for i in ids if ids.count(i) > 1})]
    for r in rules:
        trees = [r.applicability, r.condition, *(x.get("condition", x) for x in r.exemptions), *(x.get("condition") for x in r.requirements)]
        for node in (n for t in trees for n in _walk(t)):
            op = ALIASES.get(node.get("op"), node.get("op"))
            if op not in LEAVES | {"and", "or", "not"}:
                out.append(f"{r.rule_id}: unknown operator {op}")
            if op == "between" and node.get("min") is None and node.get("max") is None:
                out.append(f"{r.rule_id}: between without a bound")
            if op == "regex":
                try:
                    re.compile(str(node.get("pattern", node.get("value"))))
                except re.error:
                    out.append(f"{r.rule_id}: bad pattern")
        try:
            a, b = (date.fromisoformat(x) if x else None for x in (r.effective_from, r.effective_to))
            if a and b and b <= a:
                out.append(f"{r.rule_id}: effective dates inverted")
        except ValueError:
            out.append(f"{r.rule_id}: bad date")
        out += [f"{r.rule_id}: depends on itself" for d in r.depends_on if d == r.rule_id]
        out += [f"{r.rule_id}: unknown dependency {d}" for d in r.depends_on if d not in ids]
    try:
        dependency_order(rules)
    except RuleConfigurationError as e:
        out.append(str(e))
    return out


def dependency_order(rules: list[Rule]) -> list[Rule]:
    """Rules after all that they depend on, otherwise in their order; a cycle is reported as a chain. Rules may share an id."""
    by: dict[str, list[Rule]] = {}
    for r in rules:
        by.setdefault(r.rule_id, []).append(r)
    out, done, open_ = [], set(), []

    def visit(r: Rule) -> None:
        if id(r) in done:
            return
        if any(x is r for x in open_):
            at = next(i for i, x in enumerate(open_) if x is r)
            raise RuleConfigurationError("dependency cycle " + " -> ".join(x.rule_id for x in [*open_[at:], r]))
        open_.append(r)
        for d in r.depends_on:
            for other in by.get(d, []):
                visit(other)
        open_.pop()
        done.add(id(r))
        out.append(r)

    for r in rules:
        visit(r)
    return out


def merge_rulesets(*rulesets: list[Rule]) -> list[Rule]:
    """All rules in turn; repeated ids are left for validate() to find."""
    return [r for rules in rulesets for r in rules]


def _scope(rule: Rule, e: Evidence) -> Column:
    """True, false, or null where the context doesn't say."""
    value = F.lit(True)
    for key, allowed in rule.applies_to.items():
        if "all" not in [str(a).lower() for a in allowed]:
            seen = F.lower(e.context[key].cast("string")) if key in e.context else F.lit(None).cast("string")
            value = value & seen.isin([str(a).lower() for a in allowed])
    return value


def compile_rule(rule: Rule, e: Evidence, as_of: Column | None = None) -> tuple[Column, Column]:
    """Status and missing evidence (array of paths) of one rule. A null `as_of` means no date filter, so the rule's own status counts."""
    applicable = compile_condition(rule.applicability, e)
    exempt = [compile_condition(x.get("condition", x), e) for x in rule.exemptions]
    parts = [compile_condition(x.get("condition"), e) for x in rule.requirements] or ([compile_condition(rule.condition, e)] if rule.condition else [])
    either = lambda cs, pick: F.lit(False) if not cs else _any([pick(c) for c in cs])
    in_force = F.lit(True)
    if as_of is not None:
        if rule.effective_from:
            in_force = in_force & (as_of >= F.lit(rule.effective_from).cast("date"))
        if rule.effective_to:
            in_force = in_force & (as_of < F.lit(rule.effective_to).cast("date"))
    idle = F.lit(rule.status in INACTIVE)
    dormant = F.when(as_of.isNull(), idle).otherwise(~in_force) if as_of is not None else idle
    scope = _scope(rule, e)
    failed, unsure = either(parts, lambda c: F.coalesce(~c.value, F.lit(False))), either(parts, lambda c: c.value.isNull())
    status = (
        F.when(dormant | F.lit(not parts), NOT_CONSIDERED)
        .when(scope.isNull(), UNCERTAIN)
        .when(~scope, NOT_APPLICABLE)
        .when(applicable.error, ENGINE_ERROR)
        .when(applicable.value.isNull(), UNCERTAIN)
        .when(~applicable.value, NOT_APPLICABLE)
        .when(either(exempt, lambda c: c.error), ENGINE_ERROR)
        .when(either(exempt, lambda c: F.coalesce(c.value, F.lit(False))), EXEMPTED)
        .when(either(parts, lambda c: c.error), ENGINE_ERROR)
        .when(failed, FAIL)
        .when(unsure, UNCERTAIN)
        .otherwise(PASS)
    )
    paths = sorted({f for c in [applicable, *exempt, *parts] for f in c.fields})
    gaps = F.array_compact(F.array(*(F.when(e.observed(p).isNull(), F.lit(p)) for p in paths))) if paths else F.array().cast("array<string>")
    return status, gaps


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def _reads(rule: Rule) -> set[str]:
    """Paths that a rule's conditions and calculations look at."""
    trees = [rule.applicability, rule.condition, *(x.get("condition", x) for x in rule.exemptions), *(x.get("condition") for x in rule.requirements), *(d["calc"] for d in rule.derived)]
    return {node[k] for t in trees for node in _walk(t) for k in ("field", "value_field", "values_field") if k in node} | set(rule.applies_to)


def statuses(subjects: DataFrame, key: str, rules: list[Rule], e: Evidence, as_of: Column | None = None, lenient: bool = False) -> tuple[DataFrame, list[Rule]]:
    """One row per row of `subjects`: the key, and for the i-th of the returned rules its status `_status{i}` and missing evidence `_gaps{i}`.

    Derived values become context paths `computed.<name>`, and each rule's status `rule_results.<id>.status`, for later rules: they are columns of a
    projection before, so a chain of rules grows the plan by one projection a link. Numeric context stays numeric. With `lenient`, a rule that can't be
    compiled, or depends on an unknown one, has the status ENGINE_ERROR instead of failing the whole set.
    """
    if (problems := validate(rules)) and not lenient:
        raise RuleConfigurationError("; ".join(problems))
    known = {r.rule_id for r in rules}
    at = {f"_field{i}": (p, c) for i, (p, c) in enumerate(e.fields.items())} | {f"_context{i}": (p, c) for i, (p, c) in enumerate(e.context.items())}
    frame = subjects.select(F.col(key), *(c.alias(n) for n, (_, c) in at.items()), *([as_of.alias("_as_of")] if as_of is not None else []))
    view = Evidence({p: F.col(n) for n, (p, _) in at.items() if n.startswith("_field")}, {p: F.col(n) for n, (p, _) in at.items() if n.startswith("_context")}, e.min_confidence).typed(frame)
    ordered, pending, waiting = dependency_order(rules), {}, set()
    for i, rule in enumerate(ordered):
        if waiting & _reads(rule):
            frame, pending, waiting = frame.withColumns(pending), {}, set()
        try:
            for j, d in enumerate(rule.derived):
                path, name = f"computed.{d['name']}", f"_computed{i}_{j}"
                if any(node.get("field") in waiting for node in _walk(d["calc"])):
                    frame, pending, waiting = frame.withColumns(pending), {}, set()
                pending[name], view.context[path] = compile_calculation(d["calc"], view)[0], F.col(name)
                view.numeric.add(path)
                waiting.add(path)
            if waiting & _reads(rule) or any(f"computed.{d['name']}" in waiting for d in rule.derived):
                frame, pending, waiting = frame.withColumns(pending), {}, set()
            if unknown := [d for d in rule.depends_on if d not in known]:
                raise RuleConfigurationError(f"unknown dependency {unknown[0]}")
            status, gaps = compile_rule(rule, view, F.col("_as_of") if as_of is not None else None)
        except (RuleConfigurationError, KeyError, ValueError):
            if not lenient:
                raise
            status, gaps = F.lit(ENGINE_ERROR), F.array().cast("array<string>")
        pending |= {f"_status{i}": status, f"_gaps{i}": gaps}
        path = f"rule_results.{rule.rule_id}.status"
        view.context[path] = F.col(f"_status{i}")
        waiting.add(path)
    return frame.withColumns(pending).select(key, *(f"_{c}{i}" for i in range(len(ordered)) for c in ("status", "gaps"))), ordered


def evaluate(subjects: DataFrame, key: str, rules: list[Rule], e: Evidence, as_of: Column | None = None, lenient: bool = False) -> DataFrame:
    """One row per subject and rule: key, rule_id, rule_version, severity, status, missing_evidence. See statuses()."""
    frame, ordered = statuses(subjects, key, rules, e, as_of, lenient)
    each = frame.withColumn("_rule", F.explode(F.array(*(F.lit(i) for i in range(len(ordered)))))) if ordered else frame.withColumn("_rule", F.lit(0)).limit(0)

    def pick(of, kind="string"):
        out = F.lit(None).cast(kind)
        for i in reversed(range(len(ordered))):
            out = F.when(F.col("_rule") == i, of(i)).otherwise(out)
        return out

    return each.select(
        key,
        pick(lambda i: F.lit(ordered[i].rule_id)).alias("rule_id"),
        pick(lambda i: F.lit(ordered[i].version)).alias("rule_version"),
        pick(lambda i: F.lit(ordered[i].severity)).alias("severity"),
        pick(lambda i: F.col(f"_status{i}")).alias("status"),
        pick(lambda i: F.col(f"_gaps{i}"), "array<string>").alias("missing_evidence"),
    )


ALL = (PASS, FAIL, UNCERTAIN, EXEMPTED, NOT_APPLICABLE, NOT_CONSIDERED, ENGINE_ERROR)


def _verdict(counts: DataFrame, exempt_counts: bool, downgrade_minor: bool) -> DataFrame:
    verdict = F.when(F.col("n_engine_error") > 0, ENGINE_ERROR).when(F.col("n_grave") > 0, FAIL).when(F.col("n_fail") > 0, UNCERTAIN if downgrade_minor else FAIL).when(F.col("n_uncertain") > 0, UNCERTAIN).when(F.col("n_pass") > 0, PASS)
    if exempt_counts:
        verdict = verdict.when(F.col("n_exempted") > 0, EXEMPTED)
    return counts.withColumn("overall_status", verdict.otherwise(NOT_APPLICABLE))


def overall(results: DataFrame, key: str, exempt_counts: bool = False, downgrade_minor: bool = False) -> DataFrame:
    """One row per subject: how many rules have each status, and the overall one (errors over failures over uncertainty over passes)."""
    grave = (F.col("status") == FAIL) & F.col("severity").isin("critical", "major")
    counts = results.groupBy(key).agg(*(F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ALL), F.count_if(grave).alias("n_grave"))
    return _verdict(counts, exempt_counts, downgrade_minor)


def overall_of_subjects(subjects: DataFrame, key: str, rules: list[Rule], e: Evidence, as_of: Column | None = None, exempt_counts: bool = False, downgrade_minor: bool = False) -> DataFrame:
    """overall(evaluate(...)), counted over status columns: rows aren't multiplied by the number of rules before the shuffle."""
    frame, ordered = statuses(subjects, key, rules, e, as_of)
    names = [f"_status{i}" for i in range(len(ordered))]
    grave = [n for n, r in zip(names, ordered) if r.severity in ("critical", "major")]
    count = lambda of, s: sum((F.count_if(F.col(n) == s) for n in of), F.lit(0).cast("long"))
    counts = frame.groupBy(key).agg(*(count(names, s).alias(f"n_{s.lower()}") for s in ALL), count(grave, FAIL).alias("n_grave"))
    return _verdict(counts, exempt_counts, downgrade_minor)


def compare_modes(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Shadow mode: rows where two engines' statuses differ or one has none."""
    other = b.withColumnRenamed("status", "other_status")
    return a.select(*keys, "status").join(other.select(*keys, "other_status"), keys, "full_outer").where(~F.col("status").eqNullSafe(F.col("other_status")))


__all__ = ["Compiled", "Evidence", "Rule", "compare_modes", "compile_rule", "dependency_order", "evaluate", "load_ruleset", "merge_rulesets", "overall", "overall_of_subjects", "statuses", "validate"]
