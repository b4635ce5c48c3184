"""Rule predicates compiled to nullable booleans: NULL is "unknown", so SQL's AND, OR and NOT are Kleene's.

Evidence is one struct column a field: value, unit, confidence, present, usable. Other paths are plain
context columns. Each compiled condition also tells, in `error`, where evaluating it is a configuration
error (text in a numeric comparison, units of different dimensions, an unparseable date).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.operators import units


class RuleConfigurationError(ValueError):
    """A rule that can't be compiled."""


@dataclass
class Compiled:
    value: Column
    error: Column = field(default_factory=lambda: F.lit(False))
    fields: list[str] = field(default_factory=list)


@dataclass
class Evidence:
    """Which paths are evidence structs and which plain context columns, and the least confidence that counts."""

    fields: dict[str, Column]
    context: dict[str, Column] = field(default_factory=dict)
    min_confidence: float = 0.55
    #: Paths whose values are integers or doubles, and are compared without going through text.
    numeric: set[str] = field(default_factory=set)

    def typed(self, frame: DataFrame) -> Evidence:
        """This evidence with `numeric` filled in from the types that its columns have in `frame`."""
        values = {p: c["value"] for p, c in self.fields.items()} | self.context
        kinds = frame.select(*(c.alias(str(i)) for i, c in enumerate(values.values()))).dtypes
        return Evidence(self.fields, self.context, self.min_confidence, {p for p, (_, k) in zip(values, kinds) if k in ("double", "int", "bigint", "smallint", "tinyint")})

    def _text(self, path: str, value: Column) -> Column:
        return value if path in self.numeric else value.cast("string")

    def cell(self, path: str) -> Column | None:
        return self.fields.get(path)

    def present(self, path: str) -> Column:
        if (cell := self.cell(path)) is not None:
            return F.coalesce(cell["present"], cell["value"].isNotNull())
        return self.context[path].isNotNull() if path in self.context else F.lit(False)

    def usable(self, path: str) -> Column:
        if (cell := self.cell(path)) is not None:
            return F.coalesce(cell["usable"], self.present(path))
        return F.lit(True)

    def observed(self, path: str, least: float | None = None) -> Column:
        """The value, as text unless it is numeric, where it may be used, else null. Context has no confidence to pass."""
        if (cell := self.cell(path)) is not None:
            sure = cell["confidence"].isNull() | (cell["confidence"] >= F.lit(self.min_confidence if least is None else least))
            return F.when(self.usable(path) & self.present(path) & sure, cell["value"])
        return self._text(path, self.context[path]) if path in self.context else F.lit(None).cast("string")

    def raw(self, path: str) -> Column:
        if (cell := self.cell(path)) is not None:
            return cell["value"]
        return self._text(path, self.context[path]) if path in self.context else F.lit(None).cast("string")

    def unit(self, path: str) -> Column:
        cell = self.cell(path)
        return cell["unit"] if cell is not None else F.lit(None).cast("string")


ALIASES = {">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "==": "eq", "=": "eq", "!=": "neq", "in": "in_list", "not_in": "not_in_list"}
DATES = {"date_before": "<", "date_after": ">", "date_on_or_before": "<=", "date_on_or_after": ">="}
ORDER = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
TEXT = ("contains", "not_contains", "starts_with", "ends_with")
LEAVES = {"exists", "missing", "null", "not_null", "between", "eq", "neq", "regex", "in_list", "not_in_list", "boolean", "always", "never", *ORDER, *DATES, *TEXT}
DATE_FORMATS = ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd", ""), (r"^\d{4}-\d{2}$", "yyyy-MM-dd", "-01"), (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy", ""), (r"^\d{2}/\d{4}$", "MM/yyyy/dd", "/01"), (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss", ""))


def number(text: Column) -> Column:
    return text.try_cast("double")


def parse_date(text: Column) -> Column:
    """A date of five formats; partial dates are their first day; null if none fits."""
    out = F.lit(None).cast("date")
    for pattern, form, tail in reversed(DATE_FORMATS):
        out = F.when(text.rlike(pattern), F.try_to_timestamp(F.concat(text, F.lit(tail)), F.lit(form)).cast("date")).otherwise(out)
    return out


def _right(node: dict, e: Evidence) -> tuple[Column, Column, list[str]]:
    """What to compare with: another field, or a literal."""
    if "value_field" in node:
        return e.observed(node["value_field"], node.get("min_confidence")), e.unit(node["value_field"]), [node["value_field"]]
    v = node.get("value")
    text = None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    return F.lit(text).cast("string"), F.lit(node.get("unit")).cast("string"), []


def _aligned(a: Column, a_unit: Column, b: Column, b_unit: Column) -> tuple[Column, Column]:
    """b in a's unit, and whether that is an error; without both units as it stands."""
    apart = F.coalesce(F.lower(a_unit) != F.lower(b_unit), F.lit(False))
    return F.when(apart, units.convert(b, b_unit, a_unit)).otherwise(b), apart & ~units.compatible(a_unit, b_unit) & a.isNotNull() & b.isNotNull()


def compile_condition(node: dict | None, e: Evidence) -> Compiled:
    """Compile a condition tree. No condition is always true; an empty `and` is true, an empty `or` false."""
    if node is None:
        return Compiled(F.lit(True))
    op = ALIASES.get(node.get("op"), node.get("op"))
    if op in ("and", "or", "not"):
        args = [compile_condition(x, e) for x in node.get("args", node.get("conditions", [node["condition"]] if "condition" in node else []))]
        value = F.lit(op != "or")
        error = F.lit(False)
        for a in args:
            value = (value | a.value) if op == "or" else (value & a.value)
            error = error | a.error
        return Compiled(~value if op == "not" else value, error, [f for a in args for f in a.fields])
    if op not in LEAVES:
        raise RuleConfigurationError(f"unknown operator {op!r}")
    if op in ("always", "never"):
        return Compiled(F.lit(op == "always"))
    path = node.get("field")
    if path is None:
        raise RuleConfigurationError(f"{op} needs a field")
    if op in ("exists", "missing"):
        found = F.when(~e.present(path), F.lit(False)).when(~e.usable(path), F.lit(None)).otherwise(F.lit(True)).cast("boolean")
        return Compiled(found if op == "exists" else ~found, fields=[path])
    if op in ("null", "not_null"):
        none = e.raw(path).isNull()
        return Compiled(none if op == "null" else ~none, fields=[path])
    seen = e.observed(path, node.get("min_confidence"))
    fields = [path]
    if op == "boolean":
        want = bool(node.get("value", True))
        n = number(seen)
        truth = F.when(seen.isNull(), F.lit(None)).when(n.isNotNull(), n != 0).otherwise(F.length(seen) > 0).cast("boolean")
        return Compiled(truth if want else ~truth, fields=fields)
    if op in ("in_list", "not_in_list"):
        if "values_field" in node:
            items = F.transform(F.split(e.observed(node["values_field"]), ","), lambda x: F.lower(F.trim(x)))
            found = F.array_contains(items, F.lower(F.trim(seen)))
        else:
            values = node.get("values", node.get("value"))
            if not isinstance(values, list):
                raise RuleConfigurationError(f"{op} needs a list")
            found = F.lower(F.trim(seen)).isin([str(v).strip().lower() for v in values]) if values else F.when(seen.isNotNull(), F.lit(False))
        return Compiled(found if op == "in_list" else ~found, fields=fields)
    if op == "regex":
        return Compiled(F.rlike(seen, F.lit("(?U)" + str(node.get("pattern", node.get("value"))))), fields=fields)
    if op == "between":
        n, unit, error, value = number(seen), e.unit(path), seen.isNotNull() & number(seen).isNull(), F.lit(True)
        if node.get("min") is None and node.get("max") is None:
            raise RuleConfigurationError("between needs a bound")
        if node.get("unit"):
            n, wrong = _aligned(F.lit(0.0), F.lit(node["unit"]), n, unit)
            error = error | wrong
        for key, inclusive, open_ in (("min", lambda a, b: a >= b, lambda a, b: a > b), ("max", lambda a, b: a <= b, lambda a, b: a < b)):
            if node.get(key) is not None:
                value = value & (inclusive if node.get(f"{key}_inclusive", True) else open_)(n, F.lit(float(node[key])))
        return Compiled(value, error, fields)
    right, right_unit, more = _right(node, e)
    fields += more
    if op in TEXT:
        a, b = (seen, right) if node.get("case_sensitive") else (F.lower(seen), F.lower(right))
        found = {"starts_with": F.startswith, "ends_with": F.endswith}.get(op, F.contains)(a, b)
        return Compiled(~found if op == "not_contains" else found, fields=fields)
    if op in DATES:
        a, b = parse_date(seen), parse_date(right)
        sign = DATES[op]
        value = a < b if sign == "<" else a > b if sign == ">" else a <= b if sign == "<=" else a >= b
        return Compiled(value, (seen.isNotNull() & a.isNull()) | (right.isNotNull() & b.isNull()), fields)
    a, b = number(seen), number(right)
    aligned, wrong = _aligned(a, e.unit(path), b, right_unit)
    if op in ORDER:
        text = (seen.isNotNull() & a.isNull()) | (right.isNotNull() & b.isNull())
        return Compiled(ORDER[op](a, aligned), text | wrong, fields)
    numeric = a.isNotNull() & b.isNotNull()
    left_text, right_text = (F.trim(seen), F.trim(right)) if node.get("case_sensitive") else (F.lower(F.trim(seen)), F.lower(F.trim(right)))
    same = F.when(seen.isNull() | right.isNull(), F.lit(None)).when(numeric, F.abs(a - aligned) <= F.lit(float(node.get("tolerance", 0)))).otherwise(left_text == right_text).cast("boolean")
    return Compiled(same if op == "eq" else ~same, numeric & wrong, fields)


def compile_calculation(node: dict, e: Evidence) -> tuple[Column, Column]:
    """(value, unit) of a calculation tree; null where an input is missing, a divisor zero or units don't fit."""
    op = node.get("op")
    if op == "const":
        return F.lit(float(node["value"])), F.lit(node.get("unit")).cast("string")
    if op == "field":
        return number(e.raw(node["field"])), e.unit(node["field"])
    args = [compile_calculation(x, e) for x in node.get("args", [])]
    if op in ("add", "sub", "mul", "div"):
        if len(args) != 2:
            raise RuleConfigurationError(f"{op} takes two arguments")
        (a, ua), (b, ub) = args
        if op in ("add", "sub"):
            b, _ = _aligned(a, ua, b, ub)
            return (a + b if op == "add" else a - b), F.coalesce(ua, ub)
        return (a * b, F.coalesce(ua, ub)) if op == "mul" else (F.try_divide(a, F.nullif(b, F.lit(0.0))), ua)
    if op == "percent_diff":
        (o, uo), (x, ux) = args
        o, _ = _aligned(x, ux, o, uo)
        return F.try_divide(o - x, F.nullif(x, F.lit(0.0))) * 100, F.lit("%")
    if op == "abs":
        return F.abs(args[0][0]), args[0][1]
    if op == "convert_unit":
        value, unit = args[0]
        return units.convert(value, F.coalesce(unit, F.lit(node.get("from")).cast("string")), F.lit(node["to"])), F.lit(node["to"])
    raise RuleConfigurationError(f"unknown calculation {op!r}")
