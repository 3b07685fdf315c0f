"""Cell rules as column predicates, their gates, and the first violation of each cell."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions import cells as C

#: Forms of a date, loose on purpose, and other names of the logical types (fixed values).
DATE = r"\d{1,4}[-/.]\d{1,2}([-/.]\d{1,4})?([ T].*)?"
TYPES = {"bool": "bool", "boolean": "bool", "int": "int", "integer": "int", "float": "float", "numeric": "float", "number": "float", "date": "date"}
BOOLEANS = ("true", "false", "yes", "no", "y", "n", "t", "f", "1", "0")


@dataclass(frozen=True)
class Rule:
    """kind: regex, value_set, length, numeric_range, logical_type or not_null (noted, never enforced)."""

    column: str
    kind: str
    spec: dict[str, Any] = field(default_factory=dict)
    error_type: str = "FI"
    name: str = ""

    @property
    def label(self) -> str:
        return self.name or f"{self.kind}:{self.column}"


def violates(rule: Rule, blank: Column | None = None) -> Column | None:
    """Whether a cell that isn't blank breaks the rule; null for a rule without effect. blank: a column that says so, if there."""
    v, s = F.col(rule.column), rule.spec
    if rule.kind == "regex" and s.get("pattern"):
        bad = ~C.starts_with_match(v, s["pattern"])
    elif rule.kind == "value_set" and s.get("values"):
        bad = ~v.isin(*map(str, s["values"]))
    elif rule.kind == "length" and set(s) & {"fixed", "min", "max"}:
        tests = [F.length(v) != s["fixed"] if "fixed" in s else None, F.length(v) < s["min"] if "min" in s else None, F.length(v) > s["max"] if "max" in s else None]
        bad = _any([t for t in tests if t is not None])
    elif rule.kind == "numeric_range" and set(s) & {"min", "max"}:
        x = F.when(C.is_float(v), F.regexp_replace(C.stripped(v), "_", "").try_cast("double"))
        bad = F.coalesce(_any([t for t in (x < s["min"] if "min" in s else None, x > s["max"] if "max" in s else None) if t is not None]), F.lit(False))
    elif rule.kind == "logical_type" and str(s.get("type", "")).strip().lower() in TYPES:
        t = C.stripped(v)
        ok = {"bool": F.lower(t).isin(*BOOLEANS), "int": t.rlike(r"^[-+]?\d+(?:_\d+)*$"), "float": C.is_float(v) | F.lower(t).rlike(r"^[-+]?(inf|infinity|nan)$"), "date": C.full_match(t, DATE)}
        bad = ~ok[TYPES[str(s["type"]).strip().lower()]]
    else:
        return None
    return ~(C.is_blank(v) if blank is None else blank) & bad


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _flagged(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with a flag for each column, so that each cell is tested for blanks once."""
    return df.select("*", *(C.is_blank(F.col(c)).alias(f"_blank_{c}") for c in columns))


def violation_rates(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule, violations, rows, rate: all rules in one pass; blank cells are in the denominator."""
    flagged = _flagged(df, list(dict.fromkeys(r.column for r in rules)))
    compiled = [(r, p) for r in rules if (p := violates(r, F.col(f"_blank_{r.column}"))) is not None]
    sums = flagged.agg(F.count("*").alias("rows"), *(F.sum(F.coalesce(p, F.lit(False)).cast("long")).alias(f"v{i}") for i, (_, p) in enumerate(compiled)))
    each = F.array(*(F.struct(F.lit(r.label).alias("rule"), F.col(f"v{i}").alias("violations")) for i, (r, _) in enumerate(compiled)))
    return sums.select("rows", F.inline(each)).select("rule", "violations", "rows", (F.col("violations") / F.col("rows")).alias("rate"))


def gated(df: DataFrame, rules: list[Rule], most: float = 0.3) -> list[Rule]:
    """The rules that no more than a share of rows break; one row comes to the driver for each rule."""
    rates = {r["rule"]: r["rate"] or 0.0 for r in violation_rates(df, rules).collect()}
    return [r for r in rules if rates.get(r.label, 0.0) <= most]


def is_free_text(n_rows: int, top5: float, n_patterns: int, dominant: float, numeric: bool) -> bool:
    """Whether a column's profile shows no structure that a regex may rely on."""
    return not (numeric or (top5 >= 0.5 and n_patterns <= 30) or dominant >= 0.7)


def first_violations(df: DataFrame, rules: list[Rule], nullable: frozenset[str] = frozenset()) -> DataFrame:
    """Of each cell the first rule that it breaks, missing values first. One pass, no join."""
    columns = [c for c in df.columns if c != "row_id"]
    found = []
    for column in columns:
        v, blank = F.col(column), F.col(f"_blank_{column}")
        hit = lambda kind, name: F.struct(F.lit(kind).alias("error_type"), F.lit(name).alias("rule"))
        case = F.when(blank, hit("MV", "missing_value")) if column not in nullable else F.when(F.lit(False), hit("MV", ""))
        for r in rules:
            if r.column == column and (bad := violates(r, blank)) is not None:
                case = case.when(bad, hit(r.error_type, r.label))
        found.append(F.struct(F.lit(column).alias("column"), v.cast("string").alias("value"), case.alias("hit")))
    out = _flagged(df, columns).select("row_id", F.inline(F.array(*found))).where("hit is not null")
    return out.select("row_id", "column", "value", "hit.error_type", "hit.rule")
