"""A declarative constraint program over one table, compiled to plans that give three-valued evidence.

Each constraint, row and target gives one row of evidence: violation, check_passed or abstain.
"""

from __future__ import annotations

import ast
import hashlib
import itertools
import json
import re
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions import cells as C
from tablewarden.plans.tables import counted

from .anomalies import parsed_date
from .dependencies import arithmetic

#: Family of each operator (fixed values).
FAMILY = {"missing": "missing", "dmv": "missing", "duplicate": "format", "normalize": "semantic", "regex": "format", "type": "format", "range": "domain", "statistical": "statistical", "fd": "relation", "neighbor": "neighbor", "compare": "relation", "temporal": "relation", "arithmetic": "relation"}
ERROR_TYPE = {"missing": "MV", "dmv": "DMV", "format": "FI", "semantic": "FI", "domain": "FI", "statistical": "OTHER", "relation": "VAD", "neighbor": "OTHER"}
PARAMS = {"missing": set(), "dmv": {"tokens"}, "duplicate": set(), "normalize": {"mapping", "strip", "case"}, "regex": {"pattern"}, "type": {"type"}, "range": {"min", "max", "unit"}, "statistical": {"z"}, "fd": {"min_support", "confidence"}, "neighbor": {"min_support", "confidence"}, "compare": set(), "temporal": set(), "arithmetic": {"expression", "tolerance"}}
EVIDENCE = ("row_id", "column", "constraint_id", "source_group", "family", "status", "score", "error_type", "suggested_fix", "support", "reliability")
#: Placeholders by default, and the order in which constraints are kept (fixed values).
TOKENS = ("unknown", "missing", "?", "not available", "unspecified")
PRIORITY = {"missing": 0, "range": 1, "normalize": 2, "regex": 3, "fd": 4, "arithmetic": 4, "compare": 4, "temporal": 4, "type": 5, "dmv": 6, "duplicate": 7, "statistical": 8, "neighbor": 9}


@dataclass(frozen=True)
class Constraint:
    operator: str
    participants: tuple[str, ...]
    targets: tuple[str, ...]
    conditions: tuple[tuple[str, str], ...] = ()
    params: dict[str, Any] = field(default_factory=dict)
    source: str = "local"

    def __post_init__(self):
        if self.operator not in FAMILY:
            raise ValueError(f"unknown operator {self.operator}")
        if not 1 <= len(self.participants) <= 4 or len(self.conditions) > 2:
            raise ValueError("one to four participants and at most two conditions")
        if not self.targets or not set(self.targets) <= set(self.participants):
            raise ValueError("targets must be participants")
        if extra := set(self.params) - PARAMS[self.operator]:
            raise ValueError(f"unknown parameters {sorted(extra)}")
        if self.operator in ("fd", "neighbor", "compare", "temporal") and len(self.participants) < 2:
            raise ValueError(f"{self.operator} needs two participants")
        if self.operator == "regex":
            pattern = self.params.get("pattern", "")
            if not pattern or len(pattern) > 128 or re.search(r"[()|]", pattern):
                raise ValueError("patterns have up to 128 characters, without groups or alternatives")
            re.compile(pattern)
        if self.operator == "arithmetic":
            allowed = (ast.Expression, ast.BinOp, ast.UnaryOp, ast.Name, ast.Load, ast.Constant, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.USub, ast.UAdd)
            tree = ast.parse(self.params.get("expression", ""), mode="eval")
            if any(not isinstance(n, allowed) for n in ast.walk(tree)) or {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} - set(self.participants):
                raise ValueError("expressions have + - * / over participants alone")

    @property
    def id(self) -> str:
        body = {k: v for k, v in asdict(self).items() if k != "source"}
        return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:16]


def program_to_json(program: list[Constraint]) -> str:
    return json.dumps([asdict(c) for c in program], sort_keys=True)


def program_from_json(text: str) -> list[Constraint]:
    return [Constraint(c["operator"], tuple(c["participants"]), tuple(c["targets"]), tuple(map(tuple, c.get("conditions", ()))), c.get("params", {}), c.get("source", "local")) for c in json.loads(text)]


def merged(programs: list[list[Constraint]], most: int = 96, per_target: int = 6) -> list[Constraint]:
    """All constraints once, by PRIORITY, up to `most`, and `per_target` for each target."""
    seen, used, out = set(), {}, []
    for c in sorted((c for p in programs for c in p), key=lambda c: (PRIORITY[c.operator], c.id)):
        if c.id in seen or len(out) >= most or any(used.get(t, 0) >= per_target for t in c.targets):
            continue
        seen.add(c.id)
        out.append(c)
        for t in c.targets:
            used[t] = used.get(t, 0) + 1
    return out


def _own_checks(c: Constraint, target: str) -> tuple[Column, Column]:
    """(violated, suggested fix) of operators that look at one row; null violated abstains."""
    v, p, none = F.col(target), c.params, F.lit(None).cast("string")
    if c.operator == "missing":
        return C.is_blank(v), none
    blank = C.is_blank(v)
    bad, fix = F.lit(None).cast("boolean"), none
    if c.operator == "dmv":
        bad, fix = F.lower(C.stripped(v)).isin(*p.get("tokens", TOKENS)), F.lit("")
    elif c.operator == "duplicate":
        parts = F.transform(F.split(v, ","), C.stripped)
        bad = (F.size(parts) > 1) & (F.get(parts, F.lit(0)) != "") & (F.size(F.array_distinct(parts)) == 1)
        fix = F.get(parts, F.lit(0))
    elif c.operator == "normalize":
        fix = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in p["mapping"].items() for x in pair)), v), v) if p.get("mapping") else v
        fix = C.stripped(fix) if p.get("strip") else fix
        fix = {"lower": F.lower, "upper": F.upper, "title": F.initcap}.get(p.get("case"), lambda x: x)(fix)
        bad = fix != v
    elif c.operator == "regex":
        bad = F.when(F.length(v) <= 512, ~C.full_match(v, p["pattern"]))
    elif c.operator == "type":
        t, x = C.stripped(v), C.number_with_unit(v)["x"]
        bad = {"numeric": x.isNull(), "integer": x.isNull() | (x != F.floor(x)), "boolean": ~F.lower(t).isin("true", "false", "yes", "no", "0", "1"), "date": parsed_date(t).isNull()}[p.get("type", "numeric")]
    elif c.operator == "range":
        n = C.number_with_unit(v)
        unit = n["unit"] == p["unit"] if "unit" in p else F.lit(True)
        low = n["x"] < p["min"] if "min" in p else F.lit(False)
        high = n["x"] > p["max"] if "max" in p else F.lit(False)
        bad = F.when(n.isNotNull() & unit, low | high)
    elif c.operator in ("compare", "temporal"):
        a, b = (F.col(x) for x in c.participants[:2])
        if c.operator == "compare":
            bad = C.once(C.number_with_unit(a), lambda x: C.once(C.number_with_unit(b), lambda y: F.when(x["unit"] == y["unit"], x["x"] > y["x"])))
        else:
            bad = parsed_date(a) > parsed_date(b)
    elif c.operator == "arithmetic":
        gap = arithmetic(p["expression"], {x: C.number_with_unit(F.col(x))["x"] for x in c.participants})
        bad = F.abs(gap) > p.get("tolerance", 1e-6)
    return F.when(~blank, bad), fix


def _in_scope(c: Constraint) -> Column:
    return reduce(lambda a, x: a & F.coalesce(F.col(x[0]) == x[1], F.lit(False)), c.conditions, F.lit(True))


def _evidence(df: DataFrame, c: Constraint, target: str, bad: Column, fix: Column, support: Column, abstaining: bool = False) -> DataFrame:
    """The check itself is a column of its own, so that it runs once."""
    df = df.select("row_id", bad.alias("_bad"), fix.alias("_fix"), support.cast("long").alias("_support"))
    return df.select("row_id", *_fields(c, target, F.col("_bad"), F.col("_fix"), F.col("_support"), abstaining))


def _fields(c: Constraint, target: str, bad: Column, fix: Column, support: Column, abstaining: bool = False) -> list[Column]:
    """EVIDENCE but for row_id. abstaining: whether a check that abstains has support."""
    status = F.when(bad.isNull(), "abstain").when(bad, "violation").otherwise("check_passed")
    n = F.coalesce(support if abstaining else F.when(bad.isNotNull(), support), F.lit(0).cast("long"))
    kind = "DMV" if c.operator == "dmv" else ERROR_TYPE[FAMILY[c.operator]]
    return [
        F.lit(target).alias("column"), F.lit(c.id).alias("constraint_id"), F.lit(f"{c.operator}:{c.id}").alias("source_group"), F.lit(FAMILY[c.operator]).alias("family"), status.alias("status"),
        F.when(bad, 0.9).otherwise(0.0).alias("score"), F.lit(kind).alias("error_type"), F.when(bad, fix).alias("suggested_fix"), n.alias("support"), F.round(F.least(F.lit(0.95), 0.5 + 0.45 * n / (n + 20)), 6).alias("reliability"),
    ]


def _own_evidence(df: DataFrame, checks: list[tuple[Constraint, str]], counts: Column, seen: Column) -> DataFrame:
    """Evidence of checks of one row, from one pass over the rows. Each check is a column of its own, so that it runs once."""
    totals = df.agg(*(F.count(F.when(_in_scope(c) & counts, F.lit(1))).alias(f"_n{i}") for i, (c, _) in enumerate(checks)))  # one row
    made = [(F.when(_in_scope(c), bad), fix) for c, t in checks for bad, fix in [_own_checks(c, t)]]
    rows = df.where(seen).join(F.broadcast(totals)).select("row_id", *(x for i, (bad, fix) in enumerate(made) for x in (bad.alias(f"_bad{i}"), fix.cast("string").alias(f"_fix{i}"), F.col(f"_n{i}"))))
    return rows.select("row_id", F.inline(F.array(*(F.struct(*_fields(c, t, F.col(f"_bad{i}"), F.col(f"_fix{i}"), F.col(f"_n{i}"))) for i, (c, t) in enumerate(checks)))))


def leave_one_out(df: DataFrame, keys: list[str], value: str, min_support: int = 3, confidence: float = 0.9, reference: Column | None = None) -> DataFrame:
    """row_id, bad, peer_top, support: whether the value differs from the mode of the other rows of its group; null abstains.

    Of each group two values are enough: the mode without this row is the first or the second. reference: of each row,
    whether it counts for the others; all do by default.
    """
    df = df.withColumn("_counts", F.lit(True) if reference is None else reference)
    rows = df.where(~C.is_blank(F.col(value)) & reduce(lambda a, k: a & ~C.is_blank(F.col(k)), keys, F.lit(True))).select("row_id", *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(value).alias("value"), "_counts")
    ks = [f"k{i}" for i in range(len(keys))]
    counts = counted(rows.where("_counts"), *ks, value="value")
    place = F.struct("n", (-F.col("first_row")).alias("f"), F.col("value").alias("v"))
    first = counts.groupBy(*ks).agg(F.max(place).alias("one"), F.sum("n").alias("size"))
    second = counts.join(first, ks).where(F.col("value") != F.col("one.v")).groupBy(*ks).agg(F.max(place).alias("two"))
    peers = first.join(second, ks, "left")
    one, two = F.col("one"), F.col("two")
    less = F.when(F.col("_counts"), 1).otherwise(0)
    left = F.when(F.col("value") == one["v"], one["n"] - less).otherwise(one["n"])
    left_two = F.coalesce(F.when(F.col("value") == two["v"], two["n"] - less).otherwise(two["n"]), F.lit(0))
    top = F.when((left > left_two) | ((left == left_two) & (one["f"] >= F.coalesce(two["f"], one["f"]))), one["v"]).otherwise(two["v"])
    n = F.greatest(left, left_two)
    support = F.col("size") - less
    known = (support >= min_support) & (n / F.nullif(support, F.lit(0)) >= confidence)
    return rows.join(peers, ks).select("row_id", F.when(known, F.col("value") != top).alias("bad"), F.when(known, top).alias("peer_top"), support.alias("support"))


def execute(df: DataFrame, program: list[Constraint], reference: Column | None = None, judged: Column | None = None) -> DataFrame:
    """Evidence of every constraint, row and target. Constraints of one row share one pass; those of groups join their counts.

    reference: of each row, whether groups, medians and totals are taken from it; judged: whether it gets evidence. Both are true by default.
    """
    flags = {"_reference": reference, "_judged": judged}
    df = df.withColumns({k: v for k, v in flags.items() if v is not None})
    counts, seen = (F.lit(True) if v is None else F.col(k) for k, v in flags.items())
    out: list[DataFrame] = []
    own: list[tuple[Constraint, str]] = []
    for c in program:
        scope = _in_scope(c)
        for target in c.targets:
            if c.operator in ("fd", "neighbor"):
                *keys, value = c.participants if c.operator == "fd" else (*(x for x in c.participants if x != target), target)
                peers = leave_one_out(df.where(scope), list(keys), value, c.params.get("min_support", 3), c.params.get("confidence", 0.9), counts)
                rows = df.where(seen).select("row_id", F.when(C.is_blank(F.col(target)), F.lit(None)).otherwise(F.lit(True)).alias("filled")).join(peers, "row_id", "left")
                bad = F.when(F.col("filled"), F.col("bad"))
                out.append(_evidence(rows, c, target, bad, F.col("peer_top") if target == value else F.lit(None).cast("string"), F.col("support"), True))
            elif c.operator == "statistical":
                x = C.number_with_unit(F.col(target))
                rows = df.select("row_id", F.when(scope & ~C.is_blank(F.col(target)), x).alias("nu"), counts.alias("_counts"), seen.alias("_seen")).select("row_id", "nu.x", "nu.unit", "_counts", "_seen")
                q = rows.where("x is not null and _counts").groupBy("unit").agg(F.percentile("x", F.lit(0.5)).alias("median"), F.stddev_pop("x").alias("sd"), F.count("*").alias("n"))
                raw = rows.where("_counts").join(F.broadcast(q), "unit").groupBy("unit").agg(F.percentile(F.abs(F.col("x") - F.col("median")), F.lit(0.5)).alias("raw"))
                s = q.join(raw, "unit").withColumn("mad", F.greatest(1.4826 * F.col("raw"), 0.1 * F.col("sd"), F.lit(1e-6)))
                far = F.abs(F.col("x") - F.col("median")) / F.col("mad") > c.params.get("z", 6)
                out.append(_evidence(rows.where("_seen").join(s, "unit", "left"), c, target, F.when(F.col("n") >= 5, far), F.col("median").cast("string"), F.col("n")))
            else:
                own.append((c, target))
    if own:
        out.append(_own_evidence(df, own, counts, seen))
    return reduce(DataFrame.unionByName, out)


def evidence_features(evidence: DataFrame) -> DataFrame:
    """Of each cell and family: mean violation score, share of checks passed, mean reliability and support (50 and more
    counting as 1), coverage and whether checks disagree. Abstentions are left out, and each source counts once."""
    said = evidence.where("status <> 'abstain'").repartition("row_id", "column")  # all that follows groups the rows of a task
    once = said.groupBy("row_id", "column", "family", "source_group").agg(F.max(F.struct("score", "reliability", "support", "status")).alias("e")).select("row_id", "column", "family", "e.*")
    bad, mean = F.col("status") == "violation", lambda x: F.round(F.avg(x), 6)
    return once.groupBy("row_id", "column", "family").agg(
        mean(F.when(bad, F.col("score")).otherwise(0.0)).alias("violation"), mean((~bad).cast("double")).alias("passed"), mean("reliability").alias("reliability"), mean(F.least(F.col("support") / 50, F.lit(1.0))).alias("support"),
        F.lit(1.0).alias("coverage"), (F.max(bad & (F.col("score") > 0)) & F.max(~bad)).cast("double").alias("disagreement"),
    )


def constraint_quality(evidence: DataFrame) -> DataFrame:
    """Of each constraint: coverage (share of cells that it judges), mean support (50 and more counting as 1), stability (1
    less four standard errors of its rate of violations) and the share of counter-evidence (column counterevidence, if there)."""
    active, bad = F.col("status") != "abstain", F.when(F.col("status") != "abstain", (F.col("status") == "violation").cast("double"))
    against = F.coalesce(F.col("counterevidence").cast("double"), F.lit(0.0)) if "counterevidence" in evidence.columns else F.lit(0.0)
    out = evidence.groupBy("constraint_id").agg(F.avg(active.cast("double")).alias("coverage"), F.avg(F.when(active, F.least(F.col("support") / 50, F.lit(1.0)))).alias("support"), F.avg(bad).alias("p"), F.count(bad).alias("n"), F.avg(F.when(active, against)).alias("counter"))
    error = F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return out.select("constraint_id", F.round("coverage", 6).alias("coverage"), *(F.round(F.coalesce(x, F.lit(0.0)), 6).alias(k) for k, x in {"support": F.col("support"), "stability": F.greatest(F.lit(0.0), 1 - 4 * error), "counterevidence": F.col("counter")}.items()))


def decisions(evidence: DataFrame, threshold: float = 0.5, low: float = 0.35, high: float = 0.65) -> DataFrame:
    """Verdict of each cell: the best score times reliability of its violations, halved if every one of them has
    counter-evidence (column counterevidence, if there). Unsure: a middling score, or fewer than two reliable families of checks."""
    bad = F.col("status") == "violation"
    against = F.coalesce(F.col("counterevidence"), F.lit(False)) if "counterevidence" in evidence.columns else F.lit(False)
    weighed = F.when(bad, F.col("score") * F.col("reliability"))
    f = evidence.where("status <> 'abstain'").groupBy("row_id", "column").agg(
        F.max(weighed).alias("raw"), F.min(F.when(bad, against)).alias("against"), F.count_distinct(F.when(F.col("reliability") >= 0.5, F.col("family"))).alias("families"),
        F.max_by(F.struct("error_type", "suggested_fix"), F.when(bad, F.struct(weighed, "constraint_id"))).alias("primary"),
    )
    score = F.round(F.coalesce(F.col("raw") * F.when(F.col("against"), 0.5).otherwise(1.0), F.lit(0.0)), 6)
    out = f.withColumn("error_score", score)
    unsure = F.col("error_score").between(low, high) | (F.col("families") < 2)
    kind = F.when(F.col("raw").isNotNull(), F.col("primary.error_type")).otherwise("NONE")
    return out.select("row_id", "column", (F.col("error_score") >= threshold).alias("is_error"), "error_score", kind.alias("error_type"), unsure.alias("low_confidence"), F.when(F.col("raw").isNotNull(), F.col("primary.suggested_fix")).alias("suggested_fix"))


def localised(df: DataFrame, lhs: str, rhs: str, anchors: list[str], min_support: int = 3, share: float = 0.9, most: float = 0.5, most_anchors: int = 12, supported: bool = False) -> DataFrame:
    """Which side of a dependency is wrong, by what other rows with the same value of an anchor column, or of two, have.

    For each anchor group the (lhs, rhs) of its rows is counted once; for a row, the others' most frequent one counts if it
    has a share of `share` of them. row_id, side (lhs, rhs or unresolved), fix, and status: localized (one participant
    differs from it), context_supports_original (none does), multiple_participants_differ, or conflicting_context where
    groups say different things. Rows that no group says anything about are left out and, unless `supported`, those whose
    context supports the original.
    """
    single = [(a,) for a in anchors[:most_anchors]]
    every = [*single, *itertools.combinations(anchors[:most_anchors], 2)]
    key = lambda names: F.when(reduce(lambda x, n: x & ~C.is_blank(F.col(n)), names, F.lit(True)), F.to_json(F.array(*(F.col(n).cast("string") for n in names))))
    pair = F.to_json(F.struct(F.col(lhs).alias("l"), F.col(rhs).alias("r")))
    rows = df.select("row_id", pair.alias("pair"), F.col(lhs).alias("l"), F.col(rhs).alias("r"), F.inline(F.array(*(F.struct(F.lit("|".join(a)).alias("anchor"), key(a).alias("at")) for a in every)))).where("at is not null")
    counts = rows.groupBy("anchor", "at", "pair", "l", "r").agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))  # one row
    tops = counts.groupBy("anchor", "at").agg(F.max(F.struct("n", "pair", "l", "r")).alias("t"), F.sum("n").alias("size"))
    peers = rows.join(tops, ["anchor", "at"]).join(F.broadcast(total))
    same = F.col("pair") == F.col("t.pair")
    left = F.col("size") - 1
    sure = (left >= min_support) & (left <= most * F.col("total")) & (F.when(same, F.col("t.n") - 1).otherwise(F.col("t.n")) / left >= share)
    same_l, same_r = F.col("l").eqNullSafe(F.col("t.l")), F.col("r").eqNullSafe(F.col("t.r"))
    target = F.when(same, "none").when(~same_l & same_r, "lhs").when(same_l, "rhs").otherwise("both")
    votes = peers.where(sure).select("row_id", target.alias("target"), F.when(target == "lhs", F.col("t.l")).when(target == "rhs", F.col("t.r")).alias("fix"))
    out = votes.groupBy("row_id").agg(F.min("target").alias("target"), F.max("target").alias("other"), F.min("fix").alias("fix"))
    one = F.col("target") == F.col("other")
    status = F.when(~one, "conflicting_context").when(F.col("target") == "none", "context_supports_original").when(F.col("target") == "both", "multiple_participants_differ").otherwise("localized")
    found = status == "localized"
    return out.select("row_id", F.when(found, F.col("target")).otherwise("unresolved").alias("side"), F.when(found, F.col("fix")).alias("fix"), status.alias("status")).where(F.lit(supported) | (F.col("status") != "context_supports_original"))


def with_localisation(evidence: DataFrame, places: DataFrame, lhs: str, rhs: str, constraint_ids: list[str]) -> DataFrame:
    """The evidence of a dependency's constraints after localisation (row_id, side, fix, status; with `supported`), with counterevidence.

    The localised participant is a violation with the context's fix; the other one, and both where the context
    supports the original, keep a quarter of their reliability and count as having counter-evidence.
    """
    mine = F.col("constraint_id").isin(*constraint_ids) & (F.col("family") == "relation")
    side = F.when(F.col("_side") == "lhs", lhs).when(F.col("_side") == "rhs", rhs)
    both = evidence.join(places.select("row_id", F.col("side").alias("_side"), F.col("fix").alias("_fix"), F.col("status").alias("_status")), "row_id", "left")
    hit = mine & (F.col("_status") == "localized") & (side == F.col("column"))
    against = mine & (F.col("status") == "violation") & ((F.col("_status") == "context_supports_original") | ((F.col("_status") == "localized") & (side != F.col("column"))))
    hit, against = F.coalesce(hit, F.lit(False)), F.coalesce(against, F.lit(False))
    new = {"status": F.when(hit, "violation").otherwise(F.col("status")), "score": F.when(hit, 0.9).otherwise(F.col("score")), "suggested_fix": F.when(hit, F.col("_fix")).otherwise(F.col("suggested_fix")), "reliability": F.when(against, F.col("reliability") * 0.25).otherwise(F.col("reliability"))}
    return both.select(*(new.get(c, F.col(c)).alias(c) for c in evidence.columns), against.alias("counterevidence"))


def local_program(df: DataFrame, columns: list[str], confidence: float = 0.9) -> list[Constraint]:
    """A program from one profile of the table: one row of counts, and one for each pair of columns, come to the driver."""
    from .dependencies import Gates, group_tops
    from .detectors import RANGES, name_words

    n = F.count("*").alias("n")
    stats = df.agg(n, *(x for c in columns for x in (F.avg(C.is_blank(F.col(c)).cast("double")).alias(f"m_{c}"), F.avg(F.when(~C.is_blank(F.col(c)), C.number_with_unit(F.col(c)).isNotNull().cast("double"))).alias(f"x_{c}")))).first()
    out = []
    for c in columns:
        if (stats[f"m_{c}"] or 0) < 0.5:
            out.append(Constraint("missing", (c,), (c,)))
        if (stats[f"x_{c}"] or 0) >= 0.8:
            out.append(Constraint("type", (c,), (c,), params={"type": "numeric"}))
            if b := next((x for words, x in RANGES if set(words) & set(name_words(c))), None):
                out.append(Constraint("range", (c,), (c,), params={k: v for k, v in (("min", b[0]), ("max", b[1])) if v is not None}))
            out.append(Constraint("statistical", (c,), (c,), params={"z": 6}))
        else:
            out += [Constraint("dmv", (c,), (c,)), Constraint("duplicate", (c,), (c,))]
    groups = group_tops(df, columns, Gates(determinant_unique_ratio=1 / 3)).where("size >= 3")
    for r in groups.groupBy("lhs", "rhs").agg((F.sum("top_n") / F.sum("size")).alias("c")).where(F.col("c") >= confidence).orderBy("lhs", "rhs").collect():
        out.append(Constraint("fd", (r["lhs"], r["rhs"]), (r["lhs"], r["rhs"])))
    return merged([out])
