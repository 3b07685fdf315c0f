"""Rules between columns: functional dependencies, conditional ones, order and arithmetic, and their grading.

All pairs of columns go through one grouped plan: each row gives its pairs, counts combine before the shuffle.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablewarden.functions import cells as C
from tablewarden.plans.tables import cells, counted, majority, pairs, spread, written


@dataclass(frozen=True)
class Gates:
    confidence: float = 0.9
    group_support: int = 5
    group_confidence: float = 0.9
    pure: float = 0.9
    pure_ratio: float = 0.85
    distinct_dependents: int = 2
    determinant_unique_ratio: float = 0.5
    drop_support: int = 10
    drop_confidence: float = 0.8
    high_support: int = 50
    high_confidence: float = 0.95
    high_stability: float = 0.9


def _pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """The pairs of filled cells. Rows are spread before, as counts of all pairs of a small file are else held by one task."""
    filled = spread(df.select("row_id", *columns)).select("row_id", *(F.when(~C.is_blank(F.col(c).cast("string")), F.col(c).cast("string")).alias(c) for c in columns))
    return pairs(filled, columns, F.col("a").isNotNull() & F.col("b").isNotNull())


def usable_pairs(df: DataFrame, columns: list[str], g: Gates) -> list[tuple[str, str]]:
    """Pairs whose determinant repeats and whose dependent varies; one row of counts for each column comes to the driver."""
    values = cells(spread(df.select("row_id", *columns)), columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    found = values.groupBy("column").agg(F.sum("n").alias("rows"), F.count(F.when(~C.is_blank(F.col("value")), F.lit(1))).alias("k")).collect()  # one row for each column
    counts, n = {r["column"]: r["k"] for r in found}, max((r["rows"] for r in found), default=0)
    left = [c for c in columns if 1 < counts.get(c, 0) <= g.determinant_unique_ratio * max(n, 1)]
    return [(a, b) for a in left for b in columns if a != b and counts.get(b, 0) >= 2]


def group_tops(df: DataFrame, columns: list[str], g: Gates = Gates()) -> DataFrame:
    """lhs, rhs, a: each group of a determinant's value, with the dependent's most frequent value."""
    keep = usable_pairs(df, columns, g)
    if not keep:
        return majority(counted(_pairs(df, columns).where(F.lit(False)), "lhs", "rhs", "a", value="b"), "lhs", "rhs", "a", value="b")
    wanted = F.struct("lhs", "rhs").isin(*(F.struct(F.lit(a).alias("lhs"), F.lit(b).alias("rhs")) for a, b in keep))
    return majority(counted(_pairs(df, columns).where(wanted), "lhs", "rhs", "a", value="b"), "lhs", "rhs", "a", value="b")


def dependencies(groups: DataFrame, g: Gates = Gates()) -> DataFrame:
    """lhs, rhs, confidence, support (of groups that map), pure_ratio: the dependencies that pass the gates."""
    share = F.col("top_n") / F.col("size")
    maps = (F.col("size") >= g.group_support) & (share >= g.group_confidence)
    out = groups.groupBy("lhs", "rhs").agg(
        (F.sum("top_n") / F.sum("size")).alias("confidence"), F.sum(F.when(maps, F.col("size")).otherwise(0)).alias("support"),
        (F.sum(((F.col("size") >= g.group_support) & (share >= g.pure)).cast("double")) / F.nullif(F.sum((F.col("size") >= g.group_support).cast("double")), F.lit(0.0))).alias("pure_ratio"),
        F.count_distinct(F.when(maps, F.col("top"))).alias("dependents"),
    )
    return out.where((F.col("confidence") >= g.confidence) & (F.col("pure_ratio") >= g.pure_ratio) & (F.col("dependents") >= g.distinct_dependents))


def _of_pairs(df: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """row_id, lhs, a, rhs, b of the wanted pairs of columns alone, where both cells are filled."""
    text = lambda c: F.col(c).cast("string")
    if not wanted:
        return df.select("row_id", *(F.lit("").alias(c) for c in ("lhs", "a", "rhs", "b"))).where(F.lit(False))
    every = F.array(*(F.struct(F.lit(x).alias("lhs"), text(x).alias("a"), F.lit(y).alias("rhs"), text(y).alias("b")) for x, y in wanted))
    return df.select("row_id", F.inline(every)).where(~C.is_blank(F.col("a")) & ~C.is_blank(F.col("b")))


def _violations(df: DataFrame, groups: DataFrame, found: list[tuple[str, str]], g: Gates) -> DataFrame:
    share = F.col("top_n") / F.col("size")
    mapping = groups.where((F.col("size") >= g.group_support) & (share >= g.group_confidence))
    bad = _of_pairs(df, found).join(mapping, ["lhs", "rhs", "a"]).where("b <> top")
    return bad.select("row_id", F.col("rhs").alias("column"), F.col("b").alias("value"), F.lit("VAD").alias("error_type"), F.concat(F.lit("fd:"), "lhs", F.lit("->"), "rhs").alias("rule"), F.col("top").alias("suggested_fix"), F.round(share, 3).alias("confidence"), F.lit("high").alias("severity"))


def dependency_violations(df: DataFrame, columns: list[str], g: Gates = Gates()) -> DataFrame:
    """Cells that differ from what their determinant's group says. Findings, confidence being the group's share.

    The found pairs of columns come to the driver; rows are expanded to these alone.
    """
    groups = written(group_tops(df, columns, g), "groups")
    found = [(r["lhs"], r["rhs"]) for r in dependencies(groups, g).select("lhs", "rhs").collect()]
    return _violations(df, groups, found, g)


def stabilities(df: DataFrame, wanted: list[tuple[str, str]], rounds: int = 30, share: float = 0.8, confidence: float = 0.9) -> DataFrame:
    """lhs, rhs, stability: the share of rounds in which a hash sample of the rows holds each dependency with that confidence. One plan for all."""
    mine = F.filter(F.sequence(F.lit(1), F.lit(rounds)), lambda i: F.pmod(F.xxhash64("row_id", i), F.lit(1000)) < int(1000 * share))
    keys = ["lhs", "rhs", "round"]
    counts = _of_pairs(df, wanted).select("lhs", "rhs", "a", "b", F.explode(mine).alias("round")).groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))
    by_round = counts.groupBy(*keys, "a").agg(F.max("n").alias("top"), F.sum("n").alias("n")).groupBy(*keys).agg((F.sum("top") / F.sum("n")).alias("confidence"))
    return by_round.groupBy("lhs", "rhs").agg(F.avg((F.col("confidence") >= confidence).cast("double")).alias("stability"))


def stability(df: DataFrame, lhs: str, rhs: str, rounds: int = 30, share: float = 0.8, confidence: float = 0.9) -> DataFrame:
    """stabilities of one dependency."""
    return stabilities(df, [(lhs, rhs)], rounds, share, confidence).select("stability")


def grade(support: int, confidence: float, stable: float | None, g: Gates = Gates()) -> str:
    """drop, high or medium; a rule in between is medium unless an auditor says otherwise."""
    if support < g.drop_support or confidence < g.drop_confidence:
        return "drop"
    steady = 1.0 if stable is None else stable
    return "high" if support >= g.high_support and confidence >= g.high_confidence and steady >= g.high_stability else "medium"


def graded(df: DataFrame, columns: list[str], g: Gates = Gates(), groups: DataFrame | None = None) -> list[tuple[str, str, str]]:
    """(lhs, rhs, high or medium) of the dependencies that are not dropped. One row for each found dependency comes to the
    driver; those strong enough to be high must be stable too, which one plan counts for all of them."""
    found = dependencies(group_tops(df, columns, g) if groups is None else groups, g).orderBy("lhs", "rhs").collect()
    strong = [(r["lhs"], r["rhs"]) for r in found if r["support"] >= g.high_support and r["confidence"] >= g.high_confidence]
    stable = {(r["lhs"], r["rhs"]): r["stability"] for r in stabilities(df, strong, confidence=g.confidence).collect()} if strong else {}
    out = [(r["lhs"], r["rhs"], grade(r["support"], r["confidence"], stable.get((r["lhs"], r["rhs"]), 0.0), g)) for r in found]
    return [x for x in out if x[2] != "drop"]


def graded_violations(df: DataFrame, columns: list[str], g: Gates = Gates()) -> DataFrame:
    """dependency_violations of the graded dependencies, with their severity; those of medium severity don't mark a cell dirty."""
    groups = written(group_tops(df, columns, g), "groups")
    kept = graded(df, columns, g, groups)
    rules = df.sparkSession.createDataFrame([(f"fd:{a}->{b}", s) for a, b, s in kept], "rule string, _severity string")
    found = _violations(df, groups, [(a, b) for a, b, _ in kept], g).join(F.broadcast(rules), "rule")  # one row for each dependency
    return found.withColumn("severity", F.col("_severity")).select("row_id", "column", "value", "error_type", "rule", "suggested_fix", "confidence", "severity")


def conditional(df: DataFrame, columns: list[str], conditions: list[str], min_support: int = 30, top: int = 10, confidence: float = 0.95, gain: float = 0.1, g: Gates = Gates()) -> DataFrame:
    """Dependencies that hold for the rows of one condition value, by `gain` better than for all rows."""
    scope = Gates(confidence=confidence, group_confidence=confidence)
    usual = df.select("row_id", F.inline(F.array(*(F.struct(F.lit(c).alias("on"), F.col(c).alias("is")) for c in conditions)))).where(~C.is_blank(F.col("is")))
    frequent = usual.groupBy("on", "is").agg(F.count("*").alias("n")).where(F.col("n") >= min_support)
    frequent = frequent.withColumn("_k", F.row_number().over(W.partitionBy("on").orderBy(F.desc("n"), "is"))).where(F.col("_k") <= top).select("on", "is")
    rows = df.select("row_id", *columns, F.inline(F.array(*(F.struct(F.lit(c).alias("on"), F.col(c).alias("is")) for c in conditions))))
    rows = rows.join(F.broadcast(frequent), ["on", "is"])
    every = F.array(*(F.struct(F.lit(x).alias("lhs"), F.col(x).alias("a"), F.lit(y).alias("rhs"), F.col(y).alias("b")) for x in columns for y in columns if x != y))
    long = rows.select("row_id", "on", "is", F.inline(every)).where((F.col("on") != F.col("lhs")) & (F.col("on") != F.col("rhs")) & ~C.is_blank(F.col("a")) & ~C.is_blank(F.col("b")))
    groups = majority(counted(long, "on", "is", "lhs", "rhs", "a", value="b"), "on", "is", "lhs", "rhs", "a", value="b")
    share = F.col("top_n") / F.col("size")
    maps = (F.col("size") >= scope.group_support) & (share >= scope.group_confidence)
    local = groups.groupBy("on", "is", "lhs", "rhs").agg((F.sum("top_n") / F.sum("size")).alias("confidence"), F.sum(F.when(maps, F.col("size")).otherwise(0)).alias("support"), F.count_distinct(F.when(maps, F.col("top"))).alias("dependents"))
    everywhere = majority(counted(_pairs(df, columns), "lhs", "rhs", "a", value="b"), "lhs", "rhs", "a", value="b").groupBy("lhs", "rhs").agg((F.sum("top_n") / F.sum("size")).alias("overall"))
    out = local.join(F.broadcast(everywhere), ["lhs", "rhs"])  # one row for each pair of columns
    return out.where((F.col("confidence") >= confidence) & (F.col("dependents") >= 2) & (F.col("confidence") - F.col("overall") >= gain)).select("on", "is", "lhs", "rhs", "confidence", "overall", "support")


def constants(df: DataFrame, conditions: list[str], targets: list[str], min_support: int = 30, share: float = 0.95, overall: float = 0.85) -> DataFrame:
    """Values that nearly all rows of one condition value have, though not nearly all rows do: on, is, column, constant, share."""
    every = F.array(*(F.struct(F.lit(c).alias("on"), F.col(c).alias("is"), F.lit(t).alias("column"), F.col(t).alias("value")) for c in conditions for t in targets if c != t))
    long = df.select("row_id", F.inline(every)).where(~C.is_blank(F.col("is")) & ~C.is_blank(F.col("value")))
    tops = majority(counted(long, "on", "is", "column", value="value"), "on", "is", "column", value="value").where((F.col("size") >= min_support) & (F.col("top_n") / F.col("size") >= share))
    everywhere = df.select("row_id", F.inline(F.array(*(F.struct(F.lit(t).alias("column"), F.col(t).alias("value")) for t in targets)))).where(~C.is_blank(F.col("value")))
    totals = everywhere.groupBy("column", "value").agg(F.count("*").alias("n"))
    totals = totals.join(F.broadcast(totals.groupBy("column").agg(F.sum("n").alias("all"))), "column").select("column", F.col("value").alias("top"), (F.col("n") / F.col("all")).alias("overall"))
    return tops.join(totals, ["column", "top"]).where(F.col("overall") < overall).select("on", "is", "column", F.col("top").alias("constant"), (F.col("top_n") / F.col("size")).alias("share"), F.col("size").alias("support"))


def constant_violations(df: DataFrame, conditions: list[str], targets: list[str], **gates) -> DataFrame:
    every = F.array(*(F.struct(F.lit(c).alias("on"), F.col(c).alias("is"), F.lit(t).alias("column"), F.col(t).alias("value")) for c in conditions for t in targets if c != t))
    long = df.select("row_id", F.inline(every)).where(~C.is_blank(F.col("value")))
    bad = long.join(constants(df, conditions, targets, **gates), ["on", "is", "column"]).where("value <> constant")
    return bad.select("row_id", "column", "value", F.lit("VAD").alias("error_type"), F.concat(F.lit("cfd:("), "on", F.lit("="), "is", F.lit(")->"), "column", F.lit("="), "constant").alias("rule"), F.col("constant").alias("suggested_fix"), F.round("share", 3).alias("confidence"), F.lit("high").alias("severity"))


def compare(df: DataFrame, low: str, high: str, min_support: int = 30, most: float = 0.02) -> DataFrame:
    """Both cells of rows where low exceeds high, if few rows do."""
    x, y = C.number(F.col(low)), C.number(F.col(high))
    rate = df.where(x.isNotNull() & y.isNotNull()).agg(F.count("*").alias("n"), F.avg((x > y).cast("double")).alias("rate")).where((F.col("n") >= min_support) & (F.col("rate") <= most))
    both = F.array(F.struct(F.lit(low).alias("column"), F.col(low).alias("value")), F.struct(F.lit(high).alias("column"), F.col(high).alias("value")))
    out = df.where(x > y).select("row_id", F.inline(both)).join(F.broadcast(rate))  # rate is one row
    return out.select("row_id", "column", "value", F.lit("FI").alias("error_type"), F.lit(f"dc:{low}<={high}").alias("rule"))


def impossible_years(df: DataFrame, column: str, as_of_year: int, earliest: int = 1800) -> DataFrame:
    x = C.number(F.col(column))
    out = df.where((x < earliest) | (x > as_of_year + 1))
    return out.select("row_id", F.lit(column).alias("column"), F.col(column).alias("value"), F.lit("FI").alias("error_type"), F.lit("dc:year").alias("rule"))


def order_breaks(df: DataFrame, rank: str, measure: str, bucket: int = 10_000, steps: float = 3.0) -> DataFrame:
    """Values that jump out of the order that their neighbours by rank keep, by `steps` typical steps or more.

    Neighbours are found in buckets of the rank, each with the last row before it and the first after it, so no task
    orders the whole table.
    """
    rows = df.select("row_id", F.col(rank).cast("double").alias("r"), F.col(measure).cast("double").alias("m")).where("r is not null and m is not null")
    rows = rows.withColumn("bucket", F.floor(F.col("r") / bucket))
    edge = rows.groupBy("bucket").agg(F.min(F.struct("r", "row_id", "m")).alias("first"), F.max(F.struct("r", "row_id", "m")).alias("last"))
    # the buckets that have rows, in order: one row each
    order = W.orderBy("bucket")
    edge = edge.select(F.lag("bucket").over(order).alias("before"), F.lead("bucket").over(order).alias("after"), "first", "last")
    guests = edge.select(F.inline(F.array(F.struct(F.col("before").alias("bucket"), F.col("first").alias("x")), F.struct(F.col("after").alias("bucket"), F.col("last").alias("x"))))).where("bucket is not null")
    every = rows.withColumn("own", F.lit(True)).unionByName(guests.select("x.row_id", "x.r", "x.m", "bucket", F.lit(False).alias("own")))
    at = W.partitionBy("bucket").orderBy("r", "row_id")
    near = every.withColumn("prev", F.lag("m").over(at)).withColumn("next", F.lead("m").over(at)).where("own")
    step = near.where("prev is not null and m <> prev").agg(F.percentile(F.abs(F.col("m") - F.col("prev")), F.lit(0.5)).alias("step"))
    off = F.least(F.abs(F.col("m") - F.col("prev")), F.abs(F.col("m") - F.col("next")))
    peak = ((F.col("m") > F.col("prev")) & (F.col("m") > F.col("next"))) | ((F.col("m") < F.col("prev")) & (F.col("m") < F.col("next")))
    out = near.where(peak).join(F.broadcast(step)).where(off >= steps * F.col("step"))
    return out.select("row_id", F.lit(measure).alias("column"), F.col("m").alias("value"), F.lit("VAD").alias("error_type"), F.lit(f"dc:order:{rank}").alias("rule"))


def arithmetic(expression: str, columns: dict[str, Column]) -> Column:
    """A column of an expression of + - * / % (of the divisor's sign) **, comparisons, and/or/not, abs, min, max and round over named columns."""
    binary = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide, ast.Mod: lambda a, b: F.try_mod(F.try_mod(a, b) + b, b), ast.Pow: F.pow}
    tests = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}
    calls = {"abs": F.abs, "min": F.least, "max": F.greatest, "round": lambda x, n=None: F.bround(x, 0 if n is None else n)}

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return build(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in columns:
            return columns[node.id]
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd | ast.Not):
            x = build(node.operand)
            return -x if isinstance(node.op, ast.USub) else ~x if isinstance(node.op, ast.Not) else x
        if isinstance(node, ast.BinOp) and type(node.op) in binary:
            if isinstance(node.op, ast.Pow) and not (isinstance(node.right, ast.Constant) and abs(node.right.value) <= 8):
                raise ValueError("exponents must be constants of 8 or less")
            return binary[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in tests:
            return tests[type(node.ops[0])](build(node.left), build(node.comparators[0]))
        if isinstance(node, ast.BoolOp):
            out = build(node.values[0])
            for v in node.values[1:]:
                out = out & build(v) if isinstance(node.op, ast.And) else out | build(v)
            return out
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in calls and not node.keywords:
            args = [a.value if node.func.id == "round" and i else build(a) for i, a in enumerate(node.args)]
            return calls[node.func.id](*args)
        raise ValueError(f"not allowed in an arithmetic rule: {ast.dump(node)[:60]}")

    return build(ast.parse(expression, mode="eval"))


def arithmetic_violations(df: DataFrame, expression: str, result: str, tolerance: float = 1e-6, min_support: int = 30, most: float = 0.02) -> DataFrame:
    names = {n.id for n in ast.walk(ast.parse(expression, mode="eval")) if isinstance(n, ast.Name)} & set(df.columns)
    gap = F.abs(arithmetic(expression, {n: C.number(F.col(n)) for n in names}) - C.number(F.col(result)))
    rows = df.select("row_id", F.lit(result).alias("column"), F.col(result).alias("value"), gap.alias("gap")).where("gap is not null")
    rate = rows.agg(F.count("*").alias("n"), F.avg((F.col("gap") > tolerance).cast("double")).alias("rate")).where((F.col("n") >= min_support) & (F.col("rate") <= most))
    return rows.where(F.col("gap") > tolerance).join(F.broadcast(rate)).select("row_id", "column", "value", F.lit("FI").alias("error_type"), F.lit(f"dc:{result}={expression}").alias("rule"))


def resolve_conflicts(findings: DataFrame, user_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """One finding for each cell: by user's rules, confidence, family (cfd, dc, fd, others) and severity. If the two best are
    alike and the fixes differ, it is of medium severity. `place` is the order in which equals came."""
    family = F.when(F.col("rule").startswith("cfd:"), 3).when(F.col("rule").startswith("dc:"), 2).when(F.col("rule").startswith("fd:") | F.coalesce(F.col("error_type") == "VAD", F.lit(False)), 1).otherwise(0)
    user = F.lit(False)
    for p in user_prefixes:
        user = user | F.col("rule").startswith(p)
    key = F.struct(user.cast("int").alias("user"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), family.alias("family"), F.when(F.coalesce("severity", F.lit("high")) == "medium", 0).otherwise(1).alias("severity"))
    at = W.partitionBy("row_id", "column").orderBy(F.desc("_key"), "place")
    cell = W.partitionBy("row_id", "column")
    ranked = findings.withColumn("_key", key).withColumn("_nth", F.row_number().over(at)).withColumn("_next", F.lead("_key").over(at)).withColumn("_fixes", F.size(F.collect_set("suggested_fix").over(cell)))
    tie = (F.col("_fixes") >= 2) & F.col("_key").eqNullSafe(F.col("_next"))
    return ranked.where("_nth = 1").withColumn("severity", F.when(tie, "medium").otherwise(F.coalesce("severity", F.lit("high")))).drop("_key", "_nth", "_next", "_fixes", "place")
