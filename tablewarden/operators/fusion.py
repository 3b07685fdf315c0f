"""Evidence of all detectors on one cell as one score, and arbitration by what the cell's group says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablewarden.functions import cells as C
from tablewarden.plans.tables import counted, leading, majority, pairs

#: How much each detector's score counts, and to which family it belongs (fixed values).
WEIGHTS = {"strong_rule": 1.0, "approx_fd": 0.9, "approx_fd_medium": 0.5, "reconstruction": 0.85, "numeric_format": 0.85, "categorical_typo": 0.8, "typo": 0.8, "neighbor_consistency": 0.75, "pattern_outlier": 0.6, "statistical": 0.6, "format_cluster": 0.6, "value_burst": 0.6, "secondary_format": 0.5}
FAMILIES = {"strong_rule": "rule", "approx_fd": "rule", "approx_fd_medium": "rule", "reconstruction": "model", "statistical": "statistical", "neighbor_consistency": "neighbor", "pattern_outlier": "pattern", "format_cluster": "pattern", "secondary_format": "pattern", "numeric_format": "format", "typo": "text", "categorical_typo": "text", "value_burst": "burst"}
#: Detectors whose scores only order their own findings.
SOFT = ("reconstruction", "statistical", "neighbor_consistency")


def _lookup(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key), F.lit(default))


def rule_detector(error_type: Column, rule: Column, severity: Column) -> Column:
    """The detector's name of a deterministic finding."""
    dependency = rule.startswith("fd:") | (error_type == "VAD")
    return F.when(error_type == "T", "typo").when(dependency & (severity == "medium"), "approx_fd_medium").when(dependency, "approx_fd").otherwise("strong_rule")


def as_evidence(findings: DataFrame) -> DataFrame:
    return findings.select("row_id", "column", "value", rule_detector(F.col("error_type"), F.col("rule"), F.coalesce("severity", F.lit("high"))).alias("detector"), "error_type", F.coalesce("confidence", F.lit(0.9)).alias("score"), "suggested_fix")


def normalised(evidence: DataFrame) -> DataFrame:
    """Soft detectors' scores as their rank within the detector, in buckets of score so that no task ranks them all;
    others clipped to (0, 1], unknown ones .9."""
    soft = evidence.where(F.col("detector").isin(*SOFT))
    hard = evidence.where(~F.col("detector").isin(*SOFT))
    x = F.coalesce("score", F.lit(0.0))
    bucket = F.floor(F.log1p(F.greatest(x, F.lit(0.0))) * 64)
    keyed = soft.withColumn("_x", x).withColumn("_bucket", bucket)
    counts = keyed.groupBy("detector", "_bucket").agg(F.count("*").alias("_n"))
    each = W.partitionBy("detector")
    counts = counts.withColumn("_before", F.sum("_n").over(each.orderBy("_bucket")) - F.col("_n")).withColumn("_all", F.sum("_n").over(each)).drop("_n")
    nth = F.row_number().over(W.partitionBy("detector", "_bucket").orderBy("_x", "row_id", "column"))
    ranked = keyed.join(F.broadcast(counts), ["detector", "_bucket"]).withColumn("score", (nth + F.col("_before")) / F.col("_all"))  # counts: a few buckets for each detector
    hard = hard.withColumn("score", F.when(F.col("score").isNull() | F.isnan("score") | (F.col("score") <= 0), 0.9).otherwise(F.least("score", F.lit(1.0))))
    return ranked.select(*evidence.columns).unionByName(hard)


def detector_scores(evidence: DataFrame) -> DataFrame:
    """row_id, column, detector, weighted: each detector's best weighted score of a cell."""
    weighted = F.col("score") * _lookup(WEIGHTS, F.col("detector"), 0.6)
    return evidence.groupBy("row_id", "column", "detector").agg(F.max(weighted).alias("weighted"))


def fused(evidence: DataFrame) -> DataFrame:
    """One row for each cell: noisy-or of each detector's best weighted score, tier, detectors, families, type and fix."""
    w = evidence.withColumn("weighted", F.col("score") * _lookup(WEIGHTS, F.col("detector"), 0.6)).withColumn("family", _lookup(FAMILIES, F.col("detector"), "other"))
    best = w.groupBy("row_id", "column", "detector", "family").agg(F.max(F.struct("weighted", "score", "error_type", "suggested_fix", "value")).alias("b"))
    out = best.groupBy("row_id", "column").agg(
        F.max("b.value").alias("value"), (1 - F.product(1 - F.col("b.weighted"))).alias("p"), F.max_by("b.error_type", F.struct("b.weighted", "detector")).alias("error_type"),
        F.max_by("b.suggested_fix", F.when(F.col("b.suggested_fix").isNotNull(), F.struct("b.weighted", "detector"))).alias("suggested_fix"),
        F.array_join(F.array_sort(F.collect_set("detector")), ",").alias("detectors"), F.count_distinct("family").alias("family_count"),
    )
    p = F.round("p", 6)
    return out.select("row_id", "column", "value", "error_type", "suggested_fix", "detectors", "family_count", p.alias("suspicion"), tier(p).alias("tier"))


def tier(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.6, "mid").otherwise("low")


def of_tier(cells: DataFrame, least: str) -> DataFrame:
    rank = {"low": 0, "mid": 1, "high": 2}
    return cells.where(_lookup(rank, F.col("tier"), 0) >= rank[least])


def key_columns(df: DataFrame, columns: list[str], min_group: float = 3.0) -> DataFrame:
    """Columns that group the rows: column, groups, rows."""
    counts = df.agg(F.count("*").alias("rows"), *(F.count_distinct(F.when(~C.is_blank(F.col(c)), F.col(c))).alias(f"k_{c}") for c in columns))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"k_{c}").alias("groups")) for c in columns))
    return counts.select("rows", F.inline(each)).where((F.col("groups") >= 2) & (F.col("rows") >= min_group * F.col("groups"))).select("column", "groups", "rows")


def consensus_keys(df: DataFrame, columns: list[str], keys: list[str], min_dominance: float = 0.5, min_group: int = 3, min_lift: float = 0.15) -> DataFrame:
    """For each column the key whose groups agree best: column, key, dominance, groups."""
    rows = pairs(df, list(dict.fromkeys([*keys, *columns])), ~C.is_blank(F.col("a")) & ~C.is_blank(F.col("b")) & F.col("lhs").isin(*keys) & F.col("rhs").isin(*columns))
    groups = majority(counted(rows, "lhs", "rhs", "a", value="b"), "lhs", "rhs", "a", value="b").where(F.col("size") >= min_group)
    by = groups.groupBy("lhs", "rhs").agg((F.sum("top_n") / F.sum("size")).alias("dominance"), F.count("*").alias("groups"))
    one = rows.select("row_id", "rhs", "b").distinct()
    overall = one.groupBy("rhs", "b").agg(F.count("*").alias("n")).groupBy("rhs").agg((F.max("n") / F.sum("n")).alias("share"), F.count("*").alias("values"))
    good = by.join(F.broadcast(overall), "rhs").where((F.col("dominance") >= min_dominance) & (F.col("dominance") - F.col("share") >= min_lift) & (F.col("groups") <= F.col("values")))
    best = good.groupBy("rhs").agg(F.min(F.struct("groups", (-F.col("dominance")).alias("d"), "lhs")).alias("k"))
    return best.select(F.col("rhs").alias("column"), F.col("k.lhs").alias("key"), F.round(-F.col("k.d"), 6).alias("dominance"), F.col("k.groups").alias("groups"))


def consensus_conflicts(df: DataFrame, column: str, key: str, least: float = 0.4, own_most: float = 0.5, min_group: int = 3) -> DataFrame:
    """Cells that differ from their group's majority: row_id, column, value, majority, majority_share, own_share, group_size."""
    rows = df.where(~C.is_blank(F.col(column)) & ~C.is_blank(F.col(key))).select("row_id", F.col(key).alias("k"), F.col(column).alias("value"))
    counts = counted(rows, "k", value="value")
    tops = majority(counts, "k", value="value").where(F.col("size") >= min_group).select("k", "top", "top_n", "size")
    out = rows.join(counts.select("k", "value", "n"), ["k", "value"]).join(tops, "k")
    out = out.where((F.col("value") != F.col("top")) & (F.col("top_n") / F.col("size") >= least) & (F.col("n") / F.col("size") < own_most))
    return out.select("row_id", F.lit(column).alias("column"), "value", F.col("top").alias("majority"), F.round(F.col("top_n") / F.col("size"), 6).alias("majority_share"), F.round(F.col("n") / F.col("size"), 6).alias("own_share"), F.col("size").alias("group_size"))


def row_contexts(df: DataFrame, cells: DataFrame) -> DataFrame:
    """One row for each row with suspect cells: their evidence, and the row itself, as JSON for an arbiter."""
    suspects = cells.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("column", "value", "error_type", "suspicion", "suggested_fix"))).alias("suspects"))
    return suspects.join(df.select("row_id", F.struct(*[c for c in df.columns if c != "row_id"]).alias("row")), "row_id").select("row_id", F.size("suspects").alias("n_suspects"), F.to_json("suspects").alias("suspects"), F.to_json("row").alias("row"))


def judged(cells: DataFrame, judgments: DataFrame | None = None, conflicts: DataFrame | None = None, reject: float = 0.98, weak_share: float = 0.3, weak: float = 0.85, weak_group: int = 100) -> DataFrame:
    """Final verdict of each suspect cell. A judgment (row_id, column, is_error, confidence, fix) can reject a cell, but
    not a missing value, nor a burst, nor a conflict with its group unless it is confident; without one the cell stays
    an error of confidence .5, missing values of .95."""
    out = cells
    if judgments is None:
        out = out.withColumn("said", F.lit(None).cast("boolean")).withColumn("sure", F.lit(None).cast("double")).withColumn("fix", F.lit(None).cast("string"))
    else:
        out = out.join(judgments.select("row_id", "column", F.col("is_error").alias("said"), F.col("confidence").alias("sure"), "fix"), ["row_id", "column"], "left")
    if conflicts is None:
        out = out.withColumn("majority", F.lit(None).cast("string")).withColumn("own_share", F.lit(None).cast("double")).withColumn("group_size", F.lit(None).cast("long"))
    else:
        out = out.join(conflicts.select("row_id", "column", "majority", "own_share", "group_size"), ["row_id", "column"], "left")
    missing = F.col("error_type").isin("MV", "DMV")
    burst = F.col("detectors").contains("value_burst")
    need = F.when((F.col("own_share") >= weak_share) | (F.col("group_size") > weak_group), F.least(F.lit(weak), F.lit(reject))).otherwise(reject)
    error = F.when(missing | F.col("said").isNull() | F.col("said"), True).when(burst | F.col("majority").isNotNull(), F.col("sure") < need).otherwise(False)
    kind = F.when(burst & ~F.coalesce("said", F.lit(True)) & (F.col("error_type") == "VAD"), "FI").otherwise(F.col("error_type"))
    sure = F.when(missing, 0.95).otherwise(F.coalesce("sure", F.lit(0.5)))
    return out.select("row_id", "column", "value", error.alias("is_error"), kind.alias("error_type"), F.round(sure, 6).alias("confidence"), F.coalesce("fix", "majority", "suggested_fix").alias("suggested_fix"))


def propagated_fixes(judged_cells: DataFrame) -> DataFrame:
    """Errors without a fix take the surest fix of the same value in the same column."""
    fixes = judged_cells.where("is_error and suggested_fix is not null and suggested_fix <> ''").groupBy("column", "value").agg(F.max(F.struct("confidence", "suggested_fix")).alias("best"))
    fixes = fixes.select(F.col("column").alias("_c"), F.col("value").alias("_v"), "best")
    out = judged_cells.join(fixes, (F.col("column") == F.col("_c")) & F.col("value").eqNullSafe(F.col("_v")), "left")
    return out.withColumn("suggested_fix", F.when(F.col("is_error"), F.coalesce(F.nullif("suggested_fix", F.lit("")), "best.suggested_fix")).otherwise(F.col("suggested_fix"))).select(*judged_cells.columns)


def refined_dirty(dirty: DataFrame, judged_cells: DataFrame, n_rows: int, sure: float = 0.6, most: float = 0.05) -> DataFrame:
    """The dirty cells after judgment: sure errors are added, up to a share of each column; sure rejections are taken out."""
    wrong = leading(judged_cells.where(F.col("is_error") & (F.col("confidence") >= sure)), ["column"], F.col("confidence"), F.lit(int(most * n_rows))).select("row_id", "column")
    right = judged_cells.where(~F.col("is_error") & (F.col("confidence") >= sure) & ~F.col("error_type").isin("MV", "DMV")).select("row_id", "column")
    return dirty.join(right, ["row_id", "column"], "left_anti").unionByName(wrong).distinct()
