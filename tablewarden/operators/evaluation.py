"""How well findings match the truth."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions import cells as C
from tablewarden.plans.tables import cells


def _norm(v: Column) -> Column:
    return F.when(C.is_blank(v), "").otherwise(C.stripped(v))


def wrong_cells(dirty: DataFrame, clean: DataFrame) -> DataFrame:
    """row_id, column, value, truth of cells that differ, blanks being equal. Both tables are joined by row, then unpivoted."""
    columns = [c for c in dirty.columns if c != "row_id"]
    other = clean.select("row_id", *(F.col(c).alias(f"_{c}") for c in columns))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.col(f"_{c}").cast("string").alias("truth")) for c in columns))
    return dirty.join(other, "row_id").select("row_id", F.inline(each)).where(_norm(F.col("value")) != _norm(F.col("truth")))


def _scores(df: DataFrame) -> DataFrame:
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn"))
    return df.withColumns({"precision": F.bround(F.coalesce(p, F.lit(0.0)), 3), "recall": F.bround(F.coalesce(r, F.lit(0.0)), 3), "f1": F.bround(F.coalesce(f1, F.lit(0.0)), 3)})


def matched(found: DataFrame, truth: DataFrame) -> DataFrame:
    """row_id, column, hit, real: each cell that was found or is wrong."""
    a = found.select("row_id", "column").distinct().withColumn("hit", F.lit(True))
    b = truth.select("row_id", "column").distinct().withColumn("real", F.lit(True))
    return a.join(b, ["row_id", "column"], "full").na.fill(False, ["hit", "real"])


def _counts() -> list[Column]:
    count = lambda test: F.sum(F.expr(test).cast("long"))
    return [count("hit and real").alias("tp"), count("hit and not real").alias("fp"), count("real and not hit").alias("fn")]


def quality(found: DataFrame, truth: DataFrame, by_column: bool = True) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of the cells: of each column and, as column null, of all."""
    both = matched(found, truth)
    return _scores(both.rollup("column").agg(*_counts()) if by_column else both.agg(*_counts()))


def row_quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    rows = matched(found, truth).groupBy("row_id").agg(F.max("hit").alias("hit"), F.max("real").alias("real"))
    return _scores(rows.agg(*_counts()))


def correction_accuracy(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Of right findings with a fix, by column, how many have the true value."""
    both = found.where("suggested_fix is not null").select("row_id", "column", "suggested_fix").join(truth, ["row_id", "column"])
    return both.groupBy("column").agg(F.count("*").alias("fixes"), F.sum((_norm(F.col("suggested_fix")) == _norm(F.col("truth"))).cast("long")).alias("right"))


def by_error_type(found: DataFrame, truth: DataFrame) -> DataFrame:
    real = truth.select("row_id", "column").distinct().withColumn("real", F.lit(True))
    return found.select("row_id", "column", "error_type").distinct().join(real, ["row_id", "column"], "left").groupBy("error_type").agg(F.sum(F.coalesce("real", F.lit(False)).cast("long")).alias("tp"), F.sum((~F.coalesce("real", F.lit(False))).cast("long")).alias("fp"))


def resolved_false_alarms(before: DataFrame, after: DataFrame, truth: DataFrame, top: int = 6) -> DataFrame:
    """The columns that lost most false alarms: column, resolved."""
    false = lambda df: df.select("row_id", "column").distinct().join(truth, ["row_id", "column"], "left_anti")
    gone = false(before).join(after.select("row_id", "column"), ["row_id", "column"], "left_anti")
    return gone.groupBy("column").agg(F.count("*").alias("resolved")).orderBy(F.desc("resolved"), "column").limit(top)


def mask_leaks(df: DataFrame, dirty: DataFrame, truth: DataFrame) -> DataFrame:
    """For each column: wrong cells, those that the mask calls clean, and their share."""
    missed = truth.select("row_id", "column").join(dirty, ["row_id", "column"], "left_anti").groupBy("column").agg(F.count("*").alias("leaked"))
    return truth.groupBy("column").agg(F.count("*").alias("wrong")).join(missed, "column", "left").na.fill(0, ["leaked"]).withColumn("leak_rate", F.round(F.col("leaked") / F.col("wrong"), 6))


def gate_grid(scores: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """Quality of scored cells (row_id, column, score) at each threshold, in one pass: a cell counts for each it passes."""
    both = scores.select("row_id", "column", "score").join(truth.select("row_id", "column").distinct().withColumn("real", F.lit(True)), ["row_id", "column"], "left")
    total = truth.select("row_id", "column").distinct().agg(F.count("*").alias("all"))
    grid = both.select(F.coalesce("real", F.lit(False)).alias("real"), F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col("score") >= t)).alias("threshold"))
    out = grid.groupBy("threshold").agg(F.sum(F.col("real").cast("long")).alias("tp"), F.sum((~F.col("real")).cast("long")).alias("fp")).join(F.broadcast(total))  # one row
    return _scores(out.withColumn("fn", F.col("all") - F.col("tp")).drop("all"))


def ablation(evidence: DataFrame, truth: DataFrame, least: float = 0.6) -> DataFrame:
    """Quality of the fused score without each detector, and as `without` '' with all: one plan, in which each cell counts for
    every detector that is left out. Only the names of detectors come to the driver."""
    from .fusion import detector_scores

    names = ["", *sorted(r["detector"] for r in evidence.select("detector").distinct().collect())]
    left = F.explode(F.array(*map(F.lit, names))).alias("without")
    each = detector_scores(evidence).select("row_id", "column", "detector", "weighted", left).where(F.col("detector") != F.col("without"))
    cell = each.groupBy("without", "row_id", "column").agg(F.round(1 - F.product(1 - F.col("weighted")), 6).alias("p")).where(F.col("p") >= least)
    real = truth.select("row_id", "column").distinct().withColumn("real", F.lit(True))
    hits = cell.join(real, ["row_id", "column"], "left").groupBy("without").agg(F.count("real").alias("tp"), F.sum(F.col("real").isNull().cast("long")).alias("fp"))
    every = evidence.sparkSession.createDataFrame([(n,) for n in names], "without string").join(F.broadcast(hits), "without", "left").na.fill(0, ["tp", "fp"])
    total = real.agg(F.count("*").alias("all"))  # one row
    return _scores(every.join(F.broadcast(total)).withColumn("fn", F.col("all") - F.col("tp")).drop("all"))


def draw_counts(groups: list[tuple[int, ...]], sizes: list[int], draws: int, seed: int) -> np.ndarray:
    """How often each group's rows are drawn, for each draw: a row is drawn Poisson(1) times, so n equal rows Poisson(n) times.

    Each group's numbers depend on the seed and on what it is alone, so they don't depend on the order of groups.
    """
    return np.array([np.random.default_rng([seed, *g]).poisson(n, draws) for g, n in zip(groups, sizes)], float).reshape(len(groups), draws)


def bootstrap_f1(found: DataFrame, truth: DataFrame, group: str | None = None, draws: int = 2000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """group, f1, low, high, rows: F1 of each group of findings (one without `group`) and its bootstrap interval, drawn by rows.

    Rows are alike if they have as many hits, false alarms and misses. One pass counts the rows of each kind, of which there are few; all draws are of these
    counts. Rows without any of the three change no draw.
    """
    keys = ["row_id", "column"] + ([group] if group else [])
    a = found.select(*keys).distinct().withColumn("hit", F.lit(True))
    both = a.join(truth.select(*keys).distinct().withColumn("real", F.lit(True)), keys, "full").na.fill(False, ["hit", "real"])
    by = F.col(group).cast("string") if group else F.lit("all")
    kinds = both.groupBy(by.alias("group"), "row_id").agg(*(c.cast("int") for c in _counts())).toDF("group", "row_id", "tp", "fp", "fn")
    kinds = kinds.groupBy("group", "tp", "fp", "fn").agg(F.count("*").alias("n")).orderBy("group", "tp", "fp", "fn").collect()  # at most (columns + 1)^3 for each group
    out = []
    for name in sorted({r["group"] for r in kinds}):
        mine = [r for r in kinds if r["group"] == name]
        triples = np.array([(r["tp"], r["fp"], r["fn"]) for r in mine], float)
        times = draw_counts([(r["tp"], r["fp"], r["fn"]) for r in mine], [r["n"] for r in mine], draws, seed)
        tp, fp, fn = triples.T @ times
        drawn = 2 * tp / np.maximum(2 * tp + fp + fn, 1)
        tp, fp, fn = triples.T @ np.array([r["n"] for r in mine], float)
        low, high = np.quantile(drawn, [(1 - level) / 2, (1 + level) / 2])
        out.append((name, float(2 * tp / max(2 * tp + fp + fn, 1)), float(low), float(high), sum(r["n"] for r in mine)))
    return found.sparkSession.createDataFrame(out, "group string, f1 double, low double, high double, rows long")


def macro_interval(scores: dict[str, list[float]], draws: int = 2000, level: float = 0.95, seed: int = 42) -> tuple[float, float, float]:
    """Mean over datasets of the mean over their runs, and its interval when datasets are drawn with replacement."""
    means = np.array([np.mean(scores[k]) for k in sorted(scores)])
    drawn = np.random.default_rng(seed).choice(means, (draws, len(means))).mean(1)
    low, high = np.quantile(drawn, [(1 - level) / 2, (1 + level) / 2])
    return float(means.mean()), float(low), float(high)
