"""Denial constraints found in a table and graded: lower and higher columns, years, and columns that keep the order of a rank.

Each kind is counted for all its columns in one grouped plan. A constraint holds if few rows break it; its confidence is the share of rows that keep
it, and its severity is medium if too few rows support it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewarden.functions import cells as C
from tablewarden.plans.quantiles import quantiles
from tablewarden.plans.tables import cells, written

from .dependencies import Gates
from .discovery import compare_pairs

MIN_SUPPORT, MOST_BROKEN = 30, 0.02
FINDING = "row_id long, column string, value string, error_type string, rule string, suggested_fix string, confidence double, severity string"


def severity(support: Column, confidence: Column, g: Gates = Gates()) -> Column:
    """high or medium; null for constraints to drop. Constraints of this kind are as stable as they are."""
    strong = (support >= g.high_support) & (confidence >= g.high_confidence)
    return F.when((support >= g.drop_support) & (confidence >= g.drop_confidence), F.when(strong, "high").otherwise("medium"))


def _held(rules: DataFrame, g: Gates, min_support: int, most: float) -> DataFrame:
    """rule, confidence and severity of the rules (rule, support, kept) that hold."""
    confidence = F.col("kept") / F.col("support")
    held = rules.where((F.col("support") >= min_support) & (1 - confidence <= most)).withColumn("confidence", confidence)
    return held.withColumn("severity", severity(F.col("support"), F.col("confidence"), g)).where("severity is not null").drop("support", "kept").withColumn("confidence", F.round("confidence", 3))


def _findings(rows: DataFrame, error_type: str) -> DataFrame:
    return rows.select("row_id", "column", F.col("value").cast("string").alias("value"), F.lit(error_type).alias("error_type"), "rule", F.lit(None).cast("string").alias("suggested_fix"), "confidence", "severity")


def compared(df: DataFrame, pairs: list[tuple[str, str]] | None = None, g: Gates = Gates(), min_support: int = MIN_SUPPORT, most: float = MOST_BROKEN) -> DataFrame:
    """Both cells of rows where a lower column exceeds the higher one. pairs: (lower, higher); by default those that names give."""
    pairs = compare_pairs([c for c in df.columns if c != "row_id"]) if pairs is None else pairs
    if not pairs:
        return df.sparkSession.createDataFrame([], FINDING)
    text = lambda c: F.col(c).cast("string")
    every = F.array(*(F.struct(F.lit(f"dc:compare:{a}<={b}").alias("rule"), F.lit(a).alias("low"), F.lit(b).alias("high"), text(a).alias("v"), text(b).alias("w"), C.number(text(a)).alias("x"), C.number(text(b)).alias("y")) for a, b in pairs))
    rows = df.select("row_id", F.inline(every)).where("x is not null and y is not null")
    held = _held(rows.groupBy("rule").agg(F.count("*").alias("support"), F.sum((F.col("x") <= F.col("y")).cast("long")).alias("kept")), g, min_support, most)
    both = F.array(F.struct(F.col("low").alias("column"), F.col("v").alias("value")), F.struct(F.col("high").alias("column"), F.col("w").alias("value")))
    return _findings(rows.where("x > y").join(F.broadcast(held), "rule").select("row_id", "rule", "confidence", "severity", F.inline(both)), "FI")  # one row for each pair


def years(df: DataFrame, as_of_year: int, columns: list[str] | None = None, earliest: int = 1800, g: Gates = Gates(), min_support: int = MIN_SUPPORT, most: float = MOST_BROKEN) -> DataFrame:
    """Years before `earliest` or after the next year, in columns called a year or nearly all of whose numbers look like one."""
    name = F.lower("column")
    rows = cells(df, columns).select("row_id", "column", "value", C.number(F.col("value")).alias("x")).where("x is not null")
    good = F.col("x").between(earliest, as_of_year + 1)
    stat = rows.groupBy("column").agg(F.count("*").alias("support"), F.sum(good.cast("long")).alias("kept"), F.avg((F.abs(F.col("x") - F.rint("x")) < 1e-6).cast("double")).alias("whole"), F.avg(F.col("x").between(1000, 2100).cast("double")).alias("likely"))
    called = F.contains(name, F.lit("year")) | F.endswith(name, F.lit("yr"))
    held = _held(stat.where(called | ((F.col("whole") > 0.95) & (F.col("likely") > 0.9))).drop("whole", "likely"), g, min_support, most)
    return _findings(rows.where(~good).join(F.broadcast(held), "column").withColumn("rule", F.lit("dc:temporal:year_range")), "FI")  # one row for each column


def rank_columns(df: DataFrame, columns: list[str], min_support: int = MIN_SUPPORT) -> list[str]:
    """Columns whose numbers are nearly all whole and nearly all different."""
    x = cells(df, columns).select("column", C.number(F.col("value")).alias("x")).where("x is not null").groupBy("column", "x").agg(F.count("*").alias("n"))
    whole = F.when(F.abs(F.col("x") - F.rint("x")) < 1e-6, F.col("n")).otherwise(0)
    stat = x.groupBy("column").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(whole).alias("whole"))
    good = (F.col("n") >= min_support) & (F.col("whole") / F.col("n") > 0.95) & (F.col("k") / F.col("n") > 0.95)
    return sorted(r["column"] for r in stat.where(good).select("column").collect())  # one row for each column


def ordered(df: DataFrame, rank: str, measures: list[str], steps: float = 3.0, g: Gates = Gates(), min_support: int = MIN_SUPPORT, most: float = MOST_BROKEN) -> DataFrame:
    """Values that jump out of the order that a measure keeps by rank, up or down, by `steps` typical steps or more.

    Rows are dealt by ranges of the rank. Each range orders its own rows, with the last row before it and the first
    after it as guests, so only one row for each range is ordered in one task.
    """
    measures = [m for m in measures if m != rank]
    if not measures:
        return df.sparkSession.createDataFrame([], FINDING)
    text = lambda c: F.col(c).cast("string")
    every = F.array(*(F.struct(F.lit(m).alias("column"), text(m).alias("value"), C.number(text(m)).alias("m")) for m in measures))
    rows = df.select("row_id", C.number(text(rank)).alias("r"), F.inline(every)).where("r is not null and m is not null")
    rows = written(rows.repartitionByRange("column", "r", "row_id").withColumn("bucket", F.spark_partition_id()).withColumn("own", F.lit(True)), "by-rank")
    at = F.struct("r", "row_id", "m", "value")
    edge = rows.groupBy("column", "bucket").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    order = W.partitionBy("column").orderBy("bucket")
    edge = edge.select("column", F.lag("bucket").over(order).alias("before"), F.lead("bucket").over(order).alias("after"), "first", "last")
    guests = edge.select("column", F.inline(F.array(F.struct(F.col("before").alias("bucket"), F.col("first").alias("x")), F.struct(F.col("after").alias("bucket"), F.col("last").alias("x"))))).where("bucket is not null")
    guests = guests.select("x.row_id", "x.r", "column", "x.value", "x.m", "bucket", F.lit(False).alias("own"))
    here = W.partitionBy("column", "bucket").orderBy("r", "row_id")
    near = rows.unionByName(guests).withColumn("prev", F.lag("m").over(here)).withColumn("next", F.lead("m").over(here)).where("own")
    near = written(near.select("row_id", "column", "value", "m", "prev", "next"), "neighbours")
    up, down = (F.sum(F.when(F.col("prev").isNotNull(), test.cast("long"))) for test in (F.col("m") > F.col("prev"), F.col("m") < F.col("prev")))
    values = near.select("column", "m").distinct().groupBy("column").agg(F.count("*").alias("k"))
    stat = near.groupBy("column").agg((up + down).alias("support"), F.greatest(up, down).alias("kept"), F.count("*").alias("n")).join(values, "column").where((F.col("k") >= 3) & (F.col("n") >= min_support))
    held = _held(stat.select("column", "support", "kept"), g, min_support, most)
    step = quantiles(near.select("column", F.abs(F.col("m") - F.col("prev")).alias("d")).where("d > 0"), ["column"], "d", [0.5]).select("column", F.col("q")[0].alias("step"))
    off = F.least(F.abs(F.col("m") - F.col("prev")), F.abs(F.col("m") - F.col("next")))
    peak = ((F.col("m") > F.col("prev")) & (F.col("m") > F.col("next"))) | ((F.col("m") < F.col("prev")) & (F.col("m") < F.col("next")))
    out = near.where(peak).join(F.broadcast(held), "column").join(F.broadcast(step), "column").where(off >= steps * F.col("step"))  # one row for each column
    return _findings(out.withColumn("rule", F.concat(F.lit(f"dc:order:{rank}~"), "column")), "VAD")


def denial_findings(df: DataFrame, columns: list[str], as_of_year: int | None = None, g: Gates = Gates()) -> DataFrame:
    """All findings of discovered constraints. Ranks are checked against every other column."""
    out = compared(df, compare_pairs(columns), g)
    if as_of_year is not None:
        out = out.unionByName(years(df, as_of_year, columns, g=g))
    for rank in rank_columns(df, columns):
        out = out.unionByName(ordered(df, rank, columns, g=g))
    return out
