"""Findings on streams: rules and detectors of single cells need no state, profiles join as a static table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions import cells as C
from tablewarden.operators.rules import Rule, first_violations


def stream_findings(rows: DataFrame, rules: list[Rule], nullable: frozenset[str] = frozenset()) -> DataFrame:
    """First violation of each cell of each arriving row: the batch plan runs unchanged on a stream."""
    return first_violations(rows, rules, nullable)


def stream_outliers(rows: DataFrame, profile: DataFrame, column: str, z: float = 3.0) -> DataFrame:
    """Numbers far from the median of a static profile (median, mad: one row)."""
    x = C.number(F.col(column).cast("string"))
    far = F.abs(x - F.col("median")) / F.col("mad")
    return rows.join(F.broadcast(profile.select("median", "mad").limit(1))).where(far > z).select("row_id", F.lit(column).alias("column"), F.col(column).cast("string").alias("value"), F.lit("DIST").alias("error_type"), F.round(far, 6).alias("score"))


def windowed_rates(rows: DataFrame, time: str, column: str, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Share of blank cells of a column in each window of event time; rows later than `late` are left out."""
    blank = C.is_blank(F.col(column).cast("string"))
    return rows.withWatermark(time, late).groupBy(F.window(time, every)).agg(F.count("*").alias("rows"), F.sum(blank.cast("long")).alias("missing")).select(F.col("window.start").alias("start"), "rows", "missing")
