"""Profiles of all columns of a table in one grouped plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions import cells as C
from tablewarden.plans.tables import at_most, cells


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, rows, missing, null_rate, distinct, lengths and, of columns that are mostly numbers, their range and mean."""
    v = F.col("value")
    long = cells(df, columns).select("column", v, C.is_blank(v).alias("blank"), C.number(v).alias("x"))
    real = ~F.col("blank")
    out = long.groupBy("column").agg(
        F.count("*").alias("rows"), F.sum(F.col("blank").cast("long")).alias("missing"), F.bround(F.avg(F.col("blank").cast("double")), 3).alias("null_rate"), F.count_distinct(F.when(real, v)).alias("distinct"),
        F.min(F.when(real, F.length(v))).alias("min_length"), F.max(F.when(real, F.length(v))).alias("max_length"), F.avg(F.when(real, F.col("x").isNotNull().cast("double"))).alias("share"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("m"),
    )
    numeric = F.col("share") >= 0.8
    return out.select("column", "rows", "missing", "null_rate", "distinct", "min_length", "max_length", F.round("share", 6).alias("numeric_share"), F.when(numeric, F.col("lo")).alias("min"), F.when(numeric, F.col("hi")).alias("max"), F.when(numeric, F.round("m", 2)).alias("mean"))


def top_values(df: DataFrame, columns: list[str] | None = None, n: int = 20) -> DataFrame:
    """The n most frequent values of each column, the first seen among equals: column, value, n, nth."""
    counts = cells(df, columns).where(~C.is_blank(F.col("value"))).groupBy("column", "value").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))
    return at_most(counts, n, ["column"], F.desc("n"), F.col("first_row")).select("column", "value", "n")


def shapes(df: DataFrame, columns: list[str] | None = None, n: int = 5) -> DataFrame:
    """The n most frequent shapes of each column with their share."""
    counts = cells(df, columns).where(~C.is_blank(F.col("value"))).groupBy("column", C.shape(F.col("value")).alias("shape")).agg(F.count("*").alias("n"))
    total = counts.groupBy("column").agg(F.sum("n").alias("total"))
    return at_most(counts.join(F.broadcast(total), "column"), n, ["column"], F.desc("n"), F.col("shape")).select("column", "shape", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def kinds(df: DataFrame, columns: list[str] | None = None, numeric: float = 0.8, most_categories: int = 500) -> DataFrame:
    """column, kind: empty, id, numeric, categorical or highcard."""
    v = F.col("value")
    long = cells(df, columns).where(~C.is_blank(v)).select("column", v, C.number(v).alias("x"), v.try_cast("double").alias("plain"))
    stat = long.groupBy("column").agg(F.count_distinct("value").alias("k"), F.avg(F.col("x").isNotNull().cast("double")).alias("share"), F.avg(F.col("plain").isNotNull().cast("double")).alias("plain"), F.max(F.when(F.col("plain") != F.floor("plain"), 1).otherwise(0)).alias("fractions"), F.percentile(F.length("value"), F.lit(0.5)).alias("len"), F.stddev_samp(F.length("value")).alias("sd"))
    kind = F.when((F.col("plain") >= 0.8) & (F.col("fractions") == 0) & (F.col("len") >= 4) & (F.col("sd") <= 1.0), "id").when(F.col("share") >= numeric, "numeric").when(F.col("k") <= most_categories, "categorical").otherwise("highcard")
    every = df.sparkSession.createDataFrame([(c,) for c in columns or [c for c in df.columns if c != "row_id"]], "column string")
    return every.join(stat.select("column", kind.alias("kind")), "column", "left").select("column", F.coalesce("kind", F.lit("empty")).alias("kind"))


def character_sets(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The characters that occur in each column, in order: distinct in each cell, then among all."""
    one = cells(df, columns).where(F.col("value").isNotNull()).select("column", F.explode(F.array_distinct(F.split("value", ""))).alias("ch")).where("ch <> ''").distinct()
    return one.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("ch")), "").alias("characters"))
