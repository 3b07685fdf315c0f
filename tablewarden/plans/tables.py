"""Shapes that most operators share: cells of a table, values by number, majorities."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """row_id, column, value of every cell, empty ones too. One pass over the table."""
    columns = columns or [c for c in df.columns if c != "row_id"]
    return df.select("row_id", *(F.col(c).cast("string").alias(c) for c in columns)).unpivot(["row_id"], columns, "column", "value")


def spread(df: DataFrame, key: str = "row_id") -> DataFrame:
    """df over the session's shuffle partitions: a small file of many rows, which are costly to work on, is else read by one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def counted(df: DataFrame, *keys: str, value: str) -> DataFrame:
    """How often each value occurs for each key, and where first."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


def majority(counts: DataFrame, *keys: str, value: str) -> DataFrame:
    """For each key the most frequent value (the first seen among equals), its number, and the group's size.

    Aggregates only, so it needs no sort and combines before the shuffle.
    """
    best = F.max(F.struct(F.col("n"), (-F.col("first_row")).alias("first"), F.col(value).alias("value")))
    return counts.groupBy(*keys).agg(best.alias("best"), F.sum("n").alias("size"), F.count("*").alias("n_values")).select(
        *keys, F.col("best.value").alias("top"), F.col("best.n").alias("top_n"), "size", "n_values", (-F.col("best.first")).alias("top_first")
    )


def pairs(df: DataFrame, columns: list[str], keep: Column | None = None, *more: str) -> DataFrame:
    """row_id, lhs, a, rhs, b and `more` columns: each row once for every ordered pair of its columns, made inside the row."""
    every = F.array(*(F.struct(F.lit(x).alias("lhs"), F.col(x).cast("string").alias("a"), F.lit(y).alias("rhs"), F.col(y).cast("string").alias("b")) for x in columns for y in columns if x != y))
    out = df.select("row_id", *more, F.inline(every))
    return out if keep is None else out.where(keep)


def at_most(df: DataFrame, n: int, keys: list[str], *order: Column) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_nth") <= n).drop("_nth")


def leading(df: DataFrame, keys: list[str], score: Column, most: Column, block: int = 100_000) -> DataFrame:
    """Of each key the rows of highest score, the smallest row_id first among equals, up to `most` (a column of each row).

    Rows are counted by score and block of row_ids; only a block's rows of one score are ranked in one task.
    """
    rows = df.withColumn("_score", score).withColumn("_most", most).withColumn("_block", F.floor(F.col("row_id") / block))
    counts = rows.groupBy(*keys, "_score", "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy(F.desc("_score"), "_block")) - F.col("_n")
    counts = counts.withColumn("_before", before).drop("_n")
    nth = F.row_number().over(W.partitionBy(*keys, "_score", "_block").orderBy("row_id"))
    return rows.join(counts, [*keys, "_score", "_block"]).withColumn("_nth", nth + F.col("_before")).where(F.col("_nth") <= F.col("_most")).drop("_score", "_most", "_block", "_before", "_nth")


def errors(df: DataFrame, error_type: str, rule: str, fix: Column | None = None, confidence: float | None = None, severity: str = "high") -> DataFrame:
    """Cells as findings."""
    return df.select("row_id", "column", "value", F.lit(error_type).alias("error_type"), F.lit(rule).alias("rule"), (F.lit(None) if fix is None else fix).cast("string").alias("suggested_fix"), F.lit(confidence).cast("double").alias("confidence"), F.lit(severity).alias("severity"))


def share_package(spark: SparkSession) -> None:
    """Let Python workers of a local session find this package where the driver did."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH")) if x)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a folder of this machine only where all of Spark runs on it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """A table that many plans read, as Parquet in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
