"""Deterministic detectors of single cells. Each gives findings; thresholds are parameters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablewarden.functions import cells as C
from tablewarden.plans.tables import cells, errors, spread

#: Bounds by a part of the column's kind or name, the first that occurs (fixed values): least, most, whole numbers only.
RANGES = (
    (("age",), (0, 120, False)),
    (("percent", "percentage", "rate", "ratio"), (0, 100, False)),
    (("latitude",), (-90, 90, False)),
    (("longitude",), (-180, 180, False)),
    (("price", "amount", "cost", "salary", "income", "currency", "fee"), (0, None, False)),
    (("quantity", "count", "number", "qty"), (0, None, True)),
    (("year",), (1000, 2100, True)),
)


def missing(df: DataFrame, nullable: frozenset[str] = frozenset()) -> DataFrame:
    return errors(cells(df, [c for c in df.columns if c != "row_id" and c not in nullable]).where(C.is_blank(F.col("value"))), "MV", "missing_value")


def disguised_missing(df: DataFrame, more: tuple[str, ...] = (), numeric: tuple[str, ...] = ()) -> DataFrame:
    hit = C.is_placeholder(F.col("value"), (*C.PLACEHOLDERS, *(m.lower() for m in more), *numeric))
    return errors(cells(df).where(hit & ~C.is_blank(F.col("value"))), "DMV", "placeholder", F.lit(""), 0.8)


def repeated_values(df: DataFrame, sep: str = ",") -> DataFrame:
    fix = C.repeated_token(F.col("value"), sep)
    return errors(cells(df).where(fix.isNotNull()), "FI", "duplicate_value", fix, 0.9)


def standardised(df: DataFrame, column: str, mapping: dict[str, str], patterns: list[tuple[str, str]] = (), most: float = 0.95) -> DataFrame:
    """Values that have another canonical form: the mapping first, else the patterns in turn. A column where more than
    `most` of the values would change is left alone."""
    v = F.col(column)
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair)), v) if mapping else F.lit(None).cast("string")
    swapped = reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), patterns, v)
    rows = df.where(~C.is_blank(v)).select("row_id", F.lit(column).alias("column"), v.alias("value"), F.coalesce(known, swapped).alias("fix"))
    rate = rows.agg(F.avg((F.col("fix") != F.col("value")).cast("double")).alias("rate"))
    out = rows.where("fix <> value").join(F.broadcast(rate.where(F.col("rate") <= most)))  # one row
    return errors(out, "FI", "inconsistent_representation", F.col("fix"), 0.85)


def leaked(df: DataFrame, columns: list[str], longer: float = 3.0) -> DataFrame:
    """Cells with metadata of a source system, and longer than `longer` times the column's median length."""
    long = cells(df, columns).where(~C.is_blank(F.col("value")))
    typical = long.groupBy("column").agg(F.percentile(F.length("value"), F.lit(0.5)).alias("median"), F.avg(C.number(F.col("value")).isNotNull().cast("double")).alias("numeric"))
    out = long.where(C.looks_leaked(F.col("value"))).join(F.broadcast(typical.where("numeric < 0.8")), "column").where(F.length("value") > longer * F.col("median"))
    return errors(out, "FI", "metadata_leakage", F.lit(""), 0.8)


def bounds_of(name: str, kind: str = "") -> tuple | None:
    text = f"{kind} {name}".lower()
    return next((b for words, b in RANGES if any(w in text for w in words)), None)


def name_words(name: str) -> list[str]:
    """Words of a name in camel case or with underscores."""
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name.replace("_", " "))]


def out_of_range(df: DataFrame, column: str, kind: str = "", least_numeric: float = 0.8) -> DataFrame:
    """Numbers that nothing of this kind can have; the column must be mostly numbers."""
    low, high, whole = bounds_of(column, kind) or (None, None, False)
    x = C.number(F.col(column))
    bad = F.lit(False)
    for test in (x < low if low is not None else None, x > high if high is not None else None, F.abs(x - F.rint(x)) > 1e-9 if whole else None):
        bad = bad if test is None else bad | test
    rows = df.where(~C.is_blank(F.col(column))).select("row_id", F.lit(column).alias("column"), F.col(column).alias("value"), x.alias("x"), bad.alias("bad"))
    share = rows.agg(F.avg(F.col("x").isNotNull().cast("double")).alias("numeric")).where(F.col("numeric") >= least_numeric)
    return errors(rows.where("bad").join(F.broadcast(share)), "FI", "hard_range", None, 0.95)  # share is one row


def abbreviation_pairs(df: DataFrame, columns: list[str], min_rows: int = 30, longer: float = 1.4, multi: float = 0.5, abbreviated: float = 0.55) -> DataFrame:
    """full, short: pairs of columns where the second mostly abbreviates the first. One grouped plan for all pairs."""
    every = F.array(*(F.struct(F.lit(x).alias("full"), F.col(x).alias("a"), F.lit(y).alias("short"), F.col(y).alias("b")) for x in columns for y in columns if x != y))
    long = spread(df.select("row_id", *columns)).select(F.inline(every)).where(~C.is_blank(F.col("a")) & ~C.is_blank(F.col("b")))
    rates = long.groupBy("full", "short").agg(
        F.count("*").alias("n"), F.percentile(F.length("a"), F.lit(0.5)).alias("len_a"), F.percentile(F.length("b"), F.lit(0.5)).alias("len_b"),
        F.avg((F.size(C.tokens(F.col("b"))) >= 2).cast("double")).alias("multi"), F.avg(C.is_abbreviation(F.col("b"), F.col("a")).cast("double")).alias("rate"),
    )
    return rates.where((F.col("n") >= min_rows) & (F.col("len_a") >= longer * F.col("len_b")) & (F.col("multi") >= multi) & (F.col("rate") >= abbreviated))


def swapped(df: DataFrame, full: str, short: str) -> DataFrame:
    """Both cells of rows whose abbreviation stands in the full column."""
    a, b = F.col(full), F.col(short)
    rows = df.where(C.is_abbreviation(a, b) & ~C.is_abbreviation(b, a))
    both = F.array(F.struct(F.lit(full).alias("column"), a.alias("value"), b.alias("fix")), F.struct(F.lit(short).alias("column"), b.alias("value"), a.alias("fix")))
    return errors(rows.select("row_id", F.inline(both)), "VAD", "column_swap", F.col("fix"), 0.85)


def first_of_each_cell(found: list[DataFrame]) -> DataFrame:
    """The findings of the first detector, in order, that has any on a cell."""
    tagged = [f.withColumn("_place", F.lit(i)) for i, f in enumerate(found)]
    every = reduce(DataFrame.unionByName, tagged)
    nth = F.row_number().over(W.partitionBy("row_id", "column").orderBy("_place", "rule", F.coalesce("suggested_fix", F.lit(""))))
    return every.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "_place")


def dirty_cells(findings: DataFrame) -> DataFrame:
    """Cells that a finding of high severity marks; all others are clean. (The mask of a table, in sparse form.)"""
    return findings.where(F.coalesce("severity", F.lit("high")) != "medium").select("row_id", "column").distinct()


def clean_mask(df: DataFrame, findings: DataFrame) -> DataFrame:
    """The mask in wide form: for each row whether each column is clean."""
    columns = [c for c in df.columns if c != "row_id"]
    dirty = dirty_cells(findings).groupBy("row_id").agg(F.collect_set("column").alias("dirty"))
    return df.select("row_id").join(dirty, "row_id", "left").select("row_id", *((~F.coalesce(F.array_contains("dirty", c), F.lit(False))).alias(c) for c in columns))

