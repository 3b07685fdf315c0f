"""Similarity join of short texts by their longest common subsequence, without comparing all with all."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewarden.plans.tables import share_package


def short_length(similarity: float) -> int:
    """Texts shorter than this are joined by characters, longer ones by pairs of characters: they have enough pairs for a prefix."""
    if not 0.7 <= similarity <= 1:
        raise ValueError("the prefixes hold for similarities from 0.7 to 1")
    return max(4, math.ceil(2 / (2 * similarity / (2 - similarity) - 1)))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence: a's matches are the bits of one integer, so each character of b costs one addition."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for ch in b:
        hit = free & at.get(ch, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths."""
    return 2 * common_subsequence(a, b) / max(1, len(a) + len(b))


def _tokens(v: Column, q: int) -> Column:
    """Runs of q characters, each with how many equal ones came before it."""
    grams = F.when(F.length(v) >= q, F.transform(F.sequence(F.lit(1), F.length(v) - q + 1), lambda i: F.substr(v, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    return F.transform(grams, lambda g, i: F.concat(F.lit(f"{q}:"), g, F.lit("\u0001"), F.size(F.filter(F.slice(grams, 1, i), lambda h: h == g)).cast("string")))


def _prefixes(values: DataFrame, similarity: float) -> DataFrame:
    """value and token: so many of the rarest tokens of each value that two similar values have one in common.

    The shortest partner of a text of n characters has n * s / (2 - s). With it, at most n - s / 2 * (n + partner) characters are
    left over; each costs one token of one character, or two of two.
    """
    n = F.length("value")
    partner = n * similarity / (2 - similarity)
    left_over = n - similarity / 2 * (n + partner)
    reach = {1: F.floor(left_over + 1e-9), 2: F.floor(2 * left_over + 1e-9)}
    short = short_length(similarity)
    of = {1: n <= math.ceil((short - 1) * (2 - similarity) / similarity), 2: n >= short}
    none = F.array().cast("array<string>")
    tokens = values.select("value", *(F.when(of[q], _tokens(F.col("value"), q)).otherwise(none).alias(f"t{q}") for q in (1, 2)))
    each = tokens.select("value", F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"t{q}").alias("tokens")) for q in (1, 2)))).alias("x")).select("value", "x.q", F.explode("x.tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("n"))
    ranked = each.join(often, "token").withColumn("nth", F.row_number().over(W.partitionBy("value", "q").orderBy("n", "token")) - 1)
    return ranked.where(F.col("nth") <= F.when(F.col("q") == 1, reach[1]).otherwise(reach[2])).select("value", "token")


def similar_pairs(left: DataFrame, right: DataFrame, similarity: float = 0.85) -> DataFrame:
    """a (of left), b (of right) and ratio of all pairs of distinct values whose indel ratio is `similarity` or more; equal ones too.

    Candidates share one of the rarest tokens of both and have lengths that allow it; then the ratio itself decides.
    """
    share_package(left.sparkSession)
    both = left.select("value").unionByName(right.select("value")).where("value <> ''").distinct()
    prefix = _prefixes(both, similarity)
    a = prefix.join(left.select("value").distinct(), "value").select(F.col("value").alias("a"), "token")
    b = prefix.join(right.select("value").distinct(), "value").select(F.col("value").alias("b"), "token")
    la, lb = F.length("a"), F.length("b")
    found = a.join(b, "token").where(2 * F.least(la, lb) >= similarity * (la + lb) - 1e-9).select("a", "b").distinct()

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x, y, r) for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()) if (r := indel_ratio(x, y)) >= similarity]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["a", "b", "ratio"])

    return found.mapInArrow(verified, "a string, b string, ratio double")
