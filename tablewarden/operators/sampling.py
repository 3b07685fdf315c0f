"""Small views of a large table: typical, rare and conflicting rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.plans.tables import cells, written

from .constraints import Constraint, execute


def row_key(columns: list[str]) -> Column:
    """A hash that equal rows share."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in columns))), 256)


def row_frequencies(df: DataFrame, columns: list[str], seed: int = 42) -> DataFrame:
    """row_id, frequency (the sum over its cells of the share of rows that have the cell's value), jitter (below 1e-6, from a hash
    of the seed; it orders equally frequent rows) and key of every row."""
    long = cells(df, columns)
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("rows"))
    same = (long["column"] == counts["column"]) & long["value"].eqNullSafe(counts["value"])
    often = long.join(counts, same).groupBy("row_id").agg(F.sum("n").alias("n")).join(F.broadcast(total))  # one row
    draw = F.conv(F.substr(F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string")).cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("double") / 2**32 * 1e-6
    keys = df.select("row_id", row_key(columns).alias("key"))
    return often.select("row_id", (F.col("n") / F.col("rows")).alias("frequency"), draw.alias("jitter")).join(keys, "row_id")


def views(df: DataFrame, columns: list[str], program: list[Constraint], seed: int = 42, most: int = 6, edges: int = 96, others: int = 64) -> DataFrame:
    """view (typical, rare, conflict), nth and row_id: `most` rows of each view, of equal rows one.

    Conflicts are looked for among the `edges` most and least frequent rows and `others` drawn by a hash, by the scores of
    their violations and the cells that checks disagree about; groups are still counted over the whole table. Each
    list is a bounded top of its order, so nothing is sorted as a whole.
    """
    rows = written(row_frequencies(df, columns, seed), "frequencies")
    order = F.col("frequency") + F.col("jitter")
    high, low = rows.orderBy(order.desc(), "row_id").limit(edges), rows.orderBy(order, "row_id").limit(edges)
    drawn = rows.orderBy(F.col("jitter"), "row_id").limit(others)
    pool = written(high.unionByName(low).unionByName(drawn).dropDuplicates(["row_id"]), "pool")
    inside = df.join(F.broadcast(pool.select("row_id", F.lit(True).alias("_in"))), "row_id", "left")  # 2 * edges + others rows at most
    said = execute(inside, program, judged=F.coalesce("_in", F.lit(False))).where("status <> 'abstain'")
    cell = said.groupBy("row_id", "column").agg(F.sum(F.when(F.col("status") == "violation", F.col("score")).otherwise(0.0)).alias("score"), (F.count_distinct("status") > 1).cast("double").alias("split"))
    severity = cell.groupBy("row_id").agg(F.sum(F.col("score") + F.col("split")).alias("severity"))
    conflict = pool.join(severity, "row_id", "left").select("row_id", "key", F.round(F.coalesce("severity", F.lit(0.0)), 6).alias("severity"), "frequency")

    def first(of: DataFrame, name: str, *by: Column) -> DataFrame:
        one = of.groupBy("key").agg(F.min(F.struct(*by, F.col("row_id"))).alias("at"))
        top = one.orderBy("at").limit(most)
        return top.agg(F.sort_array(F.collect_list("at")).alias("all")).select(F.lit(name).alias("view"), F.posexplode("all").alias("nth", "at")).select("view", "nth", "at.row_id")  # most rows

    out = first(rows, "typical", (-order).alias("by")).unionByName(first(rows, "rare", order.alias("by")))
    return out.unionByName(first(conflict, "conflict", (-F.col("severity")).alias("a"), F.col("frequency").alias("b")))
