"""Exact quantiles of groups of any size, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import written

#: Bins of a histogram; and up to how many rows (or weighted values) a bin is ordered in one task.
BINS, ORDERED = 4096, 100_000


def _bin(x: Column, lo: Column, hi: Column) -> Column:
    """The bin of x among BINS of equal width; halves keep the difference finite."""
    share = (x / 2 - lo / 2) / F.nullif(hi / 2 - lo / 2, F.lit(0.0))
    return F.least(F.lit(BINS - 1), F.coalesce(F.floor(share * BINS), F.lit(0))).cast("int")


def quantiles(rows: DataFrame, keys: list[str], x: str, shares: list[float], weight: str | None = None) -> DataFrame:
    """keys, n (rows) and q: an array of the quantiles of x, interpolated between neighbours, one for each share.

    weight: how many rows one row stands for. A histogram of each group finds the bins with the wanted ranks; bins
    with more than ORDERED rows and different values get a histogram of their own; only the rows of the others are ordered, bin by bin.
    """
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    base = rows.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), w.alias("_w"))
    known = base.groupBy(*keys).agg(F.sum("_w").alias("n"), F.count("*").alias("_many"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    at = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    ranks = F.array_distinct(F.array(*(f(p).cast("long") for p in at for f in (F.floor, F.ceil))))
    want = written(known.select(*keys, "n", "_many", "_lo", "_hi", F.lit(0).cast("long").alias("_before"), F.explode(ranks).alias("_rank")), "ranks")
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]

    def spans(of: DataFrame) -> DataFrame:
        return of.select(*(F.col(k).alias(f"{k}_k") for k in keys), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_before").alias("start")).distinct()

    def within(of: DataFrame) -> DataFrame:
        s = spans(of)
        on = [base[k].eqNullSafe(s[f"{k}_k"]) for k in keys]
        joined = base.join(s, on) if on else base.join(F.broadcast(s))  # without keys, as many rows as shares
        return joined.where(F.col("_x").between(F.col("lo"), F.col("hi"))).drop(*(f"{k}_k" for k in keys))

    wide = (F.col("_lo") < F.col("_hi")) & (F.col("_many") > ORDERED)
    while not want.where(wide).isEmpty():
        hist = within(want.where(wide)).groupBy(*keys, "lo", "hi", "start", _bin(F.col("_x"), F.col("lo"), F.col("hi")).alias("bin"))
        hist = hist.agg(F.sum("_w").alias("w"), F.count("*").alias("many"), F.min("_x").alias("b_lo"), F.max("_x").alias("b_hi"))
        hist = hist.withColumn("first", F.col("start") + F.sum("w").over(W.partitionBy(*keys, "lo", "hi").orderBy("bin")) - F.col("w"))
        hit = [*same(want, hist), want["_lo"] == hist["lo"], want["_hi"] == hist["hi"], want["_rank"] >= hist["first"], want["_rank"] < hist["first"] + hist["w"]]
        new = want.where(wide).join(hist, hit).select(*(want[k] for k in keys), "n", F.col("many").alias("_many"), F.col("b_lo").alias("_lo"), F.col("b_hi").alias("_hi"), F.col("first").alias("_before"), "_rank")
        want = written(want.where(~wide).unionByName(new), "ranks")
    narrow = want.where("_lo < _hi")
    order = W.partitionBy(*keys, "lo", "hi").orderBy("_x")
    ordered = within(narrow).groupBy(*keys, "lo", "hi", "start", "_x").agg(F.sum("_w").alias("w"))
    ordered = ordered.withColumn("first", F.col("start") + F.sum("w").over(order) - F.col("w"))
    hit = [*same(narrow, ordered), narrow["_lo"] == ordered["lo"], narrow["_hi"] == ordered["hi"], narrow["_rank"] >= ordered["first"], narrow["_rank"] < ordered["first"] + ordered["w"]]
    found = narrow.join(ordered, hit).select(*(narrow[k] for k in keys), "n", "_rank", F.col("_x").alias("value"))
    found = found.unionByName(want.where("_lo = _hi").select(*keys, "n", "_rank", F.col("_lo").alias("value")))
    values = found.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "value"))).alias("at"))
    low, high = (lambda p: F.element_at("at", F.floor(p).cast("long"))), (lambda p: F.element_at("at", F.ceil(p).cast("long")))
    return values.select(*keys, "n", F.array(*(low(p) + (high(p) - low(p)) * (p - F.floor(p)) for p in at)).alias("q"))
