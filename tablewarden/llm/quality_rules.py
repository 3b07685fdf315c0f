"""Operator 5: quality rules whose cutoffs keep the risk of rejecting a good text small.

Counts of each whole text give four rates, and a rule cuts one of them. Of the labelled texts that the base rules pass,
one half fixes for each stratum a chain of rule sets, each stricter than the last: step by step the cutoff that rejects
most bad texts for the good ones it costs, among the quantiles of good texts. The other half tests the chain: of its
good texts, the exact (Clopper-Pearson) upper bound of the share that a rule set rejects must not exceed `risk`, at a
level of `delta` divided among the strata (Bonferroni). Rule sets are tested in their order, each at the whole level,
and the first that fails ends it (fixed-sequence testing, which needs no further correction). So with probability 1 - delta no
stratum loses more than `risk` of its good texts to the rules. Strata with too few good texts for any test to pass
are pooled; the guarantee of those holds for the pool as a whole. With a pool that is too small there is no rule.

Defined results: a null or empty text has no words and fails the base rules; a null stratum is one of its own, named
by an empty string; labels without a document and documents without a label are left out of the test; a document with
several labels counts once, as good if any says so; with no labels there are no rules; repeated rows are judged each;
a null id is judged by the rules and never labelled; a stratum without any label is judged by the pool's rules;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import by_bytes, documents, mix, session_defaults, written
from .words import SPACE, Words, hashes

SYMBOLS = b"#*$%&|<>"
#: The group of strata that have too few labels to be tested alone.
POOL = "*"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, n).astype(np.int64)


def _again(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of values of documents: whether an earlier place of the document has it, and whether any other has."""
    key = h ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, other = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    other[order[1:]] = same
    other[order[:-1]] |= same
    return later, other


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    words = Words(texts)
    n, buf, at = len(texts), words.buf, words.at
    out = {"n_words": words.count}
    solid = np.flatnonzero(~SPACE[buf] & ((buf & 0xC0) != 0x80))
    out["word_chars"] = _per(np.searchsorted(at, solid, "right") - 1, n)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out["n_symbols"] = _per(np.searchsorted(at, np.flatnonzero(symbol[buf]), "right") - 1, n)

    breaks = np.flatnonzero(buf == 10)
    start = np.unique(np.concatenate((at[:-1], breaks + 1)))
    start = start[start < len(buf)]
    end = np.concatenate((start[1:], [len(buf)]))[: len(start)]
    end = end - ((end > start) & (buf[end - 1] == 10)) if len(start) else end
    has_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[has_word], end[has_word]
    doc = np.searchsorted(at, start, "right") - 1
    out["n_dup_lines"] = _per(doc[_again(doc, hashes(buf, start, end))[0]], n)

    where, h = words.windows(5)
    found = where[_again(words.doc[where], h)[1]]
    cover = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + 5, -1)
    out["n_repeat_words"] = _per(words.doc[np.cumsum(cover)[:-1] > 0], n)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches):
        counts = text_counts(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("stratum"), *(pa.array(counts[c], pa.int64()) for c in COUNTS)], ["doc_id", "stratum", *COUNTS])


def counted(docs: DataFrame, stratum: Column | None = None) -> DataFrame:
    """doc_id, stratum (the language unless given) and the counts of each text."""
    session_defaults(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce((F.col("lang") if stratum is None else stratum).cast("string"), F.lit("")).alias("stratum"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def rates() -> dict[str, Column]:
    """What the rules cut, higher being worse."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_lines_per_word": F.col("n_dup_lines") / n,
        "repeat_share": F.col("n_repeat_words") / n,
        "chars_per_word": F.col("word_chars") / n,
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """The chance of k or fewer of n at rate p, by the incomplete beta function's continued fraction."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total, m = d, 1
    while m < 100_000:
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + t * d), 1 + t / c
            total *= d * c
        if abs(d * c - 1) < 1e-14:
            break
        m += 1
    return 1 - front * total if swap else front * total


def upper_bound(k: int, n: int, delta: float) -> float:
    """The largest rate at which k or fewer of n are still as likely as delta."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        low, high = (p, high) if binomial_tail(k, n, p) > delta else (low, p)
    return high


def labelled(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, rates, good and tests (whether a row is of the half that tests) of labelled texts that the base rules pass."""
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).alias("good"))
    rows = counts.where(~base_failed()).select("doc_id", "stratum", *(c.alias(k) for k, c in rates().items())).join(good, "doc_id")
    return rows.withColumn("tests", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1)


Chain = list[tuple[str, float]]


def pools(n_good: dict[str, int], risk: float, delta: float) -> dict[str, str]:
    """The group of each stratum: itself, or POOL if it has too few good test texts for any rule to pass."""
    least = math.log(delta / max(1, len(n_good))) / math.log1p(-risk)
    return {s: s if n >= least else POOL for s, n in n_good.items()}


def chain_of(grid: dict[str, list[tuple[float, int, int]]], most_good: float) -> Chain:
    """Rule sets in order, each by the cutoff it changes. grid: of each rate its cutoffs, loosest first, with the good and bad
    texts that each rejects. The next step is the one that costs fewest good texts more, and of these rejects most bad ones."""
    at, out = dict.fromkeys(grid, -1), []
    lost = 0
    spent = {k: (0, 0) for k in grid}
    while True:
        steps = []
        for k, cuts in grid.items():
            for i in range(at[k] + 1, len(cuts)):
                g, b = cuts[i][1] - spent[k][0], cuts[i][2] - spent[k][1]
                if b > 0:
                    steps.append((g, -b, i, k))
        if not steps:
            return out
        g, _, i, k = min(steps)
        if lost + g > most_good:
            return out
        lost, at[k], spent[k] = lost + g, i, grid[k][i][1:]
        out.append((k, grid[k][i][0]))


def cutoffs(counts: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05, tail: tuple[float, ...] = (1.0, 0.999, 0.998, 0.995, 0.99, 0.98, 0.97, 0.95, 0.9), wider: tuple[float, ...] = (4.0, 2.0, 1.5), bad: tuple[float, ...] = (0.02, 0.1, 0.25, 0.5)) -> dict[str, dict[str, float]]:
    """For each stratum (and POOL, for the others) the cutoff of each rate that passed; a rate above it is rejected.

    tail, wider, bad: the cutoffs tried are quantiles of good texts, multiples of the largest good rate, and quantiles of bad texts.
    """
    spark, names = counts.sparkSession, list(rates())
    rows = written(labelled(counts, labels), "labelled")
    n_good = {r["stratum"]: r["n"] for r in rows.groupBy("stratum").agg(F.sum((F.col("tests") & F.col("good")).cast("long")).alias("n")).collect()}
    if not n_good:
        return {}
    group = pools(n_good, risk, delta)
    own = [s for s in group.values() if s != POOL]
    rows = rows.withColumn("group", F.when(F.col("stratum").isin(own), F.col("stratum")).otherwise(POOL) if own else F.lit(POOL))
    fit, good = rows.where("not tests"), F.col("good")
    at = lambda k, test, shares: F.percentile_approx(F.when(test, F.col(k)), F.array(*map(F.lit, shares)), F.lit(10_000))
    quantiles = fit.groupBy("group").agg(*(x for k in names for x in (at(k, good, tail).alias(k), at(k, ~good, bad).alias(f"bad_{k}")))).collect()
    values = lambda r, k: [*(w * r[k][0] for w in wider), *r[k], *(r[f"bad_{k}"] or ())]
    tried = {r["group"]: {k: sorted({max(x, 1e-9) for x in values(r, k)}, reverse=True) for k in names} for r in quantiles if r[names[0]]}
    if not tried:
        return {}
    most = max(len(c) for g in tried.values() for c in g.values())
    table = spark.createDataFrame([(g, *(c[k] for k in names)) for g, c in tried.items()], "group string, " + ", ".join(f"cut_{k} array<double>" for k in names))
    over = [F.sum(((F.col(k) > F.get(f"cut_{k}", F.lit(i))) & (good == is_good)).cast("long")).alias(f"{k}_{i}_{int(is_good)}") for k in names for i in range(most) for is_good in (True, False)]
    chains = {}
    for r in fit.join(F.broadcast(table), "group").groupBy("group").agg(F.sum(good.cast("long")).alias("n"), *over).collect():  # one row for each group of strata
        grid = {k: [(c, r[f"{k}_{i}_1"] or 0, r[f"{k}_{i}_0"] or 0) for i, c in enumerate(tried[r["group"]][k])] for k in names}
        chains[r["group"]] = chain_of(grid, 2 * risk * r["n"])
    steps = spark.createDataFrame([(g, [(names.index(k), c) for k, c in chain]) for g, chain in chains.items()], "group string, steps array<struct<rate:int,cut:double>>")
    broken = F.filter(F.transform("steps", lambda x, i: F.when(F.get(F.array(*names), x["rate"]) > x["cut"], i)), lambda i: i.isNotNull())
    first = F.coalesce(F.array_min(broken), F.lit(-1))
    seen = rows.where(F.col("tests") & good).join(F.broadcast(steps), "group").groupBy("group", first.alias("first")).agg(F.count("*").alias("n")).collect()
    out: dict[str, dict[str, float]] = {}
    for g, chain in chains.items():
        rejected_first = {r["first"]: r["n"] for r in seen if r["group"] == g}
        n, rejected = sum(rejected_first.values()), 0
        for i, (k, cut) in enumerate(chain):
            rejected += rejected_first.get(i, 0)
            if binomial_tail(rejected, n, risk) > delta / len(chains):
                break
            out.setdefault(g, {})[k] = cut
    return out | {s: {} for s in own if s not in out}  # a stratum that is tested alone never takes the pool's rules


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(counts: DataFrame, rules: dict[str, dict[str, float]]) -> DataFrame:
    """The counts with base_failed, kept and rejected_by (the rates above their cutoff)."""
    names = list(rates())
    table = counts.sparkSession.createDataFrame([(s, [r.get(k) for k in names]) for s, r in rules.items()], "stratum string, _cuts array<double>")
    pool = [rules.get(POOL, {}).get(k) for k in names]
    cuts = F.coalesce("_cuts", F.array(*(F.lit(c).cast("double") for c in pool)))
    by = [F.when(rate > F.get(cuts, F.lit(i)), F.lit(k)) for i, (k, rate) in enumerate(rates().items())]
    out = counts.join(F.broadcast(table), "stratum", "left")  # one row for each stratum that is tested alone
    return out.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.array_compact(F.array(*by))).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("_cuts")


def apply_quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    counts = written(counted(docs), "counts")
    return judged(counts, cutoffs(counts, labels, risk, delta))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_quality_rules(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "stratum", "rejected_by")
