"""Statistical detectors: robust outliers, rare values near frequent ones, odd formats, bursts, neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablewarden.functions import cells as C
from tablewarden.plans.tables import leading, share_package, written

from .similarity import similar_pairs

CANDIDATE = ("row_id", "column", "value", "detector", "error_type", "score", "suggested_fix")


def _candidates(df: DataFrame, column: str, detector: str, kind: str, score: Column, fix: Column | None = None) -> DataFrame:
    return df.select("row_id", F.lit(column).alias("column"), F.col("value").cast("string").alias("value"), F.lit(detector).alias("detector"), F.lit(kind).alias("error_type"), F.round(score, 6).alias("score"), (F.lit(None) if fix is None else fix).cast("string").alias("suggested_fix"))


def robust_stats(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """median, mad (1.4826 times; if 0 the deviation, if 0 the quartile range or 1), q1, q3, n. Exact percentiles."""
    rows = df.where(F.col(value).isNotNull())
    q = rows.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.stddev_pop(value).alias("sd"), F.count("*").alias("n"))
    both = rows.join(F.broadcast(q), list(keys)) if keys else rows.join(F.broadcast(q))
    spread = both.groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - F.col("q")[1]), F.lit(0.5)).alias("raw"))
    out = q.join(spread, list(keys)) if keys else q.join(F.broadcast(spread))
    mad = F.when(F.col("raw") > 0, 1.4826 * F.col("raw")).when(F.col("sd") > 0, F.col("sd")).otherwise(F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(1.0)))
    return out.select(*keys, F.col("q")[1].alias("median"), mad.alias("mad"), F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), "n")


def best_date_format(df: DataFrame, column: str, sample: int = 200, least: float = 0.8) -> str | None:
    """The date format that reads most of the first `sample` cells that aren't blank, if it reads enough; one row comes to the driver."""
    v = F.col(column)
    first = df.where(~C.is_blank(v)).select("row_id", v.cast("string").alias("v")).orderBy("row_id").limit(sample)
    rates = first.agg(*(F.avg(F.try_to_timestamp("v", F.lit(f)).isNotNull().cast("double")).alias(f"r{i}") for i, f in enumerate(DATE_FORMATS))).first()
    best = max(range(len(DATE_FORMATS)), key=lambda i: (rates[i] or 0.0, -i))
    return DATE_FORMATS[best] if (rates[best] or 0.0) >= least else None


def outliers(df: DataFrame, column: str, clean: DataFrame | None = None, z: float = 3.0, k: float = 1.5, min_clean: int = 20, detector: str = "statistical", dates: bool = False) -> DataFrame:
    """Numbers more than z robust deviations from the median, or beyond k quartile ranges. Estimates come from the clean
    rows, or from all if fewer than min_clean of those have a number; if these are too few as well, nothing is found.
    dates: the cells are dates of the column's best format, if it reads nine in ten; they count in seconds."""
    if dates:
        form = best_date_format(df, column)
        x = F.unix_seconds(F.try_to_timestamp(F.col(column), F.lit(form)) if form else parsed_date(F.col(column))).cast("double")
    else:
        x = C.number(F.col(column)) if dict(df.dtypes)[column] == "string" else F.col(column).cast("double")
    rows = df.select("row_id", F.col(column).alias("value"), x.alias("x"), C.is_blank(F.col(column).cast("string")).alias("blank"))
    read = rows.agg(F.avg(F.when(~F.col("blank"), F.col("x").isNotNull().cast("double"))).alias("read")).where(F.col("read") >= (0.9 if dates else 0.0))
    rows = rows.where("x is not null").select("row_id", "value", "x")
    s = robust_stats(rows, "x").where(F.col("n") >= min_clean)
    if clean is not None:
        mine = robust_stats(rows.join(clean.select("row_id"), "row_id", "left_semi"), "x").where(F.col("n") >= min_clean)
        s = mine.withColumn("_all", F.lit(0)).unionByName(s.withColumn("_all", F.lit(1))).agg(F.min_by(F.struct("median", "mad", "q1", "q3", "n"), "_all").alias("s")).where("s is not null").select("s.*")
    if dates:
        s = s.join(F.broadcast(read)).drop("read")  # both are one row
    far = F.abs(F.col("x") - F.col("median")) / F.col("mad")
    wide = F.greatest(F.col("q3") - F.col("q1"), F.lit(1e-9))
    out = rows.join(F.broadcast(s)).where((far > z) | (F.col("x") < F.col("q1") - k * wide) | (F.col("x") > F.col("q3") + k * wide))
    fix = F.date_format(F.timestamp_seconds("median"), "yyyy-MM-dd") if dates else F.round("median", 6)
    return _candidates(out, column, detector, "DIST", far, fix)


def unit_outliers(df: DataFrame, column: str, z: float = 6.0, min_refs: int = 5) -> DataFrame:
    """Numbers far from the median of those with the same unit."""
    rows = df.select("row_id", F.col(column).alias("value"), C.number_with_unit(F.col(column)).alias("nu")).where("nu is not null").select("row_id", "value", "nu.x", "nu.unit")
    q = rows.groupBy("unit").agg(F.percentile("x", F.lit(0.5)).alias("median"), F.stddev_pop("x").alias("sd"), F.count("*").alias("n")).where(F.col("n") >= min_refs)
    raw = rows.join(F.broadcast(q), "unit").groupBy("unit").agg(F.percentile(F.abs(F.col("x") - F.col("median")), F.lit(0.5)).alias("raw"))
    s = q.join(raw, "unit").withColumn("mad", F.greatest(1.4826 * F.col("raw"), 0.1 * F.col("sd"), F.lit(1e-6)))
    far = F.abs(F.col("x") - F.col("median")) / F.col("mad")
    return _candidates(rows.join(F.broadcast(s), "unit").where(far > z), column, "unit_statistical", "DIST", far)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(~C.is_blank(F.col(column))).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


def _deletions(v: Column) -> Column:
    """The value and all it becomes without one of its characters: values one edit apart share one of these."""
    drop = F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(F.substr(v, F.lit(1), i - 1), F.substr(v, i + 1)))
    return F.array_distinct(F.array_append(drop, v))


def edit_neighbours(values: DataFrame, rare_most: int = 2, anchor_least: int = 3) -> DataFrame:
    """rare, n, anchor, anchor_n: rare values and frequent ones within one edit, by an equi-join on their deletions."""
    rare = values.where(F.col("n") <= rare_most).select(F.col("value").alias("rare"), "n", F.explode(_deletions(F.col("value"))).alias("key"))
    anchor = values.where(F.col("n") >= anchor_least).select(F.col("value").alias("anchor"), F.col("n").alias("anchor_n"), F.explode(_deletions(F.col("value"))).alias("key"))
    return rare.join(anchor, "key").where(F.levenshtein("rare", "anchor") == 1).select("rare", "n", "anchor", "anchor_n").distinct()


def vocabulary_noise(df: DataFrame, column: str, ratio: float = 10, most: float = 0.05, min_length: int = 2) -> DataFrame:
    """Cells with a rare value that is one edit from exactly one frequent value, the clearest first, up to a share of the column."""
    values = value_counts(df, column)
    near = edit_neighbours(values).where((F.col("anchor_n") >= ratio * F.col("n")) & (F.length("anchor") >= min_length))
    single = near.groupBy("rare").agg(F.count("*").alias("k"), F.first("anchor").alias("anchor"), F.first("anchor_n").alias("anchor_n"), F.first("n").alias("n")).where("k = 1")
    total = values.agg(F.sum("n").alias("total"))
    cells = df.join(single, F.col(column) == F.col("rare")).select("row_id", F.col(column).alias("value"), (F.col("anchor_n") / F.col("n")).alias("ratio"), "anchor")
    first = leading(cells.join(F.broadcast(total)).withColumn("column", F.lit(column)), ["column"], F.col("ratio"), F.floor(most * F.col("total")))  # total is one row
    return first.select("row_id", "column", "value", F.col("anchor").alias("suggested_fix"), F.round("ratio", 6).alias("ratio"))


def typos(df: DataFrame, column: str, dirty: DataFrame | None = None, most_values: int | None = 1000, rare_most: int = 2, anchor_least: int = 3, rare_share: float = 0.001, similarity: float = 0.85, min_rows: int = 30) -> DataFrame:
    """Rare values of a categorical column whose most similar frequent value is close, the first seen among equally similar ones.

    Values are counted over the cells that aren't dirty (row_id, column), if these are `min_rows` at least, else over all. most_values: a
    column with more distinct values isn't categorical and gives nothing; None sets no limit.
    """
    v = F.col(column)
    filled = df.where(~C.is_blank(v)).select("row_id", v.alias("value"))
    clean = filled if dirty is None else filled.join(dirty.where(F.col("column") == column).select("row_id"), "row_id", "left_anti")
    counts = filled.select("value").distinct().join(clean.groupBy("value").agg(F.count("*").alias("c"), F.min("row_id").alias("c_first")), "value", "left").join(filled.groupBy("value").agg(F.count("*").alias("t"), F.min("row_id").alias("t_first")), "value")
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c_total"), F.sum("t").alias("t_total"), F.count("c").alias("c_k"), F.count("t").alias("t_k"))
    enough = F.col("c_total") >= min_rows
    pick = lambda a, b: F.when(enough, F.coalesce(a, F.lit(0))).otherwise(F.col(b))
    values = counts.join(F.broadcast(size)).select("value", pick(F.col("c"), "t").alias("n"), F.when(enough, F.col("c_first")).otherwise(F.col("t_first")).alias("first_row"), pick(F.col("c_total"), "t_total").alias("total"), pick(F.col("c_k"), "t_k").alias("k"))  # one row
    values = values.where(F.col("total") >= min_rows)
    if most_values is not None:
        values = values.where(F.col("k") <= most_values)
    values = written(values, "values")
    rare = values.where(((F.col("n") <= rare_most) | (F.col("n") / F.col("total") < rare_share)) & (F.col("n") < anchor_least))
    near = similar_pairs(rare, values.where(F.col("n") >= anchor_least), similarity).join(values.select(F.col("value").alias("b"), "first_row"), "b")
    best = near.groupBy("a").agg(F.max_by("b", F.struct("ratio", -F.col("first_row"))).alias("anchor"), F.max("ratio").alias("score"))
    rows = filled.join(best, filled["value"] == best["a"])
    return _candidates(rows, column, "categorical_typo", "T", F.col("score"), F.col("anchor"))


def rare_formats(df: DataFrame, column: str, floor: float = 0.02, rare_most: int = 2, min_rows: int = 30) -> DataFrame:
    """Rare values whose shape few cells have."""
    rows = df.where(~C.is_blank(F.col(column))).select("row_id", F.col(column).alias("value"), C.shape(F.col(column)).alias("shape"))
    counts = rows.groupBy("value").agg(F.count("*").alias("n"))
    shapes = rows.groupBy("shape").agg(F.count("*").alias("shape_n"))
    total = rows.agg(F.count("*").alias("total")).where(F.col("total") >= min_rows)
    share = F.col("shape_n") / F.col("total")
    out = rows.join(counts.where((F.col("n") <= rare_most)), "value").join(shapes, "shape").join(F.broadcast(total)).where(share < floor)
    return _candidates(out, column, "format_cluster", "FI", 1 - share)


def odd_patterns(df: DataFrame, column: str, dominant: float = 0.8, rare_most: int = 2, min_rows: int = 30, dates: bool = False) -> DataFrame:
    """Cells of rare shape in a column of one dominant shape; in a date column also cells of that shape that are no date."""
    rows = df.where(~C.is_blank(F.col(column))).select("row_id", F.col(column).alias("value"), C.shape(F.col(column)).alias("shape"))
    shapes = rows.groupBy("shape").agg(F.count("*").alias("n"))
    top = shapes.agg(F.max(F.struct("n", "shape")).alias("top"), F.sum("n").alias("total")).where((F.col("total") >= min_rows) & (F.col("top.n") >= dominant * F.col("total")))
    every = rows.join(shapes, "shape").join(F.broadcast(top))  # top is one row
    rare = _candidates(every.where((F.col("shape") != F.col("top.shape")) & (F.col("n") <= rare_most)), column, "pattern_outlier", "FI", F.greatest(1 - F.col("n") / F.col("total"), F.lit(0.6)))
    if not dates:
        return rare
    broken = every.where((F.col("shape") == F.col("top.shape")) & parsed_date(F.col("value")).isNull())
    return rare.unionByName(_candidates(broken, column, "pattern_outlier", "FI", F.lit(0.85)))


#: Date formats that are tried in turn (fixed values): ISO, with slashes, American, European, with dashes, with dots, with times, without separators, with names of months, of a month.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "MM-dd-yyyy", "yyyy.MM.dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm", "yyyyMMdd", "dd-MMM-yyyy", "dd MMM yyyy", "MMM dd, yyyy", "yyyy-MM")


def parsed_date(v: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(v, F.lit(f)) for f in DATE_FORMATS))


def secondary_formats(df: DataFrame, column: str, dominant: float = 0.6, least: float = 0.02, most: float = 0.4, min_count: int = 20) -> DataFrame:
    """Cells of another frequent format beside the dominant one, unless it is a shortened form of that."""
    rows = df.where(~C.is_blank(F.col(column))).select("row_id", F.col(column).alias("value"), C.coarse_shape(F.col(column)).alias("shape"))
    shapes = rows.groupBy("shape").agg(F.count("*").alias("n"))
    top = shapes.agg(F.max(F.struct("n", "shape")).alias("top"), F.sum("n").alias("total")).where(F.col("top.n") >= dominant * F.col("total"))
    share = F.col("n") / F.col("total")
    other = shapes.join(F.broadcast(top)).where((F.col("shape") != F.col("top.shape")) & (F.col("n") >= min_count) & (share >= least) & (share <= most) & ~C.is_subsequence(F.col("shape"), F.col("top.shape")))
    return _candidates(rows.join(other.select("shape"), "shape"), column, "secondary_format", "FI", F.lit(0.6))


def odd_number_counts(df: DataFrame, column: str, dominant: float = 0.9, numeric: float = 0.9, min_rows: int = 30) -> DataFrame:
    """Cells with another number of numbers than nearly all cells of a numeric column."""
    rows = df.where(~C.is_blank(F.col(column))).select("row_id", F.col(column).alias("value"), C.number_tokens(F.col(column)).alias("k"), C.number(F.col(column)).alias("x"))
    counts = rows.groupBy("k").agg(F.count("*").alias("n"), F.count("x").alias("numbers"))
    top = counts.agg(F.max(F.struct("n", (-F.col("k")).alias("k"))).alias("top"), F.sum("n").alias("total"), F.sum("numbers").alias("numbers"))
    top = top.where((F.col("total") >= min_rows) & (F.col("top.n") >= dominant * F.col("total")) & (F.col("numbers") >= numeric * F.col("total")))
    return _candidates(rows.join(F.broadcast(top.select((-F.col("top.k")).alias("usual")))).where("k <> usual"), column, "numeric_format", "FI", F.lit(0.9))


def bursts(df: DataFrame, column: str, min_rows: int = 100, min_count: int = 15, share: float = 0.03, spike_count: int = 20, spike_share: float = 0.05, over_second: float = 10.0, dates: bool = False) -> DataFrame:
    """Values that are suspiciously frequent in a column of many values: of dates each such one, else one far above the second."""
    values = value_counts(df, column)
    stat = values.agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.max_by("value", F.struct("n", -F.col("first_row"))).alias("top"), F.max(F.struct("n", -F.col("first_row"))).alias("best"))
    stat = stat.where((F.col("total") >= min_rows) & (F.lit(dates) | (F.col("k") >= 0.15 * F.col("total"))))
    if dates:
        hit = values.join(F.broadcast(stat)).where((F.col("n") >= min_count) & (F.col("n") >= share * F.col("total")))
    else:
        second = values.join(F.broadcast(stat)).where("value <> top").agg(F.max("n").alias("second"))
        hit = values.join(F.broadcast(stat)).join(F.broadcast(second)).where((F.col("value") == F.col("top")) & (F.col("n") >= spike_count) & (F.col("n") >= spike_share * F.col("total")) & (F.col("n") >= over_second * F.coalesce("second", F.lit(0))))
    hit = hit.select("value", F.least(F.col("n") / F.col("total") / share, F.lit(1.0)).alias("score"))
    return _candidates(df.select("row_id", F.col(column).alias("value")).join(hit, "value"), column, "value_burst", "VAD", F.col("score"))


#: Bytes of an Arrow batch of pairs of blocks; without this limit it has 10,000 pairs, each of about 2 MB at 64 numbers a vector.
PAIR_BYTES = 8 << 20


def _packed_blocks(size: int):
    """Vectors as rows of up to `size` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype("<f8")
                yield pa.RecordBatch.from_arrays([pa.array([part.column("vec_id").to_numpy().astype("<i8").tobytes()]), pa.array([flat.tobytes()])], ["ids", "flat"])

    return run


def _nearest_of_blocks(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                of = lambda name, kind, at=at, batch=batch: np.frombuffer(batch.column(name)[at].as_buffer(), kind)
                mine, theirs = of("q_ids", "<i8"), of("ids", "<i8")
                q, v = of("q_flat", "<f8").reshape(len(mine), -1), of("flat", "<f8").reshape(len(theirs), -1)
                found = []
                for i, x in zip(mine, q):
                    d = np.sqrt(((v - x) ** 2).sum(axis=1))
                    d[theirs == i] = np.inf
                    best = np.lexsort((theirs, d))[:k]
                    best = best[np.isfinite(d[best])]
                    found.append((np.full(len(best), i), theirs[best], d[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["query_id", "vec_id", "distance"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 2048) -> DataFrame:
    """query_id, vec_id, distance, nth: the k nearest vectors (columns vec_id, embedding) of each query, itself left out. Exact.

    Blocks of queries meet blocks of vectors on the executors; of each pair of blocks a query keeps its k nearest, and these are merged.
    A task's Python gets pairs of blocks in Arrow batches cut by PAIR_BYTES, so it holds few of them however many there are.
    """
    share_package(vectors.sparkSession)
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PAIR_BYTES))
    packed = lambda df: df.where("vec_id is not null and embedding is not null").select("vec_id", "embedding").mapInArrow(_packed_blocks(block), "ids binary, flat binary")
    pairs = packed(queries).select(F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat")).crossJoin(packed(vectors))  # of blocks
    out = pairs.mapInArrow(_nearest_of_blocks(k), "query_id long, vec_id long, distance double")
    at = W.partitionBy("query_id").orderBy("distance", "vec_id")
    return out.withColumn("nth", F.row_number().over(at)).where(F.col("nth") <= k)


def neighbour_disagreement(neighbours: DataFrame, labels: DataFrame, majority: float = 0.8) -> DataFrame:
    """Rows (vec_id, label) whose neighbours' most frequent label, of a share of `majority` or more, is another one."""
    votes = neighbours.join(labels, "vec_id").groupBy("query_id", "label").agg(F.count("*").alias("n"))
    best = votes.groupBy("query_id").agg(F.max(F.struct("n", (-F.col("label")).alias("label"))).alias("best"), F.sum("n").alias("k"))
    own = best.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return own.select("query_id", "own", (-F.col("best.label")).alias("majority"), F.round(F.col("best.n") / F.col("k"), 6).alias("share")).where(F.col("share") >= majority).where("own <> majority")
