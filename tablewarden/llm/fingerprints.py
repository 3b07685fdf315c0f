"""Operator 4: one-permutation MinHash fingerprints, with DataFrame functions alone.

Each shingle (five words) is hashed once; the top bits of the hash name its bin and each bin keeps its least hash.
An empty bin borrows, by optimal densification, from a bin with a value: the first in an order of all
bins that is random for each empty bin, the same for every text (`TRIES` bins by a hash of the try, then the others by a hash of theirs). Of each bin the lowest `BITS` bits are kept, as
hexadecimal digits, and the chance that such bits agree by accident is taken out of the likeness.

Defined results: a null text is an empty one; a text without words has an empty fingerprint, which is like another
empty one (1) and like nothing else (0); one of 1 to 4 words is one shingle; the last document's next one is the
first; of one document alone, itself; rows that share an id follow each other in the order of their texts' hashes; a null
id comes first; a table without rows gives none; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import documents, written

BINS = 128
BITS = 8
DIGITS = BITS // 4
#: Characters that end a word.
SPACE = " \t\n\x0b\x0c\r"


def shingle_hashes(text: str, k: int = 5) -> tuple[Column, Column]:
    """The words of a text column; and, of the column `words`, the hash of each shingle of k words."""
    words = F.split(F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE)), "[\\x20\\x09-\\x0D]+")
    n = F.size("words")
    whole = F.array(F.xxhash64(F.array_join("words", " ")))
    each = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(F.col("words"), i + j) for j in range(k))))
    return words, F.when(F.get("words", F.lit(0)) == "", F.array().cast("array<bigint>")).when(n < k, whole).otherwise(each)


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - (BINS - 1).bit_length())


def bin_minima(hashes: str) -> Column:
    """The least hash of each bin that has one, ordered (signed) by hash; so neighbours of other bins begin a bin."""
    ordered = F.sort_array(F.col(hashes))
    return F.aggregate(F.array(ordered), F.array().cast("array<bigint>"), lambda _, a: F.filter(a, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(a, i - 1)))))


#: Bins that an empty bin looks at by number, before it takes the first of those left in an order of its own.
TRIES = 16


def own_digits(minima: str, bins: str) -> tuple[Column, Column]:
    """The digits of each minimum; and, of the column `low`, those of each bin, null where it has none. minima, bins: of those that have one."""
    low = F.transform(F.col(minima), lambda h: F.lpad(F.hex(h.bitwiseAND(F.lit((1 << BITS) - 1))), DIGITS, "0"))
    each = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get("low", F.nullif(F.array_position(F.col(bins), j.cast("bigint")), F.lit(0)).cast("int") - 1))
    half = BINS // 2  # minima are in order of signed hashes: the bins of the upper half first
    return low, F.when(F.size(bins) == BINS, F.concat(F.slice("low", half + 1, half), F.slice("low", 1, half))).otherwise(each)


def densified(bins: str) -> Column:
    """Digits of all bins, of the columns `low` and `own`: the bin's own or those that it borrows. An empty bin looks at bins in a fixed
    order until one is filled; coalesce ends with the first."""

    def digit(d: Column, j: Column) -> Column:
        tries = (F.get("own", F.hash(F.lit(t), j).bitwiseAND(BINS - 1)) for t in range(TRIES))
        last = F.array_min(F.transform(F.col(bins), lambda b, i: F.struct(F.hash(j, b).alias("rank"), i.alias("i"))))["i"]
        return F.coalesce(d, *tries, F.get("low", last))

    return F.array_join(F.transform("own", digit), "")


def fingerprint(rows: DataFrame, text: str, out: str, k: int = 5) -> DataFrame:
    """rows with the fingerprint of a text column. The steps are columns, so each is computed once."""
    words, hashes = shingle_hashes(text, k)
    keep = [F.col(c) for c in rows.columns]
    step = rows.select(*keep, words.alias("words"))
    step = step.select(*keep, hashes.alias("hashes"))
    step = step.select(*keep, bin_minima("hashes").alias("minima"))
    step = step.select(*keep, "minima", F.transform("minima", _bin).alias("filled"))
    low, own = own_digits("minima", "filled")
    step = step.select(*keep, "filled", low.alias("low"))
    step = step.select(*keep, "filled", "low", own.alias("own"))
    return step.select(*keep, F.when(F.size("filled") == 0, "").otherwise(densified("filled")).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints: the share of bins with equal bits, less what chance gives."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substr(a, i * DIGITS - (DIGITS - 1), F.lit(DIGITS)) == F.substr(b, i * DIGITS - (DIGITS - 1), F.lit(DIGITS))))
    chance = 2.0**-BITS
    rest = F.greatest(F.lit(0.0), (same / F.lit(BINS) - chance) / (1 - chance))
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(rest)


#: Quantiles of the ids that place a row among all.
QUANTILES = 512


def with_bucket(rows: DataFrame) -> DataFrame:
    """rows with a bucket: buckets of about as many neighbouring rows (doc_id, h) as there are buckets, by rank: exact at quantiles of the ids, and
    in proportion between two. Null ids come first, by hash. Only the quantiles come to the driver."""
    shares = [i / QUANTILES for i in range(QUANTILES + 1)] + [1 - 10.0**-i for i in (3, 4)]
    known, n = rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, sorted(shares))), F.lit(100 * QUANTILES)), F.count("*")).first()
    at, share = [], []
    for x, s in zip(known or [0], sorted(shares)):
        if not at or x > at[-1]:
            at.append(x), share.append(s)
    bounds, ranks = F.array(*map(F.lit, at)), F.array(*map(F.lit, share))
    i = F.greatest(F.size(F.filter(bounds, lambda x: x <= F.col("doc_id"))) - 1, F.lit(0))
    rows = rows.withColumn("_i", i)  # the segment, searched for once
    low, high = F.get(bounds, F.col("_i")).cast("double"), F.get(bounds, F.col("_i") + 1).cast("double")
    part = F.coalesce(F.try_divide(F.col("doc_id").cast("double") - low, high - low), F.lit(0.0))  # as doubles, ids are never too far apart
    rank = F.get(ranks, F.col("_i")) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)) * (F.coalesce(F.get(ranks, F.col("_i") + 1), F.lit(1.0)) - F.get(ranks, F.col("_i")))
    many = max(1, int(n**0.5))
    null = F.floor(F.col("h").cast("double") / 2.0**64 * many).cast("long") - many  # below all others
    return rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), null).otherwise(F.floor(rank * many).cast("long"))).drop("_i")


def in_buckets(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, h) in buckets of neighbouring ids, about as many as each holds, with a copy (extra) of the
    row that follows the bucket's last: the next bucket's first, after the last bucket the first one's."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = with_bucket(rows)
    heads = written(rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("head")), "heads")
    order = W.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(order), F.last("bucket").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    heads = heads.select(F.col("bucket").alias("of"), "head", before.alias("to"))
    same = (rows.bucket == heads.of) & rows.doc_id.eqNullSafe(heads["head"]["doc_id"]) & (rows.h == heads["head"]["h"])
    copies = rows.join(heads, same).groupBy("to", "doc_id", "h").agg(F.first("text").alias("text"))
    copies = copies.select("doc_id", "text", F.col("to").alias("bucket"), "h", F.lit(True).alias("extra"))
    return rows.withColumn("extra", F.lit(False)).unionByName(copies)


def fingerprints(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next of every row of docs."""
    at = W.partitionBy("bucket").orderBy("extra", "doc_id", "h")
    half = F.floor(F.length("text") / 2).cast("int")
    rows = in_buckets(docs).withColumn("next", F.lead("text").over(at))
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next", F.lit(1), half))
    rows = rows.select("bucket", "extra", "doc_id", "h", "text", F.length("text").cast("long").alias("n_chars"), F.when(~F.col("extra"), edited).alias("edited"))
    rows = fingerprint(rows, "text", "fingerprint", k)
    rows = rows.drop("text")
    rows = fingerprint(rows, "edited", "edited_fingerprint", k)
    rows = rows.withColumn("next_fingerprint", F.lead("fingerprint").over(at)).where("not extra")
    near = lambda other: likeness(F.col("fingerprint"), F.col(other))
    return rows.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))


def op4_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints(documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
