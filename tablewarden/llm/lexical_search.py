"""Operator 12: ranked lexical search by MaxScore, shard by shard.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A to Z are lower-cased. Three passes:

1. Each slice of documents (a shard) becomes an inverted index of the terms that the items ask for: documents with a term and
   how often they have it. It is written. Terms are found by hash and then compared byte by byte.
2. Counts of documents (df), N and L are summed over the shards; with them each term gets its weight.
3. Each shard is searched for each item: its terms are ordered by their upper bound in the shard. Those at the end whose
   bounds together can't bring a document among the best are non-essential: only documents of the essential lists are
   candidates, and the other lists are probed, from the greatest bound down, for those that can still qualify. What a task has
   found for an item bounds its next shards. The best of all tasks are merged.

Items come in blocks of about `ITEM_BYTES` of text, so that the terms sent to the tasks, and their counts, are bounded.

Defined results: a null or empty text has no term, and isn't counted; an item without terms, or whose terms no document has, gets no
row; rows that share an item_id are one item with the terms of all (a null item_id too); rows of documents that share an id are documents of their
own; a null doc_id comes last among equal scores; a table without rows gives none; extra columns are ignored.
"""

from __future__ import annotations

import math
import string
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import by_bytes, documents, release, session_defaults, shared_folder, written
from .words import Words, hashes

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ITEM_BYTES = 4 << 20
SHARD_BYTES = 16 << 20
#: What each byte stands for: A to Z for a to z, other ASCII than letters and digits for a space.
FOLD = np.array([b if b >= 128 or chr(b) in string.ascii_lowercase + string.digits else b + 32 if chr(b) in string.ascii_uppercase else 32 for b in range(256)], np.uint8)
B = 75  # of 100: how much a document's length counts


class Terms:
    """The terms of a block of items, in order of their hashes."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        size = np.array([len(t) for t in raw], np.int64)
        buf, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum(size)))
        h = hashes(buf, at[:-1], at[1:])
        order = np.argsort(h)
        self.terms, self.buf, self.hash, self.start, self.size = [terms[i] for i in order], buf, h[order], at[:-1][order], size[order]

    def match(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Words that are terms, and which."""
        if not len(self.hash) or not len(words.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        term = np.minimum(np.searchsorted(self.hash, words.hash), len(self.hash) - 1)
        word = np.flatnonzero((self.hash[term] == words.hash) & (self.size[term] == words.end - words.start))
        term = term[word]
        n = self.size[term]
        past = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        same = words.buf[np.repeat(words.start[word], n) + past] == self.buf[np.repeat(self.start[term], n) + past]
        good = np.logical_and.reduceat(same, np.cumsum(n) - n) if len(n) else np.zeros(0, bool)
        return word[good], term[good]


SHARD = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), *((k, pa.binary()) for k in ("docs", "known", "lengths", "terms", "counts", "places", "tfs"))])
SHARD_DDL = "n_docs long, n_terms long, docs binary, known binary, lengths binary, terms binary, counts binary, places binary, tfs binary"


def _index(sent, size: int):
    """A shard for each slice: its numbers of documents and terms; documents with a wanted term; postings by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch in by_bytes(batches, size):
            words = Words(batch.column("text"), FOLD)
            word, term = wanted.match(words)
            key, tf = np.unique(term * batch.num_rows + words.doc[word], return_counts=True)
            term, doc = np.divmod(key, batch.num_rows)
            have, place = np.unique(doc, return_inverse=True)
            terms, counts = np.unique(term, return_counts=True)
            ids = batch.column("doc_id").take(pa.array(have))
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            arrays = (ids.fill_null(0).to_numpy(), known, words.count[have], terms, counts, place, tf)
            kinds = ("<i8", "u1", "<i8", "<i4", "<i4", "<i4", "<u4")
            row = [int((words.count > 0).sum()), int(words.count.sum()), *(np.asarray(a).astype(k).tobytes() for a, k in zip(arrays, kinds))]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, SHARD)], schema=SHARD)
            del words

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents with it) of a task; term -1: documents, -2: terms with repeats."""
    total: dict[int, int] = {}
    for batch in batches:
        for row in batch.to_pylist():
            own = zip(np.frombuffer(row["terms"], "<i4").tolist(), np.frombuffer(row["counts"], "<i4").tolist())
            for k, n in (*own, (-1, row["n_docs"]), (-2, row["n_terms"])):
                total[k] = total.get(k, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["term", "n"])


def length_norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - B + B * n * N div L of each document."""
    if len(lengths) and B * int(lengths.max()) * n_docs >= 1 << 63:
        return np.array([100 - B + B * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
    return 100 - B + B * lengths * n_docs // max(1, n_terms)


class Shard:
    """Postings of a shard: for term i documents places[at[i]:at[i + 1]] (ascending) and their integer parts of the score."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.docs, self.known = np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["known"], "u1").astype(bool)
        self.terms, counts = np.frombuffer(row["terms"], "<i4"), np.frombuffer(row["counts"], "<i4")
        self.at = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        self.places, tf = np.frombuffer(row["places"], "<i4"), np.frombuffer(row["tfs"], "<u4").astype(np.int64)
        m = length_norms(np.frombuffer(row["lengths"], "<i8"), n_docs, n_terms)
        self.parts = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.places])
        self.most = np.maximum.reduceat(self.parts, self.at[:-1]) if len(counts) else np.zeros(0, np.int64)

    def lists(self, terms: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, int]]:
        """(upper bound, weight, place of the term) of the terms that occur, from the greatest bound down."""
        i = np.searchsorted(self.terms, terms)
        some = np.flatnonzero((i < len(self.terms)) & (self.terms[np.minimum(i, len(self.terms) - 1)] == terms) & (weights > 0)) if len(self.terms) else np.zeros(0, np.int64)
        found = zip((weights[some] * self.most[i[some]]).tolist(), weights[some].tolist(), i[some].tolist())
        return sorted(found, reverse=True)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that may be among the k best and reach least (1 or more)."""
        lists = self.lists(terms, weights)
        rest = np.concatenate((np.cumsum([u for u, _, _ in lists][::-1], dtype=np.int64)[::-1], [0]))
        score, need, i = np.zeros(len(self.docs), np.int64), max(1, least), 0
        while i < len(lists) and rest[i] >= need:  # essential: a document of this list and later ones alone can qualify
            _, w, j = lists[i]
            a, b = self.at[j], self.at[j + 1]
            score[self.places[a:b]] += w * self.parts[a:b]
            i += 1
            if i & (i - 1) == 0 or i % 8 == 0:
                need = max(need, self._kth(score, k))
        need = max(need, self._kth(score, k))
        at = np.flatnonzero((score + rest[i] >= need) & (score > 0))
        got = score[at]
        for n, (_, w, j) in enumerate(lists[i:], i):
            able = got + rest[n] >= need
            at, got = at[able], got[able]
            a, b = self.at[j], self.at[j + 1]
            where = np.minimum(np.searchsorted(self.places[a:b], at), b - a - 1)
            hit = self.places[a:b][where] == at
            got = got + np.where(hit, w * self.parts[a:b][where], 0)
            need = max(need, self._kth(got, k))
        return at[got >= need], got[got >= need]

    @staticmethod
    def _kth(scores: np.ndarray, k: int) -> int:
        return int(np.partition(scores, -k)[-k]) if len(scores) >= k else 0


FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _search(sent, k: int):
    """The k best documents of a task's shards for each item of the broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, n_docs, n_terms = sent.value
        kept = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in items]
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, n_docs, n_terms)
                for i, (terms, weights) in enumerate(items):
                    held = kept[i]
                    at, score = shard.best(terms, weights, k, int(held[2][-1]) if len(held[2]) == k else 1)
                    if len(at):
                        doc, unknown, score = (np.concatenate(x) for x in zip(held, (shard.docs[at], ~shard.known[at], score)))
                        order = np.lexsort((doc, unknown, -score))[:k]
                        kept[i] = doc[order], unknown[order], score[order]
        for i, (doc, unknown, score) in enumerate(kept):
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(doc), pa.int32()), pa.array(doc, pa.int64(), mask=unknown), pa.array(score)], schema=FOUND)
        release()

    return run


def item_terms(items: DataFrame) -> DataFrame:
    """block, item_id, term and how often the item has it."""
    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), lower.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(-(-size // ITEM_BYTES) or 1)))
    terms = rows.select("block", "item_id", F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("term"))
    return terms.groupBy("block", "item_id", "term").agg(F.count("*").alias("n"))


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    spark = docs.sparkSession
    session_defaults(spark)
    asked = written(item_terms(items), "item-terms")
    blocks = [r["block"] for r in asked.select("block").distinct().orderBy("block").collect()]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, schema = f"{shared_folder(spark)}/ranked-{uuid.uuid4().hex}", "item_id long, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(found)
    for block in blocks:
        rows = asked.where(F.col("block") == block).orderBy("item_id", "term").collect()
        wanted = Terms(sorted({r["term"] for r in rows}))
        number = {t: i for i, t in enumerate(wanted.terms)}
        sent = spark.sparkContext.broadcast(wanted)
        shards = written(texts.mapInArrow(_index(sent, SHARD_BYTES), SHARD_DDL), "shards")
        counts = shards.select("n_docs", "n_terms", "terms", "counts").mapInArrow(_counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
        df = {r["term"]: r["n"] for r in counts.collect()}
        n_docs, n_terms = df.pop(-1, 0), df.pop(-2, 0)
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        by_item: dict[int | None, list[tuple[int, int]]] = {}
        for r in rows:
            if (t := number[r["term"]]) in weight:
                by_item.setdefault(r["item_id"], []).append((t, weight[t] * r["n"]))
        items_ = list(by_item)
        lists = [tuple(np.array(x, np.int64) for x in zip(*by_item[i])) for i in items_]
        ask = spark.sparkContext.broadcast((lists, n_docs, n_terms))
        names = F.broadcast(spark.createDataFrame(list(enumerate(items_)), "item int, item_id long"))  # of one block
        hits = shards.mapInArrow(_search(ask, k), "item int, doc_id long, score long").join(names, "item")
        hits.select("item_id", "doc_id", "score").write.mode("append").parquet(found)
        sent.unpersist(), ask.unpersist()
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = spark.read.schema(schema).parquet(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}')"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
    a AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
    q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY 1, 2),
    p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
    f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM p, a GROUP BY 1),
    m AS (SELECT rid, doc_id, 100 - 75 + (75 * len(w) * n_docs) // n_terms AS norm FROM d, a),
    s AS (SELECT item_id, rid, any_value(doc_id) AS doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * norm))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
