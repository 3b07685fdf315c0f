"""Operator 11: exact top-k search by vector-approximation files.

Components become integers, x -> floor(scale * x). Rows with one and the same vector are a class, of which the k + 1 smallest
ids are kept, so a vector that a third of all rows share is scored once. Classes lie in blocks, each with its vectors and their
cells: in each dimension the number of the interval that holds the component. The bounds between intervals are quantiles of a
sample of `SAMPLE` classes; the outer intervals end at the block's own least and greatest component, so the cells of every row
are right. A task scans the cells of its blocks for the bounds of each inner product (the middle of the cell, and its half
width times the query's absolute values), drops what can't reach the k-th result, and reads the exact vectors of the rest
from the highest bound down, until no bound left reaches the k-th exact score.

Queries come in blocks of about `QUERIES` distinct vectors; one block at a time is sent to all tasks, as a bounded broadcast.
The k + 1 best of each task are merged by query; a query's own row is taken out last.

Defined results: vectors that are null or hold null or non-finite components, rows without an id, and vectors of another
length than the most frequent one (of equally frequent ones the longest) take no part; repeated rows (id and vector) count once; rows that share
an id but differ are each a candidate, and each a query; equal scores go by id; components and scores outside 64 bits are
held at their ends; a table without queries, or with one row, gives none; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import documents, release, session_defaults, shared_folder, written

CELLS = 64
SAMPLE = 4096
BLOCK = 2048
QUERIES = 8192
#: Queries of a block that are scanned at once.
TILE = 512
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and v (doubles) of the vectors of finite components that have the most frequent length."""
    v = F.col(column).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (most["n"] if most else 0))


def _key() -> list[Column]:
    """Two independent 64-bit hashes stand for a vector."""
    return [F.xxhash64("v").alias("h"), F.xxhash64(F.lit(7), "v").alias("h2")]


def matrix(column: pa.Array, kind: str = "<i8") -> np.ndarray:
    """Rows of a list column whose lists have one length and no nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, kind).reshape(len(column), -1)


BLOCKS = pa.schema([("dims", pa.int32()), ("cells", pa.binary()), ("vectors", pa.binary()), ("hash", pa.binary()), ("ids", pa.binary())])


def _encode(edges: np.ndarray, held: int, size: int):
    """Packed blocks of classes. edges: dims x (CELLS - 1) bounds; ids are padded with the greatest long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = matrix(part.column("v"))
                cells = np.empty(x.shape, np.uint8)
                for j, e in enumerate(edges):
                    cells[:, j] = np.searchsorted(e, x[:, j], "right")
                ids = np.full((len(x), held), _MOST, np.int64)
                n = part.column("ids").value_lengths().to_numpy(zero_copy_only=False)
                ids[np.arange(held) < n[:, None]] = part.column("ids").flatten().to_numpy(zero_copy_only=False)
                row = [[x.shape[1]], [cells.tobytes()], [x.tobytes()], [part.column("h").to_numpy().astype("<i8").tobytes()], [np.column_stack((n, ids)).astype("<i8").tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, BLOCKS)], schema=BLOCKS)
        release()

    return run


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact, held within 64 bits."""
    top = _top(q) * _top(x) * max(1, q.shape[1])
    if top < 1 << 62:
        return np.einsum("ij,ij->i", q, x)
    return np.array([min(max(int(a @ b), _LEAST), _MOST) for a, b in zip(q.astype(object), x.astype(object))], np.int64)


def _top(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min()), 1) if x.size else 1


def bounds(q: np.ndarray, cells: np.ndarray, x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each query with each cell; of x only the outer ends of its dimensions are used."""
    dims = np.arange(x.shape[1])
    low = np.concatenate((np.minimum(x.min(0), edges[:, 0])[:, None], edges), 1).astype(float)
    high = np.concatenate((edges - 1, np.maximum(x.max(0), edges[:, -1])[:, None]), 1).astype(float)
    middle, half = ((low + high) / 2)[dims, cells], ((high - low) / 2)[dims, cells]
    f = q.astype(float)
    at, off = f @ middle.T, np.abs(f) @ half.T
    top = float(_top(q)) * max(_top(x), _top(edges)) * max(1, q.shape[1])
    off += top * 2.0**-44 if top >= 2.0**50 else 0.0  # below, all these numbers are exact
    return np.clip(at - off, _LEAST, _MOST), np.clip(at + off, _LEAST, _MOST)


def nth_of(groups: np.ndarray) -> np.ndarray:
    """Place of each value among its equals, of sorted values."""
    return np.arange(len(groups)) - np.searchsorted(groups, groups)


class Best:
    """The k classes of highest score of each of n queries, ties to the smaller first id."""

    def __init__(self, n: int, k: int, held: int):
        self.n, self.k = n, k
        self.q, self.score, self.hash, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, held + 1), np.int64)

    def add(self, q: np.ndarray, score: np.ndarray, hash_: np.ndarray, ids: np.ndarray) -> None:
        q, score, hash_, ids = np.concatenate((self.q, q)), np.concatenate((self.score, score)), np.concatenate((self.hash, hash_)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids[:, 1], ~score, q))
        order = order[nth_of(q[order]) < self.k]
        self.q, self.score, self.hash, self.ids = q[order], score[order], hash_[order], ids[order]

    def kth(self) -> np.ndarray:
        """The k-th score of each query; the least long where there are fewer."""
        out, last = np.full(self.n, _LEAST, np.int64), np.searchsorted(self.q, np.arange(self.n), "right") - 1
        full = np.bincount(self.q, minlength=self.n) >= self.k
        out[full] = self.score[last[full]]
        return out


def search_block(best: Best, q: np.ndarray, cells: np.ndarray, x: np.ndarray, hashes: np.ndarray, ids: np.ndarray, edges: np.ndarray) -> int:
    """Merge a block's classes into best; the number of exact vectors that were read."""
    low, high = bounds(q, cells, x, edges)
    need = best.kth().astype(float)
    if len(x) >= best.k:
        need = np.maximum(need, np.partition(low, -best.k, axis=1)[:, -best.k])
    qi, xi = np.nonzero(high >= need[:, None])
    reach = high[qi, xi]
    order = np.lexsort((-reach, qi))
    qi, xi, reach = qi[order], xi[order], reach[order]
    nth, done, step = nth_of(qi), 0, 2 * best.k
    read = 0
    while len(qi):
        now = nth < done + step
        best.add(qi[now], exact(q[qi[now]], x[xi[now]]), hashes[xi[now]], ids[xi[now]])
        read, done, step = read + int(now.sum()), done + step, 2 * step
        left = ~now & (reach >= best.kth().astype(float)[qi])
        qi, xi, reach, nth = qi[left], xi[left], reach[left], nth[left]
    return read


FOUND = pa.schema([("h", pa.int64()), ("h2", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64()), ("of", pa.int64())])


def _search(sent, k: int, edges: np.ndarray, tile: int):
    """The k best (score, id, hash of its vector) of a task's blocks, for each query of the broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, queries = sent.value
        best = [Best(len(queries[i : i + tile]), k, k) for i in range(0, len(queries), tile)]
        for batch in batches:
            for row in batch.to_pylist():
                d = row["dims"]
                x = np.frombuffer(row["vectors"], "<i8").reshape(-1, d) if d else np.zeros((len(row["hash"]) // 8, 0), np.int64)
                cells, hashes = np.frombuffer(row["cells"], np.uint8).reshape(x.shape), np.frombuffer(row["hash"], "<i8")
                ids = np.frombuffer(row["ids"], "<i8").reshape(len(x), -1)
                for i, b in enumerate(best):
                    search_block(b, queries[i * tile : i * tile + tile], cells, x, hashes, ids, edges)
        for i, b in enumerate(best):
            some = np.arange(b.ids.shape[1] - 1) < b.ids[:, :1]
            n = some.sum(1)
            q, score, of, ids = np.repeat(b.q, n), np.repeat(b.score, n), np.repeat(b.hash, n), b.ids[:, 1:][some]
            order = np.lexsort((ids, ~score, q))
            order = order[nth_of(q[order]) < k]
            key = keys[i * tile + q[order]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key[:, 0], key[:, 1], score[order], ids[order], of[order])], schema=FOUND)
        release()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with all other rows.

    is_query: of a row's vec_id.
    """
    spark = vectors.sparkSession
    session_defaults(spark)
    rows = usable(vectors).where("vec_id IS NOT NULL").withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long")))
    held = k + 1  # one may be the query's own
    by_vector = rows.withColumn("nth", F.dense_rank().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("nth") <= held)
    classes = written(by_vector.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select("v", "ids", *_key()), "classes")
    queries = written(rows.where(is_query).select("vec_id", "v").distinct().select("vec_id", "v", *_key()), "queries")
    share = min(1.0, 2 * SAMPLE / max(1, classes.count()))  # so few rows are ordered, whatever the number of tasks
    sample = classes.where(F.shiftrightunsigned("h", 33) <= F.lit(share * 2**31)).orderBy("h", "h2").limit(SAMPLE).select("v").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    edges = np.quantile(np.array([r["v"] for r in sample], np.int64), np.arange(1, CELLS) / CELLS, axis=0, method="lower").T.copy()
    cells = written(classes.mapInArrow(_encode(edges, held, BLOCK), "dims int, cells binary, vectors binary, hash binary, ids binary"), "cells")
    distinct = queries.select("v", "h", "h2").distinct()
    n = -(-distinct.count() // QUERIES)
    distinct = written(distinct.withColumn("block", F.pmod("h", F.lit(max(n, 1)))), "query-vectors")
    found = f"{shared_folder(spark)}/found-{uuid.uuid4().hex}"
    schema = "h long, h2 long, score long, vec_id long, of long"
    spark.createDataFrame([], schema).write.parquet(found)
    for i in range(n):
        block = distinct.where(F.col("block") == i).select("h", "h2", "v").toArrow()
        keys = np.column_stack([block.column(c).to_numpy() for c in ("h", "h2")]).astype(np.int64)
        sent = spark.sparkContext.broadcast((keys, matrix(block.column("v").combine_chunks()) if block.num_rows else np.zeros((0, len(edges)), np.int64)))
        cells.mapInArrow(_search(sent, held, edges, TILE), schema).write.mode("append").parquet(found)
        sent.unpersist()
    found = spark.read.schema(schema).parquet(found)
    found = found.withColumn("nth", F.row_number().over(W.partitionBy("h", "h2").orderBy(F.desc("score"), "vec_id", "of"))).where(F.col("nth") <= held)
    best = found.groupBy("h", "h2").agg(F.sort_array(F.collect_list(F.struct("nth", "score", "vec_id", "of"))).alias("best"))
    salts = 16  # many queries may share a vector
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = queries.select(F.col("vec_id").alias("query_id"), "h", "h2").withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(salts)).cast("int"))
    out = asked.join(best, ["h", "h2", "salt"])
    others = F.filter("best", lambda b: (b["vec_id"] != F.col("query_id")) | (b["of"] != F.col("h")))
    out = out.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def op11_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """WITH u AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS c, unnest(range(len(embedding))) AS dim FROM embeddings),
    x AS (SELECT vec_id, dim, CAST(floor(256 * c) AS BIGINT) AS x FROM u WHERE vec_id NOT IN (SELECT vec_id FROM u WHERE c IS NULL OR NOT isfinite(c))),
    s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(sum(q.x * x.x) AS BIGINT) AS score FROM x q JOIN x USING (dim) WHERE q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
