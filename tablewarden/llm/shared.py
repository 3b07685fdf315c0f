"""Spark helpers of the training-data operators: shared-folder tables and packed exchanges."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that Spark hands to a Python worker.
BATCH_BYTES = 8 << 20


def session_defaults(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, so that batches of very long texts stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):  # Python workers of a local session find the package where the driver did
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH")) if x)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine, but only if all of Spark runs on it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
    return root.rstrip("/")


#: Spark's setting by which the shuffle files of a query go when it ends; else they stay until the driver collects its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, freed: bool = False) -> DataFrame:
    """Write a stage in the shared folder and read it back: it cuts lineage and survives lost executors.

    freed: the shuffle files of this write go with its end; nothing else reads them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, None)
    if freed:
        spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        if freed:
            spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """Buckets of a packed exchange: the session's shuffle partitions, which grow with the data."""
    return min(65536, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, n: int) -> DataFrame:
    """Send each packed row to the partition that its column `part` names."""
    return df.repartitionById(n, F.col("part"))


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only GNU's allocator has it
        ctypes.CDLL(None).malloc_trim(0)


def by_bytes(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about `limit` text bytes; one longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
    release()


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    return starts, np.diff(np.concatenate((starts, [len(keys)])))


#: A packed row: documents in order (differences of ids), values for each, and arrays of as many values.
PACKED = "part int, docs binary, counts binary, a binary, b binary, c binary"


def packed(part: np.ndarray, doc: np.ndarray, **arrays: np.ndarray) -> Iterator[dict]:
    """Rows of PACKED for values that are sorted by (part, doc)."""
    starts, lengths = runs(part)
    for s, n in zip(starts.tolist(), lengths.tolist()):
        d = doc[s : s + n]
        first, count = runs(d)
        row = {"part": int(part[s]), "docs": np.diff(d[first], prepend=0).astype("<i8").tobytes(), "counts": count.astype("<u4").tobytes(), "a": b"", "b": b"", "c": b""}
        yield row | {k: np.ascontiguousarray(v[s : s + n]).tobytes() for k, v in arrays.items()}


def unpacked(row: dict, **kinds: str) -> tuple[np.ndarray, ...]:
    """The document of each value, then the arrays."""
    ids = np.cumsum(np.frombuffer(row["docs"], "<i8"))
    return (np.repeat(ids, np.frombuffer(row["counts"], "<u4")), *(np.frombuffer(row[k], t) for k, t in kinds.items()))


SCHEMA = pa.schema([("part", pa.int32()), *((k, pa.binary()) for k in ("docs", "counts", "a", "b", "c"))])


def as_batches(rows: Iterator[dict], schema: pa.Schema = SCHEMA, at_once: int = 64) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)
    held = []
    release()


def target_of(doc: np.ndarray, n: int) -> np.ndarray:
    """Partition of a document among n."""
    return ((doc ^ (doc >> 7) ^ (doc >> 17)) % n).astype(np.int32)


def target_column(doc: Column, n: int) -> Column:
    """The same, of a column of longs."""
    return F.pmod(doc.bitwiseXOR(F.shiftright(doc, 7)).bitwiseXOR(F.shiftright(doc, 17)), F.lit(n)).cast("int")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
