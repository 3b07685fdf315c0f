"""Operator 6: pack token sequences by minimum bin slack.

Documents become token ids and an end id; only those longer than a sequence are cut. Pieces of one length are
interchangeable, so the plan needs the number of pieces of each length alone: at most `capacity` numbers, whatever
the input. For each bin the longest piece left is taken, and subset-sum dynamic programming over the lengths
left, with their numbers, as bits of one integer, finds the fullest combination with it. That bin is repeated as
often as its pieces last, then removed. Pieces find their bin by their rank within their length, which is counted
in buckets, so no length has to be ranked in one task.

Defined results: a null text is an empty one, a document of one piece with the end id alone; rows that share an id
are packed each (their pieces have the same numbers); a null id is kept; a table without rows gives none; extra
columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import by_bytes, documents, parts, session_defaults, written

END = 0


#: The one way of splitting texts whose tokenizer files are read here; the pattern is that of the byte-level pre-tokenizer.
SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of white space in one run, or of one word, above which the tokenizer itself encodes a text.
LONG_RUN = re.compile(r"\s{20000}|\w{20000}|[^\w\s]{20000}")


@functools.lru_cache(1)
def encoder(path: str):
    """Token ids of a text, as the tokenizer file at `path` gives them.

    The file's vocabulary and ranks also hold for tiktoken, which gives the same ids several times as fast.
    Texts with the special token's name, and those with very long runs (which its pattern can't bear), take the tokenizer itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    whole = functools.cache(lambda: Tokenizer.from_file(path))  # few texts need it
    spec = json.load(open(path, encoding="utf-8"))
    if spec.get("normalizer") or spec["model"].get("type") != "BPE" or any((spec.get("pre_tokenizer") or {}).get(k) != v for k, v in SPLIT.items()):
        raise ValueError(f"{path}: only byte-level BPE without a normalizer is known here")
    special = {t["content"] for t in spec.get("added_tokens", ())}
    symbols = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in symbols} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in symbols)}
    ranks = {bytes(byte_of[ch] for ch in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if any(s in text for s in special) or len(text) >= 20_000 and LONG_RUN.search(text):
            return np.array(whole().encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())

    return ids


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.uint32()))])


def _cut(path: str, capacity: int, with_ids: bool):
    schema = pa.schema(list(PIECES)[:5] + [pa.field("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path)
        for batch in by_bytes(batches):
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                got = np.append(ids_of(text or ""), np.uint32(END)).astype("<u4")
                at = 0
                for j, end in enumerate(range((len(got) - 1) % capacity + 1, len(got) + 1, capacity)):
                    doc.append(i), piece.append(j), start.append(at), length.append(end - at), crc.append(zlib.crc32(got[at:end].tobytes()))
                    if with_ids:
                        ids.append(got[at:end].astype(np.int32))
                    at = end
            cols = [doc, piece, start, length, crc, *([ids] if with_ids else ())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): of a cut document the first piece may be shorter."""
    session_defaults(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cut(tokenizer, capacity, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def fullest(room: int, left: dict[int, int]) -> list[int]:
    """Lengths, each at most as often as `left` has it, whose sum comes closest to room without exceeding it."""
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in sorted((x for x in left if x <= room), reverse=True):
        n, chunk = min(left[length], room // length), 1
        while n and not reach >> room & 1:
            take = min(chunk, n)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            n, chunk = n - take, chunk * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            out += [length] * take
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how many bins, the lengths in one) until no piece is left."""
    left, out = {k: n for k, n in counts.items() if n}, []
    while left:
        longest = max(left)
        rest = {k: n - (k == longest) for k, n in left.items() if n > (k == longest)}
        bin_ = [longest, *fullest(capacity - longest, rest)]
        need = {k: bin_.count(k) for k in bin_}
        times = min(left[k] // n for k, n in need.items())
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((times, bin_))
    return out


def _places(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length: (first rank, first sequence, pieces in one sequence, offset of the first), by rank."""
    used, sequence, out = dict.fromkeys(counts, 0), 0, {k: [] for k in counts}
    for times, bin_ in plan(counts, capacity):
        offset = 0
        for length in sorted(set(bin_), reverse=True):
            n = bin_.count(length)
            out[length].append((used[length], sequence, n, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    return out


def _assign(places: dict[int, list[tuple[int, int, int, int]]]):
    tables = {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in places.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length).tolist():
                at = np.flatnonzero(length == size)
                first, seq, n, off = tables[size]
                k = np.searchsorted(first, rank[at], "right") - 1
                past = rank[at] - first[k]
                sequence[at] = seq[k] + past // n[k]
                offset[at] = off[k] + past % n[k] * size
            cols = [c for c in batch.schema.names if c not in ("rank", "bucket")]
            yield pa.RecordBatch.from_arrays([*map(batch.column, cols), pa.array(sequence), pa.array(offset)], [*cols, "sequence_id", "offset"])

    return run


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """The pieces with sequence_id and offset. `cut` must give the same rows each time it is read (a written table)."""
    spark = cut.sparkSession
    n = parts(spark)
    rows = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).cast("int"))
    by_bucket = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    by_bucket = written(by_bucket.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    order = ["doc_id", "piece", "start", "ids_crc32"]
    ranked = rows.withColumn("nth", F.row_number().over(W.partitionBy("length", "bucket").orderBy(*order)) - 1)
    ranked = ranked.join(by_bucket.select("length", "bucket", "before"), ["length", "bucket"]).withColumn("rank", (F.col("nth") + F.col("before")).cast("long"))
    ranked = ranked.select(*cut.columns, "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_assign(_places(counts, capacity)), schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of docs with their place; with_ids: their token ids too."""
    return pack(written(pieces(docs, tokenizer, capacity, with_ids), "pieces"), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), default_tokenizer(), 2048)
