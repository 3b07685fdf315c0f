"""Operator 3: remove passages that an earlier document already has, by level-wise doubling.

Level 25 keeps, of each document, the smallest window hash among any 26 neighbours; a 50-word window can only be
repeated if its smallest 25-word window is. Windows of 50 words over a repeated one are the candidates of
level 50. From there each level joins two neighbouring windows that are both repeated into one of twice the
length, until no window is repeated. Every level is one exchange of packed hashes by hash and one back by document.

Words are removed if a window of `min_words` words covers them that also starts in a document with a smaller id.

Defined results: a null or empty text has no words and keeps its row; rows whose id is null, and rows that share
an id, are judged as documents of their own id (a null id: none is smaller, so nothing is removed and nothing is
lent to others; rows that share an id lose the union of their spans); a table without rows gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import PACKED, as_batches, by_bytes, dealt, documents, mix, packed, parts, runs, session_defaults, target_of, unpacked, written
from .words import Words


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _lowest(h: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours."""
    span, low = 1, h
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[: len(low) - (w - span)], low[w - span :]) if w > span else low


def _anchors(words: Words, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window of min_words words, and the smallest hash of its windows of half the length."""
    half = min_words // 2
    where, h = words.windows(half)
    full = np.full(len(words.hash), np.iinfo(np.uint64).max, np.uint64)
    full[where] = h
    n = len(full) - min_words + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = _lowest(full[: len(full) - half + 1], min_words - half + 1)
    ok = np.flatnonzero(words.doc[:n] == words.doc[min_words - 1 :])
    return ok, low[ok]


def _emit_anchors(min_words: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in by_bytes(batches):
                words = Words(batch.column("text"))
                where, low = _anchors(words, min_words)
                doc = words.doc[where]
                new = np.ones(len(low), bool)
                new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
                low, doc = low[new], batch.column("doc_id").to_numpy(zero_copy_only=False)[doc[new]]
                part = _bucket(low, n)
                order = np.lexsort((doc, part))
                yield from packed(part[order], doc[order], a=low[order])

        yield from as_batches(rows())

    return run


def _repeated(kinds: str, n: int, smaller: bool):
    """Keep values that more than one document has, and send them back to their documents.

    kinds "a": hashes alone; "ab": hashes with positions, and in c whether a smaller document has the hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, a, b = [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                d, h, *p = unpacked(row, **({"a": "<u8", "b": "<i4"} if kinds == "ab" else {"a": "<u8"}))
                doc.append(d), a.append(h), b.extend(p)
        if not doc:
            return
        doc, h = np.concatenate(doc), np.concatenate(a)
        order = np.lexsort((doc, h))
        doc, h = doc[order], h[order]
        first, count = runs(h)
        least = np.repeat(doc[first], count)
        many = np.repeat(doc[first] != doc[first + count - 1], count)
        doc, h, later = doc[many], h[many], (doc > least)[many]
        part = target_of(doc, n)
        extra = {"b": np.concatenate(b)[order][many], "c": later} if kinds == "ab" else {}
        order = np.lexsort((doc, part))
        extra = {k: v[order] for k, v in extra.items()}
        yield from as_batches(packed(part[order], doc[order], a=h[order], **extra))

    return run


def _by_document(kinds: str):
    """One row for each document: its values, ordered by position where there is one."""
    schema = pa.schema([("doc_id", pa.int64()), *((k, pa.binary()) for k in "abc")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"a": "<u8", "b": "<i4", "c": "?"} if kinds == "abc" else {"a": "<u8"}
        held: list[tuple] = [unpacked(row, **types) for batch in batches for row in batch.to_pylist()]
        if not held:
            return
        doc, *cols = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((cols[1], doc)) if kinds == "abc" else np.argsort(doc, kind="stable")
        doc, cols = doc[order], [c[order] for c in cols]
        starts, counts = runs(doc)
        rows = ({"doc_id": int(doc[s])} | {k: c[s : s + m].tobytes() for k, c in zip(types, cols)} for s, m in zip(starts.tolist(), counts.tolist()))
        yield from as_batches(rows, schema, 512)

    return run


BY_DOCUMENT = "doc_id long, a binary, b binary, c binary"


def _emit_candidates(min_words: int, n: int):
    """Windows of min_words words whose anchor is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in by_bytes(batches):
                words = Words(batch.column("text"))
                where, low = _anchors(words, min_words)
                doc = words.doc[where]
                lists = batch.column("a").to_pylist()
                keep = np.zeros(len(where), bool)
                starts, counts = runs(doc)
                for s, m in zip(starts.tolist(), counts.tolist()):
                    keep[s : s + m] = np.isin(low[s : s + m], np.frombuffer(lists[doc[s]], "<u8"))
                _, h = words.windows(min_words)
                where, doc, h = where[keep], doc[keep], h[keep]
                pos = (where - words.first[doc]).astype("<i4")
                doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[doc]
                part = _bucket(h, n)
                order = np.lexsort((doc, part))
                yield from packed(part[order], doc[order], a=h[order], b=pos[order])

        yield from as_batches(rows())

    return run


def _emit_doubled(length: int, n: int):
    """Windows of twice the length, of two repeated neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in by_bytes(batches, 8 << 20, "a"):
                docs, hs, ps = [], [], []
                for row in batch.to_pylist():
                    h, pos = np.frombuffer(row["a"], "<u8"), np.frombuffer(row["b"], "<i4")
                    at = np.searchsorted(pos, pos + length)
                    ok = np.flatnonzero((at < len(pos)) & (pos[np.minimum(at, len(pos) - 1)] == pos + length))
                    docs.append(np.full(len(ok), row["doc_id"])), ps.append(pos[ok])
                    hs.append(mix(h[ok] * np.uint64(0x9E3779B97F4A7C15) + mix(h[at[ok]] + np.uint64(length))))
                doc, h, pos = np.concatenate(docs), np.concatenate(hs), np.concatenate(ps)
                part = _bucket(h, n)
                order = np.lexsort((doc, part))
                yield from packed(part[order], doc[order], a=h[order], b=pos[order])

        yield from as_batches(rows())

    return run


def _covered(pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of words, from and to, that windows starting at the ordered positions cover."""
    if not len(pos):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = np.flatnonzero(pos[1:] > pos[:-1] + length)
    return pos[np.concatenate(([0], gap + 1))].astype(np.int64), pos[np.concatenate((gap, [len(pos) - 1]))].astype(np.int64) + length


def _spans(min_words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("n_repeated", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for row in batch.to_pylist():
                    pos, later = np.frombuffer(row["b"], "<i4"), np.frombuffer(row["c"], "?")
                    b, e = _covered(np.unique(pos[later]), min_words)
                    yield {"doc_id": row["doc_id"], "begins": b.tolist(), "ends": e.tolist(), "n_repeated": len(pos)}

        yield from as_batches(rows(), schema, 1024)

    return run


def repeated_spans(docs: DataFrame, min_words: int = 50, all_levels: bool = True) -> DataFrame:
    """Spans of words to remove, for each document with a window of min_words words that another document has.

    Returns doc_id, begins and ends (word numbers, end excluded), n_repeated (windows of min_words words that
    another document has) and longest (the last level, in words, at which a window of the document was repeated;
    min_words where all_levels is false).
    """
    if min_words < 2:
        raise ValueError("min_words must be 2 or more")
    spark = docs.sparkSession
    session_defaults(spark)
    n = parts(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    anchors = dealt(docs.mapInArrow(_emit_anchors(min_words, n), PACKED), n).mapInArrow(_repeated("a", n, False), PACKED)
    anchors = dealt(anchors, n).mapInArrow(_by_document("a"), BY_DOCUMENT)
    candidates = docs.join(anchors.select("doc_id", "a"), "doc_id").mapInArrow(_emit_candidates(min_words, n), PACKED)
    level = dealt(dealt(candidates, n).mapInArrow(_repeated("ab", n, True), PACKED), n).mapInArrow(_by_document("abc"), BY_DOCUMENT)
    level = written(level, f"level-{min_words}")
    spans = level.mapInArrow(_spans(min_words), "doc_id long, begins array<int>, ends array<int>, n_repeated long")
    reached = level.select("doc_id", F.lit(min_words).alias("longest"))
    length = min_words
    while all_levels and not level.isEmpty():
        doubled = level.select("doc_id", "a", "b").mapInArrow(_emit_doubled(length, n), PACKED)
        level = dealt(dealt(doubled, n).mapInArrow(_repeated("ab", n, True), PACKED), n).mapInArrow(_by_document("abc"), BY_DOCUMENT)
        length *= 2
        level = written(level, f"level-{length}")
        reached = reached.unionByName(level.select("doc_id", F.lit(length).alias("longest")))
    longest = reached.groupBy("doc_id").agg(F.max("longest").alias("longest"))
    return spans.join(longest, "doc_id")


def dedup_substrings(docs: DataFrame, min_words: int = 50, all_levels: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space), begins, ends, longest (0: nothing repeated)."""
    spans = repeated_spans(docs, min_words, all_levels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = rows.join(spans, "doc_id", "left")
    schema = "doc_id long, n_words long, n_removed long, kept string, begins array<int>, ends array<int>, n_repeated long, longest int"
    return both.mapInArrow(_stripped, schema)


STRIPPED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("n_repeated", pa.int64()), ("longest", pa.int32())])


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches):
        words = Words(batch.column("text"))
        raw = words.buf.tobytes()
        kept, removed = [], []
        for i, (begins, ends) in enumerate(zip(batch.column("begins").to_pylist(), batch.column("ends").to_pylist())):
            first, last = int(words.first[i]), int(words.first[i + 1])
            keep = np.ones(last - first, bool)
            for x, y in zip(begins or (), ends or ()):
                keep[x:y] = False
            at = np.flatnonzero(keep) + first
            kept.append(b" ".join([raw[s:t] for s, t in zip(words.start[at].tolist(), words.end[at].tolist())]).decode())
            removed.append(last - first - len(at))
        cols = [batch.column("doc_id"), words.count, removed, kept, batch.column("begins"), batch.column("ends"), pc.fill_null(batch.column("n_repeated"), 0), pc.fill_null(batch.column("longest"), 0)]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, STRIPPED)], schema=STRIPPED)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with, where they have spans, the text without the words of these and the white space after them; other characters stay."""

    def with_text():
        for batch in batches:
            row = batch.column("_row")
            yield pa.RecordBatch.from_arrays([row, batch.column("_begins"), batch.column("_ends"), row.field("text").cast(pa.string())], ["_row", "_begins", "_ends", "text"])

    for batch in by_bytes(with_text()):
        left: list[str | None] = [None] * batch.num_rows
        begins, ends = batch.column("_begins"), batch.column("_ends")
        for i in np.flatnonzero(begins.is_valid().to_numpy(zero_copy_only=False)).tolist():
            words = Words(batch.column("text").slice(i, 1))
            raw, out, at = words.buf.tobytes(), [], 0
            for x, y in zip(begins[i].as_py(), ends[i].as_py()):
                out.append(raw[at : words.start[x]])
                at = int(words.start[y]) if y < len(words.start) else len(raw)
            left[i] = b"".join((*out, raw[at:])).decode()
        yield pa.RecordBatch.from_arrays([batch.column("_row"), begins.is_valid(), pa.array(left, pa.string())], ["_row", "_is_cut", "_left"])


def without_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The rows of docs, all columns, with text and n_chars of what is left. A text of which nothing is left goes.

    The spans come through all levels, up to the longest that repeats.
    """
    spans = repeated_spans(docs, min_words).select(F.col("doc_id").alias("_id"), F.col("begins").alias("_begins"), F.col("ends").alias("_ends")).where("size(_begins) > 0")
    rows = docs.select(F.struct("*").alias("_row"))  # so that no column of docs clashes
    both = rows.join(spans, F.col("_row").getField("doc_id") == F.col("_id"), "left").select("_row", "_begins", "_ends")
    schema = T.StructType([*rows.schema, T.StructField("_is_cut", T.BooleanType()), T.StructField("_left", T.StringType())])
    both = both.mapInArrow(_cut, schema).where(~F.col("_is_cut") | F.col("_left").rlike("[^\\x20\\x09-\\x0D]"))
    new = {"text": F.when(F.col("_is_cut"), F.col("_left")).otherwise(F.col("_row").getField("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_is_cut"), F.length("_left").cast("long")).otherwise(F.col("_row").getField("n_chars"))
    return both.select(*(new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of dedup_substrings over all of documents."""
    out = dedup_substrings(documents(spark, sf_dir), 50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated", "longest")
