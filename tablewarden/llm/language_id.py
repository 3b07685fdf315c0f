"""Operator 10: language identification by cross-parsing against suffix automata.

For each language a suffix automaton of labelled text recognises every substring of that text. A document is
parsed greedily into phrases, each the longest match from where the last one ended; the language with the
fewest phrases, times the bits that point at one (log2 of its text's length) and over the document's length, wins.
Texts are the UTF-8 bytes of their letters in lower case, all else being spaces, so every script is told apart and no
letter is left out.

Texts are parsed side by side in NumPy. A long one is parsed in pieces of `SEGMENT` bytes, each as if a phrase began
there; then, piece after piece, from the state in which the one before really ended, up to where both parses are
in the same state. The result is that of one parse of the whole text.

The labelled text is a bounded sample: `sample_docs` documents a language, by the hash of their id, each giving
`excerpt` characters from a place that the hash gives too, up to `sample_bytes` bytes in all.

Defined results: a null text, an empty one and one without a letter are `und` with score 0; equal counts go to the
first language by name; if no row is labelled, every text is `und`; rows whose id is null are not learned from and
not held out; repeated rows are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_bytes, documents, session_defaults

SEGMENT = 4096
UNKNOWN = "und"
#: From this bit on an entry of a parser's table holds how many phrases the step ends, below it the next state.
COUNT = 29


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the letters of all texts, runs of others as one space, and where each begins. Each text begins and ends with a space."""
    texts = [f" {t.lower()} " if t else "" for t in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    point = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    point = np.where(_letters()[point], point, 32).astype("<u4")
    keep = np.ones(len(point), bool)
    keep[1:] = (point[1:] != 32) | (point[:-1] != 32)
    ends = np.cumsum(sizes)
    keep[(ends - sizes)[sizes > 0]] = True
    point = point[keep]
    at = np.concatenate(([0], np.cumsum(keep)))
    at = np.concatenate((at[ends - sizes], at[-1:]))
    width = 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)
    return np.frombuffer(point.tobytes().decode("utf-32-le").encode(), np.uint8), np.concatenate(([0], np.cumsum(width)))[at]


class Alphabet:
    """Codes of the bytes of some texts: 0 for a space, and one more for all other bytes."""

    def __init__(self, texts: list[str]):
        used = np.unique(letter_bytes(texts)[0])
        used = used[used != 32]
        self.size = len(used) + 2
        self.code = np.full(256, self.size - 1, np.uint8)
        self.code[used] = np.arange(1, len(used) + 1)
        self.code[32] = 0

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        raw, at = letter_bytes(texts)
        return self.code[raw], at


def automaton(codes: list[int], size: int) -> np.ndarray:
    """Greedy parser of the substrings of `codes`: a table of next states (times size) by state and code.

    From bit COUNT on an entry holds how many phrases the step ends.
    """
    last, link, length, step = 0, [-1], [0], [{}]
    for c in codes:
        cur = len(step)
        step.append({}), length.append(length[last] + 1), link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q])), length.append(length[p] + 1), link.append(link[q])
                link[q] = link[cur] = clone
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
        last = cur
    if len(step) * size >= 1 << COUNT:
        raise ValueError("sample_bytes is too large for this alphabet")
    again = np.full(size, 2 << COUNT, np.int32)  # an unknown byte is a phrase of its own
    for c, s in step[0].items():
        again[c] = s * size + (1 << COUNT)
    table = np.tile(again, (len(step), 1))
    table[0] = np.where(again >= 2 << COUNT, 1 << COUNT, again - (1 << COUNT))
    for s, d in enumerate(step):
        if d:
            table[s, list(d)] = np.fromiter(d.values(), np.int32, len(d)) * size
    return table.ravel()


class Parser:
    """Counts of phrases of many texts against each language."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.alphabet = Alphabet([text for _, text in samples])
        self.langs = [lang for lang, _ in samples]
        codes = [self.alphabet.codes([text])[0] for _, text in samples]
        self.bits = np.array([math.log2(len(c)) for c in codes])
        self.tables = [automaton(c.tolist(), self.alphabet.size) for c in codes]

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: phrases by language, parsed bytes, and whether it has a letter."""
        codes, at = self.alphabet.codes(texts)
        n, sizes = len(texts), np.diff(at)
        pieces = -(-sizes // SEGMENT)
        doc = np.repeat(np.arange(n), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = at[doc] + nth * SEGMENT
        size = np.minimum(SEGMENT, at[doc + 1] - start)
        order = np.argsort(-size, kind="stable")
        doc, nth, start, size = doc[order], nth[order], start[order], size[order]
        total = np.zeros((len(self.langs), n))
        for table, out in zip(self.tables, total):
            np.add.at(out, doc, _parsed(table, codes, doc, nth, start, size, pieces))
        letter = np.zeros(n, bool)
        some = np.flatnonzero(sizes)
        if len(some):
            letter[some] = np.maximum.reduceat(codes, at[some]) > 0
        return total, sizes, letter


def _parsed(table: np.ndarray, codes: np.ndarray, doc: np.ndarray, nth: np.ndarray, start: np.ndarray, size: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Phrases that end in each piece of a text (the last of a text ends with it). The pieces are in order of falling size."""
    mask = (1 << COUNT) - 1
    active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")
    row = np.concatenate(([0], np.cumsum(active)))  # all pieces' states after a step lie together
    many = bool((pieces > 1).any())
    states, counts = np.zeros(len(doc), np.int32), np.zeros(len(doc), np.int32)
    past = np.zeros((2, int(row[-1])), np.int32) if many else None
    for t, k in enumerate(active.tolist()):
        v = table.take(states[:k] + codes[start[:k] + t])
        counts[:k] += v >> COUNT
        np.bitwise_and(v, mask, out=states[:k])
        if many:
            past[0, row[t] : row[t + 1]] = states[:k]
            past[1, row[t] : row[t + 1]] = counts[:k]
    if many:
        place = np.empty(len(doc), np.int64)  # of the pieces in the order of their texts
        place[np.lexsort((nth, doc))] = np.arange(len(doc))
        piece_at = np.argsort(place)
        for r in range(1, int(pieces.max())):
            at = np.flatnonzero(nth == r)
            entered = states[piece_at[place[at] - 1]]
            todo, state = at[entered > 0], entered[entered > 0]
            count = np.zeros(len(todo), np.int32)
            t = 0
            while len(todo):
                v = table.take(state + codes[start[todo] + t])
                count, state = count + (v >> COUNT), v & mask
                same = state == past[0, row[t] + todo]
                counts[todo[same]] += count[same] - past[1, row[t] + todo[same]]
                t += 1
                ended = ~same & (size[todo] == t)
                counts[todo[ended]], states[todo[ended]] = count[ended], state[ended]
                left = ~same & ~ended
                todo, state, count = todo[left], state[left], count[left]
    return counts + ((states != 0) & (nth == pieces[doc] - 1))


@functools.lru_cache(1)
def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(samples)


def is_held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


Samples = tuple[tuple[str, str], ...]


def learn(docs: DataFrame, sample_docs: int = 60, excerpt: int = 400, sample_bytes: int = 24_000) -> Samples:
    """The labelled sample of each language."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("doc_id is not null and lang is not null and text is not null").where(~is_held_out())
    many = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not many:
        return ()
    share = functools.reduce(lambda c, x: c.when(F.col("lang") == x[0], x[1]), ((k, min(1.0, 3 * sample_docs / n)) for k, n in many.items()), F.when(F.lit(False), 0.0))
    key = F.xxhash64("doc_id", F.lit(10))
    begin = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.greatest(F.lit(1), F.length("text") - excerpt)) + 1
    picked = rows.where(F.pmod(key, F.lit(1 << 20)) < share * (1 << 20)).select("lang", key.alias("key"), F.col("text").substr(begin.cast("int"), F.lit(excerpt)).alias("piece")).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["key"], r["piece"])):
        held = texts.setdefault(r["lang"], [])
        if any(ch.isalpha() for ch in r["piece"]) and len(held) < sample_docs:
            held.append(r["piece"].lower())
    return tuple((lang, " ".join(pieces).encode("utf-8", "replace")[:sample_bytes].decode("utf-8", "ignore")) for lang, pieces in sorted(texts.items()) if pieces)


def _score(samples: Samples):
    """Adds the prediction to the other columns; the text is a column or a field of the struct `row`."""

    def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if "row" in batch.schema.names:
                row = batch.column("row")
                batch = pa.RecordBatch.from_arrays([row, row.field("text")], ["row", "text"])
            yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(with_text(batches)):
            n = batch.num_rows
            pred, score, rate = [UNKNOWN] * n, np.zeros(n), np.zeros(n)
            if samples:
                parser = _parser(samples)
                total, sizes, letter = parser.phrases(batch.column("text").to_pylist())
                cost = total * parser.bits[:, None]
                best = cost.argmin(axis=0)
                lead = (cost - cost[best, np.arange(n)]) / parser.bits[best]  # in phrases of the best language
                score = np.where(letter, 1 / np.exp(-np.clip(lead, 0, 700)).sum(axis=0), 0.0)
                pred = [parser.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letter.tolist())]
                rate = np.where(letter, cost.min(axis=0) / np.maximum(sizes, 1), 0.0)
            others = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, others), pa.array(pred, pa.string()), pa.array(score), pa.array(rate)], [*others, "lang_pred", "score", "bits_per_char"])

    return run


def identify(docs: DataFrame, model: Samples | None = None, **sample) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1: how far the best language leads), bits_per_char (of the winner, for each byte)."""
    session_defaults(docs.sparkSession)
    samples = learn(docs, **sample) if model is None else model
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(samples), "doc_id long, held_out boolean, lang_pred string, score double, bits_per_char double")


def keep_identified(docs: DataFrame, max_bits_per_char: float = 9.0, **sample) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known.

    Rejected: texts without a letter, and texts that every language needs more than max_bits_per_char for.
    """
    session_defaults(docs.sparkSession)
    samples = learn(docs, **sample)
    rows = docs.select(F.struct("*").alias("row"))
    schema = T.StructType([*rows.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_char", T.DoubleType())])
    found = rows.mapInArrow(_score(samples), schema)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("bits_per_char") <= max_bits_per_char)).select("row.*")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return identify(documents(spark, sf_dir))
