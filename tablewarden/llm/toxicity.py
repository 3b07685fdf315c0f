"""Operator 7: toxicity by a subsequence-kernel support vector machine with Nystrom landmarks.

The kernel of two strings sums over all subsequences of three letters, gaps allowed up to `SPAN` characters, each
weighing `DECAY` to the power of its span, so `idiot` stays close to `id-iot`, `id iot` and `idxiot`. The units compared are
the words of a sentence, its pairs of neighbouring words of which one has at most `SHORT` bytes and both `PAIR` (what a
space inside an insult leaves), and runs of single characters (`i d i o t`) joined to one. A sentence scores as its
highest unit, a text as its highest sentence. Of an insult of several longer words each word counts by itself. Words of one or two
letters are units only within pairs and runs; words of more than `PIECE` characters are scored in overlapping pieces.

Sentences of labelled texts inherit the label. Which unit of a toxic text is the insult isn't known, so training
alternates (multiple-instance): fit on the present witnesses, then take each toxic text's highest units as its
witnesses and the highest units of clean texts, pairs included, as hard negatives. Units that the machine suspects are judged by a second one of the same kind, with a
power of the kernel: most clean words that share a part with an insult end there. Kernel values with `landmarks` units, whitened by
their own kernel matrix, are the features of a linear squared-hinge machine. The machine is linear in kernel values and
these are sums over subsequences, so it becomes one exact table of weights by subsequence, which scores all texts.
A logistic curve over the highest units of the training texts gives the score.

Training takes at most `sample_docs` labelled texts of each label, by the hash of their id, `sample_chars`
characters of each, and `most_pairs` pairs of clean ones; scoring takes whole texts.

Defined results: a null or empty text scores as a text without any unit; without a toxic or a clean label everything
scores 0; a document with several labels is toxic if any says so; null ids are never learned from and not held out;
repeated rows score each; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import by_bytes, documents, mix, session_defaults
from .words import Words

DECAY = 0.7
SPAN = 8
SIZE = 32  # codes: 0 is a gap, 1 to 26 the letters, the rest other alphabets
SHORT, PAIR = 3, 12  # bytes of the shorter word of a pair, and of both
PIECE = 24  # longer units are scored in pieces of this length, half of it overlapping
#: Characters that often stand for a letter.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
STEPS = [(d1, d2) for d1 in range(1, SPAN - 1) for d2 in range(1, SPAN - d1)]
WORD = re.compile("[^\\x20\\x09-\\x0D]+")


@functools.lru_cache(1)
def _codes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        ch = chr(i)
        if ch.isalpha():
            base = unicodedata.normalize("NFKD", ch)[0].lower()
            out[i] = ord(base) - 96 if "a" <= base <= "z" else 27 + i % 5
    for ch, letter in LOOKALIKES.items():
        out[ord(ch)] = ord(letter) - 96
    return out


def _flat(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all units, with as many gaps between two that no subsequence reaches over, and where each starts."""
    pad = "\n" * (SPAN - 1)
    units = [u.lower() for u in units]
    sizes = np.fromiter(map(len, units), np.int64, len(units)) + len(pad)
    codes = _codes()[np.frombuffer((pad.join(units) + 2 * pad).encode("utf-32-le", "surrogatepass"), np.uint32)]
    return codes, np.cumsum(sizes) - sizes


def _subsequences(codes: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """For each pair of steps: weight, index of the subsequence from each place, and whether it has three letters."""
    n, wide = len(codes) - SPAN + 1, codes.astype(np.int32)
    solid = codes > 0
    first, firm = wide[:n] * (SIZE * SIZE), solid[:n]
    for d1, d2 in STEPS:
        j, k = d1, d1 + d2
        yield DECAY ** (k + 1), first + wide[j : n + j] * SIZE + wide[k : n + k], firm & solid[j : n + j] & solid[k : n + k]


def unit_scores(units: list[str], table: np.ndarray) -> np.ndarray:
    """Sum of the table over each unit's subsequences, over the norm of their weights; 0 if it has none."""
    if not units:
        return np.zeros(0)
    codes, start = _flat(units)
    total = np.zeros(len(codes), np.float32)
    norm = np.zeros(len(codes), np.float32)
    for weight, index, whole in _subsequences(codes):
        total[: len(index)] += np.float32(weight) * table.take(index)
        norm[: len(index)] += np.float32(weight * weight) * whole
    total, norm = np.add.reduceat(total, start), np.add.reduceat(norm, start)
    return np.where(norm > 0, total / np.sqrt(np.maximum(norm, 1e-12)), 0.0)


def features(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The normed subsequence weights of each unit, sparse: unit, subsequence, weight."""
    codes, start = _flat(units)
    rows, cols, vals = [], [], []
    for weight, index, whole in _subsequences(codes):
        at = np.flatnonzero(whole)
        rows.append(np.searchsorted(start, at, "right") - 1), cols.append(index[at]), vals.append(np.full(len(at), weight))
    row, col, val = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    norm = np.sqrt(np.bincount(row, val * val, len(units)))
    return row, col, val / np.maximum(norm[row], 1e-12)


def _kernel(units: list[str], landmarks: np.ndarray) -> np.ndarray:
    """Kernel of each unit with each landmark (their subsequence weights as columns)."""
    out = np.zeros((len(units), landmarks.shape[1]), np.float32)
    for b in range(0, len(units), 512):
        row, col, val = features(units[b : b + 512])
        order = np.argsort(row, kind="stable")
        row, col, val = row[order], col[order], val[order].astype(np.float32)
        if len(row):
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            out[b + row[first]] = np.add.reduceat(landmarks[col] * val[:, None], first, axis=0)
    return out


def _squared_hinge(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 20) -> np.ndarray:
    """Newton steps on the ridge-penalised squared hinge; the last weight is the bias."""
    z = np.hstack((z, np.ones((len(z), 1)))).astype(np.float64)
    beta = np.zeros(z.shape[1])
    for _ in range(rounds):
        active = y * (z @ beta) < 1
        za, wa = z[active], weight[active]
        new = np.linalg.solve((za * wa[:, None]).T @ za + ridge * np.eye(z.shape[1]), za.T @ (wa * y[active]))
        if np.abs(new - beta).max() < 1e-6:
            break
        beta = new
    return beta


def _fit(units: list[str], y: np.ndarray, weight: np.ndarray, landmarks: list[str]) -> tuple[np.ndarray, float]:
    """The machine as a table of weights by subsequence, and its bias."""
    row, col, val = features(landmarks)
    dense = np.zeros((SIZE**3, len(landmarks)), np.float32)
    np.add.at(dense, (col, row), val)
    own = (dense.T @ dense).astype(np.float64)
    size, vectors = np.linalg.eigh(own)
    good = size > 1e-6 * size.max()
    whiten = vectors[:, good] / np.sqrt(size[good])
    beta = _squared_hinge(_kernel(units, dense) @ whiten, y, weight)
    return (dense @ (whiten @ beta[:-1])).astype(np.float32), float(beta[-1])


#: Power of the kernel by which suspects are judged again, and how far below all suspects other units lie.
POWER, BELOW = 4, 6.0
#: Units of other texts than those learned from spread so much wider around the middle of the curve.
OPTIMISM = 3.0


def _judge(suspects: list[str], y: np.ndarray, weight: np.ndarray, landmarks: list[str]) -> dict:
    """A second machine for suspects: the kernel's power tells close strings apart that share most of their subsequences."""
    row, col, val = features(landmarks)
    dense = np.zeros((SIZE**3, len(landmarks)), np.float32)
    np.add.at(dense, (col, row), val)
    size, vectors = np.linalg.eigh(((dense.T @ dense).astype(np.float64)) ** POWER)
    good = size > 1e-6 * size.max()
    whiten = vectors[:, good] / np.sqrt(size[good])
    beta = _squared_hinge(_kernel(suspects, dense).astype(np.float64) ** POWER @ whiten, y, weight, 0.3)
    return {"landmarks": dense, "weights": whiten @ beta[:-1], "shift": float(beta[-1])}


def sharpened(units: list[str], first: np.ndarray, model: dict) -> np.ndarray:
    """Final scores of units: those that the table suspects are judged by the second machine, the others lie below."""
    out = first + model["bias"]
    judge = model.get("judge")
    if judge is None or not len(out):
        return out
    at = np.flatnonzero(out >= model["suspect"])
    out = out - BELOW
    if len(at):
        out[at] = _kernel([units[i].lower() for i in at], judge["landmarks"]).astype(np.float64) ** POWER @ judge["weights"] + judge["shift"]
    return out


def text_units(text: str) -> set[str]:
    """The words of a text, and runs of three single characters or more as one."""
    words = WORD.findall(text)
    out, run = set(), []
    for w in (*words, "  "):
        if len(w) == 1:
            run.append(w)
            continue
        if len(run) > 2:
            out |= set(_pieces("".join(run)))
        run = []
        if len(w) > PIECE:
            out |= set(_pieces(w))
        elif w != "  ":
            out.add(w)
    return {u.lower() for u in out if len(u) > 2}


def sentence_pairs(text: str) -> set[str]:
    """The pairs of neighbouring words within a sentence that are units."""
    out = set()
    for line in text.split("\n"):
        words = WORD.findall(line)
        for a, b in zip(words, words[1:]):
            sizes = len(a.encode("utf-8", "replace")), len(b.encode("utf-8", "replace"))
            if min(sizes) <= SHORT and max(sizes) > 1 and sum(sizes) <= PAIR and a[-1] not in ".!?":
                out.add(f"{a} {b}".lower())
    return out


def _pieces(unit: str) -> list[str]:
    return [unit[i : i + PIECE] for i in range(0, max(1, len(unit) - PIECE // 2), PIECE // 2)] if len(unit) > PIECE else [unit]


def _gapped(units: list[str], rng: np.random.Generator) -> list[str]:
    """Each unit with a stray character inside."""
    at = [1 + int(x * (len(u) - 1)) for u, x in zip(units, rng.random(len(units)))]
    return [u[:i] + ".-*x_"[int(x * 5)] + u[i:] for u, i, x in zip(units, at, rng.random(len(units)))]


def train(texts: list[str], toxic: list[bool], landmarks: int = 192, rounds: int = 4, most: int = 4000, seed: int = 7, most_pairs: int = 50_000) -> dict | None:
    """The model from labelled texts: table, bias and the logistic curve's slope and middle."""
    rng = np.random.default_rng(seed)
    pairs: dict[str, None] = {}
    for t, bad in zip(texts, toxic):
        if not bad and len(pairs) < most_pairs:
            pairs |= dict.fromkeys(sorted(sentence_pairs(t)))
    pairs_of = list(pairs)[:most_pairs]
    bags = [sorted(text_units(t)) for t in texts]
    y = np.array(toxic, bool)
    if y.all() or not y.any():
        return None
    names = sorted({u for b in bags for u in b})
    if not names:
        return None
    number = {u: i for i, u in enumerate(names)}
    bags = [np.array([number[u] for u in b], np.int64) for b in bags]
    count = np.zeros((2, len(names)))
    for b, t in zip(bags, y):
        count[int(t), b] += 1
    many = np.array([(~y).sum(), y.sum()], float)
    odds = np.log((count[1] + 0.05) / (many[1] + 0.1)) - np.log((count[0] + 0.05) / (many[0] + 0.1))
    scores, table, bias = odds * np.minimum(1, np.log1p(count.sum(axis=0)) / np.log(3)), None, 0.0
    clean = np.flatnonzero(count[0] > 0)
    for _ in range(rounds):
        witness: dict[int, float] = {}
        for b in (b for b, t in zip(bags, y) if t and len(b)):
            top = scores[b].max()
            for i in b[(scores[b] >= (top if table is None else max(min(top, 0.5), top - 0.7))) & (count[0, b] <= 0.05 * count[1, b])]:
                witness[int(i)] = witness.get(int(i), 0) + 1
        positive = np.array(sorted(witness, key=lambda i: (-witness[i], names[i]))[:most], np.int64)
        clean_only = np.setdiff1d(clean, positive)
        hard = clean_only[np.argsort(-scores[clean_only], kind="stable")[:most]]
        frequent = clean_only[np.argsort(-count[0, clean_only], kind="stable")[: most // 2]]
        others = rng.permutation(clean_only)[:most]
        negative = np.unique(np.concatenate((hard, frequent, others)))
        if not len(positive) or not len(negative):
            return None
        odd_pairs = [pairs_of[i] for i in np.argsort(-pair_scores, kind="stable")[: most // 2]] if table is not None else []
        pos = [names[i] for i in positive]
        marks = pos[: landmarks // 2]
        marks += [names[i] for i in (*hard[: landmarks // 4], *rng.permutation(negative)[: landmarks - len(marks) - landmarks // 4])]
        marks = list(dict.fromkeys(u for u in marks if unit_scores([u], np.ones(SIZE**3, np.float32))[0] > 0))
        if not marks:
            return None
        against = [names[i] for i in negative] + odd_pairs
        units = pos + _gapped(pos, rng) + against
        sign = np.array([1.0] * (2 * len(pos)) + [-1.0] * len(against))
        power = np.array([witness[i] for i in positive], float) ** 0.5
        power = np.concatenate((power, 0.5 * power, np.ones(len(against))))
        power[sign > 0] *= 0.5 * len(against) / power[sign > 0].sum()
        table, bias = _fit(units, sign, power, marks)
        scores, pair_scores = unit_scores(names, table) + bias, unit_scores(pairs_of, table)
    two = [sorted(sentence_pairs(t)) for t in texts]
    flat, owner = [p for x in two for p in x], np.repeat(np.arange(len(two)), list(map(len, two)))
    flat_scores = np.concatenate([unit_scores(flat[i : i + 50_000], table) for i in range(0, len(flat), 50_000)] or [np.zeros(0)])
    top = np.array([scores[b].max() if len(b) else bias for b in bags])
    model = {"table": table, "bias": bias, "suspect": float(np.quantile(top[y], 0.05)) - 0.05}
    first, suspect = scores - bias, np.flatnonzero(scores >= model["suspect"])
    own = {i: n for n, i in enumerate(suspect.tolist())}
    odd = sorted({flat[i] for i in np.flatnonzero((flat_scores + bias >= model["suspect"]) & ~y[owner])})[: most // 2] if len(flat) else []
    inside = [np.array([own[i] for i in b.tolist() if i in own], np.int64) for b in bags]
    held = [names[i] for i in suspect]
    now = odds[suspect]
    for _ in range(3 if len(held) else 0):
        found: dict[int, float] = {}
        for b, t in zip(inside, y):
            if t and len(b):
                i = int(b[np.argmax(now[b])])
                found[i] = found.get(i, 0) + 1
        good = np.array([i for i in sorted(found) if count[0, suspect[i]] <= 0.05 * count[1, suspect[i]]], np.int64)
        bad = np.setdiff1d(np.flatnonzero(count[0, suspect] > 0), good)
        if not len(good) or not len(bad) + len(odd):
            break
        good, bad = good[np.argsort([-found[i] for i in good], kind="stable")][:most], bad[np.argsort(-now[bad], kind="stable")][:most]
        pos, neg = [held[i] for i in good], [held[i] for i in bad] + odd
        units = pos + _gapped(pos, rng) + neg
        sign = np.array([1.0] * (2 * len(pos)) + [-1.0] * len(neg))
        power = np.concatenate((np.sqrt([found[i] for i in good]), 0.5 * np.sqrt([found[i] for i in good]), np.sqrt(count[0, suspect[bad]]), np.ones(len(odd))))
        power[sign > 0] *= 0.5 * power[sign < 0].sum() / power[sign > 0].sum()
        model["judge"] = _judge(units, sign, power, list(dict.fromkeys(pos[:landmarks] + neg[:landmarks])))
        now = sharpened(held, first[suspect], model)
    scores = sharpened(names, first, model)
    best = np.array([scores[b].max() if len(b) else bias - BELOW * ("judge" in model) for b in bags])
    for i in range(0, len(flat), 50_000):
        np.maximum.at(best, owner[i : i + 50_000], sharpened(flat[i : i + 50_000], flat_scores[i : i + 50_000], model))
    near = np.ones(len(y), bool)
    if "judge" in model:  # texts without any suspect say nothing about where the curve bends
        near = np.array([len(x) > 0 for x in inside]) | np.isin(np.arange(len(texts)), owner[flat_scores + bias >= model["suspect"]])
    if len(set(y[near].tolist())) < 2:
        near = np.ones(len(y), bool)
    slope, middle = _logistic(best[near], y[near])
    slope /= OPTIMISM if "judge" in model else 1.0
    return model | {"slope": slope, "middle": middle}


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a logistic curve, a little smoothed."""
    z = np.stack((x, np.ones_like(x)), axis=1)
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (target - p) - 1e-3 * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    slope = max(float(beta[0]), 1e-3)
    return slope, float(-beta[1] / slope)


def _pairs_of(words: Words) -> np.ndarray:
    """The first words of the pairs that are units, as sentence_pairs has them."""
    size = words.end - words.start
    a, b = size[:-1], size[1:]
    ok = (words.doc[:-1] == words.doc[1:]) & (np.minimum(a, b) <= SHORT) & (np.maximum(a, b) > 1) & (a + b <= PAIR) & ~np.isin(words.buf[words.end[:-1] - 1], np.frombuffer(b".!?", np.uint8))
    breaks = np.concatenate(([0], np.cumsum(words.buf == 10)))
    at = np.flatnonzero(ok)
    return at[breaks[words.start[at + 1]] == breaks[words.end[at]]]


def _score(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            n = batch.num_rows
            worst = np.full(n, -np.inf)
            units: list[str] = [""] * n
            if model:
                words = Words(batch.column("text"))
                raw = words.buf.tobytes()
                size = words.end - words.start
                _, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
                names = [raw[s:e].decode() for s, e in zip(words.start[first].tolist(), words.end[first].tolist())]
                whole = [u if len(u) <= PIECE else "" for u in names]
                got = sharpened(whole, unit_scores(whole, model["table"]), model)
                for i in np.flatnonzero(np.fromiter(map(len, names), np.int64, len(names)) > PIECE).tolist():
                    got[i] = sharpened(_pieces(names[i]), unit_scores(_pieces(names[i]), model["table"]), model).max()
                scores = got[inverse]
                some = np.flatnonzero(words.count)
                if len(some):
                    worst[some] = np.maximum.reduceat(scores, words.first[some])
                    at = np.flatnonzero(scores == worst[words.doc])
                    for j in at[np.unique(words.doc[at], return_index=True)[1]].tolist():
                        units[words.doc[j]] = names[inverse[j]]
                two = _pairs_of(words)
                if len(two):
                    _, first, inverse_two = np.unique(mix(words.hash[two] + mix(words.hash[two + 1])), return_index=True, return_inverse=True)
                    at_two = two[first]
                    joined = [f"{raw[s:e].decode()} {raw[t:f].decode()}" for s, e, t, f in zip(words.start[at_two].tolist(), words.end[at_two].tolist(), words.start[at_two + 1].tolist(), words.end[at_two + 1].tolist())]
                    got = sharpened(joined, unit_scores(joined, model["table"]), model)[inverse_two]
                    top = np.full(n, -np.inf)
                    np.maximum.at(top, words.doc[two], got)
                    at = np.flatnonzero((got == top[words.doc[two]]) & (got > worst[words.doc[two]]))
                    for j in at[np.unique(words.doc[two[at]], return_index=True)[1]].tolist():
                        units[words.doc[two[j]]] = joined[inverse_two[j]]
                    worst = np.maximum(worst, top)
                lone = np.fromiter(map(len, names), np.int64, len(names))[inverse] == 1 if len(size) else np.zeros(0, bool)
                begin = np.flatnonzero(lone & np.concatenate(([True], ~lone[:-1] | (words.doc[1:] != words.doc[:-1])))) if len(lone) else []
                for s in begin:
                    e = s
                    while e < len(lone) and lone[e] and words.doc[e] == words.doc[s]:
                        e += 1
                    if e - s > 2:
                        joined = "".join(names[i] for i in inverse[s:e])
                        top = sharpened(_pieces(joined), unit_scores(_pieces(joined), model["table"]), model).max()
                        if top > worst[words.doc[s]]:
                            worst[words.doc[s]], units[words.doc[s]] = top, joined
                worst = np.where(np.isfinite(worst), worst, model["bias"] - BELOW * ("judge" in model))
                score = 1 / (1 + np.exp(-np.clip(model["slope"] * (worst - model["middle"]), -50, 50)))
            else:
                score = np.zeros(n)
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array(units)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "unit"])

    return run


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = 2000, sample_chars: int = 20_000, **how) -> dict | None:
    """A model from a bounded sample of the labelled documents that are not held out."""
    from .language_id import is_held_out

    mark = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic")).where(~is_held_out())
    many = {r["toxic"]: r["count"] for r in mark.groupBy("toxic").count().collect()}
    if len(many) < 2:
        return None
    key = F.xxhash64("doc_id", F.lit(7))
    share = F.when(F.col("toxic"), min(1.0, 1.2 * sample_docs / many[True])).otherwise(min(1.0, 1.2 * sample_docs / many[False]))
    picked = mark.where(F.pmod(key, F.lit(1 << 20)) < share * (1 << 20)).orderBy(key, "doc_id").limit(4 * sample_docs)  # a bound; expected are 2.4 times sample_docs
    text = F.substring(F.coalesce(F.col("text").cast("string"), F.lit("")), 1, sample_chars)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(picked), "doc_id").select(key.alias("key"), "toxic", "text").collect()
    rows = sorted(rows, key=lambda r: (r["toxic"], r["key"], r["text"]))
    rows = [r for t in (False, True) for r in [r for r in rows if r["toxic"] == t][:sample_docs]]
    return train([r["text"] for r in rows], [r["toxic"] for r in rows], **how)


def score_toxicity(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, score and unit (the highest one) of every row of docs."""
    from .language_id import is_held_out

    session_defaults(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, unit string")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = score_toxicity(docs, learn(docs, documents(spark, sf_dir, "labels")))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "unit")
