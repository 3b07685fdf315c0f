"""Operator 8: licence notices, by a trained paragraph classifier that templates confirm.

A paragraph (a line, or a part of 64 words of a longer one) is a bag of word 1- to 3-grams, lower case and without
punctuation. Sparse logistic regression, one curve for each licence family and one for ordinary text, is trained on
pieces of the template texts and on paragraphs of the corpus. The unknown class is calibrated by leaving out one family
at a time: a family is named only above what nine in ten such strangers reach. A family's prediction stands only if enough
of the paragraph's 2-grams are in that family's templates. Another paragraph is `unknown` if it is less like ordinary text than
999 in 1000 paragraphs that the classifier had not seen, and has two licence words or more. Licence words are learned:
those that the templates of two families or more have, but no text of the corpus sample outside spans like a template.

Notices within longer lines, wherever they begin, are judged apart: a span of a line, at least SHORTEST 2-grams of a
family's templates with a share of `confirm` or more, one of them of no other family, is a notice if it has a licence word and
the classifier, reading its words alone, names the family too; of overlapping spans the one with the most such 2-grams
counts. Unknown notices are also sought in overlapping windows of 16 and 64 words. Parts of one line that name one family are one notice.

Training reads a bounded sample of the corpus: `sample_docs` documents by the hash of their id, `sample_paragraphs`
paragraphs of them. Scanning takes whole texts.

Defined results: null and empty texts have no notice; repeated rows and rows that share an id are scanned each; null
ids are never in the sample; a table without rows gives none; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import by_bytes, documents, mix, runs, session_defaults
from .words import Words, powers

NONE, UNKNOWN = "none", "unknown"
LONGEST = 64
SHORTEST = 3
#: Words of the overlapping windows within a line, each half a window from the last.
WINDOWS = (16, LONGEST)
BUCKETS = 1 << 17
#: Notices of the licence families; each line is a paragraph of a template. Fixed values.
TEMPLATES = {
    "apache": """Licensed under the Apache License, Version 2.0.
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.
SPDX-License-Identifier: Apache-2.0""",
    "mit": """Released under the MIT License.
This project is licensed under the terms of the MIT license.
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
SPDX-License-Identifier: MIT""",
    "gpl": """This work is licensed under the GNU General Public License, version 3.
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.
SPDX-License-Identifier: GPL-3.0-or-later""",
    "lgpl": """This library is licensed under the GNU Lesser General Public License, version 2.1.
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.
SPDX-License-Identifier: LGPL-2.1-or-later""",
    "bsd": """Released under the BSD 3-Clause License.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.
SPDX-License-Identifier: BSD-3-Clause""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.
SPDX-License-Identifier: MPL-2.0""",
    "cc-by-nc": """Licensed under CC BY-NC 4.0.
This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.
You may not use the material for commercial purposes.
SPDX-License-Identifier: CC-BY-NC-4.0""",
    "cc-by": """Licensed under CC BY 4.0.
This work is licensed under a Creative Commons Attribution 4.0 International License.
Text is available under the Creative Commons Attribution-ShareAlike License.
SPDX-License-Identifier: CC-BY-4.0""",
    "isc": """Released under the ISC License.
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
SPDX-License-Identifier: ISC""",
}


def _plain() -> np.ndarray:
    """Bytes of words: lower case, and punctuation as a space; a line feed stays."""
    out = np.arange(256, dtype=np.uint8)
    for i in range(128):
        ch = chr(i)
        out[i] = ord(ch.lower()) if ch.isalnum() or i == 10 else 32
    return out


PLAIN = _plain()


class Paragraphs:
    """n-grams of the paragraphs of texts. doc, begin, end: text and words of each; gram, of: each gram and its paragraph."""

    def __init__(self, texts: pa.Array):
        words = Words(texts, PLAIN)
        n = len(words.start)
        line = np.searchsorted(np.flatnonzero(words.buf == 10), words.start) + words.doc  # grows at each line and text
        start, count = runs(line)
        nth = np.arange(n) - np.repeat(start, count)
        part = line * np.int64(1 << 20) + nth // LONGEST
        self.line = line
        self.lines = start, count
        self.begin, self.count = runs(part)
        self.doc = words.doc[self.begin]
        self.words = words
        of = np.repeat(np.arange(len(self.begin)), self.count)
        h, grams, owners = words.hash, [words.hash], [of]
        for k in (2, 3):
            if n >= k:
                ok = np.flatnonzero(of[: n - k + 1] == of[k - 1 :])
                g = sum((h[ok + j] * p for j, p in enumerate(powers(k))), np.uint64(k))
                grams.append(mix(g)), owners.append(of[ok])
        self.pairs = (grams[1], owners[1]) if len(grams) > 1 else (grams[0][:0], of[:0])
        self.gram, self.of = np.concatenate(grams), np.concatenate(owners)

    def scores(self, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Of each paragraph the sum of its grams' weights over the root of their number, and the bias."""
        n = len(self.begin)
        out = np.zeros((n, table.shape[1]))
        column = (self.gram >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)
        size = np.bincount(self.of, minlength=n)
        for c in range(table.shape[1]):
            out[:, c] = np.bincount(self.of, table[column, c], n)
        return out / np.sqrt(np.maximum(size, 1))[:, None] + bias

    def line_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of the 2-grams of whole lines."""
        at = np.flatnonzero(self.line[:-1] == self.line[1:])
        h = self.words.hash
        return at, mix(sum((h[at + j] * p for j, p in enumerate(powers(2))), np.uint64(2)))

    def span_scores(self, begin: np.ndarray, end: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """The scores of words begin to end (without it), each range within a line."""
        h = self.words.hash
        out, size = np.zeros((len(begin), table.shape[1])), np.zeros(len(begin))
        for k in (1, 2, 3):
            if len(h) < k:
                continue
            gram = h if k == 1 else mix(sum((h[j : len(h) - k + 1 + j] * p for j, p in enumerate(powers(k))), np.uint64(k)))
            column = (gram >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)
            last = np.maximum(end - k + 1, begin)
            size += last - begin
            for c in range(table.shape[1]):
                total = np.concatenate(([0.0], np.cumsum(table[column, c], dtype=np.float64)))
                out[:, c] += total[np.minimum(last, len(gram))] - total[np.minimum(begin, len(gram))]
        return out / np.sqrt(np.maximum(size, 1))[:, None] + bias

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of the overlapping windows of all lines that are longer than one."""
        begins, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in WINDOWS:
            start, count = (x[self.lines[1] > size] for x in self.lines)
            n = -(-(count - size) // (size // 2)) + 1
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begins.append(np.repeat(start, n) + np.minimum(nth * (size // 2), np.repeat(count - size, n)))
            ends.append(begins[-1] + size)
        return np.concatenate(begins), np.concatenate(ends)


def _spans(hit: np.ndarray, line: np.ndarray, confirm: float) -> Iterator[tuple[int, int, int]]:
    """First and last 2-gram, and number of hits, of the spans of a line with a share of hits of confirm or more.

    hit: places of hits in order; line: their lines. Such a span has three hits within five 2-grams.
    """
    near = np.flatnonzero((line[2:] == line[:-2]) & (hit[2:] - hit[:-2] <= 2 / confirm + 1))
    for which in np.unique(line[near]).tolist():
        places = hit[np.searchsorted(line, which) : np.searchsorted(line, which, "right")].tolist()
        i = 0
        while i < len(places):
            score, best, end, j = 0.0, 0.0, i, i
            while j < len(places):
                score += 1 - confirm - (confirm * (places[j] - places[j - 1] - 1) if j > i else 0)
                if score <= 0:
                    break
                if score >= best:
                    best, end = score, j
                j += 1
            if end - i + 1 >= SHORTEST:
                yield places[i], places[end], end - i + 1
            i = end + 1


def _within_lines(grams: Paragraphs, model: dict, confirm: float, cues: np.ndarray) -> list[tuple[int, int, int, float]]:
    """Notices of families in any place of a line: first word, end, column of the family, score."""
    names, known = model["names"], model["known"]
    at, pair = grams.line_pairs()
    some = np.isin(pair, np.concatenate(list(known.values())))
    at, pair = at[some], pair[some]
    found = []
    for c, family in enumerate(names[1:], 1):
        mine = np.isin(pair, known[family])
        others = np.concatenate([v for f, v in known.items() if f != family])
        own = at[mine & ~np.isin(pair, others)]
        for first, last, n in _spans(at[mine], grams.line[at[mine]], confirm):
            if np.searchsorted(own, first) < np.searchsorted(own, last, "right"):
                found.append((n, first, last + 2, c))
    if not found:
        return []
    found.sort(key=lambda x: (-x[0], x[1:]))
    chance = _chance(grams.span_scores(np.array([x[1] for x in found]), np.array([x[2] for x in found]), model["table"], model["bias"]))
    out, taken = [], np.zeros(len(grams.line), bool)
    for (_, b, e, c), z in zip(found, chance):
        if taken[b:e].any() or z[0] >= 0.5 or z[c] < model["least"] or int(z[1:].argmax()) + 1 != c:
            continue
        if cues[e] > cues[b]:
            taken[b:e] = True
            out.append((b, e, c, float(z[c])))
    return sorted(out)


def _without_notices(grams: Paragraphs, known: np.ndarray, families: np.ndarray, confirm: float = 0.6) -> np.ndarray:
    """The words, as hashes, that are in no span of a line with a share of `confirm` or more of known 2-grams, one of them of one family alone."""
    at, pair = grams.line_pairs()
    hit, one = at[np.isin(pair, known)], at[np.isin(pair, known[families == 1])]
    keep = np.ones(len(grams.line), bool)
    for first, last, _ in _spans(hit, grams.line[hit], confirm):
        if np.searchsorted(one, first) < np.searchsorted(one, last, "right"):
            keep[first : last + 2] = False
    return grams.words.hash[keep]


def _pieces(rng: np.random.Generator, each: int) -> list[tuple[str, str]]:
    """Template paragraphs, whole and cut, with the family."""
    out = []
    for family, text in TEMPLATES.items():
        lines = text.split("\n")
        out += [(family, line) for line in lines for _ in range(4)]
        for _ in range(each):
            words = lines[rng.integers(len(lines))].split()
            size = max(min(4, len(words)), int(len(words) * (0.5 + rng.random() / 2)))
            at = rng.integers(len(words) - size + 1)
            out.append((family, " ".join(words[at : at + size])))
    return out


def _fit(grams: Paragraphs, y: np.ndarray, ridge: float = 1e-4, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """One logistic curve for each column of y (0 or 1), by adaptive gradient steps over all paragraphs."""
    column, col = np.unique((grams.gram >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64), return_inverse=True)
    n, size = len(y), np.sqrt(np.bincount(grams.of, minlength=len(y)))
    value = 1 / size[grams.of]
    weight, bias = np.zeros((len(column), y.shape[1])), np.zeros(y.shape[1])
    balance = 0.5 * np.where(y > 0, 1 / np.maximum(y.sum(axis=0), 1), 1 / np.maximum((1 - y).sum(axis=0), 1)) * n
    power, power_b = np.full_like(weight, 1e-8), np.full_like(bias, 1e-8)
    for _ in range(rounds):
        z = np.stack([np.bincount(grams.of, w[col] * value, n) for w in weight.T], axis=1) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance / n
        slope = np.stack([np.bincount(col, e[grams.of] * value, len(column)) for e in error.T], axis=1) + ridge * weight
        power += slope**2
        power_b += error.sum(axis=0) ** 2
        weight -= 0.5 * slope / np.sqrt(power)
        bias -= 0.5 * error.sum(axis=0) / np.sqrt(power_b)
    table = np.zeros((BUCKETS, y.shape[1]), np.float32)
    table[column] = weight
    return table, bias


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(ordinary: list[str], each: int = 30, seed: int = 8) -> dict:
    """The classifier, from the templates and paragraphs of ordinary text (those like a template are left out)."""
    rng = np.random.default_rng(seed)
    families = list(TEMPLATES)
    known = {f: np.unique(Paragraphs(pa.array([t])).pairs[0]) for f, t in TEMPLATES.items()}
    own = np.concatenate(list(known.values()))
    if ordinary:
        seen = Paragraphs(pa.array([re.sub(r"\s+", " ", t) for t in ordinary]))
        like = np.bincount(seen.doc[seen.pairs[1]], np.isin(seen.pairs[0], own), len(ordinary))
        of = np.bincount(seen.doc[seen.pairs[1]], minlength=len(ordinary))
        ordinary = [t for t, a, b in zip(ordinary, like, of) if a < 0.3 * max(b, 1)]
    pieces = _pieces(rng, each)
    names = [NONE, *families]
    bare = {i: " " for i in range(128) if not chr(i).isalnum()}
    texts = [" ".join(t.translate(bare).split()[:LONGEST]) for t in [t for _, t in pieces] + (ordinary or ["the of and to in is it"])]
    label = np.array([names.index(f) for f, _ in pieces] + [0] * (len(texts) - len(pieces)))
    filled = [i for i, t in enumerate(texts) if re.search(r"[^\x20\x09-\x0D]", t)]
    texts, label = [texts[i] for i in filled], label[filled]
    test = rng.random(len(texts)) < 0.25
    grams = lambda rows: Paragraphs(pa.array([texts[i] for i in rows]))

    def fit(rows: np.ndarray, columns: list[int]) -> tuple[np.ndarray, np.ndarray]:
        return _fit(grams(rows), (label[rows][:, None] == np.array(columns)).astype(float))

    everyone = list(range(len(names)))
    strangers = []
    for f in range(1, len(names)):
        columns = [c for c in everyone if c != f]
        table, bias = fit(np.flatnonzero(~test & (label != f)), columns)
        strange = np.flatnonzero(test & (label == f))
        strangers += _chance(grams(strange).scores(table, bias))[:, 1:].max(axis=1).tolist() if len(strange) else []
    table, bias = fit(np.flatnonzero(~test), everyone)
    calm = np.flatnonzero(test & (label == 0))
    plain = _chance(grams(calm).scores(table, bias))[:, 0] if len(calm) else np.array([0.5])
    table, bias = fit(np.arange(len(texts)), everyone)
    # a family must pass what nine in ten strangers reach; nothing is unknown that is as ordinary as the least ordinary of 1000
    least, odd = float(np.quantile(strangers, 0.9)) if strangers else 0.5, float(np.quantile(plain, 0.001))
    word_sets = [np.unique(Paragraphs(pa.array([t])).words.hash) for t in TEMPLATES.values()]
    many, times = np.unique(np.concatenate(word_sets), return_counts=True)
    seen = _without_notices(Paragraphs(pa.array(ordinary)), *np.unique(own, return_counts=True)) if ordinary else many[:0]
    return {"names": names, "table": table, "bias": bias, "least": max(0.3, least), "odd": min(0.5, odd), "known": known, "cues": np.setdiff1d(many[times > 1], seen)}


def learn(docs: DataFrame, sample_docs: int = 400, sample_paragraphs: int = 1500, excerpt: int = 4000) -> dict:
    rows = docs.where("doc_id is not null and text is not null").select(F.xxhash64("doc_id", F.lit(8)).alias("key"), F.col("text").cast("string").alias("text"))
    n = rows.count()
    place = F.pmod(F.xxhash64("key", F.lit(1)), F.greatest(F.lit(1), F.length("text") - excerpt)) + 1
    picked = rows.where(F.pmod("key", F.lit(1 << 20)) < min(1.0, 1.5 * sample_docs / max(n, 1)) * (1 << 20)).select("key", F.col("text").substr(place.cast("int"), F.lit(excerpt)).alias("text")).collect()
    picked = sorted(picked, key=lambda r: (r["key"], r["text"]))[:sample_docs]
    return train([line for r in picked for line in r["text"].split("\n") if line.strip()][:sample_paragraphs])


FOUND = pa.schema([("doc_id", pa.int64()), ("licence", pa.string()), ("families", pa.list_(pa.string())), ("n_notices", pa.int64()), ("n_unknown", pa.int64()), ("notices", pa.list_(pa.string())), ("score", pa.float64())])


def _scan(model: dict, confirm: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known = model["names"], model["known"]
        for batch in by_bytes(batches):
            n = batch.num_rows
            out: list[dict] = [{"doc_id": i, "licence": NONE, "families": set(), "n_notices": 0, "n_unknown": 0, "notices": [], "score": 0.0} for i in batch.column("doc_id").to_pylist()]
            grams = Paragraphs(batch.column("text"))
            if n and len(grams.begin):
                chance = _chance(grams.scores(model["table"], model["bias"]))
                odd = np.flatnonzero((chance[:, 0] < 0.5) & (grams.count > 1))
                pair, of = grams.pairs
                raw = utf8_bytes(batch.column("text"))
                cues = np.concatenate(([0], np.cumsum(np.isin(grams.words.hash, model["cues"]))))
                inside = _within_lines(grams, model, confirm, cues)
                seen = np.zeros(len(grams.line), bool)  # words of notices
                for b, e, _, _ in inside:
                    seen[b:e] = True
                of_family = np.zeros(len(grams.line), np.int8)
                for p in odd.tolist():
                    row, best = out[grams.doc[p]], int(chance[p, 1:].argmax()) + 1
                    mine = pair[np.searchsorted(of, p) : np.searchsorted(of, p, "right")]
                    same = float(np.isin(mine, known[names[best]]).mean()) if len(mine) else 0.0
                    first = grams.begin[p]
                    notice = raw[grams.words.start[first] : grams.words.end[first + grams.count[p] - 1]].decode(errors="replace")
                    if chance[p, best] >= model["least"] and same >= confirm:
                        row["families"].add(names[best])
                        row["score"] = max(row["score"], float(chance[p, best]))
                        if first and grams.line[first - 1] == grams.line[first] and of_family[first - 1] == best:
                            row["notices"][-1] += " " + notice  # the next part of the same line
                        else:
                            row["n_notices"] += 1
                            row["notices"].append(notice)
                        of_family[first : first + grams.count[p]] = best
                        seen[first : first + grams.count[p]] = True
                    elif chance[p, 0] < model["odd"] and not seen[first : first + grams.count[p]].any() and cues[first + grams.count[p]] - cues[first] > 1:
                        row["n_unknown"] += 1
                        row["notices"].append(notice)
                        seen[first : first + grams.count[p]] = True
                for b, e, c, score in inside:
                    if not (of_family[b:e] == c).any():
                        row = out[grams.words.doc[b]]
                        row["families"].add(names[c])
                        row["n_notices"] += 1
                        row["score"] = max(row["score"], score)
                        row["notices"].append(raw[grams.words.start[b] : grams.words.end[e - 1]].decode(errors="replace"))
                begin, end = grams.windows()
                chance = _chance(grams.span_scores(begin, end, model["table"], model["bias"]))
                for i in np.flatnonzero((chance[:, 0] < model["odd"]) & (cues[end] - cues[begin] > 1)).tolist():
                    b, e = begin[i], end[i]
                    notice = raw[grams.words.start[b] : grams.words.end[e - 1]].decode(errors="replace")
                    if not seen[b:e].any():
                        row = out[grams.words.doc[b]]
                        row["n_unknown"] += 1
                        row["notices"].append(notice)
                        seen[b:e] = True
                for row in out:
                    row["families"] = sorted(row["families"])
                    row["licence"] = row["families"][0] if len(row["families"]) == 1 else "several" if row["families"] else UNKNOWN if row["n_unknown"] else NONE
            for row in out:
                row["families"] = list(row["families"])
            yield pa.RecordBatch.from_pylist(out, FOUND)

    return run


def utf8_bytes(texts: pa.Array) -> bytes:
    from .words import utf8

    return utf8(texts)[0].tobytes()


def scan_licences(docs: DataFrame, model: dict, confirm: float = 0.6) -> DataFrame:
    """doc_id, licence (a family, several, unknown or none), families, n_notices, n_unknown, notices, score."""
    session_defaults(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(model, confirm), "doc_id long, licence string, families array<string>, n_notices long, n_unknown long, notices array<string>, score double")


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scan_licences(docs, learn(docs))
