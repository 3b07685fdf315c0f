import contextlib
import hashlib
import math
import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from tests_llm_helpers import SCHEMA, awkward, words

from tablewarden.llm import near_dedup, shared, substring_dedup


def random_docs(n, seed, vocabulary=400):
    rng = random.Random(seed)
    texts = [" ".join(f"t{rng.randrange(vocabulary)}" for _ in range(rng.randint(5, 260))) for _ in range(n)]
    passage = " ".join(f"p{i}" for i in range(70))
    for i in range(0, n, 9):
        texts[i] = f"{texts[i]} {passage} tail{i}"
    for i in range(0, n - 1, 5):
        w = texts[i].split()
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(9999)}"
        texts[i + 1] = " ".join(w)
    texts[n // 2] = texts[0]
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]


def brute_substrings(rows, k):
    """By id: the words that stay, judging windows on the input. Rows without an id lose nothing."""
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j : j + k])] < i:
                gone.update(range(j, j + k))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substrings_match_brute_force(spark):
    rows = random_docs(80, 1) + awkward(500)
    docs = spark.createDataFrame(rows, SCHEMA)
    for k in (50, 7):
        out = substring_dedup.dedup_substrings(docs, k).collect()
        got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in out), key=repr)
        assert got == brute_substrings(rows, k)
    longest = {r["doc_id"]: r["longest"] for r in out}
    assert longest[40] >= 7 and longest[501] == 0


def test_substring_stage_keeps_columns(spark):
    docs = spark.createDataFrame(random_docs(40, 2), SCHEMA).withColumnRenamed("lang", "_begins")
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[0] == docs.where("doc_id = 0").first()["text"]
    assert 20 not in got  # a copy of document 0, of which nothing is left
    assert substring_dedup.dedup_substrings(docs.withColumnRenamed("_begins", "lang").limit(0)).collect() == []


def brute_classes(rows, k, threshold):
    texts = {}
    for i, t, *_ in rows:
        if i is not None:
            texts[i] = t
    bags = {}
    for i, t in texts.items():
        w = words(t)
        bags[i] = Counter(" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else Counter()
    df = Counter(s for i, t, *_ in rows if i is not None for s in bags[i])
    weight = {i: {s: n * math.log1p(len(rows) / df[s]) for s, n in b.items()} for i, b in bags.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            common = sum(min(w, weight[b].get(s, 0)) for s, w in weight[a].items())
            union = sum(weight[a].values()) + sum(weight[b].values()) - common
            if union and common / union >= threshold:
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def test_near_classes_match_brute_force(spark):
    rows = [r for r in random_docs(90, 4) + awkward(500) if r[0] != 504] + [(504, "the same row twice is fine with me", "en", "s3", 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = near_dedup.near_classes(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == brute_classes(rows, 5, 0.8)
    assert [r["class_id"] for r in got if r["doc_id"] is None] == [None]


def test_a_chain_of_copies_is_one_class(spark):
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(40):
        w = list(base)
        for j in range(i):
            w[7 * j] = f"c{j}"
        rows.append((i, " ".join(w), "en", "s", 0))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_classes(rows, 5, 0.8)


def plain_classes(rows, k=5, threshold=0.8):
    bags = {}
    for i, t, *_ in rows:
        w = words(t)
        bags[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in bags}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for b in sorted(bags):
        for a in sorted(bags):
            if a < b and bags[a] and len(bags[a] & bags[b]) >= threshold * len(bags[a] | bags[b]):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in bags}


def test_plain_near_copies_of_a_hot_group(spark, tmp_path):
    rng = random.Random(12)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(240):
        w = [f"t{rng.randrange(300)}" for _ in range(rng.randint(30, 120))]
        if i % 3 == 0:  # a third of all rows: copies of one text, each with two words of its own
            w = list(base)
            for j in (rng.randrange(10, 90), rng.randrange(100, 190)):
                w[j] = f"e{i}x{j}"
        elif i % 30 == 1:  # a phrase many times: as a set like the next row, which has it twice
            w = w + "one two three four five six".split() * 20
        elif i % 30 == 2:
            w = [x for x in rows[-1][1].split() if x[0] == "t"] + "one two three four five six".split() * 2
        rows.append((i, " ".join(w), "en", "s", 0))
    want = plain_classes(rows)
    assert {want[i] for i in range(0, 240, 3)} == {0}
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.op9_near_dedup(spark, str(tmp_path)).collect()} == want
    assert sorted(r["doc_id"] for r in near_dedup.keep_first(docs).collect()) == sorted(i for i, c in want.items() if i == c)


def test_near_dedup_stage(spark):
    docs = spark.createDataFrame(random_docs(40, 6) + awkward(500), SCHEMA).withColumnRenamed("lang", "class_id")
    out = near_dedup.keep_first(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert 20 not in ids and None in ids and ids.count(504) == 2
    assert near_dedup.near_classes(docs.limit(0)).collect() == []


def test_sample_agrees_as_often_as_weights_overlap():
    import numpy as np

    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    w1, w2 = rng.random(60) + 0.1, rng.random(60) + 0.1
    same = 0
    for seed in range(600):
        a = near_dedup.sample(h, w1, np.array([0]), np.array([1]), np.array([0.0]), seed)
        b = near_dedup.sample(h, w2, np.array([0]), np.array([2]), np.array([0.0]), seed)
        same += int(a[0] == b[0])
    assert abs(same / 600 - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 0.07


def test_substrings_match_sql(spark):
    import duckdb

    from tablewarden.llm.queries import ORACLE_SQL, QUERIES

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet*')")
    want = con.sql(ORACLE_SQL["op3_substring_dedup"])
    got = QUERIES["op3_substring_dedup"](spark, folder).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def edited(rng, base, most):
    """base with up to `most` words changed, some to words that other copies get too, and now and then cut."""
    w = list(base)
    for j in rng.sample(range(len(w)), rng.randint(0, most)):
        w[j] = f"e{j % 3}" if rng.random() < 0.6 else f"own{rng.random()}"
    return w[: rng.randint(int(0.7 * len(w)), len(w))] if rng.random() < 0.3 else w


@pytest.mark.parametrize("pairwise, plain", [(256, True), (40, True), (256, False)])
def test_texts_unlike_their_pivot_are_still_linked(spark, pairwise, plain):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    second = base[:60] + [f"s{i}" for i in range(60)]
    rows = [(i, " ".join(edited(rng, base if i % 2 else second, 9 if plain else 2)), "en", "s", 0) for i in range(150)]
    want = plain_classes(rows) if plain else brute_classes(rows, 5, 0.8)
    assert len(set(want.values())) > 20 and max(map(list(want.values()).count, want.values())) > 20
    docs = spark.createDataFrame(rows, SCHEMA)
    # bands of one row miss no pair, so what is missing would be the fault of the pivots
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs, plain=plain, bands=24, rows=1, pairwise=pairwise).collect()}
    assert got == want


def damped_classes(rows, k=5, threshold=0.8):
    """Classes by brute force: weighted Jaccard similarity of smoothed TF-IDF weights."""
    bags = {}
    for i, t, *_ in rows:
        w = words(t)
        bags[i] = Counter(" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else Counter()
    df = Counter(s for b in bags.values() for s in b)
    weight = {i: {s: 1 + n / (1 + n) * math.log1p(len(rows) / df[s]) / math.log1p(len(rows)) for s, n in b.items()} for i, b in bags.items()}
    least, parent = threshold / (threshold + (1 - threshold) * 1.5), {i: i for i in bags}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for b in sorted(bags):
        for a in sorted(bags):
            if a < b and bags[a].keys() & bags[b].keys():
                common = sum(min(w, weight[b].get(s, 0)) for s, w in weight[a].items())
                if common / (sum(weight[a].values()) + sum(weight[b].values()) - common) >= least:
                    p, q = root(a), root(b)
                    parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in bags}


@pytest.mark.parametrize("pairwise", [256, 40])
def test_weighted_similarity_decides(spark, pairwise):
    rng = random.Random(31)
    base = [f"b{i}" for i in range(120)]
    second = [f"b{i}" if i < 90 else f"s{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base if i % 2 else second, 12)), "en", "s", 0) for i in range(150)]
    want = damped_classes(rows)
    assert 10 < len(set(want.values())) < 140 and want != plain_classes(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs, damped=True, bands=24, rows=1, pairwise=pairwise).collect()}
    assert got == want


def test_recall_of_planted_near_copies(spark, tmp_path):
    """Copies of many texts with words changed here and there: of those of a plain similarity of 0.8 or more nearly all are found, other texts stay."""
    rng = random.Random(32)
    rows, source = [], {}
    for i in range(120):
        rows.append((i, " ".join(f"t{rng.randrange(4000)}" for _ in range(rng.randint(40, 200))), "en", "s", 0))
    for i in range(120, 300):
        source[i] = 0 if i % 3 == 0 else rng.randrange(1, 90)  # one text has many copies
        w = rows[source[i]][1].split()
        for _ in range(max(1, int(len(w) * rng.choice([0.01, 0.02, 0.04, 0.08])))):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.op9_near_dedup(spark, str(tmp_path)).collect()}
    bag = lambda t: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)}
    near = [i for i, s in source.items() if len(bag(rows[i][1]) & bag(rows[s][1])) >= 0.8 * len(bag(rows[i][1]) | bag(rows[s][1]))]
    assert len(near) > 60 and sum(got[i] == got[source[i]] for i in near) >= 0.98 * len(near)
    assert all(got[i] == i for i in range(90, 120)) and all(got[i] in (i, *source.values()) or got[i] in source for i in source)


def test_hashes_of_words_need_no_arrays_as_long_as_the_text():
    import tracemalloc

    from tablewarden.llm.words import _ODD, hashes, mix

    rng = np.random.default_rng(3)
    buf = rng.integers(0, 256, 4 << 20).astype(np.uint8)
    end = np.cumsum(rng.integers(0, 12, len(buf) // 6))
    end = end[end <= len(buf)]
    start = np.concatenate(([0], end[:-1]))
    tracemalloc.start()
    got = hashes(buf, start, end, seed=5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * len(buf)  # as arrays of a value for each byte it took 21 bytes a byte of text
    for i in [0, 1, 2, len(end) // 2, len(end) - 1, int(np.argmax(end - start))]:
        term = sum((int(b) + 1) * pow(_ODD, k, 1 << 64) for k, b in enumerate(buf[start[i] : end[i]])) + 5
        size = int(mix(np.array([end[i] - start[i]], np.uint64))[0])
        assert mix(np.array([(term + size) % (1 << 64)], np.uint64))[0] == got[i]
    one = np.array([0]), np.array([200_000])  # longer than a block
    assert hashes(buf, *one)[0] == hashes(buf, *one, at_once=1 << 20)[0]


def test_order_by_text_is_that_of_both_keys():
    rng = np.random.default_rng(1)
    for most in (3, 70_000):
        doc, h = np.sort(rng.integers(0, most, 100_000)), rng.integers(0, 500, 100_000).astype(np.uint64) << np.uint64(50)
        got, want = near_dedup.by_text(doc, h), np.lexsort((h, doc))
        assert (doc[got] == doc[want]).all() and (h[got] == h[want]).all()


def test_a_bucket_that_pivots_do_not_split_ends_after_a_few_rounds(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, 4 if i % 12 else 14)), "en", "s", 0) for i in range(150)]
    rounds, written = [], near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, name, **more: (rounds.append(name), written(df, name, **more))[1])
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(rows, SCHEMA), damped=True, bands=24, rows=1, pairwise=40).collect()}
    want = damped_classes(rows)
    assert got == want and max(map(list(want.values()).count, want.values())) > 80
    assert rounds.count("compared") <= 6  # with a pivot for each round it took 38


def test_samples_by_levels_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(2)
    h, w = rng.integers(0, 1 << 62, 60, dtype=np.uint64), rng.random((2, 60)) + 1
    has, rest = rng.random((2, 60)) < 0.8, (3.7, 1.2)
    same = 0
    for seed in range(4000):
        a, b = (near_dedup.sample_by_levels(h[m], x[m] - 1, np.array([0]), np.array([m.sum()]), np.array([i]), np.array([r]), seed)[0] for i, (m, x, r) in enumerate(zip(has, w, rest)))
        same += int(a == b)
    x, y = w * has
    assert abs(same / 4000 - np.minimum(x, y).sum() / (np.maximum(x, y).sum() + sum(rest))) < 0.03


def test_sketches_cost_a_part_of_sampling_by_logarithms():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 1500)]
    texts = pa.array([" ".join([*base, f"end{i}"]) for i in range(120)], pa.large_string())
    doc, h, tf = near_dedup._shingles(texts, 5, 8)
    known, df = np.unique(h, return_counts=True)
    known, df = known[df > 1], df[df > 1]
    packed = [r for b in near_dedup._pack_texts(1)(iter([pa.RecordBatch.from_arrays([pa.array(range(120), pa.int64()), texts], ["doc_id", "text"])])) for r in b.to_pylist()]
    rows = [{"kind": 0, "h": known.astype("<u8").tobytes(), "df": df.astype("<u4").tobytes()}, *({"kind": 1, "doc_id": i, "copies": 1} for i in range(120)), *packed]
    began = time.thread_time()
    found = [r for b in near_dedup._sketch(120, 0.727, 16, 4, 5, 8, False, True)(iter([pa.RecordBatch.from_pylist(rows, near_dedup.FIELDS)])) for r in b.to_pylist()]
    took, began = time.thread_time() - began, time.thread_time()
    starts, size = shared.runs(doc)
    for seed in range(64):
        near_dedup.sample_by_logs(h, np.ones(len(h)), starts, doc[starts], np.ones(len(starts)), seed)
    assert len(found) == 120 and took < 0.6 * (time.thread_time() - began)


def test_shingles_are_sorted_and_looked_up_as_by_numpy():
    rng = np.random.default_rng(6)
    for n, texts in ((20_000, 60), (5_000, 3_000), (0, 1)):
        doc, h = np.sort(rng.integers(0, texts, n)), rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        got = near_dedup.sorted_by_text(doc, h)
        assert (got == h[np.lexsort((h, doc))]).all()
        keys = np.unique(np.concatenate((h[::3], h[::5] + np.uint64(1))))
        where, at = near_dedup.Known(keys).find(got)
        assert (where == np.flatnonzero(np.isin(got, keys))).all() and (keys[at] == got[where]).all()


def test_shuffle_files_of_stages_go_with_their_stage(spark):
    texts = [" ".join([*(f"w{i % 150}x{j}" for j in range(120)), f"end{i}"]) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folders = [Path(d.getPath()) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def files():
        found = {}
        for p in (p for d in folders for p in d.rglob("shuffle_*.data")):
            with contextlib.suppress(FileNotFoundError):
                found[p] = p.stat().st_size
        return found

    old, setting = files(), spark.conf.get(shared.FREED, None)
    found = near_dedup.near_classes(docs, damped=True)
    for _ in range(50):  # they go in the background
        left = sum(size for p, size in files().items() if p not in old)
        if left < 20_000:
            break
        time.sleep(0.2)
    assert left < 20_000 and spark.conf.get(shared.FREED, None) == setting
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == {i: i % 150 for i in range(300)}
