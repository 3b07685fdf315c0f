import math
import random

import pytest
from tests_llm_helpers import SCHEMA, awkward, words

from tablewarden.llm import mixing, packing, quality_rules

TOKENIZER = packing.default_tokenizer()


def docs_of(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(0, 120))), rng.choice(["en", "de", None]), f"src{rng.choice([0, 0, 0, 3, 12])}", 0) for i in range(n)]


def test_water_fill_moves_shortages_to_siblings():
    assert mixing.water_fill(100, [1, 1, 2], [10, 1000, 1000]) == [10, 30, 60]
    assert mixing.water_fill(100, [1, 0], [30, 500]) == [30, 0]


def test_shortages_stay_in_the_family_first():
    tokens = {("a", "x"): 10, ("a", "y"): 500, ("b", "z"): 500}
    got = mixing.budgets(tokens, mixing.Mix(), 200)
    assert got == {("a", "x"): 10, ("a", "y"): 90, ("b", "z"): 100}
    got = mixing.budgets(tokens, mixing.Mix(max_epochs=2), 1200)
    assert got == {("a", "x"): 20, ("a", "y"): 580, ("b", "z"): 600}


@pytest.mark.parametrize("epochs", [1, 3])
def test_each_leaf_is_whole_epochs_and_a_prefix(spark, epochs):
    rows = docs_of(400, 1)
    docs = spark.createDataFrame(rows, SCHEMA)
    mix = mixing.Mix({("web",): 3.0, ("curated",): 1.0}, share=0.7, max_epochs=epochs, bins=16)
    out = mixing.select_mix(docs, mix).select("row.doc_id", "leaf", "epoch", "n_tokens", "budget").collect()
    size = {r[0]: len(words(r[1])) for r in rows}
    leaves = {}
    for r in out:
        assert r["n_tokens"] == size[r["doc_id"]]
        leaves.setdefault(tuple(r["leaf"]), []).append(r)
    members = {}
    for i, t, lang, source, _ in rows:
        members.setdefault(("web" if len(source) == 4 else "curated", lang or "", source), []).append(i)
    for leaf, got in leaves.items():
        budget, total = got[0]["budget"], sum(size[i] for i in members[leaf])
        taken = sum(r["n_tokens"] for r in got)
        full = int(budget // total)
        times = {i: sum(r["doc_id"] == i for r in got) for i in members[leaf]}
        assert taken <= budget + 1e-6 and set(times.values()) <= {full, full + 1}
        if full < epochs:  # the next document of the last epoch would not fit
            rest = [i for i in members[leaf] if times[i] == full]
            assert not rest or taken + max(size[i] for i in rest) > budget or len(rest) == len(members[leaf])
    assert {tuple(map(tuple, [sorted((r["doc_id"], r["epoch"]) for r in out)]))} == {tuple(map(tuple, [sorted((r["doc_id"], r["epoch"]) for r in mixing.select_mix(docs.repartition(7), mix).select("row.doc_id", "epoch").collect())]))}


def test_mix_of_awkward_rows(spark):
    docs = spark.createDataFrame(docs_of(30, 2) + awkward(500), SCHEMA).withColumn("leaf", mixing.F.lit("x")).withColumn("budget", mixing.F.lit(1))
    out = mixing.select_mix(docs, mixing.Mix(share=1.0)).select("row.*")
    assert out.columns == docs.columns and out.count() == docs.count()
    assert mixing.select_mix(docs.limit(0), mixing.Mix()).collect() == []
    assert mixing.select_mix(docs, mixing.Mix({("*",): 0.0})).collect() == []


def test_fullest_matches_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        left = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(0, 60)
        flat = [k for k, n in left.items() for _ in range(n)]
        sums = {0}
        for x in flat:
            sums |= {s + x for s in sums if s + x <= room}
        got = packing.fullest(room, left)
        assert sum(got) == max(sums) and all(got.count(k) <= left[k] for k in got)


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    whole, ids = Tokenizer.from_file(TOKENIZER), packing.encoder(TOKENIZER)
    rng = random.Random(4)
    alphabet = "aB é ß\n\t　 '’s 1٣२¼ !?-_ \U0001f600́‍漢字ก don't we'll  \r\n\x00\x1f"
    texts = ["", " ", "a<|endoftext|>b"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(600)]
    for t in texts:
        assert ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_is_exact_and_tight(spark):
    rows = docs_of(120, 3) + awkward(500)
    out = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), TOKENIZER, 128, with_ids=True).collect()
    by_seq, by_doc = {}, {}
    for r in out:
        by_seq.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert len(r["ids"]) == r["length"] <= 128
    for got in by_seq.values():
        at = 0
        for r in sorted(got, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 128
    total = sum(r["length"] for r in out)
    assert -(-total // 128) <= len(by_seq) <= -(-total // 128) + 1
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    for i, t, *_ in rows[:40] + rows[-3:]:
        got = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [x for r in got for x in r["ids"]] == whole.encode(t or "", add_special_tokens=False).ids + [0]
        assert all(r["length"] == 128 for r in got[1:])
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), TOKENIZER).collect() == []


def binomial_tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_upper_bound_is_exact():
    for k, n in [(0, 10), (3, 40), (17, 300)]:
        u = quality_rules.upper_bound(k, n, 0.01)
        assert abs(binomial_tail(k, n, u) - 0.01) < 1e-6
    assert quality_rules.upper_bound(5, 5, 0.01) == 1.0


def brute_counts(text):
    import re
    from collections import Counter

    w, seen, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


def test_counts_and_rules(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(1500):
        good = rng.random() < 0.8
        body = " ".join(f"word{rng.randrange(900)}" for _ in range(rng.randint(12, 60)))
        text = body if good or rng.random() < 0.2 else " ".join(w + "###" for w in body.split()) + "\nagain and again\nagain and again"
        rows.append((i, text, "en", "s", 0))
        labels.append((i, int(good), 0))
    rows += awkward(5000)
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules.apply_quality_rules(docs, marks, risk=0.1).collect()
    got = sorted(((r["doc_id"], *(r[c] for c in quality_rules.COUNTS)) for r in out), key=repr)
    assert got == sorted(((i, *brute_counts(t)) for i, t, *_ in rows), key=repr)
    good = dict((i, q) for i, q, _ in labels)
    kept = {r["doc_id"]: r["kept"] for r in out}
    assert sum(not kept[i] for i, q in good.items() if q) <= 0.1 * sum(good.values())
    assert sum(not kept[i] for i, q in good.items() if not q) > 100
    assert all(not kept[i] for i in (5000, 5001, 5002))
    bare = quality_rules.apply_quality_rules(docs, marks.limit(0))
    assert bare.where("not base_failed and not kept").isEmpty()
    assert quality_rules.apply_quality_rules(docs.limit(0), marks).collect() == []


def test_rules_keep_their_guarantee_by_brute_force(spark):
    """The chain of each stratum goes as far as exact binomial sums allow; a small stratum is pooled."""
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(2400):
        lang = "en" if i % 3 else "de" if i % 27 else "fr"
        good = rng.random() < 0.75
        body = [f"word{rng.randrange(900)}" for _ in range(rng.randint(15, 40))]
        marks = rng.random() * (0.15 if good and lang == "en" else 0.0 if good else 1.0)
        rows.append((i, " ".join(w + "#" if rng.random() < marks else w for w in body), lang, "s", 0))
        labels.append((i, int(good), 0))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    counts = quality_rules.counted(docs)
    risk, delta = 0.05, 0.05
    rules = quality_rules.cutoffs(counts, marks, risk, delta)
    seen = [r.asDict() for r in quality_rules.labelled(counts, marks).collect()]
    n = {s: sum(r["tests"] and r["good"] for r in seen if r["stratum"] == s) for s in ("en", "de", "fr")}
    group = quality_rules.pools(n, risk, delta)
    assert group["en"] == "en" and group["fr"] == "*" and rules["en"] and "fr" not in rules
    for g in set(group.values()):
        mine = [r for r in seen if group[r["stratum"]] == g and r["tests"] and r["good"]]
        lost = sum(any(r[k] > c for k, c in rules.get(g, {}).items()) for r in mine)
        assert binomial_tail(lost, len(mine), risk) <= delta / len(set(group.values())) or not rules.get(g)
    judged = quality_rules.judged(counts, rules).where("size(rejected_by) > 0").count()
    assert judged > 300


def test_chain_takes_the_cheapest_step_first():
    grid = {"a": [(9.0, 0, 5), (5.0, 3, 50)], "b": [(2.0, 0, 20), (1.0, 1, 25)]}
    assert quality_rules.chain_of(grid, 10) == [("b", 2.0), ("a", 9.0), ("b", 1.0), ("a", 5.0)]
    assert quality_rules.chain_of(grid, 0) == [("b", 2.0), ("a", 9.0)]
    for k, n, p in ((0, 50, 0.02), (7, 300, 0.03), (40, 90, 0.4), (89, 90, 0.99)):
        assert abs(quality_rules.binomial_tail(k, n, p) - binomial_tail(k, n, p)) < 1e-9
    assert quality_rules.binomial_tail(2_000_000, 100_000_000, 0.0201) < 1e-9 < quality_rules.binomial_tail(2_000_000, 100_000_000, 0.02)
