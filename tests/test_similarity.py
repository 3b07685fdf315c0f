import random

import pytest

from tablewarden.operators import anomalies, similarity


def plain_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / max(1, len(a) + len(b))


def words(n, seed):
    rng = random.Random(seed)
    out = {"".join(rng.choice("abcdeé ") for _ in range(rng.choice([1, 2, 3, 5, 6, 8, 9, 10, 14, 25]))) for _ in range(n)}
    for w in sorted(out)[: n // 2]:
        chars = list(w * rng.choice([1, 1, 2]))
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(chars) + 1)
            chars[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        out.add("".join(chars))
    return sorted(w for w in out if w)


def test_subsequence_by_bits():
    some = words(60, 1)
    assert all(similarity.indel_ratio(a, b) == plain_ratio(a, b) for a in some for b in some)
    assert similarity.indel_ratio("", "") == 0


@pytest.mark.parametrize("least", [0.72, 0.85, 0.95])
def test_pairs_match_brute_force(spark, least):
    left, right = words(150, 2), words(150, 3) + words(150, 2)[::3]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "value string")
    got = {(r["a"], r["b"]) for r in similarity.similar_pairs(frame(left), frame(right), least).collect()}
    assert got == {(a, b) for a in left for b in set(right) if plain_ratio(a, b) >= least}
    with pytest.raises(ValueError, match="0.7"):
        similarity.similar_pairs(frame(left), frame(right), 0.5)


def test_typos_count_clean_cells_and_take_the_first_seen(spark):
    rows = ["Washington"] * 20 + ["Washingtan"] * 2 + ["Washingtox"] * 10 + ["Lisbon"] * 20 + ["Lisbom"] + ["Boston"] * 5 + [None, "?"]
    df = spark.createDataFrame(list(enumerate(rows)), "row_id long, city string")
    found = {(r["row_id"], r["suggested_fix"]) for r in anomalies.typos(df, "city").collect()}
    assert found == {(20, "Washington"), (21, "Washington")}  # Lisbom has 10 of 12 characters in common, which is too few
    dirty = spark.createDataFrame([(i, "city") for i in range(22, 31)] + [(0, "city")], "row_id long, column string")
    found = {(r["row_id"], r["suggested_fix"]) for r in anomalies.typos(df, "city", dirty).collect()}
    assert {i for i, _ in found} == {20, 21, *range(22, 32)} and {fix for _, fix in found} == {"Washington"}
    assert anomalies.typos(df, "city", most_values=3).collect() == [] and anomalies.typos(df.limit(20), "city").collect() == []
