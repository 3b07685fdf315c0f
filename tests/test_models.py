import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden import queries as Q
from tablewarden.operators import constraints, critic, encoding, evaluation, models
from tablewarden.plans import quantiles as quantiles_module
from tablewarden.plans.dirty import view
from tablewarden.plans.quantiles import quantiles


def test_quantiles_match_numpy(spark, monkeypatch):
    monkeypatch.setattr(quantiles_module, "ORDERED", 20)
    monkeypatch.setattr(quantiles_module, "BINS", 8)
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(0, 1e6, 700), "b": np.repeat([3.0, 5.0], 400), "c": np.array([7.0]), "d": np.concatenate((rng.random(300) * 1e-9, [1e300, -1e300])), "e": rng.integers(0, 4, 500).astype(float)}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("a", None), ("f", None), (None, 1.0), (None, 2.0)]
    shares = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = {r["k"]: (r["n"], r["q"]) for r in quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", shares).collect()}
    assert set(got) == {*groups, None} and got[None] == (2, [1.0, 1.1, 1.5, 1.75, 2.0])
    for k, xs in groups.items():
        assert got[k][0] == len(xs) and np.allclose(got[k][1], np.quantile(xs, shares), rtol=1e-12)
    weighted = spark.createDataFrame([(float(x), int(n)) for x, n in zip(*np.unique(groups["e"], return_counts=True))], "x double, n long")
    assert quantiles(weighted, [], "x", shares, "n").first()["q"] == np.quantile(groups["e"], shares).tolist()
    assert quantiles(weighted.limit(0), [], "x", shares, "n").collect() == []


def table(spark):
    rows = [(i, f"{i % 7 * 3} min" if i % 11 else "?", ["red", "green", "blue"][i % 3] if i % 13 else None, f"name {i} of {i * i}", "", f"{10000 + i}") for i in range(60)]
    return spark.createDataFrame(rows, "row_id long, size string, colour string, name string, none string, code string")


def test_tabular_encoder_is_saved_and_loaded(spark, tmp_path):
    df = table(spark)
    model = encoding.TabularEncoder(inputCols=["size", "colour", "name", "none", "code"], maxCardinality=10, nHash=4).fit(df)
    assert [s.kind for s in model.specs] == ["numeric", "categorical", "highcard", "dropped", "highcard"]
    model.write().save(str(tmp_path / "model"))
    again = encoding.TabularEncoderModel.load(str(tmp_path / "model"))
    rows = [r["features"] for r in model.transform(df).orderBy("row_id").collect()]
    assert rows == [r["features"] for r in again.transform(df).orderBy("row_id").collect()] and again.n_features == len(rows[0]) == 2 + 6 + 12 + 12
    sizes = np.array([i % 7 * 3 for i in range(60) if i % 11])
    low, mid, high = np.quantile(sizes, [0.25, 0.5, 0.75])
    lengths = np.array([len(f"name {i} of {i * i}") for i in range(60)])
    for i, v in enumerate(r.toArray() for r in rows):
        assert np.allclose(v[:2], [(i % 7 * 3 - mid) / (high - low) if i % 11 else 0, 0 if i % 11 else 1])
        hot = np.zeros(4)
        hot[["blue", "green", "red"].index(["red", "green", "blue"][i % 3]) if i % 13 else 3] = 1
        assert v[2:6].tolist() == hot.tolist() and (v[7] == 1) == (i % 13 == 0)
        name = f"name {i} of {i * i}"
        grams = [zlib.crc32(name[j : j + 3].encode()) % 4 for j in range(len(name) - 2)]
        q = np.quantile(lengths, [0.25, 0.5, 0.75])
        want = [(len(name) - q[1]) / (q[2] - q[0]), sum(c.isdigit() for c in name) / len(name), sum(c.isalpha() for c in name) / len(name), 0, name.count(" ") / len(name), 1, 0, 1]
        assert np.allclose(v[8:20], want + [grams.count(b) / len(grams) for b in range(4)])
    unseen = spark.createDataFrame([(1, "9 min", "pink", None, None, "x")], df.schema)
    v = model.transform(unseen).first()["features"].toArray()
    assert v[5] == 1 and v[6] == 0 and v[14] == 1 and v[20 + 7] == 0


def test_encoders_of_dirty_cells_and_empty_tables(spark):
    df = table(spark)
    dirty = df.where("row_id < 57").select("row_id", F.lit("colour").alias("column"))
    model = encoding.TabularEncoder(inputCols=["colour", "size"]).fit_clean(df, dirty)
    assert model.categorical_columns() == ["colour"] and model.specs[0].n_values == 3
    empty = encoding.TabularEncoder(inputCols=["colour", "size"]).fit(df.limit(0))
    assert empty.n_features == 0 and [s.kind for s in empty.specs] == ["dropped", "dropped"]
    assert encoding.CellEncoder(df.limit(0), ["colour"]).transform(df.limit(0)).collect() == []


def test_cell_encoder_scales_by_its_reference(spark):
    df = table(spark)
    half = df.where("row_id < 30")
    encoder = encoding.CellEncoder(half, ["size", "colour"], max_categories=5)
    got = {(r["row_id"], r["column"]): r for r in encoder.transform(df).collect()}
    sizes = np.array([i % 7 * 3 for i in range(30) if i % 11])
    low, mid, high = np.quantile(sizes, [0.25, 0.5, 0.75])
    assert len(got) == 120 and all(len(r["features"]) == encoding.FEATURES for r in got.values())
    for i in range(60):
        size, colour = got[(i, "size")], got[(i, "colour")]
        if i % 11:
            assert math.isclose(size["features"][0], (i % 7 * 3 - mid) / (high - low)) and size["features"][9] == 1
        else:
            assert size["features"][0] == 0 and size["features"][6] == 1
        assert (size["kind"], colour["kind"]) == ("numeric", "categorical") and size["label"] == 0 and (colour["label"] > 0)
    changed = spark.createDataFrame([(0, "mauve", "9999 min")], "row_id long, colour string, size string")
    new = {r["column"]: r for r in encoder.transform(changed).collect()}
    assert new["colour"]["label"] == 0 and new["colour"]["features"][8] == 0 and new["size"]["features"][0] == 20


def test_peers_match_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), f"g{int(rng.integers(0, 4)) if i % 3 else 0}" if i % 17 else None) for i in rng.permutation(400)]
    got = {r["row_id"]: r["peers"] for r in critic.peers(spark.createDataFrame(rows, "row_id long, g string"), ["g"], block=30).collect()}
    groups = {}
    for i, g in sorted(rows):
        if g:
            groups.setdefault(g, []).append(i)
    want = {}
    for members in groups.values():
        for i in members:
            others = [x for x in members if x != i]
            if others:
                want[i] = [others[int(p)] for p in np.linspace(0, len(others) - 1, min(8, len(others)))]
    assert got == want


def test_corruption_is_one_cell_of_a_copy(spark):
    df = table(spark).select("row_id", "size", "colour")
    copies, wrong = critic.corrupted(df, ["size", "colour"], critic.column_scales(df, ["size", "colour"]), share=0.5)
    source = {r["row_id"]: r.asDict() for r in df.collect()}
    made, changed = {r["row_id"]: r.asDict() for r in copies.collect()}, {r["row_id"]: r for r in wrong.collect()}
    assert set(made) == set(changed) and all(i < 0 for i in made) and 20 < len(made) < 90
    sizes = np.array([i % 7 * 3 for i in range(60) if i % 11])
    scale = np.subtract(*np.quantile(sizes, [0.75, 0.25]))
    for i, row in made.items():
        c, was = changed[i]["column"], source[changed[i]["source_row"]]
        assert all(row[k] == was[k] for k in ("size", "colour") if k != c)
        number = was[c].split()[0] if c == "size" and was[c] != "?" else None
        assert row[c] == (f"{float(number) + 10 * scale} minute" if number else was[c] + "#?~")
    again, _ = critic.corrupted(df.repartition(5), ["size", "colour"], critic.column_scales(df, ["size", "colour"]), share=0.5)
    assert {r["row_id"] for r in again.collect()} == set(made)


def test_trimmed_counts_match_brute_force(spark):
    rows = [(i, "x" if i % 2 else "y", "1" if i % 2 else "2") for i in range(40)] + [(40, "x", "2"), (41, "y", "3")]
    df = spark.createDataFrame(rows, "row_id long, a string, b string")
    plain = {(r["row_id"], r["column"]): r["p"] for r in models.predictions(df, ["a", "b"]).collect()}
    trimmed = {(r["row_id"], r["column"]): r["p"] for r in models.trimmed_predictions(df, ["a", "b"], rounds=1).collect()}
    low = {(i, c) for (i, c), p in plain.items() if -math.log(p + 1e-9) > np.quantile([-math.log(q + 1e-9) for (_, d), q in plain.items() if d == c], 0.9)}
    assert (40, "b") in low and (41, "b") in low
    for i, a, b in rows:
        weight = lambda r: (0.1 if (r[0], "a") in low else 1) * (0.1 if (r[0], "b") in low else 1)
        same = [r for r in rows if r[1] == a]
        assert math.isclose(trimmed[(i, "b")], (sum(weight(r) for r in same if r[2] == b) + 1) / (sum(map(weight, same)) + 3), abs_tol=1e-6)


def test_gradient_is_right():
    rng = np.random.default_rng(3)
    c = critic.Critic(2, hidden=4)
    e = rng.random((20, 42)) * np.repeat(rng.integers(0, 2, (20, 7)), 6, axis=1)
    e[:, 4::6] = (e[:, 4::6] > 0) * 1.0
    x, y, w = rng.random((20, 2)), rng.integers(0, 2, 20).astype(float), rng.random(20)
    g = c.gradient(e, x, y, w, c.weights)
    for i in range(len(c.weights)):
        up, down = c.weights.copy(), c.weights.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert abs((c.gradient(e, x, y, w, up)[0] - c.gradient(e, x, y, w, down)[0]) / 2e-6 - g[2 + i]) < 1e-5


def test_registry():
    assert "evidence_critic" in critic.MODELS
    with pytest.raises(ValueError, match="unknown model"):
        critic.build_model("nothing")
    with pytest.raises(ValueError, match="already"):
        critic.register_model("evidence_critic")(print)


def test_cross_fit_beats_decisions_and_resumes(spark, tmp_path, monkeypatch):
    data = "/root/testdata/sf0.01"
    df, clean = view(spark, data, "customers"), view(spark, data, "clean_customers")
    columns = Q.CUSTOMER_COLUMNS
    seen = []
    real = critic.MODELS["evidence_critic"]

    def watched(examples, **params):
        seen.append(examples.count())
        return real(examples, **params)

    monkeypatch.setitem(critic.MODELS, "evidence_critic", watched)
    teacher = critic.sure_cells(constraints.execute(df, Q.CUSTOMER_PROGRAM))
    run = lambda: critic.cross_fit(df, columns, Q.CUSTOMER_PROGRAM, k=2, steps=30, folder=str(tmp_path), teacher=teacher)
    scored = run().collect()
    assert len(seen) == 2 and len(scored) == len({(r["row_id"], r["column"]) for r in scored}) == df.count() * len(columns)
    fold = {r["row_id"]: r["fold"] for r in models.folds(df.select("row_id", *(F.col(c).cast("string") for c in columns)), 2).collect()}
    assert all(r["fold"] == fold[r["row_id"]] for r in scored)
    truth = {(r["row_id"], r["column"]) for r in evaluation.wrong_cells(df, clean).collect()}
    f1 = lambda found: 2 * len(found & truth) / (len(found) + len(truth))
    decided = {(r["row_id"], r["column"]) for r in constraints.decisions(constraints.execute(df, Q.CUSTOMER_PROGRAM)).where("is_error").collect()}
    assert f1({(r["row_id"], r["column"]) for r in scored if r["score"] >= 0.5}) > f1(decided)
    import shutil

    shutil.rmtree(next(tmp_path.glob("cross-fit-*")) / "fold=1")  # as if the run had ended after the first fold
    assert run().count() == len(scored) and len(seen) == 3
    assert run().count() == len(scored) and len(seen) == 3
    same = critic.fingerprint(df, columns, Q.CUSTOMER_PROGRAM, k=2)
    assert same == critic.fingerprint(df.repartition(7), columns, Q.CUSTOMER_PROGRAM, k=2)
    assert same not in (critic.fingerprint(df.where("row_id <> 3"), columns, Q.CUSTOMER_PROGRAM, k=2), critic.fingerprint(df, columns, Q.CUSTOMER_PROGRAM[1:], k=2), critic.fingerprint(df, columns, Q.CUSTOMER_PROGRAM, k=3))


def test_store_embeds_each_text_once(spark, tmp_path):
    from tablewarden.sources.vectors import SemanticStore

    def load(log=str(tmp_path / "log")):
        def embed(texts):
            with open(log, "a") as f:
                f.write("".join(f"{t}\n" for t in texts))
            return [[float(len(t)), 1.0] for t in texts]

        return embed

    texts = lambda *xs: spark.createDataFrame([(x,) for x in xs], "value string")
    store = SemanticStore(spark, str(tmp_path / "store"), "lengths-1", load, batch=2)
    assert {(r["value"], tuple(r["vector"])) for r in store.vectors(texts("a", "bb", "a", None, "")).collect()} == {("a", (1.0, 1.0)), ("bb", (2.0, 1.0)), ("", (0.0, 1.0))}
    again = SemanticStore(spark, str(tmp_path / "store"), "lengths-1", load)
    assert {r["value"] for r in again.vectors(texts("bb", "ccc")).collect()} == {"bb", "ccc"}
    assert sorted((tmp_path / "log").read_text().split("\n")) == ["", "", "a", "bb", "ccc"]

    def missing():
        raise RuntimeError("the model is not there")

    with pytest.raises(Exception, match="the model is not there"):
        SemanticStore(spark, str(tmp_path / "store"), "other", missing).vectors(texts("a"))
    assert SemanticStore(spark, str(tmp_path / "store"), "lengths-1", missing).vectors(texts("a")).count() == 1
    encoder = encoding.CellEncoder(table(spark), ["colour"], vectors=store.vectors(table(spark).select(F.col("colour").alias("value"))))
    assert all(len(r["features"]) == encoding.FEATURES + 2 * (r["value"] is not None) for r in encoder.transform(table(spark)).collect())


def test_bootstrap_agrees_with_drawing_rows(spark):
    rng = np.random.default_rng(4)
    kinds = rng.choice([0, 1, 2, 3], 400, p=[0.5, 0.1, 0.1, 0.3])
    found = [(i, c) for i, k in enumerate(kinds.tolist()) for c in (["a"] if k in (0, 1) else [])] + [(i, "b") for i in range(0, 400, 5)]
    truth = [(i, c) for i, k in enumerate(kinds.tolist()) for c in (["a"] if k in (0, 2) else [])] + [(i, "b") for i in range(0, 400, 10)]
    frame = lambda rows: spark.createDataFrame(rows, "row_id long, column string")
    r = evaluation.bootstrap_f1(frame(found), frame(truth)).first()
    per_row = np.zeros((400, 3))
    for i in range(400):
        a, b = {c for j, c in found if j == i}, {c for j, c in truth if j == i}
        per_row[i] = len(a & b), len(a - b), len(b - a)
    f1 = lambda s: 2 * s[0] / (2 * s[0] + s[1] + s[2])
    plain = np.quantile([f1(per_row[rng.integers(0, 400, 400)].sum(0)) for _ in range(2000)], [0.025, 0.975])
    assert math.isclose(r["f1"], f1(per_row.sum(0))) and abs(r["low"] - plain[0]) < 0.01 and abs(r["high"] - plain[1]) < 0.01
    assert evaluation.bootstrap_f1(frame(found).limit(0), frame(truth).limit(0)).collect() == []
    mean, low, high = evaluation.macro_interval({"x": [0.5, 0.7], "y": [0.9], "z": [0.1, 0.3]})
    assert math.isclose(mean, (0.6 + 0.9 + 0.2) / 3) and 0.2 <= low < mean < high <= 0.9


def test_losses_are_worked_out_once(spark):
    from tablewarden.operators import models

    scored = spark.createDataFrame([(i, "c", i / 100) for i in range(1, 21)], "row_id long, column string, p double")
    out = models.highest_losses(scored)
    assert any("losses-" in f for f in out.inputFiles())  # quantiles worked the predictions out anew each time they read them
    assert sorted(r["row_id"] for r in out.collect()) == [1, 2]
