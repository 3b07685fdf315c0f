"""Counts and votes on larger tables: what is worked out once, and that both ways of meeting counts agree."""

import pyarrow as pa
from pyspark.sql import functions as F

from tablewarden.operators import anomalies, constraints, dependencies, models


def test_equal_rows_are_judged_once_and_counts_sent_or_not_agree(spark, monkeypatch):
    rows = [(i, "xyz"[i % 3], None if i % 7 == 0 else str(i % 3 + (i % 11 == 0)), f"c{i % 2}") for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, a string, b string, c string")
    kinds, judged, votes = len({r[1:] for r in rows}), [], models.votes

    def counting(pairs, *args, **more):
        judged.append(pairs.count())
        return votes(pairs, *args, **more)

    monkeypatch.setattr(models, "votes", counting)
    sent = sorted(models.trimmed_predictions(df, ["a", "b", "c"], rounds=1).collect())
    assert len(judged) == 2 and max(judged) <= 6 * kinds
    monkeypatch.setattr(models, "SENT", 0)
    assert sorted(models.trimmed_predictions(df, ["a", "b", "c"], rounds=1).collect()) == sent
    assert {r["row_id"] for r in sent} == set(range(300))


def test_pairs_of_a_table_in_one_part_are_counted_in_many(spark):
    df = spark.createDataFrame([(i, f"v{i % 50}", f"w{i % 50}" if i % 9 else " ") for i in range(1000)], "row_id long, a string, b string").coalesce(1)
    pairs = dependencies._pairs(df, ["a", "b"])
    parts = pairs.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()
    assert len(parts) > 1 and sum(r["n"] for r in parts) == 2 * sum(i % 9 != 0 for i in range(1000))
    assert set(dependencies.usable_pairs(df, ["a", "b"], dependencies.Gates())) == {("a", "b"), ("b", "a")}


def test_pairs_of_blocks_come_in_small_batches(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i * j % 17) for j in range(16)]) for i in range(400)], "vec_id long, embedding array<float>").coalesce(1)

    def sizes(k):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes]), pa.array([0.0])], ["query_id", "vec_id", "distance"])

        return run

    monkeypatch.setattr(anomalies, "_nearest_of_blocks", sizes)
    monkeypatch.setattr(anomalies, "PAIR_BYTES", 20_000)
    got = anomalies.nearest(df, df, 1000, block=16).collect()
    assert sum(r["query_id"] for r in got) == 25 * 25 and max(r["vec_id"] for r in got) < 40_000


def test_checks_of_one_row_share_one_pass(spark):
    df = spark.createDataFrame([(1, "x", "3"), (2, "?", "z")], "row_id long, a string, b string")
    out = constraints.execute(df, [constraints.Constraint("dmv", ("a",), ("a",)), constraints.Constraint("missing", ("b",), ("b",)), constraints.Constraint("type", ("b",), ("b",), params={"type": "integer"})])
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["row_id"], r["column"], r["family"]) for r in out.where("status = 'violation'").collect()) == [(2, "a", "missing"), (2, "b", "format")]
