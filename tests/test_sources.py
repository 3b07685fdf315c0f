import pytest
from pyspark.sql import functions as F

from tablewarden import pipeline
from tablewarden.sources import tables as S


def test_csv_round_trip(spark, tmp_path):
    p = tmp_path / "t_dirty.csv"
    p.write_text('name,age\n"a, b",5\n,7\n"x ""y""",\n', encoding="utf-8")
    rows = [tuple(r) for r in S.read_csv(spark, str(p)).orderBy("row_id").collect()]
    assert rows == [(0, "a, b", "5"), (1, None, "7"), (2, 'x "y"', None)]
    assert [tuple(r) for r in S.read_csv(spark, str(p), keep_empty=True).orderBy("row_id").collect()][1] == (1, "", "7")
    empty = tmp_path / "e.csv"
    empty.write_text("name,age\n")
    with pytest.raises(ValueError):
        S.read_csv(spark, str(empty), keep_empty=True)


def test_mask_and_judgments(spark, tmp_path):
    m = tmp_path / "m.csv"
    m.write_text("a,b\nTrue,False\nodd,0\n")
    assert sorted(map(tuple, S.read_mask(spark, str(m)).collect())) == [(0, "b"), (1, "b")]
    j = tmp_path / "j.csv"
    j.write_text("row_id,column,is_error,confidence\n1,a,true,1.7\n2,b,what,x\n")
    assert [(r["row_id"], r["is_error"], r["confidence"]) for r in S.read_judgments(spark, str(j)).orderBy("row_id").collect()] == [(1, True, 1.0), (2, False, 0.0)]


def test_files_of_the_driver(spark, tmp_path):
    S.write_json(str(tmp_path / "x/y.json"), {"b": 1})
    assert S.fingerprint({"a": 1, "b": 2}) == S.fingerprint({"b": 2, "a": 1})
    with S.run_lock(str(tmp_path / "lock")):
        with pytest.raises(BlockingIOError), S.run_lock(str(tmp_path / "lock")):
            pass
    cache = S.AnswerCache(str(tmp_path / "c.json"), "v1", 1)
    cache.set({"q": 1}, "yes")
    assert S.AnswerCache(str(tmp_path / "c.json"), "v1").get({"q": 1}) == "yes"
    assert S.AnswerCache(str(tmp_path / "c.json"), "v2").get({"q": 1}) is None
    assert S.read_semantic_types(spark, str(tmp_path / "none.json")) == {}
    assert S.dataset_paths("data/beers_dirty.csv")["name"] == "beers"


def test_whole_chain_finds_the_planted_errors(spark):
    rows = [(i, ("Austin", "TX") if i % 2 else ("Boston", "MA")) for i in range(120)]
    rows = [(i, *(("Austin", "MA") if i == 31 else (None, "TX") if i == 33 else c), "?" if i == 35 else "n") for i, c in rows]
    df = spark.createDataFrame(rows, "row_id long, city string, state string, note string")
    got = {(r["row_id"], r["column"]): r["suggested_fix"] for r in pipeline.run(df).final.collect()}
    assert got[31, "state"] == "TX"
    assert (33, "city") in got and (35, "note") in got
    assert {i for i, _ in got} == {31, 33, 35}


def test_stream_gives_the_batch_rows(spark, tmp_path):
    from tablewarden.operators.rules import Rule, first_violations
    from tablewarden.streaming.cells import stream_findings

    df = spark.createDataFrame([(1, "a", "5"), (2, "", "x"), (3, "b", "7")], "row_id long, name string, n string")
    df.write.parquet(str(tmp_path / "in"))
    rules = [Rule("n", "logical_type", {"type": "int"})]
    stream = stream_findings(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), rules)
    run = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(map(tuple, spark.table("found").collect())) == sorted(map(tuple, first_violations(df, rules).collect()))


def test_headers_are_read_as_they_stand(spark, tmp_path):
    for name, head in (("twice", "a,a,b"), ("blank", "a,,b"), ("none", "")):
        (tmp_path / f"{name}.csv").write_text(f"{head}\n1,2,3\n" if head else "")
        with pytest.raises(ValueError):
            S.read_csv(spark, str(tmp_path / f"{name}.csv"), keep_empty=True)
    (tmp_path / "good.csv").write_text("﻿a,\"b,c\"\n1,\n,2\n")
    got = S.read_csv(spark, str(tmp_path / "good.csv"), keep_empty=True)
    assert got.columns == ["row_id", "a", "b,c"] and [tuple(r) for r in got.orderBy("row_id").collect()] == [(0, "1", ""), (1, "", "2")]


def test_row_ids_count_over_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select(F.col("id").cast("string").alias("v")).where("id % 3 = 0")
    got = S.with_row_ids(df).collect()
    assert sorted(r["row_id"] for r in got) == list(range(334)) and all(int(r["v"]) == 3 * r["row_id"] for r in got)
