"""All ten operators and all stages on rows that are hard to bear, on tables with clashing columns, and on empty ones."""

import pytest
from pyspark.sql import functions as F
from tests_llm_helpers import SCHEMA, awkward

import corpus_pipeline
from tablewarden.llm import fingerprints, language_id, licences, mixing, near_dedup, packing, quality_rules, substring_dedup, toxicity, warc

MOST, LEAST = (1 << 63) - 1, -(1 << 63)
CLASHING = ("part", "kind", "block", "copies", "h", "df", "bucket", "extra", "head", "words", "hashes", "filled", "low", "own", "leaf", "budget", "piece", "start", "length", "rank", "n", "held_out", "score", "unit", "toxic", "quality", "class_id", "kept", "key", "stratum", "page_id", "url", "html")


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    word = "lorem ipsum dolor sit amet consectetur adipiscing elit "
    odd = [
        (MOST, "the last id of all", "en", "s", 0), (LEAST, "the first id of all", "en", "s", 0), (700, " " * 1_000_000 + "x" + "\n" * 300_000 + "\t" * 400_000 + " " * 100_000, "en", "s", 0),
        (701, word * 190_000, "en", "s", 0), (702, "y" * 400_000, "de", None, 0), (703, "." * 300_000, None, "s", 0),
    ]
    df = spark.createDataFrame(odd + awkward(500), SCHEMA).withColumns({c: F.lit("clash") for c in CLASHING})
    path = str(tmp_path_factory.mktemp("awkward"))
    df.write.parquet(path + "/documents.parquet")
    labels = spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in (*range(500, 508), 700, 701, MOST, LEAST)] + [(None, 1, 1), (501, None, None)], "doc_id long, quality int, toxic int")
    labels.withColumn("text", F.lit("clash")).write.parquet(path + "/labels.parquet")
    return spark.read.parquet(path + "/documents.parquet"), spark.read.parquet(path + "/labels.parquet")


def pages(docs):
    return docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a/b").alias("url"), F.col("text").alias("html"))


OPERATORS = {
    "op1": (lambda d, _: mixing.select_mix(d, mixing.Mix()), "most"), "op2": (lambda d, _: warc.build_derivatives(warc.responses_of_pages(pages(d))), None), "op3": (lambda d, _: substring_dedup.dedup_substrings(d), "each"), "op4": (lambda d, _: fingerprints.fingerprints(d), "each"),
    "op5": (lambda d, labels: quality_rules.apply_quality_rules(d, labels), "each"), "op6": (lambda d, _: packing.pack_documents(d, packing.default_tokenizer()), None), "op7": (lambda d, labels: toxicity.score_toxicity(d, toxicity.learn(d, labels)), "each"),
    "op8": (lambda d, _: licences.scan_licences(d, licences.learn(d)), None), "op9": (lambda d, _: near_dedup.near_classes(d), "each"), "op10": (lambda d, _: language_id.identify(d), "each"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, rows, name):
    docs, labels = rows
    run, size = OPERATORS[name]
    assert run(docs.limit(0), labels.limit(0)).collect() == []
    n = run(docs, labels).count()
    assert n == docs.count() if size == "each" else n <= docs.count() if size == "most" else n > 0


def test_stages(spark, rows):
    docs, _ = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "").collect() == [], name
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() <= docs.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").where("offset = 0").count() > 500


def test_ids_far_apart_follow_each_other(spark):
    ids = [LEAST, LEAST + 1, -5, 1, 2, MOST - 1, MOST]
    docs = spark.createDataFrame([(i, f"text number {k} of some", "en", "s", 0) for k, i in enumerate(ids)], SCHEMA)
    out = {r["doc_id"]: r["edited"] for r in fingerprints.fingerprints(docs).collect()}
    for k, i in enumerate(ids):
        mine, other = f"text number {k} of some", f"text number {(k + 1) % len(ids)} of some"
        assert out[i] == mine[: len(mine) - len(mine) // 2] + other[: len(mine) // 2]


def test_long_runs_have_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    ids, whole = packing.encoder(path), Tokenizer.from_file(path)
    for text in (" " * 1_200_000, "a b" + "\n" * 500_000 + " c", "x" * 100_000, "é" * 50_000 + " " + "." * 50_000):
        assert ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids
