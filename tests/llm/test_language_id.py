import random

import pytest
from tests_llm_helpers import SCHEMA, awkward

from tablewarden.llm import language_id as m

WORDS = {"xx": ["alpha", "beta", "gamma", "delta", "omega"], "yy": ["der", "und", "straße", "über", "nicht"], "zz": ["qué", "niño", "pero", "todo", "hola"]}


def corpus(n=240):
    rng = random.Random(3)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 80))), lang, "s", 0) for i in range(n) for lang in [sorted(WORDS)[i % 3]]]


def phrases(text, sample):
    """Greedy parse into longest substrings of the sample, character by character."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


def test_counts_match_a_plain_parse(monkeypatch):
    samples = (("a", "abc abd xyz 汉字文本"), ("b", "hello world"))
    parser = m.Parser(samples)
    texts = ["abc hello", "zzz", "", None, "abd  xyz 12 wor", "q", "été abc " * 600, "汉字 文 本语 " * 9, "hello wor" * 999, "\U0001f600 1"]
    decode = lambda codes: "".join(chr(97 + c) for c in codes)
    known = [decode(parser.alphabet.codes([t])[0]) for _, t in samples]
    for segment in (m.SEGMENT, 7):  # phrases over the edges of pieces count once
        monkeypatch.setattr(m, "SEGMENT", segment)
        total, sizes, letter = parser.phrases(texts)
        for i, t in enumerate(texts):
            code = decode(parser.alphabet.codes([t])[0])
            assert sizes[i] == len(code)
            for k, sample in enumerate(known):
                assert total[k, i] == phrases(code, sample)
        assert letter.tolist() == [True, True, False, False, True, True, True, True, True, False]


def test_scripts_of_many_letters_are_told_apart(spark):
    rng = random.Random(8)
    pool = {"zh": [chr(0x4E00 + i) for i in range(0, 1500, 2)], "ja": [chr(0x4E00 + i) for i in range(1, 1500, 2)], "ko": [chr(0xAC00 + i) for i in range(800)], "ru": list("абвгдежзиклмнопрст")}
    text = lambda lang: " ".join("".join(rng.choices(pool[lang][: 40 if k else None], k=4)) for k in range(40))
    rows = [(i, text(lang), lang, "s", 0) for i in range(160) for lang in [sorted(pool)[i % 4]]]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = m.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and all(r["lang"] == r["lang_pred"] for r in got)


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    rows = m.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 30 and all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in rows)


def test_awkward_rows(spark):
    docs = spark.createDataFrame(corpus(60) + awkward(1000), SCHEMA)
    got = m.identify(docs).collect()
    assert len(got) == docs.count()
    empty = {r["doc_id"]: r for r in got}
    assert empty[1000]["lang_pred"] == "und" and empty[1001]["lang_pred"] == "und" and empty[1000]["score"] == 0
    wide = docs.withColumnRenamed("source", "lang_pred").withColumnRenamed("n_chars", "row")
    kept = m.keep_identified(wide)
    assert kept.columns == wide.columns and kept.where("text is null or text = ''").isEmpty()
    assert m.identify(docs.limit(0)).collect() == []
    assert {r["lang_pred"] for r in m.identify(docs.withColumn("lang", m.F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("size", [1, 5])
def test_too_large_a_sample_is_refused(size):
    assert len(m.automaton([1, 2, 1], 4)) >= 4 * size / size
