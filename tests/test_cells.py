import pytest
from pyspark.sql import functions as F

from tablewarden.functions import cells as C


def values(spark, rows, *columns):
    df = spark.createDataFrame(rows, "a string, b string")
    return [tuple(r) for r in df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).collect()]


def one(spark, texts, column):
    return [r[0] for r in values(spark, [(t, None) for t in texts], column)]


@pytest.fixture(autouse=True)
def columns(spark):
    global A, B
    A, B = F.col("a"), F.col("b")


def test_blank_sets_differ(spark):
    texts = [None, "", " \t ", "N/A", "none", "-", "?", "--", "nan", "x"]
    assert one(spark, texts, C.is_blank(A)) == [True] * 6 + [False] * 4
    assert one(spark, texts, C.is_blank(A, C.BLANK_FOR_MODELS)) == [True] * 9 + [False]


def test_shapes(spark):
    assert one(spark, ["90210-Ab", "Éa1"], C.shape(A)) == ["ddddd-Ll", "Lld"]
    assert one(spark, ["12 May 2020"], C.coarse_shape(A)) == ["N A N"]
    assert one(spark, ["Ab-1"], C.digit_pattern(A)) == ["Aa-9"]


def test_numbers(spark):
    texts = ["12", "12.5 %", "109 min", "5 oz.", "1,234", ".5", "1e5", "n/a", None, "-3"]
    assert one(spark, texts, C.number(A)) == [12.0, 12.5, 109.0, None, None, None, None, None, None, -3.0]
    assert one(spark, ["5 6 7"], C.number_tokens(A)) == [3]


def test_numbers_with_units(spark):
    got = one(spark, ["109 min", "1,2", "1,234", "3 hrs", "1e400", "7 %", "5 oz.", ".5", "5.", "1,234.5 MIN."], C.number_with_unit(A))
    assert [None if g is None else (g["x"], g["unit"]) for g in got] == [(109.0, "minute"), None, (1234.0, ""), (3.0, "hour"), None, (7.0, "percent"), (5.0, "ounce"), (0.5, ""), (5.0, ""), (1234.5, "minute")]


def test_repeated_tokens(spark):
    assert one(spark, ["Lee, lee", "a,b", "a,,a", "a", ",", None], C.repeated_token(A)) == ["Lee", None, "a", None, None, None]


def test_subsequence_and_abbreviation(spark):
    rows = [("ace", "abcde"), ("aec", "abcde"), ("", "abc")]
    assert [r[0] for r in values(spark, rows, C.is_subsequence(A, B))] == [True, False, True]
    rows = [("j comp chem", "journal of computational chemistry"), ("comp", "computational"), ("x y", "journal of chemistry")]
    assert [r[0] for r in values(spark, rows, C.is_abbreviation(A, B))] == [True, False, False]


def test_leaks_and_matches(spark):
    assert one(spark, ["TY  - JOUR", "xTY  - JOUR", "SELECT a FROM b", "found in PubMed today", "Ovidian", "plain"], C.looks_leaked(A)) == [True, True, False, True, False, False]
    assert one(spark, ["xz", "az"], C.starts_with_match(A, "a|z")) == [False, True]
    assert one(spark, ["ab", "abc"], C.full_match(A, "ab")) == [True, False]


def test_trigrams_sum_to_one(spark):
    for v in one(spark, ["abcdef", "ab"], C.hashed_trigrams(A, 8)):
        assert abs(sum(v) - 1) < 1e-9


def test_sql_names(spark):
    C.register(spark)
    assert spark.sql("SELECT dq_is_blank(' N/A ') AS a, dq_coarse_shape('ab12') AS b").first() == (True, "AN")


def test_grams_of_a_cell_are_hashed_once(spark):
    from tablewarden.operators.encoding import lexical

    assert str(lexical(F.col("v"))).count("md5(") == 1  # twice before, and there for each of 32 places


def test_tokens_of_an_abbreviation_are_split_once(spark):
    from tablewarden.functions.cells import is_abbreviation

    assert str(is_abbreviation(F.col("a"), F.col("b"))).count("split(") == 2  # of a before for each token of b
    rows = spark.createDataFrame([("Pro Nat", "Proceedings of Nature"), ("Pro", "Proceedings"), (None, "x"), ("Pro Nat", None), ("Nat Pro", "Proceedings of Nature")], "a string, b string")
    assert [r[0] for r in rows.select(is_abbreviation(F.col("a"), F.col("b"))).collect()] in ([True, False, None, None, False], [True, False, False, None, False])


def test_a_number_is_parsed_from_one_stripped_text(spark):
    assert str(C.number_with_unit(F.col("v"))).count("btrim(") <= 1 and str(C.number_with_unit(F.col("v"))).count("lower(") == 1  # many times before
    rows = spark.createDataFrame([("1,234.5 oz",), ("1,2",), (" 7 Mins. ",), ("5e400",), ("x",), ("",), (None,), ("-.5%",)], "v string")
    got = [r[0] and tuple(r[0]) for r in rows.select(C.number_with_unit(F.col("v"))).collect()]
    assert got == [(1234.5, "ounce"), None, (7.0, "minute"), None, None, None, None, (-0.5, "percent")]
