"""Column expressions on the text of one cell. All are native, so they run inside generated code and on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that count as missing, after stripping and lower-casing (fixed values).
BLANK = ("", "empty", "null", "n/a", "na", "none", "-")
#: The wider set that feature encoders treat as missing (fixed values).
BLANK_FOR_MODELS = (*BLANK, "nan", "?", "--")
#: Placeholders that stand for a missing value (fixed values).
PLACEHOLDERS = ("?", "??", "???", "unknown", "unk", "n.a.", "n.a", "nil", "nan", "missing", "tbd", "tba", "undefined", "unspecified", "not available", "not applicable", "no value", "no data", "xx", "xxx", "xxxx", "--", "---", "...")
#: Units of measurement by the words for them (fixed values); other words stand for themselves.
UNITS = {"min": "minute", "mins": "minute", "minutes": "minute", "hr": "hour", "hrs": "hour", "hours": "hour", "%": "percent", "oz": "ounce", "ounces": "ounce"}
NUMBER = r"[-+]?\d+(?:\.\d+)?"


#: Characters of white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(v: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(v, F.lit(WHITE))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), where x is worked out once. Within a lambda function Spark works an expression out for each element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def is_blank(v: Column, values: tuple[str, ...] = BLANK) -> Column:
    return v.isNull() | F.lower(stripped(v)).isin(*values)


def is_placeholder(v: Column, values: tuple[str, ...] = PLACEHOLDERS) -> Column:
    return F.coalesce(F.lower(stripped(v)).isin(*values), F.lit(False))


def shape(v: Column) -> Column:
    """Digits as d, upper case as L, lower case as l; other characters stay."""
    marked = F.regexp_replace(v, r"\p{Nd}", "\u0001")
    marked = F.regexp_replace(F.regexp_replace(marked, r"\p{Lu}", "L"), r"\p{Ll}", "l")
    return F.regexp_replace(marked, "\u0001", "d")


def coarse_shape(v: Column) -> Column:
    """Runs of ASCII letters as A, runs of digits as N."""
    return F.regexp_replace(F.regexp_replace(v, "[A-Za-z]+", "A"), r"\d+", "N")


def digit_pattern(v: Column) -> Column:
    """Digits as 9, ASCII letters as A and a."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"\d", "9"), "[A-Z]", "A"), "[a-z]", "a")


def number(v: Column) -> Column:
    """The number of a cell that is one, with a percent sign or one word of unit after it; else null."""
    whole = rf"(?U)^\s*{NUMBER}\s*%?\s*[^\W\d_]*\s*$"
    return F.when(~is_blank(v) & v.rlike(whole), F.regexp_extract(v, NUMBER, 0).try_cast("double"))


def number_tokens(v: Column) -> Column:
    return F.regexp_count(v, F.lit(NUMBER))


def number_with_unit(v: Column) -> Column:
    """Struct of x and unit: thousands separators, exponents and a full stop at the end are read; what is no finite number is null."""
    return once(F.lower(stripped(v)), lambda text: once(F.replace(text, F.lit(","), F.lit("")), lambda plain: _parsed(text, plain)))


def _parsed(text: Column, plain: Column) -> Column:
    grouped = text.rlike(r"^[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?\s*[a-z%]*\.?\z")
    pattern = r"^([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:e[+-]?\d+)?)\s*([a-z%]*)\.?\z"
    known = F.create_map(*(F.lit(y) for pair in UNITS.items() for y in pair))
    fits = ~F.contains(text, F.lit(",")) | grouped

    def of(x: Column) -> Column:  # null where the pattern doesn't match
        unit = once(F.regexp_extract(plain, pattern, 2), lambda word: F.coalesce(F.try_element_at(known, word), word))
        return F.when(fits & (F.abs(x) < float("inf")), F.struct(x.alias("x"), unit.alias("unit")))

    return once(F.regexp_extract(plain, pattern, 1).try_cast("double"), of)


def repeated_token(v: Column, sep: str = ",") -> Column:
    """The token of a cell that only repeats it, whatever the case; else null."""
    tokens = F.filter(F.transform(F.split(v, F.lit(sep)), stripped), lambda t: t != "")
    same = F.size(F.array_distinct(F.transform(tokens, F.lower))) == 1
    return F.when((F.size(tokens) >= 2) & same, F.get(tokens, F.lit(0)))


#: A reference manager's tag, and names of literature databases (fixed values).
LEAK_TAG = r"[A-Z][A-Z0-9]\s{2,}-\s"
LEAK_SOURCES = ("PubMed", "MEDLINE", "NLM", "Ovid", "EBSCOhost", "EMBASE")


def looks_leaked(v: Column) -> Column:
    """Whether a reference manager's tag or a literature database's name is in the cell."""
    return v.rlike(LEAK_TAG) | v.rlike(rf"\b(?:{'|'.join(LEAK_SOURCES)})\b")


def is_subsequence(short: Column, long: Column) -> Column:
    """Whether the characters of short occur in long, in order."""
    return F.aggregate(F.split(long, ""), F.lit(1), lambda i, ch: F.when(F.substr(short, i, F.lit(1)) == ch, i + 1).otherwise(i)) > F.length(short)


def tokens(v: Column) -> Column:
    return F.filter(F.split(F.lower(v), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")


def is_abbreviation(short: Column, long: Column) -> Column:
    """Whether the tokens of short are prefixes of tokens of long, in order: two or more, two of them longer than a letter."""
    return once(tokens(short), lambda mine: _are_prefixes(mine, tokens(long)))


def _are_prefixes(mine: Column, theirs: Column) -> Column:
    def step(a: Column, full: Column) -> Column:
        mine_now = F.get(mine, a["k"])
        strong = (F.length(mine_now) >= 2) & full.startswith(mine_now)
        weak = (F.length(mine_now) == 1) & (F.substr(full, F.lit(1), F.lit(1)) == mine_now)
        go = F.struct((a["k"] + 1).alias("k"), (a["s"] + F.when(strong, 1).otherwise(0)).alias("s"))
        return F.when((a["k"] < F.size(mine)) & (strong | weak), go).otherwise(a)

    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("s"))
    end = F.aggregate(theirs, start, step)
    return (F.size(mine) >= 2) & once(end, lambda e: (e["k"] >= F.size(mine)) & (e["s"] >= 2))


def full_match(v: Column, pattern: str) -> Column:
    return v.rlike(rf"^(?:{pattern})\z")


def starts_with_match(v: Column, pattern: str) -> Column:
    return v.rlike(f"^(?:{pattern})")


def is_float(v: Column) -> Column:
    return stripped(v).rlike(r"^[-+]?(?:\d+(?:_\d+)*\.?(?:\d+)?|\.\d+)(?:[eE][-+]?\d+)?$")


def hashed_trigrams(v: Column, buckets: int) -> Column:
    """Share of the cell's character 3-grams in each bucket."""
    grams = F.when(F.length(v) < 3, F.array(v)).otherwise(F.transform(F.sequence(F.lit(1), F.length(v) - 2), lambda i: F.substr(v, i, F.lit(3))))
    hit = F.transform(grams, lambda g: F.crc32(g.cast("binary")) % buckets)
    return once(hit, lambda every: F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.size(F.filter(every, lambda h: h == b)) / F.size(every)))


def register(spark) -> None:
    """SQL names of the cell functions that need no parameter."""
    from pyspark.sql.types import BooleanType, StringType  # noqa: F401

    for name, body in {
        "dq_is_blank": "v IS NULL OR lower(regexp_replace(v, '(?U)^\\\\s+|\\\\s+$', '')) IN " + str(BLANK),
        "dq_coarse_shape": "regexp_replace(regexp_replace(v, '[A-Za-z]+', 'A'), '\\\\d+', 'N')",
    }.items():
        kind = "BOOLEAN" if name.startswith("dq_is") else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS {kind} RETURN {body}")
