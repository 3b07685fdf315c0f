"""Registered queries of the table operators, and DuckDB SQL with the same rows.

The tables are those of plans.dirty; `v` names a view's SQL. Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.operators import anomalies, constraints, dependencies, detectors, discovery, evaluation, fusion, models, profile, rules
from tablewarden.plans.dirty import view, view_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

CUSTOMER_COLUMNS = ["name", "nationkey", "nation", "region", "segment", "note"]
ORDER_COLUMNS = ["status", "priority", "day", "discount_percent", "low_day", "high_day", "qty", "price", "total", "year"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


#: The SQL spells its values out, so that it can't share an error of the operators.
BLANK_SQL = "('', 'empty', 'null', 'n/a', 'na', 'none', '-')"
PLACEHOLDER_SQL = "('?', '??', '???', 'unknown', 'unk', 'n.a.', 'n.a', 'nil', 'nan', 'missing', 'tbd', 'tba', 'undefined', 'unspecified', 'not available', 'not applicable', 'no value', 'no data', 'xx', 'xxx', 'xxxx', '--', '---', '...')"
LEAK_SQL = "(regexp_matches({v}, '[A-Z][A-Z0-9]\\s{{2,}}-\\s') OR regexp_matches({v}, '\\b(PubMed|MEDLINE|NLM|Ovid|EBSCOhost|EMBASE)\\b'))"
DEFAULT_TOKENS_SQL = "('unknown', 'missing', '?', 'not available', 'unspecified')"


def blank(v: str) -> str:
    return f"({v} IS NULL OR lower(regexp_replace({v}, '^\\s+|\\s+$', '', 'g')) IN {BLANK_SQL})"


def unpivoted(name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT row_id, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM {name}" for c in columns)


def paired(name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT row_id, '{a}' AS lhs, {a} AS a, '{b}' AS rhs, {b} AS b FROM {name} WHERE NOT {blank(a)} AND NOT {blank(b)}" for a in columns for b in columns if a != b)


SHAPE = r"regexp_replace(regexp_replace(regexp_replace({v}, '\d', chr(1), 'g'), '[A-Z]', 'L', 'g'), '[a-z]', 'l', 'g')"


def shape_sql(v: str) -> str:
    return f"replace({SHAPE.format(v=v)}, chr(1), 'd')"


def number_sql(v: str) -> str:
    return f"CASE WHEN NOT {blank(v)} AND regexp_full_match({v}, '\\s*[-+]?\\d+(\\.\\d+)?\\s*%?\\s*[A-Za-z]*\\s*') THEN CAST(regexp_extract({v}, '[-+]?\\d+(\\.\\d+)?') AS DOUBLE) END"


ERROR = "row_id, \"column\", value, '{kind}' AS error_type, '{rule}' AS rule, {fix} AS suggested_fix, CAST({confidence} AS DOUBLE) AS confidence, '{severity}' AS severity"


def error_sql(kind: str, rule: str, fix: str = "CAST(NULL AS VARCHAR)", confidence: str = "NULL", severity: str = "high") -> str:
    return ERROR.format(kind=kind, rule=rule, fix=fix, confidence=confidence, severity=severity)


@query(f"{view_sql('customers')}, c AS ({unpivoted('customers', CUSTOMER_COLUMNS)}) SELECT {error_sql('MV', 'missing_value')} FROM c WHERE {blank('value')}")
def missing_values(spark, sf_dir):
    return detectors.missing(view(spark, sf_dir, "customers"))


@query(f"{view_sql('customers')}, c AS ({unpivoted('customers', CUSTOMER_COLUMNS)}) SELECT {error_sql('DMV', 'placeholder', chr(39) * 2, '0.8')} FROM c WHERE lower(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) IN {PLACEHOLDER_SQL} AND NOT {blank('value')}")
def disguised_missing(spark, sf_dir):
    return detectors.disguised_missing(view(spark, sf_dir, "customers"))


_TOKENS = "list_filter(list_transform(string_split(value, ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


@query(f"{view_sql('customers')}, c AS ({unpivoted('customers', CUSTOMER_COLUMNS)}), t AS (SELECT row_id, \"column\", value, {_TOKENS} AS t FROM c) SELECT {error_sql('FI', 'duplicate_value', 't[1]', '0.9')} FROM t WHERE len(t) >= 2 AND len(list_distinct(list_transform(t, lambda x: lower(x)))) = 1")
def duplicate_tokens(spark, sf_dir):
    return detectors.repeated_values(view(spark, sf_dir, "customers"))


SEGMENTS = {s.lower(): s for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")}


@query(f"{view_sql('customers')}, t AS (SELECT row_id, 'segment' AS \"column\", segment AS value, CASE WHEN segment IN {tuple(SEGMENTS)} THEN upper(segment) ELSE regexp_replace(segment, 'X$', '') END AS fix FROM customers WHERE NOT {blank('segment')}) SELECT {error_sql('FI', 'inconsistent_representation', 'fix', '0.85')} FROM t WHERE fix <> value AND (SELECT avg(CASE WHEN fix <> value THEN 1.0 ELSE 0.0 END) FROM t) <= 0.95")
def inconsistent_representation(spark, sf_dir):
    return detectors.standardised(view(spark, sf_dir, "customers"), "segment", SEGMENTS, [("X$", "")])


@query(f"{view_sql('customers')}, m AS (SELECT quantile_cont(length(note), 0.5) AS median FROM customers), c AS (SELECT row_id, 'note' AS \"column\", note AS value FROM customers, m WHERE {LEAK_SQL.format(v='note')} AND length(note) > 3 * median) SELECT {error_sql('FI', 'metadata_leakage', chr(39) * 2, '0.8')} FROM c")
def leaked_metadata(spark, sf_dir):
    return detectors.leaked(view(spark, sf_dir, "customers"), ["note"])


@query(f"{view_sql('orders_table')}, t AS (SELECT row_id, 'discount_percent' AS \"column\", discount_percent AS value, {number_sql('discount_percent')} AS x FROM orders_table WHERE NOT {blank('discount_percent')}) SELECT {error_sql('FI', 'hard_range', confidence='0.95')} FROM t WHERE (x < 0 OR x > 100) AND (SELECT avg(CASE WHEN x IS NULL THEN 0.0 ELSE 1.0 END) FROM t) >= 0.8")
def hard_range(spark, sf_dir):
    return detectors.out_of_range(view(spark, sf_dir, "orders_table"), "discount_percent")


@query()
def abbreviation_pairs(spark, sf_dir):
    out = detectors.abbreviation_pairs(view(spark, sf_dir, "parts"), ["title", "short_title", "type", "brand"])
    return out.select("full", "short", "n", F.round("rate", 6).alias("rate"))


@query(f"{view_sql('parts')}, s AS (SELECT * FROM parts WHERE row_id % 37 = 0) SELECT row_id, 'title' AS \"column\", title AS value, 'VAD' AS error_type, 'column_swap' AS rule, short_title AS suggested_fix, CAST(0.85 AS DOUBLE) AS confidence, 'high' AS severity FROM s UNION ALL SELECT row_id, 'short_title', short_title, 'VAD', 'column_swap', title, 0.85, 'high' FROM s")
def swapped_columns(spark, sf_dir):
    return detectors.swapped(view(spark, sf_dir, "parts"), "title", "short_title")


ORDER_RULES = [
    rules.Rule("status", "value_set", {"values": ["O", "F", "P"]}, name="status_set"),
    rules.Rule("priority", "regex", {"pattern": "[1-5]-[A-Z]"}, name="priority_form"),
    rules.Rule("day", "length", {"fixed": 10}, name="day_length"),
    rules.Rule("day", "regex", {"pattern": r"\d{4}-\d{2}-\d{2}"}, name="day_form"),
    rules.Rule("discount_percent", "regex", {"pattern": r"\d+ %"}, name="discount_form"),
    rules.Rule("total", "numeric_range", {"min": 0, "max": 600}, name="total_range"),
    rules.Rule("qty", "logical_type", {"type": "int"}, name="qty_type"),
    rules.Rule("year", "numeric_range", {"max": 2100}, name="year_range"),
]
_BAD = {
    "status_set": ("status", "status NOT IN ('O','F','P')"),
    "priority_form": ("priority", "NOT regexp_matches(priority, '^[1-5]-[A-Z]')"),
    "day_length": ("day", "length(day) <> 10"),
    "day_form": ("day", "NOT regexp_matches(day, '^\\d{4}-\\d{2}-\\d{2}')"),
    "discount_form": ("discount_percent", "NOT regexp_matches(discount_percent, '^\\d+ %')"),
    "total_range": ("total", "(CAST(total AS DOUBLE) < 0 OR CAST(total AS DOUBLE) > 600)"),
    "qty_type": ("qty", "NOT regexp_full_match(qty, '[-+]?\\d+')"),
    "year_range": ("year", "CAST(year AS DOUBLE) > 2100"),
}


@query(f"{view_sql('orders_table')} " + " UNION ALL ".join(f"SELECT '{k}' AS rule, CAST(sum(CASE WHEN NOT {blank(c)} AND {t} THEN 1 ELSE 0 END) AS BIGINT) AS violations, count(*) AS rows, round(sum(CASE WHEN NOT {blank(c)} AND {t} THEN 1 ELSE 0 END) / count(*), 6) AS rate FROM orders_table" for k, (c, t) in _BAD.items()))
def rule_rates(spark, sf_dir):
    return rules.violation_rates(view(spark, sf_dir, "orders_table"), ORDER_RULES).withColumn("rate", F.round("rate", 6))


def _first_sql() -> str:
    parts = []
    for c in ORDER_COLUMNS:
        tests = "".join(f" WHEN {t} THEN '{k}'" for k, (col, t) in _BAD.items() if col == c)
        parts.append(f"SELECT row_id, '{c}' AS \"column\", {c} AS value, CASE WHEN {blank(c)} THEN 'MV' ELSE 'FI' END AS error_type, CASE WHEN {blank(c)} THEN 'missing_value'{tests} END AS rule FROM orders_table")
    return f"{view_sql('orders_table')} SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE rule IS NOT NULL"


@query(_first_sql())
def first_violations(spark, sf_dir):
    df = view(spark, sf_dir, "orders_table")
    return rules.first_violations(df, rules.gated(df, ORDER_RULES))


@query(f"""{view_sql('customers')}, c AS ({unpivoted('customers', CUSTOMER_COLUMNS)}), t AS (SELECT "column", value, {blank('value')} AS b, {number_sql('value')} AS x FROM c)
SELECT "column", count(*) AS rows, CAST(sum(CASE WHEN b THEN 1 ELSE 0 END) AS BIGINT) AS missing, round_even(avg(CASE WHEN b THEN 1.0 ELSE 0.0 END), 3) AS null_rate, count(DISTINCT CASE WHEN NOT b THEN value END) AS "distinct",
CAST(min(CASE WHEN NOT b THEN length(value) END) AS INTEGER) AS min_length, CAST(max(CASE WHEN NOT b THEN length(value) END) AS INTEGER) AS max_length, round(avg(CASE WHEN NOT b THEN CASE WHEN x IS NULL THEN 0.0 ELSE 1.0 END END), 6) AS numeric_share,
CASE WHEN avg(CASE WHEN NOT b THEN CASE WHEN x IS NULL THEN 0.0 ELSE 1.0 END END) >= 0.8 THEN min(x) END AS min, CASE WHEN avg(CASE WHEN NOT b THEN CASE WHEN x IS NULL THEN 0.0 ELSE 1.0 END END) >= 0.8 THEN max(x) END AS max, CASE WHEN avg(CASE WHEN NOT b THEN CASE WHEN x IS NULL THEN 0.0 ELSE 1.0 END END) >= 0.8 THEN round(avg(x), 2) END AS mean
FROM t GROUP BY "column" """)
def profile_columns(spark, sf_dir):
    return profile.profile(view(spark, sf_dir, "customers"))


@query(f"""{view_sql('orders_table')}, c AS ({unpivoted('orders_table', ORDER_COLUMNS)}), g AS (SELECT "column", value, count(*) AS n, min(row_id) AS f FROM c WHERE NOT {blank('value')} GROUP BY ALL)
SELECT "column", value, n FROM g QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, f) <= 8""")
def top_values(spark, sf_dir):
    return profile.top_values(view(spark, sf_dir, "orders_table"), n=8)


@query(f"""{view_sql('orders_table')}, c AS ({unpivoted('orders_table', ORDER_COLUMNS)}), g AS (SELECT "column", {shape_sql('value')} AS shape, count(*) AS n FROM c WHERE NOT {blank('value')} GROUP BY ALL), h AS (SELECT *, sum(n) OVER (PARTITION BY "column") AS total FROM g)
SELECT "column", shape, n, round(n / total, 6) AS share FROM h QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, shape) <= 5""")
def shape_histogram(spark, sf_dir):
    return profile.shapes(view(spark, sf_dir, "orders_table"))


@query(f"""{view_sql('orders_table')}, c AS ({unpivoted('orders_table', ORDER_COLUMNS)}), t AS (SELECT "column", value, {number_sql('value')} AS x, TRY_CAST(value AS DOUBLE) AS p FROM c WHERE NOT {blank('value')}),
s AS (SELECT "column", count(DISTINCT value) AS k, avg(CASE WHEN x IS NULL THEN 0.0 ELSE 1.0 END) AS share, avg(CASE WHEN p IS NULL THEN 0.0 ELSE 1.0 END) AS plain, max(CASE WHEN p <> floor(p) THEN 1 ELSE 0 END) AS fr, quantile_cont(length(value), 0.5) AS len, stddev_samp(length(value)) AS sd FROM t GROUP BY 1)
SELECT "column", CASE WHEN plain >= 0.8 AND fr = 0 AND len >= 4 AND sd <= 1 THEN 'id' WHEN share >= 0.8 THEN 'numeric' WHEN k <= 500 THEN 'categorical' ELSE 'highcard' END AS kind FROM s""")
def column_kinds(spark, sf_dir):
    return profile.kinds(view(spark, sf_dir, "orders_table"))


@query(f"""{view_sql('orders_table')}, c AS ({unpivoted('orders_table', ['status', 'priority', 'discount_percent'])}), u AS (SELECT DISTINCT "column", unnest(string_split(value, '')) AS ch FROM c WHERE value IS NOT NULL)
SELECT "column", string_agg(ch, '' ORDER BY ch) AS characters FROM u WHERE ch <> '' GROUP BY 1""")
def character_sets(spark, sf_dir):
    return profile.character_sets(view(spark, sf_dir, "orders_table"), ["status", "priority", "discount_percent"])


_FD_COLUMNS = ["nationkey", "nation", "region", "segment"]
_FD = f"""{view_sql('customers')}, p AS ({paired('customers', _FD_COLUMNS)}), g AS (SELECT lhs, rhs, a, b, count(*) AS n, min(row_id) AS f FROM p GROUP BY ALL),
m AS (SELECT lhs, rhs, a, b AS top, n AS top_n, sum(n) OVER (PARTITION BY lhs, rhs, a) AS size FROM g QUALIFY row_number() OVER (PARTITION BY lhs, rhs, a ORDER BY n DESC, f) = 1),
fd AS (SELECT lhs, rhs, sum(top_n) / sum(size) AS confidence, CAST(sum(CASE WHEN size >= 5 AND top_n / size >= 0.9 THEN size ELSE 0 END) AS BIGINT) AS support, sum(CASE WHEN size >= 5 AND top_n / size >= 0.9 THEN 1.0 ELSE 0.0 END) / nullif(sum(CASE WHEN size >= 5 THEN 1.0 ELSE 0.0 END), 0) AS pure_ratio, count(DISTINCT CASE WHEN size >= 5 AND top_n / size >= 0.9 THEN top END) AS dependents FROM m GROUP BY ALL),
ok AS (SELECT * FROM fd WHERE confidence >= 0.9 AND pure_ratio >= 0.85 AND dependents >= 2) """


@query(_FD + "SELECT lhs, rhs, round(confidence, 6) AS confidence, support, round(pure_ratio, 6) AS pure_ratio, dependents FROM ok")
def fd_discover(spark, sf_dir):
    out = dependencies.dependencies(dependencies.group_tops(view(spark, sf_dir, "customers"), _FD_COLUMNS))
    return out.select("lhs", "rhs", F.round("confidence", 6).alias("confidence"), "support", F.round("pure_ratio", 6).alias("pure_ratio"), "dependents")


@query(_FD + "SELECT p.row_id, p.rhs AS \"column\", p.b AS value, 'VAD' AS error_type, concat('fd:', p.lhs, '->', p.rhs) AS rule, m.top AS suggested_fix, round(m.top_n / m.size, 3) AS confidence, 'high' AS severity FROM p JOIN m USING (lhs, rhs, a) JOIN ok USING (lhs, rhs) WHERE m.size >= 5 AND m.top_n / m.size >= 0.9 AND p.b <> m.top")
def fd_violations(spark, sf_dir):
    return dependencies.dependency_violations(view(spark, sf_dir, "customers"), _FD_COLUMNS)


@query()
def fd_stability(spark, sf_dir):
    return dependencies.stability(view(spark, sf_dir, "customers"), "nationkey", "nation")


def _conditional_sql(columns: list[str], conditions: list[str], gain: float, confidence: float, min_support: int = 30, top: int = 10) -> str:
    scoped = " UNION ALL ".join(f"SELECT '{c}' AS \"on\", {c} AS \"is\", row_id AS r FROM customers WHERE NOT {blank(c)}" for c in conditions)
    tops = lambda keys: f"SELECT {keys}, a, max(n) AS top_n, sum(n) AS size, arg_max(b, {{'n': n, 'f': -f}}) AS top FROM (SELECT {keys}, a, b, count(*) AS n, min(row_id) AS f FROM j GROUP BY ALL) GROUP BY ALL"
    return f"""{view_sql('customers')}, p AS ({paired('customers', columns)}), c AS ({scoped}), u AS (SELECT "on", "is" FROM c GROUP BY "on", "is" HAVING count(*) >= {min_support} QUALIFY row_number() OVER (PARTITION BY "on" ORDER BY count(*) DESC, "is") <= {top}),
j AS (SELECT * FROM c JOIN u USING ("on", "is") JOIN p ON r = p.row_id WHERE "on" <> lhs AND "on" <> rhs), g AS ({tops('"on", "is", lhs, rhs')}),
l AS (SELECT "on", "is", lhs, rhs, sum(top_n) / sum(size) AS confidence, CAST(sum(CASE WHEN size >= 5 AND top_n / size >= {confidence} THEN size ELSE 0 END) AS BIGINT) AS support, count(DISTINCT CASE WHEN size >= 5 AND top_n / size >= {confidence} THEN top END) AS dependents FROM g GROUP BY ALL),
o AS (SELECT lhs, rhs, sum(top_n) / sum(size) AS overall FROM (SELECT lhs, rhs, a, max(n) AS top_n, sum(n) AS size FROM (SELECT lhs, rhs, a, b, count(*) AS n FROM p GROUP BY ALL) GROUP BY ALL) GROUP BY ALL)
SELECT "on", "is", lhs, rhs, round(confidence, 6) AS confidence, round(overall, 6) AS overall, support FROM l JOIN o USING (lhs, rhs) WHERE confidence >= {confidence} AND dependents >= 2 AND confidence - overall >= {gain}"""


@query(_conditional_sql(["nationkey", "nation", "region"], ["segment", "note"], 0.001, 0.9))
def cfd_variable(spark, sf_dir):
    out = dependencies.conditional(view(spark, sf_dir, "customers"), ["nationkey", "nation", "region"], ["segment", "note"], gain=0.001, confidence=0.9)
    return out.select("on", "is", "lhs", "rhs", F.round("confidence", 6).alias("confidence"), F.round("overall", 6).alias("overall"), "support")


_CFD = f"""{view_sql('customers')}, l AS (SELECT row_id, 'nation' AS "on", nation AS "is", region AS value FROM customers WHERE NOT {blank('region')} UNION ALL SELECT row_id, 'nationkey', nationkey, region FROM customers WHERE NOT {blank('region')}),
g AS (SELECT "on", "is", value, count(*) AS n, min(row_id) AS f FROM l WHERE NOT {blank('"is"')} GROUP BY ALL), m AS (SELECT "on", "is", value AS top, n AS top_n, sum(n) OVER (PARTITION BY "on", "is") AS size FROM g QUALIFY row_number() OVER (PARTITION BY "on", "is" ORDER BY n DESC, f) = 1),
t AS (SELECT region AS top, count(*) / (SELECT count(*) FROM customers WHERE NOT {blank('region')}) AS overall FROM customers WHERE NOT {blank('region')} GROUP BY 1), k AS (SELECT m.* FROM m JOIN t USING (top) WHERE size >= 20 AND top_n / size >= 0.9 AND overall < 0.85) """


@query(_CFD + "SELECT l.row_id, 'region' AS \"column\", l.value, 'VAD' AS error_type, concat('cfd:(', l.\"on\", '=', l.\"is\", ')->region=', k.top) AS rule, k.top AS suggested_fix, round(top_n / size, 3) AS confidence, 'high' AS severity FROM l JOIN k USING (\"on\", \"is\") WHERE l.value <> k.top")
def cfd_constant(spark, sf_dir):
    return dependencies.constant_violations(view(spark, sf_dir, "customers"), ["nation", "nationkey"], ["region"], min_support=20, share=0.9)


@query(f"{view_sql('orders_table')}, t AS (SELECT row_id, low_day, high_day FROM orders_table WHERE CAST(low_day AS DOUBLE) > CAST(high_day AS DOUBLE)) SELECT row_id, 'low_day' AS \"column\", low_day AS value, 'FI' AS error_type, 'dc:low_day<=high_day' AS rule FROM t UNION ALL SELECT row_id, 'high_day', high_day, 'FI', 'dc:low_day<=high_day' FROM t")
def dc_compare(spark, sf_dir):
    return dependencies.compare(view(spark, sf_dir, "orders_table"), "low_day", "high_day")


@query(f"{view_sql('orders_table')} SELECT row_id, 'year' AS \"column\", year AS value, 'FI' AS error_type, 'dc:year' AS rule FROM orders_table WHERE CAST(year AS INTEGER) < 1800 OR CAST(year AS INTEGER) > 2026")
def dc_temporal(spark, sf_dir):
    return dependencies.impossible_years(view(spark, sf_dir, "orders_table"), "year", 2025)


@query(f"""{view_sql('events_table')}, t AS (SELECT row_id, CAST(counter AS DOUBLE) AS m, lag(counter) OVER (ORDER BY row_id) AS p, lead(counter) OVER (ORDER BY row_id) AS x FROM events_table), s AS (SELECT quantile_cont(abs(m - p), 0.5) AS step FROM t WHERE p IS NOT NULL AND m <> p)
SELECT row_id, 'counter' AS "column", m AS value, 'VAD' AS error_type, 'dc:order:row_id' AS rule FROM t, s WHERE ((m > p AND m > x) OR (m < p AND m < x)) AND least(abs(m - p), abs(m - x)) >= 3 * step""")
def dc_order(spark, sf_dir):
    return dependencies.order_breaks(view(spark, sf_dir, "events_table"), "row_id", "counter")


@query(f"{view_sql('orders_table')} SELECT row_id, 'total' AS \"column\", total AS value, 'FI' AS error_type, 'dc:total=qty * price' AS rule FROM orders_table WHERE abs(CAST(qty AS DOUBLE) * CAST(price AS DOUBLE) - CAST(total AS DOUBLE)) > 1e-6")
def dc_arithmetic(spark, sf_dir):
    return dependencies.arithmetic_violations(view(spark, sf_dir, "orders_table"), "qty * price", "total")


_YEARS = " UNION ALL ".join(f"SELECT 'year' AS kind, '{c}' AS \"column\", CAST(NULL AS VARCHAR) AS other FROM (SELECT {number_sql(c)} AS x FROM orders_table) HAVING count(x) >= 30 AND ('{c}' LIKE '%year%' OR (avg(CASE WHEN x = floor(x) THEN 1.0 WHEN x IS NOT NULL THEN 0.0 END) > 0.95 AND avg(CASE WHEN x BETWEEN 1000 AND 2100 THEN 1.0 WHEN x IS NOT NULL THEN 0.0 END) > 0.9))" for c in ORDER_COLUMNS)


@query(f"{view_sql('orders_table')} SELECT 'compare' AS kind, 'low_day' AS \"column\", 'high_day' AS other UNION ALL SELECT 'date', unnest(['day', 'low_day', 'high_day', 'year']), NULL UNION ALL {_YEARS}")
def discovered_columns(spark, sf_dir):
    """The columns of the orders that hold years or dates, and the pairs to compare."""
    df = view(spark, sf_dir, "orders_table")
    rows = [("compare", a, b) for a, b in discovery.compare_pairs(ORDER_COLUMNS)] + [("year", c, None) for c in discovery.year_columns(df, ORDER_COLUMNS)] + [("date", c, None) for c in discovery.date_columns(df, ORDER_COLUMNS)]
    return spark.createDataFrame(rows, "kind string, column string, other string")


@query(_FD + "SELECT lhs, rhs, CASE WHEN support >= 50 AND confidence >= 0.95 THEN 'high' ELSE 'medium' END AS severity FROM ok WHERE support >= 10 AND confidence >= 0.8")
def graded_dependencies(spark, sf_dir):
    """Severity of each dependency. The SQL leaves out stability, which is 1 where the confidence is well above its gate."""
    return spark.createDataFrame(dependencies.graded(view(spark, sf_dir, "customers"), _FD_COLUMNS), "lhs string, rhs string, severity string")


def _region_findings(spark, sf_dir) -> DataFrame:
    df = view(spark, sf_dir, "customers")
    fd = dependencies.dependency_violations(df, _FD_COLUMNS).withColumn("place", F.lit(1))
    cfd = dependencies.constant_violations(df, ["nation", "nationkey"], ["region"], min_support=20, share=0.9).withColumn("place", F.lit(2))
    return fd.unionByName(cfd).withColumn("place", F.concat_ws("|", "place", "rule"))


_FD_ROWS = ORACLE_SQL["fd_violations"]
_CFD_ROWS = ORACLE_SQL["cfd_constant"]


@query(f"""WITH e AS (SELECT *, concat('1|', rule) AS place, 1 AS family FROM ({_FD_ROWS}) UNION ALL SELECT *, concat('2|', rule), 3 FROM ({_CFD_ROWS})), r AS (SELECT *, row_number() OVER w AS nth, lead(confidence) OVER w AS next_confidence, lead(family) OVER w AS next_family FROM e WINDOW w AS (PARTITION BY row_id, "column" ORDER BY confidence DESC, family DESC, place)),
k AS (SELECT row_id, "column", count(DISTINCT suggested_fix) AS fixes FROM e GROUP BY ALL) SELECT row_id, "column", value, error_type, rule, suggested_fix, confidence, CASE WHEN fixes >= 2 AND confidence = next_confidence AND family = next_family THEN 'medium' ELSE 'high' END AS severity FROM r JOIN k USING (row_id, "column") WHERE nth = 1""")
def rule_conflicts(spark, sf_dir):
    return dependencies.resolve_conflicts(_region_findings(spark, sf_dir))


def _customer_findings(spark, sf_dir) -> DataFrame:
    df = view(spark, sf_dir, "customers")
    return detectors.first_of_each_cell([detectors.missing(df), detectors.disguised_missing(df), detectors.standardised(df, "segment", SEGMENTS, [("X$", "")]), detectors.leaked(df, ["note"]), detectors.repeated_values(df), dependencies.dependency_violations(df, _FD_COLUMNS)])


_CHAIN = f"""{_FD}, c AS ({unpivoted('customers', CUSTOMER_COLUMNS)}), tk AS (SELECT row_id, "column", value, {_TOKENS} AS t FROM c), st AS (SELECT row_id, segment AS value, CASE WHEN segment IN {tuple(SEGMENTS)} THEN upper(segment) ELSE regexp_replace(segment, 'X$', '') END AS fix FROM customers WHERE NOT {blank('segment')}),
e AS (SELECT 0 AS place, row_id, "column", value, 'MV' AS error_type, 'missing_value' AS rule, CAST(NULL AS VARCHAR) AS suggested_fix, CAST(NULL AS DOUBLE) AS confidence FROM c WHERE {blank('value')}
UNION ALL SELECT 1, row_id, "column", value, 'DMV', 'placeholder', '', 0.8 FROM c WHERE lower(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) IN {PLACEHOLDER_SQL} AND NOT {blank('value')}
UNION ALL SELECT 2, row_id, 'segment', value, 'FI', 'inconsistent_representation', fix, 0.85 FROM st WHERE fix <> value
UNION ALL SELECT 3, row_id, "column", value, 'FI', 'metadata_leakage', '', 0.8 FROM c WHERE "column" = 'note' AND {LEAK_SQL.format(v='value')} AND length(value) > 3 * (SELECT quantile_cont(length(note), 0.5) FROM customers)
UNION ALL SELECT 4, row_id, "column", value, 'FI', 'duplicate_value', t[1], 0.9 FROM tk WHERE len(t) >= 2 AND len(list_distinct(list_transform(t, lambda x: lower(x)))) = 1
UNION ALL SELECT 5, p.row_id, p.rhs, p.b, 'VAD', concat('fd:', p.lhs, '->', p.rhs), m.top, round(m.top_n / m.size, 3) FROM p JOIN m USING (lhs, rhs, a) JOIN ok USING (lhs, rhs) WHERE m.size >= 5 AND m.top_n / m.size >= 0.9 AND p.b <> m.top),
f AS (SELECT row_id, "column", value, error_type, rule, suggested_fix, confidence, 'high' AS severity FROM e QUALIFY row_number() OVER (PARTITION BY row_id, "column" ORDER BY place, rule, coalesce(suggested_fix, '')) = 1) """


@query(_CHAIN + "SELECT * FROM f")
def priority_findings(spark, sf_dir):
    return _customer_findings(spark, sf_dir)


@query(_CHAIN + "SELECT c.row_id, " + ", ".join(f"NOT bool_or(c.\"column\" = '{c}' AND f.row_id IS NOT NULL) AS {c}" for c in CUSTOMER_COLUMNS) + " FROM c LEFT JOIN f USING (row_id, \"column\") GROUP BY c.row_id")
def clean_mask(spark, sf_dir):
    return detectors.clean_mask(view(spark, sf_dir, "customers"), _customer_findings(spark, sf_dir))


_STAT = """, q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, stddev_pop(x) AS sd, count(*) AS n FROM t WHERE x IS NOT NULL), r AS (SELECT quantile_cont(abs(x - median), 0.5) AS raw FROM t, q WHERE x IS NOT NULL),
s AS (SELECT q.*, CASE WHEN raw > 0 THEN 1.4826 * raw WHEN sd > 0 THEN sd ELSE greatest(q3 - q1, 1.0) END AS mad FROM q, r) """
_EVENT_STAT = f"{view_sql('events_table')}, t AS (SELECT row_id, value, value AS x FROM events_table){_STAT}"


@query(_EVENT_STAT + "SELECT round(median, 6) AS median, round(mad, 6) AS mad, round(q1, 6) AS q1, round(q3, 6) AS q3, n FROM s")
def robust_stats(spark, sf_dir):
    out = anomalies.robust_stats(view(spark, sf_dir, "events_table"), "value")
    return out.select(*(F.round(c, 6).alias(c) for c in ("median", "mad", "q1", "q3")), "n")


def _outlier_sql(z: float, k: float) -> str:
    return f"SELECT row_id, round(abs(x - median) / mad, 6) AS score, round(median, 6) AS fix FROM t, s WHERE abs(x - median) / mad > {z} OR x < q1 - {k} * (q3 - q1) OR x > q3 + {k} * (q3 - q1)"


@query(_EVENT_STAT + _outlier_sql(3.0, 1.5))
def robust_outliers(spark, sf_dir):
    return anomalies.outliers(view(spark, sf_dir, "events_table"), "value").select("row_id", "score", F.col("suggested_fix").cast("double").alias("fix"))


_CLEAN_EVENTS = f"""{ORACLE_SQL['dc_order'].split("SELECT row_id, 'counter'")[0].replace("t AS (", "od AS (").replace("FROM t ", "FROM od ").replace("s AS (", "os AS (").rstrip()}, dirty AS (SELECT row_id FROM od, os WHERE ((m > p AND m > x) OR (m < p AND m < x)) AND least(abs(m - p), abs(m - x)) >= 3 * step)"""


@query(f"{_CLEAN_EVENTS}, t AS (SELECT row_id, value, value AS x FROM events_table WHERE row_id NOT IN (SELECT row_id FROM dirty)){_STAT}, u AS (SELECT row_id, value AS x FROM events_table) " + _outlier_sql(6.0, 4.5).replace("FROM t, s", "FROM u, s"))
def extreme_outliers(spark, sf_dir):
    df = view(spark, sf_dir, "events_table")
    clean = df.join(dependencies.order_breaks(df, "row_id", "counter"), "row_id", "left_anti")
    return anomalies.outliers(df, "value", clean, 6.0, 4.5).select("row_id", "score", F.col("suggested_fix").cast("double").alias("fix"))


@query(f"""{view_sql('parts')}, t AS (SELECT row_id, CAST(split_part(measure, ' ', 1) AS DOUBLE) AS x, CASE split_part(measure, ' ', 2) WHEN 'oz' THEN 'ounce' ELSE 'minute' END AS unit FROM parts), q AS (SELECT unit, quantile_cont(x, 0.5) AS median, stddev_pop(x) AS sd, count(*) AS n FROM t GROUP BY 1),
s AS (SELECT q.unit, median, greatest(1.4826 * quantile_cont(abs(x - median), 0.5), 0.1 * any_value(sd), 1e-6) AS mad FROM t JOIN q USING (unit) GROUP BY q.unit, median) SELECT row_id, round(abs(x - median) / mad, 6) AS score FROM t JOIN s USING (unit) WHERE abs(x - median) / mad > 1.2""")
def unit_outliers(spark, sf_dir):
    return anomalies.unit_outliers(view(spark, sf_dir, "parts"), "measure", z=1.2).select("row_id", "score")


_TYPES = f"{view_sql('parts')}, v AS (SELECT type AS value, count(*) AS n FROM parts WHERE NOT {blank('type')} GROUP BY 1) "


@query(_TYPES + "SELECT r.value AS rare, r.n, a.value AS anchor, a.n AS anchor_n FROM v r, v a WHERE r.n <= 5 AND a.n >= 20 AND levenshtein(r.value, a.value) = 1")
def edit_neighbours(spark, sf_dir):
    return anomalies.edit_neighbours(anomalies.value_counts(view(spark, sf_dir, "parts"), "type"), 5, 20)


@query(_TYPES + """, e AS (SELECT r.value AS rare, r.n, a.value AS anchor, a.n AS anchor_n FROM v r, v a WHERE r.n <= 2 AND a.n >= 3 AND a.n >= 2 * r.n AND length(a.value) >= 2 AND levenshtein(r.value, a.value) = 1), one AS (SELECT rare, any_value(anchor) AS anchor, any_value(anchor_n / n) AS ratio FROM e GROUP BY 1 HAVING count(*) = 1),
c AS (SELECT row_id, rare, anchor, ratio, row_number() OVER (ORDER BY ratio DESC, row_id) AS nth FROM parts JOIN one ON type = rare) SELECT row_id, 'type' AS "column", rare AS value, anchor AS suggested_fix, round(ratio, 6) AS ratio FROM c WHERE nth <= floor(0.05 * (SELECT sum(n) FROM v))""")
def vocabulary_noise(spark, sf_dir):
    return anomalies.vocabulary_noise(view(spark, sf_dir, "parts"), "type", ratio=2)


def _ratio_sql(a: str, b: str) -> str:
    """Twice the longest common subsequence over both lengths; the subsequence by the bits of one integer."""
    full = f"((CAST(1 AS HUGEINT) << length({a})) - 1)"
    masks = f"list_transform(string_split({b}, ''), lambda ch: CAST(list_sum(list_transform(range(length({a})), lambda i: CASE WHEN substr({a}, CAST(i AS INTEGER) + 1, 1) = ch THEN CAST(1 AS HUGEINT) << CAST(i AS INTEGER) ELSE CAST(0 AS HUGEINT) END)) AS HUGEINT))"
    return f"(2 * (length({a}) - bit_count(list_reduce({masks}, lambda s, x: ((s + (s & x)) | (s - (s & x))) & {full}, {full}))) / (length({a}) + length({b})))"


@query(f"""{view_sql('parts')}, v AS (SELECT type AS value, count(*) AS n, min(row_id) AS f FROM parts WHERE NOT {blank('type')} GROUP BY 1), p AS (SELECT a.value AS a, b.value AS b, b.f, {_ratio_sql('a.value', 'b.value')} AS ratio FROM v a JOIN v b ON a.n < 3 AND b.n >= 3 WHERE 2 * least(length(a.value), length(b.value)) >= 0.85 * (length(a.value) + length(b.value))),
t AS (SELECT a, b, ratio FROM p WHERE ratio >= 0.85 QUALIFY row_number() OVER (PARTITION BY a ORDER BY ratio DESC, f) = 1)
SELECT row_id, 'type' AS "column", type AS value, 'categorical_typo' AS detector, 'T' AS error_type, round(ratio, 6) AS score, b AS suggested_fix FROM parts JOIN t ON type = a WHERE (SELECT count(*) FROM v) <= 1000""")
def typo_candidates(spark, sf_dir):
    return anomalies.typos(view(spark, sf_dir, "parts"), "type")


_TYPE_SHAPES = f"{view_sql('parts')}, t AS (SELECT row_id, type AS value, {shape_sql('type')} AS shape FROM parts WHERE NOT {blank('type')}), n AS (SELECT value, count(*) AS n FROM t GROUP BY 1), s AS (SELECT shape, count(*) AS k FROM t GROUP BY 1) "


@query(_TYPE_SHAPES + "SELECT row_id, 'type' AS \"column\", value, 'format_cluster' AS detector, 'FI' AS error_type, round(1 - k / (SELECT count(*) FROM t), 6) AS score, CAST(NULL AS VARCHAR) AS suggested_fix FROM t JOIN n USING (value) JOIN s USING (shape) WHERE n <= 10 AND k / (SELECT count(*) FROM t) < 0.02")
def format_cluster(spark, sf_dir):
    return anomalies.rare_formats(view(spark, sf_dir, "parts"), "type", rare_most=10)


_DAYS = f"{view_sql('orders_table')}, t AS (SELECT row_id, day AS value, {shape_sql('day')} AS shape FROM orders_table WHERE NOT {blank('day')}), s AS (SELECT shape, count(*) AS n FROM t GROUP BY 1) "


@query(_DAYS + "SELECT row_id, 'day' AS \"column\", value, 'pattern_outlier' AS detector, 'FI' AS error_type, CAST(0.85 AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS suggested_fix FROM t WHERE shape = 'dddd-dd-dd' AND try_strptime(value, '%Y-%m-%d') IS NULL")
def pattern_outlier(spark, sf_dir):
    return anomalies.odd_patterns(view(spark, sf_dir, "orders_table"), "day", dates=True)


#: The cells (so) of a second frequent format (sg: all formats, st: the first one).
_SECONDARY = f"""sf AS (SELECT row_id, day, regexp_replace(regexp_replace(day, '[A-Za-z]+', 'A', 'g'), '\\d+', 'N', 'g') AS shape FROM orders_table WHERE NOT {blank('day')}), sg AS (SELECT shape, count(*) AS n, sum(count(*)) OVER () AS total FROM sf GROUP BY 1), st AS (SELECT * FROM sg QUALIFY row_number() OVER (ORDER BY n DESC, shape DESC) = 1),
so AS (SELECT row_id, day FROM sf WHERE shape IN (SELECT a.shape FROM sg a, st b WHERE b.n >= 0.6 * b.total AND a.shape <> b.shape AND a.n >= 20 AND a.n >= 0.02 * a.total AND a.n <= 0.4 * a.total AND NOT regexp_matches(b.shape, array_to_string(list_transform(string_split(a.shape, ''), lambda x: regexp_escape(x)), '.*'))))"""


@query(f"{view_sql('orders_table')}, {_SECONDARY} SELECT row_id, 'day' AS \"column\", day AS value, 'secondary_format' AS detector, 'FI' AS error_type, CAST(0.6 AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS suggested_fix FROM so")
def secondary_format(spark, sf_dir):
    return anomalies.secondary_formats(view(spark, sf_dir, "orders_table"), "day")


@query(f"{view_sql('orders_table')} SELECT row_id, 'discount_percent' AS \"column\", discount_percent AS value, 'numeric_format' AS detector, 'FI' AS error_type, CAST(0.9 AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS suggested_fix FROM orders_table WHERE len(regexp_extract_all(discount_percent, '[-+]?\\d+(\\.\\d+)?')) <> 1")
def numeric_arity(spark, sf_dir):
    return anomalies.odd_number_counts(view(spark, sf_dir, "orders_table"), "discount_percent")


@query(f"{view_sql('events_table')}, v AS (SELECT first_seen AS value, count(*) AS n, sum(count(*)) OVER () AS total FROM events_table GROUP BY 1) SELECT row_id, 'first_seen' AS \"column\", value, 'value_burst' AS detector, 'VAD' AS error_type, round(least(n / total / 0.03, 1.0), 6) AS score, CAST(NULL AS VARCHAR) AS suggested_fix FROM (SELECT row_id, first_seen AS value FROM events_table) JOIN v USING (value) WHERE n >= 15 AND n / total >= 0.03")
def value_burst(spark, sf_dir):
    return anomalies.bursts(view(spark, sf_dir, "events_table"), "first_seen", dates=True)


def _near(spark, sf_dir) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return anomalies.nearest(vectors, vectors.where("vec_id % 20 = 0"), 5)


_KNN = "WITH d AS (SELECT q.vec_id AS query_id, q.label AS own, v.vec_id, v.label, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 5) "


@query(_KNN + "SELECT query_id, vec_id, round(distance, 6) AS distance FROM k")
def nearest_neighbours(spark, sf_dir):
    return _near(spark, sf_dir).select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


@query(_KNN + ", v AS (SELECT query_id, own, label, count(*) AS n FROM k GROUP BY ALL), b AS (SELECT *, sum(n) OVER (PARTITION BY query_id) AS total FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1) SELECT query_id, own, label AS majority, round(n / total, 6) AS share FROM b WHERE n / total >= 0.4 AND own <> label")
def neighbour_disagreement(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    return anomalies.neighbour_disagreement(_near(spark, sf_dir), labels, 0.4)


def _evidence(spark, sf_dir) -> DataFrame:
    orders = view(spark, sf_dir, "orders_table")
    parts = [anomalies.odd_patterns(orders, "day", dates=True), anomalies.secondary_formats(orders, "day"), anomalies.odd_number_counts(orders, "discount_percent")]
    out = fusion.as_evidence(detectors.out_of_range(orders, "discount_percent")).unionByName(fusion.as_evidence(detectors.missing(orders)))
    for p in parts:
        out = out.unionByName(p.select(*out.columns))
    return out


_EVIDENCE = f"""{view_sql('orders_table')}, {_SECONDARY}, e AS (SELECT row_id, 'day' AS "column", day AS value, 'pattern_outlier' AS detector, 'FI' AS error_type, 0.85 * 0.6 AS w FROM orders_table WHERE {shape_sql('day')} = 'dddd-dd-dd' AND try_strptime(day, '%Y-%m-%d') IS NULL
UNION ALL SELECT row_id, 'day', day, 'secondary_format', 'FI', 0.6 * 0.5 FROM so
UNION ALL SELECT row_id, 'discount_percent', discount_percent, 'numeric_format', 'FI', 0.9 * 0.85 FROM orders_table WHERE len(regexp_extract_all(discount_percent, '[-+]?\\d+(\\.\\d+)?')) <> 1
UNION ALL SELECT row_id, 'discount_percent', discount_percent, 'strong_rule', 'FI', 0.95 FROM orders_table WHERE {number_sql('discount_percent')} > 100
UNION ALL SELECT row_id, "column", value, 'strong_rule', 'MV', 0.9 FROM ({unpivoted('orders_table', ORDER_COLUMNS)}) WHERE {blank('value')}) """


@query(_EVIDENCE + "SELECT row_id, \"column\", max(value) AS value, arg_max(error_type, w) AS error_type, CAST(NULL AS VARCHAR) AS suggested_fix, string_agg(detector, ',' ORDER BY detector) AS detectors, count(DISTINCT CASE detector WHEN 'strong_rule' THEN 'rule' WHEN 'numeric_format' THEN 'format' ELSE 'pattern' END) AS family_count, round(1 - product(1 - w), 6) AS suspicion, CASE WHEN round(1 - product(1 - w), 6) >= 0.85 THEN 'high' WHEN round(1 - product(1 - w), 6) >= 0.6 THEN 'mid' ELSE 'low' END AS tier FROM e GROUP BY row_id, \"column\"")
def fused_evidence(spark, sf_dir):
    return fusion.fused(fusion.normalised(_evidence(spark, sf_dir)))


@query(f"""{view_sql('events_table')}, t AS (SELECT row_id, value, value AS x FROM events_table){_STAT}, o AS (SELECT row_id, round(abs(x - median) / mad, 6) AS score FROM t, s WHERE abs(x - median) / mad > 3 OR x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) SELECT row_id, round(row_number() OVER (ORDER BY score, row_id) / count(*) OVER (), 6) AS score FROM o""")
def soft_score_ranks(spark, sf_dir):
    out = fusion.normalised(anomalies.outliers(view(spark, sf_dir, "events_table"), "value"))
    return out.select("row_id", F.round("score", 6).alias("score"))


@query(f"{view_sql('customers')}, k AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT CASE WHEN NOT {blank(c)} THEN {c} END) AS groups, count(*) AS rows FROM customers" for c in CUSTOMER_COLUMNS) + ") SELECT * FROM k WHERE groups >= 2 AND rows >= 3 * groups")
def key_columns(spark, sf_dir):
    return fusion.key_columns(view(spark, sf_dir, "customers"), CUSTOMER_COLUMNS)


@query(f"""{view_sql('customers')}, p AS (SELECT DISTINCT * FROM ({paired('customers', ['nationkey', 'segment', 'nation', 'region'])}) WHERE lhs IN ('nationkey', 'segment') AND rhs IN ('nation', 'region')),
g AS (SELECT lhs, rhs, a, max(n) AS top_n, sum(n) AS size FROM (SELECT lhs, rhs, a, b, count(*) AS n FROM p GROUP BY ALL) GROUP BY ALL HAVING sum(n) >= 3), d AS (SELECT lhs, rhs, sum(top_n) / sum(size) AS dominance, count(*) AS groups FROM g GROUP BY ALL),
o AS (SELECT rhs, max(n) / sum(n) AS share, count(*) AS n_values FROM (SELECT rhs, b, count(*) AS n FROM (SELECT DISTINCT row_id, rhs, b FROM p) GROUP BY ALL) GROUP BY 1)
SELECT rhs AS "column", lhs AS key, round(dominance, 6) AS dominance, groups FROM d JOIN o USING (rhs) WHERE dominance >= 0.5 AND dominance - share >= 0.15 AND groups <= n_values QUALIFY row_number() OVER (PARTITION BY rhs ORDER BY groups, dominance DESC, lhs) = 1""")
def consensus_keys(spark, sf_dir):
    return fusion.consensus_keys(view(spark, sf_dir, "customers"), ["nation", "region"], ["nationkey", "segment"])


_CONSENSUS = f"""{view_sql('customers')}, t AS (SELECT row_id, nationkey AS k, nation AS value FROM customers WHERE NOT {blank('nation')} AND NOT {blank('nationkey')}), g AS (SELECT k, value, count(*) AS n, min(row_id) AS f FROM t GROUP BY ALL), m AS (SELECT k, value AS top, n AS top_n, sum(n) OVER (PARTITION BY k) AS size FROM g QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, f) = 1),
x AS (SELECT row_id, 'nation' AS "column", t.value, top AS majority, round(top_n / size, 6) AS majority_share, round(n / size, 6) AS own_share, CAST(size AS BIGINT) AS group_size FROM t JOIN g USING (k, value) JOIN m USING (k) WHERE size >= 3 AND t.value <> top AND top_n / size >= 0.4 AND n / size < 0.5) """


@query(_CONSENSUS + "SELECT * FROM x")
def consensus_conflicts(spark, sf_dir):
    return fusion.consensus_conflicts(view(spark, sf_dir, "customers"), "nation", "nationkey")


def _judged(spark, sf_dir) -> DataFrame:
    df = view(spark, sf_dir, "customers")
    cells = fusion.fused(fusion.normalised(fusion.as_evidence(_customer_findings(spark, sf_dir))))
    # stands for an arbiter: it rejects the cells of every seventh row, more and less surely
    said = cells.where("row_id % 7 = 0").select("row_id", "column", F.lit(False).alias("is_error"), F.when(F.col("row_id") % 2 == 0, 0.99).otherwise(0.9).alias("confidence"), F.lit(None).cast("string").alias("fix"))
    return fusion.judged(cells, said, fusion.consensus_conflicts(df, "nation", "nationkey"))


@query(_CHAIN + f""", {_CONSENSUS[len(view_sql('customers')) + 2 :].replace("t AS (", "ct AS (").replace("FROM t ", "FROM ct ").replace(", m AS (", ", cm AS (").replace("JOIN m ", "JOIN cm ").replace("g AS (", "cg AS (").replace("FROM g ", "FROM cg ").replace("JOIN g ", "JOIN cg ").replace("t.value", "ct.value")}
SELECT f.row_id, f."column", f.value, CASE WHEN error_type IN ('MV', 'DMV') OR f.row_id % 7 <> 0 THEN true WHEN x.majority IS NOT NULL THEN CASE WHEN f.row_id % 2 = 0 THEN 0.99 ELSE 0.9 END < CASE WHEN own_share >= 0.3 OR group_size > 100 THEN 0.85 ELSE 0.98 END ELSE false END AS is_error, error_type,
CAST(CASE WHEN error_type IN ('MV', 'DMV') THEN 0.95 WHEN f.row_id % 7 <> 0 THEN 0.5 WHEN f.row_id % 2 = 0 THEN 0.99 ELSE 0.9 END AS DOUBLE) AS confidence, coalesce(x.majority, suggested_fix) AS suggested_fix FROM f LEFT JOIN x USING (row_id, "column")""")
def judgments(spark, sf_dir):
    return _judged(spark, sf_dir)


_JUDGED = ORACLE_SQL["judgments"]


@query(f"""WITH j AS ({_JUDGED}), b AS (SELECT "column" AS c, value AS v, suggested_fix AS fix FROM j WHERE is_error AND suggested_fix <> '' QUALIFY row_number() OVER (PARTITION BY "column", value ORDER BY confidence DESC, suggested_fix DESC) = 1)
SELECT row_id, "column", value, is_error, error_type, confidence, CASE WHEN is_error THEN coalesce(nullif(suggested_fix, ''), fix) ELSE suggested_fix END AS suggested_fix FROM j LEFT JOIN b ON "column" = c AND value IS NOT DISTINCT FROM v""")
def fix_propagation(spark, sf_dir):
    return fusion.propagated_fixes(_judged(spark, sf_dir))


@query()
def row_contexts(spark, sf_dir):
    return fusion.row_contexts(view(spark, sf_dir, "orders_table"), fusion.fused(fusion.normalised(_evidence(spark, sf_dir))))


@query(f"""WITH j AS ({_JUDGED}), d AS (SELECT DISTINCT row_id, "column" FROM ({_CHAIN} SELECT * FROM f)), w AS (SELECT row_id, "column" FROM j WHERE is_error AND confidence >= 0.6 QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY confidence DESC, row_id) <= floor(0.05 * (SELECT count(*) FROM customer)))
SELECT row_id, "column" FROM d WHERE (row_id, "column") NOT IN (SELECT (row_id, "column") FROM j WHERE NOT is_error AND confidence >= 0.6 AND error_type NOT IN ('MV', 'DMV')) UNION SELECT * FROM w""")
def refined_mask(spark, sf_dir):
    df = view(spark, sf_dir, "customers")
    return fusion.refined_dirty(detectors.dirty_cells(_customer_findings(spark, sf_dir)), _judged(spark, sf_dir), df.count())


_TRUTH = ", w AS (" + " UNION ALL ".join(f"SELECT d.row_id, '{c}' AS \"column\", d.{c} AS value, k.{c} AS truth FROM customers d JOIN clean_customers k USING (row_id) WHERE CASE WHEN {blank('d.' + c)} THEN '' ELSE regexp_replace(d.{c}, '^\\s+|\\s+$', '', 'g') END <> k.{c}" for c in CUSTOMER_COLUMNS) + ") "
_BOTH_CUSTOMERS = view_sql("customers", "clean_customers")


def _truth(spark, sf_dir) -> DataFrame:
    return evaluation.wrong_cells(view(spark, sf_dir, "customers"), view(spark, sf_dir, "clean_customers"))


@query(_BOTH_CUSTOMERS + _TRUTH + "SELECT * FROM w")
def ground_truth(spark, sf_dir):
    return _truth(spark, sf_dir)


_EVAL = _CHAIN.replace(view_sql("customers"), _BOTH_CUSTOMERS) + _TRUTH + ", b AS (SELECT coalesce(f.\"column\", w.\"column\") AS \"column\", CASE WHEN f.row_id IS NOT NULL AND w.row_id IS NOT NULL THEN 1 ELSE 0 END AS tp, CASE WHEN w.row_id IS NULL THEN 1 ELSE 0 END AS fp, CASE WHEN f.row_id IS NULL THEN 1 ELSE 0 END AS fn FROM f FULL JOIN w ON f.row_id = w.row_id AND f.\"column\" = w.\"column\") "


@query(_EVAL + "SELECT \"column\", CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round_even(coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0), 3) AS precision, round_even(coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0), 3) AS recall, round_even(coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0), 3) AS f1 FROM b GROUP BY ROLLUP (\"column\")")
def quality_by_column(spark, sf_dir):
    return evaluation.quality(_customer_findings(spark, sf_dir), _truth(spark, sf_dir))


@query(_EVAL + "SELECT error_type, CAST(sum(CASE WHEN w.row_id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN w.row_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS fp FROM f LEFT JOIN w ON f.row_id = w.row_id AND f.\"column\" = w.\"column\" GROUP BY 1")
def quality_by_error_type(spark, sf_dir):
    return evaluation.by_error_type(_customer_findings(spark, sf_dir), _truth(spark, sf_dir))


@query(_EVAL + f"SELECT f.\"column\", count(*) AS fixes, CAST(sum(CASE WHEN CASE WHEN {blank('suggested_fix')} THEN '' ELSE suggested_fix END = truth THEN 1 ELSE 0 END) AS BIGINT) AS right FROM f JOIN w ON f.row_id = w.row_id AND f.\"column\" = w.\"column\" WHERE suggested_fix IS NOT NULL GROUP BY 1".replace("AS right", "AS \"right\""))
def correction_accuracy(spark, sf_dir):
    return evaluation.correction_accuracy(_customer_findings(spark, sf_dir), _truth(spark, sf_dir))


@query(_EVAL + """, r AS (SELECT CASE WHEN max(tp + fp) > 0 THEN 1 ELSE 0 END AS hit, CASE WHEN max(tp + fn) > 0 THEN 1 ELSE 0 END AS truly FROM (SELECT coalesce(f.row_id, w.row_id) AS row_id, CASE WHEN f.row_id IS NOT NULL AND w.row_id IS NOT NULL THEN 1 ELSE 0 END AS tp, CASE WHEN w.row_id IS NULL THEN 1 ELSE 0 END AS fp, CASE WHEN f.row_id IS NULL THEN 1 ELSE 0 END AS fn FROM f FULL JOIN w ON f.row_id = w.row_id AND f."column" = w."column") GROUP BY row_id),
q AS (SELECT CAST(sum(hit * truly) AS BIGINT) AS tp, CAST(sum(hit * (1 - truly)) AS BIGINT) AS fp, CAST(sum((1 - hit) * truly) AS BIGINT) AS fn FROM r) SELECT tp, fp, fn, round_even(tp / (tp + fp), 3) AS precision, round_even(tp / (tp + fn), 3) AS recall, round_even(2 * tp / (2 * tp + fp + fn), 3) AS f1 FROM q""")
def row_quality(spark, sf_dir):
    return evaluation.row_quality(_customer_findings(spark, sf_dir), _truth(spark, sf_dir))


@query(f"""WITH found AS ({ORACLE_SQL['robust_outliers']}), kept AS ({ORACLE_SQL['extreme_outliers']}), truth AS (SELECT event_id AS row_id FROM events WHERE event_id % 401 = 0)
SELECT 'value' AS "column", count(*) AS resolved FROM found WHERE row_id NOT IN (SELECT row_id FROM truth) AND row_id NOT IN (SELECT row_id FROM kept)""")
def false_alarms_resolved(spark, sf_dir):
    """False alarms of the wide outlier bounds that the narrow ones don't have; the wrong cells are those of the dirty view."""
    df = view(spark, sf_dir, "events_table")
    clean = df.join(dependencies.order_breaks(df, "row_id", "counter"), "row_id", "left_anti")
    truth = df.where("row_id % 401 = 0").select("row_id", F.lit("value").alias("column"))
    return evaluation.resolved_false_alarms(anomalies.outliers(df, "value"), anomalies.outliers(df, "value", clean, 6.0, 4.5), truth.select("row_id", "column"))


@query(_EVAL + "SELECT w.\"column\", count(*) AS wrong, CAST(sum(CASE WHEN f.row_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS leaked, round(sum(CASE WHEN f.row_id IS NULL THEN 1 ELSE 0 END) / count(*), 6) AS leak_rate FROM w LEFT JOIN f ON f.row_id = w.row_id AND f.\"column\" = w.\"column\" GROUP BY 1")
def mask_leaks(spark, sf_dir):
    return evaluation.mask_leaks(view(spark, sf_dir, "customers"), detectors.dirty_cells(_customer_findings(spark, sf_dir)), _truth(spark, sf_dir))


@query(_EVAL + """, d AS (SELECT row_id, "column", CASE WHEN error_type = 'VAD' THEN 'approx_fd' ELSE 'strong_rule' END AS detector, coalesce(confidence, 0.9) AS score FROM f), n AS (SELECT DISTINCT detector AS without FROM d UNION ALL SELECT ''),
k AS (SELECT without, row_id, "column" FROM d JOIN n ON detector <> without WHERE round(score * CASE detector WHEN 'approx_fd' THEN 0.9 ELSE 1.0 END, 6) >= 0.6), h AS (SELECT n.without, count(w.row_id) AS tp, count(k.row_id) - count(w.row_id) AS fp FROM n LEFT JOIN k ON k.without = n.without LEFT JOIN w ON w.row_id = k.row_id AND w."column" = k."column" GROUP BY 1)
SELECT without, tp, fp, (SELECT count(*) FROM w) - tp AS fn, round_even(coalesce(tp / nullif(tp + fp, 0), 0), 3) AS precision, round_even(tp / (SELECT count(*) FROM w), 3) AS recall, round_even(2 * tp / (tp + fp + (SELECT count(*) FROM w)), 3) AS f1 FROM h""")
def detector_ablation(spark, sf_dir):
    return evaluation.ablation(fusion.normalised(fusion.as_evidence(_customer_findings(spark, sf_dir))), _truth(spark, sf_dir))


_MODEL = f"""{view_sql('customers')}, p AS ({paired('customers', _FD_COLUMNS)}), n AS (SELECT lhs, a, rhs, b, count(*) AS n FROM p GROUP BY ALL), g AS (SELECT lhs, a, rhs, sum(n) AS size, max(n) AS top_n, arg_max(b, {{'n': n, 'b': b}}) AS top FROM n GROUP BY ALL), k AS (SELECT rhs, count(DISTINCT b) AS k FROM n GROUP BY 1),
vote AS (SELECT row_id, rhs AS "column", p.b AS value, (n + 1) / (size + k) AS p, (top_n + 1) / (size + k) AS best_p, top FROM p JOIN n USING (lhs, a, rhs, b) JOIN g USING (lhs, a, rhs) JOIN k USING (rhs)),
m AS (SELECT row_id, "column", value, round(avg(p), 6) AS p, arg_max(top, {{'p': best_p, 't': top}}) AS best, round(max(best_p), 6) AS best_p FROM vote GROUP BY ALL) """


@query(_MODEL.replace(view_sql("customers"), _BOTH_CUSTOMERS) + _TRUTH.rstrip() + """, b AS (SELECT t.t AS threshold, CASE WHEN w.row_id IS NULL THEN 0 ELSE 1 END AS hit FROM m LEFT JOIN w ON m.row_id = w.row_id AND m."column" = w."column" JOIN (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]) AS t) t ON 1 - m.p >= t.t), q AS (SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(sum(hit) AS BIGINT) AS tp, CAST(sum(1 - hit) AS BIGINT) AS fp, (SELECT count(*) FROM w) - sum(hit) AS fn FROM b GROUP BY 1)
SELECT threshold, tp, fp, CAST(fn AS BIGINT) AS fn, round_even(tp / (tp + fp), 3) AS precision, round_even(tp / (tp + fn), 3) AS recall, round_even(2 * tp / (2 * tp + fp + fn), 3) AS f1 FROM q""")
def gate_grid(spark, sf_dir):
    df = view(spark, sf_dir, "customers")
    scored = models.predictions(df, _FD_COLUMNS).select("row_id", "column", (1 - F.col("p")).alias("score"))
    return evaluation.gate_grid(scored, _truth(spark, sf_dir), [0.5, 0.6, 0.7, 0.8, 0.9])


@query(_MODEL + "SELECT * FROM m")
def model_predictions(spark, sf_dir):
    return models.predictions(view(spark, sf_dir, "customers"), _FD_COLUMNS)


@query(_MODEL + """, s AS (SELECT *, -ln(p + 1e-9) AS s FROM m), l AS (SELECT "column", quantile_cont(s, 0.99) AS most FROM s GROUP BY 1 HAVING avg(CASE WHEN best = value THEN 1.0 ELSE 0.0 END) >= 0.5)
SELECT row_id, "column", value, 'reconstruction' AS detector, 'DIST' AS error_type, round(s, 6) AS score, best AS suggested_fix FROM s JOIN l USING ("column") WHERE (s > most OR p < 0.02) AND best <> value""")
def unlikely_cells(spark, sf_dir):
    return models.unlikely_cells(models.predictions(view(spark, sf_dir, "customers"), _FD_COLUMNS))


_ROW_TEXT = "to_json([" + ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in CUSTOMER_COLUMNS) + "])"


@query(f"{view_sql('customers')} SELECT row_id, CAST(CAST(('0x' || substr(sha256('42:' || CAST({_ROW_TEXT} AS VARCHAR)), 1, 8)) AS BIGINT) % 3 AS INTEGER) AS fold FROM customers")
def row_folds(spark, sf_dir):
    return models.folds(view(spark, sf_dir, "customers"))


@query(_CHAIN + ", d AS (SELECT row_id, count(DISTINCT \"column\") AS n FROM f GROUP BY 1) SELECT customers.row_id, coalesce(d.n, 0) AS n_dirty FROM customers LEFT JOIN d USING (row_id) WHERE coalesce(d.n, 0) <= 1")
def nearly_clean_rows(spark, sf_dir):
    return models.nearly_clean_rows(view(spark, sf_dir, "customers"), detectors.dirty_cells(_customer_findings(spark, sf_dir)))


CUSTOMER_PROGRAM = [
    constraints.Constraint("missing", ("nation",), ("nation",)),
    constraints.Constraint("dmv", ("region",), ("region",)),
    constraints.Constraint("duplicate", ("name",), ("name",)),
    constraints.Constraint("normalize", ("segment",), ("segment",), params={"case": "upper"}),
    constraints.Constraint("regex", ("nation",), ("nation",), params={"pattern": r"NATION_\d+"}),
    constraints.Constraint("type", ("nationkey",), ("nationkey",), params={"type": "integer"}),
    constraints.Constraint("range", ("nationkey",), ("nationkey",), params={"min": 0, "max": 24}),
    constraints.Constraint("fd", ("nationkey", "nation"), ("nationkey", "nation")),
    constraints.Constraint("neighbor", ("region", "nationkey"), ("region",), (("segment", "BUILDING"),)),
]
ORDER_PROGRAM = [
    constraints.Constraint("compare", ("low_day", "high_day"), ("low_day", "high_day")),
    constraints.Constraint("arithmetic", ("qty", "price", "total"), ("total",), params={"expression": "qty * price - total"}),
    constraints.Constraint("statistical", ("total",), ("total",), params={"z": 6}),
    constraints.Constraint("temporal", ("day", "due"), ("day",)),
]


def _evidence_sql(table: str, c: constraints.Constraint, target: str, kind: str, bad: str, fix: str = "CAST(NULL AS VARCHAR)", support: str | None = None, source: str | None = None, scope: str = "true") -> str:
    """One constraint's evidence on one target. bad is null where it abstains; support without a value counts the rows in scope."""
    n = f"CASE WHEN {bad} IS NULL THEN 0 ELSE (SELECT count(*) FROM {table} WHERE {scope}) END" if support is None else f"coalesce({support}, 0)"
    family = {"missing": "missing", "dmv": "missing", "duplicate": "format", "normalize": "semantic", "regex": "format", "type": "format", "range": "domain", "statistical": "statistical", "neighbor": "neighbor"}.get(c.operator, "relation")
    return f"""SELECT row_id, '{target}' AS "column", '{c.id}' AS constraint_id, '{c.operator}:{c.id}' AS source_group, '{family}' AS family, CASE WHEN {bad} IS NULL THEN 'abstain' WHEN {bad} THEN 'violation' ELSE 'check_passed' END AS status, CASE WHEN {bad} THEN 0.9 ELSE 0.0 END AS score, '{kind}' AS error_type,
CASE WHEN {bad} THEN {fix} END AS suggested_fix, CAST({n} AS BIGINT) AS support, round(least(0.95, 0.5 + 0.45 * {n} / ({n} + 20)), 6) AS reliability FROM {source or table}"""


def _peers_sql(name: str, rows: str, key: str, value: str, confidence: float = 0.9) -> str:
    """CTEs that end in {name}: row_id, bad, peer_top, support of each row with a key and a value, against the others of its key."""
    return f"""{name}_t AS (SELECT row_id, {key} AS k, {value} AS v FROM {rows} WHERE NOT {blank(key)} AND NOT {blank(value)}), {name}_g AS (SELECT k, v, count(*) AS n, min(row_id) AS f FROM {name}_t GROUP BY ALL),
{name}_l AS (SELECT t.row_id, t.v AS own, g.v, CASE WHEN g.v = t.v THEN g.n - 1 ELSE g.n END AS n, g.f, sum(g.n) OVER (PARTITION BY t.row_id) - 1 AS support FROM {name}_t t JOIN {name}_g g USING (k)), {name}_b AS (SELECT * FROM {name}_l QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, f) = 1),
{name} AS (SELECT row_id, CASE WHEN support >= 3 AND n / support >= {confidence} THEN own <> v END AS bad, CASE WHEN support >= 3 AND n / support >= {confidence} THEN v END AS peer_top, support FROM {name}_b)"""


def _customer_program_sql() -> str:
    c = CUSTOMER_PROGRAM
    unless = lambda col, test: f"CASE WHEN NOT {blank(col)} THEN {test} END"
    parts = "list_transform(string_split(name, ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"
    own = [
        _evidence_sql("customers", c[0], "nation", "MV", blank("nation")),
        _evidence_sql("customers", c[1], "region", "DMV", unless("region", f"lower(regexp_replace(region, '^\\s+|\\s+$', '', 'g')) IN {DEFAULT_TOKENS_SQL}"), "''"),
        _evidence_sql("customers", c[2], "name", "FI", unless("name", f"len({parts}) > 1 AND {parts}[1] <> '' AND len(list_distinct({parts})) = 1"), f"{parts}[1]"),
        _evidence_sql("customers", c[3], "segment", "FI", unless("segment", "upper(segment) <> segment"), "upper(segment)"),
        _evidence_sql("customers", c[4], "nation", "FI", unless("nation", "NOT regexp_full_match(nation, 'NATION_\\d+')")),
        _evidence_sql("customers", c[5], "nationkey", "FI", unless("nationkey", "NOT regexp_full_match(nationkey, '\\d+')")),
        _evidence_sql("customers", c[6], "nationkey", "FI", unless("nationkey", "CAST(nationkey AS INTEGER) NOT BETWEEN 0 AND 24")),
        _evidence_sql("customers", c[7], "nationkey", "VAD", unless("nationkey", "bad"), support="support", source="customers LEFT JOIN fd USING (row_id)"),
        _evidence_sql("customers", c[7], "nation", "VAD", unless("nation", "bad"), "peer_top", "support", "customers LEFT JOIN fd USING (row_id)"),
        _evidence_sql("customers", c[8], "region", "OTHER", unless("region", "bad"), "peer_top", "support", "customers LEFT JOIN nb USING (row_id)"),
    ]
    return f"{view_sql('customers')}, {_peers_sql('fd', 'customers', 'nationkey', 'nation')}, building AS (SELECT * FROM customers WHERE segment = 'BUILDING'), {_peers_sql('nb', 'building', 'nationkey', 'region')}, ev AS ({' UNION ALL '.join(own)}) "


_EV = _customer_program_sql()


def _order_program_sql() -> str:
    c, num = ORDER_PROGRAM, "TRY_CAST({} AS DOUBLE)"
    low, high, qty, price, total = (num.format(x) for x in ("low_day", "high_day", "qty", "price", "total"))
    date = "coalesce(try_strptime({0}, '%Y-%m-%d'), try_strptime({0}, '%m/%d/%Y'))"
    parts = [_evidence_sql("dated", c[0], t, "VAD", f"{low} > {high}") for t in ("low_day", "high_day")]
    parts.append(_evidence_sql("dated", c[1], "total", "VAD", f"abs({qty} * {price} - {total}) > 1e-6"))
    parts.append(_evidence_sql("dated", c[2], "total", "OTHER", f"abs({total} - median) / mad > 6", "CAST(median AS VARCHAR)", "n", "dated, spread"))
    parts.append(_evidence_sql("dated", c[3], "day", "VAD", f"{date.format('day')} > {date.format('due')}"))
    spread = f"middle AS (SELECT quantile_cont({total}, 0.5) AS median, stddev_pop({total}) AS sd, count({total}) AS n FROM dated), spread AS (SELECT median, n, greatest(1.4826 * quantile_cont(abs({total} - median), 0.5), 0.1 * any_value(sd), 1e-6) AS mad FROM dated, middle GROUP BY median, n)"
    return f"{view_sql('orders_table')}, dated AS (SELECT *, CASE WHEN row_id % 173 = 0 THEN '1990-01-01' ELSE day END AS due FROM orders_table), {spread}, ev AS ({' UNION ALL '.join(parts)}) SELECT * FROM ev WHERE status <> 'check_passed'"


def _program_evidence(spark, sf_dir) -> DataFrame:
    return constraints.execute(view(spark, sf_dir, "customers"), CUSTOMER_PROGRAM)


@query(_EV + "SELECT * FROM ev")
def constraint_evidence(spark, sf_dir):
    return _program_evidence(spark, sf_dir)


def _own_row_sql() -> str:
    c = CUSTOMER_PROGRAM
    tests = {c[0].id: ("nation", blank("nation")), c[1].id: ("region", f"lower(regexp_replace(region, '^\\s+|\\s+$', '', 'g')) IN {DEFAULT_TOKENS_SQL}"), c[4].id: ("nation", "NOT regexp_full_match(nation, 'NATION_\\d+')"), c[6].id: ("nationkey", "CAST(nationkey AS INTEGER) < 0 OR CAST(nationkey AS INTEGER) > 24")}
    return view_sql("customers") + " " + " UNION ALL ".join(f"SELECT row_id, '{col}' AS \"column\", '{i}' AS constraint_id, CASE WHEN {blank(col)} AND '{i}' <> '{c[0].id}' THEN 'abstain' WHEN {t} THEN 'violation' ELSE 'check_passed' END AS status FROM customers" for i, (col, t) in tests.items())


@query(_own_row_sql())
def constraint_status(spark, sf_dir):
    ids = [CUSTOMER_PROGRAM[i].id for i in (0, 1, 4, 6)]
    return _program_evidence(spark, sf_dir).where(F.col("constraint_id").isin(ids)).select("row_id", "column", "constraint_id", "status")


@query(_order_program_sql())
def order_program(spark, sf_dir):
    dated = view(spark, sf_dir, "orders_table").withColumn("due", F.when(F.col("row_id") % 173 == 0, "1990-01-01").otherwise(F.col("day")))
    return constraints.execute(dated, ORDER_PROGRAM).where("status <> 'check_passed'")


_LOO = f"""{view_sql('customers')}, t AS (SELECT row_id, nationkey AS k, nation AS v FROM customers WHERE NOT {blank('nation')} AND NOT {blank('nationkey')}), g AS (SELECT k, v, count(*) AS n, min(row_id) AS f FROM t GROUP BY ALL),
l AS (SELECT t.row_id, t.v AS own, g.v, CASE WHEN g.v = t.v THEN g.n - 1 ELSE g.n END AS n, g.f, sum(g.n) OVER (PARTITION BY t.row_id) - 1 AS support FROM t JOIN g USING (k)), b AS (SELECT * FROM l WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, f) = 1)
SELECT t.row_id, CASE WHEN b.support >= 3 AND b.n / b.support >= 0.8 THEN b.own <> b.v END AS bad, CASE WHEN b.support >= 3 AND b.n / b.support >= 0.8 THEN b.v END AS peer_top FROM t LEFT JOIN b USING (row_id)"""


@query(_LOO)
def leave_one_out(spark, sf_dir):
    return constraints.leave_one_out(view(spark, sf_dir, "customers"), ["nationkey"], "nation", confidence=0.8).select("row_id", "bad", "peer_top")


@query(_EV + """SELECT row_id, "column", family, round(avg(CASE WHEN status = 'violation' THEN score ELSE 0 END), 6) AS violation, round(avg(CASE WHEN status = 'violation' THEN 0.0 ELSE 1.0 END), 6) AS passed, round(avg(reliability), 6) AS reliability, round(avg(least(support / 50, 1.0)), 6) AS support, CAST(1.0 AS DOUBLE) AS coverage,
CAST(CASE WHEN bool_or(status = 'violation') AND bool_or(status <> 'violation') THEN 1 ELSE 0 END AS DOUBLE) AS disagreement FROM ev WHERE status <> 'abstain' GROUP BY ALL""")
def evidence_features(spark, sf_dir):
    return constraints.evidence_features(_program_evidence(spark, sf_dir))


@query(_EV + """, q AS (SELECT constraint_id, avg(CASE WHEN status = 'abstain' THEN 0.0 ELSE 1.0 END) AS coverage, avg(least(support / 50, 1.0)) FILTER (status <> 'abstain') AS support, avg(CASE WHEN status = 'violation' THEN 1.0 ELSE 0.0 END) FILTER (status <> 'abstain') AS p, count(*) FILTER (status <> 'abstain') AS n FROM ev GROUP BY 1)
SELECT constraint_id, round(coverage, 6) AS coverage, round(coalesce(support, 0), 6) AS support, round(coalesce(greatest(0, 1 - 4 * sqrt(p * (1 - p) / n)), 0), 6) AS stability, CAST(0.0 AS DOUBLE) AS counterevidence FROM q""")
def constraint_quality(spark, sf_dir):
    return constraints.constraint_quality(_program_evidence(spark, sf_dir))


@query(_EV + """, v AS (SELECT row_id, "column", error_type, suggested_fix, score * reliability AS w FROM ev WHERE status = 'violation' QUALIFY row_number() OVER (PARTITION BY row_id, "column" ORDER BY score * reliability DESC, constraint_id DESC) = 1), k AS (SELECT row_id, "column", count(DISTINCT CASE WHEN reliability >= 0.5 THEN family END) AS families FROM ev WHERE status <> 'abstain' GROUP BY ALL),
d AS (SELECT k.*, round(coalesce(w, 0), 6) AS error_score, error_type, suggested_fix FROM k LEFT JOIN v USING (row_id, "column")) SELECT row_id, "column", error_score >= 0.5 AS is_error, error_score, coalesce(error_type, 'NONE') AS error_type, error_score BETWEEN 0.35 AND 0.65 OR families < 2 AS low_confidence, suggested_fix FROM d""")
def cell_decisions(spark, sf_dir):
    return constraints.decisions(_program_evidence(spark, sf_dir))


@query(f"""{view_sql('customers')}, t AS (SELECT row_id, nationkey AS k, nation AS l, region AS r FROM customers WHERE NOT {blank('nationkey')}), g AS (SELECT k, l, r, count(*) AS n FROM t GROUP BY ALL), m AS (SELECT k, l AS tl, r AS tr, n AS top_n, sum(n) OVER (PARTITION BY k) AS size FROM g QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1),
v AS (SELECT row_id, l IS NOT DISTINCT FROM tl AS same_l, r IS NOT DISTINCT FROM tr AS same_r, tl, tr, CASE WHEN l IS NOT DISTINCT FROM tl AND r IS NOT DISTINCT FROM tr THEN top_n - 1 ELSE top_n END / (size - 1) AS share FROM t JOIN m USING (k) WHERE size - 1 >= 3 AND size - 1 <= 0.5 * (SELECT count(*) FROM customers))
SELECT row_id, CASE WHEN NOT same_l AND same_r THEN 'lhs' WHEN same_l AND NOT same_r THEN 'rhs' ELSE 'unresolved' END AS side, CASE WHEN NOT same_l AND same_r THEN tl WHEN same_l AND NOT same_r THEN tr END AS fix, CASE WHEN same_l OR same_r THEN 'localized' ELSE 'multiple_participants_differ' END AS status FROM v WHERE share >= 0.8 AND NOT (same_l AND same_r)""")
def localised_errors(spark, sf_dir):
    return constraints.localised(view(spark, sf_dir, "customers"), "nation", "region", ["nationkey"], share=0.8)


@query()
def induced_program(spark, sf_dir):
    program = constraints.local_program(view(spark, sf_dir, "customers"), CUSTOMER_COLUMNS)
    return spark.createDataFrame([(c.id, c.operator, ",".join(c.participants), ",".join(c.targets)) for c in program], "id string, operator string, participants string, targets string")


@query(f"""SELECT event_type, count(*) AS n, count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) AS keys, min(CAST(json_extract(props, '$.k') AS BIGINT)) AS low, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS high FROM events GROUP BY 1""")
def json_profile(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct(k).alias("keys"), F.min(k).alias("low"), F.max(k).alias("high"))


from tablewarden import model_queries  # noqa: E402, F401  it registers its queries with those above
