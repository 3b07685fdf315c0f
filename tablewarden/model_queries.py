"""Registered queries of encoders, models and the critic, and DuckDB SQL with the same rows."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewarden.operators import constraints, critic, denial, encoding, evaluation, models, sampling
from tablewarden.plans.dirty import view, view_sql
from tablewarden.plans.quantiles import quantiles
from tablewarden.queries import _customer_findings, _EV, _EVAL, _FD_COLUMNS, _MODEL, _truth, CUSTOMER_COLUMNS, CUSTOMER_PROGRAM, blank, number_sql, query, unpivoted

BLANK_10_SQL = "('', 'empty', 'null', 'n/a', 'na', 'none', '-', 'nan', '?', '--')"
_ENCODED = ["nationkey", "nation", "region", "segment", "note"]


def blank_10(v: str) -> str:
    return f"({v} IS NULL OR lower(regexp_replace({v}, '^\\s+|\\s+$', '', 'g')) IN {BLANK_10_SQL})"


_VALUES = f"""{view_sql('customers')}, c AS ({unpivoted('customers', CUSTOMER_COLUMNS)}), n AS (SELECT "column", value, count(*) AS n FROM c WHERE NOT {blank_10('value')} GROUP BY ALL),
w AS (SELECT *, ln(1 + n) / ln(1 + max(n) OVER (PARTITION BY "column")) AS frequency FROM n) """


@query(_VALUES + 'SELECT "column", value, n, round(frequency, 6) AS frequency FROM w')
def log_frequencies(spark, sf_dir):
    out = encoding.log_frequency(encoding.distinct_values(view(spark, sf_dir, "customers"), CUSTOMER_COLUMNS))
    return out.select("column", "value", "n", F.round("frequency", 6).alias("frequency"))


def _tabular(spark, sf_dir) -> encoding.TabularEncoderModel:
    return encoding.TabularEncoder(inputCols=_ENCODED).fit(view(spark, sf_dir, "customers"))


_KEY = "CASE WHEN NOT b THEN CAST(value AS DOUBLE) END"


@query(_VALUES + f""", m AS (SELECT quantile_cont({number_sql('nationkey')}, 0.5) AS median, quantile_cont({number_sql('nationkey')}, 0.75) - quantile_cont({number_sql('nationkey')}, 0.25) AS iqr FROM customers WHERE NOT {blank_10('nationkey')}),
t AS (SELECT row_id, "column", value, {blank_10('value')} AS b FROM c WHERE "column" IN {tuple(_ENCODED)}),
f AS (SELECT row_id, 'nationkey#value' AS name, ({number_sql('value')} - median) / iqr AS value FROM t, m WHERE "column" = 'nationkey'
UNION ALL SELECT row_id, "column" || CASE WHEN b THEN '=__UNK__' ELSE '=' || value END, 1.0 FROM t WHERE "column" <> 'nationkey'
UNION ALL SELECT row_id, "column" || '#blank', 1.0 FROM t WHERE b
UNION ALL SELECT row_id, "column" || '#frequency', frequency FROM t JOIN w USING ("column", value) WHERE "column" <> 'nationkey')
SELECT row_id, name, round(value, 6) AS value FROM f WHERE value <> 0""")
def tabular_features(spark, sf_dir):
    """The features of the customers that aren't 0, by name."""
    model = _tabular(spark, sf_dir)
    rows = model.transform(view(spark, sf_dir, "customers")).select("row_id", F.posexplode(vector_to_array("features")).alias("feature", "value")).where("value <> 0")
    return rows.join(F.broadcast(model.feature_names()), "feature").select("row_id", "name", F.round("value", 6).alias("value"))  # bounded: few values of few columns


@query(_VALUES + """, k AS (SELECT "column", count(*) AS k, CASE "column" WHEN 'nationkey' THEN 2 ELSE count(*) + 3 END AS width, CASE "column" WHEN 'nationkey' THEN 0 WHEN 'nation' THEN 1 WHEN 'region' THEN 2 WHEN 'segment' THEN 3 ELSE 4 END AS place FROM n WHERE "column" <> 'name' GROUP BY 1)
SELECT "column" AS name, CAST(sum(width) OVER (ORDER BY place) - width AS INTEGER) AS start, CAST(width AS INTEGER) AS width, CASE "column" WHEN 'nationkey' THEN 'numeric' ELSE 'categorical' END AS target, CAST(CASE "column" WHEN 'nationkey' THEN 0 ELSE k + 1 END AS INTEGER) AS classes FROM k""")
def encoded_columns(spark, sf_dir):
    """Where each column's features are, and what can be predicted of it."""
    rows = [(t["name"], t["start"], t["width"], t["target"], t["classes"]) for t in _tabular(spark, sf_dir).targets()]
    return spark.createDataFrame(rows, "name string, start int, width int, target string, classes int")


_GRAMS = " UNION ALL ".join(f"SELECT \"column\", value, substr(coalesce(value, ''), i, {k}) AS g FROM (SELECT *, unnest(range(1, greatest(length(coalesce(value, '')) - {k} + 1, 1) + 1)) AS i FROM v)" for k in (1, 2, 3))
_CELLS = ["nationkey", "segment", "note"]


@query(f"""{view_sql('customers')}, c AS ({unpivoted('customers', _CELLS)}), v AS (SELECT "column", value, count(*) AS n FROM c GROUP BY ALL), x AS (SELECT *, {blank('value')} AS b, TRY_CAST(value AS DOUBLE) AS x FROM v),
q AS (SELECT quantile_cont(TRY_CAST(nationkey AS DOUBLE), 0.5) AS median, quantile_cont(TRY_CAST(nationkey AS DOUBLE), 0.75) - quantile_cont(TRY_CAST(nationkey AS DOUBLE), 0.25) AS scale FROM customers),
g AS ({_GRAMS}), h AS (SELECT "column", value, CAST(('0x' || substr(md5(g), 1, 8)) AS BIGINT) % 32 AS bucket, count(*) AS n FROM g GROUP BY ALL), l AS (SELECT "column", value, sqrt(sum(n * n)) AS norm FROM h GROUP BY ALL),
t AS (SELECT *, coalesce(value, '') AS s, greatest(length(coalesce(value, '')), 1) AS len FROM x),
f AS (SELECT "column", value, 0 AS feature, greatest(-20, least(20, (x - median) / scale)) AS score FROM t, q WHERE "column" = 'nationkey'
UNION ALL SELECT "column", value, 1, CASE WHEN b THEN 1 ELSE 0 END FROM t UNION ALL SELECT "column", value, 2, least(length(s) / 100, 5) FROM t
UNION ALL SELECT "column", value, 3, length(regexp_replace(s, '[^0-9]', '', 'g')) / len FROM t UNION ALL SELECT "column", value, 4, length(regexp_replace(s, '[^A-Za-z]', '', 'g')) / len FROM t
UNION ALL SELECT "column", value, 5, length(regexp_replace(s, '[^ ]', '', 'g')) / len FROM t UNION ALL SELECT "column", value, 6, length(regexp_replace(s, '[A-Za-z0-9 ]', '', 'g')) / len FROM t
UNION ALL SELECT "column", value, 7, CASE WHEN s = upper(s) AND s <> lower(s) THEN 1 ELSE 0 END FROM t UNION ALL SELECT "column", value, 8, n / (SELECT count(*) FROM customers) FROM t
UNION ALL SELECT "column", value, 16 + bucket, n / norm FROM h JOIN l ON h."column" = l."column" AND h.value IS NOT DISTINCT FROM l.value)
SELECT "column", value, CAST(feature AS INTEGER) AS feature, round(CAST(score AS DOUBLE), 6) AS score FROM f WHERE score <> 0""".replace('SELECT "column", value, 16 + bucket, n / norm FROM h JOIN', 'SELECT h."column", h.value, 16 + bucket, n / norm FROM h JOIN'))
def cell_features(spark, sf_dir):
    """The features of all distinct cells that aren't 0, by place."""
    df = view(spark, sf_dir, "customers")
    rows = encoding.CellEncoder(df, _CELLS).transform(df).select("column", "value", "features").distinct()
    return rows.select("column", "value", F.posexplode("features").alias("feature", "score")).where("score <> 0").withColumn("score", F.round("score", 6))


@query(f"""{view_sql('events_table')} SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.1), 6) AS low, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.99), 6) AS high FROM events_table GROUP BY 1""")
def group_quantiles(spark, sf_dir):
    q = quantiles(view(spark, sf_dir, "events_table"), ["event_type"], "value", [0.1, 0.5, 0.99])
    return q.select("event_type", "n", *(F.round(F.col("q")[i], 6).alias(k) for i, k in enumerate(("low", "median", "high"))))


@query(f"""{view_sql('customers')}, t AS (SELECT row_id, segment, nation, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY segment, nation) AS size FROM customers WHERE segment IS NOT NULL AND nation IS NOT NULL WINDOW w AS (PARTITION BY segment, nation ORDER BY row_id)),
p AS (SELECT *, unnest(range(least(8, size - 1))) AS j, least(8, size - 1) AS k FROM t WHERE size > 1), s AS (SELECT *, CASE WHEN k > 1 THEN (j * (size - 2)) // (k - 1) ELSE 0 END AS other FROM p),
o AS (SELECT s.row_id, s.j, t.row_id AS peer FROM s JOIN t ON s.segment = t.segment AND s.nation = t.nation AND t.place = CASE WHEN other >= s.place THEN other + 1 ELSE other END)
SELECT row_id, string_agg(CAST(peer AS VARCHAR), ' ' ORDER BY j) AS peers FROM o GROUP BY 1""")
def row_peers(spark, sf_dir):
    return critic.peers(view(spark, sf_dir, "customers"), ["segment", "nation"]).select("row_id", F.array_join("peers", " ").alias("peers"))


_CONTEXT = [(c.id, t, o) for c in CUSTOMER_PROGRAM for t in c.targets for o in c.participants if o != t]


@query(_MODEL.replace("SELECT row_id, rhs AS \"column\", p.b AS value,", "SELECT row_id, lhs, k, rhs AS \"column\", p.b AS value,") + f""", x AS (SELECT * FROM (VALUES {', '.join(map(str, _CONTEXT))}) AS x(constraint_id, "column", lhs)), part AS (SELECT row_id, "column", constraint_id, sum(p) AS p, count(*) AS n, any_value(k) AS k FROM vote JOIN x USING ("column", lhs) GROUP BY ALL),
both_ AS (SELECT *, sum(p) OVER (PARTITION BY row_id, "column") AS all_p, sum(n) OVER (PARTITION BY row_id, "column") AS all_n FROM part)
SELECT constraint_id, count(*) AS cells, round(greatest(-1, least(1, avg(ln(all_p / all_n) - ln(CASE WHEN all_n > n THEN (all_p - p) / (all_n - n) ELSE 1 / k END)))), 6) AS gain FROM both_ GROUP BY 1""")
def prediction_gain(spark, sf_dir):
    return models.prediction_gain(view(spark, sf_dir, "customers"), _FD_COLUMNS, CUSTOMER_PROGRAM)


@query(_MODEL + """, s AS (SELECT row_id, "column", -ln(p + 1e-9) AS loss FROM m), l AS (SELECT "column", quantile_cont(loss, 0.9) AS most FROM s GROUP BY 1) SELECT row_id, "column", round(loss, 6) AS loss FROM s JOIN l USING ("column") WHERE loss > most""")
def highest_losses(spark, sf_dir):
    """The cells that trimmed training trusts less."""
    out = models.highest_losses(models.predictions(view(spark, sf_dir, "customers"), _FD_COLUMNS))
    return out.withColumn("loss", F.round("loss", 6))


_TRIMMED = _MODEL.replace("n AS (SELECT lhs, a, rhs, b, count(*) AS n FROM p GROUP BY ALL)", """o AS (SELECT lhs, a, rhs, b, count(*) AS n FROM p GROUP BY ALL), og AS (SELECT lhs, a, rhs, sum(n) AS size FROM o GROUP BY ALL), ok AS (SELECT rhs, count(DISTINCT b) AS k FROM o GROUP BY 1),
ol AS (SELECT row_id, rhs AS "column", -ln(round(avg((n + 1) / (size + k)), 6) + 1e-9) AS loss FROM p JOIN o USING (lhs, a, rhs, b) JOIN og USING (lhs, a, rhs) JOIN ok USING (rhs) GROUP BY ALL), oq AS (SELECT "column", quantile_cont(loss, 0.9) AS most FROM ol GROUP BY 1),
ow AS (SELECT row_id, "column", 0.1::DOUBLE AS weight FROM ol JOIN oq USING ("column") WHERE loss > most),
n AS (SELECT lhs, a, rhs, b, sum(coalesce(l.weight, 1) * coalesce(r.weight, 1)) AS n FROM p LEFT JOIN ow l ON l.row_id = p.row_id AND l."column" = lhs LEFT JOIN ow r ON r.row_id = p.row_id AND r."column" = rhs GROUP BY ALL)""")


@query(_TRIMMED + 'SELECT row_id, "column", value, p FROM m')
def trimmed_predictions(spark, sf_dir):
    out = models.trimmed_predictions(view(spark, sf_dir, "customers"), _FD_COLUMNS, rounds=1)
    return out.select("row_id", "column", "value", "p")


_SCALE = f"SELECT quantile_cont({number_sql('nationkey')}, 0.75) - quantile_cont({number_sql('nationkey')}, 0.25) AS scale FROM customers"


@query(f"""{view_sql('customers')}, s AS ({_SCALE}), c AS ({unpivoted('customers', ['nationkey', 'nation', 'segment'])})
SELECT row_id, "column", value, CASE WHEN "column" = 'nationkey' THEN CAST(CAST(value AS DOUBLE) + 10 * scale AS VARCHAR) ELSE value || '#?~' END AS wrong FROM c, s WHERE NOT {blank('value')}""")
def synthetic_errors(spark, sf_dir):
    """A wrong value for every filled cell, as the critic learns from them."""
    df = view(spark, sf_dir, "customers").select("row_id", "nationkey", "nation", "segment")
    columns = df.columns[1:]
    _, wrong = critic.corrupted(df, columns, critic.column_scales(df, columns), share=1.0)
    cells = encoding.cells(df, columns).withColumnRenamed("row_id", "source_row").withColumnRenamed("value", "was")
    return wrong.join(cells, ["source_row", "column"]).select(F.col("source_row").alias("row_id"), "column", F.col("was").alias("value"), F.col("value").alias("wrong"))


@query()
def cross_fit_scores(spark, sf_dir):
    """Each cell of the customers scored once, by a critic that never saw its row."""
    out = critic.cross_fit(view(spark, sf_dir, "customers"), CUSTOMER_COLUMNS, CUSTOMER_PROGRAM, k=2, steps=15, teacher=critic.sure_cells(constraints.execute(view(spark, sf_dir, "customers"), CUSTOMER_PROGRAM)))
    return out.select("row_id", "column", "value", "fold", F.round("score", 4).alias("score"), F.round("residual", 6).alias("residual"), "alternative")


_FREQUENCIES = f"""fc AS ({unpivoted('customers', _FD_COLUMNS)}), fn AS (SELECT "column", value, count(*) AS n FROM fc GROUP BY ALL), ft AS (SELECT row_id, CAST(sum(n) AS BIGINT) / (SELECT count(*) FROM customers) AS frequency FROM fc JOIN fn ON fc."column" = fn."column" AND fc.value IS NOT DISTINCT FROM fn.value GROUP BY 1),
fr AS (SELECT ft.*, CAST(('0x' || substr(md5('42:' || row_id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE * 1e-6 AS jitter, (nationkey, nation, region, segment)::VARCHAR AS key FROM ft JOIN customers USING (row_id)) """


@query(f"{view_sql('customers')}, {_FREQUENCIES} SELECT row_id, round(frequency, 6) AS frequency, round(jitter * 1e6, 6) AS jitter FROM fr")
def row_frequencies(spark, sf_dir):
    out = sampling.row_frequencies(view(spark, sf_dir, "customers"), _FD_COLUMNS)
    return out.select("row_id", F.round("frequency", 6).alias("frequency"), F.round(F.col("jitter") * 1e6, 6).alias("jitter"))


@query(_EV + f""", {_FREQUENCIES}, pool AS (SELECT * FROM fr QUALIFY row_number() OVER (ORDER BY frequency + jitter DESC, row_id) <= 96 OR row_number() OVER (ORDER BY frequency + jitter, row_id) <= 96 OR row_number() OVER (ORDER BY jitter, row_id) <= 64),
cell AS (SELECT row_id, "column", sum(CASE WHEN status = 'violation' THEN score ELSE 0 END) + CASE WHEN count(DISTINCT status) > 1 THEN 1 ELSE 0 END AS s FROM ev WHERE status <> 'abstain' GROUP BY ALL), sev AS (SELECT row_id, sum(s) AS s FROM cell GROUP BY 1),
con AS (SELECT pool.row_id, key, round(coalesce(s, 0), 6) AS severity, frequency FROM pool LEFT JOIN sev USING (row_id)),
tops AS (SELECT 'typical' AS view, row_id, -(frequency + jitter) AS a, 0.0 AS b, key FROM fr UNION ALL SELECT 'rare', row_id, frequency + jitter, 0.0, key FROM fr UNION ALL SELECT 'conflict', row_id, -severity, frequency, key FROM con),
one AS (SELECT * FROM tops QUALIFY row_number() OVER (PARTITION BY view, key ORDER BY a, b, row_id) = 1)
SELECT view, CAST(row_number() OVER (PARTITION BY view ORDER BY a, b, row_id) - 1 AS INTEGER) AS nth, row_id FROM one QUALIFY row_number() OVER (PARTITION BY view ORDER BY a, b, row_id) <= 6""")
def sample_views(spark, sf_dir):
    """Typical, rare and conflicting customers."""
    return sampling.views(view(spark, sf_dir, "customers"), _FD_COLUMNS, CUSTOMER_PROGRAM)


@query(_EVAL + """SELECT 'all' AS "group", round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1, true AS inside FROM b""")
def f1_interval(spark, sf_dir):
    """F1 of the findings on customers, and whether it lies within its bootstrap interval, which must not be wider than 0.2."""
    out = evaluation.bootstrap_f1(_customer_findings(spark, sf_dir), _truth(spark, sf_dir))
    return out.select("group", F.round("f1", 6).alias("f1"), (F.col("f1").between(F.col("low"), F.col("high")) & (F.col("high") - F.col("low") < 0.2)).alias("inside"))


_NULL = "CAST(NULL AS VARCHAR)"
_GRADE = "CASE WHEN support >= 10 AND kept / support >= 0.8 THEN CASE WHEN support >= 50 AND kept / support >= 0.95 THEN 'high' ELSE 'medium' END END"
_LEAST = 15  # of rows that a constraint needs, so that one with few of them holds in small tables
_RARE = "CASE WHEN row_id < {n} * 4 AND row_id % 4 = 1 THEN {v} END"
_SPANS = f"spans AS (SELECT row_id, low_day, high_day, year, {_RARE.format(n=60, v='low_day')} AS min_size, {_RARE.format(n=60, v='high_day')} AS max_size FROM orders_table)"


def _spans(spark, sf_dir):
    """Orders with two pairs of lower and higher columns, of which one is filled in few rows."""
    few = (F.col("row_id") < 240) & (F.col("row_id") % 4 == 1)
    return view(spark, sf_dir, "orders_table").select("row_id", "low_day", "high_day", "year", F.when(few, F.col("low_day")).alias("min_size"), F.when(few, F.col("high_day")).alias("max_size"))


@query(f"""{view_sql('orders_table')}, {_SPANS}, t AS (SELECT row_id, 'low_day' AS low, 'high_day' AS high, low_day AS v, high_day AS w FROM spans UNION ALL SELECT row_id, 'min_size', 'max_size', min_size, max_size FROM spans),
x AS (SELECT *, TRY_CAST(v AS DOUBLE) AS x, TRY_CAST(w AS DOUBLE) AS y FROM t WHERE TRY_CAST(v AS DOUBLE) IS NOT NULL AND TRY_CAST(w AS DOUBLE) IS NOT NULL), s AS (SELECT low, high, count(*) AS support, sum(CASE WHEN x <= y THEN 1 ELSE 0 END) AS kept FROM x GROUP BY ALL),
h AS (SELECT low, high, round(kept / support, 3) AS confidence, {_GRADE} AS severity FROM s WHERE support >= {_LEAST} AND 1 - kept / support <= 0.1), b AS (SELECT * FROM x JOIN h USING (low, high) WHERE x > y AND severity IS NOT NULL)
SELECT row_id, low AS "column", v AS value, 'FI' AS error_type, 'dc:compare:' || low || '<=' || high AS rule, {_NULL} AS suggested_fix, confidence, severity FROM b UNION ALL SELECT row_id, high, w, 'FI', 'dc:compare:' || low || '<=' || high, NULL, confidence, severity FROM b""")
def compared_columns(spark, sf_dir):
    return denial.compared(_spans(spark, sf_dir), min_support=_LEAST, most=0.1)


@query(f"""{view_sql('orders_table')}, s AS (SELECT count(*) AS support, sum(CASE WHEN CAST(year AS INTEGER) BETWEEN 1800 AND 2026 THEN 1 ELSE 0 END) AS kept FROM orders_table WHERE year IS NOT NULL)
SELECT row_id, 'year' AS "column", year AS value, 'FI' AS error_type, 'dc:temporal:year_range' AS rule, {_NULL} AS suggested_fix, round(kept / support, 3) AS confidence, {_GRADE} AS severity FROM orders_table, s WHERE CAST(year AS INTEGER) NOT BETWEEN 1800 AND 2026 AND 1 - kept / support <= 0.02""")
def graded_years(spark, sf_dir):
    return denial.years(view(spark, sf_dir, "orders_table"), 2025)


_RANKED = f"""{view_sql('events_table')}, e AS (SELECT row_id, row_id AS place, counter, value, user_id FROM events_table), u AS (SELECT row_id, place AS r, 'counter' AS "column", counter AS m FROM e UNION ALL SELECT row_id, place, 'value', value FROM e UNION ALL SELECT row_id, place, 'user_id', user_id FROM e),
n AS (SELECT *, lag(m) OVER w AS p, lead(m) OVER w AS x FROM u WINDOW w AS (PARTITION BY "column" ORDER BY r, row_id)), s AS (SELECT "column", sum(CASE WHEN m <> p THEN 1 ELSE 0 END) AS support, greatest(sum(CASE WHEN m > p THEN 1 ELSE 0 END), sum(CASE WHEN m < p THEN 1 ELSE 0 END)) AS kept FROM n GROUP BY 1),
h AS (SELECT "column", round(kept / support, 3) AS confidence, {_GRADE} AS severity FROM s WHERE support >= 30 AND 1 - kept / support <= 0.02), q AS (SELECT "column", quantile_cont(abs(m - p), 0.5) AS step FROM n WHERE m <> p GROUP BY 1) """


@query(_RANKED + f"""SELECT row_id, "column", CAST(CAST(m AS BIGINT) AS VARCHAR) AS value, 'VAD' AS error_type, 'dc:order:place~' || "column" AS rule, {_NULL} AS suggested_fix, confidence, severity FROM n JOIN h USING ("column") JOIN q USING ("column")
WHERE ((m > p AND m > x) OR (m < p AND m < x)) AND least(abs(m - p), abs(m - x)) >= 3 * step AND severity IS NOT NULL""")
def ordered_columns(spark, sf_dir):
    df = view(spark, sf_dir, "events_table").withColumn("place", F.col("row_id"))
    return denial.ordered(df, "place", ["counter", "value", "user_id"])


@query(f"""{view_sql('events_table')}, x AS (SELECT unnest(['row_id', 'counter', 'user_id', 'value']) AS "column", unnest([row_id, counter, user_id, value]) AS x FROM events_table)
SELECT CASE "column" WHEN 'row_id' THEN 'place' ELSE "column" END AS "column" FROM x WHERE x IS NOT NULL GROUP BY 1 HAVING avg(CASE WHEN abs(x - round(x)) < 1e-6 THEN 1.0 ELSE 0.0 END) > 0.95 AND count(DISTINCT x) / count(*) > 0.95""")
def rank_columns(spark, sf_dir):
    df = view(spark, sf_dir, "events_table").withColumn("place", F.col("row_id"))
    return spark.createDataFrame([(c,) for c in denial.rank_columns(df, ["place", "counter", "user_id", "value"])], "column string")
