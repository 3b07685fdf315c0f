"""Tables with known errors, made from the clean star schema by rules on their integer keys.

Each is SQL that Spark and DuckDB both run; names in braces are the tables. The clean tables are the ground truth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CUSTOMER = "FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"

CUSTOMERS = f"""SELECT c_custkey AS row_id,
 CASE WHEN c_custkey % 59 = 0 THEN concat(c_name, ',', c_name) WHEN c_custkey % 61 = 0 THEN concat(c_name, ' , ', lower(c_name)) WHEN c_custkey % 79 = 0 THEN '' ELSE c_name END AS name,
 CAST(c_nationkey AS STRING) AS nationkey,
 CASE WHEN c_custkey % 53 = 0 THEN 'NATION_X' WHEN c_custkey % 101 = 0 THEN 'n/a' WHEN c_custkey % 89 = 0 THEN NULL ELSE n_name END AS nation,
 CASE WHEN c_custkey % 67 = 0 THEN '?' WHEN c_custkey % 71 = 0 THEN ' Unknown ' WHEN c_custkey % 47 = 0 THEN 'ATLANTIS' ELSE r_name END AS region,
 CASE WHEN c_custkey % 73 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 97 = 0 THEN concat(c_mktsegment, 'X') ELSE c_mktsegment END AS segment,
 CASE WHEN c_custkey % 113 = 0 THEN concat('TY  - JOUR ', c_name, ' ', c_name, ' ', c_name, ' ', c_name) ELSE concat('note ', CAST(c_custkey % 7 AS STRING)) END AS note
 {_CUSTOMER}"""

CLEAN_CUSTOMERS = f"""SELECT c_custkey AS row_id, c_name AS name, CAST(c_nationkey AS STRING) AS nationkey, n_name AS nation, r_name AS region,
 c_mktsegment AS segment, concat('note ', CAST(c_custkey % 7 AS STRING)) AS note {_CUSTOMER}"""

_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
ORDERS = f"""SELECT o_orderkey AS row_id,
 CASE WHEN o_orderkey % 97 = 0 THEN 'X' WHEN o_orderkey % 199 = 0 THEN '' ELSE o_orderstatus END AS status,
 CASE WHEN o_orderkey % 103 = 0 THEN '9-NONE' WHEN o_orderkey % 107 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS priority,
 CASE WHEN o_orderkey % 31 = 0 THEN concat(substr({_DAY}, 6, 2), '/', substr({_DAY}, 9, 2), '/', substr({_DAY}, 1, 4)) WHEN o_orderkey % 4999 = 0 THEN '1998-13-45' ELSE {_DAY} END AS day,
 CASE WHEN o_orderkey % 127 = 0 THEN concat(CAST(o_custkey % 11 AS STRING), ' ', CAST(o_custkey % 7 AS STRING)) WHEN o_orderkey % 131 = 0 THEN '140 %' ELSE concat(CAST(o_custkey % 11 AS STRING), ' %') END AS discount_percent,
 CAST(o_orderkey % 90 AS STRING) AS low_day, CAST(CASE WHEN o_orderkey % 151 = 0 THEN o_orderkey % 90 - 5 ELSE o_orderkey % 90 + o_custkey % 5 END AS STRING) AS high_day,
 CAST(o_custkey % 40 AS STRING) AS qty, CAST(o_custkey % 17 AS STRING) AS price,
 CAST((o_custkey % 40) * (o_custkey % 17) + CASE WHEN o_orderkey % 157 = 0 THEN 3 ELSE 0 END AS STRING) AS total,
 CASE WHEN o_orderkey % 163 = 0 THEN '2190' ELSE substr({_DAY}, 1, 4) END AS year
 FROM {{orders}}"""

PARTS = """SELECT p_partkey AS row_id,
 CASE WHEN p_partkey % 211 = 0 THEN concat(p_type, CASE WHEN p_partkey % 2 = 0 THEN 'X' ELSE 'Q' END) WHEN p_partkey % 307 = 0 THEN concat('=', CAST(p_partkey % 3 AS STRING), '!') ELSE p_type END AS type,
 p_brand AS brand,
 CASE WHEN p_partkey % 37 = 0 THEN concat(substr(split_part(p_name, ' ', 1), 1, 3), ' ', substr(split_part(p_name, ' ', 2), 1, 2)) ELSE concat(p_name, ' group') END AS title,
 CASE WHEN p_partkey % 37 = 0 THEN concat(p_name, ' group') ELSE concat(substr(split_part(p_name, ' ', 1), 1, 3), ' ', substr(split_part(p_name, ' ', 2), 1, 2)) END AS short_title,
 concat(CAST(p_size AS STRING), CASE WHEN p_partkey % 3 = 0 THEN ' oz' ELSE ' min' END) AS measure
 FROM {part}"""

EVENTS = """SELECT event_id AS row_id, event_type, user_id,
 CASE WHEN event_id % 401 = 0 THEN value + 5000 ELSE value END AS value,
 CASE WHEN event_id % 9 = 0 THEN '2024-01-01' ELSE concat('2024-', CASE WHEN user_id % 12 + 1 < 10 THEN '0' ELSE '' END, CAST(user_id % 12 + 1 AS STRING), '-', CAST(event_id % 18 + 10 AS STRING)) END AS first_seen,
 CAST(event_id * 10 + CASE WHEN event_id % 499 = 250 THEN 4000 ELSE event_id % 7 END AS BIGINT) AS counter
 FROM {events}"""

VIEWS = {"customers": CUSTOMERS, "clean_customers": CLEAN_CUSTOMERS, "orders_table": ORDERS, "parts": PARTS, "events_table": EVENTS}
TABLES = ("region", "nation", "customer", "part", "orders", "events")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the Parquet tables in sf_dir."""
    text = VIEWS[name]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text})


def view_sql(*names: str) -> str:
    """The views as common table expressions for DuckDB, where the tables go by their names."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names)
