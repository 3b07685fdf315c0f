"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .fingerprints import op4_minhash_fingerprints
from .language_id import op10_language_id
from .lexical_search import SQL as LEXICAL_SQL
from .lexical_search import op12_lexical_search
from .licences import op8_licence_scan
from .mixing import op1_source_mix
from .near_dedup import op9_near_dedup
from .packing import op6_best_fit_packing
from .quality_rules import op5_quality_rules
from .substring_dedup import op3_substring_dedup
from .toxicity import op7_toxicity
from .vector_search import SQL as VECTOR_SQL
from .vector_search import op11_vector_search
from .warc import op2_warc_derivatives
from .whitening import op13_whitening

QUERIES = {f.__name__: f for f in (op1_source_mix, op2_warc_derivatives, op3_substring_dedup, op4_minhash_fingerprints, op5_quality_rules, op6_best_fit_packing, op7_toxicity, op8_licence_scan, op9_near_dedup, op10_language_id, op11_vector_search, op12_lexical_search, op13_whitening)}


def substring_sql(min_words: int = 50, levels: int = 11) -> str:
    """op3_substring_dedup by plain windows: words, windows that two documents have, and the levels above."""
    sql = f"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    u AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS pos FROM t),
    d0 AS (SELECT doc_id, pos, hash(long) AS h FROM (SELECT doc_id, n, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {min_words - 1} FOLLOWING) AS long FROM u) WHERE pos + {min_words} <= n)"""
    for i in range(levels):
        sql += f""",
    r{i} AS (SELECT doc_id, pos, h, doc_id > least AS later FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS least, max(doc_id) OVER (PARTITION BY h) AS most FROM d{i}) WHERE least <> most),
    d{i + 1} AS (SELECT a.doc_id, a.pos, hash(a.h, b.h) AS h FROM r{i} a JOIN r{i} b ON a.doc_id = b.doc_id AND b.pos = a.pos + {min_words << i})"""
    reached = " UNION ALL ".join(f"SELECT doc_id, {min_words << i} AS length FROM r{i}" for i in range(levels))
    return sql + f""",
    k AS (SELECT u.doc_id, word, pos, bool_or(coalesce(later, false)) OVER (PARTITION BY u.doc_id ORDER BY pos ROWS BETWEEN {min_words - 1} PRECEDING AND CURRENT ROW) AS gone FROM u LEFT JOIN r0 USING (doc_id, pos)),
    c AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM k GROUP BY 1),
    m AS (SELECT doc_id, max(length) AS longest FROM ({reached}) GROUP BY 1), q AS (SELECT doc_id, count(*) AS n_repeated FROM r0 GROUP BY 1)
    SELECT documents.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_repeated, 0) AS n_repeated, CAST(coalesce(longest, 0) AS INTEGER) AS longest
    FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN q USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {"op3_substring_dedup": substring_sql(), "op11_vector_search": VECTOR_SQL, "op12_lexical_search": LEXICAL_SQL}
