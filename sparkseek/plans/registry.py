"""Registered queries and the DuckDB SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function ``(spark, sf_dir)`` under its own name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


# Corpora as common table expressions.
DOCS = r"""d AS (SELECT doc_id AS seq, 'doc-' || doc_id AS id, '/doc/' || doc_id AS url, array_to_string(string_split_regex(text, '\s+')[1:4], ' ') AS heading, text AS body, lang AS label,
  source AS breadcrumb, (['section','action','field','link','file','media','structured'])[doc_id % 7 + 1] AS type FROM documents)"""
PARTS = r"""d AS (SELECT p_partkey::BIGINT AS seq, 'part-' || p_partkey AS id, '/part/' || p_partkey AS url, p_name AS heading, concat_ws(' ', p_name, p_type, p_brand) AS body, p_brand AS label,
  p_type AS breadcrumb, 'section' AS type FROM part)"""


def toks(c: str) -> str:
    return rf"list_filter(string_split_regex(lower({c}), '\s+'), lambda w: w <> '')"


def values(rows: list[tuple]) -> str:
    """A VALUES list of literals."""

    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, int | float):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def direct(q: str, heading: float = 2.0, body: float = 1.0) -> str:
    """``m``: direct matches of ``d`` with stage, word_pos and raw, before boosts."""
    terms = q.split()
    hit = [f"((length('{t}') >= 3 AND (list_contains(string_split_regex(lower(body), '\\s+'), '{t}') OR list_contains(string_split_regex(strip_accents(lower(body)), '\\s+'), '{t}'))) OR (length('{t}') >= 2 AND coalesce(lower(label) = '{t}', false)))" for t in terms]
    place = " ".join(f"WHEN {h} THEN {i}" for i, h in enumerate(hit))
    return f"""x AS (SELECT *, CASE WHEN length(heading) >= 2 AND (lower(heading) = '{q}' OR strip_accents(lower(heading)) = '{q}') THEN 0
    WHEN starts_with(lower(heading), '{q}') OR starts_with(strip_accents(lower(heading)), '{q}') THEN 1 WHEN {' OR '.join(hit)} THEN 2 END AS stage,
    CASE {place} ELSE 0 END AS wp FROM d),
m AS (SELECT * EXCLUDE wp, CASE WHEN stage = 2 THEN wp ELSE 0 END AS word_pos,
    CASE stage WHEN 0 THEN 1e2 WHEN 1 THEN 5e1 ELSE 2e1 END * CASE WHEN stage < 2 THEN {heading}::DOUBLE * (2 - exp(-length(heading) / 5e1)) ELSE {body}::DOUBLE * (2 - exp(-length(body) / 5e1)) END AS raw
    FROM x WHERE stage IS NOT NULL)"""


def boost(q: str, source: str = "m", to: str = "b") -> str:
    """Phrase and proximity bonus for several terms."""
    terms = q.split()
    if len(terms) < 2:
        return f"{to} AS (SELECT * FROM {source})"
    every = lambda c: " AND ".join(f"list_contains({c}, '{t}')" for t in terms)
    pairs = [(a, b) for i, a in enumerate(terms) for b in terms[i + 1 :]]
    at = lambda t: f"list_filter(range(1, len(ht || bt) + 1), lambda i: (ht || bt)[i] = '{t}')"
    gains = ", ".join(f"(SELECT greatest(1e0, 2e0 - min(abs(u - v)) * 0.1::DOUBLE) FROM (SELECT unnest({at(a)}) AS u), (SELECT unnest({at(b)}) AS v))" for a, b in pairs)
    phrase = lambda c: f"contains(' ' || array_to_string({c}, ' ') || ' ', ' {q} ')"
    return f"""t AS (SELECT *, {toks('heading')} AS ht, {toks('body')} AS bt FROM {source}),
g AS (SELECT *, CASE WHEN ({every('ht')}) OR ({every('bt')}) THEN list_avg([{gains}]) ELSE 1e0 END AS near FROM t),
{to} AS (SELECT * REPLACE (raw * CASE WHEN {phrase('ht')} OR {phrase('bt')} THEN 1.5::DOUBLE ELSE near END AS raw) FROM g)"""


def top(source: str = "b", limit: int = 8, full: float = 2e2, where: str = "true") -> str:
    return f"""SELECT seq, id, heading, type, stage, round(raw, 6) AS raw, round(greatest(0e0, least(1e0, 1 - raw / {full}::DOUBLE)), 6) AS score
FROM {source} WHERE {where} ORDER BY round(raw, 9) DESC, stage, word_pos, seq LIMIT {limit}"""
