"""Search, ranking and query-language queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkseek.functions import text as X
from sparkseek.operators import index as I
from sparkseek.operators import saved as D
from sparkseek.operators import search as S
from sparkseek.operators.segments import opened, vacuumed
from sparkseek.plans import querylang as L
from sparkseek.plans.registry import DOCS, PARTS, boost, direct, query, top, toks, values
from sparkseek.sources.corpus import documents, parts, table
from sparkseek.sources.scratch import folder, stamp

NORM = "(2 - exp(-length(heading) / 5e1))"


_BUILT: dict[tuple, str] = {}


def indexed(spark, sf, corpus=documents, name="documents") -> str:
    """Path of the saved index of a table, built by the first query of a session that asks for it and again once the table changes."""
    key = (spark.sparkContext.applicationId, sf, name, stamp(spark, f"{sf}/{name}.parquet"))
    if key not in _BUILT:
        path = folder(spark)
        I.save(corpus(spark, sf), path)
        _BUILT[key] = path
    return _BUILT[key]


def classic(corpus: str, q: str, **kw) -> str:
    return f"WITH {corpus}, {direct(q)}, {boost(q)} {top(**kw)}"


@query(classic(DOCS, "the and"))
def search_classic(spark, sf):
    return D.search(spark, indexed(spark, sf), "the and")


@query(classic(PARTS, "small ring"))
def search_exact(spark, sf):
    return S.search(parts(spark, sf), "small ring")


@query(classic(PARTS, "small", limit=20))
def search_prefix(spark, sf):
    return S.search(parts(spark, sf), "small", limit=20)


@query(classic(DOCS, "with", limit=15))
def search_body_word(spark, sf):
    return D.search(spark, indexed(spark, sf), "with", limit=15)


@query(classic(DOCS, "the and attion", limit=25))
def search_multiword_proximity(spark, sf):
    return D.search(spark, indexed(spark, sf), "the and attion", limit=25)


@query(f"WITH {DOCS}, {direct('the')}, {boost('the')} SELECT seq, id, round(raw, 6) AS raw FROM b ORDER BY round(raw, 9) DESC, stage, word_pos, seq LIMIT 10 OFFSET 20")
def search_following(spark, sf):
    """The third page of ten, each read after the cursor of the one before."""
    at, cursor = opened(spark, indexed(spark, sf)), None
    for _ in range(3):
        page, cursor = D.following(spark, at, "the", cursor, 10)
    return page


@query(classic(DOCS, "the and"))
def search_unindexed(spark, sf):
    """The same as ``search_classic``, by one pass over the records."""
    return S.search(documents(spark, sf), "the and")


@query(classic(PARTS, "small ring", limit=30))
def search_saved_parts(spark, sf):
    return D.search(spark, indexed(spark, sf, parts, "part"), "small ring", limit=30)


@query(f"WITH {DOCS}, {direct('and for')}, {boost('and for')} " + top(where="type IN ('section', 'media')"))
def search_saved_filter(spark, sf):
    return D.search(spark, indexed(spark, sf), "and for", filter=F.col("type").isin("section", "media"))


@query(f"""WITH {DOCS}, w AS (SELECT seq, lower(unnest(list_filter(string_split_regex(heading, '\\s+') || string_split_regex(body, '\\s+'), lambda t: t <> ''))) AS term FROM d),
f AS (SELECT seq, strip_accents(term) AS term FROM (SELECT seq, lower(unnest(string_split_regex(body, '\\s+'))) AS term FROM d) WHERE strip_accents(term) <> term),
t AS (SELECT seq, lower(unnest(string_split_regex(coalesce(label, ''), '\\s+') || string_split_regex(coalesce(breadcrumb, ''), '\\s+'))) AS term FROM d),
p AS (SELECT DISTINCT term, seq FROM (SELECT * FROM w UNION ALL SELECT * FROM f UNION ALL SELECT * FROM t UNION ALL SELECT seq, lower(label) AS term FROM d WHERE length(label) >= 2) WHERE term <> '')
SELECT (SELECT count(*) FROM d) AS records, (SELECT count(*) FROM p) AS postings, (SELECT count(DISTINCT term) FROM p) AS terms""")
def index_build(spark, sf):
    """Writes a new index and counts what it holds."""
    path = folder(spark)
    I.save(documents(spark, sf), path)
    found = opened(spark, path).table("postings").agg(F.count("*").alias("postings"), F.countDistinct("term").alias("terms")).first()
    out = spark.createDataFrame([(I.meta(spark, path)["records"], found.postings, found.terms)], "records long, postings long, terms long")
    I.cleared(spark, path)
    return out


@query(classic(PARTS, "ring standard", limit=25))
def search_phrase_bonus(spark, sf):
    return S.search(parts(spark, sf), "ring standard", limit=25)


def _bm25_sql(corpus: str, q: str) -> str:
    terms = q.split()
    n_of = lambda t: f"(SELECT coalesce(nullif(sum(len(list_filter(string_split_regex(lower(body), '\\s+'), lambda w: w = '{t}'))), 0), 1)::DOUBLE FROM d)"
    df = f"CASE WHEN stage < 2 THEN {n_of(q)} " + " ".join(f"WHEN word_pos = {i} THEN {n_of(t)}" for i, t in enumerate(terms)) + " END"
    return f"""WITH {corpus}, {direct(q)}, k AS (SELECT count(*)::DOUBLE AS n, avg(length(body) + length(heading)) AS mean FROM d),
f AS (SELECT *, {df} AS df FROM m, k),
r AS (SELECT * REPLACE (CASE stage WHEN 0 THEN 1e2 WHEN 1 THEN 5e1 ELSE 2e1 END * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (2.5::DOUBLE / (1 + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * ((length(heading) + length(body)) / mean)))) AS raw) FROM f),
{boost(q, 'r')} {top(full=1e2)}"""


@query(_bm25_sql(DOCS, "inea the"))
def search_bm25(spark, sf):
    return D.search(spark, indexed(spark, sf), "inea the", scoring="bm25")


def _bm25f_sql(corpus: str, q: str, limit: int = 8) -> str:
    w = {"heading": 2.0, "body": 1.0, "label": 1.5, "breadcrumb": 0.5}
    count = lambda c, t: f"len(list_filter(string_split_regex(lower(coalesce({c}, '')), '\\s+'), lambda w: w = '{t}'))"
    parts_, total = [], []
    for i, t in enumerate(q.split()):
        dfs = ", ".join(f"coalesce(nullif(sum({count(c, t)}), 0), 1)::DOUBLE AS {c}{i}" for c in w)
        parts_.append(dfs)
        tf = " + ".join(f"{count(c, t)} * {x}::DOUBLE" for c, x in w.items())
        known = f"greatest(heading{i}, body{i}, CASE WHEN length(coalesce(label, '')) > 0 THEN label{i} ELSE 0 END, CASE WHEN length(coalesce(breadcrumb, '')) > 0 THEN breadcrumb{i} ELSE 0 END)"
        total.append(f"(CASE WHEN ({tf}) > 0 THEN ln((n - {known} + 0.5::DOUBLE) / ({known} + 0.5::DOUBLE) + 1) * (({tf}) * 2.5::DOUBLE / (({tf}) + 1.5::DOUBLE * norm)) ELSE 0 END)")
    size = " + ".join(f"coalesce(length({c}), 0) * {x}::DOUBLE" for c, x in w.items())
    return f"""WITH {corpus}, k AS (SELECT count(*)::DOUBLE AS n, avg(length(body) + length(heading)) AS mean, {', '.join(parts_)} FROM d),
z AS (SELECT d.*, k.*, 0.25::DOUBLE + 0.75::DOUBLE * (({size}) / mean) AS norm FROM d, k),
m AS (SELECT *, 3 AS stage, 0 AS word_pos, 1e2 * ({' + '.join(total)}) AS raw FROM z),
n1 AS (SELECT * FROM m WHERE raw > 0), {boost(q, 'n1')} {top(limit=limit)}"""


@query(_bm25f_sql(PARTS, "copper ring"))
def search_bm25f(spark, sf):
    return D.search(spark, indexed(spark, sf, parts, "part"), "copper ring", scoring="bm25f", bm25f_always=True)


@query(_bm25f_sql(PARTS, "copper ring"))
def search_bm25f_unindexed(spark, sf):
    return S.search(parts(spark, sf), "copper ring", scoring="bm25f", bm25f_always=True)


@query(_bm25f_sql(DOCS, "thanedble inea", limit=30))
def search_bm25f_documents(spark, sf):
    return D.search(spark, indexed(spark, sf), "thanedble inea", scoring="bm25f", bm25f_always=True, limit=30)


@query(_bm25f_sql(DOCS, "is of nd"))
def search_bm25f_gated(spark, sf):
    return D.search(spark, indexed(spark, sf), "is of nd", scoring="bm25f")


@query(f"WITH {PARTS}, {direct('red ring', heading=0.5, body=5)}, {boost('red ring')} {top(limit=12)}")
def search_weights(spark, sf):
    return S.search(parts(spark, sf), "red ring", limit=12, weights={"heading": 0.5, "body": 5.0})


@query(f"WITH {DOCS}, {direct('the')}, {boost('the')} " + top(where="type IN ('section', 'media')"))
def search_filter(spark, sf):
    return S.search(documents(spark, sf), "the", filter=F.col("type").isin("section", "media"))


@query(f"""WITH {DOCS}, {direct('the')}, b AS (SELECT * REPLACE (raw * CASE type WHEN 'action' THEN 2e0 WHEN 'file' THEN 0.5::DOUBLE ELSE 1e0 END AS raw) FROM m) {top()}""")
def search_type_weights(spark, sf):
    return S.search(documents(spark, sf), "the", type_weights={"action": 2.0, "file": 0.5})


def _mmr_sql(corpus: str, q: str) -> str:
    return f"""WITH {corpus}, {direct(q)}, p AS (SELECT * FROM m ORDER BY round(raw, 9) DESC, stage, word_pos, seq LIMIT 40),
k AS (SELECT *, row_number() OVER (ORDER BY round(raw, 9) DESC, stage, word_pos, seq) AS rk, list_distinct(list_filter(string_split_regex(lower(heading || ' ' || body), '\\s+'), lambda w: length(w) > 2)) AS t FROM p),
j AS (SELECT a.rk, max(CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0e0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t))::DOUBLE END) AS likeness FROM k a JOIN k b ON b.rk < a.rk GROUP BY a.rk),
r AS (SELECT k.* REPLACE (CASE WHEN k.rk = 1 THEN raw ELSE 0.5::DOUBLE * raw + 0.5::DOUBLE * (1 - coalesce(likeness, 0)) END AS raw) FROM k LEFT JOIN j USING (rk))
SELECT seq, id, heading, type, stage, round(raw, 6) AS raw, round(greatest(0e0, least(1e0, 1 - raw / 2e2)), 6) AS score FROM r ORDER BY round(raw, 9) DESC, rk LIMIT 10"""


@query(_mmr_sql(PARTS, "ring"))
def search_mmr(spark, sf):
    return S.search(parts(spark, sf), "ring", limit=10, diversify=True, pool=40)


@query(_mmr_sql(DOCS, "inea"))
def search_mmr_documents(spark, sf):
    return D.search(spark, indexed(spark, sf), "inea", limit=10, diversify=True, pool=40)


@query(f"""WITH {PARTS}, {direct('ring')}, c AS (SELECT 'part-' || user_id AS id, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY user_id),
b AS (SELECT m.* REPLACE (raw * CASE WHEN clicks IS NULL THEN 1e0 ELSE (1 + (clicks - 1) * 0.1::DOUBLE) * 1.2::DOUBLE END AS raw) FROM m LEFT JOIN c USING (id)) {top()}""")
def search_popularity(spark, sf):
    clicks = table(spark, sf, "events").where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("count"))
    clicks = clicks.select(F.lit(" Ríng ").alias("query"), F.concat(F.lit("part-"), "user_id").alias("record_id"), "count")
    return S.search(parts(spark, sf), "ring", clicks=clicks)


@query(f"""WITH {DOCS}, {direct('the')} SELECT seq, id, round(raw, 6) AS raw, (SELECT count(*) FROM m) AS total, (SELECT count(*) FROM m) > 35 AS has_more,
CASE WHEN (SELECT count(*) FROM m) > 35 THEN '35' END AS next_cursor FROM m ORDER BY round(m.raw, 9) DESC, stage, word_pos, seq LIMIT 15 OFFSET 20""")
def search_paginated(spark, sf):
    return D.page(spark, indexed(spark, sf), "the", cursor="20", size=15)


@query(f"WITH {DOCS}, {direct('with')} SELECT count(*) AS total FROM m")
def search_count(spark, sf):
    return D.total(spark, indexed(spark, sf), "with")


@query(f"WITH {DOCS} SELECT seq, id, heading, type, 0 AS stage, 0e0 AS raw, 1e0 AS score FROM d ORDER BY seq LIMIT 8")
def search_empty(spark, sf):
    return S.search(documents(spark, sf), "  ")


@query(f"""WITH {DOCS}, {direct('the')}, p AS (SELECT * FROM m ORDER BY round(raw, 9) DESC, stage, word_pos, seq LIMIT 100)
SELECT seq, id, type, round(raw, 6) AS raw FROM p WHERE type IN ('action', 'field') ORDER BY round(p.raw, 9) DESC, stage, word_pos, seq LIMIT 8""")
def search_category(spark, sf):
    return S.category(documents(spark, sf), "the", ["action", "field"])


@query(f"""WITH {PARTS}, {direct('small')} SELECT seq, round(raw, 6) AS raw, round(greatest(0e0, least(1e0, 1 - raw / 2e2)), 6) AS score FROM m""")
def score_projection(spark, sf):
    rows = S.ranked(parts(spark, sf), "small")
    return rows.select("seq", F.round("raw", 6).alias("raw"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("raw") / 200)), 6).alias("score"))


_SPANS = f"""WITH {DOCS}, {direct('inea')}, s AS (SELECT *, CASE WHEN stage < 2 THEN 'heading' ELSE 'body' END AS "key", CASE WHEN stage < 2 THEN heading ELSE body END AS txt FROM m),
p AS (SELECT *, instr(lower(txt), 'inea') - 1 AS pos FROM s),
r AS (SELECT *, CASE WHEN stage = 0 OR pos < 0 THEN 0 ELSE pos END AS "start", CASE WHEN stage = 0 THEN length(heading) WHEN pos < 0 THEN least(length(txt), 4) ELSE pos + 4 END AS "end" FROM p)"""


@query(_SPANS + ' SELECT seq, "key", "start"::BIGINT AS "start", "end"::BIGINT AS "end" FROM r')
def match_spans(spark, sf):
    rows = S.spans(S.ranked(documents(spark, sf), "inea"), "inea")
    return rows.select("seq", "key", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(_SPANS + """, q AS (SELECT seq, txt AS t, "start"::BIGINT AS s, "end"::BIGINT AS e, length(txt) AS n FROM r),
f AS (SELECT *, greatest(0, s - 60) AS f0, CASE WHEN s <= 60 THEN least(n, e + 120) ELSE least(n, e + 60) END AS z FROM q),
g AS (SELECT *, CASE WHEN z = n THEN greatest(0, s - 120) ELSE f0 END AS f FROM f)
SELECT seq, (CASE WHEN f > 0 THEN '...' ELSE '' END) || substr(t, f + 1, s - f) || '<mark>' || substr(t, s + 1, e - s) || '</mark>' || substr(t, e + 1, z - e) || (CASE WHEN z < n THEN '...' ELSE '' END) AS snippet FROM g""")
def snippet(spark, sf):
    rows = S.spans(S.ranked(documents(spark, sf), "inea"), "inea")
    return rows.select("seq", X.snippet(F.col("text"), F.col("start"), F.col("end")).alias("snippet"))


_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(f"""SELECT page_id, CASE WHEN i = 0 THEN {_ESC.format('html')} ELSE {_ESC.format('substr(html, 1, i - 1)')} || '<mark>' || {_ESC.format('substr(html, i, 4)')} || '</mark>' || {_ESC.format('substr(html, i + 4)')} END AS marked
FROM (SELECT *, instr(lower(html), 'href') AS i FROM pages)""")
def highlight(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.highlight(F.col("html"), "href").alias("marked"))


@query("""SELECT doc_id, CASE WHEN i < 0 THEN substr(text, 1, 90) || '…' ELSE (CASE WHEN i > 30 THEN '…' ELSE '' END) || substr(text, greatest(0, i - 30) + 1, least(length(text), i + 44) - greatest(0, i - 30)) || (CASE WHEN i + 44 < length(text) THEN '…' ELSE '' END) END AS snippet
FROM (SELECT *, instr(lower(text), 'inea') - 1 AS i FROM documents)""")
def short_snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.short_snippet(F.col("text"), "inea").alias("snippet"))


def _fuzzy_sql(corpus: str, q: str, d: int, a: float, b: float) -> str:
    n = len(q)
    skip = f"AND NOT contains(h, '{q}')" if d == 1 else ""
    return f"""WITH {corpus}, l AS (SELECT *, lower(heading) AS h, lower(body) AS lb FROM d),
o AS (SELECT * FROM l WHERE (length(h) >= 2 AND abs(length(h) - {n}) <= {d}) OR len(list_filter(string_split_regex(lb, '\\s+'), lambda w: length(w) >= 3 AND abs(length(w) - {n}) <= {d})) > 0 OR (length(label) >= 2 AND abs(length(label) - {n}) <= {d})),
e AS (SELECT *, CASE WHEN levenshtein(h, '{q}') <= {d} {skip} THEN levenshtein(h, '{q}') END AS hd,
  list_min(list_transform(range(1, length(lb) - {n} + 2), lambda i: levenshtein(substr(lb, i, {n}), '{q}'))) AS bd FROM o),
b AS (SELECT *, {3 + d} AS stage, 0 AS word_pos, CASE WHEN hd IS NOT NULL THEN (1 - hd / greatest({n}, length(h))::DOUBLE) * {a} * 2 * {NORM}
  WHEN bd <= {d} THEN (1 - bd / greatest({n}, length(lb))::DOUBLE) * {b} * (2 - exp(-length(body) / 5e1)) END AS raw FROM e) {top(where='raw IS NOT NULL', limit=20)}"""


@query(_fuzzy_sql(PARTS, "hotplate", 1, 6e1, 4e1))
def fuzzy_one_edit(spark, sf):
    return S.search(parts(spark, sf), "hotplate", fuzzy=True, limit=20)


@query(_fuzzy_sql(PARTS, "smal rinf", 2, 3e1, 2e1))
def fuzzy_two_edit(spark, sf):
    return S.search(parts(spark, sf), "smal rinf", fuzzy=True, limit=20)


def _fuzzy_documents_sql(q: str, d: int, a: float, b: float) -> str:
    """As above, with the windows of a body made from its single characters, which takes time in proportion to its length."""
    n = len(q)
    word = " || ".join(["ch", *(f"lead(ch, {k}) OVER w" for k in range(1, n))])
    return f"""WITH {DOCS}, l AS (SELECT *, lower(heading) AS h, lower(body) AS lb FROM d),
o AS (SELECT * FROM l WHERE (length(h) >= 2 AND abs(length(h) - {n}) <= {d}) OR len(list_filter(string_split_regex(lb, '\\s+'), lambda w: length(w) >= 3 AND abs(length(w) - {n}) <= {d})) > 0 OR (length(label) >= 2 AND abs(length(label) - {n}) <= {d})),
c AS (SELECT seq, unnest(string_split(lb, '')) AS ch, generate_subscripts(string_split(lb, ''), 1) AS i FROM o),
x AS (SELECT seq, {word} AS piece FROM c WINDOW w AS (PARTITION BY seq ORDER BY i)),
y AS (SELECT seq, min(levenshtein(piece, '{q}')) AS bd FROM (SELECT DISTINCT seq, piece FROM x WHERE piece IS NOT NULL) GROUP BY seq),
e AS (SELECT o.*, CASE WHEN levenshtein(h, '{q}') <= {d} {f"AND NOT contains(h, '{q}')" if d == 1 else ""} THEN levenshtein(h, '{q}') END AS hd, bd FROM o LEFT JOIN y USING (seq)),
b AS (SELECT *, {3 + d} AS stage, 0 AS word_pos, CASE WHEN hd IS NOT NULL THEN (1 - hd / greatest({n}, length(h))::DOUBLE) * {a} * 2 * {NORM}
  WHEN bd <= {d} THEN (1 - bd / greatest({n}, length(lb))::DOUBLE) * {b} * (2 - exp(-length(body) / 5e1)) END AS raw FROM e) {top(where='raw IS NOT NULL', limit=20)}"""


@query(_fuzzy_documents_sql("thintimt", 1, 6e1, 4e1))
def fuzzy_documents(spark, sf):
    return D.fuzzy(spark, indexed(spark, sf), "thintimt", 1, S.Options()).transform(_shown, 20)


@query(_fuzzy_documents_sql("thimtimt", 2, 3e1, 2e1))
def fuzzy_documents_two(spark, sf):
    return D.fuzzy(spark, indexed(spark, sf), "thimtimt", 2, S.Options()).transform(_shown, 20)


@query(_fuzzy_documents_sql("thintimt", 1, 6e1, 4e1))
def fuzzy_documents_unindexed(spark, sf):
    """The same as ``fuzzy_documents``, by one pass over the records."""
    return S.fuzzy(documents(spark, sf), "thintimt", 1, S.Options()).transform(_shown, 20)


def _shown(rows, limit):
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("raw") / 200)), 6)
    return rows.orderBy(F.round("raw", 9).desc(), "stage", "word_pos", "seq").limit(limit).select("seq", "id", "heading", "type", "stage", F.round("raw", 6).alias("raw"), score.alias("score"))


# The same changes in SQL: parts are written in three steps, some deleted, and some given other names, which moves them to the end.
_CHANGED = f"""{PARTS.replace('d AS', 'o_ AS', 1)}, s_ AS (SELECT * REPLACE (row_number() OVER (ORDER BY seq % 3 = 2, seq) - 1 AS seq) FROM o_),
l_ AS (SELECT * FROM s_ WHERE id <> 'part-1' AND seq % 7 <> 3), k_ AS (SELECT (SELECT count(*) FROM o_) + row_number() OVER (ORDER BY seq) - 1 AS seq, * EXCLUDE seq FROM l_ WHERE seq % 11 = 5),
d AS (SELECT * FROM l_ WHERE seq % 11 <> 5 UNION ALL SELECT * REPLACE ('ring small ' || heading AS heading) FROM k_)"""


def _changed(spark, sf) -> str:
    """Path of an index that was written, added to, deleted from and updated; it is built once a session."""
    key = (spark.sparkContext.applicationId, sf, "changed", stamp(spark, f"{sf}/part.parquet"))
    if key not in _BUILT:
        path, rows = folder(spark), parts(spark, sf)
        old, new = rows.where("seq % 3 <> 2"), rows.where("seq % 3 = 2")
        I.save(I.ranked(old).withColumn("seq", F.col("rank")).select(*rows.columns), path, buckets=4)
        I.add(spark, path, new)
        I.remove(spark, path, I.load(spark, path).where("seq % 7 = 3 OR id = 'part-1'").select("id"))
        I.update(spark, path, I.load(spark, path).where("seq % 11 = 5").withColumn("heading", F.concat(F.lit("ring small "), "heading")))
        _BUILT[key] = path
    return _BUILT[key]


@query(f"WITH {_CHANGED} SELECT seq, id, heading, body, label FROM d")
def index_segments(spark, sf):
    return I.load(spark, _changed(spark, sf)).select("seq", "id", "heading", "body", "label")


@query(f"WITH {_CHANGED}, {direct('small ring')}, {boost('small ring')} {top(limit=40)}")
def index_segments_search(spark, sf):
    return D.search(spark, _changed(spark, sf), "small ring", limit=40)


@query(_bm25f_sql(PARTS, "copper ring", 20).replace(PARTS, _CHANGED))
def index_segments_bm25f(spark, sf):
    """Frequencies are those of live records, by what deletions took."""
    return D.search(spark, _changed(spark, sf), "copper ring", scoring="bm25f", bm25f_always=True, limit=20)


@query(_fuzzy_sql(PARTS, "hotplate", 1, 6e1, 4e1).replace(PARTS, _CHANGED))
def index_segments_fuzzy(spark, sf):
    return D.search(spark, _changed(spark, sf), "hotplate", fuzzy=True, limit=20)


_CELLS = " UNION ALL ".join(f"SELECT '{f}' AS field, unnest(string_split_regex(lower({f}), '\\s+')) AS term FROM d" for f in I.FIELDS)


@query(f"WITH {_CHANGED}, n AS (SELECT field, term, count(*) AS n FROM ({_CELLS}) GROUP BY ALL) SELECT field, term, n FROM n WHERE term IN ('ring', 'small', 'copper', 'brand#11', 'hot')")
def index_segments_frequencies(spark, sf):
    return I.counts_of(spark, _changed(spark, sf), ["ring", "small", "copper", "brand#11", "hot"])


@query(f"""WITH {_CHANGED} SELECT 1 AS version, count(*) FILTER (seq % 3 <> 2) AS records FROM o_ UNION ALL SELECT 2, count(*) FROM o_ UNION ALL SELECT 3, count(*) FROM l_ UNION ALL SELECT 4, count(*) FROM d""")
def index_snapshots(spark, sf):
    """Live records of every version of an index, each read as it was."""
    path = _changed(spark, sf)
    out = None
    for v in (1, 2, 3, 4):
        rows = I.load(spark, opened(spark, path, v)).agg(F.lit(v).alias("version"), F.count("*").alias("records"))
        out = rows if out is None else out.union(rows)
    return out


@query(f"WITH {_CHANGED}, {direct('small ring')}, {boost('small ring')} {top(limit=40)}")
def index_compacted(spark, sf):
    """The same index, merged into one segment in a folder of its own, with the other versions deleted."""
    path = folder(spark)
    I.save(I.load(spark, _changed(spark, sf)), path)
    I.add(spark, path, I.load(spark, path).where("seq < 0"))
    I.compact(spark, path, fan=None)
    vacuumed(spark, path)
    return D.search(spark, path, "small ring", limit=40)


def _closest_sql(corpus: str, word: str) -> str:
    return f"""WITH {corpus}, k AS (SELECT 0 AS tier, seq, 0 AS pos, lower(heading) AS key FROM d WHERE length(heading) >= 2
UNION ALL SELECT 1, seq, i - 1, w[i] FROM (SELECT seq, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT seq, string_split_regex(lower(body), '\\s+') AS w FROM d)) WHERE length(w[i]) >= 3)
SELECT key, levenshtein(key, '{word}')::INT AS distance FROM k WHERE levenshtein(key, '{word}') <= 2 ORDER BY 2, tier, seq, pos LIMIT 1"""


@query(_closest_sql(PARTS, "standart"))
def closest_word(spark, sf):
    return S.closest_word(parts(spark, sf), "standart")


@query(_closest_sql(DOCS, "thanedbel"))
def closest_word_documents(spark, sf):
    return D.closest_word(spark, indexed(spark, sf), "thanedbel")


@query(_closest_sql(DOCS, "thanedbel"))
def closest_word_unindexed(spark, sf):
    return S.closest_word(documents(spark, sf), "thanedbel")


def _suggest_sql(corpus: str, q: str) -> str:
    return f"""WITH {corpus}, t AS (SELECT heading, seq, CASE WHEN starts_with(lower(heading), '{q}') THEN 0 WHEN contains(lower(heading), '{q}') THEN 1 END AS tier FROM d)
SELECT heading, min((tier, seq))[1] AS tier, min((tier, seq))[2] AS seq FROM t WHERE tier IS NOT NULL GROUP BY heading ORDER BY min((tier, seq)) LIMIT 10"""


@query(_suggest_sql(PARTS, "ri"))
def suggest(spark, sf):
    return S.suggest(parts(spark, sf), "ri")


@query(_suggest_sql(DOCS, "that"))
def suggest_documents(spark, sf):
    return D.suggest(spark, indexed(spark, sf), "that")


@query(_suggest_sql(DOCS, "nd"))
def suggest_holding(spark, sf):
    """Headings that start with the query are few, so those that hold it follow."""
    return D.suggest(spark, indexed(spark, sf), "nd")


def _ext(where: str) -> str:
    return f"WITH {DOCS}, m AS (SELECT *, 6 AS stage, 0 AS word_pos, 1e2 * {NORM} AS raw FROM d WHERE {where}) {top('m', 20)}"


def _ext_query(q: str):
    return lambda spark, sf: D.extended(spark, indexed(spark, sf), q, S.Options()).transform(_shown, 20)


_ANY = lambda t: f"(contains(lower(heading), '{t}') OR contains(lower(body), '{t}') OR contains(lower(coalesce(label, '')), '{t}') OR contains(lower(coalesce(breadcrumb, '')), '{t}'))"
_PHRASE = lambda p: f"(contains(' ' || array_to_string({toks('heading')}, ' ') || ' ', ' {p} ') OR contains(' ' || array_to_string({toks('body')}, ' ') || ' ', ' {p} '))"
for _name, _q, _where in (
    ("ext_term", "thintint", _ANY("thintint")),
    ("ext_phrase", "'the and attion'", _PHRASE("the and attion")),
    ("ext_exclude", "inea !thing", f"{_ANY('inea')} AND NOT contains(lower(heading), 'thing') AND NOT contains(lower(body), 'thing')"),
    ("ext_prefix", "^the", "(starts_with(lower(heading), 'the') OR starts_with(lower(body), 'the'))"),
    ("ext_suffix", "the.$", "(ends_with(lower(heading), 'the.') OR ends_with(lower(body), 'the.'))"),
    ("ext_or", "src17 | src3", f"({_ANY('src17')} OR {_ANY('src3')})"),
    ("ext_field", "type:media label:fr", "contains(type, 'media') AND contains(lower(coalesce(label, '')), 'fr')"),
):
    _f = _ext_query(_q)
    _f.__name__ = _name
    query(_ext(_where))(_f)


@query(f"WITH {DOCS} SELECT seq, type FROM d WHERE contains(lower(heading), 'th') AND contains(type, 'action')")
def field_query_match(spark, sf):
    rows = documents(spark, sf)
    return rows.where(L.matches_fields(L.parse_fields('title:"th" type:action rest'), rows.columns)).select("seq", "type")


@query(f"WITH {PARTS}, {direct('small')} SELECT seq, round(raw * 1.25::DOUBLE * 2, 6) AS raw FROM m")
def field_boost(spark, sf):
    factor = L.field_boost(L.parse_fields("title:small type:section"), {"type": 2.0})
    return S.ranked(parts(spark, sf), "small").select("seq", F.round(F.col("raw") * factor, 6).alias("raw"))


#: Queries are the names of parts; brands are synonyms of their first words, and types are what was asked before.
_NAMES, _TYPES = "SELECT DISTINCT p_name AS query FROM part", "SELECT DISTINCT concat(upper(p_name), ' ', p_type) AS past FROM part"


@query(f"""WITH q AS ({_NAMES}), s AS (SELECT DISTINCT lower(string_split(p_name, ' ')[1]) AS term, p_brand AS synonym FROM part), h AS ({_TYPES}),
w AS (SELECT query, string_split(query, ' ') AS ws FROM q)
SELECT query, query AS alternative FROM q UNION
SELECT query, array_to_string(list_filter(ws, lambda t: lower(t) <> term) || [synonym], ' ') FROM w JOIN s ON list_contains(ws, term) UNION
SELECT query, past FROM q JOIN h ON contains(lower(past), lower(query)) AND past <> query""")
def query_expand(spark, sf):
    p = table(spark, sf, "part")
    brands = p.select(F.lower(F.element_at(F.split("p_name", " "), 1)).alias("term"), F.col("p_brand").alias("synonym")).distinct()
    return L.expanded(p.select(F.col("p_name").alias("query")).distinct(), brands, p.select(F.concat(F.upper("p_name"), F.lit(" "), "p_type").alias("past")).distinct())


@query(f"SELECT doc_id, {_PHRASE('the and attion').replace('heading', 'text').replace('body', 'text')} AS hit FROM documents")
def phrase_match(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.has_phrase(X.words(F.col("text")), ["the", "and", "attion"]).alias("hit"))


_COS = "CASE WHEN {n} > 0 THEN list_dot_product(a, b) / {n} ELSE 0 END"


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS b FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, embedding::DOUBLE[] AS a, b FROM embeddings, q)
SELECT vec_id, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 6) AS score FROM e ORDER BY list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) DESC, vec_id LIMIT 10""")
def cosine_topk(spark, sf):
    rows = table(spark, sf, "embeddings")
    first = rows.where("vec_id = 0").select("embedding").first()
    return S.semantic(rows, first.embedding).select("vec_id", F.round("score", 6).alias("score"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT *, greatest(1, list_max(list_transform(v, lambda x: abs(x)))) AS m FROM e)
SELECT vec_id, array_to_string(list_transform(v, lambda x: greatest(-127, least(127, floor(x / m * 127 + 0.5::DOUBLE)))::INT), ',') AS q FROM m""")
def quantize(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(X.quantize(F.col("embedding")).cast("array<string>"), ",").alias("q"))


@query(f"WITH {PARTS}, {direct('small')} SELECT seq, id, heading, type, stage, round(raw, 6) AS raw, round(greatest(0e0, least(1e0, 1 - raw / 2e2)), 6) AS score FROM m ORDER BY heading DESC, seq DESC LIMIT 8")
def search_sorted(spark, sf):
    return S.search(parts(spark, sf), "small", order=[F.desc("heading"), F.desc("seq")])


@query(f"WITH {PARTS}, {direct('ring')}, s AS ({top('m')}) SELECT * FROM s WHERE seq % 2 = 0")
def search_plugins(spark, sf):
    return S.hooked(parts(spark, sf), "RING please", before=[lambda q: q.split()[0].lower()], after=[lambda rows: rows.where("seq % 2 = 0")])


@query("""WITH e AS (SELECT event_type || user_id AS key, max(event_id) AS used FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200)
SELECT key, used AS value FROM e WHERE starts_with(key, 'cl') ORDER BY used DESC""")
def recent_completions(spark, sf):
    e = table(spark, sf, "events").select(F.concat("event_type", F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("value"), F.col("event_id").alias("used"))
    return S.recent_completions(e, "cl", 200)
