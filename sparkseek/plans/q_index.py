"""Index, maintenance, log, agent and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkseek.operators import extract as E
from sparkseek.operators import index as I
from sparkseek.operators import logs as G
from sparkseek.plans.registry import DOCS, PARTS, query, values
from sparkseek.sources import corpus as C
from sparkseek.sources.corpus import documents, parts, table
from sparkseek.sources.files import file_documents
from sparkseek.sources.scratch import folder, is_folder
from sparkseek.streaming import live as V


_POSTINGS = """WITH {corpus}, w AS (SELECT seq, unnest(list_filter(string_split_regex(lower(body), '\\s+'), lambda t: length(t) >= 3)) AS term FROM d), f AS (SELECT seq, strip_accents(term) AS term FROM w WHERE strip_accents(term) <> term)
SELECT term, seq, count(*) AS tf FROM (SELECT * FROM w UNION ALL BY NAME SELECT * FROM f UNION ALL BY NAME SELECT seq, lower(label) AS term FROM d WHERE length(label) >= 2) GROUP BY term, seq"""


@query(_POSTINGS.format(corpus=PARTS))
def postings(spark, sf):
    return I.postings(parts(spark, sf))


@query(_POSTINGS.format(corpus=DOCS))
def postings_documents(spark, sf):
    return I.postings(documents(spark, sf))


@query(f"""WITH {PARTS} SELECT lower(label) AS term, seq, 2 AS tf FROM d WHERE lower(label) = 'brand#11'""")
def postings_lookup(spark, sf):
    path = folder(spark)
    I.save(parts(spark, sf), path, buckets=4)
    return I.lookup(spark, path, "brand#11")


@query(f"WITH {DOCS} SELECT term, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(body), '\\s+')) AS term FROM d) WHERE length(term) >= 2 GROUP BY term")
def doc_freq(spark, sf):
    return I.frequencies(documents(spark, sf))


_FIELD = " UNION ALL ".join(f"SELECT '{f}' AS field, unnest(string_split_regex(lower({f}), '\\s+')) AS term FROM d" for f in I.FIELDS)


@query(f"WITH {PARTS} SELECT field, term, count(*) AS n FROM ({_FIELD}) WHERE length(term) >= 2 GROUP BY field, term")
def field_doc_freq(spark, sf):
    return I.occurrences(parts(spark, sf))


_INSPECT = """WITH {corpus}, p AS (SELECT DISTINCT substr(h, 1, i) AS p FROM (SELECT h, unnest(range(1, length(h) + 1)) AS i FROM (SELECT lower(heading) AS h FROM d UNION SELECT strip_accents(lower(heading)) FROM d))),
w AS (SELECT unnest(list_filter(string_split_regex(lower(body), '\\s+'), lambda t: length(t) >= 3)) AS term FROM d),
k AS (SELECT DISTINCT term FROM (SELECT term FROM w UNION ALL SELECT strip_accents(term) FROM w UNION ALL SELECT lower(label) FROM d WHERE length(label) >= 2))
SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(*) FROM k) + (SELECT count(*) FROM p WHERE length(p) >= 2) AS terms, (SELECT count(*) FROM p) + 1 AS trie_nodes, 1 AS version"""


@query(_INSPECT.format(corpus=PARTS))
def index_inspect(spark, sf):
    return I.inspect(parts(spark, sf))


@query(_INSPECT.format(corpus=DOCS))
def index_inspect_documents(spark, sf):
    return I.inspect(documents(spark, sf))


@query(f"WITH {DOCS}, t AS (SELECT unnest(['section','action','field','link','file','media','structured']) AS type) SELECT t.type, count(d.seq) AS n FROM t LEFT JOIN d ON d.type = t.type GROUP BY t.type")
def facets(spark, sf):
    return I.facets(documents(spark, sf))


@query(f"""WITH {DOCS} SELECT count(*) AS "all", count(*) FILTER (type IN ('section','structured')) AS pages, count(*) FILTER (type IN ('action','field')) AS actions, count(*) FILTER (type = 'file') AS files, count(*) FILTER (type IN ('link','media')) AS links FROM d""")
def badges(spark, sf):
    return I.badges(documents(spark, sf))


_TWO = "a AS (SELECT seq, id, heading FROM d WHERE seq % 3 <> 0), b AS (SELECT seq, id, upper(heading) AS heading FROM d WHERE seq % 2 = 0), u AS (SELECT 0 AS src, * FROM a UNION ALL SELECT 1, * FROM b)"


def _merge(order: str) -> str:
    return f"""WITH {PARTS}, {_TWO}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src {order}, seq {order}) AS k, min((src, seq)) OVER (PARTITION BY id) AS p FROM u)
SELECT seq, id, heading, p[1] AS place_src, p[2] AS place_seq FROM r WHERE k = 1"""


def _merged(spark, sf, prefer):
    rows = parts(spark, sf).select("seq", "id", "heading")
    out = I.merged([rows.where("seq % 3 <> 0"), rows.where("seq % 2 = 0").withColumn("heading", F.upper("heading"))], prefer)
    return out.select("seq", "id", "heading", F.col("place.src").alias("place_src"), F.col("place.seq").alias("place_seq"))


@query(_merge("ASC"))
def merge_first(spark, sf):
    return _merged(spark, sf, "first")


@query(_merge("DESC"))
def merge_last(spark, sf):
    return _merged(spark, sf, "last")


@query(f"WITH {PARTS} SELECT seq, id FROM d WHERE NOT (seq % 10 = 0)")
def index_remove(spark, sf):
    rows = parts(spark, sf)
    return I.removed(rows, rows.where("seq % 10 = 0").select("id")).select("seq", "id")


@query(f"""WITH {PARTS}, c AS (SELECT (SELECT max(seq) FROM d) + row_number() OVER (ORDER BY seq) AS seq, id, 'new ' || heading AS heading FROM d WHERE seq % 100 = 1)
SELECT seq, id, heading FROM d WHERE seq % 100 <> 1 UNION ALL SELECT * FROM c""")
def index_update(spark, sf):
    rows = parts(spark, sf).select("seq", "id", "heading")
    return I.updated(rows, rows.where("seq % 100 = 1").withColumn("heading", F.concat(F.lit("new "), "heading")))


@query(f"WITH {PARTS} SELECT seq, id FROM d UNION ALL SELECT seq + (SELECT max(seq) + 1 FROM d), id FROM d WHERE seq < 50")
def index_add(spark, sf):
    rows = parts(spark, sf).select("seq", "id")
    return I.added(rows, rows.where("seq < 50"))


_META = """o AS (SELECT page_id, url, 'e' || page_id AS etag, md5(html) AS content_hash FROM pages WHERE page_id % 11 <> 0),
n AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 'e' || page_id ELSE 'x' END AS etag, CASE WHEN page_id % 5 = 0 THEN md5(html) ELSE 'y' || page_id END AS content_hash FROM pages WHERE page_id % 7 <> 0)"""


@query(f"""WITH {_META} SELECT coalesce('/p/' || o.page_id, '/p/' || n.page_id) AS url, CASE WHEN o.url IS NULL THEN 'add' WHEN n.url IS NULL THEN 'drop' WHEN o.etag = n.etag OR o.content_hash = n.content_hash THEN 'keep' ELSE 'fetch' END AS action FROM o FULL JOIN n USING (page_id)""")
def incremental_diff(spark, sf):
    p = table(spark, sf, "pages").withColumn("url", F.concat(F.lit("/p/"), F.col("page_id").cast("string")))
    tag = F.concat(F.lit("e"), F.col("page_id").cast("string"))
    old = p.where("page_id % 11 <> 0").select("url", tag.alias("etag"), F.md5("html").alias("content_hash"))
    new = p.where("page_id % 7 <> 0").select("url", F.when(F.col("page_id") % 3 == 0, tag).otherwise("x").alias("etag"), F.when(F.col("page_id") % 5 == 0, F.md5("html")).otherwise(F.concat(F.lit("y"), F.col("page_id").cast("string"))).alias("content_hash"))
    return I.refreshed(old, new)


@query("SELECT event_id FROM events WHERE epoch_ms(TIMESTAMP '2024-01-20 00:00:00') - epoch_ms(ts) <= 864000 * 1000")
def cache_ttl(spark, sf):
    rows = table(spark, sf, "events").withColumn("timestamp", F.unix_millis(F.col("ts").cast("timestamp")))
    return I.fresh(rows, F.unix_millis(F.lit("2024-01-20 00:00:00").cast("timestamp")), 864_000).select("event_id")


@query(f"WITH {PARTS}, f AS (SELECT term, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(body), '\\s+')) AS term FROM d) WHERE length(term) >= 2 GROUP BY term) SELECT term, n AS body, floor(n * 0.3::DOUBLE)::BIGINT AS heading, floor(n * 0.1::DOUBLE)::BIGINT AS label, floor(n * 0.1::DOUBLE)::BIGINT AS breadcrumb FROM f")
def migration_df(spark, sf):
    return I.migrated(I.frequencies(parts(spark, sf)))


@query(f"WITH {PARTS} SELECT seq, id, heading, body FROM d")
def serialize_roundtrip(spark, sf):
    rows = parts(spark, sf).select("seq", "id", "heading", "body")
    return I.deserialized(I.serialized(rows), "seq long, id string, heading string, body string")


@query(f"WITH {PARTS} SELECT seq, id, heading, type FROM d")
def save_load(spark, sf):
    path = folder(spark)
    I.save(parts(spark, sf), path, buckets=4)
    return I.load(spark, path).select("seq", "id", "heading", "type")


@query(f"WITH {PARTS} SELECT seq, ((row_number() OVER (ORDER BY seq) - 1) // ceil((SELECT count(*) FROM d) / 7e0)::BIGINT)::INT AS shard FROM d")
def shard_array(spark, sf):
    return I.shards(parts(spark, sf), 7)


#: Answers of a content system, one for each supplier: an array, an object with records, another object, an empty array.
_ENTRY = """concat('{"id":"', cast(s_suppkey AS string), '","url":"/s","heading":"', s_name, '"}')"""
_PAYLOAD = f"""CASE s_suppkey % 4 WHEN 0 THEN concat('[', {_ENTRY}, ',', {_ENTRY}, ']') WHEN 1 THEN concat('{{"records":[', {_ENTRY}, ']}}') WHEN 2 THEN '{{"other":1}}' ELSE '[]' END"""


@query("SELECT s_suppkey::VARCHAR AS id, s_name AS heading FROM supplier WHERE s_suppkey % 4 IN (0, 1) UNION ALL SELECT s_suppkey::VARCHAR, s_name FROM supplier WHERE s_suppkey % 4 = 0")
def cms_source(spark, sf):
    return C.cms(table(spark, sf, "supplier").selectExpr(f"{_PAYLOAD} AS payload")).select("id", "heading")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS seq, CASE WHEN n_nationkey % 2 = 0 THEN 'n' || n_nationkey ELSE 'mock-' || (row_number() OVER (ORDER BY n_nationkey) - 1) END AS id, '/' AS url, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS heading, 'section' AS type FROM nation")
def mock_records(spark, sf):
    """Records of the nations, every second one with defaults alone."""
    rows = table(spark, sf, "nation").orderBy("n_nationkey").collect()
    return C.mock(spark, [{} if r.n_nationkey % 2 else {"id": f"n{r.n_nationkey}", "heading": r.n_name} for r in rows]).select("seq", "id", "url", "heading", "type")


_A = "SELECT p_partkey AS id, round(p_retailprice / 1000, 4) AS score FROM part WHERE p_partkey % 2 = 0"
_B = "SELECT p_partkey AS id, round(p_size / 50e0, 4) AS score FROM part WHERE p_partkey % 3 = 0"


@query(f'SELECT id, a.score AS "first", b.score AS "second" FROM ({_A}) a FULL JOIN ({_B}) b USING (id)')
def relevance_compare(spark, sf):
    p = table(spark, sf, "part")
    return G.compare(p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.round(F.col("p_retailprice") / 1000, 4).alias("score")), p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.round(F.col("p_size") / 50, 4).alias("score")))


@query("WITH l AS (SELECT event_id AS pos, event_type AS query FROM events ORDER BY event_id DESC LIMIT 100) SELECT query, count(*) AS n FROM l GROUP BY query ORDER BY n DESC, min(pos) LIMIT 3")
def popular_queries(spark, sf):
    return G.popular_queries(table(spark, sf, "events").select(F.col("event_id").alias("at"), F.col("event_type").alias("query")), 3)


@query("SELECT lower(event_type) AS query, user_id AS record_id, count(*) AS count FROM events WHERE event_type <> 'error' GROUP BY 1, 2")
def click_popularity(spark, sf):
    rows = table(spark, sf, "events").where("event_type <> 'error'").select(F.concat(F.lit(" "), F.upper("event_type")).alias("query"), F.col("user_id").alias("record_id"))
    return G.click_popularity(rows)


_HIST = "e AS (SELECT event_type || '-' || user_id % 20 AS query, event_id AS ts, user_id % 7 = 0 AND event_type = 'purchase' AS pinned FROM events), h AS (SELECT query, max(ts) AS ts, bool_or(pinned) AS pinned FROM e GROUP BY query ORDER BY pinned DESC, ts DESC, query LIMIT 50)"


def _entries(spark, sf):
    return table(spark, sf, "events").select(F.concat("event_type", F.lit("-"), (F.col("user_id") % 20).cast("string")).alias("query"), F.col("event_id").alias("ts"), ((F.col("user_id") % 7 == 0) & (F.col("event_type") == "purchase")).alias("pinned"))


@query(f"WITH {_HIST} SELECT * FROM h")
def history_dedup(spark, sf):
    return G.history(_entries(spark, sf))


@query(f"WITH {_HIST} SELECT query FROM h WHERE starts_with(lower(query), 'pur') ORDER BY pinned DESC, ts DESC, query LIMIT 8")
def history_suggest(spark, sf):
    return G.history_suggestions(_entries(spark, sf), "PUR")


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
SELECT user_id, min(ts)::VARCHAR AS "start", (max(ts) + INTERVAL 6 HOUR)::VARCHAR AS "end", count(*) AS n, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM s GROUP BY user_id, s""")
def debounce_sessions(spark, sf):
    out = G.debounced(_utc(table(spark, sf, "events")), "6 hours")
    return out.select("user_id", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "n", "kinds")


def _utc(events):
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


#: Events of a user in order, each with the admitted times before it that still count.
_ADMITTED = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, n, event_id, ms, [ms] AS times, true AS ok FROM e WHERE n = 1
UNION ALL SELECT user_id, n, event_id, ms, CASE WHEN len(kept) < 2 THEN kept || [ms] ELSE kept END, len(kept) < 2
  FROM (SELECT e.*, list_filter(r.times, lambda t: t > e.ms - 86400000) AS kept FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))"""


@query(_ADMITTED + " SELECT event_id, len(times) AS recent FROM r WHERE ok")
def rescan_rate_limit(spark, sf):
    return G.rate_limited(_utc(table(spark, sf, "events")), 2, 86_400, order=["event_id"]).select("event_id", "recent")


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation UNION SELECT n_nationkey, (n_nationkey * 5 + 11) % 25 FROM nation WHERE n_nationkey % 4 = 0),
r AS (SELECT 1 AS n, 0 AS depth UNION SELECT b, depth + 1 FROM r JOIN e ON a = n WHERE depth < 26) SELECT n::VARCHAR AS url, min(depth) AS depth FROM r GROUP BY n""")
def graph_reachable(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    edges = n.select("k", ((F.col("k") * 7 + 3) % 25).alias("t")).union(n.where("k % 4 = 0").select("k", (F.col("k") * 5 + 11) % 25))
    edges = edges.select(F.col("k").cast("string").alias("from_url"), F.col("t").cast("string").alias("to_url")).distinct()
    return E.frontier(spark.createDataFrame([("1",)], "url string"), edges)


#: A step for each part; some lack what their action needs.
_STEPS = """p_brand AS workflow, p_partkey AS step, CASE p_size % 6 WHEN 0 THEN 'click' WHEN 1 THEN 'type' WHEN 2 THEN 'navigate' WHEN 3 THEN 'wait' WHEN 4 THEN 'submit' END AS action|CASE WHEN p_partkey % 2 = 0 THEN '#a' END AS selector|
CASE WHEN p_partkey % 5 = 0 THEN 'r1' END AS record_id|CASE WHEN p_partkey % 3 = 0 THEN p_name END AS value|CASE WHEN p_partkey % 7 < 3 THEN '/u' END AS url|CASE WHEN p_partkey % 4 = 0 THEN 0 END AS timeout"""
_SAID = "'Step ' || step || ' (' || action || '): missing '"


@query(f"""WITH t AS (SELECT {_STEPS.replace('|', ', ')} FROM part)
SELECT workflow, step, 'Step ' || step || ': missing "action"' AS error FROM t WHERE action IS NULL
UNION ALL SELECT workflow, step, {_SAID} || '"selector" or "recordId"' FROM t WHERE action IN ('click', 'type', 'submit') AND selector IS NULL AND record_id IS NULL
UNION ALL SELECT workflow, step, {_SAID} || '"value"' FROM t WHERE action = 'type' AND value IS NULL
UNION ALL SELECT workflow, step, {_SAID} || '"url"' FROM t WHERE action = 'navigate' AND url IS NULL
UNION ALL SELECT workflow, step, {_SAID} || '"timeout"' FROM t WHERE action = 'wait' AND timeout IS NULL""")
def workflow_validate(spark, sf):
    head, *rest = _STEPS.split("|")
    return G.workflow_errors(table(spark, sf, "part").selectExpr(*head.split(", ", 2), *rest))


@query("""SELECT c_custkey, step, action, selector, CASE step WHEN 1 THEN c_name WHEN 2 THEN '{{password}}' END AS value
FROM customer, (VALUES (1, 'type', '[name="username"]'), (2, 'type', '[name="password"]'), (3, 'submit', 'form')) t(step, action, selector)""")
def workflow_template(spark, sf):
    """The login of every customer."""
    return G.filled(table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("username")), "login", ["username"]).drop("username")


@query("SELECT n_nationkey AS step, n_name AS action, r AS round FROM nation, (SELECT unnest(range(1, 4)) AS r)")
def workflow_repeat(spark, sf):
    return G.repeated(table(spark, sf, "nation").select(F.col("n_nationkey").alias("step"), F.col("n_name").alias("action")), 3)


_RECORD = "SELECT seq, id, url, heading, body, type, label, CASE WHEN seq % 5 = 0 THEN '#s' || seq END AS selector, seq % 14 = 1 AS destructive FROM d"


def _agents(spark, sf):
    return documents(spark, sf).withColumn("selector", F.when(F.col("seq") % 5 == 0, F.concat(F.lit("#s"), F.col("seq").cast("string")))).withColumn("destructive", F.col("seq") % 14 == 1)


@query(f"""WITH {DOCS}, r AS ({_RECORD}), q AS (SELECT 'doc-' || (doc_id * 3) AS id, CASE doc_id % 2 WHEN 0 THEN 'act' ELSE 'fill' END AS kind FROM documents)
SELECT id, kind, reason IS NULL AS success, reason FROM (SELECT q.id, kind, CASE WHEN r.id IS NULL THEN 'not-found' WHEN kind = 'act' THEN CASE WHEN type = 'action' AND destructive THEN 'blocked-destructive' END WHEN type <> 'field' THEN 'not-a-field' WHEN coalesce(selector, '') = '' THEN 'no-selector' END AS reason FROM q LEFT JOIN r ON r.id = q.id)""")
def act_gating(spark, sf):
    requests = table(spark, sf, "documents").select(F.concat(F.lit("doc-"), (F.col("doc_id") * 3).cast("string")).alias("id"), F.when(F.col("doc_id") % 2 == 0, "act").otherwise("fill").alias("kind"))
    return G.gate(requests, _agents(spark, sf))


@query(f"WITH {DOCS}, r AS ({_RECORD}) SELECT id, type, coalesce(nullif(heading, ''), nullif(label, ''), id) AS name, coalesce(body, '') AS description, selector FROM r WHERE type IN ('action', 'field')")
def agent_tools(spark, sf):
    return G.agent_tools(_agents(spark, sf))


@query(f"WITH {DOCS} SELECT seq, id FROM d WHERE type IN ('action', 'field') AND (contains(lower(heading), 'th') OR contains(lower(coalesce(label, '')), 'th')) ORDER BY seq LIMIT 1")
def find_actionable(spark, sf):
    return G.actionable(documents(spark, sf), "TH").select("seq", "id")


_TOOLS = [*G.TOOLS, "jump"]
_CALLS = f"""c AS (SELECT doc_id AS id, ({_TOOLS})[doc_id % 8 + 1] AS tool, doc_id % 2 = 0 AS has_selector, doc_id % 3 = 0 AS has_value, doc_id % 5 = 0 AS has_url, CASE WHEN doc_id % 14 = 0 THEN 'soon' WHEN doc_id % 7 = 0 THEN '5' END AS quiet FROM documents)"""


@query(f"""WITH {_CALLS} SELECT id, 'unknown tool: jump' AS error FROM c WHERE tool = 'jump' UNION ALL SELECT id, tool || ': missing selector' FROM c WHERE tool IN ('click', 'type', 'extractText') AND NOT has_selector
UNION ALL SELECT id, 'type: missing value' FROM c WHERE tool = 'type' AND NOT has_value UNION ALL SELECT id, 'navigate: missing url' FROM c WHERE tool = 'navigate' AND NOT has_url
UNION ALL SELECT id, 'waitForStable: quietMs is no number' FROM c WHERE tool = 'waitForStable' AND quiet = 'soon'""")
def tool_call_errors(spark, sf):
    k = F.col("doc_id")
    given = [("selector", k % 2 == 0, "#a"), ("value", k % 3 == 0, "v"), ("url", k % 5 == 0, "/u"), ("quietMs", k % 14 == 0, "soon"), ("quietMs", (k % 14 != 0) & (k % 7 == 0), "5")]
    pairs = F.filter(F.array(*[F.when(c, F.struct(F.lit(n).alias("k"), F.lit(v).alias("v"))) for n, c, v in given]), lambda p: p.isNotNull())
    calls = table(spark, sf, "documents").select(k.alias("id"), F.element_at(F.array(*map(F.lit, _TOOLS)), (k % 8 + 1).cast("int")).alias("tool"), F.map_from_entries(pairs).alias("arguments"))
    return G.tool_errors(calls)


_MANIFEST = "SELECT seq, type, heading, CASE WHEN p_size > 45 THEN 'input[name=\"card\"]' WHEN p_size > 25 THEN '#s' || p_size END AS selector, url FROM (SELECT d.*, p_size FROM d JOIN part ON p_partkey = seq)"


@query(f"""WITH {PARTS}, r AS ({_MANIFEST}), k AS (SELECT *, coalesce(nullif(selector, ''), url) AS target FROM r WHERE NOT regexp_matches(coalesce(selector, ''), '(?i)password|card|ssn|social-security|cc-'))
SELECT max(seq) AS seq, type, heading, min(seq) AS place FROM k GROUP BY type, heading, target""")
def manifest_dedup(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("seq"), "p_size")
    rows = parts(spark, sf).join(p, "seq").withColumn("selector", F.when(F.col("p_size") > 45, 'input[name="card"]').when(F.col("p_size") > 25, F.concat(F.lit("#s"), F.col("p_size").cast("string"))))
    return G.manifest(rows.select("seq", "type", "heading", "selector", "url")).select("seq", "type", "heading", F.col("place.seq").alias("place"))


@query(f"WITH {PARTS} SELECT label, breadcrumb AS kind, max(seq) AS seq, min(seq) AS place FROM d GROUP BY label, breadcrumb")
def pagination_merge(spark, sf):
    rows = G.latest_by(parts(spark, sf).select("seq", "label", F.col("breadcrumb").alias("kind")), ["label", "kind"], ["seq"])
    return rows.select("label", "kind", "seq", F.col("place.seq").alias("place"))


def _streamed(spark, sf, plan):
    """Run a streaming plan over the events table as one available-now stream into a folder, and read that."""
    path, to = f"{sf}/events.parquet", folder(spark)
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if is_folder(spark, path) else f"{sf}/events*.parquet")
    out = plan(source.withColumn("ts", F.col("ts").cast("timestamp")))
    run = out.writeStream.format("parquet").option("path", f"{to}/rows").outputMode("append").option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{to}/rows")


@query("""WITH w AS (SELECT date_trunc('hour', ts) AS w, event_type AS query FROM events WHERE ts IS NOT NULL), m AS (SELECT max(ts) AS last FROM events)
SELECT w::VARCHAR AS "start", query, count(*) AS n FROM w, m WHERE w + INTERVAL 1 HOUR <= last - INTERVAL 2 HOUR GROUP BY w, query""")
def stream_query_counts(spark, sf):
    out = _streamed(spark, sf, lambda s: V.query_counts(s.select("ts", F.col("event_type").alias("query"))))
    return out.select(F.col("start").cast("string").alias("start"), "query", "n")


@query(_ADMITTED + " SELECT user_id::VARCHAR AS url, ms FROM r WHERE ok")
def stream_rescans(spark, sf):
    return _streamed(spark, sf, lambda s: V.rescans(s.select(F.col("user_id").cast("string").alias("url"), "ts"), 2, 86_400))


@query("SELECT 'query' AS type, event_type AS query, count(*) AS n FROM events WHERE trim(event_type) <> '' GROUP BY event_type")
def analytics_counts(spark, sf):
    rows = table(spark, sf, "events").where(F.trim("event_type") != "")
    return rows.groupBy(F.lit("query").alias("type"), F.trim("event_type").alias("query")).agg(F.count("*").alias("n"))


@query("SELECT count(*) + 1 AS lines, 1 AS heads FROM part")
def static_export(spark, sf):
    path = folder(spark)
    I.static_export(parts(spark, sf).select("seq", "id", "heading"), path, "hugo")
    lines = spark.read.option("wholetext", False).text(path)
    return lines.agg((F.count_if(F.col("value").startswith("{")) + F.count_if(F.col("value") == "search_index: true")).alias("lines"), F.count_if(F.col("value") == "search_index: true").alias("heads"))


@query(f"""WITH {PARTS}, r AS (SELECT *, label AS page FROM ({_MANIFEST.replace('seq, type', 'seq, label, type')})), k AS (SELECT DISTINCT page, type, heading, coalesce(nullif(selector, ''), url) AS target FROM r WHERE NOT regexp_matches(coalesce(selector, ''), '(?i)password|card|ssn|social-security|cc-') AND NOT contains(coalesce(selector, ''), 's30'))
SELECT page, count(*) AS records, (SELECT count(*) FROM k WHERE k.page = r.page) AS kept, count(*) - (SELECT count(*) FROM k WHERE k.page = r.page) AS excluded FROM r GROUP BY page""")
def manifest_counts(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("seq"), "p_size")
    rows = parts(spark, sf).join(p, "seq").withColumn("selector", F.when(F.col("p_size") > 45, 'input[name="card"]').when(F.col("p_size") > 25, F.concat(F.lit("#s"), F.col("p_size").cast("string"))))
    return G.manifest_counts(rows.select("seq", "type", "heading", "selector", "url", "label"), "label", exclude=["s30"])


@query("SELECT seq, type, score * CASE type WHEN 'file' THEN 0.5::DOUBLE WHEN 'media' THEN 0 ELSE 1 END AS score FROM (SELECT doc_id AS seq, (['section','action','field','link','file','media','structured'])[doc_id % 7 + 1] AS type, n_chars / 1000e0 AS score FROM documents)")
def relevance_weights(spark, sf):
    sizes = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), (F.col("n_chars") / 1000).alias("score"))
    return G.reweighted(documents(spark, sf).join(sizes, "seq").select("seq", "type", "score"), {"file": 0.5, "media": -1.0})


@query("SELECT p_brand AS workflow, '{\"version\":1,\"steps\":[' || string_agg('{\"action\":\"' || p_type || '\",\"selector\":\"#' || p_size || '\"}', ',' ORDER BY p_partkey) || ']}' AS json FROM part GROUP BY p_brand")
def workflow_exported(spark, sf):
    steps = table(spark, sf, "part").select(F.col("p_brand").alias("workflow"), F.col("p_partkey").alias("step"), F.col("p_type").alias("action"), F.concat(F.lit("#"), F.col("p_size").cast("string")).alias("selector"))
    return G.exported(steps)


@query("SELECT p_partkey AS id, unnest(CASE WHEN p_size > 25 THEN ['type', 'submit'] ELSE ['wait'] END) AS action, unnest(CASE WHEN p_size > 25 THEN [1, 2] ELSE [1] END) AS step FROM part")
def workflow_conditional(spark, sf):
    then = spark.createDataFrame([(1, "type"), (2, "submit")], "step int, action string")
    return G.conditional(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size"), F.col("p_size") > 25, then, spark.createDataFrame([(1, "wait")], "step int, action string")).select("id", "action", "step")


@query("SELECT part, step, action FROM (SELECT 0 AS part, n_nationkey AS step, n_name AS action FROM nation UNION ALL SELECT 1, r_regionkey, r_name FROM region)")
def workflow_composed(spark, sf):
    steps = lambda t, k, v: table(spark, sf, t).select(F.col(k).alias("step"), F.col(v).alias("action"))
    return G.composed(steps("nation", "n_nationkey", "n_name"), steps("region", "r_regionkey", "r_name"))


@query("SELECT s_suppkey, name, steps FROM supplier, (VALUES ('login', 3), ('search', 2), ('form-filling', 2)) t(name, steps)")
def workflow_templates(spark, sf):
    """How many steps each template takes for each supplier."""
    out = None
    for name in G.TEMPLATES:
        rows = G.filled(table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("query")), name, ["query"])
        rows = rows.groupBy("s_suppkey").agg(F.count("*").cast("int").alias("steps")).withColumn("name", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT 'txt' AS type, string_agg(r_name, chr(10) ORDER BY r_regionkey) || chr(10) AS text FROM region")
def document_files(spark, sf):
    path = folder(spark)
    table(spark, sf, "region").orderBy("r_regionkey").coalesce(1).select(F.col("r_name").alias("value")).write.text(path)
    return file_documents(spark, path).select("type", "text")


@query(_POSTINGS.format(corpus=PARTS))
def serialize_index(spark, sf):
    path = folder(spark)
    I.save(parts(spark, sf), path, buckets=4)
    rows = I.restored_index(I.serialized_index(spark, path), "postings", "term string, seq long, tf long, words int, label boolean")
    return rows.where("tf > 0").select("term", "seq", "tf")


@query(f"WITH {PARTS} SELECT seq, id, heading FROM d")
def static_export_rows(spark, sf):
    path = folder(spark)
    I.static_export(parts(spark, sf).select("seq", "id", "heading"), path, "jekyll")
    return I.deserialized(spark.read.text(path).where(F.col("value").startswith("{")).withColumnRenamed("value", "json"), "seq long, id string, heading string")
