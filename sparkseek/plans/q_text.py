"""Text, URL and HTML queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkseek.functions import text as X
from sparkseek.functions import urls as U
from sparkseek.operators import extract as E
from sparkseek.operators import logs as G
from sparkseek.operators import search as S
from sparkseek.plans.registry import query, values
from sparkseek.plans import querylang as L
from sparkseek.sources.corpus import documents, table
from sparkseek.sources.files import is_document
from sparkseek.sources.scratch import folder

_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_TOKENS = f"list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '' AND NOT list_contains([{_STOP}], t))"
_STEM = "CASE WHEN length(t) <= 2 THEN t WHEN ends_with(t, 'ing') THEN t[:-4] WHEN ends_with(t, 'ed') THEN t[:-3] WHEN ends_with(t, 'es') AND length(t) > 3 THEN t[:-3] WHEN ends_with(t, 's') AND length(t) > 3 THEN t[:-2] ELSE t END"


@query(f"SELECT doc_id, len({_TOKENS}) AS n, array_to_string({_TOKENS}, ' ') AS tokens FROM documents")
def tokenize(spark, sf):
    tokens = X.tokenize(F.col("text"), stemmed=False)
    return table(spark, sf, "documents").select("doc_id", F.size(tokens).alias("n"), F.array_join(tokens, " ").alias("tokens"))


@query(f"SELECT doc_id, array_to_string(list_transform({_TOKENS}, lambda t: {_STEM}), ' ') AS stems FROM documents")
def stem(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.tokenize(F.col("text")), " ").alias("stems"))


_LANG = {k: " + ".join(f"regexp_matches(t, '(^|[^A-Za-z0-9_]){w}([^A-Za-z0-9_]|$)')::INT" for w in ws) for k, ws in X.LANGUAGE_WORDS.items()}
_DETECT = "c AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _LANG.items()) + """ FROM (SELECT *, lower(text) AS t FROM documents)),
l AS (SELECT *, CASE greatest(en, es, fr, de) WHEN 0 THEN 'en' WHEN en THEN 'en' WHEN es THEN 'es' WHEN fr THEN 'fr' ELSE 'de' END AS found FROM c)"""


@query(f"WITH {_DETECT} SELECT doc_id, found FROM l")
def lang_detect(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.detect_language(F.col("text")).alias("found"))


_STOPS = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in ws)}]" for k, ws in X.LANGUAGE_WORDS.items())


@query(f"""WITH {_DETECT}, s AS (SELECT doc_id, t, CASE found {_STOPS} END AS stop FROM l)
SELECT doc_id, array_to_string(list_filter(string_split_regex(t, '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1 AND NOT list_contains(stop, w)), ' ') AS tokens FROM s""")
def lang_tokenize(spark, sf):
    rows = table(spark, sf, "documents").withColumn("lang_found", X.detect_language(F.col("text")))
    return rows.select("doc_id", F.array_join(X.tokenize_language(F.col("text"), F.col("lang_found")), " ").alias("tokens"))


@query("SELECT doc_id, strip_accents(text) AS folded FROM documents")
def fold_accents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.fold(F.col("text")).alias("folded"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*(>|$)', '', 'g'), '\s+', ' ', 'g')) AS plain FROM pages")
def strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.strip_tags(F.col("html")).alias("plain"))


_WORDS = [("Robert",), ("Ashcraft",), ("Tymczak",), ("Pfister",), ("o'Hara",), ("123",), ("",), ("Jackson",)]
_CODES = " ".join(f"WHEN contains('{g}', ch) THEN '{d}'" for d, g in X.SOUNDEX.items())


_SOUNDEX = f"""w(word) AS ({values(_WORDS)} UNION ALL SELECT DISTINCT p_name FROM part), u AS (SELECT word, regexp_replace(upper(word), '[^A-Z]', '', 'g') AS u FROM w),
c AS (SELECT word, u, list_transform(string_split(u, ''), lambda ch: CASE {_CODES} ELSE '' END) AS c FROM u),
k AS (SELECT word, u, array_to_string(list_transform(range(2, len(c) + 1), lambda i: CASE WHEN c[i] <> '' AND c[i] <> c[i - 1] THEN c[i] ELSE '' END), '') AS k FROM c),
s AS (SELECT word, CASE WHEN u = '' THEN '' ELSE rpad(substr(u[1] || k, 1, 4), 4, '0') END AS code FROM k)"""


@query(f"WITH {_SOUNDEX} SELECT * FROM s")
def soundex(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("word")).distinct()
    return spark.createDataFrame(_WORDS, "word string").unionByName(names).select("word", X.soundex(F.col("word")).alias("code"))


@query("""WITH c AS (SELECT p_partkey, list_transform(string_split(p_name, ''), lambda ch: ascii(ch)::BIGINT) AS c FROM part),
h AS (SELECT p_partkey, abs(list_reduce(c, lambda h, x: (((h * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648, 0::BIGINT)) AS h FROM c)
SELECT p_partkey, h AS decimal_hash FROM h""")
def version_hash(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", X.poly_hash(F.col("p_name")).alias("b36"))
    return rows.select("p_partkey", F.conv("b36", 36, 10).cast("long").alias("decimal_hash"))


_LABEL = "CASE p_size % 6 WHEN 0 THEN concat('DELETE ', p_name) WHEN 1 THEN 'Pay now' WHEN 2 THEN concat('Cancel ', p_name) WHEN 3 THEN 'Cancel Subscription' WHEN 4 THEN '' ELSE p_type END"


@query(f"SELECT p_partkey, label, regexp_matches(lower(label), 'delete|remove|cancel subscription|unsubscribe|pay|checkout|submit order|confirm') AS destructive FROM (SELECT p_partkey, {_LABEL} AS label FROM part)")
def destructive(spark, sf):
    return E.with_destructive(table(spark, sf, "part").selectExpr("p_partkey", f"{_LABEL} AS label"), F.col("label"))


@query("SELECT doc_id, CASE doc_id % 7 WHEN 6 THEN 'Answer' ELSE (['Section','Action','Field','Link','File','Media'])[doc_id % 7 + 1] END AS shown FROM documents")
def type_labels(spark, sf):
    return documents(spark, sf).select(F.col("seq").alias("doc_id"), X.type_label(F.col("type")).alias("shown"))


@query("SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g') AS slug FROM documents")
def slugs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.slug(F.col("text")).alias("slug"))


@query("""WITH h AS (SELECT doc_id, abs(list_reduce(list_transform(string_split(text, ''), lambda ch: ascii(ch)::BIGINT), lambda h, x: (((h * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648, 0::BIGINT)) AS h FROM documents)
SELECT doc_id, h AS decimal_hash FROM h""")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.conv(X.poly_hash(F.col("text")), 36, 10).cast("long").alias("decimal_hash"))


@query(f"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '' AND NOT list_contains([{_STOP}], t)) AS t FROM documents),
f AS (SELECT doc_id, list_transform(t, lambda w: strip_accents(w)) AS t FROM t)
SELECT doc_id, array_to_string(list_filter(list_transform(t, lambda t: {_STEM}), lambda w: w <> ''), ' ') AS tokens FROM f""")
def token_pipeline(spark, sf):
    tokens = X.filtered_tokens(F.col("text"), [X.without(), X.fold, X.stem])
    return table(spark, sf, "documents").select("doc_id", F.array_join(tokens, " ").alias("tokens"))


@query("SELECT doc_id, substr(text, 1, 1200) AS preview FROM documents")
def preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 1200).alias("preview"))


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"
_PLAIN = r"trim(regexp_replace(regexp_replace({0}, '<[^>]*(>|$)', '', 'g'), '\s+', ' ', 'g'))"
#: Headings and the text after each, cut out by position.
_SECTIONS = f"""c AS (SELECT page_id, url, {_CLEAN} AS h FROM pages),
m AS (SELECT page_id, url, h, regexp_extract_all(h, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS tags, string_split_regex(h, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS texts FROM c),
u AS (SELECT page_id, url, i - 1 AS pos, tags[i] AS tag, texts[i + 1] AS after, list_transform(tags, lambda t: {_PLAIN.format("regexp_extract(t, '(?is)^<h[1-6][^>]*>(.*?)</h[1-6]>', 1)")}) AS names
  FROM (SELECT *, unnest(range(1, len(tags) + 1)) AS i FROM m)),
s AS (SELECT *, names[pos + 1] AS heading, regexp_extract(tag, '(?i)\\bid=["'']([^"'']+)["'']', 1) AS given FROM u)"""


@query(f"""WITH {_SECTIONS} SELECT page_id, pos, heading, CASE WHEN given <> '' THEN given ELSE regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g') END AS heading_id, {_PLAIN.format('after')} AS body FROM s""")
def sections(spark, sf):
    return E.sections(table(spark, sf, "pages")).select("page_id", "pos", "heading", "heading_id", "body")


#: A page for each part, in expressions that both engines read alike: headings, files, images and structured data.
_PART_URL = "concat('https://parts.example/docs/', cast(p_size AS string), '/', cast(p_partkey AS string), '.html')"
_PART_HTML = """concat('<h1>', p_name, ' <em>part</em></h1><p>First &amp; ', p_type, '</p><h2 id=''spec''>Size ', cast(p_size AS string), '</h2><p>of ', p_brand, '</p><section><h3>', p_type, '</h3>a<section><h4>Deep</h4>b</section></section><!-- <h1>not</h1> -->',
'<a href=''/files/', cast(p_partkey AS string), '.PDF''>Sheet of ', p_name, '</a><a href="b', cast(p_size AS string), '.zip?"></a><a href=''c.html''>page</a><a rel=''nofollow'' href=''d.csv#''>data</a><a href=''https://other.example/deck.pptx''><b>Deck</b></a>',
'<img src=x alt='' ', p_name, ' ''><img alt=''''><img src=''y''><IMG ALT="', p_type, '"><script>secret()</script>',
CASE p_partkey % 3 WHEN 0 THEN concat('<script type="application/ld+json">{"@type":"FAQPage","mainEntity":[{"name":"Why ', p_name, '?","acceptedAnswer":{"text":"', p_type, '"}},{"name":"No answer"},{"name":"Whose?","suggestedAnswer":{"text":"', p_brand, '"}}]}</script>')
WHEN 1 THEN concat('<script type="application/ld+json">[{"@type":"FAQPage","mainEntity":[{"name":"Size?","acceptedAnswer":{"text":"', cast(p_size AS string), '"}}]}]</script><script type="application/ld+json">{"@type":"Article","headline":"', p_name, '","description":"', p_type, '"}</script>')
ELSE concat('<script type="application/ld+json">{broken</script><script type="application/ld+json">{"@type":"Product","name":"', p_name, '"}</script><script type="application/ld+json">{"@graph":[]}</script>') END)"""
_PART_PAGES = f"pages AS (SELECT p_partkey AS page_id, {_PART_URL} AS url, {_PART_HTML} AS html FROM part)"


def _pages(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey AS page_id", f"{_PART_URL} AS url", f"{_PART_HTML} AS html")


@query(f"""WITH {_PART_PAGES}, {_SECTIONS} SELECT page_id, pos, heading, array_to_string(names[1:pos + 1], ' › ') AS breadcrumb, {_PLAIN.format('after')} AS body FROM s""")
def breadcrumb(spark, sf):
    return E.sections(_pages(spark, sf)).select("page_id", "pos", "heading", "breadcrumb", "body")


_ANCHORS = f"""a AS (SELECT page_id, url, i - 1 AS pos, l[i] AS a FROM (SELECT page_id, url, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a>') AS l FROM pages))),
b AS (SELECT page_id, url, pos, regexp_extract(a, '(?is)<a\\s([^>]*)>', 1) AS attrs, {_PLAIN.format("regexp_extract(a, '(?is)<a[^>]*>(.*?)</a>', 1)")} AS text FROM a),
h AS (SELECT *, regexp_extract(attrs, '(?i)(?:^|\\s)href=["'']([^"'']*)["'']', 1) AS href FROM b)"""


@query(f"""WITH {_ANCHORS} SELECT page_id, pos, href, text FROM h WHERE href <> '' AND href <> '#' AND NOT starts_with(href, 'javascript:') AND text <> '' AND NOT regexp_matches(lower(attrs), 'rel=["''][^"'']*nofollow')""")
def links(spark, sf):
    return E.links(table(spark, sf, "pages")).select("page_id", "pos", "href", "text")


@query(f"""WITH {_PART_PAGES}, {_ANCHORS}
SELECT page_id, pos, CASE WHEN text <> '' THEN text ELSE string_split(href, '/')[-1] END AS heading, CASE WHEN contains(href, '://') THEN href WHEN starts_with(href, '/') THEN 'https://parts.example' || href ELSE regexp_extract(url, '^.*/') || href END AS target
FROM h WHERE regexp_matches(lower(href), '\\.(pdf|doc|docx|xls|xlsx|ppt|pptx|zip|csv)[?#]?$')""")
def files(spark, sf):
    return E.files(_pages(spark, sf))


@query(f"""WITH {_PART_PAGES}, i AS (SELECT page_id, k - 1 AS pos, l[k] AS img FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '(?is)<img\\s[^>]*>') AS l FROM pages)))
SELECT * FROM (SELECT page_id, pos, trim(regexp_extract(img, '(?is)\\salt=["'']([^"'']*)["'']', 1)) AS heading FROM i) WHERE heading <> ''""")
def media_alt(spark, sf):
    return E.images(_pages(spark, sf))


_SCRIPTS = r"""s AS (SELECT page_id, i - 1 AS script, l[i] AS j FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM
  (SELECT page_id, regexp_extract_all(html, '(?is)<script[^>]*type=["'']application/ld\+json["''][^>]*>(.*?)</script>', 1) AS l FROM pages))),
v AS (SELECT page_id, script, j::JSON AS j FROM s WHERE json_valid(j))"""
_BLOCKS = f"{_PART_PAGES}, {_SCRIPTS}"


@query(f"""WITH {_BLOCKS}, e AS (SELECT page_id, script, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END) AS d FROM v),
q AS (SELECT page_id, script, n - 1 AS pos, l[n] AS q FROM (SELECT page_id, script, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT page_id, script, json_extract(d, '$.mainEntity[*]') AS l FROM e WHERE d->>'$."@type"' = 'FAQPage')))
SELECT page_id, script, pos, q->>'$.name' AS question, coalesce(q->>'$.acceptedAnswer.text', q->>'$.suggestedAnswer.text') AS answer FROM q WHERE coalesce(q->>'$.acceptedAnswer.text', q->>'$.suggestedAnswer.text') IS NOT NULL""")
def jsonld_faq(spark, sf):
    return E.faqs(_pages(spark, sf))


@query(f"""WITH {_BLOCKS} SELECT page_id, script, j->>'$."@type"' AS kind, coalesce(j->>'$.name', j->>'$.headline', '') AS name, coalesce(j->>'$.description', '') AS description,
trim(coalesce(j->>'$.name', j->>'$.headline', '') || ' ' || coalesce(j->>'$.description', '')) AS body FROM v WHERE json_type(j) = 'OBJECT' AND j->>'$."@type"' NOT IN ('FAQPage')""")
def jsonld_typed(spark, sf):
    return E.things(_pages(spark, sf))


#: Two pages for each customer, one with a form and one with media, and the records that they hold; @ stands for the name, ~ for the segment.
_FORMS = [
    (0, '<main>Area<form><label for="u">@</label><input id="u" name="user" value="me"><label>Mail <input type="email"></label><input type="hidden" name="h"><input placeholder="Phone"><textarea aria-label="Note">hi</textarea></form></main><button class="big red">Delete ~</button><button aria-label="Close" title="x">×</button><div role="button" data-testid="go">Go</div><input type="submit" aria-label="Send">'),
    (1, '<figure><img alt="@"><figcaption>Sleeps</figcaption></figure><video title="~"><track kind="captions" src="t.vtt"></video><details><summary>More</summary></details>'),
]
_DOM = [
    (0, "action", 0, "Delete ~", "", "Delete ~", "button.big.red"), (0, "action", 1, "Close", "", "Close", '[aria-label="Close"]'), (0, "action", 2, "Go", "", "Go", '[data-testid="go"]'), (0, "action", 3, "Send", "", "Send", '[aria-label="Send"]'),
    (0, "field", 0, "@", "Area@Mail hi", "@", "#u"), (0, "field", 1, "Mail", "Area@Mail hi", "Mail", "main > form > label:nth-child(2) > input"), (0, "field", 2, "Phone", "Area@Mail hi", "Phone", "main > form > input:nth-child(3)"), (0, "field", 3, "Note", "Area@Mail hi", "Note", '[aria-label="Note"]'),
    (1, "action", 0, "More", "", "More", "details > summary"), (1, "media", 0, "@", "", "@ Sleeps", "figure > img"), (1, "media", 1, "~", "", "~ [Transcript available: t.vtt]", "video"),
]


def _filled(c: str) -> str:
    return f"replace(replace({c}, '@', c_name), '~', c_mktsegment)"


@query(f"SELECT c_custkey * 2 + side AS page_id, type, pos, {_filled('heading')} AS heading, {_filled('breadcrumb')} AS breadcrumb, {_filled('body')} AS body, selector FROM ({values(_DOM)}) t(side, type, pos, heading, breadcrumb, body, selector), customer")
def dom_extract(spark, sf):
    pages = None
    for side, html in _FORMS:
        page = table(spark, sf, "customer").select((F.col("c_custkey") * 2 + side).alias("page_id"), F.concat(F.lit("/c"), F.col("c_custkey").cast("string")).alias("url"), F.lit(html).alias("html"), "c_name", "c_mktsegment")
        page = page.withColumn("html", F.expr(_filled("html"))).drop("c_name", "c_mktsegment")
        pages = page if pages is None else pages.union(page)
    rows = E.dom_records(pages)
    return rows.select("page_id", "type", "pos", "heading", "breadcrumb", "body", F.element_at("selectors", 1).alias("selector"))


_DROP = "|".join(U.TRACKING)


@query(f"""WITH u AS (SELECT page_id, regexp_replace(url, '/$', '') AS u FROM pages), p AS (SELECT page_id, regexp_extract(u, '^[^?#]*') AS p, list_filter(string_split(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^({_DROP})(=|$)') AND NOT regexp_matches(x, '^[^=]*=?$')) AS q, regexp_extract(u, '#.*$') AS t FROM u)
SELECT page_id, (CASE WHEN regexp_matches(p, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*$') THEN p || '/' ELSE p END) || (CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END) || t AS normal FROM p""")
def url_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.normalize(F.col("url")).alias("normal"))


#: References that a page may hold, by its number.
_REFERENCE = "CASE page_id % 9 WHEN 0 THEN 'sitemap.xml' WHEN 1 THEN '/docs/guide' WHEN 2 THEN 'https://other.com/page' WHEN 3 THEN '//cdn.example.com/script.js' WHEN 4 THEN '' WHEN 5 THEN '../up/./x?q=1#f' WHEN 6 THEN '?page=2' WHEN 7 THEN 'mailto:a@b.cd' END"


@query(f"""WITH r AS (SELECT page_id, url, {_REFERENCE} AS value, regexp_extract(url, '^[^?#]*') AS bare FROM pages),
b AS (SELECT *, regexp_extract(bare, '^[A-Za-z]+:') AS scheme, regexp_extract(bare, '^[^/]*//[^/]*') AS origin FROM r),
d AS (SELECT *, CASE WHEN bare = origin THEN '/' ELSE regexp_extract(substr(bare, length(origin) + 1), '^.*/') END AS dir FROM b)
SELECT page_id, value, CASE page_id % 9 WHEN 0 THEN origin || dir || value WHEN 1 THEN origin || value WHEN 3 THEN scheme || value WHEN 5 THEN origin || regexp_replace(dir, '[^/]+/$', '') || 'up/x?q=1#f' WHEN 6 THEN (CASE WHEN bare = origin THEN bare || '/' ELSE bare END) || value WHEN 2 THEN value WHEN 7 THEN value ELSE url END AS resolved FROM d""")
def url_resolve(spark, sf):
    rows = table(spark, sf, "pages").selectExpr("page_id", "url", f"{_REFERENCE} AS value")
    return rows.select("page_id", "value", U.resolve(F.col("value"), F.col("url")).alias("resolved"))


#: Sitemaps of the origins of the pages: one index that names another, which names three maps and the first again.
_SITES = """o AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') AS origin, page_id % 3 AS k FROM pages),
p AS (SELECT *, row_number() OVER (PARTITION BY origin, k ORDER BY page_id) - 1 AS pos FROM o)"""


def _maps(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*", 0).alias("origin"), (F.col("page_id") % 3).alias("k"))
    at = lambda name: F.concat("origin", F.lit(f"/{name}.xml"))
    index = lambda *names: F.concat(F.lit("<sitemapindex>"), *[F.concat(F.lit("<sitemap><loc>"), n, F.lit("</loc><lastmod>2020</lastmod></sitemap>")) for n in names], F.lit("</sitemapindex>"))
    origins = p.select("origin").distinct()
    tops = origins.select(at("map").alias("url"), index(F.lit("parts.xml")).alias("xml")).union(origins.select(at("parts").alias("url"), index(F.lit("s0.xml"), at("s1"), F.lit("/s2.xml"), F.lit("map.xml")).alias("xml")))
    locs = p.groupBy("origin", "k").agg(F.sort_array(F.collect_list(F.struct("page_id", "url"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: F.concat(F.lit("<url><loc> "), x["url"], F.lit(" </loc></url>"))), "")
    return tops.union(locs.select(F.concat("origin", F.lit("/s"), F.col("k").cast("string"), F.lit(".xml")).alias("url"), F.concat(F.lit("<urlset>"), body, F.lit("</urlset>")).alias("xml")))


@query(f"WITH {_SITES}, m AS (SELECT url, min((origin || '/s' || k || '.xml', pos::INT)) AS spot FROM p GROUP BY url) SELECT url AS loc, spot[1] AS sitemap, spot[2] AS pos FROM m")
def sitemap_locs(spark, sf):
    return E.sitemap_locations(_maps(spark, sf))


@query(f"WITH {_SITES}, f AS (SELECT min(origin) AS origin FROM o) SELECT origin || n AS url, depth FROM f, (VALUES ('/map.xml', 0), ('/parts.xml', 1), ('/s0.xml', 2), ('/s1.xml', 2), ('/s2.xml', 2)) t(n, depth)")
def sitemap_recursive(spark, sf):
    maps = _maps(spark, sf)
    first = table(spark, sf, "pages").select(F.min(F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*", 0))).first()[0]
    return E.reachable(f"{first}/map.xml", E.sitemap_children(maps))


_ROBOTS = "User-agent: bot\nDisallow: /all\nUser-agent: *\r\nDisallow: /en\n# note\nDisallow:\nDISALLOW: /th \nUser-agent: x\nDisallow: /"


@query("""WITH u AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') AS origin, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, url FROM u WHERE length(origin) % 2 = 1 OR NOT (starts_with(path, '/en') OR starts_with(path, '/th'))""")
def robots_filter(spark, sf):
    """Every second origin has rules."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    origin = U.origin(F.col("url"))
    robots = pages.select(origin.alias("origin")).distinct().withColumn("text", F.when(F.length("origin") % 2 == 0, _ROBOTS).otherwise(""))
    return E.allowed(pages, E.disallowed(robots))


@query("""WITH s AS (SELECT doc_id AS seq, text AS body, unnest(CASE WHEN length(text) <= 500 THEN [0] ELSE range(0, length(text), 400) END) AS s FROM documents)
SELECT seq, (s // 400)::INT AS chunk, substr(body, s + 1, 500) AS body FROM s""")
def chunk_body(spark, sf):
    return E.chunks(documents(spark, sf), 500)


_ENDING = "concat(url, CASE page_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX?x=1' WHEN 2 THEN '.html' WHEN 3 THEN '.xls' WHEN 4 THEN '.pptx#p' ELSE 'pdf' END)"


@query(f"SELECT page_id, url, regexp_matches(lower(url), '\\.(pdf|docx?|xlsx?|pptx?)($|\\?)') AS is_document FROM (SELECT page_id, {_ENDING} AS url FROM pages)")
def document_url(spark, sf):
    return table(spark, sf, "pages").selectExpr("page_id", f"{_ENDING} AS url").select("page_id", "url", is_document(F.col("url")).alias("is_document"))


_ALT = "CASE p_size % 4 WHEN 0 THEN concat(' ', p_name, ' ') WHEN 1 THEN '' WHEN 2 THEN '  ' END AS alt, CASE WHEN p_size % 3 > 0 THEN concat(' ', p_type) END AS ocr"


@query(f"SELECT p_partkey, alt, ocr, coalesce(nullif(trim(alt), ''), trim(ocr)) AS text FROM (SELECT p_partkey, {_ALT} FROM part)")
def alt_text(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey", *_ALT.split(", CASE")[:1], "CASE" + _ALT.split(", CASE")[1])
    return rows.select("p_partkey", "alt", "ocr", E.alternative(F.col("alt"), F.col("ocr")).alias("text"))


@query(f"WITH {_SOUNDEX} SELECT word AS term, unnest([word, code]) AS alternative FROM s WHERE code <> ''")
def phonetic_alternatives(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("term")).distinct()
    return L.phonetic_alternatives(spark.createDataFrame(_WORDS, "term string").unionByName(names))


_ORIGIN = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')"
_KEY = "CASE WHEN given <> '' THEN given ELSE regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g') END"
#: Links of the pages; all of them are absolute paths.
_LINKS = f"""{_ANCHORS}, k AS (SELECT page_id, url, pos, href, text, CASE WHEN starts_with(href, '/') THEN {_ORIGIN} || href ELSE href END AS target FROM h
  WHERE href <> '' AND href <> '#' AND NOT starts_with(href, 'javascript:') AND text <> '' AND NOT regexp_matches(lower(attrs), 'rel=["''][^"'']*nofollow'))"""
_EDGES = f"""{_SECTIONS}, {_LINKS}, edges AS (SELECT url AS from_url, heading AS action, url || '#' || {_KEY} AS to_url, NULL::VARCHAR AS effect, NULL::BOOLEAN AS destructive FROM s
  UNION ALL SELECT url, text, target, NULL, NULL FROM k WHERE starts_with(target, {_ORIGIN}))"""


@query(f"WITH {_SECTIONS} SELECT page_id, pos, heading, array_to_string(names[1:pos + 1], ' › ') AS breadcrumb FROM s")
def breadcrumbs(spark, sf):
    return E.sections(table(spark, sf, "pages")).select("page_id", "pos", "heading", "breadcrumb")


@query(f"""WITH {_SECTIONS}, x AS (SELECT page_id, pos, given, substr(after, 1, 500) AS a FROM s)
SELECT page_id, pos, '#' || CASE WHEN given <> '' THEN given ELSE coalesce(nullif(regexp_extract(a, '(?is)<section[^>]*id="([^"]+)"', 1), ''), nullif(regexp_extract(a, '(?is)<article[^>]*id="([^"]+)"', 1), '')) END AS selector FROM x""")
def section_selectors(spark, sf):
    return E.sections(table(spark, sf, "pages")).select("page_id", "pos", "selector")


@query(f"WITH {_LINKS} SELECT page_id, pos, target, CASE WHEN starts_with(target, {_ORIGIN}) THEN 'section' ELSE 'link' END AS type FROM k")
def link_targets(spark, sf):
    return E.links(table(spark, sf, "pages")).select("page_id", "pos", "target", "type")


@query(f"""WITH {_ANCHORS} SELECT page_id, pos, CASE WHEN text <> '' THEN text ELSE string_split(href, '/')[-1] END AS heading, CASE WHEN starts_with(href, '/') THEN {_ORIGIN} || href ELSE href END AS target
FROM h WHERE regexp_matches(lower(href), '\\.(pdf|doc|docx|xls|xlsx|ppt|pptx|zip|csv)[?#]?$')""")
def page_files(spark, sf):
    return E.files(table(spark, sf, "pages"))


@query("""WITH i AS (SELECT page_id, k - 1 AS pos, l[k] AS img FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '(?is)<img\\s[^>]*>') AS l FROM pages)))
SELECT * FROM (SELECT page_id, pos, trim(regexp_extract(img, '(?is)\\salt=["'']([^"'']*)["'']', 1)) AS heading FROM i) WHERE heading <> ''""")
def page_images(spark, sf):
    return E.images(table(spark, sf, "pages"))


@query(f"""WITH {_SCRIPTS}, e AS (SELECT page_id, script, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END) AS d FROM v)
SELECT count(*) FILTER (d->>'$."@type"' = 'FAQPage') AS faqs, count(*) FILTER (d->>'$."@type"' <> 'FAQPage') AS things FROM e""")
def page_structured(spark, sf):
    pages = table(spark, sf, "pages")
    return E.faqs(pages).agg(F.count("*").alias("faqs")).join(E.things(pages).agg(F.count("*").alias("things")))  # two single rows


@query(f"WITH {_ANCHORS} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, text AS heading, 'action' AS type, regexp_matches(lower(text), 'delete|remove|cancel subscription|unsubscribe|pay|checkout|submit order|confirm') AS destructive FROM b WHERE text <> ''")
def accessibility(spark, sf):
    return E.accessible(table(spark, sf, "pages")).select("page_id", "pos", "heading", "type", "destructive")


@query(f"""WITH {_EDGES}, f AS (SELECT page_id, count(*) AS n FROM b WHERE text <> '' GROUP BY page_id),
rec AS (SELECT page_id, 'section' AS type, heading, '#' || given AS target FROM s WHERE given <> '' UNION ALL SELECT page_id, 'section', heading, url || '#' || {_KEY} FROM s WHERE given = '' UNION ALL SELECT page_id, 'section', text, target FROM k),
n AS (SELECT page_id, count(*) AS n, count(DISTINCT (type, heading, target)) AS kept FROM rec GROUP BY page_id)
SELECT page_id AS page, coalesce(n.n, 0) + coalesce(f.n, 0) AS records, coalesce(kept, 0) + coalesce(f.n, 0) AS kept, coalesce(n.n, 0) - coalesce(kept, 0) AS excluded FROM n FULL JOIN f USING (page_id)""")
def page_manifest_counts(spark, sf):
    return G.manifest_counts(E.page_records(table(spark, sf, "pages")), "page_id")


@query(f"WITH {_EDGES} SELECT * FROM edges")
def graph_edges(spark, sf):
    return E.graph_edges(table(spark, sf, "pages"))


@query(f"WITH {_EDGES} SELECT (SELECT count(*) FROM pages) AS nodes, count(*) AS edges, count(DISTINCT from_url) AS sources, count(DISTINCT to_url) AS targets FROM edges")
def site_graph_saved(spark, sf):
    pages, path = table(spark, sf, "pages"), folder(spark)
    pages.select("url", "page_id").write.parquet(f"{path}/nodes")
    E.graph_edges(pages).write.parquet(f"{path}/edges")
    nodes = spark.read.parquet(f"{path}/nodes").agg(F.count("*").alias("nodes"))
    return nodes.join(spark.read.parquet(f"{path}/edges").agg(F.count("*").alias("edges"), F.countDistinct("from_url").alias("sources"), F.countDistinct("to_url").alias("targets")))


@query(f"""SELECT page_id, unnest(list_distinct([CASE WHEN regexp_matches(url, '^[^?#]*://[^/?#]*$') THEN url || '/' ELSE regexp_extract(regexp_extract(url, '^[^?#]*'), '^(.*/)') END || 'sitemap.xml', {_ORIGIN} || '/sitemap.xml'])) AS candidate FROM pages""")
def sitemap_candidates(spark, sf):
    both = F.array_distinct(F.concat(E.sitemap_candidates(F.col("url")), E.sitemap_candidates(F.col("url"), "/sitemap.xml")))
    return table(spark, sf, "pages").select("page_id", F.explode(both).alias("candidate"))


def _normal(u: str) -> str:
    """The normal form of a URL, as ``url_normalize`` has it."""
    u = f"regexp_replace({u}, '/$', '')"
    p = f"regexp_extract({u}, '^[^?#]*')"
    q = f"list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^({_DROP})(=|$)') AND NOT regexp_matches(x, '^[^=]*=?$'))"
    return f"((CASE WHEN regexp_matches({p}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*$') THEN {p} || '/' ELSE {p} END) || (CASE WHEN len({q}) > 0 THEN '?' || array_to_string({q}, '&') ELSE '' END) || regexp_extract({u}, '#.*$'))"


@query(f"""WITH RECURSIVE {_LINKS}, x AS (SELECT DISTINCT {_normal('url')} AS a, {_normal('target')} AS b FROM k WHERE starts_with(target, {_ORIGIN})),
y AS (SELECT a, b FROM x WHERE NOT starts_with(regexp_extract(b, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/th')),
z AS (SELECT {_normal('url')} AS u FROM pages),
r AS (SELECT u AS seed, u AS url, 0 AS depth FROM z WHERE NOT starts_with(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/th') UNION SELECT seed, b, depth + 1 FROM r JOIN y ON a = url WHERE depth < 12)
SELECT seed, url, min(depth) AS depth FROM r GROUP BY seed, url""")
def crawl_pages(spark, sf):
    pages = table(spark, sf, "pages")
    closed = pages.select(U.origin(F.col("url")).alias("origin"), F.lit("/th").alias("path")).distinct()
    return E.crawl(pages.select("url"), pages, closed)


@query(f"""WITH v AS (SELECT doc_id AS seq, 'doc-' || doc_id AS id, lower(array_to_string(string_split_regex(text, '\\s+')[1:4], ' ') || ' ' || text) AS t FROM documents),
w AS (SELECT seq, id, [{", ".join(f"(length(t) - length(replace(t, '{c}', '')))::DOUBLE" for c in "aeiou")}] AS a, [{", ".join(f"{'where are the notes on ring stations'.count(c)}e0" for c in "aeiou")}] AS b FROM v)
SELECT seq, id, round(CASE WHEN list_dot_product(a, a) > 0 THEN list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) ELSE 0 END, 6) AS score FROM w ORDER BY CASE WHEN list_dot_product(a, a) > 0 THEN list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) ELSE 0 END DESC, seq LIMIT 10""")
def semantic_records(spark, sf):
    """An embedder of vowel counts stands for a model."""
    embed = lambda texts: texts.str.lower().map(lambda t: [float(t.count(c)) for c in "aeiou"])
    found = S.semantic_records(documents(spark, sf), "Where are the notes on ring stations", embed)
    return found.select("seq", "id", F.round("score", 6).alias("score"))
