"""HTML pages to typed records. Regular markup goes through JVM expressions; true DOM work through one ``mapInPandas``."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkseek.functions import text as X
from sparkseek.functions import urls as U
from sparkseek.sources.scratch import folder

HEADING = r"(?is)^<h([1-6])([^>]*)>(.*?)</h[1-6]>"
FILES = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "csv")
ANCHOR = r"(?is)<a\s([^>]*)>(.*?)</a>"
HREF = r"""(?i)(?:^|\s)href=["']([^"']*)["']"""


def sections(pages: DataFrame) -> DataFrame:
    """One row per heading of ``pages(page_id, url, html)``, with the text up to the next heading.

    The page is split before each heading; a row's place in the array gives its order and its breadcrumb
    (all headings so far), so nothing is shuffled.
    """
    parts = F.split(X.clean_html(F.col("html")), r"(?is)(?=<h[1-6][^>]*>.*?</h[1-6]>)")
    rows = pages.select("page_id", "url", F.filter(parts, lambda p: p.rlike(HEADING)).alias("parts"))
    names = F.transform("parts", lambda p: X.strip_tags(F.regexp_extract(p, HEADING, 3)))
    rows = rows.select("page_id", "url", names.alias("names"), F.posexplode("parts").alias("pos", "part"))
    heading, opened = F.element_at("names", F.col("pos") + 1), F.regexp_extract("part", HEADING, 2)
    given = F.regexp_extract(opened, r"""(?i)\bid=["']([^"']+)["']""", 1)
    made = F.when(heading == "", F.substring(F.sha2(F.concat_ws("#", "url", F.col("pos").cast("string")), 256), 1, 11)).otherwise(X.slug(heading))
    key = F.when(given != "", given).otherwise(made)
    rest = F.regexp_replace("part", HEADING, "")
    parent = lambda tag: F.regexp_extract(F.substring(rest, 1, 500), rf'(?is)<{tag}[^>]*id="([^"]+)"', 1)
    near = F.coalesce(F.nullif(parent("section"), F.lit("")), F.nullif(parent("article"), F.lit("")))
    return rows.select(
        "page_id",
        "pos",
        F.concat_ws("#", "url", key).alias("id"),
        heading.alias("heading"),
        key.alias("heading_id"),
        F.array_join(F.slice("names", F.lit(1), F.col("pos") + 1), " › ").alias("breadcrumb"),
        X.strip_tags(rest).alias("body"),
        F.concat(F.lit("#"), F.when(given != "", given).otherwise(near)).alias("selector"),
    )


def anchors(pages: DataFrame) -> DataFrame:
    """``page_id, url, pos, attrs, href, text`` of every ``<a href>``."""
    rows = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*>.*?</a>"), F.lit(0))).alias("pos", "a"))
    attrs = F.regexp_extract("a", ANCHOR, 1)
    rows = rows.select("page_id", "url", "pos", attrs.alias("attrs"), F.regexp_extract(attrs, HREF, 1).alias("href"), X.strip_tags(F.regexp_extract("a", ANCHOR, 2)).alias("text"))
    return rows.where("href <> ''")


def links(pages: DataFrame) -> DataFrame:
    """Followed links with a text. Those to the page's own origin are of type section, others of type link."""
    rows = anchors(pages).where(~F.lower("attrs").rlike("""rel=["'][^"']*nofollow""") & (F.col("href") != "#") & ~F.col("href").startswith("javascript:") & (F.col("text") != ""))
    target = U.resolve(F.col("href"), F.col("url"))
    kind = F.when(target.startswith(U.origin(F.col("url"))), F.lit("section")).otherwise(F.lit("link"))
    return rows.select("page_id", "pos", "href", "text", target.alias("target"), kind.alias("type"))


def files(pages: DataFrame, extensions: tuple[str, ...] = FILES) -> DataFrame:
    """Links that end in a file extension; a link without text takes the last part of its path."""
    rows = anchors(pages).where(F.lower("href").rlike(rf"\.({'|'.join(extensions)})[?#]?$"))
    name = F.when(F.col("text") != "", F.col("text")).otherwise(F.element_at(F.split("href", "/"), -1))
    return rows.select("page_id", "pos", name.alias("heading"), U.resolve(F.col("href"), F.col("url")).alias("target")).where("heading <> ''")


def images(pages: DataFrame) -> DataFrame:
    """Images with a text alternative."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<img\s[^>]*>"), F.lit(0))).alias("pos", "img"))
    alt = F.trim(F.regexp_extract("img", r"""(?is)\salt=["']([^"']*)["']""", 1))
    return rows.select("page_id", "pos", alt.alias("heading")).where("heading <> ''")


def _scripts(pages: DataFrame) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    return pages.select("page_id", "url", F.posexplode(found).alias("script", "json")).withColumn("v", F.try_parse_json("json")).where("v IS NOT NULL")


def faqs(pages: DataFrame) -> DataFrame:
    """Questions with an answer of FAQ pages, given alone or within an array; other and malformed data are skipped."""
    item = "array<struct<name:string,acceptedAnswer:struct<text:string>,suggestedAnswer:struct<text:string>>>"
    entry = f"struct<`@type`:string,mainEntity:{item}>"
    one = F.array(F.try_variant_get("v", "$", entry))
    rows = _scripts(pages).withColumn("data", F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", f"array<{entry}>")).otherwise(one))
    rows = rows.where(F.exists("data", lambda d: d["@type"] == "FAQPage"))
    every = F.flatten(F.transform("data", lambda d: F.coalesce(d["mainEntity"], F.array().cast(item))))
    rows = rows.select("page_id", "script", F.posexplode(every).alias("pos", "q"))
    answer = F.coalesce(F.nullif("q.acceptedAnswer.text", F.lit("")), F.nullif("q.suggestedAnswer.text", F.lit("")))
    return rows.select("page_id", "script", "pos", F.col("q.name").alias("question"), answer.alias("answer")).where("question <> '' AND answer IS NOT NULL")


def things(pages: DataFrame) -> DataFrame:
    """Other typed objects with a name, headline or description."""
    get = lambda k: F.coalesce(F.try_variant_get("v", f"$.{k}", "string"), F.lit(""))
    rows = _scripts(pages).where(~F.schema_of_variant("v").startswith("ARRAY")).withColumn("kind", F.try_variant_get("v", "$['@type']", "string"))
    rows = rows.where("kind IS NOT NULL AND kind <> 'FAQPage'")
    name = F.when(get("name") != "", get("name")).otherwise(get("headline"))
    rows = rows.select("page_id", "script", "kind", name.alias("name"), get("description").alias("description"))
    return rows.withColumn("body", F.trim(F.concat_ws(" ", "name", "description"))).where("body <> ''")


def chunks(records: DataFrame, size: int) -> DataFrame:
    """Windows of ``size`` characters that overlap by a fifth, numbered in order; short bodies are one chunk."""
    step = size - size // 5
    starts = F.when(F.length("body") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length("body") - 1, F.lit(step)))
    rows = records.select("seq", "body", F.posexplode(starts).alias("chunk", "start"))
    return rows.select("seq", "chunk", F.substring("body", F.col("start") + 1, F.lit(size)).alias("body"))


def sitemap_locations(maps: DataFrame) -> DataFrame:
    """Distinct page URLs of ``sitemaps(url, xml)`` that are no index, each at its first place."""
    pages = maps.where(~F.col("xml").contains("<sitemapindex"))
    rows = pages.select("url", F.posexplode(F.regexp_extract_all("xml", F.lit("<loc>(.*?)</loc>"), F.lit(1))).alias("pos", "loc"))
    target = U.resolve(F.trim("loc"), F.col("url"))
    return rows.select(target.alias("loc"), F.struct("url", "pos").alias("at")).groupBy("loc").agg(F.min("at").alias("at")).select("loc", F.col("at.url").alias("sitemap"), F.col("at.pos").alias("pos"))


def reachable(start: str, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """``url, depth`` of all that can be reached over ``edges(from_url, to_url)`` from one URL."""
    return frontier(edges.sparkSession.createDataFrame([(start,)], "url string"), edges, None, depth)


def frontier(start: DataFrame, edges: DataFrame, most: int | None = 500, depth: int | None = None) -> DataFrame:
    """Breadth-first crawl order: ``url, depth``, at most ``most`` pages, by depth, then URL."""
    return levels(start.select(F.lit("").alias("seed"), "url"), edges, most, depth).select("url", "depth").orderBy("depth", "url")


def levels(seeds: DataFrame, edges: DataFrame, most: int | None = 500, depth: int | None = None) -> DataFrame:
    """``seed, url, depth`` of what each of ``seeds(seed, url)`` reaches over ``edges(from_url, to_url)``, level by level.

    A level is one join and one anti-join over written tables, so neither plans nor paths grow, and cycles end.
    With ``most``, each seed keeps that many pages, by depth, then URL, and goes no deeper once it has them.
    """
    spark, path = edges.sparkSession, folder(edges.sparkSession)
    edges.select("from_url", "to_url").distinct().write.parquet(f"{path}/steps")
    steps = spark.read.parquet(f"{path}/steps")
    seeds.select("seed", "url", F.lit(0).alias("depth")).distinct().write.parquet(f"{path}/levels/n=0")
    kept = "seed string, url string, depth int"
    level = 0
    while depth is None or level < depth:
        seen = spark.read.schema(kept).parquet(*[f"{path}/levels/n={i}" for i in range(level + 1)])
        newest = spark.read.schema(kept).parquet(f"{path}/levels/n={level}")
        found = newest.join(steps, F.col("url") == F.col("from_url")).select("seed", F.col("to_url").alias("url")).distinct()
        found = found.join(seen, ["seed", "url"], "left_anti")
        if most is not None:
            held = seen.groupBy("seed").agg(F.count("*").alias("held")).where(F.col("held") < most)
            found = found.join(held.select("seed"), "seed", "left_semi")
        level += 1
        found.select("seed", "url", F.lit(level).alias("depth")).write.parquet(f"{path}/levels/n={level}")
        if spark.read.schema(kept).parquet(f"{path}/levels/n={level}").isEmpty():
            break
    out = spark.read.schema(kept).parquet(*[f"{path}/levels/n={i}" for i in range(level + 1)])
    if most is None:
        return out
    place = F.row_number().over(Window.partitionBy("seed").orderBy("depth", "url"))  # a level more than ``most`` rows a seed
    return out.withColumn("_i", place).where(F.col("_i") <= most).drop("_i")


def crawl(seeds: DataFrame, pages: DataFrame, closed: DataFrame | None = None, most: int | None = 500, depth: int | None = None) -> DataFrame:
    """``seed, url, depth``: the same-origin crawl from each of ``seeds(url)`` over the links of ``pages(page_id, url, html)``.

    URLs are normalised; pages of another origin and paths that ``closed(origin, path)`` disallows are not visited.
    """
    steps = links(pages).where("type = 'section'").join(pages.select("page_id", "url"), "page_id")
    steps = steps.select(U.normalize(F.col("url")).alias("from_url"), U.normalize(F.col("target")).alias("to_url"))
    steps = steps.where(U.origin(F.col("from_url")) == U.origin(F.col("to_url")))
    start = seeds.select(U.normalize(F.col("url")).alias("url"))
    if closed is not None:
        steps = allowed(steps.withColumn("url", F.col("to_url")), closed).drop("url")
        start = allowed(start, closed)
    return levels(start.select(F.col("url").alias("seed"), "url"), steps, most, depth)


def sitemap_children(maps: DataFrame) -> DataFrame:
    """Edges from each sitemap index to its child sitemaps."""
    found = F.regexp_extract_all("xml", F.lit(r"(?s)<sitemap>.*?<loc>(.*?)</loc>.*?</sitemap>"), F.lit(1))
    rows = maps.where(F.col("xml").contains("<sitemapindex")).select("url", F.explode(found).alias("child"))
    return rows.select(F.col("url").alias("from_url"), U.resolve(F.trim("child"), F.col("url")).alias("to_url"))


def disallowed(robots: DataFrame) -> DataFrame:
    """Paths of ``robots(origin, text)`` that are closed to all agents; the agent line before a rule decides."""
    lines = F.transform(F.split("text", "\n"), lambda s: F.trim(F.regexp_replace(s, "\r", "")))
    agent = r"(?i)^User-agent:\s*(.+)$"
    walk = F.aggregate(
        lines,
        F.struct(F.lit("").alias("agent"), F.array().cast("array<string>").alias("paths")),
        lambda a, s: F.when(s.rlike(agent), F.struct(F.trim(F.regexp_extract(s, agent, 1)).alias("agent"), a["paths"].alias("paths")))
        .when((a["agent"] == "*") & s.rlike(r"(?i)^Disallow:\s*\S"), F.struct(a["agent"].alias("agent"), F.array_append(a["paths"], F.trim(F.regexp_extract(s, r"(?i)^Disallow:\s*(.+)$", 1))).alias("paths")))
        .otherwise(a),
    )
    return robots.select("origin", F.explode(F.array_distinct(walk["paths"])).alias("path"))


def allowed(urls: DataFrame, closed: DataFrame) -> DataFrame:
    """``urls(url)`` without those whose path starts with a closed path of their origin."""
    rows = urls.withColumn("_o", U.origin(F.col("url"))).withColumn("_p", U.path(F.col("url")))
    hit = (F.col("_o") == F.col("origin")) & F.startswith("_p", "path")
    return rows.join(closed, hit, "left_anti").select(*urls.columns)


def graph_edges(pages: DataFrame) -> DataFrame:
    """``from_url, action, to_url, effect, destructive``: the site graph of ``pages(page_id, url, html)``.

    Headings lead to their part of the page, links to pages of the same origin. Actions and form fields lead nowhere:
    their ``effect`` is dom-action or field-input, and actions say whether they are destructive.
    """
    none, here = F.lit(None).cast("string"), pages.select("page_id", "url")
    parts = sections(pages).join(here, "page_id").select(F.col("url").alias("from_url"), F.col("heading").alias("action"), F.col("id").alias("to_url"))
    steps = links(pages).join(here, "page_id").where(F.startswith("target", U.origin(F.col("url"))))
    steps = steps.select(F.col("url").alias("from_url"), F.col("text").alias("action"), F.col("target").alias("to_url"))
    moves = parts.unionByName(steps).select("*", none.alias("effect"), F.lit(None).cast("boolean").alias("destructive"))
    acts = dom_records(pages).where(F.col("type").isin("action", "field")).join(here, "page_id")
    effect = F.when(F.col("type") == "field", "field-input").otherwise("dom-action")
    danger = F.when(F.col("type") == "action", X.is_destructive(F.col("heading")))
    return moves.unionByName(acts.select(F.col("url").alias("from_url"), F.col("heading").alias("action"), none.alias("to_url"), effect.alias("effect"), danger.alias("destructive")))


def sitemap_candidates(base: Column, configured: str = "sitemap.xml") -> Column:
    """Distinct URLs at which the sitemap of a page may be."""
    other = ["./sitemap.xml"] if not configured.startswith("/") else ["sitemap.xml"] if configured == "/sitemap.xml" else []
    return F.array_distinct(F.array(*[U.resolve(F.lit(v), base) for v in (configured, *other)]))


_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Dom(HTMLParser):
    """Small tree of ``[tag, attributes, text parts, children, parent]``."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, [], [], None]
        self.at = self.root
        self.all: list[list] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, [], [], self.at]
        self.at[3].append(node)
        self.at[2].append(node)
        self.all.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node[0] != tag:
            node = node[4]
        if node is not self.root:
            self.at = node[4]

    def handle_data(self, data):
        self.at[2].append(data)


def _text(node: list) -> str:
    out, todo = [], list(reversed(node[2]))
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            todo += reversed(part[2])
    return "".join(out).strip()


def _name(dom: _Dom, node: list) -> str:
    a = node[1]
    if a.get("aria-label", "").strip():
        return a["aria-label"].strip()
    if ref := a.get("aria-labelledby"):
        other = next((n for n in dom.all if n[1].get("id") == ref), None)
        if other and _text(other):
            return _text(other)
    return _text(node) or a.get("title", "").strip()


def _path(node: list) -> str:
    steps = []
    while node[4] is not None:
        tag, a, _, _, parent = node
        if a.get("id"):
            steps.append(f"{tag}#{a['id']}")
            break
        step = tag + "".join(f".{c}" for c in a.get("class", "").split())
        twins = [n for n in parent[3] if n[0] == tag]
        place = next(i for i, n in enumerate(twins) if n is node)
        steps.append(step + (f":nth-child({place + 1})" if place else ""))
        node = parent
    return " > ".join(reversed(steps))


def _selectors(dom: _Dom, node: list) -> list[str]:
    """From the most to the least meaningful, without repeats."""
    a, q = node[1], lambda s: s.replace("\\", "\\\\").replace('"', '\\"')
    out = [f'[{k}="{q(a[k])}"]' for k in ("data-testid", "data-test", "data-agent-id") if a.get(k)]
    out += [f"#{a['id']}"] if a.get("id") else []
    out += [f'[aria-label="{q(a["aria-label"])}"]'] if a.get("aria-label") else []
    if role := a.get("role"):
        name = _name(dom, node)
        out += [f'[role="{q(role)}"][aria-label="{q(name)}"]'] if name else []
        out.append(f'[role="{q(role)}"]')
    twins = [n for n in node[4][3] if n[0] == node[0]]
    place = next(i for i, n in enumerate(twins) if n is node) + 1
    return list(dict.fromkeys([*out, _path(node), f"xpath=//{node[0]}[{place}]"]))


#: The attribute by which pages mark further elements as actions.
MARKED = "data-action"


def _is_action(n: list, marked: str) -> bool:
    return n[0] in ("button", "summary") or n[1].get("role") == "button" or n[0] == "input" and n[1].get("type") in ("button", "submit") or marked in n[1]


_FOCUSABLE = frozenset("a button input textarea select summary".split())
_ROLES = frozenset("button link tab menuitem checkbox radio combobox option".split())


def _is_focusable(n: list, marked: str) -> bool:
    tab = n[1].get("tabindex", "").strip()
    return n[0] in _FOCUSABLE or n[1].get("role") in _ROLES or "contenteditable" in n[1] or bool(re.fullmatch(r"\+?\d+", tab)) or marked in n[1]


def _field_label(dom: _Dom, node: list) -> str:
    a = node[1]
    if a.get("id") and (n := next((n for n in dom.all if n[0] == "label" and n[1].get("for") == a["id"]), None)) and _text(n):
        return _text(n)
    up = node[4]
    while up is not None and up[0] != "label":
        up = up[4]
    if up is not None and _text(up):
        value = a.get("value", "")
        return _text(up).replace(value, "", 1).strip() if value else _text(up)
    return a.get("placeholder") or a.get("aria-label", "")


def _above(node: list, tags: frozenset) -> list | None:
    node = node[4]
    while node is not None and node[0] not in tags:
        node = node[4]
    return node


_FORM, _AREA = frozenset(["form"]), frozenset("h1 h2 h3 h4 h5 h6 article section main".split())
_FIGURE = frozenset(["figure"])


def dom_rows(html: str, marked: str = MARKED) -> list[tuple]:
    """``type, heading, breadcrumb, body, selectors, value, transcript`` of actions, fields and media, in that order."""
    dom, out = _Dom(html), []
    for n in dom.all:
        if _is_action(n, marked) and (name := _name(dom, n)):
            out.append(("action", name, "", name, _selectors(dom, n), None, None))
    for n in dom.all:
        if n[0] in ("input", "textarea", "select") and n[1].get("type") not in ("hidden", "button", "submit", "reset") and (form := _above(n, _FORM)):
            if label := _field_label(dom, n):
                area = _above(form, _AREA)
                out.append(("field", label, _text(area) if area else "", label, _selectors(dom, n), _text(n) if n[0] == "textarea" else n[1].get("value", ""), None))
    for n in dom.all:
        if n[0] == "img" and (alt := n[1].get("alt", "").strip()):
            figure = _above(n, _FIGURE)
            caption = next((_text(c) for c in dom.all if c[0] == "figcaption" and _above(c, _FIGURE) is figure), "") if figure else ""
            out.append(("media", alt, "", f"{alt} {caption}".strip(), _selectors(dom, n), None, None))
    for n in dom.all:
        if n[0] in ("video", "audio") and (title := n[1].get("title") or n[1].get("aria-label", "")):
            tracks = [c[1]["src"] for c in n[3] if c[0] == "track" and c[1].get("kind") in ("captions", "subtitles") and c[1].get("src")]
            script = " ".join(f"[Transcript available: {s}]" for s in tracks)
            out.append(("media", title, "", f"{title} {script}".strip(), _selectors(dom, n), None, script))
    return out


DOM_SCHEMA = "page_id long, type string, pos int, heading string, breadcrumb string, body string, selectors array<string>, value string, transcript string"


def focusable_rows(html: str, marked: str = MARKED) -> list[tuple]:
    """The same columns for every named element that can take the focus: the static part of an accessibility tree."""
    dom, out = _Dom(html), []
    for n in dom.all:
        if _is_focusable(n, marked) and (name := _name(dom, n)):
            field = n[0] in ("input", "textarea", "select") or "contenteditable" in n[1]
            out.append(("field" if field else "action", name, "", name, _selectors(dom, n), None, None))
    return out


def dom_records(pages: DataFrame, marked: str = MARKED, rows_of: Callable[[str, str], list[tuple]] = dom_rows) -> DataFrame:
    """Actions, form fields and media of ``pages``, numbered within page and type."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page, html in zip(frame["page_id"], frame["html"], strict=True):
                seen: dict[str, int] = {}
                for kind, *rest in rows_of(html or "", marked):
                    out.append((page, kind, seen.setdefault(kind, 0), *rest))
                    seen[kind] += 1
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DOM_SCHEMA.split(", ")])

    return pages.select("page_id", "html").mapInPandas(rows, DOM_SCHEMA)


def accessible(pages: DataFrame, marked: str = MARKED) -> DataFrame:
    """Named elements of ``pages`` that can take the focus, with ``destructive``; shadow roots and frames need a browser."""
    return with_destructive(dom_records(pages, marked, focusable_rows), F.col("heading"))


def page_records(pages: DataFrame, marked: str = MARKED) -> DataFrame:
    """Everything that ``pages`` hold, as ``page_id, seq, type, heading, selector, url, destructive``: headings, actions, fields, media,
    links, files, structured data, and what can take the focus, in this order within a page."""
    here = pages.select("page_id", F.col("url").alias("page_url"))
    none, no = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    cols = lambda rows, place, kind, url, selector=none, danger=no, name="heading": rows.select("page_id", F.lit(place).alias("place"), F.col("pos").alias("pos"), kind.alias("type"), F.col(name).alias("heading"), selector.alias("selector"), url.alias("url"), danger.alias("destructive"))
    first = F.element_at("selectors", 1)
    dom, focus = dom_records(pages, marked), accessible(pages, marked)
    parts = [
        cols(sections(pages), 0, F.lit("section"), F.col("id"), F.col("selector")),
        cols(dom.where("type = 'action'"), 1, F.col("type"), none, first, X.is_destructive(F.col("heading"))),
        cols(dom.where("type = 'field'"), 2, F.col("type"), none, first),
        cols(links(pages), 3, F.col("type"), F.col("target"), name="text"),
        cols(files(pages), 4, F.lit("file"), F.col("target")),
        cols(dom.where("type = 'media'"), 5, F.col("type"), none, first),
        cols(faqs(pages).withColumn("pos", F.col("script") * 1000 + F.col("pos")), 6, F.lit("structured"), none, name="question"),
        cols(things(pages).withColumn("pos", F.col("script")), 7, F.lit("structured"), none, name="name"),
        cols(focus, 8, F.col("type"), none, first, F.col("destructive")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    order = F.struct("place", "pos")
    return every.join(here, "page_id").select("page_id", order.alias("seq"), "type", "heading", "selector", F.coalesce("url", "page_url").alias("url"), "destructive")


def image_texts(pages: DataFrame, ocr: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """``page_id, pos, src, text`` of the images: their alternative, else what ``ocr`` reads at their source, if given; those without text go."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<img\s[^>]*>"), F.lit(0))).alias("pos", "img"))
    get = lambda name: F.trim(F.regexp_extract("img", rf"""(?is)\s{name}=["']([^"']*)["']""", 1))
    rows = rows.select("page_id", "pos", get("src").alias("src"), get("alt").alias("alt"))
    read = F.pandas_udf(ocr, "string")(F.when((F.col("alt") == "") & (F.col("src") != ""), F.col("src"))) if ocr else F.lit(None).cast("string")
    return rows.withColumn("read", read).select("page_id", "pos", "src", alternative(F.col("alt"), F.col("read")).alias("text")).where("text <> ''")


def alternative(alt: Column, read: Column) -> Column:
    """The alternative text of an image, else the text read from it."""
    return F.coalesce(F.nullif(F.trim(alt), F.lit("")), F.trim(read))


def with_destructive(records: DataFrame, label: Column) -> DataFrame:
    return records.withColumn("destructive", X.is_destructive(label))
