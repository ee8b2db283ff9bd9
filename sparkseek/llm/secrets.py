"""Secret scans: a trigram index asked by Boolean queries made from each rule, then exact verification; DataFrame functions only."""

from __future__ import annotations

import re
import re._parser as regex_tree
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import dropped, saved


@dataclass(frozen=True)
class Rule:
    """A pattern, valid in Python and Java alike and without look-around, and the least length of what one of its groups holds."""

    pattern: str
    group: int = 0
    least: int = 1


def _either(words: str) -> str:
    """Letters of a pattern in either case, spelled out."""
    return re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", words)


# Kinds of secrets. The first three are the base; they keep their order.
RULES = {
    "assign": Rule(rf"({_either('password|passwd|secret|token|api_?key')})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": Rule("AKIA[A-Z0-9]+", 0, 16),
    "hex": Rule("[0-9a-f]+", 0, 32),
    "pem": Rule("-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    "github": Rule("gh[opsu]_[A-Za-z0-9]+", 0, 40),
    "slack": Rule("xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    "google": Rule("AIza[A-Za-z0-9_-]+", 0, 39),
    "payment": Rule("[rs]k_live_[A-Za-z0-9]+", 0, 24),
    "web_token": Rule(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
}
BASE = ("assign", "access", "hex")
#: Documents whose postings lie together.
BLOCK = 16_384
#: Words of the filter of texts to verify, at most.
FILTER_WORDS = 1 << 20
#: Strings that a part of a pattern may stand for before it is cut, and alternatives of a query.
STRINGS, ALTERNATIVES = 48, 32

Query = frozenset[frozenset[str]]  # alternatives, each of trigrams that must all occur
EVERY: Query = frozenset([frozenset()])


def _least(q: set[frozenset[str]]) -> Query:
    """Without alternatives that another one follows from."""
    return frozenset(a for a in q if not any(b < a for b in q))


def _both(a: Query, b: Query) -> Query:
    out = _least({x | y for x in a for y in b})
    return out if len(out) <= ALTERNATIVES else min(a, b, key=len)


def _any(parts: Sequence[Query]) -> Query:
    out = _least({x for q in parts for x in q})
    return out if len(out) <= ALTERNATIVES else EVERY


def _of_strings(strings: set[str]) -> Query:
    return _any([frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings])


def _read(items) -> tuple[set[str] | None, Query]:
    """Of a run of pattern parts: the strings that it stands for, if they are few, and trigrams that every match holds."""
    exact: set[str] | None = {""}
    known: set[str] = {""}
    query = EVERY
    for op, arg in items:
        name, some, must = str(op), None, EVERY
        if name == "LITERAL":
            some = {chr(arg).lower()}
        elif name == "IN":
            chars = {c for k, a in arg for c in ([a] if str(k) == "LITERAL" else range(a[0], a[1] + 1) if str(k) == "RANGE" and a[1] - a[0] < 99 else range(0x3000, 0x3100))}
            some = {chr(c).lower() for c in chars}
            some = some if len(some) <= 6 else None
        elif name == "SUBPATTERN":
            some, must = _read(arg[3])
        elif name == "BRANCH":
            read = [_read(b) for b in arg[1]]
            if all(s is not None for s, _ in read):
                some = set().union(*(s for s, _ in read))
            must = _any([_of_strings(s) if s is not None else q for s, q in read])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            strings, held = _read(inner)
            if high == 1 and low == 0 and strings is not None:
                some = strings | {""}
            elif low:
                must = held if strings is None else _of_strings(strings)
                if low == high and strings is not None and len(strings) ** int(low) <= STRINGS:
                    some = reduce(lambda a, _: {x + y for x in a for y in strings}, range(int(low)), {""})
        if some is not None and len(known) * len(some) <= STRINGS:
            known = {a + b for a in known for b in some}
            if exact is not None:
                exact = known
            continue
        query = _both(_both(query, _of_strings(known)), must)
        if some is not None:  # too many together: go on from here
            query, known = _both(query, _of_strings(some)), some if len(some) <= STRINGS else {""}
        else:
            known = {""}
        exact = None
    return exact, _both(query, _of_strings(known))


def trigram_query(pattern: str) -> Query:
    """Trigrams of the text in lower case that every match needs, as alternatives; one without trigrams if none is mandatory."""
    return _read(regex_tree.parse(pattern))[1]


def _contained(low: Column, grams: Sequence[str]) -> Column:
    """Places in ``grams`` of those that a text holds."""
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))


def _full_scan(rule: Rule) -> str:
    """The pattern, with a bound on its last run where the least length is that of the whole match of one class."""
    if rule.group == 0 and (m := re.fullmatch(r"(\[[^]]+\])\+", rule.pattern)):
        return f"{m[1]}{{{rule.least},}}"
    return rule.pattern


def indexed(docs: DataFrame, rules: Mapping[str, Rule], queries: Mapping[str, Query], grams: Sequence[str]) -> DataFrame:
    """``doc_id, h1, h2, held`` of each row: two hashes of its text, and which trigrams it holds.

    Rules without mandatory trigrams are matched against every text here; those that hit are held under the rule's own
    number, counted on from the trigrams.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.lower(text).alias("low"))
    whole = [k for k in rules if queries[k] == EVERY]
    scanned = [F.when(F.col("text").rlike(_full_scan(rules[k])), F.lit(len(grams) + i)) for i, k in enumerate(whole)]
    held = _contained(F.col("low"), grams)
    held = F.concat(held, F.array_compact(F.array(*scanned))) if scanned else held
    return rows.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), held.alias("held"))


def postings(rows: DataFrame, blocks: int) -> DataFrame:
    """``block, gram, texts``: the inverted index, with one list of text hashes for each block and trigram."""
    each = rows.select(F.pmod("h1", F.lit(blocks)).alias("block"), "h1", F.explode("held").alias("gram"))
    return each.groupBy("block", "gram").agg(F.collect_set("h1").alias("texts"))


def candidates(index: DataFrame, queries: Mapping[str, Query], grams: Sequence[str]) -> DataFrame:
    """``h1, rules``: texts by hash and the rules that they may match, by intersection of postings within each block."""
    place = {g: i for i, g in enumerate(grams)}
    whole = [k for k in queries if queries[k] == EVERY]
    asked = range(len(grams) + len(whole))
    lists = index.groupBy("block").agg(*[F.first(F.when(F.col("gram") == i, F.col("texts")), True).alias(f"g{i}") for i in asked])
    of = lambda i: F.coalesce(f"g{i}", F.array().cast("array<long>"))
    found = []
    for n, (k, q) in enumerate(queries.items()):
        ways = [of(len(grams) + whole.index(k))] if k in whole else [reduce(F.array_intersect, [of(place[g]) for g in sorted(way)]) for way in sorted(q, key=sorted)]
        found.append(F.struct(F.lit(n).alias("rule"), reduce(F.array_union, ways).alias("texts")))
    rows = lists.select(F.explode(F.array(*found)).alias("f")).select("f.rule", F.explode("f.texts").alias("h1"))
    return rows.groupBy("h1").agg(F.collect_set("rule").alias("rules"))


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``h1, h2, text, rules``: each wanted text once. A filter of at most FILTER_WORDS words keeps others from being moved."""
    place = F.shiftrightunsigned("h1", 38)  # 26 bits: a word and a bit of it
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    # Bounded: a row for each word of the filter, 2^20 at most.
    bits = wanted.select(word.alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h1, 38) & 63 AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text.alias("text")).select("text", F.xxhash64("text").alias("h1")).withColumns({"word": word, "bit": bit})
    rows = rows.join(F.broadcast(bits), "word").where(F.getbit("bits", "bit") == 1)
    # Copies of a text meet in the tasks that read them, before they are sent.
    texts = rows.groupBy("h1", F.xxhash64(F.lit(1), "text").alias("h2")).agg(F.first("text").alias("text"))
    return texts.join(wanted, "h1")


def verified(texts: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """``h1, h2, found``: all matches of the rules in candidate texts, as sorted structs ``start, rule, stop`` in code points.

    A match's place is the length of what is before it: the pieces that the pattern leaves of the text and earlier matches.
    """
    cells = []
    for n, rule in enumerate(rules.values()):
        pattern, size = F.lit(rule.pattern), lambda c: F.transform(c, lambda x: F.length(x))
        parts = [size(F.split("text", rule.pattern, -1)), size(F.regexp_extract_all("text", pattern, F.lit(0)))]
        parts.append(size(F.regexp_extract_all("text", pattern, F.lit(rule.group))) if rule.group else parts[1])
        zipped = F.arrays_zip(*[p.alias(c) for p, c in zip(parts, ("gap", "size", "held"), strict=True)])
        cells.append(F.struct(F.lit(n).alias("rule"), F.when(F.array_contains("rules", n), zipped).alias("parts")))
    rows = texts.select("h1", "h2", F.explode(F.array(*cells)).alias("c")).select("h1", "h2", "c.rule", F.posexplode("c.parts").alias("at", "p"))
    rows = rows.select("h1", "h2", "rule", "at", "p.gap", "p.size", "p.held")
    before = Window.partitionBy("h1", "h2", "rule").orderBy("at")
    start = F.sum("gap").over(before) + F.coalesce(F.sum("size").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules.values()]), F.col("rule") + 1)
    rows = rows.withColumn("start", start).where(F.col("size").isNotNull() & (F.col("held") >= least))
    span = F.struct(F.col("start"), F.col("rule"), (F.col("start") + F.col("size")).alias("stop"))
    return rows.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(span)).alias("found"))


def secrets(docs: DataFrame, rules: Mapping[str, Rule] | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans``.

    Each rule becomes a Boolean query over trigrams, and one pass over the corpus notes which of these a text holds; other
    trigrams would never be asked for. Postings lie by block, lists of a rule are intersected within each, and only candidate
    texts are read again and matched exactly. A rule without mandatory trigrams is matched against every text in the first pass.

    Null texts count as empty; empty texts hold nothing. Rows are kept as they are, repeats and null ids too; equal texts are
    matched once. Long texts are matched whole. Kinds beyond the first three only add spans. An empty table gives an
    empty result; further columns are not read.
    """
    rules = dict(rules or RULES)
    queries = {k: trigram_query(r.pattern) for k, r in rules.items()}
    grams = sorted({g for q in queries.values() for way in q for g in way})
    rows = saved(indexed(docs, rules, queries, grams))
    index = saved(postings(rows, max(1, rows.count() // BLOCK)))
    wanted = saved(candidates(index, queries, grams))
    dropped(index)
    found = saved(verified(_fetched(docs, wanted), rules))
    dropped(wanted)
    spans = F.coalesce("found", F.array().cast("array<struct<start:bigint,rule:int,stop:bigint>>"))
    names = F.array(*map(F.lit, rules))
    base = [n for n, k in enumerate(rules) if k in BASE]
    digest = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["rule"] + 1), s["start"], s["stop"])), ",")
    count = lambda n: F.size(F.filter(spans, lambda s: s["rule"] == n)).cast("long")
    counts = [count(n).alias(f"n_{k}") for n, k in enumerate(rules) if k in BASE]
    kept = F.filter(spans, lambda s: s["rule"].isin(base))
    rows = rows.select("doc_id", "h1", "h2").join(found, ["h1", "h2"], "left")
    return rows.select("doc_id", *counts, F.sha2(digest(kept), 256).alias("base_sha256"), digest(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"))


def secrets_sql(rules: Mapping[str, Rule] | None = None) -> str:
    """The same scan in DuckDB, of every text by every rule."""
    rules = rules or RULES
    each = []
    for n, (k, r) in enumerate(rules.items()):
        p = r.pattern.replace("'", "''")
        each.append(f"SELECT r, {n} AS rule, '{k}' AS kind, {r.least} AS least, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', {r.group}) AS v FROM d")
    spans = "coalesce(array_to_string(list(kind || ':' || b || ':' || e ORDER BY b, rule) {f}, ','), '')"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}')::BIGINT AS n_{k}" for k in BASE)
    of_base = spans.format(f=f"FILTER (WHERE kind IN ({', '.join(repr(k) for k in BASE)}))")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
a AS ({' UNION ALL '.join(each)}),
x AS (SELECT r, rule, kind, least, length(m[i]) AS size, length(v[i]) AS held, list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0) AS b
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM a WHERE len(m) > 0)),
s AS (SELECT r, rule, kind, b::BIGINT AS b, (b + size)::BIGINT AS e FROM x WHERE held >= least)
SELECT doc_id, {counts}, sha256({of_base}) AS base_sha256, {spans.format(f='FILTER (WHERE kind IS NOT NULL)')} AS spans, count(kind)::BIGINT AS n_spans
FROM d LEFT JOIN s USING (r) GROUP BY r, doc_id"""
