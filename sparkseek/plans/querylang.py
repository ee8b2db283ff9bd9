"""The extended query syntax and the field syntax, parsed on the driver into Column predicates."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.functions import text as X

FIELDS = {"title": ("heading",), "heading": ("heading",), "body": ("body",), "label": ("label",), "breadcrumb": ("breadcrumb",), "type": ("type",)}
ANYWHERE = ("heading", "body", "label", "breadcrumb")
_LEX = re.compile(r"""\s+|'(?P<exact>[^']+)'|!(?P<exclude>\S+)|\^(?P<prefix>\S+)|(?P<or>\|)|(?P<suffix>\S+)\$(?=\s|$)|(?P<term>\S+)""")


@dataclass(frozen=True)
class Node:
    """``kind`` is and, or, term, exact, exclude, prefix or suffix."""

    kind: str
    value: str = ""
    children: tuple[Node, ...] = ()


def parse(query: str) -> Node:
    """Words are joined by AND; ``|`` joins its two neighbours, and chains of them, by OR."""
    groups: list[list[Node]] = []
    joined = False
    for m in _LEX.finditer(query):
        kind = m.lastgroup
        if kind == "or":
            joined = bool(groups)
        elif kind:
            node = Node(kind, m[kind])
            if joined:
                groups[-1].append(node)
            else:
                groups.append([node])
            joined = False
    return Node("and", children=tuple(g[0] if len(g) == 1 else Node("or", children=tuple(g)) for g in groups))


def has_known_field(query: str) -> bool:
    return bool(re.search(rf"\b(?:{'|'.join(FIELDS)}):\S+", query, re.I))


def predicate(node: Node) -> Column:
    low = lambda c: F.coalesce(F.lower(c), F.lit(""))
    v = node.value.lower()
    if node.kind in ("and", "or"):
        out = F.lit(node.kind == "and")
        for child in node.children:
            out = out & predicate(child) if node.kind == "and" else out | predicate(child)
        return out
    if node.kind == "term":
        m = re.fullmatch(r"([\w-]+):(.+)", node.value, re.S)
        columns, v = (FIELDS.get(m[1].lower(), ANYWHERE), m[2].lower()) if m else (ANYWHERE, v)
        tests = [low(c).contains(v) for c in columns]
    elif node.kind == "exact":
        tests = [X.has_phrase(X.words(F.col(c)), v.split()) for c in ("heading", "body")]
    elif node.kind == "exclude":
        return ~low("heading").contains(v) & ~low("body").contains(v)
    elif node.kind == "prefix":
        tests = [low(c).startswith(v) for c in ("heading", "body")]
    else:
        tests = [low(c).endswith(v) for c in ("heading", "body")]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


@dataclass(frozen=True)
class FieldQuery:
    terms: tuple[str, ...]
    fields: Mapping[str, str]


def parse_fields(query: str) -> FieldQuery:
    """``name:value`` pairs (the last wins, quotes may hold spaces) and the other words."""
    terms, fields = [], {}
    for token in re.findall(r'(?:[^\s"]+|"[^"]*")+', query):
        m = re.fullmatch(r"([\w-]+):(.+)", token)
        bare = (m[2] if m else token).removeprefix('"').removesuffix('"')
        if m:
            fields[m[1].lower()] = bare
        else:
            terms.append(bare)
    return FieldQuery(tuple(terms), fields)


def matches_fields(q: FieldQuery, columns: Sequence[str]) -> Column:
    """All fields contain their values, in any case; an unknown field is empty."""
    out = F.lit(True)
    for name, value in q.fields.items():
        c = {"title": "heading"}.get(name, name)
        held = F.coalesce(F.lower(F.col(c).cast("string")), F.lit("")) if c in columns else F.lit("")
        out = out & held.contains(value.lower())
    return out


def field_boost(q: FieldQuery, boosts: Mapping[str, float] | None = None) -> float:
    out = 1.0
    for name in q.fields:
        out *= (boosts or {}).get(name, 1.25)
    return out


def expanded(queries: DataFrame, synonyms: DataFrame, history: DataFrame) -> DataFrame:
    """``query, alternative`` for ``queries(query)``: itself, synonyms in place of a word, past queries that hold it."""
    q = queries.select(F.trim("query").alias("query"))
    words = q.select("query", F.explode(F.filter(F.split("query", X.SPACES), lambda t: t != "")).alias("word"))
    swapped = words.join(synonyms, F.lower("word") == F.col("term")).select("query", F.array_join(F.array_append(F.filter(F.split("query", X.SPACES), lambda t: t != F.col("word")), F.col("synonym")), " ").alias("alternative"))
    # A past query is matched against each query by containment: both lists are short.
    past = q.join(history, F.contains(F.lower("past"), F.lower("query")) & (F.col("past") != F.col("query"))).select("query", F.col("past").alias("alternative"))
    return q.select("query", F.col("query").alias("alternative")).unionByName(swapped).unionByName(past).distinct()


def phonetic_alternatives(terms: DataFrame) -> DataFrame:
    """``term, alternative`` for ``terms(term)``: itself and its phonetic code; nothing for a term without a letter A to Z."""
    rows = terms.select("term", X.soundex(F.col("term")).alias("code")).where("code <> ''")
    return rows.select("term", F.explode(F.array("term", "code")).alias("alternative"))
