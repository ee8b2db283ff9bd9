"""Search over a saved index: scores come from the postings of the query's words, and only the best records are read.

Every function takes the folder of an index, for its last version, or a snapshot of a version.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions import text as X
from sparkseek.operators import blocks as B
from sparkseek.operators import index as I
from sparkseek.operators import keys as K
from sparkseek.operators import search as S
from sparkseek.operators.segments import Snapshot, opened
from sparkseek.plans.querylang import ANYWHERE, FIELDS, Node, has_known_field, parse


def statistics(spark: SparkSession, path: str | Snapshot, terms: Sequence[str]) -> Mapping[str, float]:
    """Rows, mean length, and occurrences of each term by field, from the stored tables: a few rows to the driver."""
    known = opened(spark, path).manifest
    n = {(r.field, r.term): r.n for r in I.counts_of(spark, path, sorted(set(terms))).collect()}
    return {"n": known.records, "mean": known.mean} | {f"{c}{i}": n.get((c, t), 0) for i, t in enumerate(terms) for c in S.FIELDS}


def _run(places: Sequence[Column]) -> Column:
    """Whether some place of the first word is followed by the others in turn."""

    def follows(p: Column) -> Column:
        out = F.lit(True)
        for i, c in enumerate(places[1:], 1):
            out = out & F.array_contains(c, p + i)
        return out

    return F.exists(places[0], follows)


def _all(rows: DataFrame) -> DataFrame:
    return rows


def _words(spark: SparkSession, path: str | Snapshot, terms: Sequence[str], only: Callable[[DataFrame], DataFrame] = _all) -> tuple[DataFrame, dict[str, Column]]:
    """``seq``, the sizes and a cell for each distinct term, of the records that hold any; and the cell of each term."""
    names = {t: f"t{i}" for i, t in enumerate(dict.fromkeys(terms))}
    found = only(I.of_terms(spark, path, sorted(names)))
    cell = F.struct("words", "label", "in_heading", "in_body", "in_label", "in_breadcrumb")
    if len(names) == 1:
        rows = found.select("seq", *I.SIZES, cell.alias("t0"))
    else:
        rows = found.groupBy("seq").agg(*[F.first(c).alias(c) for c in I.SIZES], *[F.first(F.when(F.col("term") == t, cell), True).alias(n) for t, n in names.items()])
    return rows, {t: F.col(n) for t, n in names.items()}


def _boost(terms: Sequence[str], cells: Mapping[str, Column]) -> Column:
    """The boost of :func:`search.boosted`, from the places of the terms."""
    if len(terms) < 2:
        return F.lit(1.0)
    of = lambda t, c: F.coalesce(cells[t][c], F.array().cast("array<int>"))
    h, b = [of(t, "in_heading") for t in terms], [of(t, "in_body") for t in terms]
    filled = lambda cs: F.greatest(*[F.when(F.size(c) == 0, 1).otherwise(0) for c in cs]) == 0
    both = [F.concat(x, F.transform(y, lambda p: p + F.col("heading_words"))) for x, y in zip(h, b, strict=True)]
    gaps = [F.when(F.size(both[i]) > 0, F.lit(0)) if terms[i] == terms[j] else X.least_gap(both[i], both[j]) for i in range(len(terms)) for j in range(i + 1, len(terms))]
    return S.boost(_run(h) | _run(b), filled(h) | filled(b), X.closeness(gaps))


def _heads(at: Snapshot, q: str) -> DataFrame:
    """``seq, exact, hl, bl`` of headings that start with the query, a row for each key: a pushed range of the sorted table of headings."""
    key = F.col("key")
    heads = at.live(at.table("headings").where(key.startswith(q) if len(q) >= 2 else key == q))
    return heads.select("seq", ((key == q) & (F.col("heading_length") >= 2)).alias("exact"), F.col("heading_length").alias("hl"), F.col("body_length").alias("bl"))


def matched(spark: SparkSession, path: str | Snapshot, query: str, opts: S.Options, only: Callable[[DataFrame], DataFrame] = _all) -> DataFrame:
    """``seq, stage, word_pos, raw`` of what :func:`search.direct` finds among the rows that ``only`` leaves, without reading a record."""
    q = X.fold_text(query.strip()).lower()
    terms = q.split()
    rows, cells = _words(spark, path, terms, only)
    heads = only(_heads(opened(spark, path), q))
    rows = rows.join(heads.groupBy("seq").agg(F.max("exact").alias("exact"), F.first("hl").alias("hl"), F.first("bl").alias("bl")), "seq", "full")
    heading, body = F.coalesce("heading_length", "hl"), F.coalesce("body_length", "bl")
    word = lambda t: F.coalesce(cells[t]["words"], F.lit(0)) > 0 if len(t) >= 3 else F.lit(False)
    label = lambda t: F.coalesce(cells[t]["label"], F.lit(False)) if len(t) >= 2 else F.lit(False)
    stage, place = S.staged(F.coalesce("exact", F.lit(False)), F.col("exact").isNotNull() & F.lit(len(q) >= 2), [word(t) | label(t) for t in terms])
    rows = rows.withColumns({"stage": stage, "word_pos": place}).where("stage IS NOT NULL")
    raw = S.direct_score(heading, body, terms, opts, lambda: statistics(spark, path, [q, *terms]))
    return rows.select("seq", "stage", "word_pos", (raw * _boost(terms, cells)).alias("raw"))


def weighted(spark: SparkSession, path: str | Snapshot, query: str, opts: S.Options, only: Callable[[DataFrame], DataFrame] = _all) -> DataFrame:
    """``seq, stage, word_pos, raw`` of what :func:`search.bm25f` finds among the rows that ``only`` leaves, without reading a record."""
    terms = X.fold_text(query.strip()).lower().split()
    rows, cells = _words(spark, path, terms, only)
    lengths = {c: F.coalesce(f"{c}_length", F.lit(0)) for c in S.FIELDS}
    places = lambda t, c: F.coalesce(F.size(cells[t][c]), F.lit(0))
    times = lambda t, c: F.coalesce(cells[t][c], F.lit(0))
    counts = [{"heading": places(t, "in_heading"), "body": places(t, "in_body"), "label": times(t, "in_label"), "breadcrumb": times(t, "in_breadcrumb")} for t in terms]
    raw = S.bm25f_score(lengths, counts, statistics(spark, path, terms), opts)
    return rows.withColumn("raw", raw).where("raw > 0").select("seq", F.lit(3).alias("stage"), F.lit(0).alias("word_pos"), (F.col("raw") * _boost(terms, cells)).alias("raw"))


def best(spark: SparkSession, path: str | Snapshot, query: str, opts: S.Options, by: Callable[..., DataFrame] = matched, after: Sequence | None = None) -> B.Best:
    """The first rows of :func:`matched` or :func:`weighted`, after a place in the ranking if one is given.

    Where a word is common, only blocks of records are read whose bound may reach the last of these rows.
    """
    at, q = opened(spark, path), X.fold_text(query.strip()).lower()
    terms, bounds = q.split(), None
    names = list(dict.fromkeys(terms))
    if names and len(names) <= B.TERMS and B.safe(opts):
        rows = B.blocks(at, names)
        if rows is not None and by is matched:
            # As live headings are joined to find their deletions, they are only those of the query.
            bounds = B.direct_bounds(rows, _heads(at, q), terms, opts, lambda: statistics(spark, at, [q, *terms]))
        elif rows is not None:
            bounds = B.weighted_bounds(rows, terms, opts, statistics(spark, at, terms))
    if bounds is not None:
        return B.best(bounds, lambda only: by(spark, at, query, opts, only), opts.limit, after)
    return B.Best(B.first(by(spark, at, query, opts), opts.limit, after), 0, 0)


def following(spark: SparkSession, path: str | Snapshot, query: str, cursor: Sequence | None = None, size: int = 20, **knobs) -> tuple[DataFrame, tuple | None]:
    """A page of direct matches after the last row of the page before, and the cursor of the next one; none at the end.

    A cursor is the place of a row in the ranking, ``(score, stage, word_pos, seq)``, so a page costs the same however deep it is. Pages
    fit together if they are read from one snapshot.
    """
    opts, at = replace(S.Options(), limit=size + 1, **knobs), opened(spark, path)
    found = best(spark, at, query, opts, matched, cursor).rows
    top = found[:size]
    more = tuple(top[-1][c] for c in B.KEY) if len(found) > size else None
    return _fetched(spark, at, top).orderBy(*S._order()).select("seq", "id", F.round("raw", 6).alias("raw")), more


def _plain(opts: S.Options) -> bool:
    return opts.filter is None and not (opts.order or opts.type_weights or opts.diversify or opts.clicks is not None)


def _fetched(spark: SparkSession, path: str | Snapshot, top: list) -> DataFrame:
    """The records of a few scored rows: their sequence numbers prune the sorted table."""
    rows = spark.createDataFrame([(r.seq, r.stage, r.word_pos, r.raw) for r in top], "seq long, stage int, word_pos int, raw double")
    return I.load(spark, path).where(F.col("seq").isin([r.seq for r in top])).join(F.broadcast(rows), "seq")


def search(spark: SparkSession, path: str | Snapshot, query: str, opts: S.Options | None = None, **knobs) -> DataFrame:
    """The same rows as :func:`search.search` over the saved records.

    Plain searches take the best ``limit`` rows of the postings and read only their records. Those that filter, boost or
    order by columns score the records that match. What the postings can't answer (extended syntax, fuzzy matches)
    reads the records, with the stored statistics.
    """
    opts = replace(opts or S.Options(), **knobs)
    at = opened(spark, path)
    opts = replace(opts, stats=lambda terms: statistics(spark, at, terms))
    if not query.strip():
        return S.search(I.load(spark, at), query, opts)
    syntax = any(c in query for c in "'!^$|") or has_known_field(query)
    if opts.extended and opts.extended_first and syntax:
        return S.shown(S.finished(extended(spark, at, query, opts), opts).limit(opts.limit), opts)
    stages = [matched]
    if opts.scoring == "bm25f":
        stages = [weighted, matched] if opts.bm25f_always else [matched, weighted]
    for stage in stages:
        if _plain(opts):
            if top := best(spark, at, query, opts, stage).rows:
                return S.shown(_fetched(spark, at, top).orderBy(*S._order()), opts)
        elif not (found := stage(spark, at, query, opts)).limit(1).isEmpty():
            direct = replace(opts, fuzzy=False, extended=False)
            return S.search(I.load(spark, at).join(found.select("seq"), "seq", "left_semi"), query, direct)
    after: list[Callable[[], DataFrame]] = []
    if opts.fuzzy:
        after += [lambda d=d: fuzzy(spark, at, query, d, opts) for d in (1, 2) if d <= opts.fuzzy_distance]
    if opts.extended or has_known_field(query):
        after.append(lambda: extended(spark, at, query, opts))
    rows = I.load(spark, at).where(F.lit(False)).withColumns({"raw": F.lit(0.0), "stage": F.lit(2), "word_pos": F.lit(0)})
    for stage in after:
        rows = stage()
        if stage is not after[-1] and not rows.limit(1).isEmpty():
            break
    return S.shown(S.finished(rows, opts).limit(opts.limit), opts)


#: Terms that a look-up names one by one; more of them are joined.
NAMED = 256


def _held(field: str) -> Column:
    """Whether a posting is of a field."""
    return (F.size(f"in_{field}") if field in ("heading", "body") else F.col(f"in_{field}")) > 0


def terms_like(at: Snapshot, piece: str, test: Column) -> DataFrame:
    """``term``: distinct terms of the dictionary that hold a piece and pass a test; by one of its trigrams, if it has any."""
    rows = at.pruned("grams", "gram", [piece[len(piece) // 2 - 1 : len(piece) // 2 + 2]]) if len(piece) >= 3 else at.table("terms")
    return rows.where(test).select("term").distinct()


def postings_like(at: Snapshot, terms: DataFrame) -> DataFrame:
    """Live postings of the terms: a few are looked up by name, more are joined."""
    few = terms.limit(NAMED + 1).collect()
    if len(few) <= NAMED:
        return I.of_terms(at.spark, at, [r.term for r in few])
    return at.live(at.table("postings").join(terms, "term", "left_semi"))


def _candidates(at: Snapshot, node: Node) -> DataFrame | None:
    """``seq`` of all records that may satisfy a part of an extended query; none if the index can't tell."""
    v = node.value.lower()
    if node.kind in ("and", "or"):
        sets = [_candidates(at, c) for c in node.children]
        if node.kind == "or":
            return None if not sets or any(s is None for s in sets) else reduce(DataFrame.union, sets).distinct()
        sets = [s for s in sets if s is not None]
        return reduce(lambda a, b: a.join(b, "seq", "left_semi"), sets) if sets else None
    term = F.col("term")
    if node.kind == "exact":
        words = v.split()
        if not words:
            return None
        rows, cells = _words(at.spark, at, words)
        of = lambda t, c: F.coalesce(cells[t][c], F.array().cast("array<int>"))
        return rows.where(_run([of(t, "in_heading") for t in words]) | _run([of(t, "in_body") for t in words])).select("seq")
    if node.kind == "term":
        m = re.fullmatch(r"([\w-]+):(.+)", node.value, re.S)
        fields, v = (FIELDS.get(m[1].lower(), ANYWHERE), m[2].lower()) if m else (ANYWHERE, v)
        if "type" in fields:
            return None
        rows = postings_like(at, terms_like(at, v, term.contains(v))).where(reduce(Column.__or__, map(_held, fields)))
    elif node.kind == "prefix":
        first = lambda c: F.coalesce(F.get(c, F.lit(0)) == 0, F.lit(False))
        rows = postings_like(at, terms_like(at, v[:3] if len(v) > 2 else v, term.startswith(v))).where(first("in_heading") | first("in_body"))
    elif node.kind == "suffix":
        rows = postings_like(at, terms_like(at, v[-3:] if len(v) > 2 else v, term.endswith(v))).where(_held("heading") | _held("body"))
    else:
        return None
    return rows.select("seq").distinct()


def _of(spark: SparkSession, at: Snapshot, found: DataFrame | None) -> DataFrame:
    rows = I.load(spark, at)
    return rows if found is None else rows.join(found.select("seq").distinct(), "seq", "left_semi")


def extended(spark: SparkSession, path: str | Snapshot, query: str, opts: S.Options) -> DataFrame:
    """The same as :func:`search.extended`: substrings are looked up among the distinct terms, phrases by places, and only records
    that the postings leave are read and tested. A query of exclusions or types alone reads all records."""
    at = opened(spark, path)
    return S.extended(_of(spark, at, _candidates(at, parse(query.strip()))), query, opts)


def _near_terms(q: str, distance: int):
    """A pandas UDF: whether some stretch of a text around a term, of the query's length and with one of its pieces in the term, may be
    within the distance. What is beside the term is unknown, but for the white space next to it."""
    n, pieces = len(q), S.pieces_of(q, distance)
    joker = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in q)
    edge = joker if re.search(r"\s", q) else " "

    def slices(t: str) -> Iterator[str]:
        wide = joker * n + edge + t + edge + joker * n
        for p in pieces:
            i = wide.find(p, n + 1)
            while i >= 0:
                yield wide[max(0, i + len(p) - n) : i + n]
                i = wide.find(p, i + 1)

    @F.pandas_udf("boolean")
    def udf(terms: pd.Series) -> pd.Series:
        cut = [list(slices(t)) for t in terms]
        flat = S.least_distances([s for c in cut for s in c], q, joker)
        out, k = [], 0
        for c in cut:
            out.append(bool((flat[k : k + len(c)] <= distance).any()))
            k += len(c)
        return pd.Series(out)

    return udf


def fuzzy(spark: SparkSession, path: str | Snapshot, query: str, distance: int, opts: S.Options) -> DataFrame:
    """The same as :func:`search.fuzzy`: only records are read whose heading is near the query, or that have a term which holds a piece
    of it and whose surroundings may be near it."""
    at, q = opened(spark, path), query.strip().lower()
    pieces = [max(p.split(), key=len, default="") for p in S.pieces_of(q, distance)]
    if len(q) <= distance or not all(pieces):
        return S.fuzzy(I.load(spark, at), query, distance, opts)
    whole = not re.search(r"\s", q)
    terms = reduce(DataFrame.union, [terms_like(at, p, F.col("term").contains(p)) for p in pieces]).distinct()
    # A piece with a space in it ends one term and starts another, so its longest part is only held by one of them.
    terms = terms.where(_near_terms(q, distance)("term")) if whole else terms
    found = postings_like(at, terms).where(_held("body")).select("seq")
    near = neighbours(at, q, distance).where("tier = 0").select("key").distinct()
    found = found.union(at.live(at.table("headings").join(near, "key", "left_semi")).select("seq"))
    return S.fuzzy(_of(spark, at, found), query, distance, opts)


def neighbours(at: Snapshot, word: str, distance: int = K.EDITS) -> DataFrame:
    """``key, tier, seq, pos, segment, distance`` of headings and body words within some edits of a word, at most K.EDITS."""
    rows = at.pruned("neighbours", "variant", K.variants(word, distance)).withColumn("distance", F.levenshtein("key", F.lit(word), distance))
    return rows.where(F.col("distance").between(0, distance)).select("key", "tier", "seq", "pos", "segment", "distance").distinct()


def closest_word(spark: SparkSession, path: str | Snapshot, word: str, distance: int = K.EDITS) -> DataFrame:
    """The same as :func:`search.closest_word`, from the table of words by their parts.

    Where records were deleted, the first places of the nearest keys are those of live postings.
    """
    at, q = opened(spark, path), word.lower()
    order = ["distance", "tier", "seq", "pos"]
    near = neighbours(at, q, distance).where((F.length("key") >= 2) & F.lit(len(q) >= 2))
    if any(s.delta for s in at.manifest.segments):
        keys = near.select("key", "tier", "distance").distinct()
        heads = at.live(at.table("headings").where(F.col("key") == F.lower("heading")).join(keys.where("tier = 0"), "key")).select("key", "distance", "tier", "seq", F.lit(0).alias("pos"))
        named = keys.where("tier = 1").withColumnRenamed("key", "term")
        words = postings_like(at, named.select("term")).where(_held("body")).join(named, "term")
        near = heads.union(words.select("term", "distance", "tier", "seq", F.element_at("in_body", 1)))
    return near.orderBy(*order).limit(1).select("key", "distance")


def suggest(spark: SparkSession, path: str | Snapshot, query: str, limit: int = 10) -> DataFrame:
    """The same as :func:`search.suggest`: from the stored completions of a prefix, if they are enough, else from the table of headings."""
    at, q = opened(spark, path), query.strip().lower()
    if 2 <= len(q) <= K.PREFIX and limit <= K.STORED and not any(s.delta for s in at.manifest.segments):
        top = at.pruned("completions", "prefix", [q]).groupBy("heading").agg(F.min("seq").alias("seq")).orderBy("seq").limit(limit).collect()  # at most ``limit`` rows
        if len(top) == limit:
            return spark.createDataFrame([(r.heading, 0, r.seq) for r in top], "heading string, tier int, seq long")
    key = F.col("key")
    tier = F.when(key.startswith(q), 0).when((F.length("heading") >= 2) & key.contains(q), 1)
    rows = at.live(at.table("headings").where(key.contains(q) & F.lit(len(q) >= 2)))
    first = rows.withColumn("tier", tier).where("tier IS NOT NULL").groupBy("heading").agg(F.min(F.struct("tier", "seq")).alias("m"))
    return first.orderBy("m").limit(limit).select("heading", F.col("m.tier").alias("tier"), F.col("m.seq").alias("seq"))


def total(spark: SparkSession, path: str | Snapshot, query: str) -> DataFrame:
    """How many records match directly, from the postings alone."""
    return matched(spark, path, query, S.Options()).agg(F.count("*").alias("total"))


def page(spark: SparkSession, path: str | Snapshot, query: str, cursor: str | None = None, size: int = 20, **knobs) -> DataFrame:
    """The same as :func:`search.page` for what the postings answer: a count and a top-k of scored rows, then one page of records."""
    opts = replace(S.Options(), **knobs)
    found, at, size = matched(spark, path, query, opts), max(0, int(cursor or 0)), max(1, size)
    n = found.count()
    top = found.orderBy(*S._order()).offset(at).limit(size).collect()  # at most ``size`` rows
    return S.paged(_fetched(spark, path, top).orderBy(*S._order()), at, size, n)
