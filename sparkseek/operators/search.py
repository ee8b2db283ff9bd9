"""Staged lexical search over records ``(seq, id, heading, body, label, breadcrumb, type)``.

Every stage is one filter-and-project over the records, so a query is a single scan whose best rows come
from a top-k, without a shuffle of the corpus. Later stages only run if the earlier ones found nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkseek.functions import text as X
from sparkseek.plans.querylang import has_known_field, parse, predicate

FIELDS = ("heading", "body", "label", "breadcrumb")
WEIGHTS = {"heading": 2.0, "body": 1.0, "label": 1.5, "breadcrumb": 0.5}


@dataclass(frozen=True)
class Options:
    """Knobs of a search. ``filter`` and ``order`` are applied after scoring, as they must not change which stage answers."""

    limit: int = 8
    weights: Mapping[str, float] = field(default_factory=dict)
    scoring: str = "classic"  # or bm25, bm25f
    k1: float = 1.5
    b: float = 0.75
    bm25f_always: bool = False
    fuzzy: bool = False
    fuzzy_distance: int = 2
    extended: bool = False
    extended_first: bool = True
    filter: Column | None = None
    order: Sequence[Column] = ()
    type_weights: Mapping[str, float] = field(default_factory=dict)
    diversify: bool = False
    mmr_lambda: float = 0.5
    pool: int = 100
    clicks: DataFrame | None = None  # query, record_id, count
    popularity_boost: float = 1.2
    stats: Callable[[Sequence[str]], Mapping[str, float]] | None = None  # stored statistics, in place of a pass over the records


def _stats(records: DataFrame, terms: Sequence[str], opts: Options) -> Mapping[str, float]:
    """Rows, mean length, and the occurrences of each term by field: one aggregate, one row to the driver."""
    if opts.stats:
        return opts.stats(terms)
    aggs = [F.count("*").alias("n"), F.avg(F.length("body") + F.length("heading")).alias("mean")]
    for i, t in enumerate(terms):
        aggs += [F.sum(X.term_count(F.col(c), t) if len(t) >= 2 else F.lit(0)).alias(f"{c}{i}") for c in FIELDS]
    return records.agg(*aggs).first().asDict()


def _bm25(df: float, size: Column, stats: Mapping, opts: Options) -> Column:
    idf = F.log((F.lit(float(stats["n"])) - df + 0.5) / (df + 0.5) + 1)
    norm = 1 - opts.b + opts.b * (size / F.lit(stats["mean"] or 50.0))
    return idf * ((opts.k1 + 1) / (1 + opts.k1 * norm))


def staged(exact: Column, prefix: Column, held: Sequence[Column]) -> tuple[Column, Column]:
    """Stage (0 exact heading, 1 heading prefix, 2 words, else null) and the place of the first word held in stage 2."""
    stage, place = F.when(exact, 0).when(prefix, 1), F.lit(0)
    for i in reversed(range(len(held))):
        place = F.when(held[i], F.lit(i)).otherwise(place)
    for h in held:
        stage = F.coalesce(stage, F.when(h, 2))
    return stage, F.when(stage == 2, place).otherwise(F.lit(0))


def direct_score(heading: Column, body: Column, terms: Sequence[str], opts: Options, stats: Callable[[], Mapping], stage: Column | None = None, place: Column | None = None) -> Column:
    """Score of a row from its ``stage``, ``word_pos`` (or other columns) and the lengths of its heading and body, before boosts."""
    w = WEIGHTS | dict(opts.weights)
    stage, place = F.col("stage") if stage is None else stage, F.col("word_pos") if place is None else place
    base = F.when(stage == 0, 100.0).when(stage == 1, 50.0).otherwise(20.0)
    if opts.scoring == "bm25":
        known = stats()
        df = lambda i: float(known[f"body{i}"] or 0) or 1.0
        score = _bm25(df(0), heading + body, known, opts)
        for i in range(len(terms)):
            score = F.when((stage == 2) & (place == i), _bm25(df(i + 1), heading + body, known, opts)).otherwise(score)
        return base * score
    by_heading = base * w["heading"] * (1 + X.length_share(heading))
    return F.when(stage < 2, by_heading).otherwise(base * w["body"] * (1 + X.length_share(body)))


def direct(records: DataFrame, query: str, opts: Options) -> DataFrame:
    """Exact heading, heading prefix, then body words; each record counts once, at its best stage."""
    q = X.fold_text(query.strip()).lower()
    terms = q.split()
    h, b, label = F.lower("heading"), F.lower("body"), F.lower("label")
    hf = X.fold(h)
    exact = (F.length("heading") >= 2) & ((h == q) | (hf == q))
    prefix = (h.startswith(q) | hf.startswith(q)) if len(q) >= 2 else F.lit(False)
    hit = lambda t: F.array_contains(F.split(b, X.SPACES), t)
    accented = lambda t: (F.length(b) != F.octet_length(b)) & F.array_contains(F.split(X.fold(b), X.SPACES), t)
    word = lambda t: ((b.contains(t) & hit(t)) | accented(t)) if len(t) >= 3 else F.lit(False)
    stage, place = staged(exact, prefix, [word(t) | ((label == t) if len(t) >= 2 else F.lit(False)) for t in terms])
    rows = records.withColumns({"stage": stage, "word_pos": place}).where("stage IS NOT NULL")
    raw = direct_score(F.length("heading"), F.length("body"), terms, opts, lambda: _stats(records, [q, *terms], opts))
    return boosted(rows.withColumn("raw", raw), terms)


def bm25f_score(lengths: Mapping[str, Column], counts: Sequence[Mapping[str, Column]], stats: Mapping, opts: Options) -> Column:
    """Field-weighted BM25 from the length of each field (0 for none) and how often each term is in it."""
    w = WEIGHTS | dict(opts.weights)
    size = sum((lengths[c] * F.lit(float(w[c])) for c in FIELDS), F.lit(0.0))
    norm = 1 - opts.b + opts.b * (size / F.lit(stats["mean"] or 50.0))
    total = F.lit(0.0)
    for i, n in enumerate(counts):
        df = [float(stats[f"{c}{i}"] or 0) or 1.0 for c in FIELDS]
        known = F.greatest(F.lit(max(df[:2])), *[F.when(lengths[c] > 0, F.lit(d)) for c, d in zip(FIELDS[2:], df[2:], strict=True)])
        tf = sum((n[c] * F.lit(float(w[c])) for c in FIELDS), F.lit(0.0))
        idf = F.log((F.lit(float(stats["n"])) - known + 0.5) / (known + 0.5) + 1)
        total = total + F.when(tf > 0, idf * (tf * (opts.k1 + 1) / (tf + opts.k1 * norm))).otherwise(F.lit(0.0))
    return total * 100


def bm25f(records: DataFrame, query: str, opts: Options) -> DataFrame:
    """Field-weighted BM25 of all terms; rows without any term drop out."""
    terms = X.fold_text(query.strip()).lower().split()
    stats = _stats(records, terms, opts)
    lengths = {c: F.coalesce(F.length(c), F.lit(0)) for c in FIELDS}
    counts = [{c: F.coalesce(X.term_count(F.col(c), t), F.lit(0)) for c in FIELDS} for t in terms]
    rows = records.withColumn("raw", bm25f_score(lengths, counts, stats, opts)).where("raw > 0")
    return boosted(rows.withColumn("stage", F.lit(3)).withColumn("word_pos", F.lit(0)), terms)


def boosted(rows: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Half as much again for the whole phrase in one field; else by closeness, if one field holds all terms."""
    if len(terms) < 2:
        return rows
    h, b = X.words(F.col("heading")), X.words(F.col("body"))
    every = lambda tokens: F.size(F.array_except(F.array(*map(F.lit, terms)), tokens)) == 0
    return rows.withColumn("raw", F.col("raw") * boost(X.has_phrase(h, terms) | X.has_phrase(b, terms), every(h) | every(b), X.proximity(F.concat(h, b), terms)))


def boost(phrase: Column, every: Column, near: Column) -> Column:
    return F.when(phrase, F.lit(1.5)).otherwise(F.when(every, near).otherwise(F.lit(1.0)))


def popular(rows: DataFrame, query: str, opts: Options) -> DataFrame:
    """Boost rows that were clicked for the same query, folded and in lower case."""
    q = X.fold_text(query.strip()).lower()
    clicks = opts.clicks.where(X.fold(F.lower(F.trim("query"))) == q).groupBy(F.col("record_id").alias("id")).agg(F.sum("count").alias("clicks"))
    boost = F.when(F.col("clicks").isNotNull(), (1 + (F.col("clicks") - 1) * 0.1) * opts.popularity_boost).otherwise(F.lit(1.0))
    return rows.join(clicks, "id", "left").withColumn("raw", F.col("raw") * boost).drop("clicks")


def least_distances(texts: list[str], q: str, joker: str | None = None) -> np.ndarray:
    """Least edit distance between ``q`` and any stretch of its length in each text; more than that length for shorter texts.

    The usual table of distances is filled for all stretches of all texts at once. A ``joker`` in a text equals every character.
    """
    asked, n, any_of = [ord(c) for c in q], len(q), ord(joker) if joker else -1
    kind = np.uint8 if n < 200 else np.uint32
    none = np.iinfo(kind).max
    a = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    found = np.full(max(0, len(a) - n + 1) + 1, none, kind)
    for at in range(0, len(found) - 1, 1 << 15):
        part = np.lib.stride_tricks.sliding_window_view(a[at : at + (1 << 15) + n - 1], n)
        row = [np.full(len(part), j, kind) for j in range(n + 1)]
        for i in range(n):
            before, row[0] = row[0], np.full(len(part), i + 1, kind)
            for j in range(1, n + 1):
                step = np.minimum(np.minimum(row[j], row[j - 1]) + kind(1), before + ((part[:, i] != asked[j - 1]) & (part[:, i] != any_of)))
                before, row[j] = row[j], step
        found[at : at + len(part)] = row[n]
    out, start = np.full(len(texts), none, kind), np.cumsum(size) - size
    long = np.flatnonzero(size >= n)
    if len(long):
        ends = np.stack([start[long], start[long] + size[long] - n + 1], axis=1).ravel()  # stretches within a text
        out[long] = np.minimum.reduceat(found, ends)[::2]
    return out


def pieces_of(q: str, distance: int) -> list[str]:
    """A word in one piece more than it may have edits: what is so close to it holds one of them verbatim."""
    cuts = [len(q) * i // (distance + 1) for i in range(distance + 2)]
    return [q[a:z] for a, z in zip(cuts, cuts[1:], strict=False) if z > a]


def window_distance(q: str, distance: int):
    """A pandas UDF: least edit distance between ``q`` and any stretch of its length in a text, null beyond ``distance``.

    Time grows with the length of the texts, which are taken some millions of characters at a time.
    """
    @F.pandas_udf("int")
    def udf(texts: pd.Series) -> pd.Series:
        out, kept, held = [], [], 0
        for t in [t if isinstance(t, str) else "" for t in texts]:
            kept.append(t)
            held += len(t)
            if held > 1 << 22:
                out.append(least_distances(kept, q))
                kept, held = [], 0
        if kept:
            out.append(least_distances(kept, q))
        got = pd.Series(np.concatenate(out).astype(np.int64) if out else [], dtype="Int64")
        return got.where(got <= distance).astype("Int32")

    return udf


def fuzzy(records: DataFrame, query: str, distance: int, opts: Options) -> DataFrame:
    """Rows within ``distance`` edits of the query: the heading as a whole, else the best window of the body.

    Only rows that own an index key of nearly the query's length are compared. A window within d edits
    holds one of d + 1 pieces of the query verbatim; only bodies that hold one leave the JVM.
    """
    q, w, n = query.strip().lower(), WEIGHTS | dict(opts.weights), len(query.strip())
    if not n:
        return records.where(F.lit(False)).withColumns({"raw": F.lit(0.0), "stage": F.lit(3 + distance), "word_pos": F.lit(0)})
    low = records.withColumn("h", F.lower("heading")).withColumn("b", F.lower("body"))
    band = lambda c: F.abs(F.length(c) - n) <= distance
    owner = ((F.length("h") >= 2) & band(F.col("h"))) | F.exists(F.split("b", X.SPACES), lambda t: (F.length(t) >= 3) & band(t)) | ((F.length("label") >= 2) & band(F.col("label")))
    held = F.lit(False)
    for p in pieces_of(q, distance):
        held = held | F.col("b").contains(p)
    by_heading = F.levenshtein("h", F.lit(q), distance)  # -1 beyond the bound
    if distance == 1:
        by_heading = F.when(~F.col("h").contains(q), by_heading)
    near = F.coalesce(F.col("hd"), F.lit(-1)) >= 0
    rows = low.where(owner).withColumn("hd", by_heading).where(near | held)
    rows = rows.withColumn("bd", window_distance(q, distance)(F.when(~near, F.col("b"))))
    top = {1: (60.0, 40.0), 2: (30.0, 20.0)}[distance]
    close = lambda d, c: 1 - F.col(d) / F.greatest(F.lit(n), F.length(c))
    from_heading = close("hd", "h") * top[0] * w["heading"] * (1 + X.length_norm(F.col("heading")))
    from_body = close("bd", "b") * top[1] * w["body"] * (1 + X.length_norm(F.col("body")))
    raw = F.when(F.col("hd") >= 0, from_heading).when(F.col("bd") >= 0, from_body)
    return rows.withColumn("raw", raw).where("raw IS NOT NULL").withColumn("stage", F.lit(3 + distance)).withColumn("word_pos", F.lit(0)).drop("h", "b", "hd", "bd")


def extended(records: DataFrame, query: str, opts: Options) -> DataFrame:
    """Rows that satisfy a query in the extended syntax."""
    w = WEIGHTS | dict(opts.weights)
    rows = records.where(predicate(parse(query.strip())))
    return rows.withColumn("raw", 50.0 * w["heading"] * (1 + X.length_norm(F.col("heading")))).withColumn("stage", F.lit(6)).withColumn("word_pos", F.lit(0))


def scored(records: DataFrame, query: str, opts: Options) -> DataFrame:
    """All rows of the first stage that finds any, with ``raw``, ``stage`` and ``word_pos``."""
    syntax = any(c in query for c in "'!^$|") or has_known_field(query)
    if opts.extended and opts.extended_first and syntax:
        return extended(records, query, opts)
    stages: list[Callable[[], DataFrame]] = [lambda: direct(records, query, opts)]
    if opts.scoring == "bm25f":
        stages.insert(0 if opts.bm25f_always else len(stages), lambda: bm25f(records, query, opts))
    after: list[Callable[[], DataFrame]] = []
    if opts.fuzzy:
        after += [lambda d=d: fuzzy(records, query, d, opts) for d in (1, 2) if d <= opts.fuzzy_distance]
    if opts.extended or has_known_field(query):
        after.append(lambda: extended(records, query, opts))
    for k, stage in enumerate([*stages, *after]):
        rows = stage()
        last = k == len(stages) + len(after) - 1
        if last or not rows.limit(1).isEmpty():
            return popular(rows, query, opts) if opts.clicks is not None and k < len(stages) else rows
    raise AssertionError("no stage")


def diversified(rows: DataFrame, opts: Options) -> DataFrame:
    """Maximal marginal relevance over the best ``pool`` rows.

    A row's score becomes (1 - l) score + l (1 - its greatest Jaccard likeness to a better row); the best
    keeps its own. As rows are inserted before the first smaller score, one sort gives the same order.
    """
    best = rows.orderBy(*_order()).limit(opts.pool)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(*_order())))  # at most `pool` rows
    tokens = F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", "heading", "body")), X.SPACES), lambda t: F.length(t) > 2))
    a = ranked.withColumn("tokens", tokens)
    b = a.select(F.col("rank").alias("r"), F.col("tokens").alias("t"))
    both, union = F.size(F.array_intersect("tokens", "t")), F.size(F.array_union("tokens", "t"))
    like = F.when((F.size("tokens") == 0) | (F.size("t") == 0), 0.0).otherwise(both / union)
    pairs = a.join(b, F.col("r") < F.col("rank")).groupBy("rank").agg(F.max(like).alias("like"))
    out = ranked.join(pairs, "rank", "left")
    lam = opts.mmr_lambda
    mixed = F.when(F.col("rank") == 1, F.col("raw")).otherwise((1 - lam) * F.col("raw") + lam * (1 - F.coalesce("like", F.lit(0.0))))
    return out.withColumn("raw", mixed).withColumn("place", F.col("rank")).drop("like", "rank")


def _order() -> list[Column]:
    """Best first. Scores count to 9 digits, so that equal ones tie on any machine; then stage, word and row."""
    return [F.round("raw", 9).desc(), F.asc("stage"), F.asc("word_pos"), F.asc("seq")]


def ranked(records: DataFrame, query: str, opts: Options | None = None, **knobs) -> DataFrame:
    """The matching records in rank order, unlimited; all records by ``seq`` for an empty query."""
    opts = replace(opts or Options(), **knobs)
    if not query.strip():
        rows = records.withColumns({"raw": F.lit(0.0), "stage": F.lit(0), "word_pos": F.lit(0)})
        return rows.orderBy("seq")
    return finished(scored(records, query, opts), opts)


def finished(rows: DataFrame, opts: Options) -> DataFrame:
    """Scored rows filtered, boosted by type, diversified and in order."""
    if opts.filter is not None:
        rows = rows.where(opts.filter)
    if opts.type_weights:
        boost = F.lit(1.0)
        for k, v in opts.type_weights.items():
            boost = F.when(F.col("type") == k, F.lit(float(v))).otherwise(boost)
        rows = rows.withColumn("raw", F.col("raw") * boost)
    if opts.diversify:
        return diversified(rows, opts).orderBy(F.round("raw", 9).desc(), "place")
    return rows.orderBy(*(opts.order or _order()))


def search(records: DataFrame, query: str, opts: Options | None = None, **knobs) -> DataFrame:
    """The best ``limit`` records: ``seq, id, heading, type, stage, raw, score`` (1 - raw / 200, held to 0 to 1)."""
    opts = replace(opts or Options(), **knobs)
    return shown(ranked(records, query, opts).limit(opts.limit), opts)


def shown(rows: DataFrame, opts: Options) -> DataFrame:
    top = 100.0 if opts.scoring == "bm25" else 200.0
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("raw") / top))
    return rows.select("seq", "id", "heading", "type", "stage", F.round("raw", 6).alias("raw"), F.round(score, 6).alias("score"))


def total(records: DataFrame, query: str, **knobs) -> DataFrame:
    """How many records match."""
    return ranked(records, query, **knobs).agg(F.count("*").alias("total"))


def page(records: DataFrame, query: str, cursor: str | None = None, size: int = 20, **knobs) -> DataFrame:
    """A page of the ranking with ``total``, ``next_cursor`` and ``has_more`` on each row."""
    at, size = max(0, int(cursor or 0)), max(1, size)
    rows = ranked(records, query, **knobs)
    return paged(rows.offset(at).limit(size), at, size, rows.count())


def paged(rows: DataFrame, at: int, size: int, n: int) -> DataFrame:
    more = at + size < n
    rows = rows.select("seq", "id", F.round("raw", 6).alias("raw"))
    return rows.withColumns({"total": F.lit(n).cast("long"), "has_more": F.lit(more), "next_cursor": F.lit(str(at + size) if more else None).cast("string")})


def category(records: DataFrame, query: str, kinds: Sequence[str], limit: int = 8, pool: int = 100) -> DataFrame:
    """The best records of some types among the best ``pool``."""
    rows = ranked(records, query).limit(pool).where(F.col("type").isin(*kinds))
    return rows.orderBy(*_order()).limit(limit).select("seq", "id", "type", F.round("raw", 6).alias("raw"))


def closest_word(records: DataFrame, word: str, distance: int = 2) -> DataFrame:
    """The index key of least edit distance to a word: headings before body words, then by first record."""
    q = word.lower()
    keys = records.select(F.lit(0).alias("tier"), "seq", F.lit(0).alias("pos"), F.lower("heading").alias("key"))
    body = records.select(F.lit(1).alias("tier"), "seq", F.posexplode(F.split(F.lower("body"), X.SPACES)).alias("pos", "key")).where(F.length("key") >= 3)
    every = keys.where(F.length("key") >= 2).unionByName(body).where(F.abs(F.length("key") - len(q)) <= distance)
    near = every.withColumn("distance", F.levenshtein("key", F.lit(q), distance)).where(F.col("distance").between(0, distance) & F.lit(len(q) >= 2))
    return near.orderBy("distance", "tier", "seq", "pos").limit(1).select("key", "distance")


def suggest(records: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Distinct headings for completion: those that start with the query, then those that hold it."""
    q = query.strip().lower()
    h = F.lower("heading")
    tier = F.when(h.startswith(q) | X.fold(h).startswith(q), 0).when((F.length("heading") >= 2) & (h.contains(q) | X.fold(h).contains(q)), 1)
    rows = records.withColumn("tier", tier).where(F.col("tier").isNotNull() & F.lit(len(q) >= 2))
    first = rows.groupBy("heading").agg(F.min(F.struct("tier", "seq")).alias("m"))
    return first.orderBy("m").limit(limit).select("heading", F.col("m.tier").alias("tier"), F.col("m.seq").alias("seq"))


def spans(rows: DataFrame, query: str) -> DataFrame:
    """Adds ``key, start, end``: the first occurrence of the query in the scored field, else its beginning."""
    q = query.strip().lower()
    key = F.when(F.col("stage") < 2, F.lit("heading")).otherwise(F.lit("body"))
    text = F.when(key == "heading", F.col("heading")).otherwise(F.col("body"))
    at = F.instr(F.lower(text), q) - 1
    start = F.when((F.col("stage") == 0) | (at < 0), 0).otherwise(at)
    end = F.when(F.col("stage") == 0, F.length("heading")).when(at < 0, F.least(F.length(text), F.lit(len(q)))).otherwise(at + len(q))
    return rows.withColumns({"key": key, "start": start, "end": end, "text": text})


def semantic(vectors: DataFrame, query: Sequence[float], limit: int = 10) -> DataFrame:
    """The rows of ``vectors(vec_id, embedding)`` of greatest cosine with a query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("vec_id", X.cosine(F.col("embedding"), q).alias("score")).orderBy(F.desc("score"), "vec_id").limit(limit)


def semantic_records(records: DataFrame, query: str, embedder: Callable[[pd.Series], pd.Series], limit: int = 10) -> DataFrame:
    """The records of greatest cosine with a query, ``seq, id, score``, by a caller's embedder of series of texts to series of vectors.

    A record is embedded by its heading and body, in Arrow batches; the query once, on the driver.
    """
    q = [float(x) for x in embedder(pd.Series([query])).iloc[0]]
    text = F.concat_ws(" ", F.coalesce("heading", F.lit("")), F.coalesce("body", F.lit("")))
    rows = records.select("seq", "id", F.pandas_udf(embedder, "array<double>")(text).alias("v"))
    score = X.cosine(F.col("v"), F.array(*map(F.lit, q)))
    return rows.select("seq", "id", score.alias("score")).orderBy(F.desc("score"), "seq").limit(limit)


def recent_completions(entries: DataFrame, prefix: str, most: int = 10_000) -> DataFrame:
    """Values of ``entries(key, value, used)`` whose key starts with a prefix, last used first.

    Of equal keys the last stays; only the ``most`` last used keys are held.
    """
    rows = entries.groupBy("key").agg(F.max_by("value", "used").alias("value"), F.max("used").alias("used"))
    held = rows.orderBy(F.desc("used"), "key").limit(most)
    return held.where(F.col("key").startswith(prefix)).orderBy(F.desc("used"), "key").select("key", "value")


def hooked(records: DataFrame, query: str, before: Sequence[Callable[[str], str]] = (), after: Sequence[Callable[[DataFrame], DataFrame]] = (), **knobs) -> DataFrame:
    """A search with plug-ins that rewrite the query first and the result last."""
    for f in before:
        query = f(query)
    rows = search(records, query, **knobs)
    for f in after:
        rows = rows.transform(f)
    return rows
