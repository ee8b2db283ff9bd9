"""Bounds of scores by block of records, so that a search for common words reads only the blocks that may hold a best row.

A block is WIDTH consecutive sequence numbers. For terms that are dense in a segment the index keeps, by block, what holds them, the
ends of the lengths and the least ratios of size to occurrences; for the others, whose postings are few, the same is made of these. From these follows the best score that a record of a block can have, and its best place among equal ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sparkseek.functions import text as X
from sparkseek.operators import search as S
from sparkseek.operators.segments import Snapshot

#: Sequence numbers of a block, as a power of two, and the postings a block from which a term's blocks are stored.
SHIFT, DENSE = 7, 4
WIDTH = 1 << SHIFT
#: Blocks that the first step reads, how many times more each next one reads, and the most that are named one by one.
FIRST, GROWTH, NAMED = 4, 8, 256
#: Distinct terms of a query that bounds are kept for side by side; longer queries read all their postings.
TERMS = 8

#: What a block knows of a term, and of the lengths of the records that have it.
PEAKS = ("heading", "body", "words", "whole")
LENGTHS = {"hi_heading": ("max", "heading_length"), "hi_body": ("max", "body_length"), "lo_heading": ("min", "heading_length"), "lo_body": ("min", "body_length")}
#: Field-weighted scores rise as ``1 / tf + c * size / tf`` falls, for weighted occurrences and sizes. Its least value in a block is kept for
#: these ``c``; as a function of ``c`` it is concave, so between two of them it is above the line.
STEPS = (0.0, *[4.0**-i for i in range(6, -1, -1)])
LEAST = tuple(f"least{i}" for i in range(len(STEPS)))


def block_of(seq: str = "seq") -> Column:
    return F.shiftright(F.col(seq), SHIFT)


def summed(postings: DataFrame, *by: str) -> DataFrame:
    """``term, block`` with what bounds need of the postings there, and the columns ``by``."""
    n = {"heading": F.size("in_heading"), "body": F.size("in_body"), "words": F.col("words") > 0, "whole": F.col("label")}
    ends = [getattr(F, how)(c).alias(k) for k, (how, c) in LENGTHS.items()]
    w = S.WEIGHTS
    tf = F.size("in_heading") * w["heading"] + F.size("in_body") * w["body"] + F.col("in_label") * w["label"] + F.col("in_breadcrumb") * w["breadcrumb"]
    size = sum((F.coalesce(f"{c}_length", F.lit(0)) * w[c] for c in S.FIELDS), F.lit(0.0))
    least = [F.min(F.when(tf > 0, (1 + c * size) / tf)).alias(k) for k, c in zip(LEAST, STEPS, strict=True)]
    return postings.groupBy(*by, "term", block_of().alias("block")).agg(*[F.max(v).alias(k) for k, v in n.items()], *ends, *least)


def dense(postings: Column, records: int) -> Column:
    """Whether a term has so many postings in a segment that its blocks are stored: they are a fraction of these."""
    return postings * WIDTH >= DENSE * records


def blocks(at: Snapshot, terms: Sequence[str]) -> DataFrame | None:
    """``block``, the ends of lengths, and a cell for each distinct term (``t0``, ``t1``, ...), null where no record has it.

    None if no term is dense in any segment: its postings are as quick to read.
    """
    kept = {(r.segment, r.term): r.dense for r in at.pruned("terms", "term", terms).select("segment", "term", "dense").collect()}
    if not any(kept.values()):
        return None
    rows = at.pruned("blocks", "term", terms).select("term", "block", *PEAKS, *LENGTHS, *LEAST)
    for s in at.segments:
        if light := [t for t in terms if kept.get((s.id, t)) is False]:
            rows = rows.unionByName(summed(at.pruned("postings", "term", light, [s])))
    of = lambda c, t: F.when(F.col("term") == t, F.col(c))
    cells = [F.struct(*[F.max(of(c, t)).alias(c) for c in PEAKS], *[F.min(of(c, t)).alias(c) for c in LEAST]).alias(f"t{i}") for i, t in enumerate(terms)]
    return rows.groupBy("block").agg(*[getattr(F, how)(k).alias(k) for k, (how, _) in LENGTHS.items()], *cells)


def safe(opts: S.Options) -> bool:
    """Whether scores rise with occurrences and fall or rise evenly with lengths, as bounds take for granted."""
    return all(w >= 0 for w in opts.weights.values()) and opts.k1 >= 0 and 0 <= opts.b <= 1


def _raised(raw: Column, terms: Sequence[str], cells: dict[str, Column], opts: S.Options) -> Column:
    """A bound with the greatest boost that the places of the terms may give, where a block has them all."""
    if len(terms) > 1:
        gaps = [F.lit(0 if a == b else 1) for i, a in enumerate(terms) for b in terms[i + 1 :]]
        every = reduce(Column.__and__, [F.coalesce(cells[t]["heading"] + cells[t]["body"], F.lit(0)) > 0 for t in cells])
        raw = F.when(every, F.greatest(raw, raw * F.greatest(F.lit(1.5), X.closeness(gaps)))).otherwise(raw)
    # Sums of quotients may differ in the last bits from those of a record; a product of rising factors may not.
    return raw if opts.scoring == "classic" else raw + F.abs(raw) * 1e-11


def _keyed(rows: DataFrame, raw: Column, stage: Column, place: Column) -> DataFrame:
    """``block, bound, stage, place, start``: the place in the ranking that no record of a block comes before."""
    bound = F.coalesce(F.round(raw, 9), F.lit(float("-inf")))
    return rows.select("block", bound.alias("bound"), stage.alias("stage"), place.alias("place"), F.shiftleft("block", SHIFT).alias("start"))


def direct_bounds(rows: DataFrame, heads: DataFrame, terms: Sequence[str], opts: S.Options, stats: Callable[[], dict]) -> DataFrame:
    """Bounds of direct matches: words by the cells of :func:`blocks`, headings by ``heads(seq, exact, hl, bl)``."""
    cells = {t: F.col(f"t{i}") for i, t in enumerate(dict.fromkeys(terms))}
    ends = [F.max("exact").alias("exact"), F.max("hl").alias("h1"), F.max("bl").alias("b1"), F.min("hl").alias("h0"), F.min("bl").alias("b0")]
    rows = rows.join(heads.groupBy(block_of().alias("block")).agg(*ends), "block", "full")
    known: dict = {}

    def score(stage: int, i: int, ends: Sequence[tuple[str, str]]) -> Column:
        lazy = lambda: known or known.update(stats()) or known
        return F.greatest(*[S.direct_score(F.col(h), F.col(b), terms, opts, lazy, F.lit(stage), F.lit(i)) for h, b in ends])

    held = {}
    for i, t in enumerate(terms):
        word = F.coalesce(cells[t]["words"], F.lit(False)) if len(t) >= 3 else F.lit(False)
        label = F.coalesce(cells[t]["whole"], F.lit(False)) if len(t) >= 2 else F.lit(False)
        held[i] = word | label
    lengths, heading = [("hi_heading", "hi_body"), ("lo_heading", "lo_body")], [("h1", "b1"), ("h0", "b0")]
    cases = [F.when(h, score(2, i, lengths)) for i, h in held.items()]
    cases += [F.when(F.col("exact"), score(0, 0, heading)), F.when(F.col("exact").isNotNull(), score(1, 0, heading))]
    stage = F.when(F.col("exact"), 0).when(F.col("exact").isNotNull(), 1).otherwise(2)
    place = F.lit(0)
    for i in reversed(held):
        place = F.when(held[i], i).otherwise(place)
    some = reduce(Column.__or__, held.values()) | F.col("exact").isNotNull()
    return _keyed(rows.where(some), _raised(F.greatest(*cases), terms, cells, opts), stage, F.when(stage == 2, place).otherwise(0))


def weighted_bounds(rows: DataFrame, terms: Sequence[str], opts: S.Options, stats: dict) -> DataFrame | None:
    """Bounds of field-weighted scores: the best of each term in a block, and no less than nothing. None for weights of one's own."""
    if opts.b >= 1 or any(S.WEIGHTS[c] != w for c, w in opts.weights.items()):
        return None
    cells = {t: F.col(f"t{i}") for i, t in enumerate(dict.fromkeys(terms))}
    n, c = float(stats["n"]), opts.b / (1 - opts.b) / (stats["mean"] or 50.0)
    low = max(i for i, x in enumerate(STEPS) if x <= c)
    part = (c - STEPS[low]) / (STEPS[low + 1] - STEPS[low]) if low + 1 < len(STEPS) else 0.0
    raw = F.lit(0.0)
    for i, t in enumerate(terms):
        rare = max(float(stats[f"{f}{i}"] or 0) or 1.0 for f in ("heading", "body"))  # other fields only make a term commoner
        idf = max(0.0, math.log((n - rare + 0.5) / (rare + 0.5) + 1))
        least = cells[t][LEAST[low]] * (1 - part) + (cells[t][LEAST[low + 1]] * part if part else 0)
        raw = raw + F.coalesce(100 * idf * (opts.k1 + 1) / (1 + opts.k1 * (1 - opts.b) * least), F.lit(0.0))
    return _keyed(rows, _raised(raw, terms, cells, opts), F.lit(3), F.lit(0)).where("bound > 0")


def ahead(columns: Sequence[Column], key: Sequence, equal: bool = False) -> Column:
    """Whether columns come before a key in the ranking: the first falls, the others rise."""
    out = F.lit(equal)
    for i in reversed(range(len(key))):
        c, v = columns[i], F.lit(key[i])
        out = (c > v if i == 0 else c < v) | ((c == v) & out)
    return out


def score() -> Column:
    """The score as the ranking sees it: to 9 digits, unknown ones last."""
    return F.coalesce(F.round("raw", 9), F.lit(float("-inf")))


#: The place of a row in the ranking.
KEY = ("score", "stage", "word_pos", "seq")


def first(rows: DataFrame, limit: int, after: Sequence | None = None) -> list[Row]:
    """The best ``limit`` of scored rows, with ``score``, that come after a place in the ranking."""
    rows = rows.withColumn("score", score())
    if after is not None:
        rows = rows.where(~ahead([F.col(c) for c in KEY], after, True))
    return rows.orderBy(F.desc("score"), *KEY[1:]).limit(limit).collect()  # at most ``limit`` rows


@dataclass(frozen=True)
class Best:
    """The first rows of a ranking, ``seq, stage, word_pos, raw, score``; of ``blocks`` with a match, ``read`` were read."""

    rows: list[Row]
    blocks: int
    read: int


def _within(chosen: Sequence[int]) -> Column:
    """Whether a sequence number is in one of the blocks, as ranges that reach the scan."""
    runs: list[list[int]] = []
    for b in sorted(chosen):
        if runs and runs[-1][1] == b:
            runs[-1][1] = b + 1
        else:
            runs.append([b, b + 1])
    seq = F.col("seq")
    return reduce(Column.__or__, [(seq >= a << SHIFT) & (seq < z << SHIFT) for a, z in runs])


def best(bounds: DataFrame, scored: Callable[[Callable[[DataFrame], DataFrame]], DataFrame], limit: int, after: Sequence | None = None) -> Best:
    """The best ``limit`` rows: blocks are read by falling bound until no other one may hold a better row than the last of them.

    ``scored`` scores the rows that a function leaves of postings and headings. Steps grow, and what is left after them is joined, so there
    are a few of them at any size. ``after`` is the ``(score, stage, word_pos, seq)`` that rows must come after.
    """
    bounds = bounds.persist()
    try:
        total, read, size, top, last = bounds.count(), 0, FIRST, [], None
        order = [F.desc("bound"), F.asc("stage"), F.asc("place"), F.asc("start")]
        keys = [F.col(c) for c in ("bound", "stage", "place", "start")]
        while read < total:
            rest = bounds
            if last is not None:
                rest = rest.where(~ahead(keys, last, True))
            if len(top) == limit:
                rest = rest.where(ahead(keys, [top[-1][c] for c in KEY], True))
            if size <= NAMED:
                chosen = rest.orderBy(*order).limit(size).collect()  # at most NAMED rows
                if not chosen:
                    break
                part = scored(lambda rows, c=chosen: rows.where(_within([r.block for r in c])))
                read, last = read + len(chosen), [chosen[-1][c] for c in ("bound", "stage", "place", "start")]
            else:
                left = rest.select(F.col("block").alias("_block"))
                if not (n := left.count()):
                    break
                part = scored(lambda rows, d=left: rows.join(d, block_of() == F.col("_block"), "left_semi"))
                read += n
            top = sorted([*top, *first(part, limit, after)], key=lambda r: (-r.score, r.stage, r.word_pos, r.seq))[:limit]
            if size > NAMED:
                break
            size *= GROWTH
        return Best(top, total, read)
    finally:
        bounds.unpersist()
