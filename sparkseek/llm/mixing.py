"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import dropped, saved, word_count

#: Cells that a stretch of the key line is cut into, and the rows of a stretch that may be sorted in one task.
BUCKETS, FEW = 4096, 50_000
SYMBOLS = "[#$%&*|!]"


def quality_weight(text: Column, size: Column) -> Column:
    """Weight from 0.1 to 1 that falls with the symbols per word of a text."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0))
    return F.lit(1.0) - F.least(F.lit(0.9), symbols / F.greatest(size, F.lit(1)))


def _keyed(docs: DataFrame, seed: str) -> dict[str, Column]:
    """Size and sampling key: an exponential variate, made from the id and the text, over the weight."""
    text, size = F.col("text").cast("string"), word_count(F.col("text").cast("string"))
    name = F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    draw = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double")
    u = (draw + F.lit(1.0)) / F.lit(float(2**52 + 1))
    return {"size": size, "e": -F.log(u) / quality_weight(text, size)}


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank``, the 0-based place of each source by code point, null last, without one task for all."""
    placed = saved(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("part", part).join(offsets, "part").withColumn("rank", rank).drop("at", "part", "offset")


def _targets(sources: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """Adds ``target``: shares of all words by weight, none above ``most`` times the source, the rest reshared."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    known = saved(_ranked(sources).withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size")))
    total = known.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # rises until no further source reaches its cap
        full = F.col("cap") <= F.lit(level) * F.col("w")
        held, free = known.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        after = (total - (held or 0.0)) / free if free else level
        if after <= level:
            break
        level = after
    return known.withColumn("target", F.least("cap", F.lit(level) * F.col("w")))


def _plan(rows: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """A row for each source: its size, target, whole epochs, and the last key that the part epoch takes."""
    sources = _targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    sources = sources.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    sources = saved(sources.select("source", "source_size", "target", "epochs", "rest"))
    return saved(sources.alias("s").join(_edges(rows, sources).alias("m"), F.expr("s.source <=> m.source"), "left").select("s.*", "below", "last", "of"))


def _edges(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Where the part epoch of each source ends: ``source, below, last, of``.

    It takes the rows with a key under ``below``, those up to ``last``, and ``of.m`` of the ``of.c`` identical
    rows at ``last``. The cell of the key line in which the budget ends is cut into cells again until few rows
    are left in it, or one key, so neither low weights nor repeated rows bring many rows to one task.
    """
    open_ = rows.alias("r").join(sources.where("rest > 0").alias("s"), F.expr("r.source <=> s.source"))
    open_ = open_.select("r.source", "e", "doc_id", "size", F.lit(0).cast("long").alias("start"), "rest")
    cell, used = F.floor((F.lit(1.0) - F.exp(-F.col("e"))) * F.lit(BUCKETS)), []
    while True:
        placed = open_.withColumn("cell", cell)
        sums = placed.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("e").alias("lo"), F.max("e").alias("hi"), F.first("start").alias("start"), F.first("rest").alias("rest"))
        upto = Window.partitionBy("source").orderBy("cell")  # at most BUCKETS + 1 rows
        sums = sums.withColumn("end", F.col("start") + F.sum("words").over(upto)).withColumn("start", F.col("end") - F.col("words"))
        cut = saved(sums.where("start <= rest AND rest < end").select("source", "cell", "n", "lo", "hi", "start", "rest"))
        near = placed.drop("start", "rest", "lo", "hi").alias("r").join(cut.alias("c"), F.expr("r.source <=> c.source AND r.cell = c.cell"))
        near = near.select("r.source", "e", "doc_id", "size", "c.start", "c.rest", "lo", "hi")
        crowded = cut.where((F.col("n") > FEW) & (F.col("lo") < F.col("hi"))).limit(1).count()
        if not crowded:
            break
        open_ = saved(near)
        used += [open_, cut]
        part = (F.col("e") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        cell = F.when(F.col("lo") < F.col("hi"), F.least(F.lit(BUCKETS - 1), F.floor(part * F.lit(BUCKETS)))).otherwise(F.lit(0)).cast("long")
    same = near.groupBy("source", "e", "doc_id", "size").agg(F.count("*").alias("c"), F.first("start").alias("start"), F.first("rest").alias("rest"), F.first("lo").alias("lo"))
    order = Window.partitionBy("source").orderBy("e", "doc_id", "size")
    upto = F.col("start") + F.sum(F.col("size") * F.col("c")).over(order) - F.col("size") * F.col("c")
    # A row at the edge is in if that brings the words taken nearer to the rest.
    fit = F.when(F.col("size") > 0, F.floor((2 * F.col("rest") - 2 * F.col("upto") + F.col("size")) / (2 * F.col("size")))).otherwise(F.when(F.col("upto") <= F.col("rest"), F.col("c")).otherwise(F.lit(0)))
    same = same.withColumn("upto", upto).withColumn("m", F.greatest(F.lit(0), F.least(F.col("c"), fit)).cast("long"))
    last = F.max(F.when(F.col("m") > 0, F.struct("e", "doc_id", "size", "m", "c")))
    found = same.groupBy("source").agg(F.min("lo").alias("below"), last.alias("last"))
    found = saved(found.select("source", "below", F.col("last").dropFields("m", "c").alias("last"), F.struct(F.col("last.m").alias("m"), F.col("last.c").alias("c")).alias("of")))
    dropped(cut, *used)
    return found


def _taken(rows: DataFrame, plan: DataFrame, *names: str) -> DataFrame:
    """``names`` of the plan's sources and rows, ``n``, how often a row is taken at least, and ``more``: null, or how many of the
    identical rows at the edge, this one among them, are taken once more."""
    joined = rows.alias("r").join(plan.alias("p"), F.expr("r.source <=> p.source"))
    key = F.struct("r.e", F.col("r.doc_id").cast("long").alias("doc_id"), "r.size")
    edge = F.coalesce(key == F.col("last"), F.lit(False))
    before = F.when(F.col("last").isNotNull(), (key < F.col("last")) | (edge & (F.col("of.m") == F.col("of.c")))).otherwise(F.col("r.e") < F.col("below"))
    n = F.col("epochs") + F.coalesce(before.cast("long"), F.lit(0))
    more = F.when(edge & (F.col("of.m") < F.col("of.c")), F.col("of.m"))
    return joined.select(*names, "r.source", n.cast("long").alias("n"), more.alias("more"))


def _first_of(rows: DataFrame) -> DataFrame:
    """Adds one to ``n`` of the first ``more`` of the identical rows of each source, counted by ``row`` without one task for all."""
    part = F.shiftright("row", 33)
    rows = rows.withColumn("part", part)
    counts = rows.groupBy("source", "part").agg(F.count("*").alias("in_part"))  # a row for each partition
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source", "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("source", "part").orderBy("row"))
    ranked = rows.withColumn("rank", rank).alias("r").join(counts.alias("c"), F.expr("r.source <=> c.source AND r.part = c.part"))
    return ranked.select("r.*", "offset").withColumn("n", F.col("n") + (F.col("rank") + F.col("offset") <= F.col("more")).cast("long"))


def _rows(docs: DataFrame, seed: str) -> DataFrame:
    keys = _keyed(docs, seed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), keys["size"].alias("size"), keys["e"].alias("e"))
    return saved(rows.withColumn("row", F.monotonically_increasing_id()))


def mixture(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: str = "mix:") -> DataFrame:
    """One row per row of ``docs(doc_id, text, source, ...)``: ``doc_id, size, source_size, target, taken``.

    Sources by code point (null last) weigh ``weights`` in turn and share all words; no target exceeds
    ``most`` times its source. A source is taken whole as often as it fits (complete epochs); the rest
    of its target goes to the rows of least exponential key over quality weight, prefix-summed to the
    budget. Keys depend on ``doc_id``, text and ``seed`` only, so reruns agree. Equal keys go by id, then size;
    of identical rows as many are taken as the budget has room for. Null or empty texts have size 0 and
    take nothing. An empty table gives an empty result. Further columns are not read.
    """
    rows = _rows(docs, seed)
    plan = _plan(rows, weights, most)
    found = _taken(rows, plan, "r.doc_id", "r.size", "source_size", "target", "row")
    if not plan.where("of.m < of.c").isEmpty():
        found = found.where("more IS NULL").select("doc_id", "size", "source_size", "target", "n").unionByName(_first_of(found.where("more IS NOT NULL")).select("doc_id", "size", "source_size", "target", "n"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("n") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: str = "mix:") -> DataFrame:
    """``docs`` with every row as often as :func:`mixture` takes it; the texts are not shuffled.

    Null texts, repeated rows and empty tables are treated as there, and all columns are kept whatever their names.
    Only where some of the identical rows at an edge are taken are these written once, to be counted.
    """
    plan = _plan(_rows(docs, seed), weights, most)
    names = [f"`{c}`" for c in docs.columns]
    marked = docs.select(F.struct(*names).alias("doc"), "doc_id", "text", F.col("source").cast("string").alias("source"))
    keys = _keyed(marked, seed)
    found = _taken(marked.select("doc", "doc_id", "source", keys["size"].alias("size"), keys["e"].alias("e")), plan, "doc")
    if not plan.where("of.m < of.c").isEmpty():
        edge = saved(found.where("more IS NOT NULL").withColumn("row", F.monotonically_increasing_id()))
        found = found.where("more IS NULL").select("doc", "n").unionByName(_first_of(edge).select("doc", "n"))
    return found.where("n > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("doc.*")


#: The same mixture in DuckDB.
MIXTURE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(len(regexp_extract_all(text, '[#$%&*|!]')), 0) AS symbols,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE AS draw
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln((draw + 1.0) / 4503599627370497.0) / (1.0 - least(0.9::DOUBLE, symbols::DOUBLE / greatest(size, 1))) AS e
  FROM d),
s AS (
  SELECT source, sum(size)::DOUBLE AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM k GROUP BY source),
w AS (SELECT source, s, CASE r % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w FROM s),
o AS (
  SELECT *, row_number() OVER (ORDER BY s / w, source NULLS LAST) AS i,
         coalesce(sum(3.0 * s) OVER (ORDER BY s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS held,
         sum(w) OVER (ORDER BY s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS free,
         sum(s) OVER ()::DOUBLE AS total
  FROM w),
l AS (SELECT min_by((total - held) / free, i) AS level FROM o WHERE (total - held) / free * w <= 3.0 * s),
t AS (SELECT source, s, least(3.0 * s, level * w)::DOUBLE AS target FROM o, l),
p AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS epochs FROM t),
f AS (
  SELECT k.doc_id, k.size, p.s, p.target, p.epochs, p.target - p.epochs * p.s AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY e, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, s::BIGINT AS source_size, target,
       ((epochs + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM f
"""
