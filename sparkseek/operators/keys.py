"""Tables over the distinct terms and headings of an index, for substrings, corrections and completions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Edits that corrections go to, at most: a key has one part more.
EDITS = 2
#: Longest prefix with stored completions, and how many it stores.
PREFIX, STORED = 8, 40


def grams_of(word: str, n: int = 3) -> list[str]:
    return sorted({word[i : i + n] for i in range(len(word) - n + 1)})


def term_grams(terms: DataFrame) -> DataFrame:
    """``gram, term``: each term under its trigrams."""
    at = F.transform(F.sequence(F.lit(1), F.length("term") - 2), lambda i: F.substring("term", i, F.lit(3)))
    return terms.where(F.length("term") >= 3).select("term", F.explode(F.array_distinct(at)).alias("gram"))


def variants(word: str, distance: int = EDITS) -> list[str]:
    """Parts that a key within some edits of a word may share with it: for each length that it may have, each of its parts where the word may hold it."""
    out = set()
    for n in range(max(0, len(word) - distance), len(word) + distance + 1):
        for i in range(EDITS + 1):
            start, stop = n * i // (EDITS + 1), n * (i + 1) // (EDITS + 1)
            for at in range(max(0, start - distance), start + distance + 1):
                if at + stop - start <= len(word):
                    out.add(f"{n}:{i}:{word[at : at + stop - start]}")
    return sorted(out)


def neighbours(terms: DataFrame, heads: DataFrame) -> DataFrame:
    """``variant, key, tier, seq, pos``: headings (tier 0) and body words (tier 1) under each of their parts, with their first place.

    A key is cut into one part more than edits count, so of two words that are so close one part of the one is in the other,
    moved by no more places than there are edits. A part is named with the length of its key and its number.
    """
    h = heads.where((F.col("key") == F.lower("heading")) & (F.length("key") >= 1)).groupBy("key").agg(F.min("seq").alias("seq"))
    words = terms.where(F.col("first").isNotNull() & (F.length("term") >= 3)).select(F.col("term").alias("key"), F.lit(1).alias("tier"), "first.seq", "first.pos")
    keys = h.select("key", F.lit(0).alias("tier"), "seq", F.lit(0).alias("pos")).unionByName(words)
    n = F.length("key")
    bound = lambda i: F.floor(n * i / (EDITS + 1)).cast("int")
    parts = [F.concat(n.cast("string"), F.lit(f":{i}:"), F.substring("key", bound(i) + 1, bound(i + 1) - bound(i))) for i in range(EDITS + 1)]
    return keys.select(F.explode(F.array(*parts)).alias("variant"), "key", "tier", "seq", "pos")


def completions(heads: DataFrame) -> DataFrame:
    """``prefix, rank, heading, seq``: the first STORED distinct headings of each prefix of 2 to PREFIX characters."""
    first = heads.groupBy("key", "heading").agg(F.min("seq").alias("seq"))
    sizes = F.sequence(F.lit(2), F.least(F.length("key"), F.lit(PREFIX)))
    rows = first.where(F.length("key") >= 2).select("heading", "seq", F.explode(F.transform(sizes, lambda n: F.substring("key", F.lit(1), n))).alias("prefix")).distinct()
    # The limit on ranks is applied in each task before rows are dealt out, so a common prefix brings few rows to its task.
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy("seq", "heading"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= STORED).select("prefix", "rank", "heading", "seq")
