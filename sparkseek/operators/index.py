"""Index tables, their upkeep, and counts over them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkseek.functions import text as X
from sparkseek.operators import blocks as B
from sparkseek.operators import keys as K
from sparkseek.operators import segments as S
from sparkseek.sources import scratch

FIELDS = ("heading", "body", "label", "breadcrumb")
#: What a posting knows of its record.
SIZES = ("heading_length", "body_length", "label_length", "breadcrumb_length", "heading_words")


def occurrences(records: DataFrame) -> DataFrame:
    """``field, term, n``: occurrences of white-space words of two or more characters, by field."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])
    rows = records.select(F.explode(cells).alias("c")).select("c.field", F.explode(F.split(F.lower("c.text"), X.SPACES)).alias("term"))
    return rows.where(F.length("term") >= 2).groupBy("field", "term").agg(F.count("*").alias("n"))


def frequencies(records: DataFrame, field: str = "body") -> DataFrame:
    """``term, n`` of one field."""
    rows = records.select(F.explode(F.split(F.lower(field), X.SPACES)).alias("term")).where(F.length("term") >= 2)
    return rows.groupBy("term").agg(F.count("*").alias("n"))


def postings(records: DataFrame) -> DataFrame:
    """``term, seq, tf``: body words of three or more characters and their accent-free forms, and whole labels."""
    words = F.filter(F.split(F.lower("body"), X.SPACES), lambda w: F.length(w) >= 3)
    both = F.concat(words, F.filter(F.transform(words, lambda w: F.when(X.fold(w) != w, X.fold(w))), lambda w: w.isNotNull()))
    label = F.when(F.length("label") >= 2, F.array(F.lower("label"))).otherwise(F.array().cast("array<string>"))
    rows = records.select("seq", F.explode(F.concat(both, label)).alias("term"))
    return rows.groupBy("term", "seq").agg(F.count("*").alias("tf"))


POSTING = "term string, seq long, words int, label boolean, in_heading array<int>, in_body array<int>, in_label int, in_breadcrumb int, tf long, " + ", ".join(f"{c} int" for c in SIZES)


#: Words that are taken apart at a time.
PART_WORDS = 1 << 20


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch of about PART_WORDS words, a record at least."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns[1:]:
        if pa.types.is_list(c.type):
            size += c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + PART_WORDS, "right")))
        yield batch.slice(at, to - at)
        at = to


def _postings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each record by place, in arrays: words get numbers, and one stable sort brings those of a record together."""
    for part in (p for b in batches for p in _parts(b)):
        n = part.num_rows
        values, record, place, kind = [], [], [], []
        for k, c in enumerate(part.columns[i] for i in (1, 2, 3, 5, 6)):  # heading, body, folded, label, breadcrumb
            size = c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values.append(c.flatten())
            record.append(np.repeat(np.arange(n), size))
            place.append(np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
            kind.append(np.full(size.sum(), k))
        label = np.flatnonzero(part.column(4).is_valid().to_numpy(zero_copy_only=False))
        values.append(part.column(4).drop_null())
        record, place, kind = np.concatenate([*record, label]), np.concatenate([*place, np.zeros(len(label), np.int64)]), np.concatenate([*kind, np.full(len(label), 5)])
        coded = pa.concat_arrays(values).dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        key = record * max(1, len(words)) + code
        order = np.argsort(key, kind="stable")
        key, kind, place = key[order], kind[order], place[order].astype(np.int32)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        times = np.bincount(group * 6 + kind, minlength=6 * len(first)).reshape(-1, 6).astype(np.int32)
        held, of = code[order][first], record[order][first]
        long = pc.utf8_length(words).to_numpy()[held] >= 3 if len(held) else np.zeros(0, bool)
        count, whole = np.where(long, times[:, 1] + times[:, 2], 0).astype(np.int32), times[:, 5] > 0
        places = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(times[:, k])]).astype(np.int32)), pa.array(place[kind == k])) for k in (0, 1)]
        arrays = [words.take(pa.array(held)), part.column(0).take(pa.array(of)), pa.array(count), pa.array(whole), *places, pa.array(times[:, 3]), pa.array(times[:, 4]), pa.array(count.astype(np.int64) + whole)]
        arrays += [c.take(pa.array(of)) for c in part.columns[7:]]
        yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in POSTING.split(", ")])


def positions(records: DataFrame) -> DataFrame:
    """A row for each record and word of it: all that a search needs to score the record by that word.

    ``tf`` counts as :func:`postings` does; ``words`` are its occurrences in the body, folded ones included, ``label`` says
    whether it is the label; ``in_heading`` and ``in_body`` are its places among the words of a field, of any length, and
    ``in_label`` and ``in_breadcrumb`` how often it is one of theirs. The words are split in the JVM and gathered in Arrow
    batches, record by record, so nothing is shuffled.
    """
    h, b = X.words(F.col("heading")), X.words(F.col("body"))
    strange = F.filter(b, lambda w: F.length(w) != F.octet_length(w))
    folded = F.filter(F.transform(strange, lambda w: F.when(X.fold(w) != w, X.fold(w))), lambda w: w.isNotNull() & (w != ""))
    label = F.when(F.length("label") >= 2, F.lower("label"))
    lengths = [F.length("heading"), F.length("body"), F.coalesce(F.length("label"), F.lit(0)), F.coalesce(F.length("breadcrumb"), F.lit(0)), F.size(h)]
    cells = [h.alias("h"), b.alias("b"), folded.alias("folded"), label.alias("label"), X.words(F.col("label")).alias("l"), X.words(F.col("breadcrumb")).alias("c")]
    return records.select("seq", *cells, *[n.alias(c) for n, c in zip(lengths, SIZES, strict=True)]).mapInArrow(_postings_of, POSTING)


def _written(rows: DataFrame, path: str, name: str, segment: str, by_bucket: bool = False) -> str:
    """Write a table of a segment; its name if it is dealt by bucket and has no row, so that nothing reads it."""
    at = f"{path}/{name}/segment={segment}"
    if not by_bucket:
        rows.write.parquet(at)
        return ""
    rows.write.partitionBy("bucket").parquet(at)
    return "" if any(n.startswith("bucket=") for n in scratch.names(rows.sparkSession, at)) else name


def _sizes(records: DataFrame):
    """Records, those of known length, their characters, all characters, and the first and last number."""
    both = F.length("body") + F.length("heading")
    return records.agg(F.count("*").alias("records"), F.count(both).alias("sized"), F.coalesce(F.sum(both), F.lit(0)).alias("chars"), F.max("seq").alias("last")).first()


def _heads(records: DataFrame) -> DataFrame:
    """``seq, heading, heading_length, body_length, key`` for the heading in lower case and without accents."""
    h = F.lower("heading")
    heads = records.select("seq", "heading", F.length("heading").alias("heading_length"), F.length("body").alias("body_length"), F.explode(F.array_distinct(F.array(h, X.fold(h)))).alias("key"))
    return heads.where("key <> ''")


def _segment(spark: SparkSession, path: str, postings: DataFrame, heads: DataFrame, segment: S.Segment, files: int) -> S.Segment:
    """Write all tables of a segment but its records.

    Postings are dealt by bucket and a slot of the sequence number, and sorted by term, so a common term spreads over
    all files of its bucket, and a look-up reads one folder and the row groups of its term. What completes, corrects
    and holds a word is made of the distinct terms and headings.
    """
    buckets, seg = segment.buckets, segment.id
    slots = max(1, files // buckets)
    place = F.col("bucket") * F.lit(slots) + F.pmod(F.xxhash64("seq"), F.lit(slots)).cast("int")
    dealt = postings.withColumn("bucket", S.bucket(F.col("term"), buckets)).repartitionById(buckets * slots, place)
    empty = [_written(dealt.sortWithinPartitions("bucket", "term", "seq"), path, "postings", seg, True)]
    if empty[0]:
        spark.createDataFrame([], S.SCHEMAS["postings"]).write.mode("overwrite").parquet(f"{path}/postings/segment={seg}")
    _written(heads.repartitionByRange(files, "key").sortWithinPartitions("key"), path, "headings", seg)
    n = {"heading": F.size("in_heading"), "body": F.size("in_body"), "label": F.col("in_label"), "breadcrumb": F.col("in_breadcrumb")}
    spot = F.struct(F.col("seq").alias("seq"), F.element_at("in_body", 1).alias("pos"))
    held = spark.read.parquet(f"{path}/postings/segment={seg}")
    held = held if "bucket" in held.columns else held.withColumn("bucket", F.lit(0))
    counts = held.groupBy("bucket", "term").agg(*[F.sum(v).alias(k) for k, v in n.items()], F.min(F.when(F.size("in_body") > 0, spot)).alias("first"), B.dense(F.count("*"), segment.records).alias("dense"))
    empty.append(_written(counts.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term"), path, "terms", seg, True))
    terms = counts if empty[0] else spark.read.parquet(f"{path}/terms/segment={seg}")
    # Dense terms are few: DENSE of WIDTH records have each, so they are no more than 32 times the distinct words of a record.
    common = held.join(terms.where("dense").select("bucket", "term"), ["bucket", "term"], "left_semi")
    empty.append(_written(B.summed(common, "bucket").repartition(buckets, "bucket").sortWithinPartitions("bucket", "term", "block"), path, "blocks", seg, True))
    heads = spark.read.parquet(f"{path}/headings/segment={seg}")
    cells = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("n")) for k in n])
    counts = terms.where(F.length("term") >= 2).select("bucket", "term", F.explode(F.filter(cells, lambda c: c["n"] > 0)).alias("c")).select("bucket", "term", "c.*", F.lit(seg).alias("of"))
    empty.append(_written(counts.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term"), path, "frequencies", seg, True))
    empty.append(_written(_by_bucket(K.term_grams(terms), "gram", buckets), path, "grams", seg, True))
    empty.append(_written(_by_bucket(K.neighbours(terms, heads), "variant", buckets), path, "neighbours", seg, True))
    empty.append(_written(_by_bucket(K.completions(heads), "prefix", buckets), path, "completions", seg, True))
    return replace(segment, empty=tuple(filter(None, empty)))


def _by_bucket(rows: DataFrame, column: str, buckets: int) -> DataFrame:
    rows = rows.withColumn("bucket", S.bucket(F.col(column), buckets))
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", column)


def _layout(spark: SparkSession, chars: int, buckets: int | None, per_file: int) -> tuple[int, int]:
    """Buckets, one for 2 GB, and files, one for ``per_file`` characters, and more where there are cores for them."""
    return buckets or max(4, min(4096, chars >> 31)), max(min(spark.sparkContext.defaultParallelism, 1 + (chars >> 20)), chars // per_file)


def _new(spark: SparkSession, path: str, records: DataFrame, buckets: int | None, per_file: int, on_index: Sequence[Callable[[DataFrame], object]]):
    """Write a segment of records, unseen until a manifest names it; the segment and what is known of its records."""
    known = _sizes(records)
    buckets, files = _layout(spark, known.chars, buckets, per_file)
    segment = S.Segment(S.new_id(), buckets, known.records)
    _written(records.repartitionByRange(files, "seq").sortWithinPartitions("seq"), path, "records", segment.id)
    rows = spark.read.parquet(f"{path}/records/segment={segment.id}")
    for hook in on_index:
        hook(rows)
    return _segment(spark, path, positions(rows), _heads(rows), segment, files), known


def save(records: DataFrame, path: str, buckets: int | None = None, per_file: int = 1 << 27, on_index: Sequence[Callable[[DataFrame], object]] = ()) -> S.Snapshot:
    """Write an index of the records as the next version under ``path``; what was there stays readable as the version before.

    It holds the records by sequence number, and beside them postings, terms, frequencies, headings, and tables for completion
    and correction. Buckets and files follow the characters of the corpus. Plug-ins ``on_index`` get the saved records.
    """
    spark = records.sparkSession
    segment, known = _new(spark, path, records, buckets, per_file, on_index)
    before = S.read(spark, path)
    manifest = S.Manifest(before.version if before else 0, 0, (segment,), 0 if known.last is None else known.last + 1, known.records, known.sized, known.chars)
    return S.Snapshot(spark, path, S.commit(spark, path, manifest))


def add(spark: SparkSession, path: str, more: DataFrame, buckets: int | None = None, per_file: int = 1 << 27, on_index: Sequence[Callable[[DataFrame], object]] = ()) -> S.Snapshot:
    """Append records to a saved index as a segment of their own: they get the numbers after the last, in their own order.

    Ids may repeat, as nothing enforces them. Only files of the new records are written.
    """
    return _changed(spark, path, None, more, buckets, per_file, on_index)


def remove(spark: SparkSession, path: str, ids: DataFrame) -> S.Snapshot:
    """Delete the records of ``ids(id)`` from a saved index: a bit for each, and what they take from the frequencies. Other ids do nothing."""
    return _changed(spark, path, ids, None)


def update(spark: SparkSession, path: str, changes: DataFrame, **layout) -> S.Snapshot:
    """Replace the records whose id ``changes`` have, and append those that are new, in one version."""
    return _changed(spark, path, changes.select("id"), changes, **layout)


def _changed(spark, path, ids, more, buckets=None, per_file=1 << 27, on_index=()) -> S.Snapshot:
    at = S.opened(spark, path)
    if at is None:
        raise ValueError(f"no index in {path}")
    m = at.manifest
    if ids is not None:
        delta = S.Segment(S.new_id(), max([4, *(s.buckets for s in at.segments)]), 0, True)
        old = at.live(at.table("records")).join(ids.select("id").distinct(), "id", "left_semi")
        # What is deleted is written, as three sums read it.
        held = scratch.folder(spark)
        old.select("segment", "seq", *FIELDS).write.parquet(held)
        old = spark.read.parquet(held)
        gone = _sizes(old)
        if gone.records:
            bit = F.expr("shiftleft(1L, cast(seq & 63 AS int))")
            bits = old.groupBy(F.col("segment").alias("of"), F.shiftright("seq", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
            _written(bits, path, "deletions", delta.id)
            less = old.select("segment", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])).alias("c"))
            less = less.select(F.col("segment").alias("of"), "c.field", F.explode(F.split(F.lower("c.text"), X.SPACES)).alias("term")).where(F.length("term") >= 2)
            less = less.groupBy("of", "field", "term").agg((-F.count("*")).alias("n"))
            empty = _written(_by_bucket(less.select("term", "field", "n", "of"), "term", delta.buckets), path, "frequencies", delta.id, True)
            delta = replace(delta, empty=(empty,) if empty else ())
            m = replace(m, segments=(*m.segments, delta), records=m.records - gone.records, sized=m.sized - gone.sized, chars=m.chars - gone.chars)
        scratch.delete(spark, held)
    if more is not None:
        columns = [c for c in at.table("records").columns if c != "segment"]
        new = ranked(more).withColumn("seq", F.col("rank") + F.lit(m.next_seq)).select(*columns)
        segment, known = _new(spark, path, new, buckets, per_file, on_index)
        m = replace(m, segments=(*m.segments, segment), next_seq=m.next_seq if known.last is None else known.last + 1, records=m.records + known.records, sized=m.sized + known.sized, chars=m.chars + known.chars)
    return S.Snapshot(spark, path, S.commit(spark, path, m))


def compact(spark: SparkSession, path: str, fan: int | None = 4, per_file: int = 1 << 27) -> S.Snapshot:
    """Merge segments of like size, ``fan`` or more of a tier, into one, without what is deleted; nothing if no tier has so many.

    Without ``fan`` all segments are merged. Postings and headings are carried over, not made again; records keep their numbers.
    """
    at = S.opened(spark, path)
    tiers: dict[int, list[S.Segment]] = {}
    for s in at.segments:
        tiers.setdefault(s.records.bit_length() // 2, []).append(s)
    group = next((g for _, g in sorted(tiers.items()) if len(g) >= fan), None) if fan else at.segments
    if group is None:
        return at
    rows = at.live(at.table("records", group)).drop("segment")
    known = _sizes(rows)
    buckets, files = _layout(spark, known.chars, max(s.buckets for s in group), per_file)
    merged = S.Segment(S.new_id(), buckets, known.records)
    _written(rows.repartitionByRange(files, "seq").sortWithinPartitions("seq"), path, "records", merged.id)
    merged = _segment(spark, path, at.live(at.table("postings", group)).drop("segment", "bucket"), at.live(at.table("headings", group)).drop("segment"), merged, files)
    left = tuple(s for s in at.manifest.segments if s not in group)
    if all(s.delta for s in left):
        left = ()  # what deltas take is gone from the only segment
    return S.Snapshot(spark, path, S.commit(spark, path, replace(at.manifest, segments=(*left, merged))))


def load(spark: SparkSession, path: str | S.Snapshot) -> DataFrame:
    """Live records of a saved index."""
    at = S.opened(spark, path)
    return at.live(at.table("records")).drop("segment")


def meta(spark: SparkSession, path: str | S.Snapshot) -> dict:
    """Version, segments, records and mean length of a saved index."""
    m = S.opened(spark, path).manifest
    return {"version": m.version, "built": m.built, "segments": len(m.segments), "records": m.records, "mean": m.mean}


def of_terms(spark: SparkSession, path: str | S.Snapshot, terms: Sequence[str]) -> DataFrame:
    """Postings of some terms in live records."""
    at = S.opened(spark, path)
    return at.live(at.pruned("postings", "term", terms))


def counts_of(spark: SparkSession, path: str | S.Snapshot, terms: Sequence[str]) -> DataFrame:
    """``field, term, n`` of some terms over live records: what segments hold less what deltas take from them."""
    at = S.opened(spark, path)
    rows = at.pruned("frequencies", "term", terms, at.manifest.segments)
    return rows.where(F.col("of").isin([s.id for s in at.segments])).groupBy("field", "term").agg(F.sum("n").alias("n")).where("n > 0")


def lookup(spark: SparkSession, path: str | S.Snapshot, term: str) -> DataFrame:
    """Postings of one term."""
    return of_terms(spark, path, [term]).where("tf > 0").select("term", "seq", "tf")


def cleared(spark: SparkSession, path: str) -> bool:
    """Delete a saved index; whether there was one."""
    return scratch.delete(spark, path)


def facets(records: DataFrame) -> DataFrame:
    """Count of every type, zero where there is none."""
    kinds = records.sparkSession.createDataFrame([(t,) for t in X.TYPES], "type string")
    return kinds.join(records.groupBy("type").agg(F.count("*").alias("n")), "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def badges(records: DataFrame) -> DataFrame:
    """Counts of the result categories, in one pass."""
    count = lambda *t: F.count_if(F.col("type").isin(*t))
    return records.agg(F.count("*").alias("all"), count("section", "structured").alias("pages"), count("action", "field").alias("actions"), count("file").alias("files"), count("link", "media").alias("links"))


def inspect(records: DataFrame) -> DataFrame:
    """Documents, index terms (body keys and heading prefixes), and nodes of the heading trie."""
    h = F.lower("heading")
    forms = F.array_distinct(F.array(h, X.fold(h)))
    prefixes = records.select(F.explode(forms).alias("h")).select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("h"))), lambda i: F.substring("h", F.lit(1), i))).alias("p")).where("p <> ''").distinct()
    trie = prefixes.agg(F.count("*").alias("nodes"), F.count_if(F.length("p") >= 2).alias("prefixes"))
    keys = postings(records).select("term").distinct().agg(F.count("*").alias("keys"))
    n = records.agg(F.count("*").alias("documents"))
    return n.crossJoin(trie).crossJoin(keys).select("documents", (F.col("keys") + F.col("prefixes")).alias("terms"), (F.col("nodes") + 1).alias("trie_nodes"), F.lit(1).alias("version"))


def merged(parts: Sequence[DataFrame], prefer: str = "first") -> DataFrame:
    """Union by id: the first or last of equal ids, at the place of the first. Adds ``place``."""
    every = None
    for i, p in enumerate(parts):
        rows = p.withColumn("src", F.lit(i))
        every = rows if every is None else every.unionByName(rows)
    at = F.struct("src", "seq")
    row = F.struct(*parts[0].columns)
    pick = F.min_by(row, at) if prefer == "first" else F.max_by(row, at)
    # Both ends fit in one partial aggregate, so copies of an id meet only as two rows for each task.
    return every.groupBy("id").agg(pick.alias("r"), F.min(at).alias("place")).select("r.*", "place")


def removed(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids, "id", "left_anti")


def updated(records: DataFrame, changes: DataFrame) -> DataFrame:
    """Changed rows go to the end: they get the sequence numbers after the last, in their own order."""
    last = records.agg(F.max("seq")).first()[0]
    start = 0 if last is None else last + 1
    new = ranked(changes).withColumn("seq", F.col("rank") + F.lit(start))
    return records.join(changes.select("id"), "id", "left_anti").unionByName(new.select(*records.columns))


def ranked(rows: DataFrame, width: int = 65_536) -> DataFrame:
    """Adds ``rank``, the 0-based place of each row by ``seq``: within spans of numbers, and spans by their counts, so that no task ranks all."""
    rows = rows.withColumn("_span", F.floor(F.col("seq") / width))
    counts = rows.groupBy("_span").agg(F.count("*").alias("n"))
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # a row for each span
    counts = counts.select("_span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_span").orderBy("seq")) - 1
    return rows.withColumn("_place", place).join(counts, "_span").withColumn("rank", F.col("_place") + F.col("_offset")).drop("_span", "_place", "_offset")


def added(records: DataFrame, more: DataFrame) -> DataFrame:
    """Append rows; ids may repeat, as nothing enforces them."""
    last = records.agg(F.max("seq")).first()[0]
    return records.unionByName(more.withColumn("seq", F.col("seq") + F.lit((-1 if last is None else last) + 1)).select(*records.columns))


def refreshed(old: DataFrame, new: DataFrame) -> DataFrame:
    """``url, action`` for page metadata ``(url, etag, content_hash)``: keep, fetch, add or drop."""
    o, n = old.alias("o"), new.alias("n")
    same = (F.col("o.etag") == F.col("n.etag")) | (F.col("o.content_hash") == F.col("n.content_hash"))
    action = F.when(F.col("o.url").isNull(), "add").when(F.col("n.url").isNull(), "drop").when(F.coalesce(same, F.lit(False)), "keep").otherwise("fetch")
    return o.join(n, F.col("o.url") == F.col("n.url"), "full").select(F.coalesce("o.url", "n.url").alias("url"), action.alias("action"))


def carried(old_records: DataFrame, new_records: DataFrame, plan: DataFrame) -> DataFrame:
    """Records after a refresh: old ones of kept pages, new ones of the others."""
    keep = plan.where("action = 'keep'").select(F.col("url").alias("page_url"))
    return old_records.join(keep, "page_url", "left_semi").unionByName(new_records.join(keep, "page_url", "left_anti"))


def fresh(meta: DataFrame, now_ms: Column, ttl_seconds: int) -> DataFrame:
    """Cache entries that are no older than the time to live, in seconds."""
    return meta.where(now_ms - F.col("timestamp") <= ttl_seconds * 1000)


def migrated(df: DataFrame) -> DataFrame:
    """Field frequencies for an index that only has body frequencies ``(term, n)``."""
    return df.select("term", F.col("n").alias("body"), F.floor(F.col("n") * 0.3).alias("heading"), F.floor(F.col("n") * 0.1).alias("label"), F.floor(F.col("n") * 0.1).alias("breadcrumb"))


def serialized(records: DataFrame) -> DataFrame:
    """One JSON document a row: the distributed form of a static export."""
    return records.select("seq", F.to_json(F.struct(*records.columns)).alias("json"))


def deserialized(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(F.from_json("json", schema).alias("r")).select("r.*")


def serialized_index(spark: SparkSession, path: str | S.Snapshot) -> DataFrame:
    """``part, json``: the manifest, and every live row of a saved index, as a JSON document by the table that it is of."""
    at = S.opened(spark, path)
    out = spark.createDataFrame([("manifest", json.dumps(asdict(at.manifest)))], "part string, json string")
    for part in ("records", "postings", "headings"):
        rows = at.live(at.table(part))
        out = out.unionByName(rows.select(F.lit(part).alias("part"), F.to_json(F.struct(*[c for c in rows.columns if c not in ("segment", "bucket")])).alias("json")))
    return out


def restored(rows: DataFrame, path: str, schema: str, per_file: int = 1 << 27) -> S.Snapshot:
    """A saved index again from :func:`serialized_index`, whose records have this schema: one segment, made of the stored postings."""
    spark = rows.sparkSession
    records = restored_index(rows, "records", schema)
    known = _sizes(records)
    buckets, files = _layout(spark, known.chars, None, per_file)
    segment = S.Segment(S.new_id(), buckets, known.records)
    _written(records.repartitionByRange(files, "seq").sortWithinPartitions("seq"), path, "records", segment.id)
    heads = restored_index(rows, "headings", "seq long, heading string, heading_length int, body_length int, key string")
    segment = _segment(spark, path, restored_index(rows, "postings", POSTING), heads, segment, files)
    manifest = S.Manifest(0, 0, (segment,), 0 if known.last is None else known.last + 1, known.records, known.sized, known.chars)
    return S.Snapshot(spark, path, S.commit(spark, path, manifest))


def restored_index(rows: DataFrame, part: str, schema: str) -> DataFrame:
    """One table of a serialised index."""
    return deserialized(rows.where(F.col("part") == part), schema)


def static_export(records: DataFrame, path: str, form: str = "json") -> None:
    """Write JSON lines; for site generators with a front-matter line that marks the index."""
    rows = serialized(records).select(F.col("json").alias("value"))
    if form in ("hugo", "jekyll"):
        head = records.sparkSession.createDataFrame([("---\nsearch_index: true\n---",)], "value string")
        rows = head.unionByName(rows)
    rows.write.mode("overwrite").text(path)


def shards(records: DataFrame, n: int, width: int = 65_536) -> DataFrame:
    """``seq, shard``: contiguous shards of equal, rounded-up size."""
    size = F.ceil(F.lit(records.count()) / F.lit(n))
    return ranked(records.select("seq"), width).select("seq", F.floor(F.col("rank") / size).cast("int").alias("shard"))
