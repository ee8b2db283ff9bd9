import collections
import itertools
import random

from pyspark.sql import functions as F

from sparkseek.llm.packing import optimal_bounds, packed

DATA = "/root/testdata/sf0.01/documents.parquet"


def plain_padding(rows, bounds):
    return sum(next(b for b in bounds if b >= n) - n for n in rows)


def test_bounds_are_optimal():
    rng = random.Random(3)
    for _ in range(200):
        rows = [rng.randrange(0, 14) for _ in range(rng.randrange(1, 25))]
        hist = collections.Counter(rows)
        lengths = sorted(hist)
        k = rng.randrange(1, 6)
        got = optimal_bounds(lengths, [hist[x] for x in lengths], [x * hist[x] for x in lengths], k)
        assert got == sorted(set(got)) and len(got) <= k and got[-1] == lengths[-1]
        best = min(plain_padding(rows, [*c, lengths[-1]]) for r in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], r))
        assert plain_padding(rows, got) == best
    assert optimal_bounds([], [], [], 4) == []


def check_batches(rows, budget):
    batches = collections.defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.bucket_len
        batches[r.bucket, r.bucket_len, r.batch].append(r.slot)
    last = {b: max(k[2] for k in batches if k[0] == b) for b in {k[0] for k in batches}}
    for (bucket, length, batch), slots in batches.items():
        fit = max(1, budget // max(1, length))
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= fit
        assert batch == last[bucket] or len(slots) == fit


def test_batches_over_the_whole_table(spark, monkeypatch):
    monkeypatch.setattr("sparkseek.llm.packing.SLICE_ROWS", 100)
    docs = spark.read.parquet(DATA)
    rows = packed(docs, buckets=8, budget=8192).collect()
    want = {r.doc_id: len(r.text.split(" ")) for r in docs.select("doc_id", F.translate("text", "\t\n\x0b\x0c\r", "     ").alias("text")).collect()}
    assert len(rows) == 1000 and all(r.n_tokens <= want[r.doc_id] for r in rows)
    check_batches(rows, 8192)


def test_nulls_repeats_long_and_empty(spark):
    long = "w " * 300_000
    rows = [(1, "a b"), (1, "a b"), (2, None), (None, "c"), (3, ""), (4, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("x")).withColumn("row", F.lit(1))
    got = packed(docs, 3, 100).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 1), (1, 2), (1, 2), (2, 0), (3, 0), (4, 300_000)]
    check_batches(got, 100)
    assert packed(spark.createDataFrame([], docs.schema)).collect() == []


def plain_least_padding(rows, buckets):
    """Least padding by the plain recurrence over every pair of lengths."""
    hist = collections.Counter(rows)
    lengths = sorted(hist)
    best = [0] + [float("inf")] * len(lengths)
    for _ in range(buckets):
        best = [0] + [min(best[j], *(best[i] + sum((lengths[j - 1] - x) * hist[x] for x in lengths[i:j]) for i in range(j))) for j in range(1, len(lengths) + 1)]
    return best[-1]


def test_long_lengths_are_not_binned():
    rng = random.Random(6)
    for buckets in (1, 2, 5, 9):
        rows = [rng.choice([rng.randrange(10), rng.randrange(4000, 60_000), 10**6 + rng.randrange(40)]) for _ in range(60)]
        hist = collections.Counter(rows)
        lengths = sorted(hist)
        got = optimal_bounds(lengths, [hist[x] for x in lengths], [x * hist[x] for x in lengths], buckets)
        assert len(got) <= buckets and plain_padding(rows, got) == plain_least_padding(rows, buckets)


def test_padding_over_a_table_is_the_least(spark):
    docs = spark.read.parquet(DATA).where("doc_id < 250").unionByName(spark.read.parquet(DATA).where("doc_id < 8").withColumn("text", F.repeat(F.lit("w "), (F.col("doc_id") * 1000 + 4500).cast("int"))))
    rows = packed(docs, buckets=4).collect()
    lengths = [r.n_tokens for r in rows]
    assert max(lengths) == 11_500 and len({r.bucket_len for r in rows}) == 4
    assert sum(r.bucket_len - r.n_tokens for r in rows) == plain_least_padding(lengths, 4)


def test_bounds_of_counts_beyond_64_bits():
    assert optimal_bounds([1, 10**8], [5 * 10**10, 1], [5 * 10**10, 10**8], 2) == [1, 10**8]
    # Every count a great many times over has the same bounds.
    lengths, counts = [1, 2, 3, 7, 8, 9, 30, 31, 100], [5, 1, 4, 2, 2, 9, 1, 1, 1]
    for k in (1, 2, 3, 4):
        want = optimal_bounds(lengths, counts, [a * b for a, b in zip(lengths, counts, strict=True)], k)
        many = [c * 10**16 for c in counts]
        assert optimal_bounds(lengths, many, [a * b for a, b in zip(lengths, many, strict=True)], k) == want
