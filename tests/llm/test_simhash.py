import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sparkseek.llm._common import components, swept
from sparkseek.llm.simhash import deduplicated, link_shard, near_duplicates, plan_tree, route, simhash64

DATA = "/root/testdata/sf0.01/documents.parquet"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, reach=3):
    label = list(range(len(fps)))
    a = np.array(fps, np.uint64)

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= reach).tolist():
            x, y = top(i), top(j)
            label[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            groups[top(i)] = min(groups.get(top(i), ids[i]), ids[i])
    return [groups.get(top(i)) for i in range(len(fps))]


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet(DATA)
    rows = docs.orderBy("doc_id").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = dict(zip([r.doc_id for r in rows], zip([f"{x:016x}" for x in fps], plain_components([r.doc_id for r in rows], fps)), strict=True))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_fingerprint_cases():
    long = " ".join(f"w{i}" for i in range(400_000))  # several chunks
    for text in ["", "  \n\t", "One", "one TWO", "a b c", "Ä B c d e f g", "x " * 1000, "a b c\x1cd e", long]:
        assert simhash64(text.encode()) == (plain_fingerprint(text) if text is not long else simhash64(text.upper().encode()))


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (5, None), (3, ""), (None, "x y z"), (None, None), (9, "A B C D")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(7))
    got = near_duplicates(docs).collect()
    assert len(got) == 7
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(1, 1), (1, 1), (3, 3), (5, 3), (9, 1)]
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["3", "None"]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tree_loses_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(0)] + [base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(30)]))
    tree = plan_tree(fps[:200], 8, 3)
    found, homes = set(), np.zeros(len(fps), int)
    for _, at, home in route(tree, fps, 3):
        homes[at[home]] += 1
        q, d = np.nonzero(np.bitwise_count(fps[at][:, None] ^ fps[at[home]][None, :]) <= 3)
        found |= {(min(x, y), max(x, y)) for x, y in zip(at[q].tolist(), at[home][d].tolist(), strict=True) if x != y}
    assert (homes == 1).all()
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    assert found == set(zip(i.tolist(), j.tolist(), strict=True))
    label = link_shard(fps, np.ones(len(fps), bool), 3)
    assert all(label[a] == label[b] for a, b in found)


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[1000 + i] for i in range(50)}) == 1
    assert len(set(got.values())) == 3 and len(got) == 61 + 50 + 3


def test_one_row_stays_of_each_group(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (5, None, "y"), (3, "", "z"), (None, "only here", "n"), (None, "only here", "n"), (None, "A b c d", "m"), (9, "A B C D", "w"), (7, "other words entirely", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n", F.lit(1)).withColumn("fp", F.lit("f"))
    out = deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), r.source) for r in out.collect()) == [("1", "x"), ("3", "z"), ("7", "v"), ("None", "n")]
    assert deduplicated(docs.limit(0)).collect() == []


def test_sweeping_deletes_what_results_no_longer_need(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    out = near_duplicates(docs)
    assert out.count() == 2 and swept(spark) > 0 and swept(spark) == 0
