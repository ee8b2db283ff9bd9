import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from sparkseek.llm import near_copies as module
from sparkseek.llm.vptree import balls

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_balls_find_every_pair_within_reach_once():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 12, 1500)).astype(np.uint32)
    home = rng.random(len(keys)) < 0.7
    found = [(a, b) for q, d in balls(keys, home, 1, 1 << 10) for a, b in zip(q.tolist(), d.tolist(), strict=True) if a != b]
    i, j = np.nonzero(np.bitwise_count(keys[:, None] ^ keys[None, :]) == 1)
    assert sorted(found) == [(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if home[b]]


def test_sets_at_the_likeness_share_a_table_and_others_do_not():
    rng = np.random.default_rng(1)
    for n in (9, 40, 300):
        for like, low, high in ((0.8, 0.99, 1), (0, 0, 0.01)):
            met = []
            for _ in range(200):
                both = 2 * n * like / (1 + like)
                h = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
                x = module._unpacked([module.sketch(h[:n]), module.sketch(h[n - int(np.ceil(both)) : 2 * n - int(np.ceil(both))])])
                met.append(module._meets(module._prints(x[:1] ^ x[1:], slice(0, module.TABLES))).any())
            assert low <= np.mean(met) <= high, (n, like)


def test_near_dedup_takes_its_links_from_the_trees(spark, monkeypatch):
    docs = spark.read.parquet(DATA)
    rows = pq.read_table(DATA, columns=["text"]).column(0).to_pylist()
    classes = len({module.shingle_set((t or "").encode()).tobytes() for t in rows})
    kept = corpus_pipeline.near_dedup(spark, docs, "").count()
    assert kept < classes
    dealt = module._shards
    monkeypatch.setattr(module, "_shards", lambda sets, tables: dealt(sets, tables).where("false"))
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == classes
