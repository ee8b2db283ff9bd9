"""Near copies by the Jaccard likeness of five-word shingles, found by SimHash fingerprints in vantage-point trees and checked exactly."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import components, dropped, saved, word_chunks
from .vptree import Node, balls, plan_tree, route

SHINGLE = 5
#: Two sets are linked from 4/5 on; kept as whole numbers so that the test is exact.
LIKE, OF = 4, 5
#: Bits of a set's SimHash. At 0.8 two sets differ in 15 % of them, and sets of any size but 5 against 4 in at most 16.2 %.
BITS = 1024
#: Each table has a fingerprint of 64 of these bits. Its tree is over the first TREE of them and searched to REACH; the others
#: may differ in REST. A pair at 0.8 is found by none of the tables with a chance of 3e-6, one of other texts by one with 4e-9.
TREE, REACH, REST, TABLES = 20, 1, 10, 104
#: Sets of 4 and 5 shingles with 4 in common differ in 18.8 %: up to this size a set is in more tables (chance of a miss 6e-5).
SMALL, SMALL_TABLES = 5, 208
#: Tables of the first round, which links each set to one of its fingerprint.
STARS = 8
#: Most of the BITS that may differ for an exact check; a pair at 0.8 has more with a chance under 1e-6.
APART, SMALL_APART = 224, 256
#: Tables that are asked first for sets that meet others; the rest is asked for further sets only.
EARLY = 16
#: Sets a shard of a table should be home to, fewer where whole sketches travel, the least number of shards, and the sets that a tree is planned from.
SHARD_ROWS, WHOLE_ROWS, MIN_SHARDS, SAMPLE = 1 << 20, 1 << 17, 2, 16_384
#: Shingles that one side of a comparison within a bucket should hold; larger buckets are cut into parts.
PART = 1 << 17
_RNG = np.random.default_rng(42)
_MUL = _RNG.integers(0, 1 << 63, (1, BITS // 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, (1, BITS // 64), dtype=np.uint64) * np.uint64(2)
_PLACES = np.array([_RNG.permutation(BITS)[:64] for _ in range(SMALL_TABLES)])
_KEY = np.uint64((1 << TREE) - 1)
_BLOCK = 1 << 20
_P, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    h = np.full(parts[0].shape, len(parts), np.uint64)
    for p in parts:
        h = _mix(h * _P + p)
    return h


def shingle_set(data: bytes) -> np.ndarray:
    """Hashes of the distinct word shingles of a UTF-8 text, sorted; a shorter text is one shingle, an empty one none."""
    digest, found, tail = xxhash.xxh64_intdigest, [], np.zeros(0, np.uint64)
    for words in word_chunks(data.lower()):  # bytes.lower() only touches A-Z
        w = np.concatenate([tail, np.fromiter(map(digest, words), np.uint64, len(words))])
        n = len(w) - SHINGLE + 1
        if n > 0:
            found.append(_joined([w[i : i + n] for i in range(SHINGLE)]))
        tail = w[max(0, n) :]
    if not found and len(tail):
        found.append(_joined([tail[i : i + 1] for i in range(len(tail))]))
    return np.unique(np.concatenate(found).view(np.int64)).view(np.uint64) if found else tail


def sketch(h: np.ndarray) -> bytes:
    """SimHash of a set: the bits that over half of its members' hashes have."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 255):
        x = _mix((h[i : i + 255, None] ^ _XOR) * _MUL)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes()


def _unpacked(bits: Iterable[bytes]) -> np.ndarray:
    """The bits of sketches, a row each."""
    return np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")


def _prints(x: np.ndarray, tables: slice) -> np.ndarray:
    """Fingerprints of unpacked sketches, a column a table."""
    return np.packbits(np.take(x, _PLACES[tables], axis=1), axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def _meets(x: np.ndarray) -> np.ndarray:
    """Whether fingerprints that differ by ``x`` find each other."""
    return (np.bitwise_count(x & _KEY) <= REACH) & (np.bitwise_count(x >> np.uint64(TREE)) <= REST)


def _class(h: np.ndarray) -> int:
    """Name of a set: equal sets share it."""
    return xxhash.xxh64_intdigest(h.tobytes(), 42) if len(h) else 0


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(np.array([_class(h) for h in sets], np.uint64).view(np.int64)),
                pa.array([len(h) for h in sets], pa.int32()),
                pa.array([sketch(h) for h in sets], pa.binary()),
                batch.column(2),
            ],
            ["doc_id", "cls", "size", "bits", "text_hash"],
        )


def _shards(classes: DataFrame, tables: range, whole: bool = False) -> DataFrame:
    """``t, leaf, home, fresh, prints, names, roots, more``: the fingerprints of ``classes(cls, size, bits, root, fresh)`` in the
    tables, dealt by the tree of each to the shards that their balls meet. A row holds those of one batch, as arrays in binary; no
    roots: their own. ``more`` has sketch, size and ``classes.shared`` of each, if ``whole``."""
    spark = classes.sparkSession
    picked = _unpacked(bytes(r.bits) for r in classes.select("bits", "cls").orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).collect())
    leaves = max(MIN_SHARDS, -(-classes.count() // (WHOLE_ROWS if whole else SHARD_ROWS)))
    trees = [plan_tree((_prints(picked, slice(t, t + 1))[:, 0] & _KEY).astype(np.uint32), leaves, REACH) for t in tables]
    sent = spark.sparkContext.broadcast(trees)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Node] = sent.value
        for batch in batches:
            cls, size, root, fresh, shared = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4, 5))
            x = _unpacked(b.as_py() for b in batch.column(2))
            more = np.zeros(len(cls), _MORE)
            more["words"], more["size"], more["shared"] = np.packbits(x, axis=1, bitorder="little").view(np.uint64), size, shared
            for t, tree in zip(tables, held, strict=True):
                own = np.arange(len(cls)) if t < TABLES else np.flatnonzero(size <= SMALL)
                fps, rows = _prints(x[own], slice(t, t + 1))[:, 0], []
                for leaf, at, home in route(tree, (fps & _KEY).astype(np.uint32), REACH):
                    kind = home * 4 + (root == cls)[own[at]] * 2 + fresh[own[at]]
                    for k in np.unique(kind).tolist():
                        i = at[kind == k]
                        rows.append((t, leaf, k >= 4, k % 2 == 1, fps[i].tobytes(), cls[own[i]].tobytes(), b"" if k & 2 else root[own[i]].tobytes(), more[own[i]].tobytes() if whole else b""))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _SHARD.types, strict=True)], schema=_SHARD)

    columns = [F.lit(0).alias("shared") if c == "shared" and not whole else F.col(c) for c in ("cls", "size", "bits", "root", "fresh", "shared")]
    return classes.select(*columns).mapInArrow(dealt, "t int, leaf int, home boolean, fresh boolean, prints binary, names binary, roots binary, more binary")


_SHARD = pa.schema([("t", pa.int32()), ("leaf", pa.int32()), ("home", pa.bool_()), ("fresh", pa.bool_()), *[(c, pa.binary()) for c in ("prints", "names", "roots", "more")]])
_MORE = np.dtype([("words", np.uint64, BITS // 64), ("size", np.int32), ("shared", np.int32)])


def _opened(frame: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Fingerprints, names, roots, home and fresh marks of a shard."""
    fps, cls = (np.frombuffer(b"".join(frame[c]), k) for c, k in (("prints", np.uint64), ("names", np.int64)))
    root = np.frombuffer(b"".join(r or n for r, n in zip(frame["roots"], frame["names"], strict=True)), np.int64)
    return fps, cls, root, *(np.repeat(frame[c].to_numpy(bool), [len(n) // 8 for n in frame["names"]]) for c in ("home", "fresh"))


def _near_keys(keys: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of distinct sorted keys, the larger at home, within reach of each other: each pair in one shard only."""
    found = [(q[q < d], d[q < d]) for q, d in balls(keys, home, REACH, 1 << 16)]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in (zip(*found, strict=True) if found else ((), ())))


def _stars(frame: pd.DataFrame) -> pd.DataFrame:
    """Links to be checked: each set at home to the first of its key, and the first ones of near keys to each other."""
    fps, cls, _, home, _ = _opened(frame)
    keys = (fps & _KEY).astype(np.uint32)
    order = np.lexsort((_mix(cls.view(np.uint64)), keys))
    fps, cls, keys, home = fps[order], cls[order], keys[order], home[order]
    uniq, start, which = np.unique(keys, return_index=True, return_inverse=True)
    q, d = _near_keys(uniq, home[start])
    i, j = np.concatenate([np.flatnonzero(home), start[q]]), np.concatenate([start[which[home]], start[d]])
    hit = (cls[i] != cls[j]) & _meets(fps[i] ^ fps[j])
    a, b = cls[i[hit]], cls[j[hit]]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _products(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places ``x, i, j`` of all pairs of ranges: those of range x are ``a[x] + r, b[x] + s`` for r < na[x], s < nb[x]. In blocks."""
    n = na * nb
    for x in np.flatnonzero(n > _BLOCK).tolist():
        step = max(1, _BLOCK // int(nb[x]))
        for r in range(0, int(na[x]), step):
            i = np.arange(r, min(r + step, int(na[x]))) + a[x]
            yield np.full(len(i) * nb[x], x), np.repeat(i, nb[x]), np.tile(b[x] + np.arange(nb[x]), len(i))
    small = np.flatnonzero((n > 0) & (n <= _BLOCK))
    part = np.cumsum(n[small]) // _BLOCK
    for at in np.split(small, np.flatnonzero(np.diff(part)) + 1) if len(small) else []:
        x = np.repeat(at, n[at])
        off = np.arange(len(x)) - np.repeat(np.cumsum(n[at]) - n[at], n[at])
        yield x, a[x] + off // nb[x], b[x] + off % nb[x]


def _meetings(fps: np.ndarray, root: np.ndarray, home: np.ndarray, fresh: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Key and places of the pairs of a shard whose fingerprints meet and which no other way joins, at least one of them fresh: those
    of a key at home, and those with a key below within reach of it. The largest component of a key is not compared within itself."""
    keys = (fps & _KEY).astype(np.uint32)
    order = np.lexsort((root, keys))
    change = (np.diff(keys[order].astype(np.int64)) != 0) | (np.diff(root[order]) != 0)
    run = np.concatenate([[0], np.cumsum(change)])
    length = np.bincount(run)[run]
    largest_last = np.lexsort((run, length, keys[order]))
    order, length = order[largest_last], length[largest_last]
    fps, root, keys, home, fresh = fps[order], root[order], keys[order], home[order], fresh[order]
    uniq, start, count = np.unique(keys, return_index=True, return_counts=True)
    last = start + count - 1
    top, others = root[last], count - length[last]
    q, d = _near_keys(uniq, home[start])
    own = np.flatnonzero(home[start])
    same = top[q] == top[d]
    rest = count - others
    ranges = [
        (own, start[own], others[own], start[own], count[own]),
        (d, start[q], np.where(same, others[q], count[q]), start[d], count[d]),
        (d[same], (start + others)[q[same]], rest[q[same]], start[d[same]], others[d[same]]),
    ]
    center, a, na, b, nb = (np.concatenate(c) for c in zip(*ranges, strict=True))
    for x, i, j in _products(a, na, b, nb):
        hit = (root[i] != root[j]) & (fresh[i] | fresh[j]) & ((i < j) | (keys[i] != keys[j]))
        x, i, j = x[hit], i[hit], j[hit]
        hit = _meets(fps[i] ^ fps[j])
        yield uniq[center[x[hit]]].astype(np.int64), order[i[hit]], order[j[hit]]


def _met(frame: pd.DataFrame) -> pd.DataFrame:
    """The fresh sets of a shard that meet one of another component."""
    fps, cls, root, home, fresh = _opened(frame)
    seen = np.zeros(len(fps), bool)
    for _, i, j in _meetings(fps, root, home, fresh):
        seen[i] = seen[j] = True
    return pd.DataFrame({"cls": np.unique(cls[seen & fresh])})


def _may_reach(a_shared: np.ndarray, a_size: np.ndarray, b_shared: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether sets can have as many common shingles as the likeness takes, of those that are in other sets at all."""
    return np.minimum(a_shared, b_shared) * (LIKE + OF) >= (a_size + b_size) * LIKE


def _apart(words: np.ndarray, others: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether few enough bits of sketches differ; ``size`` is that of the larger set."""
    return np.bitwise_count(words ^ others).sum(axis=1, dtype=np.int64) <= np.where(size <= SMALL, SMALL_APART, APART)


def _first_in(x: np.ndarray, t: int) -> np.ndarray:
    """Places of the pairs that no table before ``t`` finds, by the bits in which they differ."""
    left = np.arange(len(x))
    for before in range(0, t, 8):
        left = left[~_meets(_prints(x[left], slice(before, min(before + 8, t)))).any(axis=1)]
    return left


def _members(frame: pd.DataFrame) -> pd.DataFrame:
    """The buckets of a shard, one for each key at home: the sets there, and within reach of it below, that are in pairs which
    may reach the likeness, that no other way joins, and that no table finds before."""
    fps, cls, root, home, fresh = _opened(frame)
    more, t = np.frombuffer(b"".join(frame["more"]), _MORE), int(frame["t"].iloc[0])
    words, size, shared = more["words"], more["size"].astype(np.int64), more["shared"].astype(np.int64)
    held = [np.zeros(0, np.int64)]
    for center, i, j in _meetings(fps, root, home, fresh):
        hit = _may_reach(shared[i], size[i], shared[j], size[j])
        center, i, j = center[hit], i[hit], j[hit]
        for at in range(0, len(i), 4096):
            c, a, b = (y[at : at + 4096] for y in (center, i, j))
            hit = np.flatnonzero(_apart(words[a], words[b], np.maximum(size[a], size[b])))
            hit = hit[_first_in(_unpacked([(words[a[hit]] ^ words[b[hit]]).tobytes()]), t)]
            held.append(np.unique(np.concatenate([c[hit] * len(fps) + y[hit] for y in (a, b)])))
    at = np.unique(np.concatenate(held))
    c, i = at // len(fps), at % len(fps)
    return pd.DataFrame({"band": (t << TREE) + c, "cls": cls[i], "size": size[i], "shared": shared[i], "root": root[i]})


#: Bits of the filter of texts whose sets are wanted, 8 MB whatever the corpus; a fuller filter lets more texts through.
FILTER = 1 << 26


def _slots(h: Column) -> list[Column]:
    """Three places of a hash in the filter, which are slices of it."""
    return [F.shiftrightunsigned(h, by).bitwiseAND(F.lit(FILTER - 1)) for by in (0, 19, 38)]


def _filter(hashes: DataFrame) -> np.ndarray:
    """The bits of ``hashes(text_hash)``: at most 2,048 rows of 4 KB to the driver."""
    places = hashes.select(F.explode(F.array(*_slots(F.col("text_hash")))).alias("p"))
    parts = places.groupBy(F.shiftright("p", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    out = np.zeros(FILTER // 8, np.uint8)
    for r in parts.collect():
        out[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``cls, set`` of the classes of ``wanted(cls, text_hash)``; ``docs`` has a text of each with this hash.

    Most texts are near no other. A filter of bounded size keeps these from being taken apart and dealt out, and an exact
    join drops what it let through. Each set comes once a task, so that a large group of copies leaves few rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_filter(wanted))

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = sent.value, set()
        for batch in batches:
            h = batch.column(1).to_numpy().view(np.uint64)
            hit = np.ones(len(h), bool)
            for by in (0, 19, 38):
                at = (h >> np.uint64(by)) & np.uint64(FILTER - 1)
                hit &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
            hit[hit] = [x not in seen and not seen.add(x) for x in h[hit].tolist()]
            found = {_class(s): s for s in (shingle_set(t.as_py() or b"") for t in batch.column(0).filter(pa.array(hit)).cast(pa.binary()))}
            names = np.fromiter(found, np.uint64, len(found)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([s.view(np.int64) for s in found.values()], pa.list_(pa.int64()))], ["cls", "set"])

    text = F.col("text").cast("string")
    sets = docs.select(text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(taken, "cls long, set array<long>")
    return saved(sets.join(wanted.select("cls").hint("merge"), "cls", "left_semi").groupBy("cls").agg(F.first("set").alias("set")))


def _shared(sets: DataFrame) -> DataFrame:
    """``cls, shared``: how many shingles of each set at least one other of ``sets(cls, set)`` has."""
    once = sets.select("cls", F.explode("set").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.first("cls").alias("cls")).where("n = 1")
    lone = once.groupBy("cls").agg(F.count("*").alias("lone"))
    return sets.select("cls", F.size("set").alias("size")).join(lone.hint("merge"), "cls", "left").select("cls", (F.col("size") - F.coalesce("lone", F.lit(0))).cast("int").alias("shared"))


def _pairs(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of parts of buckets, of those asked and the others, that may reach the likeness, that no other way
    joins, and that no table finds before; the bucket is the one of the larger key."""
    size, shared, root, cls, top, band = (frame[c].to_numpy(np.int64) for c in ("size", "shared", "root", "cls", "top", "band"))
    part, ask, asked, data, x = frame["part"].to_numpy(), frame["ask"].to_numpy(), frame["asked"].to_numpy(bool), frame["data"].to_numpy(bool), _unpacked(frame["bits"])
    words, found = np.packbits(x, axis=1, bitorder="little").view(np.uint64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    order = np.lexsort((ask, part, band))
    change = (np.diff(band[order]) != 0) | (np.diff(part[order]) != 0) | (np.diff(ask[order]) != 0)
    for rows in np.split(order, np.flatnonzero(change) + 1) if len(order) else []:
        t, center = int(band[rows[0]]) >> TREE, np.uint64(band[rows[0]]) & _KEY
        key = _prints(x[rows], slice(t, t + 1))[:, 0] & _KEY
        others, other_key = rows[data[rows]], key[data[rows]]
        for at in np.flatnonzero(asked[rows]).tolist():
            i = int(rows[at])
            near = others[(root[others] != root[i]) & ((root[others] == top[i]) | (cls[i] < cls[others])) & (np.maximum(other_key, key[at]) == center)]
            near = near[_may_reach(shared[near], size[near], shared[i], size[i])]
            near = near[_apart(words[near], words[i], np.maximum(size[near], size[i]))]
            for k in range(0, len(near), 1024):
                some = near[k : k + 1024]
                some = some[_meets(_prints(x[some] ^ x[i], slice(t, t + 1)))[:, 0]]
                some = some[_first_in(x[some] ^ x[i], t)]
                found.append((np.full(len(some), i), some))
    i, j = (np.concatenate(y) for y in zip(*found, strict=True))
    return i, j


def _bundled(parts: DataFrame) -> DataFrame:
    """With a column ``bundle``, so that small parts of buckets share a call: about 4,096 rows each, whole parts."""
    n = 1 + parts.count() // 4096
    return parts.withColumn("bundle", F.pmod(F.xxhash64("band", "part", "ask"), F.lit(n)))


def _rivals(frame: pd.DataFrame) -> pd.DataFrame:
    """Spanning links of parts of buckets, by exact checks of their pairs. Pairs never leave the part."""
    size, root, cls = frame["size"].to_numpy(np.int64), frame["root"].to_numpy(np.int64, copy=True), frame["cls"].to_numpy(np.int64)
    sets, links = frame["set"].to_numpy(), []
    first, second = _pairs(frame)
    for near in np.split(np.arange(len(first)), np.flatnonzero(np.diff(first)) + 1) if len(first) else []:
        i = int(first[near[0]])
        near = second[near]
        near = near[root[near] != root[i]]
        for at in range(0, len(near), 4096):
            some = near[at : at + 4096]
            ends = np.cumsum(size[some])
            held = np.searchsorted(sets[i], flat := np.concatenate(sets[some]))
            hit = sets[i][np.minimum(held, size[i] - 1)] == flat
            n = np.diff(np.concatenate([[0], np.cumsum(hit)[ends - 1]]))
            for j in some[n * (LIKE + OF) >= (size[some] + size[i]) * LIKE].tolist():
                if root[i] != root[j]:
                    links.append((cls[i], cls[j]))
                    root[root == root[j]] = root[i]
    return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)


def _dealt(members: DataFrame) -> DataFrame:
    """The members of buckets, in parts of about PART shingles a side.

    The largest component of a bucket is not compared within itself: members outside it are asked against all. Each
    member is in one part, copied for each part of those asked, and those asked go to each part of the members; where
    a member is both, one row says so.
    """
    held = members.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    held = held.groupBy("band").agg(F.max(F.struct("n", "root", "words")).alias("top"), F.sum("words").alias("words"))
    parts = lambda c: F.greatest(F.lit(1), F.ceil(c / F.lit(PART))).cast("int")
    held = held.select("band", F.col("top.root").alias("top"), parts(F.col("words")).alias("parts"), parts(F.col("words") - F.col("top.words")).alias("asks"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    own = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    rows = members.join(held.hint("merge"), "band").withColumn("mine", own(F.col("parts"))).withColumn("my_ask", own(F.col("asks")))
    outside = F.col("root") != F.col("top")
    cells = F.transform(every(F.col("asks")), lambda k: F.struct(F.col("mine").alias("part"), k.alias("ask"), F.lit(True).alias("data"), (outside & (k == F.col("my_ask"))).alias("asked")))
    more = F.transform(F.filter(every(F.col("parts")), lambda k: outside & (k != F.col("mine"))), lambda k: F.struct(k.alias("part"), F.col("my_ask").alias("ask"), F.lit(False).alias("data"), F.lit(True).alias("asked")))
    return saved(rows.select("band", "cls", "size", "shared", "root", "top", F.inline(F.concat(cells, more))))


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets reach the likeness: 9 n >= 4 (|a| + |b|) for n common shingles."""
    half = pairs.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("x")).hint("merge"), "a")
    both = half.join(sets.select(F.col("cls").alias("b"), F.col("set").alias("y")).hint("merge"), "b")
    n = F.size(F.array_intersect("x", "y"))
    return saved(both.where(n * (LIKE + OF) >= (F.size("x") + F.size("y")) * LIKE).select("a", "b"))


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, fingerprint, component_id, root, text_hash``.

    Rows whose sets of five-word shingles have a Jaccard likeness of 0.8 or more are linked; ``component_id``
    is the least ``doc_id`` reachable, null if all are null. Rows with the same set are one class from the start,
    ``fingerprint`` names it; null and word-less texts share the empty set. ``root`` names the component, which
    ``component_id`` does not where ids repeat, and ``text_hash`` is the XXH64 of the text.

    Every set has SimHash fingerprints in many tables. Vantage-point trees deal each table to shards and find the
    fingerprints near each other. First each set is compared with one of its fingerprint. Of what still meets other
    components, sets stay that have enough shingles in common with any others. These alone are dealt again with whole
    sketches, and compared across components within a task that returns links and no pairs.
    """
    text = F.col("text").cast("string").alias("text")
    rows = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.xxhash64(text).alias("text_hash")).mapInArrow(_sketches, "doc_id long, cls long, size int, bits binary, text_hash long"))
    classes = saved(rows.groupBy("cls").agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), *[F.first(c).alias(c) for c in ("size", "bits")]))
    light = saved(rows.select("doc_id", "cls", "text_hash"))
    dropped(rows)
    bits, hashes = classes.select("cls", "bits").hint("merge"), classes.select("cls", "text_hash")
    sized = lambda c: classes.select(F.col("cls").alias(c), F.col("size").alias(f"{c}_size")).hint("merge")
    alone = classes.where("size > 0").withColumn("root", F.col("cls")).withColumn("fresh", F.lit(True))
    stars = _shards(alone, range(STARS)).groupBy("t", "leaf").applyInPandas(_stars, "a long, b long").distinct()
    stars = stars.join(sized("a"), "a").join(sized("b"), "b").where(F.greatest("a_size", "b_size") * LIKE <= F.least("a_size", "b_size") * OF)
    stars = saved(stars.select("a", "b"))
    wanted = saved(stars.select(F.col("a").alias("cls")).union(stars.select("b")).distinct().join(hashes.hint("merge"), "cls"))
    sets = _sets(docs, wanted)
    linked = _checked(stars, sets)
    dropped(stars, sets, wanted)
    roots = saved(components(linked).withColumnRenamed("node", "cls"))
    placed = saved(classes.where("size > 0").join(roots, "cls", "left").select("cls", "size", "bits", F.coalesce("root", "cls").alias("root"), F.lit(True).alias("fresh")))
    first = saved(_shards(placed, range(EARLY)).groupBy("t", "leaf").applyInPandas(_met, "cls long").distinct())
    rest = placed.drop("fresh").join(first.select("cls", F.lit(False).alias("known")).hint("merge"), "cls", "left").withColumn("fresh", F.col("known").isNull())
    rest = saved(rest.drop("known"))
    late = saved(_shards(rest, range(EARLY, SMALL_TABLES)).groupBy("t", "leaf").applyInPandas(_met, "cls long").distinct())
    wanted = saved(first.union(late).join(hashes.hint("merge"), "cls"))
    sets = _sets(docs, wanted)
    # A link takes four fifths of a set's shingles from another set, so sets that have too many of their own are done.
    able = saved(placed.join(_shared(sets).hint("merge"), "cls").where(F.col("shared") * OF >= F.col("size") * LIKE))
    dropped(roots, placed, first, rest, late, wanted)
    members = saved(_shards(able, range(SMALL_TABLES), whole=True).groupBy("t", "leaf").applyInPandas(_members, "band long, cls long, size int, shared int, root long"))
    parts = _dealt(members)
    rows = _bundled(parts).join(bits, "cls").join(sets.hint("merge"), "cls")
    more = rows.groupBy("bundle").applyInPandas(_rivals, "a long, b long")
    more = saved(more.distinct())
    dropped(able, members, parts, sets)
    roots = saved(components(linked.union(more)).withColumnRenamed("node", "cls"))
    whole = saved(classes.join(roots, "cls", "left").select("cls", "least", F.coalesce("root", "cls").alias("root")))
    least = saved(whole.groupBy("root").agg(F.min("least").alias("component_id")))
    final = saved(whole.select("cls", "root").join(least, "root").select("cls", "root", "component_id"))
    out = saved(light.join(final, "cls").select("doc_id", F.lpad(F.lower(F.hex("cls")), 16, "0").alias("fingerprint"), "component_id", "root", "text_hash"))
    dropped(classes, light, linked, more, roots, whole, least, final)
    return out
