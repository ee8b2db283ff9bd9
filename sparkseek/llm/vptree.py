"""Vantage-point trees over Hamming space: shards of fingerprints, and balls within a shard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass
class Node:
    """Inside (distance to ``point`` at most ``radius``) and outside, or a leaf."""

    leaf: int = -1
    point: np.uint64 = np.uint64(0)
    radius: int = 0
    inside: Node | None = None
    outside: Node | None = None


def split(fps: np.ndarray, reach: int, tries: int = 12) -> tuple[np.uint64, int] | None:
    """Vantage point and radius that put the fewest fingerprints near the boundary of a fair split."""
    best, r = None, np.arange(64)
    for v in fps[:: max(1, len(fps) // tries)][:tries]:
        below = np.concatenate([np.zeros(reach, np.int64), np.cumsum(np.bincount(np.bitwise_count(fps ^ v), minlength=65)), np.full(reach, len(fps))])
        within = below[r + reach]
        fair = (within >= 0.2 * len(fps)) & (within <= 0.8 * len(fps))
        if fair.any():
            both = below[r + 2 * reach] - np.where(r >= reach, below[r], 0)
            cost = np.where(fair, both + np.abs(2 * within - len(fps)) / 2, np.inf)
            at = int(cost.argmin())
            if best is None or cost[at] < best[0]:
                best = (cost[at], v, at)
    return best and best[1:]


def plan_tree(sample: np.ndarray, leaves: int, reach: int) -> Node:
    """Vantage-point tree with about ``leaves`` leaves, split where most of the sample is."""
    made = 0

    def grow(fps: np.ndarray, most: float) -> Node:
        nonlocal made
        if len(fps) > most and len(fps) >= 8 and (cut := split(fps, reach)):
            near = np.bitwise_count(fps ^ cut[0]) <= cut[1]
            return Node(-1, cut[0], cut[1], grow(fps[near], most), grow(fps[~near], most))
        made += 1
        return Node(made - 1)

    return grow(sample, len(sample) / leaves)


def route(tree: Node, fps: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per leaf: the fingerprints whose ball of radius ``reach`` meets it, and which of them live there."""
    todo = [(tree, np.arange(len(fps)), np.ones(len(fps), bool))]
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if node.leaf >= 0:
            yield node.leaf, at, home
            continue
        d = np.bitwise_count(fps[at] ^ node.point).astype(np.int16)
        near, i, o = d <= node.radius, d - reach <= node.radius, d + reach > node.radius
        todo += [(node.inside, at[i], (home & near)[i]), (node.outside, at[o], (home & ~near)[o])]


def balls(fps: np.ndarray, home: np.ndarray, reach: int, block: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a shard's fingerprints, those asked and those at home within ``reach`` bits of them, as arrays of places.

    A local vantage-point tree is walked with whole arrays: data fall on one side of each boundary,
    queries on every side that their ball meets. Sides of at most ``block`` comparisons are not cut further.
    """
    todo = [(np.flatnonzero(home), np.arange(len(fps)))]
    while todo:
        data, asked = todo.pop()
        if not len(data) or not len(asked):
            continue
        cut = split(fps[data][: 1 << 14], reach, 6) if len(data) > 128 and len(data) * len(asked) > block else None
        if cut:
            d, q = (np.bitwise_count(fps[x] ^ cut[0]).astype(np.int16) for x in (data, asked))
            todo += [(data[d <= cut[1]], asked[q - reach <= cut[1]]), (data[d > cut[1]], asked[q + reach > cut[1]])]
            continue
        step = max(1, (1 << 21) // len(data))
        for i in range(0, len(asked), step):
            some = asked[i : i + step]
            q, d = np.divmod(np.flatnonzero(np.bitwise_count(fps[some][:, None] ^ fps[data][None, :]) <= reach), len(data))
            if len(q) > len(some) or (some[q] != data[d]).any():
                yield some[q], data[d]
