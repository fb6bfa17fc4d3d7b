"""Isolation forest kernel for one small group of rows (numpy).

What is random comes from MD5 digests of tree, node and purpose, so that a forest can be
grown again by any engine that knows MD5: a tree's sample are the rows with the least digests, a
node's feature and cut follow from the digests of its number (children of node n: 2n and 2n + 1).
Scales don't matter to a tree, so features are taken as they are, at nine decimals.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

TREES, SAMPLE, DECIMALS = 100, 256, 9


def mean_path(n):
    """Average depth of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2)
    h = 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, h))


@lru_cache(maxsize=1_000_000)
def share(tree: int, node: int, purpose: str) -> float:
    """A number from 0 to 1, 1 excluded: 32 bits of a digest."""
    return int(hashlib.md5(f"{tree}:{node}:{purpose}".encode()).hexdigest()[:8], 16) / 2**32


def _sample(tree: int, rows: int) -> np.ndarray:
    size = min(SAMPLE, rows)
    order = np.array([share(tree, i, "row") for i in range(rows)])
    return np.lexsort((np.arange(rows), order))[:size]


def _depths(x: np.ndarray, tree: int, limit: int) -> np.ndarray:
    """Path length of every row of ``x`` in one tree."""
    out = np.zeros(len(x))
    stack = [(np.arange(len(x)), x[_sample(tree, len(x))], 0, 1)]
    while stack:
        rows, node, depth, no = stack.pop()
        low, high = node.min(axis=0), node.max(axis=0)
        features = np.flatnonzero(high > low)
        if depth >= limit or len(node) <= 1 or len(features) == 0:
            out[rows] = depth + mean_path(len(node))
            continue
        j = features[int(share(tree, no, "feature") * len(features))]
        cut = low[j] + (high[j] - low[j]) * share(tree, no, "cut")
        left_rows, left_node = x[rows, j] <= cut, node[:, j] <= cut
        stack.append((rows[left_rows], node[left_node], depth + 1, 2 * no))
        stack.append((rows[~left_rows], node[~left_node], depth + 1, 2 * no + 1))
    return out


def isolation_scores(x: np.ndarray) -> np.ndarray:
    """Negative anomaly score per row; lower is more anomalous."""
    x = np.round(x, DECIMALS)
    size = min(SAMPLE, len(x))
    limit = int(np.ceil(np.log2(max(size, 2))))
    total = sum(_depths(x, tree, limit) for tree in range(TREES))
    return -np.exp2(-total / TREES / max(float(mean_path(size)), 1e-12))
