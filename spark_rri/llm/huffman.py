"""Canonical Huffman codes."""

from __future__ import annotations

import numpy as np


def code_sizes(weight: np.ndarray) -> np.ndarray:
    """Code lengths of ascending weights, by the two queues of leaves and joins."""
    n, w = len(weight), weight.tolist()
    joined: list[float] = []
    parent = [0] * (2 * n - 1)
    leaf = join = 0
    for k in range(n - 1):
        total = 0.0
        for _ in range(2):
            if leaf < n and (join >= len(joined) or w[leaf] <= joined[join]):
                total += w[leaf]
                parent[leaf] = n + k
                leaf += 1
            else:
                total += joined[join]
                parent[n + join] = n + k
                join += 1
        joined.append(total)
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    return np.array(depth[:n], np.int64)


def canonical(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, length in bits) of every symbol; shorter codes come first, equally long ones by symbol."""
    order = np.argsort(weight, kind="stable")
    size = np.empty(len(weight), np.int64)
    size[order] = code_sizes(weight[order])
    count = np.bincount(size)
    start = [0]
    for c in count[:-1]:
        start.append(start[-1] + int(c) << 1)
    by = np.argsort(size, kind="stable")
    code = np.empty(len(by), np.int64)
    code[by] = np.array(start, np.int64)[size[by]] + np.arange(len(by)) - np.concatenate([[0], np.cumsum(count)])[size[by]]
    return code, size
