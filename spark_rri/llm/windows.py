"""Super-windows: every window of W symbols belongs to one run of windows that share a minimal gram.

Two equal windows hold the same grams, so they have the same minimum and meet under one key;
each window lies in exactly one run. A run is stored once as its W + n - 1 symbols.
"""

from __future__ import annotations

import numpy as np

from .arrays import Rolling, sliding_min


def super_windows(symbols: np.ndarray, at: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first, count, key, body, again): runs of windows in texts given by offsets.

    first is relative to its text; key is the shared minimum; body identifies the run's symbols;
    again says that the minimal gram lies in the run more than once, so its own windows may repeat.
    """
    roll = Rolling(symbols)
    grams, wide = roll.grams(gram), width - gram + 1
    low = sliding_min(grams, wide)
    n = len(low)
    room = np.maximum(np.diff(at) - width + 1, 0)
    if n <= 0 or not room.any():
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64), z.astype(bool)
    texts = np.flatnonzero(room)
    begin, stop = at[texts], at[texts] + room[texts]
    new = np.ones(n, bool)
    new[1:] = low[1:] != low[:-1]
    new[begin] = True
    live = np.zeros(n + 1, np.int64)
    np.add.at(live, begin, 1)
    np.add.at(live, stop, -1)
    valid = np.cumsum(live[:-1]) > 0
    start = np.flatnonzero(new & valid)
    text = texts[np.searchsorted(begin, start, "right") - 1]
    nxt = np.append(start[1:], n)
    end = np.minimum(nxt, at[text] + room[text])
    # a gram is minimal somewhere if it reaches the largest minimum of the windows around it
    edge = np.zeros(wide - 1, np.uint64)
    top = ~sliding_min(~np.concatenate([edge, low, edge]), wide)
    minima = np.flatnonzero(grams == top)
    a, b = np.searchsorted(minima, start), np.searchsorted(minima, end + wide - 1)
    run = np.repeat(np.arange(len(start)), b - a)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
    again = np.bincount(run, grams[minima[inside]] == low[start][run], minlength=len(start)) > 1
    return text, start - at[text], end - start, low[start], roll.slices(start, end + width - 1), again
