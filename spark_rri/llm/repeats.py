"""Quality rules from suffix arrays: longest-common-prefix intervals give a text's repeated word runs.

All texts of a chunk share one suffix array over (text, word) ranks, built by prefix doubling
on numpy arrays; only suffixes that still tie are sorted again. A suffix's longest common
prefix with its neighbours of the same text is the longest repeat that starts there; the
union of these spans is what the text repeats.

Edge cases: null and empty texts have no words and fail the base rule; repeated rows are
judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import WHITE, Rolling, chunks, owners, words
from .storage import bounded_batches

#: Fixed values of the contract.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SHORT_RUN = 3


def suffix_ranks(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order within texts, and ranks by the first 1, 2, 4, ... symbols until all differ.

    Texts do not share ranks. A rank is its group's first place in the order.
    """
    n = len(symbols)
    text = owners(at)
    stop = at[1:][text]
    order = np.lexsort((symbols, text))
    new = np.ones(n, bool)
    new[1:] = (symbols[order][1:] != symbols[order][:-1]) | (text[order][1:] != text[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, step = [rank], 1
    while True:
        slot = np.flatnonzero(~new | np.append(~new[1:], False))  # places in the order that still tie
        if not len(slot):
            break
        who = order[slot]
        ahead = who + step
        nxt = np.where(ahead < stop[who], rank[np.minimum(ahead, n - 1)], -1)
        sub = np.lexsort((nxt, rank[who]))
        who, nxt = who[sub], nxt[sub]
        order[slot] = who
        old = rank[who]
        cut = np.ones(len(slot), bool)
        cut[1:] = (old[1:] != old[:-1]) | (nxt[1:] != nxt[:-1])
        new[slot] = cut
        rank = rank.copy()
        rank[who] = np.maximum.accumulate(np.where(cut, slot, 0))
        levels.append(rank)
        step *= 2
    return order, levels


def neighbour_lcp(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Common prefix of each suffix in the order with the one before (0 for the first)."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    i, j = order[:-1].copy(), order[1:].copy()
    got = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank = levels[k]
        inside = (i < n) & (j < n)
        same = inside & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])
        got += same * (1 << k)
        i += same * (1 << k)
        j += same * (1 << k)
    lcp[1:] = got
    return lcp


def longest_repeats(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each position: length of the longest run from there that also starts elsewhere in its text."""
    if not len(symbols):
        return np.zeros(0, np.int64)
    order, levels = suffix_ranks(symbols, at)
    lcp = neighbour_lcp(order, levels)
    out = np.empty(len(symbols), np.int64)
    out[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    return out


def covered(longest: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """Positions in the union of repeated runs of at least ``least`` symbols."""
    reach = np.where(longest >= least, np.arange(len(longest)) + longest, 0)
    return np.maximum.accumulate(reach) > np.arange(len(longest)) if len(longest) else np.zeros(0, bool)


def counts(per_item: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(per_item, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def duplicate_lines(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    edge = np.zeros(len(raw) + 1, bool)
    edge[at[:-1]] = True
    edge[1:] |= np.append(raw == 10, False)[:-1] if len(raw) else False
    edge[len(raw)] = False
    start = np.flatnonzero(edge)
    if not len(start):
        return np.zeros(len(at) - 1, np.int64)
    text = np.searchsorted(at, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(raw)), at[text + 1])
    body = end - ((end > start) & (raw[np.maximum(end, 1) - 1] == 10))
    ink = np.concatenate([[0], np.cumsum(~WHITE[raw])])
    has = ink[body] > ink[start]
    start, body, text = start[has], body[has], text[has]
    h = Rolling(raw).slices(start, body)
    order = np.lexsort((h, text))
    same = np.zeros(len(order), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    return np.bincount(text[order][same], minlength=len(at) - 1).astype(np.int64)


COLUMNS = {"doc_id": "long", "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "repeat_fraction": "double", "longest_repeat": "long"}


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = 8, max_fraction: float = 0.3, max_longest: int = 100) -> DataFrame:
    """One row per document: counts, base rule and verdict.

    repeat_fraction is the share of words in the union of repeats of at least ``min_repeat`` words,
    longest_repeat the longest of all repeats in words. A document is kept if the base rule
    passes and neither exceeds its limit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in chunks(batch):
                starts, ends, wa = words(raw, at)
                h = Rolling(raw).slices(starts, ends)
                n = np.diff(wa)
                longest = longest_repeats(h.view(np.int64), wa)
                lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                repeat = counts(covered(longest, wa, SHORT_RUN), wa)
                fraction = counts(covered(longest, wa, min_repeat), wa) / np.maximum(n, 1)
                most = np.zeros(len(n), np.int64)
                np.maximum.at(most, owners(wa), longest)
                failed = (n < 50) | (100 * repeat > 50 * n)
                kept = ~failed & (fraction <= max_fraction) & (most <= max_longest)
                values = [n, counts(lead[ends] - lead[starts], wa), counts(SYMBOLS[raw], at), duplicate_lines(raw, at), repeat, failed, kept, fraction, most]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, values)], list(COLUMNS))

    schema = ", ".join(f"{k} {v}" for k, v in COLUMNS.items())
    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)
