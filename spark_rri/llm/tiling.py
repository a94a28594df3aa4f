"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed (``min_match`` words in a row) are compared:
running Karp-Rabin finds common runs of unmarked words at falling search lengths, the longest
are marked first, and no word is marked twice. The tiles may lie in any order, so reordered
passages are found. An item is contaminated by a document when its tiles cover at least
``coverage`` of the item's words.

Words are runs of non-ASCII bytes, letters and digits, lower-cased; an item with fewer words than ``min_match``
is one seed and one tile by itself.

Seeds of the benchmark go to every task only while its texts have at most ``max_shared_seeds``
bytes, which bound the seeds (counted first); beyond that documents' distinct seeds are joined
with them, rows known by id and a digest of their text, so null and repeated ids are safe.

Edge cases: null and empty texts and items without a word match nothing; repeated documents
and items are reported each; empty tables give no rows; other columns are ignored, and kept
by ``remove_contaminated``.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, Rolling, chunks, signed, word_hashes, words
from .storage import bounded_batches

#: Documents are searched for longer matches first, from this many words down to min_match.
FIRST_SEARCH = 64


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and offsets by text."""
    flat = LOWER[raw]
    keep = np.zeros(256, bool)
    keep[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
    flat = np.where(keep[flat], flat, 32).astype(np.uint8)
    starts, ends, wa = words(flat, at)
    return word_hashes(flat, starts, ends), wa


def text_tokens(text: bytes | None) -> np.ndarray:
    raw = np.frombuffer(text or b"", np.uint8)
    return tokens(raw, np.array([0, len(raw)]))[0]


def seed_hashes(words_: np.ndarray, length: int) -> np.ndarray:
    return Rolling(words_).grams(length) if len(words_) >= length else np.zeros(0, np.uint64)


def tiles(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in doc, start in item, words), longest first, never overlapping."""
    least = min(min_match, len(item))
    if not least or len(doc) < least:
        return []
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    found = []
    search = min(max(FIRST_SEARCH, least), len(item), len(doc))
    while search >= least:
        places = defaultdict(list)
        usable = np.convolve(free_doc, np.ones(search, np.int64), "valid") == search
        hashes = seed_hashes(doc, search)
        wanted = [j for j in range(len(item) - search + 1) if free_item[j : j + search].all()]
        own = seed_hashes(item, search)
        hits = np.flatnonzero(usable & np.isin(hashes, own[wanted])) if wanted else []
        for i in hits:
            places[int(hashes[i])].append(int(i))
        matches, longest = [], 0
        for j in wanted:
            for i in places.get(int(own[j]), ()):
                if i and j and free_doc[i - 1] and free_item[j - 1] and doc[i - 1] == item[j - 1]:
                    continue  # part of a longer match
                n = 0
                while i + n < len(doc) and j + n < len(item) and free_doc[i + n] and free_item[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                if n >= search:
                    matches.append((-n, j, i))
                    longest = max(longest, n)
        if longest >= 2 * search:
            search = min(longest, len(item), len(doc))
            continue
        # the longest first; of a match that a tile has cut what is left goes back, so none as long as the search stays unmarked
        heapq.heapify(matches)
        while matches:
            n, j, i = heapq.heappop(matches)
            both = np.flatnonzero(np.diff(np.concatenate([[False], free_doc[i : i - n] & free_item[j : j - n], [False]]).astype(np.int8)))
            for low, high in both.reshape(-1, 2).tolist():
                if high - low == -n:
                    free_doc[i : i - n] = free_item[j : j - n] = False
                    found.append((i, j, -n))
                elif high - low >= search:
                    heapq.heappush(matches, (low - high, j + low, i + low))
        if search == least:
            break
        search = max(least, search // 2)
    return found


def near(doc: np.ndarray, item: np.ndarray, seeds: np.ndarray, length: int) -> np.ndarray:
    """The document's words that can be in a tile with the item; other stretches become one breaking word."""
    mask = np.isin(seeds, seed_hashes(item, length))
    cover = np.zeros(len(doc) + 1, np.int64)
    hit = np.flatnonzero(mask)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + length, -1)
    inside = np.cumsum(cover[:-1]) > 0
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    out = np.where(inside, doc, np.uint64(0))
    return out[keep]


class Benchmark:
    """Items as word hashes, with the seeds that lead to them."""

    def __init__(self, rows: list, min_match: int):
        self.min_match = min_match
        self.items = [(r["item_id"], t) for r in rows if len(t := text_tokens(bytes(r["text"]) if r["text"] is not None else None))]
        by: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for k, (_, t) in enumerate(self.items):
            length = min(min_match, len(t))
            s = np.unique(seed_hashes(t, length))
            by[length].append((s, np.full(len(s), k)))
        self.seeds = {}
        for length, parts in by.items():
            s, k = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(s, kind="stable")
            self.seeds[length] = (s[order], k[order])

    def compare(self, doc: np.ndarray, seeds: dict[int, np.ndarray]) -> Iterator[tuple[int, int, int, list]]:
        """(item, its words, covered words, tiles) of all items that share a seed."""
        for length, own in seeds.items():
            listed, item_of = self.seeds[length]
            hit = np.unique(own[np.isin(own, listed)])
            low, high = np.searchsorted(listed, hit, "left"), np.searchsorted(listed, hit, "right")
            for k in sorted({int(x) for a, b in zip(low, high, strict=True) for x in item_of[a:b]}):
                item_id, item = self.items[k]
                found = tiles(near(doc, item, own, length), item, self.min_match)
                yield item_id, len(item), sum(t[2] for t in found), found


SCHEMA = "doc_id long, item_id long, item_words long, covered_words long, coverage double, n_tiles long"


def _scan(batches: Iterator[pa.RecordBatch], bench: Benchmark, coverage: float) -> Iterator[tuple[pa.RecordBatch, list[list[tuple]]]]:
    """For each slice of a batch, the contaminations of every row."""
    for batch in batches:
        for part, raw, at in chunks(batch):
            h, wa = tokens(raw, at)
            grams = {length: seed_hashes(h, length) for length in bench.seeds}
            rows: list[list[tuple]] = [[] for _ in range(part.num_rows)]
            some = np.zeros(part.num_rows, bool)
            for length, (listed, _) in bench.seeds.items():
                hit = np.flatnonzero(np.isin(grams[length], listed))
                text = np.searchsorted(wa, hit, "right") - 1
                some[text[hit + length <= wa[text + 1]]] = True
            for d in np.flatnonzero(some):
                doc = h[wa[d] : wa[d + 1]]
                own = {length: grams[length][wa[d] : max(wa[d], wa[d + 1] - length + 1)] for length in bench.seeds}
                for item_id, n, got, found in bench.compare(doc, own):
                    if got >= coverage * n:
                        rows[d].append((item_id, n, got, got / n, len(found)))
            yield part, rows


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text"))


def _small(items: DataFrame, limit: int) -> bool:
    """Bytes bound the number of seeds."""
    return (items.agg(F.sum(F.length("text"))).first()[0] or 0) <= limit


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = 5, coverage: float = 0.6, max_shared_seeds: int = 32 << 20) -> DataFrame:
    """One row per document and item whose tiles cover at least ``coverage`` of the item's words."""
    plain, items = _plain(docs, id_col, text_col), _items(benchmark, item_col, item_text_col)
    if not _small(items, max_shared_seeds):
        return _joined(plain, items, min_match, coverage).drop("doc_key")
    shared = docs.sparkSession.sparkContext.broadcast(Benchmark(items.collect(), min_match))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _scan(batches, shared.value, coverage):
            ids = part.column(0).to_pylist()
            flat = [(d, *x) for d, found in zip(ids, rows, strict=True) for x in found]
            if flat:
                cols = list(zip(*flat, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if i == 4 else pa.int64()) for i, c in enumerate(cols)], ["doc_id", "item_id", "item_words", "covered_words", "coverage", "n_tiles"])

    return plain.mapInArrow(run, SCHEMA)


def _digest(text: Column) -> Column:
    return F.xxhash64(text.cast("binary"))


def _joined(plain: DataFrame, items: DataFrame, min_match: int, coverage: float) -> DataFrame:
    """The same by joins, with the digest of the document's text: distinct seeds of both sides, then the texts of pairs that share one."""
    plain, items = plain.withColumn("doc_key", _digest(F.col("text"))), items.withColumn("item_key", _digest(F.col("text")))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, at in chunks(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.minimum(np.diff(tokens(raw, at)[1]), min_match)), pa.int32())], ["n"])

    lengths = sorted(r[0] for r in items.mapInArrow(sizes, "n int").distinct().collect() if r[0])  # min_match at most

    def seeds(batches: Iterator[pa.RecordBatch], of_items: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in chunks(batch):
                h, wa = tokens(raw, at)
                for d in range(part.num_rows):
                    t = h[wa[d] : wa[d + 1]]
                    for length in [min(min_match, len(t))] if of_items else lengths:
                        s = signed(np.unique(seed_hashes(t, length))) if length else []
                        if len(s):
                            yield pa.RecordBatch.from_arrays([pa.array([part.column(k)[d].as_py()] * len(s), pa.int64()) for k in (0, 2)] + [pa.array(s), pa.array([length] * len(s), pa.int32())], ["id", "key", "seed", "length"])

    schema = "id long, key long, seed long, length int"
    left = plain.mapInArrow(lambda b: seeds(b, False), schema).withColumnsRenamed({"id": "left_id", "key": "left_key"})
    right = items.mapInArrow(lambda b: seeds(b, True), schema).withColumnsRenamed({"id": "right_id", "key": "right_key"})
    pairs = left.join(right, ["seed", "length"]).select("left_id", "left_key", "right_id", "right_key").distinct()
    both = pairs.join(plain, F.col("left_id").eqNullSafe(F.col("doc_id")) & (F.col("left_key") == F.col("doc_key")))
    both = both.join(items.withColumnRenamed("text", "item_text"), F.col("right_id").eqNullSafe(F.col("item_id")) & (F.col("right_key") == F.col("item_key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                item = text_tokens(row["item_text"])
                found = tiles(text_tokens(row["text"]), item, min_match)
                got = sum(t[2] for t in found)
                if len(item) and got >= coverage * len(item):
                    out.append((row["doc_id"], row["item_id"], len(item), got, got / len(item), len(found), row["doc_key"]))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if i == 4 else pa.int64()) for i, c in enumerate(cols)], ["doc_id", "item_id", "item_words", "covered_words", "coverage", "n_tiles", "doc_key"])

    return both.select("doc_id", "doc_key", "text", "item_id", "item_text").mapInArrow(run, SCHEMA + ", doc_key long")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = 5, coverage: float = 0.6, max_shared_seeds: int = 32 << 20) -> DataFrame:
    """The rows of docs, all columns, that contaminate no item."""
    items = _items(benchmark, item_col, item_text_col)
    if not _small(items, max_shared_seeds):
        bad = _joined(_plain(docs, id_col, text_col), items, min_match, coverage).select("doc_id", "doc_key").distinct()
        own = docs.select(F.struct(*docs.columns).alias("own"))
        same = F.col("own")[id_col].cast("long").eqNullSafe(F.col("doc_id")) & (_digest(F.col("own")[text_col]) == F.col("doc_key"))
        return own.join(bad, same, "left_anti").select("own.*")
    shared = docs.sparkSession.sparkContext.broadcast(Benchmark(items.collect(), min_match))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index(text_col))
            own = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), column], ["doc_id", "text"])
            low = 0
            for part, rows in _scan([own], shared.value, coverage):
                clean = pa.array([not r for r in rows], pa.bool_())
                yield batch.slice(low, part.num_rows).filter(clean)
                low += part.num_rows

    return bounded_batches(docs).mapInArrow(run, docs.schema)
