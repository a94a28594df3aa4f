"""Removal of repeated windows: bytes by suffix arrays, words by an FM-index.

The shared plan. Windows go by runs that share a minimal gram (see ``windows``), so equal
windows meet under one key and only runs' digests are shuffled. Keys that occur once drop
out, unless their run holds its minimal gram twice. Of the others every distinct run goes, once
and with the number of its copies, to a shard dealt by key, and the shard's index decides which
windows repeat: those in intervals of equal windows whose runs have at least two copies in all.
What it finds of a run with copies holds for all of them. A key with more than ``max_runs``
distinct runs (which bounds a shard: some 5 MB of text), a passage that very many texts hold,
at its ends, is dealt window by window instead, by the windows' digests, pre-aggregated before
the shuffle. Nothing is dropped in either way.

Bytes: each shard has a suffix array over phrases, cut where the content says so and named in
the order of their bytes, so it is the byte order of the suffixes at phrase borders; windows
are put in order by what stands before their first border and the suffix behind it, and common
prefixes of neighbours in the array give the intervals. Words: each shard has a compressed
FM-index over its runs, in which backward search gives the matching statistics of every run
that documents bring, and the weight of an interval the number of copies.

Rows are known by id and a digest of their text, so repeated rows and null ids are safe:
equal rows share a verdict, and count as two texts.

Edge cases: null, empty and short texts have no window and stay whole; an empty table gives
no rows; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .arrays import Rolling, binary, chunks, merged, signed, word_hashes, words
from .fmindex import FMIndex, repeated_windows
from .lyndon import suffix_array
from .storage import Scratch, bounded_batches
from .windows import super_windows

#: Bytes of runs that a shard's index takes at a time, keys whole.
SHARD_SYMBOLS = 1 << 19
#: What is told of a run to the task that cuts it out of its text.
RUN = ("key", "body", "first", "n", "copies", "many")
#: A phrase border lies where the hash of so many bytes is a multiple of the second number.
BORDER, SPACING = 8, 16

Split = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
Finder = Callable[[np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def as_bytes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return raw, at


def as_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, wa = words(raw, at)
    return word_hashes(raw, starts, ends), wa


def common_prefix(roll: Rolling, i: np.ndarray, j: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many symbols from places i and j agree, up to ``room``, by halving on hashes."""
    got = np.zeros(len(i), np.int64)
    for k in range(int(room.max(initial=0)).bit_length() - 1, -1, -1):
        on = np.flatnonzero(got + (1 << k) <= room)
        n = got[on] + (1 << k)
        got[on[roll.slices(i[on], i[on] + n) == roll.slices(j[on], j[on] + n)]] += 1 << k
    return got


def border_order(symbols: np.ndarray, at: np.ndarray, border: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Borders by the byte order of the suffixes there, by a suffix array over phrases.

    A phrase reaches to the end of the next border's gram, so none is the start of another,
    and the order of names is that of bytes; a run's last one reaches to the run's end.
    """
    whole = symbols.tobytes()
    last = np.append(run[1:] != run[:-1], True)
    end = np.where(last, at[run + 1], np.append(border[1:], 0) + BORDER)
    phrases = [whole[a:b] for a, b in zip(border.tolist(), end.tolist(), strict=True)]
    name = {x: k for k, x in enumerate(sorted(set(phrases)))}
    n_runs = len(at) - 1
    slot = np.arange(len(border)) + run
    text = np.full(len(border) + n_runs, -1, np.int64)
    text[slot] = np.fromiter((name[x] for x in phrases), np.int64, len(phrases)) + n_runs
    text[text < 0] = np.arange(n_runs)[::-1]  # each run ends in a number of its own, the last is the smallest
    border_at = np.full(len(text), -1, np.int64)
    border_at[slot] = np.arange(len(border))
    order = border_at[np.asarray(suffix_array(text.tolist()), np.int64)]
    return order[order >= 0]


def by_suffix_array(symbols: np.ndarray, at: np.ndarray, copies: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, window) that repeat among all runs, each of which stands for its copies."""
    roll = Rolling(symbols)
    size = np.diff(at)
    border = np.flatnonzero(roll.grams(BORDER) % np.uint64(SPACING) == 0)
    run = np.searchsorted(at, border, "right") - 1
    good = border + BORDER <= at[run + 1]
    border, run = border[good], run[good]
    order = border_order(symbols, at, border, run)
    rank = np.empty(len(border), np.int64)
    rank[order] = np.arange(len(order))
    left = np.minimum(at[run + 1] - border, width)
    lows = [common_prefix(roll, border[order[:-1]], border[order[1:]], np.minimum(left[order[:-1]], left[order[1:]]))]
    while len(lows[-1]) > 1 << (len(lows) - 1):  # least common prefix of 2, 4, ... neighbours
        x, half = lows[-1], 1 << (len(lows) - 1)
        lows.append(np.minimum(x[:-half], x[half:]))
    count = np.where(size >= width, size - width + 1, 0)
    owner = np.repeat(np.arange(len(size)), count)
    window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = at[owner] + window
    i = np.searchsorted(border, place)
    has = i < len(border)
    has[has] = border[i[has]] + BORDER <= place[has] + width
    stop = place + width
    stop[has] = border[i[has]]
    head = roll.slices(place, stop)
    behind = np.full(len(place), -1, np.int64)
    behind[has] = rank[i[has]]
    by = np.lexsort((behind, head))
    same = head[by][1:] == head[by][:-1]
    low, high = behind[by][:-1], behind[by][1:]
    pair = np.flatnonzero(same & (low >= 0) & (high > low))  # without a border, equal heads are equal windows
    span = high[pair] - low[pair]
    level = np.frexp(span.astype(np.float64))[1] - 1
    least = np.empty(len(pair), np.int64)
    for k in np.unique(level):
        on = np.flatnonzero(level == k)
        least[on] = np.minimum(lows[k][low[pair[on]]], lows[k][high[pair[on]] - (1 << int(k))])
    same[pair] = least >= width - (stop - place)[by][pair]
    first = np.flatnonzero(np.append(True, ~same)) if len(by) else np.zeros(0, np.int64)
    total = np.add.reduceat(copies[owner[by]], first) if len(by) else first
    hit = by[np.repeat(total >= 2, np.diff(np.append(first, len(by))))]
    return owner[hit], window[hit]


def by_fm_index(symbols: np.ndarray, at: np.ndarray, copies: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same over word hashes: backward search of every run in an index of all."""
    _, name = np.unique(symbols, return_inverse=True)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    text = np.zeros(len(symbols) + len(at) - 1, np.int64)
    slot = np.arange(len(symbols)) + owner
    text[slot] = name + 1  # 0 ends a run
    weight = np.zeros(len(text), np.int64)
    weight[slot] = copies[owner]
    begin = at[:-1] + np.arange(len(at) - 1)
    return repeated_windows(FMIndex(text, weight), text, begin, np.maximum(np.diff(at) - width + 1, 0), width)


def _plain(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    text = F.col(text_col).cast("binary")
    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"), *more)


def _same_row(a: str, b: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(a)) & (F.col("th") == F.col(b))


def _runs(plain: DataFrame, split: Split, width: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in chunks(batch):
                text, first, n, key, body, again = super_windows(*split(raw, at), width, gram)
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(body)), part.column(0).take(take), part.column(1).take(take), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(again)], ["key", "body", "doc_id", "th", "first", "n", "again"])

    return plain.mapInArrow(run, "key long, body long, doc_id long, th long, first int, n int, again boolean")


def _cut_out(plain: DataFrame, runs: DataFrame, split: Split, width: int, scratch: Scratch) -> DataFrame:
    """The symbols of chosen runs, from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in chunks(batch):
                sym, sa = split(raw, at)
                sym = np.ascontiguousarray(sym)
                wide, whole = sym.dtype.itemsize, sym.tobytes()
                found = part.column(3).flatten()
                text = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(3)).to_numpy())
                columns = dict(zip(RUN, found.flatten(), strict=True))
                start = (sa[text] + columns["first"].to_numpy()) * wide
                end = start + (columns["n"].to_numpy().astype(np.int64) + width - 1) * wide
                cut = pa.array([whole[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays([columns["key"], columns["body"], part.column(0).take(take), part.column(1).take(take), columns["first"], columns["n"], columns["copies"], columns["many"], cut], [*RUN[:2], "doc_id", "th", *RUN[2:], "symbols"])

    by_text = runs.groupBy(F.col("doc_id").alias("run_id"), F.col("th").alias("run_th")).agg(F.collect_list(F.struct(*RUN)).alias("runs"))
    return plain.join(scratch.beside(by_text), _same_row("run_id", "run_th")).select("doc_id", "th", "text", "runs").mapInArrow(run, "key long, body long, doc_id long, th long, first int, n int, copies long, many boolean, symbols binary")


#: What a shard's index says: windows rel to rel + n - 1 of a run repeat.
FOUND = "key long, body long, doc_id long, th long, first int, copies long, rel int, n int"


def _sharded(runs: DataFrame, finder: Finder, width: int, kind: type) -> DataFrame:
    """Repeated windows of distinct runs; all runs of a key come together."""

    def shard(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(rows).combine_chunks()
        raw, at = binary(table.column("symbols"))
        symbols, at = raw.view(kind), at // np.dtype(kind).itemsize
        run, window = finder(symbols, at, table.column("copies").to_numpy(), width)
        if not len(run):
            return None
        order = np.lexsort((window, run))
        run, window = run[order], window[order]
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (window[1:] != window[:-1] + 1)
        head = np.flatnonzero(new)
        n = np.append(head[1:], len(run)) - head
        own = table.select(["key", "body", "doc_id", "th", "first", "copies"]).take(pa.array(run[head])).combine_chunks()
        return own.append_column("rel", pa.array(window[head].astype(np.int32))).append_column("n", pa.array(n.astype(np.int32))).to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.dtype(kind).itemsize
        held: list[pa.RecordBatch] = []
        room = 0
        for batch in batches:
            key = batch.column(0).to_numpy()
            size = np.diff(binary(batch.column(7))[1]) // wide
            low = 0
            for cut in np.flatnonzero(np.append(True, key[1:] != key[:-1])):  # a new key begins here
                if held and held[-1].column(0)[-1].as_py() == key[cut] and cut == 0:
                    continue
                if cut > low:
                    held.append(batch.slice(low, cut - low))
                    room += int(size[low:cut].sum())
                    low = int(cut)
                if room >= SHARD_SYMBOLS:
                    if found := shard(held):
                        yield found
                    held, room = [], 0
            if low < batch.num_rows:
                held.append(batch.slice(low))
                room += int(size[low:].sum())
        if held and (found := shard(held)):
            yield found

    dealt = runs.repartition("key").sortWithinPartitions("key", "body")
    return dealt.select("key", "body", "doc_id", "th", "first", "n", "copies", "symbols").mapInArrow(run, FOUND)


def _window_by_window(runs: DataFrame, width: int, kind: type) -> DataFrame:
    """The same of runs whose key is very frequent: every window's digest is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                k = row["n"]
                h = Rolling(np.frombuffer(row["symbols"], kind)).slices(np.arange(k), np.arange(k) + width)
                own = [pa.array([row[c]] * k, t) for c, t in (("key", pa.int64()), ("body", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int32()), ("copies", pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), *own, pa.array(np.arange(k, dtype=np.int32))], ["window", "key", "body", "doc_id", "th", "first", "copies", "rel"])

    each = runs.mapInArrow(run, "window long, key long, body long, doc_id long, th long, first int, copies long, rel int")
    times = each.groupBy("window").agg(F.sum("copies").alias("times")).filter("times >= 2").select("window")
    return each.join(times, "window", "left_semi").select("key", "body", "doc_id", "th", "first", "copies", "rel", F.lit(1).alias("n"))


def repeated(docs: DataFrame, split: Split, finder: Finder, width: int, gram: int, kind: type, id_col: str, text_col: str, max_runs: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(plain, spans): for every text with a repeated window, [first, n] of its runs of repeated windows."""
    plain = _plain(docs, id_col, text_col)
    rows = _runs(plain, split, width, gram)
    live = rows.groupBy("key").agg(F.count("*").alias("rows"), F.max("again").alias("again")).filter("rows > 1 or again").select("key")
    kept = scratch.save(rows.drop("again").join(live, "key"))
    scratch.release()
    bodies = kept.groupBy("key", "body").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "th", "first", "n")).alias("r"))
    bodies = scratch.save(bodies.select("key", "body", "copies", "r.*"))
    many = bodies.groupBy("key").agg((F.count("*") > max_runs).alias("many"))
    chosen = scratch.save(_cut_out(plain, bodies.join(many, "key"), split, width, scratch))
    scratch.release()
    found = scratch.save(_sharded(chosen.filter("not many"), finder, width, kind).union(_window_by_window(chosen.filter("many"), width, kind)))
    hit = F.col("first") + F.col("rel")
    one = found.filter("copies = 1").select("doc_id", "th", hit.alias("first"), "n")
    copied = found.filter("copies > 1").select("key", "body", "rel", "n").join(kept.drop("n"), ["key", "body"]).select("doc_id", "th", hit.alias("first"), "n")
    spans = one.union(copied).groupBy(F.col("doc_id").alias("span_id"), F.col("th").alias("span_th")).agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    return plain, scratch.beside(spans.select("span_id", "span_th", F.array_sort("spans").alias("spans")))


def _kept(plain: DataFrame, spans: DataFrame, each: Callable, names: list[str], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                first = np.array([x["first"] for x in found or ()], np.int64)
                rows.append((doc_id, *each(text or b"", first, np.array([x["n"] for x in found or ()], np.int64))))
            kinds = pa.schema([(n, pa.string() if n == "kept_sha256" else pa.binary() if n == "kept_text" else pa.int64()) for n in names])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], names)

    return plain.join(spans, _same_row("span_id", "span_th"), "left").select("doc_id", "text", "spans").mapInArrow(run, schema)


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, gram: int = 48, max_runs: int = 20_000, with_text: bool = False) -> DataFrame:
    """One row per document: bytes, removed bytes, removed spans and digest of what is left.

    with_text adds kept_text, the bytes that are left (which may break a character).
    """
    scratch = Scratch(docs.sparkSession)
    plain, spans = repeated(docs, as_bytes, by_suffix_array, width, gram, np.uint8, id_col, text_col, max_runs, scratch)

    def each(text: bytes, first: np.ndarray, n: np.ndarray) -> tuple:
        start, end = merged(first, first + n + width - 1)
        left, at = [], 0
        for a, b in zip(start.tolist(), end.tolist(), strict=True):
            left.append(text[at:a])
            at = b
        left.append(text[at:])
        rest = b"".join(left)
        out = (len(text), len(text) - len(rest), len(start), hashlib.sha256(rest).hexdigest())
        return (*out, rest) if with_text else out

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text binary" * with_text
    return _kept(plain, spans, each, names, schema)


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, gram: int = 12, max_runs: int = 20_000, with_text: bool = False) -> DataFrame:
    """One row per document: words, removed words and digest of what is left, joined by blanks."""
    scratch = Scratch(docs.sparkSession)
    plain, spans = repeated(docs, as_words, by_fm_index, width, gram, np.uint64, id_col, text_col, max_runs, scratch)

    def each(text: bytes, first: np.ndarray, n: np.ndarray) -> tuple:
        own = text.split()
        start, end = merged(first, first + n + width - 1)
        left, at = [], 0
        for a, b in zip(start.tolist(), end.tolist(), strict=True):
            left += own[at:a]
            at = b
        left += own[at:]
        rest = b" ".join(left)
        out = (len(own), len(own) - len(left), hashlib.sha256(rest).hexdigest())
        return (*out, rest) if with_text else out

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text binary" * with_text
    return _kept(plain, spans, each, names, schema)


def without_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, width: int = 200, gram: int = 48, max_runs: int = 20_000) -> DataFrame:
    """The rows of docs, all columns, with repeated bytes cut out of the text.

    A character that a cut breaks goes whole. length_col, if given, becomes the new length in characters.
    """
    scratch = Scratch(docs.sparkSession)
    _, spans = repeated(docs, as_bytes, by_suffix_array, width, gram, np.uint8, id_col, text_col, max_runs, scratch)
    plain = _plain(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_col, text_col), id_col, text_col, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not found:
                    texts.append(None if text is None else text.decode("utf-8", "replace"))
                    continue
                first = np.array([x["first"] for x in found], np.int64)
                start, end = merged(first, first + np.array([x["n"] for x in found], np.int64) + width - 1)
                cuts = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(text)]
                texts.append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    both = plain.join(spans, _same_row("span_id", "span_th"), "left").select("row", "text", "spans")
    out = both.mapInArrow(run, StructType([both.schema["row"], StructField("text", StringType())]))
    new = {text_col: F.col("text")} | ({length_col: F.length("text").cast(docs.schema[length_col].dataType)} if length_col else {})
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
