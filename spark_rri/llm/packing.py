"""Packing: tokenised documents into sequences of near-equal fill, by Karmarkar-Karp multiway differencing.

Each scan partition tokenises its own texts, cuts them into pieces and packs blocks of pieces
in the task that read them, so nothing is shuffled. A document of n ids gives n // capacity
full pieces, each a sequence by itself, and a rest cut into pieces of at most ``max_piece``.
A block of rests fills about ``windows`` sequences: the differencing method repeatedly merges
the two partial partitions with the largest imbalance, pairing full windows of one with empty
windows of the other; where a window would exceed the capacity, the window count rises by one
and the block is packed again.

Edge cases: a null or empty text is the end id alone; repeated rows are packed each; an empty
table gives no rows; other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches

END_ID = 2
CACHE_WORDS = 1_500_000
_encoders: dict[str, WordEncoder] = {}

PIECE_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class WordEncoder(dict):
    """White-space separated word (bytes) -> its ids as little-endian bytes; holds a bounded number of words.

    The tokenizer splits at white space before anything else, so a text's ids are its words' ids in turn.
    """

    #: Stands between words when many are encoded at once; words that hold it are encoded alone.
    MARK = "\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark_id = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        assert len(self.mark_id) == 1

    def learn(self, words: Iterable[bytes]) -> None:
        new = [w for w in set(words) if w not in self]
        plain = [w for w in new if b"\x01" not in w]
        for w in new if len(plain) < len(new) else ():
            if b"\x01" in w:
                self[w] = np.array(self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        glue = f" {self.MARK} "
        for low in range(0, len(plain), 400):
            part = plain[low : low + 400]
            text = glue.join(w.decode("utf-8", "replace") for w in part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark_id[0])
            assert len(cuts) == len(part) - 1
            raw, a = ids.tobytes(), 0
            for w, b in zip(part, [*(cuts * 4).tolist(), len(raw)], strict=True):
                self[w] = raw[a:b]
                a = b + 4

    def encode(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.__getitem__, words))


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp for any number of windows: the items of each window.

    A partial partition is a list of (sum, items) in descending order; windows not listed are empty.
    """
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        room = windows - len(a)
        if len(b) <= room:
            both = a + b
        else:  # the smallest windows of a meet the largest of b
            met = len(b) - room
            low = a[len(a) - met :]
            high = b[:met]
            both = a[: len(a) - met] + b[met:] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(reversed(low), high, strict=True)]
        both.sort(key=lambda x: -x[0])
        least = both[-1][0] if len(both) == windows else 0
        heapq.heappush(heap, (least - both[0][0], serial, both))
        serial += 1
    out = []
    for _, tree in heap[0][2] if heap else []:
        items, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                items.append(x)
        out.append(sorted(items))
    return out


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; their number rises until none is exceeded."""
    if not sizes:
        return []
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, windows)
        if max(sum(sizes[i] for i in w) for w in found) <= capacity:
            return found
        windows += 1


def cut(n: int, capacity: int, max_piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, then the rest in near-equal parts."""
    full = n // capacity
    pieces = [(k * capacity, capacity) for k in range(full)]
    rest, at = n - full * capacity, full * capacity
    parts = -(-rest // max_piece)
    for k in range(parts):
        size = rest // parts + (k < rest % parts)
        pieces.append((at, size))
        at += size
    return pieces


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, max_piece: int = 1024, windows: int = 128, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    with_ids adds the piece's ids as an array, for writing the sequences themselves.
    """
    target = windows * (capacity - max(1, capacity // 400))
    names = list(PIECE_COLUMNS) + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        prefix, serial = TaskContext.get().partitionId() << 40, 0
        block: list[tuple] = []
        held = 0
        out: list[tuple] = []

        def place(pieces: list[tuple]) -> None:
            nonlocal serial
            for window in pack_block([p[2] for p in pieces], capacity):
                at = 0
                for i in window:
                    d, start, length, crc, n, ids = pieces[i]
                    out.append((d, start, length, crc, n, prefix + serial, at, ids))
                    at += length
                serial += 1

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in cols[7]], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                split = [(t or b"").split() for t in part.column(1).to_pylist()]
                if len(enc) > CACHE_WORDS:
                    enc.clear()
                enc.learn(w for t in split for w in t)
                for d, t in zip(part.column(0).to_pylist(), split, strict=True):
                    raw = enc.encode(t) + end
                    n = len(raw) // 4
                    for start, length in cut(n, capacity, max_piece):
                        ids = raw[4 * start : 4 * (start + length)]
                        piece = (d, start, length, zlib.crc32(ids), n, ids if with_ids else b"")
                        if length == capacity:
                            place([piece])
                            continue
                        if held + length > target:
                            place(block)
                            block, held = [], 0
                        block.append(piece)
                        held += length
                if len(out) > 20_000:
                    yield emit()
        place(block)
        if out:
            yield emit()

    schema = ", ".join(f"{c} long" for c in PIECE_COLUMNS) + ", ids array<long>" * with_ids
    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)
