"""Language-model scoring: a hashed maximum-entropy model over a tree of the whole vocabulary.

A token's probability is the product of the binary decisions on the way to its word. The
shared tree is a Huffman tree whose leaves are the ``head`` most frequent words, classes of
about ``per_class`` other words, dealt by hash, and the unseen word; within a class a balanced
tree leads to each word. The logit of every decision is a bias plus hashed feature weights:
the previous word, the one before it (a skip feature) and both as a bigram. Biases start at
the counts, so the untrained model equals the smoothed unigram model, and every text has a
proper probability.

Training goes in rounds. Documents are dealt to shards of about ``TOKENS_PER_SHARD`` tokens by
their id and text; in every round gradient steps over a shard's documents start from the shared
weights, and the shards' weights are averaged by tokens in a tree of bounded groups and shared
again. All training documents are used once over the rounds. What a shard holds and in which
order does not hang on Spark's partitions, so scores do not either. There are ``ROWS`` weights for
hashed features at every size, which tasks can be sent; a token touches some fifty of them.

Counts are over all training documents and never leave Spark: the head words go to all tasks;
other words' tokens are joined, with their features, with counts and paths within classes, on
which the decisions within classes are learnt and scored.

Edge cases: null, empty and blank texts are one end token; repeated rows count and are scored
each; an empty table gives no rows; without training tokens every token has the base
probability; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, chunks, mix, signed, word_hashes, words
from .huffman import canonical
from .storage import Scratch, bounded_batches

END = np.uint64(0xE0D0E0D0E0D0E0D1)
START = np.uint64(0x57A757A757A757A7)
ADD = 0.1
FEATURES = 3
NODE_FACTOR, ROW_FACTOR = np.uint32(0x85EBCA6B), np.uint32(0x9E3779B1)
ROWS = 1 << 22
MOST_CLASS_BITS, GROUP_WORDS = 16, 100_000
#: Tokens of a gradient step.
BATCH = 32_768
FLUSH = 1_000_000
BLOCKS, FAN_IN = 32, 32
TOKENS_PER_SHARD = 4_000_000
#: Weights that one step updates at a time.
BLOCK = 1 << 15


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-case words, an end token behind each text, and offsets by text."""
    flat = LOWER[raw]
    starts, ends, wa = words(flat, at)
    h = word_hashes(flat, starts, ends)
    n = len(wa) - 1
    out = np.full(len(h) + n, END, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(n), np.diff(wa))] = h
    return out, wa + np.arange(n + 1)


def contexts(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """tokens x features: hashes of what stands before each token in its text."""
    one, two = np.empty_like(h), np.empty_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    first = at[:-1]
    one[first] = START
    two[first] = START
    second = first[np.diff(at) > 1] + 1
    two[second] = START
    return np.stack([mix(one + np.uint64(1)), mix(two + np.uint64(2)), mix(one * np.uint64(3) ^ mix(two + np.uint64(3)))], axis=1)


def zeros(n: int) -> np.ndarray:
    """A fresh array: one like an array that came by pickle has a type object of its own, with which ``np.add.at`` is slow."""
    return np.zeros(n, np.float32)


def log_sigmoid(z: np.ndarray) -> np.ndarray:
    """In single precision the plain logarithm is as good as log1p here, to 1e-7, and several times faster."""
    return -np.log(np.float32(1) + np.exp(-z))


@dataclass
class Paths:
    """Binary decisions that lead to each token's leaf: ``size`` bits of ``code``, the highest first.

    key(order, depth, prefix) hashes the nodes at a depth, bias(order, depth, prefix) is their logit without features.
    """

    code: np.ndarray
    size: np.ndarray
    key: Callable[[np.ndarray, int, np.ndarray], np.ndarray]
    bias: Callable[[np.ndarray, int, np.ndarray], np.ndarray]

    def levels(self, f: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By depth, for the tokens that have a node there: their bits, weight rows and logits of bit 1; and all tokens' order."""
        order = np.argsort((255 - self.size).astype(np.uint8), kind="stable")
        size, code, own = self.size[order], self.code[order], np.ascontiguousarray(f[order].T)
        if len(size) and size[0] < 31:
            size, code = size.astype(np.int32), code.astype(np.int32)
        shift = np.uint32(32 - (len(weight).bit_length() - 1))
        for depth in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -depth, "left"))
            left = size[:n] - size.dtype.type(depth)
            prefix = code[:n] >> left
            rows = own[:, :n] ^ self.key(order[:n], depth, prefix)
            rows *= ROW_FACTOR
            rows >>= shift
            rows = rows.astype(np.intp)
            z = weight.take(rows).sum(axis=0)
            z += self.bias(order[:n], depth, prefix)
            yield order, ((code[:n] >> (left - left.dtype.type(1))) & left.dtype.type(1)).astype(np.float32), rows, z

    def log_probability(self, f: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Natural logarithms of the tokens' leaves."""
        total, out = np.zeros(len(self.code)), np.zeros(len(self.code))
        for order, bit, _, z in self.levels(f, weight):
            z *= bit * np.float32(2) - np.float32(1)
            total[: len(z)] += log_sigmoid(z)
        if total.any():
            out[order] = total
        return out

    def learn(self, f: np.ndarray, weight: np.ndarray, heat: np.ndarray, slope: np.ndarray, rate: float) -> None:
        """One Adagrad step on all decisions of the tokens, in place; slope is room for the gradient, zero before and after."""
        for _, bit, rows, z in self.levels(f, weight):
            error = np.float32(1) / (np.float32(1) + np.exp(-z)) - bit
            for row in rows:
                np.add.at(slope, row, error)
        for low in range(0, len(weight), BLOCK):
            g, h, w = (x[low : low + BLOCK] for x in (slope, heat, weight))
            h += g * g
            w -= np.float32(rate) * g / np.sqrt(h + np.float32(1))
            g[:] = 0


class Tree:
    """Canonical Huffman tree: at each depth leaves come before inner nodes, so nodes need no table of paths."""

    def __init__(self, weight: np.ndarray):
        self.code, self.size = canonical(weight)
        deepest = int(self.size.max())
        count = np.bincount(self.size, minlength=deepest + 1)
        self.lead, start = [], 0
        for c in count.tolist():
            self.lead.append(start + c)
            start = self.lead[-1] << 1
        self.first = np.concatenate([[0], np.cumsum([(1 << d) - x for d, x in enumerate(self.lead)])])
        mass = np.zeros((2, int(self.first[-1])))
        for d in range(deepest):
            below = np.flatnonzero(self.size > d)
            left = self.size[below] - d
            node = self.first[d] + (self.code[below] >> left) - self.lead[d]
            bit = (self.code[below] >> (left - 1)) & 1
            for b in (0, 1):
                mass[b] += np.bincount(node[bit == b], weight[below[bit == b]], minlength=mass.shape[1])
        self.bias = (np.log(mass[1]) - np.log(mass[0])).astype(np.float32)

    def paths(self, leaf: np.ndarray) -> Paths:
        node = lambda depth, prefix: prefix + prefix.dtype.type(int(self.first[depth]) - self.lead[depth])
        key = lambda _, depth, prefix: node(depth, prefix).astype(np.uint32) * NODE_FACTOR
        return Paths(self.code[leaf], self.size[leaf], key, lambda _, depth, prefix: self.bias.take(node(depth, prefix)))


@dataclass
class Model:
    """The tree's leaves are the head words, then the classes that hold other words, then the unseen word."""

    head: np.ndarray  # hashes of the head words, ascending
    times: np.ndarray  # their counts
    class_bits: int
    class_leaf: np.ndarray  # class -> leaf, -1 for classes without words
    tree: Tree
    weight: np.ndarray

    def leaves(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's leaf and whether it is a head word's."""
        if len(self.head):
            at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
            own = self.head[at] == h
        else:
            at, own = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        return np.where(own, at, self.class_leaf[class_of(h, self.class_bits)]), own

    @property
    def unseen(self) -> int:
        return len(self.tree.code) - 1


def class_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def features(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (contexts(h, at) >> np.uint64(32)).astype(np.uint32)


def lower_codes(h: np.ndarray, c: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Balanced trees over the words of each class, whole classes given: order of words, code, size, biases with offsets.

    Places without a word have no mass: the decision for them has probability 0.
    """
    cls = class_of(h, bits)
    order = np.lexsort((h, cls))
    h, cls, w = h[order], cls[order], c[order] + ADD
    first = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
    low = np.repeat(first, np.diff(np.append(first, len(h))))
    high = np.repeat(np.append(first[1:], len(h)), np.diff(np.append(first, len(h))))
    code = np.arange(len(h)) - low
    size = np.ceil(np.log2(high - low)).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    total = np.concatenate([[0.0], np.cumsum(w)])
    bias = np.empty(at[-1], np.float32)
    for d in range(int(size.max())):
        on = np.flatnonzero(size > d)
        width = 1 << (size[on] - d)
        a = low[on] + code[on] // width * width
        mid, b = np.minimum(a + width // 2, high[on]), np.minimum(a + width, high[on])
        with np.errstate(divide="ignore"):
            bias[at[on] + d] = np.log(np.where(b > mid, total[b] - total[mid], 0.0)) - np.log(total[mid] - total[a])
    return order, code, size, bias, at


def lower_paths(table: pa.RecordBatch) -> tuple[Paths, np.ndarray]:
    """Paths within classes, and features, of joined rare words."""
    code, size, base = (table.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("code", "size", "class"))
    flat = np.frombuffer(b"".join(table.column("bias").to_pylist()), np.float32)
    start = np.cumsum(size) - size

    def key(who: np.ndarray, depth: int, prefix: np.ndarray) -> np.ndarray:
        return (mix(base[who].astype(np.uint64) * np.uint64(1 << 32) + (prefix + (1 << depth)).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)

    f = np.stack([table.column(f"f{k}").to_numpy(zero_copy_only=False).astype(np.int32).view(np.uint32) for k in range(FEATURES)], axis=1)
    return Paths(code, size, key, lambda who, depth, _: flat[start[who] + depth]), f


def pieces(parts: Iterator[tuple[np.ndarray, ...]], size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The rows of all parts in order, ``size`` at a time, whatever the parts' own sizes; the last piece is shorter."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= size:
            whole = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            for low in range(0, n - size + 1, size):
                yield tuple(x[low : low + size] for x in whole)
            held, n = [tuple(x[n - n % size :] for x in whole)], n % size
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def averaged(data: DataFrame, weight: np.ndarray, shards: int, deal: Column, steps: Callable[[np.ndarray, Iterator[pa.RecordBatch]], int]) -> np.ndarray:
    """Weights learnt from the shards, each from the same start; their average by tokens.

    deal is a number of each row, the same for rows that are equal: it gives shard and order.
    """
    shared = data.sparkSession.sparkContext.broadcast(weight)
    names = data.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        left: list[pa.RecordBatch] = []  # the start of the next shard

        def of_shard(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[pa.RecordBatch]:
            while True:
                batch = left.pop() if left else next(batches, None)
                if batch is None:
                    return
                n = int(np.searchsorted(batch.column(0).to_numpy(), shard, "right"))
                if n:
                    yield batch.slice(0, n).select(names)
                if n < batch.num_rows:
                    left.append(batch.slice(n))
                    return

        while True:
            if not left and (first := next((b for b in batches if b.num_rows), None)) is not None:
                left.append(first)
            if not left:
                return
            shard, own = left[0].column(0)[0].as_py(), zeros(len(base))
            own += base
            n = steps(own, of_shard(batches, shard))
            parts = [x.tobytes() for x in np.array_split((own - base) * np.float32(n), BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([shard] * BLOCKS, pa.int64()), pa.array([n] * BLOCKS, pa.int64()), pa.array(parts, pa.binary())], ["block", "shard", "tokens", "delta"])

    schema = "block int, shard long, tokens long, delta binary"

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        total = np.zeros(len(table.column("delta")[0].as_py()) // 4, np.float32)
        for x in table.column("delta"):
            total += np.frombuffer(x.as_buffer(), np.float32)
        return pa.table({"block": table.column("block")[:1], "shard": pa.array([table.column("shard")[0].as_py() // FAN_IN], pa.int64()), "tokens": pa.array([sum(table.column("tokens").to_pylist())], pa.int64()), "delta": pa.array([total.tobytes()], pa.binary())})

    dealt = data.withColumn("__deal", deal).select(F.pmod("__deal", F.lit(shards)).alias("__shard"), "__deal", *names).repartitionById(shards, F.col("__shard").cast("int")).sortWithinPartitions("__shard", "__deal")
    deltas = dealt.drop("__deal").mapInArrow(run, schema)
    while shards > 1:
        deltas = deltas.groupBy("block", F.expr(f"shard div {FAN_IN}")).applyInArrow(add, schema)
        shards = -(-shards // FAN_IN)
    rows = sorted(deltas.collect(), key=lambda r: r["block"])
    if not rows:
        return weight
    return weight + np.concatenate([np.frombuffer(bytes(r["delta"]), np.float32) for r in rows]) / np.float32(rows[0]["tokens"])


def _counts(plain: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            u, inv = np.unique(h, return_inverse=True)
            return u, np.bincount(inv, n, minlength=len(u)).astype(np.int64)

        for batch in batches:
            for _, raw, at in chunks(batch):
                held.append(np.unique(tokens(raw, at)[0], return_counts=True))
                size += len(held[-1][0])
                if size > FLUSH:
                    held = [flush()]
                    size = len(held[0][0])
                    if size > FLUSH // 2:
                        u, n = held.pop()
                        size = 0
                        yield pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(n)], ["h", "c"])
        if held:
            u, n = flush()
            yield pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(n)], ["h", "c"])

    return plain.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _codes(rare: DataFrame, bits: int, words_: int) -> DataFrame:
    """Word -> count, class and path within its class; classes are dealt to groups of about ``GROUP_WORDS`` words."""
    groups = max(1, -(-words_ // GROUP_WORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls = class_of(b.column(0).to_numpy().view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cls)], ["h", "c", "class"])

    def build(table: pa.Table) -> pa.Table:
        h, c = table.column("h").to_numpy(), table.column("c").to_numpy()
        order, code, size, bias, at = lower_codes(h.view(np.uint64), c, bits)
        raw = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(bias.tobytes())])
        return pa.table({"h": h[order], "c": c[order], "class": table.column("class").to_numpy()[order], "code": code, "size": size.astype(np.int32), "bias": raw})

    by_class = rare.mapInArrow(run, "h long, c long, class long")
    return by_class.groupBy(F.pmod(F.xxhash64("class"), F.lit(groups)).alias("part")).applyInArrow(build, "h long, c long, class long, code long, size int, bias binary")


def _head_words(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and counts of the words over the least count that at most ``limit`` words have, and that count."""
    left, least = limit, None
    for r in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toLocalIterator():
        left -= r["n"]
        if left < 0:
            break
        least = r["c"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0), 1 << 62
    found = counts.filter(F.col("c") >= least).toArrow()
    h, c = found.column("h").to_numpy().view(np.uint64), found.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order].astype(np.float64), least


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", head: int = 1 << 20, per_class: int = 32, frequent: int = 1 << 20, rounds: int = 2, rate: float = 0.3) -> DataFrame:
    """One row per document: token counts, base score and the model's log10 probability.

    train is true for the rows of docs to learn from.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    both = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    learned = both.filter("train").select("doc_id", "text")
    counts = scratch.save(_counts(learned))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total = n + ADD * (v + 1)
    known, times, least = _head_words(counts, min(head, frequent))
    others = counts.filter(F.col("c") < least)
    n_others = v - len(known)
    bits = min((n_others // per_class).bit_length(), MOST_CLASS_BITS)
    codes = scratch.save(_codes(others, bits, n_others))
    mass = codes.groupBy("class").agg((F.sum("c") + F.lit(ADD) * F.count("*")).alias("mass"), F.sum("c").alias("c")).toArrow()
    class_leaf = np.full(1 << bits, -1, np.int64)
    class_leaf[mass.column("class").to_numpy()] = len(known) + np.arange(mass.num_rows)
    tree = Tree(np.concatenate([times + ADD, mass.column("mass").to_numpy(), [ADD]]))
    n_rare = int(sum(mass.column("c").to_pylist()))
    model = Model(known, times, bits, class_leaf, tree, np.zeros(ROWS, np.float32))
    shape = spark.sparkContext.broadcast(Model(known, times, bits, class_leaf, tree, np.zeros(0, np.float32)))  # at most ``head`` words and 2**MOST_CLASS_BITS classes

    shards = lambda size: max(1, -(-size // (TOKENS_PER_SHARD * rounds)))
    in_round = lambda deal, r: F.pmod(F.xxhash64(deal, F.lit("round")), F.lit(rounds)) == r
    by_text = F.xxhash64("doc_id", "text")

    for r in range(rounds if n else 0):

        def upper(weight: np.ndarray, batches: Iterator[pa.RecordBatch], step: float = rate / (r + 1)) -> int:
            m, heat, slope, seen = shape.value, zeros(len(weight)), zeros(len(weight)), 0

            def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for b in batches:
                    for _, raw, at in chunks(b):
                        h, ta = tokens(raw, at)
                        yield m.leaves(h)[0], features(h, ta)

            for leaf, f in pieces(each(), BATCH):
                m.tree.paths(leaf).learn(f, weight, heat, slope, step)
                seen += len(leaf)
            return seen

        model.weight = averaged(learned.filter(in_round(by_text, r)), model.weight, shards(n), by_text, upper)
    shared = spark.sparkContext.broadcast(model.weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, weight = shape.value, shared.value
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, raw, at in chunks(batch):
                h, ta = tokens(raw, at)
                size = np.diff(ta)
                owner = np.repeat(np.arange(len(size)), size)
                f, (leaf, common) = features(h, ta), m.leaves(h)
                log = np.zeros(len(h))
                has = np.flatnonzero(leaf >= 0)
                for low in range(0, len(has), BATCH):
                    own = has[low : low + BATCH]
                    log[own] = m.tree.paths(leaf[own]).log_probability(f[own], weight)
                base = np.where(common, np.log10(m.times[np.where(common, leaf, 0)] + ADD), 0.0) if len(m.times) else np.zeros(len(h))
                rare = np.flatnonzero(~common)
                unseen = m.tree.paths(np.full(len(rare), m.unseen)).log_probability(f[rare], weight)
                sums = [np.bincount(owner, x, minlength=len(size)) for x in (base, np.where(common, log, 0.0))]
                n_common = np.bincount(owner, common, minlength=len(size)).astype(np.int64)
                edges = np.concatenate([[0], np.cumsum(np.bincount(owner[rare], minlength=len(size)))])
                record = pa.StructArray.from_arrays([pa.array(signed(h[rare])), pa.array(log[rare].astype(np.float32)), pa.array(unseen.astype(np.float32))] + [pa.array(np.ascontiguousarray(f[rare, k]).view(np.int32)) for k in range(FEATURES)], ["h", "up", "unseen", "f0", "f1", "f2"])
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), record)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(serial, serial + len(size))), part.column(0), part.column(2), pa.array(size.astype(np.int64)), pa.array(n_common), pa.array(sums[0]), pa.array(sums[1]), lists], ["row", "doc_id", "train", "n_tokens", "n_common", "base", "model", "rare"])
                serial += len(size)

    record = "struct<h: long, up: float, unseen: float, f0: int, f1: int, f2: int>"
    scored = scratch.save(both.mapInArrow(run, f"row long, doc_id long, train boolean, n_tokens long, n_common long, base double, model double, rare array<{record}>"))
    scratch.release()
    joined = scratch.save(scored.select("row", "train", F.explode("rare").alias("x")).select("row", "train", "x.*").join(codes, "h", "left").drop("h"))
    lower_weight = np.zeros(ROWS, np.float32)
    inner = joined.filter("train and size > 0").select("code", "size", "class", "bias", "f0", "f1", "f2")
    by_token = F.xxhash64("class", "code", "f0", "f1", "f2")
    for r in range(rounds if n_rare else 0):

        def lower(weight: np.ndarray, batches: Iterator[pa.RecordBatch], step: float = rate / (r + 1)) -> int:
            heat, slope, seen = zeros(len(weight)), zeros(len(weight)), 0
            held: list[pa.RecordBatch] = []

            def learn() -> None:
                paths, f = lower_paths(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                paths.learn(f, weight, heat, slope, step)
                held.clear()

            room = BATCH
            for b in batches:
                while b.num_rows:
                    held.append(b.slice(0, room))
                    seen += held[-1].num_rows
                    room -= held[-1].num_rows
                    b = b.slice(held[-1].num_rows)
                    if not room:
                        learn()
                        room = BATCH
            if held:
                learn()
            return seen

        lower_weight = averaged(inner.filter(in_round(by_token, r)), lower_weight, shards(n_rare), by_token, lower)
    lower_shared = spark.sparkContext.broadcast(lower_weight)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                paths, f = lower_paths(b)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(b.column(2).to_numpy() + paths.log_probability(f, lower_shared.value))], ["row", "c", "log"])

    seen = joined.filter("c is not null").select("row", "c", "up", "code", "size", "class", "bias", "f0", "f1", "f2").mapInArrow(within, "row long, c long, log double")
    rare = seen.unionByName(joined.filter("c is null").select("row", "c", F.col("unseen").cast("double").alias("log")))
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))).alias("rare_base"), F.sum("log").alias("rare_log"), F.count("c").alias("rare_known"))
    out = scored.drop("rare").join(rare, "row", "left")
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_common") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * math.log10(total)).alias("base_score"),
        ((F.col("model") + F.coalesce("rare_log", F.lit(0.0))) / math.log(10)).alias("score"),
    )
