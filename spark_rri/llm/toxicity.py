"""Toxicity: a convolutional text classifier in numpy with language-calibrated thresholds.

A word's embedding is the sum of two rows of a hashed table, one for the word and one for its
first ``STEM`` bytes, so inflected forms of one stem share what is learned; filters of several widths slide over the words, each
filter keeps its maximum over the whole text, and a logistic layer weighs the maxima. Buckets
that too few training texts use have a zero embedding, so unseen words do nothing. Scoring
precomputes each bucket's product with every filter position: a convolution is then a sum of
shifted table rows.

The classifier is fitted on all labelled texts. They are dealt by hash to shards of about ``WORDS_PER_SHARD`` words: one shard
is learned first, then the others start from its weights and are averaged, each bucket over the shards that use it.
A fifth of the texts, which the weights are not learned from, calibrates thresholds by language. Languages are found, not given: training texts fall into groups
by how often they use the most common words of all, which are mostly function words; a text belongs
to the group it is most like. A group with too few texts of either label uses the threshold of all. Logits are shifted so that every threshold lies at score 0.7.
Counts, groups and thresholds come from Spark jobs over all texts; the driver sees sums by bucket, by group and by logit (steps of 1 / ``FINE``) only.

Edge cases: null and empty texts have zero features and score what the bias gives; repeated
rows are scored each; an empty table gives no rows; without both labels in the training rows
the score is 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, Rolling, chunks, mix, owners, signed, words
from .maxent import averaged
from .storage import Scratch, bounded_batches

WIDTHS = (1, 2, 3)
CUT = 0.7
STEM = 6
#: Words that tell groups of texts apart, texts of a group at least (share), and likeness under which a text is unlike a group.
COMMON, LEAST_SHARE, UNLIKE = 400, 0.05, 0.3
#: Steps of likeness to a direction (0 to 1), and steps of a logit's unit, in which texts are counted.
NEARNESS, FINE = 256, 1024
WORDS_PER_SHARD = 1 << 20


@dataclass
class Words:
    """Distinct words (hash, hash of the stem), each word's index, and offsets by text."""

    hash: np.ndarray
    stem: np.ndarray
    index: np.ndarray
    at: np.ndarray

    def part(self, keep: np.ndarray) -> Words:
        size = np.diff(self.at)
        return Words(self.hash, self.stem, self.index[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])]))


def joined(parts: list[Words]) -> Words:
    """The texts of all parts, in order."""
    own = [np.zeros(0, np.uint64), *[p.hash[p.index] for p in parts]], [np.zeros(0, np.uint64), *[p.stem[p.index] for p in parts]]
    distinct, first, index = np.unique(np.concatenate(own[0]), return_index=True, return_inverse=True)
    return Words(distinct, np.concatenate(own[1])[first], index, np.concatenate([[0], np.cumsum(np.concatenate([[], *[np.diff(p.at) for p in parts]]))]).astype(np.int64))


def normal_words(raw: np.ndarray, at: np.ndarray) -> Words:
    """Lower-case words without ASCII punctuation."""
    flat = LOWER[raw]
    punct = np.zeros(256, bool)
    punct[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
    flat = np.where(punct[flat], 32, flat).astype(np.uint8)
    starts, ends, wa = words(flat, at)
    roll = Rolling(flat)
    distinct, first, index = np.unique(roll.slices(starts, ends), return_index=True, return_inverse=True)
    stem = roll.slices(starts[first], np.minimum(ends, starts + STEM)[first])
    return Words(distinct, mix(stem + np.uint64(1)), index, wa)


@dataclass
class Groups:
    """Groups of texts by how often they use common words, which languages do each in their own way."""

    words: np.ndarray  # hashes, ascending
    centres: np.ndarray  # groups x words, of length 1

    def profiles(self, w: Words) -> np.ndarray:
        """Texts x common words: square roots of counts, scaled to length 1; all 0 for a text without one."""
        n = len(w.at) - 1
        at = np.minimum(np.searchsorted(self.words, w.hash), max(len(self.words) - 1, 0))
        known = self.words[at] == w.hash if len(self.words) else np.zeros(len(w.hash), bool)
        use = known[w.index]
        out = np.sqrt(np.bincount(owners(w.at)[use] * len(self.words) + at[w.index[use]], minlength=n * len(self.words)).reshape(n, -1))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def of(self, w: Words) -> np.ndarray:
        """Each text's group; the last index for a text that is like none."""
        near = self.profiles(w) @ self.centres.T
        near = np.concatenate([near, np.full((len(near), 1), 1e-9)], axis=1)
        return near.argmax(axis=1)


def scaled(c: np.ndarray) -> np.ndarray:
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def spread(x: np.ndarray, centres: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Of profiles unlike all centres, by likeness to the seed (``NEARNESS`` steps): number and sum; one row a step."""
    left = x.any(axis=1)
    if len(centres):
        left &= (x @ centres.T).max(axis=1) < UNLIKE
    x = x[left]
    step = np.minimum((x @ scaled(seed[None])[0] * NEARNESS).astype(np.int64), NEARNESS - 1)
    out = np.zeros((NEARNESS, x.shape[1] + 1))
    for k in np.unique(step):
        out[k, 0], out[k, 1:] = (step == k).sum(), x[step == k].sum(axis=0)
    return out


def sums(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Sums of the profiles by the centre they are most like."""
    own = (x @ centres.T).argmax(axis=1)
    return np.stack([x[own == k].sum(axis=0) for k in range(len(centres))])


def find_groups(common: np.ndarray, n: int, over_all: Callable, turns: int = 8) -> Groups:
    """Groups of n texts: a new one as long as enough texts are unlike all, then means until they settle.

    over_all(f, *given) adds up f(profiles, *given) over all texts.
    """
    centres, before = np.zeros((0, len(common))), -1
    while len(common):
        told = over_all(spread, centres, np.zeros(len(common)))
        left = told[:, 0].sum()
        if left <= max(LEAST_SHARE * n, 1) or left == before:
            break
        before = left
        seed = told[:, 1:].sum(axis=0)
        for _ in range(4):  # from the mean of what is left to the densest part of it
            told = over_all(spread, centres, seed)
            upto = np.cumsum(told[::-1, 0])[::-1]  # texts at least so near
            seed = told[np.flatnonzero(upto >= 0.25 * left)[-1] :, 1:].sum(axis=0)
        centres = scaled(np.concatenate([centres, seed[None]]))
    for _ in range(turns if len(centres) else 0):
        told = over_all(sums, centres)
        centres = scaled(told[told.any(axis=1)])
    return Groups(common, centres)


def learn_groups(w: Words) -> Groups:
    """Groups of texts at hand."""
    pairs = np.unique(owners(w.at) * max(len(w.hash), 1) + w.index)
    texts = np.bincount(pairs % max(len(w.hash), 1), minlength=len(w.hash))
    common = np.sort(w.hash[np.argsort(-texts, kind="stable")[:COMMON]])
    x = Groups(common, np.zeros((0, len(common)))).profiles(w)
    return find_groups(common, len(x), lambda f, *given: f(x, *given))


@dataclass
class ToxicModel:
    products: np.ndarray  # position of a filter x buckets x filters
    weights: np.ndarray
    bias: float
    groups: Groups
    shift: np.ndarray  # by group, the last for texts like none
    bits: int

    def logits(self, w: Words) -> np.ndarray:
        products = self.products[:, bucket_of(w.hash, self.bits)] + self.products[:, bucket_of(w.stem, self.bits)]
        return maxima(products, w.index, w.at) @ self.weights + self.bias

    def scores(self, w: Words) -> np.ndarray:
        z = self.logits(w) - self.shift[self.groups.of(w)] + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def bucket_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def blocks() -> list[tuple[int, int]]:
    """(width, first product) of every filter width."""
    out, at = [], 0
    for w in WIDTHS:
        out.append((w, at))
        at += w
    return out


def maxima(products: np.ndarray, bucket: np.ndarray, wa: np.ndarray, want_at: bool = False):
    """Largest activation of every filter in each text, at least 0; a filter may run over the end into blanks."""
    filters = products.shape[2]
    n = len(wa) - 1
    full = np.flatnonzero(np.diff(wa))
    out = np.zeros((n, len(WIDTHS) * filters), np.float32)
    where = np.full(out.shape, -1, np.int64)
    if not len(full):
        return (out, where) if want_at else out
    for b, (w, first) in enumerate(blocks()):
        z = products[first][bucket]
        for k in range(1, w):
            part = products[first + k][bucket[k:]]
            crosses = np.zeros(len(bucket), bool)
            for j in range(1, k + 1):
                crosses[np.maximum(wa[1:] - j, 0)] = True
            part[crosses[: len(part)]] = 0
            z[: len(part)] += part
        top = np.maximum.reduceat(z, wa[full], axis=0)
        cols = slice(b * filters, (b + 1) * filters)
        out[full, cols] = np.maximum(top, 0)
        if want_at:
            for i, t in enumerate(full):
                where[t, cols] = np.where(top[i] > 0, z[wa[t] : wa[t + 1]].argmax(axis=0) + wa[t], -1)
    return (out, where) if want_at else out


@dataclass
class Shape:
    """How embeddings, filters, the logistic layer and its bias lie in one array; behind them, which buckets were used."""

    bits: int
    dims: int
    filters: int

    def views(self, flat: np.ndarray) -> list[np.ndarray]:
        shapes = [(1 << self.bits, self.dims), (sum(WIDTHS), self.dims, self.filters), (len(WIDTHS) * self.filters,), (1,), (1 << self.bits,)]
        parts = np.split(flat, np.cumsum([np.prod(x) for x in shapes]))
        return [p.reshape(x) for p, x in zip(parts, shapes, strict=False)]

    def start(self, usual: np.ndarray, seed: int = 7) -> np.ndarray:
        rng = np.random.default_rng(seed)
        emb = rng.normal(0, 0.3, (1 << self.bits, self.dims)) * usual[:, None]
        rest = [rng.normal(0, 0.3, (sum(WIDTHS), self.dims, self.filters)), rng.normal(0, 0.3, len(WIDTHS) * self.filters)]
        return np.concatenate([emb.ravel(), *[x.ravel() for x in rest], np.zeros(1 + (1 << self.bits))]).astype(np.float32)


def train(w: Words, y: np.ndarray, flat: np.ndarray, shape: Shape, usual: np.ndarray, positive: float, epochs: int = 8, rate: float = 0.03, batch: int = 32, decay: float = 1e-4, seed: int = 7) -> None:
    """Adam on embeddings, filters and the logistic layer, in place; gradients flow through the maxima's words only.

    Of the buckets, only the usual ones learn; positive is the share of label 1 in all texts.
    """
    rng = np.random.default_rng(seed)
    wa, index, filters, dims = w.at, w.index, shape.filters, shape.dims
    whole, stem = bucket_of(w.hash, shape.bits), bucket_of(w.stem, shape.bits)
    *params, used = shape.views(flat)
    emb, conv, weights, bias = params
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    share = np.where(y > 0, 0.5 / max(positive, 1e-6), 0.5 / max(1 - positive, 1e-6))
    step = 0
    n = len(y)
    for _ in range(epochs):
        turn = rng.permutation(n)
        for low in range(0, n, batch):
            docs = turn[low : low + batch]
            size = np.diff(wa)[docs]
            own = np.concatenate([[0], np.cumsum(size)])
            idx = np.repeat(wa[docs] - own[:-1], size) + np.arange(own[-1])
            uniq, inv = np.unique(index[idx], return_inverse=True)
            own_emb = emb[whole[uniq]] + emb[stem[uniq]]
            prod = np.einsum("ud,pdf->puf", own_emb, conv)
            feats, where = maxima(prod, inv, own, want_at=True)
            p = 1 / (1 + np.exp(-(feats @ weights + bias[0])))
            err = ((p - y[docs]) * share[docs] / len(docs)).astype(np.float32)
            grads = [np.zeros_like(own_emb), np.zeros_like(conv), feats.T @ err + decay * weights, np.array([err.sum()], np.float32)]
            back = err[:, None] * weights[None, :]
            for b, (w, first) in enumerate(blocks()):
                for f in range(filters):
                    col = b * filters + f
                    live = np.flatnonzero(where[:, col] >= 0)
                    pos = where[live, col]
                    for k in range(w):
                        ok = pos + k < own[live + 1]
                        word = inv[pos[ok] + k]
                        g = back[live[ok], col]
                        np.add.at(grads[0], word, g[:, None] * conv[first + k, :, f])
                        grads[1][first + k, :, f] += g @ own_emb[word]
            touched = np.flatnonzero(np.abs(grads[0]).sum(axis=1))
            buckets, place = np.unique(np.concatenate([whole[uniq[touched]], stem[uniq[touched]]]), return_inverse=True)
            folded = np.zeros((len(buckets), dims), np.float32)
            np.add.at(folded, place, np.concatenate([grads[0][touched]] * 2))
            grads[0] = folded * usual[buckets][:, None]
            used[buckets] = 1
            step += 1
            for i, g in enumerate(grads):
                rows = buckets if i == 0 else slice(None)
                m1[i][rows] = 0.9 * m1[i][rows] + 0.1 * g
                m2[i][rows] = 0.999 * m2[i][rows] + 0.001 * g * g
                params[i][rows] -= rate * (m1[i][rows] / (1 - 0.9**step)) / (np.sqrt(m2[i][rows] / (1 - 0.999**step)) + 1e-6)


def threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit with the best F1 at the labels' natural frequencies; the middle of the gap to the next lower one."""
    order = np.argsort(-z, kind="stable")
    z, y, weight = z[order], y[order], weight[order]
    hit = np.cumsum(y * weight)
    f1 = 2 * hit / (np.cumsum(weight) + (y * weight).sum())
    best = int(f1.argmax())
    return float((z[best] + z[min(best + 1, len(z) - 1)]) / 2)


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        for part, raw, at in chunks(batch):
            yield part, normal_words(raw, at)


def added(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once with the sum of its values."""
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(values)).astype(np.int64)


def _counted(rows: DataFrame, bits: int) -> DataFrame:
    """kind, key, n: texts of each word's hash (0), texts to learn from of each bucket (1, once for words and once for stems), words of all (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, total = np.zeros(1 << bits, np.int64), 0
        keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def told(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n)], ["kind", "key", "n"])

        for part, w in texts_of(batches):
            text, size = owners(w.at), max(len(w.hash), 1)
            pairs = np.unique(text * size + w.index)
            keys.append(signed(w.hash))
            times.append(np.bincount(pairs % size, minlength=len(w.hash)))
            learned = ~part.column("held").to_numpy(zero_copy_only=False)
            pairs = pairs[learned[pairs // size]]
            for h in (w.hash, w.stem):
                buckets += np.bincount(np.unique(((pairs // size) << bits) + bucket_of(h, bits)[pairs % size]) & ((1 << bits) - 1), minlength=1 << bits)
            total += len(w.index)
            if sum(map(len, keys)) > 1 << 18:
                key, n = added(keys, times)
                if len(key) > 1 << 17:
                    yield told(0, key, n)
                    key, n = key[:0], n[:0]
                keys, times = [key], [n]
        yield told(0, *added(keys, times))
        yield told(1, np.flatnonzero(buckets), buckets[buckets > 0])
        yield told(2, np.zeros(1, np.int64), np.array([total]))

    return rows.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _learned_groups(rows: DataFrame, common: np.ndarray, n: int, scratch: Scratch) -> Groups:
    """Groups of all rows' texts; their profiles are written once, those of a chunk in a row."""

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Groups(common, np.zeros((0, len(common))))
        for _, w in texts_of(batches):
            x = groups.profiles(w)
            text, word = np.nonzero(x)
            made = (np.bincount(text, minlength=len(x)).astype(np.int32), word.astype(np.int16), x[text, word])
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in made], ["size", "word", "value"])

    saved = scratch.save(rows.mapInArrow(profiles, "size binary, word binary, value binary"))

    def over_all(f: Callable, *given: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in batches:
                for row in batch.to_pylist():
                    size, word, value = (np.frombuffer(row[c], t) for c, t in (("size", np.int32), ("word", np.int16), ("value", np.float64)))
                    x = np.zeros((len(size), len(common)))
                    x[np.repeat(np.arange(len(size)), size), word] = value
                    total = total + f(x, *given)
            if np.ndim(total):
                k = np.flatnonzero(total.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k].tolist(), pa.list_(pa.float64()))], ["k", "total"])

        wide = NEARNESS if f is spread else len(given[0])
        out = np.zeros((wide, len(common) + (f is spread)))
        parts = saved.mapInArrow(run, "k long, total array<double>").select("k", F.posexplode("total").alias("at", "v")).filter("v != 0").groupBy("k", "at").agg(F.sum("v").alias("v")).toArrow()
        out[parts.column("k").to_numpy(), parts.column("at").to_numpy()] = parts.column("v").to_numpy()
        return out

    groups = find_groups(common, n, over_all)
    scratch.drop(saved)
    return groups


def _weights(learned: DataFrame, shape: Shape, usual: np.ndarray, positive: float, shards: int, epochs: int = 8, more: int = 3, **options) -> np.ndarray:
    """Parameters learned from all texts: ``epochs`` times from the first shard's, then ``more`` times from each other's."""
    flat = shape.start(usual)
    buckets, dims = 1 << shape.bits, shape.dims

    def learn(turns: int) -> Callable:
        def steps(own: np.ndarray, batches: Iterator[pa.RecordBatch]) -> int:
            texts, y = [], []
            for part, w in texts_of(batches):
                texts.append(w)
                y.append(part.column("label").to_numpy())
            train(joined(texts), np.concatenate(y).astype(np.float64), own, shape, usual, positive, turns, **options)
            return sum(map(len, y))

        return steps

    deal = F.xxhash64("doc_id", "text")
    first = F.pmod(F.xxhash64(deal, F.lit("first")), F.lit(shards)) == 0
    for part, n, turns in ((learned.filter(first), 1, epochs), *([(learned.filter(~first), shards - 1, more)] if shards > 1 else [])):
        flat[-buckets:] = 0
        step = averaged(part, flat, n, deal, learn(turns)) - flat
        used = np.where(step[-buckets:] > 0, step[-buckets:], 1)  # the share of texts in shards that use a bucket
        step[: buckets * dims] /= np.repeat(used, dims)
        flat = flat + step
    return flat


def fit(labelled: DataFrame, least_positive: int = 20, least_texts: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bits: int = 17, dims: int = 12, filters: int = 8, **options) -> ToxicModel | None:
    """Learn from all texts with a label; None without both labels."""
    scratch = Scratch(labelled.sparkSession)
    rows = bounded_batches(labelled).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    rows = scratch.save(rows.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0))
    counts = {(r["label"], r["held"]): r["count"] for r in rows.groupBy("label", "held").count().collect()}
    n = sum(counts.values())
    if len({k for k, _ in counts}) < 2:
        return None
    if n < 50 or not all((k, False) in counts for k in (0, 1)):
        rows, counts = rows.withColumn("held", F.lit(False)), {(k, False): sum(v for (kk, _), v in counts.items() if kk == k) for k in (0, 1)}
    told = scratch.save(_counted(rows, bits))
    total = told.filter("kind = 2").first()["n"]
    common = told.filter("kind = 0").orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    usual = np.zeros(1 << bits, bool)
    usual[told.filter((F.col("kind") == 1) & (F.col("n") >= least_texts)).toArrow().column("key").to_numpy()] = True
    groups = _learned_groups(rows, np.sort(common.column("key").to_numpy().view(np.uint64)), n, scratch)

    shape, learned = Shape(bits, dims, filters), sum(v for (_, held), v in counts.items() if not held)
    flat = _weights(rows.filter("not held").select("doc_id", "text", "label"), shape, usual, counts[1, False] / learned, max(1, -(-total // WORDS_PER_SHARD)), **options)
    emb, conv, weights, bias, _ = shape.views(flat)
    model = ToxicModel(np.einsum("ud,pdf->puf", emb, conv).astype(np.float32), weights, float(bias[0]), groups, np.zeros(len(groups.centres) + 1), bits)
    use = rows.filter("held") if (0, True) in counts and (1, True) in counts else rows
    told = logits(use, model).groupBy("group", "step").agg(F.sum("label").alias("hit"), F.count("*").alias("n")).orderBy("step", "group").toArrow()
    group, step, hit, size = (told.column(c).to_numpy() for c in ("group", "step", "hit", "n"))

    def best(of: np.ndarray) -> float:
        at, own = np.unique(step[of], return_inverse=True)
        hits, texts = np.bincount(own, hit[of]), np.bincount(own, size[of])
        return threshold((at + 0.5) / FINE, hits / texts, texts)

    model.shift[:] = best(group >= 0)
    for k in range(len(model.shift)):
        mine = group == k
        if hit[mine].sum() >= least_positive and (size - hit)[mine].sum() >= least_positive:
            model.shift[k] = best(mine)
    scratch.release()
    return model


def logits(rows: DataFrame, model: ToxicModel) -> DataFrame:
    """Label, group and logit of every text, in steps of 1 / ``FINE``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, w in texts_of(batches):
            step = np.floor(m.logits(w).astype(np.float64) * FINE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("label").cast(pa.int64()), pa.array(m.groups.of(w).astype(np.int64)), pa.array(step)], ["label", "group", "step"])

    return rows.select("label", "text").mapInArrow(run, "label long, group long, step long")


def score(docs: DataFrame, model: ToxicModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: score and whether it reaches the threshold of its group."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size fixed by the number of buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, raw, at in chunks(batch):
                s = m.scores(normal_words(raw, at)) if m else np.zeros(len(at) - 1)
                s = s.astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
