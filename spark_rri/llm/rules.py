"""Quality by a sparse ensemble of rules over text statistics.

Small boosted trees on a bounded sample of labelled texts propose rules: every path from a root is a
conjunction of bounds on statistics. A lasso logistic regression over the rules keeps few of them and
weighs them, its penalty chosen on texts that trees and weights have not seen. The model is a
list of rules, compiled to one Spark column over the statistics.

Texts cross to Python once, for the statistics of whole texts; the sample's statistics, not its texts, reach
the driver (about ``per_label`` rows of each label).

Edge cases: null and empty texts have all statistics 0 and score by the rules that hold for 0; one-word and
very long texts are scored whole; repeated rows are scored each; an empty table gives no rows;
without both labels in the training rows the score is a constant, the smoothed share of label 1;
labels other than 0 and 1 and null labels teach nothing; columns that are not named play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import Rolling, chunks, counts_of, mix, owners, words
from .sampling import balanced_rows
from .storage import bounded_batches

STATISTICS = ["n_words", "word_length", "long_words", "symbols", "marks", "exclamations", "digits", "upper", "capitalised", "distinct", "commonest", "repeated_next", "repeated_triples", "line_words", "repeated_lines"]
SCHEMA = "doc_id long, " + ", ".join(f"`{s}` double" for s in STATISTICS)
LONG = 20
#: Share of a constant's loss by which a sparser model may be worse than the best.
NEAR = 0.02


def among(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


SYMBOLS, MARKS, EXCLAMATIONS, DIGITS = among("#*$%&|<>"), among(".,;:"), among("!?"), among("0123456789")
UPPER, LETTERS = among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), among("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def groups(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By owner: distinct values, the count of the commonest, and items whose value occurs more than once."""
    distinct, most, again = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(value):
        _, first, count = np.unique(mix(value ^ mix(owner.astype(np.uint64))), return_index=True, return_counts=True)
        own = owner[first]
        distinct = np.bincount(own, minlength=n)
        np.maximum.at(most, own, count)
        again = np.bincount(own, np.where(count > 1, count, 0), minlength=n)
    return distinct, most, again


def statistics_of(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts x statistics; shares are of words, letters or lines, so that they hold for texts of any length."""
    n = len(at) - 1
    starts, ends, wa = words(raw, at)
    owner, length = owners(wa), ends - starts
    per = lambda flags: counts_of(flags, at[:-1], at[1:])
    of_words = lambda flags: np.bincount(owner, flags, minlength=n)
    n_words = np.diff(wa)
    many = np.maximum(n_words, 1)
    hashes = Rolling(raw).slices(starts, ends)
    distinct, most, _ = groups(owner, hashes, n)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    inside = owner[2:] == owner[:-2]
    triples = mix(mix(hashes[:-2]) + np.uint64(3) * mix(hashes[1:-1] + np.uint64(1)) + np.uint64(7) * hashes[2:])[inside] if len(starts) > 2 else hashes[:0]
    _, _, again = groups(owner[:-2][inside], triples, n) if len(starts) > 2 else (0, 0, np.zeros(n))

    cut = np.flatnonzero(np.append(raw == 10, False))
    line_at = np.unique(np.concatenate([at, cut + 1]))
    line_start, line_end = line_at[:-1], line_at[1:]
    line_end = line_end - (raw[line_end - 1] == 10) if len(line_start) else line_end
    first, last = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    full = last > first
    text = np.searchsorted(at, line_start[full], "right") - 1
    lines = np.bincount(text, minlength=n)
    unlike, _, _ = groups(text, Rolling(raw).slices(line_start[full], line_end[full]), n)
    many_lines = np.maximum(lines, 1)
    characters = counts_of((raw & 0xC0) != 0x80, starts, ends)
    columns = [
        n_words, of_words(characters) / many, of_words(length > LONG) / many, per(SYMBOLS[raw]) / many, per(MARKS[raw]) / many, per(EXCLAMATIONS[raw]) / many, per(DIGITS[raw]) / np.maximum(of_words(length), 1),
        per(UPPER[raw]) / np.maximum(per(LETTERS[raw]), 1), of_words(UPPER[raw[starts]]) / many, distinct / many, most / many, of_words(same) / many, again / many, n_words / many_lines, (lines - unlike) / many_lines,
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c) for c in statistics_of(raw, at).T]], ["doc_id", *STATISTICS])

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, SCHEMA)


@dataclass(frozen=True, order=True)
class Rule:
    """All bounds (k, low, high) hold: low < statistic k <= high."""

    bounds: tuple[tuple[int, float, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return reduce(np.logical_and, [(x[:, k] > low) & (x[:, k] <= high) for k, low, high in self.bounds])

    def column(self) -> Column:
        parts = [c for k, low, high in self.bounds for c in ([F.col(STATISTICS[k]) > low] if low > -np.inf else []) + ([F.col(STATISTICS[k]) <= high] if high < np.inf else [])]
        return reduce(lambda a, b: a & b, parts)

    def with_bound(self, k: int, low: float, high: float) -> Rule:
        old = {b[0]: b[1:] for b in self.bounds}
        was = old.get(k, (-np.inf, np.inf))
        return Rule(tuple(sorted((j, *v) for j, v in (old | {k: (max(low, was[0]), min(high, was[1]))}).items())))


@dataclass
class RuleModel:
    bias: float
    rules: list[Rule] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def logit(self) -> Column:
        return reduce(lambda z, rw: z + F.when(rw[0].column(), F.lit(float(rw[1]))).otherwise(F.lit(0.0)), zip(self.rules, self.weights, strict=True), F.lit(float(self.bias)))

    def described(self) -> list[tuple[str, float]]:
        """Every rule as text with its weight, the heaviest first."""
        told = lambda r: " and ".join(f"{low:.4g} < {STATISTICS[k]} <= {high:.4g}" for k, low, high in r.bounds)
        return sorted(((told(r), float(w)) for r, w in zip(self.rules, self.weights, strict=True)), key=lambda p: -abs(p[1]))


def grow(bins: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """A regression tree on binned statistics: the rules of all its nodes but the root, and its prediction for every row."""
    found: list[Rule] = []
    out = np.zeros(len(bins))

    def split(inside: np.ndarray, everyone: np.ndarray, rule: Rule, left: int) -> None:
        w, t = weight[inside], target[inside]
        out[everyone] = (w * t).sum() / max(w.sum(), 1e-12)
        best = (1e-9, None, None)
        for k in range(bins.shape[1]) if left and len(inside) >= 2 * least else ():
            size = len(cuts[k]) + 1
            n = np.cumsum(np.bincount(bins[inside, k], minlength=size))[:-1]
            sw = np.cumsum(np.bincount(bins[inside, k], w, size))
            st = np.cumsum(np.bincount(bins[inside, k], w * t, size))
            a, b, total, all_w = sw[:-1], sw[-1] - sw[:-1], st[-1], sw[-1]
            gain = np.where((n >= least) & (len(inside) - n >= least), st[:-1] ** 2 / np.maximum(a, 1e-12) + (total - st[:-1]) ** 2 / np.maximum(b, 1e-12) - total**2 / all_w, 0)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), k, int(gain.argmax()))
        _, k, at = best
        if k is None:
            return
        for side, low, high in ((bins[:, k] <= at, -np.inf, cuts[k][at]), (bins[:, k] > at, cuts[k][at], np.inf)):
            more = rule.with_bound(k, float(low), float(high))
            found.append(more)
            split(inside[side[inside]], everyone[side[everyone]], more, left - 1)

    split(rows, np.arange(len(bins)), Rule(()), depth)
    return found, out


def propose(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int, depth: int, rate: float, least: int, seed: int) -> list[Rule]:
    """Distinct rules of boosted trees, each grown on half of the rows."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 66)[1:-1], method="lower")) for c in x.T]
    bins = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T, strict=True)], axis=1)
    z, found = np.zeros(len(y)), {}
    for _ in range(trees):
        rows = rng.permutation(len(y))[: max(len(y) // 2, 1)]
        rules, step = grow(bins, cuts, y - 1 / (1 + np.exp(-z)), weight, rows, int(rng.integers(1, depth + 1)), least)
        z += rate * 4 * step
        found |= dict.fromkeys(rules)
    return sorted(found)


def lasso(hits: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, bias: float, start: np.ndarray, turns: int = 150) -> tuple[float, np.ndarray]:
    """Weights and bias of the least weighted log loss plus penalty x sum of |weight x deviation|, by accelerated proximal steps."""
    total = weight.sum()
    step = 4 / max((weight[:, None] * hits**2).sum() / total + 1, 1e-9)
    w, b, vw, vb, t = start.copy(), bias, start.copy(), bias, 1.0
    for _ in range(turns):
        err = weight * (1 / (1 + np.exp(-np.clip(hits @ vw + vb, -30, 30))) - y) / total
        new = vw - step * (hits.T @ err)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b, t2 = vb - step * err.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return b, w


def log_loss(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * np.logaddexp(0, np.where(y > 0, -z, z))).sum() / weight.sum())


def learn(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.2, least: int = 10, seed: int = 7) -> RuleModel:
    """Rules and weights; of falling penalties the first whose loss on the held fifth is near the least."""
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2:
        held = np.zeros(len(y), bool)
    rules = propose(x[~held], y[~held], weight[~held], trees, depth, rate, min(least, max(len(y) // 20, 1)), seed)
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6))
    bias = float(np.log(share / (1 - share)))
    if not rules:
        return RuleModel(bias)
    alike: dict[bytes, Rule] = {}
    for r in sorted(rules, key=lambda r: len(r.bounds)):  # of rules that hold for the same texts the shortest
        alike.setdefault(np.packbits(r.holds(x)).tobytes(), r)
    rules = sorted(alike.values())
    hits = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64)
    spread = np.sqrt(np.maximum(hits[~held].mean(axis=0) * (1 - hits[~held].mean(axis=0)), 1e-4))
    scaled = hits / spread
    own, ours, mine = scaled[~held], y[~held], weight[~held]
    most = np.abs(own.T @ (mine * (ours - share))).max() / mine.sum()
    path, at = [], (bias, np.zeros(len(rules)))
    for penalty in most * np.geomspace(0.5, 0.001, 12):
        at = lasso(own, ours, mine, penalty, *at)
        path.append((log_loss(scaled[held] @ at[1] + at[0], y[held], weight[held]) if held.any() else -penalty, *at))
    enough = min(p[0] for p in path) + (NEAR * log_loss(np.full(held.sum(), bias), y[held], weight[held]) if held.any() else 0)
    _, bias, w = next(p for p in path if p[0] <= enough)
    live = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(float(bias), [rules[i] for i in live], w[live] / spread[live])


def fit(labelled: DataFrame, per_label: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> RuleModel:
    """Learn from about ``per_label`` texts of each label, weighted to the labels' natural frequencies."""
    rows = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    sample, counts = balanced_rows(rows, "label", per_label)
    if len(counts) < 2:
        n, p = sum(counts.values()), counts.get(1, 0)
        return RuleModel(float(np.log((p + 0.5) / (n - p + 0.5))))
    told = [(statistics(sample.filter(F.col("label") == k)).collect(), k) for k in (0, 1)]
    drawn = sorted((tuple(-1 if v is None else v for v in r), k) for rs, k in told for r in rs)
    x, y = np.array([r[0][1:] for r in drawn], np.float64).reshape(-1, len(STATISTICS)), np.array([r[1] for r in drawn], np.float64)
    if len(set(y)) < 2:
        return RuleModel(float(np.log((counts[1] + 0.5) / (counts[0] + 0.5))))
    turn = np.random.default_rng(3).permutation(len(y))
    x, y = x[turn], y[turn]
    return learn(x, y, np.where(y > 0, counts[1] / y.sum(), counts[0] / (1 - y).sum()), **options)


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """One row per document: score and whether it reaches the cut."""
    scored = statistics(docs, id_col, text_col).select("doc_id", (1 / (1 + F.exp(-model.logit()))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
