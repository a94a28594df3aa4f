"""Local alignment of many sequence pairs in one job, and the residue maps it gives."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.substitution import BLOSUM62, symmetric
from ..shared import enough_parts

#: Cells of the pairs that are aligned in one go; a larger pair goes alone.
CELLS = 1 << 22
#: Rows whose pairs are aligned and joined in one task.
PAIRS_A_TASK = 20_000
FOUND = "__a string, __b string, a_index array<int>, b_index array<int>, score double, identity double"
#: Stands behind the end of a sequence; faces no letter.
PAD, NEVER = 0, -1e9


def score_table(scores: Mapping[tuple[str, str], float] | None = None) -> np.ndarray:
    """Scores of letter pairs by code point (beyond 127 as X); BLOSUM62 unless given.

    Letters that the scores do not hold score as X does, and -1 if X is not among them. See
    sources.alignments.read_score_matrix for other published matrices.
    """
    scores = symmetric(BLOSUM62) if scores is None else scores
    out = np.full((128, 128), -1.0)
    for known in {x for x, _ in scores}:
        out[ord(known), :] = out[:, ord(known)] = scores.get((known, "X"), -1.0)
    for (x, y), s in scores.items():
        out[ord(x), ord(y)] = out[ord(y), ord(x)] = s
    out[PAD, :] = out[:, PAD] = NEVER
    return out


def codes(sequence: str) -> np.ndarray:
    return np.array([ord(c) if 0 < ord(c) < 128 else ord("X") for c in sequence], dtype=np.int64)


def padded(sequences: list[str]) -> np.ndarray:
    """Sequences x places, codes of letters and behind them ``PAD``."""
    out = np.full((len(sequences), max(map(len, sequences))), PAD, np.int64)
    for row, text in zip(out, sequences, strict=True):
        row[: len(text)] = codes(text)
    return out


STOP, DIAGONAL, UP, LEFT, UP_OPENS, LEFT_OPENS = 0, 1, 2, 3, 4, 8


def align_many(a: list[str], b: list[str], table: np.ndarray, opening: float, extension: float) -> list[tuple[float, list[int], list[int]]]:
    """Of each pair the best local alignment with affine gaps: its score and the places of letters that face each other.

    A gap of n letters costs opening + (n - 1) * extension, opening being the dearer. Of equal
    alignments the one that ends first in a, then in b, is given, steps along both before gaps.
    All pairs advance together, a row of cells of every pair in one step, gaps along a row by a running
    maximum; one byte is kept per cell. The ways back are followed together too.
    """
    x, y = padded(a), padded(b)
    count, n, m = len(a), x.shape[1], y.shape[1]
    if not n or not m:
        return [(0.0, [], [])] * count
    trail = np.zeros((n, count, m), dtype=np.uint8)
    before, up = np.zeros((count, m + 1)), np.full((count, m), -np.inf)
    place = np.arange(m)
    best, end = np.zeros(count), np.full((count, 2), -1)
    for i in range(n):
        opens, extends = before[:, 1:] - opening, up - extension
        up = np.maximum(opens, extends)
        diagonal = before[:, :-1] + table[x[:, i, None], y]
        base = np.maximum(np.maximum(diagonal, up), 0.0)
        tilted = base + extension * place
        top = np.maximum.accumulate(tilted, axis=1)
        since = np.maximum.accumulate(np.where(tilted >= top, place, 0), axis=1)
        left = np.full((count, m), -np.inf)
        left[:, 1:] = top[:, :-1] - opening - extension * place[:-1]
        row = np.maximum(base, left)
        source = np.where(row <= 0, STOP, np.where(row == diagonal, DIAGONAL, np.where(row == up, UP, LEFT)))
        left_opens = np.zeros((count, m), dtype=bool)
        left_opens[:, 1:] = since[:, :-1] == place[:-1]
        trail[i] = source | np.where(opens >= extends, UP_OPENS, 0) | np.where(left_opens, LEFT_OPENS, 0)
        before[:, 1:] = row
        j = row.argmax(axis=1)
        now = row[np.arange(count), j]
        better = now > best
        best[better] = now[better]
        end[better] = np.stack([np.full(count, i), j], axis=1)[better]
    found = _ways_back(trail, end)
    return [(float(s), *w) for s, w in zip(best, found, strict=True)]


def _ways_back(trail: np.ndarray, end: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """The places that face each other on the way from each pair's last cell to its first."""
    at_a: list[list[int]] = [[] for _ in end]
    at_b: list[list[int]] = [[] for _ in end]
    live = np.flatnonzero(end[:, 0] >= 0)
    i, j, inside = end[live, 0], end[live, 1], np.zeros(len(live), np.int64)  # the gap that a cell lies in
    while len(live):
        t = trail[i, live, j].astype(np.int64)
        step = np.where(inside > 0, inside, t & 3)
        along = step == DIAGONAL
        for k, p, q in zip(live[along].tolist(), i[along].tolist(), j[along].tolist(), strict=True):
            at_a[k].append(p)
            at_b[k].append(q)
        inside = np.where((step == UP) & (t & UP_OPENS == 0), UP, np.where((step == LEFT) & (t & LEFT_OPENS == 0), LEFT, 0))
        i, j = i - ((step == DIAGONAL) | (step == UP)), j - ((step == DIAGONAL) | (step == LEFT))
        on = (step != STOP) & (i >= 0) & (j >= 0)
        live, i, j, inside = live[on], i[on], j[on], inside[on]
    return [(p[::-1], q[::-1]) for p, q in zip(at_a, at_b, strict=True)]


def align(a: str, b: str, table: np.ndarray, opening: float, extension: float) -> tuple[float, list[int], list[int]]:
    """``align_many`` of one pair."""
    return align_many([a], [b], table, opening, extension)[0] if a and b else (0.0, [], [])


def in_batches(pairs: list[tuple[str, str]], cells: int = CELLS) -> Iterator[list[tuple[str, str]]]:
    """The pairs by size, as many at a time as have about so many cells when all are as large as the largest."""
    held: list[tuple[str, str]] = []
    n = m = 0
    for x, y in sorted(pairs, key=lambda p: (len(p[0]), len(p[1]))):
        n, m = max(n, len(x)), max(m, len(y))
        if held and (len(held) + 1) * n * m > cells:
            yield held
            held, n, m = [], len(x), len(y)
        held.append((x, y))
    if held:
        yield held


def identity(a: str, b: str, at_a: list[int], at_b: list[int]) -> float | None:
    """Equal letters over the columns of the whole alignment, unaligned ends and gaps included; NULL without a column."""
    if not at_a:
        return 0.0 if a or b else None
    inner = sum(1 + (i - p - 1) + (j - q - 1) for (p, q), (i, j) in zip(zip(at_a, at_b), zip(at_a[1:], at_b[1:]), strict=False)) + 1
    columns = max(at_a[0], at_b[0]) + inner + max(len(a) - at_a[-1], len(b) - at_b[-1]) - 1
    return sum(a[i] == b[j] for i, j in zip(at_a, at_b, strict=True)) / columns


def sequence_map(pairs: DataFrame, a: str, b: str, scores: Mapping[tuple[str, str], float] | None = None, opening: float = 11.0, extension: float = 0.5, mismatch: float = 0.1, unknown: float = 0.5) -> DataFrame:
    """The pairs with a_index, b_index (places that face each other, from 0), score, identity and reason.

    Each distinct pair of sequences is aligned once, whatever the rows that hold it; equal sequences
    map letter to letter without alignment (score NULL). Gap letters (-) are read as X. reason is
    NULL for a usable map, else what speaks against it: ``no sequence`` (NULL or empty), ``too many
    X`` (more than the share ``unknown`` of a) or ``length`` (aligned letters differ from b's
    length by the share ``mismatch`` or more). Other columns and repeated rows stay.
    """
    table = score_table(scores)
    left, right = F.translate(a, "-", "X"), F.translate(b, "-", "X")
    parts = enough_parts(pairs, PAIRS_A_TASK)
    # rows travel by a hash of their pair; the texts are compared where they meet
    told = pairs.withColumns({"__a": F.coalesce(left, F.lit("")), "__b": F.coalesce(right, F.lit(""))}).withColumn("__pair", F.xxhash64("__a", "__b")).repartition(parts, "__pair")
    todo = told.filter("__a != __b and __a != '' and __b != ''").select("__pair", "__a", "__b").distinct().select("__a", "__b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in in_batches(list(batch[["__a", "__b"]].itertuples(index=False, name=None))):
                found = align_many([x for x, _ in part], [y for _, y in part], table, opening, extension)
                yield pd.DataFrame([(x, y, p, q, s, identity(x, y, p, q)) for (x, y), (s, p, q) in zip(part, found, strict=True)], columns=["__a", "__b", "a_index", "b_index", "score", "identity"])

    every = F.when(F.col("__a") != "", F.sequence(F.lit(0), F.length("__a") - 1)).otherwise(F.array().cast("array<int>"))
    same = F.col("__a") == F.col("__b")
    made = todo.mapInPandas(run, FOUND).withColumn("__made", F.xxhash64("__a", "__b")).withColumnsRenamed({"__a": "__x", "__b": "__y"}).repartition(parts, "__made")
    out = told.join(made, F.expr("__pair = __made and __a = __x and __b = __y"), "left").drop("__pair", "__made", "__x", "__y")
    out = out.withColumns({
        "a_index": F.when(same, every).otherwise(F.coalesce("a_index", F.array().cast("array<int>"))),
        "b_index": F.when(same, every).otherwise(F.coalesce("b_index", F.array().cast("array<int>"))),
        "identity": F.when(same & (F.col("__a") != ""), 1.0).otherwise(F.col("identity")),
    })
    n_unknown = F.length("__a") - F.length(F.translate("__a", "X", ""))
    far = F.abs(F.size("a_index") - F.length("__b")) >= mismatch * F.length("__b")
    reason = F.when((F.col("__a") == "") | (F.col("__b") == ""), "no sequence").when(n_unknown > unknown * F.length("__a"), "too many X").when(far, "length")
    return out.withColumn("reason", reason).drop("__a", "__b")


def residue_map(maps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a_place, b_place): one row per two letters that face each other, of usable maps."""
    good = maps.filter("reason is null").select(*keys, F.explode(F.arrays_zip("a_index", "b_index")).alias("m"))
    return good.select(*keys, F.col("m.a_index").alias("a_place"), F.col("m.b_index").alias("b_place"))


def homologous(maps: DataFrame, least: float = 0.95) -> DataFrame:
    """Maps of near-equal sequences: identity above ``least``."""
    return maps.filter(F.col("identity") > least)


def counterpart_cells(maps: DataFrame, part: str, a: str, b: str, points_a: DataFrame, points_b: DataFrame) -> DataFrame:
    """(part, a, b, rmsd, n_mapped): distance of every two mapped chains of a part, for joins.greedy_match.

    maps: chains a and b with their sequences' map. points_a and points_b: part, chain, place
    (from 0 along the chain), x, y, z; places without a point do not count.
    """
    from .joins import rmsd
    from .spatial import AXES, distance2

    l = points_a.select(part, F.col("chain").alias(a), F.col("place").alias("a_place"), F.struct(*AXES).alias("l"))
    r = points_b.select(part, F.col("chain").alias(b), F.col("place").alias("b_place"), F.struct(*AXES).alias("r"))
    both = residue_map(maps, [part, a, b]).join(l, [part, a, "a_place"]).join(r, [part, b, "b_place"])
    sized = both.groupBy(part, a, b).agg(F.count("*").alias("n_mapped"))
    return rmsd(both, [part, a, b], distance2()).join(sized, [part, a, b])
