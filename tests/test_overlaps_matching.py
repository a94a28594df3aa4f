"""Overlaps and matchings of dense parts against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from spark_rri.operators import joins


def survivors(spans):
    return {(p, o) for p, s, e, o in spans if e <= s or p is None or not any(q == p and z > o and f > t and 2 * (min(e, f) - max(s, t)) > e - s for q, t, f, z in spans)}


@pytest.mark.parametrize("seed", range(3))
def test_overlaps(spark, seed):
    rng = random.Random(seed)
    spans = []
    for k in range(260):
        part, at, n = rng.choice(["a", "a", "b", None]), rng.randint(-60, 60), rng.choice([0, 1, 2, 7, 8, 9, 63, 64, 65, 200, rng.randint(0, 90)])
        spans.append((part, at, at + n, k))
    rng.shuffle(spans)
    rows = spark.createDataFrame([(*s, "x") for s in spans], "part string, a long, b long, o int, __k string")
    got = joins.overlap_anti_join(rows, "part", "a", "b", "o")
    assert got.columns == rows.columns and {(r["part"], r["o"]) for r in got.collect()} == survivors(spans)
    assert joins.overlap_anti_join(rows.filter("a >= b"), "part", "a", "b", "o").count() == sum(s[1] >= s[2] for s in spans)


def test_rows_of_a_dense_part_grow_with_its_spans(spark, monkeypatch):
    """All spans of one part overlap: what the join makes is linear in the spans, as pairs would not be."""
    counts = []
    keep = type(spark.range(1)).join
    monkeypatch.setattr(type(spark.range(1)), "join", lambda self, other, on=None, how="inner": counts.append(keep(self, other, on, how).count()) or keep(self, other, on, how))
    for n in (250, 1000):
        spans = spark.range(n).select(F.lit("p").alias("part"), (F.col("id") % 7).alias("a"), (F.col("id") % 7 + 1000).alias("b"), (F.lit(n) - F.col("id")).alias("o"))
        assert [r["o"] for r in joins.overlap_anti_join(spans, "part", "a", "b", "o").collect()] == [n]
    assert counts[2] < 5 * counts[0] < 5 * 250 * 60


@pytest.mark.parametrize("crowd", [0, 2, 10**9])
def test_overlaps_by_cells_and_by_intervals(spark, monkeypatch, crowd):
    """All cells crowded, some, and none."""
    monkeypatch.setattr(joins, "CROWD", crowd)
    rng = random.Random(crowd)
    spans = [(rng.choice(["a", "b", None]), at := rng.choice([rng.randint(-90, 90), -(1 << 20)]), at + rng.choice([0, 1, 2, 3, 4, 8, 9, 64, rng.randint(0, 90), 1 << 21]), k) for k in range(200)]
    rows = spark.createDataFrame(spans, "part string, a long, b long, o int")
    assert {(r["part"], r["o"]) for r in joins.overlap_anti_join(rows, "part", "a", "b", "o").collect()} == survivors(spans)


def test_few_rows_where_spans_lie_apart(spark, monkeypatch):
    """Spans of one length that hardly meet make a few rows each, not rows for every power and digit of the lengths."""
    counts = []
    keep = type(spark.range(1)).join
    monkeypatch.setattr(type(spark.range(1)), "join", lambda self, other, on=None, how="inner": counts.append(self.count() + other.count()) or keep(self, other, on, how))
    spans = spark.range(2000).select((F.col("id") % 40).alias("part"), (F.col("id") * 500).alias("a"), (F.col("id") * 500 + 6000).alias("b"), F.col("id").alias("o"))
    assert joins.overlap_anti_join(spans, "part", "a", "b", "o").count() == 2000
    assert counts and sum(counts) < 2000 * 10


def greedy(cells):
    used_a, used_b, out = set(), set(), set()
    for p, a, b, c in sorted((x for x in cells if None not in x), key=lambda x: (x[3], x[1], x[2])):
        if (p, a) not in used_a and (p, b) not in used_b:
            used_a.add((p, a))
            used_b.add((p, b))
            out.add((p, a, b, c))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_dominant_match_is_greedy(spark, seed):
    rng = random.Random(seed)
    cells = {(rng.choice("xxy"), rng.randint(0, 14), rng.randint(0, 14)): rng.choice([1.0, 2.0, 3.0, rng.random()]) for _ in range(300)}
    cells = [(*k, v) for k, v in cells.items()] + [("x", None, 1, 0.1), (None, 1, 1, 0.1), ("y", 99, 99, None)]
    rows = spark.createDataFrame([(*c, 0) for c in cells], "part string, a int, b int, cost double, m int")
    assert set(map(tuple, joins.dominant_match(rows, "part", "a", "b", "cost").collect())) == greedy(cells)
    assert joins.dominant_match(rows.limit(0), "part", "a", "b", "cost").count() == 0


def test_cells_along_a_path(spark):
    """Costs that rise along a path let one cell go a round: slow, and still right."""
    cells = [("p", k // 2 + k % 2, k // 2, float(k)) for k in range(7)]
    rows = spark.createDataFrame(cells, "part string, a int, b int, cost double")
    assert set(map(tuple, joins.dominant_match(rows, "part", "a", "b", "cost").collect())) == greedy(cells)


def test_cells_of_a_part_spread(spark):
    """greedy_match numbers cells by ranges: no window over a part."""
    cells = spark.range(3000).select(F.lit(0).alias("part"), (F.col("id") % 40).alias("a"), F.expr("id div 40").alias("b"), (F.col("id") * 7919 % 3001).cast("double").alias("cost"))
    got = joins.greedy_match(cells, "part", "a", "b", "cost", 1e9)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "part" not in "".join(line for line in plan.split("\n") if "Window " in line)
    best = sorted((r["cost"], r["a"], r["b"]) for r in cells.collect())[:75]
    want = {}
    for c, a, b in best:
        want.setdefault(a, (b, c))
    assert {r["a"]: (r["b"], r["cost"]) for r in got.collect()} == want
