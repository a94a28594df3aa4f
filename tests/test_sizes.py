"""What one task holds stays the same when tables grow."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spark_rri.operators import groups, spatial
from spark_rri.plans import mapping_queries, more_queries  # noqa: F401
from spark_rri.plans import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "anew"), [("orientation_mean", 0), ("symmetric_mean", 0), ("contact_equivalence", 5), ("within_partner_equivalence", 6)])
def test_partitions_grow_with_the_lines(spark, monkeypatch, name, anew):
    want = sorted(map(tuple, q.QUERIES[name](spark, SF).collect()), key=str)
    monkeypatch.setattr(q, "LINES_A_TASK", 250)
    out = q.QUERIES[name](spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    parts = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 250)
    assert parts > 20
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all(f", {parts}), REPARTITION_BY_NUM" in line for line in exchanges), plan
    assert sum("ENSURE_REQUIREMENTS" in line for line in exchanges) == 0
    assert len(exchanges) >= 1 + anew
    assert sorted(map(tuple, out.collect()), key=str) == want


def test_means_of_both_ways(spark):
    from spark_rri.operators import scoring

    rows = spark.createDataFrame([("k", 1, 2, 1.0), ("k", 2, 1, 4.0), ("k", 3, 3, 5.0), ("m", 1, 2, 7.0), (None, 1, 2, 9.0), (None, 2, 1, 9.0)], "k string, a int, b int, s double")
    got = scoring.symmetric_mean(rows, "k", "a", "b", "s")
    assert sorted((r["k"], r["a"], r["b"], r["symmetric"]) for r in got.collect()) == [("k", 1, 2, 2.5), ("k", 2, 1, 2.5), ("k", 3, 3, 5.0), ("m", 1, 2, 7.0)]
    turned = scoring.transposed(rows, ["k"], ["a"], ["b"], ["s"])
    assert turned.columns == ["orientation", "k", "a", "b", "s"]
    assert {tuple(r) for r in turned.filter("k = 'm'").collect()} == {("d", "m", 1, 2, 7.0), ("t", "m", 2, 1, 7.0)}
    assert turned.filter(F.col("k").isNull()).count() == 4


def test_blocks_of_a_large_group(spark, monkeypatch):
    """Every pair once with many pieces of either side; more tasks than groups."""
    from spark_rri.operators import joins

    monkeypatch.setattr(joins, "SIDE_OF_BLOCK", 7)
    monkeypatch.setattr(joins, "PAIRS_A_TASK", 50)
    left = spark.range(40).selectExpr("nullif(id % 3, 2) as g", "id as a")
    right = spark.range(55).selectExpr("nullif(id % 3, 2) as g", "id as b")
    out = joins.pair_lattice(left, right, "g", F.col("a") >= F.col("b"))
    want = sorted((a, b, 1 if a >= b else -1) for a in range(40) for b in range(55) if a % 3 == b % 3 != 2)
    assert sorted(map(tuple, out.select("a", "b", "categ").collect())) == want
    parts = -(-len(want) // 50)
    assert f", {parts}), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_left_rows_of_a_lattice_pass_by(spark, monkeypatch):
    """Left pieces are longer than the right ones, which are held; the right side is sent fewer times."""
    from spark_rri.operators import joins

    monkeypatch.setattr(joins, "SIDE_OF_BLOCK", 30)
    side = spark.range(100).selectExpr("1 as g", "id * 37 % 101 as a")
    out = joins.pair_lattice(side, side.withColumnRenamed("a", "b"), "g", F.col("a") >= F.col("b"))
    assert out.select("a", "b").distinct().count() == out.count() == 10_000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert " / 300.0)" in plan and " / 30.0)" in plan


def test_alignments_in_parts_by_rows(spark, monkeypatch):
    from spark_rri.operators import alignment as al

    monkeypatch.setattr(al, "PAIRS_A_TASK", 10)
    rows = spark.createDataFrame([(k, "ACDEFGHIKL"[: 4 + k % 5], "ACDEFWHIKL"[: 4 + k % 7]) for k in range(95)], "k int, a string, b string")
    out = al.sequence_map(rows, "a", "b")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ", 10), REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    table = al.score_table()
    for r in out.collect():
        want = (None, list(range(len(r["a"]))), list(range(len(r["b"])))) if r["a"] == r["b"] else al.align(r["a"], r["b"], table, 11.0, 0.5)
        assert (r["score"], r["a_index"], r["b_index"]) == want


def test_gabriel_graph_of_a_dense_cell_keeps_few_pairs(spark, monkeypatch):
    """400 points within one cut-off: what is left of their 79,800 pairs before rows travel is a few a point, and exact in the end."""
    import random

    from spark_rri.operators import spatial

    rng, kept = random.Random(3), []
    stored = spatial.stored
    monkeypatch.setattr(spatial, "stored", lambda df, *by: kept.append(out := stored(df, *by)) or out)
    at = {k: tuple(rng.random() * 0.05 for _ in range(3)) for k in range(399)}
    at[399] = at[0]
    d2 = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q, strict=True))
    want = {(i, j) for i in at for j in at if i < j and not any(d2(at[i], p) + d2(at[j], p) < d2(at[i], at[j]) - 1e-12 for p in at.values())}
    rows = spark.createDataFrame([(1, k, *p) for k, p in at.items()], "complex_id int, node int, x double, y double, z double")
    assert {(r["src"], r["dst"]) for r in spatial.gabriel_graph(rows, 0.1, ["complex_id"]).collect()} == want
    assert kept[0].count() < 400 * 30


def test_linking_edges_connect_the_same(spark):
    """Groups of linking edges are those of all pairs within the cut-off; a crowded place gives an edge a point, not one a pair."""
    rng = random.Random(11)
    rows = [(i, i % 2, *[rng.uniform(-1, 1) for _ in range(3)]) for i in range(300)]
    rows += [(300 + i, 0, *[5 + rng.uniform(0, 0.05) for _ in range(3)]) for i in range(200)]
    rows += [(500, 0, None, 0.0, 0.0), (501, 0, math.nan, 0.0, 0.0), (502, 0, math.inf, 0.0, 0.0), (503, 0, 1e18, 0.0, 0.0), (504, 0, 1e18, 0.1, 0.0), (505, 0, 1e18, 3.0, 0.0), (506, 0, 7.0, 0.0, 0.0), (507, 0, 7.25, 0.0, 0.0), (508, 0, None, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "node int, complex_id int, x double, y double, z double")
    edges = spatial.linking_edges(points, 0.25, ["complex_id"])
    label = {r[0]: r[0] for r in rows}

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] == b[1] and None not in (a[2], b[2]) and sum((x - y) ** 2 for x, y in zip(a[2:], b[2:], strict=True)) <= 0.25 * 0.25:
                low, high = sorted((root(a[0]), root(b[0])))
                label[high] = low
    got = {r["node"]: r["label"] for r in groups.connected_groups(points, edges, "node", "src", "dst").collect()}
    assert got == {n: root(n) for n in label} and len(set(got.values())) > 10
    assert edges.filter("src >= 300 and src < 500 and dst < 500").count() < 2 * 200


def test_connected_groups_send_nothing_through_the_driver(spark, monkeypatch):
    """Cells, edges and labels are merged, however small; what is sent to all tasks passes through the driver in every round."""
    from pyspark.sql.classic.dataframe import DataFrame

    plans, plain = [], DataFrame.checkpoint

    def watched(self, *a, **b):
        out = plain(self, *a, **b)
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(DataFrame, "checkpoint", watched)
    points = spark.range(60).select(F.lit(1).alias("complex_id"), F.col("id").alias("node"), *[(F.col("id") % 20 * 0.9 + F.when(F.col("id") < 20, 0).otherwise(1e6 if c == "x" else 0)).alias(c) for c in "xyz"])
    got = {r["node"]: r["label"] for r in groups.connected_groups(points, spatial.linking_edges(points, 2.0, ["complex_id"]), "node", "src", "dst").collect()}
    assert got == {n: 0 if n < 20 else 20 for n in range(60)}
    assert len(plans) > 3 and sum("Join" in p for p in plans) > 2 and not [p for p in plans if "Broadcast" in p]
