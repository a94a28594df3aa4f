"""Small cases of lookups, matches, chain limits, axes, keys, models on disk and repeated intake."""

import math

from pyspark.sql import functions as F

from spark_rri.functions import keys
from spark_rri.operators import evaluation, joins, models, neighbours, ordered, spatial
from spark_rri.sources import sinks, tables
from spark_rri.streaming import intake


def test_catalogue_lookup_reads_status(spark, tmp_path):
    spark.createDataFrame([("c1", 5.0, 0), ("c1", 4.0, 1), ("c2", 6.0, 2)], "chain string, v double, status int").write.parquet(str(tmp_path / "known"))
    first = tables.read_catalogue(spark, str(tmp_path / "known"))
    second = spark.createDataFrame([("s2", 7.0, 0), ("s3", 8.0, None)], "seq string, v double, status int")
    rows = spark.createDataFrame([("c1", "s1"), ("c2", "s2"), ("c3", "s3"), (None, None)], "chain string, seq string")
    got = {(r.chain, r.v, r.origin) for r in joins.catalogue_lookup(rows, first, "chain", second, "seq", "v").collect()}
    assert got == {("c1", 5.0, "first"), ("c2", 7.0, "second"), ("c3", None, "compute"), (None, None, "compute")}


def test_matched_rows_rejects(spark):
    left = spark.createDataFrame([("a", k, 1) for k in range(20)] + [("b", k, 1) for k in range(4)], "g string, k int, x int")
    right = spark.createDataFrame([("a", k, 2) for k in range(1, 20)] + [("b", 9, 2)], "g string, k int, y int")
    kept, rejects = joins.matched_rows(left, right, ["g", "k"], "g")
    assert kept.count() == 19 and [(r.g, r.n_keys, r.one_sided) for r in rejects.collect()] == [("b", 5, 5)]


def test_paired_with_target(spark):
    side = lambda *rows: spark.createDataFrame(list(rows), "position int, taxon string, seq string")
    left = side((0, None, "ACD"), (1, "t", "A-D"), (2, "t", "ACDa"), (3, None, "AAA"), (4, "u", "AAA"))
    right = side((0, None, "GH"), (1, "t", "GH"), (2, "v", "GG"))
    assert sorted((r.position, r.taxon, r.paired) for r in joins.paired_with_target(left, right, "position", "taxon", "seq").collect()) == [(0, None, "ACD-----GH"), (1, "t", "ACD-----GH")]


def test_chain_sequences(spark):
    rows = [("a", k, "AXG"[k % 3]) for k in range(15)] + [("a", 15, "X"), ("b", 1, "A")] + [("c", k, "X") for k in range(20)]
    got = joins.chain_sequences(spark.createDataFrame(rows, "c string, k int, l string"), ["c"], ["k"], "l", F.col("l") != "X")
    assert [(r.c, r.sequence) for r in got.collect()] == [("a", "AXG" * 5)]


def test_trace_axes_ends_are_undefined(spark):
    p = spark.createDataFrame([("c", 1, 0.0, 0.0, 0.0), ("c", 2, 1.0, 1.0, 0.0), ("c", 3, 2.0, 0.0, 0.0), ("c", 4, 1.0, 2.0, 0.0)], "g string, node int, x double, y double, z double")
    axes = spatial.trace_axes(p, ["g"], ["node"])
    assert {r.node: (r.ax, r.ay) for r in axes.collect()} == {1: (None, None), 2: (0.0, 2.0), 3: (2.0, -3.0), 4: (None, None)}
    got = {r.node: (r.n_up, r.n_down) for r in spatial.half_sphere_counts(axes, 5.0, ["g"], ("ax", "ay", "az")).collect()}
    assert got[1] == got[4] == (-1, -1) and got[2] == (1, 2)


def test_representative_and_accessible(spark):
    atoms = spark.createDataFrame([("r", "CA", 1.0), ("r", "CB", 2.0), ("s", "CA", 3.0)], "res string, atom string, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    got = spatial.representative(atoms, ["res"], F.when(F.col("atom") == "CB", 0).otherwise(1))
    assert {r.res: r.x for r in got.collect()} == {"r": 2.0, "s": 3.0}
    edges = spark.createDataFrame([("c", 1, 2), ("c", 1, 3), ("c", 2, 1)], "k string, src int, dst int")
    exposed = spark.createDataFrame([("c", 1, 5.0), ("c", 2, 6.0), ("c", 3, 4.9)], "k string, node int, exposure double")
    assert {(r.src, r.dst) for r in neighbours.accessible_edges(edges, exposed, ["k"]).collect()} == {(1, 2), (2, 1)}


def test_wrapped_runs_cross_lines(spark):
    rows = spark.createDataFrame([("c", k, "H" if k < 5 else "E") for k in range(7)], "c string, k int, l string")
    got = sorted((r.segment, r.line, r.from_place, r.to_place) for r in ordered.wrapped_runs(rows, "c", ["k"], "l", 3).collect())
    assert got == [(1, 0, 0, 2), (1, 1, 0, 1), (2, 1, 2, 2), (2, 2, 0, 0)]


def test_best_correlation_row(spark):
    s = spark.createDataFrame([("g", 0.1, 0), ("g", 0.2, 0), ("g", 0.3, 1), ("g", 0.4, 1)], "g string, s double, y int")
    got = evaluation.best_correlation(evaluation.threshold_sweep(s, "g", "s", "y"), "g").first()
    assert (got.t, got.accuracy, got.fpr, got.npv) == (0.2, 1.0, 0.0, 1.0) and math.isclose(got.mcc, 1.0)
    assert evaluation.hit_rate_marks(spark.createDataFrame([("a", 1), ("b", 4), ("c", None)], "g string, first_rank int"), (0.3, 0.6)).orderBy("share").collect() == [(0.3, 1, 1 / 3), (0.6, 4, 2 / 3)]


def test_key_details(spark):
    col = F.lit
    row = spark.range(1).select(keys.residue_order(col("12A")).alias("a"), keys.overlap_fraction(col(0), col(10), col(5), col(20)).alias("b"), keys.overlap_fraction(col(3), col(3), col(0), col(9)).alias("c"), keys.display_chain(col("*")).alias("d"), keys.without_insertions(col("AbC-")).alias("e"), evaluation.expected_interface_size(col(100)).alias("f")).first()
    assert tuple(row.a) == (12, "A") and row[1:5] == (0.5, None, " ", "AC-") and row.f == round(6.1 * 100**0.3)


def test_model_round_trip(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 6).cast("double").alias("a"), (F.col("id") % 6 > 2).cast("int").alias("label"))
    fitted = models.pipeline(["a"], models.random_forest(trees=3, depth=2)).fit(rows)
    sinks.save_model(fitted, str(tmp_path), "step1", True)
    again = sinks.load_model(str(tmp_path), "step1", True)
    pairs = models.score(again, models.score(fitted, rows, "one"), "two").select("one", "two").collect()
    assert len(pairs) == 60 and all(math.isclose(r.one, r.two) for r in pairs)


def test_intake_takes_new_files_only(spark, tmp_path):
    source, target, seen = (str(tmp_path / n) for n in ("in", "out", "seen"))
    spark.range(3).write.parquet(f"{source}/t.parquet")
    work = lambda df: df.withColumn("twice", F.col("id") * 2)
    assert intake.available_now(spark, f"{source}/t.parquet", work, target, seen).count() == 3
    spark.range(10, 15).write.mode("append").parquet(f"{source}/t.parquet")
    assert sorted(r.id for r in intake.available_now(spark, f"{source}/t.parquet", work, target, seen).collect()) == [0, 1, 2, 10, 11, 12, 13, 14]
    assert [r.id for r in intake.pending(spark.range(5), spark.range(4), ["id"]).collect()] == [4]
