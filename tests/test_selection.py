"""Curves, model selection and recipes on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from spark_rri.operators import curves, models, recipes, selection


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(240).select(F.concat(F.lit("c"), F.col("id") % 12).alias("complex_id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 7 > 3).cast("int").alias("label"))


def test_average_precision_and_area(spark):
    s = spark.createDataFrame([("x", 0.9, 1), ("x", 0.8, 0), ("x", 0.7, 1), ("y", 0.5, 0)], "g string, s double, y int")
    assert [(r.g, round(r.average_precision, 6)) for r in curves.average_precision(s, "g", "s", "y").collect()] == [("x", round(0.5 + 0.5 * 2 / 3, 6))]
    got = curves.pr_auc(s, "g", "s", "y").first()
    assert math.isclose(got.pr_auc, 0.5 * (0.5 + 2 / 3) / 2)


def test_mean_curve_interpolates(spark):
    p = spark.createDataFrame([("u", 0.5, 1.0), ("u", 1.0, 1.0), ("v", 1.0, 1.0)], "g string, x double, y double")
    got = {r.x: (r["mean"], r.parts) for r in curves.mean_curve(p, "g", "x", "y", steps=4).collect()}
    assert got == {0.0: (0.0, 2), 0.25: (0.375, 2), 0.5: (0.75, 2), 0.75: (0.875, 2), 1.0: (1.0, 2)}


def test_matrix_round_trip(spark):
    s = spark.createDataFrame([("x", 0, 1, 0.5), ("x", 0, 0, 0.25), ("x", 1, 0, 1.0)], "c string, i int, j int, s double")
    m = curves.to_rows(s, "c", "i", "j", "s")
    assert m.count() == 2 and sorted(map(tuple, curves.to_long(m, "c", "i").collect())) == sorted(map(tuple, s.collect()))
    more = spark.createDataFrame([("x", 0, 1, 2.0)], "c string, i int, j int, t double")
    assert {(r.i, r.j): r.s for r in curves.add_matrix(s, more, ["c", "i", "j"], "s", "t", 0.5).collect()} == {(0, 1): 1.5, (0, 0): 0.25, (1, 0): 1.0}


def test_grid_search_and_learning_curve(rows):
    forest = models.random_forest(trees=3, depth=1)
    got = selection.grid_search(rows, ["a", "b"], forest, {"maxDepth": [1, 3]}, folds=2, group="complex_id", best=1).collect()
    assert len(got) == 1 and got[0].auc > 0.9
    got = selection.learning_curve(rows, rows, ["a", "b"], forest, [0.5, 1.0], group="complex_id").collect()
    assert [r.share for r in got] == [0.5, 1.0] and got[0].n_train < got[1].n_train == 240


def test_fold_loop_resumes(spark, rows, tmp_path):
    part = lambda c: F.when(F.substring("complex_id", -1, 1).cast("int") % 2 == c, "test").otherwise("train")
    ids = rows.select("complex_id").distinct()
    folds = ids.select(F.lit(0).alias("fold"), part(0).alias("part"), "complex_id").union(ids.select(F.lit(1), part(1), "complex_id"))
    forest = models.random_forest(trees=3, depth=3)
    out = str(tmp_path / "scores")
    fitted = selection.fold_loop(rows, folds, ["a", "b"], forest, out)
    assert spark.read.parquet(out).count() == 240
    selection.fold_loop(rows, folds, ["a", "b"], forest, out)
    assert spark.read.parquet(out).count() == 240
    assert [r.feature for r in selection.importances(fitted, ["a", "b"], spark).collect()][0] == "a"


def test_fits(spark):
    p = spark.createDataFrame([("g", t, 2.0 * t**0.5) for t in (1.0, 4.0, 9.0)], "g string, t double, p double")
    got = selection.power_fit(p, "g", "t", "p").first()
    assert math.isclose(got.factor, 2.0, rel_tol=1e-9) and math.isclose(got.exponent, 0.5, rel_tol=1e-9)
    p = spark.createDataFrame([(t, 1 / (1 + math.exp(-(2 * t - 1)))) for t in (-1.0, 0.0, 1.0, 2.0)], "t double, p double")
    slope, intercept = selection.logistic_fit(p, "t", "p")
    assert abs(slope - 2) < 0.01 and abs(intercept + 1) < 0.01


def test_protocols(spark):
    got = spark.createDataFrame([("seq", "seq"), ("struct", "seq"), ("struct", "struct")], "l string, r string").select(selection.protocol(F.col("l"), F.col("r")).alias("p"), selection.model_kind(F.col("l"), F.col("r")).alias("k"))
    assert [tuple(r) for r in got.collect()] == [("seq", "homo"), ("mixed", "hetero"), ("struct", "homo")]


def test_mixed_recipe(spark):
    seq = spark.createDataFrame([("c", 1, 1.0, 5.0), ("c", 2, 3.0, 6.0)], "complex_id string, node int, `w.4` double, `w.5` double")
    surf = spark.createDataFrame([("c", 1, 7.0), ("c", 2, 8.0)], "complex_id string, node int, asa double")
    edges = spark.createDataFrame([("c", 1, 2), ("c", 2, 1)], "complex_id string, src int, dst int")
    pairs = spark.createDataFrame([("c", 1, 2), ("c", 2, 9)], "complex_id string, i int, j int")
    coup = spark.createDataFrame([("c", 1, 2, 0.5)], "complex_id string, i int, j int, q double")
    recipe = [recipes.FeatureSpec("win", ("w.4", "w.5")), recipes.FeatureSpec("surf", ("asa",), kind="struct"), recipes.FeatureSpec("coup", ("q",), level="pair")]
    tables = {"L": {"win": seq, "surf": surf}, "R": {"win": seq}, "pair": {"coup": coup}}
    got = recipes.codify(pairs, recipe, tables, {"L": edges, "R": edges}, {"L": "struct", "R": "seq"}, ["complex_id"])
    assert not [c for c in got.columns if c.startswith("R_surf") or c.endswith("_w_4") and "avg" in c]
    row = got.collect()[0].asDict()
    assert got.count() == 1 and (row["L_surf_asa"], row["L_avg_surf_asa"], row["R_win_w_5"], row["R_max_win_w_5"], row["coup_q"]) == (7.0, 8.0, 6.0, 5.0, 0.5)
    assert [s.name for s in recipes.without_couplings(recipe, False)] == ["win", "surf"]


def test_encode_by_kinds(spark):
    frame = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    ids = "complex_id string, node int"
    window = frame(f"{ids}, `w.4` double, `w.5` double", ("c", 1, 1.0, 5.0), ("c", 2, 3.0, 6.0), ("c", 3, 4.0, 7.0))
    one = frame(f"{ids}, v double", ("c", 1, 7.0), ("c", 2, 8.0), ("c", 3, 9.0))
    tables = {n: one for n in ("letter_window", "conservation", "predicted_surface", "surface", "half_sphere", "secondary_structure")} | {"profile_window": window}
    edges = frame("complex_id string, src int, dst int", ("c", 1, 2), ("c", 2, 1))
    pairs = frame("complex_id string, chain_l string, i int, chain_r string, j int", ("c", "A", 1, "B", 1), ("c", "A", 1, "B", 2), ("c", "A", 2, "B", 1))
    couplings = frame("complex_id string, i int, j int, p double, run_quality double", ("c", 1, 2, 0.5, 1.0))
    sides = {"L": tables, "R": tables, "pair": {"couplings": couplings}}

    def run(left, right, **more):
        out = recipes.encode(pairs, sides, {"L": edges, "R": edges}, {"L": left, "R": right}, ["complex_id"], **more)
        return {(r.i, r.j): r.asDict() for r in out.collect()}

    seq, struct, mixed = run("seq", "seq"), run("struct", "struct"), run("struct", "seq")
    assert len(seq) == len(struct) == len(mixed) == 3
    assert not [c for c in seq[1, 1] if "surface_v" in c and "predicted" not in c or c.startswith("L_avg")]
    assert (seq[1, 1]["L_length"], seq[1, 1]["R_length"], seq[1, 1]["l2r_max_couplings_p"]) == (2, 2, 0.5)
    assert not [c for c in struct[1, 1] if "predicted" in c or c.endswith("_length")] and struct[1, 1]["R_avg_surface_v"] == 8.0
    assert "L_avg_profile_window_w_5" in struct[1, 1] and "L_avg_profile_window_w_4" not in struct[1, 1]
    assert mixed[1, 1]["L_max_surface_v"] == 8.0 and not [c for c in mixed[1, 1] if c.startswith(("R_surface", "R_max"))] and mixed[1, 1]["R_length"] == 2
    assert [c for c in mixed[1, 1] if "run_quality" in c] == ["couplings_run_quality"]
    assert not [c for c in run("seq", "seq", couplings=False)[1, 1] if "couplings" in c]


def test_two_step_over_neighbourhoods(spark):
    pairs = spark.range(200).select(F.concat(F.lit("c"), (F.col("id") % 8)).alias("complex_id"), F.expr("cast(id div 8 % 5 as int) as i"), F.expr("cast(id div 40 as int) as j"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 7 > 3).cast("int").alias("label"))
    nodes = pairs.select("complex_id", F.col("i").alias("src")).distinct()
    edges = nodes.withColumn("dst", F.explode(F.array(F.col("src") - 1, F.col("src") + 1)))
    got = models.two_step(pairs, ["a"], ["complex_id"], edges, edges, models.random_forest(trees=3, depth=3), 2, "complex_id")
    assert got.count() == 200 and {"step0_P", "step0_z_P", "l2r_avg_step0_P", "n2n_max_step0_z_P", "prediction"} <= set(got.columns)
    rows = got.collect()
    before = {(r.complex_id, r.i, r.j): r.step0_P for r in rows}
    for r in rows:
        around = [before[r.complex_id, r.i, j] for j in (r.j - 1, r.j + 1) if (r.complex_id, r.i, j) in before]
        assert math.isclose(r.l2r_avg_step0_P, sum(around) / len(around) if around else -1024.0)
