"""Lists, keys and small merges."""

from pyspark.sql import functions as F

from spark_rri.functions import keys
from spark_rri.operators import evaluation, joins, recipes, scoring
from spark_rri.sources import tables


def test_chain_lists(spark, tmp_path):
    (tmp_path / "chains.txt").write_text("# ids\n1abc AB C\n\n2abc L H\n3abc L\n")
    good, bad = tables.read_chain_list(spark, str(tmp_path / "chains.txt"))
    assert sorted((r.complex_id, r.chains_l, r.chains_r) for r in good.collect()) == [("1abc", ["A", "B"], ["C"]), ("2abc", ["L"], ["H"])]
    assert [r.line for r in bad.collect()] == ["3abc L"]
    (tmp_path / "only.txt").write_text("set1 1abc_A 1abc_B 2abc_C\nset2 1abc_A\nempty\n")
    assert sorted(map(tuple, tables.read_restricted_ids(spark, str(tmp_path / "only.txt")).collect())) == [("1abc", "A"), ("1abc", "B"), ("2abc", "C")]


def test_keys_and_codes(spark):
    rows = spark.createDataFrame([("1abc_l_b",), ("1abc",), ("1abc_A#sl",), (None,)], "k string")
    got = [tuple(r[0]) if r[0] else None for r in rows.select(keys.key_parts(F.col("k"))).collect()]
    assert got[:3] == [("1abc", "l", "b", None), ("1abc", None, None, None), ("1abc", "A", None, "sl")]
    names = spark.createDataFrame([(n,) for n in ("MLY", "hyp", "HOH", "UNK", "ALA")], "n string")
    assert [r[0] for r in names.select(keys.one_letter(F.col("n"))).collect()] == ["K", "P", None, "X", "A"]
    assert [r[0] for r in names.select(keys.one_letter(F.col("n"), {"UNK": "U"})).collect()] == ["K", "P", None, "U", "A"]


def test_pair_features_lose_one_percent_at_most(spark):
    ids = joins.PAIR_IDS
    pairs = spark.range(400).select(F.when(F.col("id") < 200, "a").otherwise("b").alias("g"), *[F.col("id").cast("string").alias(c) for c in ids], F.lit(1).alias("categ"))
    features = pairs.filter("resIdL not in ('1', '2', '201', '202', '203')").select("g", *ids, F.lit(0.5).alias("q"), F.lit(0.1).alias("r_P"))
    merged, rejects = joins.pair_feature_merge(pairs, features, "g")
    assert merged.columns[-2:] == ["q_P", "r_P"] and {(r.g, r.n) for r in merged.groupBy("g").agg(F.count("*").alias("n")).collect()} == {("a", 198)}
    assert [(r.g, r.rows_before, r.rows_after) for r in rejects.collect()] == [("b", 200, 197)]


def test_small_parts(spark):
    one = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (3, "z")], "k int, v string")
    assert sorted(map(str, joins.in_all([one, one.filter("v != 'z'"), one], ["k", "v"]).collect())) == sorted(map(str, one.distinct().filter("v != 'z'").collect()))
    frame = spark.createDataFrame([(1, 2, 3, 4, 5)], "p int, R_b int, id int, L_a int, L_c int")
    assert recipes.in_order(frame, ["id"]).columns == ["id", "L_a", "L_c", "R_b", "p"] and recipes.in_order(frame, ["id"], "PRL").columns == ["id", "p", "R_b", "L_a", "L_c"]
    scores = spark.createDataFrame([("a", 1.0), ("a", None), (None, 3.0), ("b", 2.0)], "g string, s double")
    assert {tuple(r) for r in scoring.above_threshold(scores, "g", "s", 1.5).collect()} == {("a", False, 0), (None, True, 1), ("b", True, 1)}


def test_precision_over_contacts(spark):
    rows = [("a", float(-k), k, int(k < 3 or k == 9)) for k in range(10)] + [(None, float(-k), k, 0) for k in range(6)]
    pairs = spark.createDataFrame(rows, "g string, s double, k int, y int")
    got = {r["g"]: tuple(r)[1:] for r in evaluation.precision_over_contacts(pairs, "g", "s", ["k"], "y").collect()}
    assert got == {"a": (6, 4, 0.5, 0.125), None: (6, 0, 0.0, None)}
    assert {r["n"] for r in evaluation.precision_over_contacts(pairs, "g", "s", ["k"], "y", 4).collect()} == {4}
