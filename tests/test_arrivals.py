"""Parts that arrive over several calls, a catalogue that fills itself, and folds by least load."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from spark_rri.operators import catalogue, sampling
from spark_rri.streaming.gather import gather

START = datetime(2024, 1, 1)


def test_complexes_over_three_calls(spark, tmp_path):
    source, folder = str(tmp_path / "parts"), str(tmp_path / "state")

    def call(rows):
        data = [(k, v, None if at is None else START + timedelta(hours=at), n) for k, v, at, n in rows]
        spark.createDataFrame(data, "complex_id string, variant string, at timestamp, reason2 int").coalesce(1).write.mode("append").parquet(source)
        found = gather(spark, source, folder, "complex_id", "variant", ["l", "r"], "at", 10 * 3600)
        return {s: sorted((r["complex_id"] or "", r["variant"], r["reason"] or "") for r in t.collect()) for s, t in found.items()}

    one = call([("a", "l", 0, 1), ("a", "l", 0, 2), ("b", "l", 1, 1), ("c", "l", 8, 1), ("c", "r", 8, 1), (None, "l", 1, 1), ("n", "x", None, 1)])
    assert one["complete"] == [("c", "l", ""), ("c", "r", "")]
    assert one["waiting"] == [("a", "l", ""), ("a", "l", ""), ("b", "l", ""), ("n", "x", "")]
    assert one["quarantined"] == [("", "l", "no key")]
    two = call([("a", "r", 9, 1), ("d", "l", 10.5, 1)])
    assert [x for x in two["complete"] if x[0] == "a"] == [("a", "l", ""), ("a", "l", ""), ("a", "r", "")]
    assert two["waiting"] == [("b", "l", ""), ("d", "l", ""), ("n", "x", "")]
    three = call([("b", "r", 10, 1), ("e", "l", 21, 1), ("c", "extra", 21, 1)])
    assert ("b", "r", "") in three["complete"] and ("c", "extra", "") in three["complete"]
    assert three["waiting"] == [("e", "l", ""), ("n", "x", "")]
    assert three["quarantined"] == [("", "l", "no key"), ("d", "l", "1 of 2 variants")]
    four = call([("d", "r", 22, 1)])
    assert ("d", "r", "came after quarantine") in four["quarantined"] and len(four["complete"]) == len(three["complete"])
    again = gather(spark, source, folder, "complex_id", "variant", ["l", "r"], "at", 10 * 3600)
    assert {s: t.count() for s, t in again.items()} == {s: len(v) for s, v in four.items()}


def test_catalogue_fills_itself(spark, tmp_path):
    path, asked = str(tmp_path / "catalogue"), []

    def compute(todo):
        return todo.filter("seq != 'skip'").select("seq", F.when(F.col("seq") != "bad", F.length("seq")).alias("value"), F.when(F.col("seq") == "bad", 3).otherwise(0).alias("status"))

    def counted(todo):
        asked.append(sorted(r[0] for r in todo.collect()))
        return compute(todo)

    rows = lambda *seqs: spark.createDataFrame([(s, k) for k, s in enumerate(seqs)], "seq string, row int")
    told = lambda df: sorted((r["seq"] or "", r["value"], r["status"], r["origin"]) for r in df.collect())
    first = told(catalogue.filled(rows("aa", "aa", "bad", "skip", None), path, "seq", counted))
    assert first == [("", None, None, None), ("aa", 2, 0, "computed"), ("aa", 2, 0, "computed"), ("bad", None, 3, "computed"), ("skip", None, None, None)]
    assert max(asked, key=len) == ["aa", "bad", "skip"]
    asked.clear()
    second = told(catalogue.filled(rows("aa", "bad", "ccc"), path, "seq", counted))
    assert second == [("aa", 2, 0, "catalogue"), ("bad", None, 3, "catalogue"), ("ccc", 3, 0, "computed")]
    assert max(asked, key=len) == ["ccc"]
    asked.clear()
    assert {r[3] for r in told(catalogue.filled(rows("aa", "bad", "ccc"), path, "seq", counted))} == {"catalogue"} and not any(asked)
    entries = spark.createDataFrame([("aa", 9, 0), ("z", 1, 0)], "seq string, value int, status int")
    for _ in range(2):
        catalogue.upsert(entries, path, "seq")
        assert sorted((r["seq"], r["value"]) for r in spark.read.parquet(path).collect()) == [("aa", 9), ("bad", None), ("ccc", 3), ("z", 1)]
    assert catalogue.filled(rows().limit(0), path, "seq", compute).count() == 0


def greedy_spread(sizes, folds):
    loads = [0] * folds
    for n in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += n
    return max(loads) - min(loads)


def test_folds_are_as_even_as_greedy_ones(spark):
    rng = random.Random(5)
    for n, most, folds in ((40, 100, 5), (600, 60, 7), (600, 40, 3), (5, 2, 3), (1, 1, 4)):
        sizes = [max(1, int(rng.paretovariate(0.9))) for _ in range(n)]
        groups = spark.createDataFrame([(f"g{k:04}", s) for k, s in enumerate(sizes)], "g string, n long").repartition(3)
        got = sampling.group_folds(groups, "g", "n", folds, most=most).collect()
        assert sorted((r["g"], r["n"]) for r in got) == sorted((f"g{k:04}", s) for k, s in enumerate(sizes))
        loads = [sum(r["n"] for r in got if r["fold"] == f) for f in range(folds)]
        assert max(loads) - min(loads) <= greedy_spread(sizes, folds)
    assert sampling.group_folds(groups.limit(0), "g", "n", 3).count() == 0
