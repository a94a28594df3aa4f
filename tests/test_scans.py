"""Numbers, running sums and least rows of groups that fill most of a table, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from spark_rri.operators import evaluation, sampling, scans


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    groups = ["hot"] * 700 + ["b"] * 200 + [None] * 80 + [f"g{k}" for k in range(40)]
    data = [(g, rng.choice([None, 0.5, rng.random()]), k, rng.randint(0, 9), rng.choice([1, 0, 0])) for k, g in enumerate(groups)]
    return data, spark.createDataFrame(data, "g string, score double, id int, n int, label int").repartition(7)


def place(r):
    return (r[1] is not None, r[1] or 0, r[2])


def of(data, g):
    return sorted((r for r in data if r[0] == g), key=place)


def order():
    return [F.col("score"), F.col("id")]


def test_numbers(rows):
    data, frame = rows
    want = {r[2]: k for g in {r[0] for r in data} for k, r in enumerate(of(data, g))}
    got = scans.placed_in_group(frame, ["g"], order(), "at").collect()
    assert {r["id"]: r["at"] for r in got} == want and len(got) == len(data)
    assert sorted(r["at"] for r in scans.numbered(frame, [F.col("g"), *order()], "at").collect()) == list(range(len(data)))
    assert scans.placed_in_group(frame.limit(0), ["g"], order(), "at").count() == 0


def test_running_sums_and_rows_before(rows, spark):
    data, frame = rows
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["id"]: r for r in scans.running(frame, "g", order(), {"total": "n", "hits": "label"}).collect()}
        before = {r["id"]: r["last"] for r in scans.with_previous(frame, "g", order(), {"last": "id"}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(before) == len(data)
    for g in {r[0] for r in data}:
        total = hits = 0
        last = None
        for r in of(data, g):
            total, hits = total + r[3], hits + r[4]
            assert (got[r[2]]["total"], got[r[2]]["hits"], before[r[2]]) == (total, hits, last)
            last = r[2]


def test_hot_group_fills_many_ranges(rows, spark):
    _, frame = rows
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = scans.ranges(frame, [F.col("g"), *order()]).filter("g = 'hot'").groupBy("__range").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 3 and max(r["count"] for r in sizes) < 500


@pytest.mark.parametrize("k", [0, 1, 17, 10_000])
def test_least_rows(rows, spark, k):
    data, frame = rows
    wanted = frame.select("g").distinct().withColumn("__k", F.lit(k))
    # hashes that share all leading digits within a bin, so that the last pass decides
    hash_ = F.concat(F.lpad((F.col("id") % 3).cast("string"), 3, "0"), F.lit("abc"), F.lpad((F.col("id") % 50).cast("string"), 26, "0"))
    got = scans.least_rows(frame, "g", wanted, hash_, ["id"]).collect()
    want = {r[2] for g in {r[0] for r in data} for r in sorted((r for r in data if r[0] == g), key=lambda r: (r[2] % 3, r[2] % 50, r[2]))[:k]}
    assert {r["id"] for r in got} == want and len(got) == len(want)


def test_samples_keep_null_groups(rows):
    data, frame = rows
    got = sampling.negative_sampling(frame, "g", "label", ["id"], 1.0).collect()
    for g in {r[0] for r in data}:
        p, n = sum(r[4] == 1 for r in data if r[0] == g), sum(r[4] == 0 for r in data if r[0] == g)
        assert sum(r["g"] == g for r in got) == (p + min(p, n) if p else 0)
    drawn = sampling.bootstrap(frame, "g", ["id"], 0.5).collect()
    for g in {r[0] for r in data}:
        n = sum(r[0] == g for r in data)
        mine = [r["draw"] for r in drawn if r["g"] == g]
        assert sorted(mine) == list(range(1, max(n // 2, 1) + 1))


def test_areas_of_null_groups(rows):
    data, frame = rows
    got = {r["g"]: r["auc"] for r in evaluation.roc_auc(frame.fillna(0.0, ["score"]), "g", "score", "label").collect()}
    for g in {r[0] for r in data}:
        pos, neg = ([r[1] or 0.0 for r in data if r[0] == g and r[4] == y] for y in (1, 0))
        want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else 0.5
        assert abs(got[g] - want) < 1e-9
