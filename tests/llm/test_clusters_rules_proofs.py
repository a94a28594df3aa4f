"""Centroid clustering, the rule ensemble and the Merkle manifest against plain versions, on odd rows too."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spark_rri.llm import laesa, merkle, queries, rules

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# centroid clustering


def odd_vectors(n, seed=3):
    rng = random.Random(seed)
    rows = [(i, [rng.choice((-1, 1)) * rng.random() / 4 for _ in range(64)], 1, "x") for i in range(n)]
    rows += [(n, rows[0][1], 1, "tie"), (n + 1, rows[0][1], 1, "tie"), (0, rows[1][1], 1, "repeated id"), (None, rows[2][1], 1, "no id")]
    bad = [None, [], [0.5] * 63, [0.5] * 65, [0.5] * 63 + [None], [0.5] * 63 + [float("nan")], [0.5] * 63 + [float("-inf")]]
    return rows + [(1000 + i, v, 0, "bad") for i, v in enumerate(bad)]


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    cent = [v for _, v in sorted(kept, key=lambda r: (sha("1:", "" if r[0] is None else str(r[0])), r[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        at = [min((square(v, c), j) for j, c in enumerate(cent)) for _, v in kept]
        if turn < rounds:
            for j in range(len(cent)):
                own = [v for (_, v), (_, a) in zip(kept, at, strict=True) if a == j]
                cent[j] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else cent[j]
    each = Counter()
    for d, j in at:
        each[j] += d
    return sorted(((i, j, d, each[j], sum(each.values()), sha(",".join(map(str, cent[j])))) for (i, _), (d, j) in zip(kept, at, strict=True)), key=str)


@pytest.mark.parametrize("n", [150, 3, -1])
def test_clusters(spark, tmp_path, n):
    rows = odd_vectors(n) if n > 0 else []
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int, distance string").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op11_centroid_clustering(spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(rows)


def test_pivots_spare_distances_only():
    rng = np.random.default_rng(0)
    centres = rng.integers(-60, 60, (16, 64))
    x = (centres[rng.integers(0, 16, 2000)] + rng.integers(-3, 4, (2000, 64))).astype(np.int64)
    exact = laesa.squares(x, centres)
    for n_pivots in (1, 16):
        p = laesa.choose_pivots(x[:300], n_pivots)
        cluster, best, computed = laesa.nearest(x, laesa.squares(x, p), centres, laesa.squares(centres, p))
        assert (cluster == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
        assert 2000 <= computed < (2000 * 16 if n_pivots == 1 else 2000 * 4)
        assert (laesa.bounds(laesa.squares(x, p), laesa.squares(centres, p)) <= exact).all()


def test_large_components_are_an_error(spark):
    rows = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="a scaled component beyond"):
        laesa.cluster(rows).collect()


# Merkle manifest


def climb(nodes):
    steps, place, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, p in enumerate(place):
            low = p // 8 * 8
            steps[i].append((level[low:p], level[p + 1 : low + 8]))
        place, level = [p // 8 for p in place], [sha(*level[k : k + 8]) for k in range(0, len(level), 8)]
    return level[0], steps


def plain_manifest(rows):
    told = lambda *vs: sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in vs])
    parts = []
    for lang in sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode())):
        own = sorted(((r[0], told(*r)), r) for r in rows if r[2] == lang) if all(r[0] is not None for r in rows) else sorted((((r[0] is not None, r[0] or 0, told(*r)), r) for r in rows if r[2] == lang), key=lambda x: x[0])
        parts.append(([x[1] for x in own], *climb([told(*x[1]) for x in own])))
    root, upper = climb([p[1] for p in parts]) if parts else (None, [])
    out = []
    for (own, subroot, steps), above in zip(parts, upper, strict=True):
        for r, s in zip(own, steps, strict=True):
            text = r[4].translate(LOWER) if r[4] is not None and zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 3 == 0 else r[4]
            h = told(*r[:4], text)
            for left, right in s + above:
                h = sha(*left, h, *right)
            out.append((r[0], told(*r), subroot, root, sha(*[x for a, b in s + above for x in a + b]), h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("langs", [0, 1, 4, 12])
def test_manifest(spark, tmp_path, langs):
    rng = random.Random(langs)
    names = [None, "é", "en", "", *[f"l{k}" for k in range(8)]][:langs]
    sizes = [90, 9, 1, 8, 2, *[1] * 7]
    rows, number = [], 0
    for lang, size in zip(names, sizes, strict=False):
        for _ in range(size):
            number += rng.randint(1, 9)
            text = rng.choice([None, "", "Text A", "no capitals", "ÀÉ only others", "Long " * 300])
            rows.append((number, rng.choice(["s", None, "é"]), lang, rng.choice([None, 5]), text))
    if rows:
        rows += [rows[0], rows[0], (rows[1][0], "same id", rows[1][2], 1, "Other"), (None, "s", rows[0][2], 1, "No id")]
    clash = [(*r, "k", 1) for r in rows]
    spark.createDataFrame(clash, "doc_id long, source string, lang string, n_chars long, text string, digest string, pos int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(rows)


def test_joins_double_the_distance(spark, monkeypatch):
    """Four steps from the lowest inner node take two joins; every proof folds to the root and a changed leaf does not."""
    jumps = []
    monkeypatch.setattr(merkle, "jump", lambda *a, f=merkle.jump: jumps.append(a[2]) or f(*a))
    rows = spark.range(8**4 + 1).select(F.lit("g").alias("g"), F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    proofs = merkle.prove(rows.withColumn("digest", F.unhex("digest")), "g", "k", "digest", [])
    good, bad = merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root"), merkle.folded(merkle.node_digest(F.col("leaf")), F.col("proof")) == F.col("root")
    told = proofs.agg(F.count("*"), F.count_if(good), F.count_if(bad), F.max(F.size("proof"))).first()
    assert tuple(told) == (8**4 + 1, 8**4 + 1, 0, 5) and jumps == [2, 3]


# rule ensemble


def plain_statistics(text):
    raw = (text or "").encode()
    ws = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n = max(len(ws), 1)
    count, triples = Counter(ws), Counter(zip(ws, ws[1:], ws[2:], strict=False))
    lines = [line for line in raw.split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
    share = lambda chars, of: sum(raw.count(c.encode()) for c in chars) / max(of, 1)
    upper, letters = [chr(k) for k in range(65, 91)], [chr(k) for k in (*range(65, 91), *range(97, 123))]
    return [
        len(ws), sum(len(w.decode()) for w in ws) / n, sum(len(w) > 20 for w in ws) / n, share("#*$%&|<>", n), share(".,;:", n), share("!?", n), share("0123456789", sum(map(len, ws))),
        share(upper, sum(raw.count(c.encode()) for c in letters)), sum(b"A" <= w[:1] <= b"Z" for w in ws) / n, len(count) / n, max(count.values(), default=0) / n, sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / n, sum(v for v in triples.values() if v > 1) / n,
        len(ws) / max(len(lines), 1), (len(lines) - len(set(lines))) / max(len(lines), 1),
    ]


def test_statistics(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t ", "one", "A A A a", "x\n\nx\n x\ny\n", "é" * 30 + " ñ", "a b c a b c\na b c", "".join(rng.choice("aB #\n.!7é ") for _ in range(20_000))]
    texts += ["".join(rng.choice("ab A\n. ") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int").repartition(2)
    for r in rules.statistics(rows).collect():
        assert np.allclose(r[1:], plain_statistics(texts[r[0]])), texts[r[0]]


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["red", "green", "blue", "cyan", "Pink", "grey"]) + str(rng.randint(0, 40)) for _ in range(rng.randint(20, 60)))
    bad = [lambda: good().upper(), lambda: "### ".join(good().split()), lambda: "spam " * 50]
    rows = [(i, good(), 1) if i % 4 else (i, rng.choice(bad)(), 0) for i in range(400)]
    return spark.createDataFrame([(*r, 9.0, "x") for r in rows], "doc_id long, text string, quality int, symbols double, score string")


def test_rules_learn_and_compile(spark, graded):
    train, test = graded.filter("doc_id % 3 != 1"), graded.filter("doc_id % 3 = 1")
    model = rules.fit(train)
    assert 0 < len(model.rules) <= 60 and model.described()[0][0]
    got = rules.score(test, model).join(test.select("doc_id", "quality"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95
    x = np.array([r[1:] for r in rules.statistics(test).orderBy("doc_id").collect()])
    z = model.bias + np.stack([r.holds(x) for r in model.rules], axis=1) @ model.weights
    assert np.allclose(1 / (1 + np.exp(-z)), [r["score"] for r in sorted(got, key=lambda r: r["doc_id"])])
    again = rules.fit(train.repartition(5))
    assert again.rules == model.rules and np.allclose(again.weights, model.weights)
    assert rules.score(test.limit(0), model).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (2, "")], "doc_id long, text string")
    scores = [r["score"] for r in rules.score(odd, model).collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 for s in scores)


@pytest.mark.parametrize("where", ["false", "quality = 1", "quality = 0", "quality is null"])
def test_rules_without_both_labels(graded, where):
    model = rules.fit(graded.filter(where))
    assert not model.rules
    assert rules.score(graded, model).select("predicted").distinct().collect()[0][0] == (0 if where == "quality = 0" else 1)


@pytest.mark.parametrize("name, table", [("op11_centroid_clustering", "embeddings"), ("op13_merkle_manifest", "documents")])
def test_matches_sql(spark, name, table):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '/root/testdata/sf0.001/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op12_quality_classifier(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert len(got) > 50 and np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95
