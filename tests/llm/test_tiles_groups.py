"""Greedy tilings against a plain one on both paths; thresholds of languages that nobody named."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spark_rri.llm import langid, tiling, toxicity
from spark_rri.llm.sampling import balanced_rows


def plain_tiles(doc, item, least):
    """Again and again the longest common run of unmarked words, the first in the item, then in the document."""
    free_doc, free_item, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = None
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and free_doc[i + n] and free_item[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, j, i)
        if best is None:
            return out
        n, j, i = best
        free_doc[i : i + n] = free_item[j : j + n] = [False] * n
        out.append((i, j, n))


def cases(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        words = [f"w{k}" for k in range(rng.choice([2, 3, 6, 40]))]
        item = [rng.choice(words) for _ in range(rng.randint(1, 40))]
        doc = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, len(item))
            at = rng.randint(0, len(doc))
            doc[at:at] = item[a : a + rng.randint(1, 25)]
        yield doc, item


def test_tiles_are_greedy():
    number = {f"w{k}": np.uint64(k + 1) for k in range(40)}
    for doc, item in cases(1, 600):
        least = min(3, len(item))
        got = tiling.tiles(np.array([number[w] for w in doc], np.uint64), np.array([number[w] for w in item], np.uint64), 3)
        want = plain_tiles(doc, item, least) if len(doc) >= least else []
        assert sorted(got) == sorted(want), (doc, item)


@pytest.mark.parametrize("limit", [32 << 20, -1])
def test_both_paths_report_what_a_plain_tiling_covers(spark, limit):
    docs, items, want = [], [], set()
    for k, (doc, item) in enumerate(cases(2, 40)):
        docs.append([f"{w}x{k % 20}" for w in doc])
        items.append([f"{w}x{k % 20}" for w in item])
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            least = min(5, len(item))
            covered = sum(t[2] for t in plain_tiles(doc, item, least))
            if 5 * covered >= 3 * len(item):
                want.add((d, i, len(item), covered))
    rows = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)] + [(99, None), (98, "")], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(99, None), (98, "")], "item_id long, text string")
    got = tiling.contaminated(rows, bench, max_shared_seeds=limit)
    assert {tuple(r)[:4] for r in got.collect()} == want and len(want) > 10
    assert tiling.contaminated(rows.limit(0), bench, max_shared_seeds=limit).count() == tiling.contaminated(rows, bench.limit(0), max_shared_seeds=limit).count() == 0
    assert {r["doc_id"] for r in tiling.remove_contaminated(rows, bench, max_shared_seeds=limit).collect()} == ({*range(len(docs)), 98, 99} - {w[0] for w in want})


def tongue(rng, common, rare, n):
    return [rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n)]


def test_groups_of_five_languages():
    """Five invented languages fall into groups of their own, whatever their shares."""
    rng = random.Random(3)
    langs = [([f"{c}{k}" for k in range(12)], [f"{c}r{k}" for k in range(400)]) for c in "abcde"]
    texts, truth = [], []
    for lang, size in enumerate((300, 120, 80, 60, 60)):
        for _ in range(size):
            texts.append(" ".join(tongue(rng, *langs[lang], rng.randint(15, 80))).encode())
            truth.append(lang)
    at = np.cumsum([0, *map(len, texts)])
    w = toxicity.normal_words(np.frombuffer(b"".join(texts), np.uint8), at)
    groups = toxicity.learn_groups(w)
    own, truth = groups.of(w), np.array(truth)
    assert len(groups.centres) == 5 and len({int(np.bincount(own[truth == k]).argmax()) for k in range(5)}) == 5
    assert all((own[truth == k] == np.bincount(own[truth == k]).argmax()).mean() > 0.97 for k in range(5))
    odd = toxicity.normal_words(np.frombuffer(b"zz yya0", np.uint8), np.array([0, 5, 5, 7]))
    assert groups.of(odd).tolist() == [5, 5, 0] or groups.of(odd)[:2].tolist() == [5, 5]
    none = toxicity.learn_groups(toxicity.normal_words(np.zeros(0, np.uint8), np.array([0, 0])))
    assert none.of(odd).tolist() == [0, 0, 0]


def test_thresholds_by_group(spark):
    """A fifth language whose clean texts use the bad words of another: one threshold for all would not do. Clashing columns, empty tables."""
    rng = random.Random(5)
    rows = []
    for k in range(1500):
        c = "abcde"[k % 5]
        text = tongue(rng, [f"{c}{n}" for n in range(12)], [f"{c}r{n}" for n in range(60)], 30)
        toxic = rng.random() < 0.4
        if toxic:
            text[rng.randrange(30)] = f"bad{c}{rng.randrange(3)}"
        rows.append((k, " ".join(text), int(toxic), 0.5, "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score double, predicted string")
    model = toxicity.fit(docs.filter("doc_id % 3 != 1"))
    assert len(model.shift) == 6
    got = toxicity.score(docs.filter("doc_id % 3 = 1"), model).join(docs.select("doc_id", "toxic"), "doc_id").collect()
    for c in range(5):
        own = [r for r in got if r["doc_id"] % 5 == c]
        assert np.mean([r["predicted"] == r["toxic"] for r in own]) > 0.85
    assert toxicity.score(docs.limit(0), model).count() == 0
    empty = toxicity.score(spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string"), model).collect()
    assert len(empty) == 3 and all(0 <= r["score"] <= 1 for r in empty)
    assert toxicity.fit(docs.filter(F.lit(False))) is None


@pytest.mark.parametrize("a_shard", [1 << 20, 1 << 15])
def test_toxicity_learns_from_all_texts(spark, monkeypatch, a_shard):
    """One bad word marks the texts of a sample of 1500 a label, another one the rest."""
    monkeypatch.setattr(toxicity, "WORDS_PER_SHARD", a_shard, raising=False)
    rng = random.Random(11)
    plain = spark.createDataFrame([(k, k % 2) for k in range(6000)], "doc_id long, toxic int")
    drawn = {r["doc_id"] for r in balanced_rows(plain, "toxic", 1500)[0].collect()}
    rows = []
    for k in range(6000):
        text = tongue(rng, [f"c{n}" for n in range(12)], [f"r{n}" for n in range(60)], 12)
        if k % 2:
            text[rng.randrange(12)] = "drawnbad" if k in drawn else "otherbad"
        rows.append((k, " ".join(text), k % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs)).join(docs, "doc_id").collect()
    for part in (True, False):
        for label in (0, 1):
            own = [r["predicted"] for r in got if (r["doc_id"] in drawn) is part and r["toxic"] == label]
            assert len(own) > 1000 and abs(np.mean(own) - label) < 0.1


def test_language_learns_from_all_texts(spark):
    """Counts are those of every text, not of a sample: a language's words that only texts outside a sample of 500 use are known too."""
    plain = spark.createDataFrame([(k, "uv"[k % 2]) for k in range(3000)], "doc_id long, lang string")
    drawn = {r["doc_id"] for r in balanced_rows(plain, "lang", 500)[0].collect()}
    rng = random.Random(2)
    stems = {(lang, part): ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(8)] for lang in "uv" for part in (True, False)}
    rows = [(k, " ".join(rng.choices(stems["uv"[k % 2], k in drawn], k=10)), "uv"[k % 2]) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = langid.detect(docs, model, with_spans=False).join(docs, "doc_id").collect()
    assert model.languages == ["u", "v"] and all(r["lang_pred"] == r["lang"] for r in got)
    assert sum(r["score"] == 1 for r in got) > 0.99 * len(got)
    texts = [b"ab a", b"", b"ab"]
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = langid.count_grams(raw, at, np.array([0, 1, 1]), 2)
    alone = [langid.count_grams(np.frombuffer(t, np.uint8), np.array([0, len(t)]), np.array([0]), 1)[0] for t in texts]
    assert (whole[0] == alone[0]).all() and (whole[1] == alone[1] + alone[2]).all() and whole.sum() == 3 * (5 + 1 + 3)
