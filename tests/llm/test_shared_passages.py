"""Sets that share a passage: their group is told apart by what they do not share, exactly."""

import random

import pytest

from spark_rri.llm import partenum

WORDS = [f"w{k}" for k in range(300)]


def sets(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def plain_components(texts):
    bags, label = [sets(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(bags):
        for j, b in enumerate(bags[:i]):
            if 100 * len(a & b) >= 80 * len(a | b) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def passages(seed, n):
    """Texts around the threshold: a passage, or most of it, and words of their own that some share; two passages, so that classes mix."""
    rng = random.Random(seed)
    make = lambda k: [rng.choice(WORDS) for _ in range(k)]
    shared, tails = [make(100), make(60)], [make(k) for k in (8, 12, 16, 20)]
    out = []
    for _ in range(n):
        p = list(rng.choice(shared))
        if rng.random() < 0.3:
            p = p[rng.randint(0, 6) :]
        if rng.random() < 0.2:
            p[rng.randrange(len(p))] = "odd"
        if rng.random() < 0.1:
            p = p + shared[1]
        own = make(rng.choice([0, 3, 8, 9, 10, 11, 12, 13, 25]))
        out.append(" ".join(own + p + (rng.choice(tails) if rng.random() < 0.5 else [])))
    return out


@pytest.mark.parametrize("seed, max_pairs", [(1, -1), (3, 40)])
def test_components(spark, seed, max_pairs):
    texts = passages(seed, 70)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in partenum.near_duplicates(docs, max_pairs=max_pairs).collect()}
    want = plain_components(texts)
    assert [got[i] for i in range(len(texts))] == want and 5 < len(set(want)) < 65


def test_a_passage_of_many_texts_leaves_no_pairs(spark, monkeypatch):
    """Texts that share a passage too short to link them: their group is told apart without pairs."""
    rng = random.Random(7)
    words = [f"x{k}" for k in range(20_000)]
    passage = [rng.choice(words) for _ in range(200)]
    texts = [" ".join([rng.choice(words) for _ in range(15)] + passage + [rng.choice(words) for _ in range(15)]) for _ in range(700)]
    texts += [t.replace(t.split()[0], "changed", 1) for t in texts[:5]]
    sizes = []
    monkeypatch.setattr(partenum, "_paired", lambda members, label, *a, f=partenum._paired: sizes.append(members.count()) or f(members, label, *a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in partenum.near_duplicates(docs, max_pairs=10_000).collect()}
    assert all(got[i] == (i if i < 700 else i - 700) for i in got)
    assert len(sizes) == 2 and sizes[1] < 20
