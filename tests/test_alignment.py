"""Local alignment against a plain recursion, and the maps made of it."""

import random
from functools import lru_cache

import pytest

from spark_rri.operators import alignment as al
from spark_rri.operators import joins
from spark_rri.sources.alignments import read_score_matrix

TABLE = al.score_table()


def best_score(a, b, opening, extension):
    """Best local score by trying every gap length in every cell."""

    @lru_cache(None)
    def at(i, j):
        if i < 0 or j < 0:
            return 0.0
        down = [at(i - k, j) - opening - (k - 1) * extension for k in range(1, i + 1)]
        side = [at(i, j - k) - opening - (k - 1) * extension for k in range(1, j + 1)]
        return max([0.0, at(i - 1, j - 1) + TABLE[ord(a[i]), ord(b[j])], *down, *side])

    return max((at(i, j) for i in range(len(a)) for j in range(len(b))), default=0.0)


def score_of(a, b, at_a, at_b, opening, extension):
    total = sum(TABLE[ord(a[i]), ord(b[j])] for i, j in zip(at_a, at_b))
    for (p, q), (i, j) in zip(zip(at_a, at_b), list(zip(at_a, at_b))[1:]):
        for gap in (i - p - 1, j - q - 1):
            total -= opening + (gap - 1) * extension if gap else 0
    return total


@pytest.mark.parametrize("opening,extension", [(11.0, 0.5), (3.0, 1.0), (2.0, 2.0)])
def test_align_is_optimal(opening, extension):
    rng = random.Random(3)
    for _ in range(150):
        a = "".join(rng.choice("ACDX") for _ in range(rng.randint(0, 14)))
        b = "".join(rng.choice("ACDX") for _ in range(rng.randint(0, 14)))
        if rng.random() < 0.5 and len(a) > 4:
            b = a[: len(a) // 2] + b[:3] + a[len(a) // 2 + 1 :]
        got, at_a, at_b = al.align(a, b, TABLE, opening, extension)
        assert got == best_score(a, b, opening, extension)
        assert got == score_of(a, b, at_a, at_b, opening, extension)
        assert at_a == sorted(set(at_a)) and at_b == sorted(set(at_b)) and len(at_a) == len(at_b)


def test_pairs_together_as_alone():
    """Pairs of mixed lengths in one batch give what each gives by itself, empty ones too."""
    rng = random.Random(8)
    pairs = [("".join(rng.choice("ACDEKLMX") for _ in range(rng.choice([0, 1, 3, 20, 60]))), "".join(rng.choice("ACDEKLMX") for _ in range(rng.choice([0, 1, 5, 25, 50])))) for _ in range(120)]
    together = al.align_many([a for a, _ in pairs], [b for _, b in pairs], TABLE, 11.0, 0.5)
    assert together == [al.align(a, b, TABLE, 11.0, 0.5) for a, b in pairs]
    cut = list(al.in_batches(pairs, 5_000))
    assert sorted(p for part in cut for p in part) == sorted(pairs)
    assert all(len(part) == 1 or len(part) * max(len(a) for a, _ in part) * max(len(b) for _, b in part) <= 5_000 for part in cut)


def test_published_scores():
    assert TABLE[ord("W"), ord("W")] == 11 and TABLE[ord("F"), ord("Y")] == 3 and TABLE[ord("G"), ord("I")] == -4 and TABLE[ord("X"), ord("C")] == TABLE[ord("B"), ord("C")] == -2
    letters = [ord(c) for c in "ARNDCQEGHILKMFPSTWYV"]
    part = TABLE[letters][:, letters]
    assert (part == part.T).all() and part.diagonal().sum() == 116 and (part.diagonal() > part.max(axis=1, where=~(part == part.diagonal()), initial=-9)).all()


def test_sequence_map(spark):
    base = "MKTAYIAKQRQISFVKSHFSRQ"
    rows = [(1, base, base), (2, base[:10] + base[11:], base), (3, None, base), (4, "X" * 22, base), (5, base[:8], base), (6, base, base), (2, base[:10] + base[11:], base), (7, "", "")]
    got = al.sequence_map(spark.createDataFrame(rows, "id int, a string, b string"), "a", "b").collect()
    assert len(got) == 8
    by = {r.id: r for r in got}
    assert by[1].a_index == by[1].b_index == list(range(22)) and by[1].identity == 1.0 and by[1].reason is None
    assert by[2].reason is None and by[2].a_index == list(range(21)) and by[2].b_index == [*range(10), *range(11, 22)] and by[2].identity == 21 / 22
    assert {k: by[k].reason for k in (3, 4, 5, 6, 7)} == {3: "no sequence", 4: "too many X", 5: "length", 6: None, 7: "no sequence"}
    assert al.sequence_map(spark.createDataFrame([], "id int, a string, b string"), "a", "b").count() == 0
    maps = al.sequence_map(spark.createDataFrame(rows[:2], "id int, a string, b string"), "a", "b")
    assert al.residue_map(maps, ["id"]).count() == 43 and al.homologous(maps).count() == 2


def test_counterpart(spark):
    chains = spark.createDataFrame([("c", "A", "U", "ACDEFGHI", "ACDEFGHI"), ("c", "A", "V", "ACDEFGHI", "ACDEFGHI")], "complex_id string, bound string, unbound string, a string, b string")
    maps = al.sequence_map(chains, "a", "b")
    line = lambda chain, shift: [("c", chain, k, float(k), 0.0, shift) for k in range(8)]
    schema = "complex_id string, chain string, place int, x double, y double, z double"
    cells = al.counterpart_cells(maps, "complex_id", "bound", "unbound", spark.createDataFrame(line("A", 0.0), schema), spark.createDataFrame(line("U", 2.0) + line("V", 1.0), schema))
    assert {(r.unbound, r.rmsd, r.n_mapped) for r in cells.collect()} == {("U", 2.0, 8), ("V", 1.0, 8)}
    assert [(r.bound, r.unbound) for r in joins.greedy_match(cells, "complex_id", "bound", "unbound", "rmsd", 1.5).collect()] == [("A", "V")]


def test_score_matrix(spark, tmp_path):
    path = tmp_path / "matrix.txt"
    path.write_text("# scores\n   A  C\nA  4 -2\nC -2  9\n")
    scores = read_score_matrix(spark, str(path))
    assert scores == {("A", "A"): 4.0, ("A", "C"): -2.0, ("C", "A"): -2.0, ("C", "C"): 9.0}
    assert al.align("ACA", "ACA", al.score_table(scores), 11, 0.5)[0] == 17.0
