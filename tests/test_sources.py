"""Readers and writers on small files written here."""

import json

import pytest
from pyspark.sql import functions as F

from spark_rri.sources import alignments, profiles, sinks, structures, tables, text

ATOM = "{:6s}{:5d}  {:3s}{:1s}{:3s} {:1s}{:4d}{:1s}   {:8.3f}{:8.3f}{:8.3f}  1.00{:6.2f}          {:>2s}"


@pytest.fixture
def put(tmp_path):
    def write(name, body):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
        return str(tmp_path / name)

    return write


def pdb():
    return "\n".join([
        "MODEL        1",
        ATOM.format("ATOM", 1, "N", "", "ALA", "A", 5, "", 1.0, -2.0, 3.5, 9.0, "N"),
        ATOM.format("ATOM", 2, "CA", "", "ALA", "A", 5, "", 1.5, -2.0, 3.5, 9.0, "C"),
        ATOM.format("HETATM", 3, "O", "", "HOH", "A", 5, "", 7.0, 7.0, 7.0, 9.0, "O"),
        ATOM.format("ATOM", 4, "CA", "", "GLY", "A", 52, "A", 2.0, 0.0, 0.0, 9.0, "C"),
        ATOM.format("ATOM", 5, "CA", "", "GLY", "", 1, "", 2.0, 0.0, 0.0, 9.0, "C"),
        "MODEL        2",
        ATOM.format("ATOM", 1, "CA", "", "ALA", "A", 5, "", 0.0, 0.0, 0.0, 9.0, "C"),
        "END",
    ])


def test_pdb_models_blank_chains_and_repeated_numbers(spark, put):
    path = put("1abc_l_b.pdb", pdb())
    got = structures.read_pdb(spark, path).orderBy("line_no").collect()
    assert [(r.chain_id, r.res_id, r.atom_name, r.model) for r in got] == [("A", "5", "N", 1), ("A", "5", "CA", 1), ("A", "52A", "CA", 1), ("+", "1", "CA", 1)]
    assert (got[0].complex_id, got[0].partner, got[0].state, got[0].y) == ("1abc", "l", "b", -2.0)
    both = structures.read_pdb(spark, path, "all")
    assert [r.model for r in structures.select_models(both, [2, 1]).collect()] == [2, 1, 1, 1, 1]


def test_mmcif_gives_the_same_atoms(spark, put):
    names = ["group_PDB", "id", "type_symbol", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "Cartn_x", "Cartn_y", "Cartn_z", "B_iso_or_equiv", "auth_seq_id", "auth_asym_id", "pdbx_PDB_ins_code", "pdbx_PDB_model_num"]
    body = "data_x\nloop_\n" + "".join(f"_atom_site.{n}\n" for n in names) + "ATOM 1 C CA . ALA Z 1.0 2.0 3.0 9.0 5 A ? 1\nHETATM 2 O \"O5'\" . GLC Z 1.0 2.0 4.0 9.0 6 A B 1\n#\n"
    got = structures.read_mmcif(spark, put("1abc_r_b.cif", body)).orderBy("line_no").collect()
    assert [(r.chain_id, r.res_id, r.res_name, r.atom_name, r.hetflag, r.z) for r in got] == [("A", "5", "ALA", "CA", "", 3.0), ("A", "6B", "GLC", "O5'", "H", 4.0)]


def test_structure_round_trip_with_scores(spark, put, tmp_path):
    atoms = structures.read_pdb(spark, put("1abc_l_b.pdb", pdb()))
    scores = spark.createDataFrame([("1abc", "A", "5", 0.5)], "complex_id string, chain_id string, res_id string, prediction double")
    sinks.write_structures(sinks.with_scores_as_b_factor(atoms, scores), str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out" / "complex_id=1abc")).select("value").collect()
    assert sorted(float(r.value[60:66]) for r in back) == [0.0, 0.0, 0.5, 0.5]
    assert {r.value[21] for r in back} == {"A", " "} and {len(r.value) for r in back} == {78}


def test_fasta_rejects(spark, put, tmp_path):
    put("f/1abc_l_u.fasta", ">x\nac\nDE \n")
    put("f/1abc_r_u.fasta", ">x\nAC\n>y\nAC\n")
    put("f/2abc_l_u.fasta", ">x\n\n")
    put("f/2abc_r_u.fasta", ">x\nA1\n")
    good, bad = alignments.read_fasta(spark, str(tmp_path / "f"))
    assert [(r.complex_id, r.partner, r.sequence) for r in good.collect()] == [("1abc", "l", "ACDE")]
    assert sorted(r.reason for r in bad.collect()) == ["letter outside the alphabet", "no sequence", "several records"]


def test_a3m(spark, put):
    got = alignments.read_a3m(spark, put("x.a3m", ">q\nAC\nDE\n>h1 OS=Homo sapiens GN=X\nA-\n>h2 thing [Mus musculus]\n")).orderBy("position").collect()
    assert [(r.taxon, r.sequence) for r in got] == [(None, "ACDE"), ("Homo sapiens", "A-"), ("Mus musculus", "")]


def test_hits(spark, put):
    body = "Query= q\nLength=20\nResults from round 1\n\n>t1 name\nLength=30\n\n Score = 10 bits (5),  Expect = 2e-05, Method\n Identities = 9/18 (50%), Positives = 9/18\n\nQuery  2   ACDEF-  6\n           ACD\nSbjct  11  ACDEFG  16\n\nQuery  7   ACDEFGHIKLMN  18\n\nSbjct  17  ACDEFGHIKLMN  28\n\n>t2 other\n Score = 1 bits (1),  Expect = e-100\n Identities = 18/18 (100%)\n\nQuery  1   AC  2\n\nSbjct  1   AC  2\n"
    hits = alignments.read_hits(spark, put("x.psi", body))
    got = {r.target_id: r for r in hits.collect()}
    one = got["t1"]
    assert (one.round, one.query_length, one.query_start, one.query_end, one.target_start, one.target_end, one.identity) == (1, 20, 2, 18, 11, 28, 50.0)
    assert one.query_seq == "ACDEF-ACDEFGHIKLMN" and got["t2"].evalue == 1e-100
    assert [r.target_id for r in alignments.good_hits(hits).collect()] == ["t1"]


def test_profiles(spark, put):
    body = "\nLast position\n   A R\n    1 M  " + " ".join(map(str, range(20))) + " " + " ".join(["5"] * 20) + "  0.5 inf\n\nK Lambda\n"
    row = profiles.read_pssm(spark, put("x.pssm", body)).first()
    assert (row.seq_idx, row.letter, row.pssm[19], row.psfm[0], row.ipp) == (0, "M", 19.0, 5.0, 0.5)
    body = "HHM\n#\nNULL 1\nHMM A C\n M->M\n 0 * *\nM 1 " + "* " * 20 + "7\n    " + "1 " * 10 + "\n\n//\n"
    row = profiles.read_hhm(spark, put("x.hhm", body)).first()
    assert (row.letter, len(row.profile), row.profile[0], row.profile[20], row.profile[30]) == ("M", 31, -1.0, 7.0, 1.0)
    assert [tuple(r)[1:] for r in profiles.read_conservation(spark, put("x.al2co", "1 A 0.5\n2 C -0.25\n* end\n")).orderBy("seq_idx").collect()] == [(0, "A", 0.5), (1, "C", -0.25)]
    assert tuple(profiles.read_predicted_surface(spark, put("x.spd3", "# AA\n1 E C 135.0 -89.3 131.8 116.5 -113.0 0.977 0.010 0.011\n")).first())[1:] == (0, "E", 135.0, 0.977, 0.01, 0.011)
    body = "h\n" * 8 + "* 1 2 3 4 5 10A ALA " + " ".join(map(str, range(23))) + "\nA 1 2 3 4 5 11 HOH " + " ".join(map(str, range(23))) + "\n"
    rows = profiles.read_surface(spark, put("x.tbl", body)).collect()
    assert [(r.chain_id, r.res_id, r.res_name, r.total_ASA, r.Hydrophobicity) for r in rows] == [("+", "10A", "A", 0.0, 22.0)]
    assert [tuple(r)[1:] for r in profiles.read_coupling_matrix(spark, put("x.mat", "0 1.5\n2 0\n")).orderBy("i", "j").collect()] == [(0, 0, 0.0), (0, 1, 1.5), (1, 0, 2.0), (1, 1, 0.0)]
    assert [tuple(r)[1:] for r in profiles.read_coupling_triples(spark, put("x.psicov", "1 3 0.5\n")).collect()] == [(0, 2, 0.5)]


def test_feature_tables(spark, put, tmp_path):
    put("t/a.tab", "#Levels: s=H;E\n# note\nchainId resId v\nA 1 0.5\nA 2 NaN\nA 3\n")
    put("t/b.tab", "resId chainId v\n7 B x\n")
    path = str(tmp_path / "t")
    got = tables.read_feature_table(spark, path, types={"v": "double"}).orderBy("resId").collect()
    assert [(r.chainId, r.resId, str(r.v)) for r in got] == [("A", "1", "0.5"), ("A", "2", "nan"), ("B", "7", "None")]
    assert [r.line for r in tables.bad_lines(spark, path).collect()] == ["A 3"]
    assert [(r.column, r.levels) for r in tables.read_levels(spark, path).collect()] == [("s", ["H", "E"])]
    with pytest.raises(ValueError):
        tables.table_columns(spark, put("empty.tab", "# nothing\n"))


def test_lists(spark, put):
    got = tables.read_families(spark, put("f.tab", "# x\n1abc A;B C f1:f2;f3 f4\n"))
    assert sorted((r.side, r.chain, r.family) for r in got.collect()) == [("L", "A", "f1"), ("L", "A", "f2"), ("L", "B", "f3"), ("R", "C", "f4")]
    good, bad = tables.read_pair_list(spark, put("p.csv", "# x\n1acb:E,1acb:I\nnonsense\n"))
    assert [(r.ligand.chain, r.receptor.chain) for r in good.collect()] == [("E", "I")] and [r.line for r in bad.collect()] == ["nonsense"]
    got = tables.read_poses(spark, put("d.txt", "x\n # | score | pen.| rmsd | trans\n 1 | 120 | -1 | 0 | 1 2 3 4 5 6\n 2 | 90 | -1 | 0 | 1 2 3 4 5 6\n"), top=1).collect()
    assert [(r.rank, r.score, r.translation) for r in got] == [(1, 120.0, [4.0, 5.0, 6.0])]
    log = "noise\n   pdb auc_pair prec_50\n0 1abc 0.5 0.1\n   pdb auc_pair prec_50\n0 1abc 0.75 0.2\n pdb auc_pair prec_50\n0 2abc 0.25 0.4\n"
    got = tables.with_mean_row(tables.read_log_metrics(spark, put("log", log))).collect()
    assert [(r.complex_id, r.auc_pair) for r in got] == [("1abc", 0.75), ("2abc", 0.25), ("mean", 0.5)] and got[0].mcc_bs is None


def test_folds_round_trip(spark, put, tmp_path):
    folds = tables.read_folds(spark, put("folds.json", json.dumps([{"train": ["1abc"], "test": ["2ABC"]}, {"train": ["2ABC"], "test": []}])))
    assert sorted(map(tuple, folds.collect())) == [(0, "test", "2ABC"), (0, "train", "1abc"), (1, "train", "2ABC")]
    assert [r[0] for r in tables.uncovered(folds, folds).collect()] == ["1abc"]
    sinks.write_folds(folds, str(tmp_path / "out"), copies=2)
    got = spark.read.json(str(tmp_path / "out")).orderBy("fold").collect()
    assert [(r.train, r.test) for r in got] == [(["1abc", "1abc-1", "1abc-2"], ["2ABC"]), (["2ABC"], [])]


def test_complete_inputs(spark):
    files = spark.createDataFrame([(f"/x/{n}",) for n in ("1abc_l_b.pdb", "1abc_r_b.pdb", "2abc_l_b.pdb", "3abc_l_b.pdb", "3abc_r_b.pdb", "3abc_l_u.pdb", "junk.pdb")], "file string")
    good, bad = text.complete_inputs(text.with_file_keys(files))
    assert [r.complex_id for r in good.collect()] == ["1abc"]
    assert {r.complex_id: r.reason for r in bad.collect()} == {"2abc": "bound partner missing", "3abc": "unbound partner missing", "/x/junk.pdb": "name does not match"}


def test_result_and_sequence_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([("x", "A", "1", "G", "B", "2", "G", 1, 0.5), ("x", "A", "1", "G", "B", "3", "G", -1, None)], "complex_id string, chainIdL string, resIdL string, resNameL string, chainIdR string, resIdR string, resNameR string, categ int, prediction double")
    sites = spark.createDataFrame([("x", "A", "1", 1, 2.0)], "complex_id string, chainId string, resId string, categ int, prediction double")
    sinks.write_results(pairs, sites, sites, str(tmp_path / "r"), with_category=False)
    got = tables.read_results(spark, str(tmp_path / "r/pairs/complex_id=x")).orderBy("resIdR").collect()
    assert [(r.resIdR, r.categ, str(r.prediction)) for r in got] == [("2", None, "0.5"), ("3", None, "nan")]
    assert sinks.large_enough(pairs, ["complex_id"], 2).count() == 0 and sinks.large_enough(pairs, ["complex_id"], 1).count() == 2
    residues = spark.createDataFrame([("x", "l", "A", "2", "C", 1), ("x", "l", "A", "1", "G", 0)], "complex_id string, partner string, chain_id string, res_id string, res_name string, seq_idx int")
    sinks.write_sequences(residues, str(tmp_path / "s"))
    assert [r.value for r in spark.read.text(str(tmp_path / "s/fasta")).collect()] == [">x_l_A", "GC"]
    lineage = spark.createDataFrame([("x", "b"), ("x", "a")], "complex_id string, train_id string")
    sinks.write_lineage(lineage, str(tmp_path / "l"))
    assert sinks.read_lineage(spark, str(tmp_path / "l")).first().trained_on == ["a", "b"]
    sinks.write_codified(pairs, pairs.filter("categ = 1"), str(tmp_path / "c"))
    assert {r["variant"]: r["count"] for r in spark.read.parquet(str(tmp_path / "c")).groupBy("variant").count().collect()} == {"all": 2, "sampled": 1}
    sinks.write_curve(spark.range(2).select((F.col("id") / 2).alias("threshold"), F.lit(1.0).alias("precision")), str(tmp_path / "k"))
    assert spark.read.json(str(tmp_path / "k")).count() == 2


def test_models_of_one_file_are_read_by_several_tasks(spark, tmp_path):
    """A file of 60 models, split at them: the same atoms as in one piece, each model in one task."""
    atom = lambda k, x: f"ATOM  {k:5d}  CA  GLY A{k:4d}    {x:8.3f}{0.0:8.3f}{0.0:8.3f}  1.00  0.00           C"
    models = [f"MODEL {m:8d}\n" + "\n".join(atom(k, m + k / 10) for k in range(1, 40)) + "\nENDMDL" for m in range(1, 61)]
    for name, head, end in (("1abc_l_b.pdb", "HEADER    X\n", "\n"), ("2abc_l_b.pdb", "", "\r\n")):
        (tmp_path / name).write_bytes((head + "\n".join(models) + "\nEND\n").replace("\n", end).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        atoms = structures.read_pdb(spark, str(tmp_path), "all")
        pieces = structures.model_lines(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).groupBy("file", "model").agg(F.count_distinct("task").alias("n"), F.min("task").alias("task")).collect()
        got = sorted((r["complex_id"], r["model"], r["res_seq"], r["x"]) for r in atoms.collect())
        first = structures.read_pdb(spark, str(tmp_path)).select("model").distinct().collect()
        chosen = [(r["model"], r["res_seq"]) for r in structures.select_models(atoms.filter("complex_id = '1abc'"), [60, 2]).collect()]
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{key}")
    assert got == [(c, m, k, round(m + k / 10, 3)) for c in ("1abc", "2abc") for m in range(1, 61) for k in range(1, 40)]
    assert len({r["task"] for r in pieces}) > 5 and {r["n"] for r in pieces if r["model"]} == {1}
    assert [r["model"] for r in first] == [1]
    assert chosen == [(m, k) for m in (60, 2) for k in range(1, 40)]
