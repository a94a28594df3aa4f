"""Structure files as one table of atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import residue_id
from .text import in_file, lines, with_file_keys, words

ATOM_COLUMNS = ["file", "complex_id", "partner", "state", "model", "chain_id", "res_seq", "i_code", "res_id", "res_name", "hetflag", "atom_name", "element", "altloc", "x", "y", "z", "b_factor", "line_no"]
#: First column and width of each field of an ATOM line.
FIELDS = {"atom_name": (13, 4), "altloc": (17, 1), "res_name": (18, 3), "chain_id": (22, 1), "res_seq": (23, 4), "i_code": (27, 1), "x": (31, 8), "y": (39, 8), "z": (47, 8), "b_factor": (61, 6), "element": (77, 2)}
#: Where an mmCIF atom table has the same fields.
CIF_FIELDS = {"atom_name": "auth_atom_id", "altloc": "label_alt_id", "res_name": "auth_comp_id", "chain_id": "auth_asym_id", "res_seq": "auth_seq_id", "i_code": "pdbx_PDB_ins_code", "x": "Cartn_x", "y": "Cartn_y", "z": "Cartn_z", "b_factor": "B_iso_or_equiv", "element": "type_symbol"}
#: Fields that have another name where the author gave none.
CIF_ELSE = {"auth_atom_id": "label_atom_id", "auth_comp_id": "label_comp_id", "auth_asym_id": "label_asym_id", "auth_seq_id": "label_seq_id"}


def _finished(raw: DataFrame, models: str) -> DataFrame:
    """Types, keys, the wanted models, and the first of residues that repeat a number."""
    number = {c: F.expr(f"try_cast({c} as double)") for c in ("x", "y", "z", "b_factor")}
    atoms = raw.withColumns(number | {"res_seq": F.expr("try_cast(res_seq as int)"), "chain_id": F.when(F.col("chain_id") == "", "+").otherwise(F.col("chain_id"))})
    atoms = with_file_keys(atoms.withColumn("res_id", residue_id(F.col("res_seq"), F.col("i_code"))))
    if models == "first":
        atoms = atoms.join(atoms.groupBy("file").agg(F.min("model").alias("model")), ["file", "model"])
    kind = F.struct("hetflag", "res_name")
    first = F.first(kind).over(in_file("model", "chain_id", "res_id"))
    return atoms.withColumn("kind", kind).withColumn("first_kind", first).filter("kind = first_kind").select(*ATOM_COLUMNS)


def model_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, model, line_no, line) of fixed-width structure files.

    Spark splits a file wherever a line begins with MODEL, so a file of many models is read by as many tasks as
    its size asks for and a task holds one model at a time. Lines before the first MODEL have model
    0; line_no ascends along the file, models by their numbers: 2 ** 32 a model and one a line.
    """
    parts = spark.read.text(path, lineSep="\nMODEL ").select(F.col("_metadata.file_path").alias("file"), F.regexp_replace(F.regexp_replace("value", "^MODEL ", ""), "\r\n?", "\n").alias("text"))
    number = F.expr("try_cast(trim(substring_index(text, '\n', 1)) as int)")
    rows = parts.select("file", F.coalesce(number, F.lit(0)).alias("model"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return rows.select("file", "model", (F.col("model").cast("long") * (1 << 32) + F.col("at")).alias("line_no"), "line")


def read_pdb(spark: SparkSession, path: str | list[str], models: str = "first") -> DataFrame:
    """Atoms of fixed-width structure files; models is ``first`` or ``all``.

    A blank chain is ``+``. Of residues that share number and insertion code in a chain the first stays.
    Lines without numbers where coordinates belong have NULL coordinates. Files of many models are split at them.
    """
    all_lines = model_lines(spark, path).filter("line rlike '^(ATOM  |HETATM)'")
    cut = {name: F.trim(F.substring("line", start, width)) for name, (start, width) in FIELDS.items()}
    return _finished(all_lines.withColumns(cut | {"hetflag": F.expr("case when line like 'HETATM%' then 'H' else '' end")}), models)


def read_mmcif(spark: SparkSession, path: str | list[str], models: str = "first") -> DataFrame:
    """The same atoms from mmCIF files; each file's own header gives the columns."""
    all_lines = lines(spark, path).filter(r"line rlike '^(_atom_site\\.|ATOM\\s|HETATM\\s)'")
    named = all_lines.filter("line like '\\_atom\\_site.%'").select("file", F.struct("line_no", F.trim(F.substring("line", 12, 80)).alias("name")).alias("item"))
    header = named.groupBy("file").agg(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["name"]).alias("names"))
    rows = all_lines.filter("line not like '\\_atom%'").withColumn("parts", words("line")).join(header, "file").filter("size(parts) = size(names)")
    rows = rows.withColumn("row", F.map_from_arrays("names", "parts"))

    def field(name: str):
        value = F.try_element_at("row", F.lit(name))
        if name in CIF_ELSE:
            value = F.coalesce(value, F.try_element_at("row", F.lit(CIF_ELSE[name])))
        return F.regexp_replace(F.when(value.isin(".", "?"), "").otherwise(value), "^[\"'](.*)[\"']$", "$1")

    cut = {name: F.coalesce(field(source), F.lit("")) for name, source in CIF_FIELDS.items()}
    more = {"model": F.coalesce(field("pdbx_PDB_model_num").cast("int"), F.lit(0)), "hetflag": F.expr("case when line like 'HETATM%' then 'H' else '' end")}
    return _finished(rows.withColumns(cut | more), models)


def select_models(atoms: DataFrame, models: list[int]) -> DataFrame:
    """The wanted models in the wanted order (column position); models that a file lacks give no rows."""
    wanted = atoms.sparkSession.createDataFrame(list(enumerate(models)), "position int, model int")
    return atoms.join(wanted, "model").orderBy("file", "position", "line_no")
