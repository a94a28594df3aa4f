"""Merkle manifest of a dataset: one tree for each group of rows, one over the groups' roots, and a proof for every row.

Rows of a group ascend by a key; every ``FAN`` consecutive nodes become one until one is left, the
group's subroot (a lone row is its own). Subroots, in the order of their groups, make the root alike.
A row's proof is a list of (left, right) sibling digests from its own run up to the root.

Proofs come from pointer jumping. Every inner node starts with a pointer to its parent and the
segment of its siblings there; a join of the pointers with themselves replaces the parent by the
parent's ancestor and appends its segment, which doubles the distance, until all point past the
root. Rows make the first step inside their own run, which their parent holds, so that only
the tree's inner nodes (a seventh of the rows) are joined.

Rows are placed by ranges of (group, key), so a group may fill any number of tasks; what is sent
to all tasks is measured first (``Scratch.beside``).

Edge cases: a null group is a group of its own and comes first; null keys come first in theirs; rows
with equal keys go by their digests, and rows equal in both are interchangeable; an empty table
gives no rows; null and empty values have different digests; texts count by their UTF-8 bytes,
whatever their length; columns that are not named play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .storage import Scratch

FAN = 8
#: The tree over the groups' subroots; groups are numbered from 0.
TOP = -1
NODE = ["tree", "level", "pos"]
UP = ["up_tree", "up_level", "up_pos"]
SEGMENT = "array<struct<left:binary,right:binary>>"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def record_digest(*values: Column) -> Column:
    """SHA-256 of the fields, one after the other, as binary."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def as_text(digests: Column) -> Column:
    """One or more digests as lower-case hex text."""
    return F.lower(F.hex(digests))


def node_digest(*digests: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[as_text(d) for d in digests]), 256))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda node, step: node_digest(step["left"], node, step["right"]))


def joined(digests: Column) -> Column:
    """Digests of an array, one after the other; empty for none."""
    return F.aggregate(digests, F.lit(b""), lambda whole, one: F.concat(whole, one))


def siblings(kids: Column, place: Column) -> Column:
    """The digests left and right of a place (from 1) among a run's nodes."""
    digests = F.transform(kids, lambda k: k["digest"])
    return F.struct(joined(F.slice(digests, F.lit(1), place - 1)).alias("left"), joined(F.slice(digests, place + 1, F.lit(FAN))).alias("right"))


def numbered(scratch: Scratch, rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Rows numbered from 0 in a global order, saved: dealt by ranges, numbered within each, shifted by the sizes of those before."""
    schema = StructType([*rows.schema.fields, StructField("__range", LongType()), StructField("__place", LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            places = pa.array(range(seen, seen + b.num_rows), pa.int64())
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int64()), places], [*b.schema.names, "__range", "__place"])

    placed = scratch.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema))
    before, total = {}, 0
    for r in sorted(placed.groupBy("__range").count().collect()):  # one row per range
        before[r[0]], total = total, total + r[1]
    shifts = placed.sparkSession.createDataFrame(sorted(before.items()), "__range long, __before long")
    return placed.join(F.broadcast(shifts), "__range").withColumn(out, F.col("__place") + F.col("__before")).drop("__range", "__place", "__before")


def parents(nodes: DataFrame, *carried: str) -> DataFrame:
    """One row for every ``FAN`` consecutive nodes of a tree: tree, pos, n (nodes of its level), digest and the nodes in order as ``kids``.

    nodes: tree, pos, n, digest. The one node of a tree that has no other keeps its digest.
    """
    kids = F.array_sort(F.collect_list(F.struct("pos", "digest", *carried)))
    runs = nodes.groupBy("tree", F.expr(f"pos div {FAN}").alias("pos")).agg(F.first("n").alias("was"), kids.alias("kids"))
    text = F.array_join(F.transform("kids", lambda k: as_text(k["digest"])), "")
    digest = F.when(F.col("was") == 1, F.col("kids")[0]["digest"]).otherwise(F.unhex(F.sha2(text, 256)))
    return runs.select("tree", "pos", F.expr(f"(was + {FAN - 1}) div {FAN}").alias("n"), "was", digest.alias("digest"), "kids")


def climb(scratch: Scratch, nodes: DataFrame, most: int, level: int) -> tuple[DataFrame | None, DataFrame, int]:
    """(pointers to parents, the last node of every tree with its level, levels made) from the nodes of one level; ``most`` nodes a tree at most."""
    pointers, tops, made = None, nodes.filter("n = 1").withColumn("level", F.lit(level)), 0
    while most > 1:
        runs = scratch.save(parents(nodes.filter("n > 1")))
        kid = runs.select("tree", "kids", F.col("pos").alias("up_pos"), F.posexplode("kids").alias("at", "kid"))
        step = kid.select("tree", F.lit(level).alias("level"), F.col("kid.pos").alias("pos"), F.col("tree").alias("up_tree"), F.lit(level + 1).alias("up_level"), "up_pos", F.array(siblings(F.col("kids"), F.col("at") + 1)).cast(SEGMENT).alias("segment"))
        pointers = step if pointers is None else pointers.unionByName(step)
        nodes, level, most, made = runs.select("tree", "pos", "n", "digest"), level + 1, -(-most // FAN), made + 1
        tops = tops.unionByName(nodes.filter("n = 1").withColumn("level", F.lit(level)))
    return pointers, tops.select("tree", "level", "digest"), made


def jump(scratch: Scratch, pointers: DataFrame, least: int) -> DataFrame:
    """Every pointer joined with that of the node it leads to: twice the distance, both segments. Targets lie at ``least`` or in the top tree."""
    live, done = pointers.filter("up_level is not null"), pointers.filter("up_level is null")
    ahead = pointers.filter((F.col("level") >= least) | (F.col("tree") == TOP)).select(*[F.col(a).alias(b) for a, b in zip(NODE, UP, strict=True)], *[F.col(c).alias(f"next_{c}") for c in UP], F.col("segment").alias("more"))
    met = live.join(scratch.beside(ahead), UP, "left")
    both = F.concat("segment", F.coalesce("more", F.array().cast(SEGMENT))).alias("segment")
    return scratch.save(met.select(*NODE, *[F.col(f"next_{c}").alias(c) for c in UP], both).unionByName(done.select(*NODE, *UP, "segment")))


def prove(leaves: DataFrame, group: str, key: str, digest: str, carry: list[str]) -> DataFrame:
    """One row per leaf: key, the carried columns, leaf, subroot, root (binary) and its proof, an array of (left, right) from the leaf's run to the root.

    leaves: the group and key, the leaf's digest as binary, and columns to carry.
    """
    scratch = Scratch(leaves.sparkSession)
    own = leaves.select(F.col(group).alias("group"), F.col(digest).alias("digest"), F.struct(F.col(key).alias("key"), *carry).alias("item"), F.monotonically_increasing_id().alias("salt"))
    rows = scratch.save(own)
    placed = numbered(scratch, rows, [F.col("group"), F.col("item.key"), F.col("digest"), F.col("salt")], "at").drop("salt")
    groups = placed.groupBy("group").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    groups = numbered(scratch, groups, [F.col("group")], "tree")
    sizes = groups.agg(F.max("n"), F.count("*")).first()
    known = scratch.beside(groups.withColumnRenamed("group", "__group"))
    nodes = placed.join(known, F.col("group").eqNullSafe(F.col("__group"))).select("tree", (F.col("at") - F.col("first")).alias("pos"), "n", "digest", "item")
    runs = scratch.save(parents(nodes, "item"))

    inner, subroots, high = climb(scratch, runs.select("tree", "pos", "n", "digest"), -(-(sizes[0] or 0) // FAN), 1)
    subroots = scratch.save(subroots)
    upper, root, wide = climb(scratch, subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(sizes[1]).cast("long").alias("n"), "digest"), sizes[1], 0)
    ends = subroots.select("tree", "level", F.lit(0).cast("long").alias("pos"))
    if upper is None:
        ends = ends.select("*", *[F.lit(None).cast(t).alias(c) for c, t in zip(UP, ("long", "int", "long"), strict=True)], F.array().cast(SEGMENT).alias("segment"))
    else:
        ends = ends.join(upper.filter("level = 0").select(F.col("pos").alias("tree"), *UP, "segment"), "tree")
        ends = ends.unionByName(upper.filter("level > 0"))
    pointers = scratch.save(ends if inner is None else inner.unionByName(ends))
    distance = 1
    while distance < high + wide:
        pointers = jump(scratch, pointers, 1 + distance)
        distance *= 2

    paths = pointers.filter((F.col("level") == 1) & (F.col("tree") != TOP)).select("tree", "pos", "segment")
    whole = runs.join(paths, ["tree", "pos"]).join(scratch.beside(subroots.select("tree", F.col("digest").alias("subroot"))), "tree")
    each = whole.select("was", "segment", "kids", "subroot", F.posexplode("kids").alias("place", "kid"))
    first = F.when(F.col("was") > 1, F.array(siblings(F.col("kids"), F.col("place") + 1))).otherwise(F.array()).cast(SEGMENT)
    last = root.first()
    return each.select(F.col("kid.item.key").alias(key), *[F.col(f"kid.item.{c}").alias(c) for c in carry], F.col("kid.digest").alias("leaf"), "subroot", F.lit(bytes(last["digest"]) if last else None).cast("binary").alias("root"), F.concat(first, "segment").alias("proof"))
