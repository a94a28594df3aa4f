"""Spatial operators over points: grid-binned range joins and what builds on them.

A range join bins space into cells of the cut-off's size; one side keeps its own cell, the
other is copied to the 27 cells around it, so the join is an equi join and never a nested loop.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import enough_parts, stored

AXES = ("x", "y", "z")
CELL = ("__cx", "__cy", "__cz")
#: Coordinates beyond, infinite ones among them, share the last cells.
LAST_CELL = float(1 << 61)


def distance2(a: str = "l", b: str = "r") -> Column:
    return sum((F.pow(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"), 2) for c in AXES[1:]), F.pow(F.col(f"{a}.x") - F.col(f"{b}.x"), 2))


def range_join(left: DataFrame, right: DataFrame, cutoff: float, keys: list[str], condition: Column | None = None, strict: bool = False, parts: int | None = None) -> DataFrame:
    """Pairs (aliases l and r) of equal keys within the cut-off; strict excludes the cut-off itself. parts: tasks, where a few rows make many pairs."""
    at = lambda c: F.when(F.col(c).isNotNull(), F.floor(F.least(F.greatest(F.col(c) / cutoff, F.lit(-LAST_CELL)), F.lit(LAST_CELL))))
    own, spread = left.withColumns({n: at(c) for n, c in zip(CELL, AXES, strict=True)}), right
    for n, c in zip(CELL, AXES, strict=True):
        spread = spread.withColumn(n, F.explode(F.array(*[at(c) + k for k in (-1, 0, 1)])))
    if parts:
        own, spread = (side.repartition(parts, *keys, *CELL) for side in (own, spread))
    l, r = own.alias("l"), spread.alias("r")
    on = F.lit(True)
    for k in [*keys, *CELL]:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    d2 = distance2()
    near = d2 < cutoff * cutoff if strict else d2 <= cutoff * cutoff
    on = on & near
    return l.join(r, on if condition is None else on & condition)


def contact_pairs(points: DataFrame, cutoff: float, key: str = "complex_id", partner: str = "partner", node: str = "node") -> DataFrame:
    """Distinct (key, node of the left partner, node of the right) with any two points within the cut-off."""
    l, r = points.filter(F.col(partner) == 0), points.filter(F.col(partner) == 1)
    return range_join(l, r, cutoff, [key]).select(F.col(f"l.{key}").alias(key), F.col(f"l.{node}").alias("node_l"), F.col(f"r.{node}").alias("node_r")).distinct()


def neighbour_edges(points: DataFrame, cutoff: float, keys: list[str], node: str = "node") -> DataFrame:
    """Both directions of all pairs of different nodes within the cut-off, with their distance."""
    return neighbours_of(points, points, cutoff, keys, node)


def neighbours_of(some: DataFrame, points: DataFrame, cutoff: float, keys: list[str], node: str = "node") -> DataFrame:
    """Edges from some points to other nodes within the cut-off, with their distance."""
    pairs = range_join(some, points, cutoff, keys, F.col(f"l.{node}") != F.col(f"r.{node}"))
    return pairs.select(*[F.col(f"l.{k}").alias(k) for k in keys], F.col(f"l.{node}").alias("src"), F.col(f"r.{node}").alias("dst"), F.sqrt(distance2()).alias("dist"))


#: Coordinates of this many cut-offs are beyond the cells of ``linking_edges``.
FAR = float(1 << 30)


def linking_edges(points: DataFrame, cutoff: float, keys: list[str], node: str = "node") -> DataFrame:
    """Edges (keys, src, dst) that connect just what ``neighbour_edges`` connects: one for a point and some for a cell, not all pairs.

    A cell's diagonal is the cut-off, so its points are tied to the least of them; cells that hold a pair within the cut-off
    are tied by their least nodes, found inside the join. Points too far out for exact cells have all their edges.
    Cells are merged, not sent to all tasks through the driver.
    """
    size = cutoff / math.sqrt(3) * (1 - 1e-9)
    given = points.select(*keys, node, *AXES).dropna()
    far = F.greatest(*[F.abs(F.col(c)) for c in AXES]) >= FAR * cutoff  # NaN is the greatest
    cell = [*keys, *CELL]
    placed = given.filter(~far).withColumns({n: F.floor(F.col(c) / size) for n, c in zip(CELL, AXES, strict=True)})
    tied = stored(placed.join(placed.groupBy(*cell).agg(F.min(node).alias("__least")).hint("merge"), cell))
    inside = tied.select(*keys, F.col("__least").alias("src"), F.col(node).alias("dst"))
    ahead = [w for w in itertools.product(range(-2, 3), repeat=3) if w > (0, 0, 0)]
    ways = F.explode(F.array(*[F.struct(*[F.lit(k).alias(n) for k, n in zip(w, CELL, strict=True)]) for w in ahead])).alias("__way")
    asks = tied.select("*", ways).withColumns({n: F.col(n) + F.col(f"__way.{n}") for n in CELL}).drop("__way")
    met = asks.alias("l").join(tied.alias("r").hint("merge"), [F.col(f"l.{c}") == F.col(f"r.{c}") for c in cell]).filter(distance2() <= cutoff * cutoff)
    across = met.select(*[F.col(f"l.{k}").alias(k) for k in keys], F.col("l.__least").alias("src"), F.col("r.__least").alias("dst")).distinct()
    out = neighbours_of(given.filter(far), given.hint("merge"), cutoff, keys, node).drop("dist")
    return inside.filter("src != dst").unionByName(across).unionByName(out)


def contact_number(points: DataFrame, cutoff: float, keys: list[str], node: str = "node") -> DataFrame:
    """Per node, the other nodes within the cut-off; 0 without any."""
    n = neighbour_edges(points, cutoff, keys, node).groupBy(*keys, F.col("src").alias(node)).agg(F.count("*").alias("n"))
    return points.select(*keys, node).join(n, [*keys, node], "left").select(*keys, node, F.coalesce("n", F.lit(0)).alias("contact_number"))


def half_sphere_counts(points: DataFrame, cutoff: float, keys: list[str], axis: tuple[str, str, str], node: str = "node") -> DataFrame:
    """Neighbours on either side of the plane through a node, across its axis vector; -1 where the axis is undefined."""
    pairs = range_join(points, points, cutoff, keys, F.col(f"l.{node}") != F.col(f"r.{node}"))
    dot = sum(((F.col(f"r.{c}") - F.col(f"l.{c}")) * F.col(f"l.{a}") for c, a in zip(AXES[1:], axis[1:], strict=True)), (F.col("r.x") - F.col("l.x")) * F.col(f"l.{axis[0]}"))
    n = pairs.select(*[F.col(f"l.{k}").alias(k) for k in keys], F.col(f"l.{node}").alias(node), dot.alias("dot")).groupBy(*keys, node).agg(F.count_if(F.col("dot") > 0).alias("up"), F.count_if(F.col("dot") <= 0).alias("down"))
    out = points.join(n, [*keys, node], "left")
    undefined = F.greatest(*[F.abs(F.col(a)) for a in axis]).isNull()
    return out.select(*keys, node, *[F.when(undefined, -1).otherwise(F.coalesce(c, F.lit(0))).alias(f"n_{c}") for c in ("up", "down")])


def trace_axes(trace: DataFrame, part: list[str], order: list[str], names: tuple[str, str, str] = ("ax", "ay", "az")) -> DataFrame:
    """Axis of every place of a chain from its trace alone: the sum of the ways from both neighbours to it; NULL at the ends.

    For ``half_sphere_counts`` where side chains are unknown.
    """
    w = Window.partitionBy(*part).orderBy(*order)
    return trace.withColumns({n: 2 * F.col(c) - F.lag(c).over(w) - F.lead(c).over(w) for n, c in zip(names, AXES, strict=True)})


#: Finest level of nested cells (each level halves them), children that a point's own cell must have, and how many levels above that it looks at.
LEVELS, CHILDREN, ABOVE = 20, 3, 3
#: Points whose pairs are made in one task.
POINTS_A_TASK = 250
#: By so much must a third point lie inside the sphere.
SLACK = 1e-12


def nearby(points: DataFrame, cutoff: float, keys: list[str]) -> DataFrame:
    """The points with ``__near``, some points (x, y, z) close by: one of each eighth of the small cells around them.

    Cells are halved from the cut-off's size on; a point takes the finest cell of which at least CHILDREN eighths are held, and
    the next ABOVE larger ones, so the list is short whatever the number of points.
    """
    at = [F.floor(F.col(c) / cutoff * F.pow(F.lit(2.0), F.col("__k") + 1)) for c in AXES]
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("__k")
    placed = points.select(*keys, *AXES).select("*", level).withColumns(dict(zip(CELL, at, strict=True)))
    cell = [*keys, "__k", *CELL]
    eighths = placed.groupBy(*cell).agg(F.min(F.struct(*AXES)).alias("p"))
    eighths = eighths.select(*keys, "__k", *[F.expr(f"shiftright({c}, 1)").alias(c) for c in CELL], "p")
    held = eighths.groupBy(*cell).agg(F.collect_list("p").alias("__some")).filter(F.size("__some") >= CHILDREN)
    own = [F.expr(f"shiftright({c}, 1)").alias(c) for c in CELL]
    rows = points.withColumn("__row", F.struct(*points.columns)).select("__row", *keys, *AXES, level).withColumns(dict(zip(CELL, at, strict=True))).select("__row", *keys, "__k", *own)
    found = rows.join(held, cell, "left").groupBy("__row").agg(F.slice(F.sort_array(F.collect_list(F.when(F.col("__some").isNotNull(), F.struct(-F.col("__k"), "__some")))), 1, ABOVE + 1).alias("__lists"))
    return found.select("__row.*", F.flatten(F.transform("__lists", lambda e: e["__some"])).alias("__near"))


def gabriel_graph(points: DataFrame, cutoff: float, keys: list[str], node: str = "node") -> DataFrame:
    """Edges (src < dst) within the cut-off whose diametral sphere holds no third node: a subgraph of Delaunay's.

    A pair for which one of the points listed near its first end (``nearby``) lies in its sphere drops out inside the range
    join, before rows travel. What is left, a few pairs a point, is checked against all points of the cells of its own
    length around its middle.
    """
    listed = nearby(points.select(*keys, node, *AXES), cutoff, keys)
    d2 = distance2()
    inside = lambda p: sum(((F.col(f"{e}.{c}") - p[c]) * (F.col(f"{e}.{c}") - p[c]) for e in "lr" for c in AXES), F.lit(0.0)) < d2 - SLACK
    kept = range_join(listed, points.select(*keys, node, *AXES), cutoff, keys, F.col(f"l.{node}") < F.col(f"r.{node}"), parts=enough_parts(points, POINTS_A_TASK)).filter(~F.exists("l.__near", inside))
    ends = [F.col(f"{e}.{c}").alias(f"__{e}{c}") for e in "lr" for c in AXES]
    edges = stored(kept.select(*[F.col(f"l.{k}").alias(k) for k in keys], F.col(f"l.{node}").alias("src"), F.col(f"r.{node}").alias("dst"), d2.alias("__d2"), *ends))

    # 2**-k of the cut-off is at least the edge's length; its sphere meets two cells of that size along each axis at most
    asked = edges.filter(F.col("__d2") > 0).withColumn("__k", F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.floor(F.log2(cutoff / F.sqrt("__d2")) - 1e-9))).cast("int"))
    size = lambda c: c / cutoff * F.pow(F.lit(2.0), F.col("__k"))
    for n, c in zip(CELL, AXES, strict=True):
        middle, half = (F.col(f"__l{c}") + F.col(f"__r{c}")) / 2, F.sqrt("__d2") * (0.5 + 1e-9)
        asked = asked.withColumn(n, F.explode(F.sequence(F.floor(size(middle - half)), F.floor(size(middle + half)))))
    levels = [r[0] for r in asked.select("__k").distinct().collect()]
    thirds = points.select(*keys, *AXES, F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")).alias("__k")).withColumns({n: F.floor(size(F.col(c))) for n, c in zip(CELL, AXES, strict=True)})
    sum2 = sum(((F.col(f"__{e}{c}") - F.col(c)) * (F.col(f"__{e}{c}") - F.col(c)) for e in "lr" for c in AXES), F.lit(0.0))
    blocked = asked.join(thirds, [*keys, "__k", *CELL]).filter(sum2 < F.col("__d2") - SLACK).select(*keys, "src", "dst").distinct()
    return edges.join(blocked, [*keys, "src", "dst"], "left_anti").select(*keys, "src", "dst")


def representative(atoms: DataFrame, keys: list[str], priority: Column) -> DataFrame:
    """One point per group: the one of least priority value."""
    return atoms.groupBy(*keys).agg(F.min_by(F.struct(*AXES), priority).alias("p")).select(*keys, "p.*")


def interface_nodes(points: DataFrame, cutoff: float, keys: list[str], chain: str = "chain", node: str = "node") -> DataFrame:
    """Nodes with a node of another chain of the same complex within the cut-off."""
    pairs = range_join(points, points, cutoff, keys, F.col(f"l.{chain}") != F.col(f"r.{chain}"))
    return pairs.select(*[F.col(f"l.{k}").alias(k) for k in keys], F.col(f"l.{chain}").alias(chain), F.col(f"l.{node}").alias(node)).distinct()


def chain_contact_graph(points: DataFrame, cutoff: float, least: int, keys: list[str], chain: str = "chain", node: str = "node") -> DataFrame:
    """Chain pairs of a complex with at least so many contacts."""
    pairs = range_join(points, points, cutoff, keys, F.col(f"l.{chain}") < F.col(f"r.{chain}"))
    return pairs.groupBy(*[F.col(f"l.{k}").alias(k) for k in keys], F.col(f"l.{chain}").alias("chain_a"), F.col(f"r.{chain}").alias("chain_b")).agg(F.count("*").alias("contacts")).filter(F.col("contacts") >= least)


def one_vs_rest(chains: DataFrame, key: str, chain: str, size: str | None = None, least: int = 30, most: int = 800) -> DataFrame:
    """Every chain as ligand and the others of its group as receptor; a pair of two only once.

    With a size column, only chains of ``least`` to ``most`` residues take part.
    """
    if size:
        chains = chains.filter(F.col(size).between(least, most))
    l, r = chains.alias("l"), chains.alias("r")
    pairs = l.join(r, (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col(f"l.{chain}") != F.col(f"r.{chain}")))
    out = pairs.groupBy(F.col(f"l.{key}").alias(key), F.col(f"l.{chain}").alias("ligand")).agg(F.array_sort(F.collect_set(f"r.{chain}")).alias("receptor"))
    return out.filter((F.size("receptor") > 1) | (F.col("ligand") < F.col("receptor")[0]))


def rigid_transform(points: DataFrame, poses: DataFrame, keys: list[str]) -> DataFrame:
    """Every point under every pose of its complex (equal keys): rotation about x, y and z, then a shift."""
    both = points.join(poses, keys)
    ca, sa, cb, sb, cc, sc = (f(F.col(c)) for c in ("rx", "ry", "rz") for f in (F.cos, F.sin))
    y1, z1 = F.col("y") * ca + F.col("z") * sa, F.col("z") * ca - F.col("y") * sa
    x2, z2 = F.col("x") * cb + z1 * sb, z1 * cb - F.col("x") * sb
    x3, y3 = x2 * cc + y1 * sc, y1 * cc - x2 * sc
    return both.withColumns({"nx": x3 + F.col("tx"), "ny": y3 + F.col("ty"), "nz": z2 + F.col("tz")})
