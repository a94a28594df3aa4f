"""Registered queries of parts that arrive, of the catalogue, and of score bounds of alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.substitution import BLOSUM62, symmetric
from ..operators import alignment, catalogue, evaluation, joins, recipes, spatial
from ..shared import fresh_path
from ..streaming.gather import gather
from .queries import CUT, NEAR, query
from .standins import POINTS, points, table

TYPES = ["click", "view", "purchase"]
DAYS = 5


@query(f"WITH e AS (SELECT *, user_id || '/' || day(ts) AS complex_id FROM events), u AS (SELECT complex_id, count(DISTINCT event_type) FILTER (event_type IN {tuple(TYPES)}) AS n, min(ts) AS first FROM e GROUP BY 1), l AS (SELECT max(ts) AS latest FROM e) SELECT complex_id, event_id, CASE WHEN n = {len(TYPES)} THEN 'complete' WHEN date_trunc('second', latest) - date_trunc('second', first) > INTERVAL {DAYS} DAY THEN 'quarantined' ELSE 'waiting' END AS state, CASE WHEN n < {len(TYPES)} AND date_trunc('second', latest) - date_trunc('second', first) > INTERVAL {DAYS} DAY THEN n || ' of {len(TYPES)} variants' END AS reason FROM e JOIN u USING (complex_id), l")
def gathered_complexes(spark, sf):
    """A user's days stand for complexes and event types for their variants."""
    named = lambda rows: rows.select("event_id", "event_type", "ts", F.concat_ws("/", F.col("user_id").cast("string"), F.dayofmonth("ts").cast("string")).alias("complex_id"))
    found = gather(spark, f"{sf}/events.parquet", fresh_path(spark, "gathered"), "complex_id", "event_type", TYPES, "ts", DAYS * 86_400, named)
    parts = [rows.select("complex_id", "event_id", F.lit(state).alias("state"), "reason") for state, rows in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


LETTERS = "ACDEFGHIKLMNPQRS"


def profile(todo):
    """A stand-in for a costly profile of a sequence: its share of hydrophobic letters; sequences without C fail."""
    share = F.length(F.regexp_replace("seq", "[^ACFILM]", "")) / F.length("seq")
    good = F.col("seq").contains("C")
    return todo.select("seq", F.when(good, F.round(share, 6)).alias("profile"), F.when(good, 0).otherwise(2).alias("status"))


SEQ = f"translate(md5({{}}::VARCHAR), '0123456789abcdef', '{LETTERS}')"


@query(f"WITH c AS (SELECT c_custkey, {SEQ.format('(c_custkey // 2)')} AS seq FROM customer), o AS (SELECT DISTINCT {SEQ.format('(o_custkey // 2)')} AS seq FROM orders) SELECT c_custkey, CASE WHEN seq LIKE '%C%' THEN round(length(regexp_replace(seq, '[^ACFILM]', '', 'g')) / length(seq), 6) END AS profile, CASE WHEN seq LIKE '%C%' THEN 0 ELSE 2 END AS status, CASE WHEN seq IN (FROM o) THEN 'catalogue' ELSE 'computed' END AS origin FROM c")
def catalogue_filled(spark, sf):
    """Customers that have orders fill the catalogue, then all ask it."""
    seq = lambda c: F.translate(F.md5(F.expr(f"{c} div 2").cast("string")), "0123456789abcdef", LETTERS).alias("seq")
    path = fresh_path(spark, "catalogue")
    catalogue.filled(table(spark, sf, "orders").select(seq("o_custkey")), path, "seq", profile)
    return catalogue.filled(table(spark, sf, "customer").select("c_custkey", seq("c_custkey")), path, "seq", profile).select("c_custkey", "profile", "status", "origin")


#: What each letter scores against itself.
OWN = {a: score for (a, b), score in symmetric(BLOSUM62).items() if a == b}
OWN_SUM = "coalesce(list_sum(list_transform(string_split({0}, ''), lambda c: CASE c " + " ".join(f"WHEN '{a}' THEN {s}" for a, s in OWN.items()) + " ELSE -1.0 END)), 0.0)"
CHAINS = f"c AS (SELECT c_custkey, {SEQ.format('c_custkey')} || {SEQ.format('c_nationkey')} AS a, {SEQ.format('(c_custkey // 2)')} || {SEQ.format('c_nationkey')} AS b FROM customer)"


@query(f"WITH {CHAINS} SELECT c_custkey, {OWN_SUM.format('a')} AS own_a, {OWN_SUM.format('b')} AS own_b, true AS ascending, true AS bounded, true AS as_good_as_shared_end FROM c")
def alignment_bounds(spark, sf):
    """Pairs that share their second half: places ascend, no score exceeds either's own, and none is under the shared half's."""
    seq = lambda c: F.translate(F.md5(F.expr(c).cast("string")), "0123456789abcdef", LETTERS)
    chains = table(spark, sf, "customer").select("c_custkey", F.concat(seq("c_custkey"), seq("c_nationkey")).alias("a"), F.concat(seq("c_custkey div 2"), seq("c_nationkey")).alias("b"), seq("c_nationkey").alias("shared"))
    scores = F.create_map(*[F.lit(v) for item in OWN.items() for v in item])
    own = lambda c: F.aggregate(F.split(F.col(c), "(?!^)(?=.)"), F.lit(0.0), lambda total, letter: total + F.coalesce(F.try_element_at(scores, letter), F.lit(-1.0)))
    maps = alignment.sequence_map(chains, "a", "b").withColumns({"own_a": own("a"), "own_b": own("b"), "own_shared": own("shared")})
    rising = lambda c: F.col(c) == F.array_sort(F.array_distinct(c))
    score = F.coalesce("score", "own_a")  # equal sequences are not aligned
    return maps.select("c_custkey", "own_a", "own_b", (rising("a_index") & rising("b_index") & (F.size("a_index") == F.size("b_index"))).alias("ascending"), (score <= F.least("own_a", "own_b")).alias("bounded"), (score >= F.col("own_shared")).alias("as_good_as_shared_end"))


@query("WITH p AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber) AS rank, count(*) OVER (PARTITION BY l_suppkey) AS size FROM lineitem), n AS (SELECT least(500, min(size)) AS n FROM p), c AS (SELECT l_suppkey, n, count(*) FILTER (l_returnflag = 'R') AS contacts, count(*) FILTER (l_returnflag = 'R' AND rank <= n) AS hits FROM p, n GROUP BY l_suppkey, n) SELECT l_suppkey, n, contacts, round(hits / n, 6) AS precision, round(hits / n / nullif(contacts, 0), 9) AS over_contacts FROM c")
def precision_over_contacts(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice", "l_orderkey", "l_partkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("label"))
    out = evaluation.precision_over_contacts(rows, "l_suppkey", "l_extendedprice", ["l_orderkey", "l_partkey", "l_linenumber"], "label")
    return out.withColumns({"precision": F.round("precision", 6), "over_contacts": F.round("over_contacts", 9)})


SIX = ["o", "p", "s", "d", "t", "n"]
LINES = "l_linenumber AS complex_id, l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_discount AS d, l_tax AS t, l_quantity AS n"


@query(f"WITH a AS (SELECT DISTINCT {LINES} FROM lineitem), b AS (SELECT complex_id, o, p, s, d, t, n, max(o % 97) AS coupling FROM a WHERE complex_id <> 3 OR o % 60 <> 0 GROUP BY ALL), m AS (SELECT a.*, coupling AS coupling_P FROM a JOIN b USING (complex_id, o, p, s, d, t, n)), c AS (SELECT complex_id, count(*) AS n_a FROM a GROUP BY 1), k AS (SELECT complex_id, count(*) AS n_m FROM m GROUP BY 1), g AS (SELECT complex_id FROM c LEFT JOIN k USING (complex_id) WHERE n_a - coalesce(n_m, 0) <= 0.01 * n_a) SELECT complex_id, o, p, s, coupling_P FROM m WHERE complex_id IN (FROM g)")
def pair_feature_merge(spark, sf):
    """Every pair of complex 3 that the couplings lack counts against it: it loses more than 1 % and is rejected."""
    a = table(spark, sf, "lineitem").selectExpr(*[c.strip() for c in LINES.split(",")]).distinct()
    b = a.filter("complex_id <> 3 or o % 60 <> 0").withColumn("coupling", F.col("o") % 97)
    merged, _ = joins.pair_feature_merge(a, b, "complex_id", SIX)
    return merged.select("complex_id", "o", "p", "s", "coupling_P")


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer INTERSECT SELECT user_id FROM events")
def in_all_tables(spark, sf):
    named = {"orders": "o_custkey", "customer": "c_custkey", "events": "user_id"}
    return joins.in_all([table(spark, sf, t).select(F.col(c).alias("k")) for t, c in named.items()], ["k"])


@query(f"WITH {POINTS}, e AS (SELECT l.complex_id, l.node AS i, r.node AS j, l.v1 AS L_v1, r.v2 AS R_v2, l.v3 * r.v3 AS pair FROM points l JOIN points r ON l.complex_id = r.complex_id AND l.partner = 0 AND r.partner = 1 AND {NEAR}) SELECT complex_id, i, j, 'complex_id,i,j,L_v1,R_v2,pair' AS columns, L_v1 + 2 * R_v2 + 3 * pair AS told FROM e")
def ordered_blocks(spark, sf):
    """The blocks come as pair, right, left and are put in order; the value tells their places apart."""
    p = points(spark, sf)
    near = spatial.range_join(p.filter("partner = 0"), p.filter("partner = 1"), CUT, ["complex_id"])
    mixed = near.select((F.col("l.v3") * F.col("r.v3")).alias("pair"), F.col("r.v2").alias("R_v2"), F.col("l.node").alias("i"), F.col("l.v1").alias("L_v1"), F.col("r.node").alias("j"), F.col("l.complex_id").alias("complex_id"))
    out = recipes.in_order(mixed, ["complex_id", "i", "j"])
    blocks = out.columns[3:]
    return out.select("complex_id", "i", "j", F.lit(",".join(out.columns)).alias("columns"), sum((k + 1) * F.col(c) for k, c in enumerate(blocks)).alias("told"))
