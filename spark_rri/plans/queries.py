"""Registered queries on the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import neighbours as nb
from ..operators import ordered, scoring, spatial
from ..shared import enough_parts
from .standins import D2, ORDER, PAIRS, POINTS, RANKED, SCORES, TIES, chain, pairs, points, scores, table

CUT = 0.1
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


NEAR = f"{D2} <= {CUT * CUT!r}"
EDGES = f"edges AS (SELECT l.complex_id, l.node AS src, r.node AS dst, {D2} AS d2 FROM points l JOIN points r ON l.complex_id = r.complex_id AND l.node <> r.node AND {NEAR})"


@query(f"WITH {POINTS} SELECT DISTINCT l.complex_id, l.node AS node_l, r.node AS node_r FROM points l JOIN points r ON l.complex_id = r.complex_id AND l.partner = 0 AND r.partner = 1 AND {NEAR}")
def contact_range_join(spark, sf):
    return spatial.contact_pairs(points(spark, sf), CUT)


@query(f"WITH {POINTS}, {EDGES} SELECT p.complex_id, p.node, count(e.dst) AS contact_number FROM points p LEFT JOIN edges e ON p.complex_id = e.complex_id AND p.node = e.src GROUP BY ALL")
def contact_number(spark, sf):
    return spatial.contact_number(points(spark, sf), CUT, ["complex_id"])


@query(f"WITH {POINTS} SELECT DISTINCT l.complex_id, l.chain, l.node FROM points l JOIN points r ON l.complex_id = r.complex_id AND l.chain <> r.chain AND {NEAR}")
def interface_residues(spark, sf):
    return spatial.interface_nodes(points(spark, sf), CUT, ["complex_id"])


@query(f"WITH {POINTS} SELECT l.complex_id, l.chain AS chain_a, r.chain AS chain_b, count(*) AS contacts FROM points l JOIN points r ON l.complex_id = r.complex_id AND l.chain < r.chain AND {NEAR} GROUP BY ALL HAVING count(*) >= 20")
def chain_contact_graph(spark, sf):
    return spatial.chain_contact_graph(points(spark, sf), CUT, 20, ["complex_id"])


@query(f"WITH {POINTS}, e AS (SELECT l.complex_id, l.node, (r.x-l.x)*l.ax+(r.y-l.y)*l.ay+(r.z-l.z)*l.az AS dot FROM points l JOIN points r ON l.complex_id = r.complex_id AND l.node <> r.node AND {NEAR}) SELECT p.complex_id, p.node, count(*) FILTER (dot > 0) AS n_up, count(*) FILTER (dot <= 0) AS n_down FROM points p LEFT JOIN e USING (complex_id, node) GROUP BY ALL")
def half_sphere_counts(spark, sf):
    return spatial.half_sphere_counts(points(spark, sf), CUT, ["complex_id"], ("ax", "ay", "az"))


@query(f"WITH {POINTS}, {EDGES} SELECT e.complex_id, e.src, e.dst FROM edges e WHERE e.src < e.dst AND NOT EXISTS (SELECT 1 FROM edges p JOIN edges q ON p.complex_id = q.complex_id AND p.dst = q.dst WHERE p.complex_id = e.complex_id AND p.src = e.src AND q.src = e.dst AND p.d2 + q.d2 < e.d2 - 1e-12)")
def gabriel_graph(spark, sf):
    return spatial.gabriel_graph(points(spark, sf), CUT, ["complex_id"])


@query("WITH n AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) SELECT l.l_orderkey, l.l_linenumber AS ligand, string_agg(r.l_linenumber::VARCHAR, ',' ORDER BY r.l_linenumber) AS receptor FROM n l JOIN n r ON l.l_orderkey = r.l_orderkey AND l.l_linenumber <> r.l_linenumber GROUP BY ALL HAVING count(*) > 1 OR l.l_linenumber < min(r.l_linenumber)")
def one_vs_rest_chains(spark, sf):
    out = spatial.one_vs_rest(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber")
    return out.select("l_orderkey", "ligand", F.concat_ws(",", F.col("receptor").cast("array<string>")).alias("receptor"))


POSES = [(0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (1, 0.5, -0.25, 0.125, 0.0, 2.0, 0.0), (2, -1.0, 0.75, 0.3, 0.5, 0.5, -1.0)]
POSE_SQL = "poses AS (SELECT * FROM (VALUES " + ", ".join(map(str, POSES)) + ") t(pose, rx, ry, rz, tx, ty, tz))"


@query(f"WITH {POINTS}, {POSE_SQL}, a AS (SELECT *, y*cos(rx)+z*sin(rx) AS y1, z*cos(rx)-y*sin(rx) AS z1 FROM points, poses), b AS (SELECT *, x*cos(ry)+z1*sin(ry) AS x2, z1*cos(ry)-x*sin(ry) AS z2 FROM a) SELECT node, pose, round(x2*cos(rz)+y1*sin(rz)+tx, 6) AS nx, round(y1*cos(rz)-x2*sin(rz)+ty, 6) AS ny, round(z2+tz, 6) AS nz FROM b")
def rigid_transform(spark, sf):
    p = points(spark, sf)
    names = ["pose", "rx", "ry", "rz", "tx", "ty", "tz"]
    every = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, pose, strict=True)]) for pose in POSES])
    poses = p.select("complex_id").distinct().select("complex_id", F.inline(every))
    return rounded(spatial.rigid_transform(p, poses, ["complex_id"]).select("node", "pose", "nx", "ny", "nz"), "nx", "ny", "nz")


AGGS = ", ".join(f"round(coalesce({f}(q.{c}), -1024), 6) AS {f}_{c}" for c in ("v1", "v2") for f in ("avg", "max", "min", "sum"))


@query(f"WITH {POINTS}, {EDGES} SELECT p.complex_id, p.node, {AGGS} FROM points p LEFT JOIN edges e ON p.complex_id = e.complex_id AND p.node = e.src LEFT JOIN points q ON e.complex_id = q.complex_id AND e.dst = q.node GROUP BY ALL")
def neighbour_agg(spark, sf):
    p = points(spark, sf)
    out = nb.neighbour_agg(p, spatial.neighbour_edges(p, CUT, ["complex_id"]), ["complex_id"], "node", ["v1", "v2"])
    return rounded(out, *out.columns[2:])


@query(f"WITH {POINTS}, {EDGES} SELECT p.complex_id, p.node, CASE WHEN count(e.dst) = 0 THEN -1024 ELSE count(*) FILTER (q.partner = 0) END AS n_0, CASE WHEN count(e.dst) = 0 THEN -1024 ELSE count(*) FILTER (q.partner = 1) END AS n_1 FROM points p LEFT JOIN edges e ON p.complex_id = e.complex_id AND p.node = e.src LEFT JOIN points q ON e.complex_id = q.complex_id AND e.dst = q.node GROUP BY ALL")
def neighbour_factor_count(spark, sf):
    p = points(spark, sf)
    return nb.neighbour_factor_count(p, spatial.neighbour_edges(p, CUT, ["complex_id"]), ["complex_id"], "node", "partner", [0, 1])


LATTICE = f"lat AS (SELECT l.complex_id, l.node AS i, r.node AS j, l.v1 * r.v2 AS v FROM points l JOIN points r ON l.complex_id = r.complex_id AND l.partner = 0 AND r.partner = 1 AND {D2} <= 0.09 AND (l.node + r.node) % 7 <> 0), el AS (SELECT e.* FROM edges e JOIN points a ON e.src = a.node JOIN points b ON e.dst = b.node WHERE a.partner = 0 AND b.partner = 0), er AS (SELECT e.* FROM edges e JOIN points a ON e.src = a.node JOIN points b ON e.dst = b.node WHERE a.partner = 1 AND b.partner = 1)"


def _parts(name: str, join: str) -> str:
    return f"{name} AS (SELECT x.complex_id, x.i, x.j, avg(y.v) AS a, max(y.v) AS hi, min(y.v) AS lo, sum(y.v) AS s FROM lat x {join} GROUP BY ALL)"


@query(
    f"WITH {POINTS}, {EDGES}, {LATTICE}, "
    + _parts("l2r", "JOIN er ON er.complex_id = x.complex_id AND er.src = x.j JOIN lat y ON y.complex_id = x.complex_id AND y.i = x.i AND y.j = er.dst")
    + ", "
    + _parts("r2l", "JOIN el ON el.complex_id = x.complex_id AND el.src = x.i JOIN lat y ON y.complex_id = x.complex_id AND y.i = el.dst AND y.j = x.j")
    + ", "
    + _parts("n2n", "JOIN el ON el.complex_id = x.complex_id AND el.src = x.i JOIN er ON er.complex_id = x.complex_id AND er.src = x.j JOIN lat y ON y.complex_id = x.complex_id AND y.i = el.dst AND y.j = er.dst")
    + " SELECT x.complex_id, x.i, x.j, round(x.v, 6) AS v, "
    + ", ".join(f"round(coalesce({n}.{c}, -1024), 6) AS {n}_{o}" for n in ("l2r", "r2l", "n2n") for c, o in (("a", "avg"), ("hi", "max"), ("lo", "min"), ("s", "sum")))
    + " FROM lat x LEFT JOIN l2r USING (complex_id, i, j) LEFT JOIN r2l USING (complex_id, i, j) LEFT JOIN n2n USING (complex_id, i, j)"
)
def pair_neighbour_agg(spark, sf):
    p = points(spark, sf)
    l, r = p.filter("partner = 0"), p.filter("partner = 1")
    near = spatial.range_join(l, r, 0.3, ["complex_id"], (F.col("l.node") + F.col("r.node")) % 7 != 0)
    lattice = near.select(F.col("l.complex_id").alias("complex_id"), F.col("l.node").alias("i"), F.col("r.node").alias("j"), (F.col("l.v1") * F.col("r.v2")).alias("v"))
    keys = ["complex_id"]
    out = nb.pair_neighbour_agg(lattice, spatial.neighbour_edges(l, CUT, keys), spatial.neighbour_edges(r, CUT, keys), keys, "v")
    return rounded(out, *out.columns[3:])


@query("SELECT user_id, event_id, " + ", ".join(f"{'lag' if k < 0 else 'lead'}(value, {abs(k)}, -1.0) OVER ({ORDER}) AS value_{k + 5}" for k in range(-5, 6)) + " FROM events")
def window_profile(spark, sf):
    out = ordered.window_profile(chain(spark, sf), "user_id", ["ts", "event_id"], ["value"], 11, -1.0)
    return out.select("user_id", "event_id", *[f"value_{k}" for k in range(11)])


@query(f"WITH c AS (SELECT user_id, event_id, lag(event_id) OVER ({ORDER}) AS a, lead(event_id) OVER ({ORDER}) AS b FROM events) SELECT user_id, event_id AS src, a AS dst FROM c WHERE a IS NOT NULL UNION ALL SELECT user_id, event_id, b FROM c WHERE b IS NOT NULL")
def seq_neighbours(spark, sf):
    return nb.sequence_edges(chain(spark, sf), "user_id", ["ts", "event_id"], "event_id")


@query(f"SELECT user_id, event_id, round(value + (lag(value, 1, 0.0) OVER ({ORDER}) + 3 * value + lead(value, 1, 0.0) OVER ({ORDER})) / 5, 6) AS smoothed FROM events")
def smooth_131(spark, sf):
    return rounded(ordered.smooth(chain(spark, sf), "user_id", ["ts", "event_id"], "value").select("user_id", "event_id", "smoothed"), "smoothed")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round((l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey)) / nullif(stddev_pop(l_extendedprice) OVER (PARTITION BY l_suppkey), 0), 6) AS z FROM lineitem")
def zscore_by_group(spark, sf):
    out = ordered.z_score(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice", F.lit(None).cast("double"))
    return rounded(out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "z"), "z")


@query("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS scaled FROM customer")
def min_max_norm(spark, sf):
    return rounded(ordered.min_max(table(spark, sf, "customer"), "c_acctbal").select("c_custkey", "scaled"), "scaled")


@query(f"WITH a AS (SELECT *, row_number() OVER ({ORDER}) AS pos, coalesce((lag(event_type) OVER ({ORDER}) <> event_type)::INT, 1) AS new FROM events), b AS (SELECT *, sum(new) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS segment FROM a) SELECT user_id, segment::BIGINT AS segment, event_type, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS length FROM b GROUP BY ALL")
def run_length_segments(spark, sf):
    return ordered.run_lengths(chain(spark, sf), "user_id", ["ts", "event_id"], "event_type")


@query(f"SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS filled FROM events")
def forward_fill(spark, sf):
    rows = chain(spark, sf).withColumn("mark", F.when(F.col("event_type") == "purchase", F.col("value")))
    return ordered.fill_forward(rows, "user_id", ["ts", "event_id"], "mark", "filled").select("user_id", "event_id", "filled")


@query("WITH n AS (SELECT DISTINCT l_orderkey, l_suppkey, l_linenumber FROM lineitem) SELECT l_orderkey, l_suppkey, l_linenumber, chr((64 + dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey))::INT) AS new_chain, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_linenumber) - 1 AS new_node FROM n")
def renumber_entities(spark, sf):
    return ordered.renumber(table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber").distinct(), "l_orderkey", "l_suppkey", "l_linenumber")


WEIGHT = " + ".join(f"CASE WHEN rank <= {1 << i} THEN {2.0**-i!r}::DOUBLE ELSE 0 END" for i in range(3, 12))


@query(f"WITH {RANKED} SELECT complex_id, site_l, sum({WEIGHT}) AS vote FROM ranked WHERE rank <= 2048 GROUP BY ALL")
def multiscale_vote(spark, sf):
    return scoring.multiscale_vote(pairs(spark, sf), "complex_id", "score", TIES, "site_l")


@query(f"WITH {PAIRS} SELECT complex_id, site_l, max(score) AS site_score, count(*) AS n_pairs FROM pairs GROUP BY ALL")
def max_pool_site(spark, sf):
    return scoring.max_pool(pairs(spark, sf), "complex_id", "site_l", "score")


NN = "n AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), nn AS MATERIALIZED (SELECT a.l_orderkey AS complex_id, a.l_linenumber AS a, b.l_linenumber AS b, (a.l_orderkey + a.l_linenumber * 37 + b.l_linenumber * 11) % 101 / 128.0::DOUBLE AS score FROM n a JOIN n b ON a.l_orderkey = b.l_orderkey)"


#: Lines whose pairs meet in one task.
LINES_A_TASK = 100_000


def order_lines(spark, sf, key: str, line: str):
    """(distinct lines of orders, in partitions by order that hold about LINES_A_TASK rows at every size; how many partitions)."""
    t = table(spark, sf, "lineitem")
    parts = enough_parts(t, LINES_A_TASK)
    return t.select(F.col("l_orderkey").alias(key), F.col("l_linenumber").alias(line)).repartition(parts, key).distinct(), parts


def line_pairs(spark, sf):
    """Ordered pairs of an order's lines, at most seven by seven; they stay where their order's lines are."""
    n, _ = order_lines(spark, sf, "complex_id", "a")
    both = n.join(n.withColumnRenamed("a", "b"), "complex_id")
    return both.select("complex_id", "a", "b", ((F.col("complex_id") + F.col("a") * 37 + F.col("b") * 11) % 101 / F.lit(128.0)).alias("score"))


@query(f"WITH {NN} SELECT x.complex_id, x.a, x.b, x.score, (x.score + y.score) / 2 AS symmetric FROM nn x JOIN nn y ON x.complex_id = y.complex_id AND x.a = y.b AND x.b = y.a")
def symmetric_mean(spark, sf):
    return scoring.symmetric_mean(line_pairs(spark, sf), "complex_id", "a", "b", "score").select("complex_id", "a", "b", "score", "symmetric")


@query(f"WITH {NN}, o AS (SELECT complex_id, a, b, score FROM nn UNION ALL SELECT complex_id, b, a, score FROM nn) SELECT complex_id, a, b, avg(score) AS mean_score, count(*) AS n_scores FROM o GROUP BY ALL")
def orientation_mean(spark, sf):
    both = scoring.transposed(line_pairs(spark, sf), ["complex_id"], ["a"], ["b"], ["score"])
    return scoring.orientation_mean(both, ["complex_id", "a", "b"], "score")


@query(f"WITH {RANKED} SELECT complex_id, 2 * (rank <= 500)::INT + label AS confusion, count(*) AS n FROM ranked GROUP BY ALL")
def confusion_classes(spark, sf):
    return scoring.confusion_class(pairs(spark, sf), "complex_id", "score", TIES, "label", 500).groupBy("complex_id", "confusion").agg(F.count("*").alias("n"))


@query(f"WITH {SCORES}, r AS (SELECT lang, label, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS mid FROM scores), s AS (SELECT lang, sum(mid) FILTER (label = 1) AS rs, count(*) FILTER (label = 1) AS p, count(*) AS n FROM r GROUP BY lang) SELECT lang, p AS n_pos, n - p AS n_neg, round(CASE WHEN p > 0 AND n > p THEN (rs - p * (p + 1) / 2.0) / (p * (n - p)) ELSE 0.5 END, 6) AS auc FROM s")
def roc_auc_grouped(spark, sf):
    return rounded(ev.roc_auc(scores(spark, sf), "lang", "score", "label"), "auc")


KS = (8, 50, 100)


@query(f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank FROM scores) SELECT lang, count(*) AS n, count(*) FILTER (label = 1) AS n_pos, " + ", ".join(f"round(count(*) FILTER (label = 1 AND rank <= {k}) / least({k}, count(*)), 6) AS prec_{k}, round(count(*) FILTER (label = 1 AND rank <= {k}) / count(*) FILTER (label = 1), 6) AS reca_{k}" for k in KS) + " FROM r GROUP BY lang")
def precision_recall_at_k(spark, sf):
    out = ev.precision_recall_at(scores(spark, sf), "lang", "score", ["doc_id"], "label", list(KS))
    return rounded(out, *out.columns[3:])


@query(f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank, count(*) OVER (PARTITION BY lang) AS n FROM scores) SELECT lang, count(*) AS n_top, round(avg(label), 6) AS prec FROM r WHERE rank <= floor(n * 0.1) GROUP BY lang")
def precision_at_fraction(spark, sf):
    top = scoring.top_fraction(scores(spark, sf), "lang", "score", ["doc_id"], 0.1)
    return rounded(top.groupBy("lang").agg(F.count("*").alias("n_top"), F.avg("label").alias("prec")), "prec")


SWEEP = f"{SCORES}, s AS (SELECT lang, score / 7 AS v, label FROM scores), t AS (SELECT DISTINCT lang, round(v, 0) AS t FROM s), c AS (SELECT t.lang, t.t, count(*) FILTER (v > t AND label = 1) AS tp, count(*) FILTER (v > t AND label = 0) AS fp, count(*) FILTER (v <= t AND label = 1) AS fn, count(*) FILTER (v <= t AND label = 0) AS tn FROM t JOIN s ON t.lang = s.lang GROUP BY ALL), k AS (SELECT *, min(t) OVER (PARTITION BY lang) AS lo, max(t) OVER (PARTITION BY lang) AS hi FROM c), sweep AS (SELECT lang, t, tp, fp, fn, tn, tp / nullif(tp + fp, 0) AS prec, tp / nullif(tp + fn, 0) AS reca, tn / nullif(tn + fp, 0) AS spec, coalesce((tp * tn - fp * fn)::DOUBLE / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0) AS mcc FROM k WHERE t > lo AND t < hi)"


def sweep(spark, sf):
    s = scores(spark, sf).select("lang", (F.col("score") / 7).alias("v"), "label")
    return ev.threshold_sweep(s, "lang", "v", "label", 0)


@query(f"WITH {SWEEP} SELECT lang, t, tp, fp, fn, tn, round(prec, 6) AS prec, round(reca, 6) AS reca, round(spec, 6) AS spec, round(mcc, 6) AS mcc FROM sweep")
def threshold_sweep(spark, sf):
    return rounded(sweep(spark, sf), "prec", "reca", "spec", "mcc")


@query(f"WITH {SWEEP}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(abs(prec - 0.9), 9), t) AS k FROM sweep WHERE prec IS NOT NULL) SELECT lang, t, round(prec, 6) AS prec, round(reca, 6) AS reca, round(mcc, 6) AS mcc FROM r WHERE k = 1")
def recall_at_precision(spark, sf):
    out = ev.best_threshold(sweep(spark, sf).filter("prec is not null"), "lang", F.round(F.abs(F.col("prec") - 0.9), 9))
    return rounded(out, "prec", "reca", "mcc")


@query(f"WITH {SCORES}, c AS (SELECT lang, count(*) FILTER (score > 1500 AND label = 1) AS tp, count(*) FILTER (score > 1500 AND label = 0) AS fp, count(*) FILTER (score <= 1500 AND label = 1) AS fn, count(*) FILTER (score <= 1500 AND label = 0) AS tn FROM scores GROUP BY lang) SELECT *, round(tp / nullif(tp + fp, 0), 6) AS prec, round(tp / nullif(tp + fn, 0), 6) AS reca, round(tn / nullif(tn + fp, 0), 6) AS spec, round(coalesce((tp * tn - fp * fn)::DOUBLE / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0), 6) AS mcc FROM c")
def metrics_at_threshold(spark, sf):
    return rounded(ev.at_threshold(scores(spark, sf), "lang", "score", "label", 1500.0), "prec", "reca", "spec", "mcc")


@query(f"WITH {SCORES} SELECT source, bool_or(score > 9000) AS any_above, count(*) FILTER (score > 9000) AS n_above FROM scores GROUP BY source")
def sites_above_threshold(spark, sf):
    return scoring.above_threshold(scores(spark, sf), "source", "score", 9000)


@query(f"WITH {SCORES}, b AS (SELECT lang, score, count(*) AS n, count(*) FILTER (label = 1) AS p FROM scores GROUP BY ALL) SELECT lang, score, round(sum(p) OVER w / sum(p) OVER (PARTITION BY lang), 6) AS tpr, round(sum(n - p) OVER w / nullif(sum(n - p) OVER (PARTITION BY lang), 0), 6) AS fpr FROM b WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING)")
def roc_curve(spark, sf):
    return rounded(ev.roc_points(scores(spark, sf), "lang", "score", "label"), "tpr", "fpr")


@query("WITH p AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber) AS rank, l_returnflag FROM lineitem), f AS (SELECT l_suppkey, min(rank) FILTER (l_returnflag = 'R') AS first_rank FROM p GROUP BY 1), n AS (SELECT 1::BIGINT << k::INT AS n FROM range(11) t(k)) SELECT n.n, count(*) FILTER (first_rank <= n.n) AS hits, round(count(*) FILTER (first_rank <= n.n) / count(*), 6) AS hit_rate FROM f, n GROUP BY n.n")
def hit_rate_curve(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice", "l_orderkey", "l_partkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("label"))
    first = ev.first_hits(rows, "l_suppkey", "l_extendedprice", ["l_orderkey", "l_partkey", "l_linenumber"], "label")
    return rounded(ev.hit_rate_curve(first), "hit_rate")


@query("WITH m AS (SELECT l_returnflag AS flag, avg(l_quantity) AS q, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1) SELECT flag, round(q, 4) AS q, round(p, 4) AS p FROM m UNION ALL SELECT 'mean', round(avg(q), 4), round(avg(p), 4) FROM m")
def mean_summary_row(spark, sf):
    m = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("p"))
    return rounded(ev.with_mean_row(m, "flag", ["q", "p"]), "q", "p", digits=4)


@query(f"WITH {SWEEP} SELECT lang, round(regr_slope(prec, ln(t)), 6) AS slope, round(regr_intercept(prec, ln(t)), 6) AS intercept FROM sweep WHERE t > 0 AND prec IS NOT NULL GROUP BY lang")
def log_fit(spark, sf):
    return rounded(ev.log_fit(sweep(spark, sf), "lang", "t", "prec"), "slope", "intercept")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts, their multi-scale vote per site, smoothed along the chain; the 20 best sites."""
    p = points(spark, sf_dir)
    near = spatial.range_join(p.filter("partner = 0"), p.filter("partner = 1"), CUT, ["complex_id"])
    contacts = near.select(F.col("l.complex_id").alias("complex_id"), F.col("l.node").alias("site"), F.col("r.node").alias("other"), (CUT - F.sqrt(spatial.distance2())).alias("score"))
    vote = scoring.multiscale_vote(contacts, "complex_id", "score", ["site", "other"], "site")
    sites = ev.aligned(p.filter("partner = 0").select("complex_id", F.col("node").alias("site")), vote, ["complex_id", "site"], "vote")
    return ordered.smooth(sites, "complex_id", ["site"], "vote").orderBy(F.desc("smoothed"), "complex_id", "site").limit(20)
