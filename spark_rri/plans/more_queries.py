"""Registered queries of joins, sampling, splitting, groups and models, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as fk
from ..operators import groups, joins, models, sampling
from .queries import CUT, EDGES, order_lines, query, rounded
from .standins import POINTS, SCORES, points, scores, table


@query("SELECT s_suppkey, c_custkey, CASE WHEN s_acctbal >= c_acctbal THEN 1 ELSE -1 END AS categ FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def pair_lattice(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal")
    # the smaller side is the one that is held
    return joins.pair_lattice(c, s, "nation", F.col("s_acctbal") >= F.col("c_acctbal")).select("s_suppkey", "c_custkey", "categ")


@query("WITH o AS (SELECT o_custkey, o_orderpriority AS g FROM orders), c AS (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0), b AS (SELECT g, count(*) AS rows_before FROM o GROUP BY g), a AS (SELECT g, count(*) AS rows_after FROM o JOIN c ON o_custkey = c_custkey GROUP BY g) SELECT g, rows_before, coalesce(rows_after, 0) AS rows_after, abs(rows_before - coalesce(rows_after, 0)) > 0.1 * rows_before AS rejected FROM b LEFT JOIN a USING (g)")
def feature_merge_guarded(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("g"))
    c = table(spark, sf, "customer").filter("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("k"))
    merged, rejects = joins.guarded_merge(o, c, ["k"], "g", 0.1)
    kept = o.groupBy("g").agg(F.count("*").alias("rows_before")).join(merged.groupBy("g").agg(F.count("*").alias("rows_after")), "g")
    return rejects.select("g", "rows_before", "rows_after", F.lit(True).alias("rejected")).union(kept.select("g", "rows_before", "rows_after", F.lit(False)))


@query("SELECT coalesce(c_custkey, o_custkey) AS k, CASE WHEN o_custkey IS NULL THEN 'left_only' WHEN c_custkey IS NULL THEN 'right_only' ELSE 'both' END AS found_in FROM customer FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') ON c_custkey = o_custkey")
def outer_indicator(spark, sf):
    return joins.outer_indicator(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), ["k"])


@query("WITH a AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def symmetric_diff(spark, sf):
    o = table(spark, sf, "orders")
    return joins.symmetric_difference(o.filter("o_orderstatus = 'F'").select("o_custkey"), o.filter("o_orderstatus = 'O'").select("o_custkey"))


@query("WITH p AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_extendedprice > 90000), t AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_discount >= 0.1 AND l_quantity >= 49) SELECT coalesce(p.l_suppkey, t.l_suppkey) AS l_suppkey, CASE WHEN t.l_suppkey IS NULL THEN 'FP' WHEN p.l_suppkey IS NULL THEN 'FN' ELSE 'TP' END AS hit FROM p FULL JOIN t ON p.l_suppkey = t.l_suppkey")
def tp_fp_fn_sets(spark, sf):
    l = table(spark, sf, "lineitem")
    return joins.hit_sets(l.filter("l_extendedprice > 90000").select("l_suppkey"), l.filter("l_discount >= 0.1 and l_quantity >= 49").select("l_suppkey"), ["l_suppkey"])


@query("WITH d AS (SELECT doc_id, lang, source FROM documents), a AS (SELECT doc_id, max(quality) AS v FROM labels GROUP BY 1), b AS (SELECT d.source, max(l.toxic) AS v FROM labels l JOIN d USING (doc_id) GROUP BY 1) SELECT d.doc_id, d.source, coalesce(a.v, b.v, -1) AS v FROM d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (source)")
def fallback_lookup(spark, sf):
    d, l = table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels")
    first = l.groupBy("doc_id").agg(F.max("quality").alias("v"))
    second = l.join(d, "doc_id").groupBy("source").agg(F.max("toxic").alias("v"))
    return joins.fallback_lookup(d, first, "doc_id", second, "source", "v", -1).select("doc_id", "source", "v")


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def compute_once_fanout(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return joins.compute_once(d, "text", F.md5("text"), "digest").select("doc_id", "digest")


SPANS = "spans AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + (value * 60)::BIGINT AS b FROM events)"


@query(f"WITH {SPANS} SELECT x.event_id, x.user_id FROM spans x WHERE NOT EXISTS (SELECT 1 FROM spans y WHERE x.user_id = y.user_id AND y.event_id > x.event_id AND least(x.b, y.b) - greatest(x.a, y.a) > 0.5 * (x.b - x.a))")
def overlap_anti_join(spark, sf):
    e = table(spark, sf, "events")
    start = F.expr("unix_seconds(cast(ts as timestamp))")
    spans = e.select("event_id", "user_id", start.alias("a"), (start + F.round(F.col("value") * 60).cast("long")).alias("b"))
    return joins.overlap_anti_join(spans, "user_id", "a", "b", "event_id").select("event_id", "user_id")


@query("WITH n AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem), c AS (SELECT a.k, a.n AS l, b.n AS r FROM n a JOIN n b ON a.k = b.k WHERE (a.n * 7 + b.n) % 5 = 0), s AS (SELECT k, n AS node, (n * 3) % 8 AS twin FROM n) SELECT k, l, r FROM c UNION SELECT c.k, y.twin, x.twin FROM c JOIN s x ON c.k = x.k AND c.l = x.node JOIN s y ON c.k = y.k AND c.r = y.node")
def contact_equivalence(spark, sf):
    n, parts = order_lines(spark, sf, "k", "n")
    c = n.withColumnRenamed("n", "l").join(n.withColumnRenamed("n", "r"), "k").filter("(l * 7 + r) % 5 = 0")
    return joins.equivalent_contacts(c, n.select("k", F.col("n").alias("node"), ((F.col("n") * 3) % 8).alias("twin")), "k", "l", "r", parts)


@query("WITH m AS (SELECT s_suppkey AS node, s_suppkey * 2 + 1 AS renamed FROM supplier WHERE s_suppkey % 3 <> 0) SELECT DISTINCT a.renamed AS l, b.renamed AS r FROM (SELECT DISTINCT l_suppkey AS l, l_partkey AS r FROM lineitem) c JOIN m a ON c.l = a.node JOIN m b ON c.r = b.node")
def label_transfer(spark, sf):
    m = table(spark, sf, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") * 2 + 1).alias("renamed"))
    c = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("l"), F.col("l_partkey").alias("r")).distinct()
    return joins.transfer_labels(c, m, "l", "r")


@query("SELECT l_suppkey AS i, l_partkey - 45 AS j, max(l_tax) AS score FROM lineitem WHERE l_suppkey < 40 AND l_partkey >= 45 GROUP BY ALL")
def coupling_slice(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.max("l_tax").alias("score"))
    return joins.coupling_slice(c, 40, 5)


@query("SELECT conv_id, string_agg(left(role, 1), '' ORDER BY turn) AS sequence FROM conversations GROUP BY 1")
def sequence_assembly(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.substring("role", 1, 1).alias("letter"))
    return joins.assemble(c, ["conv_id"], ["turn"], "letter")


@query("SELECT source, lang, arg_max(doc_id, n_chars * 1000000 + doc_id) AS doc_id FROM documents GROUP BY ALL")
def best_per_taxon(spark, sf):
    return joins.best_per_group(table(spark, sf, "documents"), ["source", "lang"], "doc_id", F.col("n_chars") * 1000000 + F.col("doc_id"))


@query("WITH b AS (SELECT source, lang, arg_max(doc_id, n_chars * 1000000 + doc_id)::VARCHAR AS d FROM documents GROUP BY ALL) SELECT l.source, l.d || '-----' || r.d AS paired FROM b l JOIN b r ON l.source = r.source AND l.lang = 'en' AND r.lang = 'fr'")
def paired_alignment(spark, sf):
    b = best_per_taxon(spark, sf).withColumn("d", F.col("doc_id").cast("string"))
    return joins.paired_alignment(b.filter("lang = 'en'"), b.filter("lang = 'fr'"), "source", "d")


RMSD = f"{POINTS}, o AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY node) AS k FROM points), cells AS (SELECT l.chain AS a, r.chain AS b, sqrt(avg((l.x-r.x)*(l.x-r.x)+(l.y-r.y)*(l.y-r.y)+(l.z-r.z)*(l.z-r.z))) AS rmsd FROM o l JOIN o r ON l.k = r.k AND l.chain < 5 AND r.chain >= 5 GROUP BY ALL)"


def rmsd_cells(spark, sf):
    from pyspark.sql import Window

    from ..operators.spatial import distance2

    p = points(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("chain").orderBy("node")))
    both = p.filter("chain < 5").alias("l").join(p.filter("chain >= 5").alias("r"), F.col("l.k") == F.col("r.k"))
    named = both.select(F.col("l.chain").alias("a"), F.col("r.chain").alias("b"), distance2().alias("d2"))
    return joins.rmsd(named, ["a", "b"], F.col("d2"))


@query(f"WITH {RMSD} SELECT a, b, round(rmsd, 6) AS rmsd FROM cells")
def rmsd_by_pair(spark, sf):
    return rounded(rmsd_cells(spark, sf), "rmsd")


@query(f"WITH {RMSD}, r AS (SELECT *, row_number() OVER (ORDER BY rmsd, a, b) AS k FROM cells), g AS (SELECT * FROM r WHERE k <= 5) SELECT a, arg_min(b, k) AS b, round(min(rmsd), 6) AS rmsd FROM g GROUP BY a")
def greedy_match(spark, sf):
    out = joins.greedy_match(rmsd_cells(spark, sf).withColumn("part", F.lit(0)), "part", "a", "b", "rmsd", 10.0)
    return rounded(out.select("a", "b", "rmsd"), "rmsd")


TAKEN = "list_reduce(list({'a': [a], 'b': [b], 'c': [cost]} ORDER BY cost, a, b), lambda x, y: CASE WHEN list_contains(x.a, y.a[1]) OR list_contains(x.b, y.b[1]) THEN x ELSE {'a': list_concat(x.a, y.a), 'b': list_concat(x.b, y.b), 'c': list_concat(x.c, y.c)} END)"


@query(f"WITH cells AS (SELECT l_linenumber AS part, l_suppkey AS a, l_partkey AS b, min(l_extendedprice) AS cost FROM lineitem GROUP BY ALL), m AS (SELECT part, {TAKEN} AS m FROM cells GROUP BY part) SELECT part, unnest(m.a) AS a, unnest(m.b) AS b, unnest(m.c) AS cost FROM m")
def dominant_match(spark, sf):
    cells = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("part"), F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.min("l_extendedprice").alias("cost"))
    return joins.dominant_match(cells, "part", "a", "b", "cost")


@query("WITH m AS (SELECT l_suppkey, l_returnflag AS f, avg(l_discount) AS d FROM lineitem GROUP BY ALL), w AS (SELECT a.l_suppkey, a.d AS A, n.d AS N, r.d AS R FROM m a JOIN m n ON a.l_suppkey = n.l_suppkey AND a.f = 'A' AND n.f = 'N' JOIN m r ON a.l_suppkey = r.l_suppkey AND r.f = 'R') SELECT l_suppkey, round(A, 6) AS A, round(N, 6) AS N, round(R, 6) AS R, round(greatest(A, N, R) - least(A, N, R), 6) AS spread FROM w WHERE greatest(A, N, R) - least(A, N, R) > 0.0005")
def three_model_compare(spark, sf):
    m = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_discount").alias("d"))
    out = joins.three_way_compare({f: m.filter(F.col("l_returnflag") == f) for f in "ANR"}, ["l_suppkey"], "d", 0.0005)
    return rounded(out, "A", "N", "R", "spread")


@query("WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, (l_returnflag = 'R' AND l_quantity > 45)::INT AS label FROM lineitem), p AS (SELECT l_suppkey, count(*) FILTER (label = 1) AS p FROM r GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, label = 1 ORDER BY md5(concat_ws('#', l_suppkey::VARCHAR, l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, 's')), l_orderkey, l_linenumber, l_partkey) AS k FROM r) SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, label FROM k JOIN p USING (l_suppkey) WHERE p > 0 AND (label = 1 OR k <= p * 3)")
def negative_sampling(spark, sf):
    r = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).cast("int").alias("label"))
    return sampling.negative_sampling(r, "l_suppkey", "label", ["l_orderkey", "l_linenumber", "l_partkey"], 3, "s")


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer), s AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), d AS (SELECT c_nationkey, n, unnest(range(1, greatest(floor(n * 0.7), 1)::BIGINT + 1)) AS draw FROM s) SELECT d.c_nationkey, d.draw, n.c_custkey FROM d JOIN n ON d.c_nationkey = n.c_nationkey AND n.k = ('0x' || left(md5(d.c_nationkey::VARCHAR || '#' || d.draw::VARCHAR || '#b'), 8))::BIGINT % d.n")
def bootstrap_sample(spark, sf):
    out = sampling.bootstrap(table(spark, sf, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", ["c_custkey"], 0.7, "b")
    return out.select("c_nationkey", F.col("draw").cast("long").alias("draw"), "c_custkey")


@query("WITH k AS (SELECT l.doc_id, l.toxic, d.lang, row_number() OVER (PARTITION BY d.lang, l.toxic = 1 ORDER BY md5(concat_ws('#', d.lang, l.doc_id::VARCHAR, 'c')), l.doc_id) AS k FROM labels l JOIN documents d USING (doc_id)) SELECT doc_id, toxic, lang FROM k WHERE toxic = 1 OR k <= 20")
def capped_negatives(spark, sf):
    return sampling.capped(scores(spark, sf).select("doc_id", "toxic", "lang"), "lang", F.col("toxic") == 1, ["doc_id"], 20, "c")


#: Each group in turn to the first of the least loaded of five folds.
LEAST_LOADED = "list_reduce(list_concat([{'loads': [0::BIGINT for k in range(5)], 'folds': []::INT[], 'n': 0::BIGINT}], list({'loads': []::BIGINT[], 'folds': []::INT[], 'n': n} ORDER BY n DESC, g)), lambda x, y: {'loads': list_transform(x.loads, lambda v, i: CASE WHEN i = list_position(x.loads, list_min(x.loads)) THEN v + y.n ELSE v END), 'folds': list_append(x.folds, list_position(x.loads, list_min(x.loads))::INT - 1), 'n': 0::BIGINT})"


@query(f"WITH g AS (SELECT o_custkey AS g, count(*) AS n FROM orders GROUP BY 1), d AS (SELECT {LEAST_LOADED} AS d, list(g ORDER BY n DESC, g) AS gs FROM g), f AS (SELECT unnest(gs) AS g, unnest(d.folds) AS fold FROM d) SELECT g AS o_custkey, n, fold FROM f JOIN g USING (g)")
def group_kfold(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return sampling.group_folds(g, "o_custkey", "n", 5)


@query("WITH f AS (SELECT c_nationkey AS g, count(*) AS n, c_nationkey % 4 AS fold FROM customer GROUP BY 1), o AS (SELECT t.k AS test_fold, f.* FROM range(4) t(k), f WHERE f.fold <> t.k) SELECT test_fold::INT AS test_fold, g, ((row_number() OVER (PARTITION BY test_fold ORDER BY n DESC, g) - 1) % 3)::INT AS sub_fold FROM o")
def sub_folds(spark, sf):
    f = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("g")).agg(F.count("*").alias("n")).withColumn("fold", F.col("g") % 4)
    return sampling.sub_folds(f, "g", "n", 4, 3)


@query("WITH t AS (SELECT k AS fold, [k, k + 4, k + 8] AS ids FROM range(4) t(k)) SELECT o_orderkey, t.fold FROM orders, t WHERE NOT list_has_any([o_custkey % 25, (o_custkey * 7) % 25], t.ids)")
def leakage_free_merge(spark, sf):
    tests = spark.range(4).select(F.col("id").alias("fold"), F.array(*[F.col("id") + k for k in (0, 4, 8)]).alias("test_ids"))
    o = table(spark, sf, "orders").select("o_orderkey", F.array(F.col("o_custkey") % 25, (F.col("o_custkey") * 7) % 25).alias("lineage"))
    return sampling.leakage_free(o, "o_orderkey", "lineage", tests).select("o_orderkey", "fold")


@query("WITH t AS (SELECT * FROM customer WHERE c_nationkey % 5 <> 0), r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey::VARCHAR || '#i'), c_custkey) AS k FROM t) SELECT 'train' AS part, c_nationkey, c_custkey FROM r WHERE k = 1 UNION ALL SELECT 'test', c_nationkey, c_custkey FROM customer WHERE c_nationkey % 5 = 0")
def independent_split(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey")
    halves = sampling.independent_split(c, "c_nationkey", c.filter("c_nationkey % 5 = 0"), "c_custkey", "i")
    train, test = (h.select(F.lit(name).alias("part"), "c_nationkey", "c_custkey") for h, name in zip(halves, ("train", "test"), strict=True))
    return train.unionByName(test)


TIGHT = EDGES.replace(f"<= {CUT * CUT!r}", "<= 0.0025")


@query(f"WITH RECURSIVE {POINTS}, {TIGHT}, reach AS (SELECT node AS u, node AS label FROM points UNION SELECT e.dst, r.label FROM reach r JOIN edges e ON e.src = r.u) SELECT u AS node, min(label) AS label FROM reach GROUP BY u")
def connected_groups(spark, sf):
    from ..operators.spatial import linking_edges

    p = points(spark, sf)
    return groups.connected_groups(p, linking_edges(p, 0.05, ["complex_id"]), "node", "src", "dst")


FAMILIES = "f AS (SELECT p_partkey AS k, 'L' AS side, p_brand || p_size::VARCHAR AS family FROM part UNION ALL SELECT p_partkey, 'R', p_type || (p_size % 5)::VARCHAR FROM part)"


@query(f"WITH {FAMILIES}, m AS (SELECT x.k AS a, y.k AS b, bool_or(x.side = 'L' AND y.side = 'L') AS ll, bool_or(x.side = 'R' AND y.side = 'R') AS rr, bool_or(x.side = 'L' AND y.side = 'R') AS lr, bool_or(x.side = 'R' AND y.side = 'L') AS rl FROM f x JOIN f y ON x.family = y.family AND x.k < y.k GROUP BY ALL) SELECT a, b FROM m WHERE (ll AND rr) OR (lr AND rl)")
def family_groups(spark, sf):
    p = table(spark, sf, "part")
    left = p.select(F.col("p_partkey").alias("k"), F.lit("L").alias("side"), F.concat("p_brand", F.col("p_size").cast("string")).alias("family"))
    right = p.select("p_partkey", F.lit("R"), F.concat("p_type", (F.col("p_size") % 5).cast("string")))
    return groups.related(left.union(right), "k")


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1) AS lang, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2) AS number FROM pages")
def key_parsing(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", fk.first_match(u, "^https?://([^/]+)/").alias("host"), fk.first_match(u, "/([a-z]{2})/([0-9]+)").alias("lang"), fk.first_match(u, "/([a-z]{2})/([0-9]+)", 2).alias("number"))


@query(f"WITH {SCORES} SELECT f.family, count(*) AS n, round(avg(score), 4) AS mean, sum(score) AS total, max(score) AS most FROM scores s JOIN (VALUES ('low', '^src[0-4]$'), ('teens', '^src1[0-9]$')) f(family, p) ON regexp_matches(s.source, f.p) GROUP BY 1 UNION ALL SELECT 'others', count(*), round(avg(score), 4), sum(score), max(score) FROM scores WHERE NOT regexp_matches(source, '^src[0-4]$') AND NOT regexp_matches(source, '^src1[0-9]$')")
def importance_by_family(spark, sf):
    out = models.importance_by_family(scores(spark, sf), "source", "score", {"low": "^src[0-4]$", "teens": "^src1[0-9]$"})
    return rounded(out, "mean", digits=4)


def labelled_features(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("f0"), F.size(F.split("text", " ")).cast("double").alias("f1"), F.size(F.split("text", "\n")).cast("double").alias("f2"), F.length(F.regexp_replace("text", "[^,.]", "")).cast("double").alias("f3"))
    return d.join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id").withColumn("group", F.col("doc_id") % 5)


@query()
def gbt_scores(spark, sf):
    return models.cross_scores(labelled_features(spark, sf), ["f0", "f1", "f2", "f3"], models.boosted_trees(), folds=2).select("doc_id", "prediction")


@query()
def rf_scores(spark, sf):
    return models.cross_scores(labelled_features(spark, sf), ["f0", "f1", "f2", "f3"], models.random_forest(), folds=2).select("doc_id", "prediction")


@query()
def two_step_feedback(spark, sf):
    from ..operators import spatial

    keys, p = ["complex_id"], points(spark, sf)
    l, r = p.filter("partner = 0"), p.filter("partner = 1")
    near = spatial.range_join(l, r, 0.2, keys)
    values = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "lr" for c in ("v1", "v2", "v3")]
    label = (spatial.distance2() <= CUT * CUT).cast("double").alias("label")
    lattice = near.select(F.col("l.complex_id").alias("complex_id"), F.col("l.node").alias("i"), F.col("r.node").alias("j"), label, *values)
    features = [c for c in lattice.columns if c[:2] in ("l_", "r_")]
    edges = [spatial.neighbour_edges(side, CUT, keys) for side in (l, r)]
    out = models.two_step(lattice, features, keys, *edges, models.random_forest(), folds=2, group="complex_id")
    return out.select("complex_id", "i", "j", "step0_P", "n2n_max_step0_z_P", "prediction")


@query()
def isotonic_calibration(spark, sf):
    from .queries import sweep

    return models.isotonic(sweep(spark, sf).filter("prec is not null"), "t", "prec").select("lang", "t", "calibrated")


@query("SELECT event_type, event_id, user_id FROM events")
def incremental_intake(spark, sf):
    from ..streaming.intake import available_now

    return available_now(spark, f"{sf}/events.parquet", lambda df: df.select("event_type", "event_id", "user_id"))
