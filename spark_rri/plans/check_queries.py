"""Registered queries of filters, relabelling and reports on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves, filters, groups, relabel, reports
from .queries import query, rounded
from .standins import PAIRS, SCORES, TIES, pairs, scores, table

METRICS = "round(tp / nullif(tp + fp, 0), 6) AS prec, round(tp / nullif(tp + fn, 0), 6) AS reca, round(tn / nullif(tn + fp, 0), 6) AS spec, round(coalesce((tp * tn - fp * fn)::DOUBLE / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0), 6) AS mcc"
AUC = "round(CASE WHEN p > 0 AND n > p THEN (rs - p * (p + 1) / 2.0) / (p * (n - p)) ELSE 0.5 END, 6)"


@query("SELECT doc_id, source, lang FROM documents WHERE lang IS NOT NULL AND lang <> 'X'")
def skipped_columns(spark, sf):
    return filters.known_residues(filters.without_columns(table(spark, sf, "documents"), ("n_chars", "text", "seqIndex")), "lang")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE upper(trim(p_type)) IN ('ALA', 'GLY', 'MSE') AND NOT starts_with(upper(trim(p_name)), 'H') UNION ALL SELECT l_orderkey, 'CA', 'ALA' FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1")
def heavy_atoms(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    l = table(spark, sf, "lineitem").filter("l_linenumber = 1")
    name = F.when(F.col("l_returnflag") == "A", "CA").when(F.col("l_returnflag") == "N", " HB1").otherwise("O")
    residue = F.when(F.col("l_returnflag") == "R", "HOH").otherwise("ala")
    atoms = l.select(F.col("l_orderkey").alias("p_partkey"), name.alias("p_name"), residue.alias("p_type"))
    kept = filters.heavy_atoms(p.unionByName(atoms), "p_name", "p_type")
    return kept.withColumn("p_type", F.when(F.col("p_type") == "ala", "ALA").otherwise(F.col("p_type")))


@query("WITH n AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS size FROM lineitem GROUP BY 1) SELECT l_suppkey, count(*) AS n, 'kept' AS reason FROM lineitem JOIN n USING (l_suppkey) WHERE size > 20 AND size < 90 GROUP BY 1 UNION ALL SELECT l_suppkey, size, CASE WHEN size <= 20 THEN 'too few' ELSE 'too many' END FROM n WHERE size <= 20 OR size >= 90")
def sized_partners(spark, sf):
    kept, rejects = filters.sized(table(spark, sf, "lineitem").select("l_suppkey", "l_partkey"), ["l_suppkey"], ["l_partkey"], 20, 90)
    return kept.groupBy("l_suppkey").agg(F.count("*").alias("n")).withColumn("reason", F.lit("kept")).unionByName(rejects.select("l_suppkey", F.col("size").alias("n"), "reason"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 10")
def accessible_set(spark, sf):
    return filters.accessible(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey % 2 = 0")
def evaluated_ids(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    case = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("1ABC"), "p_brand")).otherwise(F.concat(F.lit("1abc"), "p_brand"))
    return filters.evaluated(p.withColumn("id", case), "id").select("p_partkey", "p_brand")


@query("SELECT o_orderkey, true AS listed FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT o_orderkey, false FROM orders WHERE o_custkey IS NULL OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def listed_ids(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    ids = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    part = lambda inverted: filters.listed(o, ids, ["o_custkey"], inverted).select("o_orderkey", F.lit(not inverted).alias("listed"))
    return part(False).unionByName(part(True))


@query("SELECT s_nationkey, s_suppkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_quantity >= 50 AND l.l_discount >= 0.1 AND s.s_suppkey IN (l.l_suppkey, l.l_partkey))")
def chains_not_touching(spark, sf):
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey")
    c = table(spark, sf, "lineitem").filter("l_quantity >= 50 and l_discount >= 0.1").select("l_suppkey", "l_partkey")
    return filters.not_touching(s, c, [], "s_suppkey", ("l_suppkey", "l_partkey"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_tax AS l_quantity_x_l_tax, l_quantity * l_discount AS l_quantity_x_l_discount FROM lineitem")
def product_terms(spark, sf):
    out = filters.product_terms(table(spark, sf, "lineitem"), ["l_quantity"], ["l_tax", "l_discount"])
    return out.select("l_orderkey", "l_linenumber", "l_quantity_x_l_tax", "l_quantity_x_l_discount")


@query("WITH f AS (SELECT l_returnflag AS letter, round(avg(l_tax), 6) AS f1, round(avg(l_discount), 6) AS f2 FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) SELECT l_orderkey, l_linenumber, f1, f2 FROM lineitem LEFT JOIN f ON l_returnflag = letter")
def encoded_letters(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_tax", "l_discount")
    f = l.filter("l_returnflag != 'N'").groupBy(F.col("l_returnflag").alias("letter")).agg(F.round(F.avg("l_tax"), 6).alias("f1"), F.round(F.avg("l_discount"), 6).alias("f2"))
    return filters.encoded_letters(l, "l_returnflag", f).select("l_orderkey", "l_linenumber", "f1", "f2")


@query("SELECT event_id, (event_type = 'click')::INT AS event_type_click, (event_type = 'view')::INT AS event_type_view FROM events")
def one_hot_levels(spark, sf):
    return filters.one_hot(table(spark, sf, "events"), "event_type", ["click", "view"]).select("event_id", "event_type_click", "event_type_view")


@query("SELECT page_id, replace(url, '-', 'X') AS letters FROM pages")
def gap_letters(spark, sf):
    return table(spark, sf, "pages").select("page_id", filters.gap_letter(F.col("url")).alias("letters"))


@query("SELECT conv_id, turn, count(DISTINCT turn) OVER (PARTITION BY conv_id) AS \"seqLen\" FROM conversations")
def chain_lengths(spark, sf):
    return filters.with_chain_length(table(spark, sf, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"])


@query("WITH t AS (SELECT l_orderkey, l_linenumber, max((l_discount >= 0.05)::INT) AS label FROM lineitem WHERE l_quantity > 10 GROUP BY ALL) SELECT l.l_orderkey, l.l_linenumber, l.l_extendedprice, t.label FROM lineitem l JOIN t ON l.l_orderkey = t.l_orderkey AND l.l_linenumber = t.l_linenumber")
def relabelled_contacts(spark, sf):
    l = table(spark, sf, "lineitem")
    truth = l.filter("l_quantity > 10").groupBy("l_orderkey", "l_linenumber").agg(F.max((F.col("l_discount") >= 0.05).cast("int")).alias("label"))
    rows = l.select("l_orderkey", "l_linenumber", "l_extendedprice", F.lit(0).alias("label"))
    return relabel.relabelled(rows, truth, ["l_orderkey", "l_linenumber"], "label").select("l_orderkey", "l_linenumber", "l_extendedprice", "label")


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 1 ELSE -1 END AS categ FROM orders")
def enriched_labels(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.lit(-1).alias("categ"))
    extra = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return relabel.enriched(o, extra, ["o_custkey"], "categ").select("o_orderkey", "categ")


@query("WITH n AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL), k AS (SELECT l_suppkey, n, count(*) AS times FROM n GROUP BY ALL), r AS (SELECT l_suppkey, arg_min(n, times * 1000000 + n) AS rare FROM k GROUP BY 1 HAVING count(*) > 1) SELECT l.l_suppkey, l.l_linenumber, count(*) AS n FROM lineitem l JOIN n USING (l_suppkey, l_linenumber) LEFT JOIN r ON r.l_suppkey = l.l_suppkey WHERE r.rare IS NULL OR n.n <> r.rare GROUP BY ALL")
def without_rarest(spark, sf):
    l = table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber")
    return relabel.without_rarest(l, ["l_suppkey"], "l_linenumber").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))


@query(f"WITH {SCORES} SELECT source, count(*) AS n, count(*) FILTER (label = 1) AS n_pos, round(avg((label = 1)::INT), 6) AS share, count(*) FILTER (score > 5000) AS n_difficult FROM scores GROUP BY 1")
def positive_share(spark, sf):
    return rounded(relabel.positive_share(scores(spark, sf), ["source"], "label", F.col("score") > 5000), "share")


@query("WITH n AS (SELECT l_orderkey AS k, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1), u AS (SELECT n FROM n GROUP BY 1 ORDER BY count(*) DESC, n DESC LIMIT 1), e AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 <> 0) SELECT coalesce(n.k, e.k) AS k, coalesce(n.n, 0) AS n_variants, CASE WHEN n.n IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'not expected' ELSE 'other number' END AS reason FROM n FULL JOIN e ON n.k = e.k CROSS JOIN u WHERE n.n IS NULL OR e.k IS NULL OR n.n <> u.n")
def incomplete_complexes(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    e = table(spark, sf, "orders").filter("o_orderkey % 10 != 0").select(F.col("o_orderkey").alias("k"))
    return relabel.incomplete(l, "k", "l_linenumber", e)


@query("SELECT c_custkey, 'l' AS partner, c_mktsegment AS chain FROM customer UNION ALL SELECT c_custkey, 'r', lower(c_mktsegment) FROM customer")
def homo_copy(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("chain"), F.lower("c_mktsegment").alias("other"))
    return relabel.homo_copy(c, "partner", {"chain": "other"}).select("c_custkey", "partner", "chain")


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def ids_of_any(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return relabel.ids_of_any([o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"), table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("k"))], "k")


@query("SELECT DISTINCT l_linenumber AS complex_id, l_suppkey AS site_l FROM lineitem")
def sites_of_partner(spark, sf):
    return relabel.sites_of(pairs(spark, sf), ["complex_id", "site_l"])


@query("SELECT p_brand AS variant_of, count(*) AS n, count(*) FILTER (p_partkey % 3 = 1) AS n_left FROM part GROUP BY 1")
def variant_groups(spark, sf):
    tag = F.element_at(F.array(F.lit(""), F.lit("#sl"), F.lit("#sr")), (F.col("p_partkey") % 3 + 1).cast("int"))
    p = table(spark, sf, "part").select(F.concat("p_brand", tag).alias("id"))
    left = relabel.of_side(p, "id", "l").groupBy(relabel.variant_group(F.col("id")).alias("variant_of")).agg(F.count("*").alias("n_left"))
    every = p.groupBy(relabel.variant_group(F.col("id")).alias("variant_of")).agg(F.count("*").alias("n"))
    return every.join(left, "variant_of", "left").select("variant_of", "n", F.coalesce("n_left", F.lit(0)).alias("n_left"))


@query("WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_acctbal > 9000)::INT DESC, md5(c_custkey::VARCHAR || '#m'), c_custkey) AS place FROM customer) SELECT c_nationkey, c_custkey, place FROM r WHERE place <= 10")
def cluster_members(spark, sf):
    return relabel.cluster_members(table(spark, sf, "customer"), "c_nationkey", "c_custkey", F.col("c_acctbal") > 9000, 10, "m").select("c_nationkey", "c_custkey", F.col("place").cast("long").alias("place"))


NODES = "c AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS l, l_suppkey % 7 AS r FROM lineitem), s AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS node, (l_linenumber * 3) % 8 AS twin FROM lineitem)"


@query(f"WITH {NODES} SELECT k, l, r FROM c UNION SELECT c.k, s.twin, c.r FROM c JOIN s ON c.k = s.k AND c.l = s.node UNION SELECT c.k, c.l, s.twin FROM c JOIN s ON c.k = s.k AND c.r = s.node")
def equivalence_within_partner(spark, sf):
    l = table(spark, sf, "lineitem")
    c = l.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), (F.col("l_suppkey") % 7).alias("r")).distinct()
    s = l.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("node"), ((F.col("l_linenumber") * 3) % 8).alias("twin")).distinct()
    return relabel.within_partner(c, s, "k", "l", "r")


@query(f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank, count(*) OVER (PARTITION BY source) AS n FROM scores), c AS (SELECT source, count(*) FILTER (call) AS n_called, count(*) FILTER (call AND label = 1) AS tp, count(*) FILTER (call AND label <> 1) AS fp, count(*) FILTER (NOT call AND label = 1) AS fn, count(*) FILTER (NOT call AND label <> 1) AS tn FROM (SELECT *, rank <= round(6.1 * pow(n, 0.3)) AS call FROM r) GROUP BY 1) SELECT *, {METRICS} FROM c")
def site_metrics(spark, sf):
    return rounded(reports.site_metrics(scores(spark, sf), "source", "score", ["doc_id"], "label"), "prec", "reca", "spec", "mcc")


@query(f"WITH {SCORES}, t AS (SELECT lang, (arg_min(score, abs(score - 1500) * 1000000 + score)) AS threshold FROM scores GROUP BY 1), x AS (SELECT lang, threshold, score >= threshold AS call, label FROM scores JOIN t USING (lang) UNION ALL SELECT NULL, 1500.0::DOUBLE, score >= 1500, label FROM scores), c AS (SELECT lang, threshold, count(*) FILTER (call AND label = 1) AS tp, count(*) FILTER (call AND label <> 1) AS fp, count(*) FILTER (NOT call AND label = 1) AS fn, count(*) FILTER (NOT call AND label <> 1) AS tn FROM x GROUP BY ALL) SELECT *, {METRICS} FROM c")
def metrics_at_nearest_cut(spark, sf):
    return rounded(reports.nearest_cut(scores(spark, sf), "lang", "score", "label", 1500.0), "prec", "reca", "spec", "mcc")


def _side(tag: str, score: str) -> str:
    return f"m{tag} AS (SELECT lang, {score} AS score, label, doc_id FROM scores), r{tag} AS (SELECT lang, label, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS mid, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank FROM m{tag}), s{tag} AS (SELECT lang, sum(mid) FILTER (label = 1) AS rs, count(*) FILTER (label = 1) AS p, count(*) AS n, min(rank) FILTER (label = 1) AS first FROM r{tag} GROUP BY 1), t{tag} AS (SELECT lang, {AUC} AS auc, first FROM s{tag})"


@query(f"WITH {SCORES}, {_side('a', 'score')}, {_side('b', '-score')} SELECT lang, ta.auc AS auc_a, ta.first AS first_a, tb.auc AS auc_b, tb.first AS first_b, CASE WHEN ta.first < tb.first THEN 'a' WHEN tb.first < ta.first THEN 'b' WHEN ta.first IS NOT NULL THEN 'same' END AS earlier FROM ta JOIN tb USING (lang)")
def two_model_summary(spark, sf):
    s = scores(spark, sf)
    out = reports.side_by_side(s, s.withColumn("score", -F.col("score")), "lang", "score", ["doc_id"], "label")
    return rounded(out, "auc_a", "auc_b")


WEIGHT = " + ".join(f"CASE WHEN rank <= {1 << i} THEN {2.0**-i!r}::DOUBLE ELSE 0 END" for i in range(3, 12))


@query(f"WITH {PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY complex_id ORDER BY score DESC, l_orderkey, site_r, site_l) AS rank FROM pairs), v AS (SELECT complex_id, site_l, max(label) AS label, sum(CASE WHEN rank <= 2048 THEN {WEIGHT} ELSE 0 END) AS vote FROM k GROUP BY ALL), r AS (SELECT complex_id, label, rank() OVER (PARTITION BY complex_id ORDER BY vote) + (count(*) OVER (PARTITION BY complex_id, vote) - 1) / 2.0 AS mid FROM v), s AS (SELECT complex_id, sum(mid) FILTER (label = 1) AS rs, count(*) FILTER (label = 1) AS p, count(*) AS n FROM r GROUP BY 1) SELECT complex_id, p AS n_pos, n - p AS n_neg, {AUC} AS auc FROM s")
def rescored_sites(spark, sf):
    return rounded(reports.rescored(pairs(spark, sf), "complex_id", "score", TIES, "site_l", "label"), "auc")


@query("SELECT l_suppkey AS i, l_partkey AS j, l_linenumber AS complex_id, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL")
def score_matrix(spark, sf):
    best = pairs(spark, sf).groupBy("complex_id", F.col("site_l").alias("i"), F.col("site_r").alias("j")).agg(F.max("score").alias("score"))
    return curves.to_long(curves.to_rows(best, "complex_id", "i", "j", "score"), "complex_id", "i").select("i", "j", "complex_id", "score")


@query("WITH RECURSIVE f AS (SELECT p_partkey AS k, p_brand || p_size::VARCHAR AS l, p_type || (p_size % 5)::VARCHAR AS r FROM part), h AS (SELECT DISTINCT k, least(l, r) AS one, greatest(l, r) AS two FROM f), e AS (SELECT DISTINCT x.k AS a, y.k AS b FROM h x JOIN h y USING (one, two)), reach AS (SELECT k AS u, k AS label FROM f UNION SELECT e.b, r.label FROM reach r JOIN e ON e.a = r.u) SELECT u AS k, min(label) AS label FROM reach GROUP BY u")
def family_components(spark, sf):
    p = table(spark, sf, "part")
    left = p.select(F.col("p_partkey").alias("k"), F.lit("L").alias("side"), F.concat("p_brand", F.col("p_size").cast("string")).alias("family"))
    right = p.select("p_partkey", F.lit("R"), F.concat("p_type", (F.col("p_size") % 5).cast("string")))
    return groups.related_groups(left.union(right), "k")
