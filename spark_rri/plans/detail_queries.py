"""Registered queries of full metric reports, lookups with status, wrapped segments and chain limits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import alignment_quality, base_id, clean_sequence, valid_sequence, without_insertions
from ..operators import evaluation as ev
from ..operators import joins, ordered, spatial
from .queries import query, rounded, sweep
from .standins import ORDER, RANKED, SCORES, TIES, chain, pairs, scores, table

FULL = "round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy, round(fp / nullif(fp + tn, 0), 6) AS fpr, round(tn / nullif(tn + fn, 0), 6) AS npv"


@query(
    f"WITH {SCORES}, s AS (SELECT lang, score / 7 AS score, label FROM scores), r AS (SELECT *, round(score) AS t FROM s), t AS (SELECT DISTINCT lang, t FROM r), c AS (SELECT t.lang, t.t, count(*) FILTER (s.score > t.t AND s.label = 1) AS tp, count(*) FILTER (s.score > t.t AND s.label <> 1) AS fp, count(*) FILTER (s.score <= t.t AND s.label = 1) AS fn, count(*) FILTER (s.score <= t.t AND s.label <> 1) AS tn FROM t JOIN s ON s.lang = t.lang GROUP BY ALL), "
    "e AS (SELECT lang, min(t) AS a, max(t) AS b FROM c GROUP BY 1), m AS (SELECT c.*, coalesce((tp * tn - fp * fn)::DOUBLE / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0) AS mcc FROM c JOIN e USING (lang) WHERE t > a AND t < b) "
    "SELECT lang, round(mcc, 6) AS mcc, t FROM m QUALIFY row_number() OVER (PARTITION BY lang ORDER BY round(mcc, 12) DESC, t) = 1"
)
def best_correlation(spark, sf):
    out = ev.best_correlation(sweep(spark, sf), "lang")
    return rounded(out.select("lang", "mcc", "t"), "mcc")


@query(
    f"WITH {SCORES}, s AS (SELECT lang, score, label FROM scores WHERE lang IS NOT NULL UNION ALL SELECT NULL, score, label FROM scores), c AS (SELECT lang, count(*) FILTER (score > 300 AND label = 1) AS tp, count(*) FILTER (score > 300 AND label <> 1) AS fp, count(*) FILTER (score <= 300 AND label = 1) AS fn, count(*) FILTER (score <= 300 AND label <> 1) AS tn FROM s GROUP BY lang), "
    "k AS (SELECT lang, label, (rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0) AS r FROM s), a AS (SELECT lang, count(*) FILTER (label = 1) AS p, count(*) AS n, sum(r) FILTER (label = 1) AS rs FROM k GROUP BY lang) "
    f"SELECT c.lang, tp, fp, fn, tn, {FULL}, round(CASE WHEN p > 0 AND n > p THEN (rs - p * (p + 1) / 2.0) / (p * (n - p)) ELSE 0.5 END, 6) AS auc FROM c JOIN a ON c.lang IS NOT DISTINCT FROM a.lang"
)
def report_at_threshold(spark, sf):
    out = ev.more_metrics(ev.report_at(scores(spark, sf), "lang", "score", "label", 300.0))
    return rounded(out.select("lang", "tp", "fp", "fn", "tn", "accuracy", "fpr", "npv", "auc"), "accuracy", "fpr", "npv", "auc")


FIRST = "rows AS (SELECT l_suppkey AS g, (l_returnflag = 'R' AND l_quantity > 45)::INT AS label, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber) AS rank FROM lineitem)"


def line_labels(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice", "l_orderkey", "l_partkey", "l_linenumber", ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).cast("int").alias("label"))


LINE_TIES = ["l_orderkey", "l_partkey", "l_linenumber"]


@query(f"WITH {FIRST}, f AS (SELECT g, min(rank) FILTER (label = 1) AS f FROM rows GROUP BY g), c AS (SELECT n, (SELECT count(*) FROM f WHERE f <= n) / (SELECT count(*) FROM f) AS hit_rate FROM range(1, 1025) t(n)), s AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS share), k AS (SELECT share, n, hit_rate, row_number() OVER (PARTITION BY share ORDER BY round(abs(hit_rate - share), 12), n) AS k FROM s, c) SELECT share, n, round(hit_rate, 6) AS hit_rate FROM k WHERE k = 1")
def hit_rate_marks(spark, sf):
    first = ev.first_hits(line_labels(spark, sf), "l_suppkey", "l_extendedprice", LINE_TIES, "label")
    return rounded(ev.hit_rate_marks(first), "hit_rate")


@query(f"WITH {RANKED} SELECT (1 << k)::INT AS n, round((SELECT count(*) FROM ranked WHERE label = 1 AND rank <= (1 << k)) / (SELECT count(DISTINCT complex_id) FROM pairs), 6) AS mean_hits FROM range(11) t(k)")
def mean_hits(spark, sf):
    return rounded(ev.mean_hits(pairs(spark, sf), "complex_id", "score", TIES, "label"), "mean_hits")


@query(f"WITH c AS (SELECT user_id, event_type, row_number() OVER ({ORDER}) - 1 AS p, (event_type IS DISTINCT FROM lag(event_type) OVER ({ORDER}))::INT AS new, ts, event_id FROM events), s AS (SELECT *, sum(new) OVER ({ORDER}) AS segment FROM c) SELECT user_id, segment::BIGINT AS segment, event_type, p // 4 AS line, min(p) % 4 AS from_place, max(p) % 4 AS to_place FROM s GROUP BY ALL")
def wrapped_segments(spark, sf):
    return ordered.wrapped_runs(chain(spark, sf), "user_id", ["ts", "event_id"], "event_type", 4)


@query("WITH n AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS size FROM lineitem GROUP BY ALL HAVING max(l_quantity) BETWEEN 10 AND 40) SELECT l.l_orderkey, l.l_linenumber AS ligand, string_agg(r.l_linenumber::VARCHAR, ',' ORDER BY r.l_linenumber) AS receptor FROM n l JOIN n r ON l.l_orderkey = r.l_orderkey AND l.l_linenumber <> r.l_linenumber GROUP BY ALL HAVING count(*) > 1 OR l.l_linenumber < min(r.l_linenumber)")
def one_vs_rest_sized(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("size"))
    out = spatial.one_vs_rest(n, "l_orderkey", "l_linenumber", "size", 10, 40)
    return out.select("l_orderkey", "ligand", F.concat_ws(",", F.col("receptor").cast("array<string>")).alias("receptor"))


@query("WITH a AS (SELECT c_custkey AS k, min(c_acctbal) AS v FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1), b AS (SELECT l_orderkey AS o, min(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT o_orderkey, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'first' WHEN b.v IS NOT NULL THEN 'second' ELSE 'compute' END AS origin FROM orders LEFT JOIN a ON o_custkey = k LEFT JOIN b ON o_orderkey = o")
def catalogue_lookup(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("v"), (F.col("c_custkey") % 3).alias("status"))
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("v"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("status"))
    return joins.catalogue_lookup(o, a, "o_custkey", b, "o_orderkey", "v").select("o_orderkey", "v", "origin")


@query("WITH l AS (SELECT l_suppkey AS g, l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_quantity > 2), r AS (SELECT l_suppkey AS g, l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_quantity < 48), u AS (SELECT coalesce(l.g, r.g) AS g, l.k IS NOT NULL AND r.k IS NOT NULL AS two FROM (SELECT DISTINCT * FROM l) l FULL JOIN (SELECT DISTINCT * FROM r) r ON l.g = r.g AND l.k = r.k AND l.n = r.n), j AS (SELECT g, count(*) AS rows FROM l JOIN r USING (g, k, n) GROUP BY 1), c AS (SELECT g, count(*) AS n, count(*) FILTER (NOT two) AS o, coalesce(max(rows), 0) AS rows FROM u LEFT JOIN j USING (g) GROUP BY 1) SELECT g, CASE WHEN o > 0.1 * n THEN 'rejected' ELSE 'kept' END AS verdict, CASE WHEN o > 0.1 * n THEN o ELSE rows END AS n FROM c WHERE o > 0.1 * n OR rows > 0")
def matched_rows(spark, sf):
    base = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_quantity")
    kept, rejects = joins.matched_rows(base.filter("l_quantity > 2").drop("l_quantity"), base.filter("l_quantity < 48").drop("l_quantity"), ["g", "k", "n"], "g")
    kept = kept.groupBy("g").agg(F.count("*").alias("n")).select("g", F.lit("kept").alias("verdict"), "n")
    return kept.unionByName(rejects.select("g", F.lit("rejected").alias("verdict"), F.col("one_sided").alias("n")))


@query(f"WITH e AS (SELECT user_id, event_type, ts, event_id FROM events), s AS (SELECT user_id, regexp_replace(string_agg(CASE WHEN event_type = 'click' THEN 'X' ELSE upper(left(event_type, 1)) END, '' ORDER BY ts, event_id), 'X+$', '') AS sequence, avg((event_type <> 'click')::INT) AS share FROM e GROUP BY 1) SELECT user_id, sequence FROM s WHERE share > 0.5 AND length(sequence) > 12")
def chain_sequences(spark, sf):
    c = chain(spark, sf).withColumn("letter", F.when(F.col("event_type") == "click", "X").otherwise(F.upper(F.substring("event_type", 1, 1))))
    return joins.chain_sequences(c, ["user_id"], ["ts", "event_id"], "letter", F.col("event_type") != "click").select("user_id", "sequence")


@query("SELECT page_id, regexp_replace(url, '[a-z]', '', 'g') AS kept FROM pages")
def insertions_removed(spark, sf):
    return table(spark, sf, "pages").select("page_id", without_insertions(F.col("url")).alias("kept"))


@query("SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[-a-z]', '', 'g')) AS quality, upper(regexp_replace(coalesce(lang, ''), '[ \\t\\n]+', '', 'g')) AS letters, regexp_matches(upper(coalesce(lang, '')), '^[ABCDEFGHIKLMNPQRSTVWXYZ]+$') AS valid, upper(string_split_regex(source, '[:@#-]')[1]) AS base FROM documents")
def text_feature_table(spark, sf):
    d = table(spark, sf, "documents")
    lang = clean_sequence(F.coalesce("lang", F.lit("")))
    return d.select("doc_id", alignment_quality(F.coalesce("text", F.lit(""))).alias("quality"), lang.alias("letters"), valid_sequence(lang).alias("valid"), base_id(F.col("source")).alias("base"))
