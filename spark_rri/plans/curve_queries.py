"""Registered queries of curves over thresholds, with their SQL."""

from __future__ import annotations

from ..operators import curves
from ..operators import evaluation as ev
from .queries import query, rounded
from .standins import SCORES, scores

COUNTS = f"WITH {SCORES}, b AS (SELECT lang, score, count(*) AS n, count(*) FILTER (label = 1) AS p FROM scores GROUP BY ALL)"
DOWN = "WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"
PR = f"{COUNTS}, r AS (SELECT lang, score, p, sum(p) OVER w / sum(n) OVER w AS prec, sum(p) OVER w / nullif(sum(p) OVER (PARTITION BY lang), 0) AS reca, sum(p) OVER (PARTITION BY lang) AS total FROM b {DOWN})"


@query(f"{PR} SELECT lang, round(sum(prec * p / total), 6) AS average_precision FROM r WHERE total > 0 GROUP BY lang")
def average_precision(spark, sf):
    return rounded(curves.average_precision(scores(spark, sf), "lang", "score", "label"), "average_precision")


@query(f"{PR}, s AS (SELECT lang, (reca - lag(reca) OVER o) * (prec + lag(prec) OVER o) / 2 AS slab FROM r WHERE total > 0 AND reca > 0.01 WINDOW o AS (PARTITION BY lang ORDER BY score DESC)) SELECT lang, round(coalesce(sum(slab), 0), 6) AS pr_auc FROM s GROUP BY lang")
def pr_auc(spark, sf):
    return rounded(curves.pr_auc(scores(spark, sf), "lang", "score", "label"), "pr_auc")


@query(f"{COUNTS}, r AS (SELECT lang, sum(p) OVER w / sum(p) OVER (PARTITION BY lang) AS y, sum(n - p) OVER w / nullif(sum(n - p) OVER (PARTITION BY lang), 0) AS x FROM b {DOWN}), s AS (SELECT lang, x AS x1, y AS y1, lag(x, 1, 0) OVER o AS x0, lag(y, 1, 0) OVER o AS y0 FROM r WINDOW o AS (PARTITION BY lang ORDER BY x, y)), g AS (SELECT lang, k, y0 + (y1 - y0) * (k / 100 - x0) / (x1 - x0) AS v FROM s, range(1, 101) t(k) WHERE k > floor(x0 * 100 + 1e-9) AND k <= floor(x1 * 100 + 1e-9) UNION ALL SELECT DISTINCT lang, 0, 0::DOUBLE FROM r) SELECT k / 100 AS x, round(avg(v), 6) AS mean, count(*) AS parts FROM g GROUP BY k")
def mean_roc_curve(spark, sf):
    return rounded(curves.mean_curve(ev.roc_points(scores(spark, sf), "lang", "score", "label"), "lang", "fpr", "tpr"), "mean")
