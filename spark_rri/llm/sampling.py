"""Bounded, repeatable samples of labelled texts for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def balanced_rows(rows: DataFrame, label: str, per_label: int, key: str = "doc_id") -> tuple[DataFrame, dict]:
    """About ``per_label`` rows of each label value, chosen by a hash of the key, never much more; and the counts of all.

    One pass counts the labels without reading texts; rows are kept whose hash falls under their
    label's share. The number of label values is small by nature (languages, 0/1).
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_label / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    most = max([min(1.0, per_label / n) for n in counts.values()], default=0.0)
    rows = rows.filter(draw < most)  # on the key alone, so it holds below a join of texts with labels
    return rows.filter(draw < share), counts


def balanced_sample(rows: DataFrame, label: str, per_label: int, key: str = "doc_id") -> tuple[list, dict]:
    """The rows of ``balanced_rows``, collected in order of the key."""
    chosen, counts = balanced_rows(rows, label, per_label, key)
    return sorted(chosen.collect(), key=lambda r: (r[key] is None, r[key])), counts
