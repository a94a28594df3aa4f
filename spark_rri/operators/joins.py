"""Joins with guards, fallbacks and equivalences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import stored
from .scans import placed_in_group

#: Bits of a digit of lengths in ``latest_around``, and spans of a cell that ``overlap_anti_join`` joins row by row.
DIGIT, CROWD = 3, 64


#: Rows of the right side in a block of ``pair_lattice``, rows of the left side for each of them, and pairs made in one task, about.
SIDE_OF_BLOCK, LONGER, PAIRS_A_TASK = 2000, 10, 4_000_000


def pair_lattice(left: DataFrame, right: DataFrame, key: str, contacts: Column) -> DataFrame:
    """All pairs within a group, labelled 1 or -1 by the condition on aliases l and r.

    The pairs grow with the product of a group's sides, so each side is cut into pieces and every two
    pieces meet in a block of their own; tasks are as many as the pairs need, however few the groups.
    A right piece is held and gone through for each left row, so it is short; left rows pass by, so their piece is
    longer, which sends the right side fewer times.
    """
    sizes = left.groupBy(key).agg(F.count("*").alias("__nl")).join(right.groupBy(key).agg(F.count("*").alias("__nr")), key)
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(sizes.agg(F.sum(F.col("__nl") * F.col("__nr"))).first()[0] or 0) // PAIRS_A_TASK))
    pieces = sizes.select(key, *[F.ceil(F.col(n) / rows).alias(n) for n, rows in (("__nl", LONGER * SIDE_OF_BLOCK), ("__nr", SIDE_OF_BLOCK))])
    block = [key, "__a", "__b"]

    def dealt(side: DataFrame, own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
        """The rows with a piece by their hash, once for every piece of the other side."""
        placed = side.join(pieces, key).withColumn(own[0], F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in side.columns]), own[1]))
        return placed.withColumn(other[0], F.explode(F.sequence(F.lit(0).cast("long"), F.col(other[1]) - 1))).drop("__nl", "__nr").repartition(parts, *block)

    a, b = ("__a", "__nl"), ("__b", "__nr")
    l, r = dealt(left, a, b).alias("l"), dealt(right, b, a).alias("r").hint("merge")
    met = l.join(r, reduce(lambda x, y: x & y, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in block]))
    return met.withColumn("categ", F.when(contacts, 1).otherwise(-1)).drop("__a", "__b")


def guarded_merge(left: DataFrame, right: DataFrame, keys: list[str], group: str, tolerance: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(merged, rejects): inner join; groups whose rows change by more than the tolerance are rejected with counts."""
    merged = left.join(right, keys)
    before, after = left.groupBy(group).agg(F.count("*").alias("rows_before")), merged.groupBy(group).agg(F.count("*").alias("rows_after"))
    counts = before.join(after, group, "left").withColumn("rows_after", F.coalesce("rows_after", F.lit(0)))
    bad = F.abs(F.col("rows_before") - F.col("rows_after")) > tolerance * F.col("rows_before")
    rejects = counts.filter(bad).withColumn("reason", F.lit("row count moved more than the tolerance"))
    return merged.join(rejects.select(group), group, "left_anti"), rejects


#: The ids of a pair of residues.
PAIR_IDS = ["chainIdL", "resIdL", "resNameL", "chainIdR", "resIdR", "resNameR"]


def pair_feature_merge(pairs: DataFrame, features: DataFrame, group: str, ids: list[str] = PAIR_IDS, tolerance: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(pairs with the pair features, marked _P, rejects): inner join by group and the six ids of a pair; groups that lose more than 1 % are rejected."""
    keys = [group, *ids]
    named = features.select(*keys, *[F.col(c).alias(c if c.endswith("_P") else f"{c}_P") for c in features.columns if c not in keys])
    return guarded_merge(pairs, named, keys, group, tolerance)


def in_all(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """The keys that every table holds, each once; a NULL is a key like others."""
    return reduce(lambda a, b: a.intersect(b), [t.select(*keys) for t in tables])


def outer_indicator(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full join of the keys with where each was found."""
    l, r = left.select(*keys, F.lit(1).alias("__l")).distinct(), right.select(*keys, F.lit(1).alias("__r")).distinct()
    side = F.when(F.col("__r").isNull(), "left_only").when(F.col("__l").isNull(), "right_only").otherwise("both")
    return l.join(r, keys, "full").select(*keys, side.alias("found_in"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).union(b.exceptAll(a))


def hit_sets(predicted: DataFrame, true: DataFrame, keys: list[str]) -> DataFrame:
    """Every key with TP, FP or FN."""
    found = outer_indicator(predicted, true, keys)
    names = F.when(F.col("found_in") == "both", "TP").when(F.col("found_in") == "left_only", "FP").otherwise("FN")
    return found.select(*keys, names.alias("hit"))


def fallback_lookup(rows: DataFrame, first: DataFrame, first_key: str, second: DataFrame, second_key: str, value: str, default) -> DataFrame:
    """The value by the first key, else by the second, else the default."""
    a, b = first.select(first_key, F.col(value).alias("__a")), second.select(second_key, F.col(value).alias("__b"))
    return rows.join(a, first_key, "left").join(b, second_key, "left").withColumn(value, F.coalesce("__a", "__b", F.lit(default))).drop("__a", "__b")


def catalogue_lookup(rows: DataFrame, first: DataFrame, first_key: str, second: DataFrame, second_key: str, value: str) -> DataFrame:
    """Adds the value and where it comes from: ``first`` key, else ``second`` key, else ``compute`` (value NULL).

    An entry counts only with status 0; of several of a key, the least value.
    """
    good = lambda t, k, out: t.filter("status = 0").groupBy(k).agg(F.min(value).alias(out))
    out = rows.join(good(first, first_key, "__a"), first_key, "left").join(good(second, second_key, "__b"), second_key, "left")
    origin = F.when(F.col("__a").isNotNull(), "first").when(F.col("__b").isNotNull(), "second").otherwise("compute")
    return out.withColumns({value: F.coalesce("__a", "__b"), "origin": origin}).drop("__a", "__b")


def matched_rows(left: DataFrame, right: DataFrame, keys: list[str], group: str, tolerance: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): full match of both tables by keys (the group among them), one-sided rows dropped.

    A group is rejected, with counts, if more than the share ``tolerance`` of its matched keys is one-sided.
    """
    found = outer_indicator(left, right, keys)
    counts = found.groupBy(group).agg(F.count("*").alias("n_keys"), F.count_if(F.col("found_in") != "both").alias("one_sided"))
    rejects = counts.filter(F.col("one_sided") > tolerance * F.col("n_keys")).withColumn("reason", F.lit("too many one-sided rows"))
    return left.join(right, keys).join(rejects.select(group), group, "left_anti"), rejects


def compute_once(rows: DataFrame, key: str, work: Column, out: str) -> DataFrame:
    """Work on every distinct key once and hand the result to all its rows."""
    return rows.join(rows.select(key).distinct().withColumn(out, work), key, "left")


def overlap_anti_join(spans: DataFrame, part: str, start: str, end: str, order: str) -> DataFrame:
    """Drops a span of which a later one of the same part covers more than half; order is a key of the part's spans, start and end are integers.

    A span y covers more than half of x just if it holds x's middle within and is longer than half
    of x. So each span lies in the one or two cells of its length's power of two, and a middle asks
    its cell of each power from half its own length on. Cells of more than CROWD spans are not
    joined row by row: ``latest_around`` answers for them. Spans without length neither cover nor drop.
    """
    b = spans.filter(F.col(end) > F.col(start)).select(part, F.col(order).alias("__o"), F.col(start).cast("long").alias("__s"), F.col(end).cast("long").alias("__e"))
    sized = b.withColumn("__k", F.length(F.bin(F.col("__e") - F.col("__s") - 1)))  # 2**k is the length at least
    keys = [part, "__k", "__bin"]
    cells = sized.select("*", F.explode(F.array_distinct(F.array(F.expr("shiftright(__s, __k)"), F.expr("shiftright(__e - 1, __k)")))).alias("__bin"))
    held = cells.groupBy(*keys).count()
    fullest = {r["__k"]: r["most"] for r in held.groupBy("__k").agg(F.max("count").alias("most")).collect()}
    if not fullest:
        return spans
    level = F.explode(F.filter(F.array(*[F.lit(k) for k in sorted(fullest)]), lambda k: k >= F.col("__own") - 1)).alias("__k")
    asks = sized.withColumnRenamed("__k", "__own").select(part, "__o", "__s", "__e", level).withColumn("__bin", F.expr("shiftright(__s + __e, __k + 1)"))
    crowded = held.filter(F.col("count") > CROWD).select(*keys) if max(fullest.values()) > CROWD else None
    if crowded is not None:
        asking, around = (df.join(crowded, keys, "left_semi").select(*b.columns).distinct() for df in (asks, cells))
        cells = cells.join(crowded, keys, "left_anti")
    x = asks.select(*keys, *[F.col(c).alias(f"__x{c}") for c in b.columns if c != part])
    covers = F.expr("__o > __x__o and 2 * __s < __x__s + __x__e and __x__s + __x__e < 2 * __e and 2 * (__e - __s) > __x__e - __x__s")
    met = x.join(cells, keys).filter(covers).select(part, F.col("__x__o").alias(order))
    if crowded is not None:
        met = met.union(latest_around(asking, around, part))
    return spans.join(met.distinct(), [part, order], "left_anti").select(*[F.col(f"`{c}`") for c in spans.columns])


def latest_around(asking: DataFrame, spans: DataFrame, part: str) -> DataFrame:
    """(part, __o) of the asking rows of which a later one of the spans (both: part, __o, __s, __e) covers more than half.

    Each span hands its order to the dyadic intervals it is made of, by length, and a
    middle asks the intervals around it for the latest order among lengths of over half of its
    own. Lengths are told apart digit by digit: of a longer one some digit is greater and all
    before it are equal. Every span makes rows for the logarithm of the lengths, whatever the number
    of spans it overlaps.
    """
    longest = asking.union(spans).agg(F.max(F.col("__e") - F.col("__s"))).first()[0] or 1
    high, digits = (2 * longest).bit_length(), -(-(2 * longest).bit_length() // DIGIT)
    level = F.explode(F.sequence(F.lit(0), F.lit(high))).alias("__k")
    place = F.explode(F.sequence(F.lit(0), F.lit(digits - 1))).alias("__d")
    prefix, digit = F.expr(f"shiftright(__length, {DIGIT} * (__d + 1))").alias("__prefix"), F.expr(f"cast(shiftright(__length, {DIGIT} * __d) & {(1 << DIGIT) - 1} as int)").alias("__digit")
    keys = [part, "__k", "__bin", "__d", "__prefix"]

    # the whole numbers from 2s + 1 to 2e - 1 as dyadic intervals: at most one at either end of each level
    own = spans.select(part, "__o", (2 * (F.col("__e") - F.col("__s"))).alias("__length"), (2 * F.col("__s") + 1).alias("__lo"), (2 * F.col("__e")).alias("__hi"), level)
    own = own.withColumns({"__a": F.expr("-shiftright(-__lo, __k)"), "__b": F.expr("shiftright(__hi, __k)")})
    odd = lambda c: F.col(c).bitwiseAND(F.lit(1)) != 0
    left = F.when(odd("__a") & (F.col("__a") < F.col("__b")), F.col("__a"))
    right = F.when(odd("__b") & (F.col("__a") + odd("__a").cast("long") < F.col("__b")), F.col("__b") - 1)
    pieces = own.select(part, "__o", "__length", "__k", F.explode(F.array_compact(F.array(left, right))).alias("__bin"))
    pieces = pieces.select("*", place).select(part, "__k", "__bin", "__d", prefix, digit, "__o")
    latest = pieces.groupBy(*keys).agg(*[F.max(F.when(F.col("__digit") > v, F.col("__o"))).alias(f"__over{v}") for v in range((1 << DIGIT) - 1)])

    asked = asking.select(part, "__o", (F.col("__e") - F.col("__s")).alias("__length"), (F.col("__s") + F.col("__e")).alias("__middle"), level)
    asked = asked.select("*", place).select(part, "__o", "__k", F.expr("shiftright(__middle, __k)").alias("__bin"), "__d", prefix, digit)
    found = F.array(*[F.col(f"__over{v}") for v in range((1 << DIGIT) - 1)])
    return asked.filter(F.col("__digit") < (1 << DIGIT) - 1).join(latest, keys).filter(F.col("__o") < found[F.col("__digit")]).select(part, "__o")


def distinct_contacts(contacts: DataFrame, more: DataFrame, ids: list[str], parts: int | None) -> DataFrame:
    """Both tables' distinct rows, dealt to so many partitions before equal ones meet."""
    both = contacts.select(*ids).unionByName(more.select(*ids))
    return (both.repartition(parts, *ids) if parts else both).distinct()


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], parts: int | None) -> DataFrame:
    """Inner join in so many partitions; in Spark's usual number if None."""
    return left.repartition(parts, *keys).join(right.repartition(parts, *keys), keys) if parts else left.join(right, keys)


def equivalent_contacts(contacts: DataFrame, same: DataFrame, key: str, left: str, right: str, parts: int | None = None) -> DataFrame:
    """Adds (r', l') for every contact (l, r) and equivalence l -> l', r -> r' (columns key, node, twin).

    parts: partitions of each step, for contacts that are too many for Spark's usual number.
    """
    l = same.select(key, F.col("node").alias(left), F.col("twin").alias("__lt"))
    r = same.select(key, F.col("node").alias(right), F.col("twin").alias("__rt"))
    met = dealt_join(dealt_join(contacts, l, [key, left], parts), r, [key, right], parts)
    return distinct_contacts(contacts, met.select(key, F.col("__rt").alias(left), F.col("__lt").alias(right)), [key, left, right], parts)


def within_partner_contacts(contacts: DataFrame, same: DataFrame, key: str, left: str, right: str, side: str, parts: int | None = None) -> DataFrame:
    """Adds (l', r) for every contact (l, r) and equivalence l -> l' of the left side's chains, or (l, r') for side ``right``.

    parts: partitions of each step, for contacts that are too many for Spark's usual number.
    """
    end, other = (left, right) if side == "left" else (right, left)
    twins = same.select(key, F.col("node").alias(end), F.col("twin").alias("__twin"))
    met = dealt_join(contacts, twins, [key, end], parts).select(key, F.col("__twin").alias(end), other)
    return distinct_contacts(contacts, met, [key, left, right], parts)


def transfer_labels(contacts: DataFrame, mapping: DataFrame, left: str, right: str) -> DataFrame:
    """Contacts with both ends renamed by a map (columns node, renamed); both must map."""
    l = mapping.select(F.col("node").alias(left), F.col("renamed").alias("__l"))
    r = mapping.select(F.col("node").alias(right), F.col("renamed").alias("__r"))
    return contacts.join(l, left).join(r, right).select(F.col("__l").alias(left), F.col("__r").alias(right))


def coupling_slice(couplings: DataFrame, n_left: int, gap: int) -> DataFrame:
    """The block of a coupling table (i, j, score) between the first ``n_left`` columns and those behind the gap."""
    return couplings.filter((F.col("i") < n_left) & (F.col("j") >= n_left + gap)).select("i", (F.col("j") - n_left - gap).alias("j"), "score")


def best_per_group(rows: DataFrame, keys: list[str], value: str, quality: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, quality).alias(value))


def paired_alignment(left: DataFrame, right: DataFrame, taxon: str, seq: str, joiner: str = "-----") -> DataFrame:
    """Sequences of both sides side by side for every taxon in both; unknown taxa never pair."""
    l, r = left.select(taxon, F.col(seq).alias("__l")), right.select(taxon, F.col(seq).alias("__r"))
    return l.join(r, taxon).select(taxon, F.concat_ws(joiner, "__l", "__r").alias("paired"))


def paired_with_target(left: DataFrame, right: DataFrame, position: str, taxon: str, seq: str, joiner: str = "-----") -> DataFrame:
    """(position, taxon, paired): both alignments' targets (position 0) first, then the best sequences of every taxon of both.

    Best is the longest without gaps and insertions, the least of equals; insertions (lower case) are taken out.
    """
    from ..functions.keys import alignment_quality, without_insertions

    def best(side: DataFrame) -> DataFrame:
        others = side.filter((F.col(position) > 0) & F.col(taxon).isNotNull())
        return others.groupBy(taxon).agg(F.min_by(seq, F.struct(-alignment_quality(F.col(seq)), F.col(seq))).alias(seq))

    plain = lambda df: df.withColumn("paired", without_insertions(F.col("paired")))
    head = lambda side, out: side.filter(F.col(position) == 0).select(F.lit(0).alias(position), F.col(seq).alias(out))
    targets = head(left, "__l").join(head(right, "__r"), position).select(position, F.lit(None).cast("string").alias(taxon), F.concat_ws(joiner, "__l", "__r").alias("paired"))
    return plain(targets.unionByName(paired_alignment(best(left), best(right), taxon, seq, joiner).withColumn(position, F.lit(1))))


def chain_sequences(rows: DataFrame, keys: list[str], order: list[str], letter: str, standard: Column, least: int = 12, share: float = 0.5) -> DataFrame:
    """Sequences of chains of which more than the share is standard residues, without X at the end, longer than ``least``."""
    good = rows.groupBy(*keys).agg(F.avg(standard.cast("double")).alias("__share")).filter(F.col("__share") > share).select(*keys)
    out = assemble(rows.join(good, keys, "left_semi"), keys, order, letter)
    return out.withColumn("sequence", F.regexp_replace("sequence", "X+$", "")).filter(F.length("sequence") > least)


def assemble(rows: DataFrame, keys: list[str], order: list[str], letter: str, out: str = "sequence") -> DataFrame:
    """Letters joined in order."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(letter).alias("__x"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x["__x"]), "").alias(out))


def rmsd(pairs: DataFrame, keys: list[str], squared: Column) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.sqrt(F.avg(squared)).alias("rmsd"))


def greedy_match(cells: DataFrame, part: str, a: str, b: str, cost: str, worst: float) -> DataFrame:
    """For each a its best b among the cells of least cost: at most max(a's, b's) cells, each up to max(worst, best).

    Cells are numbered by ranges of (part, cost, a, b), so a part may fill many tasks.
    """
    placed = placed_in_group(cells, [part], [F.col(cost), F.col(a), F.col(b)], "__at")
    sizes = placed.groupBy(F.col(part).alias("__part")).agg(F.greatest(F.count_distinct(a), F.count_distinct(b)).alias("__n"), F.min(cost).alias("__best"))
    r = placed.join(sizes, F.col(part).eqNullSafe(F.col("__part")))
    good = r.filter((F.col("__at") < F.col("__n")) & (F.col(cost) <= F.greatest(F.lit(worst), F.col("__best"))))
    return good.groupBy(part, a).agg(F.min_by(b, "__at").alias(b), F.min(cost).alias(cost))


def dominant_match(cells: DataFrame, part: str, a: str, b: str, cost: str) -> DataFrame:
    """One-to-one matching of a part's a and b, as if cells were taken by rising (cost, a, b) whenever both ends are free.

    A cell that is the least of its row and of its column would be taken whatever comes before it, so all such
    cells are taken at once, their rows and columns leave, and the rest goes into the next
    round, until none is left. Rounds are as many as the longest chain of cells each of which waits for
    the one before, some log of the cells when costs are not ordered along a path. (a, b) is a key
    of the part's cells; cells with a NULL in part, end or cost are no candidates.
    """
    left = stored(cells.select(part, a, b, cost).dropna())
    place = F.struct(cost, a, b)
    taken = []
    while not left.isEmpty():
        rows = left.groupBy(part, a).agg(F.min(place).alias("__m")).select(part, "__m.*")
        columns = left.groupBy(part, b).agg(F.min(place).alias("__m")).select(part, "__m.*")
        both = stored(rows.join(columns.select(part, a, b), [part, a, b]))
        taken.append(both)
        left = stored(left.join(both.select(part, a), [part, a], "left_anti").join(both.select(part, b), [part, b], "left_anti"))
    return reduce(lambda x, y: x.unionByName(y), taken) if taken else left


def with_previous_scores(pairs: DataFrame, steps: list[DataFrame], keys: list[str], group: str, score: str = "prediction") -> DataFrame:
    """Earlier steps' scores as pair features, raw and standardised by group."""
    from .ordered import z_score

    def feature(k: int, step: DataFrame) -> DataFrame:
        named = step.select(*keys, F.col(score).alias(f"step{k}_P"))
        return z_score(named, group, f"step{k}_P", F.lit(0.0), f"step{k}_z_P")

    return reduce(lambda acc, ks: acc.join(feature(*ks), keys), enumerate(steps), pairs)


def three_way_compare(frames: dict[str, DataFrame], keys: list[str], metric: str, gap: float) -> DataFrame:
    """Rows of all frames whose metric differs by more than the gap between any two."""
    named = [f.select(*keys, F.col(metric).alias(n)) for n, f in frames.items()]
    out = reduce(lambda a, b: a.join(b, keys), named)
    spread = F.greatest(*frames) - F.least(*frames)
    return out.withColumn("spread", spread).filter(F.col("spread") > gap)
