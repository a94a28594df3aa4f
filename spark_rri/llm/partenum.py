"""N-gram Jaccard join by PartEnum signatures, exact for every pair of different texts.

Sets of word shingles fall into bands of similar size; sets of a band and the next share a
tag. A tag splits the shingle domain by a hash into coarse parts of ``FINE`` fine parts each,
and a set signs, for each of its first coarse parts, with every subset of ``FINE - FREE`` fine
parts. Two sets of sizes a and b with similarity of at least 4/5 differ in at most (a + b) / 9
shingles, so among more than half as many coarse parts one has at most ``FREE`` = 1 difference,
and the subset without that fine part agrees. A subset that is empty in both sets would agree
without a signature; a set with so many of them that this could hide a link signs again under
another hash (``LEVELS`` times, then with its empty subsets too), and both sets of a hidden
link are in that case, so none is lost. Sets that can only link with equal sets do not sign.

Sets stand for all documents with the same shingles, so copies never meet. Groups of sets that
share a signature are settled in turns, each linear in their members: first every set meets
one hub, of its groups' most connected sets the nearest; in later turns members outside a
group's largest component meet a member of it, another one in every group, and again only the
nearest counts. Groups that still hold different components then give their pairs across
components, as far as sizes and parity sketches allow a link. Before whole sets are compared, parity
sketches as wide as the sets are large rule most other pairs out.

A group that could give more than ``max_pairs`` of them is not paired. What most of its sets hold,
a passage that many texts share, is taken as the group's core, and its sets are compared by what they do
not share with it: that settles the sets near the core by one hub, and any other two sets that link
must share one of the rarest shingles of what is left. The groups of sets that share such a
shingle have at most half as many sets, and are settled in the same way until they are small (``_told_apart``).

Edge cases: null, empty and blank texts have an empty set and link with nothing; a text of
fewer words than a shingle is one shingle; repeated rows link like copies; rows with a null id are components by their text's group; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER, Rolling, chunks, mix, owners, signed, word_hashes, words
from .components import components
from .storage import Scratch, bounded_batches

SHINGLE = 5
LEVELS = 3
#: Fine parts of a coarse part, and how many of them a signature leaves out.
FINE, FREE = 3, 1
#: Similarity of at least 80 / 100.
OVER, UNDER = 80, 100
SEEN_SETS = 200_000
SKETCH = 16
#: Bits a shingle, at least, of the sketches that are compared before whole sets.
WIDE = 4
SKETCHES = [f"p{k}" for k in range(SKETCH)]
#: Turns in which every set is compared with one member of its groups at most.
TURNS = 2
#: Rounds in which every set is compared with its nearest candidate only, before all that are left are.
NEAREST_FIRST = 1


def bands(limit: int = 1 << 31) -> np.ndarray:
    """Largest size of every band: each reaches from one more than the last to 5/4 of that."""
    tops, low = [], 1
    while low <= limit:
        tops.append(low * UNDER // OVER)
        low = tops[-1] + 1
    return np.array(tops, np.int64)


TOPS = bands()
#: By tag: most differences within it, coarse parts, of which some are spare against empty ones.
MOST = 2 * TOPS // 9
SPARE = 1 + (MOST // (FREE + 1) + 1) // 12
PARTS = MOST // (FREE + 1) + 1 + SPARE


def shingles(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and offsets by text."""
    flat = LOWER[raw]
    starts, ends, wa = words(flat, at)
    h = word_hashes(flat, starts, ends)
    roll = Rolling(h)
    n = np.diff(wa)
    grams = roll.slices(np.arange(max(len(h) - SHINGLE + 1, 0)), np.arange(SHINGLE, max(len(h) + 1, SHINGLE)))
    room = np.maximum(n - SHINGLE + 1, 0)
    where = np.repeat(wa[:-1], room) + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
    text = np.repeat(np.arange(len(n)), room)
    value = grams[where]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    value = np.concatenate([value, roll.slices(wa[short], wa[short + 1])])
    text = np.concatenate([text, short])
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(len(n) + 1))


def digests(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for each set; equal sets have the same, an empty one 0."""
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mix(value ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    out = mix(total[at[1:]] - total[at[:-1]] + mix(np.diff(at).astype(np.uint64)))
    return np.where(np.diff(at) > 0, out | np.uint64(1), np.uint64(0))


def signatures(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of all sets, both tags, repeated under other hashes where parts are empty."""
    size = np.diff(at)
    sets = np.flatnonzero(size)
    band = np.searchsorted(TOPS, size[sets])
    who, sigs = [], []
    for step in (0, 1):
        _sign(value, at, sets, band + step, 0, who, sigs)
    return np.concatenate(who), np.concatenate(sigs)


def _sign(value: np.ndarray, at: np.ndarray, sets: np.ndarray, tag: np.ndarray, level: int, who: list, sigs: list) -> None:
    if not len(sets):
        who.append(np.zeros(0, np.int64))
        sigs.append(np.zeros(0, np.uint64))
        return
    size = at[sets + 1] - at[sets]
    partner = np.minimum(TOPS[tag], size * UNDER // OVER)
    apart = (size + partner) // 9
    used = np.where(apart > 0, apart // (FREE + 1) + 1 + SPARE[tag], 0)
    parts = PARTS[tag]
    own = np.concatenate([[0], np.cumsum(size)])
    k = np.repeat(np.arange(len(sets)), size)
    v = value[np.repeat(at[sets] - own[:-1], size) + np.arange(own[-1])]
    salt = mix((tag * 64 + level * 8).astype(np.uint64))
    x = mix(v ^ salt[k])
    coarse = (x >> np.uint64(33)).astype(np.int64) % parts[k]
    inside = np.flatnonzero(coarse < used[k])
    k, x = k[inside], x[inside]
    base = np.concatenate([[0], np.cumsum(used)])
    fine = (x & np.uint64(0xFFFFFFFF)).astype(np.int64) % FINE
    total = np.zeros(base[-1] * FINE, np.uint64)
    np.add.at(total, (base[k] + coarse[inside]) * FINE + fine, mix(v[inside] + np.uint64(0x2545F4914F6CDD1D)))
    total = total.reshape(-1, FINE)
    owner = owners(base)
    place = mix(salt[owner] + (np.arange(base[-1]) - base[owner]).astype(np.uint64) * np.uint64(2 * FINE))
    found, empty = [], np.zeros(base[-1], bool)
    for left_out in range(FINE):  # every subset of FINE - FREE fine parts leaves out one
        content = total.sum(axis=1) - total[:, left_out]
        empty |= content == 0
        found.append((content, mix(content + mix(place + np.uint64(left_out)))))
    short = np.bincount(owner[empty], minlength=len(sets)) > SPARE[tag]
    for content, sig in found:
        emit = (content != 0) | (short[owner] if level == LEVELS - 1 else False)
        who.append(sets[owner[emit]])
        sigs.append(sig[emit])
    if short.any() and level < LEVELS - 1:
        _sign(value, at, sets[short], tag[short], level + 1, who, sigs)


def parities(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sets x SKETCH numbers of 64 bits: whether an odd number of shingles falls on each bit.

    The bits in which two sketches differ are at most the shingles in which their sets differ.
    """
    n = len(at) - 1
    bit = (mix(value ^ np.uint64(0x9FB21C651E98DF25)) >> np.uint64(40)).astype(np.int64) % (64 * SKETCH)
    odd = np.bincount(owners(at) * (64 * SKETCH) + bit, minlength=n * 64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, 64 * SKETCH), axis=1, bitorder="little").view(np.int64).reshape(n, SKETCH)


def whole_sets(value: np.ndarray, at: np.ndarray) -> list[bytes]:
    raws = value.tobytes()
    return [raws[8 * a : 8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def wide_parities(value: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A parity sketch of each set, of four to eight bits a shingle: a power of two, at least 64."""
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(WIDE * np.diff(at), 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    own = owners(at)
    bit = mix(value ^ np.uint64(0x6A09E667F3BCC909)) & (bits[own] - 1).astype(np.uint64)
    place, times = np.unique(base[own] + bit.astype(np.int64), return_counts=True)
    place = place[times % 2 == 1]
    raws = np.bincount(place >> 3, 1 << (place & 7), minlength=int(base[-1] >> 3)).astype(np.uint8).tobytes()
    return [raws[a:b] for a, b in zip((base[:-1] >> 3).tolist(), (base[1:] >> 3).tolist(), strict=True)]


def least_apart(x: np.ndarray, y: np.ndarray) -> int:
    """In how many shingles two sets differ at least, by their wide sketches; the wider one folds to the other's width."""
    x, y = sorted((x, y), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def may_be_similar(x: np.ndarray, y: np.ndarray, n_x: int, n_y: int) -> bool:
    return 9 * least_apart(x, y) <= n_x + n_y


def are_similar(x: np.ndarray, y: np.ndarray, n_x: int, n_y: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return UNDER * both >= OVER * (n_x + n_y - both)


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def _profiles(plain: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in chunks(batch):
                value, sa = shingles(raw, at)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(sa).astype(np.int64)), pa.array(signed(digests(value, sa))), *map(pa.array, np.ascontiguousarray(parities(value, sa).T))], ["doc_id", "n_shingles", "digest", *SKETCHES])

    return plain.mapInArrow(run, "doc_id long, n_shingles long, digest long, " + ", ".join(f"{c} long" for c in SKETCHES))


def _signed_rows(plain: DataFrame) -> DataFrame:
    """(sig, digest); copies within a task sign once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, raw, at in chunks(batch):
                value, sa = shingles(raw, at)
                d = digests(value, sa)
                if len(seen) > SEEN_SETS:
                    seen.clear()
                fresh = np.zeros(len(d), bool)
                for i, x in enumerate(d.tolist()):
                    if x and x not in seen:
                        seen.add(x)
                        fresh[i] = True
                keep = np.repeat(fresh, np.diff(sa))
                sa = np.concatenate([[0], np.cumsum(np.diff(sa) * fresh)])
                who, sig = signatures(value[keep], sa)
                yield pa.RecordBatch.from_arrays([pa.array(signed(sig)), pa.array(signed(d[who]))], ["sig", "digest"])

    return plain.mapInArrow(run, "sig long, digest long")


def _sets_of(plain: DataFrame, wanted: DataFrame, scratch: Scratch, form: Callable[[np.ndarray, np.ndarray], list[bytes]] = whole_sets) -> DataFrame:
    """(digest, n_shingles, shingles as bytes or another form of them) of the wanted (doc_id, digest)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in chunks(batch):
                value, sa = shingles(raw, at)
                found = pa.array(signed(digests(value, sa)))
                same = pc.equal(found, part.column(2))  # another text of the same id is not the holder
                yield pa.RecordBatch.from_arrays([found, pa.array(np.diff(sa).astype(np.int64)), pa.array(form(value, sa), pa.binary())], ["digest", "n_shingles", "shingles"]).filter(same)

    side = scratch.beside(wanted.select(F.col("doc_id").alias("wanted_id"), "digest"))
    rows = plain.join(side, F.col("doc_id").eqNullSafe(F.col("wanted_id"))).select("doc_id", "text", "digest")
    return rows.mapInArrow(sets, "digest long, n_shingles long, shingles binary")


def _agreeing(pairs: DataFrame, sets: DataFrame, agree: Callable[[np.ndarray, np.ndarray, int, int], bool]) -> DataFrame:
    """The pairs (a, b) whose sets, in the form given, agree."""
    side = lambda c: sets.select(F.col("digest").alias(c), F.col("shingles").alias(f"set_{c}"), F.col("n_shingles").alias(f"n_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
            ok = [agree(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), *n) for x, y, n in zip(batch.column(2), batch.column(3), sizes, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b", "n_a", "n_b")
    return both.mapInArrow(run, "a long, b long")


def _linked(plain: DataFrame, pairs: DataFrame, holders: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of sets whose similarity reaches the threshold, by their whole sets."""
    ends = lambda p: p.select(F.col("a").alias("digest")).union(p.select("b")).distinct().join(holders, "digest")
    sketches = scratch.save(_sets_of(plain, ends(pairs), scratch, wide_parities))
    left = scratch.save(_agreeing(pairs, sketches, may_be_similar).distinct())
    scratch.drop(sketches)
    return _agreeing(left, _sets_of(plain, ends(left), scratch), are_similar)


def _may_link(x: str, y: str) -> Column:
    """A necessary condition on sizes and sketches; no pair that links fails it."""
    sizes = F.expr(f"{UNDER} * least({x}.n_shingles, {y}.n_shingles) >= {OVER} * greatest({x}.n_shingles, {y}.n_shingles)")
    apart = " + ".join(f"bit_count({x}.{c} ^ {y}.{c})" for c in SKETCHES)
    return sizes & F.expr(f"9 * ({apart}) <= {x}.n_shingles + {y}.n_shingles")


def _members(rows: DataFrame) -> DataFrame:
    """(sig, digest), each once, of signatures that at least two sets share."""
    dealt = rows.repartition("sig")
    live = dealt.groupBy("sig").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low < high").select("sig")
    return dealt.join(live.hint("shuffle_hash"), "sig").distinct()


def _central(members: DataFrame) -> DataFrame:
    """(sig, met, digest): every set with its groups' hubs, the sets that meet most others."""
    sizes = members.groupBy("sig").agg(F.count("*").alias("n"))
    degree = members.join(sizes, "sig").groupBy("digest").agg(F.sum("n").alias("degree"))
    hubs = members.join(degree, "digest").groupBy("sig").agg(F.max_by("digest", F.struct("degree", "digest")).alias("met"))
    return members.join(hubs, "sig").filter("digest != met")


def _named(members: DataFrame, label: DataFrame, turn: int) -> DataFrame:
    """(sig, digest, label, top, met, rows, same) of groups with several components.

    top is a group's largest component and met one of its members, another one for every group and turn;
    same counts the pairs of members within components.
    """
    named = members.select("sig", "digest").join(label, "digest", "left").select("sig", "digest", F.coalesce("label", "digest").alias("label"))
    parts = named.groupBy("sig", "label").agg(F.count("*").alias("n"), F.max_by("digest", F.xxhash64("digest", "sig", F.lit(turn))).alias("met"))
    groups = parts.groupBy("sig").agg(F.max(F.struct("n", "label", "met")).alias("m"), F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("same"), F.count("*").alias("labels"))
    return named.join(groups.filter("labels > 1").select("sig", F.col("m.label").alias("top"), F.col("m.met").alias("met"), "rows", "same"), "sig")


def _nearest(met: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b): of the sets that a set meets and may link with, the one with the nearest sketch."""
    met = met.select(F.col("digest").alias("own"), "met").distinct()
    x, y = sketches.alias("x"), sketches.alias("y")
    fit = met.join(x, F.col("own") == F.col("x.digest")).join(y, (F.col("met") == F.col("y.digest")) & _may_link("x", "y"))
    best = fit.groupBy("own").agg(F.min_by("met", F.struct(_apart("x", "y"), "met")).alias("met"))
    return best.select(F.least("own", "met").alias("a"), F.greatest("own", "met").alias("b")).distinct()


def _across(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs of sets in different components, with these, la and lb."""
    of = lambda c: label.select(F.col("digest").alias(c), F.col("label").alias(f"l{c}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.withColumns({"la": F.coalesce("la", "a"), "lb": F.coalesce("lb", "b")}).filter("la != lb")


def _merged(label: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(digest, label) after more links; only the components they touch are walked."""
    across = scratch.save(_across(links, label).select("la", "lb").distinct())
    if not across.take(1):
        return label
    found = components(across, scratch, "la", "lb").select(F.col("node").alias("label"), F.col("label").alias("new"))
    ends = across.select(F.explode(F.array("la", "lb")).alias("digest")).distinct()
    known = label.union(ends.join(label, "digest", "left_anti").select("digest", F.col("digest").alias("label")))
    return scratch.save(known.join(found, "label", "left").select("digest", F.coalesce("new", "label").alias("label")))


def _classes(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(sig, digest): groups that share a set are one, so that each set is in one group only."""
    low = members.groupBy("sig").agg(F.min("digest").alias("low"))
    found = components(members.join(low, "sig").select("low", "digest"), scratch, "low", "digest")
    return found.select(F.col("label").alias("sig"), F.col("node").alias("digest"))


def _each(sets: DataFrame, *names: str) -> DataFrame:
    """A row per shingle of the sets: the named columns and shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in chunks(batch, "shingles"):
                who = pa.array(np.repeat(np.arange(part.num_rows), np.diff(at) // 8))
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(who) for k in range(len(names))], pa.array(raw.view(np.int64))], [*names, "shingle"])

    return sets.select(*names, "shingles").mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "shingle"]))


def _from_core(groups: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(sig, digest, n_shingles, apart, shingles): of every set what it and its group's core do not share.

    The core are the shingles that more than half of the group's sets hold, fewer than two sets' worth.
    """
    own = scratch.save(groups.join(sets, "digest").select("sig", "digest", "n_shingles", "shingles"))
    counts = _each(own, "sig").groupBy("sig", "shingle").agg(F.count("*").alias("n"))
    sizes = own.groupBy("sig").agg(F.count("*").alias("size"))
    core = counts.join(sizes, "sig").filter("2 * n > size").groupBy("sig").agg(F.collect_list("shingle").alias("core"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [np.setxor1d(np.frombuffer(x.as_buffer(), np.int64), np.asarray(c.values, np.int64) if c.is_valid else [], assume_unique=True).astype(np.int64) for x, c in zip(batch.column(3), batch.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in left], pa.int64()), pa.array([x.tobytes() for x in left], pa.binary())], ["sig", "digest", "n_shingles", "apart", "shingles"])

    return scratch.save(own.join(core, "sig", "left").mapInArrow(run, "sig long, digest long, n_shingles long, apart long, shingles binary"))


def _told_apart(groups: DataFrame, label: DataFrame, sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(label, smaller groups): links that a group's core settles, and groups of at most half of its sets that hold all other links.

    Sets of sizes a and b link just if they differ in at most (a + b) / 9 shingles, and they differ
    in what they do not both share with the core C, each set taken as A xor C. With
    s = 9 |A xor C| - a, sets with s_A + s_B <= 0 do link: all that may be so with the set of
    least s, the hub, are linked with it. Any other pair has s_A + s_B > 0 and must share
    (s_A + s_B) / 18 shingles of A xor C and B xor C, so it shares one of the rarest of either. A
    shingle lies in A xor C for at most half of the group, as the core is the majority's.
    """
    apart = _from_core(groups, sets, scratch).withColumn("s", 9 * F.col("apart") - F.col("n_shingles"))
    hub = apart.groupBy("sig").agg(F.min(F.struct("s", "digest")).alias("hub")).select("sig", F.col("hub.s").alias("hub_s"), F.col("hub.digest").alias("hub"))
    apart = scratch.save(apart.join(hub, "sig"))
    far = F.col("s") + F.col("hub_s") > 0
    label = _merged(label, scratch.save(apart.filter(~far & (F.col("digest") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("digest").alias("b")).distinct()), scratch)
    least = apart.filter(far).groupBy("sig").agg(F.min("s").alias("far_s"))
    share = F.expr("greatest(1, (s + if(s + hub_s > 0, hub_s, far_s) + 17) div 18)")
    open_ = apart.join(least, "sig").withColumn("most", F.col("apart") - share + 1)
    rows = _each(open_, "sig", "digest", "most")
    counts = rows.groupBy("sig", "shingle").agg(F.count("*").alias("n"))
    order = Window.partitionBy("sig", "digest").orderBy("n", "shingle")  # as many rows as a set and its core have shingles
    first = rows.join(counts, ["sig", "shingle"]).withColumn("place", F.row_number().over(order)).filter("place <= most and n > 1")
    found = scratch.save(first.select(F.xxhash64("sig", "shingle").alias("sig"), "digest"))
    alike = found.groupBy("sig").agg(F.count("*").alias("n"), F.expr("bit_xor(digest)").alias("x"), F.expr("bit_xor(xxhash64(digest))").alias("y"))
    return label, scratch.save(found.join(alike.groupBy("n", "x", "y").agg(F.min("sig").alias("sig")).select("sig"), "sig"))


def _apart(x: str, y: str) -> Column:
    return F.expr(" + ".join(f"bit_count({x}.{c} ^ {y}.{c})" for c in SKETCHES))


def _paired(members: DataFrame, label: DataFrame, plain: DataFrame, holders: DataFrame, sketches: DataFrame, scratch: Scratch) -> DataFrame:
    """(digest, label) after all links within groups (see _named), found from their pairs across components."""
    near = members.select("sig", "digest", "label", "top").join(sketches, "digest")
    # of two sets in different components at least one is outside the group's largest
    across = F.expr("x.label != y.label and (y.label = y.top or x.digest < y.digest)")
    pairs = near.filter("label != top").alias("x").join(near.alias("y"), (F.col("x.sig") == F.col("y.sig")) & across & _may_link("x", "y"))
    pairs = scratch.save(pairs.select(F.least("x.digest", "y.digest").alias("a"), F.greatest("x.digest", "y.digest").alias("b"), _apart("x", "y").alias("apart")).distinct())
    for turn in range(NEAREST_FIRST + 1):
        pairs = _across(pairs, label).select("a", "b", "apart")
        now = pairs.select("a", "b")
        if turn < NEAREST_FIRST:  # a set's nearest set elsewhere; most components merge by these pairs
            ends = pairs.withColumn("end", F.explode(F.array("a", "b")))
            now = ends.groupBy("end").agg(F.min_by(F.struct("a", "b"), F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        now = scratch.save(now)
        if not now.take(1):
            break
        label = _merged(label, scratch.save(_linked(plain, now, holders, scratch)), scratch)
        pairs = scratch.save(pairs.join(now, ["a", "b"], "left_anti"))
        scratch.release()
    return label


def _settled(members: DataFrame, label: DataFrame, plain: DataFrame, holders: DataFrame, sketches: DataFrame, max_pairs: int, scratch: Scratch) -> DataFrame:
    """(digest, label) after all links between sets that share a signature of members."""
    for turn in range(TURNS):
        if turn:
            members = scratch.save(_named(members, label, turn))
        now = scratch.save(_nearest(members.filter("label != top") if turn else _central(members), sketches))
        if now.take(1):
            label = _merged(label, scratch.save(_linked(plain, now, holders, scratch)), scratch)
        scratch.release()
    members = scratch.save(_named(members, label, TURNS))
    small = F.col("rows") * F.col("rows") - F.col("same") <= max_pairs
    label = _paired(members.filter(small), label, plain, holders, sketches, scratch)
    hot = members.filter(~small).select("sig", "digest")
    sets = None
    while hot.take(1):
        if sets is None:
            hot = scratch.save(_classes(hot, scratch))
            sets = scratch.save(_sets_of(plain, hot.select("digest").join(holders, "digest"), scratch))
        label, groups = _told_apart(hot, label, sets, scratch)
        scratch.release()
        members = scratch.save(_named(groups, label, TURNS))
        label = _paired(members.filter(small), label, plain, holders, sketches, scratch)
        hot = scratch.save(members.filter(~small).select("sig", "digest"))
    return label


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_pairs: int = 250_000) -> DataFrame:
    """One row per document: size of its set and the smallest id of its component.

    max_pairs decides how a group is settled, not what is found.
    """
    scratch = Scratch(docs.sparkSession)
    plain = _plain(docs, id_col, text_col)
    profile = scratch.save(_profiles(plain))
    one = profile.filter("digest != 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), *[F.first(c).alias(c) for c in SKETCHES])
    one = scratch.save(one)
    holders, sketches = one.select("digest", "doc_id"), one.select("digest", "n_shingles", *SKETCHES)
    members = scratch.save(_members(_signed_rows(plain)))
    scratch.release()
    alone = holders.limit(0).select("digest", F.col("digest").alias("label"))
    label = _settled(members, alone, plain, holders, sketches, max_pairs, scratch)
    first = holders.join(label, "digest", "left").select("digest", "doc_id", F.coalesce("label", "digest").alias("label"))
    smallest = first.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = first.join(smallest, "label").select("digest", "component_id")
    return profile.join(named, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, less those whose component has a smaller id.

    Rows that repeat an id are one document, of which one row stays; rows without an id stay.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(near_duplicates(docs, id_col, text_col))
    gone = scratch.beside(found.filter("doc_id != component_id").select(F.col("doc_id").alias("gone_id")).distinct())
    left = docs.alias("d").join(gone.alias("g"), F.col(f"d.`{id_col}`").cast("long") == F.col("g.gone_id"), "left_anti")
    if found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").take(1):
        named, bare = left.filter(F.col(id_col).isNotNull()), left.filter(F.col(id_col).isNull())
        left = named.dropDuplicates([id_col]).union(bare)
    return left
