"""SQL that gives the rows of the text queries that SQL can express.

Runs of words are named by hashes of hashes: a run of 2n words by those of its halves.
"""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPLIT = "regexp_extract_all(coalesce({}, ''), '[^\\x20\\x09-\\x0D]+')"
BY = "OVER (PARTITION BY doc_id ORDER BY i)"


def _words(text: str = "text") -> str:
    """d: doc_id, text, list of words; w: a row per word."""
    return f"d AS (SELECT doc_id, text, {SPLIT.format(text)} AS ws FROM documents), w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM d)"


def _doubled(name: str, most: int) -> str:
    """Tables h1, h2, h4, ... most with the names of runs of 1, 2, 4, ... words."""
    out, k = [f"{name}1 AS (SELECT doc_id, i, n, word, hash(word) AS h1 FROM w)"], 1
    while k < most:
        out.append(f"{name}{2 * k} AS (SELECT *, hash(h{k}, lead(h{k}, {k}) {BY}) AS h{2 * k} FROM {name}{k})")
        k *= 2
    return ", ".join(out)


def _covered(flag: str, n: int) -> str:
    return f"max({flag}::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


LOWERED = f"translate(text, '{UPPER}', '{UPPER.lower()}')"

OP6 = f"""WITH RECURSIVE {_words(LOWERED)}, {_doubled("h", 4)},
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, i, n, hash(h4, lead(h1, 4) {BY}) AS g FROM h4) WHERE i + 4 <= n
  UNION ALL SELECT doc_id, hash(array_to_string(ws, ' '), 'short') FROM d WHERE len(ws) BETWEEN 1 AND 4),
z AS (SELECT doc_id, count(*) AS n, hash(list_sort(list(g))) AS whole FROM s GROUP BY 1),
r AS (SELECT whole, any_value(n) AS n, min(doc_id) AS rep FROM z GROUP BY 1),
t AS (SELECT s.doc_id AS rep, g FROM s WHERE doc_id IN (SELECT rep FROM r)),
p AS (SELECT x.rep AS a, y.rep AS b, count(*) AS shared FROM t x JOIN t y ON x.g = y.g AND x.rep < y.rep GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN r x ON x.rep = a JOIN r y ON y.rep = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT rep AS v, rep AS label FROM r UNION SELECT u.b, reach.label FROM reach JOIN u ON u.a = reach.v),
c AS (SELECT v AS rep, min(label) AS label FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(c.label, d.doc_id) AS component_id FROM d LEFT JOIN z USING (doc_id) LEFT JOIN r ON r.whole = z.whole LEFT JOIN c ON c.rep = r.rep"""

OP7 = f"""WITH {_words()}, {_doubled("h", 32)},
g AS (SELECT doc_id, i, word, CASE WHEN i + 34 <= n THEN hash(h32, lead(h2, 32) {BY}, lead(h1, 34) {BY}) END AS g FROM h32),
f AS (SELECT *, g IS NOT NULL AND count(*) OVER (PARTITION BY g) > 1 AS again FROM g),
k AS (SELECT doc_id, i, word, {_covered("again", 35)} AS gone FROM f),
o AS (SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM k GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)"""

OP8 = f"""WITH {_words()}, {_doubled("h", 64)},
g AS (SELECT doc_id, i, n, CASE WHEN i + 2 <= n THEN hash(h2, lead(h1, 2) {BY}) END AS g3, CASE WHEN i + 7 <= n THEN h8 END AS g8, CASE WHEN i + 100 <= n THEN hash(h64, lead(h32, 64) {BY}, lead(h4, 96) {BY}, lead(h1, 100) {BY}) END AS g101 FROM h64),
f AS (SELECT doc_id, i, {", ".join(f"g{k} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{k}) > 1 AS a{k}" for k in (3, 8, 101))} FROM g),
c AS (SELECT doc_id, {_covered("a3", 3)} AS c3, {_covered("a8", 8)} AS c8, a101 FROM f),
o AS (SELECT doc_id, sum(c3)::BIGINT AS r3, sum(c8)::BIGINT AS r8, bool_or(a101) AS long FROM c GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
x AS (SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(m.n, 0) AS n_dup_lines, coalesce(r3, 0) AS n_repeat_words, coalesce(r8, 0) AS r8, coalesce(long, false) AS long FROM d LEFT JOIN o USING (doc_id) LEFT JOIN m ON m.doc_id = d.doc_id),
y AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, r8 / greatest(n_words, 1) AS repeat_fraction FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND repeat_fraction <= 0.3 AND NOT long AS kept, repeat_fraction FROM y"""

BYTES = "d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(hex(coalesce(text, '')), '..') AS ws FROM documents), w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM d)"

OP2 = f"""WITH {BYTES}, {_doubled("h", 128)},
g AS (SELECT doc_id, i, word, CASE WHEN i + 199 <= n THEN hash(h128, lead(h64, 128) {BY}, lead(h8, 192) {BY}) END AS g FROM h128),
f AS (SELECT *, g IS NOT NULL AND count(*) OVER (PARTITION BY g) > 1 AS again FROM g),
k AS (SELECT doc_id, i, word, {_covered("again", 200)} AS gone FROM f),
s AS (SELECT *, gone = 1 AND coalesce(lag(gone) {BY}, 0) = 0 AS first FROM k),
o AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, count(*) FILTER (first) AS n_spans, string_agg(word, '' ORDER BY i) FILTER (gone = 0) AS kept FROM s GROUP BY 1)
SELECT d.doc_id, strlen(text) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)"""



def _clustering(rounds: int = 3) -> str:
    """k-means on integers, one block of tables a round."""
    # a sum less its positive remainder is the floored mean times the count
    parts = ["""kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""", "k AS (SELECT row_number() OVER () AS id, * FROM kept)", "x AS (SELECT id, unnest(v) AS x, unnest(range(64)) AS dim FROM k)", "start AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS num, id FROM k QUALIFY num < 16)", "c0 AS (SELECT num, dim, x AS c FROM start JOIN x USING (id))"]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS MATERIALIZED (SELECT id, num, sum((x - c) * (x - c))::BIGINT AS distance FROM x JOIN c{r} USING (dim) GROUP BY ALL)")
        parts.append(f"a{r} AS (SELECT id, arg_min(num, (distance, num)) AS num, min(distance) AS distance FROM d{r} GROUP BY 1)")
        if r < rounds:
            parts.append(f"m{r} AS (SELECT num, dim, sum(x) AS s, count(*) AS n FROM a{r} JOIN x USING (id) GROUP BY ALL)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT num, dim, coalesce((s - ((s % n) + n) % n) // n, c)::BIGINT AS c FROM c{r} LEFT JOIN m{r} USING (num, dim))")
    return f"WITH {', '.join(parts)}, h AS (SELECT num, sha256(string_agg(c::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY 1) SELECT vec_id, num::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY num))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN k USING (id) JOIN h USING (num)"


#: crc32 of a text of ASCII characters: bit by bit, with the polynomial's fixed value.
CRC32 = "xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split({0}, ''), lambda s: ascii(s)::UBIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::UBIGINT for z in range(8)]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"


def _levels(name: str, nodes: str, group: str, most: int) -> list[str]:
    """Tables name0, name1, ... of a tree's levels: group, pos, n, digest; and each node's siblings left and right."""
    out = [f"{name}0 AS MATERIALIZED ({nodes})"]
    for k in range(most):
        run = f"OVER (PARTITION BY {group}, pos // 8 ORDER BY pos ROWS BETWEEN"
        out.append(f"{name}s{k} AS MATERIALIZED (SELECT *, coalesce(string_agg(digest, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(digest, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT {group}, pos // 8 AS pos, any_value((n + 7) // 8) AS n, CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM {name}{k} GROUP BY ALL)")
    return out


def _manifest(deep: int = 9, wide: int = 3) -> str:
    """Trees of up to 8 ** deep leaves over up to 8 ** wide languages; levels above a tree's last node change nothing."""
    bare = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    fields = " || ".join(bare(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    parts = [f"f AS (SELECT *, {fields} AS head, CASE WHEN {CRC32.format('doc_id::VARCHAR')} % 3 = 0 THEN {low} ELSE text END AS other FROM documents)", f"e AS MATERIALIZED (SELECT doc_id, lang, sha256(head || {bare('text')}) AS leaf, sha256(head || {bare('other')}) AS tampered FROM f)", "g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM e))", "b AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n, doc_id, leaf, tampered FROM e JOIN g ON e.lang IS NOT DISTINCT FROM g.lang)"]
    parts += _levels("t", "SELECT g, pos, n, leaf AS digest FROM b", "g", deep)
    parts += _levels("u", f"SELECT 0 AS one, g AS pos, (SELECT count(*) FROM g) AS n, digest FROM t{deep}", "one", wide)
    parts.append("p0 AS (SELECT b.*, tampered AS h, '' AS proof FROM b)")
    steps = [(f"ts{k}", f"s.g = p.g AND s.pos = p.pos // {8**k}") for k in range(deep)] + [(f"us{k}", f"s.pos = p.g // {8**k}") for k in range(wide)]
    for k, (s, on) in enumerate(steps):
        parts.append(f"p{k + 1} AS MATERIALIZED (SELECT p.* REPLACE (CASE WHEN s.n = 1 THEN h ELSE sha256(l || h || r) END AS h, proof || l || r AS proof) FROM p{k} p JOIN {s} s ON {on})")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, t{deep}.digest AS subroot, u{wide}.digest AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = u{wide}.digest AS verified FROM p{len(steps)} p JOIN t{deep} USING (g), u{wide}"


SQL = {"op2_suffix_array_dedup": OP2, "op6_jaccard_join": OP6, "op7_substring_dedup": OP7, "op8_repetition_rules": OP8, "op11_centroid_clustering": _clustering(), "op13_merkle_manifest": _manifest()}
