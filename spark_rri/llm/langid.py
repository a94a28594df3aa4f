"""Language identification of mixed text: script ranges, per-word scores, Viterbi labels.

Every word gets a script from its letters' code points; a script admits only the languages
that were learned in it. Admitted languages score a word by hashed byte n-gram log
probabilities, and a Viterbi pass with a penalty for each change of language labels the
words, so a text's spans come out in one go. The text's language is the one with most
letters under its label.

The model is fitted on all texts with a language: tasks count n-grams and letters, Spark adds
the counts up, and the driver sees one sum for each language and bucket.

Edge cases: a null text or one without a letter is ``und`` with score 0; a text whose letters
are all of scripts never learned gets the most common learned language with score 0; repeated
rows are labelled each; an empty table gives no rows; rows without a language are not learned
from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, Rolling, chunks, counts_of, owners, word_hashes, words
from .storage import bounded_batches

UNKNOWN = "und"
#: Languages whose counts a task holds at a time.
MANY = 64
BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
#: First and last code point of the letters of some scripts (Unicode blocks).
BLOCKS = (
    ("latin", 0x41, 0x2AF),
    ("greek", 0x370, 0x3FF),
    ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F),
    ("arabic", 0x870, 0x8FF),
    ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF),
    ("tamil", 0xB80, 0xBFF),
    ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("cyrillic", 0x1C80, 0x1C8F),
    ("georgian", 0x1C90, 0x1CBF),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("latin", 0x2C60, 0x2C7F),
    ("georgian", 0x2D00, 0x2D2F),
    ("cyrillic", 0x2DE0, 0x2DFF),
    ("kana", 0x3040, 0x30FF),
    ("hangul", 0x3130, 0x318F),
    ("kana", 0x31F0, 0x31FF),
    ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF),
    ("cyrillic", 0xA640, 0xA69F),
    ("latin", 0xA720, 0xA7FF),
    ("devanagari", 0xA8E0, 0xA8FF),
    ("hangul", 0xA960, 0xA97F),
    ("hangul", 0xAC00, 0xD7FF),
    ("han", 0xF900, 0xFAFF),
    ("latin", 0xFB00, 0xFB06),
    ("armenian", 0xFB13, 0xFB17),
    ("hebrew", 0xFB1D, 0xFB4F),
    ("arabic", 0xFB50, 0xFDFF),
    ("arabic", 0xFE70, 0xFEFF),
    ("latin", 0xFF21, 0xFF5A),
    ("kana", 0xFF66, 0xFF9F),
    ("hangul", 0xFFA0, 0xFFDC),
    ("han", 0x20000, 0x323AF),
)
SCRIPTS = tuple(dict.fromkeys(name for name, _, _ in BLOCKS))


#: The table of letters, made once in a worker.
_letter: list[np.ndarray] = []


def code_points(raw: np.ndarray) -> np.ndarray:
    """Code point at each UTF-8 lead byte, 0 at continuation bytes."""
    b = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int32)
    c, b1, b2, b3 = b[:-3], b[1:-2] & 0x3F, b[2:-1] & 0x3F, b[3:] & 0x3F
    return np.select(
        [c < 0x80, c < 0xC0, c < 0xE0, c < 0xF0],
        [c, 0, (c & 0x1F) << 6 | b1, (c & 0x0F) << 12 | b1 << 6 | b2],
        (c & 0x07) << 18 | b1 << 12 | b2 << 6 | b3,
    )


def letters_of(points: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter by its Unicode category, which digits, marks and signs of a script's block are not."""
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letter[0][np.minimum(points, 0x10FFFF)]


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Script index + 1 of letters of a known script, else 0."""
    low, high = (np.array([b[k] for b in BLOCKS]) for k in (1, 2))
    number = np.array([SCRIPTS.index(b[0]) + 1 for b in BLOCKS])
    at = np.searchsorted(low, points, "right") - 1
    return np.where((at >= 0) & (points <= high[at]) & letters_of(points), number[at], 0)


def word_scripts(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent script of each word's letters (index + 1, 0 for none), and its letters."""
    s = scripts_of(code_points(raw))
    present = np.flatnonzero(np.bincount(s, minlength=len(SCRIPTS) + 1)[1:]) + 1
    best, most = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    letters = np.zeros(len(starts), np.int64)
    for k in present:
        n = counts_of(s == k, starts, ends)
        letters += n
        best = np.where(n > most, k, best)
        most = np.maximum(most, n)
    return best, letters


def gram_sums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Per word, the sum of table rows of its n-grams; grams include one byte on either side."""
    padded = np.concatenate([[32], LOWER[raw], [32] * (max(ORDERS) + 1)]).astype(np.uint8)
    roll = Rolling(padded)
    out = np.zeros((len(starts), table.shape[1]), np.float64)
    for order in ORDERS:
        bucket = (roll.grams(order) >> np.uint64(48)).astype(np.int64) + (ORDERS.index(order) << 16)
        total = np.zeros((len(bucket) + 1, table.shape[1]), np.float64)
        np.cumsum(table[bucket], axis=0, out=total[1:])
        # in padded, the word is [start + 1, end + 1) with its neighbours at start and end + 1
        last = np.maximum(ends + 3 - order, starts)
        out += total[last] - total[starts]
    return out


def distinct_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct word once, blanks between: their bytes, starts and ends, and each word's index."""
    _, first, index = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    size = (ends - starts)[first]
    at = np.concatenate([[0], np.cumsum(size + 1)])
    own = np.full(at[-1] + 1, 32, np.uint8)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    own[np.repeat(at[:-1], size) + inside] = raw[np.repeat(starts[first], size) + inside]
    return own, at[:-1], at[:-1] + size, index


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # n-gram buckets x languages, log probability less the mean over languages
    admits: np.ndarray  # scripts + 1 x languages
    common: int
    penalty: float

    def word_scores(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, script: np.ndarray) -> np.ndarray:
        score = gram_sums(raw, starts, ends, self.table)
        admitted = self.admits[script]
        score[~admitted] = -1e3
        score[~admitted.any(axis=1)] = 0
        return score


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; all texts advance together, longest first.

    A step keeps the label for nothing or takes the best other one for the penalty.
    """
    label = np.zeros(len(score), np.int64)
    size = np.diff(first)
    by = np.argsort(-size, kind="stable")
    begin, size = first[:-1][by], size[by]
    if not len(size) or not size[0]:
        return label
    active = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), "right")
    stay = np.zeros(score.shape, bool)
    jump = np.zeros(len(score), np.int64)
    value = score[begin[: active[0]]].copy()
    rows = np.arange(len(size))
    final = np.zeros(len(size), np.int64)
    for t in range(1, size[0]):
        n = active[t]
        if n < len(value):
            final[n : len(value)] = value[n:].argmax(axis=1)
            value = value[:n]
        top = value.argmax(axis=1)
        reach = value[rows[:n], top] - penalty
        keep = value >= reach[:, None]
        at = begin[:n] + t
        stay[at], jump[at] = keep, top
        value = np.where(keep, value, reach[:, None]) + score[at]
    final[: len(value)] = value.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        label[at] = final[:n]
        if t:
            final[:n] = np.where(stay[at, final[:n]], final[:n], jump[at])
    return label


def count_grams(raw: np.ndarray, at: np.ndarray, kind: np.ndarray, kinds: int) -> np.ndarray:
    """N-grams of texts by kind: kinds x buckets of all orders. Each text stands between blanks, so no gram crosses texts."""
    gap = max(ORDERS) + 1
    n, owner = len(at) - 1, owners(at)
    place = np.arange(len(raw)) + (owner + 1) * gap
    padded = np.full(len(raw) + (n + 1) * gap, 32, np.uint8)
    padded[place] = LOWER[raw]
    starts = np.concatenate([place, at[:-1] + np.arange(1, n + 1) * gap - 1])  # of a text's bytes and of the blank before it
    of = np.concatenate([kind[owner], kind]) * BUCKETS
    roll = Rolling(padded)
    return np.concatenate([np.bincount(of + (roll.grams(order)[starts] >> np.uint64(48)).astype(np.int64), minlength=kinds * BUCKETS).reshape(kinds, BUCKETS) for order in ORDERS], axis=1)


def _counted(rows: DataFrame) -> DataFrame:
    """lang, key, n over all texts: of every gram's bucket, then of every script's letters, then of texts."""
    n_scripts = len(SCRIPTS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                key = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key), pa.array(n[key])], ["lang", "key", "n"])
            held.clear()

        for batch in batches:
            for part, raw, at in chunks(batch):
                column = part.column("lang").dictionary_encode()
                names, kind = column.dictionary.to_pylist(), column.indices.to_numpy().astype(np.int64)
                starts, ends, wa = words(raw, at)
                own, s, e, index = distinct_words(raw, starts, ends)
                script, letters = word_scripts(own, s, e)
                by_script = np.bincount(kind[owners(wa)] * n_scripts + script[index], letters[index], minlength=len(names) * n_scripts).reshape(len(names), -1)
                all_counts = np.concatenate([count_grams(raw, at, kind, len(names)), by_script.astype(np.int64), np.bincount(kind, minlength=len(names))[:, None]], axis=1)
                for lang, n in zip(names, all_counts, strict=True):
                    if lang in held:
                        held[lang] += n
                    else:
                        held[lang] = n.copy()
                if len(held) > MANY:
                    yield from told()
        yield from told()

    return rows.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, penalty: float = 8.0, smoothing: float = 0.5, least_share: float = 0.02, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Learn from all texts that have a language; None if there are none."""
    rows = bounded_batches(labelled).select(F.col(text_col).cast("binary").alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    told = _counted(rows).toArrow()
    column = told.column("lang").combine_chunks().dictionary_encode()
    names = column.dictionary.to_pylist()
    languages = sorted(names)
    if not languages:
        return None
    n_grams = len(ORDERS) * BUCKETS
    every = np.zeros((n_grams + len(SCRIPTS) + 2, len(languages)))
    number = np.array([languages.index(x) for x in names])
    every[told.column("key").to_numpy(), number[column.indices.to_numpy()]] = told.column("n").to_numpy()
    counts, letters, texts = every[:n_grams], every[n_grams:-1], every[-1]
    log = np.empty_like(counts)
    for i in range(len(ORDERS)):
        part = slice(i * BUCKETS, (i + 1) * BUCKETS)
        log[part] = np.log((counts[part] + smoothing) / (counts[part].sum(axis=0) + smoothing * BUCKETS))
    seen = counts.sum(axis=1) > 0
    table = np.where(seen[:, None], log - log.mean(axis=1, keepdims=True), 0)
    admits = letters / np.maximum(letters.sum(axis=0), 1) >= least_share
    admits[0] = False
    return LanguageModel(languages, table, admits, int(texts.argmax()), penalty)


SCHEMA = "doc_id long, lang_pred string, score double, n_spans long, spans array<struct<lang:string,first_word:long,n_words:long>>"


def detect(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """One row per document: language, share of letters under it, and the labelled spans of words."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # size fixed by buckets x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, raw, at in chunks(batch):
                yield label(part, raw, at, m, with_spans)

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.25) -> DataFrame:
    """The rows of docs, all columns, that are in one learned language: it labels at least ``least`` of the text's letters.

    Null texts, texts without a letter and texts in scripts that no learned language uses go, and so do all without a model.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at_text).cast(pa.binary())], ["doc_id", "text"])
            low = 0
            for part, raw, at in chunks(own):
                found = label(part, raw, at, shared.value, False)
                good = pc.and_(pc.not_equal(found.column(1), UNKNOWN), pc.greater_equal(found.column(2), least))
                yield batch.slice(low, part.num_rows).filter(good)
                low += part.num_rows

    return bounded_batches(docs).mapInArrow(run, docs.schema)


def label(part: pa.RecordBatch, raw: np.ndarray, at: np.ndarray, m: LanguageModel | None, with_spans: bool) -> pa.RecordBatch:
    starts, ends, wa = words(raw, at)
    own, s, e, index = distinct_words(raw, starts, ends)
    script, letters = word_scripts(own, s, e)
    n, k = len(at) - 1, len(m.languages) if m else 0
    owner = np.repeat(np.arange(n), np.diff(wa))
    share = np.zeros((n, max(k, 1)))
    if m:
        lang = viterbi(m.word_scores(own, s, e, script)[index], wa, m.penalty)
        counted = (letters * m.admits[script].any(axis=1))[index]
        share = np.bincount(owner * k + lang, counted, minlength=n * k).reshape(n, k)
    total = share.sum(axis=1)
    best = np.where(total > 0, share.argmax(axis=1), m.common if m else 0)
    every = np.bincount(owner, counts_of(letters_of(code_points(own)), s, e)[index], minlength=n)  # letters of any script
    lettered = every > 0
    score = np.where(total > 0, share.max(axis=1) / np.maximum(every, 1), 0.0)
    pred = [m.languages[b] if ok and m else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
    score = np.where(lettered, score, 0.0)
    cut = np.zeros(len(starts), bool)
    if m and len(starts):
        cut[0] = True
        cut[1:] = lang[1:] != lang[:-1]
        cut[wa[:-1][np.diff(wa) > 0]] = True
    first = np.flatnonzero(cut)
    edges = np.searchsorted(first, wa)
    n_spans = np.diff(edges) * lettered
    if with_spans and m:
        size = np.append(first[1:], len(starts)) - first
        text = owner[first] if len(first) else np.zeros(0, np.int64)
        good = lettered[text] if len(first) else np.zeros(0, bool)
        items = pa.StructArray.from_arrays([pa.array([m.languages[x] for x in lang[first][good]], pa.string()), pa.array((first - wa[text])[good], pa.int64()), pa.array(size[good], pa.int64())], ["lang", "first_word", "n_words"])
        offsets = np.concatenate([[0], np.cumsum(n_spans)])
        spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)
    else:
        spans = pa.nulls(n, pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())])))
    return pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(n_spans, pa.int64()), spans], ["doc_id", "lang_pred", "score", "n_spans", "spans"])
