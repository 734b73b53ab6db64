"""Toxicity of documents: boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and word beginnings that are far more frequent in toxic training documents.  Features are
its densities (also with digits and symbols read as letters), hits near a second person, capitals, exclamation and other
punctuation, and obfuscated words.

Learning takes at most ``TRAIN_ROWS`` labelled rows, those of smallest id hash; their ids and labels are small enough to be
broadcast (16 bytes each), and their features to be collected.  Scoring is row by row over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm import boosting
from changeloom.llm.language import held_out
from changeloom.llm.texts import LOWER, SAME, Words, _power_tables, mix, runs

TRAIN_ROWS = 40_000
LEXICON = 8_192
# Lexicon entries occur in at least so many toxic training documents, and are so many times as frequent there.
LEAST_DOCUMENTS, STRONG, WEAK = 6, 3.0, 1.5
BEGINNINGS = (4, 5, 6, 7)
NEAR = 5

# Second person in the four languages at hand; other words may be passed to ``features``.
SECOND_PERSON = ("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos "
                 "tú ti usted ustedes tus vosotros").split()

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
# Characters that stand for letters: 0 o, 1 i, 3 e, 4 a, 5 s, 7 t, @ a, $ s, ! i.
_SPELLED = dict(zip(b"013457@$!", b"oieastasi"))
_PLAIN_GAP = ~_LETTERS
_SPELLED_GAP = ~_LETTERS
_SPELLED_GAP[list(_SPELLED)] = False
_READ = LOWER.copy()
for _byte, _letter in _SPELLED.items():
    _READ[_byte] = SAME[_letter]


def _units(words: Words, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, hashes) of word beginnings of each length, and of whole words of other lengths."""
    sums = words.prefix_sums(table)
    size = words.end - words.start
    for k in BEGINNINGS:
        at = np.flatnonzero(size >= k)
        yield at, _prefix(words, sums, at, k)
    at = np.flatnonzero((size < BEGINNINGS[0]) & (size > 1) | (size > BEGINNINGS[-1]))
    yield at, words.hashes(table, sums)[at]


def _prefix(words: Words, sums: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    _, inverse = _power_tables(len(sums))
    start = words.start[at]
    return mix((sums[start + k] - sums[start]) * inverse[start] + np.full(len(at), k, np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of a task with the number of toxic and of other documents that hold them."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged():
        unit, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return unit, *(np.bincount(at, np.concatenate([p[i] for p in parts])).astype(np.int64) for i in (1, 2))

    for batch in batches:
        toxic = np.asarray(batch.column(1))
        for first, end, data, offsets in runs(batch.column(0)):
            words = Words(data, offsets, _PLAIN_GAP)
            text = np.repeat(np.arange(first, end), np.diff(words.bounds))
            found = list(_units(words, LOWER))
            of = np.concatenate([text[at] for at, _ in found])
            unit = np.concatenate([h for _, h in found])
            order = np.lexsort((unit, of))
            of, unit = of[order], unit[order]
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (unit[1:] != unit[:-1])
            label = toxic[of[new]]
            parts.append((unit[new], (label > 0).astype(np.int64), (label <= 0).astype(np.int64)))
            if len(parts) >= 16:
                parts = [merged()]
    if parts:
        unit, yes, no = merged()
        yield pa.RecordBatch.from_arrays([pa.array(unit.view(np.int64)), pa.array(yes), pa.array(no)], names=["unit", "yes", "no"])


FEATURES = ("strong", "strong_rate", "weak_rate", "spelled", "spelled_rate", "near_second", "second_rate", "capitals", "shouted",
            "exclamation", "punctuation", "obfuscated", "log_words")


def features(column: pa.Array, strong: np.ndarray, weak: np.ndarray, second: list[str] = SECOND_PERSON) -> np.ndarray:
    """[text, feature].  ``strong`` and ``weak`` are sorted hashes of lexicon units."""
    you = np.concatenate([Words(d := np.frombuffer(w.encode(), np.uint8), np.array([0, len(d)])).hashes(LOWER) for w in second])
    out = []
    for first, end, data, offsets in runs(column):
        n = end - first
        words = Words(data, offsets, _PLAIN_GAP)
        text = np.repeat(np.arange(n), np.diff(words.bounds))
        total = np.maximum(np.diff(words.bounds), 1)

        def hits(w: Words, table: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
            hit = np.zeros(len(w.start), bool)
            for at, unit in _units(w, table):
                hit[at] |= _within(unit, lexicon)
            return hit

        hard, soft = hits(words, LOWER, strong), hits(words, LOWER, weak)
        spelled = Words(data, offsets, _SPELLED_GAP)
        spelled_text = np.repeat(np.arange(n), np.diff(spelled.bounds))
        read = hits(spelled, _READ, strong)
        person = np.isin(words.hashes(LOWER), you)
        # Second persons within NEAR words on either side, not across texts.
        count = np.concatenate(([0], np.cumsum(person)))
        here = np.arange(len(person))
        low = np.maximum(here - NEAR, words.bounds[text])
        high = np.minimum(here + NEAR + 1, words.bounds[text + 1])
        near = hard & (count[high] > count[low])

        def sums(flags: np.ndarray) -> np.ndarray:
            running = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
            return running[offsets[1:]] - running[offsets[:-1]]

        letters = np.maximum(sums(_LETTERS[data]), 1)
        upper = (data >= 65) & (data <= 90)
        inside = np.zeros(len(data), bool)
        if len(data) > 2:
            inside[1:-1] = _LETTERS[data[:-2]] & _LETTERS[data[2:]] & ~_LETTERS[data[1:-1]] & (data[1:-1] > 32) & (
                data[1:-1] != 39) & (data[1:-1] != 45)
        size = words.end - words.start
        capital = np.concatenate(([0], np.cumsum(upper, dtype=np.int64)))
        shouted = (size > 2) & (capital[words.end] - capital[words.start] == size)

        def of(flags: np.ndarray, where: np.ndarray = text) -> np.ndarray:
            return np.bincount(where[flags], minlength=n).astype(float)

        punctuation = (data > 32) & (data < 128) & ~_LETTERS[data] & ~((data >= 48) & (data <= 57))
        out.append(np.stack([
            np.log1p(of(hard)), of(hard) / total, of(soft) / total, np.log1p(of(read, spelled_text)), of(read, spelled_text) / total,
            np.log1p(of(near)), of(person) / total, sums(upper) / letters, of(shouted) / total, sums(data == 33) / total,
            sums(punctuation) / total, sums(inside) / total, np.log1p(np.diff(words.bounds)),
        ], axis=1))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _rows(batches: Iterator[pa.RecordBatch], strong: np.ndarray, weak: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column(0), strong, weak)
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))],
                                         names=["toxic", "place", "x"])


def learn(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, boosting.Forest]:
    """(strong units, weak units, calibrated trees) from labelled rows that aren't held out."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(
        F.col("doc_id").cast("bigint").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    # At most TRAIN_ROWS rows of 16 bytes: the bound for the broadcast.
    sample = F.broadcast(marked.orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS))
    train = documents.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").cast("string").alias("_text")).where(
        "_text IS NOT NULL").join(sample, "_id")
    units = train.select("_text", "_toxic").mapInArrow(_unit_counts, "unit bigint, yes bigint, no bigint")
    size = marked.agg(F.sum("_toxic"), F.sum(1 - F.col("_toxic"))).first()
    yes, no = (max(1, x or 0) for x in size)
    odds = F.log((F.col("yes") + 0.5) / F.lit(yes + 1.0)) - F.log((F.col("no") + 0.5) / F.lit(no + 1.0))
    found = units.groupBy("unit").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).where(
        F.col("yes") >= LEAST_DOCUMENTS).withColumn("odds", odds).where(F.col("odds") >= WEAK).orderBy(
        F.desc("odds"), "unit").limit(LEXICON).select("unit", "odds").collect()
    unit = np.array([r[0] for r in found], np.int64).view(np.uint64)
    strong = np.sort(unit[[r[1] >= STRONG for r in found]]) if found else unit
    weak = np.sort(unit)
    rows = train.select("_text", "_toxic", F.xxhash64("_id").alias("place")).mapInArrow(
        partial(_rows, strong=strong, weak=weak), "toxic int, place bigint, x array<double>").toPandas()
    rows = rows.sort_values("place", kind="stable") if len(rows) else rows
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return strong, weak, boosting.fit(x, (rows["toxic"].to_numpy(float) > 0).astype(float))


def scorer(strong: np.ndarray, weak: np.ndarray, forest: boosting.Forest):
    """Arrow UDF: probability that a text is toxic."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(boosting.probability(forest, features(texts, strong, weak)), pa.float64())

    return score


def document_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``documents``.

    Learned from texts and ``labels.toxic`` of ids that aren't held out; of several labels for one id the largest counts, NULL
    labels don't.  NULL and empty texts get the score of an empty text.  Without labels of both kinds every row gets the share
    of toxic labels.  Rows are scored one by one.
    """
    score = scorer(*learn(documents, labels))
    scored = documents.select("doc_id", held_out().alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
