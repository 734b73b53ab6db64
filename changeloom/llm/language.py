"""Language of documents by error-correcting output codes.

Every language has a codeword; each bit of it splits the languages into two sides, and one binary classifier over hashed
character n-grams (one to four letters of a word, its edges marked) predicts that bit.  All n-grams of all training texts
are counted by language in one pass; a bit's weights are the log odds of its two sides.  Decoding weighs each bit's loss
by how well that bit does and takes the language of least loss; the gap to the second marks ambiguous texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.llm.texts import mix, runs

# n-grams are hashed into this many buckets.
BUCKET_BITS = 16
LENGTHS = (1, 2, 3, 4)
# With more languages than this the codewords are drawn at random instead of listing all splits.
ALL_SPLITS = 5
RANDOM_BITS = 32
# Texts whose score is lower are ambiguous.
AMBIGUOUS = 0.6
UNKNOWN = "und"

# ASCII letters in lower case and all bytes of other characters; everything else is an edge (0).
_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray      # [language, bit], +1 or -1
    weights: np.ndarray   # [bucket, bit]
    trust: np.ndarray     # per bit


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text is a multiple of 5.  A NULL id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(end positions, buckets) of the n-grams of each length.  None spans two texts or has an edge inside."""
    letters = _LETTER[data].astype(np.uint64)
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    shift = np.uint64(64 - BUCKET_BITS)
    for k in LENGTHS:
        if len(data) < k:
            return
        code = np.zeros(len(data) - k + 1, np.uint64)
        whole = np.ones(len(code), bool)
        for j in range(k):
            part = letters[j:len(data) - k + 1 + j]
            code = code << np.uint64(8) | part
            if j:
                whole &= ~first[j:len(data) - k + 1 + j]
            if 0 < j < k - 1 or k == 1:
                whole &= part > 0
        if k > 1:
            whole &= (code & np.uint64((1 << 8 * (k - 1)) - 1)) > 0
        at = np.flatnonzero(whole)
        yield at, (mix(code[at] + np.uint64(k << 40)) >> shift).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of a task by language: (language, bucket, n)."""
    counts = np.zeros((len(languages), 1 << BUCKET_BITS), np.int64)
    place = {name: i for i, name in enumerate(languages)}
    for batch in batches:
        own = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
        for first, end, data, offsets in runs(batch.column(0)):
            of = np.repeat(own[first:end], np.diff(offsets))
            for at, buckets in _grams(data, offsets):
                counts += np.bincount((of[at] << BUCKET_BITS) + buckets, minlength=counts.size).reshape(counts.shape)
    language, bucket = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(language), pa.array(bucket), pa.array(counts[language, bucket])],
                                     names=["language", "bucket", "n"])


def codewords(n: int) -> np.ndarray:
    """[language, bit] of +1 and -1.  Up to ALL_SPLITS languages: every split into two sides once.  More: random balanced
    splits, with a fixed seed, until all codewords differ in at least a quarter of the bits."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= ALL_SPLITS:
        return np.array([[1, *rest] for rest in product((1, -1), repeat=n - 1) if -1 in rest], float).T
    rng = np.random.default_rng(7)
    while True:
        half = np.where(np.arange(n) % 2, 1.0, -1.0)
        code = np.stack([rng.permutation(half) for _ in range(RANDOM_BITS + 2 * n)], axis=1)
        distance = (code[:, None, :] != code[None, :, :]).sum(2) + np.eye(n) * code.shape[1]
        if distance.min() * 4 >= code.shape[1]:
            return code


def learn(documents: DataFrame) -> Model:
    """Model from the texts and languages of all rows that aren't held out and have both.

    What reaches the driver are the language names and one count per language and bucket.
    """
    rows = documents.where(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0)).select(
        F.col("text").cast("string"), F.col("lang").cast("string"))
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((1 << BUCKET_BITS, 1)), np.ones(1))
    counted = rows.mapInArrow(partial(_count, languages=languages), "language bigint, bucket bigint, n bigint")
    counts = np.zeros((len(languages), 1 << BUCKET_BITS))
    found = counted.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts[found["language"].to_numpy(int), found["bucket"].to_numpy(int)] = found["n"].to_numpy(float)
    # Every language weighs the same, however much text it has.
    share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * counts.shape[1])
    code = codewords(len(languages))
    bits = []
    for column in code.T:
        plus, minus = share[column > 0], share[column < 0]
        bits.append(np.log(plus.mean(0)) - np.log(minus.mean(0)) if len(minus) else np.zeros(counts.shape[1]))
    weights = np.stack(bits, axis=1)
    # A bit is trusted as far as the languages lie apart on it: its weakest language on the right side.
    expected = share @ weights * code
    trust = np.maximum(expected.min(axis=0), 1e-3)
    return Model(languages, code, weights, trust / trust.sum())


def predict(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of every text."""
    names, scores = [], []
    for first, end, data, offsets in runs(column):
        n, bits = end - first, model.weights.shape[1]
        margin, count = np.zeros((n, bits)), np.zeros(n)
        text = np.repeat(np.arange(n), np.diff(offsets))
        for at, buckets in _grams(data, offsets):
            of = text[at]
            count += np.bincount(of, minlength=n)
            for b in range(bits):
                margin[:, b] += np.bincount(of, weights=model.weights[buckets, b], minlength=n)
        known = (count > 0) & _has_letter(data, offsets)
        if not model.languages:
            known[:] = False
        if len(model.languages) < 2:
            names += [model.languages[0] if k else UNKNOWN for k in known]
            scores.append(known.astype(float))
            continue
        # Logistic loss of each bit against each codeword, on the evidence of the whole text.
        evidence = margin / np.sqrt(np.maximum(count, 1))[:, None]
        loss = np.logaddexp(0, -evidence[:, None, :] * model.code[None]) @ model.trust
        likely = np.exp(loss.min(1, keepdims=True) - loss)
        likely /= likely.sum(1, keepdims=True)
        best = likely.argmax(1)
        names += [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        scores.append(np.where(known, likely[np.arange(n), best], 0.0))
    return names, np.concatenate(scores) if scores else np.zeros(0)


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a text has a letter; texts without ASCII letters are looked at character by character."""
    ascii_ = np.concatenate(([0], np.cumsum((_LETTER[data] > 0) & (data < 128), dtype=np.int64)))
    out = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def predictor(model: Model):
    """Arrow UDF: (lang_pred, score, ambiguous) of a text."""
    @F.arrow_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def language(texts: pa.Array) -> pa.Array:
        names, scores = predict(texts, model)
        unclear = [name == UNKNOWN or score < AMBIGUOUS for name, score in zip(names, scores)]
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unclear, pa.bool_())],
            names=["lang_pred", "score", "ambiguous"])

    return language


def document_languages(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) per row.

    Learned from ``text`` and non-NULL ``lang`` of rows that aren't held out.  ``und`` with score 0 if the text is NULL or has no
    letter, or if there is nothing to learn from.  ``score`` (0 to 1) is the share of the predicted language; below 0.6 a text is
    ambiguous.  Rows are judged one by one; rows with a NULL doc_id may be learned from.
    """
    language = predictor(learn(documents))
    return documents.select("doc_id", held_out().alias("held_out"), language(F.col("text").cast("string")).alias("p")).select(
        "doc_id", "held_out", "p.*")


def clear_documents(documents: DataFrame) -> DataFrame:
    """The rows whose language is known and not ambiguous, with all their columns."""
    language = predictor(learn(documents))
    return documents.where(~language(F.col("text").cast("string"))["ambiguous"])
