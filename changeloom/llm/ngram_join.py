"""Jaccard join of documents on five-word shingles, by prefixes of single tokens and token combinations.

The shingles of a document are ordered from rare to frequent.  Two sets of similarity 0.75 or more that lack at most
``e`` of each other's tokens share a token of their first ``e + 1``.  A frequent token alone would bring everything together that
holds a common passage, so tokens are classed: a rare one is a signature by itself; frequent ones fall into eight groups by their
hash, and within a group two of them together are one.  The prefix is extended until ``e`` missing tokens can't destroy every
signature: a rare token counts 1, a group with n tokens counts n - 1.  Whatever two documents share a signature are verified.

Sets too small for eight groups use single tokens only; sizes whose partners may be that small make both kinds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.components import components
from changeloom.llm.setjoin import (GROUPS, HEAVY, REMEMBERED, bucket, cluster_links, errors_allowed, first_pairs, in_map, may_match,
                                    shared, sketch_of, split_by, verified)
from changeloom.llm.texts import LOWER, Words, digest, mix, runs, windows
from changeloom.session import durable

WORDS = 5
# A token is frequent if its bucket holds more than so many times the mean.
FREQUENT = 4
# Smallest set whose size minus the errors allowed leaves more than GROUPS tokens; partners of smaller sets are below SINGLES.
COMBINED = next(n for n in range(1, 1000) if n - GROUPS >= errors_allowed(n) + 1)
SINGLES = (COMBINED - 1) * 4 // 3 + 1
UNIT = ["doc_id"]


def shingle_sets(column: pa.Array, k: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text; A-Z are lower-cased."""
    for first, end, data, offsets in runs(column):
        words = Words(data, offsets)
        hashes, bounds = windows(words.hashes(LOWER), words.bounds, k)
        for i in range(end - first):
            yield first + i, np.unique(hashes[bounds[i]:bounds[i + 1]])


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (doc_id, size, digest), and the task's token counts by bucket (bucket, n)."""
    counts = np.zeros(1 << 16, np.int64)
    for batch in batches:
        sizes, digests = [], []
        for _, tokens in shingle_sets(batch.column(1)):
            sizes.append(len(tokens))
            digests.append(digest(tokens))
            counts += np.bincount(bucket(tokens), minlength=len(counts))
        none = pa.nulls(len(sizes), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                                          none, none], names=["doc_id", "n_shingles", "digest", "bucket", "n"])
    used = np.flatnonzero(counts)
    none = pa.nulls(len(used), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(used), pa.binary()), pa.array(used),
                                      pa.array(counts[used])], names=["doc_id", "n_shingles", "digest", "bucket", "n"])


def signatures(tokens: np.ndarray, counts: np.ndarray, frequent: float) -> tuple[np.ndarray, np.ndarray]:
    """(signature hashes, shapes) of one set."""
    n = len(tokens)
    count = counts[bucket(tokens)]
    order = np.lexsort((tokens, count))
    tokens, often = tokens[order], count[order] > frequent
    errors = errors_allowed(n)
    singles = np.arange(errors + 1)
    place = np.int64(n) << np.int64(32)
    if n < COMBINED or not often[:errors + 1].any():
        if n < SINGLES or not often.any():
            return tokens[singles], place + singles * 2
    sigs, shapes = [], []
    if n < SINGLES:
        sigs.append(tokens[singles])
        shapes.append(place + singles * 2)
    if n >= COMBINED:
        rare = int(np.argmax(often)) if often.any() else n
        alone = np.arange(min(rare, errors + 1))
        if n >= SINGLES:
            sigs.append(tokens[alone])
            shapes.append(place + alone * 2)
        left = errors + 1 - len(alone)
        if left > 0:
            group = (mix(tokens[rare:]) % np.uint64(GROUPS)).astype(np.int64)
            # Each token but the first of its group counts.
            gain = np.ones(len(group), np.int64)
            gain[[int(np.argmax(group == g)) for g in np.unique(group)]] = 0
            end = int(np.searchsorted(np.cumsum(gain), left)) + 1
            for g in range(GROUPS):
                at = np.flatnonzero(group[:end] == g) + rare
                i, j = np.triu_indices(len(at), 1)
                sigs.append(mix(tokens[at[i]] * np.uint64(0x9FB21C651E98DF25) + tokens[at[j]]))
                shapes.append(place + at[i] * 2 + 1)
    return np.concatenate(sigs), np.concatenate(shapes)


def _postings(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Signatures of every set; of equal sets in a task only those of smaller ids than all before, so that the smallest
    id of the corpus is always there."""
    seen: dict[bytes, int] = {}
    frequent = FREQUENT * max(1.0, counts.mean())
    for batch in batches:
        ids = batch.column(0)
        sigs, docs, shapes, held = [], [], [], 0

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(docs)),
                 pa.array(np.concatenate(shapes))], names=["sig", "doc_id", "shape"])

        for row, tokens in shingle_sets(batch.column(1)):
            doc_id = ids[row].as_py()
            if not len(tokens) or seen.get(key := digest(tokens), doc_id + 1) <= doc_id:
                continue
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen[key] = doc_id
            sig, shape = signatures(tokens, counts, frequent)
            sigs.append(sig)
            shapes.append(shape)
            docs.append(np.full(len(sig), doc_id, np.int64))
            held += len(sig)
            if held > 200_000:
                yield out()
                sigs, docs, shapes, held = [], [], [], 0
        if sigs:
            yield out()


def _token_sets(column: pa.Array) -> Iterator[np.ndarray]:
    return (tokens for _, tokens in shingle_sets(column))


def _open(found: DataFrame, linked: DataFrame) -> DataFrame:
    """Postings of signatures that more components than one share, with the signature's size and the unit's component."""
    placed = found.join(linked.select(F.col("v").alias("doc_id"), "u"), "doc_id", "left").select(
        "sig", "doc_id", "shape", F.coalesce("u", "doc_id").alias("own"))
    apart = placed.groupBy("sig").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count(F.lit(1)).alias("size")).where(
        "lo < hi").select("sig", "size")
    return durable(placed.join(apart, "sig"))


def _light_pairs(open_: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs that share a small signature, may match, weren't tried and are not connected yet."""
    light = open_.where(F.col("size") <= HEAVY)
    left = light.select("sig", F.col("doc_id").alias("x"), F.col("shape").alias("shape_x"), F.col("own").alias("own_x"))
    right = light.select("sig", F.col("doc_id").alias("y"), F.col("shape").alias("shape_y"), F.col("own").alias("own_y"))
    return left.join(right, "sig").where("own_x <> own_y AND x < y").where(may_match("shape_x", "shape_y")).select(
        F.struct(F.col("x").alias("doc_id")).alias("a"), F.struct(F.col("y").alias("doc_id")).alias("b")).distinct().join(
        tried, ["a", "b"], "left_anti")


def near_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with their sets' sizes and digests, components (v, u) of ``doc_id``)."""
    texts = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    survey = durable(texts.mapInArrow(
        _survey, "doc_id bigint, n_shingles bigint, digest binary, bucket bigint, n bigint"))
    rows = survey.where("bucket IS NULL").select("doc_id", "n_shingles", "digest")
    counts = sketch_of(survey.where("bucket IS NOT NULL").select("bucket", "n"))
    known = texts.where("doc_id IS NOT NULL")
    # Equal sets hang under their first document.
    owner = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    smallest = owner.groupBy("digest").agg(F.min("doc_id").alias("a"))
    copies = durable(owner.join(smallest, "digest").where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct())
    # An id that several rows share may be a copy with one of them and the first with another.
    shared_ids = owner.groupBy("doc_id").agg((F.min("digest") < F.max("digest")).alias("several")).where("several")
    only_copies = copies.select(F.col("b").alias("doc_id")).distinct().join(shared_ids, "doc_id", "left_anti")
    found = shared(known.mapInArrow(partial(_postings, counts=counts), "sig bigint, doc_id bigint, shape bigint"), UNIT,
                   only_copies)

    def fetch(bits):
        wanted = F.arrow_udf(lambda ids: pa.array(in_map(bits, np.asarray(ids))), "boolean")
        return known.where(wanted("doc_id"))

    def ends(pairs):
        return pairs.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"))

    pairs = durable(first_pairs(found, UNIT))
    links = ends(verified(pairs, fetch, UNIT, _token_sets)).unionByName(copies)
    linked = components(links)
    open_ = _open(found, linked)
    if not open_.isEmpty():
        heavy = cluster_links(open_.where(F.col("size") > HEAVY).select("sig", "doc_id", "shape"), fetch, UNIT, _token_sets)
        light = verified(durable(_light_pairs(open_, pairs)), fetch, UNIT, _token_sets)
        linked = components(linked.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(ends(light)).unionByName(
            ends(heavy.select(F.col("root").alias("a"), "b"))))
    return rows, linked


def document_components(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): the set size and the smallest doc_id reachable by links of similarity >= 0.75.

    Words are runs of other characters than white space, A-Z lower-cased; a set holds the distinct five-word shingles, or
    the whole sequence where there are fewer words.  NULL texts and texts without words have an empty set and link with
    nothing.  One row per input row.  Rows that share a doc_id are one document that links with whatever one of its texts
    links with; a NULL doc_id links with nothing and has a NULL component.  Other columns of the input are not read.
    """
    rows, linked = near_documents(documents)
    return rows.join(linked, F.col("doc_id") == F.col("v"), "left").select(
        "doc_id", "n_shingles", F.coalesce("u", "doc_id").alias("component_id"))


def first_of_each(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose doc_id names its component; all columns.  Rows with a NULL doc_id stay."""
    _, linked = near_documents(documents)
    gone = linked.select(F.col("v").alias("doc_id"))
    maybe, kept = split_by(documents, gone)
    rows = maybe.select(F.struct("*").alias("row")).join(
        gone, F.col("row.doc_id").cast("bigint") == F.col("doc_id"), "left_anti").select("row.*")
    return kept.unionByName(rows)
