"""Ranked lexical search: the best documents of every query text by weighted term matches.

All documents are read once into segments of a few thousand documents, each one row that holds the postings of the terms
that the queries ask for, and the number of terms of each document.  Statistics over all documents (documents, terms, and
documents by term) come from the segments.

A segment is searched by presence masks.  For one query, the postings of each of its terms set one bit in the masks of
their documents, and documents of equal mask form a group.  No document of a group can score more than the best impacts
of the mask's terms add up to.  Groups are evaluated by descending maximum, and the search is over when the best
documents so far score more than the next maximum.  Each task keeps the best few documents of each query over all its
segments, so later segments end sooner; what the tasks return is ranked by query.

Queries are worked on in blocks of at most ``BLOCK_TERMS`` terms (and one query at least), the only thing that is
broadcast; there is no limit on the number of blocks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from changeloom.functions.scale import sum_before
from changeloom.session import durable

BLOCK_TERMS = 200_000
SEGMENT_DOCUMENTS = 2_048
SEGMENT_POSTINGS = 1 << 19
# A text is cut into terms in parts of this many bytes.
PART_BYTES = 1 << 20
# Groups are evaluated until this many documents are reached, before the limit is looked at again.
STEP = 64
# Partial rankings of a query, before the last one.
SALTS = 64

# ASCII digits and letters and all other characters beyond ASCII belong to terms; A-Z are lower-cased.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

SEGMENT = ("doc_ids array<bigint>, lengths array<bigint>, terms array<int>, holders array<int>, docs array<int>, "
           "counts array<bigint>, n_documents bigint, n_terms bigint")


def parts(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text, part by part."""
    text = text.translate(_TABLE)
    start = 0
    while start < len(text):
        end = len(text) if len(text) - start <= PART_BYTES else text.find(b" ", start + PART_BYTES)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def query_terms(queries: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term): the distinct terms of each query.  Rows that share an id are one query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, terms = [], []
            for i, value in enumerate(batch.column(1)):
                found = set().union(*parts(value.as_py() or b""))
                items += [i] * len(found)
                terms += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(items, pa.int64())), pa.array(terms, pa.binary())],
                                             names=["item", "term"])

    kind = queries.schema[item].dataType.simpleString()
    return queries.select(F.col(item), F.col(text).cast("string").cast("binary")).mapInArrow(
        run, f"item {kind}, term binary").distinct()


def segments(documents: DataFrame, index: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``SEGMENT``.  Posting p says that document ``docs[p]`` holds a term ``counts[p]`` times; postings go by term,
    ``holders`` postings for each of ``terms``.  Documents without an asked term, or without an id, count in ``n_documents``
    and ``n_terms`` (and ``holders`` is over all rows), but they can't be found.

    ``index`` is bounded by its caller.
    """
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        ids, lengths, rows, n_documents, n_terms, n_postings = [], [], [], 0, 0, 0

        def segment() -> pa.RecordBatch:
            of_doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            pairs = np.array([pair for row in rows for pair in row], np.int64).reshape(-1, 2)
            order = np.argsort(pairs[:, 0], kind="stable")
            terms, holders = np.unique(pairs[:, 0], return_counts=True)
            values = [np.array(ids, np.int64), np.array(lengths, np.int64), terms.astype(np.int32), holders.astype(np.int32),
                      of_doc[order].astype(np.int32), pairs[order, 1]]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in values]
            return pa.RecordBatch.from_arrays([*lists, pa.array([n_documents]), pa.array([n_terms])],
                                              names=[c.split()[0] for c in SEGMENT.split(", ")])

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, found = 0, Counter()
                for words in parts(value.as_py() or b""):
                    n += len(words)
                    found.update(words)
                n_documents += n > 0
                n_terms += n
                row = [(t, c) for word, c in found.items() if (t := number(word)) is not None]
                if not row:
                    continue
                ids.append(NO_ID if key is None else key)
                lengths.append(n)
                rows.append(row)
                n_postings += len(row)
                if len(ids) >= SEGMENT_DOCUMENTS or n_postings >= SEGMENT_POSTINGS:
                    yield segment()
                    ids, lengths, rows, n_documents, n_terms, n_postings = [], [], [], 0, 0, 0
        if n_documents:
            yield segment()

    return documents.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string").cast("binary")).mapInArrow(run, SEGMENT)


# Stands for a missing id, which is never returned.
NO_ID = -(1 << 63)


@dataclass
class Block:
    """Queries of one block: for each its id and its terms; a weight for each term; figures of all documents."""

    items: list
    terms: list[np.ndarray]
    weights: np.ndarray
    n_documents: int
    n_terms: int


def masks_of(present: Iterable[np.ndarray], n: int) -> np.ndarray:
    """Presence masks of n documents, as rows of 64-bit words: bit j tells whether the document is in the j-th posting list."""
    present = list(present)
    masks = np.zeros((n, -(-len(present) // 64)), np.uint64)
    for j, docs in enumerate(present):
        masks[docs, j // 64] |= np.uint64(1 << j % 64)
    return masks


def maxima(masks: np.ndarray, best: np.ndarray) -> np.ndarray:
    """What the best impacts of each mask's terms add up to."""
    bits = np.unpackbits(np.ascontiguousarray(masks).view(np.uint8), axis=1, bitorder="little", count=len(best))
    # Exact: impacts stay below 2**53 in sum, so no matrix product of doubles loses a unit.
    return (bits.astype(np.float64) @ best.astype(np.float64)).astype(np.int64)


class Segment:
    """Postings of one segment with their impacts."""

    def __init__(self, row: dict, block: Block):
        self.ids = row["doc_ids"]
        n = row["lengths"]
        slow = 10 + 90 * n * block.n_documents // block.n_terms
        docs, tf = row["docs"], row["counts"]
        self.terms, holders = row["terms"], row["holders"]
        self.bounds = np.concatenate(([0], np.cumsum(holders)))
        term = np.repeat(self.terms, holders)
        impact = block.weights[term] * (1_000_000_000 * tf // (1_000 * tf + 8 * slow[docs]))
        self.docs = docs
        self.best = np.maximum.reduceat(impact, self.bounds[:-1]) if len(docs) else impact
        by_doc = np.argsort(docs, kind="stable")
        self.doc_term, self.doc_impact = term[by_doc], impact[by_doc]
        self.doc_bounds = np.searchsorted(docs[by_doc], np.arange(len(n) + 1))

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Exact scores of some documents; ``asked`` is 1 at the terms of the query and 0 elsewhere."""
        size = self.doc_bounds[docs + 1] - self.doc_bounds[docs]
        first = np.cumsum(size) - size
        at = np.repeat(self.doc_bounds[docs] - first, size) + np.arange(size.sum())
        return np.add.reduceat(self.doc_impact[at] * asked[self.doc_term[at]], first)

    def search(self, terms: np.ndarray, asked: np.ndarray, top: tuple[np.ndarray, np.ndarray], k: int):
        """The k best of ``top`` and of this segment's documents, as (scores, ids), best first."""
        at = np.searchsorted(self.terms, terms)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)]
        if not len(at):
            return top
        masks = masks_of((self.docs[self.bounds[i]:self.bounds[i + 1]] for i in at), len(self.ids))
        matched = np.flatnonzero(masks.any(axis=1) & (self.ids != NO_ID))
        masks = masks[matched]
        keys = masks[:, 0] if masks.shape[1] == 1 else masks.view(f"V{8 * masks.shape[1]}")[:, 0]
        _, one, group = np.unique(keys, return_index=True, return_inverse=True)
        most = maxima(masks[one], self.best[at])
        # Documents group by group, the groups by descending maximum.
        place = np.argsort(-most[group], kind="stable")
        docs, most = matched[place], most[group][place]
        start = 0
        while start < len(docs):
            if len(top[0]) == k and most[start] < top[0][-1]:
                break
            # Whole groups, STEP documents at least.
            end = min(start + STEP, len(docs))
            end = int(np.searchsorted(-most, -most[end - 1], "right"))
            found = self.scores(docs[start:end], asked)
            good = found > 0
            scores = np.concatenate((top[0], found[good]))
            ids = np.concatenate((top[1], self.ids[docs[start:end]][good]))
            order = np.lexsort((ids, -scores))[:k]
            top = scores[order], ids[order]
            start = end
        return top


def best_documents(found: DataFrame, block: Block, k: int, kind: T.DataType) -> DataFrame:
    """(item, doc_id, score): for each query the k best documents of each task."""
    shared = found.sparkSession.sparkContext.broadcast(block)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        tops = [none] * len(block.items)
        asked = np.zeros(len(block.weights), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].values.to_numpy() for name in batch.schema.names[:6]}
                segment = Segment(row, block)
                for q, terms in enumerate(block.terms):
                    asked[terms] = 1
                    tops[q] = segment.search(terms, asked, tops[q], k)
                    asked[terms] = 0
        which = [q for q, (scores, _) in enumerate(tops) for _ in scores]
        yield pa.RecordBatch.from_arrays(
            [pa.array([block.items[q] for q in which], item_type), pa.array(np.concatenate([ids for _, ids in tops])),
             pa.array(np.concatenate([scores for scores, _ in tops]))], names=["item", "doc_id", "score"])

    item_type = to_arrow_type(kind)
    return found.mapInArrow(run, f"item {kind.simpleString()}, doc_id bigint, score bigint")


def search(documents: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
           item: str = "item_id", query: str = "text") -> DataFrame:
    """(item, rank, doc_id, score): the k best documents of each query with a score above 0, equal scores by doc_id.

    NULL texts have no terms.  A query without a term, or whose terms no document holds, has no rows; queries of one id
    (NULL is one, too) are one query.  Every row of ``documents`` is a document, so a repeated row is found twice; a row
    without id counts in the statistics but isn't returned.  Empty tables give no rows.  Other columns aren't read.
    """
    spark = documents.sparkSession
    kind = queries.schema[item].dataType
    asked = durable(query_terms(queries, item, query))
    sizes = asked.groupBy("item").agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", F.md5(F.col("item").cast("string")))
    placed = sum_before(sizes, [], F.substring(F.coalesce("_h", F.lit("")), 1, 3), [F.col("_h"), F.col("item")], F.col("_n"), "_before")
    blocks = durable(asked.join(placed.select(F.col("item").alias("_item"), F.floor(F.col("_before") / BLOCK_TERMS).alias("block")),
                                F.col("item").eqNullSafe(F.col("_item"))).drop("_item"))
    last = blocks.agg(F.max("block")).first()[0]
    found = []
    for number in range(0 if last is None else last + 1):
        # At most BLOCK_TERMS rows and those of one query more.
        rows = blocks.where(F.col("block") == number).select("item", "term").collect()
        index = {term: i for i, term in enumerate(sorted({bytes(r.term) for r in rows}))}
        by_item: dict = {}
        for r in rows:
            by_item.setdefault(r.item, []).append(index[bytes(r.term)])
        if not by_item:
            continue
        made = durable(segments(documents, index, doc_id, text))
        n, length = made.agg(F.sum("n_documents"), F.sum("n_terms")).first()
        if not n:
            break
        holders = np.zeros(len(index), np.int64)
        for r in made.select(F.inline(F.arrays_zip("terms", "holders"))).groupBy("terms").agg(F.sum("holders").alias("df")).collect():
            holders[r.terms] = r.df
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(df) + 1))) for df in holders], np.int64)
        items = list(by_item)
        block = Block(items, [np.array(sorted(by_item[i]), np.int64) for i in items], weights, n, length)
        found.append(best_documents(made, block, k, kind))
    if not found:
        return spark.createDataFrame([], f"`{item}` {kind.simpleString()}, rank int, doc_id bigint, score bigint")
    every = reduce(DataFrame.unionByName, found).withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    order = [F.desc("score"), F.asc("doc_id")]
    partly = every.withColumn("_n", F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*order))).where(F.col("_n") <= k)
    ranked = partly.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", "doc_id", "score")
