"""Packing of documents into token sequences of bounded length, balanced by attention cost.

A document's ids are cut into whole sequences of 1024; what is left of each document is a piece.  Within a block of documents
the pieces go, from the largest down, to the sequence of lowest cost that has room; cost is linear in the tokens plus
quadratic in each piece, as attention within a document is.  Where no sequence of low cost has room for all of a piece,
it is cut.  A block has exactly as much room as it has tokens: sequences of 1024, and for the rest sequences whose
lengths are powers of two, so there is no padding.

A block is a run of a task's rows, so no row is moved and a task holds some two million tokens at a time.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.bpe import byte_symbols, default_path, load_vocabulary, vocabulary

LENGTH = 1024
BLOCK_TOKENS = 1 << 21
END = 0
# Attention within a piece costs this much per pair of tokens, a token 1.
PER_PAIR = 1 / LENGTH
# A piece is cut if none of so many sequences of lowest cost has room for it.
TRIES = 8

# Fixed value: the pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The library's merge loop is slow on words as long as this; those go through the linear encoder.
LONG_WORD = re.compile(r"\S{2000}|\s{2000}")


class Encoder:
    """Ids of texts by the merge ranks of the vocabulary file; special tokens in a text become their ids."""

    def __init__(self, text: str):
        import tiktoken

        data = json.loads(text)
        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in name): i for name, i in data["model"]["vocab"].items()
                 if all(c in symbols for c in name)}
        special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        ranks = {b: i for b, i in ranks.items() if i not in special.values()}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = "all" if special else set()
        self.text = text

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if LONG_WORD.search(text):
            return np.frombuffer(vocabulary(self.text).encode(text), "<u4")
        return np.array(self.encoding.encode(text, allowed_special=self.special), "<u4")


@lru_cache(maxsize=2)
def encoder(text: str) -> Encoder:
    return Encoder(text)


def cost(length: int) -> float:
    return length + PER_PAIR * length * length


def room_for(tokens: int) -> list[int]:
    """Lengths of sequences that together hold exactly so many tokens."""
    rest = tokens % LENGTH
    return [LENGTH] * (tokens // LENGTH) + [1 << k for k in range(LENGTH.bit_length() - 2, -1, -1) if rest >> k & 1]


def assign(lengths: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece.  Lengths count the end token; all are 1 or more."""
    sequence = 0
    pieces: list[tuple[float, int, int, int]] = []
    left = 0
    for document, length in enumerate(lengths):
        whole = length // LENGTH
        for i in range(whole):
            yield document, i * LENGTH, LENGTH, sequence, 0
            sequence += 1
        if rest := length % LENGTH:
            pieces.append((-cost(rest), document, whole * LENGTH, rest))
            left += rest
    heapq.heapify(pieces)
    room = room_for(left)
    used = [0] * len(room)
    # Sequences that aren't full, by cost.
    open_ = [(0.0, i) for i in range(len(room))]
    while pieces:
        _, document, start, length = heapq.heappop(pieces)
        tried = []
        while open_ and len(tried) < TRIES:
            tried.append(heapq.heappop(open_))
            if room[tried[-1][1]] - used[tried[-1][1]] >= length:
                break
        at = len(tried) - 1 if room[tried[-1][1]] - used[tried[-1][1]] >= length else 0
        spent, i = tried.pop(at)
        for entry in tried:
            heapq.heappush(open_, entry)
        part = min(length, room[i] - used[i])
        yield document, start, part, sequence + i, used[i]
        used[i] += part
        if used[i] < room[i]:
            heapq.heappush(open_, (spent + cost(part), i))
        if part < length:
            heapq.heappush(pieces, (-cost(length - part), document, start + part, length - part))


PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def packed(documents: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids`` if asked for).

    A document is its ids and then id 0; NULL and empty texts are the id 0 alone.  Every row of the input is a document of
    its own, also repeated ones and those with a NULL doc_id.  ``sequence_id`` is unique over all tasks; a sequence is
    filled by one task.  Columns other than ``doc_id`` and ``text`` are not read.
    """
    shared = load_vocabulary(documents.sparkSession, path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(shared.value)
        next_sequence = TaskContext.get().partitionId() << 33

        def out(ids, tokens):
            nonlocal next_sequence
            rows = np.array(list(assign([len(t) for t in tokens])), np.int64).reshape(-1, 5)
            document, start, length, sequence, offset = rows.T
            pieces = [tokens[d][s:s + n] for d, s, n in zip(document.tolist(), start.tolist(), length.tolist())]
            columns = [pa.array([ids[d] for d in document.tolist()], pa.int64()), pa.array(start), pa.array(length),
                       pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64()),
                       pa.array([len(tokens[d]) for d in document.tolist()], pa.int64()),
                       pa.array(next_sequence + sequence), pa.array(offset)]
            names = [c.split()[0] for c in PIECES.split(", ")]
            if with_ids:
                columns.append(pa.array([p.astype(np.int32) for p in pieces], pa.list_(pa.int32())))
                names.append("ids")
            next_sequence += int(sequence.max()) + 1
            return pa.RecordBatch.from_arrays(columns, names=names)

        ids, tokens, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc_id.as_py())
                tokens.append(np.append(words.ids(text.as_py()), np.uint32(END)).astype("<u4"))
                held += len(tokens[-1])
                if held >= BLOCK_TOKENS:
                    yield out(ids, tokens)
                    ids, tokens, held = [], [], 0
        if tokens:
            yield out(ids, tokens)

    source = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return source.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))
