"""Byte-pair encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one token can be the last token of the prefix's encoding.  An automaton over the
vocabulary gives the tokens that end at each byte, longest first; a token is the last one if it may follow the last
token of the prefix before it.  Whether two tokens may stand side by side is decided from the merge table alone
(``may_follow``).  Following the stored last tokens backwards emits the ids.  The cost is linear in the word, also for
"words" of megabytes.

Words are independent of each other, so every worker remembers words it has seen (at most ``CACHE_ENTRIES``; the memory is
emptied when it is full, which changes the speed but not the result).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE_ENTRIES = 400_000
# Longer words are encoded anew each time.
CACHE_CHARS = 48

# The white space of the pre-tokenizer, and its pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
           rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
# A single space between two characters that aren't white space always begins a word.
CUT = re.compile(r"(?<=\S) (?=\S)")
UNEVEN = re.compile(r" (?:\s|$)|\s ")


def byte_symbols() -> dict[str, int]:
    """Symbol of the vocabulary file -> byte: printable Latin-1 stands for itself, others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tables of one byte-level BPE vocabulary file (its JSON text).

    Tokens are numbered by rank inside: bytes first, then one rank per merge.
    """

    def __init__(self, text: str):
        import ahocorasick
        import regex

        data = json.loads(text)
        symbols = byte_symbols()
        ids = data["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        singles = [s for s in ids if len(s) == 1]
        rank = {s: i for i, s in enumerate(singles)}
        self.merged: dict[tuple[int, int], int] = {}
        parts: list[tuple[int, int]] = [(i, i) for i in range(len(singles))]
        names = list(singles)
        for left, right in merges:
            pair = (rank[left], rank[right])
            if left + right not in rank:
                rank[left + right] = len(names)
                names.append(left + right)
                parts.append(pair)
            self.merged.setdefault(pair, rank[left + right])
        self.parts = parts
        self.ids = [ids[name] for name in names]
        raw = [bytes(symbols[c] for c in name) for name in names]
        self.lengths = [len(b) for b in raw]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.decoded = {i: b for i, b in zip(self.ids, raw)} | {i: s.encode() for s, i in self.special.items()}
        self.words = regex.compile(PATTERN)
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")"
                                      ) if self.special else None
        self.follows: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, bytes_ in enumerate(raw):
            if self._stands(token):
                self.automaton.add_word(bytes_.decode("latin-1"), (token, len(bytes_)))
        self.automaton.make_automaton()
        self.seen: dict[str, bytes] = {}

    def _stands(self, token: int) -> bool:
        """Whether the token's own text is encoded as this one token: its two parts must meet before either is cut
        by an earlier merge, which is so when they could stand side by side but for the merge itself."""
        left, right = self.parts[token]
        return left == right == token or self._compatible(left, right, token)

    def _compatible(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge of rank below ``limit`` joins a part at the end of ``left`` with one at the start of
        ``right``, going back through the merges that made both, the latest first."""
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < limit:
                return False
            # On equal ranks the merge further left comes first, so an equal rank on the right still undoes it.
            if left > right:
                limit, (_, inner) = left, self.parts[left]
                if inner == left:
                    inner, limit = None, right + 1
                if inner is None:
                    first = self.parts[right][0]
                    if first == right:
                        return True
                    right = first
                else:
                    left = inner
            else:
                limit, (first, _) = right + 1, self.parts[right]
                if first == right:
                    inner = self.parts[left][1]
                    if inner == left:
                        return True
                    limit, left = left, inner
                else:
                    right = first

    def may_follow(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > CACHE_ENTRIES:
                self.follows.clear()
            known = self.follows[key] = self._compatible(left, right, len(self.parts))
        return known

    def word(self, word: str) -> list[int]:
        """Ids of one pre-tokenized word."""
        text = word.encode("utf-8").decode("latin-1")
        last: list[int | None] = [None] * (len(text) + 1)
        done, follows = 0, self.follows
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if end == done:
                continue
            start = end - length
            if start:
                before = last[start]
                known = follows.get(before << 32 | token)
                if not (self.may_follow(before, token) if known is None else known):
                    continue
            last[end] = token
            done = end
        out, at = [], len(text)
        while at:
            token = last[at]
            out.append(self.ids[token])
            at -= self.lengths[token]
        return out[::-1]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run of words as little-endian 32-bit integers."""
        out = []
        for word in self.words.findall(chunk):
            known = self.seen.get(word) if len(word) < len(chunk) else None
            if known is None:
                known = np.array(self.word(word), "<u4").tobytes()
                if len(word) <= CACHE_CHARS:
                    if len(self.seen) >= CACHE_ENTRIES:
                        self.seen.clear()
                    self.seen[word] = known
            out.append(known)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        first, *rest = CUT.split(text) if UNEVEN.search(text) else text.split(" ")
        seen = self.seen
        out = [self._chunk(first)] if first else []
        for chunk in rest:
            known = seen.get(chunk := " " + chunk)
            if known is None:
                known = self._chunk(chunk)
                if len(chunk) <= CACHE_CHARS:
                    if len(seen) >= CACHE_ENTRIES:
                        seen.clear()
                    seen[chunk] = known
            out.append(known)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers.  Special tokens written in the text become
        their ids."""
        if not text:
            return b""
        if self.cut_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(np.array([self.special[part]], "<u4").tobytes() if part in self.special else self._plain(part)
                        for part in self.cut_special.split(text) if part)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the ids; what isn't valid UTF-8 becomes the replacement character."""
        raw = b"".join(map(self.decoded.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode("utf-8")


@lru_cache(maxsize=2)
def vocabulary(text: str) -> Vocabulary:
    """One per worker process and file."""
    return Vocabulary(text)


def load_vocabulary(spark: SparkSession, path: str):
    """Broadcast the vocabulary file, which has a fixed size (about 1.5 MB), so that workers need no copy of it."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, text: str = "text", path: str | None = None, out: str = "ids") -> DataFrame:
    """Add the ids of ``text`` as ``array<int>``.  NULL and empty texts have no ids.  Rows are not moved.

    A column that has the name ``out`` already is replaced; other columns are kept as they are.
    """
    shared = load_vocabulary(df.sparkSession, path or default_path())

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts):
        words = vocabulary(shared.value)
        return texts.map(lambda t: np.frombuffer(words.encode(t), "<i4"))

    return df.withColumn(out, ids(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, out: str = "text") -> DataFrame:
    """Add the text of an ``array<int>`` column; NULL stays NULL.  Ids outside the vocabulary raise an error."""
    shared = load_vocabulary(df.sparkSession, path or default_path())

    @F.pandas_udf("string")
    def texts(lists):
        words = vocabulary(shared.value)
        return lists.map(lambda x: None if x is None else words.decode(np.array(x, "<u4").tobytes()).decode("utf-8"))

    return df.withColumn(out, texts(F.col(ids)))


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: the number of tokens, and SHA-256 of the ids and of the text decoded from them.

    Every whole text is encoded and decoded again (NULL: empty).  One row for each input row, repeated rows and NULL
    ids included; no shuffle; columns other than ``doc_id`` and ``text`` are not read.  An empty table gives no rows.
    """
    shared = load_vocabulary(documents.sparkSession, path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(shared.value)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for value in batch.column(1):
                ids = words.encode(value.as_py())
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(words.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()),
                 pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, DIGESTS)
