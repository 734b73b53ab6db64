"""SentencePiece encoding and decoding of merge-type models by a table over prefixes.

A merge-type model joins, again and again, the two neighbours whose union is the piece of the highest score.  Every prefix
of a word then has exactly one piece that can be the last of its encoding.  An automaton over the pieces gives those that
end at each character, longest first; the last piece is the one that may stand behind the last piece of the prefix before
it (``may_follow``, decided from how both pieces came about).  Ids are recovered backwards from the table.  The cost is
linear in the word.

What can't be merged across is cut first: a character that no longer piece contains stands alone, and a piece has spaces in
front only.  Runs of spaces have pieces of one common, lowest score; they are joined last, from the left.  Models of another
shape are refused (``PieceModel.__init__``).

Words are independent, so each worker remembers at most ``CACHE_ENTRIES`` of them; the memory is emptied when it is full,
which changes the speed only.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE_ENTRIES = 600_000
# Longer words are encoded anew each time.
CACHE_CHARS = 48
# So many words of a text are looked up at a time; longer texts are cut by a pattern instead of all at once.
WORDS_AT_ONCE = 1 << 16
PLAIN_CHARS = 1 << 20

# The sign that stands for a space, and the types of pieces in a model file.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("changeloom-each-byte", _each_byte)


class PieceModel:
    """Tables of one model file.  Pieces are numbered by rank inside: single characters first, then in merging order."""

    def __init__(self, proto: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        spec = model.normalizer_spec
        if (model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces
                or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix):
            raise ValueError("a merge-type model with the identity as normalizer is needed")
        self.dummy_prefix = spec.add_dummy_prefix
        kinds = Counter(p.type for p in model.pieces)
        if kinds.keys() - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("pieces of users and unused pieces are not supported")
        normal = [(p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL]
        spaces = {p: i for p, i, _ in normal if len(p) > 1 and not p.strip(SPACE)}
        merged = [(p, i, s) for p, i, s in normal if len(p) > 1 and p not in spaces]
        scores = {s for _, _, s in merged}
        lowest = {s for p, _, s in normal if p in spaces}
        if (len(scores) < len(merged) or any(SPACE in p[1:] for p, _, _ in merged) or len(lowest) > 1
                or scores and lowest and max(lowest) >= min(scores)):
            raise ValueError("pieces must differ in score and have spaces in front only")
        singles = {p: i for p, i, _ in normal if len(p) == 1}
        inside = sorted({c for p, _, _ in merged for c in p} | {SPACE})
        if set(inside) - set(singles):
            raise ValueError("every character of a piece must be a piece")
        self.space_ids = {len(p): i for p, i in spaces.items()} | {1: singles[SPACE]}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        bytes_ = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_ids = [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None
        self.singles, self.inside = singles, set(inside)

        self.names = inside + [p for p, _, _ in sorted(merged, key=lambda x: -x[2])]
        ids = {p: i for p, i, _ in normal}
        self.ids = [ids[name] for name in self.names]
        rank = {name: r for r, name in enumerate(self.names)}
        self.space_rank = rank[SPACE]
        self.parts: list[tuple[int, int]] = []
        self.joined: dict[tuple[int, int], int] = {}
        self.follows: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for r, name in enumerate(self.names):
            made_of = (r, r) if len(name) == 1 else self._made_of(name, r, rank)
            self.parts.append(made_of or (r, r))
            if made_of:
                self.automaton.add_word(name, (r, len(name)))
                if len(name) > 1:
                    self.joined[made_of] = r
        self.automaton.make_automaton()

        joinable = re.escape("".join(c for c in inside if c != SPACE))
        self.words = re.compile(f"{SPACE}*[{joinable}]+|{SPACE}+|." if joinable else f"{SPACE}+|.", re.DOTALL)
        # One word with a space in front, by far the most frequent chunk.
        self.whole = re.compile(f"{SPACE}[{joinable}]+" if joinable else "(?!)").fullmatch
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.seen: dict[str, bytes] = {}
        surface = model.trainer_spec.unk_surface
        self.text_of = [int(p.piece[1:-1], 16).to_bytes() if p.type == BYTE else b"" if p.type == CONTROL
                        else surface.encode() if p.type == UNKNOWN else p.piece.replace(SPACE, " ").encode()
                        for p in model.pieces]
        self.is_normal = [p.type == NORMAL for p in model.pieces]
        self.controls = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}

    def _made_of(self, name: str, r: int, rank: dict[str, int]) -> tuple[int, int] | None:
        """The two pieces that are joined last when the piece's own text is encoded; None if it never becomes this piece."""
        for cut in range(len(name) - 1, 0, -1):
            left, right = rank.get(name[:cut], r), rank.get(name[cut:], r)
            if left < r and right < r and self._apart(left, right):
                return left, right
        return None

    def _apart(self, left: int, right: int) -> bool:
        """Whether two pieces stay apart under the pieces known so far.

        The merges that made both are taken back, latest first.  If the pieces that face each other at some moment have a
        union that comes earlier than what was made next on either side, they would have been joined then.  Of equal
        merges the one further left comes first, hence the 1 for the right side.
        """
        until = len(self.names)
        while True:
            union = self.joined.get((left, right))
            if union is not None and union < until:
                return False
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    inner = self.parts[left][1]
                    if inner != left:
                        until, left = left, inner
                        break
                else:
                    inner = self.parts[right][0]
                    if inner != right:
                        until, right = right + 1, inner
                        break
                undo_left = not undo_left
            else:
                return True

    def may_follow(self, left: int, right: int) -> bool:
        key = left * len(self.names) + right
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) >= CACHE_ENTRIES:
                self.follows.clear()
            known = self.follows[key] = self._apart(left, right)
        return known

    def last_pieces(self, word: str) -> list[tuple[int, int] | None]:
        """For every prefix of a word the one piece that ends its encoding, as (rank, length)."""
        last: list[tuple[int, int] | None] = [None] * (len(word) + 1)
        # Keys of pairs stay below 2 ** 30 for 32,768 pieces, where Python's integers are fastest.
        done, known_pairs, n = -1, self.follows.get, len(self.names)
        for at, found in self.automaton.iter(word):
            if at == done:
                continue
            piece, length = found
            start = at + 1 - length
            if start:
                before = last[start][0]
                known = known_pairs(before * n + piece)
                if not (self.may_follow(before, piece) if known is None else known):
                    continue
            last[at + 1] = found
            done = at
        return last

    def word(self, word: str) -> list[int]:
        """Ids of one word: spaces in front, then characters of pieces."""
        last, ids = self.last_pieces(word), self.ids
        found, at = [], len(word)
        if word.startswith(SPACE + SPACE):
            ranks = []
            while at:
                r, length = last[at]
                ranks.append(r)
                at -= length
            spaces = 0
            while ranks and ranks[-1] == self.space_rank:
                spaces += 1
                ranks.pop()
            return self._space_run(spaces) + [ids[r] for r in reversed(ranks)]
        while at:
            r, length = last[at]
            found.append(ids[r])
            at -= length
        found.reverse()
        return found

    def _space_run(self, n: int) -> list[int]:
        """Ids of n spaces: of all neighbours whose union is a piece, those furthest left are joined first."""
        sizes: list[int] = []
        for _ in range(n):
            sizes.append(1)
            while len(sizes) > 1 and sizes[-2] + sizes[-1] in self.space_ids:
                last = sizes.pop()
                sizes[-1] += last
        return [self.space_ids[size] for size in sizes]

    def _single(self, char: str) -> list[int]:
        if char in self.singles:
            return [self.singles[char]]
        return [self.unknown] if self.byte_ids is None else [self.byte_ids[b] for b in char.encode()]

    def _remember(self, word: str, ids: bytes) -> bytes:
        if len(word) <= CACHE_CHARS:
            if len(self.seen) >= CACHE_ENTRIES:
                self.seen.clear()
            self.seen[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        """Ids of spaces and what follows up to the next space, as little-endian 32-bit integers."""
        if self.whole(chunk):
            return array("I", self.word(chunk)).tobytes()
        words = self.words.findall(chunk)
        if len(words) == 1:
            return self._ids(chunk)
        out, seen = [], self.seen.get
        for word in words:
            known = seen(word)
            out.append(self._remember(word, self._ids(word)) if known is None else known)
        return b"".join(out)

    def _ids(self, word: str) -> bytes:
        alone = len(word) == 1 and word != SPACE and word not in self.inside
        return array("I", self._single(word) if alone else self.word(word)).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        text = text.replace(" ", SPACE)
        if self.dummy_prefix:
            text = SPACE + text
        # What lies between two single spaces; the ids are all that grows with the text.
        plain = SPACE + SPACE not in text and len(text) <= PLAIN_CHARS and text[0] == SPACE
        chunks = map(SPACE.__add__, text[1:].split(SPACE)) if plain else map(re.Match.group, self.chunks.finditer(text))
        out, seen = [], self.seen.get
        while part := list(islice(chunks, WORDS_AT_ONCE)):
            found = []
            for chunk in part:
                known = seen(chunk)
                found.append(self._remember(chunk, self._chunk(chunk)) if known is None else known)
            out.append(b"".join(found))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the ids.  Bytes that are no valid UTF-8 become replacement characters, one for each byte."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if not self.controls.isdisjoint(numbers):
            # Bytes on both sides of a control piece aren't read as one character.
            runs = [list(run) for is_control, run in groupby(numbers, self.controls.__contains__) if not is_control]
            return b"".join(self._text(run, self.dummy_prefix and i == 0) for i, run in enumerate(runs))
        return self._text(numbers, self.dummy_prefix)

    def _text(self, numbers: list[int], at_start: bool) -> bytes:
        raw = b"".join(map(self.text_of.__getitem__, numbers))
        if at_start:
            # The space in front of the first piece that gives text goes.
            first = next((i for i in numbers if self.text_of[i]), None)
            if first is not None and self.is_normal[first] and raw.startswith(b" "):
                raw = raw[1:]
        try:
            raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("utf-8", "changeloom-each-byte").encode("utf-8")
        return raw


@lru_cache(maxsize=2)
def piece_model(proto: bytes) -> PieceModel:
    """One per worker process and file."""
    return PieceModel(proto)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_model(spark: SparkSession, path: str | None):
    """Broadcast the model file, which has a fixed size (about 0.5 MB), so that workers need no copy of it."""
    with open(path or default_path(), "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(df: DataFrame, text: str = "text", path: str | None = None, out: str = "ids") -> DataFrame:
    """Add the ids of ``text`` as ``array<int>``.  NULL and empty texts have no ids.  Rows are not moved.

    A column that has the name ``out`` already is replaced; other columns are kept as they are.
    """
    shared = load_model(df.sparkSession, path)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts):
        model = piece_model(shared.value)
        return texts.map(lambda t: np.frombuffer(model.encode(t), "<i4"))

    return df.withColumn(out, ids(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, out: str = "text") -> DataFrame:
    """Add the text of an ``array<int>`` column; NULL stays NULL.  Ids outside the model raise an error."""
    shared = load_model(df.sparkSession, path)

    @F.pandas_udf("string")
    def texts(lists):
        model = piece_model(shared.value)
        return lists.map(lambda x: None if x is None else model.decode(np.array(x, "<u4").tobytes()).decode("utf-8"))

    return df.withColumn(out, texts(F.col(ids)))


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: the number of ids, SHA-256 of the ids in decimal, joined by commas, and of the text decoded from them.

    Every whole text is encoded and decoded again (NULL: empty).  One row for each input row, repeated rows and NULL
    doc_ids included; no shuffle; columns other than ``doc_id`` and ``text`` are not read.  An empty table gives no rows.
    """
    shared = load_model(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(shared.value)
        decimals = [str(i) for i in range(len(model.text_of))]
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for value in batch.column(1):
                ids = model.encode(value.as_py())
                numbers = np.frombuffer(ids, "<u4").tolist()
                counts.append(len(numbers))
                of_ids.append(hashlib.sha256(",".join(map(decimals.__getitem__, numbers)).encode()).hexdigest())
                of_text.append(hashlib.sha256(model.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()),
                 pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, DIGESTS)
