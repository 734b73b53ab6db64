"""SentencePiece ids against the library, lexical search and the conversation trie against brute force."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import sentencepiece

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from harness import compare  # noqa: E402
from test_llm import CLASHING, EDGE, ODD  # noqa: E402

from changeloom.llm import conversation_trie, lexical, piece_bpe  # noqa: E402
from changeloom.llm.queries import ORACLES, QUERIES  # noqa: E402
from changeloom.session import ship_package  # noqa: E402

# -- pieces ----------------------------------------------------------------------------------------------------------

PIECES = [*ODD, " ", "\n", "▁", "▁▁ a", "a▁b", "\x00a\x00", "日本語 텍스트 🙂🙂", "the" * 4000, " " * 5000 + "such", "tab\tand  two   three"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_path())


@pytest.fixture(scope="module")
def model():
    return piece_bpe.PieceModel(Path(piece_bpe.default_path()).read_bytes())


def same(model, library, texts):
    for text in texts:
        ids = library.encode(text)
        found = model.encode(text)
        assert np.frombuffer(found, "<u4").tolist() == ids, text[:80]
        assert model.decode(found).decode() == library.decode(ids), text[:80]


def test_pieces_equal_the_library(model, library, documents):
    rng = random.Random(3)
    texts = [r.text or "" for r in documents.select("text").collect()]
    odd = "ab cde  the ing▁ \n\t.é日本語🙂\x00ñüthein   1234,"
    drawn = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    joined = ["".join(rng.choice(model.names) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    spaces = [a + " " * n + b for n in range(50) for a in ("", "x") for b in ("", "y")]
    same(model, library, [*PIECES, *texts, *drawn, *joined, *spaces])


def test_long_texts_are_cut_into_parts(model, library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "PLAIN_CHARS", 50)
    monkeypatch.setattr(piece_bpe, "WORDS_AT_ONCE", 3)
    same(model, library, [*PIECES, "one two  three four\nfive " * 20])


def test_cache_is_bounded(model, library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "CACHE_ENTRIES", 100)
    model.seen.clear()
    model.follows.clear()
    same(model, library, [" ".join(f"w{i}x\nv{i}" for i in range(2000))])
    assert len(model.seen) <= 101 and len(model.follows) <= 101


def test_decoding_any_ids(model, library):
    rng = random.Random(4)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32_000), 0, 1, 2, 259, 29_871]) for _ in range(rng.randint(0, 8))]
        assert model.decode(np.array(ids, "<u4").tobytes()).decode() == library.decode(ids), ids


def test_last_piece_of_every_prefix(model, library):
    """The table's entry for a prefix is the last piece of that prefix encoded by itself."""
    word = "▁unbelievablyinternationalisation"
    last = model.last_pieces(word)
    for end in range(1, len(word) + 1):
        assert model.ids[last[end][0]] == library.encode(word[1:end])[-1] if end > 1 else last[1] is not None


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(Path(piece_bpe.default_path()).read_bytes())
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        piece_bpe.PieceModel(proto.SerializeToString())


@pytest.fixture(scope="module")
def documents(spark, small_dir):
    ship_package(spark)
    return spark.read.parquet(f"{small_dir}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    ship_package(spark)
    names = [*CLASHING, "item", "rank", "terms", "base", "ix", "depth"]
    rows = [(i, t, *([k] * len(names))) for k, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{c}` int" for c in names)).repartition(3)


def test_piece_digests_of_edge_cases(edge, library):
    got = Counter(tuple(r) for r in piece_bpe.digests(edge).collect())
    want = Counter()
    for i, t in EDGE:
        ids = library.encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert got == want
    assert piece_bpe.digests(edge.limit(0)).collect() == []


def test_piece_columns_round_trip(edge):
    out = piece_bpe.decode(piece_bpe.encode(edge.select("doc_id", "text"), out="pieces"), "pieces", out="again")
    for r in out.collect():
        assert r.again == (r.text or "").replace("▁", " ")


# -- search ----------------------------------------------------------------------------------------------------------

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def best(documents, queries, k):
    held = [(i, Counter(terms_of(t))) for i, t in documents]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(set)
    for item, text in queries:
        asked[item].update(terms_of(text))
    out = set()
    for item, terms in asked.items():
        rows = []
        for i, c, n in held:
            m = 100 - 90 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in terms if t in c)
            if score > 0 and i is not None:
                rows.append((-score, i))
        out |= {(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(rows)[:k], 1)}
    return out


def found(documents, queries, **options):
    rows = [tuple(r) for r in lexical.search(documents, queries, **options).select("item_id", "rank", "doc_id", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_search_edge_cases(spark, edge):
    queries = [(1, "the cat; GARDEN"), (2, None), (3, ""), (None, "one Ééé 日本語"), (4, "nowhere"), (5, "one"), (5, "x b c"),
               (6, " ".join(t for _, t in EDGE if t)[:3000]), (6, "one")]
    df = spark.createDataFrame([(i, t, "x") for i, t in queries], "item_id int, text string, score string")
    # Repeated rows are documents of their own; the brute-force version keeps them apart by rank.
    assert found(edge, df, k=4) == best(EDGE, queries, 4)
    assert found(edge, df, k=1) == best(EDGE, queries, 1)
    assert found(edge, df.limit(0)) == set() and found(edge.limit(0), df) == set()
    assert found(edge.where("text IS NULL"), df) == set()


@pytest.mark.parametrize("seed", [1, 2])
def test_search_in_small_segments_and_blocks(spark, monkeypatch, seed):
    """Many segments and query blocks, ties, equal documents, queries of more terms than one mask word holds."""
    ship_package(spark)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)] + ["É", "日本"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 3, 30, 200])))) for i in range(300)]
    docs += [(1000 + i, docs[i % 7][1]) for i in range(100)]
    queries = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 60])))) for i in range(12)] + [(99, " ".join(words))]
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 60)
    monkeypatch.setattr(lexical, "SEGMENT_DOCUMENTS", 16)
    monkeypatch.setattr(lexical, "PART_BYTES", 64)
    documents = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    items = spark.createDataFrame(queries, "item_id bigint, text string")
    assert found(documents, items, k=10) == best(docs, queries, 10)


def test_masks_group_documents_and_bound_their_scores():
    rng = np.random.default_rng(1)
    postings = [np.sort(rng.choice(50, rng.integers(1, 40), replace=False)) for _ in range(70)]
    masks = lexical.masks_of(postings, 50)
    best_impact = rng.integers(1, 10**9, 70)
    for doc in range(50):
        bits = [j for j in range(70) if doc in postings[j]]
        assert sum(1 << j for j in bits) == int(masks[doc, 0]) + (int(masks[doc, 1]) << 64)
        assert lexical.maxima(masks[doc:doc + 1], best_impact)[0] == sum(int(best_impact[j]) for j in bits)


def test_search_stops_early(monkeypatch):
    """Groups whose maximum is below the best documents so far are not evaluated."""
    n = 4000
    block = lexical.Block([0], [np.array([0, 1])], np.array([5000, 10]), n, n * 10)
    docs = np.concatenate((np.arange(100), np.arange(n)))
    row = {"doc_ids": np.arange(n), "lengths": np.full(n, 10), "terms": np.array([0, 1]), "holders": np.array([100, n]),
           "docs": docs, "counts": np.ones(len(docs), np.int64)}
    segment, looked_at = lexical.Segment(row, block), []
    scores = segment.scores
    monkeypatch.setattr(segment, "scores", lambda docs, asked: looked_at.append(len(docs)) or scores(docs, asked))
    top = segment.search(np.array([0, 1]), np.ones(2, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64)), 10)
    assert top[1].tolist() == list(range(10)) and sum(looked_at) == 100


# -- conversations ---------------------------------------------------------------------------------------------------


def trie(rows, ties_up=True):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(sorted(x, key=lambda y: y[2:], reverse=not ties_up), key=lambda y: y[:2])]
           for c, x in turns.items()}
    rebuilt = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + mine[h:]
    members, ends = defaultdict(set), defaultdict(list)
    for c, sequence in rebuilt.items():
        for d in range(len(sequence) + 1):
            members[tuple(sequence[:d])].add(c)
        ends[tuple(sequence)].append(c)
    out = set()
    for node, convs in members.items():
        below = [u for u in members if u[:len(node)] == node]
        children = [u for u in members if len(u) == len(node) + 1 and u[:-1] == node]
        parents = {u[:-1] for u in members if u}
        out.add((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children),
                 sum(u not in parents for u in below), sum((len(members[u]) - 1) * len(u[-1][1].encode()) for u in below if u),
                 hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def built(df):
    rows = [tuple(r) for r in conversation_trie.prefix_trie(df).select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def talks(seed, n=60, longest=14):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 200), n):
        for turn in range(rng.choice([0, 1, 2, 5, longest])):
            text = rng.choice(["hello", "hello", "ja", "é日", "", None])
            rows.append((c, turn, rng.choice(["user", "user", None]), text))
    return [r for r in rows if rng.random() < 0.95]


SCHEMA = "conv_id bigint, turn int, role string, text string, ix int, depth string, x0 int, base int, head int"


def frame(spark, rows):
    ship_package(spark)
    return spark.createDataFrame([(*r, 1, "d", 2, 3, 4) for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_equals_brute_force(spark, seed):
    rows = [r for r in talks(seed) if r[0] >= 0]
    assert built(frame(spark, rows)) == trie(rows)


def test_trie_with_a_long_conversation_in_small_blocks(spark, monkeypatch):
    """One conversation holds most turns and all conversations share them; paths hang on paths that hang on paths."""
    monkeypatch.setattr(conversation_trie, "position_block", lambda c: __import__("pyspark").sql.functions.floor(
        (__import__("pyspark").sql.functions.col(c) if isinstance(c, str) else c) / 7))
    monkeypatch.setattr(conversation_trie, "ID_BLOCK", 3)
    long = [("user", f"t{i % 9}") for i in range(90)]
    rows = [(5, i, *turn) for i, turn in enumerate(long)]
    for c in range(6, 40):
        keep = 90 - 2 * c
        rows += [(c, i, *turn) for i, turn in enumerate([*long[:keep], ("user", f"own {c // 3}"), ("user", "last")])]
    rows += [(c, i, "user", "same") for c in range(50, 80) for i in range(9)]
    assert built(frame(spark, rows)) == trie(rows)


def test_trie_edge_cases(spark):
    base = [(0, None, None, None), (0, None, "user", "first"), (0, 3, "user", "x" * 5000), (0, -1, "user", "before")]
    repeated = [(7, 1, "user", "same")] * 3 + [(None, 1, "user", "nobody")]
    # Nothing is left of conversation 12, whose base isn't stored and whose own turns are fewer than its head.
    short = [(c, 0, "user", "only") for c in (12, 13, 14, 16)]
    rows = base + repeated + short
    got = built(frame(spark, rows))
    # Different turns of one number are ordered by a hash, so either order of the two in conversation 0 is right.
    assert got in (trie(rows), trie(rows, ties_up=False))
    assert built(frame(spark, rows)) == got
    # A third of all rows is one repeated row.
    copies = [(9, 1, "user", "same")] * 40 + [(c, i, "user", "same") for c in (5, 10, 11) for i in range(30)]
    assert built(frame(spark, copies)) == trie(copies)
    assert built(frame(spark, rows).limit(0)) == set()
    assert built(frame(spark, [(None, 1, "user", "x")])) == set()


def test_letters_that_collide_are_replaced(spark, monkeypatch):
    """With a hash that can't tell two texts apart, the check of the stored turns asks for other letters."""
    rows = [(c, i, "user", t) for c, t in ((0, "a"), (1, "b"), (2, "a")) for i in range(10)]
    df, asked = frame(spark, rows), []
    differ = conversation_trie.letters_differ
    monkeypatch.setattr(conversation_trie, "letters_differ", lambda d, salt: asked.append(salt) or salt < 2 or differ(d, salt))
    assert built(df) == trie(rows) and asked == [0, 1, 2]
    from pyspark.sql import functions as F

    mixed = df.withColumn("text", F.col("text"))
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(5).cast("bigint"))
    assert differ(mixed, 0)


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op13_lexical_search"])
def test_queries_match_sql(spark, small_dir, small_duckdb, name):
    problem, count, _ = compare(spark, small_duckdb, small_dir, QUERIES[name], ORACLES[name])
    assert problem is None and count > 0, problem
