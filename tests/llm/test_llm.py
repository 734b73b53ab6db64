"""The numbered operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import brute  # noqa: E402
from harness import DATA  # noqa: E402

from changeloom.llm import (boosting, bpe, embedding_dedup, html_text, language, line_dedup, ngram_join, packing,  # noqa: E402
                            quality, setjoin, toxicity, url_filter)
from changeloom.llm.queries import HOST_RULES, ORACLES, QUERIES  # noqa: E402
from changeloom.session import ship_package  # noqa: E402

PROSE = "the cat of the house is in the garden and it was there for a long day with all of the others that came by "
# Names that the operators use inside, as extra columns.
CLASHING = ["sig", "shape", "a", "b", "u", "v", "line", "tokens", "n", "bucket", "_removed", "_doc", "kept", "score", "ids", "host"]


def prose(seed, words=120):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioustrnlm") for _ in range(rng.randint(2, 7))) for _ in range(words))


EDGE = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (6, "A b\nA b\n\nc"), (6, "A b\nA b\n\nc"), (None, PROSE), (None, None),
    (7, "x" * 30_000), (8, prose(1)), (9, prose(1) + " end"), (10, "\n".join([prose(2), prose(3), prose(2)])), (11, "日本語 é <|endoftext|> ß"),
    (12, prose(4, 20_000)), (13, "!!! ??? 123"), (14, prose(1).upper()), (15, PROSE * 20),
]


@pytest.fixture(scope="module")
def edge(spark):
    ship_package(spark)
    rows = [(i, t, "en" if k % 2 else "de", None, *([k] * len(CLASHING))) for k, (i, t) in enumerate(EDGE)]
    schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{c} int" for c in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def documents(spark, small_dir):
    ship_package(spark)
    return spark.read.parquet(f"{small_dir}/documents.parquet")


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# -- tokens ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(Path(bpe.default_path()).read_text(encoding="utf-8"))


ODD = ["", " ", "  a", "a  b", "it's they'll  \n\n x\t y ", "<|endoftext|>a <|endoftext|>", "ééé ñ 日本語 😀😀", "a" * 3000,
       " x \xa0y\x85z", "x \x1c y", "foo\n bar \nbaz  ", "1234567890 ½ ²", "don't'S", "\r\n \r\n", "aaa bbb" * 50]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab 'stre\n\t.,1é日 　\x1d_-") for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ids_equal_the_library(library, vocabulary):
    encoder = packing.Encoder(Path(bpe.default_path()).read_text(encoding="utf-8"))
    for text in ODD + random_texts(1500):
        expected = library.encode(text, add_special_tokens=False).ids
        raw = vocabulary.encode(text)
        assert np.frombuffer(raw, "<u4").tolist() == expected
        assert encoder.ids(text).tolist() == expected
        assert vocabulary.decode(raw).decode() == library.decode(expected, skip_special_tokens=False)


def test_every_token_encodes_to_itself(vocabulary):
    assert all(vocabulary._stands(token) for token in range(len(vocabulary.parts)))


def test_digests(edge, library):
    expected = sorted((i if i is not None else -1, len(ids := library.encode(t or "", add_special_tokens=False).ids),
                       hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                       hashlib.sha256((t or "").encode()).hexdigest()) for i, t in EDGE)
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in bpe.digests(edge).collect()) == expected
    assert bpe.digests(edge.limit(0)).count() == 0


def test_encode_and_decode_columns(edge):
    out = bpe.decode(bpe.encode(edge), out="again").select("text", "again", "sig").collect()
    assert [r["again"] for r in out] == [r["text"] or "" for r in out]


# -- URL filters -----------------------------------------------------------------------------------------------------


URLS = [("https://spam-farm.example.org/en/728?x", "block", None), (None, "allow", None), ("http://X.NET/es/q#a", "block", "net/es/"),
        ("abc", "allow", None), ("http://cheap-pills.example.org/", "block", None), ("", "allow", None),
        ("http://www.example.com/en/1", "allow", "www.example.com/en/"), ("http://example.com", "allow", None),
        ("http://notexample.com/en/x", "allow", "com/"), ("http://a.Example.com/en/", "block", "example.com/en/"),
        ("http://a.example.com/EN/", "allow", "com/"), ("ftp://net/fr/a://b", "block", "net/fr/"), ("://", "allow", None),
        ("http://a.net?/es/", "allow", None), ("http://" + "a." * 20_000 + "net/es/", "block", "net/es/")]


def test_url_rules(spark):
    df = spark.createDataFrame([(i % 14, url, "x") for i, (url, _, _) in enumerate(URLS)], "page_id int, url string, rule string")
    got = {r["url"]: (r["verdict"], r["rule"]) for r in url_filter.judged(df, HOST_RULES).collect()}
    assert got == {url: (verdict, rule) for url, verdict, rule in URLS}
    assert url_filter.judged(df.limit(0), HOST_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judged(df, [], []).collect()} == {"allow"}


def test_rules_are_filed_under_their_rarest_token():
    index = url_filter.rarest(HOST_RULES, {"com": 5, "example": 9, "en": 7, "www": 1, "net": 3, "es": 4, "fr": 2})
    assert {t: [r.text for r in rules] for t, rules in index.items()} == {
        "com": ["com/", "example.com/en/"], "www": ["www.example.com/en/"], "net": ["net/es/"], "fr": ["net/fr/"]}


def test_url_query_stays_native(spark, small_dir):
    plan = QUERIES["op2_url_filters"](spark, str(small_dir))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_queries_with_sql(spark, small_dir, small_duckdb):
    from harness import compare

    for name, sql in ORACLES.items():
        assert compare(spark, small_duckdb, small_dir, QUERIES[name], sql)[0] is None


# -- HTML ------------------------------------------------------------------------------------------------------------


def test_article_without_its_surroundings():
    page = ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>A</a></ul></nav>"
            "<!-- <p>no</p> --><div class='ad'>Buy the best of all things and be happy.</div><article><h1>Short &amp; good</h1>"
            "<p><b>First  line<br>goes\non.<br><p>Be.<aside>Not this</aside><p>Fish &amp; chips &#233;</p><form>Mail <input></form>"
            "<div class=comments><p>I like this and the other one too</p></div></article><footer>&copy; x</footer></body>")
    assert html_text.main_text(page) == "Short & good\nFirst line goes on.\nBe.\nFish & chips é"


def test_prose_without_an_article_tag():
    text = "the cat is in the house and it is good for you. " * 5
    page = f"<body><header><h1>Site</h1></header><div id=cookie-notice>the cookies are of use</div><p>{text}</p><p>Short one.</p><p>{text}</p>"
    assert html_text.main_text(page) == f"{text.strip()}\nShort one.\n{text.strip()}"


@pytest.mark.parametrize("page", [None, "", "<", "<<<>>>", "<p", "<!--", "<script>", "</div></div>", "<a href='x", "&am", "<p>" * 5000])
def test_broken_pages(page):
    assert "<p" not in html_text.main_text(page)


def test_pages(spark, small_dir):
    ship_package(spark)
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    rows = html_text.page_texts(pages.withColumn("text", pages["url"])).collect()
    assert len(rows) == pages.count() and all(r["n_chars"] == len(r["text"]) > 0 for r in rows)
    odd = spark.createDataFrame([(None, None, None), (1, None, "")], "page_id bigint, url string, html string")
    assert sorted((r["text"], r["n_chars"]) for r in html_text.page_texts(odd).collect()) == [("", 0)] * 2
    assert html_text.page_texts(odd.limit(0)).count() == 0


# -- packing ---------------------------------------------------------------------------------------------------------


def test_assignment_fills_every_sequence():
    rng = random.Random(3)
    for _ in range(100):
        lengths = [rng.choice((1, rng.randrange(1, 30), rng.randrange(1, 5000), 1024)) for _ in range(rng.randrange(60))]
        documents, sequences = defaultdict(list), defaultdict(list)
        for document, start, length, sequence, offset in packing.assign(lengths):
            documents[document].append((start, length))
            sequences[sequence].append((offset, length))
        for parts, total in [(sorted(documents[d]), n) for d, n in enumerate(lengths)] + [(sorted(s), None) for s in sequences.values()]:
            at = 0
            for start, length in parts:
                assert start == at and length > 0
                at += length
            assert at == total if total else at == 1024 or at & (at - 1) == 0 and at < 1024


def test_costs_are_balanced():
    rng = random.Random(5)
    lengths = [rng.randrange(1, 1024) for _ in range(2000)]
    spent, used = defaultdict(float), defaultdict(int)
    for _, _, length, sequence, _ in packing.assign(lengths):
        spent[sequence] += packing.cost(length)
        used[sequence] += length
    whole = np.array([spent[s] for s in spent if used[s] == packing.LENGTH])
    assert whole.std() / whole.mean() < 0.2


def test_packed_rows(edge, library):
    rows = packing.packed(edge, with_ids=True).collect()
    encoded = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in EDGE if i is not None}
    seen, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] is not None:
            assert r["ids"] == encoded[r["doc_id"]][r["start"]:r["start"] + r["length"]] and r["doc_tokens"] == len(encoded[r["doc_id"]])
            seen[r["doc_id"]] += r["length"]
    assert seen == {i: n * len(encoded[i]) for i, n in zip(seen, [2 if i == 6 else 1 for i in seen])} and len(seen) == len(encoded)
    for parts in sequences.values():
        assert all(a[0] + a[1] == b[0] for a, b in zip(sorted(parts), sorted(parts)[1:])) and min(parts)[0] == 0
    assert packing.packed(edge.limit(0)).count() == 0


# -- embeddings ------------------------------------------------------------------------------------------------------


def test_embeddings_against_brute_force(spark):
    ship_package(spark)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((120, 32))
    near = base[rng.integers(0, 120, 180)] + rng.standard_normal((180, 32)) * rng.uniform(0, 0.5, (180, 1))
    vectors = np.concatenate([base, near, np.repeat(base[:1], 40, 0), base[1:2] * 7]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [float("inf")] * 32]
    rows += [(1000 + i, v, None) for i, v in enumerate(odd)] + [(None, vectors[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, key int").repartition(4)
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df).collect()}
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    expected = linked.sum(1)
    found = np.array([got[i]["n_links"] for i in range(len(vectors))])
    assert (found <= expected).all() and found.sum() >= 0.97 * expected.sum()
    roots = brute.component_of(range(len(vectors)), lambda a, b: linked[a, b])
    same = [got[i]["component_id"] == roots[i] for i in range(len(vectors))]
    assert np.mean(same) > 0.95
    for i in range(len(odd)):
        assert tuple(got[1000 + i])[1:] == (0, 1000 + i, True)
    assert tuple(got[None])[1:] == (0, None, False)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_tiles_lose_and_repeat_nothing(spark, monkeypatch):
    ship_package(spark)
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal(16) + rng.standard_normal((90, 16)) * 0.02
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    assert {tuple(r)[1:3] for r in embedding_dedup.near_vectors(df).collect()} == {(89, 0)}


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    u, g = rng.standard_normal((2, 1500, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    g -= (g * u).sum(1, keepdims=True) * u
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    code = embedding_dedup.product_code(64)
    a, b = (list(embedding_dedup.list_filters(x, code)) for x in (u, 0.9 * u + np.sqrt(0.19) * g))
    assert np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(a, b)]) > 0.97


# -- quality ---------------------------------------------------------------------------------------------------------


def test_quality_measures(documents, edge):
    for df in (documents, edge):
        texts = sorted(((i or -1, brute.base_measures(t)) for i, t in pairs_of(df)))
        got = sorted((r["doc_id"] or -1, tuple(r)[1:6]) for r in quality.document_quality(df).collect())
        assert got == texts
    assert quality.document_quality(edge.limit(0)).count() == 0


def test_quality_keeps_prose_and_drops_junk(spark):
    documents, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.document_quality(documents).drop("quality").join(labels, "doc_id").where("NOT base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_good_documents_keep_their_columns(edge):
    out = quality.good_documents(edge)
    assert out.columns == edge.columns and not {r["doc_id"] for r in out.collect()} & {1, 2, 3, 4, 5, 6, 7, 11, 13}


# -- language --------------------------------------------------------------------------------------------------------


def test_held_out_languages(documents):
    rows = language.document_languages(documents).withColumnRenamed("lang_pred", "p").join(
        documents.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r["held_out"] and len(r["text"]) > 20]
    assert held and np.mean([r["p"] == r["lang"] for r in held]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, edge):
    got = defaultdict(set)
    for r in language.document_languages(edge).collect():
        got[r["doc_id"]].add((r["lang_pred"], r["score"] == 0))
    for i in (1, 2, 3, 13):
        assert got[i] == {("und", True)}
    assert ("und", True) not in got[8] | got[11]
    assert language.document_languages(edge.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "abc", "xx"), (2, "12", None)], "doc_id bigint, text string, lang string")
    assert {r["lang_pred"] for r in language.document_languages(one).collect()} == {"xx", "und"}
    assert language.clear_documents(edge).columns == edge.columns


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 20])
def test_codewords_lie_apart(n):
    code = language.codewords(n)
    distance = (code[:, None] != code[None]).sum(2) + np.eye(n) * 99
    assert code.shape[0] == n and distance.min() >= max(1, code.shape[1] // 4)


# -- lines -----------------------------------------------------------------------------------------------------------


def test_lines_against_brute_force(documents, edge):
    for df in (documents.limit(60), edge):
        expected = defaultdict(set)
        for doc_id, line in brute.later_lines(sorted(set(pairs_of(df)), key=str)):
            expected[doc_id].add(line)
        for r in line_dedup.removed_lines(df).collect():
            assert set(r["removed"]) == expected[r["doc_id"]] and r["n_removed"] == len(r["removed"]), r["doc_id"]
    assert line_dedup.removed_lines(edge.limit(0)).count() == 0


def test_near_lines_chain(spark):
    ship_package(spark)
    rng = random.Random(9)
    base = prose(20, 60).split()
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"w{i}"
        rows.append((i, prose(100 + i, 30) + "\n" + " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {(r["doc_id"], n) for r in line_dedup.removed_lines(df).collect() for n in r["removed"]}
    assert got == brute.later_lines(rows)


def test_documents_without_later_lines(edge):
    out = line_dedup.without_later_lines(edge)
    texts = defaultdict(list)
    for r in out.collect():
        texts[r["doc_id"]].append(r["text"])
    assert out.columns == edge.columns
    assert 5 not in texts and texts[4] == ["one"] and texts[1] == [None] and texts[2] == [""]
    assert texts[6] == ["A b\n\nc"] * 2 and len(texts[None]) == 2


# -- documents -------------------------------------------------------------------------------------------------------


def test_components_against_brute_force(documents, edge):
    for df in (documents, edge):
        sets = {i: brute.shingles(t) for i, t in pairs_of(df) if i is not None}
        roots = brute.component_of(sets, lambda a, b: brute.similar(sets[a], sets[b]))
        for r in ngram_join.document_components(df).collect():
            if r["doc_id"] is None:
                assert r["component_id"] is None
            else:
                assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), roots[r["doc_id"]])
    assert ngram_join.document_components(edge.limit(0)).count() == 0


@pytest.mark.parametrize("size", [6, 11, 13, 15, 40, 90])
def test_frequent_tokens_lose_no_link(spark, monkeypatch, size):
    """Everything is frequent, so only combinations index it."""
    ship_package(spark)
    monkeypatch.setattr(ngram_join, "FREQUENT", 0.0)
    rng = random.Random(size)
    base = prose(size, size + 4).split()
    rows = []
    for i in range(40):
        words = base[rng.randrange(3):len(base) - rng.randrange(3)]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(6)}"
        rows.append((i, " ".join(words)))
    sets = {i: brute.shingles(t) for i, t in rows}
    roots = brute.component_of(sets, lambda a, b: brute.similar(sets[a], sets[b]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.document_components(df).collect()} == roots


def test_similar_sets_share_a_signature():
    """For random pairs of similarity 0.75 or more, with any classing of tokens, and whatever is frequent."""
    rng = np.random.default_rng(3)
    counts = np.zeros(1 << setjoin.SKETCH_BITS, np.int64)
    for _ in range(3000):
        n = int(rng.integers(1, 80))
        tokens = rng.integers(1, 1 << 63, 2 * n, dtype=np.uint64)
        counts[setjoin.bucket(tokens)] = rng.integers(0, 10, len(tokens))
        a = np.unique(tokens[:n])
        drop = int(rng.integers(0, n // 4 + 1))
        b = np.unique(np.concatenate((a[drop:], tokens[n:n + int(rng.integers(0, n // 4 + 1))])))
        if 7 * len(np.intersect1d(a, b)) < 3 * (len(a) + len(b)):
            continue
        frequent = float(rng.integers(0, 10))
        (x, _), (y, _) = (ngram_join.signatures(s, counts, frequent) for s in (a, b))
        assert len(np.intersect1d(x, y))


def test_first_of_each(edge):
    out = ngram_join.first_of_each(edge)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == edge.columns and 5 not in ids and 9 not in ids and 14 not in ids and ids.count(None) == 2


# -- toxicity --------------------------------------------------------------------------------------------------------


def test_held_out_toxicity(spark):
    ship_package(spark)
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1500):
        words = prose(5000 + i, 60).split()
        toxic = i % 6 == 0
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            words[rng.randrange(60)] = rng.choice(["grobnik", "grobnikal", "Vexarot", "vexarots!!"])
        rows.append((i, " ".join(words)))
        if i % 7:
            labels.append((i, int(toxic)))
    labels += [(3, None), (None, 1), (99999, 1), (6, 1), (6, 1)]
    df = spark.createDataFrame(rows + [(5000, None), (5001, ""), (None, "vexarot grobnik")], "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    out = toxicity.document_toxicity(df, marks).collect()
    assert len(out) == 1503 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 1500]
    assert np.mean([r["predicted"] == (r["doc_id"] % 6 == 0) for r in held]) > 0.95
    assert toxicity.document_toxicity(df.limit(0), marks).count() == 0
    assert {round(r["score"], 6) for r in toxicity.document_toxicity(df.limit(3), marks.limit(0)).collect()} == {0.5}


def test_trees_and_isotonic_steps():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    forest = boosting.fit(x, y)
    assert np.mean((boosting.probability(forest, x) >= 0.5) == y) > 0.97
    steps = boosting.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))[1]
    assert (np.diff(steps) > 0).all()


# -- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, documents, small_dir):
    import corpus_pipeline

    docs = documents
    kept = {"quality_rules": lambda d: {r["doc_id"] for r in quality.document_quality(d).where("kept").collect()},
            "language_id": lambda d: {r["doc_id"] for r in language.document_languages(d).where("NOT ambiguous").collect()},
            "ngram_jaccard_join": lambda d: {r["doc_id"] for r in ngram_join.document_components(d).where(
                "doc_id = component_id").collect()}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(small_dir)).persist()
        assert out.columns == documents.columns
        if name in kept:
            assert {r["doc_id"] for r in out.collect()} == kept[name](docs)
        docs = out
    assert corpus_pipeline.run(spark, str(small_dir)).select("doc_id").distinct().count() == docs.count()


def test_large_groups_are_verified_by_clusters(spark, monkeypatch):
    """Variants of one text, many of which don't link with each other, in signatures larger than HEAVY and many tiles."""
    ship_package(spark)
    for module in (setjoin, ngram_join, line_dedup):
        monkeypatch.setattr(module, "HEAVY", 4)
    monkeypatch.setattr(setjoin, "TILE", 16)
    rng = random.Random(12)
    base = prose(77, 60).split()
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(60)] = f"w{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    sets = {i: brute.shingles(t) for i, t in rows}
    roots = brute.component_of(sets, lambda a, b: brute.similar(sets[a], sets[b]))
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.document_components(df).collect()} == roots
    got = {(r["doc_id"], n) for r in line_dedup.removed_lines(df).collect() for n in r["removed"]}
    assert got == brute.later_lines(rows)


def test_overlaps():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60 if i % 2 else 6000, 40).astype(np.uint64)) for i in range(50)] + [np.zeros(0, np.uint64)]
    expected = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (setjoin.overlaps(sets) == np.array(expected)).all()


def test_equal_texts_in_any_order(spark):
    """The smallest id comes last in its task, and a near copy lies elsewhere."""
    ship_package(spark)
    text = prose(31, 60)
    rows = [(i, text) for i in (9, 7, 5)] + [(20, text + " more"), (2, "a b"), (1, "a b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.document_components(df).collect()} == {
        9: 5, 7: 5, 5: 5, 20: 5, 2: 1, 1: 1}
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.removed_lines(df).collect()} == {9: 1, 7: 1, 5: 0, 20: 1, 2: 1, 1: 0}
