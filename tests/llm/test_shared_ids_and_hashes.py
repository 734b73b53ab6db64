"""Rows that share an id, hashes of long regular words, and what a task remembers."""

import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from test_llm import prose  # noqa: E402

from changeloom.llm import bpe, ngram_join, quality, setjoin, texts  # noqa: E402
from changeloom.session import ship_package  # noqa: E402


def regular(n, letters):
    """Two words whose values are equal under every polynomial modulo 2**64, if they are long enough."""
    word = "".join(letters[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans(letters, letters[::-1]))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_long_regular_words_stay_apart(spark, n):
    ship_package(spark)
    one, two = regular(n, "ab")
    measured = quality.measures(pa.array([f"{one}\n{two}", f"{one}\n{one}", f"{one} x y {two} x y"]))
    assert measured["n_dup_lines"].tolist() == [0, 1, 0] and measured["n_repeat_words"].tolist() == [0, 0, 0]
    rows = [(1, one), (2, two), (3, one.upper())]
    out = ngram_join.document_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: r.component_id for r in out.collect()} == {1: 1, 2: 2, 3: 1}


def test_power_tables_of_long_texts_are_not_kept():
    words = texts.Words(data := np.frombuffer(b"ab " * 200_000, np.uint8), np.array([0, len(data)]))
    assert len(set(words.hashes().tolist())) == 1
    assert all(len(t) <= texts.RUN_BYTES + 1 for t in texts._powers)


@pytest.mark.parametrize("heavy", [128, 1])
def test_components_of_shared_ids_do_not_depend_on_row_order(spark, monkeypatch, heavy):
    ship_package(spark)
    monkeypatch.setattr(setjoin, "HEAVY", heavy)
    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    one, two = prose(1), prose(2)
    rows = [(1, one), (1, two), (2, two + " word"), (3, one + " word"), (4, prose(3)), (0, prose(4)), (5, prose(4)), (5, prose(5)), (6, prose(5) + " end")]
    want = {1: 1, 2: 1, 3: 1, 4: 4, 0: 0, 5: 0, 6: 0}
    for ordered in (rows, rows[::-1]):
        df = spark.createDataFrame(ordered, "doc_id bigint, text string").coalesce(1)
        assert {r.doc_id: r.component_id for r in ngram_join.document_components(df).collect()} == want


def test_tasks_remember_a_bounded_number_of_sets(spark, monkeypatch):
    rows = [(i % 7 + 100 * (i // 7), prose(i % 7)) for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    want = {i: i % 100 for i, _ in rows}
    monkeypatch.setattr(ngram_join, "REMEMBERED", 2)
    assert {r.doc_id: r.component_id for r in ngram_join.document_components(df).collect()} == want


def test_word_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 1000)
    words = bpe.Vocabulary(Path(bpe.default_path()).read_text(encoding="utf-8"))
    words.encode("\n".join(f"w{i}" for i in range(20_000)))
    assert len(words.seen) <= 1000


def test_maps_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(1)
    ruled_out = 0
    for _ in range(4000):
        n = int(rng.integers(1, 400))
        one = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        kept = one[rng.random(len(one)) < rng.choice([0.1, 0.7, 0.9, 1.0])]
        two = np.unique(np.concatenate((kept, rng.integers(0, 1 << 63, int(rng.integers(0, n // 3 + 2))).astype(np.uint64))))
        if not len(two):
            continue
        both = len(np.intersect1d(one, two))
        similar = 4 * both >= 3 * (len(one) + len(two) - both)
        may = setjoin.may_be_similar(len(one), setjoin.bits_of(one), len(two), setjoin.bits_of(two))
        assert may or not similar
        ruled_out += not may
    assert ruled_out > 1000
