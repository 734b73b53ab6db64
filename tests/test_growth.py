"""Steps whose time, disk or memory grew too fast."""

import contextlib
import io
import os

from pyspark.sql import functions as F

from changeloom.llm import piece_bpe
from changeloom.operators import history as H
from changeloom.operators import plans as P
from changeloom.sources import tables


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_each_diff_is_moved_once_whatever_number_of_records_it_goes_into(spark):
    ranges = spark.createDataFrame([(1, f"h{i}", 1, f"b{i}") for i in range(6)], "repo int, head_commit string, n_commits int, base_commit string")
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+b\n"
    texts = spark.createDataFrame([(7, diff), (8, diff * 9)], "diff_id int, diff string")
    diffs = ranges.select("repo", "base_commit", "head_commit", F.when(F.col("head_commit") == "h5", 8).otherwise(7).alias("diff_id"),
                          F.lit(False).alias("has_binary"))
    originals = ranges.select("repo", "head_commit", "n_commits", F.array(F.struct(F.col("head_commit").alias("sha"))).alias("original_commits"))
    ignores = spark.createDataFrame([], "repo int, sha string, existing_gitignore array<string>")
    repos = spark.createDataFrame([(1, "r", "main")], "repo int, remote_url string, branch string")
    out = H.assemble_examples(ranges, diffs, originals, ignores, repos, max_chars=200, texts=texts)
    whole = H.assemble_examples(ranges, diffs.join(texts, "diff_id").drop("diff_id"), originals, ignores, repos, max_chars=200)
    assert sorted(map(str, out.collect())) == sorted(map(str, whole.collect()))
    assert out.select("head_commit").distinct().count() == 5


def test_lists_of_original_commits_are_not_shuffled(spark):
    chain = spark.createDataFrame([(1, "h", f"s{i}", i) for i in range(5)], "repo int, head string, sha string, pos int")
    commits = spark.createDataFrame([(1, f"s{i}", f"t{i}", i == 2) for i in range(5)], "repo int, sha string, subject string, is_merge boolean")
    files = spark.createDataFrame([(1, "s1", "b"), (1, "s1", "a"), (1, "zz", "c")], "repo int, sha string, path string")
    ranges = H.default_branch_ranges(chain, max_commits=2)
    out = H.original_commits(ranges, chain, commits, files)
    found = {(r.head_commit, r.n_commits): [(c.sha, c.subject, c.files) for c in r.original_commits] for r in out.collect()}
    assert found == {("s0", 1): [("s0", "t0", [])], ("s0", 2): [("s0", "t0", []), ("s1", "t1", ["a", "b"])],
                     ("s1", 1): [("s1", "t1", ["a", "b"])], ("s1", 2): [("s1", "t1", ["a", "b"])],
                     ("s2", 2): [("s3", "t3", [])], ("s3", 1): [("s3", "t3", [])]}
    above = plan_of(out).split("Window [collect_list")[0]
    assert "Exchange" not in above and "Join" not in above


def test_raw_files_take_a_folder_for_each_task_not_for_each_name(spark, tmp_path):
    texts = {"a.gz": "x", "b:/c %41": "é\ny", "c[1]{2}": "", **{f"n{i}": f"{i}" for i in range(40)}}
    rows = spark.createDataFrame([(k, v) for k, v in texts.items()] + [("none", None)], "name string, content string").coalesce(2)
    tables.write_files(rows, f"{tmp_path}/out")
    files = tables.read_files(spark, f"{tmp_path}/out").select(tables.stored_name(F.col("path")).alias("name"), F.col("content").cast("string").alias("text"))
    assert {r.name: r.text for r in files.collect()} == {k: v + "\n" for k, v in texts.items()} | {"none": "\n"}
    assert len(os.listdir(f"{tmp_path}/out")) == 2


def test_raw_files_in_stores_that_are_not_mounted_go_by_spark(spark):
    assert tables._local_folder(spark, "file:///a/b") == "/a/b" and tables._local_folder(spark, "/a/b") == "/a/b"
    assert tables._local_folder(spark, "hdfs://host/a") is None and tables._local_folder(spark, "viewfs://x/a") is None


def test_claims_are_dealt_by_number_before_commits_are_counted(spark):
    claims = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 2, 5), (1, 2, 6), (None, 3, 5), (None, 4, 5)], "plan int, commit_ix int, hunk int")
    out = P.double_assigned(claims)
    assert {tuple(r) for r in out.collect()} == {(1, 5, 2), (None, 5, 2)}
    assert "REPARTITION_BY_NUM" in plan_of(out)


CLAIMS = [(1, 9, 1), (1, 4, 1), (1, 4, 2), (1, 2, 2), (1, 7, 3), (1, None, 3), (1, 8, None), (2, 1, 1), (2, 1, 1), (2, 3, 1), (None, 5, 1),
          (None, 6, 1), (3, 5, 1), (3, 6, 2), (3, 6, 3), (3, 5, 3), (3, 4, 9)]
LINKED = {(1, 9, 2), (1, 4, 2), (1, 2, 2), (1, 7, 7), (1, None, None), (1, 8, 8), (2, 1, 1), (2, 3, 1), (None, 5, 5), (None, 6, 6),
          (3, 5, 5), (3, 6, 5), (3, 4, 4)}


def test_small_plans_are_linked_without_rounds(spark, monkeypatch):
    def rounds(*_):
        raise AssertionError("rounds")

    monkeypatch.setattr(P, "_linked_in_rounds", rounds)
    out = P.overlap_components(spark.createDataFrame(CLAIMS, "plan int, commit_ix bigint, hunk int"))
    rows = [tuple(r) for r in out.collect()]
    assert set(rows) == LINKED and len(rows) == len(LINKED)


def test_large_plans_are_linked_in_rounds(spark):
    out = P.overlap_components(spark.createDataFrame(CLAIMS, "plan int, commit_ix bigint, hunk int"), most=4)
    rows = [tuple(r) for r in out.collect()]
    assert set(rows) == LINKED and len(rows) == len(LINKED)


def test_a_chunk_of_one_word_is_not_cut_into_words():
    with open(piece_bpe.default_path(), "rb") as file:
        model = piece_bpe.PieceModel(file.read())
    cut, model.words = model.words, None
    word = model._chunk("▁reading")
    model.words = cut
    assert word == model.encode("reading") and model.decode(word) == b"reading"
    assert model.decode(model.encode("  a\xff \u6f22  b ")) == "  a\xff \u6f22  b ".encode()
