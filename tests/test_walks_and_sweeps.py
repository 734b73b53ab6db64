"""Walks, as-of rules, sweeps, ordered pieces and stores, against brute force in small blocks."""

import random

import pytest
from pyspark.sql import functions as F

from changeloom.operators import conversations as M
from changeloom.operators import diffs as D
from changeloom.operators import history as H
from changeloom.operators import plans as P
from changeloom.operators import prepare
from changeloom.plans import flows
from changeloom.sources import tables


def forest(seed, n=240):
    """Commits of two repositories; parents are older, some are far away, some aren't stored."""
    rng = random.Random(seed)
    rows = []
    for repo in (1, 2):
        for pos in range(n if repo == 1 else 25):
            far = rng.random() < 0.1
            up = pos + (rng.randint(20, 60) if far else rng.randint(1, 4))
            rows.append((repo, f"{repo}-{pos}", None if rng.random() < 0.01 else f"{repo}-{up}", pos))
    return rows


@pytest.mark.parametrize("block_rows", [1, 7, 64, 65536])
def test_walks_cross_blocks(spark, block_rows):
    rows = forest(block_rows)
    up = {(r, s): p for r, s, p, _ in rows}
    stored = set(up)
    heads = [(1, "1-0"), (1, "1-3"), (1, "1-100"), (2, "2-0"), (2, "2-24"), (2, "nowhere"), (3, "3-0")]
    want = set()
    for repo, head in heads:
        sha, pos = head, 0
        while (repo, sha) in stored and pos < 30:
            want.add((repo, head, sha, pos))
            sha, pos = up[repo, sha], pos + 1
    commits = spark.createDataFrame(rows, "repo int, sha string, parent1 string, topo_pos int").repartition(5)
    out = H.first_parent_chain(commits, spark.createDataFrame(heads, "repo int, head string"), cap=30, block_rows=block_rows)
    got = [tuple(r) for r in out.select("repo", "head", "sha", "pos").collect()]
    assert len(got) == len(want) and set(got) == want
    assert H.first_parent_chain(commits, spark.createDataFrame([], "repo int, head string"), cap=30).count() == 0


def test_ignore_rules_hold_from_their_commit_on(spark):
    rng = random.Random(3)
    chain = [("r", f"c{p}", p) for p in range(40)] + [("s", f"d{p}", p) for p in range(5)]
    versions = []
    for repo, sha, pos in chain:
        for path in (".gitignore", "lib/.gitignore", "readme.gitignore"):
            if rng.random() < 0.15:
                versions.append((repo, sha, path, None if rng.random() < 0.3 else f"# c\n *.{pos} \n\n{path[0]}{pos}/"))
    versions.append(("r", "elsewhere", ".gitignore", "never"))
    want = {}
    for repo, sha, pos in chain:
        rules = []
        for path, folder in ((".gitignore", ""), ("lib/.gitignore", "lib/")):
            older = [(p, content) for r, s, p in chain if r == repo and p >= pos
                     for r2, s2, path2, content in versions if (r2, s2, path2) == (r, s, path)]
            content = min(older, key=lambda x: x[0])[1] if older else None
            rules += [folder + line.strip() for line in (content or "").split("\n") if line.strip() and not line.strip().startswith("#")]
        if rules:
            want[repo, sha] = rules
    on_chain = spark.createDataFrame(chain, "repo string, sha string, pos int")
    made = spark.createDataFrame(versions, "repo string, sha string, path string, content string")
    for bucket in (1, 8, 64):
        out = H.ignore_rules_at(on_chain.union(on_chain), made, on_chain, bucket=bucket).collect()
        assert {(r.repo, r.sha): r.existing_gitignore for r in out} == want and len(out) == len(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_conflicts_of_a_hot_file(spark, seed):
    rng = random.Random(seed)
    rows = [(0, rng.choice(["hot", "hot", "hot", "cold", None]), rng.randrange(3), pos, rng.randrange(600), rng.choice([0, 1, 1, 5, 90]))
            for pos in range(220)]
    want = {}
    for f in {r[1] for r in rows}:
        ranges = [(c, p, s, s + max(n - 1, 0)) for _, file, c, p, s, n in rows if file == f]
        for c, p, s, e in ranges:
            before = [(x[3], -x[1], x) for x in ranges if (x[2], x[1]) < (s, p) and x[0] != c and s - x[3] <= 3]
            after = [(-x[2], -x[1], x) for x in ranges if (x[2], x[1]) > (s, p) and x[0] != c and x[2] - e <= 3]
            b, a = (max(side)[2] if side else None for side in (before, after))
            gaps = [max(s - x[3], x[2] - e) for x in (b, a) if x]
            if gaps:
                want[f, p] = (c, b and b[0], b and b[1], a and a[0], a and a[1], min(gaps))
    ranges = spark.createDataFrame(rows, "plan int, file string, commit_ix int, pos int, start_line int, line_count int").repartition(4)
    for block_lines in (8, 100, 4096):
        out = P.nearest_conflicts(ranges, block_lines=block_lines).collect()
        got = {(r.file, r.pos): (r.commit_ix, r.before_commit, r.before_pos, r.after_commit, r.after_pos, r.gap) for r in out}
        assert len(got) == len(out) and got == want


def test_patch_pieces_make_the_combined_patch(spark):
    rng = random.Random(5)
    rows = []
    for key in ("hot", "a", None):
        for no in range(1, {"hot": 150, "a": 1}.get(key, 6)):
            start = rng.randrange(500)
            rows.append((key, no, f"diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -{start},1 +1 @@\n-x{no}" + rng.choice(["", "\n"])))
    hunks = spark.createDataFrame(rows, "k string, hunk_no int, patch string").repartition(3)
    whole = {r.k: (r.n_hunks, r.patch) for r in D.combined_patches(hunks, ["k"]).collect()}
    for block_lines in (16, 65536):
        pieces = D.patch_pieces(hunks, ["k"], block_lines=block_lines).orderBy("piece_no").collect()
        assert len(pieces) == len(rows)
        assert {k: (n, "".join(p.piece for p in pieces if p.k == k)) for k, (n, _) in whole.items()} == whole


def test_many_hunks_and_files_keep_their_headers(spark):
    one = "diff --git a/f b/f\nindex 1..2\n--- a/f\n+++ b/f\n" + "".join(f"@@ -{i} +{i} @@\n-a{i}\n+b{i}\n" for i in range(1, 3001))
    many = "".join(f"diff --git a/f{i} b/f{i}\n--- a/f{i}\n+++ b/f{i}\n@@ -1 +1 @@\n-a\n+b{i}\n" for i in range(3000))
    df = spark.createDataFrame([(one,), (many,)], "diff string")
    a, b = (r[0] for r in df.select(D.split_hunks("diff")).collect())
    head = one[:one.index("@@")]
    assert a == [f"{head}@@ -{i} +{i} @@\n-a{i}\n+b{i}\n" for i in range(1, 3001)]
    assert b == [f"diff --git a/f{i} b/f{i}\n--- a/f{i}\n+++ b/f{i}\n@@ -1 +1 @@\n-a\n+b{i}\n" for i in range(3000)]
    compat = df.limit(1).select(D.split_hunks_compat("diff")).first()[0]
    assert compat == a


def test_notice_follows_the_row_that_spends_the_budget(spark):
    rows = [("s", i, f"part {i}", 40) for i in range(5)] + [("exact", 0, "all", 100), ("small", 0, None, 10)]
    df = spark.createDataFrame(rows, "k string, pos int, shown string, charged int")
    out = D.context_parts(df, ["k"], "pos", cap=100).orderBy("k", "pos", "part_no").collect()
    assert [(r.k, r.pos, r.part_no, r.part) for r in out] == [
        ("exact", 0, 0, "all"), ("exact", 0, 1, D.OMITTED), ("s", 0, 0, "part 0"), ("s", 1, 0, "part 1"), ("s", 2, 0, "part 2"),
        ("s", 2, 1, D.OMITTED)]


def test_batches_ask_for_their_hunks(spark):
    files = spark.createDataFrame([("f", 5, 20_000, 100), ("big", 7, 20_000, 100)], "file_path string, n_hunks int, total_chars int, remaining int")
    hunks = spark.createDataFrame([(f, i, f"@@ {i}") for f, n in (("f", 5), ("big", 7)) for i in range(1, n + 1)],
                                  "file_path string, hunk_no int, patch string")
    out = D.batch_requests(D.batch_plan(files), hunks, ["file_path"])
    got = {(r.file_path, r.start_hunk): (r.end_hunk, r.request) for r in out.collect()}
    assert sorted(got) == [("big", 1), ("big", 3), ("big", 5), ("big", 7), *[("f", i) for i in range(1, 6)]]
    assert got["big", 3] == (4, "Describe hunks 3-4 of 7 from 'big' in two to four sentences.\n\nHunk 3:\n@@ 3\n\nHunk 4:\n@@ 4")
    answers = out.withColumn("summary", F.concat(F.lit(" s"), F.col("start_hunk").cast("string"), F.lit("\n")))
    text = {r.file_path: r.summary for r in D.batched_summary(answers, ["file_path"]).collect()}
    assert text["big"] == "[batched summary — 7 hunk(s)]\n  Hunks 1-2: s1\n  Hunks 3-4: s3\n  Hunks 5-6: s5\n  Hunks 7-7: s7"


def test_large_files_are_listed_but_not_read(spark, tmp_path):
    for name, n in (("small.txt", 10), ("edge.txt", 100), ("large.txt", 101)):
        (tmp_path / name).write_bytes(b"x" * n)
    files = tables.read_files(spark, str(tmp_path), max_bytes=100)
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.content and len(r.content)) for r in files.collect()}
    assert got == {"small.txt": (10, 10), "edge.txt": (100, 100), "large.txt": (101, None)}
    assert "LessThanOrEqual(length,100)" in files._jdf.queryExecution().executedPlan().toString()


def test_plan_files_of_any_layout(spark, tmp_path):
    record = {"commits": [{"subject": "fix: a", "hunks": ["a::1"]}], "gitignore": ["*.x"], "hunk_patches": {"a::1": "line\nline"}}
    import json

    (tmp_path / "one.json").write_text(json.dumps(record))
    (tmp_path / "two.json").write_text(json.dumps(record, indent=2) + "\n")
    (tmp_path / "cut.json").write_text(json.dumps(record, indent=2)[:40])
    good, broken = tables.read_plan(spark, str(tmp_path))
    assert sorted(r.file.rsplit("/", 1)[1] for r in good.collect()) == ["one.json", "two.json"]
    assert all(r.hunk_patches == record["hunk_patches"] and r.gitignore == ["*.x"] for r in good.collect())
    assert [r.file.rsplit("/", 1)[1] for r in broken.collect()] == ["cut.json"]


def test_plan_files_are_listed_by_tasks_as_spark_lists_them(spark, tmp_path):
    def as_spark_reads(path):
        found = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
        return found.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("document"))

    def rows(found):
        return sorted((r[0], bytes(r[1])) for r in found.select("file", F.col("document").cast("binary")).collect())

    for name, text in {"a.json": b"{}", "below/x y%41+\u00e9.json": b"x\r\ny\n", "empty": b"", "_hidden": b"-", "_a=b": b"ab", ".h": b"-",
                       "file=a%2Fb.txt": b"\xff\xfe", "below/deep/_metadata": b"-", "below/.no/x": b"-", "_no/x": b"-", "k=v/z": b"z"}.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(text)
    for path in (str(tmp_path / "in"), f"file://{tmp_path}/in"):
        found = tables._whole_texts(spark, path)
        # The driver holds no list of the files.
        assert "Scan text" not in found._jdf.queryExecution().executedPlan().toString() and found.inputFiles() == []
        assert rows(found) == rows(as_spark_reads(path)) and len(rows(found)) == 5
    # What Spark unpacks is still unpacked.
    import gzip

    (tmp_path / "in" / "packed.gz").write_bytes(gzip.compress(b"packed"))
    assert b"packed" in [text for _, text in rows(tables._whole_texts(spark, str(tmp_path / "in")))]


def test_counters_come_from_the_write(spark, tmp_path):
    rows = [(None, False, "train"), ("bad", False, None), (None, True, "train"), (None, False, "val")]
    df = spark.createDataFrame(rows, "problem string, is_augmented boolean, split string")
    counted = tables.write_counted(df, str(tmp_path / "out"), **prepare.counters()).first()
    assert tuple(counted) == (3, 1, 1, 2, 1) == tuple(prepare.prep_counters(df).first())
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_store_is_compacted_once(spark, tmp_path):
    path = str(tmp_path / "store")
    text = "word " * 200
    rows = [(1, "m0", "system", "s", 0, None, "original", 0), (1, "m1", "user", text, 1, None, "original", 1),
            (1, "m2", "tool", text, 2, None, "original", 2), (1, "m3", "tool", "short", 3, None, "original", 3),
            (2, "m0", "user", "hi", 0, None, "original", 0)]
    schema = "conv_id bigint, msg_id string, role string, content string, turn bigint, parent_id string, kind string, msg_ix bigint"
    tables.append_messages(spark.createDataFrame(rows, schema), path)
    answers = spark.createDataFrame([(1, "m1", "brief", "-"), (1, "m2", text + "x", "points")], "conv_id bigint, msg_id string, short string, shorter string")
    limits = {"summary_tokens": 50, "recent_tokens": 100}
    first = flows.compact_store(spark, path, answers, 60, **limits).collect()
    assert {(r.msg_id, r.parent_id, r.role, r.kind) for r in first} == {("m4", "m1", "meta", "summary"), ("m5", "m2", "meta", "summary")}
    again = flows.compact_store(spark, path, answers, 60, **limits).collect()
    assert again == []
    log = tables.read_messages(spark, path)
    assert log.count() == 7
    roots = {r.msg_id: r.root_id for r in M.root_originals(log.where("conv_id = 1"), ["conv_id"]).collect()}
    assert roots["m4"] == "m1" and roots["m5"] == "m2" and roots["m3"] == "m3"
    view = {r.msg_id: r.content for r in M.current_view(log).where("conv_id = 1").collect()}
    assert view["m1"].endswith("\nbrief") and view["m2"].endswith("\npoints") and view["m3"] == "short" and len(view) == 4


def test_tool_results_by_dialect(spark):
    df = spark.createDataFrame([("out \"x\"", "call_1"), ("out", None)], "c string, i string")
    native, chat = ([r[0] for r in df.select(M.tool_result_message("c", "i", d)).collect()] for d in ("native", "chat"))
    assert native == ['{"role":"tool","content":"out \\"x\\""}', '{"role":"tool","content":"out"}']
    assert chat == ['{"role":"tool","tool_call_id":"call_1","content":"out \\"x\\""}', '{"role":"tool","content":"out"}']
