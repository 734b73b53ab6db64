"""Blocked computations, graph and range joins against brute force, with tiny blocks and hot keys."""

import random

from pyspark.sql import functions as F

from changeloom.functions import scale
from changeloom.functions.scale import (max_so_far, numbered, position_block, preceding_values, scanned, sum_before, with_totals)
from changeloom.operators import history as H
from changeloom.operators import plans as P


def hot_rows(seed, n=300):
    """(key, pos, value): one key holds most rows, one key is NULL, positions have gaps."""
    rng = random.Random(seed)
    rows, used = [], set()
    while len(rows) < n:
        key = rng.choice(["hot", "hot", "hot", "a", "b", None])
        pos = rng.randint(0, 400)
        if (key, pos) not in used:
            used.add((key, pos))
            rows.append((key, pos, rng.choice([None, rng.randint(0, 9)])))
    return rows


def by_key(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(row[0], []).append(row)
    return groups


def test_numbered_and_running_values(spark):
    rows = hot_rows(1)
    df = spark.createDataFrame(rows, "key string, pos bigint, value bigint").repartition(7)
    block, order = position_block("pos", 8), [F.col("pos")]
    out = numbered(df, ["key"], block, order, "no", total="n")
    out = sum_before(out, ["key"], block, order, F.coalesce("value", F.lit(0)), "before")
    out = max_so_far(out, ["key"], block, order, F.col("value"), "top")
    got = {(r.key, r.pos): (r.no, r.before, r.top, r.n) for r in out.collect()}
    assert len(got) == len(rows)
    for key, group in by_key(rows).items():
        before, top = 0, None
        for no, (_, pos, value) in enumerate(group, 1):
            if value is not None:
                top = value if top is None else max(top, value)
            assert got[key, pos] == (no, before, top, len(group))
            before += value or 0


def test_global_numbering(spark):
    df = spark.range(1000).withColumn("h", F.md5(F.col("id").cast("string")))
    out = numbered(df, [], F.substring("h", 1, 1), [F.col("h")], "no").orderBy("no").collect()
    assert [r.no for r in out] == list(range(1, 1001))
    assert [r.h for r in out] == sorted(r.h for r in out)


def test_global_blocks_in_groups(spark, monkeypatch):
    monkeypatch.setattr(scale, "GROUP_BLOCKS", 3)
    rows = [(i, (i * 7) % 11 if i % 5 else None) for i in range(0, 400, 3)]
    df = spark.createDataFrame(rows, "pos bigint, value bigint").repartition(5)
    out = scanned(df, [], position_block("pos", 8), [F.col("pos")],
                  {"s": (F.col("value"), "sum", -1), "m": (F.col("value"), "max", 0)}, {"all": (F.col("value"), "sum")}).collect()
    values = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        before = [v for p, v in rows if p < r.pos and v is not None]
        upto = before + ([values[r.pos]] if values[r.pos] is not None else [])
        assert (r.s, r.m, r["all"]) == (sum(before) if before else None, max(upto, default=None),
                                        sum(v for _, v in rows if v is not None))


def test_one_evaluation_for_rows_and_totals(spark, small_dir):
    """The source is read once, also where values are nested, filtered and used twice by the caller."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "source", "text")
    block, order = position_block("doc_id", 16), [F.col("doc_id")]
    out = with_totals(docs, ["source"], block, {"n_chars": (F.length("text"), "sum")})
    out = numbered(out.where("n_chars > 0"), ["source"], block, order, "no")
    rows = out.select("doc_id", "no", F.length("text").alias("n")).collect()
    assert len(rows) == docs.count()
    joined = out.select("source", "no").join(out.groupBy("source").agg(F.max("no").alias("last")), "source")
    assert joined.where("no = last").count() == docs.select("source").distinct().count()
    shown = _final_plan(out)
    assert shown.count("FileScan") == 1, shown


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_preceding_values_cross_blocks(spark):
    rows = [("hot", i, f"s{i}") for i in range(1, 60)] + [("b", i, f"b{i}") for i in range(1, 6)]
    df = spark.createDataFrame(rows, "key string, no int, s string")
    for block_rows in (4, 5, 7, 1000):
        out = preceding_values(df, ["key"], "no", F.col("s"), 4, "prior", rows=block_rows)
        got = {(r.key, r.no): r.prior for r in out.collect()}
        assert len(got) == len(rows)
        for key, no, _ in rows:
            assert got[key, no] == [f"{key[0] if key == 'b' else 's'}{i}" for i in range(max(1, no - 4), no)]


def components(claims):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    owner = {}
    for plan, commit, hunk in claims:
        find((plan, commit))
        other = owner.setdefault((plan, hunk), (plan, commit))
        a, b = find(other), find((plan, commit))
        parent[max(a, b)] = min(a, b)
    return {node: find(node)[1] for node in parent}


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(3)
    chain = [(1, i, i) for i in range(120)] + [(1, i + 1, i) for i in range(119)]
    star = [(2, i, 0) for i in range(80)] + [(2, i, 1000 + i) for i in range(80)]
    noise = [(3, rng.randrange(100), rng.randrange(90)) for _ in range(110)]
    alone = [(4, 5, 1)]
    claims = sorted(set(chain + star + noise + alone))
    out = P.overlap_components(spark.createDataFrame(claims, "plan bigint, commit_ix bigint, hunk bigint"))
    got = {(r.plan, r.commit_ix): r.component for r in out.collect()}
    assert got == components(claims)
    merged = P.component_hunks(
        spark.createDataFrame([(*c, 0) for c in claims], "plan bigint, commit_ix bigint, hunk bigint, pos int"), out)
    assert merged.where("plan = 1").select("component").distinct().count() == 1


def test_dependent_splits_on_a_hot_file(spark):
    rng = random.Random(4)
    rows = [(0, "hot" if rng.random() < 0.8 else "cold", rng.randrange(3), pos, rng.randrange(3000), rng.choice(
        [0, 1, 1, 5, 30, 400])) for pos in range(250)]
    ranges = spark.createDataFrame(rows, "plan int, file string, commit_ix int, pos int, start_line int, line_count int")
    want = set()
    for a in rows:
        for b in rows:
            if a[1] == b[1] and a[3] < b[3] and a[2] != b[2]:
                end_a, end_b = a[4] + max(a[5] - 1, 0), b[4] + max(b[5] - 1, 0)
                gap = max(b[4] - end_a, a[4] - end_b)
                if gap <= 3:
                    want.add((a[1], a[2], a[3], b[2], b[3], gap))
    for bucket in (1, 16, 64):
        out = P.dependent_splits(ranges, bucket=bucket).drop("plan").collect()
        assert len(out) == len(want) and {tuple(r) for r in out} == want


def test_first_parent_chain_caps_and_balanced_draw(spark):
    commits = [(1, f"c{i}", f"c{i - 1}" if i else None, 300 - i) for i in range(300)]
    commits += [(2, f"d{i}", f"d{i - 1}" if i else None, 12 - i) for i in range(12)]
    df = spark.createDataFrame(commits, "repo int, sha string, parent1 string, topo_pos int")
    heads = spark.createDataFrame([(1, "c299"), (2, "d11")], "repo int, head string")
    chain = H.first_parent_chain(df, heads, cap=200)
    got = {(r.repo, r.pos): r.sha for r in chain.collect()}
    assert got == {**{(1, p): f"c{299 - p}" for p in range(200)}, **{(2, p): f"d{11 - p}" for p in range(12)}}
    assert {r.repo for r in H.repos_with_history(chain).collect()} == {1, 2}
    ranges = H.default_branch_ranges(chain)
    picked = H.balanced_draw(ranges, count=151, max_per_repo=100).groupBy("repo").count().collect()
    # Repository 2 has 60 ranges and gives them all, repository 1 fills up.
    assert {r.repo: r["count"] for r in picked} == {1: 91, 2: 60}
    even = H.balanced_draw(ranges, count=21).groupBy("repo").count().collect()
    assert sorted(r["count"] for r in even) == [10, 11]


def test_checkpoint_dir_comes_from_the_session(spark):
    from changeloom.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir()


def test_shuffles_go_once_their_rows_are_kept(spark):
    import time

    from changeloom.llm.components import components
    from changeloom.session import RELEASE, durable

    def shuffles():
        status = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
        return {int(x) for x in str(status.keys().mkString(",")).split(",") if x}

    before, setting = shuffles(), spark.conf.get(RELEASE, None)
    rows = spark.range(1000).withColumn("a", F.col("id") % 100)
    # Both frames stay referenced, so that no collection of garbage can have taken the files.
    dealt = rows.repartition("a").groupBy("a").count()
    kept = durable(dealt)
    linked = components(rows.select("a", F.col("id").alias("b")))
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before and spark.conf.get(RELEASE, None) == setting
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, dealt.collect())) == [(a, 10) for a in range(100)]
    assert linked.count() == 900


def test_lists_of_commits_are_moved_to_their_records_and_texts_only(spark):
    import re

    key = "repo string, base_commit string, head_commit string"
    shas = [f"s{i}" for i in range(6)]
    ranges = spark.createDataFrame([("r", shas[i + n], shas[i], i, n) for i in range(4) for n in (1, 2)], f"{key}, head_pos int, n_commits int")
    diffs = spark.createDataFrame([("r", shas[i + n], shas[i], i % 2, False) for i in range(4) for n in (1, 2)], f"{key}, diff_id bigint, has_binary boolean")
    texts = spark.createDataFrame([(d, f"diff --git a/f{d}.py b/f{d}.py\n--- a/f{d}.py\n+++ b/f{d}.py\n" + "+x\n" * (1 + 99 * d)) for d in (0, 1)],
                                  "diff_id bigint, diff string")
    originals = ranges.select("repo", "head_commit", "n_commits", F.array(F.struct(F.col("head_commit").alias("sha"), F.lit("m").alias(
        "subject"), F.array(F.lit("f")).alias("files"))).alias("original_commits"))
    ignores = spark.createDataFrame([("r", shas[2], ["*.x"])], "repo string, sha string, existing_gitignore array<string>")
    repos = spark.createDataFrame([("r", "url", "main")], "repo string, remote_url string, branch string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = H.assemble_examples(ranges, diffs, originals, ignores, repos, max_chars=200, texts=texts)
        plan = out._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert moved and sum("original_commits" in columns for columns in moved) == 2
    # The longer text is over the limit; its records go.
    assert sorted((r.head_commit, r.n_commits, r.existing_gitignore) for r in rows) == [
        ("s0", 1, []), ("s0", 2, ["*.x"]), ("s2", 1, []), ("s2", 2, [])]
    assert all(r.diff.endswith("+x\n") and r.changed_files == ["f0.py"] and r.original_commits[0].sha == r.head_commit for r in rows)
