"""Commit history to training examples."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.functions import constants as K
from changeloom.functions.scale import BLOCK_ROWS, first_row, first_rows, hash_block, numbered, position_block
from changeloom.functions.text import (LINE_BREAK, as_col, base_name, parent_dir, seeded_hash, split_lines,
                                       strip, suffix)
from changeloom.session import durable

# -- repositories ------------------------------------------------------------------------------------------------


def normalize_url(url: Column | str) -> Column:
    """Remote URL as host/owner/name.  ``.git`` goes before trailing slashes, so ``x.git/`` keeps it."""
    out = as_col(url)
    for prefix in K.URL_PREFIXES:
        out = F.regexp_replace(out, f"^{prefix}", "")
    out = F.regexp_replace(out, "^([^:/]*):", "$1/")
    out = F.regexp_replace(out, "\\.git\\z", "")
    return F.rtrim(out, F.lit("/"))


def priority(name: Column | str, ranking: list[str]) -> Column:
    """Position in the ranking; unlisted names come last."""
    found = F.array_position(F.array(*[F.lit(r) for r in ranking]), as_col(name))
    return F.when(found > 0, found).otherwise(F.lit(len(ranking) + 1))


def pick_remote(remotes: DataFrame, keys: list[str], name: str = "name", url: str = "url",
                position: str = "pos") -> DataFrame:
    """One remote per repository: origin, then upstream, then the first listed."""
    rank = F.struct(priority(name, K.REMOTE_PRIORITY), F.col(position))
    return remotes.groupBy(*keys).agg(F.min_by(url, rank).alias("remote_url"))


def pick_branch(branches: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Default branch per repository; NULL when no well-known name exists."""
    listed = branches.withColumn("_prio", priority(name, K.BRANCH_PRIORITY))
    best = F.min_by(F.when(F.col("_prio") <= len(K.BRANCH_PRIORITY), F.col(name)), F.col("_prio"))
    return listed.groupBy(*keys).agg(best.alias("branch"))


def dedup_repos(repos: DataFrame, path: str = "path", url: str = "url", position: str = "input_pos") -> DataFrame:
    """Keep the first repository per path, then per URL; repositories without URL are all kept."""
    by_path = first_row(repos, [path], [F.col(position)])
    # A missing URL is replaced by the path, so that those rows neither meet nor pile up in one task.
    keyed = by_path.withColumn("_url", F.coalesce(F.col(url), F.concat(F.lit("\x00"), F.col(path))))
    return first_row(keyed, ["_url"], [F.col(position)]).drop("_url")


def repos_with_history(chain: DataFrame, repo: str = "repo", minimum: int = K.MIN_REPO_COMMITS) -> DataFrame:
    """Repositories whose default branch has at least ``minimum`` first-parent commits."""
    return chain.groupBy(repo).agg(F.count(F.lit(1)).alias("n_commits")).where(F.col("n_commits") >= minimum)


# -- files -------------------------------------------------------------------------------------------------------


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.try_element_at(table, key)


def detect_languages(files: Column | str) -> Column:
    """Sorted distinct languages of a file list, from extensions and well-known names."""

    def of_file(path):
        return F.array(_lookup(K.EXTENSION_LANGUAGE, F.lower(suffix(path))),
                       _lookup(K.FILE_NAME_LANGUAGE, F.lower(base_name(path))))

    return F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.transform(as_col(files), of_file)))))


def languages_by(files: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Languages per key of a long file table.  What is collected are languages, of which there are a few dozen, so a
    key with any number of files stays small."""
    spoken = files.select(*keys, F.explode_outer(detect_languages(F.array(path))).alias("_language"))
    return spoken.groupBy(*keys).agg(F.sort_array(F.collect_set("_language")).alias("languages"))


def gitignore_rules(tree_files: DataFrame, keys: list[str], path: str = "path", content: str = "content") -> DataFrame:
    """Ignore rules of every .gitignore in a tree, one row each, prefixed with the file's directory."""
    lines = (
        tree_files.where(base_name(path) == ".gitignore")
        .select(*keys, F.col(path), F.posexplode(split_lines(content)).alias("line_no", "_line"))
        .withColumn("_rule", strip("_line"))
        .where((F.col("_rule") != "") & ~F.col("_rule").startswith("#"))
    )
    folder = parent_dir(path)
    rule = F.when(folder == "", F.col("_rule")).otherwise(F.concat(folder, F.lit("/"), F.col("_rule")))
    return lines.select(*keys, F.col(path).alias("gitignore_path"), "line_no", rule.alias("pattern"))


def changed_files_of_diff(diff: Column | str) -> Column:
    """Paths of the net diff, in diff order."""
    return F.regexp_extract_all(as_col(diff), F.lit("(?md)^diff --git a/.* b/(.*)$"), 1)


def has_binary_entry(numstat: Column | str) -> Column:
    """True if a numstat listing counts '-' lines for some file."""
    return strip(numstat).rlike(f"(?:^|{LINE_BREAK})-\\t-\\t")


def gate_reason(n_files: Column, has_binary: Column, n_chars: Column, max_files: int = K.MAX_FILES,
                max_chars: int = K.MAX_DIFF_CHARS) -> Column:
    """Why a range is rejected, NULL if it passes.  Needs sizes only, so the diff text itself can be joined later."""
    return (
        F.when(F.coalesce(n_files, F.lit(0)) == 0, "no_files")
        .when(n_files > max_files, "too_many_files")
        .when(has_binary, "binary")
        .when(F.coalesce(n_chars, F.lit(0)) == 0, "empty_diff")
        .when(n_chars > max_chars, "diff_too_large")
    )


# Blocks of one repository's candidates in a draw: 16 ** 2.
REPO_DIGITS = 2

# -- commits -----------------------------------------------------------------------------------------------------


def is_merge(parents: Column | str) -> Column:
    return F.size(as_col(parents)) > 1


def commit_pool(commits: DataFrame, repo: str = "repo", position: str = "topo_pos",
                cap: int = K.COMMIT_POOL_CAP) -> DataFrame:
    """Newest commits per repository over all branches."""
    return first_rows(commits, [repo], position_block(position), [F.col(position)], cap, "_n").drop("_n")


def _walked(cap: int):
    """Arrow task of ``first_parent_chain``: rows come by (repo, block), the commits of a block before the walks that enter it."""
    most = 1 << 17

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks have few walks as a rule, so what they give is handed on together.
        found: list[pa.RecordBatch] = []
        for part in parts(batches):
            found.append(part)
            if sum(p.num_rows for p in found) >= most:
                yield from pa.Table.from_batches(found).combine_chunks().to_batches()
                found = []
        if found:
            yield from pa.Table.from_batches(found).combine_chunks().to_batches()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, commits, index = None, [], None
        for batch in batches:
            first = 0
            sorted_by = zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
            for (*block, walks), group in groupby(sorted_by):
                end = first + sum(1 for _ in group)
                if block != here:
                    here, commits, index = block, [], None
                if not walks:
                    commits.append([batch.column(c).slice(first, end - first) for c in (3, 4, 5)])
                elif commits:
                    index = index or _block_index(commits)
                    yield from walk(*index, batch.slice(first, end - first))
                first = end

    def walk(place: dict, shas: pa.Array, ups: pa.Array, up: np.ndarray, up_block: np.ndarray, entering: pa.RecordBatch):
        who = np.arange(entering.num_rows)
        at = np.array([place[s] for s in entering.column(3).to_pylist()])
        pos = entering.column(7).to_numpy()
        seen: list[tuple] = []
        left: list[tuple] = []
        held = 0
        while len(at):
            seen.append((who, at, pos))
            held += len(at)
            after = pos + 1
            inside, leaving = (after < cap) & (up[at] >= 0), (after < cap) & (up[at] < 0) & (up_block[at] >= 0)
            if leaving.any():
                left.append((who[leaving], at[leaving], after[leaving]))
            who, at, pos = who[inside], up[at[inside]], after[inside]
            if held >= most:
                yield rows(seen, shas, None, entering)
                seen, held = [], 0
        if seen:
            yield rows(seen, shas, None, entering)
        if left:
            yield rows(left, ups, up_block, entering)

    def rows(steps: list[tuple], names: pa.Array, blocks: np.ndarray | None, entering: pa.RecordBatch) -> pa.RecordBatch:
        who, at, pos = (np.concatenate(x) for x in zip(*steps, strict=True))
        next_block = pa.nulls(len(at), pa.int64()) if blocks is None else pa.array(blocks[at], pa.int64())
        return pa.RecordBatch.from_arrays(
            [entering.column(0).take(pa.array(who)), entering.column(6).take(pa.array(who)), names.take(pa.array(at)),
             pa.array(pos, pa.int32()), next_block], names=["repo", "head", "sha", "pos", "next_block"])

    return run


def _block_index(commits: list) -> tuple:
    shas, ups, up_block = (pa.concat_arrays([part[c] for part in commits]) for c in range(3))
    names = shas.to_pylist()
    place = {s: i for i, s in enumerate(names)}
    up = np.array([-1 if u is None else place.get(u, -1) for u in ups.to_pylist()])
    return place, shas, ups, up, up_block.fill_null(-1).to_numpy()


def first_parent_chain(commits: DataFrame, heads: DataFrame, repo: str = "repo", sha: str = "sha",
                       first_parent: str = "parent1", cap: int = K.FIRST_PARENT_CAP, position: str = "topo_pos",
                       block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Walk first parents from each head: (repo, head, sha, pos), at most ``cap`` commits per head.

    The commits of a repository are cut into blocks of their topological position (an integer), in which parents follow
    children closely.  A walk goes on within its block without any join, all walks of a block together; only a walk that
    leaves for an older block is handed on to the next round.  So there are as many rounds as blocks that the longest walk
    crosses, and only blocks that a walk enters are read.  A walk ends at a commit whose parent isn't stored.
    """
    placed = commits.select(F.col(repo).alias("repo"), F.col(sha).alias("sha"), F.col(first_parent).alias("up"),
                            position_block(position, block_rows).alias("block"))
    homes = placed.select(F.col("repo").alias("_repo"), F.col("sha").alias("_sha"), F.col("block").alias("up_block"))
    graph = durable(placed.join(homes, (F.col("repo") == F.col("_repo")) & (F.col("up") == F.col("_sha")), "left").select(
        "repo", "block", "sha", "up", "up_block"))
    starts = heads.select(F.col(repo).alias("repo"), F.col("head"), F.col("head").alias("sha"))
    entering = starts.join(graph, ["repo", "sha"]).select("repo", "block", "head", "sha", F.lit(0).alias("pos"))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    kind = commits.schema[repo].dataType.simpleString()
    found = []
    while True:
        blocks = entering.select("repo", "block").distinct()
        rows = graph.join(blocks, ["repo", "block"], "left_semi").select(
            "repo", "block", F.lit(False).alias("walks"), "sha", "up", "up_block", text.alias("head"), F.lit(None).cast("int").alias("pos"),
        ).unionByName(entering.select("repo", "block", F.lit(True).alias("walks"), "sha", text.alias("up"), number.alias("up_block"),
                                      "head", "pos"))
        steps = durable(rows.repartition("repo", "block").sortWithinPartitions("repo", "block", "walks").mapInArrow(
            _walked(cap), f"repo {kind}, head string, sha string, pos int, next_block bigint"))
        found.append(steps.where("next_block IS NULL").select(F.col("repo").alias(repo), "head", F.col("sha").alias(sha), "pos"))
        entering = steps.where("next_block IS NOT NULL").withColumnRenamed("next_block", "block")
        if entering.isEmpty():
            return reduce(DataFrame.unionByName, found)


def chain_of_length(chain: DataFrame, length: int) -> DataFrame:
    """Heads that have a full chain of ``length`` commits, with the sha at its end."""
    return chain.where(F.col("pos") == length - 1).select("repo", "head", F.col("sha").alias("last_sha"))


def default_branch_ranges(chain: DataFrame, min_commits: int = 1, max_commits: int = 8, seed: int = 42) -> DataFrame:
    """All (head, n) candidates on default-branch chains, ranked later by their hash.

    The base lies n steps below the head, found by ``lead`` over a chain of at most 500 rows per repository.
    """
    window = Window.partitionBy("repo").orderBy("pos")
    bases = F.array(*[
        F.struct(F.lit(n).alias("n_commits"), F.lead("sha", n).over(window).alias("base_commit"))
        for n in range(min_commits, max_commits + 1)
    ])
    ranges = chain.select("repo", "pos", F.col("sha").alias("head_commit"), bases.alias("_bases")).select(
        "repo", F.col("pos").alias("head_pos"), "head_commit", F.inline("_bases")).where("base_commit IS NOT NULL")
    return _with_draw(ranges, seed)


def any_branch_ranges(commits: DataFrame, min_commits: int = 1, max_commits: int = 8, seed: int = 42) -> DataFrame:
    """All (head, n) candidates whose head may be any pooled commit."""
    heads = commit_pool(commits).select("repo", F.col("sha").alias("head"))
    chain = first_parent_chain(commits, heads, cap=max_commits + 1)
    ranges = chain.where(F.col("pos").between(min_commits, max_commits)).select(
        "repo", F.col("head").alias("head_commit"), F.col("pos").alias("n_commits"), F.col("sha").alias("base_commit"))
    return _with_draw(ranges, seed)


def _with_draw(ranges: DataFrame, seed: int) -> DataFrame:
    return ranges.withColumn("draw", seeded_hash(seed, "repo", "head_commit", "n_commits"))


def balanced_draw(candidates: DataFrame, count: int, repo: str = "repo", draw: str = "draw",
                  max_per_repo: int | None = None) -> DataFrame:
    """Up to ``count`` candidates; every repository gives its first pick before any gives a second.

    ``pick`` is the rank within the repository.  Nothing is sorted globally: rows are counted per pick, whole levels
    are taken while they fit, and only the level in which the count runs out is ranked by hash, block by block.
    """
    limit = count if max_per_repo is None else min(count, max_per_repo)
    # Each map task hands on its first rows of a block, and each block its first rows, so a repository's last ranking is
    # over a fixed number of rows.
    def first(rows, keys):
        ranked = rows.withColumn("pick", F.row_number().over(Window.partitionBy(*keys).orderBy(draw)))
        return ranked.where(F.col("pick") <= limit)

    blocked = first(candidates.withColumn("_block", hash_block(draw, REPO_DIGITS)), [repo, "_block"]).drop("_block")
    picked = durable(first(blocked, [repo]).withColumn("pick", F.col("pick").cast("bigint")))
    # At most ``limit`` rows, whatever the number of candidates.
    levels = picked.groupBy("pick").agg(F.count(F.lit(1)).alias("_rows")).withColumn(
        "_start", F.coalesce(F.sum("_rows").over(Window.orderBy("pick").rowsBetween(Window.unboundedPreceding, -1)),
                              F.lit(0)))
    levelled = picked.join(levels.where(F.col("_start") < count), "pick")
    fits = F.col("_start") + F.col("_rows") <= count
    last = numbered(levelled.where(~fits), [], hash_block(draw), [F.col(draw)], "_place")
    chosen = last.where(F.col("_start") + F.col("_place") <= count).drop("_place")
    return levelled.where(fits).unionByName(chosen).drop("_start", "_rows")


def original_commits(ranges: DataFrame, chain: DataFrame, commits: DataFrame, commit_files: DataFrame,
                     most: int | None = None) -> DataFrame:
    """Non-merge commits of each range, newest first, with subject and files.  Ranges of merges only are dropped.

    Every commit of the chain is described once; the entries of a head are what follows it on the chain, a frame of at most
    ``most`` positions (by default as many as the longest range has), and shorter ranges are its beginnings.  The ranges are
    brought to their heads before, so lists of entries are formed where they are used and never shuffled.
    """
    if most is None:
        most = ranges.agg(F.max("n_commits")).first()[0] or 1
    lengths = ranges.groupBy("repo", F.col("head_pos").alias("pos"), "head_commit").agg(F.collect_set("n_commits").alias("n_commits"))
    wanted = lengths.groupBy("repo", "pos").agg(F.collect_list(F.struct("head_commit", "n_commits")).alias("_wanted"))
    on_chain = chain.select("repo", "pos", "sha")
    plain = commits.where(~F.col("is_merge")).select("repo", "sha", "subject", F.lit(True).alias("_plain"))
    # One row per commit is kept of the files, so that what was shuffled for them is off the disks before lists are formed.
    files = durable(commit_files.join(on_chain, ["repo", "sha"], "left_semi").groupBy("repo", "sha").agg(
        F.sort_array(F.collect_list("path")).alias("files")))
    entry = F.struct("pos", "sha", "subject", F.coalesce("files", F.array().cast("array<string>")).alias("files"))
    described = on_chain.join(wanted, ["repo", "pos"], "left").join(plain, ["repo", "sha"], "left").join(files, ["repo", "sha"], "left")
    ahead = Window.partitionBy("repo").orderBy("pos").rangeBetween(0, most - 1)
    lists = described.select("repo", "pos", "_wanted", F.collect_list(F.when(F.col("_plain"), entry)).over(ahead).alias("_entries"))
    heads = lists.where("_wanted IS NOT NULL").select("repo", "pos", "_entries", F.inline("_wanted").alias("head_commit", "_lengths"))
    inside = F.filter("_entries", lambda e: e["pos"] < F.col("pos") + F.col("n_commits"))
    listed = heads.select("repo", "pos", "_entries", "head_commit", F.explode("_lengths").alias("n_commits")).withColumn(
        "_entries", inside).where(F.size("_entries") > 0)
    return listed.select("repo", "head_commit", "n_commits", F.transform("_entries", lambda e: F.struct(
        e["sha"].alias("sha"), e["subject"].alias("subject"), e["files"].alias("files"))).alias("original_commits"))


def assemble_examples(ranges: DataFrame, diffs: DataFrame, originals: DataFrame, ignores: DataFrame,
                      repos: DataFrame, max_files: int = K.MAX_FILES, max_chars: int = K.MAX_DIFF_CHARS,
                      texts: DataFrame | None = None) -> DataFrame:
    """Example records.  Gates run on narrow columns; the diff text is joined for survivors only.

    Where many ranges share a diff, ``diffs`` holds a ``diff_id`` instead, and ``texts`` (diff_id, diff) each diff once: it is
    measured once and moved once, however many records it goes into.  All that is narrow comes together first and is kept, and
    what was shuffled for it goes; lists of commits are moved twice then, to their records and with these to the texts.
    """
    key = ["repo", "base_commit", "head_commit"]
    measures = [F.length("diff").alias("_n_chars"), changed_files_of_diff("diff").alias("changed_files")]
    if texts is None:
        measured, shown = diffs.select(*key, "has_binary", *measures), diffs.select(*key, "diff")
    else:
        measured = diffs.select(*key, "diff_id", "has_binary").join(texts.select("diff_id", *measures), "diff_id").drop("diff_id")
        shown = diffs.select(*key, "diff_id")
    passed = ranges.select(*key, "n_commits").join(measured, key).where(
        gate_reason(F.size("changed_files"), F.col("has_binary"), F.col("_n_chars"), max_files, max_chars).isNull()).select(
        *key, "n_commits", "changed_files")
    if texts is not None:
        passed = passed.join(shown, key)
    placed = passed.join(ignores.withColumnRenamed("sha", "base_commit"), ["repo", "base_commit"], "left").join(repos, "repo", "left")
    described = durable(placed).join(originals, ["repo", "head_commit", "n_commits"])
    described = described.join(shown, key) if texts is None else described.join(
        texts.where(~F.coalesce(F.length("diff") > max_chars, F.lit(False))).select("diff_id", "diff"), "diff_id")
    return described.select(
        F.coalesce("remote_url", F.col("repo").cast("string")).alias("repo_url"), "branch", "base_commit",
        "head_commit", F.col("n_commits").cast("int").alias("n_commits"), "diff", "changed_files",
        "original_commits",
        F.coalesce("existing_gitignore", F.array().cast("array<string>")).alias("existing_gitignore"),
        detect_languages("changed_files").alias("languages"))


def gitignore_arrays(rules: DataFrame) -> DataFrame:
    """Rules of each tree as one ordered array."""
    entry = F.struct("gitignore_path", "line_no", "pattern")
    return rules.groupBy("repo", "sha").agg(F.sort_array(F.collect_list(entry)).alias("_rules")).select(
        "repo", "sha", F.col("_rules.pattern").alias("existing_gitignore"))


def gitignore_patterns(path: Column | str, content: Column | str) -> Column:
    """Rules of one .gitignore file as an array, prefixed with the file's directory."""
    folder = parent_dir(path)
    rules = F.filter(F.transform(split_lines(content), strip), lambda r: (r != "") & ~r.startswith("#"))
    return F.when(folder == "", rules).otherwise(F.transform(rules, lambda r: F.concat(folder, F.lit("/"), r)))


def ignore_rules_at(bases: DataFrame, versions: DataFrame, chain: DataFrame, repo: str = "repo", bucket: int = 64) -> DataFrame:
    """(repo, sha, existing_gitignore): the ignore rules in force at base commits.

    An as-of join along the first-parent chain.  ``versions`` (repo, sha, path, content) tells for each commit which .gitignore
    files it left changed, NULL for a removed one; ``chain`` (repo, sha, pos) counts from the newest commit.  A version is in
    force from its own commit up to the one before the next version of that path, an interval of positions.  ``bases`` (repo, sha,
    pos) look up the intervals that hold their position, by bucket, so that only what is in force is formed; rules are
    parsed once per version.  Files go by path, rules by line.  A base without rules has no row.
    """
    placed = versions.where(base_name("path") == ".gitignore").join(chain.select(repo, "sha", "pos"), [repo, "sha"]).select(
        repo, "path", "pos", F.when(F.col("content").isNotNull(), gitignore_patterns("path", "content")).alias("rules"))
    newer = F.lag("pos").over(Window.partitionBy(repo, "path").orderBy("pos"))
    spans = placed.withColumn("_from", F.coalesce(newer + 1, F.lit(0))).where("rules IS NOT NULL").select(
        repo, "path", "rules", "_from", F.col("pos").alias("_to"))
    bucketed = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_from") / bucket), F.floor(F.col("_to") / bucket))))
    asked = bases.select(repo, "sha", "pos").distinct().withColumn("_bucket", F.floor(F.col("pos") / bucket))
    held = asked.join(bucketed, [repo, "_bucket"]).where(F.col("pos").between(F.col("_from"), F.col("_to")))
    return held.groupBy(repo, "sha").agg(F.sort_array(F.collect_list(F.struct("path", "rules"))).alias("_files")).select(
        repo, "sha", F.flatten("_files.rules").alias("existing_gitignore"))


# -- statistics --------------------------------------------------------------------------------------------------


def dataset_totals(examples: DataFrame, line_chars: Column) -> DataFrame:
    return examples.agg(
        F.count(F.lit(1)).alias("n_examples"), F.count_distinct("repo_url").alias("n_repos"),
        F.floor(F.sum(line_chars) / F.count(F.lit(1))).cast("bigint").alias("avg_line_chars"),
        F.min("n_commits").cast("bigint").alias("min_commits"), F.max("n_commits").cast("bigint").alias("max_commits"),
        F.avg("n_commits").alias("avg_commits"))


def language_frequency(examples: DataFrame, languages: str = "languages") -> DataFrame:
    return examples.select(F.explode(languages).alias("language")).groupBy("language").agg(
        F.count(F.lit(1)).alias("n_examples"))


def top_repos(examples: DataFrame, n: int = 15) -> DataFrame:
    return examples.groupBy("repo_url").agg(F.count(F.lit(1)).alias("n_examples")).orderBy(
        F.desc("n_examples"), "repo_url").limit(n)


def repo_profile(commits: DataFrame, files: DataFrame, branches: DataFrame, repo: str = "repo") -> DataFrame:
    """Per repository: commits, branch, languages of its files.  Files are reduced to languages before the shuffle."""
    counted = commits.groupBy(repo).agg(F.count(F.lit(1)).alias("n_commits"))
    spoken = languages_by(files, [repo]).withColumn("languages", F.nullif(F.array_join("languages", ", "), F.lit("")))
    return (
        counted.join(branches, repo, "left").join(spoken, repo, "left")
        .select(repo, "n_commits", F.coalesce("branch", F.lit("?")).alias("branch"),
                F.coalesce("languages", F.lit("-")).alias("languages"))
    )
