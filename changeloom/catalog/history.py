"""Harvest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.catalog.registry import Tables, query
from changeloom.functions import constants as K
from changeloom.operators import history as H
from changeloom.session import durable


def _values(mapping):
    return ", ".join(f"('{k}', '{v}')" for k, v in mapping.items())


# The oracle derives languages by joining lookup tables, the operator by a per-row expression.
LANGUAGE_CTES = f"""
    ext(e, lang) AS (VALUES {_values(K.EXTENSION_LANGUAGE)}),
    fname(f, lang) AS (VALUES {_values(K.FILE_NAME_LANGUAGE)}),
    named AS (SELECT *, lower(split_part(path, '/', -1)) AS bn FROM files0),
    langs AS (
        SELECT n.ex_id, e.lang FROM named n JOIN ext e ON regexp_extract(n.bn, '^.+(\\.[^.]+)$', 1) = e.e
        UNION SELECT n.ex_id, f.lang FROM named n JOIN fname f ON n.bn = f.f)"""


@query("h1_normalize_url", oracle=r"""
    SELECT page_id, v, rtrim(regexp_replace(CASE WHEN position(':' IN u) > 0
            AND position('/' IN split_part(u, ':', 1)) = 0
        THEN concat(split_part(u, ':', 1), '/', substr(u, position(':' IN u) + 1)) ELSE u END, '\.git$', ''), '/')
        AS normalized
    FROM (SELECT page_id, v, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url,
              '^https://', ''), '^http://', ''), '^git@', ''), '^ssh://git@', ''), '^ssh://', '') AS u
          FROM (SELECT page_id, 0 AS v, url FROM pages
                UNION ALL SELECT page_id, 1, concat(regexp_replace(url, '^https?://([^/]*)/', 'git@\1:'), '.git')
                    FROM pages
                UNION ALL SELECT page_id, 2, concat(regexp_replace(url, '^https?://', 'ssh://git@'), '.git/')
                    FROM pages) t) s""")
def normalize_url(t):
    pages = t.pages.select("page_id", F.explode(F.array(
        F.struct(F.lit(0).alias("v"), F.col("url").alias("url")),
        F.struct(F.lit(1).alias("v"),
                 F.concat(F.regexp_replace("url", "^https?://([^/]*)/", "git@$1:"), F.lit(".git")).alias("url")),
        F.struct(F.lit(2).alias("v"),
                 F.concat(F.regexp_replace("url", "^https?://", "ssh://git@"), F.lit(".git/")).alias("url")),
    )).alias("r"))
    return pages.select("page_id", "r.v", H.normalize_url("r.url").alias("normalized"))


@query("h2_priority_pick", oracle="""
    WITH remotes AS (
        SELECT o_custkey AS repo, o_orderkey AS pos, CASE o_orderkey % 11 WHEN 3 THEN 'origin' WHEN 5 THEN 'upstream'
            ELSE concat('fork', CAST(o_orderkey % 11 AS STRING)) END AS name,
            CASE o_orderkey % 13 WHEN 0 THEN 'HEAD' WHEN 1 THEN 'develop' WHEN 2 THEN 'main' WHEN 3 THEN 'stable'
            ELSE concat('topic', CAST(o_orderkey % 13 AS STRING)) END AS branch_name FROM orders),
    r AS (SELECT repo, pos, row_number() OVER (PARTITION BY repo ORDER BY CASE name WHEN 'origin' THEN 1
              WHEN 'upstream' THEN 2 ELSE 3 END, pos) AS k FROM remotes),
    b AS (SELECT repo, branch_name, row_number() OVER (PARTITION BY repo ORDER BY CASE branch_name WHEN 'HEAD' THEN 1
              WHEN 'main' THEN 2 WHEN 'develop' THEN 5 WHEN 'stable' THEN 6 ELSE 9 END) AS k FROM remotes)
    SELECT r.repo, concat('u', CAST(r.pos AS STRING)) AS remote_url,
        CASE WHEN b.branch_name NOT LIKE 'topic%' THEN b.branch_name END AS branch
    FROM r JOIN b ON r.repo = b.repo AND r.k = 1 AND b.k = 1""")
def priority_pick(t):
    remotes = t.sql("""
        SELECT o_custkey AS repo, o_orderkey AS pos, concat('u', o_orderkey) AS url,
            CASE o_orderkey % 11 WHEN 3 THEN 'origin' WHEN 5 THEN 'upstream' ELSE concat('fork', o_orderkey % 11) END
                AS name,
            CASE o_orderkey % 13 WHEN 0 THEN 'HEAD' WHEN 1 THEN 'develop' WHEN 2 THEN 'main' WHEN 3 THEN 'stable'
                ELSE concat('topic', o_orderkey % 13) END AS branch_name
        FROM {orders}""")
    return H.pick_remote(remotes, ["repo"]).join(H.pick_branch(remotes, ["repo"], "branch_name"), "repo")


@query("h3_repo_dedup", oracle="""
    WITH repos AS (
        SELECT o_orderkey AS input_pos, concat('/r/', CAST(o_custkey AS STRING), '/', CAST(o_orderkey % 3 AS STRING))
            AS path, CASE WHEN o_custkey % 4 > 0 THEN concat('host/', CAST(o_custkey % 500 AS STRING)) END AS url
        FROM orders),
    p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY input_pos) AS k FROM repos) x
          WHERE k = 1)
    SELECT input_pos, path, url FROM p WHERE url IS NULL
    UNION ALL SELECT input_pos, path, url FROM (
        SELECT *, row_number() OVER (PARTITION BY url ORDER BY input_pos) AS j FROM p WHERE url IS NOT NULL) y
    WHERE j = 1""")
def repo_dedup(t):
    return H.dedup_repos(t.sql("""
        SELECT o_orderkey AS input_pos, concat('/r/', o_custkey, '/', o_orderkey % 3) AS path,
            CASE WHEN o_custkey % 4 > 0 THEN concat('host/', o_custkey % 500) END AS url
        FROM {orders}"""))


def _heads(t):
    return t.heads.withColumnRenamed("sha", "head")


def _chain(t):
    return H.first_parent_chain(t.history, _heads(t)).select("repo", "sha", "pos")


CHAIN_CTE = """chain AS (
        SELECT h.repo, h.sha AS head, h.sha, h.parent1, 0 AS pos FROM history h JOIN heads d ON h.sha = d.sha
        UNION ALL SELECT h.repo, c.head, h.sha, h.parent1, c.pos + 1 FROM chain c
        JOIN history h ON h.repo = c.repo AND h.sha = c.parent1 WHERE c.pos < 499)"""


@query("h4_min_history", oracle=f"""
    WITH RECURSIVE {CHAIN_CTE}
    SELECT repo, count(*) AS n_commits FROM chain, (SELECT 1 FROM {{heads}} LIMIT 1) one
    GROUP BY repo HAVING count(*) >= 10""")
def min_history(t):
    return H.repos_with_history(_chain(t))


@query("h5_detect_languages", oracle=f"""
    WITH files0 AS (SELECT * FROM {{ex_files}}), {LANGUAGE_CTES}
    SELECT f.ex_id, coalesce(string_agg(DISTINCT l.lang, ',' ORDER BY l.lang), '') AS languages
    FROM (SELECT DISTINCT ex_id FROM files0) f LEFT JOIN langs l ON f.ex_id = l.ex_id GROUP BY f.ex_id""")
def detect_languages(t):
    return H.languages_by(t.ex_files, ["ex_id"]).withColumn("languages", F.array_join("languages", ","))


@query("h6_mine_gitignore", oracle="""
    WITH trees AS (
        SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '.gitignore' WHEN 1 THEN 'sub/dir/.gitignore' ELSE 'a.gitignore' END
            AS path, regexp_replace(replace(replace(text, '. ', chr(10)), chr(10), concat(chr(10), ' ')), ' [a]', ' #',
            'g') AS content FROM documents),
    parts AS (SELECT doc_id, path, unnest(string_split(content, chr(10))) AS line,
                  generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no FROM trees WHERE doc_id % 3 < 2)
    SELECT doc_id AS repo, path AS gitignore_path, CAST(line_no AS BIGINT) AS line_no,
        concat(CASE WHEN path = '.gitignore' THEN '' ELSE 'sub/dir/' END, trim(line)) AS pattern
    FROM parts WHERE trim(line) <> '' AND trim(line) NOT LIKE '#%'""")
def mine_gitignore(t):
    trees = t.sql("""
        SELECT doc_id AS repo, CASE doc_id % 3 WHEN 0 THEN '.gitignore' WHEN 1 THEN 'sub/dir/.gitignore'
            ELSE 'a.gitignore' END AS path, regexp_replace(replace(replace(text, '. ', chr(10)), chr(10),
            concat(chr(10), ' ')), ' [a]', ' #') AS content FROM {documents}""")
    return H.gitignore_rules(trees, ["repo"]).withColumn("line_no", F.col("line_no").cast("bigint"))


def _commits(t):
    parents = F.array_compact(F.array("parent1", "parent2"))
    return t.history.withColumn("is_merge", H.is_merge(parents))


@query("h7_merge_flag", oracle="""
    SELECT is_merge, count(*) AS n FROM (
        SELECT parent1 IS NOT NULL AND parent2 IS NOT NULL AS is_merge FROM {history}) x GROUP BY is_merge""")
def merge_flag(t):
    return _commits(t).groupBy("is_merge").agg(F.count(F.lit(1)).alias("n"))


@query("h8_first_parent_chain", oracle=f"""
    WITH RECURSIVE {CHAIN_CTE}
    SELECT repo, sha, CAST(pos AS BIGINT) AS pos FROM chain, (SELECT 1 FROM {{heads}} LIMIT 1) one""")
def first_parent_chain(t):
    return _chain(t).withColumn("pos", F.col("pos").cast("bigint"))


@query("h8_chain_of_length", oracle=f"""
    WITH RECURSIVE {CHAIN_CTE}
    SELECT repo, head, sha AS last_sha FROM chain, (SELECT 1 FROM {{heads}} LIMIT 1) one WHERE pos = 4""")
def chain_of_length(t):
    return H.chain_of_length(H.first_parent_chain(t.history, _heads(t), cap=5), 5)


@query("h9_commit_pool", oracle="""
    SELECT repo, sha, topo_pos FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY topo_pos) AS k
        FROM {history}) h WHERE k <= 4500""")
def commit_pool(t):
    # Repository 0 of the test tables is larger than this cap.
    return H.commit_pool(t.history, cap=4500).select("repo", "sha", "topo_pos")


RANGE_CTES = f"""{CHAIN_CTE},
    ranges AS (
        SELECT a.repo, a.pos AS head_pos, a.sha AS head_commit, CAST(b.pos - a.pos AS BIGINT) AS n_commits,
            b.sha AS base_commit, md5(concat('42:', CAST(a.repo AS STRING), ':', a.sha, ':',
            CAST(b.pos - a.pos AS STRING))) AS draw
        FROM chain a JOIN chain b ON a.repo = b.repo AND b.pos - a.pos BETWEEN 1 AND 8)"""


@query("h10_default_branch_ranges", oracle=f"""
    WITH RECURSIVE {RANGE_CTES}
    SELECT repo, head_commit, n_commits, base_commit, draw FROM ranges, (SELECT 1 FROM {{heads}} LIMIT 1) one""")
def default_branch_ranges(t):
    return H.default_branch_ranges(_chain(t)).select(
        "repo", "head_commit", F.col("n_commits").cast("bigint").alias("n_commits"), "base_commit", "draw")


@query("h10_any_branch_ranges", oracle="""
    WITH RECURSIVE walk AS (
        SELECT repo, sha AS head_commit, parent1 AS base_commit, 1 AS n_commits FROM history
            WHERE parent1 IS NOT NULL
        UNION ALL SELECT w.repo, w.head_commit, h.parent1, w.n_commits + 1 FROM walk w
        JOIN history h ON h.repo = w.repo AND h.sha = w.base_commit WHERE w.n_commits < 8 AND h.parent1 IS NOT NULL)
    SELECT repo, head_commit, base_commit, CAST(n_commits AS BIGINT) AS n_commits,
        md5(concat('42:', CAST(repo AS STRING), ':', head_commit, ':', CAST(n_commits AS STRING))) AS draw
    FROM walk, (SELECT 1 FROM {heads} LIMIT 1) one""")
def any_branch_ranges(t):
    return H.any_branch_ranges(t.history).withColumn("n_commits", F.col("n_commits").cast("bigint"))


@query("h11_quality_gates", oracle="""
    WITH f AS (SELECT ex_id, count(*) AS n_files FROM {ex_files} GROUP BY ex_id),
    g AS (SELECT CASE WHEN coalesce(n_files, 0) = 0 THEN 'no_files' WHEN n_files > 6 THEN 'too_many_files'
            WHEN toxic = 1 THEN 'binary' WHEN coalesce(length(diff), 0) = 0 THEN 'empty_diff'
            WHEN length(diff) > 3000 THEN 'diff_too_large' ELSE 'passed' END AS gate
          FROM {examples} e LEFT JOIN f ON e.ex_id = f.ex_id)
    SELECT gate, count(*) AS n FROM g GROUP BY gate""")
def quality_gates(t):
    counts = t.ex_files.groupBy("ex_id").agg(F.count(F.lit(1)).alias("n_files"))
    reason = H.gate_reason(F.col("n_files"), F.col("toxic") == 1, F.length("diff"), max_files=6, max_chars=3000)
    return (t.examples.join(counts, "ex_id", "left").select(F.coalesce(reason, F.lit("passed")).alias("gate"))
            .groupBy("gate").agg(F.count(F.lit(1)).alias("n")))


@query("h12_binary_flag", oracle="""
    SELECT ex_id, ex_id % 3 = 0 OR ex_id % 5 = 0 AS has_binary FROM {file_diffs}""")
def binary_flag(t):
    listing = t.sql("""
        SELECT ex_id, concat(CASE WHEN ex_id % 3 = 0 THEN concat('-', chr(9), '-', chr(9), 'x.png') ELSE
            concat('1', chr(9), '-', chr(9), '-') END, chr(10), '3', chr(9), '1', chr(9), path, chr(10),
            CASE WHEN ex_id % 5 = 0 THEN concat('-', chr(9), '-', chr(9), path, chr(10)) ELSE '' END) AS numstat
        FROM {file_diffs}""")
    return listing.select("ex_id", H.has_binary_entry("numstat").alias("has_binary"))


def _on_chain(t, chain):
    """The tables, with the commits of a chain alone in ``history`` and in the views of it.

    The operators leave out other commits, too, but each only after it has shuffled them; here they go once.
    """
    narrow = Tables(t.spark, t.directory)
    commits = t.history.select("repo", "oid", "sha", "parent1", "parent2", "subject")
    narrow._cache["history"] = durable(commits.join(chain.select("repo", "sha"), ["repo", "sha"], "left_semi"))
    return narrow


def _commit_texts(commits):
    return F.transform(commits, lambda c: F.concat_ws("|", c["sha"], c["subject"], F.array_join(c["files"], ";")))


@query("h13_original_commits", oracle=f"""
    WITH RECURSIVE {RANGE_CTES},
    first_use AS (SELECT 1 FROM {{heads}} LIMIT 1),
    fl AS (SELECT repo, sha, string_agg(path, ';' ORDER BY path) AS files FROM {{history_files}} GROUP BY repo, sha),
    mem AS (SELECT r.repo, r.head_commit, r.n_commits, c.pos, h.sha, h.subject, coalesce(fl.files, '') AS files
            FROM ranges r JOIN chain c ON c.repo = r.repo AND c.pos BETWEEN r.head_pos AND r.head_pos + r.n_commits - 1
            JOIN history h ON h.repo = c.repo AND h.sha = c.sha AND NOT (h.parent1 IS NOT NULL AND h.parent2 IS NOT NULL)
            LEFT JOIN fl ON fl.repo = h.repo AND fl.sha = h.sha)
    SELECT repo, head_commit, n_commits, count(*) AS n_original,
        string_agg(concat(sha, '|', subject, '|', files), chr(10) ORDER BY pos) AS commits
    FROM mem GROUP BY repo, head_commit, n_commits""")
def original_commits(t):
    chain = _chain(t)
    ranges = H.default_branch_ranges(chain)
    on_chain = _on_chain(t, chain)
    out = H.original_commits(ranges, chain, _commits(on_chain), on_chain.history_files)
    return out.select("repo", "head_commit", F.col("n_commits").cast("bigint").alias("n_commits"),
                      F.size("original_commits").cast("bigint").alias("n_original"),
                      F.array_join(_commit_texts("original_commits"), "\n").alias("commits"))


@query("h14_changed_files", oracle="""
    SELECT ex_id, concat(path, CASE WHEN ex_id % 3 = 0 THEN concat(';docs/new', CAST(ex_id AS STRING), '.txt') ELSE ''
        END) AS changed_files FROM {file_diffs}""")
def changed_files(t):
    return t.range_diffs.select(
        "ex_id", F.array_join(H.changed_files_of_diff("diff"), ";").alias("changed_files"))


@query("h15_balanced_draw", oracle=f"""
    WITH RECURSIVE {RANGE_CTES},
    k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY draw) AS pick
          FROM ranges, (SELECT 1 FROM {{heads}} LIMIT 1) one)
    SELECT repo, head_commit, n_commits, CAST(pick AS BIGINT) AS pick FROM k WHERE pick <= 20
    ORDER BY pick, draw LIMIT 1000""")
def balanced_draw(t):
    ranges = H.default_branch_ranges(_chain(t))
    return H.balanced_draw(ranges, count=1000, max_per_repo=20).select(
        "repo", "head_commit", F.col("n_commits").cast("bigint").alias("n_commits"),
        F.col("pick").cast("bigint").alias("pick"))


@query("h16_example_records", oracle=f"""
    WITH RECURSIVE {CHAIN_CTE},
    picked AS (SELECT a.repo, a.sha AS head_commit, b.sha AS base_commit, a.pos AS head_pos, b.pos AS base_pos,
                   b.pos - a.pos AS n_commits
               FROM chain a JOIN chain b ON a.repo = b.repo AND b.pos - a.pos IN (1, 2)),
    first_use AS (SELECT 1 FROM {{heads}} LIMIT 1),
    d AS (SELECT h.repo, h.sha, e.path, e.diff, x.quality FROM {{history}} h
          JOIN {{file_diffs}} e ON h.oid % (SELECT max(doc_id) + 1 FROM documents) = e.ex_id JOIN {{examples}} x ON x.ex_id = e.ex_id),
    fl AS (SELECT repo, sha, string_agg(path, ';' ORDER BY path) AS files FROM {{history_files}} GROUP BY repo, sha),
    kept AS (SELECT p.repo, p.head_commit, p.n_commits, string_agg(concat(h.sha, '|', h.subject, '|', coalesce(fl.files, '')),
                 chr(10) ORDER BY c.pos) AS commits
             FROM picked p JOIN chain c ON c.repo = p.repo AND c.pos >= p.head_pos AND c.pos < p.base_pos
             JOIN history h ON h.repo = c.repo AND h.sha = c.sha AND NOT (h.parent1 IS NOT NULL AND h.parent2 IS NOT NULL)
             LEFT JOIN fl ON fl.repo = h.repo AND fl.sha = h.sha GROUP BY 1, 2, 3),
    versions AS (SELECT c.repo, c.pos, i.path, i.content FROM {{ignore_versions}} i JOIN chain c ON c.repo = i.repo AND c.sha = i.sha),
    in_force AS (SELECT p.repo, p.base_pos, v.path, v.content, row_number() OVER (
                     PARTITION BY p.repo, p.base_pos, v.path ORDER BY v.pos) AS k
                 FROM (SELECT DISTINCT repo, base_pos FROM picked) p JOIN versions v ON v.repo = p.repo AND v.pos >= p.base_pos),
    lines AS (SELECT repo, base_pos, path, trim(unnest(string_split(content, chr(10)))) AS line,
                  generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM in_force WHERE k = 1 AND content IS NOT NULL),
    rules AS (SELECT repo, base_pos, string_agg(concat(regexp_replace(path, '[^/]*$', ''), line), ';' ORDER BY path, line_no) AS rules
              FROM lines WHERE line <> '' AND line NOT LIKE '#%' GROUP BY repo, base_pos)
    SELECT concat('repo', CAST(p.repo AS STRING)) AS repo_url, 'main' AS branch, p.base_commit, p.head_commit,
        CAST(p.n_commits AS BIGINT) AS n_commits, md5(d.diff) AS diff_md5, d.path AS changed_files, k.commits AS original_commits,
        coalesce(r.rules, '') AS existing_gitignore,
        CASE WHEN d.path LIKE '%.py' THEN 'python' WHEN d.path LIKE '%.js' THEN 'javascript' ELSE 'rust' END
            AS languages
    FROM picked p JOIN kept k ON k.repo = p.repo AND k.head_commit = p.head_commit AND k.n_commits = p.n_commits
    JOIN d ON d.repo = p.repo AND d.sha = p.head_commit LEFT JOIN rules r ON r.repo = p.repo AND r.base_pos = p.base_pos
    WHERE length(d.diff) <= 8000 AND NOT coalesce(d.quality = 0, FALSE)""")
def example_records(t):
    chain = _chain(t)
    ranges = H.default_branch_ranges(chain, max_commits=2)
    # Every commit has the diff of some document.
    size = t.documents.agg(F.max("doc_id") + 1).first()[0]
    on_chain = _on_chain(t, chain)
    by_head = on_chain.sql(f"""
        SELECT h.repo, h.sha AS head_commit, x.ex_id AS diff_id, coalesce(x.quality = 0, false) AS has_binary
        FROM {{history}} h JOIN {{examples}} x ON h.oid % {size} = x.ex_id""")
    texts = t.file_diffs.select(F.col("ex_id").alias("diff_id"), "diff")
    diffs = ranges.select("repo", "base_commit", "head_commit").join(by_head, ["repo", "head_commit"])
    originals = H.original_commits(ranges, chain, _commits(on_chain), on_chain.history_files)
    bases = ranges.select("repo", F.col("base_commit").alias("sha"), (F.col("head_pos") + F.col("n_commits")).alias("pos"))
    ignores = H.ignore_rules_at(bases, on_chain.ignore_versions, chain)
    repos = t.heads.select(
        "repo", F.concat(F.lit("repo"), F.col("repo").cast("string")).alias("remote_url"), F.lit("main").alias("branch"))
    out = H.assemble_examples(ranges, diffs, originals, ignores, repos, max_chars=8000, texts=texts)
    return out.select(
        "repo_url", "branch", "base_commit", "head_commit", F.col("n_commits").cast("bigint").alias("n_commits"),
        F.md5("diff").alias("diff_md5"), F.array_join("changed_files", ";").alias("changed_files"),
        F.array_join(_commit_texts("original_commits"), "\n").alias("original_commits"),
        F.array_join("existing_gitignore", ";").alias("existing_gitignore"), F.array_join("languages", ",").alias("languages"))


@query("h17_dataset_totals", oracle="""
    SELECT count(*) AS n_examples, count(DISTINCT repo_url) AS n_repos,
        CAST(floor(sum(length(diff)) / count(*)) AS BIGINT) AS avg_line_chars, CAST(min(n_commits) AS BIGINT)
        AS min_commits, CAST(max(n_commits) AS BIGINT) AS max_commits, avg(n_commits) AS avg_commits FROM {examples}""")
def dataset_totals(t):
    return H.dataset_totals(t.examples, F.length("diff"))


@query("h17_language_frequency", oracle="""
    SELECT language, count(*) AS n_examples FROM {examples} GROUP BY language""")
def language_frequency(t):
    return H.language_frequency(t.examples.select(F.array("language").alias("languages")))


@query("h17_top_repos", oracle="""
    SELECT repo_url, count(*) AS n_examples FROM {examples} GROUP BY repo_url
    ORDER BY n_examples DESC, repo_url LIMIT 15""")
def top_repos(t):
    return H.top_repos(t.examples)


@query("h18_repo_profile", oracle=f"""
    WITH files0 AS (SELECT repo AS ex_id, path FROM {{history_files}}), {LANGUAGE_CTES},
    c AS (SELECT repo, count(*) AS n_commits FROM {{history}} GROUP BY repo),
    l AS (SELECT ex_id, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS languages FROM langs GROUP BY ex_id)
    SELECT c.repo, c.n_commits, CASE WHEN c.repo % 10 = 0 THEN '?' ELSE 'main' END AS branch,
        coalesce(l.languages, '-') AS languages FROM c LEFT JOIN l ON c.repo = l.ex_id""")
def repo_profile(t):
    branches = t.heads.select(
        "repo", F.when(F.col("repo") % 10 != 0, F.lit("main")).alias("branch"))
    return H.repo_profile(t.history, t.history_files, branches)
