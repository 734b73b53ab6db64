"""Source, sink, profile and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.catalog.registry import query
from changeloom.operators import profiles as R
from changeloom.sources import tables as S
from changeloom.streaming import intake as T


def _jsonl_folder(t):
    path = S.scratch_path(t.spark, "lines")
    line = F.to_json(F.struct("event_id", "event_type", F.array("props").alias("tags")))
    broken = (
        F.when(F.col("event_id") % 10 == 3, "").when(F.col("event_id") % 10 == 4, "   ")
        .when(F.col("event_id") % 10 == 5, F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string")))
        .otherwise(line)
    )
    t.events.select(broken.alias("value")).write.text(path)
    return path


SCHEMA = "event_id bigint, event_type string, tags array<string>"


@query("s1_tolerant_jsonl", oracle="""
    SELECT event_id, event_type, props AS tags, 'good' AS kind FROM events WHERE event_id % 10 NOT IN (3, 4, 5)
    UNION ALL SELECT NULL, concat('{"event_id": ', CAST(event_id AS STRING)), NULL, 'bad' FROM events
    WHERE event_id % 10 = 5""")
def tolerant_jsonl(t):
    good, bad = S.read_jsonl(t.spark, _jsonl_folder(t), SCHEMA)
    shown = good.select("event_id", "event_type", F.array_join("tags", ";").alias("tags"), F.lit("good").alias("kind"))
    return shown.unionByName(bad.select(
        F.lit(None).cast("bigint").alias("event_id"), F.col("line").alias("event_type"),
        F.lit(None).cast("string").alias("tags"), F.lit("bad").alias("kind")))


@query("s2_jsonl_sink", oracle="""
    SELECT event_id, event_type, props AS tags FROM events WHERE event_id % 2 = 0
    UNION ALL SELECT event_id, event_type, props FROM events WHERE event_id % 3 = 0
    UNION ALL SELECT event_id, event_type, props FROM events WHERE event_id % 2 <> 0 AND event_id % 3 <> 0""")
def jsonl_sink(t):
    path = S.scratch_path(t.spark, "sink")
    rows = t.events.select("event_id", "event_type", F.array("props").alias("tags"))
    S.write_jsonl(rows.where("event_id % 5 = 0"), path)
    S.write_jsonl(rows.where("event_id % 2 = 0"), path)
    S.write_jsonl(rows.where("event_id % 3 = 0"), path, append=True)
    S.write_jsonl(rows.where("event_id % 2 <> 0 AND event_id % 3 <> 0"), path, append=True)
    good, _ = S.read_jsonl(t.spark, path, SCHEMA)
    return good.withColumn("tags", F.array_join("tags", ";"))


def exported_history(t):
    """All four tables of an exported history, written and read back: texts of documents are diffs and file contents."""
    root = S.scratch_path(t.spark, "history")
    text = F.col("repo").cast("string").alias("repo")
    t.history.select(text, "sha", F.array_compact(F.array("parent1", "parent2")).alias("parents"), "subject",
                     F.lit("main").alias("branch_head"), F.col("topo_pos").cast("bigint").alias("topo_pos")
                     ).write.parquet(f"{root}/commits")
    t.history_files.select(text, "sha", "path", F.length("path").alias("pos")).write.parquet(f"{root}/commit_files")
    t.examples.select(F.col("repo_url").alias("repo"), "base_commit", "head_commit", "diff", (F.col("ex_id") % 2 == 0).alias("has_binary")
                      ).write.parquet(f"{root}/range_diffs")
    t.examples.select(F.col("repo_url").alias("repo"), F.col("head_commit").alias("sha"), F.concat(
        F.lit("docs/"), F.col("ex_id").cast("string")).alias("path"), F.col("diff").alias("content")).write.parquet(f"{root}/tree_files")
    return S.read_history(t.spark, root)


@query("s3_history_scan", oracle="""
    SELECT CAST(repo AS STRING) AS repo, sha, parent1, parent1 IS NOT NULL AND parent2 IS NOT NULL AS is_merge, subject,
        CAST(topo_pos AS BIGINT) AS topo_pos FROM {history}""")
def history_scan(t):
    return S.history_commits(exported_history(t)["commits"])


@query("s3_commit_files", oracle="""
    SELECT CAST(repo AS STRING) AS repo, sha, path, CAST(length(path) AS INT) AS pos FROM {history_files}""")
def commit_files(t):
    return exported_history(t)["commit_files"]


@query("s3_range_diffs", oracle="""
    SELECT repo_url AS repo, base_commit, head_commit, md5(diff) AS diff_md5, ex_id % 2 = 0 AS has_binary FROM {examples}""")
def range_diffs(t):
    found = exported_history(t)["range_diffs"]
    return found.select("repo", "base_commit", "head_commit", F.md5("diff").alias("diff_md5"), "has_binary")


@query("s3_tree_files", oracle="""
    SELECT repo_url AS repo, head_commit AS sha, concat('docs/', CAST(ex_id AS STRING)) AS path, md5(diff) AS content_md5
    FROM {examples}""")
def tree_files(t):
    return exported_history(t)["tree_files"].select("repo", "sha", "path", F.md5("content").alias("content_md5"))


@query("s4_plan_document", oracle="""
    SELECT hunk_id, file_path, md5(patch) AS patch_md5, is_untracked FROM {hunks}
    WHERE NOT is_untracked OR ex_id % 2 = 1""")
def plan_document(t):
    commits = t.hunks.select("ex_id").distinct().select("ex_id", F.array(F.struct(
        F.lit("fix: x").alias("subject"))).alias("commits"), F.array(F.lit("*.log")).alias("gitignore"))
    path = S.scratch_path(t.spark, "plans")
    S.plan_document(commits, t.hunks, ["ex_id"]).drop("ex_id").write.json(path)
    plans = t.spark.read.schema(S.schemas.PLAN).json(path)
    live = t.hunks.where("ex_id % 2 = 1").drop("ex_id")
    return S.restore_hunks(plans, live, []).select("hunk_id", "file_path", F.md5("patch").alias("patch_md5"),
                                                   "is_untracked")


@query("s4_plan_files", oracle="""
    SELECT CAST(ex_id AS STRING) AS plan, hunk_id, file_path, md5(patch) AS patch_md5 FROM {hunks}
    WHERE NOT is_untracked AND ex_id % 4 <> 3 UNION ALL
    SELECT CAST(ex_id AS STRING), NULL, NULL, 'broken' FROM {hunks} WHERE ex_id % 4 = 3 AND hunk_no = 1""")
def plan_files(t):
    """Indented documents, documents on one line and cut-off ones, one file each, through the reader of plan files."""
    commits = t.hunks.select("ex_id").distinct().select("ex_id", F.array(F.struct(
        F.lit("fix: x").alias("subject"))).alias("commits"), F.array(F.lit("*.log")).alias("gitignore"))
    plans = S.plan_document(commits, t.hunks, ["ex_id"])
    record = F.struct("commits", "gitignore", "hunk_patches")
    indented, flat = F.to_json(record, {"pretty": "true"}), F.to_json(record)
    cut_off = F.concat(F.lit("{\n  "), F.substring(flat, 2, 9))
    text = F.when(F.col("ex_id") % 4 == 3, cut_off).when(F.col("ex_id") % 2 == 0, indented).otherwise(flat)
    path = S.scratch_path(t.spark, "plan-files")
    S.write_files(plans.select(F.col("ex_id").cast("string").alias("name"), text.alias("content")), path)
    good, broken = S.read_plan(t.spark, path)
    name = S.stored_name(F.col("file"))
    live = t.spark.createDataFrame([], f"plan string, {S.schemas.HUNK}")
    restored = S.restore_hunks(good.withColumn("plan", name), live, ["plan"])
    none = F.lit(None).cast("string")
    return restored.select("plan", "hunk_id", "file_path", F.md5("patch").alias("patch_md5")).unionByName(
        broken.select(name.alias("plan"), none.alias("hunk_id"), none.alias("file_path"), F.lit("broken").alias("patch_md5")))


RAW_PAGES = """
    SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat(html, chr(1), 'z') WHEN 1 THEN concat('id,page', chr(10), html) ELSE html END AS html,
        concat('p', CAST(page_id AS STRING), CASE page_id % 5 WHEN 1 THEN '.csv' ELSE '.html' END) AS name FROM pages"""


@query("s5_raw_files", oracle=f"""
    SELECT name, CASE WHEN n > 6000 THEN concat('large: ', CAST(n AS STRING))
        WHEN page_id % 5 = 0 THEN concat('[binary file — ', format('{{:,}}', n), ' bytes, cannot display]')
        WHEN page_id % 5 = 1 AND c > 3000 THEN concat('[structural summary of ', name, ' — ', format('{{:,}}', c),
            ' chars; use query_tool_result to retrieve specifics]', chr(10), 'CSV: 2 columns, ~',
            format('{{:,}}', c - length(replace(raw, chr(10), ''))), ' rows', chr(10), 'Columns: id, page')
        WHEN c > 3000 THEN concat(substr(raw, 1, 3000), chr(10), chr(10), '[truncated — file is ', format('{{:,}}', n),
            ' bytes; showing first 3,000 chars]') ELSE raw END AS shown
    FROM (SELECT *, concat(html, chr(10)) AS raw, strlen(html) + 1 AS n, length(html) + 1 AS c FROM ({RAW_PAGES}) p) q""")
def raw_files(t):
    """Pages written as raw files and read back by the binary reader; of large files only the length is read."""
    path = S.scratch_path(t.spark, "raw-files")
    S.write_files(t.sql(RAW_PAGES.replace("FROM pages", "FROM {pages}").replace("chr(1)", "chr(0)")), path, content="html")
    files = S.read_files(t.spark, path, max_bytes=6000).withColumn("path", S.stored_name(F.col("path")))
    shown = R.readable_content(files, limit=3000)
    return shown.select(F.col("path").alias("name"), F.when(F.col("content").isNull(), F.concat(
        F.lit("large: "), F.col("length").cast("string"))).otherwise(F.col("shown")).alias("shown"))


@query("s5_file_content", oracle="""
    SELECT page_id, CASE WHEN page_id % 5 = 0 THEN concat('[binary file — ', n, ' bytes, cannot display]')
        WHEN page_id % 5 = 1 AND length(html) > 3000 THEN concat('[structural summary of p', CAST(page_id AS STRING),
            '.csv — ', c, ' chars; use query_tool_result to retrieve specifics]', chr(10), 'CSV: 2 columns, ~', l,
            ' rows', chr(10), 'Columns: id, page')
        WHEN length(html) > 3000 THEN concat(substr(html, 1, 3000), chr(10), chr(10), '[truncated — file is ', n,
            ' bytes; showing first 3,000 chars]') ELSE html END AS shown
    FROM (SELECT page_id, html, format('{:,}', strlen(html)) AS n, format('{:,}', length(html)) AS c,
              format('{:,}', length(html) - length(replace(html, chr(10), ''))) AS l
          FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat(html, 'z') WHEN 1 THEN concat('id,page', chr(10), html)
                    ELSE html END AS html FROM pages) p) q""")
def file_content(t):
    files = t.sql("""
        SELECT page_id, concat('p', page_id, CASE page_id % 5 WHEN 1 THEN '.csv' ELSE '.html' END) AS path,
            CASE page_id % 5 WHEN 0 THEN concat(encode(html, 'UTF-8'), X'00') WHEN 1 THEN
            encode(concat('id,page', chr(10), html), 'UTF-8') ELSE encode(html, 'UTF-8') END AS content FROM {pages}""")
    return R.readable_content(files, limit=3000).select("page_id", "shown")


CODE = """
    SELECT event_id, concat('d', event_id, CASE event_id % 6 WHEN 0 THEN '.json' WHEN 1 THEN '.jsonl' WHEN 2 THEN '.csv'
            WHEN 3 THEN '.ts' WHEN 4 THEN '.py' ELSE '.txt' END) AS path, CASE event_id % 6
        WHEN 0 THEN CASE WHEN event_id % 12 = 0 THEN concat('{"z": ', props, ', "a": ', event_id, ', "v": 1.0, "s": "',
            event_type, '", "n": null, "t": [true], "b": false}') ELSE concat('[', props, ',', event_id, ']') END
        WHEN 1 THEN concat(chr(10), props, chr(10), '  ', chr(10), props, chr(10), 'broken')
        WHEN 2 THEN concat('id,"a,b",', event_type, chr(10), '1,2,3', chr(10))
        WHEN 3 THEN concat('import x from "', event_type, '"', chr(10), 'import x from "', event_type, '"', chr(10),
            'export async function run', event_id, '(a) {}', chr(10), 'class K', event_id, ' {}', chr(10),
            'const go = async (x) => x', chr(10), ' const hidden = 1')
        WHEN 4 THEN CASE WHEN event_id % 12 = 4 THEN concat('import os', chr(10), 'from a import ', event_type, chr(10),
            'class C', event_id, '(B):', chr(10), ' x = 1', chr(10), ' def m(self): pass', chr(10), 'def f(a, *, b=1): pass',
            chr(10), 'def f(c): pass', chr(10)) ELSE concat('def broken(', event_id) END
        ELSE props END AS content
    FROM {events}"""


@query("d14_structural_profile", oracle="""
    WITH c AS (SELECT event_id, path, content, concat('[structural summary of ', path, ' — ', CAST(length(content)
            AS STRING), ' chars; use query_tool_result to retrieve specifics]', chr(10)) AS head, event_type, props,
            CAST(event_id AS STRING) AS e FROM (""" + CODE.replace("'d', event_id,", "'d', CAST(event_id AS STRING),")
       .replace(", event_id, '", ", CAST(event_id AS STRING), '").replace("', event_id)", "', CAST(event_id AS STRING))")
       .replace("SELECT event_id, concat('d'", "SELECT event_id, event_type, props, concat('d'") + """) s)
    SELECT event_id, head || CASE event_id % 6
        WHEN 0 THEN CASE WHEN event_id % 12 = 0 THEN concat('Object with 7 keys: ''z'' (dict), ''a'' (int), ''v'' (float), ',
            '''s'' (str), ''n'' (NoneType), ''t'' (list), ''b'' (bool)') ELSE 'Array of 2 items (each: dict)' END
        WHEN 1 THEN 'Object with 1 keys (3 lines): ''k'' (int)'
        WHEN 2 THEN concat('CSV: 3 columns, ~2 rows', chr(10), 'Columns: id, a,b, ', event_type)
        WHEN 3 THEN concat(chr(10), chr(10), 'Imports:', chr(10), '  import x from "', event_type, '"', chr(10), chr(10),
            'Exports/definitions: run', e, ', K', e, ', go')
        WHEN 4 THEN CASE WHEN event_id % 12 = 4 THEN concat(chr(10), chr(10), 'Imports:', chr(10), '  import os', chr(10),
            '  from a import ', event_type, chr(10), chr(10), 'Top-level definitions:', chr(10), '  class C', e, '(B):',
            chr(10), '  def m(...)', chr(10), '  def f(a, *, b=1): ...') END END AS profile
    FROM c""")
def structural_profile(t):
    return R.add_profiles(t.sql(CODE)).select("event_id", "profile")


def _event_stream(t):
    return (t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet")
            .parquet(t.directory))


@query("t1_incremental_intake", oracle="""
    SELECT user_id, count(DISTINCT event_type) AS n_keys FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def incremental_intake(t):
    base = S.scratch_path(t.spark, "intake")
    keyed = _event_stream(t).select("user_id", F.concat_ws("@", "user_id", "event_type").alias("example_key"))
    labelled = t.events.where("event_type = 'error'").select(F.concat_ws("@", "user_id", "event_type").alias("example_key"))
    for _ in range(2):  # the second run resumes from the checkpoint and finds nothing new
        T.start_intake(keyed, f"{base}/out", f"{base}/checkpoint", labelled=labelled.distinct()).awaitTermination()
    return t.spark.read.parquet(f"{base}/out").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_keys"))


@query("t2_running_counters", oracle="""
    SELECT user_id % 5 AS model, CAST(count_if(event_type <> 'error') AS BIGINT) AS ok,
        CAST(count_if(event_type = 'error') AS BIGINT) AS failed,
        CAST(sum(CASE WHEN event_type <> 'error' THEN floor(value) ELSE 0 END) AS BIGINT) AS total_tokens
    FROM events GROUP BY user_id % 5""")
def running_counters(t):
    base = S.scratch_path(t.spark, "counters")
    attempts = _event_stream(t).select((F.col("user_id") % 5).alias("model"), (F.col("event_type") != "error").alias("ok"),
                                       F.floor("value").alias("tokens"))
    T.start_counters(attempts, ["model"], f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return T.newest_counters(t.spark, f"{base}/out", ["model"])
