"""Diff and hunk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.catalog.registry import query
from changeloom.functions.scale import numbered, position_block
from changeloom.operators import diffs as D


@query("d1_split_hunks", oracle="""
    SELECT ex_id, 1 AS hunk_no, concat(header, body1) AS patch FROM {diff_parts}
    UNION ALL SELECT ex_id, 2, concat(header, open2, removed2) FROM {diff_parts}
    UNION ALL SELECT ex_id, 3, concat(header3, body3) FROM {diff_parts} WHERE ex_id % 3 = 0""")
def split_hunks(t):
    return t.range_diffs.select("ex_id", F.posexplode(D.split_hunks("diff")).alias("i", "patch")).select(
        "ex_id", (F.col("i") + 1).alias("hunk_no"), "patch")


@query("d1_split_hunks_compat", oracle="""
    WITH lines AS (
        SELECT ex_id, unnest(string_split(rtrim(diff, chr(10)), chr(10))) AS line,
            generate_subscripts(string_split(rtrim(diff, chr(10)), chr(10)), 1) AS k FROM {range_diffs}),
    kinds AS (SELECT *, CASE WHEN starts_with(line, '@@') THEN 'h' WHEN starts_with(line, 'diff --git')
                  OR starts_with(line, 'index ') OR starts_with(line, '--- ') OR starts_with(line, '+++ ') THEN 'f'
                  ELSE 'o' END AS kind FROM lines),
    marks AS (SELECT *, max(CASE WHEN kind <> 'o' THEN k END) OVER (PARTITION BY ex_id ORDER BY k) AS m,
                  sum(CASE WHEN kind = 'h' THEN 1 ELSE 0 END) OVER (PARTITION BY ex_id ORDER BY k) AS seg FROM kinds),
    st AS (SELECT a.ex_id, a.line, a.k, a.seg, coalesce(b.kind, 'f') = 'h' AS in_hunk
           FROM marks a LEFT JOIN kinds b ON a.ex_id = b.ex_id AND a.m = b.k),
    hd AS (SELECT h.ex_id, h.seg, string_agg(x.line, chr(10) ORDER BY x.k) AS header
           FROM (SELECT ex_id, seg, min(k) AS k0 FROM st WHERE in_hunk GROUP BY 1, 2) h
           JOIN st x ON x.ex_id = h.ex_id AND NOT x.in_hunk AND x.k < h.k0 GROUP BY 1, 2),
    bd AS (SELECT ex_id, seg, string_agg(line, chr(10) ORDER BY k) AS body FROM st WHERE in_hunk GROUP BY 1, 2)
    SELECT bd.ex_id, CAST(bd.seg AS INT) AS hunk_no, md5(concat(hd.header, chr(10), bd.body, chr(10))) AS patch_md5
    FROM bd JOIN hd ON bd.ex_id = hd.ex_id AND bd.seg = hd.seg""")
def split_hunks_compat(t):
    return t.range_diffs.select("ex_id", F.posexplode(D.split_hunks_compat("diff")).alias("i", "patch")).select(
        "ex_id", (F.col("i") + 1).alias("hunk_no"), F.md5("patch").alias("patch_md5"))


@query("d2_collect_hunks", oracle="""
    SELECT ex_id, hunk_id, file_path, hunk_no, patch, is_untracked, is_binary FROM {hunks} WHERE is_untracked OR ex_id % 9 <> 5""")
def collect_hunks(t):
    files = t.sql("""
        SELECT ex_id, path, ex_id % 10 = 3 AS is_untracked, CASE WHEN ex_id % 9 = 5 AND ex_id % 10 <> 3 THEN chr(10)
            WHEN ex_id % 10 = 3 THEN '' WHEN ex_id % 11 = 3 THEN concat('diff --git a/x b/x', chr(10),
            'Binary files a/x and b/x differ', chr(10)) ELSE diff END AS diff
        FROM {file_diffs}""")
    return D.collect_hunks(files, compat=False)


@query("d3_is_binary_diff", oracle="""
    SELECT ex_id, ex_id % 4 IN (0, 2) AS is_binary FROM {file_diffs}""")
def is_binary_diff(t):
    return t.sql("""
        SELECT ex_id, concat(diff, CASE ex_id % 4 WHEN 0 THEN 'Binary files a/x and b/x differ'
            WHEN 1 THEN 'Binary files a/x and b/x changed' WHEN 2 THEN concat('GIT binary patch', chr(10), 'literal 9')
            ELSE concat('+Binary files a and b differ', chr(10)) END) AS diff FROM {file_diffs}
        """).select("ex_id", D.is_binary_diff("diff").alias("is_binary"))


@query("d4_old_range", oracle="""
    SELECT hunk_id, CASE WHEN patch <> '' THEN CAST(5 + ex_id % 100 + CASE WHEN hunk_no = 2 THEN 9 ELSE 0 END AS INT) END
        AS start_line, CASE WHEN patch = '' THEN NULL WHEN hunk_no = 1 THEN 1 ELSE n + 1 END AS line_count
    FROM {hunks} JOIN (SELECT ex_id AS did, n FROM {diff_parts}) p ON p.did = ex_id""")
def old_range(t):
    r = D.old_range("patch")
    return t.hunks.select("hunk_id", r["start"].alias("start_line"), r["count"].cast("bigint").alias("line_count"))


STATS = """
    SELECT h.hunk_id, h.hunk_no, p.n, p.dash, h.patch, h.is_untracked FROM {hunks} h JOIN {diff_parts} p ON h.ex_id = p.ex_id"""


@query("d5_diff_stats", oracle=f"""
    SELECT hunk_id, CASE WHEN patch <> '' AND hunk_no = 1 THEN n ELSE 0 END AS added,
        CASE WHEN patch <> '' AND hunk_no = 2 AND dash = '' THEN n ELSE 0 END AS removed FROM ({STATS}) s""")
def diff_stats(t):
    return t.hunks.select("hunk_id", D.added_lines("patch").cast("bigint").alias("added"),
                          D.removed_lines("patch").cast("bigint").alias("removed"))


# Whole patches, and each once more from its first plus sign on, so that a text that begins with one is met.
CUT_PATCHES = """
    SELECT hunk_id, ex_id, 0 AS cut, patch FROM {hunks}
    UNION ALL SELECT hunk_id, ex_id, 1, substr(patch, position('+' IN patch)) FROM {hunks} WHERE position('+' IN patch) > 0"""


@query("d6_substring_stats", oracle=f"""
    SELECT hunk_id, cut, CAST((length(patch) - length(replace(patch, concat(chr(10), '+'), ''))) / 2
        - (length(patch) - length(replace(patch, concat(chr(10), '+++'), ''))) / 4 AS BIGINT) AS added,
        CAST((length(patch) - length(replace(patch, concat(chr(10), '-'), ''))) / 2
        - (length(patch) - length(replace(patch, concat(chr(10), '---'), ''))) / 4 AS BIGINT) AS removed
    FROM ({CUT_PATCHES}) h""")
def substring_stats(t):
    return t.sql(CUT_PATCHES).select("hunk_id", "cut", D.quick_added("patch").alias("added"), D.quick_removed("patch").alias("removed"))


@query("d7_generated_flag", oracle="""
    SELECT path, split_part(path, '/', -1) IN ('go.sum', 'package-lock.json', 'yarn.lock', 'Cargo.lock')
        OR path LIKE '%.min.js' AS is_generated FROM (SELECT DISTINCT path FROM {paths}) p""")
def generated_flag(t):
    return t.paths.select("path").distinct().select("path", D.is_generated("path").alias("is_generated"))


CONTEXT = """
    ctx AS (
        SELECT hunk_id, ex_id, hunk_no, CASE WHEN is_untracked THEN '(new untracked file — no diff)'
                WHEN is_binary THEN '[binary file]' WHEN file_path LIKE '%.min.js' THEN
                concat('[machine-generated lockfile — group with the dependency change that caused it] +',
                    CAST(CASE WHEN hunk_no = 1 THEN n ELSE 0 END AS STRING), '/-',
                    CAST(CASE WHEN hunk_no = 2 AND ex_id % 7 <> 0 THEN n ELSE 0 END AS STRING), ' lines')
                WHEN length(patch) <= 2000 THEN patch END AS body, is_untracked, is_binary
        FROM {hunks} JOIN (SELECT ex_id AS did, n FROM {diff_parts}) p ON p.did = ex_id),
    sized AS (SELECT *, CASE WHEN is_untracked THEN 50 WHEN is_binary THEN 30 ELSE coalesce(length(body), 0) END
                  AS charged FROM ctx)"""


@query("d8_render_context", oracle=f"""
    WITH {CONTEXT}
    SELECT hunk_id, CASE WHEN body IS NOT NULL THEN concat('--- ', hunk_id, ' ---', chr(10), body) END AS shown,
        CAST(charged AS BIGINT) AS charged, body IS NULL AS needs_summary FROM sized""")
def render_context(t):
    return D.render_context(t.hunks, limit=2000).select("hunk_id", "shown", "charged", "needs_summary")


@query("d9_budget_cut", oracle=f"""
    WITH {CONTEXT},
    placed AS (SELECT hunk_id, ex_id % 4 AS change_set, charged, coalesce(sum(charged) OVER (PARTITION BY ex_id % 4
                   ORDER BY ex_id * 2 + hunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent_before
               FROM sized)
    SELECT hunk_id, change_set, CAST(spent_before AS BIGINT) AS spent_before,
        spent_before + charged >= 120000 AS closes FROM placed WHERE spent_before < 120000""")
def budget_cut(t):
    rendered = D.render_context(t.hunks, limit=2000).select(
        "hunk_id", (F.col("ex_id") % 4).alias("change_set"), (F.col("ex_id") * 2 + F.col("hunk_no")).alias("pos"),
        "charged")
    return D.budget_cut(rendered, ["change_set"], "pos").select("hunk_id", "change_set", "spent_before", "closes")


@query("d9_context_parts", oracle=f"""
    WITH {CONTEXT},
    placed AS (SELECT hunk_id, ex_id % 4 AS change_set, ex_id * 2 + hunk_no AS pos, charged,
                   CASE WHEN body IS NOT NULL THEN concat('--- ', hunk_id, ' ---', chr(10), body) END AS shown,
                   coalesce(sum(charged) OVER (PARTITION BY ex_id % 4 ORDER BY ex_id * 2 + hunk_no
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent_before FROM sized),
    cut AS (SELECT * FROM placed WHERE spent_before < 120000),
    shown_parts AS (SELECT change_set, pos, 0 AS k, shown AS part FROM cut WHERE shown IS NOT NULL
        UNION ALL SELECT change_set, pos, 1, concat(chr(10), '... (remaining hunks omitted — total size limit reached)')
        FROM cut WHERE spent_before + charged >= 120000)
    SELECT change_set, pos, CAST(row_number() OVER (PARTITION BY change_set, pos ORDER BY k) - 1 AS INTEGER) AS part_no, md5(part) AS part
    FROM shown_parts""")
def context_parts(t):
    rendered = D.render_context(t.hunks, limit=2000).select(
        (F.col("ex_id") % 4).alias("change_set"), (F.col("ex_id") * 2 + F.col("hunk_no")).alias("pos"), "charged", "shown")
    return D.context_parts(rendered, ["change_set"], "pos").withColumn("part", F.md5("part"))


SIDES = """
    SELECT ex_id, path, 'staged' AS side, 0 AS side_rank, diff FROM {file_diffs} WHERE ex_id % 3 <> 1
    UNION ALL SELECT ex_id, path, 'unstaged', 1, CASE WHEN ex_id % 5 = 0 THEN chr(10) ELSE concat(diff, 'z') END
    FROM {file_diffs} WHERE ex_id % 3 <> 2"""


@query("d10_file_view", oracle=f"""
    WITH s AS ({SIDES}),
    v AS (SELECT path, coalesce(string_agg(CASE WHEN trim(replace(diff, chr(10), '')) <> '' THEN concat('=== ', side,
              ' ===', chr(10), diff) END, chr(10) ORDER BY side_rank), concat('No diff found for ', path)) AS t
          FROM s GROUP BY path)
    SELECT path, CASE WHEN length(t) > 6000 THEN concat(substr(t, 1, 6000), chr(10), chr(10),
        '... (truncated at 6000 chars)') ELSE t END AS view FROM v""")
def file_view(t):
    return D.file_view(t.sql(SIDES).select("path", "side", "diff"))


@query("d11_search_diff", oracle=f"""
    WITH s AS ({SIDES}),
    lines AS (SELECT ex_id, side_rank, string_split(rtrim(diff, chr(10)), chr(10)) AS ls,
                  unnest(string_split(rtrim(diff, chr(10)), chr(10))) AS line,
                  generate_subscripts(string_split(rtrim(diff, chr(10)), chr(10)), 1) AS k FROM s)
    SELECT ex_id, side_rank, CAST(k AS INT) AS line_number,
        array_to_string(ls[greatest(k - 2, 1):k + 2], chr(10)) AS match_context
    FROM lines WHERE regexp_matches(line, '^[-+].*th(e|er) ') ORDER BY side_rank, ex_id, k LIMIT 50""")
def search_diff(t):
    return D.search_diff(t.sql(SIDES).drop("side", "path"), "^[-+].*th(e|er) ", order=("side_rank", "ex_id"))


@query("d12_hunk_list", oracle="""
    SELECT h.ex_id, CAST(h.hunk_no AS BIGINT) AS line_no, concat('  ', hunk_id, '  ', CASE WHEN is_untracked
        THEN '(new untracked file)' WHEN is_binary THEN '[binary file]' ELSE concat('(+',
        CAST(CASE WHEN hunk_no = 1 THEN n ELSE 0 END AS STRING), '/-',
        CAST(CASE WHEN hunk_no = 2 AND h.ex_id % 7 <> 0 THEN n ELSE 0 END AS STRING), ')') END) AS line
    FROM {hunks} h JOIN {diff_parts} p ON h.ex_id = p.ex_id
    UNION ALL SELECT DISTINCT ex_id, 0, 'Available hunks:' FROM {hunks}""")
def hunk_list(t):
    return D.hunk_list(t.hunks, ["ex_id"], "hunk_no")


@query("d13_combined_patch", oracle="""
    SELECT ex_id, file_path, count(*) AS n_hunks, CASE WHEN count(*) = 1 THEN min(patch) ELSE md5(min(p.whole)) END
        AS patch
    FROM {hunks} h JOIN (SELECT ex_id AS did, concat(header, body1, open2, removed2) AS whole FROM {diff_parts}) p
    ON p.did = h.ex_id GROUP BY ex_id, file_path""")
def combined_patch(t):
    # Later hunks come first in the input, so that the sort by old start shows.
    shuffled = t.hunks.withColumn("hunk_no", 5 - F.col("hunk_no"))
    out = D.combined_patches(shuffled, ["ex_id", "file_path"])
    return out.select("ex_id", "file_path", F.col("n_hunks").cast("bigint").alias("n_hunks"),
                      F.when(F.col("n_hunks") == 1, F.col("patch")).otherwise(F.md5("patch")).alias("patch"))


@query("d13_patch_pieces", oracle="""
    SELECT h.ex_id, h.file_path, CAST(h.hunk_no AS BIGINT) AS piece_no, n.n_hunks, CASE WHEN n.n_hunks = 1 THEN h.patch
        WHEN h.hunk_no = 1 THEN md5(concat(header, body1)) ELSE md5(concat(open2, removed2)) END AS piece
    FROM {hunks} h JOIN {diff_parts} p ON h.ex_id = p.ex_id
    JOIN (SELECT ex_id, file_path, count(*) AS n_hunks FROM {hunks} GROUP BY ex_id, file_path) n
        ON h.ex_id = n.ex_id AND h.file_path = n.file_path""")
def patch_pieces(t):
    shuffled = t.hunks.withColumn("hunk_no", 5 - F.col("hunk_no"))
    out = D.patch_pieces(shuffled, ["ex_id", "file_path"])
    return out.withColumn("piece", F.when(F.col("n_hunks") == 1, F.col("piece")).otherwise(F.md5("piece")))


@query("d15_change_metadata", oracle=f"""
    SELECT DISTINCT 'Untracked' AS side, regexp_extract(hunk_id, '[^.]*$') AS kind, CAST(NULL AS BIGINT) AS added,
        CAST(NULL AS BIGINT) AS removed FROM {{hunks}} WHERE is_untracked
    UNION ALL SELECT CASE WHEN hunk_no = 1 THEN 'Staged' ELSE 'Unstaged' END AS side, regexp_extract(hunk_id, '[^.]*$') AS kind,
        CAST(sum(CASE WHEN patch <> '' AND hunk_no = 1 THEN n ELSE 0 END) AS BIGINT) AS added,
        CAST(sum(CASE WHEN patch <> '' AND hunk_no = 2 AND dash = '' THEN n ELSE 0 END) AS BIGINT) AS removed
    FROM ({STATS}) s WHERE NOT is_untracked GROUP BY 1, 2""")
def change_metadata(t):
    sided = t.hunks.withColumn("side", F.when(F.col("hunk_no") == 1, "Staged").otherwise("Unstaged")).withColumn(
        "kind", F.regexp_extract("hunk_id", "[^.]*$", 0))
    return D.change_metadata(sided, ("side", "kind"))


@query("d16_ordered_union", oracle="""
    WITH s AS (SELECT ex_id, path AS value, ex_id % 3 AS source_rank, row_number() OVER (PARTITION BY ex_id ORDER BY path)
                   AS pos FROM {ex_files}),
    r AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY source_rank, pos, ex_id) AS k FROM s)
    SELECT value, source_rank, CAST(pos AS BIGINT) AS pos FROM r WHERE k = 1""")
def ordered_union(t):
    values = t.sql("""
        SELECT path AS value, ex_id % 3 AS source_rank, CAST(row_number() OVER (PARTITION BY ex_id ORDER BY path)
            AS BIGINT) AS pos FROM {ex_files}""")
    return D.ordered_union(values)


HUNK_SETS = """
    SELECT source AS file_path, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS hunk_no, text AS patch,
        md5(text) AS summary, length(text) AS chars FROM {documents}"""


@query("d17_summary_requests", oracle=f"""
    WITH h AS ({HUNK_SETS}), c AS (SELECT file_path AS fp, count(*) AS n FROM h GROUP BY 1),
    p AS (SELECT a.file_path, a.hunk_no, string_agg(concat('  Hunk ', CAST(b.hunk_no AS STRING), ': ', b.summary),
              chr(10) ORDER BY b.hunk_no) AS prior
          FROM h a JOIN h b ON a.file_path = b.file_path AND b.hunk_no BETWEEN a.hunk_no - 4 AND a.hunk_no - 1
          GROUP BY 1, 2)
    SELECT h.file_path, CAST(h.hunk_no AS BIGINT) AS hunk_no, md5(concat('Describe hunk ', CAST(h.hunk_no AS STRING),
        ' of ', CAST(c.n AS STRING), ' from ''', h.file_path, ''' in one to three sentences.', chr(10), chr(10),
        CASE WHEN p.prior IS NULL THEN '' ELSE concat('Previous hunks in this file:', chr(10), p.prior, chr(10), chr(10))
        END, 'Hunk ', CAST(h.hunk_no AS STRING), ':', chr(10), h.patch)) AS request_md5
    FROM h JOIN c ON h.file_path = c.fp LEFT JOIN p ON p.file_path = h.file_path AND p.hunk_no = h.hunk_no""")
def summary_requests(t):
    rows = t.sql("SELECT source AS file_path, doc_id, text AS patch, md5(text) AS summary FROM {documents}")
    hunks = numbered(rows, ["file_path"], position_block("doc_id"), [F.col("doc_id")], "hunk_no")
    counts = hunks.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_hunks"))
    out = D.summary_requests(hunks.join(counts, "file_path"), ["file_path"])
    return out.select("file_path", F.col("hunk_no").cast("bigint").alias("hunk_no"), F.md5("request").alias("request_md5"))


@query("d18_batch_plan", oracle=f"""
    WITH f AS (SELECT file_path, CAST(count(*) AS INT) AS n, sum(chars) AS total, CASE WHEN max(patch) > 'M' THEN 20000
                   ELSE 0 END AS remaining, greatest(1, CAST(floor(count(*) / 3) AS INT)) AS bs
               FROM ({HUNK_SETS}) h GROUP BY file_path)
    SELECT file_path, CAST(s AS INT) AS start_hunk, CAST(least(s + bs - 1, n) AS INT) AS end_hunk
    FROM (SELECT *, unnest(generate_series(1, n, bs)) AS s FROM f WHERE remaining > 0 AND total > 12000) x""")
def batch_plan(t):
    files = t.sql("SELECT source AS file_path, text AS patch, length(text) AS chars FROM {documents}").groupBy("file_path").agg(
        F.count(F.lit(1)).cast("int").alias("n_hunks"), F.sum("chars").alias("total_chars"),
        F.when(F.max("patch") > "M", 20000).otherwise(0).alias("remaining"))
    return D.batch_plan(files).select("file_path", "start_hunk", "end_hunk")


BATCHES = f"""
    f AS (SELECT file_path, CAST(count(*) AS INT) AS n, greatest(1, CAST(floor(count(*) / 3) AS INT)) AS bs
          FROM ({HUNK_SETS}) h GROUP BY file_path HAVING sum(chars) > 12000),
    b AS (SELECT h.file_path, CAST((h.hunk_no - 1) // bs * bs + 1 AS INT) AS start_hunk, n, CAST(max(h.hunk_no) AS INT) AS end_hunk,
              string_agg(concat('Hunk ', CAST(h.hunk_no AS STRING), ':', chr(10), h.patch), concat(chr(10), chr(10))
                  ORDER BY h.hunk_no) AS texts
          FROM ({HUNK_SETS}) h JOIN f ON f.file_path = h.file_path GROUP BY 1, 2, 3)"""


def _batched(t):
    rows = t.sql("SELECT source AS file_path, doc_id, text AS patch, length(text) AS chars FROM {documents}")
    hunks = numbered(rows, ["file_path"], position_block("doc_id"), [F.col("doc_id")], "hunk_no")
    files = rows.groupBy("file_path").agg(F.count(F.lit(1)).cast("int").alias("n_hunks"), F.sum("chars").alias("total_chars"),
                                          F.lit(20000).alias("remaining"))
    return D.batch_requests(D.batch_plan(files), hunks, ["file_path"])


@query("d18_batch_requests", oracle=f"""
    WITH {BATCHES}
    SELECT file_path, start_hunk, end_hunk, n AS n_hunks, md5(concat('Describe hunks ', CAST(start_hunk AS STRING), '-',
        CAST(end_hunk AS STRING), ' of ', CAST(n AS STRING), ' from ''', file_path, ''' in two to four sentences.', chr(10), chr(10),
        texts)) AS request FROM b""")
def batch_requests(t):
    return _batched(t).withColumn("request", F.md5("request"))


@query("d18_batched_summary", oracle=f"""
    WITH {BATCHES}
    SELECT file_path, concat('[batched summary — ', CAST(max(n) AS STRING), ' hunk(s)]', chr(10), string_agg(concat('  Hunks ',
        CAST(start_hunk AS STRING), '-', CAST(end_hunk AS STRING), ': ', CAST(length(texts) AS STRING)), chr(10) ORDER BY start_hunk))
        AS summary FROM b GROUP BY file_path""")
def batched_summary(t):
    # The length of the texts stands in for the model's answer.
    length = F.length(F.regexp_extract("request", "(?s)^[^\n]*\n\n(.*)$", 1)).cast("string")
    return D.batched_summary(_batched(t).withColumn("summary", F.concat(F.lit(" "), length)), ["file_path"])
