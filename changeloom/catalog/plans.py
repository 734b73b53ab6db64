"""Commit plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.catalog.registry import Tables, query
from changeloom.catalog.views import VIEWS
from changeloom.operators import plans as P
from changeloom.session import durable


def _claims(t):
    """Rows of ``claims``, with orders and lines dealt into all of the session's partitions for their join.

    Adaptive execution would join parts by their compressed size, which for columns of keys is a fraction of their memory.
    """
    dealt, parts = Tables(t.spark, t.directory), int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt._cache["orders"] = t.orders.select("o_orderkey", "o_custkey").repartition(parts, "o_orderkey")
    dealt._cache["lineitem"] = t.lineitem.select("l_orderkey", "l_partkey").repartition(parts, "l_orderkey")
    return dealt.sql(VIEWS["claims"])


HUNK_TABLE = """
    SELECT DISTINCT plan, hunk FROM {claims} WHERE hunk % 7 <> 0
    UNION ALL SELECT DISTINCT plan, 60 FROM {claims}"""
SKIP_TABLE = "SELECT DISTINCT plan, hunk + 3 AS hunk FROM {claims} WHERE hunk % 11 = 0"


@query("c1_unknown_hunks", oracle=f"""
    WITH h AS ({HUNK_TABLE}) SELECT c.plan, c.commit_ix, c.hunk FROM {{claims}} c
    WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.plan = c.plan AND h.hunk = c.hunk)""")
def unknown_hunks(t):
    return P.unknown_hunks(t.claims, t.sql(HUNK_TABLE))


@query("c2_double_assigned", oracle="""
    SELECT plan, hunk, count(DISTINCT commit_ix) AS n_commits FROM {claims} GROUP BY plan, hunk
    HAVING count(DISTINCT commit_ix) > 1""")
def double_assigned(t):
    return P.double_assigned(_claims(t))


@query("c3_coverage", oracle=f"""
    ({HUNK_TABLE}) EXCEPT SELECT plan, hunk FROM {{claims}} EXCEPT ({SKIP_TABLE})""")
def coverage(t):
    return P.unassigned_hunks(t.sql(HUNK_TABLE), t.claims, t.sql(SKIP_TABLE))


@query("c4_invalid_skips", oracle=f"({SKIP_TABLE}) EXCEPT ({HUNK_TABLE})")
def invalid_skips(t):
    return P.invalid_skips(t.sql(SKIP_TABLE), t.sql(HUNK_TABLE))


COMPONENT_CTES = """
    edge AS (SELECT DISTINCT a.plan, a.commit_ix AS x, b.commit_ix AS y FROM {claims} a JOIN {claims} b
             ON a.plan = b.plan AND a.hunk = b.hunk),
    reach AS (SELECT plan, x, y FROM edge UNION SELECT r.plan, r.x, e.y FROM reach r JOIN edge e
              ON e.plan = r.plan AND e.x = r.y),
    comp AS (SELECT plan, x AS commit_ix, min(y) AS component FROM reach GROUP BY plan, x)"""


@query("c5_overlap_components", oracle=f"""
    WITH RECURSIVE {COMPONENT_CTES} SELECT plan, commit_ix, component FROM comp""")
def overlap_components(t):
    return P.overlap_components(durable(_claims(t)))


@query("c5_merge_groups", oracle=f"""
    WITH RECURSIVE {COMPONENT_CTES} SELECT plan, component, count(*) AS n_commits FROM comp GROUP BY plan, component
    HAVING count(*) > 1""")
def merge_groups(t):
    return P.merge_groups(P.overlap_components(durable(_claims(t))))


@query("c6_component_hunks", oracle=f"""
    WITH RECURSIVE {COMPONENT_CTES},
    r AS (SELECT c.plan, comp.component, c.hunk, c.commit_ix AS first_commit, row_number() OVER (
              PARTITION BY c.plan, comp.component, c.hunk ORDER BY c.commit_ix) AS k
          FROM {{claims}} c JOIN comp ON comp.plan = c.plan AND comp.commit_ix = c.commit_ix)
    SELECT plan, component, hunk, first_commit, hunk AS first_pos FROM r WHERE k = 1""")
def component_hunks(t):
    claims = durable(_claims(t))
    return P.component_hunks(claims.withColumn("pos", F.col("hunk")), P.overlap_components(claims))


@query("c6_component_issues", oracle=f"""
    WITH RECURSIVE {COMPONENT_CTES}
    SELECT DISTINCT c.plan, comp.component, concat('f', CAST(c.hunk % 5 AS STRING)) AS path,
        CASE WHEN c.hunk % 3 = 0 THEN '' ELSE 'unused' END AS message
    FROM {{claims}} c JOIN comp ON comp.plan = c.plan AND comp.commit_ix = c.commit_ix""")
def component_issues(t):
    claims = durable(_claims(t))
    issues = claims.select("plan", "commit_ix", F.col("hunk").alias("pos"), F.expr("concat('f', hunk % 5)").alias("path"),
                             F.when(F.col("hunk") % 3 != 0, "unused").alias("message"))
    return P.component_issues(issues, P.overlap_components(claims))


@query("c7_dependent_splits", oracle="""
    WITH r AS (SELECT *, start_line + greatest(line_count - 1, 0) AS end_line FROM {hunk_ranges})
    SELECT a.plan, a.file, a.commit_ix AS commit_a, a.pos AS pos_a, b.commit_ix AS commit_b, b.pos AS pos_b,
        CAST(greatest(b.start_line - a.end_line, a.start_line - b.end_line) AS BIGINT) AS gap
    FROM r a JOIN r b ON a.plan = b.plan AND a.file = b.file AND a.pos < b.pos AND a.commit_ix <> b.commit_ix
    WHERE greatest(b.start_line - a.end_line, a.start_line - b.end_line) <= 3""")
def dependent_splits(t):
    return P.dependent_splits(t.hunk_ranges)


@query("c7_nearest_conflicts", oracle="""
    WITH r AS (SELECT *, start_line + greatest(line_count - 1, 0) AS end_line FROM {hunk_ranges}),
    pairs AS (
        SELECT a.plan, a.file, a.commit_ix AS c_a, a.pos AS p_a, b.commit_ix AS c_b, b.pos AS p_b, a.end_line AS reach,
            b.start_line AS later, greatest(b.start_line - a.end_line, a.start_line - b.end_line) AS gap
        FROM r a JOIN r b ON a.plan = b.plan AND a.file = b.file AND a.commit_ix <> b.commit_ix
            AND (a.start_line < b.start_line OR (a.start_line = b.start_line AND a.pos < b.pos))
        WHERE b.start_line - a.end_line <= 3),
    before AS (SELECT *, row_number() OVER (PARTITION BY plan, file, p_b ORDER BY reach DESC, p_a) AS k FROM pairs),
    after AS (SELECT *, row_number() OVER (PARTITION BY plan, file, p_a ORDER BY later, p_b) AS k FROM pairs)
    SELECT coalesce(x.plan, y.plan) AS plan, coalesce(x.file, y.file) AS file, coalesce(x.c_b, y.c_a) AS commit_ix,
        coalesce(x.p_b, y.p_a) AS pos, x.c_a AS before_commit, x.p_a AS before_pos, y.c_b AS after_commit, y.p_b AS after_pos,
        CAST(least(coalesce(x.gap, y.gap), coalesce(y.gap, x.gap)) AS BIGINT) AS gap
    FROM (SELECT * FROM before WHERE k = 1) x FULL JOIN (SELECT * FROM after WHERE k = 1) y
        ON x.plan = y.plan AND x.file = y.file AND x.p_b = y.p_a""")
def nearest_conflicts(t):
    return P.nearest_conflicts(t.hunk_ranges)


CLAIMED = """
    SELECT ex_id % 50 AS plan, ex_id % 3 AS commit_ix, CASE ex_id % 6 WHEN 0 THEN concat(file_path, '::9')
        WHEN 1 THEN concat(file_path, '-gone::1') WHEN 2 THEN 'loose' ELSE hunk_id END AS hunk_id, ex_id
    FROM {hunks}"""


@query("c8_remap_hunks", oracle=f"""
    WITH c AS ({CLAIMED}), h AS (SELECT ex_id % 50 AS plan, hunk_id, is_untracked FROM {{hunks}})
    SELECT c.plan, c.commit_ix, c.hunk_id, c.ex_id, coalesce(k.hunk_id, u.hunk_id) AS resolved,
        k.hunk_id IS NULL AS remapped
    FROM c LEFT JOIN h k ON k.plan = c.plan AND k.hunk_id = c.hunk_id
    LEFT JOIN h u ON u.plan = c.plan AND u.is_untracked AND u.hunk_id = concat(split_part(c.hunk_id, '::', 1), '::1')
        AND position('::' IN c.hunk_id) > 0
    WHERE k.hunk_id IS NOT NULL OR u.hunk_id IS NOT NULL""")
def remap_hunks(t):
    hunks = t.hunks.withColumn("plan", F.col("ex_id") % 50).drop("ex_id")
    return P.remap_hunks(t.sql(CLAIMED), hunks)


@query("c9_file_rollup", oracle=f"""
    WITH c AS ({CLAIMED}), h AS (SELECT x.ex_id % 50 AS plan, hunk_id, file_path, is_untracked,
            CASE WHEN patch <> '' AND hunk_no = 1 THEN n ELSE 0 END AS a,
            CASE WHEN patch <> '' AND hunk_no = 2 AND dash = '' THEN n ELSE 0 END AS r
        FROM {{hunks}} x JOIN {{diff_parts}} p ON x.ex_id = p.ex_id),
    j AS (SELECT c.plan, c.commit_ix, coalesce(h.file_path, split_part(c.hunk_id, '::', 1)) AS file_path, h.a, h.r,
              h.is_untracked, h.hunk_id FROM c LEFT JOIN h ON h.plan = c.plan AND h.hunk_id = c.hunk_id)
    SELECT plan, commit_ix, file_path, CAST(sum(a) AS BIGINT) AS added, CAST(sum(r) AS BIGINT) AS removed,
        count(hunk_id) AS n_hunks, CASE WHEN count(hunk_id) = 0 THEN '~' WHEN bool_or(is_untracked) THEN '+'
        WHEN sum(a) = 0 AND sum(r) > 0 THEN '×' ELSE '~' END AS marker
    FROM j GROUP BY plan, commit_ix, file_path""")
def file_rollup(t):
    hunks = t.hunks.withColumn("plan", F.col("ex_id") % 50).drop("ex_id")
    return P.file_rollup(t.sql(CLAIMED), hunks)


BODIES = """
    SELECT doc_id, concat(CASE WHEN doc_id % 4 = 0 THEN concat('breaking-Change : drops x', chr(10), 'more of it', chr(10),
        chr(10)) ELSE '' END, CASE WHEN doc_id % 4 = 1 THEN concat(text, chr(10)) ELSE replace(text, '. ',
        concat('.', chr(10), chr(10))) END, CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), 'BREAKING CHANGE: gone', chr(10),
        'tail') ELSE '' END) AS body FROM {documents}"""


@query("c10_strip_breaking_trailer", oracle=f"""
    WITH l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line,
                   generate_subscripts(string_split(body, chr(10)), 1) AS k FROM ({BODIES}) b),
    m AS (SELECT *, regexp_matches(line, '(?i)^BREAKING[- ]CHANGE\\s*:') AS tr, trim(line) = '' AS bl FROM l),
    w AS (SELECT *, coalesce(max(CASE WHEN tr THEN k END) OVER p, 0) AS lt, coalesce(max(CASE WHEN bl THEN k END) OVER p,
              0) AS lb FROM m WINDOW p AS (PARTITION BY doc_id ORDER BY k))
    SELECT d.doc_id, regexp_replace(coalesce(string_agg(w.line, chr(10) ORDER BY w.k), ''), '^\\s+|\\s+$', '', 'g')
        AS body
    FROM documents d LEFT JOIN w ON d.doc_id = w.doc_id AND w.lt <= w.lb GROUP BY d.doc_id""")
def strip_breaking_trailer(t):
    return t.sql(BODIES).select("doc_id", P.strip_breaking_trailer("body").alias("body"))


@query("c11_commit_message", oracle="""
    SELECT doc_id, concat('fix: x', CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat(chr(10), chr(10),
        regexp_replace(text, '^\\s+|\\s+$', '', 'g')) END, CASE WHEN doc_id % 4 = 0 THEN concat(chr(10), chr(10),
        'BREAKING CHANGE: gone', chr(10), 'Signed-off-by: bot') ELSE concat(chr(10), chr(10), 'Signed-off-by: bot') END)
        AS message FROM documents""")
def commit_message(t):
    body = F.when(F.col("doc_id") % 3 == 0, " \n").otherwise(F.col("text"))
    breaking = F.when(F.col("doc_id") % 4 == 0, " gone ")
    message = P.commit_message(F.lit("fix: x"), body, breaking, "Signed-off-by: bot")
    return t.documents.select("doc_id", message.alias("message"))


COMMITS = """
    SELECT doc_id % 100 AS plan, CAST(floor(doc_id / 100) AS BIGINT) AS commit_ix, concat('s', doc_id) AS subject,
        CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS body, concat('h', doc_id) AS hunk,
        CASE WHEN doc_id % 2 = 0 THEN concat('note', doc_id % 4) ELSE '' END AS note FROM {documents}"""


@query("c12_merge_commits", oracle="""
    WITH c AS (SELECT doc_id % 100 AS plan, CAST(floor(doc_id / 100) AS BIGINT) AS commit_ix, doc_id, text,
                   concat('s', CAST(doc_id AS STRING)) AS subject, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS body,
                   concat('h', CAST(doc_id AS STRING)) AS hunk, CASE WHEN doc_id % 2 = 0 THEN
                   concat('note', CAST(doc_id % 4 AS STRING)) ELSE '' END AS note FROM documents),
    m AS (SELECT a.plan, a.commit_ix, a.subject, concat_ws(concat(chr(10), chr(10)), nullif(a.body, ''),
              nullif(b.body, '')) AS body, concat(a.hunk, ',', b.hunk) AS hunks, CASE WHEN a.note <> '' AND b.note <> ''
              AND a.note <> b.note THEN concat(a.note, '; ', b.note) WHEN a.note <> '' THEN a.note ELSE b.note END AS note
          FROM c a JOIN c b ON a.plan = b.plan AND a.commit_ix = 1 AND b.commit_ix = 4 AND a.plan % 2 = 0)
    SELECT plan, commit_ix, subject, md5(body) AS body_md5, hunks, note FROM m
    UNION ALL SELECT plan, commit_ix, subject, md5(body), hunk, note FROM c
    WHERE NOT (plan % 2 = 0 AND commit_ix IN (1, 4) AND EXISTS (SELECT 1 FROM m WHERE m.plan = c.plan))""")
def merge_commits(t):
    issues = F.array().cast("array<struct<message:string,path:string>>")
    commits = t.sql(COMMITS).select("plan", "commit_ix", F.struct(
        "subject", "body", F.array("hunk").alias("hunks"), issues.alias("issues"),
        F.col("note").alias("breaking_change")).alias("commit"))
    pairs = commits.where("plan % 2 = 0").select("plan").distinct().select("plan", F.lit(4).alias("a"), F.lit(1).alias("b"))
    out = P.merge_commits(commits, pairs)
    return out.select("plan", "commit_ix", "commit.subject", F.md5("commit.body").alias("body_md5"),
                      F.array_join("commit.hunks", ",").alias("hunks"), F.col("commit.breaking_change").alias("note"))


@query("c13_edited_message", oracle="""
    SELECT doc_id, regexp_replace(CASE WHEN p > 0 THEN substr(m, 1, p - 1) ELSE m END, '^\\s+|\\s+$', '', 'g') AS subject,
        CASE WHEN p > 0 THEN regexp_replace(substr(m, p + 2), '^\\s+|\\s+$', '', 'g') ELSE '' END AS body
    FROM (SELECT doc_id, m, position(concat(chr(10), chr(10)) IN m) AS p FROM (
        SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, '. ', concat('.', chr(10), chr(10))) ELSE text END AS m
        FROM documents) x) y""")
def edited_message(t):
    text = F.when(F.col("doc_id") % 2 == 0, F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n"))).otherwise(F.col("text"))
    return t.documents.select("doc_id", P.edited_message(text).alias("m")).select("doc_id", "m.subject", "m.body")


@query("c14_new_patterns", oracle="""
    SELECT x.ex_id, x.path AS pattern FROM {ex_files} x WHERE NOT EXISTS (
        SELECT 1 FROM {ex_files} y WHERE y.ex_id = x.ex_id + 1 AND y.path = x.path AND y.path NOT LIKE '%.log')""")
def new_patterns(t):
    existing = t.ex_files.select((F.col("ex_id") - 1).alias("ex_id"), F.when(
        F.col("path").endswith(".log"), F.concat(F.lit("# "), F.col("path"))).otherwise(
        F.concat(F.lit("  "), F.col("path"), F.lit(" "))).alias("line"))
    return P.new_patterns(t.ex_files.withColumnRenamed("path", "pattern"), existing, ["ex_id"])


@query("c15_plan_counts", oracle="""
    SELECT ex_id % 50 AS plan, count(DISTINCT hunk_id) AS n_hunks, count(DISTINCT file_path) AS n_files FROM {hunks}
    GROUP BY ex_id % 50""")
def plan_counts(t):
    return P.plan_counts(t.hunks.withColumn("plan", F.col("ex_id") % 50))
