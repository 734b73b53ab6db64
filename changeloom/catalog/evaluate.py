"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.catalog.label import KEY_SQL
from changeloom.catalog.prepare import labelled
from changeloom.catalog.registry import query
from changeloom.operators import evaluate as E
from changeloom.operators import history as H

F1_CTES = """
    lab AS (SELECT DISTINCT ex_id, label_ix, file FROM g), pre AS (SELECT DISTINCT ex_id, pred_ix, file FROM g),
    pairs AS (SELECT l.ex_id, l.label_ix, p.pred_ix, (SELECT count(*) FROM lab a JOIN pre b ON a.ex_id = b.ex_id
                  AND a.file = b.file WHERE a.ex_id = l.ex_id AND a.label_ix = l.label_ix AND b.pred_ix = p.pred_ix)
                  AS both_n, l.n AS nl, p.n AS np
              FROM (SELECT ex_id, label_ix, count(*) AS n FROM lab GROUP BY 1, 2) l
              JOIN (SELECT ex_id, pred_ix, count(*) AS n FROM pre GROUP BY 1, 2) p ON l.ex_id = p.ex_id),
    best AS (SELECT ex_id, label_ix, max(CAST(both_n AS DOUBLE) / (nl + np - both_n)) AS s FROM pairs GROUP BY 1, 2),
    f1 AS (SELECT ex_id, avg(s) AS file_grouping_f1 FROM best GROUP BY ex_id)"""

TYPES = "CASE {0} % 5 WHEN 0 THEN 'feat(x): a' WHEN 1 THEN ' fix: b' WHEN 2 THEN 'Docs: c' WHEN 3 THEN 'chore(y)!: d' " \
        "ELSE 'plain text' END"
TYPE_OF = "CASE {0} % 5 WHEN 0 THEN 'feat' WHEN 1 THEN 'fix' WHEN 3 THEN 'chore' ELSE '' END"


@query("e1_commit_type", oracle="""
    SELECT ex_id, kind, CASE kind WHEN 0 THEN CASE ex_id % 3 WHEN 0 THEN 'feat' WHEN 1 THEN 'fix' ELSE 'docs' END
        ELSE regexp_extract(trim(replace(subject, chr(10), ' ')), '^([a-z]+)[(:]', 1) END AS type
    FROM (SELECT ex_id, 0 AS kind, '' AS subject FROM {answer_objects}
          UNION ALL SELECT o_orderkey, 1, concat(chr(10), lower(o_orderpriority), ': x') FROM {orders}
          UNION ALL SELECT o_orderkey, 2, concat(lower(o_orderstatus), '(', o_orderpriority, ') x') FROM {orders}) s""")
def commit_type(t):
    subjects = t.sql("""
        SELECT ex_id, 0 AS kind, get_json_object(obj, '$.commits[0].subject') AS subject FROM {answer_objects}
        UNION ALL SELECT o_orderkey, 1, concat(chr(10), lower(o_orderpriority), ': x') FROM {orders}
        UNION ALL SELECT o_orderkey, 2, concat(lower(o_orderstatus), '(', o_orderpriority, ') x') FROM {orders}""")
    return subjects.select("ex_id", "kind", E.commit_type("subject").alias("type"))


@query("e2_file_grouping_f1", oracle=f"""
    WITH g AS (SELECT * FROM {{grouping}}), {F1_CTES}
    SELECT ex_id, round(file_grouping_f1, 9) AS file_grouping_f1 FROM f1""")
def file_grouping_f1(t):
    out = E.grouping_f1(t.grouping, t.grouping)
    return out.select("ex_id", F.round("file_grouping_f1", 9).alias("file_grouping_f1"))


def nested(t):
    """Label and predicted commits of each example as arrays of (subject, files)."""
    def side(ix):
        return (t.grouping.groupBy("ex_id", ix).agg(F.collect_set(F.col("file").cast("string")).alias("files"))
                .withColumn("subject", F.expr(TYPES.format(f"(ex_id + {ix})")))
                .groupBy("ex_id").agg(F.collect_list(F.struct("subject", "files")).alias(ix)))

    return side("label_ix").join(side("pred_ix"), "ex_id")


@query("e2_nested_grouping_f1", oracle=f"""
    WITH g AS (SELECT * FROM {{grouping}}), {F1_CTES}
    SELECT ex_id, round(file_grouping_f1, 9) AS file_grouping_f1 FROM f1""")
def nested_grouping_f1(t):
    score = E.grouping_f1_of(F.col("pred_ix"), F.col("label_ix"))
    return nested(t).select("ex_id", F.round(score, 9).alias("file_grouping_f1"))


TYPE_CTES = f"""
    lt AS (SELECT DISTINCT ex_id, label_ix AS ix, {TYPE_OF.format('(ex_id + label_ix)')} AS ty FROM g),
    pt AS (SELECT DISTINCT ex_id, {TYPE_OF.format('(ex_id + pred_ix)')} AS ty FROM g),
    ta AS (SELECT lt.ex_id, avg(CASE WHEN lt.ty <> '' AND EXISTS (SELECT 1 FROM pt WHERE pt.ex_id = lt.ex_id
               AND pt.ty = lt.ty) THEN 1.0 ELSE 0.0 END) AS type_accuracy FROM lt GROUP BY lt.ex_id)"""


@query("e3_type_accuracy", oracle=f"""
    WITH g AS (SELECT * FROM {{grouping}}), {TYPE_CTES}
    SELECT ex_id, round(type_accuracy, 9) AS type_accuracy FROM ta""")
def type_accuracy(t):
    def side(ix):
        return t.grouping.select("ex_id", ix).distinct().withColumn(
            "subject", F.expr(TYPES.format(f"(ex_id + {ix})")))

    out = E.type_accuracy(side("label_ix"), side("pred_ix"))
    return out.select("ex_id", F.round("type_accuracy", 9).alias("type_accuracy"))


RULES = ["*.pyc", "build/", ".DS_Store", "*.min.js", "dist", "src/red/", ".env.local", "*lock/"]
RULE_ROWS = ", ".join(f"({i}, '{r}')" for i, r in enumerate(RULES))


@query("e4_is_gitignored", oracle=f"""
    WITH rules(k, rule) AS (VALUES {RULE_ROWS}),
    f AS (SELECT DISTINCT path FROM {{paths}}),
    m AS (SELECT f.path, CASE WHEN r.rule LIKE '*%' THEN ends_with(f.path, substr(r.rule, 2))
              WHEN r.rule LIKE '%/' THEN position(concat('/', r.rule) IN concat('/', f.path)) > 0
                  OR starts_with(f.path, substr(r.rule, 1, length(r.rule) - 1))
              ELSE f.path = r.rule OR ends_with(f.path, concat('/', r.rule)) END AS hit
          FROM f CROSS JOIN rules r)
    SELECT path, bool_or(hit) AS ignored FROM m GROUP BY path""")
def is_gitignored(t):
    rules = F.array(*[F.lit(r) for r in RULES])
    return t.paths.select("path").distinct().select("path", E.is_ignored(F.col("path"), rules).alias("ignored"))


@query("e5_junk_routing", oracle="""
    WITH inj AS (SELECT ex_id, path FROM {ex_files}),
    r AS (SELECT ex_id, path, CASE ex_id % 3 WHEN 0 THEN path LIKE '%.pyc' WHEN 1 THEN starts_with(path, 'build')
              OR path LIKE '%/build/%' ELSE path = '.DS_Store' END AS ignored FROM inj)
    SELECT ex_id, round(avg(CASE WHEN ignored AND NOT path LIKE '%1.%' THEN 1.0 ELSE 0.0 END), 9) AS junk_routing
    FROM r GROUP BY ex_id""")
def junk_routing(t):
    files = t.ex_files.groupBy("ex_id").agg(F.collect_set("path").alias("injected"))
    rules = F.array(F.expr("CASE ex_id % 3 WHEN 0 THEN '*.pyc' WHEN 1 THEN 'build/' ELSE '.DS_Store' END"))
    committed = F.filter("injected", lambda f: F.contains(f, F.lit("1.")))
    commits = F.array(F.struct(committed.alias("files")))
    return files.select("ex_id", F.round(E.junk_routing_of(commits, rules, F.col("injected")), 9).alias("junk_routing"))


def results(t):
    """Result rows of labelled examples, scored against the derived answers."""
    examples = labelled(t).where("quality IS NOT NULL AND toxic = 0").withColumn(
        "injected_files", F.when(F.col("noise_injected"), F.array(F.lit("a.pyc"), F.lit("README.md"))))
    predictions = E.prediction_status(t.answers.select("ex_id", "content"), "content").join(
        examples.select("ex_id", "example_key"), "ex_id").drop("ex_id")
    return E.result_rows(examples, predictions)


RESULT_CTES = f"""
    fl AS (SELECT ex_id, count(*) AS n FROM {{ex_files}} GROUP BY ex_id),
    res AS (
        SELECT {KEY_SQL} AS example_key, repo_url, language, e.ex_id % 3 = 0 AS noise_injected,
            coalesce(a.problem, '') IN ('', 'empty') AS parsed,
            CASE WHEN coalesce(a.problem, '') IN ('', 'empty') THEN CAST(0 AS DOUBLE) END AS file_grouping_f1,
            CAST(CASE WHEN a.problem IS NULL THEN CASE WHEN (CASE e.ex_id % 3 WHEN 0 THEN 'feat' WHEN 1 THEN 'fix' ELSE 'docs'
                END) = (CASE WHEN quality = 1 THEN 'feat' ELSE 'fix' END) THEN 1.0 ELSE 0.0 END
                WHEN a.problem = 'empty' THEN 0.0 END AS DOUBLE) AS type_accuracy,
            CAST(CASE WHEN e.ex_id % 3 = 0 THEN CASE WHEN a.problem IS NULL THEN 0.5 WHEN a.problem = 'empty' THEN 0.0
                END END AS DOUBLE) AS junk_routing
        FROM {{examples}} e JOIN {{answers}} a ON e.ex_id = a.ex_id LEFT JOIN fl ON fl.ex_id = e.ex_id
        WHERE quality IS NOT NULL AND toxic = 0)"""


@query("e6_result_rows", oracle=f"""
    WITH {RESULT_CTES}
    SELECT example_key, repo_url, language AS languages, noise_injected, parsed, file_grouping_f1, type_accuracy,
        junk_routing FROM res""")
def result_rows(t):
    return results(t).withColumn("languages", F.array_join("languages", ","))


@query("e7_report_totals", oracle=f"""
    WITH {RESULT_CTES}
    SELECT count(*) AS n, CAST(count_if(parsed) AS BIGINT) AS n_parsed, avg(CASE WHEN parsed THEN 1.0 ELSE 0.0 END) AS parse_rate,
        avg(file_grouping_f1) AS avg_file_grouping_f1, count(file_grouping_f1) AS n_file_grouping_f1,
        avg(type_accuracy) AS avg_type_accuracy, count(type_accuracy) AS n_type_accuracy,
        avg(junk_routing) AS avg_junk_routing, count(junk_routing) AS n_junk_routing FROM res""")
def report_totals(t):
    return E.report_totals(results(t))


@query("e8_report_by_language", oracle=f"""
    WITH {RESULT_CTES}
    SELECT language, count(*) AS n, avg(file_grouping_f1) AS avg_file_grouping_f1 FROM res WHERE parsed
    GROUP BY GROUPING SETS ((), (language))""")
def report_by_language(t):
    return E.report_by_language(results(t))


@query("e9_prediction_status", oracle="""
    SELECT ex_id, coalesce(problem, '') IN ('', 'empty') AS parsed FROM {answers}""")
def prediction_status(t):
    return E.prediction_status(t.answers.select("ex_id", "content")).select("ex_id", "parsed")


@query("e10_teacher_vs_history", oracle=f"""
    WITH g AS (SELECT DISTINCT l_orderkey AS ex_id, l_partkey AS file, l_linenumber % 3 AS label_ix,
                   l_suppkey % 3 AS pred_ix FROM {{lineitem}}), {F1_CTES}
    SELECT ex_id, round(file_grouping_f1, 9) AS file_grouping_f1 FROM f1""")
def teacher_vs_history(t):
    original = t.grouping.select("ex_id", F.col("pred_ix").alias("label_ix"), "file")
    teacher = t.grouping.select("ex_id", F.col("label_ix").alias("pred_ix"), "file")
    out = E.grouping_f1(original, teacher)
    return out.select("ex_id", F.round("file_grouping_f1", 9).alias("file_grouping_f1"))


@query("e11_publication_filter", oracle="""
    SELECT ex_id, repo_url FROM {examples} WHERE repo_url NOT IN
        (SELECT source FROM documents GROUP BY source HAVING max(doc_id) % 3 = 0)""")
def publication_filter(t):
    private = t.documents.groupBy(F.col("source").alias("repo_url")).agg(F.max("doc_id").alias("m")).where("m % 3 = 0")
    return E.publishable(t.examples.select("ex_id", "repo_url"), private)
