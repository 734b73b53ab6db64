"""Labelling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.catalog.registry import query
from changeloom.functions import constants as K
from changeloom.functions.jsontext import commit_list_error, extract_json_object
from changeloom.operators import history as H
from changeloom.operators import label as L

KEY_SQL = "concat(repo_url, '@', base_commit, '..', head_commit)"


def records(t):
    """Examples with key, changed files and, where a labels row exists, a label."""
    files = t.ex_files.groupBy("ex_id").agg(
        F.sort_array(F.collect_set("path")).alias("changed_files"))
    empty = F.array().cast("array<string>")
    return (
        t.examples.join(files, "ex_id", "left")
        .withColumn("example_key", L.example_key())
        .withColumn("changed_files", F.coalesce("changed_files", empty))
        .withColumn("languages", F.array("language"))
    )


def sql_text(value):
    """SQL literal of a text, with line breaks as chr(10)."""
    if value is None:
        return "NULL"
    return "concat(" + ", chr(10), ".join("'" + part.replace("'", "''") + "'" for part in value.split("\n")) + ")"


def junk_text(path, kind, body):
    out = f"diff --git a/{path} b/{path}\nnew file mode 100644\nindex 0000000..deadbeef\n"
    if kind == "binary":
        return out + f"Binary files /dev/null and b/{path} differ\n"
    added = body.rstrip("\n").split("\n")
    return out + f"--- /dev/null\n+++ b/{path}\n@@ -0,0 +1,{len(added)} @@\n" + "".join(f"+{x}\n" for x in added)


def template_values(templates):
    return ",\n".join(
        f"({i}, '{t[0]}', {sql_text(junk_text(*t[:3]))}, {sql_text(t[3] if len(t) > 3 else None)})"
        for i, t in enumerate(templates))


def draw_ctes(templates, key_sql, source):
    """Seeded draws in SQL: one row per kept noise file."""
    return f"""
    tpl(ix, path, junk, rule) AS (VALUES {template_values(templates)}),
    src AS (SELECT *, 1 + CAST(concat('0x', substr(md5(concat('42:', {key_sql}, ':count')), 1, 8)) AS BIGINT) % 3 AS n
            FROM {source}),
    drawn AS (SELECT src.*, j.j, CAST(concat('0x', substr(md5(concat('42:', {key_sql}, ':draw', CAST(j.j AS STRING))),
                  1, 8)) AS BIGINT) % {len(templates)} AS ix
              FROM src JOIN (SELECT unnest([1, 2, 3]) AS j) j ON j.j <= src.n),
    firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key_sql}, ix ORDER BY j) AS dup FROM drawn) d
               WHERE dup = 1),
    kept AS (SELECT f.*, t.path, t.junk, t.rule FROM firsts f JOIN tpl t ON f.ix = t.ix
             WHERE NOT EXISTS (SELECT 1 FROM {{ex_files}} x WHERE x.ex_id = f.ex_id AND x.path = t.path))"""


@query("flagship_split_counts", oracle="""
    WITH keyed AS (SELECT DISTINCT h.example_key, h.repo_url, h.language, e.quality, e.toxic FROM {harvested} h
                   JOIN {examples} e ON h.ex_id = e.ex_id),
    good AS (SELECT example_key, concat(language, ':', repo_url) AS stratum, language FROM keyed
             WHERE quality IS NOT NULL AND toxic = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat('42:', example_key)), example_key) AS k,
              count(*) OVER (PARTITION BY stratum) AS n FROM good),
    s AS (SELECT language, CASE WHEN n > 1 AND k <= greatest(1, round_even(n * 0.1, 0)) THEN 'val' ELSE 'train' END
              AS split FROM r
          UNION ALL SELECT language, 'pending' FROM keyed WHERE quality IS NULL
          UNION ALL SELECT language, 'bad_label' FROM keyed WHERE quality IS NOT NULL AND toxic = 1)
    SELECT split, language, count(*) AS n FROM s GROUP BY split, language""")
def flagship(t):
    from changeloom.plans.flows import split_counts

    examples = t.sql("SELECT h.*, h.draw AS input_pos FROM {harvested} h")
    labels = t.sql("""
        SELECT concat(repo_url, '@', base_commit, '..', head_commit) AS example_key,
            named_struct('commits', CASE WHEN toxic = 0 THEN array(named_struct('subject', 'fix: x')) END) AS label
        FROM {examples} WHERE quality IS NOT NULL""")
    return split_counts(examples, labels)


@query("l1_example_key", oracle=f"SELECT ex_id, {KEY_SQL} AS example_key FROM {{examples}}")
def example_key(t):
    return t.examples.select("ex_id", L.example_key().alias("example_key"))


def _labels(t):
    return t.examples.select(L.example_key().alias("example_key"), F.col("quality").alias("label"))


@query("l2_pending", oracle="""
    SELECT h.ex_id, h.example_key FROM {harvested} h JOIN {examples} e ON h.ex_id = e.ex_id
    WHERE h.draw = 0 AND e.quality IS NULL""")
def pending(t):
    examples = t.sql("SELECT *, ex_id * 2 + draw AS input_pos FROM {harvested}")
    return L.pending_examples(examples, _labels(t)).select("ex_id", "example_key")


@query("l2_pending_limited", oracle="""
    SELECT h.ex_id, h.example_key FROM {harvested} h JOIN {examples} e ON h.ex_id = e.ex_id
    WHERE h.draw = 0 AND e.quality IS NULL ORDER BY h.ex_id LIMIT 100""")
def pending_limited(t):
    examples = t.sql("SELECT *, ex_id * 2 + draw AS input_pos FROM {harvested}")
    return L.pending_examples(examples, _labels(t), limit=100).select("ex_id", "example_key")


@query("l3_noise_draw", oracle=f"""
    SELECT ex_id, substr(md5(concat('42:', {KEY_SQL}, ':noise')), 1, 8) < '{int(0.3 * 2**32):08x}' AS noisy
    FROM {{examples}}""")
def noise_draw(t):
    return t.examples.select("ex_id", L.draws_noise(L.example_key()).alias("noisy"))


@query("l4_inject_noise", oracle=f"""
    WITH e0 AS (SELECT *, {KEY_SQL} AS example_key FROM {{examples}}),
    noisy AS (SELECT * FROM e0 WHERE substr(md5(concat('42:', example_key, ':noise')), 1, 8)
              < '{int(0.3 * 2**32):08x}'),
    {draw_ctes(K.LABEL_NOISE, 'example_key', 'noisy')},
    agg AS (SELECT ex_id, string_agg(path, ';' ORDER BY j) AS paths, string_agg(junk, chr(10) ORDER BY j) AS junk
            FROM kept GROUP BY ex_id),
    fl AS (SELECT ex_id, string_agg(path, ';' ORDER BY path) AS files FROM {{ex_files}} GROUP BY ex_id)
    SELECT e.ex_id, a.ex_id IS NOT NULL AS noise_injected, coalesce(a.paths, '') AS injected_files,
        concat(coalesce(fl.files, ''), CASE WHEN fl.ex_id IS NOT NULL AND a.ex_id IS NOT NULL THEN ';' ELSE '' END,
            coalesce(a.paths, '')) AS changed_files,
        md5(CASE WHEN a.ex_id IS NULL THEN diff ELSE concat(diff, chr(10), a.junk) END) AS diff_md5
    FROM e0 e LEFT JOIN agg a ON e.ex_id = a.ex_id LEFT JOIN fl ON fl.ex_id = e.ex_id""")
def inject_noise(t):
    out = L.inject_noise(records(t))
    return out.select("ex_id", "noise_injected", F.array_join("injected_files", ";").alias("injected_files"),
                      F.array_join("changed_files", ";").alias("changed_files"), F.md5("diff").alias("diff_md5"))


@query("l5_junk_diff", oracle="""
    SELECT path, concat('diff --git a/', path, ' b/', path, chr(10), 'new file mode 100644', chr(10),
        'index 0000000..deadbeef', chr(10), CASE WHEN path LIKE '%.pyc'
        THEN concat('Binary files /dev/null and b/', path, ' differ', chr(10))
        ELSE concat('--- /dev/null', chr(10), '+++ b/', path, chr(10), '@@ -0,0 +1,2 @@', chr(10), '+', path, chr(10),
            '+end', chr(10)) END) AS junk
    FROM (SELECT DISTINCT path FROM {paths}) p""")
def junk_diff(t):
    kind = F.when(F.col("path").endswith(".pyc"), "binary").otherwise("text")
    body = F.concat(F.col("path"), F.lit("\nend\n"))
    return t.paths.select("path").distinct().select("path", L.junk_diff(F.col("path"), kind, body).alias("junk"))


USER_SQL = f"""concat({sql_text('Sample Output:' + chr(10) + L.LABEL_PROMPT.sample_text + chr(10) * 2 + 'Changed files:'
                                + chr(10))}, coalesce(fl.files, ''), chr(10), chr(10), 'Diffs:', chr(10), """
FILE_LIST_CTE = """fl AS (SELECT ex_id, string_agg(concat('  - ', path), chr(10) ORDER BY path) AS files
        FROM {ex_files} GROUP BY ex_id)"""


@query("l6_build_messages", oracle=f"""
    WITH {FILE_LIST_CTE}
    SELECT e.ex_id, 'system,user' AS roles, {len(L.LABEL_PROMPT.system)} AS system_chars,
        {USER_SQL} e.diff) AS user_text
    FROM {{examples}} e LEFT JOIN fl ON e.ex_id = fl.ex_id""")
def build_messages(t):
    out = records(t).select("ex_id", L.build_messages().alias("m"))
    return out.select("ex_id", F.array_join("m.role", ",").alias("roles"),
                      F.length(F.col("m")[0]["content"]).alias("system_chars"),
                      F.col("m")[1]["content"].alias("user_text"))


@query("l7_request_body", oracle="""
    SELECT ex_id, 'teacher' AS model, CAST(0.2 AS DOUBLE) AS temperature, 4096 AS max_tokens,
        CASE WHEN ex_id % 2 = 0 THEN 'high' END AS effort, ex_id % 2 = 0 AS has_effort, md5(diff) AS diff_md5
    FROM {examples}""")
def request_body(t):
    messages = F.array(L.message("user", F.col("diff")))
    body = F.when(F.col("ex_id") % 2 == 0, L.request_body(messages, "teacher", effort="high")).otherwise(
        L.request_body(messages, "teacher"))
    get = F.get_json_object
    return t.examples.select("ex_id", body.alias("b")).select(
        "ex_id", get("b", "$.model").alias("model"), get("b", "$.temperature").cast("double").alias("temperature"),
        get("b", "$.max_completion_tokens").cast("int").alias("max_tokens"),
        get("b", "$.reasoning_effort").alias("effort"), F.contains("b", F.lit("reasoning_effort")).alias("has_effort"),
        F.md5(get("b", "$.messages[0].content")).alias("diff_md5"))


@query("l8_response_content", oracle="SELECT ex_id, content FROM {responses}")
def response_content(t):
    return t.responses.select("ex_id", L.response_content("response").alias("content"))


@query("l9_extract_json_object", oracle="""
    SELECT ex_id, 'answer' AS source, expected AS raw_json,
        CASE WHEN problem IN ('none', 'incomplete') THEN problem END AS json_error FROM {answers}
    UNION ALL SELECT page_id, 'page', regexp_extract(html, '\\{[^{}"]*\\}'), NULL FROM {pages}""")
def extract(t):
    texts = t.sql("""
        SELECT ex_id, 'answer' AS source, content AS text FROM {answers}
        UNION ALL SELECT page_id, 'page', html FROM {pages}""")
    return extract_json_object(texts, "text").select("ex_id", "source", "raw_json", "json_error")


@query("l10_label_validation", oracle="""
    SELECT ex_id, CASE WHEN problem IN ('not_a_list', 'empty', 'invalid') THEN problem END AS label_error,
        CASE WHEN problem IN ('not_a_list', 'invalid') THEN problem END AS eval_error
    FROM {answers} WHERE expected IS NOT NULL""")
def label_validation(t):
    found = extract_json_object(t.answers.select("ex_id", F.col("content").alias("text")), "text").where("raw_json IS NOT NULL")
    return found.select("ex_id", commit_list_error("raw_json").alias("label_error"),
                        commit_list_error("raw_json", allow_empty=True).alias("eval_error"))


def _attempts(t):
    parsed = L.parse_responses(t.responses)
    tries = F.explode(F.sequence(F.lit(1), (F.col("ex_id") % 3 + 1).cast("int")))
    return parsed.withColumn("attempt", tries).withColumn(
        "example_key", F.concat(F.lit("k"), F.col("ex_id").cast("string"))).withColumn(
        "messages", F.array(L.message("user", F.lit("go"))))


@query("l11_retry_set", oracle="""
    SELECT concat('k', CAST(ex_id AS STRING)) AS example_key, CAST(ex_id % 3 + 2 AS INT) AS attempt, 2 AS n_messages,
        concat('The last answer was not usable JSON: ', problem, ' | content: ', substr(content, 1, 300), chr(10),
            'Answer with one JSON object that matches the schema, without explanation or markdown.') AS last_turn
    FROM {answers} WHERE problem IS NOT NULL AND ex_id % 3 + 1 < 3""")
def retry_set(t):
    return L.retry_requests(_attempts(t)).select(
        "example_key", "attempt", F.size("messages").alias("n_messages"),
        F.element_at("messages", -1)["content"].alias("last_turn"))


@query("l12_attach_label", oracle="""
    SELECT e.ex_id, 1 AS n_commits_in_label, concat('src/f', CAST(e.ex_id AS STRING), '.py;README.md') AS files,
        '*.pyc' AS rules, 'teacher' AS model, e.ex_id % 1000 AS prompt_tokens,
        CASE WHEN e.ex_id % 7 = 0 THEN 0 ELSE e.ex_id % 77 END AS completion_tokens
    FROM {examples} e JOIN {responses} r ON e.ex_id = r.ex_id WHERE r.problem IS NULL""")
def attach_label(t):
    keyed = t.examples.select("ex_id", L.example_key().alias("example_key"))
    parsed = L.parse_responses(t.responses).join(keyed, "ex_id").drop("ex_id")
    out = L.attach_labels(keyed, parsed, "teacher")
    return out.select("ex_id", F.size("label.commits").alias("n_commits_in_label"),
                      F.array_join(F.col("label.commits")[0]["files"], ";").alias("files"),
                      F.array_join("label.gitignore", ";").alias("rules"), "label.model",
                      "label.usage.prompt_tokens", "label.usage.completion_tokens")


@query("l13_progress", oracle="""
    SELECT user_id % 5 AS model, CAST(count_if(event_type <> 'error') AS BIGINT) AS ok,
        CAST(count_if(event_type = 'error') AS BIGINT) AS failed,
        round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM events) * 100, 6) AS pct,
        CAST(sum(CASE WHEN event_type <> 'error' THEN floor(value) ELSE 0 END) AS BIGINT) AS total_tokens
    FROM events GROUP BY user_id % 5""")
def progress(t):
    attempts = t.events.select((F.col("user_id") % 5).alias("model"), (F.col("event_type") != "error").alias("ok"),
                               F.floor("value").alias("tokens"))
    return L.progress(attempts, t.events, ["model"]).withColumn("pct", F.round("pct", 6))


@query("l14_dry_run_counts", oracle="""
    SELECT count(*) AS total, count(DISTINCT CASE WHEN e.quality IS NOT NULL THEN h.example_key END) AS labelled,
        CAST(count_if(e.quality IS NULL) AS BIGINT) AS to_label
    FROM {harvested} h JOIN {examples} e ON h.ex_id = e.ex_id""")
def dry_run_counts(t):
    return L.dry_run_counts(t.harvested, _labels(t))
