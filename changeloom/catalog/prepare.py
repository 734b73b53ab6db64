"""Preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.catalog.label import FILE_LIST_CTE, KEY_SQL, USER_SQL, draw_ctes, records
from changeloom.catalog.registry import query
from changeloom.catalog.views import SPOKEN, ascii_sql
from changeloom.functions import constants as K
from changeloom.functions.jsontext import commit_list_error, extract_json_object
from changeloom.functions.text import truncate
from changeloom.operators import label as L
from changeloom.operators import prepare as P
from changeloom.sources import tables as S


def labelled(t):
    """Records with a label where a labels row exists; toxic ones have no commits."""
    issues = "array<struct<message:string,path:string>>"
    commit = F.struct(F.when(F.col("quality") == 1, "feat: add").otherwise("fix: mend").alias("subject"),
                      F.col("changed_files").alias("files"), F.lit("body").alias("body"),
                      F.array().cast(issues).alias("issues"))
    commits = F.when(F.col("toxic") == 0, F.array(commit))
    label = F.struct(commits.alias("commits"), F.array(F.lit("*.tmp"), F.lit(".DS_Store")).alias("gitignore"))
    return records(t).withColumn("label", F.when(F.col("quality").isNotNull(), label)).withColumn(
        "noise_injected", F.col("ex_id") % 3 == 0)


@query("p1_sft_triple", oracle=f"""
    WITH {FILE_LIST_CTE},
    js AS (SELECT ex_id, string_agg(concat('"', path, '"'), ',' ORDER BY path) AS files FROM {{ex_files}} GROUP BY ex_id)
    SELECT e.ex_id, 'system,user,assistant' AS roles, {USER_SQL} CASE WHEN length(e.diff) > 30000
            THEN concat(substr(e.diff, 1, 30000), chr(10), chr(10), '... (diff truncated at 30000 chars)') ELSE e.diff
            END) AS user_text,
        concat('{{"commits":[{{"subject":"', CASE WHEN quality = 1 THEN 'feat: add' ELSE 'fix: mend' END,
            '","files":[', coalesce(js.files, ''), '],"body":"body","issues":[]}}],"gitignore":["*.tmp",".DS_Store"]}}')
            AS assistant_text
    FROM {{examples}} e LEFT JOIN fl ON e.ex_id = fl.ex_id LEFT JOIN js ON js.ex_id = e.ex_id
    WHERE quality IS NOT NULL AND toxic = 0""".replace("{{\"", "{\"").replace("}}]", "}]").replace("]}}", "]}"))
def sft_triple(t):
    out = labelled(t).where(P.label_problem().isNull()).select("ex_id", P.sft_messages().alias("m"))
    return out.select("ex_id", F.array_join("m.role", ",").alias("roles"), F.col("m")[1]["content"].alias("user_text"),
                      F.col("m")[2]["content"].alias("assistant_text"))


@query("p1_assistant_from_json", oracle="""
    SELECT ex_id, CASE WHEN kind = 6 THEN '{"commits":[],"gitignore":[]}' ELSE obj END AS assistant_text FROM {answers}
    WHERE problem IS NULL OR problem = 'empty'""")
def assistant_from_json(t):
    found = extract_json_object(t.answers.select("ex_id", F.col("content").alias("text")), "text")
    usable = found.where(F.col("raw_json").isNotNull() & commit_list_error("raw_json", allow_empty=True).isNull())
    return usable.select("ex_id", P.assistant_text_of_json("raw_json").alias("assistant_text"))


@query("p1_ascii_answer", oracle=f"""
    SELECT doc_id, md5(concat('{{"commits":[{{"subject":"docs: ', lang, '","files":["', lang, '.md"],"body":"', {ascii_sql('plain')},
        '","issues":[]}}],"gitignore":[]}}')) AS answer_md5
    FROM (SELECT doc_id, lang, plain FROM documents JOIN ({SPOKEN}) s USING (doc_id)) d WHERE lang IS NOT NULL AND plain IS NOT NULL""")
def ascii_answer(t):
    texts = t.sql(SPOKEN.replace("SELECT doc_id", "SELECT doc_id, lang").replace("FROM documents", "FROM {documents}"))
    commit = F.struct(F.concat(F.lit("docs: "), F.col("lang")).alias("subject"), F.array(F.concat("lang", F.lit(".md"))).alias("files"),
                      F.col("plain").alias("body"), F.array().cast("array<struct<message:string,path:string>>").alias("issues"))
    label = F.struct(F.array(commit).alias("commits"), F.array().cast("array<string>").alias("gitignore"))
    usable = texts.where("lang IS NOT NULL AND plain IS NOT NULL").select("doc_id", label.alias("label"), F.array().cast(
        "array<string>").alias("changed_files"), F.lit("").alias("diff"))
    answer = P.sft_messages(ascii_only=True)[2]["content"]
    return usable.select("doc_id", F.md5(answer).alias("answer_md5"))


@query("p2_truncate", oracle="""
    SELECT ex_id, CASE WHEN length(diff) > 1500 THEN concat(substr(diff, 1, 1500), chr(10), chr(10),
        '... (diff truncated at 1500 chars)') ELSE diff END AS shown FROM {examples}""")
def truncate_diff(t):
    return t.examples.select("ex_id", truncate("diff", 1500, "\n\n... (diff truncated at 1500 chars)").alias("shown"))


@query("p3_augment", oracle=f"""
    WITH clean AS (SELECT e.*, v.variant, concat({KEY_SQL}, ':', CAST(v.variant AS STRING)) AS vkey
              FROM {{examples}} e JOIN (SELECT unnest([0, 1]) AS variant) v ON TRUE
              WHERE ex_id % 3 <> 0 AND quality IS NOT NULL AND toxic = 0),
    {draw_ctes(K.AUGMENT_NOISE, 'vkey', 'clean')},
    r AS (SELECT DISTINCT ex_id, variant, rule FROM (SELECT ex_id, variant, rule FROM kept
          UNION ALL SELECT ex_id, variant, '*.tmp' FROM kept UNION ALL SELECT ex_id, variant, '.DS_Store' FROM kept) u),
    ra AS (SELECT ex_id, variant, string_agg(rule, ';' ORDER BY rule) AS rules FROM r GROUP BY ex_id, variant)
    SELECT k.ex_id, k.variant, string_agg(path, ';' ORDER BY j) AS injected_files, ra.rules,
        md5(concat(min(diff), chr(10), string_agg(junk, chr(10) ORDER BY j))) AS diff_md5
    FROM kept k JOIN ra ON k.ex_id = ra.ex_id AND k.variant = ra.variant GROUP BY k.ex_id, k.variant, ra.rules""")
def augment(t):
    out = P.augment(labelled(t).where(P.label_problem().isNull()), variants=2)
    return out.select("ex_id", "variant", F.array_join("injected_files", ";").alias("injected_files"),
                      F.array_join("label.gitignore", ";").alias("rules"), F.md5("diff").alias("diff_md5"))


@query("p4_bad_labels", oracle="""
    SELECT CASE WHEN quality IS NULL THEN 'no_label' WHEN toxic = 1 THEN 'no_commits' ELSE 'usable' END AS problem,
        count(*) AS n FROM {examples} GROUP BY 1""")
def bad_labels(t):
    return labelled(t).groupBy(F.coalesce(P.label_problem(), F.lit("usable")).alias("problem")).agg(
        F.count(F.lit(1)).alias("n"))


SPLIT_CTES = f"""
    base AS (SELECT *, {KEY_SQL} AS example_key, concat(language, ':', repo_url) AS stratum FROM {{examples}}
             WHERE ex_id % 5 <> 4),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat('42:', example_key)), example_key)
                   AS k, count(*) OVER (PARTITION BY stratum) AS n FROM base),
    split AS (SELECT example_key, ex_id, CASE WHEN n > 1 AND k <= greatest(1, round_even(n * 0.1, 0)) THEN 'val'
                  ELSE 'train' END AS split FROM ranked)"""


def _split(t):
    keyed = records(t).withColumn("stratum", P.stratum()).withColumn("is_augmented", F.col("ex_id") % 5 == 4)
    return P.stratified_split(keyed, augmented="is_augmented")


@query("p5_stratified_split", oracle=f"""
    WITH {SPLIT_CTES}
    SELECT example_key, split FROM split
    UNION ALL SELECT {KEY_SQL}, 'train' FROM {{examples}} WHERE ex_id % 5 = 4""")
def stratified_split(t):
    return _split(t).select("example_key", "split")


@query("p6_seeded_order", oracle=f"""
    SELECT ex_id, row_number() OVER (ORDER BY md5(concat('42:', {KEY_SQL}))) - 1 AS shuffle_pos FROM {{examples}}""")
def seeded_order(t):
    keyed = t.examples.select("ex_id", L.example_key().alias("example_key"))
    return P.seeded_order(keyed).select("ex_id", "shuffle_pos")


@query("p7_strip_metadata", oracle="SELECT ex_id, md5(diff) AS messages FROM {examples}")
def strip_metadata(t):
    return P.strip_metadata(t.examples.select(
        "ex_id", F.md5("diff").alias("messages"), F.array("language").alias("languages"), "repo_url",
        F.lit(False).alias("is_augmented")))


@query("p8_render_chat", oracle="""
    SELECT conv_id, turn, concat('<|im_start|>', role, chr(10), text, '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10),
        'ok<|im_end|>', chr(10)) AS text FROM conversations""")
def render_chat(t):
    messages = F.array(F.struct("role", F.col("text").alias("content")), L.message("assistant", F.lit("ok")))
    return t.conversations.select("conv_id", "turn", P.render_chat(messages).alias("text"))


@query("p9_pack_plan", oracle="""
    WITH s AS (SELECT conv_id * 1000 + turn AS seq, CAST(floor(length(text) / 4) AS BIGINT) AS n_tokens
               FROM conversations),
    c AS (SELECT *, coalesce(sum(n_tokens) OVER (ORDER BY md5(concat('42:', CAST(seq AS STRING))), seq
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM s)
    SELECT seq, n_tokens, CAST(floor(st / 1024) AS BIGINT) AS pack_id, CAST(st % 1024 AS BIGINT) AS pack_offset FROM c""")
def pack_plan(t):
    sequences = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
                                       F.floor(F.length("text") / 4).cast("bigint").alias("n_tokens"))
    return P.pack_plan(sequences, key="seq", length=1024)


@query("p10_prep_counters", oracle=f"""
    WITH {SPLIT_CTES}
    SELECT (SELECT count(*) FROM base) AS loaded, CAST((SELECT count_if(quality IS NULL OR toxic = 1) FROM base) AS BIGINT) AS skipped,
        (SELECT count(*) FROM {{examples}} WHERE ex_id % 5 = 4) AS augmented,
        CAST((SELECT count_if(split = 'train') FROM split) + (SELECT count(*) FROM {{examples}} WHERE ex_id % 5 = 4)
            AS BIGINT) AS train,
        CAST((SELECT count_if(split = 'val') FROM split) AS BIGINT) AS val""")
def prep_counters(t):
    state = labelled(t).select("example_key", P.label_problem().alias("problem"),
                               (F.col("ex_id") % 5 == 4).alias("is_augmented"))
    return P.prep_counters(state.join(_split(t), "example_key"))


@query("p10_written_counters", oracle=f"""
    WITH {SPLIT_CTES}
    SELECT (SELECT count(*) FROM base) AS loaded, CAST((SELECT count_if(quality IS NULL OR toxic = 1) FROM base) AS BIGINT) AS skipped,
        (SELECT count(*) FROM {{examples}} WHERE ex_id % 5 = 4) AS augmented,
        CAST((SELECT count_if(split = 'train') FROM split) + (SELECT count(*) FROM {{examples}} WHERE ex_id % 5 = 4)
            AS BIGINT) AS train,
        CAST((SELECT count_if(split = 'val') FROM split) AS BIGINT) AS val""")
def written_counters(t):
    """The counters of p10, taken while the rows are written."""
    state = labelled(t).select("example_key", P.label_problem().alias("problem"), (F.col("ex_id") % 5 == 4).alias("is_augmented"))
    return S.write_counted(state.join(_split(t), "example_key"), S.scratch_path(t.spark, "prepared"), **P.counters())


@query("p11_leakage_check", oracle=f"""
    WITH {SPLIT_CTES.replace("WHERE ex_id % 5 <> 4", "WHERE quality IS NOT NULL AND toxic = 0")}
    SELECT example_key AS base_key FROM split WHERE split = 'val' AND ex_id % 3 <> 0""")
def leakage_check(t):
    usable = labelled(t).where(P.label_problem().isNull()).withColumn("stratum", P.stratum())
    # A path that no template has leaves every draw in place, so each clean example gets its variant.
    fresh = usable.withColumn("changed_files", F.array(F.lit("only.txt")))
    prepared = P.split_then_augment(fresh, reference_compat=True)
    return P.leaked_keys(prepared.withColumnRenamed("example_key", "base_key"))


@query("p11_no_leakage", oracle="SELECT repo_url AS base_key FROM {examples} WHERE FALSE")
def no_leakage(t):
    usable = labelled(t).where(P.label_problem().isNull()).withColumn("stratum", P.stratum())
    prepared = P.split_then_augment(usable)
    return P.leaked_keys(prepared.withColumnRenamed("example_key", "base_key"))
