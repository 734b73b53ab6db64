"""Conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.catalog.registry import query
from changeloom.catalog.views import SPOKEN, ascii_sql
from changeloom.operators import conversations as M
from changeloom.plans import flows
from changeloom.sources import tables as S

STORE = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS msg_ix FROM {messages})"


def store(t):
    return M.append_ids(t.messages)


@query("m1_append_ids", oracle=f"""
    SELECT conv_id, turn, concat('m', CAST(msg_ix AS STRING)) AS msg_id FROM {STORE} s""")
def append_ids(t):
    return store(t).select("conv_id", "turn", "msg_id")


@query("m2_lookup", oracle=f"""
    SELECT s.conv_id, concat('m', CAST(s.msg_ix + 2 AS STRING)) AS msg_id, o.content
    FROM {STORE} s LEFT JOIN {STORE} o ON s.conv_id = o.conv_id AND o.msg_ix = s.msg_ix + 2""")
def lookup(t):
    messages = store(t)
    wanted = messages.select("conv_id", F.concat(F.lit("m"), (F.col("msg_ix") + 2).cast("string")).alias("msg_id"))
    return M.lookup(wanted, messages.select("conv_id", "msg_id", "content"))


@query("m3_root_original", oracle="""
    WITH RECURSIVE up AS (
        SELECT msg_id, msg_id AS at, parent_id FROM links
        UNION ALL SELECT u.msg_id, l.msg_id, l.parent_id FROM up u JOIN links l ON l.msg_id = u.parent_id)
    SELECT l.msg_id, u.at AS root_id FROM links l LEFT JOIN up u ON u.msg_id = l.msg_id AND u.parent_id IS NULL,
        (SELECT 1 FROM {links} LIMIT 1) one""")
def root_original(t):
    return M.root_originals(t.links).select("msg_id", "root_id")


@query("m4_last_messages", oracle=f"""
    SELECT conv_id, concat('m', CAST(msg_ix AS STRING)) AS msg_id, role FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY msg_ix DESC) AS k FROM {STORE} s
        WHERE role = 'user') x WHERE k <= 2""")
def last_messages(t):
    return M.last_messages(store(t), n=2, role="user").select("conv_id", "msg_id", "role")


@query("m5_count_messages", oracle="SELECT conv_id, count(*) AS n_messages FROM {messages} GROUP BY conv_id")
def count_messages(t):
    return M.count_messages(t.messages)


@query("m6_token_estimate", oracle="""
    SELECT conv_id, turn, length(content) // 4 AS estimated, length(content) - length(replace(content, ' ', '')) + 1
        AS counted FROM {messages}""")
def token_estimate(t):
    words = M.token_counter(lambda text: text.count(" ") + 1)
    return t.messages.select("conv_id", "turn", M.estimate_tokens("content").alias("estimated"),
                             words(F.col("content")).alias("counted"))


SPARSE = "(SELECT conv_id, turn, role, CASE WHEN turn % 5 <> 2 THEN content END AS content FROM {messages})"


@query("m7_conversation_size", oracle=f"""
    SELECT conv_id, CAST(sum(coalesce(length(content), 0)) AS BIGINT) AS n_chars,
        CAST(sum(coalesce(length(content), 0) // 4) AS BIGINT) AS n_tokens FROM {SPARSE} s GROUP BY conv_id""")
def conversation_size(t):
    return M.conversation_size(t.sql(f"SELECT * FROM {SPARSE}"))


@query("m8_compaction_candidates", oracle=f"""
    WITH s AS (SELECT conv_id, msg_ix, role, CASE WHEN msg_ix % 5 = 4 THEN '[Summarized x' ELSE content END AS content
               FROM {STORE} x),
    z AS (SELECT *, length(content) // 4 AS n_tokens, sum(length(content) // 4) OVER (PARTITION BY conv_id) AS total,
              max(CASE WHEN role = 'tool' THEN msg_ix END) OVER (PARTITION BY conv_id) AS lt FROM s),
    e AS (SELECT *, coalesce(sum(n_tokens - 30) OVER (PARTITION BY conv_id ORDER BY msg_ix ROWS BETWEEN UNBOUNDED
              PRECEDING AND 1 PRECEDING), 0) AS saved_before FROM z
          WHERE NOT starts_with(content, '[Summarized') AND n_tokens > 30
          AND ((role = 'tool' AND NOT (msg_ix = lt AND n_tokens <= 200)) OR (role = 'user' AND msg_ix = 1)))
    SELECT conv_id, msg_ix, role, n_tokens, CAST(saved_before AS BIGINT) AS saved_before FROM e
    WHERE total - saved_before > 300""")
def compaction_candidates(t):
    messages = store(t).withColumn("content", F.when(F.col("msg_ix") % 5 == 4, "[Summarized x").otherwise(F.col("content")))
    return M.compaction_candidates(messages, 300, summary_tokens=30, recent_tokens=200)


@query("m9_threshold_state", oracle="""
    SELECT conv_id, n_tokens, CASE WHEN n_tokens > CASE WHEN conv_id % 3 = 0 THEN 600 ELSE 900 END THEN 'hard'
        WHEN n_tokens > CASE WHEN conv_id % 2 = 0 THEN 400 ELSE 900 END THEN 'soft' ELSE 'ok' END AS state
    FROM (SELECT conv_id, CAST(sum(length(content) // 4) AS BIGINT) AS n_tokens FROM {messages} GROUP BY conv_id) s""")
def threshold_state(t):
    sizes = M.conversation_size(t.messages)
    return M.threshold_state(sizes, F.when(F.col("conv_id") % 2 == 0, 400), F.when(F.col("conv_id") % 3 == 0, 600),
                             F.lit(900)).select("conv_id", "n_tokens", "state")


@query("m10_pinned_split", oracle="""
    SELECT conv_id, turn, CASE WHEN position('. ' IN content) > 0 THEN substr(content, 1, position('. ' IN content) - 1)
        ELSE '' END AS pinned, CASE WHEN position('. ' IN content) > 0 THEN substr(content, position('. ' IN content))
        ELSE content END AS rest FROM {messages}""")
def pinned_split(t):
    return t.messages.select("conv_id", "turn", M.pinned_split("content", ". ").alias("p")).select(
        "conv_id", "turn", "p.pinned", "p.rest")


@query("m11_summary_acceptance", oracle="""
    WITH s AS (SELECT conv_id, turn, content, CASE WHEN turn % 3 = 0 THEN md5(content) ELSE concat(content, 'x!!!')
                   END AS a, CASE WHEN turn % 3 = 1 THEN concat(' ', CAST(length(content) AS STRING), ' ') ELSE content END AS b FROM {messages}),
    l AS (SELECT *, CASE WHEN length(trim(a)) // 4 < length(content) // 4 THEN 1
              WHEN length(trim(b)) // 4 < length(content) // 4 THEN 2 ELSE 3 END AS level FROM s)
    SELECT conv_id, turn, level, concat('pin', '[Summarized — id: ''m', CAST(turn AS STRING),
        '''. Use query_message to ask specific questions about the full output.]', chr(10), CASE level WHEN 1 THEN
        regexp_replace(a, '^\\s+|\\s+$', '', 'g') WHEN 2 THEN regexp_replace(b, '^\\s+|\\s+$', '', 'g') ELSE
        concat(substr(content, 1, 512), chr(10), '[Truncated — use query_message for full content]') END) AS content
    FROM l""")
def summary_acceptance(t):
    made = t.sql("""
        SELECT conv_id, turn, content, concat('m', turn) AS msg_id, CASE WHEN turn % 3 = 0 THEN md5(content)
            ELSE concat(content, 'x!!!') END AS a, CASE WHEN turn % 3 = 1 THEN concat(' ', CAST(length(content) AS STRING), ' ') ELSE content END AS b
        FROM {messages}""")
    chosen = M.accept_summary("msg_id", "content", "a", "b", F.lit("pin"))
    return made.select("conv_id", "turn", chosen.alias("s")).select("conv_id", "turn", "s.level", "s.content")


@query("m11_stored_summaries", oracle=f"""
    WITH s AS {STORE},
    z AS (SELECT *, length(content) // 4 AS n_tokens, sum(length(content) // 4) OVER (PARTITION BY conv_id) AS total,
              count(*) OVER (PARTITION BY conv_id) AS n, max(CASE WHEN role = 'tool' THEN msg_ix END) OVER (PARTITION BY conv_id) AS lt FROM s),
    e AS (SELECT *, coalesce(sum(n_tokens - 40) OVER (PARTITION BY conv_id ORDER BY msg_ix ROWS BETWEEN UNBOUNDED
              PRECEDING AND 1 PRECEDING), 0) AS saved_before FROM z
          WHERE n_tokens > 40 AND ((role = 'tool' AND NOT (msg_ix = lt AND n_tokens <= 200)) OR (role = 'user' AND msg_ix = 1))),
    chosen AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY msg_ix) AS k FROM e WHERE total - saved_before > 300)
    SELECT conv_id, concat('m', CAST(n + k - 1 AS STRING)) AS msg_id, 'meta' AS role, concat('m', CAST(msg_ix AS STRING)) AS parent_id,
        concat('m', CAST(msg_ix AS STRING)) AS root_id, concat('[Summarized — id: ''m', CAST(msg_ix AS STRING),
        '''. Use query_message to ask specific questions about the full output.]', chr(10), md5(content)) AS content FROM chosen""")
def stored_summaries(t):
    """Conversations compacted in the store: the second run finds nothing to add, and summaries lead back to their originals."""
    path = S.scratch_path(t.spark, "messages")
    none = F.lit(None).cast("string")
    S.append_messages(store(t).select("conv_id", "msg_id", "role", "content", F.col("turn").cast("bigint").alias("turn"),
                                      none.alias("parent_id"), F.lit("original").alias("kind"), "msg_ix"), path)
    answers = store(t).select("conv_id", "msg_id", F.md5("content").alias("short"), F.lit("-").alias("shorter"))
    for _ in range(2):
        flows.compact_store(t.spark, path, answers, 300, summary_tokens=40, recent_tokens=200)
    log = S.read_messages(t.spark, path)
    roots = M.root_originals(log, ["conv_id"]).select("conv_id", "msg_id", "root_id")
    return log.where("kind = 'summary'").join(roots, ["conv_id", "msg_id"]).select(
        "conv_id", "msg_id", "role", "parent_id", "root_id", "content")


@query("m12_apply_replacements", oracle="""
    SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND turn % 4 <> 0 THEN concat('[Summarized] ', CAST(turn AS STRING))
        WHEN turn % 4 = 0 THEN concat('[Summarized', content) ELSE content END AS content,
        turn % 2 = 0 AND turn % 4 <> 0 AS applied FROM {messages}""")
def apply_replacements(t):
    messages = t.sql("""
        SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN concat('[Summarized', content) ELSE content END AS content
        FROM {messages}""")
    swaps = t.sql("""
        SELECT conv_id, turn, concat('[Summarized] ', turn) AS content FROM {messages} WHERE turn % 2 = 0""")
    return M.apply_replacements(messages, swaps, ("conv_id", "turn"))


def _parsed(t):
    """Responses with their message and usage, each read by its dialect."""
    native = F.col("dialect") == "native"
    return t.agent_responses.withColumn("message", F.when(native, M.response_message("response", "native")).otherwise(
        M.response_message("response", "chat"))).withColumn("usage", F.when(
            native, M.response_usage("response", "native")).otherwise(M.response_usage("response", "chat")))


@query("m13_usage", oracle="""
    SELECT user_id, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens,
        CAST(sum(p + c) AS BIGINT) AS total_tokens
    FROM (SELECT user_id, CASE WHEN kind < 2 THEN event_id % 500 WHEN kind = 5 THEN 3 ELSE 0 END AS p,
              CASE WHEN kind < 2 THEN event_id % 50 WHEN kind = 2 THEN 7 ELSE 0 END AS c FROM {agent_responses}) u
    GROUP BY user_id""")
def usage(t):
    return M.total_usage(_parsed(t), ["user_id"])


@query("m14_reasoning", oracle="""
    SELECT event_id, CASE kind WHEN 0 THEN concat('plan ', k) WHEN 1 THEN concat('why ', k) WHEN 2 THEN concat('late ', k)
        END AS reasoning FROM {agent_responses}""")
def reasoning(t):
    return _parsed(t).select("event_id", M.reasoning_of("message").alias("reasoning"))


@query("m15_tool_call", oracle="""
    SELECT event_id, CASE WHEN kind < 2 THEN event_type END AS name,
        CASE WHEN kind = 1 THEN concat('call_', CAST(event_id AS STRING)) END AS call_id,
        CASE WHEN kind < 3 THEN replace(props, ' ', '') END AS arguments,
        CASE WHEN kind = 2 THEN concat(repeat(chr(96), 3), 'json', chr(10), props, chr(10), repeat(chr(96), 3))
            WHEN kind = 3 THEN concat('not json ', k) END AS text
    FROM {agent_responses}""")
def tool_call(t):
    return _parsed(t).select("event_id", M.tool_call_of("message").alias("c"), "message").select(
        "event_id", "c.name", "c.call_id", F.replace(M.tool_args_of("message"), F.lit(" "), F.lit("")).alias("arguments"),
        M.text_of("message").alias("text"))


@query("m16_brief_args", oracle="""
    SELECT event_id, CASE WHEN length(j) > 80 THEN concat(substr(j, 1, 77), '...') ELSE j END AS brief FROM (
        SELECT event_id, concat('{"props":', replace(props, ' ', ''), ',"note":"', repeat('ab c', CAST(event_id % 25 AS INT)),
            '"}') AS j FROM events) x""")
def brief_args(t):
    args = t.sql("""
        SELECT event_id, concat('{ "props": ', props, ',  "note":"', repeat('ab c', CAST(event_id % 25 AS INT)), '"}') AS a
        FROM {events}""")
    return args.select("event_id", M.brief_args("a").alias("brief"))


@query("m16_ascii_args", oracle=f"""
    SELECT doc_id, CASE WHEN length(j) > 80 THEN concat(substr(j, 1, 77), '...') ELSE j END AS brief FROM (
        SELECT doc_id, concat('{{"text":"', {ascii_sql('plain')}, '"}}') AS j FROM ({SPOKEN}) p) x""")
def ascii_args(t):
    args = t.sql(SPOKEN.replace("FROM documents", "FROM {documents}"))
    text = F.concat(F.lit('{"text":"'), F.col("plain"), F.lit('"}'))
    return args.select("doc_id", M.brief_args(text, ascii_only=True).alias("brief"))


@query("m15_tool_result_message", oracle="""
    SELECT event_id, concat('{"role":"tool","content":"', event_type, ' é"}') AS native, concat('{"role":"tool",',
        CASE WHEN event_id % 3 > 0 THEN concat('"tool_call_id":"call_', CAST(event_id AS STRING), '",') ELSE '' END,
        '"content":"', event_type, ' é"}') AS chat FROM events""")
def tool_result_message(t):
    content = F.concat("event_type", F.lit(" é"))
    call = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("call_"), F.col("event_id").cast("string")))
    return t.events.select("event_id", M.tool_result_message(content, call, "native").alias("native"),
                           M.tool_result_message(content, call, "chat").alias("chat"))


@query("m17_tool_results", oracle=f"""
    SELECT conv_id, concat('m', CAST(msg_ix AS STRING)) AS msg_id, content FROM {STORE} s
    WHERE role = 'tool' AND turn % 3 <> 0""")
def tool_results(t):
    return M.tool_results(store(t).withColumn("kind", F.when(F.col("turn") % 3 == 0, "summary").otherwise("original")))


@query("m18_no_call_streaks", oracle="""
    WITH n AS (SELECT event_id, user_id % 7 AS agent, kind < 2 AS has_call, row_number() OVER (PARTITION BY user_id % 7
                   ORDER BY event_id) AS k FROM {agent_responses}),
    c AS (SELECT *, k - coalesce(max(CASE WHEN has_call THEN k END) OVER (PARTITION BY agent ORDER BY event_id), 0)
              AS streak FROM n)
    SELECT event_id, agent, CAST(streak AS BIGINT) AS streak, streak >= 3 AS escalates FROM c""")
def no_call_streaks(t):
    turns = _parsed(t).select("event_id", (F.col("user_id") % 7).alias("agent"),
                              M.tool_call_of("message").isNotNull().alias("has_call"))
    return M.no_call_streaks(turns, ["agent"], "event_id").select("event_id", "agent", "streak", "escalates")
