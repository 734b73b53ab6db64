"""Change-set data derived from the given tables.

The text is plain SQL that Spark and the oracle engine read alike, so both sides see the same rows.
``{name}`` refers to a given table or to another view.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    # File paths, one per part: several languages, lock files, noise files.
    "paths": """
        SELECT p_partkey, CASE p_partkey % 17
            WHEN 0 THEN concat('src/', stem, '.py') WHEN 1 THEN concat('src/', stem, '.rs')
            WHEN 2 THEN concat('web/', stem, '.TSX') WHEN 3 THEN concat('pkg/', stem, '/go.sum')
            WHEN 4 THEN concat('src/', stem, '.java') WHEN 5 THEN concat('docs/', stem, '.md')
            WHEN 6 THEN concat(stem, '/Cargo.toml') WHEN 7 THEN '.DS_Store'
            WHEN 8 THEN concat('__pycache__/', stem, '.pyc') WHEN 9 THEN concat('dist/', stem, '.min.js')
            WHEN 10 THEN concat('builder/', stem, '.o') WHEN 11 THEN concat('lib/', stem, '.cpp')
            WHEN 12 THEN '.env.local' WHEN 13 THEN concat('app/', stem, '/package.json')
            WHEN 14 THEN concat('build/', stem, '.log') WHEN 15 THEN concat('.', stem)
            ELSE concat('Makefile', CAST(p_partkey AS STRING)) END AS path
        FROM (SELECT p_partkey, concat(replace(p_name, ' ', '/'), '_', CAST(p_partkey AS STRING)) AS stem
              FROM {part}) p""",
    # Changed files per example.
    "ex_files": """
        SELECT DISTINCT l.l_orderkey AS ex_id, p.path
        FROM {lineitem} l JOIN {paths} p ON l.l_partkey = p.p_partkey""",
    # Examples: documents stand in for diffs, labels mark the labelled ones.
    "examples": """
        SELECT d.doc_id AS ex_id, d.source AS repo_url, md5(concat('b', CAST(d.doc_id AS STRING))) AS base_commit,
            md5(concat('h', CAST(d.doc_id AS STRING))) AS head_commit,
            CAST(1 + d.doc_id % 8 AS INT) AS n_commits, d.text AS diff, d.lang AS language,
            b.quality AS quality, b.toxic AS toxic
        FROM {documents} d LEFT JOIN {labels} b ON d.doc_id = b.doc_id""",
    # Raw harvest output: a third of the ranges was drawn twice.
    "harvested": """
        SELECT ex_id, 0 AS draw, concat(repo_url, '@', base_commit, '..', head_commit) AS example_key, repo_url,
            language FROM {examples}
        UNION ALL
        SELECT ex_id, 1 AS draw, concat(repo_url, '@', base_commit, '..', head_commit) AS example_key, repo_url,
            language FROM {examples} WHERE ex_id % 3 = 0""",
    # Commit history: orders are commits.  Every third one belongs to repository 0, which so holds a third of all rows
    # in one long chain; the others fall into 200 repositories of two branches per 60,000 orders.  Every fifth commit
    # skips one on its branch, every seventh is a merge.  Parents are found by arithmetic, without any window.
    "history": """
        SELECT repo, oid, md5(concat('c', CAST(oid AS STRING))) AS sha,
            CASE WHEN room >= first_step THEN md5(concat('c', CAST(oid - first_step AS STRING))) END AS parent1,
            CASE WHEN oid % 7 = 0 AND room >= 3 * step THEN md5(concat('c', CAST(oid - 3 * step AS STRING))) END AS parent2,
            concat(CASE oid % 5 WHEN 0 THEN 'feat' WHEN 1 THEN 'fix' WHEN 2 THEN 'chore' WHEN 3 THEN 'docs'
                ELSE 'misc change' END, CASE WHEN oid % 5 < 4 THEN '(core): ' ELSE ' ' END, o_orderpriority) AS subject,
            newest - oid AS topo_pos
        FROM (SELECT *, CASE WHEN oid % 5 = 0 THEN 2 * step ELSE step END AS first_step FROM (
            SELECT o_orderkey AS oid, o_orderpriority, (SELECT max(o_orderkey) + 1 FROM {orders}) AS newest,
                CASE WHEN o_orderkey % 3 = 0 THEN 0
                    ELSE 1 + o_orderkey % 200 + 200 * CAST(floor(o_orderkey / 60000) AS BIGINT) END AS repo,
                CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 600 END AS step,
                CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE o_orderkey % 60000 END AS room
            FROM {orders}) o) h""",
    # The newest commit of each repository is the head of its default branch.
    "heads": """
        SELECT h.repo, h.sha FROM {history} h JOIN (SELECT repo, min(topo_pos) AS topo_pos FROM {history} GROUP BY repo) n
        ON h.repo = n.repo AND h.topo_pos = n.topo_pos""",
    # Files per commit.
    # What a commit leaves in the .gitignore files that it changes; NULL is a removed file.
    "ignore_versions": """
        SELECT repo, sha, CASE WHEN oid % 11 % 2 = 0 THEN '.gitignore' ELSE 'lib/core/.gitignore' END AS path,
            CASE WHEN oid % 13 <> 5 THEN concat('# ', subject, chr(10), ' *.x', CAST(oid % 17 AS STRING), ' ', chr(10), chr(10),
                'out', CAST(oid % 5 AS STRING), '/') END AS content
        FROM {history} h WHERE oid % 7 IN (1, 4)""",
    "history_files": """
        SELECT DISTINCT h.repo, h.sha, p.path
        FROM {history} h JOIN {lineitem} l ON l.l_orderkey = h.oid JOIN {paths} p ON l.l_partkey = p.p_partkey""",
    # One unified diff per document: added lines, removed lines, and for some a second file.  Removed lines of every
    # seventh start with dashes, so that they look like a file header.
    "diff_parts": """
        SELECT ex_id, path, n, dash, concat('diff --git a/', path, ' b/', path, chr(10),
            'index 1111111..2222222 100644', chr(10), '--- a/', path, chr(10), '+++ b/', path, chr(10)) AS header,
            concat('@@ -', CAST(s AS STRING), CASE WHEN ex_id % 4 = 0 THEN '' ELSE ',1' END, ' +', CAST(s AS STRING),
                ',', CAST(n + 1 AS STRING), ' @@ fn', chr(10), ' ctx', chr(10), '+',
                replace(text, chr(10), concat(chr(10), '+')), chr(10)) AS body1,
            concat('@@ -', CAST(s + 9 AS STRING), ',', CAST(n + 1 AS STRING), ' +', CAST(s + 9 + n AS STRING), ',1 @@',
                chr(10), ' tail', chr(10)) AS open2,
            concat('-', dash, replace(text, chr(10), concat(chr(10), '-', dash)), chr(10)) AS removed2,
            concat('diff --git a/old.txt b/docs/new', CAST(ex_id AS STRING), '.txt', chr(10),
                'index 3333333..4444444 100644', chr(10), '--- a/old.txt', chr(10), '+++ b/docs/new.txt', chr(10))
                AS header3,
            concat('@@ -5,2 +5,1 @@', chr(10), ' keep', chr(10), '-drop', chr(10)) AS body3
        FROM (SELECT doc_id AS ex_id, text, 5 + doc_id % 100 AS s,
                CASE WHEN doc_id % 7 = 0 THEN '-- ' ELSE '' END AS dash,
                concat('src/f', CAST(doc_id AS STRING), CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.rs'
                    WHEN 2 THEN '.py' ELSE '.min.js' END) AS path,
                length(text) - length(replace(text, chr(10), '')) + 1 AS n
              FROM {documents}) d""",
    "file_diffs": """
        SELECT ex_id, path, concat(header, body1, open2, removed2) AS diff FROM {diff_parts}""",
    "range_diffs": """
        SELECT ex_id, concat(header, body1, open2, removed2, CASE WHEN ex_id % 3 = 0 THEN concat(header3, body3) ELSE ''
            END) AS diff
        FROM {diff_parts}""",
    # Hunks of those diffs; every tenth file is untracked and every eleventh is binary.
    "hunks": """
        SELECT ex_id, concat(path, '::', CAST(hunk_no AS STRING)) AS hunk_id, path AS file_path, hunk_no,
            CASE WHEN ex_id % 10 = 3 OR ex_id % 11 = 3 THEN '' ELSE patch END AS patch, ex_id % 10 = 3 AS is_untracked,
            ex_id % 10 <> 3 AND ex_id % 11 = 3 AS is_binary
        FROM (SELECT ex_id, path, 1 AS hunk_no, concat(header, body1) AS patch FROM {diff_parts}
              UNION ALL SELECT ex_id, path, 2, concat(header, open2, removed2) FROM {diff_parts}) h
        WHERE hunk_no = 1 OR NOT (ex_id % 10 = 3 OR ex_id % 11 = 3)""",
    # Label and predicted commit of each file.
    "grouping": """
        SELECT DISTINCT l_orderkey AS ex_id, l_partkey AS file, l_suppkey % 3 AS label_ix, l_linenumber % 3 AS pred_ix
        FROM {lineitem}""",
    # Line ranges of hunks, assigned to commits of one plan.
    "hunk_ranges": """
        SELECT DISTINCT 0 AS plan, l_partkey AS file, l_suppkey % 4 AS commit_ix,
            l_orderkey * 1000 + l_suppkey % 4 * 100 + CAST(l_quantity AS BIGINT) % 40 AS pos,
            l_orderkey % 2000 AS start_line, CAST(l_quantity AS BIGINT) % 40 AS line_count
        FROM {lineitem}""",
    # Hunks claimed by commits; customer = plan, order = commit.
    "claims": """
        SELECT DISTINCT o.o_custkey AS plan, o.o_orderkey AS commit_ix, l.l_partkey % 60 AS hunk
        FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey""",
    # Conversations as stored messages: the assistant plays the tool.
    "messages": """
        SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'tool' ELSE role END AS role, text AS content
        FROM {conversations}""",
    # Parent links: every id hangs under half of it.
    "links": """
        SELECT concat('m', CAST(o_orderkey AS STRING)) AS msg_id,
            CASE WHEN o_orderkey > 1 AND o_orderkey % 5 <> 0
                THEN concat('m', CAST(CAST(floor(o_orderkey / 2) AS BIGINT) AS STRING)) END AS parent_id
        FROM {orders}""",
    # What a model may answer: one of eight kinds per document.  chr(92) is a backslash, chr(96) a back quote.
    "answer_objects": """
        SELECT doc_id AS ex_id, doc_id % 8 AS kind, concat('{"commits":[{"subject":"', CASE doc_id % 3 WHEN 0 THEN 'feat'
            WHEN 1 THEN 'fix' ELSE 'docs' END, '(core): change ', CAST(doc_id AS STRING), '","files":["src/f',
            CAST(doc_id AS STRING), '.py","README.md"],"body":"say ', chr(92), '"hi', chr(92), '" {x} ', snippet,
            '","issues":[]}],"gitignore":["*.pyc"]}') AS obj, snippet, text
        FROM (SELECT doc_id, text, replace(replace(replace(text, chr(92), concat(chr(92), chr(92))), '"', concat(chr(92), '"')),
                chr(10), concat(chr(92), 'n')) AS snippet FROM {documents}) d""",
    "answers": """
        SELECT ex_id, kind, CASE kind
                WHEN 0 THEN obj
                WHEN 1 THEN concat(fence, 'json', chr(10), obj, chr(10), fence, chr(10))
                WHEN 2 THEN concat('Sure: ', obj, ' and {more} text', chr(10))
                WHEN 3 THEN text
                WHEN 4 THEN concat(fence, chr(10), substr(obj, 1, length(obj) - 2))
                WHEN 5 THEN '{"commits":"none"}'
                WHEN 6 THEN concat('{"commits":[],"note":"', snippet, '"}')
                ELSE concat('x {commits: [', CAST(ex_id AS STRING), ']} y') END AS content,
            CASE WHEN kind IN (0, 1, 2) THEN obj WHEN kind = 5 THEN '{"commits":"none"}'
                WHEN kind = 6 THEN concat('{"commits":[],"note":"', snippet, '"}')
                WHEN kind = 7 THEN concat('{commits: [', CAST(ex_id AS STRING), ']}') END AS expected,
            CASE kind WHEN 3 THEN 'none' WHEN 4 THEN 'incomplete' WHEN 5 THEN 'not_a_list' WHEN 6 THEN 'empty'
                WHEN 7 THEN 'invalid' END AS problem, obj
        FROM (SELECT *, concat(chr(96), chr(96), chr(96)) AS fence FROM {answer_objects}) a""",
    # Raw API answers that carry those texts; every fifth puts the text into the reasoning field.
    "responses": """
        SELECT ex_id, kind, content, expected, problem, concat('{"choices":[{"message":{"role":"assistant","content":',
            CASE WHEN ex_id % 5 = 0 THEN '" ","reasoning_content":' ELSE '' END, '"', escaped, '"}}],"usage":{',
            '"prompt_tokens":', CAST(ex_id % 1000 AS STRING), CASE WHEN ex_id % 7 = 0 THEN '' ELSE
            concat(',"completion_tokens":', CAST(ex_id % 77 AS STRING)) END, ',"total_tokens":',
            CAST(ex_id % 1000 + ex_id % 77 AS STRING), '}}') AS response
        FROM (SELECT *, replace(replace(replace(content, chr(92), concat(chr(92), chr(92))), '"', concat(chr(92), '"')),
                chr(10), concat(chr(92), 'n')) AS escaped FROM {answers}) r""",
    # Agent responses in two dialects, one of six kinds per event; props holds the tool arguments.
    "agent_responses": """
        SELECT event_id, user_id, kind, k, CASE WHEN kind IN (0, 2, 4) THEN 'native' ELSE 'chat' END AS dialect, CASE kind
            WHEN 0 THEN concat('{"message":{"role":"assistant","content":"","thinking":"  plan ', k,
                ' ","tool_calls":[{"function":{"name":"', event_type, '","arguments":', props, '}}]},"prompt_eval_count":',
                CAST(event_id % 500 AS STRING), ',"eval_count":', CAST(event_id % 50 AS STRING), '}')
            WHEN 1 THEN concat('{"choices":[{"message":{"content":null,"thinking":" ","reasoning":"why ', k,
                '","tool_calls":[{"id":"call_', CAST(event_id AS STRING), '","function":{"name":"', event_type,
                '","arguments":"', replace(props, '"', concat(chr(92), '"')), '"}}]}}],"usage":{"prompt_tokens":',
                CAST(event_id % 500 AS STRING), ',"completion_tokens":', CAST(event_id % 50 AS STRING), '}}')
            WHEN 2 THEN concat('{"message":{"content":"', fence, 'json', chr(92), 'n',
                replace(props, '"', concat(chr(92), '"')), chr(92), 'n', fence, '","reasoning_content":"late ', k,
                '"},"eval_count":7}')
            WHEN 3 THEN concat('{"choices":[{"message":{"content":" not json ', k, ' ","reasoning":7}}]}')
            WHEN 4 THEN '{"message":{"content":" "}}'
            ELSE '{"choices":[],"usage":{"prompt_tokens":3}}' END AS response, props, event_type
        FROM (SELECT event_id, user_id, event_type, props, event_id % 6 AS kind, CAST(event_id % 90 AS STRING) AS k,
                concat(chr(96), chr(96), chr(96)) AS fence FROM {events}) e""",
}


# Texts in four languages, without the characters that JSON itself would escape.
SPOKEN = "SELECT doc_id, translate(text, concat(chr(34), chr(92), chr(9), chr(10), chr(13)), '     ') AS plain FROM documents"


def ascii_sql(text: str) -> str:
    """Oracle SQL for a text with other characters than ASCII written as \\uXXXX."""
    return f"""array_to_string(list_transform(string_split({text}, ''), lambda c: CASE
            WHEN c = '' OR unicode(c) < 128 THEN c WHEN unicode(c) < 65536 THEN concat('\\u', printf('%04x', unicode(c)))
            ELSE concat('\\u', printf('%04x', 55296 + (unicode(c) - 65536) // 1024), '\\u', printf('%04x', 56320 + unicode(c) % 1024)) END),
            '')"""
