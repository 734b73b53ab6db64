"""The numbered operators bound to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from changeloom.llm import (bpe, conversation_trie, embedding_dedup, html_text, language, lexical, line_dedup, ngram_join,
                            packing, piece_bpe, quality, toxicity, url_filter)
from changeloom.session import ship_package

QUERIES = {}
ORACLES = {}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return build

    return register


@query("op1_bpe")
def op1(spark: SparkSession, directory: str) -> DataFrame:
    return bpe.digests(table(spark, directory, "documents"))


HOST_RULES = [url_filter.Rule(verdict, text) for verdict, text in (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))]

# The patterns of url_filter.PATTERNS as one regular expression over host and path.
PATTERNS_SQL = (r"-pills\.|\.pills\.|/pills/|spam-farm\.|-casino\.|\.casino\.|/casino/|-poker\.|/poker/|-loans\.|\.porn\.|/porn/|"
                r"\.xxx/|-escorts\.|/phishing/|/malware/")


@query("op2_url_filters", oracle=f"""
    WITH located AS (
        SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    cut AS (
        SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM located),
    ruled AS (
        SELECT page_id, host, path, CASE
            WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
            WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
            WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
            WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
            WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule FROM cut)
    SELECT page_id, host, path, rule, CASE
        WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
        WHEN regexp_matches(host || path, '{PATTERNS_SQL}') THEN 'block' ELSE 'allow' END AS verdict FROM ruled""")
def op2(spark: SparkSession, directory: str) -> DataFrame:
    return url_filter.judged(table(spark, directory, "pages"), HOST_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op3_html_extraction")
def op3(spark: SparkSession, directory: str) -> DataFrame:
    return html_text.page_texts(table(spark, directory, "pages"))


@query("op4_packing")
def op4(spark: SparkSession, directory: str) -> DataFrame:
    return packing.packed(table(spark, directory, "documents"))


@query("op5_embedding_dedup")
def op5(spark: SparkSession, directory: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, directory, "embeddings"))


@query("op6_quality_rules")
def op6(spark: SparkSession, directory: str) -> DataFrame:
    return quality.document_quality(table(spark, directory, "documents"))


@query("op7_line_dedup")
def op7(spark: SparkSession, directory: str) -> DataFrame:
    return line_dedup.removed_lines(table(spark, directory, "documents"))


@query("op8_language_id")
def op8(spark: SparkSession, directory: str) -> DataFrame:
    return language.document_languages(table(spark, directory, "documents"))


@query("op9_ngram_join")
def op9(spark: SparkSession, directory: str) -> DataFrame:
    return ngram_join.document_components(table(spark, directory, "documents"))


@query("op10_toxicity")
def op10(spark: SparkSession, directory: str) -> DataFrame:
    return toxicity.document_toxicity(table(spark, directory, "documents"), table(spark, directory, "labels"))


# CRC-32 of a decimal number, bit by bit: each character is marked by 256, each of its eight shifts by 0.
CRC_SQL = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''),
        lambda ch: [CAST(256 + ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0]))),
        lambda crc, x: CASE WHEN x >= 256 THEN xor(crc, x - 256)
            WHEN crc % 2 = 1 THEN xor(crc // 2, CAST(3988292384 AS BIGINT)) ELSE crc // 2 END)"""


@query("op11_conversation_trie", oracle=f"""
    WITH turns AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(1) || coalesce(text, ''))) AS ix
        FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT conv_id, xor({CRC_SQL.format('conv_id')}, CAST(4294967295 AS BIGINT)) % 9 AS h
        FROM (SELECT DISTINCT conv_id FROM turns) c),
    pieces AS (
        SELECT c.conv_id, 0 AS part, ix, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND ix <= h
        UNION ALL SELECT c.conv_id, 1, ix, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND ix > h),
    rebuilt AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, ix) AS depth, octet_length(encode(text)) AS bytes,
            sha256(concat(length(role), ':', role, text)) AS turn FROM pieces),
    prefixes AS (
        SELECT conv_id, depth, bytes, string_agg(turn, ',') OVER w AS key, coalesce(string_agg(turn, ',') OVER (
            PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS parent,
            lead(depth) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends
        FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)
        UNION ALL SELECT conv_id, 0, 0, '', NULL, conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM convs),
    nodes AS (
        SELECT key, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
            sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
        FROM prefixes GROUP BY key, depth),
    grown AS (SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.parent = n.key) AS n_children FROM nodes n),
    subtrees AS (
        SELECT v.key, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((u.n_convs - 1) * u.bytes) AS saved
        FROM grown v JOIN grown u ON v.depth = 0 OR u.key = v.key OR starts_with(u.key, v.key || ',') GROUP BY v.key)
    SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, g.n_convs, g.n_children,
        CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, g.ends_sha256
    FROM grown g JOIN subtrees s ON s.key = g.key LEFT JOIN nodes p ON p.key = g.parent""")
def op11(spark: SparkSession, directory: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, directory, "conversations")).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@query("op12_piece_bpe")
def op12(spark: SparkSession, directory: str) -> DataFrame:
    return piece_bpe.digests(table(spark, directory, "documents"))


TERMS_SQL = """regexp_extract_all(translate({0}, '""" + url_filter.UPPER + "', '" + url_filter.LOWER + """'),
            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""


@query("op13_lexical_search", oracle=f"""
    WITH cut AS (SELECT row_number() OVER () AS r, doc_id, {TERMS_SQL.format('text')} AS terms FROM documents),
    sizes AS (SELECT r, doc_id, len(terms) AS n FROM cut WHERE len(terms) > 0),
    total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
    held AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM cut) x GROUP BY r, term),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM held, total GROUP BY term, n_docs),
    asked AS (SELECT DISTINCT item_id, unnest({TERMS_SQL.format('text')}) AS term FROM benchmark),
    scored AS (
        SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
        FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (r), total GROUP BY item_id, r, doc_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10""")
def op13(spark: SparkSession, directory: str) -> DataFrame:
    return lexical.search(table(spark, directory, "documents"), table(spark, directory, "benchmark"))
