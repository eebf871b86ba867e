"""The queries of the operators over the test tables, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratalake.llm import bpe, chat, decontaminate, divergence, langid, licenses, ngram_join, pii, prefix_trie, token_files, url_filter, warc, winnow
from stratalake.llm.common import read

#: The key of the pseudonyms. A deployment passes its own secret to ``pii.pseudonymise_documents``.
PII_KEY = b"stratalake test key"
END_ID = 2
#: The rules of URLs, as canonical prefixes of host and path.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, read back by the index."""
    return warc.archive_pages(read(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of a benchmark item, with the item."""
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_key")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], turns.schema)
    return chat.summary(turns.unionByName(extra))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids in files of byte planes, read back."""
    return token_files.token_table(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' texts with pseudonyms for personal data."""
    return pii.pseudonymise_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of similar texts and its number of links."""
    return ngram_join.join_similar(read(spark, sf_dir, "documents")).drop("text_key", "class_key")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a license notice, with the license."""
    return licenses.scan(read(spark, sf_dir, "documents")).drop("text_key")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' fingerprints and those of their edited texts."""
    return winnow.fingerprints(read(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' texts encoded and decoded."""
    return bpe.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' languages by a model of the documents that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = langid.learn(docs.select("doc_id", "text", "lang"))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "n_words")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' URLs with the rule that fits each and its verdict."""
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart in their words, and by which terms each differs from its language."""
    return divergence.divergences(read(spark, sf_dir, "documents").select("lang", "source", "text"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations, a row per prefix."""
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.turn_table(read(spark, sf_dir, "conversations"))))


QUERIES = {f.__name__: f for f in (op1_warc, op2_decontamination, op3_chat, op4_token_files, op5_pii, op6_ngram_join, op7_license_scan, op8_fingerprints, op9_bpe, op10_language, op11_url_filter, op12_divergence, op13_prefix_trie)}

SQL = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
        ), k AS (
            SELECT digest, n, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY digest, n
        )
        SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
            CASE WHEN k.kept IS NOT NULL AND p.page_id IS DISTINCT FROM k.kept THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN p.page_id IS DISTINCT FROM k.kept THEN k.kept END AS refers_to
        FROM p LEFT JOIN k ON p.digest = k.digest AND p.n = k.n
    """,
    "op3_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), e AS (
            SELECT *,
                length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?s>|/?INST\]|ANSWER\]|SYSTEM\]|/?ROLE\]|/END\]|NEXT\])', '\1\\\2', 'g')) AS chars,
                lag(role) OVER w AS before, row_number() OVER w AS place
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
        ), m AS (
            SELECT *, CASE WHEN role IS NOT DISTINCT FROM before THEN 6
                WHEN role = 'user' THEN 9 + 7 WHEN role = 'assistant' THEN 11 + 4 WHEN role = 'system' THEN 11 + 6
                ELSE 9 + 7 + 6 + length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?s>|/?INST\]|ANSWER\]|SYSTEM\]|/?ROLE\]|/END\]|NEXT\])', '\1\\\2', 'g'))
                END AS marks
            FROM e
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(chars + marks) AS BIGINT) AS formatted_chars
        FROM m GROUP BY conv_id
    """,
    "op11_url_filter": r"""
        WITH rules AS (
            SELECT rule, verdict, split_part(rule, '/', 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path
            FROM (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')) r(rule, verdict)
        ), cut AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), p AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ), u AS (SELECT DISTINCT host, path FROM p),
        fits AS (
            SELECT host, path, arg_max(rule, (length(rule), length(rule_host))) AS rule, arg_max(verdict, (length(rule), length(rule_host))) AS verdict
            FROM u, rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY host, path
        )
        SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
        FROM p LEFT JOIN fits ON p.host = fits.host AND p.path = fits.path
    """,
    "op12_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents
        ), w AS (
            SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
        ), kept AS (
            SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30
        ), groups AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
        n AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
            FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), p AS (
            SELECT *, 1 + CAST(CAST(1000000000 * (n + 5) AS HUGEINT) // (sum(n) OVER s + 5 * count(*) OVER s) AS BIGINT) AS p
            FROM n WINDOW s AS (PARTITION BY lang, source)
        ), whole AS (
            SELECT lang, term, 1 + CAST(CAST(1000000000 * (sum(n) + 5) AS HUGEINT) // (sum(sum(n)) OVER l + 5 * count(*) OVER l) AS BIGINT) AS q
            FROM n GROUP BY lang, term WINDOW l AS (PARTITION BY lang)
        ), sums AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), found AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, p - q FROM p JOIN whole USING (lang, term) WHERE n > 0 AND p > q
        )
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM found QUALIFY part = 'pair' OR rank <= 50
    """,
    "op13_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
            FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (
            SELECT conv_id, list(t ORDER BY place) AS turns,
                CAST(xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT)),
                    lambda crc, byte: list_reduce(CAST(range(8) AS UBIGINT[]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(crc, byte)),
                    CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT)) % 4 AS BIGINT) AS h
            FROM t GROUP BY conv_id
        ), r AS (
            SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS turns
            FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
        ), p AS (
            SELECT conv_id, depth, turns[1:depth] AS prefix, depth = len(turns) AS ends
            FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM r)
        ), n AS (
            SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
                coalesce(len(regexp_extract_all(prefix[depth].text, '[^\x20\x09-\x0D]+')), 0) AS words
            FROM p GROUP BY depth, prefix
        ), f AS (
            SELECT n.*, (SELECT count(*) FROM n c WHERE c.depth = n.depth + 1 AND c.prefix[1:n.depth] = n.prefix) AS n_children FROM n
        ), s AS (
            SELECT u.conv_id, u.depth, CAST(sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
                CAST(sum((v.n_convs - 1) * v.words) AS BIGINT) AS saved_tokens
            FROM f u JOIN f v ON v.depth >= u.depth AND v.prefix[1:u.depth] = u.prefix GROUP BY u.conv_id, u.depth
        )
        SELECT f.conv_id, f.depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
        FROM f JOIN s ON s.conv_id = f.conv_id AND s.depth = f.depth
        LEFT JOIN n up ON up.depth = f.depth - 1 AND f.prefix[1:up.depth] = up.prefix
    """,
}
