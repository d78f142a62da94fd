"""One query for each corpus operator over its whole table, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthmatch.llm.common import table
from monthmatch.llm.embedding_dedup import near_duplicates
from monthmatch.llm.fingerprint import fingerprint_edits
from monthmatch.llm.hard_negatives import mine_hard_negatives
from monthmatch.llm.html_blocks import extract_main_text
from monthmatch.llm.jaccard import jaccard_classes
from monthmatch.llm.mixing import BUDGET_SHARE, POWERS, ROUNDS, mix_sources
from monthmatch.llm.packing import pack_documents
from monthmatch.llm.quality import score_quality
from monthmatch.llm.secret_scan import ACCESS, ASSIGN, HEX, MOST_DOCUMENTS, MOST_OWNERS, OPAQUE_PATTERN, scan_secrets
from monthmatch.llm.term_trie import rank_documents
from monthmatch.llm.url_filter import judge_urls
from monthmatch.llm.warc_zip import archive_round_trip
from monthmatch.llm.winnowing import find_contamination

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL, judged by site rules and globs."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict"
    )


ORACLES["op1_url_filter"] = r"""
WITH split AS (
    SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^#]*)', 1) AS rest
    FROM pages
), rules(rule_host, rule_path, rule_verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), judged AS (
    SELECT split.*, rule_host || rule_path AS rule, rule_verdict,
        row_number() OVER (
            PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC,
            rule_host || rule_path) AS place
    FROM split LEFT JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule,
    CASE WHEN rule IS NOT NULL THEN rule_verdict
        WHEN contains(host || rest, 'spam-farm.') OR contains(host || rest, 'cheap-pills.')
            OR regexp_matches(host || rest, '^[^/?]*casino[^/?]*/') OR contains(host || rest, '/wp-login')
            OR regexp_matches(host || rest, '\?[^/?]*sessionid=') OR contains(host || rest, '/cart/')
        THEN 'block' ELSE 'allow' END AS verdict
FROM judged WHERE place = 1
"""


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and that of its edit."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted"
    )


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sampling probability and whether it is sampled."""
    docs = table(spark, sf_dir, "documents")
    return mix_sources(docs, budget_share=BUDGET_SHARE, repeats=False).selectExpr(
        "doc_id", "topic", "tokens", "round(probability, 6) AS probability", "sampled"
    )


def _raking_sql() -> str:
    """The fitting, one step for each dimension and round."""
    steps, before = [], "shares"
    for k in range(ROUNDS):
        for d in POWERS:
            steps.append(
                f"r{k}_{d} AS (SELECT * EXCLUDE weight, weight * {d}_share / sum(weight) OVER "
                f"(PARTITION BY {d}) AS weight FROM {before})"
            )
            before = f"r{k}_{d}"
    shares = ", ".join(
        f"{d}_power / sum({d}_power / {d}_cells) OVER () AS {d}_share" for d in POWERS
    )
    powers = ", ".join(
        f"pow(sum(tokens) OVER (PARTITION BY {d}), {p}) AS {d}_power, "
        f"count(*) OVER (PARTITION BY {d}) AS {d}_cells"
        for d, p in POWERS.items()
    )
    return f"""
WITH marked AS (
    SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
        greatest(1, strlen(coalesce(text, '')) // 4)::BIGINT AS tokens,
        CASE WHEN coalesce(text, '') = '' THEN 'empty'
            WHEN (length(text) - length(replace(text, '|', ''))) * 50 >= length(text) THEN 'table'
            WHEN (length(text) - length(replace(text, chr(10), ''))) * 100 >= length(text) THEN 'list'
            WHEN length(text) >= 8000 THEN 'book' WHEN length(text) >= 1500 THEN 'article'
            ELSE 'note' END AS topic
    FROM documents
), cells AS (
    SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM marked GROUP BY ALL
), powers AS (
    SELECT *, {powers} FROM cells
), shares AS (
    SELECT *, tokens AS weight, {shares} FROM powers
), {", ".join(steps)}, ratios AS (
    SELECT *, weight / tokens AS ratio FROM {before}
), scales AS (
    -- With the cells of higher ratios taken whole, the others fill the rest; the largest of these scales is the one.
    SELECT *, ({BUDGET_SHARE} * sum(tokens) OVER () - coalesce(sum(tokens) OVER (ORDER BY ratio DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY ratio DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale
    FROM ratios
), chances AS (
    SELECT source, lang, topic, least(1, ratio * max(scale) OVER ()) AS chance FROM scales
)
SELECT doc_id, topic, marked.tokens, round(chance, 6) AS probability,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 < chance AS sampled
FROM marked JOIN chances USING (source, lang, topic)
"""


ORACLES["op5_mixing"] = _raking_sql()


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def _spans_sql(kind: str, rank: int, pattern: str, hint: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
SELECT doc_id, owner, '{kind}' AS kind, {rank} AS rank, s.first AS first, s.first + length(s.value) AS last,
    s.value AS value
FROM (
    SELECT doc_id, owner, unnest(list_transform(range(2, len(p) + 1, 2), lambda i: {{
        'first': list_sum(list_transform(p[1:i - 1], lambda x: length(x)))::BIGINT, 'value': p[i]}})) AS s
    FROM (
        SELECT doc_id, owner, string_split_regex(regexp_replace(
            translate(text, chr(1) || chr(2), chr(3) || chr(3)), '{quoted}', chr(1) || '\\0' || chr(2), 'g'),
            '[\x01\x02]') AS p
        FROM docs WHERE regexp_matches(text, '{hint}')
    )
) WHERE length(regexp_extract(s.value, '{quoted}', {group})) >= {least}"""


ORACLES["op8_secrets"] = f"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner FROM documents
), base AS ({_spans_sql("assign", 0, ASSIGN, "[:=]", 2, 6)}
    UNION ALL {_spans_sql("access", 1, ACCESS, "AKIA", 0, 20)}
    UNION ALL {_spans_sql("hex", 2, HEX, "[0-9a-f]", 0, 24)}
), candidates AS (
    SELECT * FROM ({_spans_sql("opaque", 3, OPAQUE_PATTERN, "[A-Za-z0-9_-]", 0, 20)}
    ) AS c
    WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')
        AND NOT EXISTS (
            SELECT 1 FROM base WHERE base.doc_id = c.doc_id AND base.first < c.last AND base.last > c.first)
), added AS (
    SELECT * FROM candidates WHERE value IN (
        SELECT value FROM candidates GROUP BY value
        HAVING count(DISTINCT owner) <= {MOST_OWNERS}
            AND count(DISTINCT (owner, doc_id)) <= count(DISTINCT owner) * {MOST_DOCUMENTS})
), every AS (
    SELECT * FROM base UNION ALL SELECT * FROM added
), digests AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        coalesce(string_agg(kind || ':' || first || ':' || last, ',' ORDER BY first, rank)
            FILTER (rank < 3), '') AS base,
        string_agg(kind || ':' || first || ':' || last, ',' ORDER BY first, rank) AS spans
    FROM every GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
    coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN digests USING (doc_id)
"""


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of equal words, number of similar documents and group."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_classes(docs).select("doc_id", "class_id", "n_links", "group_id", "kept")


@query
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's near duplicates of the same label."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archives it was written to."""
    return archive_round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


# Eight letters of five bits for each five bytes of the digest.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    f"((('0x' || substr(digest, {10 * g + 1}, 10))::BIGINT >> {35 - 5 * k}) & 31)::INT + 1, 1)"
    for g in range(4)
    for k in range(8)
)

ORACLES["op7_warc"] = f"""
WITH payloads AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS digest
    FROM pages
), firsts AS (
    SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM payloads
)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""


@query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text, an empty line between blocks."""
    pages = table(spark, sf_dir, "pages")
    return extract_main_text(pages, separator="\n\n").select("page_id", "url", "text", "n_chars")


ORACLES["op9_jaccard_join"] = r"""
WITH RECURSIVE plain AS (
    SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[\x00-\x20]+', ' ', 'g')) AS p FROM documents
), classes AS (
    SELECT p, row_number() OVER () AS node, min(doc_id) AS class_id, count(*) AS copies, sha256(p)[:32] AS digest
    FROM plain GROUP BY p
), words AS (
    SELECT node, string_split(p, ' ') AS w FROM classes WHERE p <> ''
), grams AS (
    SELECT DISTINCT node, unnest(list_transform(
        range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
    FROM words
), sizes AS (
    SELECT node, count(*) AS n FROM grams GROUP BY node
), common AS (
    SELECT a.node AS a, b.node AS b, count(*) AS c
    FROM grams AS a JOIN grams AS b USING (g) WHERE a.node <> b.node GROUP BY ALL
), linked AS (
    SELECT a, b FROM common JOIN sizes AS x ON x.node = a JOIN sizes AS y ON y.node = b
    WHERE c * 10 >= 8 * (x.n + y.n - c)
), links AS (
    SELECT a AS node, sum(copies)::BIGINT AS links FROM linked JOIN classes ON node = b GROUP BY a
), reach(node, root) AS (
    SELECT node, node FROM classes
    UNION SELECT linked.b, reach.root FROM reach JOIN linked ON linked.a = reach.node
), roots AS (
    SELECT node, min(root) AS root FROM reach GROUP BY node
), members AS (
    SELECT *, first_value(class_id) OVER best AS group_id, first_value(digest) OVER best AS best_digest
    FROM classes JOIN roots USING (node)
    WINDOW best AS (PARTITION BY root ORDER BY class_id NULLS LAST, digest)
)
SELECT doc_id, class_id, copies - 1 + coalesce(links, 0) AS n_links, group_id,
    doc_id IS NOT DISTINCT FROM group_id AND digest = best_digest AS kept
FROM plain JOIN members USING (p) LEFT JOIN links USING (node)
"""


@query
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that are copied from benchmark items."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


# Words after A to Z are lower-cased, as an expression over a column ``text``.
_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLES["op11_decontamination"] = f"""
WITH items AS (
    SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark
), windows AS (
    SELECT item_id, least(len(w), 10) AS size, unnest(list_transform(
        range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS key
    FROM items WHERE len(w) > 0
), docs AS (
    SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), places AS (
    SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i
    FROM docs CROSS JOIN (SELECT DISTINCT size FROM windows) WHERE len(w) >= size
), hits AS (
    SELECT DISTINCT r, i, size, item_id
    FROM (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS key FROM places)
    JOIN windows USING (size, key)
), counted AS (
    SELECT r, count(DISTINCT j) AS n_hit
    FROM (SELECT r, unnest(range(i, i + size)) AS j FROM hits) GROUP BY r
), listed AS (
    SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
    FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN counted USING (r) LEFT JOIN listed USING (r)
"""


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's ten best documents."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op12_lexical_search"] = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), sizes AS (
    SELECT count(*) AS documents, sum(len(w))::BIGINT AS terms FROM docs WHERE len(w) > 0
), counts AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
    FROM counts, sizes GROUP BY term, documents
), asked AS (
    SELECT q, item_id, term, count(*) AS k
    FROM (SELECT row_number() OVER () AS q, item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL
), lengths AS (
    SELECT r, doc_id, 25 + (75 * len(w) * documents) // terms AS m FROM docs, sizes WHERE len(w) > 0
), scores AS (
    SELECT q, item_id, doc_id, sum(k * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (r)
    GROUP BY q, item_id, r, doc_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank
    FROM scores WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor's positives with their hard negatives."""
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLES["op13_hard_negatives"] = """
WITH vectors AS (
    SELECT row_number() OVER () AS r, vec_id,
        CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
        list_dot_product(a.q, b.q)::BIGINT AS score
    FROM vectors AS a, vectors AS b WHERE a.vec_id % 100 = 0 AND a.r <> b.r
), positives AS (
    SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (
        PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST) AS place
    FROM scores WHERE same QUALIFY place <= 5
), negatives AS (
    SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
        row_number() OVER (PARTITION BY p.a, place ORDER BY score DESC, vec_id NULLS LAST) AS rank
    FROM positives AS p JOIN scores AS s ON s.a = p.a AND NOT same
        AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 5
"""
