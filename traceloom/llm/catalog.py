"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import decontaminate, hard_negatives, lexical_search, lm_score, mixing, packing, quality_crf, quality_rules, simhash, suffix_dedup, token_ids, toxicity, warc


def queries() -> dict:
    found = [
        quality_rules.op1_quality_rules,
        lm_score.op2_lm_scoring,
        simhash.op3_simhash_near_dedup,
        suffix_dedup.op4_suffix_array_dedup,
        quality_crf.op5_quality_classifier,
        mixing.op6_mixing,
        warc.op7_warc,
        toxicity.op8_toxicity,
        decontaminate.op9_benchmark_decontamination,
        token_ids.op10_token_ids,
        lexical_search.op11_ranked_lexical_search,
        packing.op12_packing,
        hard_negatives.op13_hard_negatives,
    ]
    return {f.__name__: f for f in found}


_WORD = r"[^\x20\x09-\x0D]+"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM c WHERE n > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols > 0.05 * word_chars OR n_dup_lines > 0.5 * n_lines AS rest_failed FROM m),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed OR rest_failed) AS fails FROM f GROUP BY host),
p AS (SELECT avg(fails / n) AS m, var_pop(fails / n) AS v FROM h),
s AS (SELECT m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 1.0) ELSE 1.0 END AS k FROM p),
v AS (SELECT host, (fails + s.m * s.k) / (n + s.k) AS rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR rest_failed) AND rate <= 0.5 AS kept, round(rate, 6) AS host_rate
FROM f JOIN v ON f.host = v.host"""

_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9_SQL = rf"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_FOLDED} AS w FROM benchmark),
x AS (SELECT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM x) WHERE len(w) >= k)),
m AS (SELECT doc_id, item, g.k, i FROM g JOIN x ON g.k = x.k AND g.gram = x.gram),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, CAST((k // 4) * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
g AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
i AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item, item_id, term, count(*) AS q FROM (SELECT item, item_id, unnest(w) AS term FROM i) GROUP BY ALL),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, g GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 25 + (75 * len(w) * n_docs) // n_terms AS m FROM d, g WHERE len(w) > 0),
s AS (SELECT item, item_id, r, doc_id, CAST(sum(q * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM t JOIN q USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""

OP13_SQL = """
WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS INTEGER) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS same, CAST(list_dot_product(a.v, e.v) AS BIGINT) AS score
      FROM (SELECT DISTINCT * FROM e WHERE vec_id % 50 = 0) a JOIN e ON a.vec_id IS DISTINCT FROM e.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, id AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


def oracle_sql() -> dict[str, str]:
    return {"op11_ranked_lexical_search": OP11_SQL, "op13_hard_negatives": OP13_SQL, "op1_quality_rules": OP1_SQL, "op7_warc": OP7_SQL, "op9_benchmark_decontamination": OP9_SQL}
