"""SQL for DuckDB with the rows of the corpus queries."""

OP3 = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

OP4 = """
WITH digests AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), grouped AS (
    SELECT *, min(page_id) OVER (PARTITION BY html) AS first_page FROM digests
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((('0x' || substr(h, CAST((i // 8) * 10 + 1 AS INTEGER), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1 AS INTEGER), 1)), '')
           AS payload_digest,
       CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_page THEN NULL ELSE first_page END AS refers_to
FROM grouped
"""

OP5 = """
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
    FROM documents
), by_source AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM by_source
), limited AS (
    SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
           CAST(source_size * 3 AS DOUBLE) AS top
    FROM weighed
), running AS (
    SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
           coalesce(sum(top) OVER (ORDER BY top / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
           sum(weight) OVER (ORDER BY top / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
    FROM limited
), level AS (
    SELECT first((total - used) / rest ORDER BY top / weight, rank) AS share
    FROM running WHERE (total - used) / rest <= top / weight
), targets AS (
    SELECT source, source_size, CASE WHEN share IS NULL THEN top ELSE least(top, share * weight) END AS target
    FROM running LEFT JOIN level ON true
), placed AS (
    SELECT *, row_number() OVER (
        PARTITION BY source ORDER BY size, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 2))::BIGINT, doc_id) - 1 AS position
    FROM sized
), rated AS (
    SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
           ('0x' || substr(md5('mix' || coalesce(p.source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
    FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
), counted AS (
    SELECT *, CAST(least(floor(rate * (position + 1) + shift) - floor(rate * position + shift), 3) AS BIGINT) AS copies FROM rated
)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM counted
"""

OP9 = """
WITH words AS (
    SELECT doc_id, source, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
), windows AS (
    SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS body
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM words)
), repeated AS (
    SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, body) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT doc_id, count(DISTINCT p + k) AS n FROM repeated, (SELECT unnest(range(8)) AS k) GROUP BY doc_id
), counts AS (
    SELECT s.doc_id, s.source, CAST(len(w) AS BIGINT) AS n_words,
           CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
           CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
                - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
    FROM words s LEFT JOIN covered c ON s.doc_id = c.doc_id
), judged AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
), hosts AS (
    SELECT source, count(*) AS docs, count(*) FILTER (base_failed) AS failed FROM judged GROUP BY source
), moments AS (
    SELECT sum(failed) / sum(docs) AS mean, sum(docs * (failed / docs) * (failed / docs)) / sum(docs) AS squares,
           count(*) / sum(docs) AS per_doc
    FROM hosts
), strength AS (
    SELECT mean, greatest(mean * (1 - mean)
        / greatest(squares - mean * mean - mean * (1 - mean) * per_doc, mean * (1 - mean) / 1001, 1e-9) - 1, 1.0) AS s
    FROM moments
), prior AS (
    SELECT mean * s AS alpha, (1 - mean) * s AS beta FROM strength
), verdicts AS (
    SELECT source, (failed + alpha) / (docs + alpha + beta) <= 0.5 AS host_kept FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source
"""

OP13 = """
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
), marks AS (
    SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id
), judged AS (
    SELECT t.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
           [len(w) < 50,
            100 * len(list_distinct(w)) < 65 * len(w),
            100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text),
            regexp_matches(text, '[#$%&*|]'),
            coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY t.text), false)] AS fails
    FROM texts t LEFT JOIN marks m ON t.doc_id = m.doc_id
), profiles AS (
    SELECT part, fails, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL
), letters AS (
    SELECT unnest(range(1, 6)) AS f
), orders AS (
    SELECT [a.f, b.f, c.f, d.f, e.f] AS places,
           substr('ABCDE', a.f, 1) || substr('ABCDE', b.f, 1) || substr('ABCDE', c.f, 1) || substr('ABCDE', d.f, 1) || substr('ABCDE', e.f, 1) AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
    SELECT filter_order, places, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders
), seen AS (
    SELECT part, filter_order, step, places[step] AS f, docs, good, toxic,
           fails[places[step]] AS fails_now,
           list_bool_or(list_transform(places[1:step - 1], lambda x: fails[x])) IS TRUE AS gone,
           len(list_filter(fails, lambda x: x)) = 1 AS once
    FROM profiles, steps
), counted AS (
    SELECT part, filter_order, step, f,
           CAST(coalesce(sum(docs) FILTER (NOT gone AND NOT fails_now), 0) AS BIGINT) AS kept,
           CAST(coalesce(sum(docs) FILTER (NOT gone AND fails_now), 0) AS BIGINT) AS removed,
           CAST(coalesce(sum(docs) FILTER (gone AND fails_now), 0) AS BIGINT) AS redundant,
           CAST(coalesce(sum(docs) FILTER (fails_now AND once), 0) AS BIGINT) AS unique_fails,
           CAST(coalesce(sum(good) FILTER (NOT gone AND fails_now), 0) AS BIGINT) AS good_lost,
           CAST(coalesce(sum(toxic) FILTER (NOT gone AND fails_now), 0) AS BIGINT) AS toxic_lost
    FROM seen GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

ORACLES = {
    "op3_exact_dedup": OP3,
    "op4_warc": OP4,
    "op5_mix_sources": OP5,
    "op9_quality_rules": OP9,
    "op13_filter_audit": OP13,
}
