"""SQL forms of the queries that SQL can express."""

from __future__ import annotations

WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATE = f"""
    WITH item_words AS (
        SELECT item_id, ws, least(len(ws), 10) AS k FROM (SELECT item_id, {WORDS} AS ws FROM benchmark) WHERE len(ws) > 0
    ),
    item_windows AS (
        SELECT DISTINCT item_id, k, array_to_string(ws[i + 1:i + k], ' ') AS w
        FROM (SELECT *, unnest(range(len(ws) - k + 1)) AS i FROM item_words)
    ),
    doc_words AS (SELECT doc_id, coalesce({WORDS}, []) AS ws FROM documents),
    doc_windows AS (
        SELECT doc_id, k, i, array_to_string(ws[i + 1:i + k], ' ') AS w
        FROM (
            SELECT doc_id, k, ws, unnest(range(greatest(len(ws) - k + 1, 0))) AS i
            FROM doc_words, (SELECT DISTINCT k FROM item_words)
        )
    ),
    hits AS (SELECT d.doc_id, d.k, d.i, m.item_id FROM doc_windows d JOIN item_windows m ON d.k = m.k AND d.w = m.w),
    covered AS (
        SELECT doc_id, count(DISTINCT place) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM hits) GROUP BY doc_id
    ),
    named AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
        CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

SUBSTRINGS = """
    WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    parts AS (
        SELECT doc_id, c * 256 AS base, least(256, n - c * 256) AS own, greatest(least(256, n - 99 - c * 256), 0) AS fits,
            substr(h, 512 * c + 1, 710) AS part
        FROM (SELECT doc_id, h, len(h) // 2 AS n, unnest(range((len(h) // 2 + 255) // 256)) AS c FROM texts)
    ),
    windows AS (
        SELECT doc_id, base + i AS p, md5_number(substr(part, 2 * i + 1, 200)) AS w
        FROM (SELECT doc_id, base, part, unnest(range(fits)) AS i FROM parts)
    ),
    firsts AS (SELECT w, min(doc_id * 1000000000 + p) AS place FROM windows GROUP BY w HAVING count(*) > 1),
    later AS (
        SELECT doc_id, p FROM windows JOIN firsts USING (w) WHERE doc_id * 1000000000 + p > place
    ),
    bytes AS (
        SELECT doc_id, base + i AS p, substr(part, 2 * i + 1, 2) AS b
        FROM (SELECT doc_id, base, part, unnest(range(own)) AS i FROM parts)
    ),
    marked AS (
        SELECT b.doc_id, b.p, b.b, coalesce(max(l.p) OVER (PARTITION BY b.doc_id ORDER BY b.p), -100) > b.p - 100 AS gone
        FROM bytes b LEFT JOIN later l ON b.doc_id = l.doc_id AND b.p = l.p
    ),
    edges AS (
        SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM marked
    ),
    counted AS (
        SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
            string_agg(b, '' ORDER BY p) FILTER (WHERE NOT gone) AS kept
        FROM edges GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
        coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
    FROM texts LEFT JOIN counted USING (doc_id)
"""

LINES = """
    WITH lines AS (
        SELECT doc_id, unnest(range(len(parts))) AS line, unnest(parts) AS content, len(parts) AS n
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
    ),
    pairs AS (
        SELECT *, lead(content) OVER (PARTITION BY doc_id ORDER BY line) AS next_content FROM lines
    ),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY content, next_content ORDER BY doc_id, line) AS place FROM pairs
    ),
    starts AS (SELECT doc_id, line, line + 1 < n AND place > 1 AS later FROM ranked),
    marked AS (
        SELECT l.doc_id, l.line, l.content,
            s.later OR coalesce(lag(s.later) OVER (PARTITION BY l.doc_id ORDER BY l.line), false) AS gone
        FROM lines l JOIN starts s ON l.doc_id = s.doc_id AND l.line = s.line
    ),
    edges AS (
        SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY line), false) AS opens FROM marked
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
        count(*) FILTER (WHERE opens) AS n_runs,
        sha256(coalesce(string_agg(content, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM edges GROUP BY doc_id
"""

RUNS = """
    WITH numbered AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
            list_reduce(
                list_prepend(CAST(4294967295 AS BIGINT), CAST(range(8 * len(CAST(doc_id AS VARCHAR))) AS BIGINT[])),
                lambda c, k: (CASE
                    WHEN xor(c, CASE WHEN k % 8 = 0 THEN ascii(substr(CAST(doc_id AS VARCHAR), CAST(k // 8 + 1 AS INTEGER), 1)) ELSE 0 END) % 2 = 1
                    THEN xor(xor(c, CASE WHEN k % 8 = 0 THEN ascii(substr(CAST(doc_id AS VARCHAR), CAST(k // 8 + 1 AS INTEGER), 1)) ELSE 0 END) // 2, 3988292384)
                    ELSE xor(c, CASE WHEN k % 8 = 0 THEN ascii(substr(CAST(doc_id AS VARCHAR), CAST(k // 8 + 1 AS INTEGER), 1)) ELSE 0 END) // 2 END)
            ) AS c
        FROM documents
    ),
    placed AS (
        SELECT doc_id, ws, len(ws) AS n, h, a, 1 + (len(ws) - a) // (3 + (h // 10) % 8) AS p
        FROM (SELECT *, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) ELSE 0 END AS a FROM (SELECT *, xor(c, 4294967295) AS h FROM numbered))
    ),
    words AS (
        SELECT doc_id, i, ws[CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS w
        FROM (SELECT *, unnest(range(n)) AS i FROM placed)
    ),
    equal_words AS (
        SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i < y.i
    ),
    islands AS (
        SELECT doc_id, q, min(i) AS start, count(*) + q AS length
        FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal_words)
        GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(12, 2 * q)
    ),
    runs AS (SELECT doc_id, start, length, min(q) AS period FROM islands GROUP BY doc_id, start, length),
    best AS (
        SELECT doc_id, count(*) AS n_runs, max(ROW(length, -start, -period)) AS top,
            string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
        FROM runs GROUP BY doc_id
    ),
    dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
    kept AS (
        SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text
        FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
    )
    SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(-top[2] AS BIGINT) AS start,
        CAST(top[1] AS BIGINT) AS length, CAST(-top[3] AS BIGINT) AS period,
        CAST(1000 * top[1] // -top[3] AS BIGINT) AS exponent_milli,
        sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
    FROM documents d LEFT JOIN best ON d.doc_id = best.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
