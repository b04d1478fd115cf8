"""DuckDB SQL for the corpus queries that it can express: whole results, or the base columns of those that have a model."""

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_EMBEDDINGS = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, vec_id <= coalesce(c.least, vec_id) AS kept
FROM (SELECT DISTINCT vec_id FROM embeddings) e LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""

_SUBSTRINGS = """
WITH d AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
    SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS x FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS s FROM d)
), again AS (
    SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS k FROM w) WHERE k > 1
), marked AS (
    SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS opens FROM again
), runs AS (
    SELECT doc_id, min(s) AS a, max(s) + 100 AS b
    FROM (SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked) GROUP BY doc_id, run
), gaps AS (
    SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS low FROM runs
), kept AS (
    SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(substr(h, 2 * low + 1, 2 * (a - low)), '' ORDER BY a) AS k
    FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(k || substr(h, 2 * tail + 1), h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_JACCARD = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) END AS g FROM w
), t AS (
    SELECT doc_id, x FROM (SELECT doc_id, unnest(g) AS x FROM s) QUALIFY count(*) OVER (PARTITION BY x) > 1
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
    SELECT a, b FROM shared JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * c >= 90 * (len(p.g) + len(q.g) - c)
), reach AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, coalesce(c.least, doc_id)) AS component_id FROM s LEFT JOIN c ON c.a = doc_id
"""

_PERSONAL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (
    SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS e,
        regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS i,
        list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS c,
        list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS p FROM d
)
SELECT doc_id, CAST(len(e) AS BIGINT) AS n_email,
    CAST(len(list_filter(i, lambda x: len(list_filter(string_split(x, '.'), lambda y: CAST(y AS HUGEINT) > 255)) = 0)) AS BIGINT) AS n_ip,
    CAST(len(list_filter(c, lambda x: length(x) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(x) + 1),
        lambda k: CASE WHEN k % 2 = 1 THEN CAST(substr(x, length(x) + 1 - k, 1) AS INT)
            ELSE (2 * CAST(substr(x, length(x) + 1 - k, 1) AS INT)) % 10 + (2 * CAST(substr(x, length(x) + 1 - k, 1) AS INT)) // 10 END)) % 10 = 0)) AS BIGINT) AS n_card,
    CAST(len(list_filter(p, lambda x: length(x) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone
FROM m
"""

_LICENSES = rf"""
WITH w AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), p AS (
    SELECT doc_id, len(ws) AS n,
        [i - 1 for i in range(1, len(ws) + 1) if ws[i:i + 3] = ['under', 'the', 'mit', 'license']] AS m,
        [i - 1 for i in range(1, len(ws) + 1) if ws[i:i + 3] = ['apache', 'license', 'version', '2']] AS a,
        [i - 1 for i in range(1, len(ws) + 1) if ws[i:i + 2] = ['cc', 'by', 'nc']] AS c FROM w
)
SELECT doc_id, n AS n_words, CAST(len(m) + len(a) + len(c) AS BIGINT) AS n_base, list_min(m || a || c) AS first_word, list_max(m || a || c) AS last_word,
    array_to_string(list_filter([CASE WHEN len(a) > 0 THEN 'apache-2' END, CASE WHEN len(c) > 0 THEN 'cc-by-nc' END, CASE WHEN len(m) > 0 THEN 'mit' END], lambda x: x IS NOT NULL), ',') AS base_labels
FROM p
"""

_QUALITY = rf"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents
), g AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)
), r AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    len(ws) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(ws) AS base_failed
FROM d LEFT JOIN r USING (doc_id)
"""

SQL = {"op1_embedding_pq": _EMBEDDINGS, "op2_suffix_dedup": _SUBSTRINGS, "op8_ngram_jaccard": _JACCARD, "pii_base": _PERSONAL, "license_base": _LICENSES, "quality_base": _QUALITY}
