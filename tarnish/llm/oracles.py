"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]+"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> str:
    """The list of words of a text; NULL has none."""
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{SPACE}'), lambda w: w <> '')"


def shingles(table: str, key: str) -> str:
    return f"""
        SELECT DISTINCT {key}, array_to_string(list_slice(w, i, i + 4), ' ') AS s
        FROM (SELECT {key}, w, unnest(range(1, len(w) - 3)) AS i
              FROM (SELECT {key}, {words(f"translate(text, '{UP}', '{LOW}')")} AS w FROM {table}))"""


DECONTAMINATION = f"""
WITH items AS ({shingles("benchmark", "item_id")}),
     docs AS ({shingles("documents", "doc_id")}),
     sizes AS (SELECT item_id, count(*) AS n_shingles FROM items GROUP BY item_id),
     shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM docs JOIN items USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM shared JOIN sizes USING (item_id)
WHERE 5 * n_shared >= 4 * n_shingles
"""

URL_RULES = f"""
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UP}', '{LOW}') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules AS (
    SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                          ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS r(verdict, rule_host, rule_path)),
fits AS (
    SELECT *, (SELECT max_by({{'rule': rule_host || rule_path, 'verdict': verdict}}, length(rule_host || rule_path))
               FROM rules WHERE (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path)) AS best
    FROM parts)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM fits
"""

QUALITY_RULES = f"""
WITH split AS (
    SELECT doc_id, text, {words("text")} AS w, string_split(text, chr(10)) AS all_lines FROM documents),
cut AS (
    SELECT *, list_filter(all_lines, lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM split),
windows AS (
    SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM cut)),
twice AS (
    SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id),
counts AS (
    SELECT doc_id, text, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(all_lines) AS n_lines
    FROM cut LEFT JOIN covered USING (doc_id)),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR n_symbols > 0.25 * n_words
            OR n_dup_lines >= 3 AND n_dup_lines > 0.3 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}{{2,}}\\P{{L}}*$'))) > 0.4 * n_words
            OR len(list_filter(w, lambda x: NOT regexp_matches(x, '\\p{{L}}'))) > 0.4 * n_words
            OR len(list_filter(w, lambda x: ends_with(x, '!!'))) > 0.2 * n_words) AS kept
FROM base
"""

SUBSTRINGS = f"""
WITH split AS (SELECT doc_id, {words("text")} AS w FROM documents),
windows AS (
    SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM split)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY s) > 1),
covered AS (SELECT DISTINCT doc_id, i + k AS i FROM twice, range(35) AS r(k)),
places AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM split)),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
    FROM places ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""

SOURCE_AUDIT = f"""
WITH docs AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
    FROM documents),
words AS (SELECT row, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
own AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
of_lang AS (SELECT lang, term, sum(n) AS n FROM own GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, source, coalesce(sum(n), 0) AS size FROM groups LEFT JOIN own USING (lang, source) GROUP BY ALL),
lang_sizes AS (SELECT lang, sum(n) AS size FROM own GROUP BY lang),
q AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (size + 5 * v) AS q
    FROM of_lang JOIN lang_sizes USING (lang) JOIN v USING (lang)),
p AS (
    SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (size + 5 * v) AS p
    FROM sizes JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN own USING (lang, source, term)),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (
    SELECT lang, source, 'term' AS part, term AS item, p - q AS value
    FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def _nearest(book: str) -> str:
    """Each part's nearest entry of a codebook, the lower of equals, and its squared distance."""
    return f"""
        SELECT row, part, entry, away FROM (
            SELECT row, part, entry, sum((x - v) * (x - v)) AS away
            FROM parts JOIN {book} USING (part, place) GROUP BY row, part, entry)
        QUALIFY row_number() OVER (PARTITION BY row, part ORDER BY away, entry) = 1"""


def _moved(book: str, nearest: str) -> str:
    """The codebook with each used entry at the floor of the mean of its parts."""
    return f"""
        SELECT part, entry, place, coalesce(mean, v) AS v FROM {book} LEFT JOIN (
            SELECT part, entry, place, floor(sum(x)::DOUBLE / count(*))::BIGINT AS mean
            FROM parts JOIN {nearest} USING (row, part) GROUP BY part, entry, place) USING (part, entry, place)"""


VECTOR_CODES = f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, embedding AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
    SELECT row, (i - 1) // (len(e) // 16) AS part, (i - 1) % (len(e) // 16) AS place, floor(e[i]::DOUBLE * 256)::BIGINT AS x
    FROM (SELECT row, e, unnest(range(1, len(e) + 1)) AS i FROM kept)),
book_0 AS (SELECT part, row - 1 AS entry, place, x AS v FROM parts WHERE row <= 64),
near_0 AS ({_nearest("book_0")}),
book_1 AS ({_moved("book_0", "near_0")}),
near_1 AS ({_nearest("book_1")}),
book_2 AS ({_moved("book_1", "near_1")}),
near_2 AS ({_nearest("book_2")}),
codes AS (
    SELECT row, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(away)::BIGINT AS error
    FROM near_2 GROUP BY row),
digest AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM book_2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN codes USING (row) CROSS JOIN digest
"""

ORACLES = {
    "op1_substring_dedup": SUBSTRINGS,
    "op2_decontamination": DECONTAMINATION,
    "op4_quality_rules": QUALITY_RULES,
    "op6_url_rules": URL_RULES,
    "op11_source_audit": SOURCE_AUDIT,
    "op12_vector_codes": VECTOR_CODES,
}
