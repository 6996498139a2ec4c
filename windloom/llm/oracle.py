"""SQL for the pN_ queries that SQL can express, for DuckDB."""

#: One character of Unicode white space, for RE2.
WHITE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: Number of WordPunct tokens of ``text``.
TOKENS = rf"len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WHITE}]+'))"

_SEPARATOR = rf".,;:!?()\[\]{{}}\"«»“”„’''|/=<>*•{WHITE}"
_SENTENCE_END = rf'[.!?]["”»’)]?(?:[{WHITE}]|$)'


def _count(pattern: str, text: str = "t") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


#: Texts and entries with their words, lines and plain words; the statistics of problem 1 are quotients of their counts.
STATISTICS = rf"""
    i AS (SELECT DISTINCT page_id, item, t FROM (
        SELECT page_id, 0 AS item, text AS t FROM pages_out UNION ALL
        SELECT page_id, k AS item, tables[k] AS t FROM (SELECT page_id, tables, unnest(range(1, len(tables) + 1)) AS k FROM pages_out WHERE tables IS NOT NULL))
        WHERE regexp_matches(t, '[^{WHITE}]')),
    w AS (SELECT *, regexp_extract_all(t, '[^{WHITE}]+') AS w, regexp_extract_all(lower(t), '[^{_SEPARATOR}]+') AS p,
        list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^[{WHITE}]+|[{WHITE}]+$', '', 'g')), lambda x: x <> '') AS l FROM i),
    n AS (SELECT *, len(w) AS n, {_count(f'[^{WHITE}]')} AS solid, {_count(r'[\p{L}\p{N}]')} AS alnum, {_count(r'\p{Nd}')} AS digits, {_count(r'[A-Za-zÀ-ɏ]')} AS latin,
        {_count('[aeouAEOUáàâäãéèêëóòôöõúùûü]')} AS vowels, common FROM w, (SELECT list(DISTINCT lower(word)) AS common FROM common_words))
"""

#: Tokens of every listed source.
HAVE = f"""
    d AS (SELECT DISTINCT doc_id, lower(trim(source)) AS s, {TOKENS} AS tokens FROM documents),
    h AS (
        SELECT t.source, t.target_share, t.max_repeats, coalesce(sum(d.tokens), 0)::BIGINT AS tokens
        FROM mix_targets t LEFT JOIN d ON d.s = lower(trim(t.source)) GROUP BY ALL
    ),
    m AS (SELECT *, target_share * (SELECT sum(tokens) FROM h) AS needed, tokens * max_repeats AS reachable FROM h)
"""

ORACLE = {
    "p1_statistics": rf"""
        WITH {STATISTICS}
        SELECT page_id, item, n AS words, round(solid / n, 6) AS mean_word_length, round((solid - alnum) / solid, 6) AS symbol_ratio, round(digits / solid, 6) AS digit_ratio,
            round(len(list_filter(p, lambda x: list_contains(common, x))) / greatest(len(p), 1), 6) AS common_word_share,
            round(len(list_filter(l, lambda x: regexp_matches(x, '[.!?:;,”"]$'))) / greatest(len(l), 1), 6) AS punctuated_line_share, round(n / greatest(len(l), 1), 6) AS words_per_line,
            round(len(list_distinct(w)) / n, 6) AS distinct_word_share, round(vowels / greatest(latin, 1), 6) AS vowel_share,
            round(len(list_filter(p, lambda x: regexp_matches(x, '^\p{{L}}+$'))) / greatest(len(p), 1), 6) AS alphabetic_word_share,
            round(len(list_filter(l, lambda x: regexp_matches(x, '^(?:[-*•o–][{WHITE}]|\[(?:\p{{Nd}}{{0,3}}|[ xX])\]|\(?[\p{{L}}\p{{N}}_]{{1,3}}[.)][{WHITE}])'))) / greatest(len(l), 1), 6) AS marked_line_share,
            round(len(list_filter(l, lambda x: contains(x, '  ') OR contains(x, chr(9)))) / greatest(len(l), 1), 6) AS gap_line_share, round({_count('[|;]')} / n, 6) AS cell_marks_per_word,
            round(len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Lu}}'))) / n, 6) AS capital_word_share, round({_count(_SENTENCE_END)} / n, 6) AS sentence_ends_per_word,
            round(len(list_filter(w, lambda x: regexp_matches(x, '^[-–−+±(]*\p{{Nd}}[\p{{Nd}}.,)%-]*$'))) / n, 6) AS numeric_word_share,
            round(greatest(solid - digits - latin - (solid - alnum), 0) / solid, 6) AS other_script_share FROM n
    """,
    "p4_found": f"""
        SELECT DISTINCT page_id FROM pages_out
        WHERE len(regexp_extract_all(text, '[^{WHITE}]+')) > 420
    """,
    "p4_sizes": f"""
        SELECT DISTINCT page_id, n AS n_words, length(text) AS n_chars, true AS within, n > 420 AS cut
        FROM (SELECT page_id, text, len(regexp_extract_all(text, '[^{WHITE}]+')) AS n FROM pages_out WHERE text IS NOT NULL)
    """,
    "p6_found": f"SELECT DISTINCT doc_id FROM documents WHERE {TOKENS} > 1024",
    "p7_found": f"WITH {HAVE} SELECT DISTINCT source FROM m WHERE reachable < needed",
    "p7_plan": f"""
        WITH {HAVE} SELECT source, tokens, round(needed, 5) AS needed, round(least(reachable, needed), 5) AS planned, reachable >= needed AS feasible, true AS kept FROM m
    """,
    "p8_found": """
        WITH w AS (SELECT DISTINCT doc_id, substring(text, i, 300) AS x FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)),
        several AS (SELECT x FROM w GROUP BY x HAVING count(*) > 1)
        SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM w a JOIN several USING (x) JOIN w b USING (x) WHERE a.doc_id < b.doc_id
    """,
    "p6_totals": f"SELECT count(*) AS n_records, sum(tokens)::BIGINT AS n_tokens, true AS within, true AS whole FROM (SELECT DISTINCT doc_id, {TOKENS} AS tokens FROM documents WHERE doc_id IS NOT NULL)",
    "p8_shared_parts": """
        WITH t AS (SELECT min(doc_id) AS id, count(DISTINCT doc_id) AS copies, text, length(text) AS n_chars FROM documents WHERE length(text) >= 300 GROUP BY text),
        w AS (SELECT id, i, substring(text, i, 300) AS x FROM (SELECT id, text, unnest(range(1, n_chars - 298)) AS i FROM t)),
        several AS (SELECT x FROM w GROUP BY x HAVING count(DISTINCT id) > 1),
        s AS (SELECT id, i, coalesce(lag(i) OVER (PARTITION BY id ORDER BY i) + 300, 0) AS reach FROM w JOIN several USING (x)),
        c AS (SELECT id, sum(i + 300 - greatest(i, reach))::BIGINT AS covered, count(*) FILTER (i > reach) AS n_spans FROM s GROUP BY id)
        SELECT id, copies, n_chars, CASE WHEN copies > 1 THEN n_chars ELSE covered END AS shared_chars, CASE WHEN copies > 1 THEN 1 ELSE n_spans END AS n_spans
        FROM t LEFT JOIN c USING (id) WHERE copies > 1 OR covered IS NOT NULL
    """,
}
ORACLE["p8_links"] = f"SELECT id, count(*) AS n_links FROM (SELECT unnest([doc_a, doc_b]) AS id FROM ({ORACLE['p8_found']})) GROUP BY id"
