"""DuckDB SQL of the operators that have an exact answer in SQL, as stated by their contracts."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"


def _count(pattern: str, flags: str = "t") -> str:
    """Characters of the text that a class matches."""
    return f"length({flags}) - length(regexp_replace({flags}, '{pattern}', '', 'g'))"


RULES = rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM base) x),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) x WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM often, (SELECT unnest([0, 1, 2]) AS k) ks GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM base) x WHERE regexp_matches(l, {_WORD}) GROUP BY doc_id),
counts AS (SELECT base.doc_id, t, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars, {_count('[#*$%&|<>]')} AS n_symbols,
 CAST(coalesce(lines.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines,
 {_count('[A-Z]')} AS upper, {_count('[A-Za-z]')} + strlen(t) - length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) AS letters, {_count('[!?]')} AS shout, strlen(t) - ({_count(r'[\x20\x09-\x0D]')}) AS solid
 FROM base LEFT JOIN lines ON lines.doc_id = base.doc_id LEFT JOIN covered ON covered.doc_id = base.doc_id),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 100 * n_symbols > 8 * word_chars OR 100 * n_dup_lines > 50 * greatest(n_lines, 1) OR word_chars < 2 * n_words OR word_chars > 20 * n_words
 OR upper > 0.5 * greatest(letters, 1) OR shout > 0.1 * greatest(word_chars, 1) OR letters < 0.5 * greatest(solid, 1)) AS kept FROM judged
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
linked AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, linked.y FROM reach JOIN linked ON linked.x = reach.b),
component AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT x, count(*) AS n_links FROM linked GROUP BY x)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN component ON a = vec_id LEFT JOIN n ON x = vec_id
"""

NGRAMS = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
linked AS MATERIALIZED (SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 70 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, linked.y FROM reach JOIN linked ON linked.x = reach.b),
component AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), links AS (SELECT x, count(*) AS n FROM linked GROUP BY x)
SELECT d.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(links.n, 0) AS BIGINT) AS n_similar, component_id
FROM documents d JOIN component ON a = d.doc_id LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN links ON x = d.doc_id
"""
