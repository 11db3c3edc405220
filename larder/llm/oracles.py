"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

from . import quality

_WS = r"[\x20\x09-\x0D]"
_NOT_WS = r"[^\x20\x09-\x0D]"
_ALPHABET = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STOPS = ", ".join(f"'{w}'" for w in sorted({x for v in quality.STOP_WORDS.values() for x in v}))


def _broken(rule: quality.Rule) -> str:
    parts = [f"{rule.measure} < {rule.low}"] if rule.low is not None else []
    parts += [f"{rule.measure} > {rule.high}"] if rule.high is not None else []
    return f"(n_words >= {rule.at_least} AND ({' OR '.join(parts)}))"


def _ratio(a: str, b: str, name: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE {a}::DOUBLE / {b}::DOUBLE END AS {name}"


_QUALITY = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{_WS}+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_NOT_WS}')) AS l FROM t),
p AS (SELECT doc_id, p, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM s WHERE len(w) >= 5)),
d AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM d) GROUP BY doc_id),
m AS (SELECT s.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_WS}+', '', 'g'))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words,
  len(list_filter(l, lambda x: regexp_matches(x, '^{_WS}*[-*•‣▪]{_WS}'))) AS n_bullet_lines, len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…){_WS}*$'))) AS n_ellipsis_lines, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_alpha_words
  FROM s LEFT JOIN r USING (doc_id)),
k AS (SELECT *, {_ratio("word_chars", "n_words", "mean_word_chars")}, {_ratio("n_symbols", "n_words", "symbols_per_word")}, {_ratio("n_stop_words", "n_words", "stop_word_ratio")}, {_ratio("n_bullet_lines", "n_lines", "bullet_line_ratio")},
  {_ratio("n_ellipsis_lines", "n_lines", "ellipsis_line_ratio")}, {_ratio("n_dup_lines", "n_lines", "dup_line_ratio")}, {_ratio("n_alpha_words", "n_words", "alpha_word_ratio")}, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(_broken(r) for r in quality.RULES)}) AS kept FROM k
"""

_SPLIT = r"list_filter(string_split_regex({0}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')".format(_ALPHABET.format("coalesce(text, '')"))
_CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
i AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_SPLIT} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[j : j + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS j FROM i)),
pos AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT DISTINCT doc_id, p, n, item_id FROM pos JOIN win USING (n, s)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)
"""


def _escaped(x: str) -> str:
    return f"length(replace(replace({x}, '\\', '\\\\'), '<|', '<\\|'))"


_CHATS = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(32 + {_escaped("role")} + {_escaped("text")})::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
"""

_STRIPPED = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_LINES = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents),
k AS (SELECT *, CASE WHEN length({_STRIPPED}) >= 10 THEN {_ALPHABET.format(_STRIPPED)} END AS key FROM l),
f AS (SELECT *, key IS NULL OR min(doc_id) OVER (PARTITION BY key) = doc_id AS stays FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256 FROM f GROUP BY doc_id
"""

SQL: dict[str, str] = {"op1_quality_rules": _QUALITY, "op6_decontaminate": _CONTAMINATION, "op8_chat_format": _CHATS, "op9_line_dedup": _LINES}
