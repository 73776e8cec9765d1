"""SQL for the operators that SQL can express, for DuckDB over the same tables.

The others have none: fingerprints by XXH64 (5), tokenizers (3, 4), the trained span
classifier (2) and name-based identifiers (10) are out of its reach, and strings of 50
bytes at every position (8) take it minutes; tests/llm holds them against brute-force
versions.
"""

from __future__ import annotations

from . import chat, decontam, quality, substring

_SPACE = r"[\x20\x09-\x0D]"
_DOCS = "SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, * EXCLUDE (doc_id, text) FROM documents"
_WORDS = rf"list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '')"


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def quality_rules() -> str:
    bounds = []
    for rule in quality.RULES:
        bounds += [f"coalesce({rule.metric} >= {rule.low}, true)"] if rule.low is not None else []
        bounds += [f"coalesce({rule.metric} <= {rule.high}, true)"] if rule.high is not None else []
    languages = ", ".join(f"'{k}'" for k in quality.STOP_WORDS)
    names = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"
    share = "CASE WHEN {b} > 0 THEN {a} / {b} END".format
    return rf"""
    WITH d AS ({_DOCS}),
    w AS (SELECT r, doc_id, lang, t, {_WORDS} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    win AS (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w),
    again AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i:i + 7]) AS n FROM win),
    covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, range(0, 8) AS s(k) WHERE n > 1 GROUP BY r),
    m AS (
      SELECT doc_id, lang, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines,
        len(list_filter(ws, lambda x: list_contains({_quoted(quality._stop_words())}, x))) AS n_stop,
        len(list_filter(ls, lambda x: regexp_matches(x, '^{_SPACE}*[-*•]{_SPACE}'))) AS n_bullet,
        len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…){_SPACE}*$'))) AS n_ellipsis
      FROM w LEFT JOIN covered USING (r)),
    q AS (
      SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        {share(a="word_chars", b="n_words")} AS mean_word_chars, {share(a="n_symbols", b="n_words")} AS symbol_ratio,
        CASE WHEN lang IN ({languages}) THEN {share(a="n_stop", b="n_words")} END AS stop_ratio, {share(a="n_dup_lines", b="n_lines")} AS dup_line_ratio,
        {share(a="n_bullet", b="n_lines")} AS bullet_line_ratio, {share(a="n_ellipsis", b="n_lines")} AS ellipsis_line_ratio
      FROM m)
    SELECT {names}, base_failed, NOT base_failed AND {" AND ".join(bounds)} AS kept, round(mean_word_chars, 6) AS mean_word_chars,
      round(symbol_ratio, 6) AS symbol_ratio, round(stop_ratio, 6) AS stop_ratio, round(dup_line_ratio, 6) AS dup_line_ratio FROM q"""


def substring_dedup() -> str:
    n = substring.WORDS
    return rf"""
    WITH d AS ({_DOCS}),
    w AS (SELECT r, doc_id, {_WORDS} AS ws FROM d),
    win AS (SELECT r, doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w),
    late AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY ws[i:i + {n - 1}]) AS first FROM win) WHERE first < doc_id),
    gone AS (SELECT DISTINCT r, i + k AS i FROM late, range(0, {n}) AS s(k)),
    words AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
    kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
    SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)"""


def decontamination() -> str:
    n = decontam.WINDOW
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    words = rf"list_filter(regexp_split_to_array(translate(t, {letters}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return rf"""
    WITH d AS ({_DOCS}),
    w AS (SELECT r, doc_id, {words} AS ws FROM d),
    item AS (SELECT item_id::VARCHAR AS item, {words} AS ws FROM (SELECT item_id, coalesce(text, '') AS t FROM benchmark WHERE item_id IS NOT NULL)),
    size AS (SELECT item, ws, least({n}, len(ws)) AS m FROM item WHERE len(ws) > 0),
    pattern AS (SELECT DISTINCT item, m, ws[i:i + m - 1] AS g FROM (SELECT item, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM size)),
    win AS (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT DISTINCT m FROM pattern)),
    hit AS (SELECT r, i, win.m AS m, item FROM win JOIN pattern ON win.m = pattern.m AND ws[i:i + win.m - 1] = g),
    found AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY r),
    covered AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM hit, range(0, {n}) AS s(k) WHERE k < m GROUP BY r)
    SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
      sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(len(items), 0) >= {decontam.MIN_ITEMS} AS contaminated
    FROM w LEFT JOIN covered USING (r) LEFT JOIN found USING (r)"""


def chat_formatting() -> str:
    order = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"
    escaped = r"regexp_replace({0}, '<(\\*)\|', '<\1\\|', 'g')".format
    role = escaped(r"replace(replace(r, '%', '%25'), chr(10), '%0A')")
    marks = len(chat.chat_template([("", "")]))
    return rf"""
    WITH c AS (
      SELECT conv_id, turn, role, text FROM conversations UNION ALL
      SELECT {chat.PROBE_ID}, turn, role, '{chat.PROBE_TEXT}' FROM (VALUES (0, 'user'), (1, '{chat.LOSS_ROLE}')) p(turn, role)),
    t AS (SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS x FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' {order})) AS turns_sha256,
      coalesce(sum(length(x)) FILTER (WHERE r = '{chat.LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(x, '' {order}) FILTER (WHERE r = '{chat.LOSS_ROLE}'), '')) AS loss_sha256,
      sum({marks} + length({role}) + length({escaped("x")}))::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules(),
        "op6_substring_dedup": substring_dedup(),
        "op7_chat_formatting": chat_formatting(),
        "op9_decontamination": decontamination(),
    }
