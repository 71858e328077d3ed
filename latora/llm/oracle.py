"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from latora.llm import quality_rules, url_filter

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_words = lambda text: f"regexp_extract_all({_LOWER.format(f"coalesce({text}, '')")}, {_WORD})"

OP1 = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
b AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dg AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dg JOIN bw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY 1),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)"""


def _glob_pattern(glob: str) -> str:
    """A glob as a regular expression for a whole string."""
    out = ""
    for part in glob.replace("**", "\0").replace("*", "\1"):
        out += {"\0": "[\\s\\S]*", "\1": "[^/]*"}.get(part, f"\\{part}" if part in ".+()[]{}^$|?\\" else part)
    return out


def _url_sql() -> str:
    rules = sorted(url_filter.HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r[1]}{r[2]}'" for r in rules) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{r[1]}{r[2]}' THEN '{r[0]}'" for r in rules) + " WHEN glob_rule IS NOT NULL THEN 'block' ELSE 'allow' END"
    glob = "CASE " + " ".join(f"WHEN regexp_full_match(host || path, '{_glob_pattern(g)}') THEN '{g}'" for g in url_filter.BLOCK_GLOBS) + " END"
    return f"""
WITH r AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM r),
j AS (SELECT *, {rule} AS rule, {glob} AS glob_rule FROM s)
SELECT page_id, host, path, rule, {verdict} AS verdict, glob_rule FROM j"""


OP7 = _url_sql()


def _rules_sql() -> str:
    lists = quality_rules.COMMON_WORDS
    common = sorted({w for words in lists.values() for w in words})
    # the characters of each class, as regular expression sets
    sets = ["a-z", "A-Z", "0-9", r" \t", r"\n\r\x0b\x0c", r".,;:?!''""" + '"' + r"()\-", r"#*$%&|<>"]
    ascii_ = "".join(sets)
    counts = [f"length(regexp_replace(t, '[^{s}]', '', 'g'))" for s in sets] + [r"length(regexp_replace(t, '[\x00-\x7F]', '', 'g'))", rf"length(regexp_replace(t, '[{ascii_}]|[^\x00-\x7F]', '', 'g'))"]
    classes = f"[{', '.join(counts)}]"
    langs = ", ".join(f"'{k}'" for k in lists)
    jsd = lambda own, ref: f"list_sum(list_transform(range(1, len({own}) + 1), lambda i: (CASE WHEN {own}[i] > 0 THEN {own}[i] * log2(2 * {own}[i] / ({own}[i] + {ref}[i])) ELSE 0 END + CASE WHEN {ref}[i] > 0 THEN {ref}[i] * log2(2 * {ref}[i] / ({own}[i] + {ref}[i])) ELSE 0 END) / 2))"
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) AS bytes, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
vocab AS (SELECT unnest([{", ".join(f"'{w}'" for w in common)}]) AS word, unnest(range(1, {len(common) + 1})) AS k),
c AS (SELECT *, {classes} AS cls FROM d),
tok AS (SELECT doc_id, lang, {_LOWER.format("unnest(w)")} AS word FROM d),
known AS (SELECT doc_id, any_value(lang) AS lang, k, count(*) AS n FROM tok JOIN vocab USING (word) GROUP BY doc_id, k),
bins AS (SELECT c.doc_id, [coalesce(m[k], 0) FOR k IN range(1, {len(common) + 1})] AS b FROM c LEFT JOIN (SELECT doc_id, map_from_entries(list((k, n))) AS m FROM known GROUP BY doc_id) USING (doc_id)),
full_bins AS (SELECT doc_id, list_append(b, len(w) - list_sum(b)) AS b FROM bins JOIN c USING (doc_id)),
ref AS (SELECT lang, [{", ".join(f"sum(cls[{k}])::DOUBLE" for k in range(1, len(counts) + 1))}] AS rc, [{", ".join(f"sum(b[{k}])::DOUBLE" for k in range(1, len(common) + 2))}] AS rb FROM c JOIN full_bins USING (doc_id) WHERE lang IN ({langs}) GROUP BY lang),
share AS (SELECT lang, list_transform(rc, lambda x: x / list_sum(rc)) AS rc, list_transform(rb, lambda x: x / list_sum(rb)) AS rb FROM ref),
own AS (SELECT doc_id, lang, bytes, len(w) AS n, list_transform(cls, lambda x: x::DOUBLE / greatest(list_sum(cls), 1)) AS oc, list_transform(b, lambda x: x::DOUBLE / greatest(list_sum(b), 1)) AS ob FROM c JOIN full_bins USING (doc_id)),
dv AS (SELECT doc_id, min(CASE WHEN bytes >= {quality_rules.MIN_CHARS} THEN {jsd("oc", "rc")} END) AS dc, min(CASE WHEN n >= {quality_rules.MIN_WORDS} THEN {jsd("ob", "rb")} END) AS dw FROM own JOIN share ON own.lang = share.lang OR own.lang IS NULL OR own.lang NOT IN (SELECT lang FROM share) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, w[i : i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1) GROUP BY doc_id),
base AS (SELECT c.doc_id, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars, cls[7] AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, dc, dw FROM c LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN dv USING (doc_id)),
f AS (SELECT *, n_words < {quality_rules.MIN_BASE_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND coalesce(dc, 0) <= {quality_rules.MAX_CLASS_DIVERGENCE} AND coalesce(dw, 0) <= {quality_rules.MAX_WORD_DIVERGENCE} AS kept, round(dc, 6) + 0.0 AS class_divergence, round(dw, 6) + 0.0 AS word_divergence FROM f"""


OP9 = _rules_sql()
