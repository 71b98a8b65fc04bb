"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from varloom.llm import secret_scan as secrets
from varloom.llm.quality_rules import GRID

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS k FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw)),
hit AS (SELECT doc_id, i, di.n, item FROM (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM di) di JOIN bw ON bw.k = di.k AND bw.n = di.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)"""

OP8 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w FROM documents),
wi AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d))),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM wi WHERE r > 1),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""

_LN_TAIL = "list_sum(list_transform(range(0, {k} + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))))"


def quality_sql(alpha: float = 0.02, delta: float = 0.05) -> str:
    share = alpha / len(GRID)
    counts = ", ".join(f"count(*) FILTER ({r} > {c}) AS {r}_{i}" for r, grid in GRID.items() for i, c in enumerate(grid))
    tests = f"((SELECT count(*) FROM per) * {sum(map(len, GRID.values()))})"
    cuts = []
    for r, grid in GRID.items():
        whens = " ".join(f"WHEN {r}_{i} < n * {share} AND {_LN_TAIL.format(k=f'{r}_{i}', p=share)} <= {delta} / {tests} THEN {c}" for i, c in enumerate(grid))
        cuts.append(f"CASE {whens} END AS cut_{r}")
    over = " OR ".join(f"coalesce({r} > cut_{r}, false)" for r in GRID)
    rate = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END"
    return rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS l FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w))),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, coalesce(again.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper FROM w LEFT JOIN again USING (doc_id)),
r AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {rate("n_symbols", "word_chars")} AS symbol_rate, {rate("n_repeat_words", "n_words")} AS repeat_rate, {rate("n_dup_lines", "n_lines")} AS dup_line_rate, {rate("n_upper", "word_chars")} AS upper_rate FROM m),
per AS (SELECT lang, count(*) AS n, {counts} FROM r WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang),
cuts AS (SELECT lang, {", ".join(cuts)} FROM per)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept FROM r LEFT JOIN cuts USING (lang)"""


def secrets_sql(most_owners: int = 2) -> str:
    def part(pattern: str, kind: int, least: int, group: int, also: str = "true") -> str:
        p = pattern.replace("'", "''")
        return f"""SELECT doc_id, source, {kind} AS k, v, list_sum(list_transform(list_slice(gaps, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(ms, 1, i - 1), lambda x: length(x))), 0) AS s, length(ms[i]) AS n FROM
  (SELECT doc_id, source, ms, gaps, i, vs[i] AS v FROM (SELECT doc_id, source, ms, gaps, vs, unnest(range(1, len(ms) + 1)) AS i FROM
    (SELECT doc_id, coalesce(source, '') AS source, regexp_extract_all(text, '{p}') AS ms, regexp_extract_all(text, '{p}', {group}) AS vs, string_split_regex(text, '{p}') AS gaps FROM documents WHERE regexp_matches(text, '{p}')))) WHERE length(v) >= {least} AND {also}"""

    mixed = "regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')"
    rows = " UNION ALL ".join([part(secrets.ASSIGN, 0, 12, 2), part(secrets.ACCESS, 1, 18, 0), part(secrets.HEX, 2, 16, 0), part(secrets.TOKEN, 3, 24, 0, mixed)])
    kinds = "['" + "', '".join(secrets.KINDS) + "']"
    span = f"({kinds})[k + 1] || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + n AS BIGINT) AS VARCHAR)"
    return f"""
WITH c AS ({rows}),
f AS (SELECT v, count(DISTINCT source) <= {most_owners} AS live FROM c GROUP BY v),
j AS (SELECT c.*, live FROM c JOIN f USING (v) WHERE k < 3 OR live),
a AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg({span}, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg({span}, ',' ORDER BY s, k) AS spans, count(*) FILTER (live) AS n_live FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live FROM documents LEFT JOIN a USING (doc_id)"""


#: The edit lattice turn by turn: for each state the least (cost, audit), with the repaired lines. crc32 bit by bit, over keys of ASCII.
OP13 = r"""
WITH RECURSIVE s AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: CAST(0 AS BIGINT))), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS BIGINT)) % 20 AS way FROM s),
d AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h, range(2) t(copy) WHERE way <> 0 AND (copy = 0 OR way = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS words FROM d),
f AS (SELECT *, CASE WHEN words = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(words, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS kind,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
c AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'blank') AS blank, count(*) FILTER (kind = 'duplicate') AS duplicate, count(*) FILTER (kind = 'truncated') AS truncated,
  count(*) FILTER (i > 1 AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
a AS (SELECT DISTINCT conv_id FROM conversations),
g(state, role, after) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
n0 AS (SELECT state, state AS to_state, '' AS edits, 0 AS cost, CAST([] AS VARCHAR[]) AS lines FROM g UNION ALL SELECT state, after, 'I', 2, [role || ':'] FROM g UNION ALL SELECT x.state, y.after, 'II', 4, [x.role || ':', y.role || ':'] FROM g x JOIN g y ON y.state = x.after),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])} AS best FROM a
UNION ALL SELECT conv_id, i, state, min(best) FROM (
  SELECT w.conv_id, f.i, e.edit, CASE WHEN e.edit = 'D' THEN n0.to_state WHEN e.edit = 'K' AND left(f.role, 1) = 's' THEN 1 ELSE g.after END AS state,
    {'cost': w.best.cost + n0.cost + CASE e.edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e.edit <> 'D' AND f.kind = 'truncated' THEN 1 ELSE 0 END, 'audit': w.best.audit || n0.edits || e.edit,
     'lines': list_concat(list_concat(w.best.lines, n0.lines), CASE e.edit WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [f.role || ':' || f.text] ELSE [g.role || ':' || f.text] END)} AS best
  FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN n0 ON n0.state = w.state JOIN g ON g.state = n0.to_state, (VALUES ('D'), ('K'), ('R')) e(edit)
  WHERE e.edit = 'D' OR f.kind NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR left(f.role, 1) = left(g.role, 1) OR left(f.role, 1) = 's' AND n0.to_state = 0)) GROUP BY conv_id, i, state),
z AS (SELECT w.conv_id, min({'cost': w.best.cost + n0.cost, 'audit': w.best.audit || n0.edits, 'lines': list_concat(w.best.lines, n0.lines)}) AS best FROM w LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id JOIN n0 ON n0.state = w.state
  WHERE w.i = coalesce(c.n, 0) AND n0.to_state IN (0, 3) GROUP BY w.conv_id)
SELECT z.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
CAST(z.best.cost AS BIGINT) AS cost, z.best.audit AS audit, sha256(array_to_string(z.best.lines, chr(10))) AS repaired_sha256 FROM z LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM z.conv_id"""

SQL = {"op1_decontaminate": OP1, "op4_quality_rules": quality_sql(), "op5_secret_scan": secrets_sql(), "op8_substring_dedup": OP8, "op13_conversation_repair": OP13}
