"""DuckDB SQL for those queries of this subpackage that SQL can express.

Fingerprints, the fitted classifier, the tokenizer and the trees can't be said in SQL; tests hold those queries
against brute force.
"""

from __future__ import annotations

from .quality import RULES
from .queries import CONTROL_TEXT

_WORD = r"[^\x20\x09-\x0D]+"

_QUALITY = rf"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '{_WORD}') AS w FROM t),
win AS (SELECT rid, i, list_slice(w, i, i + 7) AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM again) GROUP BY rid),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '{_WORD}') GROUP BY rid),
f AS (SELECT t.rid, doc_id, lang, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
 len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '[!?]')) AS n_marks FROM t JOIN w USING (rid) LEFT JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
long AS (SELECT rid, doc_id, lang, base_failed, unnest([{", ".join(f"'{n}'" for n in RULES)}]) AS name, unnest([{", ".join(sql for sql, _, _ in RULES.values())}]) AS ratio FROM b),
rules(name, cut, rate) AS (VALUES {", ".join(f"('{n}', {c}::DOUBLE, {0.1 * part}::DOUBLE)" for n, (_, cuts, part) in RULES.items() for c in cuts)}),
lab AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT long.*, good FROM long JOIN lab USING (doc_id) WHERE NOT base_failed),
size AS (SELECT lang, count(DISTINCT rid) FILTER (good) AS n FROM held GROUP BY lang),
alpha AS (SELECT 0.05 / ((SELECT greatest(count(*), 1) FROM size) * (SELECT count(DISTINCT name) FROM rules)) AS alpha),
own AS (SELECT lang FROM size, alpha WHERE pow(1 - {0.1 * max(part for _, _, part in RULES.values())}::DOUBLE, n) <= alpha),
grp AS (SELECT rid, long.name, ratio, own.rid IS NOT NULL AS mine, CASE WHEN own.rid IS NOT NULL THEN lang END AS g FROM long LEFT JOIN (SELECT DISTINCT rid FROM long JOIN own ON long.lang IS NOT DISTINCT FROM own.lang) own USING (rid)),
cnt AS (SELECT mine, g, name, cut, rate, count(*) FILTER (good) AS n, count(*) FILTER (good AND grp.ratio > cut) AS k, count(*) FILTER (NOT good) AS nb, count(*) FILTER (NOT good AND grp.ratio > cut) AS kb FROM grp JOIN held USING (rid, name) JOIN rules USING (name) GROUP BY ALL),
chance AS (SELECT *, CASE WHEN nb > 0 AND n > 0 THEN kb / nb - k / n END AS gain, CASE WHEN k >= n * rate THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(rate) + (n - j) * ln(1 - rate)))) END AS p FROM cnt),
cuts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mine, g, name ORDER BY gain DESC, cut DESC) AS place FROM chance, alpha WHERE p <= alpha AND gain > 0) WHERE place = 1),
gone AS (SELECT DISTINCT rid FROM grp JOIN cuts ON grp.name = cuts.name AND grp.mine = cuts.mine AND grp.g IS NOT DISTINCT FROM cuts.g AND grp.ratio > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM gone) AS kept FROM b"""

_JOIN = rf"""WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
sh AS (SELECT DISTINCT rid, list_slice(w, i, i + 4) AS s FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
common AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT rid AS x, rid AS y FROM t UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(k.n_links, 0) AS n_links FROM t LEFT JOIN n USING (rid) LEFT JOIN (SELECT x AS rid, count(*) AS n_links FROM edge GROUP BY x) k USING (rid) JOIN (SELECT x AS rid, min(doc_id) AS component_id FROM reach JOIN t ON t.rid = y GROUP BY x) c USING (rid)"""

_CONTROL = r"[<\[]/?s>|[<\[]/?INST\]|[<\[]</?SYS>>"
_ESCAPED = "length({0}) + len(regexp_extract_all({0}, '␛')) + len(regexp_extract_all({0}, '" + _CONTROL + "'))"
_CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'),
s AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS learned,
 sum(17 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) + 3 AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM s"""

_ORDER = "ORDER BY most / weight, source IS NULL, source"
_MIX = rf"""WITH s AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS key FROM documents),
b AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rn FROM s GROUP BY source),
w AS (SELECT *, (rn - 1) % 3 + 1 AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total, 3 * source_size AS most FROM b),
l AS (SELECT *, CAST(total - coalesce(sum(most) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / sum(weight) OVER ({_ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT *, least(CAST(most AS DOUBLE), weight * max(level) OVER ()) AS target FROM l),
e AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM g),
p AS (SELECT source, key, count(*) AS n, CAST(sum(size) AS BIGINT) AS words FROM s GROUP BY source, key),
q AS (SELECT p.*, source_size, target, epochs, budget - epochs * source_size - coalesce(CAST(sum(words) OVER (PARTITION BY p.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS rest FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + CASE WHEN rest >= words THEN size WHEN rest > 0 THEN rest // n ELSE 0 END AS BIGINT) AS taken FROM s JOIN q ON s.key = q.key AND s.source IS NOT DISTINCT FROM q.source"""

# 20 bits, five digits of hex, are four of base32
_BASE32 = "list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hexed, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), 'string_agg', '')"
_WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hexed FROM pages),
k AS (SELECT *, count(*) OVER (PARTITION BY body) AS n, max(page_id) OVER (PARTITION BY body) AS keeper FROM p),
r AS (SELECT *, n > 1 AND keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper AS again FROM k)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN keeper END AS refers_to FROM r"""

ORACLES: dict[str, str] = {
    "op2_quality_rules": _QUALITY,
    "op5_ngram_join": _JOIN,
    "op7_chat_formatting": _CHAT,
    "op9_mixing": _MIX,
    "op10_warc": _WARC,
}
