"""DuckDB SQL for the registered queries, written apart from the operators."""

from __future__ import annotations

from . import adapters as A

_BP = f"bp AS (SELECT conv_id AS book_id, turn AS page_index, {A.PAGE_MD} AS md FROM conversations)"
#: The pages as undetected_books has them.
_BARE = f"bp AS (SELECT book_id, page_index, CASE WHEN book_id % 10 = 0 AND page_index NOT IN (2, 4) THEN '' ELSE md END AS md FROM (SELECT conv_id AS book_id, turn AS page_index, {A.PAGE_MD} AS md FROM conversations))"
# Fixed values, as in functions/patterns.py: words of a book's parts, numerals.
_PRE = "(まえがき|前書き|はじめに|序章|序論|はしがき)"
_AFT = "(あとがき|後書き|おわりに|終章|結論|むすび)"
_IDX = "(索引|インデックス)"
_NUM = "[０-９0-9一二三四五六七八九十]+"
_KANJI = "['一','二','三','四','五','六','七','八','九','十','十一','十二','十三','十四','十五']"


def _number(x: str) -> str:
    plain = f"trim(translate({x}, '０１２３４５６７８９', '0123456789'))"
    return f"CASE WHEN list_contains({_KANJI}, {plain}) THEN CAST(list_position({_KANJI}, {plain}) AS INTEGER) ELSE TRY_CAST(regexp_extract({plain}, '^[0-9]+$') AS INTEGER) END"


#: The first line with anything on it, if a heading.
_H1 = f"""{_BP}, l AS (SELECT book_id, page_index, md, list_filter(list_transform(string_split(md, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1] AS line FROM bp),
h1 AS (SELECT book_id, page_index, md, CASE WHEN starts_with(line, '# ') THEN regexp_replace(substr(line, 3), '^\\s+|\\s+$', '', 'g') END AS heading FROM l)"""
_CLASSED = f"""{_H1}, cl AS (SELECT *, CASE WHEN regexp_matches(heading, '^第\\s*{_NUM}\\s*章') OR regexp_matches(heading, '^[1-9][0-9]?[^\\d\\.\\s\\\\\\)]') THEN 'chapter'
 WHEN regexp_matches(heading, '^{_PRE}[\\d\\s]*$') THEN 'preface' WHEN regexp_matches(heading, '^{_AFT}[\\d\\s]*$') THEN 'afterword' WHEN regexp_matches(heading, '^{_IDX}[\\d\\s]*$') THEN 'index' END AS kind,
 CASE WHEN regexp_matches(heading, '^第\\s*{_NUM}\\s*章') THEN regexp_extract(heading, '^第\\s*({_NUM})\\s*章', 1) ELSE regexp_extract(heading, '^([1-9][0-9]?)[^\\d\\.\\s\\\\\\)]', 1) END AS num,
 len(regexp_extract_all(md, '(?m)^#\\s+(第\\s*{_NUM}\\s*章|[1-9][0-9]?[^\\d\\.\\s\\\\\\)]|{_PRE}|{_AFT}|{_IDX})')) AS n FROM h1),
named AS (SELECT book_id, page_index, md, n, kind, CASE WHEN kind = 'chapter' THEN {_number('num')} END AS chapter_number,
 CASE WHEN kind = 'chapter' THEN coalesce(nullif(CASE WHEN regexp_matches(heading, '^第\\s*{_NUM}\\s*章') THEN trim(regexp_replace(heading, '^第\\s*{_NUM}\\s*章\\s*', '')) ELSE trim(regexp_replace(heading, '^[1-9][0-9]?([^0-9])', '\\1')) END, ''), heading)
 WHEN kind IS NOT NULL THEN coalesce(nullif(trim(regexp_replace(heading, '[\\d\\s]+$', '')), ''), heading) END AS title, heading FROM cl)"""
_PRIO = "CASE kind WHEN 'preface' THEN 0 WHEN 'chapter' THEN 1 WHEN 'afterword' THEN 2 ELSE 3 END"


def _built(starts: str, source: str) -> str:
    """Chapters from rows of book_id, kind, chapter_number, title, start_page, pos, total."""
    order = f"PARTITION BY book_id ORDER BY start_page, {_PRIO}, pos"
    return f"""SELECT book_id, CAST(row_number() OVER ({order}) - 1 AS INTEGER) AS ord, kind, chapter_number, title, CAST(start_page AS INTEGER) AS start_page,
 CAST(coalesce(lead(start_page) OVER ({order}), total) - 1 AS INTEGER) AS end_page, '{source}' AS source FROM {starts}"""


_BODY = f"""{_CLASSED}, total AS (SELECT book_id, count(*) AS total FROM bp GROUP BY book_id),
bs AS (SELECT book_id, kind, chapter_number, title, page_index AS start_page, page_index AS pos, total FROM named JOIN total USING (book_id) WHERE kind IS NOT NULL AND n <= 1),
body AS ({_built('bs', 'body_headings')})"""



def _marks(where: str = "") -> str:
    return f"""pt AS (SELECT book_id, kind, chapter_number, title, CASE WHEN page_index % 4 = 0 OR page_index = 5 THEN 0 ELSE page_index END AS start_page, page_index AS pos, total FROM named JOIN total USING (book_id) WHERE kind IS NOT NULL {where}),
marks AS ({_built('pt', 'pdf_toc')})"""


_one = "(SELECT book_id, arg_min(start_page, ord) AS one FROM body WHERE kind = 'chapter' AND chapter_number = 1 GROUP BY book_id)"
_ENTRY = f"第\\s*({_NUM})\\s*章\\s+(.+?)\\s+[・\\.\\s]*([0-9]+)\\s*$"
_FRONT, _LISTED = f"^#\\s+{_PRE}\\s*([0-9]+)\\s*$", "^#\\s+([1-9][0-9]?)([^\\d\\.\\s\\\\\\)].+?)(?:\\s+([0-9]+))?\\s*$"
#: Contents pages line by line: one headed 目次, or else all near the start with several chapter headings.
_PRINTED = f"""{_BODY}, near AS (SELECT * FROM (SELECT book_id, page_index, md, n, row_number() OVER (PARTITION BY book_id ORDER BY page_index) AS rn FROM named) WHERE rn <= 15),
hp AS (SELECT * FROM near WHERE regexp_matches(md, '(?m)^#\\s*目次') QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY rn) = 1),
hl AS (SELECT book_id, page_index AS toc, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS nr FROM hp),
he AS (SELECT book_id, 'chapter' AS kind, {_number(f"regexp_extract(line, '{_ENTRY}', 1)")} AS chapter_number, trim(regexp_extract(line, '{_ENTRY}', 2)) AS title, CAST(regexp_extract(line, '{_ENTRY}', 3) AS BIGINT) AS printed, nr, toc FROM hl WHERE regexp_matches(line, '{_ENTRY}')),
lp AS (SELECT * FROM near WHERE n > 1 AND book_id NOT IN (SELECT book_id FROM hp)),
ll AS (SELECT book_id, rn, min(page_index) OVER (PARTITION BY book_id) AS toc, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS nr FROM lp),
lh AS (SELECT *, regexp_matches(line, '^#\\s+') AS heads, sum(CAST(regexp_matches(line, '^#\\s+') AS INTEGER)) OVER (PARTITION BY book_id ORDER BY rn, nr) AS part FROM ll),
ls AS (SELECT *, first_value(CASE WHEN NOT heads THEN TRY_CAST(nullif(regexp_extract(line, '^\\d+\\.\\s+.+?(\\d+)\\s*$', 1), '') AS BIGINT) END IGNORE NULLS) OVER (PARTITION BY book_id, part ORDER BY rn, nr ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS section FROM lh),
le AS (SELECT book_id, CASE WHEN regexp_matches(line, '{_FRONT}') THEN 'preface' ELSE 'chapter' END AS kind, CASE WHEN NOT regexp_matches(line, '{_FRONT}') THEN {_number(f"regexp_extract(line, '{_LISTED}', 1)")} END AS chapter_number,
 CASE WHEN regexp_matches(line, '{_FRONT}') THEN regexp_extract(line, '{_FRONT}', 1) ELSE trim(regexp_extract(line, '{_LISTED}', 2)) END AS title,
 CASE WHEN regexp_matches(line, '{_FRONT}') THEN CAST(regexp_extract(line, '{_FRONT}', 2) AS BIGINT) ELSE coalesce(TRY_CAST(nullif(regexp_extract(line, '{_LISTED}', 3), '') AS BIGINT), section) END AS printed, rn * 100000 + nr AS pos, toc
 FROM ls WHERE regexp_matches(line, '{_FRONT}') OR regexp_matches(line, '{_LISTED}')),
said AS (SELECT book_id, kind, chapter_number, title, printed, row_number() OVER (PARTITION BY book_id ORDER BY chapter_number, nr) AS pos, toc FROM he WHERE chapter_number IS NOT NULL
 UNION ALL SELECT * FROM le WHERE printed IS NOT NULL),
low AS (SELECT *, min(printed) FILTER (kind = 'chapter') OVER (PARTITION BY book_id) AS lowest FROM said),
ps AS (SELECT s.book_id, kind, s.chapter_number, title, greatest(0, printed - 1 + coalesce(one - (lowest - 1), toc + 1)) AS start_page, pos, total FROM low s JOIN total t ON s.book_id = t.book_id LEFT JOIN {_one} o ON o.book_id = s.book_id),
pp AS (SELECT * FROM ps WHERE start_page < total), printed AS ({_built('pp', 'ocr_toc')})"""


#: Cells and titles of the syllabus page, found in its HTML.
def _titles(named: str = "true") -> str:
    return f"""hs AS (SELECT conv_id AS book_id, turn, regexp_extract_all({A.syllabus_row(named)}, '(?s)<td[^>]*>(.*?)</td>', 1) AS tds FROM conversations),
tc AS (SELECT book_id, turn, generate_subscripts(tds, 1) AS i, trim(regexp_replace(unnest(tds), '<[^>]*>', '', 'g')) AS cell FROM hs),
titles AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY turn, i) AS k, trim(regexp_extract(cell, '^第\\s*{_NUM}\\s*章\\s*(.+)', 1)) AS title FROM tc WHERE regexp_matches(cell, '^第\\s*{_NUM}\\s*章\\s*.+'))"""


_SYLLABUS = """kc AS (SELECT *, row_number() OVER (PARTITION BY book_id, kind ORDER BY ord) AS k, count(*) FILTER (kind = 'chapter') OVER (PARTITION BY book_id) AS c FROM body),
listed AS (SELECT book_id, count(*) AS n FROM titles GROUP BY book_id),
syl AS (SELECT b.book_id, ord, kind, chapter_number, CASE WHEN kind = 'chapter' AND c = listed.n THEN t.title ELSE b.title END AS title, start_page, end_page, 'syllabus' AS source FROM kc b JOIN listed USING (book_id) LEFT JOIN titles t ON t.book_id = b.book_id AND t.k = b.k)"""

_COLS = "book_id, ord, kind, chapter_number, title, start_page, end_page, source"


def _sides(parts: tuple[str, ...], prefix: str = "") -> str:
    return ", ".join(f"{p} AS {prefix}{n}" for n, p in zip(("x1", "y1", "x2", "y2"), parts))


_BOXES = f"""p AS (SELECT l_orderkey AS book_id, {A.IDX} AS para_idx, {_sides(A.BOX)}, {A.PARA_TEXT} AS contents FROM lineitem WHERE l_linenumber % 2 = 0),
d AS (SELECT l_orderkey AS book_id, {A.IDX} AS det_idx, {_sides(A.BOX)}, {A.KIND} AS type, {A.LATEX} AS latex FROM lineitem WHERE l_linenumber % 2 = 1),
w AS (SELECT l_orderkey AS book_id, {A.IDX} AS word_idx, {_sides(A.WORD_BOX)}, {A.WORD_TEXT} AS content FROM lineitem)"""


def _area(t: str) -> str:
    return f"(greatest(0, {t}.x2 - {t}.x1) * greatest(0, {t}.y2 - {t}.y1))"


def _shared(a: str, b: str) -> str:
    return f"(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"


def _part(a: str, b: str) -> str:
    return f"CASE WHEN {_area(a)} = 0 THEN 0.0 ELSE CAST({_shared(a, b)} AS DOUBLE) / {_area(a)} END"


def _matched(least: float, d: str = "d") -> str:
    return f"""m AS (SELECT * FROM (SELECT d.*, p.para_idx, p.contents, row_number() OVER (PARTITION BY d.book_id, det_idx ORDER BY {_part('d', 'p')} DESC, p.para_idx DESC) AS r FROM {d} d JOIN p ON d.book_id = p.book_id AND p.contents IS NOT NULL AND {_part('d', 'p')} >= {least}) WHERE r = 1)"""


def _lined(least: float) -> str:
    return f"""pl AS (SELECT book_id, para_idx, generate_subscripts(ls, 1) - 1 AS line, unnest(ls) AS content FROM (SELECT *, list_filter(string_split(contents, chr(10)), lambda x: x <> '') AS ls FROM p WHERE contents IS NOT NULL)),
pn AS (SELECT *, row_number() OVER (PARTITION BY book_id, para_idx, content ORDER BY line) AS nth FROM pl),
wn AS (SELECT p.book_id, p.para_idx, w.content, w.x1, w.y1, w.x2, w.y2, row_number() OVER (PARTITION BY p.book_id, p.para_idx, w.content ORDER BY word_idx) AS nth FROM p JOIN w ON p.book_id = w.book_id AND {_area('w')} > 0 AND {_part('w', 'p')} >= {least}),
lw AS (SELECT pn.book_id, pn.para_idx, line, pn.content, x1, y1, x2, y2 FROM pn LEFT JOIN wn USING (book_id, para_idx, content, nth))"""


def _runs(least: float) -> str:
    return f"""{_BOXES}, {_matched(least)}, {_lined(least)},
hit AS (SELECT m.book_id, m.para_idx, m.det_idx, m.type, m.latex, lw.line FROM m JOIN lw ON m.book_id = lw.book_id AND m.para_idx = lw.para_idx AND {_area('m')} > 0 AND {_area('lw')} > 0 AND {_part('lw', 'm')} >= {least}),
run AS (SELECT book_id, para_idx, det_idx, type, latex, min(line) AS first, max(line) + 1 AS last FROM hit GROUP BY ALL HAVING max(line) - min(line) + 1 = count(*))"""


_ESCAPE = "regexp_replace(replace({}, chr(10), ''), '([`*{{}}\\[\\]()#+!~|-])', '\\\\\\1', 'g')"


def _plain(x: str) -> str:
    for pattern, by in (("(?m)^#{1,6}\\s+", ""), ("\\*\\*(.+?)\\*\\*|__(.+?)__", "\\1\\2"), ("\\*(.+?)\\*|_(.+?)_", "\\1\\2"), ("`(.+?)`", "\\1"), ("!\\[([^\\]]*)\\]\\([^)]+\\)", "[図: \\1]"), ("\\[([^\\]]+)\\]\\([^)]+\\)", "\\1"), ("(?m)^[-*_]{3,}\\s*$", "")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


def _slug(x: str) -> str:
    return f"""substr(regexp_replace(regexp_replace(regexp_replace(replace(replace({x}, '　', '_'), ' ', '_'), '[/\\\\:*?"<>|\\x00-\\x1f\\x7f]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'), 1, 80)"""


def _first(text: str, needle: str, by: str) -> str:
    return f"CASE WHEN strpos({text}, '{needle}') = 0 THEN {text} ELSE substr({text}, 1, strpos({text}, '{needle}') - 1) || '{by}' || substr({text}, strpos({text}, '{needle}') + {len(needle)}) END"


_SPECS = f"sp AS (SELECT conv_id, conv_id AS book_id, count(*) AS total, conv_id % 6 AS c FROM conversations GROUP BY conv_id)"
_CACHE = "(SELECT conv_id, turn, text, turn % 2 = 0 AND conv_id % 3 > 0 AND conv_id % 4 > 0 AND text IS NOT NULL AS hit FROM conversations)"
_TRIM = f"""inn AS (SELECT d.book_id, d.det_idx, w.x1, w.y1, w.x2, w.y2, w.content LIKE '%漢字語%' AS ja FROM d JOIN w ON d.book_id = w.book_id AND {_area('w')} > 0 AND {_part('w', 'd')} >= 0.5),
ag AS (SELECT book_id, det_idx, bool_or(ja) AS ja, min(x1) FILTER (NOT ja) AS x1, min(y1) FILTER (NOT ja) AS y1, max(x2) FILTER (NOT ja) AS x2, max(y2) FILTER (NOT ja) AS y2 FROM inn GROUP BY ALL),
cut AS (SELECT d.book_id, d.det_idx, d.x1 AS dx1, d.y1 AS dy1, d.x2 AS dx2, d.y2 AS dy2, {_area('d')} AS a, coalesce(ag.ja, false) AS ja, ag.x1 IS NOT NULL AS got, greatest(ag.x1, d.x1) AS x1, greatest(ag.y1, d.y1) AS y1, least(ag.x2, d.x2) AS x2, least(ag.y2, d.y2) AS y2 FROM d LEFT JOIN ag USING (book_id, det_idx))"""
_TRIMMED = ", ".join(f"CASE WHEN a = 0 THEN NULL WHEN NOT ja THEN d{s} WHEN got AND x2 > x1 AND y2 > y1 THEN {s} END AS trimmed_{s}" for s in ("x1", "y1", "x2", "y2"))
_ASSETS = f"""as1 AS (SELECT conv_id AS book_id, turn AS page_index, generate_subscripts([{', '.join(A.PAGE_ASSETS)}], 1) - 1 AS pos, unnest([{', '.join(A.PAGE_ASSETS)}]) AS path FROM conversations WHERE turn % 3 = 0),
an AS (SELECT *, regexp_extract(path, '([^/]+)$', 1) AS base, row_number() OVER (PARTITION BY book_id ORDER BY page_index, pos) AS k FROM as1),
parts AS (SELECT *, CASE WHEN contains(base, '.') THEN regexp_extract(base, '^(.*)\\.[^.]*$', 1) ELSE base END AS stem, regexp_extract(base, '\\.[^.]*$') AS ending FROM an),
nm AS (SELECT book_id, 0::BIGINT AS k, CAST([] AS VARCHAR[]) AS used, NULL::VARCHAR AS name, NULL::INTEGER AS page_index, NULL::BIGINT AS pos, NULL::VARCHAR AS path FROM (SELECT DISTINCT book_id FROM parts)
 UNION ALL SELECT book_id, k, list_append(used, name), name, page_index, pos, path FROM (SELECT nm.book_id, parts.k, nm.used, CAST(parts.page_index AS INTEGER) AS page_index, CAST(parts.pos AS BIGINT) AS pos, parts.path,
  CASE WHEN NOT list_contains(nm.used, base) THEN base ELSE list_filter(list_transform(range(1, len(nm.used) + 2), lambda i: stem || '_' || i || ending), lambda x: NOT list_contains(nm.used, x))[1] END AS name FROM nm JOIN parts ON parts.book_id = nm.book_id AND parts.k = nm.k + 1)),
named_assets AS (SELECT * FROM nm WHERE name IS NOT NULL)"""
_WAS = "(SELECT *, unnest([path, 'figures/' || regexp_extract(path, '([^/]+)$', 1)]) AS was FROM named_assets)"


def _new_name(was: str) -> str:
    """The new name of an image: by its page's asset, by the last such of the book, or as it is."""
    return f"coalesce((SELECT arg_max(name, pos) FROM x WHERE x.book_id = c.conv_id AND x.page_index = c.turn AND x.was = {was}), (SELECT arg_max(name, page_index * 100 + pos) FROM x WHERE x.book_id = c.conv_id AND x.was = {was}), {was})"


_TAKEN = "SELECT d.* FROM d JOIN cut USING (book_id, det_idx) WHERE a > 0 AND (NOT ja OR (got AND cut.x2 > cut.x1 AND cut.y2 > cut.y1))"
#: Detections whose box has shrunk and could be read again have the new box and formula.
_AGAIN = f"""SELECT book_id, det_idx, type, CASE WHEN new THEN cx1 ELSE x1 END AS x1, CASE WHEN new THEN cy1 ELSE y1 END AS y1, CASE WHEN new THEN cx2 ELSE x2 END AS x2, CASE WHEN new THEN cy2 ELSE y2 END AS y2, CASE WHEN new THEN 'n' || (cx2 - cx1) ELSE latex END AS latex
 FROM (SELECT t.*, cut.x1 AS cx1, cut.y1 AS cy1, cut.x2 AS cx2, cut.y2 AS cy2, ja AND (cut.x1, cut.y1, cut.x2, cut.y2) IS DISTINCT FROM (t.x1, t.y1, t.x2, t.y2) AND det_idx % 5 > 0 AS new FROM ({_TAKEN}) t JOIN cut USING (book_id, det_idx))"""


def _replaced(taken: str) -> str:
    return f"""{_BOXES}, {_TRIM}, dt AS ({taken}), {_matched(0.5, 'dt')}, {_lined(0.5)},
same AS (SELECT book_id, para_idx, min(para_idx) OVER (PARTITION BY book_id, x1, y1, x2, y2, contents) AS one FROM p), mc AS (SELECT m.* REPLACE (one AS para_idx) FROM m JOIN same USING (book_id, para_idx)),
shown AS (SELECT book_id, det_idx, contents, latex FROM (SELECT *, row_number() OVER (PARTITION BY book_id, para_idx ORDER BY det_idx) AS o FROM mc WHERE type = 'isolated') WHERE o = 1 AND latex <> ''),
hit AS (SELECT m.book_id, m.para_idx, m.det_idx, m.latex, lw.line FROM mc m JOIN lw ON m.type <> 'isolated' AND m.book_id = lw.book_id AND m.para_idx = lw.para_idx AND {_area('m')} > 0 AND {_area('lw')} > 0 AND {_part('lw', 'm')} >= 0.5),
run AS (SELECT book_id, para_idx, det_idx, latex, min(line) AS first, max(line) + 1 AS last FROM hit GROUP BY ALL HAVING max(line) - min(line) + 1 = count(*)),
o AS (SELECT *, row_number() OVER (PARTITION BY book_id, para_idx ORDER BY first, det_idx) AS r, coalesce(lag(last) OVER (PARTITION BY book_id, para_idx ORDER BY first, det_idx), 0) AS since FROM run),
bits AS (SELECT book_id, para_idx, r, array_to_string(list_slice(['x', '漢字語', 'y\\*', 'x', 'z_1'], since + 1, first), '') || '$' || latex || '$' AS bit, last FROM o)"""

def _both_phases(taken: str) -> str:
    return f"""WITH {_replaced(taken)} SELECT book_id, 0 AS phase, det_idx AS ord, 'x漢字語y\\*xz_1' AS needle, chr(10) || '$$' || latex || '$$' || chr(10) AS replacement FROM shown
 UNION ALL SELECT book_id, 1, para_idx, 'x漢字語y\\*xz_1', string_agg(bit, '' ORDER BY r) || array_to_string(list_slice(['x', '漢字語', 'y\\*', 'x', 'z_1'], arg_max(last, r) + 1, 5), '') FROM bits GROUP BY book_id, para_idx"""


ORACLES: dict[str, str] = {
    "page_range_filter": f"WITH {_SPECS} SELECT book_id, turn AS page_index FROM sp JOIN conversations USING (conv_id) WHERE c = 1 OR (c = 0 AND total >= 4 AND turn IN (0, 2, 3)) OR (c = 2 AND total >= 2 AND turn IN (0, 1))",
    "page_range_errors": f"WITH {_SPECS} SELECT book_id, CASE c WHEN 3 THEN 'backwards' WHEN 4 THEN 'below 1' WHEN 5 THEN 'unreadable' ELSE 'beyond total' END AS error FROM sp WHERE c IN (3, 4, 5) OR (c = 0 AND total < 4) OR (c = 2 AND total < 2)",
    "cache_hits": f"SELECT conv_id AS book_id, turn AS page_index, md5(text) AS raw_md5 FROM {_CACHE} WHERE hit",
    "cache_misses": f"SELECT conv_id AS book_id, turn AS page_index FROM {_CACHE} WHERE NOT hit",
    "existing_assets": "SELECT conv_id AS book_id, turn AS page_index, concat_ws('|', CASE WHEN conv_id IN (SELECT page_id FROM pages) THEN '/a/' || conv_id || '.png' END, CASE WHEN turn = 3 THEN '/a/x3.png' END) AS assets FROM conversations",
    "analysis_json": f"""WITH r AS (SELECT l_orderkey AS book_id, l_linenumber AS page_index, {_sides(A.BOX)} FROM lineitem WHERE l_linenumber NOT IN (3, 4))
 SELECT book_id, page_index, 'p' AS what, 0 AS idx, 'c' || page_index AS contents, x1 AS box_x1, y1 AS box_y1, x2 AS box_x2, y2 AS box_y2 FROM r UNION ALL SELECT book_id, page_index, 'p', 1, NULL, 1, 2, 3, 4 FROM r
 UNION ALL SELECT book_id, page_index, 'w', 0, 'w', 2, 1, 7, 9 FROM r UNION ALL SELECT book_id, page_index, 'w', 1, 'v', NULL, NULL, NULL, NULL FROM r""",
    "escape_markdown": f"SELECT doc_id, md5({_ESCAPE.format('text')}) AS escaped_md5 FROM documents",
    "plaintext": f"SELECT doc_id, md5({_plain('text')}) AS plain_md5 FROM documents",
    "slug_filename": f"SELECT doc_id, printf('%02d', doc_id % 130) || '_chapter_' || {_slug('t')} || '.md' AS name FROM (SELECT doc_id, '　a/b: ' || text AS t FROM documents)",
    "page_filename": "SELECT conv_id, turn, printf('page_%04d.md', conv_id * 10 + turn + 1) AS name FROM conversations",
    "chapter_number": f"SELECT conv_id, turn, {_number('raw')} AS number FROM (SELECT *, {A.NUMBER_TEXT} AS raw FROM conversations)",
    "first_h1": f"WITH {_H1} SELECT book_id, page_index, heading FROM h1",
    "classify_heading": f"WITH {_CLASSED} SELECT book_id, page_index, kind, chapter_number, title FROM named WHERE heading IS NOT NULL",
    "multi_heading_pages": f"WITH {_CLASSED} SELECT book_id, page_index, CAST(n AS INTEGER) AS headings FROM named WHERE n > 1",
    "is_japanese": f"SELECT l_orderkey, l_linenumber, c LIKE '%漢字語%' AS japanese FROM (SELECT *, {A.WORD_TEXT} AS c FROM lineitem)",
    "content_hash": "SELECT doc_id, sha256(text) AS sha256, substr(sha256(text), 1, 8) AS sha8 FROM documents",
    "body_headings": f"WITH {_BODY} SELECT * FROM body",
    "ocr_toc": f"WITH {_PRINTED} SELECT * FROM printed",
    "pdf_toc": f"WITH {_BODY}, {_marks()} SELECT * FROM marks",
    "syllabus_titles": f"WITH {_titles()} SELECT book_id, k, title FROM titles",
    "syllabus": f"WITH {_BODY}, {_titles()}, {_SYLLABUS} SELECT {_COLS} FROM syl",
    "chapter_fallback": f"""WITH {_PRINTED}, {_marks('AND book_id % 3 = 0')}, {_titles('conv_id % 7 = 0')}, {_SYLLABUS},
 every AS (SELECT 0 AS rank, {_COLS} FROM syl UNION ALL SELECT 1, {_COLS} FROM marks UNION ALL SELECT 2, {_COLS} FROM printed UNION ALL SELECT 3, {_COLS} FROM body)
 SELECT {_COLS} FROM every JOIN (SELECT book_id, min(rank) AS rank FROM every GROUP BY book_id) USING (book_id, rank)""",
    "undetected_books": f"""WITH {_PRINTED.replace(_BP, _BARE)}, whole AS (SELECT * FROM (WITH {_CLASSED} SELECT book_id, kind, page_index FROM named)), {_titles('conv_id % 4 = 0')}, {_SYLLABUS},
 marked AS (SELECT book_id FROM whole WHERE kind IS NOT NULL AND book_id % 20 = 5),
 lost AS (SELECT DISTINCT book_id FROM bp WHERE book_id NOT IN (SELECT book_id FROM syl UNION SELECT book_id FROM marked UNION SELECT book_id FROM printed UNION SELECT book_id FROM body)),
 h AS (SELECT book_id, CASE WHEN book_id IN (SELECT book_id FROM named WHERE kind IS NOT NULL) THEN 'chapter headings only beside others' ELSE 'no chapter heading' END AS why FROM lost)
 SELECT book_id, 'syllabus: ' || CASE WHEN book_id IN (SELECT book_id FROM titles) THEN why ELSE 'no chapter titles' END || chr(10) || 'pdf_toc: no chapter among the bookmarks' || chr(10)
 || 'ocr_toc: ' || CASE WHEN book_id NOT IN (SELECT book_id FROM hp UNION SELECT book_id FROM lp) THEN 'no contents page' WHEN book_id NOT IN (SELECT book_id FROM said) THEN 'no entries on it' ELSE 'no entry within the book' END || chr(10)
 || 'body_headings: ' || why AS error FROM h""",
    "word_bbox": f"SELECT l_orderkey, l_linenumber, {_sides(A.WORD_BOX, 'box_')} FROM lineitem",
    "iou": f"WITH {_BOXES} SELECT d.book_id, det_idx, para_idx, CASE WHEN {_area('d')} + {_area('p')} - {_shared('d', 'p')} = 0 THEN 0.0 ELSE CAST({_shared('d', 'p')} AS DOUBLE) / ({_area('d')} + {_area('p')} - {_shared('d', 'p')}) END AS iou, {_part('d', 'p')} AS ioa FROM d JOIN p USING (book_id)",
    "clamp_box": f"""WITH {_BOXES}, c AS (SELECT book_id, word_idx, least(x1, 100) AS x1, least(y1, 25) AS y1, least(x2, 100) AS x2, least(y2, 25) AS y2 FROM w)
 SELECT book_id, word_idx, {', '.join(f'CASE WHEN x2 > x1 AND y2 > y1 THEN {s} END AS box_{s}' for s in ('x1', 'y1', 'x2', 'y2'))} FROM c""",
    "ioa_match": f"WITH {_BOXES}, {_matched(0.5)} SELECT book_id, det_idx, para_idx FROM m",
    "words_in_paragraph": f"WITH {_BOXES} SELECT p.book_id, para_idx, word_idx FROM p JOIN w ON p.book_id = w.book_id AND {_area('w')} > 0 AND {_part('w', 'p')} >= 0.5",
    "trim_bbox": f"WITH {_BOXES}, {_TRIM} SELECT book_id, det_idx, {_TRIMMED} FROM cut",
    "reading_order": f"""WITH {_BOXES}, c AS (SELECT *, (x1 + x2) / 2.0 AS xc, (y1 + y2) / 2.0 AS yc FROM w)
 SELECT book_id, word_idx, CAST(row_number() OVER (PARTITION BY book_id ORDER BY CASE WHEN book_id % 2 = 0 THEN -xc ELSE yc END, CASE WHEN book_id % 2 = 0 THEN yc ELSE xc END, word_idx) - 1 AS INTEGER) AS place FROM c""",
    "nth_occurrence_match": f"WITH {_BOXES}, {_lined(0.5)} SELECT book_id, para_idx, CAST(line AS INTEGER) AS line, content, x1 AS box_x1, y1 AS box_y1, x2 AS box_x2, y2 AS box_y2 FROM lw",
    "contiguous_span": f"WITH {_runs(0.1)} SELECT book_id, para_idx, det_idx, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last FROM run",
    "span_collect": f"WITH {_runs(0.1)} SELECT book_id, para_idx, string_agg(first || ':' || last || ':' || latex, '|' ORDER BY first, det_idx) AS runs FROM run GROUP BY ALL",
    "inline_rebuild": f"""WITH {_runs(0.1)}, o AS (SELECT *, row_number() OVER (PARTITION BY book_id, para_idx ORDER BY first, det_idx) AS r, coalesce(lag(last) OVER (PARTITION BY book_id, para_idx ORDER BY first, det_idx), 0) AS since FROM run),
 bits AS (SELECT book_id, para_idx, r, array_to_string(list_slice(['x', '漢字語', 'y\\*', 'x', 'z_1'], since + 1, first), '') || '$' || latex || '$' AS bit, last FROM o)
 SELECT book_id, para_idx, string_agg(bit, '' ORDER BY r) || array_to_string(list_slice(['x', '漢字語', 'y\\*', 'x', 'z_1'], arg_max(last, r) + 1, 5), '') AS text FROM bits GROUP BY ALL""",
    "display_first": f"WITH {_BOXES}, {_matched(0.5)} SELECT book_id, min(det_idx) AS det_idx, para_idx FROM m GROUP BY book_id, para_idx",
    "overlay_fold": f"""WITH a AS (SELECT conv_id, turn, {_first('text', 'a', '[e]')} AS t FROM conversations), b AS (SELECT conv_id, turn, '^' || {_first('t', 'e', '<a>')} AS t FROM a)
 SELECT conv_id AS book_id, turn AS page_index, md5({_first('t', 'a', '$x$')}) AS markdown_md5 FROM b""",
    "chapter_export": f"""WITH {_BODY} SELECT body.book_id, ord, printf('%02d', ord) || '_' || kind || '_' || {_slug('title')} || '.md' AS name, md5(coalesce(string_agg(md, chr(10) || chr(10) ORDER BY page_index), '')) AS content_md5
 FROM body LEFT JOIN bp ON bp.book_id = body.book_id AND page_index >= start_page AND page_index <= end_page GROUP BY body.book_id, ord, kind, title""",
    "combine_markdown": f"WITH {_BP} SELECT book_id, 'book.md' AS name, md5(string_agg(md, chr(10) || chr(10) ORDER BY page_index)) AS content_md5 FROM bp GROUP BY book_id",
    "combine_plaintext": f"WITH {_BP} SELECT book_id, 'book.txt' AS name, md5(string_agg({_plain('md')}, chr(10) || chr(10) ORDER BY page_index)) AS content_md5 FROM bp GROUP BY book_id",
    "page_files": f"WITH {_BP} SELECT book_id, printf('page_%04d.md', page_index + 1) AS name, md5(md) AS content_md5 FROM bp",
    "asset_rewrite": f"SELECT conv_id AS book_id, turn AS page_index, CASE WHEN turn % 3 = 0 THEN replace(replace(replace({A.PAGE_IMAGES}, '![a](/x/y/', '![a]('), '![d](/x/z/', '![d]('), '![e](/x/y/', '![e](') ELSE {A.PAGE_IMAGES} END AS text FROM conversations",
    "asset_dedup": f"WITH RECURSIVE {_ASSETS} SELECT book_id, CAST(page_index AS BIGINT) AS page_index, CAST(pos AS INTEGER) AS pos, name FROM named_assets",
    "image_sources": f"""WITH RECURSIVE {_ASSETS}, x AS {_WAS} SELECT conv_id AS book_id, turn AS page_index, ' ![a](' || {_new_name("'/x/y/fig' || turn || '.png'")} || ')' || chr(10) || '![b](c.png) <img src="' || {_new_name("'figures/fig' || turn || '.png'")}
 || '"> [l](/u/v) [see](/x/y/fig' || turn || '.png) ![d](' || {_new_name("'/x/z/all.png'")} || ') ![e](' || {_new_name("'/x/y/fig0.png'")} || ')<img alt="f" src="' || {_new_name("'figures/all.png'")} || '" />' AS markdown FROM conversations c""",
    "pdf_word_layer": f"WITH {_BOXES} SELECT book_id, word_idx, content, x1 * CAST(0.36 AS DOUBLE) AS x, 842.0::DOUBLE - y2 * CAST(0.36 AS DOUBLE) AS y, greatest(4.0::DOUBLE, (y2 - y1) * CAST(0.36 AS DOUBLE)) AS font FROM w WHERE content <> ''",
    "formula_replacements": _both_phases(_TAKEN),
    "formula_rerecognition": _both_phases(_AGAIN),
    "run_pages": f"""WITH {_SPECS}, wanted AS (SELECT conv_id, turn FROM sp JOIN conversations USING (conv_id) WHERE c = 1 OR (c = 0 AND total >= 4 AND turn IN (0, 2, 3)) OR (c = 2 AND total >= 2 AND turn IN (0, 1))),
 t AS (SELECT CAST(conv_id AS VARCHAR) AS book_id, CAST(turn AS INTEGER) AS page_index, text, hit, strlen(text) AS n FROM wanted JOIN {_CACHE} USING (conv_id, turn) WHERE text IS NOT NULL)
 SELECT book_id, page_index, md5(CASE WHEN hit THEN text ELSE 'read sigma ' || text END) AS raw_md5, md5(CASE WHEN hit THEN text ELSE 'read ' || chr(10) || '$$' || CASE WHEN n % 2 = 0 THEN 'm_' || n || '^60' ELSE 'n_' || n END || '$$' || chr(10) || ' ' || text END) AS markdown_md5 FROM t""",
    "markdown_assets": f"WITH each AS (SELECT conv_id AS book_id, turn, generate_subscripts([{', '.join(A.PAGE_ASSETS)}], 1) AS pos, unnest([{', '.join(A.PAGE_ASSETS)}]) AS path FROM conversations WHERE turn % 3 = 0) SELECT book_id, regexp_extract(path, '([^/]+)$', 1) AS name, arg_max(path, turn * 100 + pos) AS path FROM each GROUP BY ALL",
}
