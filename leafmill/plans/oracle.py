"""DuckDB SQL for the registered queries, written apart from the operators."""

from __future__ import annotations

from leafmill.operators import layout as K  # fixed values only
from leafmill.plans.cases import CASES, expected


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


_S = r"[ \t\n\x0B\f\r]"
_LINES = "lines as (select doc_id, i - 1 as seq, l[i] as text from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null), unnest(range(1, len(l) + 1)) u(i))"
_MD = (
    _LINES
    + ", md as (select doc_id, seq, case when seq % 12 = 0 then '# ' || text when seq % 12 = 6 then '### ' || text when seq % 12 = 8 then '## ' || text when seq % 6 = 1 then '' when seq % 12 = 3 then '- ' || text else text end as text from lines)"
    + ", heads as (select doc_id, seq, length(regexp_extract(text, '^(#+) ', 1)) as level, trim(regexp_replace(text, '^#+ +', '')) as title from md where regexp_matches(text, '^#{1,6} '))"
)
_SQUEEZE = f"trim(regexp_replace({{}}, '{_S}+', ' ', 'g'))"
_COUNT_WORDS = r"len(regexp_extract_all({}, '[^ \t\n\x0B\f\r]+'))"
_KEY = r"regexp_replace(" + _SQUEEZE.format("lower(text)") + r", '\d+', '#', 'g')"

_PAGES = (
    _LINES
    + """, placed as (
  select doc_id, seq, (seq // 40) as page, text, 50.0 + 270 * ((seq // 20) % 2) as x0, 100.0 + 16 * (seq % 20) as y0, 260.0 + 270 * ((seq // 20) % 2) as x1, 111.0 + 16 * (seq % 20) as y1,
    case when seq % 20 = 0 then 16.0 else 11.0 end as size, case when seq % 20 = 0 then 'Display' else 'Text' end as font, seq % 20 = 0 as is_bold from lines),
 pg as (select distinct doc_id, page from placed),
 rows_ as (select * from placed
  union all select doc_id, -1 - 2 * page, page, 'Report ' || doc_id, 50.0, 25.0, 260.0, 34.0, 9.0, 'Text', false from pg
  union all select doc_id, -2 - 2 * page, page, (page + 1)::varchar, 50.0, 771.0, 260.0, 780.0, 9.0, 'Text', false from pg)"""
)
_BODY = (
    _PAGES
    + """, styles as (select doc_id, font, size, sum(length(text)) as chars, min(seq) as first from rows_ group by all),
 body as (select * from (select *, row_number() over (partition by doc_id order by chars desc, first) as r from styles) where r = 1)"""
)
_COLS = (
    _PAGES
    + """, counted as (select *, count(*) over p as n, sum((x1 - x0 <= 330 and x1 <= 300)::int) over p as l, sum((x1 - x0 <= 330 and x0 >= 300)::int) over p as r, sum((x1 - x0 <= 330)::int) over p as narrow from rows_ window p as (partition by doc_id, page)),
 cols as (select * exclude (n, l, r, narrow), case when not (n >= 12 and 2 * narrow >= n and l >= greatest(3, 0.12 * n) and r >= greatest(3, 0.12 * n)) then 0 when x1 <= 300 then 0 when x0 >= 300 then 1 else -1 end as col from counted),
 steps as (select *, y0 - lag(y0) over (partition by doc_id, page, col order by y0, seq) as step from cols)"""
)
_CELLS = """cells as (
  select l_orderkey as table_id, (l_linenumber + 2)::int as r, c as col, case c when 0 then l_partkey::varchar when 1 then l_quantity::int::varchar else l_returnflag end as text, 1 as rowspan, 1 as colspan from lineitem, range(0, 3) u(c)
  union all select t, r, c, x, rs, cs from (select distinct l_orderkey as t from lineitem), (values (1, 0, 2, 1, 'Part'), (1, 1, 1, 2, 'Item'), (2, 1, 1, 1, 'Quantity'), (2, 2, 1, 1, 'Flag')) v(r, c, rs, cs, x))"""

_AUDIT = (
    _MD
    + r""", hurt as (select doc_id, seq, case when seq % 40 = 14 then text || ' ' when seq % 40 = 26 then '![p](pic%20' || (seq % 7) || '.png)' when seq % 60 = 38 then '12' when seq % 60 = 44 then '| a | b |' || chr(10) || '| c |' || chr(10) || text else text end as text from md),
 whole as (select doc_id, regexp_replace(string_agg(text, chr(10) order by seq), '\n$', '') as t from hurt group by doc_id),
 split as (select doc_id, string_split(t, chr(10)) as l from whole), x as (select doc_id, i, l[i] as x from split, unnest(range(1, len(l) + 1)) u(i)),
 hd as (select doc_id, i, length(regexp_extract(x, '^(#+)', 1)) as level, lower(regexp_extract(x, '^#+[ \t]+(\S.*?)[ \t]*$', 1)) as title from x where regexp_matches(x, '^#{1,6}[ \t]+\S')),
 hl as (select *, lag(level) over (partition by doc_id order by i) as before from hd),
 blank as (select doc_id, i - row_number() over (partition by doc_id order by i) as run from x where regexp_matches(x, '^[ \t]*$')),
 prose as (select doc_id, count(*) as n, sum((length(trim(x)) < 45 and not regexp_matches(rtrim(x), '[.!?:;]$'))::int) as short from x where trim(x) <> '' and not regexp_matches(x, '^(#|>|[-*+] |\d+[.)] |\||```)') and regexp_matches(x, '[A-Za-z]') group by doc_id),
 w as (select doc_id, length(t) as chars, len(regexp_extract_all(t, '[A-Za-z]')) as letters, regexp_extract_all(t, '[A-Za-z]{3,}') as w from whole),
 fired as (
  select doc_id, 'heading_jump' as "check", count(*) as n from hl where level > before + 1 group by doc_id
  union all select doc_id, 'duplicate_heading', count(*) from (select doc_id, title from hd where title not in ('references', 'notes') group by all having count(*) >= 4) group by doc_id
  union all select doc_id, 'replacement_chars', count(*) from x where contains(x, chr(65533)) group by doc_id
  union all select doc_id, 'private_use_chars', count(*) from x where regexp_matches(x, '[\x{E000}-\x{F8FF}]') group by doc_id
  union all select doc_id, 'unclosed_fence', sum(regexp_matches(x, '^[ \t]*```')::int) % 2 from x group by doc_id
  union all select doc_id, 'standalone_page_number', count(*) from x where regexp_matches(x, '^[ \t]*\d{1,4}[ \t]*$') group by doc_id
  union all select doc_id, 'possible_broken_hyphen', count(*) from (select *, lead(x) over (partition by doc_id order by i) as next from x) where regexp_matches(x, '[A-Za-zÀ-ÖØ-öø-ÿ]-$') and regexp_matches(next, '^[a-zà-öø-ÿ]') group by doc_id
  union all select doc_id, 'excess_blank_lines', count(*) from (select doc_id, run from blank group by all having count(*) >= 2) group by doc_id
  union all select doc_id, 'trailing_whitespace', count(*) from x where regexp_matches(x, '[ \t]$') and x not like '%  ' group by doc_id
  union all select doc_id, 'short_prose_fragment', 1 from prose where n >= 20 and short > 0.22 * n
  union all select doc_id, 'malformed_table', count(*) from hurt where seq % 60 = 44 group by doc_id
  union all select doc_id, 'broken_image_link', count(*) from hurt where seq % 40 = 26 and seq % 7 in (1, 3, 5) group by doc_id
  union all select doc_id, 'broken_text_layer', 1 from w where chars >= 2000 and letters >= 0.4 * chars and len(w) >= 200 and
    (list_sum(list_transform(list_filter(w, lambda v: length(v) > 24), lambda v: length(v))) > 0.06 * list_sum(list_transform(w, lambda v: length(v))) or (len(w) >= 300 and len(list_filter(w, lambda v: not regexp_matches(v, '(?i)[aeiouy]'))) > 0.15 * len(w)))),
 found as (select doc_id, "check", n::int as n from fired where n > 0)"""
)
_ACRONYMS = """ac as (select doc_id, regexp_replace(text, '(^| )(the|la|der|le) ', '\\1TLA ', 'g') as text from documents where text is not null),
  aw as (select doc_id, regexp_extract_all(unnest(string_split(text, chr(10))), '[A-Za-z][A-Za-z''’\\-]*') as w from ac), ak as (select doc_id, w, list_filter(w, lambda x: regexp_matches(x, '^[A-Z][A-Z''’\\-]*[A-Z]$') and length(x) <= 6) as caps from aw),
  learned as (select doc_id, token, count(*) as n from (select doc_id, unnest(caps) as token from ak where len(w) >= 4 and 2 * len(caps) <= len(w))
    where token not in ('A', 'AN', 'THE', 'AND', 'OR', 'BUT', 'OF', 'FOR', 'TO', 'IN', 'ON', 'AT', 'BY', 'WITH', 'FROM', 'AS', 'NOR', 'VS', 'VIA', 'THIS', 'THAT', 'NOT', 'ALL', 'ONE', 'TWO', 'NEW', 'OLD', 'END', 'SEE', 'ARE', 'WAS', 'HIS', 'HER', 'ITS', 'OUR', 'YOU', 'WHO', 'HOW', 'WHY', 'MAY', 'CAN', 'OUT', 'OFF') group by all having count(*) >= 3)"""
_NAMED = "case when seq % 5 < 2 then ['References', 'Glossary', 'Notes', 'Introduction'][seq % 4 + 1] else title end"

ORACLE_SQL: dict[str, str] = {
    "text_forms": f"""with {_LINES} select doc_id, seq,
      regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_ \\t\\n\\x0B\\f\\r\\-]', '', 'g'), '[_ \\t\\n\\x0B\\f\\r]+', '-', 'g'), '^-+|-+$', '', 'g') as slug,
      regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as key,
      case when text = '' or regexp_matches(text, '[:#\\[\\]{{}}&*!|>''"%@`,?\\\\]|^[-\\s]|\\s$') then '"' || replace(replace(text, '\\', '\\\\'), '"', '\\"') || '"' else text end as yaml,
      {_SQUEEZE.format("text")} as squeezed, {_COUNT_WORDS.format("text")} as n_words from lines""",
    "markdown_escapes": f"with {_MD} select doc_id, seq, regexp_replace(regexp_replace(text, '^( *)(\\* |[#>\\-+|=]|```)', '\\1\\\\\\2'), '^( *\\d{{1,9}})([.)])( |$)', '\\1\\\\\\2\\3') as escaped from md",
    "heading_numbers": f"""with {_LINES} select doc_id, seq, case seq % 4 when 0 then 'Chapter' when 2 then 'Appendix' else '' end as label,
      case seq % 4 when 0 then (seq % 30 + 1)::varchar when 1 then (doc_id % 9 + 1) || '.' || (seq % 7 + 1) when 2 then 'B' else '' end as number,
      case seq % 4 when 3 then trim('- ' || {_SQUEEZE.format("text")}) else {_SQUEEZE.format("text")} end as title, case seq % 4 when 1 then 2 when 3 then 0 else 1 end as depth from lines""",
    "roman_values": "select doc_id, ['I','II','IV','IX','XIV','XL','XC','CD','MCMXCIX','MMXXVI','IIX','word'][doc_id % 12 + 1] as roman, [1,2,4,9,14,40,90,400,1999,2026,0,0][doc_id % 12 + 1] as value from documents",
    "damaged_text": "select doc_id, length(text) - length(replace(replace(text, 'q', ''), 'z', '')) as n_damaged, 0 as n_left from documents where text is not null",
    "broken_text_layers": f"""with t as (select doc_id, case doc_id % 3 when 1 then translate(text, 'aeiouyAEIOUY', 'kkkkkkKKKKKK') when 2 then regexp_replace(text, '([a-z]) ([a-z])', '\\1\\2', 'g') else text end as t from documents),
      s as (select doc_id, length(t) as n, len(regexp_extract_all(t, '\\p{{L}}')) as letters, len(regexp_extract_all(t, '[A-Za-z]')) as plain, regexp_extract_all(t, '[A-Za-z]{{3,}}') as w from t)
      select doc_id, case when n is null or n < 2000 then 'sound' when letters < 0.3 * n then 'few letters' when plain < 0.4 * n or len(w) < 200 then 'sound'
        when len(w) >= 300 and len(list_filter(w, lambda x: not regexp_matches(x, '(?i)[aeiouy]'))) > 0.15 * len(w) then 'words without vowels'
        when coalesce(list_sum(list_transform(list_filter(w, lambda x: length(x) > 24), lambda x: length(x))), 0) > 0.06 * list_sum(list_transform(w, lambda x: length(x))) then 'words run together' else 'sound' end as verdict from s""",
    "front_matter": "select doc_id, lang, (doc_id % 100 + 1950)::int as year, true as whole from documents",
    "line_census": f"""select doc_id, len(l) as n_lines, len(list_filter(l, lambda x: trim(x) = '')) as n_blank, {_COUNT_WORDS.format("text")} as n_words, list_max(list_transform(l, lambda x: length(x))) as longest,
      len(list_filter(l, lambda x: regexp_matches(x, '[\\x{{3400}}-\\x{{9FFF}}\\x{{3040}}-\\x{{30FF}}\\x{{20000}}-\\x{{3134F}}]'))) as n_cjk from (select doc_id, text, string_split(text, chr(10)) as l from documents where text is not null)""",
    "running_lines": f"with {_LINES}, k as (select doc_id, {_KEY} as line from lines) select line, count(distinct doc_id) as n_docs, count(*) as n_lines from k where line <> '' group by line having count(distinct doc_id) >= 3",
    "learned_acronyms": f"with {_ACRONYMS} select doc_id, token, n from learned",
    "word_forms": "select doc_id, len(f) as n_forms, len(list_filter(f, lambda x: contains(x, '-'))) as n_compounds from (select doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:-[\\p{L}\\p{N}]+)*')) as f from documents where text is not null)",
    "glyph_report": "select glyph, count(*) as n, count(distinct doc_id) as n_docs from (select doc_id, unnest(regexp_extract_all(text, '[^\\x{0}-\\x{7F}\\p{M}]')) as glyph from documents) group by glyph order by n desc, glyph limit 40",
    "token_precision_recall": """with a as (select doc_id as id, w, count(*) as n from (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as w from documents) group by all),
      b as (select item_id as id, w, count(*) as n from (select item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as w from benchmark) group by all),
      t as (select id, (select sum(n) from a where a.id = i.id) as x, (select sum(n) from b where b.id = i.id) as y, coalesce((select sum(least(a.n, b.n)) from a join b using (id, w) where a.id = i.id), 0) as c from (select distinct id from a) i join (select distinct id from b) using (id))
      select id, c::bigint as common, round(c / x, 6) as precision, round(c / y, 6) as recall from t""",
    "first_mode": "select l_orderkey, l_quantity, weight from (select *, row_number() over (partition by l_orderkey order by weight desc, first, l_quantity desc) as r from (select l_orderkey, l_quantity, count(*) as weight, min(l_linenumber) as first from lineitem group by all)) where r = 1",
    "weighted_median": "select l_suppkey, median(q) as median from (select l_suppkey, l_quantity as q from lineitem, range(0, 100) u(i) where i < l_linenumber) group by all",
    "paragraph_groups": f"""with {_LINES}, p as (select *, lag(rtrim(text)) over (partition by doc_id order by seq) as b, ltrim(text) as s from lines),
      o as (select *, case when b is null then 1 when regexp_matches(b, '[-\\x{{AD}}]$') then 0 when regexp_matches(b, '[.!?:;…]["'')\\]”’]*$') or b = '' or s = '' then 1 when regexp_matches(s, '^(\\p{{Ll}}|\\p{{N}}|[^\\p{{L}}\\p{{N}}])') then 0 else 1 end as opens from p),
      g as (select *, sum(opens) over (partition by doc_id order by seq) as paragraph from o) select doc_id, paragraph, min(seq) as first, count(*) as n_lines, {_SQUEEZE.format("string_agg(trim(text), ' ' order by seq)")} as text from g where trim(text) <> '' group by doc_id, paragraph""",
    "section_parents": f"with {_MD} select doc_id, seq, level, (select max(b.seq) from heads b where b.doc_id = h.doc_id and b.seq < h.seq and b.level < h.level) as parent from heads h",
    "section_paths": f"""with recursive {_MD}, p as (select *, (select max(b.seq) from heads b where b.doc_id = h.doc_id and b.seq < h.seq and b.level < h.level) as parent from heads h),
      walk as (select doc_id, seq, title as path from p where parent is null union all select p.doc_id, p.seq, w.path || ' > ' || p.title from p join walk w on p.doc_id = w.doc_id and p.parent = w.seq) select * from walk""",
    "heading_anchors": f"""with {_MD}, s as (select doc_id, seq, regexp_replace(regexp_replace(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_ \\t\\n\\x0B\\f\\r\\-]', '', 'g'), '[_ \\t\\n\\x0B\\f\\r]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from heads),
      n as (select *, row_number() over (partition by doc_id, slug order by seq) - 1 as k from s) select doc_id, seq, case when k = 0 then slug else slug || '-' || k end as anchor from n""",
    "blank_collapse": """with g as (select doc_id, string_split(replace(text, '. ', '.' || chr(10) || chr(10) || chr(10)), chr(10)) as l from documents where text is not null),
      r as (select doc_id, i, l[i] as x, i > 1 and trim(l[i]) = '' and trim(l[i - 1]) = '' as gone from g, unnest(range(1, len(l) + 1)) u(i)) select doc_id, count(*) as n_lines, (sum(length(x)) + count(*) - 1)::bigint as length from r where not coalesce(gone, false) group by doc_id""",
    "regime_fill": f"""with {_MD}, t as (select doc_id, seq, lower({_SQUEEZE.format(_NAMED)}) as t from heads),
      o as (select *, case when regexp_matches(t, '^(references|bibliography|works cited)$') then 'references' when regexp_matches(t, '^(glossary|terminology)$') then 'glossary' when regexp_matches(t, '^(notes|endnotes)$') then 'notes' when regexp_matches(t, '^(index|subject index)$') then 'index' when regexp_matches(t, '^(contents|table of contents)$') then 'contents' when regexp_matches(t, '^(preface|foreword|acknowledge?ments?)$') then 'front' when regexp_matches(t, '^((chapter|part) .*|introduction|\\d+(\\.\\d+)* .*)$') then 'body' end as opens from t)
      select doc_id, seq, coalesce(last_value(opens ignore nulls) over (partition by doc_id order by seq), 'body') as regime from o""",
    "audit_checks": f'with {_AUDIT} select doc_id, "check", n from found',
    "audit_totals": f'with {_AUDIT} select "check", sum(n)::bigint as n, count(*) as n_docs from found group by "check"',
    "audit_worst": f"""with {_AUDIT}, wt as (select * from (values ('replacement_chars', 5), ('private_use_chars', 5), ('broken_text_layer', 5), ('unclosed_fence', 4), ('broken_image_link', 4), ('heading_jump', 2), ('duplicate_heading', 2), ('standalone_page_number', 2), ('possible_broken_hyphen', 2), ('malformed_table', 2), ('excess_blank_lines', 1), ('trailing_whitespace', 1), ('short_prose_fragment', 1)) v("check", p))
      select doc_id, sum(p * least(n, 10))::int as score from found join wt using ("check") group by doc_id order by score desc, doc_id limit 50""",
    "evaluate_checks": """with b as (select item_id as doc_id, b.text as item, string_split(b.text, ' ') as w, d.text as t from benchmark b left join documents d on d.doc_id = b.item_id),
      k as (select doc_id, 'contains' as kind, contains(t, item) as ok from b union all select doc_id, 'absent', not contains(t, item) from b
        union all select doc_id, 'count', t is not null and not contains(t, w[2]) from b
        union all select doc_id, 'order', contains(lower(t), lower(w[2])) and contains(substr(lower(t), strpos(lower(t), lower(w[2])) + length(w[2])), lower(w[3])) from b)
      select doc_id, kind, coalesce(ok, false) as passed from k""",
    "latest_events": "select user_id, event_type, ts, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1",
    "event_sessions": """with o as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) <= 1800000000 then 0 else 1 end as opens from events),
      s as (select *, sum(opens) over (partition by user_id order by ts) as session from o) select user_id, session::bigint as session, count(*) as n, min(event_id) as first_event from s group by all""",
    "watermark_sessions": """with o as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) < 1800000000 then 0 else 1 end as opens from events) select user_id, sum(opens)::bigint as n_sessions, count(*) as n_events from o group by user_id""",
    "nearest_order": """with o as (select o_custkey, o_orderdate as at, max(o_orderkey) as k from orders group by all), l as (select l.*, o_custkey from lineitem l join orders on l_orderkey = o_orderkey)
      select l.l_orderkey, l.l_linenumber, o.k as before from l asof left join o on l.o_custkey = o.o_custkey and l.l_shipdate >= o.at""",
    "span_overlaps": "select a.o_custkey as who, a.o_orderkey as a, b.o_orderkey as b from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and abs(date_diff('day', a.o_orderdate, b.o_orderdate)) <= 10",
    "top_items": "select l_suppkey, l_orderkey, l_linenumber, r as rank from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as r from lineitem) where r <= 3",
    "body_styles": f"""with {_BODY}, m as (select doc_id, round_even(x0, 0) as margin, count(*) as n, min(seq) as f from rows_ join body using (doc_id, font, size) group by all)
      select doc_id, font, size::double as size, chars::bigint as chars, margin::double as margin from body join (select *, row_number() over (partition by doc_id order by n desc, f) as k from m) using (doc_id) where k = 1""",
    "furniture": f"""with {_PAGES}, k as (select *, y1 < 80 or y0 > 752 as band, {_KEY} as key from rows_), n as (select doc_id, max(page) + 1 as pages from rows_ group by doc_id),
      h as (select doc_id, key, count(distinct page) as c from k where band group by all), hh as (select h.doc_id, h.key from h join n using (doc_id) where c >= greatest(3, floor(pages * 0.02)))
      select k.doc_id, count(*) as n_lines, max(page) as last_page from k left join hh on k.doc_id = hh.doc_id and k.key = hh.key where not (band and (hh.key is not null or regexp_matches(text, '^\\s*(\\d{{1,4}}|[ivxlc]{{1,7}})\\s*$'))) group by k.doc_id""",
    "column_order": f"""with {_COLS}, b as (select *, sum((col = -1)::int) over (partition by doc_id, page order by y0, x0, seq) as band from cols)
      select doc_id, seq, col, row_number() over (partition by doc_id order by page, band, col, round_even(y0 / 3, 0), x0, seq) - 1 as place from b""",
    "line_pitch": f"with {_COLS} select doc_id, median(step)::double as pitch from steps where step > 0 and step < 160 group by doc_id",
    "isolated_lines": f"with {_COLS}, p as (select doc_id, median(step) as pitch from steps where step > 0 and step < 160 group by doc_id) select s.doc_id, sum((step is null or step > 1.35 * coalesce(pitch, 12))::int)::bigint as n_isolated from steps s left join p on s.doc_id = p.doc_id group by s.doc_id",
    "heading_styles": f"""with {_BODY}, s as (select doc_id, font, size, count(*) as n, avg(is_bold::int) as bold, median(length(text)) as long from rows_ group by all)
      select s.doc_id, s.font, s.size::double as size, s.n, dense_rank() over (partition by s.doc_id order by s.size desc) as level from s join body b on s.doc_id = b.doc_id where s.n >= 3 and (s.size > b.size + 0.6 or (bold > 0.5 and s.font <> b.font)) and long <= 90""",
    "caption_boxes": f"""with {_PAGES}, g as (select doc_id, page, b as box_id, 40.0 + 135 * b as bx0, 160.0 + 135 * b as bx1, 80.0 + 10 * b as by1 from pg, range(0, 4) u(b)),
      p as (select r.doc_id, r.page, r.seq, box_id, y0 - by1 as gap from rows_ r join g on r.doc_id = g.doc_id and r.page = g.page where is_bold and x0 < bx1 and bx0 < x1 and y0 - by1 between 0 and 48)
      select doc_id, page, seq, box_id, gap::double as gap from (select *, row_number() over (partition by doc_id, page, seq order by gap, box_id) as k from p) where k = 1""",
    "lines_in_boxes": f"""with {_PAGES}, g as (select doc_id, page, b as box_id, 100.0 + 90 * b as by0, 220.0 + 90 * b as by1 from pg, range(0, 3) u(b))
      select r.doc_id, r.seq, min(box_id) as box_id from rows_ r join g on r.doc_id = g.doc_id and r.page = g.page where (x0 + x1) / 2 between 0 and 300 and (y0 + y1) / 2 between by0 and by1 group by all""",
    "page_coverage": f"""with {_PAGES}, r as (select *, seq % 11 <> 5 as used, y1 < 80 or trim(text) = '' as furniture from rows_),
      s as (select doc_id, page, sum((used and not furniture)::int) as retained, sum((used and furniture)::int) as suppressed, sum((not used)::int) as unaccounted, (page % 3 = 2)::int as n_images, sum(len(regexp_extract_all(text, '[\\x{{FFFD}}\\p{{Co}}]'))) as damaged from r group by doc_id, page)
      select doc_id, page, retained::bigint as retained, suppressed::bigint as suppressed, unaccounted::bigint as unaccounted, array_to_string(list_filter([case when unaccounted > 0 then 'unaccounted_lines' end, case when n_images > 0 and retained = 0 then 'images_without_text' end, case when damaged > 0 then 'damaged_characters' end, case when retained = 0 and suppressed > 0 then 'nothing_retained' end], lambda x: x is not null), ',') as reasons,
        retained + suppressed + unaccounted + n_images = 0 as blank_candidate from s""",
    "table_markdown": f"""with {_CELLS}, b as (select table_id, r, '| ' || string_agg(text, ' | ' order by col, text) || ' |' as line from cells where r > 2 group by all)
      select table_id, '| Part | Item — Quantity | Item — Flag |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) order by r) as md from b group by table_id""",
    "table_status": f"""with {_CELLS}, h as (select table_id, r, col, colspan, case when table_id % 5 = 0 and r = 3 then 2 when table_id % 7 = 0 and r = 1 then 1000000 else rowspan end as rowspan from cells),
      z as (select table_id, sum(rowspan * colspan) as n from h group by table_id), e as (select table_id, r + a as y, col + b as x from h join z using (table_id), range(0, 2) u(a), range(0, 2) v(b) where n <= 200000 and a < rowspan and b < colspan),
      o as (select distinct table_id from (select table_id, y, x from e group by all having count(*) > 1)) select z.table_id, case when n > 200000 then 'refused' when o.table_id is not null then 'overlap' else 'ok' end as status from z left join o on z.table_id = o.table_id""",
    "html_titles": "select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) as title from pages",
    "html_links": "select page_id, len(h) as n_links, list_min(h) as first_href from (select page_id, regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1) as h from pages) where len(h) > 0",
    "acronym_sets": f"""with {_ACRONYMS}, known as (select unnest(string_split('ISBN DOI LCCN LCC DDC LCSH USA UK NY CA DC MIT IEEE ACM AI II III IV VI VII VIII IX XI XII PhD MD BC AD TV US EU UN CEO CTO UX UI API OCR PDF TD MC DP RL MDP', ' ')) as token),
      both_ as (select doc_id, token from learned union select d.doc_id, token from (select distinct doc_id from ac) d, known) select doc_id, string_agg(token, ' ' order by token) as acronyms from both_ group by doc_id""",
    "document_kinds": f"""with {_BODY}, r as (select rows_.*, body.size as body, row_number() over (partition by rows_.doc_id order by page, y0, x0, seq) as n, count(*) over (partition by rows_.doc_id) as total from rows_ join body on rows_.doc_id = body.doc_id),
      f as (select doc_id, count(*) as lines, count(*) filter (where regexp_matches(text, '{_q(K.BULLET)}')) as bullets, count(*) filter (where page = 0 and n <= 60 and regexp_matches(text, '{_q(K.ABSTRACT)}')) as abstract, count(*) filter (where page <= 2 and regexp_matches(text, '{_q(K.ARXIV)}')) as arxiv,
        count(*) filter (where regexp_matches(text, '{_q(K.KIND_MARKS["paper"])}')) as paper, count(*) filter (where page <= 2 and regexp_matches(text, '{_q(K.KIND_MARKS["book"])}')) + count(*) filter (where n > total - 200 and regexp_matches(text, '{_q(K.KIND_MARKS["book"])}')) as book,
        count(*) filter (where regexp_matches(text, '{_q(K.CHAPTER)}') and size >= 1.3 * body) as chapters, count(*) filter (where page <= 2 and regexp_matches(text, '{_q(K.KIND_MARKS["document"])}')) as marks,
        count(*) filter (where regexp_matches(text, '{_q(K.FORM)}') and regexp_matches(text, '[A-Za-z]{{3,}}') and not regexp_matches(text, '^\\s*[\\x{{2610}}\\x{{2611}}\\x{{2612}}\\x{{25A1}}\\x{{25A0}}]')) + (count(*) filter (where regexp_matches(text, '{_q(K.BOXES)}')) > 0)::int as forms,
        count(*) filter (where regexp_matches(text, '{_q(K.KIND_MARKS["deck"])}')) as deck, count(*) filter (where page = 0) as cover, max(size) filter (where page = 0) as big, any_value(body) as body from r group by doc_id),
      p as (select doc_id, page, count(*) as n, sum({_COUNT_WORDS.format("text")}) as words, count(*) filter (where regexp_matches(text, '{_q(K.LEADER)}')) as leaders, count(*) filter (where x1 - x0 < 300) as narrow, count(*) filter (where x0 > 305) as right_, arg_max(y0, (size, -n)) as top, max(size) as big, any_value(body) as body from r group by doc_id, page),
      d as (select doc_id, count(*) as used, max(page) + 1 as pages, median(words) as dense, count(*) filter (where n >= 12 and narrow >= 0.6 * n and right_ >= 0.25 * n) as split, count(*) filter (where leaders >= 4) as leaders from p group by doc_id),
      k as (select doc_id, round_even(top / 15, 0) as a, round_even(big, 0) as b, count(*) as k from p where big >= 1.25 * body group by all), t as (select doc_id, sum(k) as titled, list_sort(list(k), 'desc') as ks from k group by doc_id),
      s as (select d.doc_id, {{'document': case when pages <= 3 then 2 when pages <= 25 then 1 else 0 end + (dense >= 100 and dense < 250)::int + (bullets > 0.25 * lines)::int + least(5, 2 * marks) + case when forms >= 3 then least(5, forms) else 0 end,
          'paper': (pages > 3 and pages <= 60)::int + (dense >= 250)::int + 4 * (abstract > 0)::int + 4 * (arxiv > 0)::int + (paper >= 2)::int + 2 * (split >= 2 and split >= 0.4 * used)::int,
          'book': 3 * (pages > 60)::int + (pages > 150)::int + (dense >= 250)::int + 3 * (book >= 2)::int + 4 * (chapters >= 2)::int + 2 * (d.leaders > 0)::int + 2 * (pages >= 30 and cover between 1 and 14 and big >= 2.2 * body)::int,
          'deck': (pages > 3 and pages <= 60)::int + case when dense < 100 then case when pages >= 3 then 3 else 1 end else 0 end + 2 * (bullets > 0.25 * lines)::int + least(4, deck) + case when titled >= 4 and titled >= 0.5 * used then case when ks[1] >= 0.6 * used then 4 when ks[1] + coalesce(ks[2], 0) >= 0.7 * used then 3 else 0 end else 0 end}} as m from d join f using (doc_id) left join t using (doc_id)),
      o as (select doc_id, m, list_sort([m['document'], m['paper'], m['book'], m['deck']], 'desc') as v from s)
      select doc_id, case v[1] when m['document'] then 'document' when m['paper'] then 'paper' when m['book'] then 'book' else 'deck' end as kind, case when v[1] + v[2] = 0 then 0.5 else round(v[1] / (v[1] + v[2]), 6) end as confidence from o""",
    "markdown_chunks": f"""with recursive {_MD}, w as (select doc_id, string_split_regex(regexp_replace(string_agg(text, chr(10) order by seq), '^\\s+|\\s+$', '', 'g'), '\\n\\s*\\n') as b from md group by doc_id),
      b as (select doc_id, i - 1 as k, b[i] as t from w, unnest(range(1, len(b) + 1)) u(i)), h as (select doc_id, k, length(regexp_extract(t, '^(#+)', 1)) as level, regexp_extract(t, '^#+\\s+([^\\n]+)', 1) as title from b where regexp_full_match(t, '#{{1,6}}\\s+[^\\n]+')),
      hp as (select *, (select max(x.k) from h x where x.doc_id = h.doc_id and x.k < h.k and x.level < h.level) as parent from h),
      walk as (select doc_id, k, title as path from hp where parent is null union all select hp.doc_id, hp.k, w.path || ' > ' || hp.title from hp join walk w on hp.doc_id = w.doc_id and hp.parent = w.k),
      c as (select b.doc_id, b.k, t, coalesce(path, '') as path, h.k is not null as head from b asof left join walk on b.doc_id = walk.doc_id and b.k >= walk.k left join h on b.doc_id = h.doc_id and b.k = h.k),
      o as (select *, case when path <> '' and not head then path || chr(10) || chr(10) || t else t end as text from c)
      select doc_id, k::int as chunk, path, text, {_COUNT_WORDS.format("text")} as tokens, {_COUNT_WORDS.format("text")} > 40 as oversize from o""",
    "table_chunks": """with r as (select l_orderkey as doc_id, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) - 1) // 3 as part, l_linenumber, l_partkey, l_quantity, '| ' || l_partkey || ' | ' || l_quantity::int || ' |' as row from lineitem)
      select doc_id, 0 as chunk, 'Items' as path, '# Items' as text, 2 as tokens, false as oversize from (select distinct doc_id from r)
      union all select doc_id, (part + 1)::int, 'Items', 'Items' || chr(10) || chr(10) || '| part | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(row, chr(10) order by l_linenumber, l_partkey, l_quantity), (11 + 5 * count(*))::int, false from r group by doc_id, part""",
    "build_steps": f"""with recursive {_LINES}, s as (select doc_id, seq // 5 as slide, list(text order by seq) as l from lines group by all),
      p as (select doc_id, (slide * 3 + step)::int as page, slide, list_transform(list_slice(l, 1, case when step = 2 then len(l) else step + 1 end), lambda x: lower({_SQUEEZE.format("x")})) as keys, lower({_SQUEEZE.format("array_to_string(list_slice(l, 1, case when step = 2 then len(l) else step + 1 end), ' ')")}) as run from s, range(0, 3) u(step)),
      w as (select doc_id, 0 as at, 0 as held, null::int as gone from p where page = 0
        union all select w.doc_id, w.at + 1, case when h.slide = c.slide and not (h.page <> 0 and (len(list_filter(h.keys, lambda x: not list_contains(c.keys, x))) = 0 or starts_with(c.run, h.run))) and (len(list_filter(c.keys, lambda x: not list_contains(h.keys, x))) = 0 or starts_with(h.run, c.run)) then h.page else c.page end,
          case when h.slide <> c.slide then null when h.page <> 0 and (len(list_filter(h.keys, lambda x: not list_contains(c.keys, x))) = 0 or starts_with(c.run, h.run)) then h.page when len(list_filter(c.keys, lambda x: not list_contains(h.keys, x))) = 0 or starts_with(h.run, c.run) then c.page end
        from w join p h on h.doc_id = w.doc_id and h.page = w.held join p c on c.doc_id = w.doc_id and c.page = w.at + 1)
      select doc_id, gone as page from w where gone is not null""",
    "outline_tree": """select doc_id, seq, kind, level, in_toc from documents join (values (0, 0, 'section', 1, true), (0, 1, 'section', 2, true), (0, 2, 'section', 2, true), (0, 3, 'section', 3, true), (0, 4, 'body', 0, false), (0, 5, 'section', 1, true), (0, 6, 'section', 2, true), (0, 7, 'section', 2, true),
      (1, 0, 'heading', 1, true), (1, 1, 'heading', 1, true), (1, 2, 'heading', 1, true), (1, 3, 'heading', 1, true),
      (2, 0, 'section', 1, true), (2, 1, 'section', 2, true), (2, 2, 'runin', 0, false), (2, 3, 'runin', 0, false), (2, 4, 'runin', 0, false), (2, 5, 'heading', 1, true),
      (3, 0, 'section', 1, true), (3, 1, 'section', 1, true), (3, 2, 'section', 1, true), (3, 3, 'heading', 2, true)) v(k, seq, kind, level, in_toc) on doc_id % 4 = k""",
    "list_parents": f"""with {_LINES}, i as (select doc_id, seq, (seq * 5 % 3 + 1)::int as level, (seq + 1) // 7 as run from lines where seq % 7 <> 6)
      select doc_id, seq, level, (select max(b.seq) from i b where b.doc_id = i.doc_id and b.run = i.run and b.seq < i.seq and b.level < i.level) as parent from i""",
    "contents_entries": f"""with {_MD}, s as (select *, regexp_replace(regexp_replace(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_ \\t\\n\\x0B\\f\\r\\-]', '', 'g'), '[_ \\t\\n\\x0B\\f\\r]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from heads),
      n as (select *, row_number() over (partition by doc_id, slug order by seq) - 1 as k, dense_rank() over (partition by doc_id order by level) - 1 as d from s)
      select doc_id, seq, repeat('  ', d::int) || '- [' || title || '](#' || slug || case when k = 0 then '' else '-' || k end || ')' as entry from n""",
    "heading_echoes": f"""with {_MD}, a as (select doc_id, seq, case when seq % 4 = 2 then lower(coalesce(lag(title) over (partition by doc_id order by seq), title)) else title end as title from heads),
      k as (select doc_id, seq, lower({_SQUEEZE.format("title")}) as key from a) select doc_id, seq from (select *, lag(key) over (partition by doc_id order by seq) as before from k) where key is distinct from before""",
    "note_places": f"""with {_LINES}, k as (select doc_id, seq, case when seq % 9 = 0 then 'heading' when seq % 4 = 2 then 'footnote' else 'para' end as kind from lines)
      select doc_id, seq, kind, row_number() over (partition by doc_id order by seq // 9, (kind = 'footnote')::int, seq) - 1 as place from k""",
    "roman_sections": f"with {_LINES} select doc_id, seq, v.value from lines join (values (1, 1), (4, 2), (13, 3), (16, 4), (19, 5)) v(s, value) on seq = s where doc_id in (select doc_id from lines where seq = 13)",
    "printed_contents": f"""with {_LINES}, e as (select doc_id, seq, seq // 20 as page, case seq % 4 when 0 then '' when 1 then '2 ' else '2.1 ' end || 'Entry ' || seq || case when seq % 3 = 2 then '' else ' ..... ' || seq end as text, (seq % 3 <> 2)::int as leader from lines where seq < 40),
      c as (select *, count(*) over (partition by doc_id, page) as n, sum(leader) over (partition by doc_id, page) as lead from e), k as (select *, coalesce(sum(leader) over (partition by doc_id order by seq rows between unbounded preceding and 1 preceding), 0) as g from c where n >= 8 and lead >= 3 and (lead >= 0.4 * n or lead >= 6)),
      j as (select doc_id, g, min(seq) as seq, string_agg(trim(text), ' ' order by seq) as t from k group by doc_id, g having max(leader) = 1),
      m as (select doc_id, seq, regexp_extract(t, '^\\s*(\\d{{1,2}}(?:\\.\\d{{1,2}})*)?\\s*(.*?)\\s*(?:\\.\\s?){{3,}}\\s*(\\d{{1,4}})?\\s*$', 1) as num, regexp_extract(t, '^\\s*(\\d{{1,2}}(?:\\.\\d{{1,2}})*)?\\s*(.*?)\\s*(?:\\.\\s?){{3,}}\\s*(\\d{{1,4}})?\\s*$', 2) as title from j)
      select doc_id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') as title_key, arg_max(case when num = '' then 1 else len(string_split(num, '.')) end, seq)::int as level from m group by all""",
    "cleanest_results": """select stem, path as kept, n from (select *, count(*) over (partition by stem) as n, row_number() over (partition by stem order by score, issues, bytes desc, path) as r from
      (select 's' || (doc_id // 4) as stem, 'Out/' || doc_id || '.md' as path, doc_id * 7 % 3 as score, doc_id % 2 as issues, coalesce(strlen(text), 0) as bytes from documents)) where r = 1""",
    "case_statuses": """with c as (select doc_id // 3 as case_id, count(*) filter (where doc_id % 5 <> 0) as n, min(quality) filter (where doc_id % 5 <> 0) as q from labels group by all)
      select case_id, case when case_id % 11 = 0 then 'missing' when case_id % 13 = 5 then 'timeout' when case_id % 7 = 3 then 'error' when n = 0 then 'unannotated' when q = 1 then 'passed' else 'failed' end as status from c""",
    "engine_medians": """select l_returnflag as engine, count(*) as n, median(case when l_linestatus = 'F' then l_extendedprice::double end) as seconds, median(case when l_linestatus = 'F' then l_quantity::double end) as bytes from lineitem group by all""",
    "joined_parts": """with t as (select doc_id, '---' || chr(10) || 'title: t' || doc_id || chr(10) || '---' || chr(10) || 'first' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || regexp_replace(trim(text), '^\\s+', '') as t from documents where text is not null)
      select doc_id, sha256(t) as sha256, length(t)::int as length from t""",
    "page_ranges": """select doc_id, f::int as first, least(f + 74, n)::int as last from (select doc_id, coalesce(length(text), 0) as n from documents), unnest(range(1, n + 1, 75)) u(f)""",
    "new_names": """with f as (select 'out/' || lang || '/' || lpad(doc_id::varchar, 8, '0') || '.md' as path, 'out/' || lang || '/' as folder, case when doc_id % 5 = 1 then lpad(doc_id::varchar, 8, '0') when doc_id % 4 = 0 then 'The-Same-Title' else 'Title-No-' || (doc_id % 50) end as want from documents),
      n as (select *, row_number() over (partition by folder, want order by path) as k from f) select path, folder, want || case when k > 1 then '-' || k else '' end || '.md' as name from n""",
    "size_tiers": f"""with recursive {_PAGES}, z as (select distinct doc_id, round(9.0 + (((seq * 7) % 23 + 23) % 23) * 0.3, 1)::double as size from rows_), o as (select *, row_number() over (partition by doc_id order by size desc) as r from z),
      w as (select doc_id, r, size, size as head, 1 as tier from o where r = 1 union all select o.doc_id, o.r, o.size, case when w.head - o.size > 0.4 then o.size else w.head end, case when w.head - o.size > 0.4 then w.tier + 1 else w.tier end from w join o on o.doc_id = w.doc_id and o.r = w.r + 1)
      select doc_id, size, tier from w where tier <= 6""",
    "text_families": f"""with {_PAGES}, g as (select doc_id, case ((seq % 4) + 4) % 4 when 2 then 'Times' when 3 then 'Garamond' else 'CM' end as family, sum(length(text)) as c from rows_ group by all)
      select doc_id, family, round(c / sum(c) over (partition by doc_id), 6) as share from g qualify share >= 0.1""",
    "kind_census": f"with {_PAGES} select doc_id, nullif(count(*) filter (where is_bold), 0) as headings, count(*) filter (where not is_bold) as bodies from rows_ group by doc_id",
    "table_chains": """with t as (select doc_id, p as id, case when p % 7 = 6 then 70 else 50 end as x0, p // 4 as number, p % 4 <> 0 as goes, case when p = 2 then 'A|B' else 'a|b' end as h from (select doc_id, least(coalesce(length(text), 0) // 200, 12) as m from documents), unnest(range(0, m + 1)) u(p)),
      l as (select *, coalesce(goes and number = lag(number) over o and abs(x0 - lag(x0) over o) <= 8 and h = lag(h) over o, false) as linked from t window o as (partition by doc_id order by id))
      select doc_id, id::int as table_id, max(case when not linked then id end) over (partition by doc_id order by id)::int as root from l""",
    "table_pages": """with k as (select l_orderkey as table_id, l_linenumber, l_partkey, l_returnflag, '<tr>' || chr(10) || '<td rowspan="1" colspan="1">' || l_partkey || '</td>' || chr(10) || '<td rowspan="1" colspan="1">' || l_returnflag || ' &amp; co</td>' || chr(10) || '</tr>' as row from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_returnflag) <= 2)
      select table_id, '<table>' || chr(10) || '<tr>' || chr(10) || '<th rowspan="1" colspan="2">Items &lt;2&gt;</th>' || chr(10) || '</tr>' || chr(10) || string_agg(row, chr(10) order by l_linenumber, l_partkey, l_returnflag) || chr(10) || '</table>' as html from k group by table_id""",
    "covered_pages": """select doc_id, round(count(*) filter (where p >= 7) / count(*), 6) as share from (select doc_id, least(coalesce(length(text), 0) // 500, 9) as m from documents), unnest(range(0, m + 1)) u(p) group by doc_id""",
    "numbered_titles": f"""with {_LINES}, r as (select doc_id, seq, case when seq % 6 = 0 then (seq // 6 + 1) || '.2' else text end as t, seq % 4 = 1 as bold from lines where seq < 60),
      n as (select *, lead(t) over o as nt, lead(bold) over o as nb, lead(seq) over o as ns from r window o as (partition by doc_id order by seq))
      select doc_id, seq, len(string_split(rtrim(trim(t), '.'), '.'))::int as level, trim(t) || ' ' || trim(nt) as title from n where regexp_matches(trim(t), '^\\d{{1,2}}(\\.\\d{{1,2}}){{0,2}}\\.?$') and seq % 2 = 0 and ns = seq + 1 and (bold or nb) and length(trim(nt)) <= 90""",
    "text_hashes": "select doc_id, sha256(text) as sha256 from documents",
}
ORACLE_SQL |= {name: expected(name) for name in CASES}

ORACLE_SQL |= {
    "wrapped_titles": f"""with {_LINES}, r as (select doc_id, seq // 6 as page, seq % 6 as pos, (doc_id + seq // 6) % 3 as run, trim(left(text, 30)) as t from lines where seq < 60),
      g as (select doc_id, page, any_value(run) as run, count(*) as n, max(t) filter (where pos = 0) as first, string_agg(t, ' ' order by pos) filter (where pos <= run) as whole from r group by doc_id, page)
      select doc_id, page::int as page, case when run > 0 and n > run + 1 then whole else first end as title, (case when run > 0 and n > run + 1 then run + 1 else 1 end)::int as n_lines from g""",
    "duplicate_results": """with r as (select 's' || (doc_id // 4) as stem, 'Out/' || doc_id || '.md' as path, doc_id % 3 as score, coalesce(strlen(text), 0) as bytes from documents),
      k as (select *, first_value(path) over (partition by stem order by score, bytes desc, path) as kept from r) select stem, path, kept from k where path <> kept""",
    "engine_pairs": """with r as (select l_orderkey as case_id, l_linenumber = 1 as ours, max(l_extendedprice)::double as s from lineitem where l_linenumber <= 2 group by all)
      select a.case_id, a.s as left_seconds, b.s as right_seconds from r a join r b on a.case_id = b.case_id and a.ours and not b.ours""",
    "table_contexts": f"""with {_PAGES} select doc_id, page as table_id, string_agg(text, ' ' order by y0, x0, seq) as context from rows_ where x0 < 200 and x1 > 50 and (180 - y1 between 0 and 55 or y0 - 300 between 0 and 45) group by doc_id, page""",
    "margin_terms": f"""with {_LINES}, b as (select doc_id, seq, lower(text) as t, 16 * seq as y from lines where seq < 30), m as (select doc_id, seq + 1000 as seq, trim(string_split(text, ' ')[1]) as t, string_split(text, ' ')[1] as raw, 16 * seq + case when seq % 2 = 0 then 32 else 160 end as y from lines where seq < 30)
      select distinct m.doc_id, m.seq from m join b on m.doc_id = b.doc_id and abs(b.y - m.y) <= 40 and contains(b.t, lower(m.t)) where m.t <> '' and length(m.raw) <= 40""",
    "found_boxes": f"""with {_PAGES}, f as (select doc_id, page, seq, x0, x1, y1 + 1 as a, y1 + 1 + seq % 8 as b from rows_ where seq >= 0)
      select doc_id, page, seq as found_id from f where not exists (select 1 from rows_ r where r.doc_id = f.doc_id and r.page = f.page and least(r.x1, f.x1) > greatest(r.x0, f.x0) and least(r.y1, f.b) > greatest(r.y0, f.a))""",
    "told_levels": f"""with {_MD}, t as (select distinct doc_id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') as k from heads where seq % 24 = 0)
      select h.doc_id, h.seq, case when t.k is null then h.level else 4 end as level from heads h left join t on h.doc_id = t.doc_id and regexp_replace(lower(h.title), '[^a-z0-9]', '', 'g') = t.k""",
    "changed_lines": f"""with {_LINES}, c as (select doc_id, seq, text as before, case when regexp_matches(trim(x), '^[A-Za-z0-9+/]{{40,}}={{0,2}}$') then '' else x end as after from (select doc_id, seq, t as text, regexp_replace(replace(regexp_replace(t, '\\(c\\)(\\s*\\d{{4}})', '©\\1', 'g'), '7!', '↦'), '([^ \\t])[ \\t]+', '\\1 ', 'g') as x from (select *, case when seq % 3 = 0 then replace(text, ' ', '  ') else text end as t from lines))) select * from c where before <> after""",
    "dense_headings": f"""with {_COLS}, h as (select * from cols where seq >= 0 and (seq % 20 < 6 or seq % 20 = 12)) select doc_id, seq, count(*) over (partition by doc_id, page, col order by seq range between 3 preceding and 3 following) > 4 as dense from h""",
}
