"""Sections, selections and subsections of enactments. The oracles know by `variant` how each text was made."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outline
from .base import query

_NL = "chr(10)"
#: variant: number, heading, block of its sections in order.
_SECTIONS = {
    0: [("1", "Title", f"'SEC. 1. Title' || {_NL} || 'On ' || said"), ("2", "Rules", f"'SEC. 2. Rules' || {_NL} || 'Body two'")],
    1: [("I", "Title", f"'Section I - Title' || {_NL} || 'On ' || said"), ("2", "Rules", f"'§ 2. Rules' || {_NL} || 'Body two'")],
    2: [("1", "Title again", f"'SEC. 1. Title again' || {_NL} || 'On ' || said"), ("3", "Other", f"'SEC 3: Other' || {_NL} || 'Body three'")],
    4: [("II", "Rules", f"'sec. ii. Rules' || {_NL} || 'Body two'"), ("1", "", f"'SECTION 1.' || {_NL} || {_NL} || 'On ' || said")],
    6: [("IX", "Ninth", f"'SEC. IX. Ninth' || {_NL} || 'Body nine'"), ("2", "Rules", f"'SEC. 2) Rules' || {_NL} || 'Body two'"), ("2A", "More", f"'SEC. 2A. More' || {_NL} || said")],
}
_BLOCKS = " union all ".join(f"select act_id, '{number}' as number, '{heading}' as heading, {block} as block from {{outlines}} where variant = {v}" for v, rows in _SECTIONS.items() for number, heading, block in rows)


@query(_BLOCKS)
def ex17_split_sections(outlines):
    return outline.split_sections(outlines, "act_id", "text").select("act_id", "number", "heading", "block")


@query(f"""with b as ({_BLOCKS}), asked as (select act_id, generate_subscripts(w, 1) as place, unnest(w) as number from (select act_id, string_split(wanted, ',') as w from {{outlines}} where wanted <> '')),
 got as (select a.act_id, place, min(block) as block from asked a left join b on b.act_id = a.act_id and (b.number = a.number or b.number = case a.number when '1' then 'I' when '2' then 'II' end) group by all),
 every as (select act_id, bool_and(block is not null) as whole, string_agg(block, chr(10) || chr(10) order by place) as said from got group by act_id)
 select o.act_id, case when whole then e.said else o.text end as selected, case when wanted = '' then '{outline.FULL}' when whole then 'sections ' || replace(wanted, ',', ', ') else '{outline.INCOMPLETE}' end as label from {{outlines}} o left join every e using (act_id)""")
def ex18_select_sections(outlines):
    wanted = F.filter(F.split("wanted", ","), lambda x: x != "")
    return outline.select_sections(outlines.withColumn("wanted", wanted), "text", "wanted").select("act_id", "selected", "label")


#: variant: (n, mark, kind, depth, parent, text) of its paragraphs.
_PARAGRAPHS = {
    0: [(0, None, None, 0, None, "'Lead'"), (1, "a", "a", 1, None, "'A one goes on'"), (2, "1", "1", 2, 1, "'n one'"), (3, "2", "1", 2, 1, "'n two'"), (4, None, None, 3, 3, "'more'"), (5, "b", "a", 1, None, "p_name")],
    1: [(0, "g", "a", 1, None, "'x'"), (1, "h", "a", 1, None, "'y'"), (2, "i", "a", 1, None, "'z'"), (3, "j", "a", 1, None, "p_name")],
    2: [(0, "h", "a", 1, None, "'y'"), (1, "i", "i", 2, 0, "'one'"), (2, "ii", "i", 2, 0, "'two'"), (3, "i", "a", 1, None, "p_name")],
    3: [(0, "a", "a", 1, None, "'x'"), (1, "1", "1", 2, 0, "'y'"), (2, "A", "A", 3, 1, "'z'"), (3, "i", "i", 4, 2, "'r'"), (4, "I", "I", 5, 3, "'R'"), (5, "II", "I", 5, 3, "'S'"), (6, "B", "A", 3, 1, "'t'"), (7, "2", "1", 2, 0, "p_name")],
}
_sql = lambda x: "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
_OUTLINE = " union all ".join(f"select act_id, {n} as n, {_sql(mark)} as mark, {_sql(kind)} as kind, {depth} as depth, {_sql(parent)} as parent, {text} as text from {{bodies}} join {{part}} on p_partkey = act_id where variant = {v}" for v, rows in _PARAGRAPHS.items() for n, mark, kind, depth, parent, text in rows)


@query(_OUTLINE)
def ex26_outline(bodies):
    return outline.subsections(bodies, "act_id", "text")


@query("""with p as (select act_id, generate_subscripts(l, 1) - 1 as n, unnest(l) as t from (select act_id, list_filter(list_transform(regexp_split_to_array(text, chr(10) || '[ \t]*' || chr(10)), lambda x: trim(regexp_replace(x, '\\s*' || chr(10) || '\\s*', ' ', 'g'))), lambda x: x <> '') as l from {bodies})),
 m as (select *, nullif(regexp_extract(t, '^\\(([A-Za-z])\\)', 1), '') as mark from p), o as (select *, max(case when mark is not null then n end) over (partition by act_id order by n) as open from m)
 select act_id, n::int as n, mark, case when mark is not null then 1 when open is null then 0 else 2 end as depth, (case when mark is null then open end)::int as parent, case when mark is null then t else trim(regexp_replace(t, '^\\([A-Za-z]\\)', '')) end as text from o""")
def ex26_subsection_rows(bodies):
    return outline.subsections(bodies, "act_id", "text", nested=False).drop("kind")
