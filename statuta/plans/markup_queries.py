"""Inventories of marked-up files: files are put together from their pieces and parsed; the SQL counts from the pieces' columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markup
from .base import query

# The nearest identifier before a note: its own section's, else the last one of the file, which may stand in a note.
_NOTES = """notes as (select file, ord, 'rp-pl' || lpad(c::varchar, 3, '0') || lpad(n::varchar, 3, '0') || '-codification' as note_id, c || '-' || n as law, 'Pub. L. ' || cited || (case when by_href then '-' else '–' end) || n || '. ' || heading as heading,
  cited || '-' || n as heading_law, coalesce(identifier, before) as placement, 'active ' || tint as status, dump, case when linked then link else '' end as links, case when digested then digest else '' end as digests, title, noted from
  (select *, last_value(case when noted and inner_id then '/us/usc/t1/s1' else identifier end ignore nulls) over (partition by file order by ord rows between unbounded preceding and 1 preceding) as before from {markup_parts}) where noted)"""
_LAW = "'PL-' || lpad({}::varchar, 3, '0') || '-' || lpad(n::varchar, 3, '0')"


def _index(pieces):
    return markup.index(markup.assemble(pieces))


@query(f"with {_NOTES} select file, note_id, law, heading, heading_law, placement, status, dump, links, digests from notes")
def ex20_note_inventory(markup_pieces):
    notes = markup.note_inventory(_index(markup_pieces))
    return notes.select("file", "note_id", "law", "heading", "heading_law", "placement", "status", "dump", F.array_join("links", " ").alias("links"), F.array_join("digests", " ").alias("digests"))


@query(f"""with {_NOTES}, laws as (select law, count(*) as k, count(distinct file) as f from notes group by law)
 select count(*) as notes, count(distinct law) as laws, count(*) filter (dump) as dumps, count(*) filter (links <> '') as linked, count(*) filter (digests <> '') as with_digest, count(*) filter (heading_law <> law) as other_law,
 (select count(*) from laws where k > 1) as laws_repeated, (select count(*) from laws where f > 1) as laws_in_files, count(distinct file) as files from notes""")
def ag4_note_summary(markup_pieces):
    return markup.note_summary(markup.note_inventory(_index(markup_pieces)))


@query(f"with {_NOTES} select law, file, count(*) as notes, any_value(f) as files from notes join (select law, count(distinct file) as f from notes group by law having count(*) > 1) using (law) group by law, file")
def ag4_laws_in_files(markup_pieces):
    return markup.note_laws(markup.note_inventory(_index(markup_pieces)))


@query("""select title::varchar as title, lower(section) as section_key, arg_min(section, file || lpad(ord::varchar, 12, '0') || k) as section from
 (select file, ord, title, '0' as k, ord::varchar as section from {markup_parts} where identifier is not null union all select file, ord, title, '1', other from {markup_parts}
  union all select file, ord, 1, '2', '1' from {markup_parts} where noted and inner_id) group by title, lower(section)""")
def ex22_section_index(markup_pieces):
    return markup.section_index(_index(markup_pieces))


@query(f"""select law_id, file, sum(h)::bigint as by_href, sum(m)::bigint as by_name from (select {_LAW.format('c')} as law_id, file, 1 as h, 0 as m from {{markup_parts}} where (noted or added) and by_href
 union all select {_LAW.format('cited')}, file, 0, 1 from {{markup_parts}} where noted or added and by_name) group by law_id, file""")
def ex28_law_mentions(markup_pieces):
    return markup.law_mentions(_index(markup_pieces)).drop("first")


@query(f"""select distinct case when by_href then {_LAW.format('c')} else {_LAW.format('cited')} end as law_id, coalesce(identifier, file) as location from {{markup_parts}} where noted or added and (by_href or by_name)""")
def ex21_incorporated_locations(markup_pieces):
    return markup.incorporated(_index(markup_pieces))
