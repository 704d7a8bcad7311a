"""Queries over the edits that bills order, and over tables of statute nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits, nodes as N
from .base import query


@query("""select b.law_id, b.title, b.section, b.chapter, b.heading, case when b.chapter = cast(b.title % 10 as varchar) and e.section is null then 'high' else 'medium' end as confidence, n_chars
from (select law_id, cast(regexp_extract(text, 'Chapter \\d+ of title (\\d+)', 1) as int) as title, regexp_extract(text, '"§ (\\d+)\\. ', 1) as section, regexp_extract(text, 'Chapter (\\d+) of', 1) as chapter,
             regexp_extract(text, '"§ \\d+\\. ([^\\n]*)\\n', 1) as heading, length(regexp_extract(text, '(?s)(§ \\d+\\. .*?)\\nSEC\\. 3', 1)) as n_chars from {bills}) b
left join (select distinct title, section from {sections}) e using (title, section)""")
def ex7_new_sections(bills, sections):
    chapters = sections.select("title", (F.col("title") % 10).cast("string").alias("chapter"))
    out = edits.new_sections(bills, "law_id", "text", chapters, sections)
    return out.select("law_id", "title", "section", "chapter", "heading", "confidence", "n_chars")


_TARGET = r"'Section (\d+)((?:\(b\))?) of title (\d+), United States Code, ((?:subsection \(c\))?)[^.;]*, is (?:hereby )?(amended|repealed)'"


@query(f"select law_id, cast(regexp_extract(text, {_TARGET}, 3) as int) as title, regexp_extract(text, {_TARGET}, 1) as section, regexp_extract(text, {_TARGET}, 5) as verb, regexp_extract(text, {_TARGET}, 2) <> '' or regexp_extract(text, {_TARGET}, 4) <> '' as subdivision from {{bills}}")
def ex8_targets(bills):
    return edits.targets(bills, "law_id", "text").select("law_id", "title", "section", "verb", "subdivision")


_ORDERED = """(select law_id, text, regexp_extract(text, 'EDITS\\. Section (\\d+)', 1) as section, regexp_extract(text, 'EDITS\\. Section \\d+(\\(b\\))?', 1) <> '' or contains(text, 'Code, subsection (c)') as part,
 cast(regexp_extract(text, 'EDITS\\. Section [^ ]+ of title (\\d+)', 1) as int) as title, regexp_extract(text, '(?s)SEC\\. 3\\. EDITS\\. (.*)\\nSEC\\. 4', 1) as said from {bills})"""


@query(f"""select o.law_id, o.title, o.section, case when e.section is not null and regexp_extract(said, 'follows: "§ (\\d+)\\.', 1) = o.section then 'high' else 'medium' end as confidence,
 sha256(regexp_extract(said, '(?s)follows: "(.*)$', 1)) as block from {_ORDERED} o left join (select distinct title, section from {{sections}}) e using (title, section) where contains(said, 'to read as follows') and not part""")
def ex10_restatements(bills, sections):
    out = edits.operations(bills, "law_id", "text", sections, ["REPLACE_SECTION"])
    return out.select("law_id", "title", "section", "confidence", F.sha2("block", 256).alias("block"))


@query(f"""select law_id, title, section, left(sha256(regexp_extract(said, '(?s)the following: "(.*)$', 1)), 16) as hash16 from {_ORDERED} where contains(said, 'by adding at the end')""")
def ex11_appended(bills, sections):
    out = edits.operations(bills, "law_id", "text", sections, ["APPEND_TEXT"])
    return out.select("law_id", "title", "section", F.left(F.sha2("block", 256), F.lit(16)).alias("hash16"))


@query(f"""select o.law_id, case when part then 'REPEAL_PART' else 'REPEAL_SECTION' end as kind, o.title, o.section, case when e.section is not null and not part then 'high' else 'medium' end as confidence
 from {_ORDERED} o left join (select distinct title, section from {{sections}}) e using (title, section) where contains(said, 'hereby repealed')""")
def ex8_repeals(bills, sections):
    return edits.operations(bills, "law_id", "text", sections, ["REPEAL_SECTION", "REPEAL_PART"]).select("law_id", "kind", "title", "section", "confidence")


@query("""select law_id, target, concat_ws(',', case when regexp_matches(near, 'amend') then 'amend' end, case when regexp_matches(near, 'delay|postpone|suspend') then 'delay' end, case when regexp_matches(near, 'extend|reauthoriz') then 'extend' end,
 case when contains(near, 'repeal') then 'repeal' end, case when regexp_matches(near, 'reviv|reinstat|restor') then 'revive' end, case when contains(near, 'supersed') then 'supersede' end) as verbs,
 trim(regexp_replace(substr(text, pos - 90, 180), '\\s+', ' ', 'g')) as context
from (select law_id, text, instr(text, 'Public Law ') as pos, lower(substr(text, instr(text, 'Public Law ') - 200, 400)) as near,
 'PL-' || lpad(regexp_extract(text, 'Public Law (\\d+)-(\\d+)', 1), 3, '0') || '-' || lpad(regexp_extract(text, 'Public Law (\\d+)-(\\d+)', 2), 3, '0') as target from {bills}) where law_id <> target""")
def ex15_chronology(bills):
    return edits.chronology(bills, "law_id", "text")


@query("""select 'c' || c_custkey as id, r_name || ' > ' || n_name || ' > ' || c_name as path, true as complete from {customer} join {nation} on n_nationkey = c_nationkey join {region} on r_regionkey = n_regionkey
union all select 'n' || n_nationkey, r_name || ' > ' || n_name, true from {nation} join {region} on r_regionkey = n_regionkey union all select 'r' || r_regionkey, r_name, true from {region}""")
def wn14_breadcrumbs(region, nation, customer):
    tree = (
        region.selectExpr("concat('r', r_regionkey) as id", "cast(null as string) as parent", "r_name as label")
        .unionByName(nation.selectExpr("concat('n', n_nationkey) as id", "concat('r', n_regionkey) as parent", "n_name as label"))
        .unionByName(customer.selectExpr("concat('c', c_custkey) as id", "concat('n', c_nationkey) as parent", "c_name as label"))
    )
    return N.breadcrumbs(tree, 4)


@query("""with f as (select law_key, pos, ref, coalesce(nullif(ref, ''), cast(pos as varchar)) as k from {provisions} where side = 'final'),
r as (select * from {provisions} where side = 'review'),
i as (select * from r union all select * from {provisions} where side = 'source' and law_key not in (select law_key from r) and law_key in (select law_key from f))
select i.law_key, i.pos, i.side, coalesce(a.pos, b.pos) as final_pos, case when a.pos is not null then 'ref' when b.pos is not null then 'position' else 'none' end as how, i.note as review_note
from i left join (select law_key, k, max(pos) as pos from f group by all) a on a.law_key = i.law_key and a.k = coalesce(nullif(i.ref, ''), cast(i.pos as varchar)) left join f b on b.law_key = i.law_key and b.pos = i.pos""")
def jn16_merge_provisions(provisions):
    side = lambda name: provisions.where(F.col("side") == name).drop("side")
    return N.merged_provisions(side("final"), side("review"), side("source"), "law_key", ["note"])


@query("""select file, node_id, law_id, text <> '' and part % 3 <> 0 and part % 4 <> 0 as proved from {nodes}""")
def jn19_baseline_proofs(nodes):
    proofs = nodes.selectExpr(
        "law_id", "file", "case when part % 4 = 0 then concat(node_id, '-lost') else node_id end as node_id", "node_id as asked", "identifier", "if(part % 3 = 0, 'b2', 'b1') as baseline_commit", "text as existing_text", "'same' as comparison"
    )
    return N.baseline_proofs(proofs, nodes, "b1").select("file", F.col("asked").alias("node_id"), "law_id", "proved")


_OUTCOMES = """(select file, node_id, law_id, case when part % 5 = 0 then 'keep' when part % 17 = 1 then 'conflict' when node_id like '%-codification' then 'rewrite' else 'remove' end as outcome from {nodes} where law_id < 'PL-040'
 union all select min(file), 'rp-' || lower(replace(law_id, '-', '')) || '-codification', law_id, 'add' from {nodes} where law_id < 'PL-040' group by law_id having not bool_or(node_id like '%-codification'))"""


def _reconciled(nodes):
    laws = nodes.where("law_id < 'PL-040'").selectExpr("law_id", "concat('rp-', lower(replace(law_id, '-', '')), '-codification') as note_id").distinct()
    decisions = nodes.where("part % 5 = 0 or part % 17 = 1").selectExpr("file", "node_id", "if(part % 5 = 0, 'keep', 'conflict') as decision")
    return N.reconciled(nodes, decisions, laws)


@query(f"select * from {_OUTCOMES}")
def pl17_reconcile_nodes(nodes):
    return _reconciled(nodes)


@query(f"""select law_id, count(*) filter (where outcome = 'remove') as removed, 0::bigint as restored, count(*) filter (where outcome in ('rewrite', 'add')) as notes, count(*) filter (where outcome = 'keep') as retained,
 case when bool_or(outcome = 'conflict') then 'manual-review-required' when bool_or(outcome = 'keep') then 'repealed-with-later-active-replacement' else 'repealed-history-only' end as disposition from {_OUTCOMES} group by law_id""")
def pl17_repeal_verdicts(nodes):
    return N.verdicts(_reconciled(nodes))


def _notes(nodes):
    rows = nodes.groupBy("node_id", "law_id").agg(F.max("file").alias("file"), F.min("identifier").alias("identifier")).selectExpr("node_id as note_id", "law_id", "file", "if(length(identifier) % 2 = 0, concat(identifier, '/a/1'), identifier) as identifier")
    existing = nodes.where("part % 2 = 0").selectExpr("node_id as note_id", "file")
    sections = nodes.where("part % 3 = 0").selectExpr("file", "identifier", "if(part % 9 = 0, law_id, null) as law_id", "part as ord")
    return rows, existing, sections


_NOTES = """r as (select node_id as note_id, law_id, max(file) as file, case when length(min(identifier)) % 2 = 0 then min(identifier) || '/a/1' else min(identifier) end as identifier, min(identifier) as parent from {nodes} group by node_id, law_id),
x as (select distinct node_id as note_id, file from {nodes} where part % 2 = 0)"""


@query(f"""with {_NOTES}, s as (select file, identifier, case when part % 9 = 0 then law_id end as law_id, part as ord from {{nodes}} where part % 3 = 0),
l as (select file, law_id, min((ord, identifier)) as b from s where law_id is not null group by all), f as (select file, min((ord, identifier)) as b from s group by file)
select note_id, r.file, case when x.note_id is not null or e.identifier is not null then r.identifier when l.b is not null then l.b[2] when p.identifier is not null then r.parent else f.b[2] end as identifier,
 case when x.note_id is not null then 'replaced' when e.identifier is not null then 'exact' when l.b is not null then 'law' when p.identifier is not null then 'parent' when f.b is not null then 'first' else 'unplaced' end as how
from r left join x using (note_id, file) left join (select distinct file, identifier from s) e on e.file = r.file and e.identifier = r.identifier left join (select distinct file, identifier from s) p on p.file = r.file and p.identifier = r.parent
left join l on l.file = r.file and l.law_id = r.law_id left join f on f.file = r.file""")
def pl19_place_notes(nodes):
    return N.placed_notes(*_notes(nodes))


@query(f"with {_NOTES} select x.note_id, x.file from x join r using (note_id) where x.file <> r.file")
def pl19_stale_notes(nodes):
    rows, existing, _ = _notes(nodes)
    return N.stale_notes(rows, existing)


@query("""with n as (select file || '#' || node_id as id, * from {nodes}), own as (select * from n where part % 2 = 0)
select id as node_id, 'empty-note' as rule from own where tag = 'note' and text = '' union all select id, 'empty-node' from own where tag in ('content', 'p') and text = '' union all select id, 'placeholder' from own where contains(text, 'todo')
union all select id, 'missing-number' from own where tag = 'subsection' and num = '' union all select id, 'wrong-namespace' from own where part % 13 = 0 union all select id, 'missing-credit' from own where num = '' and part % 8 <> 0
union all select id, 'broken-reference' from own where part % 3 = 0
union all select min(id), 'repeated-citation' from own where part % 3 <> 0 group by file, identifier having count(*) > 1""")
def pl25_content_audit(nodes):
    named = nodes.withColumns({
        "node_id": F.concat_ws("#", "file", "node_id"), "section": F.col("identifier"), "namespace": F.expr("if(part % 13 = 0, 'other', 'uslm')"), "credited": F.col("num") != "", "reserved": F.expr("part % 8 = 0"), "own": F.expr("part % 2 = 0"),
    })
    refs = named.selectExpr("node_id", "file", "section", "if(part % 3 = 0, concat(section, '-x'), section) as href", "if(part % 3 = 0, '', 'cited') as marker")
    return N.content_audit(named, refs, "uslm")


@query("""with p as (select distinct law_id, case when p_partkey % 6 = 0 then 'final' else 'draft' end as status, case when p_partkey % 7 = 0 then '' else 'Said' end as summary, case when p_partkey % 10 = 0 then null when p_partkey % 11 = 0 then 'other' else 'replace_element_xml' end as op, p_partkey as k from (select 'PL-' || p_size as law_id, p_partkey from {part})),
l as (select distinct 'PL-' || p_size as law_id, p_size % 5 = 0 as survives from {part} union all select 'PL-lost', false),
d as (select p.*, k % 4 <> 0 as fragment, k % 9 <> 0 as parses from p join l using (law_id) where not survives)
select distinct * from (select law_id, 'not a draft' as error from d where status <> 'draft' union all select law_id, 'blank' from d where summary = '' or op is null union all select law_id, 'unsupported operation' from d where op = 'other'
union all select law_id, 'missing fragment' from d where op is not null and not fragment union all select law_id, 'invalid fragment' from d where op is not null and fragment and not parses
union all select law_id, 'missing title' from d where op is not null and fragment and parses and k % 13 = 0 union all select law_id, 'missing draft' from l where law_id = 'PL-lost'
union all select law_id, 'repeated id' from (select law_id, count(*) over (partition by k // 2) as n from d where op is not null and fragment and parses) where n > 1)""")
def pl31_candidate_gate(part):
    of = part.selectExpr("concat('PL-', p_size) as law_id", "p_size", "p_partkey as k")
    laws = of.selectExpr("law_id", "concat('Act ', law_id, '.') as title", "if(p_size % 5 = 0, 'survival_audit_only', 'drafted') as method").unionByName(of.limit(1).selectExpr("'PL-lost' as law_id", "'Act' as title", "cast(null as string) as method")).distinct()
    plans = of.selectExpr("law_id", "if(k % 6 = 0, 'final', 'draft') as status", "if(k % 7 = 0, '', 'Said') as summary", "case when k % 10 = 0 then null when k % 11 = 0 then 'other' else 'replace_element_xml' end as op", "k as fragment")
    fragments = of.where("k % 4 <> 0").selectExpr("k as fragment", "k % 9 <> 0 as parses", "if(k % 13 = 0, 'Other', concat('The Act ', law_id, '. Text')) as text", "array(concat('rp-', k div 2), 'x') as ids")
    return N.candidate_gate(laws, plans, fragments)


@query("""select distinct law_id, title, section, case form when 9 then 'old item' else 'one' end as old_text, case form when 9 then 'new item' else 'two' end as new_text, case when e.s is not null then 'high' else 'medium' end as confidence
 from {acts} a left join (select distinct title as t, section as s from {sections}) e on e.t = a.title and e.s = a.section where form in (9, 10)""")
def ex9_ordered_edits(acts, sections):
    out = edits.operations(acts, "law_id", "text", sections, ["STRIKE_INSERT"])
    return out.select("law_id", "title", "section", "old_text", "new_text", "confidence")
