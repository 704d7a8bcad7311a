"""Cards, statute sections, actions, results and reviews: windows, joins, aggregates, patches and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cards as C, classify
from ..operators import checks, extract, ledger, match, patch, publish, rules
from .base import query
from .text_queries import _LAW_ID


_STATUS = (
    "case " + " ".join(f"when contains(lower(list_name || ' | ' || label), '{t}') then '{s}'" for t, s in rules.NEGATIVE_STATUS)
    + " " + " ".join(rf"when regexp_matches(lower(description), '(^|[^a-z0-9_])status\s*[:=-]\s*{t}($|[^a-z0-9_])') then '{s}'" for t, s in rules.NEGATIVE_STATUS) + " else 'active' end"
)
_RANK = "case status " + " ".join(f"when '{s}' then {r}" for s, r in rules.STATUS_RANK) + " else 5 end"
_IDENTIFIED = f"select *, {_LAW_ID} as law_id, {_STATUS} as status from {{cards}}"
_N_ATTACHMENTS = "select card_id, count(distinct url) as n_attachments from {attachments} group by card_id"
_CANONICAL = f"""select law_id, card_id, status, n_attachments, duplicates, last_activity from (select *, row_number() over (partition by law_id order by {_RANK} desc, n_attachments desc, length(description) desc, last_activity desc, card_id) as r,
 count(*) over (partition by law_id) - 1 as duplicates from (select i.*, coalesce(n_attachments, 0) as n_attachments from ({_IDENTIFIED}) i left join ({_N_ATTACHMENTS}) a on i.card_id = a.card_id) where law_id is not null) where r = 1"""


def _identified(cards):
    return C.identified(cards)


def _canonical(cards, attachments):
    n = C.first_url_wins(attachments).groupBy("card_id").agg(F.count("*").alias("n_attachments"))
    return C.canonical(C.identified(cards).join(n, "card_id", "left").na.fill(0, ["n_attachments"]))


@query(f"select status, count(*) as n from ({_IDENTIFIED}) group by status")
def fl1_infer_status(cards):
    return _identified(cards).groupBy("status").agg(F.count("*").alias("n"))


@query(f"select count(*) as n from ({_IDENTIFIED}) where law_id is null and (contains(lower(name || chr(10) || description), 'public law') or contains(lower(description), 'be it enacted'))")
def fl2_suspected_unparsed(cards):
    return C.suspected_unparsed(_identified(cards)).agg(F.count("*").alias("n"))


@query(_CANONICAL)
def wn1_canonical_cards(cards, attachments):
    return _canonical(cards, attachments).select("law_id", "card_id", "status", "n_attachments", "duplicates", "last_activity")


@query(f"select status, count(*) as n, cast(sum(duplicates) as bigint) as duplicates from ({_CANONICAL}) group by status")
def ag1_disposition_counts(cards, attachments):
    return _canonical(cards, attachments).groupBy("status").agg(F.count("*").alias("n"), F.sum("duplicates").alias("duplicates"))


@query("select card_id, n, url, string_split(url, '/')[-1] as name from (select card_id, generate_subscripts(u, 1)::int as n, rtrim(unnest(u), '.,;') as url from (select card_id, regexp_extract_all(description, '(?i)https?://[^\\s<>\\]\\[)(\"'']+') as u from {cards}))")
def src3_description_links(cards):
    return C.description_links(cards)


@query("select card_id, url, ordinal from (select *, row_number() over (partition by card_id, url order by ordinal, name, added, source, part_no) as r from {attachments} where url <> '') where r = 1")
def src4_first_url_wins(attachments):
    return C.first_url_wins(attachments).select("card_id", "url", "ordinal")


@query("select doc_id, case when starts_with(text, 'version https://git-lfs') then 'pointer' else 'text' end as kind from {documents}")
def src7_quarantine_pointers(documents):
    return documents.select("doc_id", F.when(F.col("text").startswith("version https://git-lfs"), "pointer").otherwise("text").alias("kind"))


_POINTS = " + ".join(f"case when contains(value, '{t}') then {p} else 0 end" for t, p in rules.ATTACHMENT_POINTS)
_SCORED = f"""select *, {_POINTS} + case when regexp_matches(lower(url), '{rules.TEXT_EXTENSIONS}') then 8 else 0 end - case when regexp_matches(lower(url), '{rules.MEDIA_EXTENSIONS}') then 30 else 0 end + case when source = 'board' then 2 else 0 end as points
 from (select *, lower(name || ' ' || url) as value from {{attachments}})"""


@query(f"select card_id, url, points, rank from (select *, (row_number() over (partition by card_id order by points desc, added desc, url, ordinal, name, part_no))::int as rank from ({_SCORED}))")
def wn3_rank_attachments(attachments):
    return C.ranked_attachments(attachments).select("card_id", "url", "points", "rank")


@query("select law_id, group_index, ord, status, treatment, others from (select *, row_number() over (partition by law_id order by (case when status = 'valid' then 1 else 0 end) desc, group_index desc, (case when treatment <> '' then 1 else 0 end) desc, ord desc) as r, count(*) over (partition by law_id) - 1 as others from {reviews}) where r = 1")
def wn5_controlling_report(reviews):
    prefer = [(F.col("status") == "valid").cast("int"), F.col("group_index"), (F.col("treatment") != "").cast("int")]
    return ledger.controlling(reviews, "law_id", prefer, [F.col("ord").desc()]).select("law_id", "group_index", "ord", "status", "treatment", "others")


@query("select law_id, group_index, ord, status, treatment from (select *, row_number() over (partition by law_id order by group_index desc, ord desc) as r from {reviews} where status = 'valid') where r = 1")
def wn6_latest_valid_review(reviews):
    return ledger.latest_valid(reviews)


@query("select law_id, arg_max(status, ord) as status, min(ord) as first_seen from {reviews} group by law_id")
def wn7_latest_primary(reviews):
    return reviews.groupBy("law_id").agg(F.max_by("status", "ord").alias("status"), F.min("ord").alias("first_seen"))


@query("select identifier, lag(identifier) over w as prev_key, lead(identifier) over w as next_key from {sections} window w as (partition by title order by cast(section as bigint))")
def wn8_neighbours(sections):
    return match.neighbours(sections.withColumn("ord", F.col("section").cast("long")), "title", "ord", "identifier").select("identifier", "prev_key", "next_key")


@query("select law_id, ord, number, 'ACTION-' || (case when length(cast(number as varchar)) < 4 then lpad(cast(number as varchar), 4, '0') else cast(number as varchar) end) as label from (select law_id, ord, row_number() over (order by law_id, ord) as number from {reviews})")
def wn9_action_numbering(reviews):
    return ledger.numbered(reviews, "law_id", ["ord"]).select("law_id", "ord", "number", "label")


@query("select law_id, ord, cast(floor((row_number() over w - 1) / 30) + 1 as bigint) as batch, (ntile(4) over w)::int as part from {reviews} window w as (partition by law_id order by ord)")
def wn10_batching(reviews):
    return ledger.batches(reviews, "law_id", ["ord"], 30, 4).select("law_id", "ord", "batch", "part")


_EVENTS = "select node_id, 'L' || substring(node_id, 4, 1) || cast(length(action_id) % 3 as varchar(5)) as law_id, cast(right(action_id, 4) as int) as idx, result_status = 'applied' as active from {results}"


@query(f"""select node_id, law_id, case when own_active = last_own then 'keep' when active_laws - own_is_active > 0 then 'conflict' else 'remove' end as decision from (select node_id, law_id, max(idx) as last_own, max(case when active then idx end) as own_active, max(active::int) as own_is_active from (select node_id, law_id, try_cast(idx as int) as idx, active from ({_EVENTS.replace("cast(right(action_id, 4) as int)", "cast(regexp_extract(action_id, '([0-9]+)$', 1) as int)")})) group by node_id, law_id)
 join (select node_id, count(distinct case when active then law_id end) as active_laws from ({_EVENTS.replace("cast(right(action_id, 4) as int)", "cast(regexp_extract(action_id, '([0-9]+)$', 1) as int)")}) group by node_id) using (node_id)""")
def wn11_node_ownership(results):
    law = F.concat(F.lit("L"), F.substring("node_id", 4, 1), (F.length("action_id") % 3).cast("string"))
    events = results.select("node_id", law.alias("law_id"), F.regexp_extract("action_id", "([0-9]+)$", 1).cast("int").alias("idx"), (F.col("result_status") == "applied").alias("active"))
    return ledger.node_ownership(events)


@query("select title, section from (select title, right(section, 2) as section, row_number() over (partition by title, right(section, 2) order by cast(section as bigint)) as r, count(*) over (partition by title, right(section, 2)) as n from {sections}) where r = 1 and n = 1")
def wn12_unique_routes(sections):
    w = Window.partitionBy("title", "key")
    keyed = sections.select("title", F.right("section", F.lit(2)).alias("key")).withColumn("n", F.count("*").over(w))
    return keyed.where("n = 1").select("title", F.col("key").alias("section"))


@query("select conv_id, turn, (row_number() over (partition by conv_id order by role <> 'user', turn))::int as place from {conversations}")
def wn13_own_first(conversations):
    w = Window.partitionBy("conv_id").orderBy(F.col("role") != "user", "turn")
    return conversations.select("conv_id", "turn", F.row_number().over(w).alias("place"))


_OPS = r"select distinct doc_key, cast(regexp_extract(text, 'title ([0-9]+)', 1) as int) as title, regexp_extract(text, 'Section ([0-9]+)', 1) as section from {enactments}"


@query(f"select doc_key, o.title, o.section, s.section is not null as section_exists from ({_OPS}) o left join {{sections}} s on o.title = s.title and o.section = s.section")
def jn1_section_exists(enactments, sections):
    return match.with_existence(extract.citations(enactments, "doc_key", "text"), sections).select("doc_key", "title", "section", "section_exists")


_EDGES = r"""select law_id as source, 'PL-' || lpad(c, 3, '0') || '-' || lpad(n, 3, '0') as target from (select law_id, regexp_extract(text, 'Public Law (\d+)-(\d+)', 1) as c, regexp_extract(text, 'Public Law (\d+)-(\d+)', 2) as n from {enactments}) where c <> '' group by all"""


@query(f"select target as law_id, min(source) as superseded_by from ({_EDGES}) where target < source and source in (select law_id from {{enactments}}) and target in (select law_id from {{enactments}}) and right(source, 1) <> '7' group by target")
def jn4_dependency_overrides(enactments):
    edges = extract.dependencies(enactments, "law_id", "text").select(F.col("law_id").alias("source"), "target", "relation")
    laws = enactments.select("law_id", (F.right("law_id", F.lit(1)) != "7").alias("active")).distinct()
    return match.overrides(edges, laws)


@query("select count(*) filter (where d.doc_id is not null and l.doc_id is not null) as in_both, count(*) filter (where l.doc_id is null) as only_left, count(*) filter (where d.doc_id is null) as only_right from {documents} d full join {labels} l on d.doc_id = l.doc_id")
def jn5_coverage(documents, labels):
    return match.coverage(documents, labels, "doc_id")


_PVR = """select state, count(*) as n, cast(sum(planned) as bigint) as planned, cast(sum(found) as bigint) as found from (select *, case when found = 0 then 'missing' when planned = 0 then 'extra' when planned > 1 or found > 1 then 'duplicate' else 'matched' end as state
 from (select coalesce(planned, 0) as planned, coalesce(found, 0) as found from (select action_id, count(*) as planned from {actions} group by 1) a full join (select action_id, count(*) as found from {results} group by 1) b using (action_id))) group by state"""


@query(_PVR)
def jn6_plan_vs_results(actions, results):
    return match.plan_vs_results(actions, results).groupBy("state").agg(F.count("*").alias("n"), F.sum("planned").alias("planned"), F.sum("found").alias("found"))


@query("""with known as (select min(action_id) as match, law_id, identifier, treatment from {actions} where ord <= 2 group by law_id, identifier, treatment), loose as (select min(action_id) as match, law_id, identifier from {actions} where ord <= 2 group by law_id, identifier)
 select reason, count(*) as n from (select case when k.match is not null then 'exact' when l.match is not null then 'loose' else 'unmatched' end as reason from {actions} a left join known k on a.law_id = k.law_id and a.identifier = k.identifier and a.treatment = k.treatment left join loose l on a.law_id = l.law_id and a.identifier = l.identifier where a.ord > 2) group by reason""")
def jn7_consolidate_provisions(actions):
    out = match.consolidate(actions.where("ord > 2"), actions.where("ord <= 2"), ["law_id", "identifier", "treatment"], ["law_id", "identifier"], "action_id")
    return out.groupBy("reason").agg(F.count("*").alias("n"))


@query("""select w.want_id, w.title, asked, case when s.section is not null then s.section end as section from (select identifier as want_id, title, section || '-' || cast(title as varchar) || '-x' as asked, section as base from {sections}) w left join {sections} s on s.title = w.title and s.section = w.base""")
def jn8_resolve_section(sections):
    wanted = sections.select(F.col("identifier").alias("want_id"), "title", F.concat("section", F.lit("-"), F.col("title").cast("string"), F.lit("-x")).alias("asked"))
    return match.resolve_section(wanted, sections)


_TARGETS = f"select law_id, regexp_extract(identifier, '/t([0-9]+)', 1) as title, case when ord % 3 = 0 then '' else regexp_extract(identifier, '/s([0-9]+)', 1) end as section from {{actions}}"


@query(f"with t as ({_TARGETS}) select distinct law_id, title, section from t where section <> '' or not exists (select 1 from t u where u.law_id = t.law_id and u.title = t.title and u.section <> '')")
def jn9_expand_titlewide(actions):
    targets = actions.select("law_id", F.regexp_extract("identifier", "/t([0-9]+)", 1).alias("title"), F.when(F.col("ord") % 3 == 0, "").otherwise(F.regexp_extract("identifier", "/s([0-9]+)", 1)).alias("section"))
    return match.expand_titlewide(targets)


@query("select href, count(*) as n from (select unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) as href from {pages}) where href not in (select '/' || role from {conversations}) group by href")
def jn10_broken_refs(pages, conversations):
    known = conversations.select(F.concat(F.lit("/"), "role").alias("href")).distinct()
    return extract.links(pages).join(known, "href", "left_anti").groupBy("href").agg(F.count("*").alias("n"))


@query("select change, count(*) as n from (select case when a.o_orderkey is null then 'added' when b.k is null then 'removed' when a.o_totalprice <> b.v then 'changed' else 'same' end as change from (select * from {orders} where o_orderkey % 7 <> 0) a full join (select o_orderkey as k, case when o_orderkey % 5 = 0 then o_totalprice + 1 else o_totalprice end as v from {orders} where o_orderkey % 11 <> 0) b on a.o_orderkey = b.k) group by change")
def jn12_baseline_diff(orders):
    old = orders.where("o_orderkey % 7 <> 0").select("o_orderkey", "o_totalprice")
    new = orders.where("o_orderkey % 11 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return match.baseline_diff(old, new, "o_orderkey", "o_totalprice").groupBy("change").agg(F.count("*").alias("n"))


@query("select identifier, count(distinct law_id) as n_laws, string_agg(distinct law_id, ',' order by law_id) as laws from {actions} group by identifier having count(distinct law_id) > 1")
def jn14_target_overlap(actions):
    return match.target_overlap(actions)


@query("""with c as (select item_id as claim_id, list_slice(list_distinct_ordered, 1, 20) as w from (select item_id, list_reduce(list_prepend([]::varchar[], list_transform(words, lambda x: [x])), lambda a, b: case when list_contains(a, b[1]) then a else a || b end) as list_distinct_ordered from (select item_id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 4) as words from {benchmark}))),
 d as (select distinct doc_id as container_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 4)) as word from {documents})
 select claim_id, container_id, count(*) as hits from (select claim_id, least(8, len(w)) as need, unnest(w) as word from c) join d using (word) group by claim_id, container_id, need having count(*) >= need""")
def jn17_claim_containment(benchmark, documents):
    claims = benchmark.select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"))
    return match.claim_containment(claims, documents.select(F.col("doc_id").alias("container_id"), F.col("text").alias("content")), 8)


@query("select count(*) as total, count(distinct text) as unique_texts, count(*) filter (where length(text) < 120) as unusable from {documents}")
def ag3_corpus_summary(documents):
    return documents.agg(F.count("*").alias("total"), F.countDistinct("text").alias("unique_texts"), F.count_if(F.length("text") < 120).alias("unusable"))


@query("select node_id, count(*) as n from {results} group by node_id having count(*) > 1")
def ag5_duplicate_ids(results):
    return checks.duplicated(results, "node_id")


@query("select law_id, count(*) as actions, count(distinct identifier) as targets, string_agg(distinct action_type, ',' order by action_type) as categories, cast(count(distinct action_type) as bigint) as n_categories from {actions} group by law_id")
def ag7_law_rollup(actions):
    return actions.groupBy("law_id").agg(F.count("*").alias("actions"), F.countDistinct("identifier").alias("targets"), F.array_join(F.array_sort(F.collect_set("action_type")), ",").alias("categories"), F.countDistinct("action_type").alias("n_categories"))


@query("select issue, count(*) as n from (select unnest([case when evidence = '' then 'missing source evidence' end, case when treatment = 'no_code_action' then 'no code' end, case when action_type = 'repeal' then 'repeal' end]) as issue from {actions}) where issue is not null group by issue")
def ag8_issue_counts(actions):
    issues = F.array_compact(F.array(F.when(F.col("evidence") == "", "missing source evidence"), F.when(F.col("treatment") == "no_code_action", "no code"), F.when(F.col("action_type") == "repeal", "repeal")))
    return actions.select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query("select count(*) as n, count(distinct (law_id, identifier, treatment)) as distinct_provisions, count(distinct law_id) as laws from {actions}")
def ag10_provision_counts(actions):
    return actions.agg(F.count("*").alias("n"), F.countDistinct("law_id", "identifier", "treatment").alias("distinct_provisions"), F.countDistinct("law_id").alias("laws"))


@query("select result_status, count(*) as n, count(*) filter (where left(node_id, 4) = 'rp-0') as executable from {results} group by result_status")
def ag11_result_status_counts(results):
    return results.groupBy("result_status").agg(F.count("*").alias("n"), F.count_if(F.left("node_id", F.lit(4)) == "rp-0").alias("executable"))


@query("select rule, count(*) as n, min(action_id) as first_key from (select action_id, unnest([case when evidence = '' then 'no evidence' end, case when contains(identifier, '/a/') then 'pinpointed' end, case when treatment = 'Note Only' then 'free-form treatment' end]) as rule from {actions}) where rule is not null group by rule")
def ag12_exception_report(actions):
    return ledger.exceptions(actions, "action_id", {"no evidence": F.col("evidence") == "", "pinpointed": F.col("identifier").contains("/a/"), "free-form treatment": F.col("treatment") == "Note Only"})


@query("select conv_id, case when n > 2 then array_to_string(l[:2], ' | ') || ' | ' || cast(n - 2 as varchar) || ' additional' else array_to_string(l, ' | ') end as said from (select conv_id, list_sort(list_distinct(list(role || turn))) as l, len(list_distinct(list(role || turn))) as n from {conversations} group by conv_id)")
def ag14_capped_summary(conversations):
    return conversations.groupBy("conv_id").agg(ledger.capped_summary(F.collect_list(F.concat("role", F.col("turn").cast("string"))), 2).alias("said"))


@query("select law_id, string_agg(distinct treatment, '|' order by treatment) as treatments, string_agg(distinct evidence, '|' order by evidence) as evidence from {actions} group by law_id")
def ag17_signature_sets(actions):
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|").alias(c)
    return actions.groupBy("law_id").agg(joined("treatment").alias("treatments"), joined("evidence").alias("evidence"))


@query("select law_id, count(*) as n, min(rank) as rank from (select law_id, dense_rank() over (order by cast(substring(law_id, 4, 3) as int), cast(substring(law_id, 8) as int)) as rank from {enactments}) group by law_id")
def so1_law_order(enactments):
    # One row a law before the total order.
    laws = enactments.groupBy("law_id").agg(F.count("*").alias("n"))
    numbered = ledger.numbered(laws.withColumn("congress", T.parse_law_id(F.col("law_id"))["congress"]).withColumn("law_no", T.parse_law_id(F.col("law_id"))["number"]), "congress", ["law_no"])
    return numbered.select("law_id", "n", F.col("number").alias("rank"))


@query("select doc_key, title, section from (select *, row_number() over (partition by doc_key order by title, cast(section as bigint)) as r from (" + _OPS + ")) where r <= 3")
def so4_top_targets(enactments):
    found = extract.citations(enactments, "doc_key", "text")
    w = Window.partitionBy("doc_key").orderBy("title", F.col("section").cast("long"))
    return found.withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


@query("select side, count(*) as n from (select 'left' as side from (select doc_id from {documents} except all select doc_id from {labels}) union all select 'right' from (select doc_id from {labels} except all select doc_id from {documents})) group by side")
def st3_set_equality(documents, labels):
    return checks.set_mismatch(documents.select("doc_id"), labels.select("doc_id")).groupBy("side").agg(F.count("*").alias("n"))


@query("select doc_id from {documents} except select doc_id from {labels}")
def st2_set_difference(documents, labels):
    return documents.select("doc_id").subtract(labels.select("doc_id"))


@query("""with m(t, action) as (values ('new_section', 'insert new section'), ('new_subsection', 'insert new subsection'), ('amend_existing_text', 'amend existing text'), ('repeal_marking', 'repeal or remove project-added text'), ('redesignation', 'redesignate'),
 ('transfer', 'transfer'), ('substitution', 'substitution'), ('statutory_note', 'add statutory note'), ('statutory_note_only', 'add statutory note'), ('note_only', 'add statutory note'), ('historical_note_only', 'add historical note'),
 ('historical_note', 'add historical note'), ('history_only', 'add historical note'), ('source_limited_historical_note', 'add historical note'), ('amendment_note', 'add amendment note'), ('effective_date_note', 'add historical note'),
 ('savings_note', 'add historical note'), ('transfer_note', 'add statutory note'), ('exclude_from_code', 'no Code action'), ('already_incorporated', 'no Code action'))
 select provision_id, action, action in ('amend existing text', 'insert new section', 'insert new subsection', 'repeal or remove project-added text', 'redesignate', 'transfer', 'substitution') as executable from (
 select provision_id, coalesce(m.action, case when class = 'new-permanent-general' then case when starts_with(summary, 'Definitions') then 'insert new subsection' when starts_with(summary, 'The purpose') then 'add statutory note' else 'insert new section' end
  when class in ('short-title', 'findings-or-sense') then 'add statutory note' when class = 'effective-date' then 'add historical note' else 'no Code action' end) as action
 from {treated} left join m on m.t = regexp_replace(lower(trim(treatment)), '[ -]+', '_', 'g'))""")
def pl2_action_for_treatment(treated):
    action = patch.action_for(F.col("treatment"), F.array("class"), F.col("summary"))
    return treated.select("provision_id", action.alias("action")).withColumn("executable", patch.executable(F.col("action")))


_EDITS = r"""select 's' || s.identifier as k, s.identifier, s.body, e.old_text, e.new_text, e.doc_key * 100 + e.seq as ord from {sections} s join (select doc_key, seq, regexp_extract(text, 'Section ([0-9]+)', 1) as section, regexp_extract(text, 'striking "(.*?)" and', 1) as old_text, regexp_extract(text, 'inserting "(.*?)"', 1) as new_text from {enactments} where contains(text, 'striking')) e on s.section = e.section"""


@query(f"""select identifier, case when n = 1 then replace(body, old_text, new_text) else body end as body, (case when n = 1 then 1 else 0 end)::int as applied, (case when edits > 0 and n <> 1 then 1 else 0 end)::int as refused from (select s.identifier, s.body, e.old_text, e.new_text, coalesce(e.edits, 0) as edits, case when e.old_text is null then 0 else cast((length(s.body) - length(replace(s.body, e.old_text, ''))) / length(e.old_text) as int) end as n
 from {{sections}} s left join (select identifier, old_text, new_text, 1 as edits from ({_EDITS}) qualify row_number() over (partition by identifier order by ord, old_text, new_text) = 1) e on s.identifier = e.identifier)""")
def pl10_strike_insert(sections, enactments):
    pair = lambda p: F.regexp_extract("text", p, 1)
    edits = enactments.where(F.col("text").contains("striking")).select(pair("Section ([0-9]+)").alias("section"), pair('striking "(.*?)" and').alias("old_text"), pair('inserting "(.*?)"').alias("new_text"), (F.col("doc_key") * 100 + F.col("seq")).alias("ord"))
    aimed = edits.join(sections.select("section", "identifier"), "section")
    w = Window.partitionBy("identifier").orderBy("ord", "old_text", "new_text")
    first = aimed.withColumn("r", F.row_number().over(w)).where("r = 1").select("identifier", F.col("ord").cast("long").alias("ord"), "old_text", "new_text")
    return patch.strike_insert(sections, first)


@query("""select identifier, body || coalesce(string_agg(chr(10) || '[' || marker || '] ' || note, '' order by ord), '') as body from (select s.identifier, s.body, n.* exclude (identifier) from {sections} s left join (select distinct '/us/usc/t' || p_size || '/s' || p_partkey as identifier, 'L' || (p_partkey % 3) as marker, p_brand as note, cast(1 as bigint) as ord from {part} where p_partkey % 2 = 0) n using (identifier)) group by identifier, body""")
def pl11_append_notes(sections, part):
    even = part.where("p_partkey % 2 = 0")
    ident = F.concat(F.lit("/us/usc/t"), F.col("p_size").cast("string"), F.lit("/s"), F.col("p_partkey").cast("string"))
    notes = even.select(ident.alias("identifier"), F.lit(1).cast("long").alias("ord"), F.concat(F.lit("L"), (F.col("p_partkey") % 3).cast("string")).alias("marker"), F.col("p_brand").alias("note"))
    once = patch.append_notes(sections, notes)
    return patch.append_notes(once, notes)  # the second time changes nothing


@query("select identifier, case when cast(section as bigint) % 9 = 0 then 'Repealed' else heading end as heading, case when cast(section as bigint) % 9 = 0 then '' else body end as body, reserved or cast(section as bigint) % 9 = 0 as reserved from {sections}")
def pl12_repeal_section(sections):
    return patch.repeal(sections, sections.where(F.col("section").cast("long") % 9 == 0)).select("identifier", "heading", "body", "reserved")


@query("select identifier, case when cast(section as bigint) % 8 = 0 then 'As restated: ' || heading else body end as body from {sections}")
def pl13_restate_section(sections):
    new = sections.where(F.col("section").cast("long") % 8 == 0).select("identifier", F.lit(1).alias("ord"), F.concat(F.lit("As restated: "), "heading").alias("new_body"))
    return patch.restate(sections, new).select("identifier", "body")


@query("select count(*) + (select count(*) from (select distinct identifier || '/new' as i from {sections} where reserved)) as n from {sections}")
def pl14_insert_section(sections):
    new = sections.where("reserved").withColumn("identifier", F.concat("identifier", F.lit("/new"))).unionByName(sections.where("reserved"))
    return patch.insert(sections, new).agg(F.count("*").alias("n"))


_MANIFEST = """with recursive o as (select *, row_number() over (partition by identifier order by law_order, op_no, op_id) as k from {operations}),
 st as (select coalesce(s.identifier, t.identifier) as identifier, 0 as k, s.identifier is not null as there, coalesce(s.heading, '') as heading, coalesce(s.body, '') as body, '' as notes, '' as op_id, '' as law_id, '' as kind, '' as status
   from {sections} s full join (select distinct identifier from o) t on s.identifier = t.identifier
  union all select identifier, k, there or (kind = 'ADD_NEW_SECTION' and status = 'executed'),
   case when status <> 'executed' then heading when kind = 'REPEAL_SECTION' then 'Repealed' when kind in ('REPLACE_SECTION', 'ADD_NEW_SECTION') then left(new_text, 20) else heading end,
   case when status <> 'executed' then body when kind = 'STRIKE_INSERT' then replace(body, old_text, new_text) when kind = 'REPEAL_SECTION' then '' when kind in ('REPLACE_SECTION', 'ADD_NEW_SECTION') then new_text else body end,
   notes || case when status = 'executed' and kind = 'REPEAL_SECTION' then '[repeal] Repealed by ' || law_id || chr(10)
     when status = 'fallback-note:executed' or (status = 'executed' and kind in ('APPEND_TEXT', 'STATUTORY_NOTE')) then '[' || marker || '] ' || new_text || chr(10) else '' end,
   op_id, law_id, kind, status
  from (select st.identifier, o.k, st.there, st.heading, st.body, st.notes, o.op_id, o.law_id, o.kind, o.old_text, o.new_text, o.marker,
   case when o.title is null then 'skipped-no-title' when o.kind in ('STRIKE_INSERT', 'REPEAL_SECTION', 'REPLACE_SECTION', 'ADD_NEW_SECTION') and o.confidence <> 'high' then 'withheld-preserved-by-note'
    when o.kind = 'ADD_NEW_SECTION' then case when st.there then 'already-present' else 'executed' end when o.kind = 'MOVE' then 'unsupported' when not st.there then 'target-not-found'
    when o.kind = 'STRIKE_INSERT' then case when (length(st.body) - length(replace(st.body, o.old_text, ''))) = length(o.old_text) then 'executed' when contains(st.notes, '[' || o.marker || ']') then 'fallback-note:already-present' else 'fallback-note:executed' end
    when o.kind = 'REPEAL_SECTION' then case when st.heading = 'Repealed' then 'already-present' else 'executed' end
    when o.kind in ('APPEND_TEXT', 'STATUTORY_NOTE') and contains(st.notes, '[' || o.marker || ']') then 'already-present' else 'executed' end as status
   from st join o on o.identifier = st.identifier and o.k = st.k + 1))"""


def _noteless(sections):
    return sections.select("identifier", "heading", "body", F.lit("").alias("notes"))


@query(f"{_MANIFEST} select identifier, heading, body, notes from st where there qualify row_number() over (partition by identifier order by k desc) = 1")
def pl16_sections_after_manifest(sections, operations):
    return patch.apply_manifest(_noteless(sections), operations)[0]


@query(f"{_MANIFEST} select op_id, law_id, identifier, kind, status from st where k > 0")
def pl16_operation_statuses(sections, operations):
    return patch.apply_manifest(_noteless(sections), operations)[1]


@query(f"{_MANIFEST} select law_id, bool_or(done) as applied, count(*) as n_operations, count(*) filter (where done) as n_done, coalesce(string_agg(distinct identifier, ',' order by identifier) filter (where done), '') as changed from (select *, status = 'executed' or status = 'fallback-note:executed' as done from st where k > 0) group by law_id")
def pl16_manifest_by_law(sections, operations):
    told = patch.apply_manifest(_noteless(sections), operations)[1].withColumn("done", F.col("status").isin("executed", "fallback-note:executed"))
    changed = F.array_join(F.array_sort(F.collect_set(F.when(F.col("done"), F.col("identifier")))), ",")
    return told.groupBy("law_id").agg(F.bool_or("done").alias("applied"), F.count("*").alias("n_operations"), F.count_if("done").alias("n_done"), changed.alias("changed"))


_SCORED = {name: " + ".join(f"least(20, cast((length(t) - length(replace(t, '{p}', ''))) / {len(p)} as int) * {w})" for p, w in phrases) for name, phrases in (("permanent", rules.PERMANENT), ("temporary", rules.TEMPORARY))}
_RIDER = " + ".join(f"cast(contains(t, '{p}') as int)" for p in rules.RIDER)


# The oracle knows by `form` what each act orders.
@query(f"""select law_id, d as disposition, case when d = 'NONOPERATIVE_OR_REPEALED' and status <> 'repealed' then 'medium' when d = 'NON_CODE' and (form in (4, 6) or coin and form in (2, 5)) then 'medium' when d = 'STATUTORY_NOTE' and permanent < temporary then 'medium' else 'high' end as confidence,
 case when form in (0, 1, 7, 9, 10) then 1 else 0 end as n_direct, case when form in (0, 7, 9, 10) and there then 1 else 0 end as n_safe, case when form in (0, 7, 9, 10) and not there then 1 else 0 end as n_unresolved from (
 select *, case when incorporated then 'ALREADY_INCORPORATED' when status <> 'active' then 'NONOPERATIVE_OR_REPEALED' when text = '' then 'SOURCE_UNAVAILABLE' when form in (3, 4, 5) or coin and form in (2, 6) then 'NON_CODE' when form = 8 and not (rider >= 2) then 'NON_CODE'
  when form in (0, 7, 9, 10) and there and variant <> 1 then 'DIRECT_CODE_AMENDMENT' when form in (0, 1, 7, 9, 10) then 'HYBRID_DIRECT_AMENDMENT_AND_STATUTORY_NOTE' when temporary >= greatest(8, permanent + 5) then 'NON_CODE' else 'STATUTORY_NOTE' end as d
 from (select a.*, a.name = 'A commemorative act' as coin, e.section is not null as there, {_SCORED['permanent']} as permanent, {_SCORED['temporary']} as temporary, {_RIDER} as rider from (select *, lower(text) as t from {{acts}}) a left join (select distinct title, section from {{sections}}) e using (title, section)))""")
def pl1_classify_laws(acts, sections):
    chapters = sections.select("title", (F.col("section").cast("long") % 10).cast("string").alias("chapter")).distinct()
    return classify.classify(acts.select("law_id", "name", "text", "status", "incorporated"), sections, chapters, "name")


@query("select doc_id, case when contains(lower(text), 'license') then 'license' when contains(lower(text), 'reserved') then 'reserved' end as token from {documents} where contains(lower(text), 'license') or contains(lower(text), 'reserved')")
def pl26_artifact_scan(documents):
    return checks.forbidden(documents, "doc_id", "text", ["license", "reserved"])


@query("select kind, confidence, case when kind <> 'APPEND_TEXT' and confidence <> 'high' then 'withheld-preserved-by-note' else 'planned' end as status, count(*) as n from (select case action_type when 'repeal' then 'REPEAL_SECTION' when 'amendment' then 'STRIKE_INSERT' else 'APPEND_TEXT' end as kind, case when evidence = '' then 'medium' else 'high' end as confidence from {actions}) group by all")
def pl15_withhold_unsafe(actions):
    kind = F.when(F.col("action_type") == "repeal", "REPEAL_SECTION").when(F.col("action_type") == "amendment", "STRIKE_INSERT").otherwise("APPEND_TEXT")
    rows = actions.select(kind.alias("kind"), F.when(F.col("evidence") == "", "medium").otherwise("high").alias("confidence"))
    return rows.groupBy("kind", "confidence", patch.withheld(F.col("kind"), F.col("confidence")).alias("status")).agg(F.count("*").alias("n"))


@query("select law_id, result_status as state, count(*) as n from {actions} a join (select distinct action_id, result_status from {results}) r using (action_id) group by all")
def ag18_progress_ledger(actions, results):
    return actions.join(results.select("action_id", "result_status").distinct(), "action_id").groupBy("law_id", F.col("result_status").alias("state")).agg(F.count("*").alias("n"))


@query("select law_id, register, n from (select law_id, case action_type when 'amendment' then 'direct' when 'repeal' then 'nonoperative' else 'non_code' end as register, count(*) as n from {actions} group by all)")
def snk7_split_registers(actions):
    return publish.registers(actions, {"direct": F.col("action_type") == "amendment", "nonoperative": F.col("action_type") == "repeal", "non_code": F.lit(True)}).groupBy("law_id", "register").agg(F.count("*").alias("n"))


@query("select title, section, '/cite/' || title || '/' || section || '/' as path, title || ' U.S.C. § ' || section || ' - ' || heading as page_title, case when length(body) <= 240 then body else rtrim(left(body, 239), ' .,;:') || '…' end as description from {sections}")
def snk9_citation_routes(sections):
    return publish.routes(sections)


@query("select law_id, string_agg(distinct action_type, ' | ' order by action_type) as types, count(*) as n_actions, count(distinct identifier) as n_targets from {actions} group by law_id")
def snk1_inventory_register(actions):
    return publish.inventory(actions)


@query("select law_id, ord, action_type, row_number() over (partition by law_id order by ord, action_id, identifier, action_type, treatment, evidence)::int as op_index, count(*) over (partition by law_id) as n_ops from {actions}")
def snk3_operation_register(actions):
    return publish.operation_register(actions).select("law_id", "ord", "action_type", "op_index", "n_ops")


@query("select law_id, text_found, count(*) as n from (select law_id, contains(lower(law_id || ' ' || action_type || ' ' || treatment), 'note') as text_found from {actions}) where text_found group by all")
def fl5_law_search(actions):
    hit = publish.search(actions, ["law_id", "action_type", "treatment"], "note")
    return hit.groupBy("law_id").agg(F.count("*").alias("n")).withColumn("text_found", F.lit(True))


@query("select identifier, heading from {sections} where title = 7 and lower(regexp_replace(section, '[^A-Za-z0-9]', '', 'g')) in (select cast(p_partkey as varchar) from {part} where p_size = 7)")
def fl7_citation_lookup(sections, part):
    wanted = part.where("p_size = 7").select(F.lit(7).alias("title"), F.col("p_partkey").cast("string").alias("section"))
    return publish.lookup(sections, wanted)


@query("select n_name from {nation} where contains(lower(n_name), '1')")
def fl10_title_filter(nation):
    return nation.where(F.lower("n_name").contains("1")).select("n_name")


@query("select law_id, ord, case when status = 'valid' and treatment <> '' then 'kept' else 'recompute' end as state from {reviews}")
def sm3_resume_sources(reviews):
    stored = reviews.where("status = 'valid' and treatment <> ''").select("ord").withColumn("_kept", F.lit(True))
    return reviews.join(stored, "ord", "left").select("law_id", "ord", F.when(F.col("_kept"), "kept").otherwise("recompute").alias("state"))


@query("select law_id, max(ord) as ord, arg_max(status, ord) as status from {reviews} group by law_id")
def sm4_run_state(reviews):
    old, new = reviews.where("ord < 5000").select("law_id", "ord", "status"), reviews.where("ord >= 5000").select("law_id", "ord", "status")
    return ledger.merged_runs(old.groupBy("law_id").agg(F.max_by("status", "ord").alias("status"), F.max("ord").alias("ord")).select("law_id", "ord", "status"), new, "law_id", "ord")


_STAND = "case when right(law_id, 1) = '3' then 'ALREADY_INCORPORATED' when right(law_id, 1) = '7' then 'NONOPERATIVE_OR_REPEALED' else 'STATUTORY_NOTE' end"


@query(f"""with laws as (select distinct law_id, {_STAND} as d from {{citings}}), edges as (select distinct law_id as source, named as target, case when form in (0, 4, 7) then 'repeals' else 'supersedes' end as relation from {{citings}} where form in (0, 2, 4, 7, 8) and law_id <> named),
 strong as (select e.* from edges e where source in (select law_id from laws where d <> 'NONOPERATIVE_OR_REPEALED') and target in (select law_id from laws)),
 told as (select source as law_id, 'not earlier: ' || relation || ' ' || target as w from strong where source <= target union select target, 'incorporated, but ' || source || ' ' || relation || ' it' from strong where source > target and target in (select law_id from laws where d = 'ALREADY_INCORPORATED')),
 hit as (select target as law_id, min(source) as who from strong where source > target group by 1)
 select law_id, case when who is not null and d <> 'ALREADY_INCORPORATED' then 'SUPERSEDED_BEFORE_CODIFICATION' else d end as disposition, case when who is not null and d <> 'ALREADY_INCORPORATED' then 'high' else 'medium' end as confidence, case when d <> 'ALREADY_INCORPORATED' then who end as superseded_by,
 coalesce((select string_agg(w, '; ' order by w) from told t where t.law_id = laws.law_id), '') as warnings from laws left join hit using (law_id)""")
def pl1_superseded_laws(citings):
    stand = F.when(F.right("law_id", F.lit(1)) == "3", "ALREADY_INCORPORATED").when(F.right("law_id", F.lit(1)) == "7", "NONOPERATIVE_OR_REPEALED").otherwise("STATUTORY_NOTE")
    laws = citings.select("law_id", stand.alias("disposition"), F.lit("active").alias("status"), F.lit("medium").alias("confidence")).distinct()
    edges = extract.dependencies(citings, "law_id", "text").select(F.col("law_id").alias("source"), "target", "relation", "confidence").distinct()
    return classify.superseded(laws, edges).drop("status").withColumn("warnings", F.array_join("warnings", "; "))
