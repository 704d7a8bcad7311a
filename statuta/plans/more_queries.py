"""Further ledgers, registers, rollups and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks, extract, ledger, match, publish
from ..streaming import intake
from .base import query


@query("select user_id, start, n from (select user_id, time_bucket(interval 1 hour, ts) as start, count(*) as n from {events} group by all)")
def sm_windowed_counts(events):
    return intake.windowed_counts(events, "ts", "user_id")


@query("select card_id, url from (select card_id, url, row_number() over (partition by card_id order by case when ends_with(url, '.txt') then 0 when ends_with(url, '.pdf') then 2 else 4 end, url, ordinal) as r from {attachments}) where r = 1")
def src11_ranked_sources(attachments):
    rank = F.when(F.col("url").endswith(".txt"), 0).when(F.col("url").endswith(".docx"), 1).when(F.col("url").endswith(".pdf"), 2).when(F.col("url").endswith(".html"), 3).otherwise(4)
    w = Window.partitionBy("card_id").orderBy(rank, "url", "ordinal")
    return attachments.withColumn("r", F.row_number().over(w)).where("r = 1").select("card_id", "url")


@query("select law_id, count(*) as n, count(*) filter (where op = 0) as none from (select law_id, case when action_type = 'statutory_note' then 0 else 1 end as op from {actions}) group by law_id having count(*) > 1")
def snk4_location_register(actions):
    out = actions.groupBy("law_id").agg(F.count("*").alias("n"), F.count_if(F.col("action_type") == "statutory_note").alias("none"))
    return out.where("n > 1")


@query("""select law_id as source, named as target, string_agg(distinct relation, ',' order by relation) as relations, count(distinct relation) as n from (select law_id, named, case form when 0 then 'repeals' when 4 then 'repeals' when 7 then 'repeals' when 2 then 'supersedes' when 8 then 'supersedes' when 1 then 'amends' when 3 then 'overrides' else 'references' end as relation from {citings}) where law_id <> named group by all""")
def snk5_dependency_export(citings):
    edges = extract.dependencies(citings, "law_id", "text").groupBy(F.col("law_id").alias("source"), "target")
    return edges.agg(F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"), F.countDistinct("relation").alias("n"))


@query("select law_id, to_json(struct_pack(n := count(*), types := list_sort(list(distinct action_type)))) as said from {actions} group by law_id")
def snk6_nested_inventory(actions):
    return actions.groupBy("law_id").agg(F.to_json(F.struct(F.count("*").alias("n"), F.array_sort(F.collect_set("action_type")).alias("types"))).alias("said"))


@query("select title, key, min(section) as section from (select title, section, left(section, 2) as key, count(*) over (partition by title, left(section, 2)) as n from {sections}) where n = 1 group by title, key")
def snk10_preview_routes(sections):
    return publish.unambiguous(sections.select("title", "section", F.left("section", F.lit(2)).alias("key")), ["title", "key"]).select("title", "key", "section")


@query("select law_id, count(*) as n_actions, count(distinct identifier) as n_targets, count(*) filter (where evidence = '') as without_evidence, count(*) filter (where action_type = 'repeal') as repeals from {actions} group by law_id")
def snk11_public_law_view(actions):
    return publish.law_view(actions)


@query("select law_id, law_id || ': ' || count(*) || case when count(*) = 1 then ' action' else ' actions' end || ' on ' || count(distinct identifier) || case when count(distinct identifier) = 1 then ' target.' else ' targets.' end as said from {actions} group by law_id")
def snk13_render_documents(actions):
    return publish.summaries(actions)


@query("select count(*) as total, count(*) filter (where starts_with(name, 'Pub')) as named, count(distinct list_name) as lists, max(last_activity) as latest from {cards}")
def snk14_card_inventory(cards):
    return cards.agg(F.count("*").alias("total"), F.count_if(F.col("name").startswith("Pub")).alias("named"), F.countDistinct("list_name").alias("lists"), F.max("last_activity").alias("latest"))


@query("select conv_id, turn, case when trim(role) = '' then '' else trim(role) end || ' | ' || length(text) as said from {conversations}")
def fn15_canonical_text(conversations):
    return conversations.select("conv_id", "turn", F.concat_ws(" | ", F.trim("role"), F.length("text").cast("string")).alias("said"))


@query("select doc_id, length(regexp_replace(regexp_replace(text, '(?i)\"[^\"]{200,}\"', '', 'g'), '(?im)^.*license.*$', '', 'g')) as n from {documents}")
def fn30_clean_note(documents):
    cleaned = F.regexp_replace(F.regexp_replace("text", '(?i)"[^"]{200,}"', ""), "(?im)^.*license.*$", "")
    return documents.select("doc_id", F.length(cleaned).cast("long").alias("n"))


@query("select action_id, ord, regexp_extract(identifier, '/t([0-9]+)', 1) as title, case result_status when 'applied' then 'Applied' when 'documented-no-code-action' then 'No Code amendment required' else 'Superseded by a later action' end as status from {actions} join (select distinct action_id, result_status from {results}) using (action_id)")
def fn28_friendly_status(actions, results):
    joined = actions.join(results.select("action_id", "result_status").distinct(), "action_id")
    return joined.select("action_id", "ord", F.regexp_extract("identifier", "/t([0-9]+)", 1).alias("title"), publish.result_label(F.col("result_status")).alias("status"))


@query("select effect, count(*) as n from (select case when law_id like '%7' then 'repealed-history' when result_status = 'documented-no-code-action' then 'no-code' when result_status = 'superseded-by-later-action' then 'superseded' when contains(lower(treatment), 'note') or contains(action_type, 'note') then 'note' else 'code' end as effect from {actions} join (select distinct action_id, result_status from {results}) using (action_id)) group by effect")
def pl20_classify_effect(actions, results):
    joined = actions.join(results.select("action_id", "result_status").distinct(), "action_id")
    effect = publish.effect(F.col("law_id").endswith("7"), F.col("result_status"), F.col("action_type"), F.col("treatment"))
    return joined.select(effect.alias("effect")).groupBy("effect").agg(F.count("*").alias("n"))


@query("select count(*) filter (where active) as active_remaining, count(*) filter (where active and not held) as actionable, count(*) filter (where active and held) as source_holds, least(200, count(*) filter (where active)) as required, count(*) filter (where active and not held) >= least(200, count(*) filter (where active)) and count(*) filter (where active and held) <= 10 as passed from (select law_id, bool_or(status = 'valid') as active, bool_and(treatment = '') as held from {reviews} group by law_id)")
def pl22_completeness_gate(reviews):
    laws = reviews.groupBy("law_id").agg(F.bool_or(F.col("status") == "valid").alias("active"), F.bool_and(F.col("treatment") == "").alias("held"))
    return publish.completeness(laws, 200, 10)


@query("select law_id, case when invalid then 'schema-invalid' when no_treatment > 0 then 'incomplete' else 'valid' end as status from (select law_id, bool_or(status = 'schema-invalid') as invalid, count(*) filter (where treatment = '') as no_treatment from {reviews} group by law_id)")
def pl9_report_status(reviews):
    issues = F.array_compact(F.array(F.when(F.col("status") == "schema-invalid", "schema-invalid"), F.when(F.col("treatment") == "", "no treatment")))
    found = reviews.groupBy("law_id").agg(F.array_distinct(F.flatten(F.collect_list(issues))).alias("issues"))
    return found.select("law_id", publish.report_status(F.col("issues")).alias("status"))


@query("select law_id, bool_or(evidence = '') as missing_source, bool_or(action_type in ('amendment', 'repeal')) as has_action, count(distinct identifier) < count(*) as duplicate_target from {actions} group by law_id")
def pl4_risk_flags(actions):
    return actions.groupBy("law_id").agg(F.bool_or(F.col("evidence") == "").alias("missing_source"), F.bool_or(F.col("action_type").isin("amendment", "repeal")).alias("has_action"), (F.countDistinct("identifier") < F.count("*")).alias("duplicate_target"))


@query("select law_id, string_agg(distinct reason, ',' order by reason) as reasons from (select law_id, unnest([case when evidence = '' then 'missing source' end, case when treatment = 'no_code_action' then 'no code' end]) as reason from {actions}) where reason is not null group by law_id")
def pl5_review_queue(actions):
    reason = F.array_compact(F.array(F.when(F.col("evidence") == "", "missing source"), F.when(F.col("treatment") == "no_code_action", "no code")))
    return actions.select("law_id", F.explode(reason).alias("reason")).groupBy("law_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


@query("select a.law_id, coalesce(case when a.status <> '' and b.status <> '' and a.status <> b.status then 'status' end, '') as differs from (select law_id, arg_max(status, ord) as status from {reviews} where group_index < 20 group by 1) a join (select law_id, arg_max(status, ord) as status from {reviews} where group_index >= 20 group by 1) b using (law_id)")
def pl7_field_disagreements(reviews):
    last = lambda df: df.groupBy("law_id").agg(F.max_by("status", "ord").alias("status"))
    return publish.disagreements(last(reviews.where("group_index < 20")), last(reviews.where("group_index >= 20")), "law_id", ["status"])


@query("select action_id, result_status from (select action_id, case when result_status = 'superseded-by-later-action' then 'documented-no-code-action' else result_status end as result_status from {results}) group by all")
def pl18_finalize_nonexecutable(results):
    out = F.when(F.col("result_status") == "superseded-by-later-action", "documented-no-code-action").otherwise(F.col("result_status"))
    return results.select("action_id", out.alias("result_status")).distinct()


@query("select law_id, '[note:' || law_id || ':' || left(sha256(string_agg(distinct action_type, '|' order by action_type)), 12) || ']' as marker from {actions} group by law_id")
def pl30_outbox_rows(actions):
    said = F.array_join(F.array_sort(F.collect_set("action_type")), "|")
    return actions.groupBy("law_id").agg(said.alias("said")).select("law_id", F.concat(F.lit("[note:"), "law_id", F.lit(":"), F.left(F.sha2("said", 256), F.lit(12)), F.lit("]")).alias("marker"))


@query("select identifier, case when exists_ then 'ok' else 'missing' end as state from (select s.identifier, p.p_partkey is not null and p.p_partkey % 10 <> 0 as exists_ from {sections} s left join {part} p on s.section = cast(p.p_partkey as varchar))")
def jn11_manifest_vs_files(sections, part):
    files = part.where("p_partkey % 10 <> 0").select(F.col("p_partkey").cast("string").alias("section"), F.lit(True).alias("found"))
    return sections.join(files, "section", "left").select("identifier", F.when(F.col("found"), "ok").otherwise("missing").alias("state"))


@query("select law_id, coalesce(m, 0) as manifest, coalesce(r, 0) as report, case when m is null then 'extra' when r is null then 'missing' when m > 1 or r > 1 then 'duplicated' else 'ok' end as state from (select law_id, count(*) as m from {enactments} group by 1) full join (select law_id, count(*) as r from {actions} where action_type = 'repeal' group by 1) using (law_id)")
def jn13_law_set_compare(enactments, actions):
    a = enactments.groupBy("law_id").agg(F.count("*").alias("manifest"))
    b = actions.where("action_type = 'repeal'").groupBy("law_id").agg(F.count("*").alias("report"))
    state = F.when(F.col("manifest").isNull(), "extra").when(F.col("report").isNull(), "missing").when((F.col("manifest") > 1) | (F.col("report") > 1), "duplicated").otherwise("ok")
    return a.join(b, "law_id", "full_outer").withColumn("state", state).na.fill(0, ["manifest", "report"])


@query("select a.law_id, string_agg(distinct node_id, ',' order by node_id) as nodes, count(distinct identifier) as placements from (select distinct law_id, action_id, identifier from {actions}) a join (select distinct action_id, node_id from {results}) r using (action_id) group by a.law_id")
def jn15_implementation_details(actions, results):
    joined = actions.select("law_id", "action_id", "identifier").join(results.select("action_id", "node_id").distinct(), "action_id")
    return joined.groupBy("law_id").agg(F.array_join(F.array_sort(F.collect_set("node_id")), ",").alias("nodes"), F.countDistinct("identifier").alias("placements"))


@query("select law_id, ord, r.status is not null as validated from {reviews} v left join (select law_id, max(status) as status from {reviews} where status = 'valid' group by law_id) r using (law_id)")
def jn18_candidate_validation(reviews):
    valid = reviews.where("status = 'valid'").select("law_id").distinct().withColumn("v", F.lit(True))
    return reviews.join(valid, "law_id", "left").select("law_id", "ord", F.coalesce("v", F.lit(False)).alias("validated"))


@query("select count(*) as total, count(*) filter (where result_status = 'applied') as applied, count(distinct node_id) as nodes, count(*) filter (where node_id is null) as unplaced from {results}")
def ag2_publication_counts(results):
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("result_status") == "applied").alias("applied"), F.countDistinct("node_id").alias("nodes"), F.count_if(F.col("node_id").isNull()).alias("unplaced"))


@query("select law_id, cast(sum(case when treatment = 'note-only' then 3 when treatment = 'new-section' then 2 else 1 end) as bigint) as score from {reviews} group by law_id")
def ag13_amendment_score(reviews):
    return reviews.groupBy("law_id").agg(F.sum(F.when(F.col("treatment") == "note-only", 3).when(F.col("treatment") == "new-section", 2).otherwise(1)).alias("score"))


@query("select count(*) as notes, cast(sum(length(text) - length(regexp_replace(text, '\\s+', ' ', 'g'))) as bigint) as saved from {documents}")
def ag15_cleanup_savings(documents):
    return documents.agg(F.count("*").alias("notes"), F.sum((F.length("text") - F.length(F.regexp_replace("text", r"\s+", " "))).cast("long")).alias("saved"))


@query("select count(*) filter (where evidence = '') as without_evidence, count(*) filter (where evidence <> '' and treatment = 'no_code_action') as without_text, min(action_id) filter (where evidence = '') as first_key from {actions}")
def ag16_source_completeness(actions):
    return actions.agg(F.count_if(F.col("evidence") == "").alias("without_evidence"), F.count_if((F.col("evidence") != "") & (F.col("treatment") == "no_code_action")).alias("without_text"), F.min(F.when(F.col("evidence") == "", F.col("action_id"))).alias("first_key"))


@query("select doc_key, string_agg(distinct m, ',' order by m) as refs from (select doc_key, unnest(regexp_extract_all(text, 'Public Law \\d+-\\d+') || regexp_extract_all(text, 'Section \\d+ of title \\d+')) as m from {enactments}) group by doc_key")
def ex14_detect_references(enactments):
    return extract.detected(enactments, "doc_key", "text", [r"Public Law \d+-\d+", r"Section \d+ of title \d+"])


@query("select doc_key, seq, regexp_matches(lower(text), '(this act shall (expire|terminate|cease|sunset))|sunset') as ends, count(*) as n from {enactments} group by all")
def ex16_self_sunset(enactments):
    ends = F.lower("text").rlike("(this act shall (expire|terminate|cease|sunset))|sunset")
    return enactments.groupBy("doc_key", "seq", ends.alias("ends")).agg(F.count("*").alias("n"))


@query("select doc_key, seq, n, (residual > 0 or length(text) > greatest(3500, 1500)) as more from (select doc_key, seq, text, count(*) as n, (case when contains(lower(text), 'transition') or contains(lower(text), 'definitions') or contains(lower(text), 'regulations') then 1 else 0 end) as residual from {enactments} group by all)")
def ex12_needs_supplemental(enactments):
    from ..operators import rules

    one = enactments.groupBy("doc_key", "seq", "text").agg(F.count("*").alias("n"))
    return one.select("doc_key", "seq", "n", rules.needs_supplement(F.col("text"), F.lit(1), F.lit(0)).alias("more"))


@query("select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as asked from {conversations}")
def ex20_nearest_preceding(conversations):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return conversations.select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("asked"))


@query("select action_id, ord, title, section, count(*) as n from (select action_id, ord, regexp_extract(identifier, '^/us/usc/t([0-9A-Za-z]+)', 1) as title, regexp_extract(identifier, '^/us/usc/t[0-9A-Za-z]+/s([^/]+)', 1) as section from {actions}) group by all")
def ex23_targets_from_action(actions):
    t, s = (F.regexp_extract("identifier", T.IDENTIFIER, i) for i in (1, 2))
    return actions.groupBy("action_id", "ord", t.alias("title"), s.alias("section")).agg(F.count("*").alias("n"))


@query("select node_id from {results} where starts_with(node_id, 'rp-0') group by node_id")
def fl8_project_node(results):
    return results.where(F.col("node_id").startswith("rp-0")).select("node_id").distinct()


@query("select identifier from {sections} where identifier in (select identifier from {actions} where action_type = 'amendment') or not exists (select 1 from {actions} where action_type = 'amendment')")
def fl9_touched_scope(sections, actions):
    touched = actions.where("action_type = 'amendment'").select("identifier").distinct()
    return sections.select("identifier").join(touched, "identifier", "left_semi")


@query("select law_id, identifier, row_number() over (partition by law_id order by cast(regexp_extract(identifier, '/t([0-9]+)', 1) as int), regexp_extract(identifier, '/s([^/]+)', 1), identifier)::int as place from (select distinct law_id, identifier from {actions})")
def so2_target_order(actions):
    w = Window.partitionBy("law_id").orderBy(F.regexp_extract("identifier", "/t([0-9]+)", 1).try_cast("int"), F.regexp_extract("identifier", "/s([^/]+)", 1), "identifier")
    return actions.select("law_id", "identifier").distinct().withColumn("place", F.row_number().over(w))


@query("select title, section, row_number() over (partition by title order by cast(regexp_extract(section, '^([0-9]+)', 1) as int), section)::int as place from {sections}")
def so3_section_order(sections):
    w = Window.partitionBy("title").orderBy(F.regexp_extract("section", "^([0-9]+)", 1).try_cast("int"), "section")
    return sections.select("title", "section").withColumn("place", F.row_number().over(w))


@query("select distinct law_id, identifier from {actions}")
def st4_distinct_targets(actions):
    return actions.select("law_id", "identifier").distinct()


@query("select treatment, case when contains(lower(treatment), 'already-incorporated') then 1 when contains(lower(treatment), 'exclude-from-code') then 3 else 5 end as wording, count(*) as n from {actions} group by treatment")
def pl21_publication_filter(actions):
    wording = F.when(F.lower("treatment").contains("already-incorporated"), 1).when(F.lower("treatment").contains("exclude-from-code"), 3).otherwise(5)
    return actions.groupBy("treatment", wording.alias("wording")).agg(F.count("*").alias("n"))


@query("select kind, count(*) as n from (select case when href like '/%' then 'inner' when href like 'http%' then 'outer' else 'other' end as kind from (select unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) as href from {pages})) group by kind")
def pl27_publication_gate(pages):
    kind = F.when(F.col("href").startswith("/"), "inner").when(F.col("href").startswith("http"), "outer").otherwise("other")
    return extract.links(pages).select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("select count(*) as sections, count(distinct title) as titles, count(*) filter (where heading is null or heading = '') as unnamed, max(case when identifier = '/us/usc/t7/s1' then 1 else 0 end)::int as has_key from {sections}")
def pl28_index_gate(sections):
    return sections.agg(F.count("*").alias("sections"), F.countDistinct("title").alias("titles"), F.count_if(F.coalesce("heading", F.lit("")) == "").alias("unnamed"), F.max((F.col("identifier") == "/us/usc/t7/s1").cast("int")).alias("has_key"))


@query("select law_id, ord, number from (select law_id, ord, row_number() over (order by law_id, ord) as number from {reviews} where status = 'valid')")
def pl3_plan_numbers(reviews):
    return ledger.numbered(reviews.where("status = 'valid'"), "law_id", ["ord"]).select("law_id", "ord", "number")
