"""Reviews: decisions on provisions, and validation of provisions, laws and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions, validation
from .base import query

_split = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
_has = lambda c, *names: "(" + " or ".join(f"contains(',' || {c} || ',', ',{n},')" for n in names) + ")"
_in = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _drafts(drafts):
    return decisions.normalize_provisions(drafts.withColumns({"classes": _split("classes"), "source_classes": _split("source_classes")}))


@query(f"""select provision_id, case b when 1 then 'statutory-note' when 2 then 'historical-note-only' when 3 then 'new-subsection' when 4 then 'statutory-note' when 5 then 'new-section' when 6 then 'historical-note-only' else treatment end as treatment,
 case when target <> '' then target when source_target <> '' then source_target else law_target end as target,
 coalesce(nullif(case when b in (3, 4, 5) and law_command <> '' then law_command when b in (3, 4, 5) and law_change <> '' then law_change when exact_change <> '' then exact_change when source_change <> '' then source_change when law_command <> '' then law_command else law_change end, ''),
  case b when 1 then '{decisions.NOTE_TEXT}' when 2 then '{decisions.CONTEXT_TEXT}' when 6 then '{decisions.HISTORY_TEXT}' when 0 then '' else '{decisions.OPERATIVE_TEXT}' end) as exact_change,
 case b when 1 then 'notes' when 2 then 'effective date' when 3 then 'definitions' when 4 then 'purpose' when 5 then 'general' when 6 then 'history' end as rule
 from (select *, case when {_has('c', 'short-title', 'findings-or-sense')} then 1 when {_has('c', 'effective-date')} then 2
  when {_has('c', 'new-permanent-general')} and t in {_in(decisions.PLACED)} then case when contains(s, 'definition') then 3 when contains(s, 'purpose') then 4 else 5 end
  when replace(lower(trim(law_status)), '-', '_') in {_in(decisions.HISTORIC)} then 6 else 0 end as b
  from (select *, case when classes <> '' then classes else source_classes end as c, lower(case when summary <> '' then summary else source_summary end) as s, replace(lower(trim(law_treatment)), '-', '_') as t from {{drafts}}))""")
def pl6_normalize_provision(drafts):
    return _drafts(drafts).select("provision_id", "treatment", "target", "exact_change", "rule")


#: Two rules of one priority, so that some provisions meet both.
_TIED = [("short", 1, [("classes", "any", ["short-title", "findings-or-sense"])], {"treatment": "note"}), ("dated", 1, [("classes", "any", ["effective-date", "findings-or-sense"])], {"treatment": "dated"}), ("rest", 9, [], {"treatment": "text"})]


@query(f"select provision_id, case when {_has('classes', 'short-title', 'findings-or-sense')} then 'short' when {_has('classes', 'effective-date')} then 'dated' else 'rest' end as rule, case when {_has('classes', 'findings-or-sense')} or {_has('classes', 'short-title')} and {_has('classes', 'effective-date')} then 'dated' else '' end as conflicts from {{drafts}}")
def pl6_rule_conflicts(drafts):
    split = drafts.withColumn("classes", _split("classes"))
    return decisions.decide(split, _TIED, {"classes": F.col("classes")}, ["treatment"]).select("provision_id", "rule", F.array_join("conflicts", ",").alias("conflicts"))


_NORMAL = lambda c: f"replace(replace(lower(trim({c})), '-', '_'), ' ', '_')"
_ACTS = _has("classes", *validation.ACTION_CLASSES)
_CHANGES = f"({_ACTS} and {_NORMAL('treatment')} not in {_in(validation.NOTE_TREATMENTS)})"
_OF_PROVISION = f"""case when not is_object then ['schema-invalid'] else list_filter([case when {_CHANGES} and target = '' then 'missing target' end,
 case when ({_ACTS} or {_has('classes', 'new-permanent-general')}) and trim(treatment) = '' then 'missing approved code treatment' end, case when evidence = '' then 'missing source evidence' end,
 case when {_CHANGES} and change = '' then 'missing exact enacted text or amendment command' end], lambda x: x is not null) end"""
_STATUS = " ".join(f"when '{s}' then '{issue}'" for s, issue in validation.STATUS_ISSUES)
_OF_LAW = f"""list_filter([case {_NORMAL('status')} {_STATUS} end, case when chronology = '' then 'missing chronology conclusion' end, case when trim(treatment) = '' then 'missing approved code treatment' end,
 case when recommendation = '' then 'missing final recommended action' end, case when evidence = '' then 'missing source evidence' end, case when comparison = '' then 'missing current XML comparison' end, case when confidence = '' then 'missing confidence' end], lambda x: x is not null)"""
_CHECKED = f"""below as (select idx, ord, list(distinct i) as issues from (select idx, ord, unnest({_OF_PROVISION}) as i from {{report_provisions}}) group by all),
 checked as (select l.*, case when not is_object then ['schema-invalid'] else list_sort(list_distinct(list_concat({_OF_LAW}, coalesce(b.issues, [])))) end as issues from {{report_laws}} l left join below b using (idx, ord))"""
_RANK = " ".join(f"when list_contains(issues, '{s}') then '{s}'" for s in ("schema-invalid", "missing laws", "source unavailable", "unsupported source", "source-defect-unresolved", "operative-text-required-but-target-unresolved", "unresolved conclusion", "missing conclusion", "missing evidence", "missing target"))
_REPORTS = _CHECKED + f""", counted as (select idx, count(*) as n from checked group by idx), kinds as (select idx, list(distinct i) as issues from (select idx, unnest(issues) as i from checked) group by idx),
 sets as (select idx, bool_or(a is null or b is null or a > 1) as differs, count(*) filter (where a is null) as missing from (select idx, law_id, count(*) as a from checked where is_object and law_id <> '' group by all) full join (select idx, law_id, count(*) as b from {{manifest_laws}} group by all) using (idx, law_id) group by idx),
 told as (select idx, r.law_count, m.law_count as manifest_law_count, r.idx is null as no_report, m.idx is null as no_manifest, r.digest = m.digest as same, coalesce(n, 0) as n, coalesce(missing, 0) as missing,
  list_sort(list_distinct(list_filter(list_concat([case when r.law_count is distinct from coalesce(n, 0) then 'schema-invalid' end, case when differs then 'missing laws' end], coalesce(k.issues, [])), lambda x: x is not null))) as issues
  from (select *, idx as i from {{reports}}) r full join {{manifests}} m using (idx) left join counted using (idx) left join kinds k using (idx) left join sets using (idx)),
 reported as (select idx, no_manifest or no_report as gone, case when no_manifest or no_report then 'schema-invalid' when same then 'manifest-copy' {_RANK} when len(issues) > 0 then 'incomplete' else 'valid' end as status,
  case when no_manifest then ['missing manifest file'] when no_report then ['missing report file'] when same then ['byte-identical to manifest'] else issues end as issues, law_count, manifest_law_count, case when no_manifest or no_report or same then 0 else missing end as missing_laws, not (no_manifest or no_report or same) as read from told)"""


def _levels(reports, manifests, report_laws, report_provisions, manifest_laws):
    checked = validation.law_level(report_laws, report_provisions.withColumn("classes", _split("classes")))
    return checked, validation.report_level(reports, manifests, checked, manifest_laws)


@query(f"select idx, ord, array_to_string(list_sort({_OF_PROVISION}), ' | ') as issues from {{report_provisions}}")
def pl8_provision_issues(report_provisions):
    rows = report_provisions.withColumn("classes", _split("classes"))
    issues = F.when(F.col("is_object"), validation.provision_issues()).otherwise(F.array(F.lit("schema-invalid")))
    return rows.select("idx", "ord", F.array_join(issues, " | ").alias("issues"))


@query(f"with {_CHECKED} select idx, ord, law_id, array_to_string(issues, ' | ') as issues from checked")
def pl8_law_issues(report_laws, report_provisions):
    return validation.law_level(report_laws, report_provisions.withColumn("classes", _split("classes"))).select("idx", "ord", "law_id", F.array_join("issues", " | ").alias("issues"))


@query(f"with {_REPORTS} select idx, status, array_to_string(issues, ' | ') as issues, law_count, manifest_law_count, missing_laws from reported")
def ag9_report_validation(reports, manifests, report_laws, report_provisions, manifest_laws):
    _, rows = _levels(reports, manifests, report_laws, report_provisions, manifest_laws)
    return rows.select("idx", "status", F.array_join("issues", " | ").alias("issues"), "law_count", "manifest_law_count", "missing_laws")


@query(f"with {_REPORTS} select 'all' as subset, status, count(*) as n from reported group by status union all select 'canonical', status, count(*) from reported where idx <= 26 group by status")
def ag9_status_counts(reports, manifests, report_laws, report_provisions, manifest_laws):
    return validation.status_counts(_levels(reports, manifests, report_laws, report_provisions, manifest_laws)[1])


_UNDECIDED = "list_has_any(issues, ['source-defect-unresolved', 'operative-text-required-but-target-unresolved', 'missing conclusion'])"
_NO_SOURCE = "(evidence = '' or chronology = '' or list_has_any(issues, ['source unavailable', 'unsupported source']))"
_SUMMARY = lambda subset, where: f"select '{subset}' as subset, (select count(*) from reported where {where}) as reports, count(distinct nullif(law_id, '')) as laws, count(*) filter (where {_UNDECIDED}) as undecided_laws, count(distinct idx) filter (where {_UNDECIDED}) as reports_undecided, count(distinct idx) filter (where {_NO_SOURCE}) as reports_without_source from checked where is_object and idx in (select idx from reported where read) and {where}"


@query(f"with {_REPORTS} {_SUMMARY('all', 'true')} union all {_SUMMARY('canonical', 'idx <= 26')}")
def ag9_summary(reports, manifests, report_laws, report_provisions, manifest_laws):
    checked, rows = _levels(reports, manifests, report_laws, report_provisions, manifest_laws)
    return validation.summary(rows, checked)


@query(f"with {_REPORTS} select law_id, idx, status, array_to_string(issues, ' | ') as issues from (select *, row_number() over (partition by law_id order by idx desc, ord desc) as r from checked where is_object and law_id <> '' and idx in (select idx from reported where read)) where r = 1")
def ag9_latest_laws(reports, manifests, report_laws, report_provisions, manifest_laws):
    checked, rows = _levels(reports, manifests, report_laws, report_provisions, manifest_laws)
    return validation.latest(checked, rows).withColumn("issues", F.array_join("issues", " | "))
