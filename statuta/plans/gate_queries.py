"""Gates of ledgers: every rule of the catalogue, for several runs at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates
from .base import query

_in = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
_said = lambda c: f"coalesce(trim({c}), '') <> ''"
_LAW = {
    "report named": _said("report"), "report valid": "report_status = 'valid'", "no issues": "issues = ''", "in index": "indexed",
    "index agrees": "not indexed or selected = report", "latest superseded": "not indexed or latest is null or latest = report or contains(',' || superseded || ',', ',' || latest || ',')",
    "validation recorded": "record_status is not null", "validation valid": "record_status is null or record_status = 'valid'",
    **{f"{c} given": _said(c) for c in ("status", "chronology", "treatment", "action", "evidence", "comparison", "confidence")},
}
_EXECUTES = "(planned and a in ('amend_existing_text', 'insert_new_section', 'insert_new_subsection', 'repeal_or_remove_project_added_text', 'redesignate', 'transfer', 'substitution'))"
_ACTS = f"(list_has_any(string_split(classes, ','), ['direct-amendment', 'repeal', 'transfer', 'redesignation', 'substitution']) and t not in {_in(gates.NOTES_ONLY)})"
_ITSELF = "t in ('transfer', 'redesignation', 'substitution')"
_EXPECTED = """case t when 'new_section' then 'insert new section' when 'new_subsection' then 'insert new subsection' when 'amend_existing_text' then 'amend existing text' when 'repeal_marking' then 'repeal or remove project-added text'
 when 'redesignation' then 'redesignate' when 'transfer' then 'transfer' when 'substitution' then 'substitution' when 'statutory_note' then 'add statutory note' when 'historical_note_only' then 'add historical note' when 'effective_date_note' then 'add historical note' else 'no Code action' end"""
_PROVISION = {
    "treatment given": _said("treatment"), "evidence given": _said("evidence"),
    "action has target": f"not {_ACTS} or target <> ''", "action has change": f"not {_ACTS} or exact_change <> ''",
    "executing treatment has target": f"not {_ITSELF} or target <> ''", "executing treatment has change": f"not {_ITSELF} or exact_change <> ''",
    "in plan": "planned", "plan has action id": "not planned or action_id <> ''", "plan has action type": "not planned or action_type is not null",
    "action fits treatment": f"not planned or coalesce(action_type, '') = {_EXPECTED}",
    "historical note acts on no text": f"not ({_EXECUTES} and t in ('historical_note_only', 'historical_note', 'history_only', 'source_limited_historical_note'))",
    "statutory note acts on no text": f"not ({_EXECUTES} and t in ('statutory_note', 'statutory_note_only', 'note_only', 'effective_date_note', 'savings_note', 'transfer_note'))",
    "excluded has no action": "not planned or t <> 'exclude_from_code' or a = 'no_code_action'",
    "executable names file": f"not {_EXECUTES} or file <> ''", "executable names identifier": f"not {_EXECUTES} or identifier <> ''", "executable has command": f"not {_EXECUTES} or command <> ''",
    "executable command consistent": f"not {_EXECUTES} or not regexp_matches(lower(command), 'no operative text|not section-level codification|history only|do not carry this into live code text|do not retain live text')",
    "node ids valid": "not planned or len(list_filter(string_split(node_ids, ','), lambda x: x <> '' and (trim(x) = '' or trim(x)[1] = '/' or contains(x, '/us/usc/') or lower(trim(x)) like '%.xml'))) = 0",
    "exact target known": f"not ({_ITSELF} or {_EXECUTES}) or target <> '' or law_target <> '' or planned and identifier <> ''",
    "exact change known": f"not ({_ITSELF} or {_EXECUTES}) or exact_change <> '' or law_command <> '' or planned and command <> ''",
}
_RUN = {
    "plan: no treatment action conflicts": "treatment_action_conflicts = 0", "plan: no invalid node identifiers": "invalid_node_identifiers = 0",
    "plan: no executables without target": "coalesce(executables_without_target, 1) = 0", "plan: no executables without command": "executables_without_command = 0",
    "laws as expected": "n_laws = expected_laws", "stated total laws as expected": "total_laws = expected_laws", "stated reviewed laws as expected": "coalesce(reviewed_laws, -1) = expected_laws",
    "stated audit complete laws as expected": "coalesce(audit_complete_laws, -1) = expected_laws", "stated progress total as expected": "progress_total = expected_laws",
    "progress total fits ledger": "progress_total = total_laws", "progress completed fits ledger": "progress_completed is not distinct from primary_complete",
    "high risk is the remainder": "high_risk = progress_total - progress_completed", "high risk reviewed": "high_risk_reviewed is not distinct from high_risk",
    "index as expected": "n_indexed = expected_laws", "audit complete fits index": "coalesce(audit_complete_laws, -1) = n_indexed", "plan as expected": "n_planned = expected_provisions",
    "no unresolved laws": "n_open_law = 0", "no unresolved provisions": "n_open_provision = 0",
    "no controlling invalid reports": "coalesce(controlling_invalid_reports, 0) = 0", "no controlling laws with issues": "controlling_laws_with_issues = 0", "no controlling provisions with issues": "controlling_provisions_with_issues = 0",
    "mappings as expected": "n_mappings = expected_mappings", "consolidated as expected": "n_mapped = expected_provisions", "provisions as expected": "n_provisions = expected_provisions",
    "stated mappings as expected": "source_provisions = expected_mappings", "stated provisions as expected": "consolidated_provisions = expected_provisions", "no action without target": "actions_without_target = 0",
    "primary complete stated": "primary_complete is not null", "high risk reviewed stated": "high_risk_reviewed is not null", "audit complete laws stated": "audit_complete_laws is not null",
}


def _list(rules: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"case when not ({c}) then '{n}' end" for n, c in rules.items()) + "], lambda x: x is not null)"


_COUNT = lambda t, where="": f"(select count(*) from {{{t}}} x where x.run_id = s.run_id {where})"
_FAILED = f"""lawful as (select l.*, i.law_id is not null as indexed, selected, superseded, latest, coalesce(f.status, c.status) as record_status from {{gate_laws}} l
  left join (select run_id, law_id, min(selected || '|' || superseded) as s, string_split(s, '|')[1] as selected, string_split(s, '|')[2] as superseded from {{gate_index}} group by run_id, law_id) i using (run_id, law_id)
  left join (select run_id, law_id, arg_max(report, group_index) as latest from {{gate_candidates}} group by all) using (run_id, law_id)
  left join (select * from {{gate_reports}} where kind = 'full') f using (run_id, report) left join (select * from {{gate_reports}} where kind = 'canonical') c using (run_id, report)),
 provided as (select p.*, lower(replace(replace(trim(p.treatment), '-', '_'), ' ', '_')) as t, q.ord is not null as planned, lower(replace(replace(coalesce(q.action_type, ''), '-', '_'), ' ', '_')) as a, q.action_id, q.action_type, q.file, q.identifier, q.command, q.node_ids, law_target, law_command
  from {{gate_provisions}} p left join (select * from {{gate_plan}} qualify row_number() over (partition by run_id, law_id, ref order by ord) = 1) q using (run_id, law_id, ref) left join {{gate_laws}} l using (run_id, law_id)),
 runs as (select s.*, {_COUNT('gate_laws')} as n_laws, {_COUNT('gate_index')} as n_indexed, {_COUNT('gate_plan')} as n_planned, {_COUNT('gate_provisions')} as n_provisions, {_COUNT('gate_mappings')} as n_mappings,
  (select count(*) from (select distinct * from {{gate_mappings}}) x where x.run_id = s.run_id) as n_mapped, {_COUNT('gate_unresolved', "and kind = 'law'")} as n_open_law, {_COUNT('gate_unresolved', "and kind = 'provision'")} as n_open_provision from {{gate_stated}} s),
 failed as (select run_id, 'run' as scope, '' as subject, unnest({_list(_RUN)}) as rule from runs union all select run_id, 'law', law_id, unnest({_list(_LAW)}) from lawful
  union all select run_id, 'provision', law_id || ' / ' || ref, unnest({_list(_PROVISION)}) from provided)"""
_EVERY = " union all ".join(f"select '{scope}' as scope, unnest([{', '.join(repr(r) for r in rules)}]) as rule" for scope, rules in (("run", _RUN), ("law", _LAW), ("provision", _PROVISION)))


@query(f"with {_FAILED} select * from failed")
def pl23_ledger_failures(gate_stated, gate_laws, gate_index, gate_candidates, gate_reports, gate_provisions, gate_plan, gate_mappings, gate_unresolved):
    return gates.ledger_failures(gate_stated, gate_laws, gate_index, gate_candidates, gate_reports, gate_provisions, gate_plan, gate_mappings, gate_unresolved)


@query(f"with {_FAILED}, every as (select run_id, scope, rule from {{gate_stated}} cross join ({_EVERY})) select run_id, scope, rule, count(f.run_id) as broken, count(f.run_id) = 0 as passed from every left join failed f using (run_id, scope, rule) group by all")
def pl23_ledger_gate(gate_stated, gate_laws, gate_index, gate_candidates, gate_reports, gate_provisions, gate_plan, gate_mappings, gate_unresolved):
    failed = gates.ledger_failures(gate_stated, gate_laws, gate_index, gate_candidates, gate_reports, gate_provisions, gate_plan, gate_mappings, gate_unresolved)
    return gates.gate(failed, gate_stated).withColumn("broken", F.col("broken").cast("long"))
