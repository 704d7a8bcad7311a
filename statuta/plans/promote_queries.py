"""Approval of drafts, targets that moved since, and laws that published files don't show."""

from __future__ import annotations

from ..operators import markup, promote
from .base import query

_PROMOTED = """promoted as (select law_id, case when reason = '' then 'approved' when reason = 'no plan' then 'missing' else status end as state, reason from (select r.law_id, p.status, case when p.law_id is null then 'no plan' when p.status <> 'draft' then 'not a draft'
  when trim(p.summary) = '' then 'blank summary' when r.law_id not in (select law_id from {draft_operations}) then 'no operations' when r.confirmed <> p.source_sha256 then 'source hash differs' else '' end as reason from {draft_requests} r left join {draft_plans} p using (law_id)))"""


@query(f"with {_PROMOTED} select * from promoted")
def pl29_promote_plan(draft_requests, draft_plans, draft_operations):
    return promote.promote(draft_requests, draft_plans, draft_operations)


@query(f"""with {_PROMOTED}, expected as (select distinct law_id, identifier, body from {{draft_operations}} left join {{sections}} using (identifier) where law_id in (select law_id from promoted where state = 'approved'))
 select law_id, identifier, case when l.identifier is null then 'gone' when e.body is null then 'new' else 'changed' end as how from expected e left join {{later_sections}} l using (identifier) where e.body is distinct from l.body""")
def pl29_moved_targets(draft_requests, draft_plans, draft_operations, sections, later_sections):
    approved = promote.promote(draft_requests, draft_plans, draft_operations)
    return promote.moved(promote.expect_targets(approved, draft_operations, sections), later_sections)


# A law's name stands in a file where one of its parts cites it, its title where a part is headed by it.
@query("""select law_id, file from {published_laws} p where not marked and not (exists (select 1 from {markup_parts} m where m.file = p.file and (m.noted or m.added and m.by_name) and 'PL-' || lpad(m.cited::varchar, 3, '0') || '-' || lpad(m.n::varchar, 3, '0') = p.law_id)
 and exists (select 1 from {markup_parts} m where m.file = p.file and contains(m.heading, p.title)))""")
def pl32_post_publish_check(published_laws, markup_pieces):
    return promote.unpublished(published_laws.select("law_id", "title", "file", "marker"), markup.assemble(markup_pieces))
