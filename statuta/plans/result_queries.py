"""The gate of results over files before and after. The fixture breaks each rule by a form of its own, which the SQL names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markup, results
from .base import query

#: Rules that the forms of amendments (0), insertions (1), notes (2) and other actions (3) break.
_BROKEN = {
    0: {
        1: ["changed nodes present", "changed nodes known"], 2: ["changed nodes known"], 3: ["changed nodes differ", "applied file changed", "applied has its change", "final file holds text"], 4: ["removed nodes gone"], 5: ["removed nodes known"],
        6: ["executable status valid"], 9: ["satisfied has proof"], 10: ["satisfied has proof"], 11: ["satisfied has proof"], 12: ["completed target exists"], 13: ["completed has text"], 14: ["final file holds text"], 15: ["text is executable"],
        16: ["completed has credit"], 17: ["completed has amendment note"], 19: ["supersession explained"], 20: [f"supersession has {c}" for c in ("action", "law", "target", "chronology", "proof")], 21: ["superseded target exists"],
        22: ["added nodes new"], 23: ["added nodes present"], 24: ["planned"],
    },
    1: {1: ["insertion names a section", "completed target exists"], 2: ["insertion has contents entry"], 3: ["insertion has contents entry"]},
    2: {1: ["no action fits plan", "no action explained", "note found"], 2: ["note found"], 3: ["note file agrees"], 4: ["note clean"], 5: ["note holds text"], 6: ["other status valid", "note found"], 9: ["note clean"], 10: ["note has its change"]},
    3: {1: ["no action fits plan"], 2: ["no action explained"]},
}
_CASES = " ".join(f"when kind = {kind} and v = {v} then {names}" for kind, forms in _BROKEN.items() for v, names in forms.items())
_FAILED = f"""failed as (select 'result' as scope, action_id as subject, unnest(case {_CASES} else [] end) as rule from {{claim_keys}} union all select 'plan', action_id, 'has a result' from {{claim_keys}} where kind = 1 and v = 5
  union all select distinct 'file', file, case v when 4 then 'no board link' else 'no false limitation' end from {{claim_keys}} where kind = 2 and v in (4, 11)
  union all select 'note', note, case v when 8 then 'no local path' when 9 then 'no full text' else 'no internal wording' end from {{claim_keys}} where kind = 2 and v in (4, 7, 8, 9))"""
_RULES = {**{r: "result" for forms in _BROKEN.values() for names in forms.values() for r in names}, "has a result": "plan", "no board link": "file", "no false limitation": "file", "no full text": "note", "no internal wording": "note", "no local path": "note"}


def _failures(claimed, plan, before, after):
    listed = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    proof = F.when(F.col("proof_base") != "", F.struct(F.col("proof_base").alias("base"), F.col("proof_file").alias("file"), F.col("proof_node").alias("node"), F.col("proof_identifier").alias("identifier"), F.lit("text").alias("existing"), F.lit("same").alias("comparison")))
    later = F.struct(*[F.col("later").alias(c) for c in ("action", "law", "target", "chronology", "proof")])
    rows = claimed.withColumns({c: listed(c) for c in ("added", "changed", "removed")}).withColumn("proof", proof).withColumn("later", later)
    return results.failures(rows, plan.withColumn("node_ids", listed("node_ids")), markup.assemble(before), markup.assemble(after), "base1", "board.example")


@query(f"with {_FAILED} select * from failed")
def pl24_result_failures(claim_results, claim_plan, claim_before, claim_after):
    return _failures(claim_results, claim_plan, claim_before, claim_after)


@query(f"with {_FAILED}, every as (select unnest({list(_RULES.values())}) as scope, unnest({list(_RULES)}) as rule) select scope, rule, count(subject) as broken, count(subject) = 0 as passed from every left join failed using (scope, rule) group by all")
def pl24_result_gate(claim_results, claim_plan, claim_before, claim_after):
    return results.gate(_failures(claim_results, claim_plan, claim_before, claim_after))
