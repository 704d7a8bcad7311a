"""Gates over ledgers: catalogues of rules that must hold, checked for many runs of a review at once.

A rule has a scope (run, law or provision), a name and a condition over a row; a null condition is broken. What a rule
needs of other ledgers is joined to the row once for all rules of its scope: a scope is one plan, not one a rule. A rule is
checked where the texts it needs are, and goes on as a bit. Totals
of a run come from one aggregation with partial sums, so that a run may hold most rows.

A ledger with several rows of one key (index, validation records, plan) gives its first: the smallest row by `ord` or by
all columns. A null key matches nothing. Blank texts count as missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .patch import EXECUTABLE, TREATMENTS

#: Classes that change text; treatments that leave a note or nothing; treatments that must name target and
#: change by themselves (others are held by their action); treatments that may not act on text; wordings that no command
#: to be executed may hold.
ACTION_CLASSES = ("direct-amendment", "repeal", "transfer", "redesignation", "substitution")
NOTES_ONLY = (
    "historical_note_only", "historical_preservation", "historical_note", "statutory_note", "statutory_note_only", "transfer_note", "amendment_note",
    "exclude_from_code", "savings_note", "effective_date_note", "history_only", "note_only", "source_limited_historical_note",
)
SELF_EXECUTING = ("transfer", "redesignation", "substitution")
HISTORIC = ("historical_note_only", "historical_note", "history_only", "source_limited_historical_note")
STATUTORY = ("statutory_note", "statutory_note_only", "note_only", "effective_date_note", "savings_note", "transfer_note")
NO_COMMAND = (
    "no operative text", "not section-level codification", "retain as repeal history only", "do not carry this into live code text",
    "do not retain live text", "history only",
)


def _said(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) != ""


def _normal(c: str) -> Column:
    return T.normalize_text(F.coalesce(c, F.lit("")), "space")


def _if(applies: Column, holds: Column) -> Column:
    """Holds where it applies; an unknown condition is broken, an unknown applicability doesn't apply."""
    return ~F.coalesce(applies, F.lit(False)) | F.coalesce(holds, F.lit(False))


def _first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the smallest by `order`, then by the other columns."""
    rest = order + [c for c in df.columns if c not in keys + order]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("row")).select(*keys, *[F.col("row").getField(c).alias(c) for c in rest])


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that can match, dealt out by key. A key of these ledgers has few rows, so that texts of them are sorted once, where they meet,
    and not also before they are dealt, where a task has more rows of them the narrower the rows are they are made of. The key that tells
    most comes first, as a sort compares its first bytes."""
    return df.dropna(subset=keys).repartition(*keys)


def mask(rules: dict[str, Column], names: list[str]) -> Column:
    """The rules that don't hold as bits, by their place among `names`: eight bytes a row go on instead of the texts they were checked on."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1 << names.index(name)).cast("long") for name, c in rules.items()])


def broken(rows: DataFrame, scope: str, subject: Column, names: list[str], bits: str = "bits") -> DataFrame:
    """(run_id, scope, subject, rule) of the rules whose bit is set."""
    of = F.array_compact(F.array(*[F.when(F.col(bits).bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(name)) for i, name in enumerate(names)]))
    return rows.where(F.col(bits) != 0).select("run_id", F.lit(scope).alias("scope"), subject.alias("subject"), F.explode(of).alias("rule"))


def law_rows(laws: DataFrame, index: DataFrame, candidates: DataFrame, reports: DataFrame) -> DataFrame:
    """(run_id, law_id, bits) of laws with their index row, latest candidate report and validation record (that of all
    reports goes before the canonical one)."""
    names, keys = list(law_rules()), ["law_id", "run_id"]
    chosen = _first(_dealt(index.select("run_id", "law_id", "selected", "superseded"), keys), keys, []).withColumn("indexed", F.lit(True))
    latest = _dealt(candidates, keys).groupBy(*keys).agg(F.max(F.struct("group_index", F.col("report").alias("r")))["r"].alias("latest"))
    order = F.when(F.col("kind") == "full", 0).otherwise(1).alias("ord")
    records = _first(reports.select("run_id", "report", order, F.col("status").alias("record_status")), ["run_id", "report"], ["ord"]).drop("ord").withColumn("recorded", F.lit(True))
    own = laws.select("run_id", "law_id", "report", mask(_law_own(), names).alias("own"))
    met = own.join(chosen, keys, "left").join(latest, keys, "left").select("run_id", "law_id", "report", F.col("own").bitwiseOR(mask(_law_indexed(), names)).alias("own"))
    return met.join(records, ["run_id", "report"], "left").select("run_id", "law_id", F.col("own").bitwiseOR(mask(_law_recorded(), names)).alias("bits"))


def _law_own() -> dict[str, Column]:
    texts = ("status", "chronology", "treatment", "action", "evidence", "comparison", "confidence")
    return {"report named": _said("report"), "report valid": F.trim("report_status") == "valid", "no issues": ~_said("issues")} | {f"{c} given": _said(c) for c in texts}


def _law_indexed() -> dict[str, Column]:
    indexed = F.col("indexed").isNotNull()
    late = indexed & _said("latest") & ~F.col("latest").eqNullSafe(F.col("report"))
    return {
        "in index": indexed,
        "index agrees": _if(indexed, F.col("selected").eqNullSafe(F.col("report"))),
        "latest superseded": _if(late, F.array_contains(F.split("superseded", ","), F.col("latest"))),
    }


def _law_recorded() -> dict[str, Column]:
    recorded = F.col("recorded").isNotNull()
    return {"validation recorded": recorded, "validation valid": _if(recorded, F.trim("record_status") == "valid")}


def law_rules() -> dict[str, Column]:
    return _law_own() | _law_indexed() | _law_recorded()


#: Rules of which a law's row may know what its provision and its plan don't.
BY_LAW = {"law_target": "exact target known", "law_command": "exact change known"}


def provision_rows(provisions: DataFrame, plan: DataFrame, laws: DataFrame) -> DataFrame:
    """(run_id, law_id, ref, bits) of provisions with their first plan row and what their law says of target and command. Rows without
    a broken rule drop out before they meet their law, which can only mend some."""
    names, keys, by_law = list(provision_rules()), ["law_id", "ref", "run_id"], ["law_id", "run_id"]
    planned = _first(_dealt(plan.select(*keys, "ord", "action_id", "action_type", "file", "identifier", "command", "node_ids"), keys), keys, ["ord"])
    action = planned.withColumn("action", _normal("action_type"))
    executes = F.col("action").isin(*[a.replace("-", "_").replace(" ", "_") for a in EXECUTABLE])
    planned = action.withColumn("executes", executes).select(
        *keys, "action", F.trim("action_type").alias("action_type"), "executes", _said("identifier").alias("has_identifier"), _said("command").alias("has_command"),
        mask(_plan_own(), names).alias("plan_bits"), F.lit(True).alias("planned"),
    )
    of_law = _first(_dealt(laws.select("run_id", "law_id", *BY_LAW), by_law), by_law, []).select("run_id", "law_id", *[_said(c).alias(c) for c in BY_LAW])
    own = provisions.withColumn("said", _normal("treatment")).select(*keys, "said", _said("target").alias("has_target"), _said("exact_change").alias("has_change"), mask(_provision_own(), names).alias("own"))
    bits = F.col("own").bitwiseOR(F.coalesce("plan_bits", F.lit(0).cast("long"))).bitwiseOR(mask(_provision_planned(), names))
    met = own.join(planned, keys, "left").select(*keys, bits.alias("bits")).where("bits <> 0").join(of_law, by_law, "left")
    for c, name in BY_LAW.items():
        met = met.withColumn("bits", F.when(F.col(c), F.col("bits").bitwiseAND(F.lit(~(1 << names.index(name))).cast("long"))).otherwise(F.col("bits")))
    return met.select(*keys, "bits")


def _provision_own() -> dict[str, Column]:
    said = F.col("said")
    acts = F.arrays_overlap(F.split("classes", ","), F.array(*[F.lit(c) for c in ACTION_CLASSES])) & ~said.isin(*NOTES_ONLY)
    itself = said.isin(*SELF_EXECUTING)
    return {
        "treatment given": _said("treatment"),
        "evidence given": _said("evidence"),
        "action has target": _if(acts, _said("target")),
        "action has change": _if(acts, _said("exact_change")),
        "executing treatment has target": _if(itself, _said("target")),
        "executing treatment has change": _if(itself, _said("exact_change")),
    }


def _plan_own() -> dict[str, Column]:
    executes = F.col("executes")
    wrong = F.exists(F.filter(F.split(F.coalesce("node_ids", F.lit("")), ","), lambda n: n != ""), lambda n: (F.trim(n) == "") | F.trim(n).startswith("/") | n.contains("/us/usc/") | F.lower(F.trim(n)).endswith(".xml"))
    commands = F.lower(F.coalesce("command", F.lit("")))
    empty = F.lit(False)
    for wording in NO_COMMAND:
        empty = empty | commands.contains(wording)
    return {
        "plan has action id": _said("action_id"),
        "plan has action type": F.col("action_type").isNotNull(),
        "executable names file": _if(executes, _said("file")),
        "executable names identifier": _if(executes, _said("identifier")),
        "executable has command": _if(executes, _said("command")),
        "executable command consistent": _if(executes, ~empty),
        "node ids valid": ~wrong,
    }


def _provision_planned() -> dict[str, Column]:
    said, planned = F.col("said"), F.col("planned").isNotNull()
    executes = F.coalesce("executes", F.lit(False))
    acts = said.isin(*SELF_EXECUTING) | executes
    actions = F.create_map(*[F.lit(x) for pair in TREATMENTS.items() for x in pair])
    return {
        "in plan": planned,
        "action fits treatment": _if(planned, F.col("action_type") == F.coalesce(actions[said], F.lit("no Code action"))),
        "historical note acts on no text": ~(said.isin(*HISTORIC) & executes),
        "statutory note acts on no text": ~(said.isin(*STATUTORY) & executes),
        "excluded has no action": _if(planned & (said == "exclude_from_code"), F.col("action") == "no_code_action"),
        "exact target known": _if(acts, F.col("has_target") | F.coalesce("has_identifier", F.lit(False))),
        "exact change known": _if(acts, F.col("has_change") | F.coalesce("has_command", F.lit(False))),
    }


def provision_rules() -> dict[str, Column]:
    return _provision_own() | _plan_own() | _provision_planned()


def run_rows(stated: DataFrame, laws: DataFrame, index: DataFrame, plan: DataFrame, provisions: DataFrame, mappings: DataFrame, unresolved: DataFrame) -> DataFrame:
    """What each run states of itself, with the counts of its ledgers."""
    count = lambda df, what: df.groupBy("run_id").agg(F.count("*").alias("n")).select("run_id", F.lit(what).alias("what"), "n")
    # Copies of a mapping meet in one key with their number, so that rows and different ones come from one shuffle.
    mapped = mappings.groupBy("run_id", "law_id", "ref", "batch", "idx").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.sum("n").alias("mappings"), F.count("*").alias("mapped"))
    mapped = mapped.select("run_id", F.inline(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in ("mappings", "mapped")])))
    open_rows = unresolved.groupBy("run_id", F.concat(F.lit("open_"), "kind").alias("what")).agg(F.count("*").alias("n"))
    parts = [count(laws, "laws"), count(index, "indexed"), count(plan, "planned"), count(provisions, "provisions"), mapped, open_rows]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    names = ("laws", "indexed", "planned", "provisions", "mappings", "mapped", "open_law", "open_provision")
    counted = union.groupBy("run_id").agg(*[F.sum(F.when(F.col("what") == c, F.col("n")).otherwise(0)).alias(f"n_{c}") for c in names])
    return stated.join(counted, "run_id", "left").na.fill(0, [f"n_{c}" for c in names])


def run_rules() -> dict[str, Column]:
    c = F.col
    same = lambda a, b: c(a).eqNullSafe(c(b))
    none = lambda a: F.coalesce(a, F.lit(0)) == 0
    rest = F.coalesce("progress_total", F.lit(0)) - F.coalesce("progress_completed", F.lit(0))
    return (
        {f"plan: no {a.replace('_', ' ')}": c(a) == 0 for a in ("treatment_action_conflicts", "invalid_node_identifiers", "executables_without_target", "executables_without_command")}
        | {"laws as expected": c("n_laws") == c("expected_laws")}
        | {f"stated {a.replace('_', ' ')} as expected": c(a) == c("expected_laws") for a in ("total_laws", "reviewed_laws", "audit_complete_laws", "progress_total")}
        | {
            "progress total fits ledger": same("progress_total", "total_laws"),
            "progress completed fits ledger": same("progress_completed", "primary_complete"),
            "high risk is the remainder": c("high_risk") == rest,
            "high risk reviewed": same("high_risk_reviewed", "high_risk"),
            "index as expected": c("n_indexed") == c("expected_laws"),
            "audit complete fits index": c("audit_complete_laws") == c("n_indexed"),
            "plan as expected": c("n_planned") == c("expected_provisions"),
            "no unresolved laws": c("n_open_law") == 0,
            "no unresolved provisions": c("n_open_provision") == 0,
        }
        | {f"no {a.replace('_', ' ')}": none(a) for a in ("controlling_invalid_reports", "controlling_laws_with_issues", "controlling_provisions_with_issues")}
        | {
            "mappings as expected": c("n_mappings") == c("expected_mappings"),
            "consolidated as expected": c("n_mapped") == c("expected_provisions"),
            "provisions as expected": c("n_provisions") == c("expected_provisions"),
            "stated mappings as expected": c("source_provisions") == c("expected_mappings"),
            "stated provisions as expected": c("consolidated_provisions") == c("expected_provisions"),
            "no action without target": c("actions_without_target") == 0,
        }
        | {f"{a.replace('_', ' ')} stated": c(a).isNotNull() for a in ("primary_complete", "high_risk_reviewed", "audit_complete_laws")}
    )


def catalogue() -> dict[str, dict[str, Column]]:
    return {"run": run_rules(), "law": law_rules(), "provision": provision_rules()}


def ledger_failures(stated: DataFrame, laws: DataFrame, index: DataFrame, candidates: DataFrame, reports: DataFrame, provisions: DataFrame, plan: DataFrame, mappings: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(run_id, scope, subject, rule) of all broken rules. Subjects are law ids, law id / reference, or empty for a run."""
    rules = catalogue()
    of_run = run_rows(stated, laws, index, plan, provisions, mappings, unresolved).withColumn("bits", mask(rules["run"], list(rules["run"])))
    of_run = broken(of_run, "run", F.lit(""), list(rules["run"]))
    of_law = broken(law_rows(laws, index, candidates, reports), "law", F.col("law_id"), list(rules["law"]))
    of_provision = broken(provision_rows(provisions, plan, laws), "provision", F.concat_ws(" / ", "law_id", "ref"), list(rules["provision"]))
    return of_run.unionByName(of_law).unionByName(of_provision)


def gate(failures: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, scope, rule, broken, passed) for every run and rule of the catalogue, broken or not."""
    named = F.array(*[F.struct(F.lit(scope).alias("scope"), F.lit(name).alias("rule")) for scope, rules in catalogue().items() for name in rules])
    every = runs.select("run_id").distinct().select("run_id", F.inline(named))
    counts = failures.groupBy("run_id", "scope", "rule").agg(F.count("*").alias("n"))
    return every.join(counts, ["run_id", "scope", "rule"], "left").select("run_id", "scope", "rule", F.coalesce("n", F.lit(0)).alias("broken"), F.col("n").isNull().alias("passed"))
