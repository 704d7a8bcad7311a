"""Validation of reviews on three levels: provisions, laws and reports, for all reports and for the canonical ones in
one pass.

Issues are arrays of names, sorted and distinct. A law has its own and those of its provisions; a report has those of its
laws and of its law set, and its strongest issue is its status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import publish

#: Classes that change text, treatments that leave a note only (in normal form), statuses and the issue
#: each names, issues that leave a law undecided, and the issues of laws without a source.
ACTION_CLASSES = ["direct-amendment", "repeal", "transfer", "redesignation", "substitution"]
NOTE_TREATMENTS = [
    "historical_note_only", "historical_preservation", "statutory_note", "statutory_note_only", "transfer_note", "amendment_note", "exclude_from_code", "savings_note",
    "effective_date_note", "history_only", "note_only", "note_only_but_amendment_required", "source_limited_historical_note",
]
STATUS_ISSUES = [
    ("unknown", "unresolved conclusion"), ("unresolved", "unresolved conclusion"), ("source_defect_unresolved", "source-defect-unresolved"), ("source_unavailable", "source unavailable"),
    ("unsupported_source", "unsupported source"), ("operative_text_required_but_target_unresolved", "operative-text-required-but-target-unresolved"),
    ("", "missing conclusion"), ("n_a", "missing conclusion"), ("na", "missing conclusion"),
]
UNDECIDED = ["source-defect-unresolved", "operative-text-required-but-target-unresolved", "missing conclusion"]
SOURCELESS = ["source unavailable", "unsupported source"]
CANONICAL = 26
_INVALID = "schema-invalid"


def _named(**issues: Column) -> Column:
    """The names (with spaces for `_`) of the conditions that hold, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name.replace("_", " "))) for name, c in issues.items()])))


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def provision_issues(classes: str = "classes", treatment: str = "treatment", target: str = "target", evidence: str = "evidence", change: str = "change") -> Column:
    acts = F.arrays_overlap(F.col(classes), F.array(*[F.lit(c) for c in ACTION_CLASSES]))
    acts = F.coalesce(acts, F.lit(False))
    said = T.normalize_text(F.coalesce(treatment, F.lit("")), "space")
    changes = acts & ~said.isin(*NOTE_TREATMENTS)
    general = F.coalesce(F.array_contains(classes, "new-permanent-general"), F.lit(False))
    return _named(missing_target=changes & _blank(target), missing_approved_code_treatment=(acts | general) & (said == ""), missing_source_evidence=_blank(evidence), missing_exact_enacted_text_or_amendment_command=changes & _blank(change))


def law_issues() -> Column:
    """Of the columns status, chronology, treatment, recommendation, evidence, comparison and confidence."""
    status = T.normalize_text(F.coalesce("status", F.lit("")), "space")
    of_status = F.lit(None).cast("string")
    for s, issue in reversed(STATUS_ISSUES):
        of_status = F.when(status == s, issue).otherwise(of_status)
    missing = _named(
        missing_chronology_conclusion=_blank("chronology"), missing_approved_code_treatment=_blank("treatment"), missing_final_recommended_action=_blank("recommendation"),
        missing_source_evidence=_blank("evidence"), missing_current_XML_comparison=_blank("comparison"), missing_confidence=_blank("confidence"),
    )
    return F.array_sort(F.array_compact(F.concat(F.array(of_status), missing)))


def law_level(laws: DataFrame, provisions: DataFrame) -> DataFrame:
    """laws with `issues`, their provisions' among them. laws: (idx, ord, law_id, is_object, ...), provisions: (idx, ord,
    is_object, ...); what is no object is schema-invalid."""
    of_provision = F.when(F.col("is_object"), provision_issues()).otherwise(F.array(F.lit(_INVALID)))
    below = provisions.select("idx", "ord", F.explode(of_provision).alias("issue")).groupBy("idx", "ord").agg(F.collect_set("issue").alias("below"))
    joined = laws.join(below, ["idx", "ord"], "left")
    own = F.concat(law_issues(), F.coalesce("below", F.array().cast("array<string>")))
    return joined.withColumn("issues", F.when(F.col("is_object"), F.array_sort(F.array_distinct(own))).otherwise(F.array(F.lit(_INVALID)))).drop("below")


def report_level(reports: DataFrame, manifests: DataFrame, checked: DataFrame, manifest_laws: DataFrame) -> DataFrame:
    """(idx, status, issues, law_count, manifest_law_count, missing_laws) of every report or manifest. reports and manifests:
    (idx, law_count, digest); checked: what law_level gives; manifest_laws: (idx, law_id)."""
    issues = checked.select("idx", F.explode("issues").alias("issue")).groupBy("idx").agg(F.collect_set("issue").alias("below"))
    found = checked.groupBy("idx").agg(F.count("*").alias("n_laws"))
    sets = checked.where(F.col("is_object") & ~_blank("law_id")).groupBy("idx", "law_id").agg(F.count("*").alias("there"))
    wanted = manifest_laws.where(~_blank("law_id")).groupBy("idx", "law_id").agg(F.count("*").alias("asked"))
    both = sets.join(wanted, ["idx", "law_id"], "full_outer").groupBy("idx").agg(F.bool_or(F.col("there").isNull() | F.col("asked").isNull() | (F.col("there") > 1)).alias("differs"), F.count_if(F.col("there").isNull()).alias("missing_laws"))
    pair = reports.select("idx", "law_count", F.col("digest").alias("d")).join(manifests.select("idx", F.col("law_count").alias("manifest_law_count"), F.col("digest").alias("m")), "idx", "full_outer")
    every = pair.join(issues, "idx", "left").join(found, "idx", "left").join(both, "idx", "left")
    own = F.array_compact(F.array(F.when(~F.coalesce(F.col("law_count") == F.coalesce("n_laws", F.lit(0)), F.lit(False)), _INVALID), F.when(F.col("differs"), "missing laws")))
    told = F.array_sort(F.array_distinct(F.concat(own, F.coalesce("below", F.array().cast("array<string>")))))
    issues = F.when(F.col("m").isNull(), F.array(F.lit("missing manifest file"))).when(F.col("d").isNull(), F.array(F.lit("missing report file"))).when(F.col("d") == F.col("m"), F.array(F.lit("byte-identical to manifest"))).otherwise(told)
    status = F.when(F.col("m").isNull() | F.col("d").isNull(), _INVALID).when(F.col("d") == F.col("m"), "manifest-copy").otherwise(publish.report_status(F.col("issues")))
    read = F.col("m").isNotNull() & F.col("d").isNotNull() & (F.col("d") != F.col("m"))
    return every.withColumn("issues", issues).select("idx", status.alias("status"), "issues", "law_count", "manifest_law_count", F.when(read, F.coalesce("missing_laws", F.lit(0))).otherwise(0).alias("missing_laws"), read.alias("read"))


def _subsets(df: DataFrame, canonical: int, *by: str):
    """df grouped for all rows and, in the same pass, for those up to the last canonical report."""
    flagged = df.withColumn("canonical", F.col("idx") <= canonical)
    return flagged.groupingSets([[*by], [*by, "canonical"]], "canonical", *by)


def _told(rows: DataFrame) -> DataFrame:
    """The two subsets by name; what is not canonical has no row of its own."""
    name = F.when(F.col("_all") == 1, "all").when(F.col("canonical"), "canonical")
    return rows.withColumn("subset", name).where("subset is not null").drop("canonical", "_all")


def status_counts(reports: DataFrame, canonical: int = CANONICAL) -> DataFrame:
    """(subset, status, n)."""
    return _told(_subsets(reports, canonical, "status").agg(F.grouping("canonical").alias("_all"), F.count("*").alias("n")))


def summary(reports: DataFrame, checked: DataFrame, canonical: int = CANONICAL) -> DataFrame:
    """(subset, reports, laws, undecided_laws, reports_undecided, reports_without_source), laws by their ids in reports that are read."""
    n = _told(_subsets(reports, canonical).agg(F.grouping("canonical").alias("_all"), F.count("*").alias("reports")))
    rows = checked.where("is_object").join(reports.where("read").select("idx"), "idx", "left_semi")
    has = lambda names: F.arrays_overlap("issues", F.array(*[F.lit(x) for x in names]))
    undecided = has(UNDECIDED)
    sourceless = _blank("evidence") | _blank("chronology") | has(SOURCELESS)
    marked = rows.select("idx", F.nullif(F.trim("law_id"), F.lit("")).alias("law_id"), undecided.alias("undecided"), F.when(undecided, F.col("idx")).alias("u"), F.when(sourceless, F.col("idx")).alias("s"))
    laws = _told(_subsets(marked, canonical).agg(F.grouping("canonical").alias("_all"), F.countDistinct("law_id").alias("laws"), F.count_if("undecided").alias("undecided_laws"), F.countDistinct("u").alias("reports_undecided"), F.countDistinct("s").alias("reports_without_source")))
    return n.join(laws, "subset", "left").na.fill(0)


def latest(checked: DataFrame, reports: DataFrame) -> DataFrame:
    """(law_id, idx, status, issues): of each law the last report that is read and names it; of a report's equals the last row."""
    rows = checked.where(F.col("is_object") & ~_blank("law_id")).join(reports.where("read").select("idx"), "idx", "left_semi")
    best = rows.groupBy(F.trim("law_id").alias("law_id")).agg(F.max_by(F.struct("idx", "status", "issues"), F.struct("idx", "ord")).alias("b"))
    return best.select("law_id", "b.idx", "b.status", "b.issues")
