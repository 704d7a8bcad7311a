"""The gate of results: what each action claims to have done is held against the files before and after.

All claims of all actions meet the files by a few joins, whatever the number of rules: claimed nodes with the nodes of the
positions indexes, identifiers likewise, words of claimed texts with the words of files, changed lines and notes, and notes by id.
Each join is on the claimed value, so that no file's text is carried to an action. The rules are then one projection.

plan: (action_id, action_type, treatment, identifier, node_ids array). results: RESULTS below. before, after: (file, content).
A file's changed lines are those whose number differs between before and after; a line that only moved isn't one. Blank counts
as missing, a null status is none. Of several plan rows of an action the smallest counts; results of one action are
checked each (`nr` tells them apart). Files may be named with `usc/` before them and with backslashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.chunks import shared_folder
from . import markup
from .patch import EXECUTABLE

RESULTS = (
    "nr long, action_id string, status string, file string, identifier string, added array<string>, changed array<string>, removed array<string>, said string, credit string, amendment string, contents string, explanation string, "
    "validation string, note_id string, note_file string, excerpt string, proof struct<base:string,file:string,node:string,identifier:string,existing:string,comparison:string>, "
    "later struct<action:string,law:string,target:string,chronology:string,proof:string>"
)
#: Statuses of actions that change text and of others, inserting and noting actions, wordings of no executable text, and
#: tokens that no note may hold.
EXECUTED = ("applied", "already-satisfied-with-baseline-proof", "superseded-by-later-action", "blocked")
DOCUMENTED = ("applied", "documented-no-code-action", "already-satisfied-with-baseline-proof", "superseded-by-later-action", "blocked")
INSERTS = ("insert new section", "insert new subsection")
NOTES = ("add statutory note", "add historical note", "add amendment note")
NO_TEXT = ("no operative text", "not section-level codification", "retain as repeal history only", "no code action")
INTERNAL = (
    "audit/", "codification/laws/", ".json", "review-", "manifest-", "batch-", "Provision dispositions", "Source evidence", "Code treatment", "approved treatment", "recommended action", "integration command", "current XML",
    "Authenticated statutory text was unavailable", "supplied attachment yielded only viewer",
)
LIMITATION = "Authenticated statutory text was unavailable or the supplied attachment yielded only viewer"
_NOTE = r'(?s)<note\b(?=[^>]*\bid="rp-pl\d{6}-codification")[^>]*>.*?</note>'
_TARGET = r"/us/usc/t\d+[A-Za-z]?(?:/[A-Za-z0-9_.-]+)*"
#: Words of a claim that are looked for.
SAMPLE = 20


def _said(c: str | Column) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) != ""


def _list(c: Column) -> Column:
    return F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x != ""))


def file_name(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, "\\", "/"), "^usc/", "")


def words(c: Column) -> Column:
    """The different words of four or more letters or digits outside tags, in their order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")), F.lit("[a-z0-9]{4,}"), F.lit(0)))


def changed_lines(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, line) of the lines whose number differs. Equal lines are counted where they are read."""
    side = lambda df, by: df.select("file", F.explode(F.split("content", "\n")).alias("line"), F.lit(by).alias("by"))
    return side(after, 1).unionByName(side(before, -1)).groupBy("file", "line").agg(F.sum("by").alias("n")).where("n <> 0").select("file", "line")


def notes_of(after: DataFrame) -> DataFrame:
    """(note_id, file, pos, text): every project note of the files, also those that share an id."""
    found = after.select("file", F.posexplode(F.regexp_extract_all("content", F.lit(_NOTE), F.lit(0))).alias("pos", "text"))
    return found.select(F.regexp_extract("text", r'\bid="(rp-pl\d{6}-codification)"', 1).alias("note_id"), "file", "pos", "text")


def _noted(rows: DataFrame, notes: DataFrame, board: str) -> DataFrame:
    """(nr, found_file, note_clean, held_note): the note that a result claims, and how many of the claimed words it holds. Of several of one id it is
    the one in the claimed file, the note's or else the result's, that holds most of them; where that file has none, the last by file and place."""
    low = F.lower("text")
    clean = ~low.contains(board.lower()) & ~low.contains("<quotedcontent") & ~low.contains("authenticated statutory text was unavailable")
    # Copies of a note in a file count as one, so that claims don't meet each of them.
    kept = notes.groupBy("note_id", "file", "text").agg(F.max("pos").alias("pos"))
    said = kept.select("note_id", "file", "pos", clean.alias("note_clean"))
    place = file_name(F.when(_said("note_file"), F.col("note_file")).otherwise(F.col("file")))
    claims = rows.where(_said("proved_note")).select("nr", F.col("proved_note").alias("note_id"), place.alias("place"), "note_claim")
    here = claims.join(said.withColumn("place", F.col("file")), ["note_id", "place"])
    last = said.groupBy("note_id").agg(F.max(F.struct("file", "pos", "note_clean")).alias("l")).select("note_id", "l.*")
    elsewhere = claims.join(here.select("nr").distinct(), "nr", "left_anti").join(last, "note_id")
    columns = ["nr", "note_id", "file", "pos", "note_clean", "note_claim"]
    found = here.select(*columns).unionByName(elsewhere.select(*columns))
    asked = found.select("nr", "note_id", "file", "pos", F.explode("note_claim").alias("word"))
    have = kept.select("note_id", "file", "pos", F.explode(words(F.col("text"))).alias("word"))
    held = asked.join(have, ["note_id", "file", "pos", "word"], "left_semi").groupBy("nr", "file", "pos").agg(F.count("*").alias("held"))
    best = F.max(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "file", "pos", "note_clean")).alias("b")
    return found.join(held, ["nr", "file", "pos"], "left").groupBy("nr").agg(best).select("nr", F.col("b.file").alias("found_file"), "b.note_clean", F.col("b.held").alias("held_note"))


def _indexed(files: DataFrame) -> DataFrame:
    """The nodes and identifiers of the files, written, so that the joins read them and no file is scanned twice."""
    at = f"{shared_folder(files.sparkSession)}/results-{uuid.uuid4().hex}"
    markup.index(files).where(F.col("kind").isin("node", "identifier", "href")).select("file", "start", "kind", "value", "digest").write.parquet(at)
    return files.sparkSession.read.parquet(at)


def _nodes(rows: DataFrame, side: str) -> DataFrame:
    first = rows.where(F.col("kind") == "node").groupBy("file", F.col("value").alias("node")).agg(F.min_by("digest", "start").alias(f"{side}_context"))
    return first


def _node_facts(results: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts of an action's claimed nodes by what the files say of them."""
    of = lambda role: F.transform(_list(F.col(role)), lambda n: F.struct(F.lit(role).alias("role"), n.alias("node")))
    roles = F.concat(of("added"), of("changed"), of("removed"))
    claimed = results.select("nr", "file", F.inline(roles))
    rows = _nodes(before, "old").join(_nodes(after, "new"), ["file", "node"], "full_outer")
    anywhere = rows.groupBy("node").agg(F.max(F.col("old_context").isNotNull()).alias("was"), F.max(F.col("new_context").isNotNull()).alias("is"))
    joined = claimed.join(anywhere, "node", "left").join(rows, ["file", "node"], "left")
    was, now, old, new = F.coalesce("was", F.lit(False)), F.coalesce("is", F.lit(False)), F.col("old_context").isNotNull(), F.col("new_context").isNotNull()
    count = lambda role, c: F.count_if((F.col("role") == role) & c)
    same = old & F.col("old_context").eqNullSafe(F.col("new_context"))
    return joined.groupBy("nr").agg(
        count("added", ~now).alias("added_absent"), count("added", old).alias("added_old"), count("changed", ~now).alias("changed_absent"), count("changed", ~was).alias("changed_unknown"), count("changed", same).alias("changed_same"),
        count("removed", now).alias("removed_present"), count("removed", ~was).alias("removed_unknown"),
        F.count_if(((F.col("role") == "added") & new & ~old) | ((F.col("role") == "changed") & old & new & ~same) | ((F.col("role") == "removed") & old & ~new)).alias("nodes_moved"),
    )


def _targets(results: DataFrame, before: DataFrame, after: DataFrame, lines: DataFrame) -> DataFrame:
    """Whether an action's identifiers, nodes and proof stand in the files and in the changed lines."""
    ids = lambda rows: rows.where(F.col("kind").isin("identifier", "href", "node")).select("file", F.col("value").alias("token"))
    steps = lambda c: F.transform(F.sequence(F.lit(5), F.size(F.split(c, "/"))), lambda n: F.array_join(F.slice(F.split(c, "/"), 1, n), "/"))
    paths = lines.select("file", F.explode(F.flatten(F.transform(F.regexp_extract_all("line", F.lit(r"/us/usc/t\d+[A-Za-z]?/[A-Za-z0-9_./-]+"), F.lit(0)), steps))).alias("token"))
    attributes = lines.select("file", F.explode(F.regexp_extract_all("line", F.lit(r'\bid="([^"]+)"'), F.lit(1))).alias("token"))
    tokens = ids(after).select(F.lit("after").alias("side"), F.lit("").alias("file"), "token").unionByName(paths.unionByName(attributes).select(F.lit("diff").alias("side"), "file", "token"))
    tokens = tokens.unionByName(ids(before).select(F.lit("before").alias("side"), "file", "token")).distinct()

    target = F.coalesce("target", F.lit(""))
    named = F.array_compact(F.array_append(F.regexp_extract_all(target, F.lit(_TARGET), F.lit(0)), F.nullif(F.regexp_extract(target, r"/note/([^/\s]+)", 1), F.lit(""))))
    exact = F.regexp_extract_all(target, F.lit(r"/us/usc/t\d+[A-Za-z]?/s[0-9A-Za-z.-]+(?:/[0-9A-Za-z.-]+)*"), F.lit(0))
    ask = lambda side, file, values, why: F.transform(values, lambda x: F.struct(F.lit(side).alias("side"), file.alias("file"), x.alias("token"), F.lit(why).alias("why")))
    nodes = F.concat(_list(F.col("added")), _list(F.col("changed")), _list(F.col("removed")))
    proof = file_name(F.coalesce("proof.file", F.lit("")))
    asked = F.concat(
        ask("after", F.lit(""), named, "target"), ask("diff", F.col("file"), F.array_distinct(F.concat(exact, nodes)), "anchor"),
        ask("before", proof, F.array_compact(F.array("proof.node")), "proof_node"), ask("before", proof, F.array_compact(F.array("proof.identifier")), "proof_identifier"),
    )
    found = results.select("nr", F.inline(asked)).join(tokens, ["side", "file", "token"], "left_semi")
    any_of = lambda why: F.count_if(F.col("why") == why).alias(f"n_{why}")
    return found.groupBy("nr").agg(*[any_of(w) for w in ("target", "anchor", "proof_node", "proof_identifier")])


def _claims(results: DataFrame, before: DataFrame, after: DataFrame, lines: DataFrame) -> DataFrame:
    """How many of an action's claimed words its file held before and after, and its changed lines hold."""
    held = lambda df, side, key, c: df.select(F.lit(side).alias("side"), F.col(key).alias("key"), F.explode(words(F.col(c))).alias("word"))
    parts = [held(before, "before", "file", "content"), held(after, "after", "file", "content"), held(lines, "diff", "file", "line")]
    have = reduce(DataFrame.unionByName, parts).distinct()
    ask = lambda side, key, values: F.transform(values, lambda w: F.struct(F.lit(side).alias("side"), F.col(key).alias("key"), w.alias("word")))
    asked = F.concat(*[ask(side, "file", F.col("claim")) for side in ("before", "after", "diff")])
    found = results.select("nr", F.inline(asked)).join(have, ["side", "key", "word"], "left_semi")
    return found.groupBy("nr").agg(*[F.count_if(F.col("side") == s).alias(f"held_{s}") for s in ("before", "after", "diff")])


def result_rows(results: DataFrame, plan: DataFrame, before: DataFrame, after: DataFrame, board: str) -> DataFrame:
    """Results with their plan row and all that the files say of them."""
    tidy = lambda df: df.select(file_name(F.col("file")).alias("file"), F.coalesce("content", F.lit("")).alias("content"))
    before, after = tidy(before), tidy(after)
    old, new, lines, notes = _indexed(before), _indexed(after), changed_lines(before, after), notes_of(after)
    rest = [F.col(c).alias(n) for c, n in (("action_type", "action"), ("treatment", "treatment"), ("identifier", "planned_identifier"), ("node_ids", "node_ids"))]
    first = plan.groupBy("action_id").agg(F.min(F.struct(*rest)).alias("p")).select("action_id", "p.*", F.lit(True).alias("planned"))
    first_node = F.get("node_ids", F.lit(0))
    sample = lambda c: F.slice(words(c), 1, SAMPLE)
    rows = results.withColumn("file", file_name(F.col("file"))).join(first, "action_id", "left")
    rows = rows.withColumn("target", F.when(_said("identifier"), F.col("identifier")).otherwise(F.col("planned_identifier"))).withColumn("proved_note", F.when(_said("note_id"), F.col("note_id")).otherwise(first_node))
    rows = rows.withColumn("claim", sample(F.col("said"))).withColumn("note_claim", sample(F.when(_said("excerpt"), F.col("excerpt")).otherwise(F.col("said"))))
    touched = lines.select("file").distinct().withColumn("touched", F.lit(True))
    facts = rows.join(touched, "file", "left")
    for more in (_noted(rows, notes, board), _node_facts(rows, old, new), _targets(rows, old, new, lines), _claims(rows, before, after, lines)):
        facts = facts.join(more, "nr", "left")
    counts = [c for c in facts.columns if c.startswith(("added_", "changed_", "removed_", "nodes_", "n_", "held_"))]
    return facts.na.fill(0, counts)


def _claimed(held: str, claim: str = "claim", least: int = 6) -> Column:
    """A claim of fewer words than `least` must be held whole, a longer one by so many words; none isn't held."""
    n = F.size(claim)
    return (n > 0) & (F.col(held) >= F.least(n, F.lit(least)))


def rules(base: str) -> dict[str, Column]:
    planned, status, action = F.col("planned").isNotNull(), F.coalesce("status", F.lit("")), F.coalesce("action", F.lit(""))
    runs, inserts = planned & action.isin(*EXECUTABLE), action.isin(*INSERTS)
    other, applied, late = planned & ~action.isin(*EXECUTABLE), status == "applied", status == "superseded-by-later-action"
    done, noting = status.isin("applied", "already-satisfied-with-baseline-proof"), action.isin(*NOTES) | F.coalesce(F.col("treatment").contains("note"), F.lit(False))
    none = lambda c: ~planned | (F.col(c) == 0)
    when = lambda applies, holds: ~applies | F.coalesce(holds, F.lit(False))
    target = F.coalesce("target", F.lit(""))
    exists = (F.col("n_target") > 0) | (target != "") & ~target.rlike(_TARGET)
    parts = F.filter(F.transform(F.split(target, "[|;]"), F.trim), lambda x: x != "")
    root = (F.size(parts) == 0) | F.exists(parts, lambda x: x.rlike(r"^/us/usc/t\d+[A-Za-z]?$"))
    anchored = (F.col("n_anchor") > 0) | _claimed("held_diff", least=4) | (F.col("nodes_moved") > 0) | (_claimed("held_after") & ~_claimed("held_before"))
    proof = reduce(Column.__and__, [_said(f"proof.{c}") for c in ("file", "node", "identifier", "existing", "comparison")]) & (F.col("proof.base") == base) & (F.col("n_proof_node") > 0) & (F.col("n_proof_identifier") > 0)
    told = F.lower(F.concat_ws(" ", "validation", "explanation", "contents"))
    said = F.lower(F.coalesce("said", F.lit("")))
    found = applied & F.col("found_file").isNotNull()
    at = ~_said("note_file") | (file_name(F.col("note_file")) == F.col("found_file"))
    clean, holds = F.col("note_clean"), _claimed("held_note", "note_claim")
    return {
        "planned": planned, "added nodes present": none("added_absent"), "added nodes new": none("added_old"), "changed nodes present": none("changed_absent"), "changed nodes known": none("changed_unknown"), "changed nodes differ": none("changed_same"),
        "removed nodes gone": none("removed_present"), "removed nodes known": none("removed_unknown"),
        "executable status valid": when(runs, status.isin(*EXECUTED)), "satisfied has proof": when(runs & (status == "already-satisfied-with-baseline-proof"), proof), "applied file changed": when(runs & applied, F.col("touched")),
        "applied has its change": when(runs & applied, anchored), "insertion names a section": when(runs & inserts, ~root), "completed target exists": when(runs & done, exists), "completed has text": when(runs & done, _said("said")),
        "final file holds text": when(runs & applied & _said("said"), _claimed("held_after")), "text is executable": when(runs & applied, ~reduce(Column.__or__, [said.contains(w) for w in NO_TEXT])), "completed has credit": when(runs & done, _said("credit")),
        "completed has amendment note": when(runs & done, _said("amendment")), "insertion has contents entry": when(runs & inserts & done, _said("contents") & ~F.col("contents").rlike(r"(?i)\bno toc change\b")),
        "supersession explained": when(runs & late, told.contains("superseded") | told.contains("later")), **{f"supersession has {c}": when(runs & late, _said(f"later.{c}")) for c in ("action", "law", "target", "chronology", "proof")},
        "superseded target exists": when(runs & late, exists), "other status valid": when(other, status.isin(*DOCUMENTED)), "no action fits plan": when(other & (status == "documented-no-code-action"), action == "no Code action"),
        "no action explained": when(other & (status == "documented-no-code-action"), _said("explanation")), "note found": when(other & noting, found), "note file agrees": when(other & noting & found, at),
        "note clean": when(other & noting & found & at, clean), "note holds text": when(other & noting & found & at & clean, holds), "note has its change": when(other & noting & found & at & clean & holds, anchored),
    }


def file_rules(board: str) -> dict[str, Column]:
    return {"no board link": ~F.col("content").contains(board), "no false limitation": ~F.col("content").contains(LIMITATION)}


def note_rules(board: str) -> dict[str, Column]:
    low = F.lower("text")
    return {
        "no full text": ~F.col("text").contains('<quotedContent origin="/us/pl/'), "no internal wording": ~reduce(Column.__or__, [low.contains(t.lower()) for t in (*INTERNAL, board)]), "no local path": ~F.col("text").rlike(r"[A-Za-z]:\\"),
    }


def failures(results: DataFrame, plan: DataFrame, before: DataFrame, after: DataFrame, base: str, board: str) -> DataFrame:
    """(scope, subject, rule) of all broken rules: of results, planned actions without one, files and notes."""

    def broken(rows: DataFrame, scope: str, subject: str, held: dict[str, Column]) -> DataFrame:
        names = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in held.items()]))
        return rows.select(F.lit(scope).alias("scope"), F.col(subject).alias("subject"), F.explode(names).alias("rule"))

    missing = plan.select("action_id").distinct().join(results, "action_id", "left_anti").select(F.lit("plan").alias("scope"), F.col("action_id").alias("subject"), F.lit("has a result").alias("rule"))
    every = [broken(result_rows(results, plan, before, after, board), "result", "action_id", rules(base)), missing, broken(after, "file", "file", file_rules(board)), broken(notes_of(after), "note", "note_id", note_rules(board))]
    return reduce(DataFrame.unionByName, every)


def catalogue(base: str = "", board: str = "-") -> dict[str, Sequence[str]]:
    return {"result": list(rules(base)), "plan": ["has a result"], "file": list(file_rules(board)), "note": list(note_rules(board))}


def gate(broken: DataFrame) -> DataFrame:
    """(scope, rule, broken, passed) of every rule, broken or not."""
    named = broken.sparkSession.createDataFrame([(s, r) for s, held in catalogue().items() for r in held], "scope string, rule string")
    counts = broken.groupBy("scope", "rule").agg(F.count("*").alias("n"))
    return named.join(counts, ["scope", "rule"], "left").select("scope", "rule", F.coalesce("n", F.lit(0)).alias("broken"), F.col("n").isNull().alias("passed"))
