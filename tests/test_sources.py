"""Sources, sinks and streams on small files."""

import json

import pytest

from pyspark.sql import functions as F

from statuta.sources import boards
from statuta.streaming import intake, keyed

BOARD = {
    "lists": [{"id": "l1", "name": "Current Laws"}, {"id": "l2", "name": "Repealed Laws"}],
    "cards": [
        {"id": "c1", "shortLink": "s1", "name": "Public Law 41-7 | Fair Pay Act", "desc": "Text", "idList": "l1", "labels": [{"name": " "}, {"name": "Signed"}], "closed": False, "dateLastActivity": "2024-05-01T00:00:00Z", "attachments": [{"id": "a", "name": "bill", "url": "https://x.test/a.pdf"}], "url": ""},
        {"id": "c2", "shortLink": "s2", "name": "Public Law 41-7", "desc": "", "idList": "l2", "labels": [], "closed": False, "dateLastActivity": "2024-06-01T00:00:00Z", "attachments": [], "url": "https://x.test/c2"},
        {"id": "c3", "shortLink": "s3", "name": "Idea", "desc": None, "idList": "none", "labels": [], "closed": True, "dateLastActivity": None, "attachments": [], "url": None},
    ],
    "actions": [{"type": "addAttachmentToCard", "date": "2024", "data": {"card": {"id": "c1"}, "attachment": {"id": "b", "name": "late", "url": "https://x.test/b.txt"}}}, {"type": "other", "date": "2024", "data": {"card": {"id": "c1"}, "attachment": None}}],
}
TITLE = """<?xml version="1.0"?><uscDoc xmlns="http://xml.house.gov/schemas/uslm/1.0"><title identifier="/us/usc/t5"><num>5</num><heading>Title five</heading><chapter identifier="/us/usc/t5/ch1"><section identifier="/us/usc/t5/s1"><num>1</num><heading>Oath <i>of</i> office</heading></section><section identifier="/us/usc/t5/s2"><num>2</num><heading>[Reserved]</heading></section></chapter></title></uscDoc>"""


def test_board(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps(BOARD))
    found = boards.board(spark, str(tmp_path / "b.json"))
    rows = {r.card_id: r for r in boards.cards_from_board(found).collect()}
    assert (rows["c1"].list_name, rows["c1"].label, rows["c1"].url) == ("Current Laws", "Signed", "https://example.test/c/s1")
    assert (rows["c3"].list_name, rows["c3"].description, rows["c3"].last_activity) == ("UNKNOWN", "", None)
    assert [(r.card_id, r.name, r.source) for r in boards.board_attachments(found).orderBy("ordinal").collect()] == [("c1", "bill", "board"), ("c1", "late", "action")]


def test_marked_up_titles(spark, tmp_path):
    (tmp_path / "usc05.xml").write_text(TITLE)
    got = [(r.identifier, r.heading, r.reserved) for r in boards.sections(spark, str(tmp_path / "usc05.xml")).orderBy("identifier").collect()]
    assert got[1] == ("/us/usc/t5/s2", "[Reserved]", True) and got[0][0] == "/us/usc/t5/s1" and "office" in got[0][1]
    nodes = boards.structure(spark, str(tmp_path / "usc05.xml")).orderBy("node").collect()
    assert [(n.type, n.parent, n.depth) for n in nodes] == [("title", None, 0), ("chapter", 0, 1), ("section", 1, 2), ("section", 1, 2)]
    (tmp_path / "usc42.xml").write_text("version https://git-lfs.github.com/spec/v1\noid sha256:0\nsize 1\n")
    meta = {r.file: r for r in boards.title_metadata(spark, str(tmp_path / "*.xml")).collect()}
    assert (meta["usc42.xml"].kind, meta["usc42.xml"].identifier) == ("pointer", None)
    assert (meta["usc05.xml"].kind, meta["usc05.xml"].identifier, meta["usc05.xml"].heading) == ("text", "/us/usc/t5", "Title five")


def test_reports_of_any_shape(spark, tmp_path):
    (tmp_path / "review-01.json").write_text(json.dumps({"laws": [{"law_id": "PL-001-002", "status": " ", "legal_status": "active", "extra": [1]}, {"law": "PL-001-003", "code_treatment": "note"}]}))
    (tmp_path / "repair-02-3.json").write_text("{not json")
    found = boards.reports(spark, str(tmp_path))
    assert {r.file: r.group_index for r in found.select("file", "group_index").collect()} == {"review-01.json": 1, "repair-02-3.json": 1023}
    laws = sorted((r.law_id, r.status, r.treatment) for r in boards.report_laws(found).collect())
    assert laws == [("PL-001-002", "active", ""), ("PL-001-003", "", "note")]


def test_law_folders(spark, tmp_path):
    (tmp_path / "PL-001-002").mkdir()
    (tmp_path / "PL-001-002" / "text.txt").write_text("abc")
    row = boards.law_files(spark, str(tmp_path)).first()
    assert (row.law_id, row.file, row.format, row.size) == ("PL-001-002", "text.txt", "txt", 3)
    assert row.sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_a_failing_check_publishes_nothing(spark, tmp_path):
    at = str(tmp_path / "site")
    boards.staged_publish(spark.range(3), at, {"rows": lambda df: 0})
    with pytest.raises(ValueError):
        boards.staged_publish(spark.range(5), at, {"rows": lambda df: df.count()})
    assert boards.published(spark, at).count() == 3


def test_intake_keeps_the_best_card(spark, tmp_path):
    exports, target = tmp_path / "in", str(tmp_path / "cards")
    exports.mkdir()
    (exports / "one.json").write_text(json.dumps(BOARD))
    intake.intake(spark, str(exports), target, str(tmp_path / "ck")).awaitTermination()
    later = json.loads(json.dumps(BOARD))
    later["cards"] = [c | {"desc": "A longer text than before"} for c in later["cards"][:1]]
    (exports / "two.json").write_text(json.dumps(later))
    intake.intake(spark, str(exports), target, str(tmp_path / "ck")).awaitTermination()
    rows = keyed.current(spark, target).collect()
    assert [(r.law_id, r.card_id, r.description, r.n_attachments, r.duplicates) for r in rows] == [("PL-041-007", "c1", "A longer text than before", 2, 1)]

    # A lesser card of a later export doesn't displace the stored one; nor does it after a new checkpoint that begins with what was seen.
    lesser = json.loads(json.dumps(BOARD))
    lesser["cards"] = [c | {"id": "c9"} for c in lesser["cards"][1:2]]
    (exports / "three.json").write_text(json.dumps(lesser))
    intake.intake(spark, str(exports), target, str(tmp_path / "ck")).awaitTermination()
    assert [(r.card_id, r.duplicates) for r in keyed.current(spark, target).collect()] == [("c1", 2)]
    seen = keyed.current(spark, target).drop("duplicates")
    fresh = tmp_path / "fresh"
    fresh.mkdir()
    (fresh / "four.json").write_text(json.dumps(lesser))
    intake.intake(spark, str(fresh), str(tmp_path / "again"), str(tmp_path / "ck3"), seen).awaitTermination()
    assert [(r.card_id, r.duplicates) for r in keyed.current(spark, str(tmp_path / "again")).collect()] == [("c1", 1)]


def test_each_comment_is_said_once(spark, tmp_path):
    folder, out = tmp_path / "said", str(tmp_path / "out")
    for n, markers in enumerate((["a", "b", "a", None], ["b", "c"], ["a", "d"])):
        spark.createDataFrame([(m, f"t{n}") for m in markers], "marker string, text string").coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema("marker string, text string").parquet(str(folder))
        keyed.say_once(stream, out, str(tmp_path / f"ck{n // 2}")).awaitTermination()  # the last turn has a new checkpoint and reads all again
    assert sorted((r.marker, r.text) for r in keyed.said(spark, out).collect()) == [("a", "t0"), ("b", "t0"), ("c", "t1"), ("d", "t2")]


def test_windowed_counts_of_a_stream(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "user_id")
    rows.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev"))
    q = intake.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg({"n": "sum"}).first()[0] == rows.count()
