"""The stages on the smallest tables."""

import pytest

pytest.importorskip("statuta.llm")

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline
    from statuta.llm import decontaminate, near_dup, substrings
    from statuta.llm.common import table, written

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "suffix-array dedup", "benchmark decontamination", "packing"]
    docs = table(spark, SF, "documents")
    sizes, frames = [docs.count()], []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
        frames.append(docs)
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] // 2
    assert near_dup.near_duplicates(frames[1], width=5).where("not kept").count() == 0
    assert substrings.deduplicated(frames[1]).agg({"n_removed": "sum"}).first()[0] >= 0
    assert decontaminate.leaks(frames[3], table(spark, SF, "benchmark")).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == sizes[-1]
    full = pieces.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert sorted(r[1] for r in full)[1:] == [1024] * (len(full) - 1)


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}
