"""Pipeline stages on tables with nulls, repeats, no rows and columns of any name."""

import numpy as np
import pytest

pytest.importorskip("statuta.llm")

NAMES = ["id", "row", "ka", "kb", "n_bytes", "short", "kept", "first_id", "kept_id", "leak_id", "good_id", "left", "component_id", "bucket", "spans", "part", "ids", "tie", "f"]
SF = "/root/testdata/sf0.001"


def sentence(seed, n=40):
    draw = np.random.default_rng(seed)
    return " ".join("".join(draw.choice(list("abcdefgh"), 5)) for _ in range(n)) + "."


def rows():
    some = [(i, sentence(i)) for i in range(40)] + [(100, None), (101, ""), (None, sentence(900)), (None, None), (3, sentence(3)), (200, sentence(3)), (201, sentence(3) + " more"), (5, sentence(77))]
    return [(i, t, "en", "s", len(t) if t else 0) for i, t in some]


@pytest.fixture(scope="module")
def tables(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    return df, df.select("*", *[F.lit(f"x {c}").alias(c) for c in NAMES])


@pytest.mark.parametrize("k", range(4))
def test_stage(spark, tables, k):
    import corpus_pipeline

    plain, clashing = tables
    _, stage = corpus_pipeline.STAGES[k]
    want = stage(spark, plain, SF)
    assert want.columns == plain.columns
    got = stage(spark, clashing, SF)
    assert got.columns == clashing.columns
    key = lambda rows: sorted((tuple(r)[:5] for r in rows), key=repr)
    assert key(want.collect()) == key(got.collect())
    assert all(r[c] == f"x {c}" for r in got.collect() for c in NAMES)
    assert stage(spark, clashing.limit(0), SF).count() == 0


def test_packing_stage(spark, tables):
    import corpus_pipeline

    _, stage = corpus_pipeline.STAGES[4]
    assert sorted(map(tuple, stage(spark, tables[0], SF).collect()), key=repr) == sorted(map(tuple, stage(spark, tables[1], SF).collect()), key=repr)
    assert stage(spark, tables[1].limit(0), SF).count() == 0


def test_near_duplicates_that_go(spark, tables):
    import corpus_pipeline

    left = [r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, tables[0], SF).collect()]
    assert 200 not in left and 201 not in left and left.count(3) == 2 and left.count(None) == 2 and left.count(5) == 2 and 101 in left
