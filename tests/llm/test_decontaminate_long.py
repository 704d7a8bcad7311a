"""Benchmark decontamination of very long texts that repeat an item."""

import time

import numpy as np
import pytest

pytest.importorskip("statuta.llm")

from statuta.llm import decontaminate  # noqa: E402


def test_long_text_of_repeated_items(spark):
    draw = np.random.default_rng(5)
    item = [f"w{x}" for x in draw.integers(0, 5000, 1000)]
    short = [f"s{x}" for x in draw.integers(0, 300, 40)]
    foreign = [f"f{x}" for x in draw.integers(0, 9000, 200_000)]
    long_text = " ".join(item * 400 + foreign + short * 3)  # 600,120 words, over 3 MB
    docs = [(1, long_text), (2, " ".join(foreign)), (3, " ".join(foreign[:50_000] + item[100:] + foreign[50_000:])), (None, " ".join(short)), (4, "")]
    started = time.time()
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item)), (8, " ".join(short))], "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): (round(r.similarity, 6), r.word_start, r.n_windows) for r in found}
    assert set(got) == {(1, 7), (1, 8), (3, 7), (None, 8)}
    # A repetition has 996 starts with a shingle of the item; at the other four the window that starts further right is made.
    assert got[1, 7][:2] == (1.0, 0) and got[1, 7][2] >= 996 * 399 + 1
    assert got[1, 8][0] == 1.0 and got[1, 8][1] == 600_000
    assert got[None, 8] == (1.0, 0, 1)
    assert 0.8 <= got[3, 7][0] < 0.95
    assert time.time() - started < 300
