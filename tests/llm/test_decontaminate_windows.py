"""Benchmark decontamination against every window of every text."""

import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("statuta.llm")

from statuta.llm import decontaminate  # noqa: E402


def brute(docs, items, least=0.8):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    runs = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = {}
    for i, text in items:
        own = words(text)
        if not own:
            continue
        width, n = min(5, len(own)), len(own)
        want = runs(own, width)
        for d, doc in docs:
            w = words(doc)
            for s in range(max(0, len(w) - n) + 1):
                got = runs(w[s : s + n], width)
                union = sum((got | want).values())
                similarity = sum((got & want).values()) / union if union else 0
                if similarity >= least:
                    out[d, i] = max(out.get((d, i), 0), round(similarity, 9))
    return out


def test_equals_all_windows(spark):
    draw = np.random.default_rng(17)
    some = lambda n, k=60: [f"w{x}" for x in draw.integers(0, k, n)]
    items = [(i, some(int(n), 4000)) for i, n in enumerate([100, 60, 60, 41, 30, 30, 14, 12, 7, 5, 4, 2, 1])]
    items += [(50, ["again", "and"] * 15), (51, ["x"] * 20), (52, [])]
    docs = []
    for d in range(150):
        text = some(int(draw.integers(0, 50)), 5000)
        for _ in range(draw.integers(1, 4)):
            own = list(items[draw.integers(0, len(items))][1])
            kind = draw.integers(0, 6)
            if kind == 1 and len(own) > 2:  # halves swapped
                half = int(draw.integers(1, len(own)))
                own = own[half:] + own[:half]
            elif kind == 2 and own:  # a word changed
                own[draw.integers(0, len(own))] = "changed"
            elif kind == 3 and own:  # cut at an end
                cut = int(draw.integers(0, 1 + len(own) // 6))
                own = own[cut:] if draw.integers(0, 2) else own[: len(own) - cut]
            elif kind == 4 and own:  # a word put in
                own.insert(int(draw.integers(0, len(own))), "more")
            elif kind == 5:  # of two items, one after the other
                own = own + items[draw.integers(0, len(items))][1]
            text += own + some(int(draw.integers(0, 3)) * int(draw.integers(0, 40)), 5000)
        docs.append((d, " ".join(text)))
    swapped = items[0][1][50:] + items[0][1][:50]
    docs.append((900, " ".join(some(200, 9000) + swapped + some(200, 9000))))
    docs += [(901, " ".join(items[1][1][:55])), (902, " ".join(items[1][1] + items[2][1] + items[1][1])), (903, " ".join(["x"] * 400)), (904, None), (905, "")]
    named = [(i, " ".join(w).upper() if i % 2 else " ".join(w)) for i, w in items]
    want = brute(docs, named)
    assert (900, 0) in want and (901, 1) in want and len(want) > 80
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(named, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found} == want
