"""Phrases against counting all n-grams in Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("statuta.llm")

from statuta.llm import collocations as co  # noqa: E402

AZ = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, key string, range long, n long"


def brute(rows, least, longest=5, top=2000, share=100):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if 2 <= len(p) and a >= least}
        dropped = {q[i : i + k] for q, b in candidates.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= share * c[q[i : i + k]]}
        scored = []
        for p, a in candidates.items():
            if p not in dropped:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def texts(seed, n):
    draw = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "city", "éa", "it's", "a-b", "x", "\x00z", *[f"w{i}" for i in range(30)]]
    weights = [20, 15, 8, 8, 6, 5, 3, 2, 2, 2, *[1] * 30]
    rows = []
    for i in range(n):
        w = draw.choices(vocabulary, weights, k=draw.randrange(0, 40))
        text = "".join(x + draw.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", "\x0b", " ; "]) for x in w)
        rows.append((text + (" kind regards from the team." if i % 3 == 0 else ""), draw.choice(["en", "de", None, "und", ""])))
    return rows


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, t, lang, "k", 1, 2) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in co.phrases(df, **how).collect())


MESSY = [*texts(1, 400), (None, "en"), ("", "en"), ("  . ,\n", None), *[("same words again and again here", "fr")] * 30, ("a " * 30_000, "long"), ("b" * 100_000, "long"), ("x. y", "zz")]


def test_equals_counting(spark):
    for least in (6, 20):
        got = run(spark, MESSY, least=least)
        assert got == brute(MESSY, least) and len(got) > 20


def test_top_and_ties_and_share(spark):
    assert run(spark, MESSY, least=4, top=7) == brute(MESSY, 4, top=7)
    assert run(spark, MESSY, least=5, longest=3, share=50) == brute(MESSY, 5, 3, share=50)


def test_small_chunks_filters_and_ranges_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(co, "CHUNK", 2000)
    monkeypatch.setattr(co, "RANGE_WORDS", 16)
    monkeypatch.setattr(co, "FILTER_BITS", 10)  # full filters let everything through
    assert run(spark, MESSY, least=6) == brute(MESSY, 6)


def test_tables_without_phrases(spark):
    assert run(spark, []) == [] == run(spark, [("", None), (None, None), ("one two", "en")])
    assert run(spark, [("one two", "en")], least=1) == [("en", 1, "one two", 1, 1, 1, 2, 2000)]


def test_products_pass_64_bits(spark):
    big = spark.sql("select cast(1000 as decimal(4,0)) * cast(4000000000000 as decimal(17,0)) * cast(9000000000000 as decimal(17,0)) div (cast(5000000000001 as decimal(17,0)) * cast(4000000000000 as decimal(17,0))) as x").first()["x"]
    assert big == 1000 * 4000000000000 * 9000000000000 // (5000000000001 * 4000000000000)


def test_transducers_hold_what_they_were_built_from():
    draw = np.random.default_rng(2)
    for k in (1, 2, 3, 5):
        sequences = np.unique(draw.integers(0, 4, (200, k)) << 61 | draw.integers(0, 3, (200, k)), axis=0) & ((1 << 63) - 1)
        sequences = np.unique(sequences, axis=0)
        counts = draw.integers(1, 9, len(sequences))
        for spread in (0, 1, 4, 7):
            batch = co.automata(sequences, counts, spread)
            parts = list(co.opened(batch))
            back = {tuple(s): c for part, w in parts for s, c in zip(part.tolist(), w.tolist())}
            assert back == {tuple(s): c for s, c in zip(sequences.tolist(), counts.tolist())}
            assert len(set(batch.column("range").to_pylist())) == batch.num_rows
    both = pa.Table.from_batches([co.automata(sequences, counts, 0)] * 3)
    again, sums = co.united(both)
    assert (again == sequences).all() and (sums == 3 * counts).all()
    answer = co._compose(pa.Table.from_batches([co.automata(sequences[::2] + 0, counts[::2], 0)]), both)
    assert answer.column("f").to_pylist() == (3 * counts[::2]).tolist()
