"""Lloyd's rounds against a plain version in Python integers."""

import hashlib
import math

import pytest

pytest.importorskip("statuta.llm")

from statuta.llm import centroids  # noqa: E402

D = 6
SCHEMA = "vec_id long, embedding array<float>, chunk string, block long, cluster string"


def brute(rows, k, rounds, d=D):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [list(q) for _, q in sorted(kept, key=name)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda q: min(range(len(centres)), key=lambda j: (far(q, centres[j]), j))
    for _ in range(rounds):
        groups = [[] for _ in centres]
        for _, q in kept:
            groups[near(q)].append(q)
        centres = [[sum(c) // len(g) for c in zip(*g)] if g else centres[j] for j, g in enumerate(groups)]
    rows = [(i, near(q), far(q, centres[near(q)])) for i, q in kept]
    return [(i, c, s, sum(x[2] for x in rows if x[1] == c), sum(x[2] for x in rows), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, s in rows]


def vectors(n, seed=0):
    import numpy as np

    draw = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(x)) for x in draw.normal(i % 3, 0.7, D)]) for i in range(n)]


MESSY = [
    *vectors(150), (7, [0.5] * D), (7, [0.5] * D), (None, [1.0] * D), (2**60 + 1, [-1.0] * D), (2**60, [-1.0] * D), (200, None), (201, []), (202, [1.0] * (D - 1)), (203, [1.0] * (D + 1)), (204, [None, *[1.0] * (D - 1)]),
    (205, [math.nan, *[1.0] * (D - 1)]), (206, [math.inf, *[1.0] * (D - 1)]), (207, [-0.00001] * D), *[(300 + i, [0.25] * D) for i in range(90)],
]


@pytest.mark.parametrize("width", [4, 6, 1])
def test_equals_plain_rounds(spark, width):
    df = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in MESSY], SCHEMA).repartition(3)
    got = [tuple(r) for r in centroids.clusters(df, k=5, rounds=4, components=D, width=width).collect()]
    assert sorted(got, key=repr) == sorted(brute(MESSY, 5, 4), key=repr)


def test_chunks_of_few_vectors_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in MESSY], SCHEMA).repartition(5)
    monkeypatch.setattr(centroids, "CHUNK", 7)
    got = [tuple(r) for r in centroids.clusters(df, k=3, rounds=2, components=D, width=4).collect()]
    assert sorted(got, key=repr) == sorted(brute(MESSY, 3, 2), key=repr)


def test_few_vectors_and_none(spark):
    two = [(1, [0.0] * D), (2, [1.0] * D)]
    frame = lambda rows: spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA)
    assert sorted(tuple(r) for r in centroids.clusters(frame(two), components=D).collect()) == sorted(brute(two, 8, 10))
    assert centroids.clusters(frame([]), components=D).count() == 0
    assert centroids.clusters(frame([(1, None), (2, [1.0])]), components=D).count() == 0
    same = [(i, [0.5] * D) for i in range(20)]  # all centroids are equal: the first takes all, the others stay
    assert sorted(tuple(r) for r in centroids.clusters(frame(same), components=D).collect()) == sorted(brute(same, 8, 10))


def test_components_that_pass_64_bits_are_refused(spark):
    with pytest.raises(Exception, match="64 bits"):
        centroids.clusters(spark.createDataFrame([(1, [1e9] * D, "x", 1, "y")], SCHEMA), components=D).collect()
