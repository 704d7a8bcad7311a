"""The numbered operators against brute force on small tables with nulls, empties, ties, repeats, long
texts and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("statuta.llm")

from statuta.llm import decontaminate, fingerprint, html, licenses, near_dup, packing, quality, substrings, suffix_tree, token_output  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, key string, bucket int, block long, anchors string"


def sentence(seed: int, n: int) -> str:
    draw = np.random.default_rng(seed)
    return " ".join("".join(draw.choice(list("abcdefgh"), 4)) for _ in range(n)) + "."


LONG = "\n".join(sentence(100 + i, 12) for i in range(400))
TEXTS = [
    (1, "The quick brown Fox jumps. Over the lazy dog!\nAgain and again."), (2, ""), (3, None), (4, "one two"), (5, sentence(1, 60)), (6, sentence(1, 60)), (7, sentence(1, 58) + " zzzz yyyy."),
    (8, LONG), (9, sentence(2, 40) + "\n" + sentence(1, 60)), (10, "É" * 150), (11, "É" * 150 + " x"), (12, "ab" * 200), (13, "same\n" * 90), (14, " \t\n"), (16, "tail 'quoted' it's, don't; A.B.C  x"), (15, LONG[:3000] + " end"),
]
REPEATED = [*TEXTS, (5, sentence(1, 60)), (None, "no id " + sentence(3, 30)), (20, "One Two")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "k", 1, 2, "a") for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame([(i, t, "k", 1, 2, "a") for i, t in REPEATED], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(rows):
    return sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


# 1 -----------------------------------------------------------------------------------------------
def test_fingerprints(docs):
    rows = ordered(TEXTS)
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    assert len(got) == len(rows)

    def near(a, b):
        x, y = Counter(fingerprint.paragraphs(a)), Counter(fingerprint.paragraphs(b))
        return 1.0 if not x and not y else sum((x & y).values()) / sum((x | y).values())

    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        changed = text[: len(text) - len(text) // 4] + after[: len(text) // 4] if len(text) >= 4 else text
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_edited == pytest.approx(near(text, changed)) and r.near_next == pytest.approx(near(text, after))
    assert got[5].fingerprint == got[6].fingerprint != got[7].fingerprint
    assert got[2].fingerprint == got[3].fingerprint


def test_fingerprints_of_messy_and_empty_tables(messy, empty, spark):
    assert fingerprint.fingerprints(messy).count() == len(REPEATED)
    assert fingerprint.fingerprints(empty).count() == 0
    alone = fingerprint.fingerprints(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0


def test_peeling_recovers_many_differences():
    keys = [np.unique(np.random.default_rng(s).integers(0, 1 << 63, 3000, dtype=np.uint64)) for s in (1, 2)]
    shared = np.random.default_rng(3).integers(0, 1 << 63, 500, dtype=np.uint64)
    left, right = np.concatenate((keys[0], shared)), np.concatenate((keys[1], shared))
    at = lambda x: np.array([0, len(x)])
    assert fingerprint.differences((left, at(left)), (right, at(right)))[0] == len(keys[0]) + len(keys[1])


# 2 -----------------------------------------------------------------------------------------------
def brute_scores(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = [(i, [*WORD.findall((t or "").translate(AZ)), "\n"]) for i, t in rows]
    train = [w for i, w in tokens if not held(i)]
    c = Counter(x for w in train for x in w)
    pair, triple = Counter(p for w in train for p in zip(w, w[1:])), Counter(p for w in train for p in zip(w, w[1:], w[2:]))
    floor, least, gain, k = sum(c.values()) + 0.5 * (len(c) + 1), suffix_tree.LEAST_COUNT, suffix_tree.LEAST_GAIN, suffix_tree.SMOOTH
    low = lambda a: max(c[a] - 0.5, 0.5) / floor
    one = lambda a, b: (max(pair[a, b] - 1, 0) + k * low(b)) / (max(c[a] - 1, 0) + k)
    g1, g2 = Counter(), Counter()
    for (a, b), n in pair.items():
        g1[a] += n * (math.log(one(a, b)) - math.log(low(b))) if c[a] >= least else 0
    for (a, b, e), n in triple.items():
        m = pair[a, b]
        g2[a, b] += n * (math.log((n - 1 + k * one(b, e)) / (m - 1 + k)) - math.log(one(b, e))) if m >= least else 0
    out = []
    for i, w in tokens:
        score = 0.0
        for j, x in enumerate(w):
            p = (c[x] + 0.5) / floor
            if j and c[w[j - 1]] >= least and g1[w[j - 1]] >= gain:
                p = (pair[w[j - 1], x] + k * p) / (c[w[j - 1]] + k)
            if j > 1 and pair[w[j - 2], w[j - 1]] >= least and g2[w[j - 2], w[j - 1]] >= gain:
                p = (triple[w[j - 2], w[j - 1], x] + k * p) / (pair[w[j - 2], w[j - 1]] + k)
            score += math.log10(p)
        out.append((i, held(i), len(w), sum(c[x] > 0 for x in w), sum(c.values()), round(sum(math.log10((c[x] + 0.5) / floor) for x in w), 6), round(score, 6)))
    return sorted(out, key=repr)


def test_suffix_tree(messy, empty):
    got = [(*tuple(r)[:5], round(r.base_score, 6), round(r.score, 6)) for r in suffix_tree.scored(messy).collect()]
    assert sorted(got, key=repr) == brute_scores(REPEATED)
    assert suffix_tree.scored(empty).count() == 0


def test_next_symbols_sum_to_one():
    c, k = Counter("aababbbac"), 2.0
    root = {x: n / 9 for x, n in c.items()}
    seen = Counter("aab")
    assert sum((seen[x] + k * root[x]) / (3 + k) for x in root) == pytest.approx(1)


# 3 -----------------------------------------------------------------------------------------------
def test_decontamination(spark, empty):
    item, other = sentence(50, 30), sentence(51, 12)
    near = item.split()
    near[29] = "changed"
    far = item.split()
    far[::6] = ["x"] * 5
    rows = [(1, "before " + item + " after"), (2, " ".join(near)), (3, "a b " + " ".join(far)), (4, sentence(52, 400) + " " + other.upper()), (5, None), (6, ""), (None, item), (7, "two words"), (1, "again"), (8, sentence(53, 9000))]
    items = spark.createDataFrame([(1, item), (2, other), (3, None), (4, ""), (5, "two words")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert set(found) == {(1, 1), (2, 1), (4, 2), (None, 1), (7, 5)}
    assert found[1, 1].similarity == 1 or found[1, 1].similarity == pytest.approx(1)
    assert (found[1, 1].word_start, found[1, 1].n_words, found[4, 2].word_start) == (1, 30, 400)
    assert found[2, 1].similarity == pytest.approx(25 / 27)
    assert decontaminate.leaks(empty, items).count() == 0 and decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items.limit(0)).count() == 0


def test_simhash_blocks_find_everything_within_the_radius():
    masks = set(decontaminate.near_values())
    draw = np.random.default_rng(5)
    for _ in range(300):
        flips = draw.choice(64, decontaminate.RADIUS, replace=False)
        blocks = [sum(1 << int(f % 8) for f in flips if f // 8 == j) for j in range(8)]
        assert any(b in masks for b in blocks)


# 4 -----------------------------------------------------------------------------------------------
def test_licenses(spark, empty, messy):
    rows = [
        (1, "All Rights Reserved. all rights reserved"), (2, "Licensed under CC BY-NC 4.0."), (3, "x licensed under the Apache License, Version 2.0!"), (4, "This work is licensed under the GNU General Public License, version 3."),
        (5, "Released under the MIT Licence"), (6, "Released under the MIT License."), (7, None), (8, "general public licenses; cc, by"), (9, "licensed under the gnu affero general public license version 3"), (10, "ccé by"),
    ]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: (r.base_labels, r.labels, r.score) for i, r in got.items()} == {
        1: ("reserved", "reserved", 0.6), 2: ("cc-by", "cc-by,cc-by-nc", 1.0), 3: ("", "apache-2.0", 1.0), 4: ("gpl", "gpl,gpl-3", 1.0), 5: ("", "", 0.0), 6: ("", "mit", 1.0), 7: ("", "", 0.0), 8: ("cc-by", "cc-by", 0.6), 9: ("gpl", "gpl,gpl-3", 1.0), 10: ("", "", 0.0),
    }
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word) == (6, 2, 0, 3) and got[7].first_word is None
    assert licenses.scanned(messy).count() == len(REPEATED) and licenses.scanned(empty).count() == 0


def test_template_automata():
    a = licenses.Automaton("the <<opt>>very<</opt>> license of <<var:1-2>> says")
    assert a.longest("the license of acme says no".split(), 0) == 5
    assert a.longest("the very license of acme inc says".split(), 0) == 7
    assert a.longest("the license of says".split(), 0) == -1
    assert a.longest("the license of a b c says".split(), 0) == -1


# 5 -----------------------------------------------------------------------------------------------
def test_quality(spark, empty):
    good = [(i, sentence(i, 30) + " And so it was.") for i in range(200)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in sentence(i, 30).split())) for i in range(100)]
    docs = spark.createDataFrame([*good, *bad, (5000, None), (5001, ""), (None, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:150]] + [(i, 0) for i, _ in bad[:70]] + [(3, None), (None, 0), (7, 0), (7, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert all(got[i].predicted == 1 for i, _ in good[150:]) and all(got[i].predicted == 0 for i, _ in bad[70:])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values()) and len(got) == 303
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.7} and quality.classify(empty, labels).count() == 0


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in out) >= 0.97 * len(out) > 0


# 6 -----------------------------------------------------------------------------------------------
def test_html(spark):
    page = lambda body, n: f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/{n}'>Menu {n}</a></li></ul></nav><div class='ad'>Buy {n}</div>{body}<div id='comments'><p>Nice {n}</p></div><footer>Foot</footer></body></html>"
    rows = [
        (1, "http://a.test/1", page("<article><h1>Head &amp; one</h1><p><b>First<br>line\n more<p>Second&#39;s</p><div class='notice'>Cookie</div></article>", 1)),
        (2, "http://a.test/2", page("<article><h1>Two</h1><p>Only</p></article><aside>Side</aside>", 2)), (3, "http://b.test/1", page("<div class='content'><p>In div</p></div>", 3)), (4, None, None), (5, "http://c.test", ""),
        (6, "http://c.test/x", "<p>Bare<p>Two"), (1, "http://a.test/1", page("<article><p>Cut", 1).split("</article>")[0].split("<div id=")[0]),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").select("page_id", "url", "html", "text")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html.extracted(df).collect()))
    assert got == sorted((i, t, len(t)) for i, t in [(1, "Head & one\n\nFirst line more\n\nSecond's"), (2, "Two\n\nOnly"), (3, "In div"), (4, ""), (5, ""), (6, "Bare\n\nTwo"), (1, "Cut")])
    assert html.extracted(df.limit(0)).count() == 0


# 7 -----------------------------------------------------------------------------------------------
def brute_components(rows, width, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(AZ))
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            same_id = rows[a][0] is not None and rows[a][0] == rows[b][0]
            if None not in (rows[a][0], rows[b][0]) and (same_id or (sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]))):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), None if i is None else least[find(k)]) for k, (i, _) in enumerate(rows)), key=repr)


def test_near_duplicates(spark, messy, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(messy).collect()), key=repr)
    assert got == brute_components(REPEATED, 4, 80)
    assert near_dup.near_duplicates(empty).count() == 0


def test_near_duplicates_in_a_crowd(spark):
    draw = np.random.default_rng(11)
    base = sentence(70, 120).split()
    rows = []
    for i in range(250):
        words = list(base)
        for at in draw.choice(120, draw.integers(0, 12), replace=False):
            words[at] = f"w{i}x{at}"
        rows.append((i, " ".join(words)))
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == brute_components(rows, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_setsketch_merges_and_estimates():
    draw = np.random.default_rng(2)
    every = draw.integers(0, 1 << 63, 1500, dtype=np.uint64)
    a, b = np.sort(every[:1200]), np.sort(every[300:])
    regs = near_dup.registers(np.concatenate((a, b)), np.array([0, 1200, 2400]), 512)
    union = near_dup.registers(np.sort(every), np.array([0, 1500]), 512)[0]
    assert (near_dup.merged(regs[0], regs[1]) == union).all()
    assert near_dup.estimate(regs[:1], regs[1:], np.array([1200]), np.array([1200]))[0] == pytest.approx(0.6, abs=0.08)


# 8, 10 -------------------------------------------------------------------------------------------
def encoded(rows, name, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [(i, [*e.ids, end]) for (i, _), e in zip(rows, t.encode_batch([x for _, x in rows], add_special_tokens=False), strict=True)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = [(30, "a  b\tc \n d"), (31, "don't;it's'x , y . <|endoftext|> z"), (32, "naïve café №5 ½ x²"), (33, " lead"), (34, "trail "), (35, "日本 語 text"), (36, "x" * 300), (37, "a,b!!c**d e's'"), (38, "é,a è! é, o̸<a")]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_output(spark, tmp_path, file, messy):
    import public_tokenizers

    rows = ordered([*REPEATED, *ODD])
    df = spark.createDataFrame([(i, t, "k", 1, 2, "a") for i, t in ODD], SCHEMA).union(messy)
    token_output.write_tokens(df, str(tmp_path / "t"), public_tokenizers.path(file), 2)
    read = token_output.read_tokens(spark, str(tmp_path / "t")).join(token_output.shard_starts(spark, str(tmp_path / "t")), ["part", "shard"])
    got = sorted(((r.doc_id, r.shard_start + r.ids_before, r.n_tokens, r.ids_crc32) for r in read.collect()), key=lambda r: r[1])
    want, start = [], 0
    for i, ids in encoded(rows, file, 2):
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    shard = spark.read.parquet(str(tmp_path / "t/shards")).first().asDict()
    dictionary = token_output.read_dictionary(spark, str(tmp_path / "t"))
    assert len(token_output.document(shard, 0, dictionary)) == np.frombuffer(shard["counts"], "<u8")[0]
    with pytest.raises(ValueError):
        token_output.document(shard, 0, dictionary + b"x")


def test_packing(spark, messy, empty):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = ordered([*REPEATED, *ODD])
    df = spark.createDataFrame([(i, t, "k", 1, 2, "a") for i, t in ODD], SCHEMA).union(messy)
    want, start = [], 0
    for i, ids in encoded(rows, "byte_bpe_50k.json", 0):
        at = 0
        while at < len(ids):
            here = (start + at) % 64
            n = min(64 - here, len(ids) - at)
            want.append((i, at, n, crc(ids[at : at + n]), len(ids), (start + at) // 64, here))
            at += n
        start += len(ids)
    assert sorted(map(tuple, packing.pack(df, path, 0, 64).collect()), key=lambda r: r[5:]) == want
    assert packing.pack(empty, path, 0).count() == 0


# 9 -----------------------------------------------------------------------------------------------
def brute_repeats(rows):
    seen, out = set(), []
    done = {}
    for i, t in sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        if (i, t) in done:
            out.append((i, *done[i, t]))
            continue
        data = t.encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            w = data[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        done[i, t] = len(data), sum(gone), sum(1 for k in range(len(data)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()
        out.append((i, *done[i, t]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [300, 1])
def test_repeated_substrings(messy, empty, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    assert sorted(map(tuple, substrings.deduplicated(messy).collect()), key=repr) == brute_repeats(REPEATED)
    assert substrings.deduplicated(empty).count() == 0


def test_suffix_sort():
    data = np.frombuffer(b"banana bandana banana" + b"\0" * 20, np.uint8)
    starts = np.arange(21)
    order, shared = substrings.suffix_sort(data, starts, np.zeros(21, np.int64), 10)
    cut = [data.tobytes()[s : s + 10] for s in starts[order]]
    assert cut == sorted(cut)
    assert all(shared[k] == next((n for n in range(10) if cut[k][n] != cut[k - 1][n]), 10) for k in range(1, 21))
