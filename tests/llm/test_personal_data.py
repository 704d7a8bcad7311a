"""Patterns against `re`, and terms that give entities away against counting over documents."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("statuta.llm")

from statuta.llm import personal_data as pii  # noqa: E402

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, term long, spans string, key string, entity long"


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        found = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append(m.span())
        out[kind] = found
    return out


def own(text):
    raw = np.append(np.frombuffer(text.encode(), np.uint8), np.uint8(0))
    at = lambda i: len(raw[:i].tobytes().decode("utf-8", "ignore"))
    return {k: [(at(a), at(b)) for a, b in s] for k, s in zip(pii.KINDS, pii.base_spans(raw), strict=True)}


def test_patterns_equal_re_on_random_strings():
    draw = random.Random(5)
    for alphabet in ("ab@.-", "19.-", "0123456789 -", "+1 ().-9x", "é+1@a.b-% 25", "4 -.@+a\n"):
        for _ in range(3000):
            text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(0, 40)))
            assert own(text) == base(text), repr(text)


def test_patterns_on_valid_and_failing_values():
    good = "4785 3805-9239 1139"
    text = f"é me.x+y%z@mail-1.example.co.uk, a@b.c@d.e x@y 1.2.3.4.5.6.7.8 256.1.1.1; {good}; {good}0, 4111111111111112, +1 (743) 555-3824. +12 +1 2 +123456789012345678 +1)) 0.0.0.00255 1.2.3.0000256"
    assert own(text) == base(text)
    assert [len(v) for v in base(text).values()] == [2, 3, 1, 1]
    assert own("") == base("") and own("\x00a@b.c\x00") == base("\x00a@b.c\x00")


def test_long_runs_are_linear():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" + "-" * 400_000, "@" * 300_000, "1 " * 300_000, "a@" + "b." * 200_000):
        own(text)


def terms_of(text, spans):
    held = [s for found in spans.values() for s in found]
    low = text.translate(AZ)
    return [(m[0], *m.span()) for m in TERM.finditer(low) if len(m[0].encode()) >= pii.SHORTEST and not any(a < m.end() and m.start() < b for a, b in held)]


def brute(rows):
    n = len(rows)
    docs = [(i, t or "", base(t or "")) for i, t in rows]
    n_c, n_ct, n_t, contexts = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(set)
    for _, text, spans in docs:
        terms = terms_of(text, spans)
        seen = set()
        for t in {t for t, _, _ in terms}:
            n_t[t] += 1
        for k, found in enumerate(spans.values()):
            for a, b in found:
                value = text[a:b].lower() if k < 2 else re.sub("[^0-9]", "", text[a:b])
                left, right = [t for t, _, e in terms if e <= a][-pii.REACH :], [t for t, s, _ in terms if s >= b][: pii.REACH]
                seen.add((k, value))
                for t in set(left + right):
                    contexts[k, value, t].add(tuple(left + right))
                    seen.add((k, value, t))
        for key in seen:
            (n_c if len(key) == 2 else n_ct)[key] += 1
    reveal = {}
    for (k, v, t), c in contexts.items():
        if len(c) >= pii.LEAST and n_c[k, v] < n:
            d = math.log(n * n_ct[k, v, t] / (n_c[k, v] * n_t[t])) / math.log(n / n_c[k, v])
            if d >= pii.DISCLOSE:
                reveal[t] = max(d, reveal.get(t, 0))
    out = []
    for i, text, spans in docs:
        named = [f"{k}:{a}:{b}" for k, s in spans.items() for a, b in s]
        more = [f"term:{a}:{b}" for t, a, b in terms_of(text, spans) if t in reveal]
        out.append((i, *(len(s) for s in spans.values()), hashlib.sha256(",".join(named).encode()).hexdigest(), ",".join(named + more)))
    return sorted(out, key=repr), reveal


def corpus():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randrange(2, 5)))
    some = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, some(30)) for i in range(120)]
    for i in range(12):  # the word Zanzibarist stands beside one address only
        rows.append((200 + i, f"{some(9)} Zanzibarist {some(2)} jo.smith@mail.example.com, {some(12)}"))
    for i in range(8):  # in half of its documents it doesn't
        rows.append((300 + i, f"{some(9)} quantel{i % 2} {'10.1.2.3' if i % 2 else ''} {some(12)} +1 (743) 555-38{10 + i}"))
    rows += [(600 + i, f"{some(3)} b.b@mail.example.com onlybeside {some(9)}") for i in range(4)]  # never elsewhere
    rows += [(400 + i, f"copied rarest 4785380592391139 once more") for i in range(40)]  # copies: one context
    rows += [(500, "only Zanzibarist here"), (501, ""), (502, None), (None, "no id 10.1.2.3"), (503, "10.1.2.3"), (503, "10.1.2.3"), (504, "x " * 150_000 + " a@b.cd " + "y" * 7000)]
    return rows


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_spans_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "SHIPPED", most)
    rows = corpus()
    want, reveal = brute(rows)
    assert "zanzibarist" in reveal and "rarest" not in reveal
    df = spark.createDataFrame([(i, t, 1, "s", "k", 2) for i, t in rows], SCHEMA).repartition(5)
    found = pii.sanitised(df).collect()
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, hashlib.sha256(r.base_spans.encode()).hexdigest(), r.spans) for r in found), key=repr)
    assert got == want
    text = {r.doc_id: r.text for r in found}
    assert text[500] == "only <name> here" and text[503] == "<ip>" and text[0] == rows[0][1] and text[501] == "" and "555" not in text[300]
    assert "Zanzibarist" not in text[200] and "<email>" in text[200] and "<email>  " in text[600]


def test_clean_and_empty_tables(spark):
    clean = spark.createDataFrame([(i, f"clean text number {i}", 1, "s", "k", 2) for i in range(9)], SCHEMA)
    assert {(r.spans, r.n_terms) for r in pii.sanitised(clean).collect()} == {("", 0)}
    assert pii.sanitised(spark.createDataFrame([], SCHEMA)).count() == 0
    everyone = spark.createDataFrame([(i, f"beside {i} 10.1.2.3", 1, "s", "k", 2) for i in range(9)], SCHEMA)  # nothing to reveal
    assert all(r.n_terms == 0 and r.n_ip == 1 for r in pii.sanitised(everyone).collect())
