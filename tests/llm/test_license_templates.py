"""Template automata against every expansion of their templates."""

import itertools
import re

import numpy as np
import pytest

pytest.importorskip("statuta.llm")

from statuta.llm import licenses  # noqa: E402


def expansions(template):
    """Every accepted run of words; None stands for any word. Optional regions don't nest here."""
    choices = []
    for part in re.findall(r"<<opt>>.*?<</opt>>|<<var:\d+-\d+>>|\S+", template):
        if part.startswith("<<opt>>"):
            choices.append([[], part.removeprefix("<<opt>>").removesuffix("<</opt>>").split()])
        elif m := re.fullmatch(r"<<var:(\d+)-(\d+)>>", part):
            choices.append([[None] * k for k in range(int(m[1]), int(m[2]) + 1)])
        else:
            choices.append([[part]])
    return [list(itertools.chain(*x)) for x in itertools.product(*choices)]


def holds(words, run):
    return bool(run) and any(all(w in (None, words[i + k]) for k, w in enumerate(run)) for i in range(len(words) - len(run) + 1))


def test_labels_of_templates(spark):
    draw = np.random.default_rng(23)
    letters = list("abcd")
    some = lambda n: " ".join(draw.choice(letters, n))
    templates = [("wtfpl", "under the wtfpl terms"), ("open", "<<var:1-2>> a b"), ("loose", "<<opt>>a b<</opt>> <<var:0-1>> c d")]
    for k in range(12):
        templates.append((f"t{k}", f"{some(2)} <<opt>>{some(int(draw.integers(1, 3)))}<</opt>> {some(1)} <<var:{draw.integers(0, 2)}-{draw.integers(2, 4)}>> {some(2)}"))
    rows = [(i, some(int(draw.integers(0, 14)))) for i in range(300)] + [(900, "Distributed UNDER the\nWTFPL, terms!"), (901, "a" * 50_000), (902, "a b " * 20_000), (903, None), (904, "éunder the wtfpl terms"), (905, "cc BY")]
    want = {}
    runs = {label: expansions(t) for label, t in templates}
    for i, text in rows:
        words = licenses.WORD.findall((text or "").translate(licenses.AZ))[:40]  # rows over that repeat themselves
        want[i] = ",".join(sorted([x for x, r in runs.items() if any(holds(words, run) for run in r)] + (["cc-by"] if i == 905 else [])))
    got = {r.doc_id: r.labels for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    assert got == want and want[900] == "wtfpl" and len(set(want.values())) > 20
    closed = [templates[0]]
    assert licenses.hint(closed) and licenses.hint(templates)
    assert {r.doc_id for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string"), closed).where("labels = 'wtfpl'").collect()} == {900}


def test_whole_licence_texts():
    automata, starts = licenses.compiled(licenses.TEMPLATES)
    for label, template in licenses.TEMPLATES:
        if "<<var>>" in label:
            continue
        for pick in (0, -1):
            run = [w or "some" for w in expansions(template)[pick]]
            assert label in licenses.scan(["x", *run, "y"], automata, starts)[2]
            assert re.search(licenses.hint([(label, template)]).replace(r"\x{80}-\x{10ffff}", "\x80-\U0010ffff"), " ".join(run))
            if len(run) > 30:  # a mandatory word changed
                wrong = [*run[: len(run) // 2], "other", *run[len(run) // 2 + 1 :]]
                assert licenses.Automaton(template).longest(wrong, 0) < len(run)
