"""Span checkers: positives, one negative for each filter, and offsets."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from proselens.operators import checkers

PREMISES = [
    ("The socket is a shared handle, and it stays open for the run, so callers reuse it.", "it"),
    ("The workers are forked early, and they never run alone, so no deadlock can form.", "they"),
]
NOT_PREMISES = [
    "The socket is a shared handle, and it is clear that it stays, so callers reuse it.",  # expletive
    "The loader opens the file, and it stays open for the run, so callers reuse it.",  # no copula
    "The sockets are shared handles, and it stays open for the run, so callers reuse it.",  # number
    "The socket is in the pool, and it stays open for the run, so callers reuse it.",  # a second noun
    "It is a shared handle, and it stays open for the run, so callers reuse it.",  # no antecedent
]
FENCES = ["The parser, or whatever module replaces it later, returns a tree.", "A file that is not an image, including one with no name, gets skipped."]
NOT_FENCES = [
    "The parser, or a lexer, returns a tree.",  # few words
    "By default, and with no config file present, findings are printed.",  # adverbial
    "The parser, or whatever module replaces it later, Trees return.",  # no verb
]
DASHES = ["The queue — a bounded list of jobs — drains first.", "The queue – a bounded list of jobs – drains first."]
NOT_DASHES = ["Rows 3 – 5 and 7 – 9 are kept.", "The queue — a list; of jobs — drains first.", "argv — then the config — then the defaults."]


@pytest.mark.parametrize(("text", "pronoun"), PREMISES)
def test_premise(text, pronoun):
    ((clause, found, a, b),) = checkers.supporting_premises(text)
    assert found == pronoun
    assert text[a:b] == clause


@pytest.mark.parametrize("text", NOT_PREMISES)
def test_no_premise(text):
    assert checkers.supporting_premises(text) == []


@pytest.mark.parametrize("text", FENCES)
def test_comma_fence(text):
    ((clause, _, a, b),) = checkers.comma_fences(text)
    assert text[a:b] == clause
    assert clause.startswith(", ") and clause.endswith(",")


@pytest.mark.parametrize("text", NOT_FENCES)
def test_no_comma_fence(text):
    assert checkers.comma_fences(text) == []


@pytest.mark.parametrize("text", DASHES)
def test_dash_fence(text):
    assert len(checkers.dash_fences(text)) == 1


@pytest.mark.parametrize("text", NOT_DASHES)
def test_no_dash_fence(text):
    assert checkers.dash_fences(text) == []


@given(st.text(alphabet='ab `".\n,Mr', max_size=60))
def test_mask_keeps_length(text):
    assert len(checkers.mask(text)) == len(text)


def test_structure_tokens():
    found = checkers.structure_tokens("The socket is open, and it stays so all day, so it is used.")
    assert {"c2:AND>SO", "premise:AND", "AND:bsubj:pron"} <= set(found)


def test_check_names_the_first_rule(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([PREMISES[0][0], FENCES[0], DASHES[0], "Plain prose."])] + [(9, None)], "id int, text string")
    found = {r.id: r for r in checkers.check(rows).collect()}
    assert {i: r.rule for i, r in found.items()} == {0: "P14", 1: "P13", 2: "P15"}
    assert found[1].clauses == [", or whatever module replaces it later,"]


def test_the_filter_is_below_the_function(spark):
    rows = spark.range(3).selectExpr("concat('a', id) AS text")
    plan = checkers.check(rows)._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" in plan[plan.index("ArrowEvalPython") :]


def test_first_rule_of_a_shared_view_is_that_of_each_alone(monkeypatch):
    import random

    random.seed(7)
    parts = [", and ", ", so ", "it stays open for the run", "they run", "The socket is a handle", "`a, b; c`", '"no. so"', ", or whatever module replaces it", ", returns", " — ", "–", ". ", "e.g. ", "\n\n", "The parser", " that is", "(", "; "]
    texts = ["".join(random.choices(parts, k=random.randint(1, 9))) for _ in range(3000)]
    alone = [next(((r, s) for r in checkers.ORDER if (s := checkers.CHECKERS[r](t))), (None, [])) for t in texts]
    assert {r for r, _ in alone} == {None, *checkers.ORDER}
    calls = []
    monkeypatch.setattr(checkers, "mask", lambda text, own=checkers.mask: calls.append(text) or own(text))
    assert [checkers.first_of(checkers.ORDER, t) for t in texts] == alone
    assert len(calls) == len(texts)


def test_checkers_run_once_a_row(spark):
    rows = spark.createDataFrame([(1, "a — b — c")], "id int, text string")
    plan = checkers.check(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
