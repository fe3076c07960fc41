import pytest

from corpusloom.functions import repair as Z


@pytest.mark.parametrize(
    ("reply", "wanted"),
    [
        ('{"a": 1}', ({"a": 1}, "none")),
        ('so {"a": [1, 2,], "b": {"c": "}"', ({"a": [1, 2], "b": {"c": "}"}}, "container-repair")),
        ('{"evidence_ids": "x", "y"}', ({"evidence_ids": ["x", "y"]}, "evidence-array-repair")),
        ("{'a': None, 'b': (1, 2)}", ({"a": None, "b": [1, 2]}, "literal-repair")),
        ('<think>{"a": 2}', None),
        ("{'a': open('x')}", None),
        ('{"a": "no end', None),
        ('{"a": ]} {"b": 3}', ({"b": 3}, "none")),
        ("", None),
        ("[1, 2]", None),
    ],
)
def test_recovered(reply, wanted):
    assert Z.recovered(reply) == wanted


@pytest.mark.parametrize(
    ("text", "phrases", "wanted"),
    [
        ("He  said: go!", ["He said", "go"], ["He  said: ", "go!"]),
        ("(a b)", ["a", "b"], ["(a ", "b)"]),
        ("a b c", ["a", "c"], None),
        ("a b", ["a", "b", "c"], None),
        ("a b", ["a", ""], None),
        ("a b tail", ["a", "b"], None),
    ],
)
def test_aligned(text, phrases, wanted):
    assert Z.aligned(text, phrases) == wanted
    assert wanted is None or "".join(wanted) == text


def test_compacted():
    assert Z.compacted(" short ", 10) == "short"
    long = 'Facts: {"a": ["' + "x" * 2000 + '", 1, 2], "b": 1} end'
    for budget in (40, 60, 200, 400):
        out = Z.compacted(long, budget)
        assert Z.estimate(out) <= budget and out.startswith("Facts") and (budget < 60 or out.endswith("end"))
    assert Z.estimate(Z.compacted("水" * 5000, 50)) <= 50
