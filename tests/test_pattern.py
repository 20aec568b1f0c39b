import pytest

from graphloom.plans.pattern import Motif, MotifError

TRIANGLE = Motif.of((0, 1), (0, 2), (1, 2))
T, F = True, False


@pytest.mark.parametrize(
    ("motif", "start", "order", "steps"),
    [
        (TRIANGLE, 0, (0, 1, 2), [[(0, T, F), (1, T, F)]]),
        (TRIANGLE, 1, (0, 2, 1), [[(0, T, T), (1, F, F)]]),
        (TRIANGLE, 2, (1, 2, 0), [[(0, F, T), (1, F, T)]]),
        (Motif.cycle(3), 0, (0, 1, 2), [[(1, T, F), (0, F, F)]]),
        (Motif.cycle(3), 1, (1, 2, 0), [[(0, F, T), (1, T, F)]]),
        (Motif.cycle(3), 2, (2, 0, 1), [[(1, T, T), (0, F, T)]]),
        (Motif.of((0, 1), (1, 2)), 0, (0, 1, 2), [[(1, T, F)]]),
        (Motif.of((0, 1), (1, 2)), 1, (1, 2, 0), [[(0, F, T)]]),
    ],
)
def test_plans(motif, start, order, steps):
    plan = motif.plan(start)
    assert plan.order == order
    assert plan.relabelled() == steps


def test_parse():
    assert Motif.parse("3 0 1 0 2 1 2") == TRIANGLE
    assert Motif.parse(["1", "0", "1"]).width == 2
    assert Motif.clique(4).edges == ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))


@pytest.mark.parametrize("text", ["", "2 0 1", "1 0 2", "2 0 1 2 3", "1 0 0", "1 a b", "0", "1 0 -1"])
def test_bad_descriptions(text):
    with pytest.raises(MotifError):
        Motif.parse(text)


def test_edges_within_the_first_pair():
    assert Motif.of((0, 1), (1, 0), (1, 2)).plan(1).within == ((0, 1, True),)
    assert Motif.of((0, 1), (1, 0), (1, 2)).plan(0).within == ((1, 0, False),)


def test_most_constrained_first():
    assert Motif.of((0, 1), (1, 2), (0, 3), (1, 3)).plan(0).order == (0, 1, 3, 2)
    assert Motif.of((0, 1), (0, 2), (0, 3), (2, 3), (3, 1)).plan(0).order == (0, 1, 3, 2)
    assert Motif.of((0, 1), (0, 1), (1, 2), (0, 3)).plan(0).order == (0, 1, 2, 3)  # ties go to the least attribute
