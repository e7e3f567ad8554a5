import random

import pytest

from chronoledger.llm import common
from chronoledger.llm.common import Stage, components


def brute(edges):
    root = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in root)


def graph():
    """A path in random order, a star around its largest node, a circle, pairs,
    repeated edges both ways, loops, and ids at both ends of the range."""
    rng = random.Random(8)
    path, star, circle = rng.sample(range(-500, 0), 60), 999, list(range(2000, 2009))
    edges = [*zip(path, path[1:]), *((star, x) for x in range(900, 930)), *zip(circle, circle[1:] + circle[:1])]
    edges += [(rng.randrange(5000, 5080), rng.randrange(5000, 5080)) for _ in range(40)]
    edges += [(7, 7), (-(1 << 63), (1 << 63) - 1), *[(b, a) for a, b in edges[:50]], *edges[:20]]
    rng.shuffle(edges)
    return edges


@pytest.mark.parametrize("task_edges", [0, 30, None])
def test_components_by_rounds_and_in_one_task(spark, monkeypatch, task_edges):
    """By rounds alone, by rounds down to a few edges, and in one task."""
    if task_edges is not None:
        monkeypatch.setattr(common, "TASK_EDGES", task_edges)
    edges = graph()
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(3), Stage(spark, "test"))
    assert sorted(map(tuple, got.collect())) == brute(edges)


def test_few_edges_take_few_plans(spark):
    """The driver keeps something of every plan, so a small graph takes no rounds."""
    stage = Stage(spark, "test")
    components(spark.createDataFrame(graph(), "a long, b long"), stage)
    assert stage.made <= 2


@pytest.mark.parametrize("edges", [[], [(4, 4)]])
def test_no_edges(spark, edges):
    assert components(spark.createDataFrame(edges, "a long, b long"), Stage(spark, "test")).count() == 0
