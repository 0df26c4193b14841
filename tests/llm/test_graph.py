"""Components against a plain union of sets."""

import random

import pytest

from stallworks.llm import graph
from stallworks.llm.tables import Scratch


def plain(links):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {x: find(x) for x in list(top) if find(x) != x}


@pytest.mark.parametrize("least_star", [1, 4, 64])
def test_components_with_busy_stars(spark, monkeypatch, least_star):
    monkeypatch.setattr(graph, "LEAST_STAR", least_star)
    rng = random.Random(4)
    links = [(500, k) for k in range(400, 480)]  # a star around a large and one around a small node
    links += [(1, k) for k in range(600, 690)] + [(689, 400)]
    links += [(k, k + 1) for k in range(1000, 1020)] + [(1020, 1000)]  # a chain that closes
    links += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    links += [(7, 7), (600, 1), (600, 1)]
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.label for r in graph.components(Scratch(spark), df).collect()} == plain(links)


def test_no_links(spark):
    assert graph.components(Scratch(spark), spark.createDataFrame([], "a long, b long")).count() == 0
