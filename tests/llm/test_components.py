"""Connected components against a plain union-find."""

import random

from finlode.llm.components import components


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(150)]
    links += [(1000 + i + 1, 1000 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 50)] + [(7, 7), (None, 3), links[0]]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    assert {r["node"]: r["component"] for r in components(df).collect()} == {x: root(x) for x in parent}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
