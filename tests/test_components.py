import random

from corpuskit.operators.components import connected_components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_random_graph_chain_and_star(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)]
    edges += [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 260)] + [(300, 300)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {x.node: x.component for x in got.collect()} == brute(edges)


def test_empty_and_null(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    got = connected_components(spark.createDataFrame([(1, None), (2, 3)], "src long, dst long")).collect()
    assert {x.node: x.component for x in got} == {2: 2, 3: 2}
