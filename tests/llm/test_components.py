import random

from litspark.llm.components import components


def test_against_union_find(spark):
    random.seed(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + k) for k in range(1, 200)]
    edges += [(random.randrange(1000, 1300), random.randrange(1000, 1300)) for _ in range(200)] + [(7, 7), (-3, 9), (9, -3)]
    random.shuffle(edges)
    root = {x: x for e in edges for x in e}
    for _ in root:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
        if not changed:
            break
    found = components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert {r.node: r.root for r in found} == {x: y for x, y in root.items() if x != y}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
