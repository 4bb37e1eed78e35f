import numpy as np

from litspark.llm import pq_dedup as p


def brute(rows, least=0.93):
    ok = [
        (i, np.array(v, "f8"), x)
        for i, v, x in rows
        if i is not None and x is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)
    ]
    links = {
        (i, j)
        for i, v, x in ok
        for j, w, y in ok
        if i != j and x == y and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= least
    }
    root = {i: i for i, _, _ in rows if i is not None}
    for _ in root:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return {i: (sum(a == i for a, _ in links), root[i], root[i] == i) for i in root}


def found(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    out = p.link(df.selectExpr("*", "1 AS n_links")).collect()
    assert len(out) == len(rows)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out if r.vec_id is not None}


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(25):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 9))):
            v = (base + rng.normal(size=16) * rng.choice([0, 0.1, 0.2, 0.3])).astype("f4").tolist()
            rows.append((len(rows), v, int(rng.integers(0, 2))))
    assert found(spark, rows) == brute(rows)


def test_small_blocks_of_one_list(spark, monkeypatch):
    monkeypatch.setattr(p, "STORED_BLOCK", 4)
    monkeypatch.setattr(p, "PROBE_BLOCK", 8)
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * 0.25).astype("f4").tolist(), 1) for i in range(60)]
    assert found(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1),
        (7, [], 1), (8, [0.0, 0.0], 1), (9, [float("nan"), 1.0], 1), (10, [float("inf"), 1.0], 1), (11, [1e-30, 0.0], 1),
        (12, [1.0, 0.0, 0.0], 1), (13, [-1.0, 0.0], 1), (None, [1.0, 0.0], 1), (14, [1.0, 0.2], 1), (15, [None, 1.0], 1),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == {}
