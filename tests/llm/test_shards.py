from collections import Counter

import numpy as np

from litspark.llm import shards as s


def test_exact_sizes_and_slots(spark):
    rows = spark.range(0, 1003, numPartitions=7).selectExpr("id", "'x' AS SHARD")
    found = s.shuffle_to_shards(rows, 40, cell_rows=7).collect()
    assert sorted(r.id for r in found) == list(range(1003))
    n = Counter(r.shard for r in found)
    assert set(n) == set(range(40)) and set(n.values()) == {25, 26}
    for k in n:
        assert sorted(r.slot for r in found if r.shard == k) == list(range(n[k]))


def test_repeatable_and_depends_on_seed(spark):
    rows = spark.range(0, 200, numPartitions=4)
    order = lambda seed: [tuple(r) for r in s.shuffle_to_shards(rows, 3, seed).orderBy("shard", "slot").collect()]
    assert order(1) == order(1) != order(2)


def test_more_shards_than_rows_equal_rows_nulls_and_none(spark):
    rows = spark.createDataFrame([(None, None), (None, None), (1, "")], "id int, text string")
    found = s.shuffle_to_shards(rows, 40).collect()
    assert len(found) == 3 and {(r.shard, r.slot) for r in found} == {(0, 0), (1, 0), (2, 0)}
    assert s.shuffle_to_shards(rows.limit(0), 40).count() == 0


def test_matrix_has_the_margins():
    sizes, cells = np.array([5, 0, 17, 100, 3]), np.array([40, 41, 44])
    matrix = np.stack([s.matrix_row(sizes, cells, p, 9) for p in range(len(sizes))])
    assert (matrix >= 0).all() and matrix.sum(1).tolist() == sizes.tolist() and matrix.sum(0).tolist() == cells.tolist()


def test_shuffle_is_uniform():
    """Each row is as likely in each cell, also together with another row of its partition."""
    sizes, cells, n = np.array([4, 8]), np.array([6, 6]), 4000
    first = np.array([s.matrix_row(sizes, cells, 0, seed)[0] for seed in range(n)])
    # Hypergeometric: 4 drawn from 12 with 6 good.
    want = [15, 120, 225, 120, 15]
    got = np.bincount(first, minlength=5)
    assert (abs(got - n * np.array(want) / 495) < 5 * (n * np.array(want) / 495) ** 0.5 + 5).all()


def test_large_draws_follow_the_law():
    rng = np.random.default_rng(4)
    draws = [s.hypergeometric(rng, 6 * 10**9, 4 * 10**9, 10**6) for _ in range(400)]
    deviation = (1e6 * 0.6 * 0.4) ** 0.5
    assert abs(np.mean(draws) - 6e5) < 5 * deviation / 20 and 0.85 < np.std(draws) / deviation < 1.15


def test_written_shards_hold_the_texts_in_order(spark, tmp_path):
    rows = spark.range(0, 60, numPartitions=3).selectExpr("id", "concat('text ', id) AS text")
    s.write_shards(rows, str(tmp_path / "out"), 4, seed=5)
    back = spark.read.parquet(str(tmp_path / "out"))
    want = {(r.shard, r.slot, r.id) for r in s.shuffle_to_shards(rows, 4, 5).collect()}
    assert {(r.shard, r.slot, r.id) for r in back.collect()} == want
