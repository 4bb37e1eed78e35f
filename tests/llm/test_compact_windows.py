import random

import numpy as np
import pyarrow as pa
import pytest

from litspark.llm import compact_windows as c


def test_windows_stand_for_all_subsequences():
    """Every long subsequence lies in exactly one window, and that has its least hash."""
    rng = np.random.default_rng(2)
    values = rng.permutation(60).astype("u8")
    windows = c.compact_windows(values, 7)
    for a in range(60):
        for b in range(a + 6, 60):
            own = [w for w in windows if w[0] <= a <= w[1] <= b <= w[2]]
            assert len(own) == 1 and values[own[0][1]] == values[a : b + 1].min()


def test_one_word_over_and_over_has_few_windows(documents):
    docs = documents([(1, "same " * 5000)]).selectExpr("doc_id AS id", "text")
    assert c.windows(docs).count() < 4 * 4 * 5000 / 46


@pytest.fixture(scope="module")
def planted():
    random.seed(3)
    pool = [f"w{i}" for i in range(3000)]
    some = lambda n: [random.choice(pool) for _ in range(n)]
    passages = {k: some(k) for k in (30, 45, 51, 55, 60, 80, 200)}
    rows, want = [], {}

    def add(words, repeated):
        want[len(rows)] = repeated
        rows.append((len(rows), " ".join(words)))

    for _ in range(20):
        add(some(random.randint(1, 400)), None)
    for k in (51, 55, 60, 80, 200):
        add(some(100) + passages[k] + some(50), None)
        for _ in range(3):
            add(some(random.randint(0, 150)) + passages[k] + some(random.randint(0, 150)), passages[k])
    for k in (30, 45):
        for _ in range(2):
            add(some(60) + passages[k] + some(60), None)
    near = list(passages[200])
    for at in (20, 70, 120, 160):
        near[at] = "changed"
    add(some(30) + near + some(30), near)
    twice = some(120)
    add(twice + some(20) + twice, twice)
    add(rows[22][1].split(), rows[22][1].split())
    return rows, want


def test_planted_passages(documents, planted):
    rows, want = planted
    found = {r.doc_id: r for r in c.mark(documents(rows, "1 AS sources")).collect()}
    for i, text in rows:
        cut = [text[s.start : s.end].split() for s in found[i].spans]
        if want[i] is None:
            assert not cut and not found[i].sources
        else:
            assert [" ".join(x) for x in cut] == [" ".join(want[i])] and all(s <= i for s in found[i].sources)


def test_removal(documents, planted):
    rows, want = planted
    docs = documents(rows + [(1000, None), (1001, ""), (1002, "short")], "'en' AS lang")
    left = {r.doc_id: r.text for r in c.remove(docs).collect()}
    whole = [i for i, t in rows if want[i] is not None and t == " ".join(want[i])]
    assert set(left) == {i for i, _ in rows} - set(whole) | {1000, 1001, 1002}
    for i, text in rows:
        if want[i] is None:
            assert left[i] == text


def test_empty_table(documents):
    assert c.mark(documents([(1, "a")]).limit(0)).count() == 0


def _found(documents, rows):
    return {r.doc_id: [rows[r.doc_id][1].encode()[s.start : s.end].decode().split() for s in r.spans] for r in c.mark(documents(rows)).collect()}


def test_passage_around_a_frequent_sentence(documents):
    """A 60-word passage of which 40 words stand in many documents, at any place in the order."""
    rng = random.Random(5)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    sentence, texts_, want = some(40), [], {}
    passages = [some(10) + sentence + some(10) for _ in range(6)]
    for k in range(60):
        texts_.append(some(60) + sentence + some(60))
        if k % 5 == 0:
            texts_.append(some(60) + passages[k // 5 % 6] + some(60))
            if k >= 30:
                want[len(texts_) - 1] = passages[k // 5 % 6]
    found = _found(documents, [(i, " ".join(x)) for i, x in enumerate(texts_)])
    for i in range(len(texts_)):
        assert found[i] == ([want[i]] if i in want else [])


def test_copies_of_variants(documents):
    """Variants of a template, below the similarity with one another, and copies of each later."""
    rng = random.Random(6)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    template, variants = some(60), []
    for _ in range(40):
        own = list(template)
        for at in range(rng.randrange(4, 9), 60, 12):
            own[at] = some(1)[0]
        variants.append(own)
    rows = [(i, " ".join(some(30) + v + some(30))) for i, v in enumerate(variants * 2)]
    found = _found(documents, rows)
    for i in range(80):
        assert found[i] == ([variants[i - 40]] if i >= 40 else [])


def test_one_function_is_enough(documents):
    rng = random.Random(7)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = some(55)
    rows = [(i, " ".join(some(40) + passage + some(40))) for i in range(2)]
    spans = {r.doc_id: len(r.spans) for r in c.mark(documents(rows), hashes=1).collect()}
    assert spans == {0: 0, 1: 1}


class _Handed:
    """Takes the function that is handed to Spark."""

    def mapInArrow(self, run, schema):
        return run


def test_windows_of_many_keys_are_met_side_by_side(monkeypatch):
    """Each pair is judged as by plain sets, and windows of many keys in a few calls."""
    import pyarrow as pa

    rng, n, reach, least = np.random.default_rng(9), 240, 58, 46
    rows, around = [], []
    for key in range(n // 4):
        base = rng.integers(0, 60000, 2 * reach + 1)
        for k in range(4):
            own = base.copy()
            changed = rng.random(len(own)) < 0.04 * k
            own[changed] = rng.integers(0, 60000, int(changed.sum()))
            rows.append((key, 4 * key + k, 200, 200, 200))
            around.append(own.astype("u2").tobytes())
    columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
    batch = pa.RecordBatch.from_arrays([*columns, pa.array(around, pa.binary())], names=["key", "id", "at", "before", "after", "around"])
    calls, meet = [], c._Key.meet
    monkeypatch.setattr(c._Key, "meet", lambda self, i, j, *more: (calls.append(len(i)), meet(self, i, j, *more))[1])
    out = pa.Table.from_batches(c.join_windows(_Handed(), least)(iter([batch])))
    assert sum(calls) > 150 and len(calls) < 10
    told = 0
    for i, j, low, high in zip(*(out.column(k).to_pylist() for k in ("id", "source", "seed_low", "seed_high"))):
        assert j < i and i // 4 == j // 4
        if high:
            a, b = (np.frombuffer(around[k], "u2")[low - 200 + reach : high - 200 + reach] for k in (i, j))
            x, y = set(a.tolist()), set(b.tolist())
            told += 1
            assert len(x & y) >= c.SIMILAR * len(x | y) and high - low >= least
    assert told > 100


class _Found:
    """Stands for a table: gives the function that a task runs."""

    def mapInArrow(self, run, schema):
        return run


def _family(n, width=115, edits=2):
    """Windows of one key, each a copy of the first or of one before with other shingles at some places."""
    rng = np.random.default_rng(7)
    around = rng.integers(1, 1 << 16, (n, width)).astype("u2")
    for k in range(1, n):
        if k % 5:
            around[k] = around[rng.integers(0, k) if k % 3 == 0 else 0]
            around[k, rng.integers(0, width, edits)] = rng.integers(1, 1 << 16, edits)
    packed = pa.array([row.tobytes() for row in around], pa.binary())
    key, bounds = np.full(n, 8), rng.integers(30, 58, (2, n))
    columns = [key, np.arange(n), np.full(n, 100), *bounds]
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), packed], names=list("abcdef"))


def _joined(batch, step):
    run = c.join_windows(_Found(), 46)
    batches = (batch.slice(at, step) for at in range(0, batch.num_rows, step))
    return sorted(row for out in run(batches) for row in zip(*(x.to_pylist() for x in out.columns)))


def test_blocks_of_a_frequent_key_tell_the_same(monkeypatch):
    batch = _family(500)
    blocks = [_joined(batch, 500), _joined(batch, 130)]
    monkeypatch.setattr(c, "WIDE", 1 << 40)
    one_by_one = _joined(batch, 500)
    assert len(one_by_one) > 300 and blocks == [one_by_one] * 2


def test_known_repeats_are_not_looked_at(monkeypatch):
    """Of a family of near copies a window is looked at beside few others, not beside all."""
    seen, look = [], c._Key._look

    def counted(self, i, j):
        seen.append(len(i))
        look(self, i, j)

    monkeypatch.setattr(c._Key, "_look", counted)
    batch = _family(1500)
    _joined(batch, 1500)
    assert sum(seen) < 1500 * 60  # 720,000 pairs are similar


def test_dense_runs_side_by_side():
    rng = np.random.default_rng(1)
    hit = rng.random((600, 115)) < rng.choice([0.8, 0.85, 0.9, 0.95, 1, 0], (600, 1))
    found = sorted(zip(*(x.tolist() for x in c.dense_run_rows(hit, 8 / 9, 20))))
    assert found == [(r, *run) for r in range(600) for run in c.dense_runs(hit[r], 8 / 9, 20)]


def test_sources_that_tell_nothing_are_met_together(monkeypatch):
    """Windows that share one shingle over and over but are not similar: few calls, not one for each source."""
    rng = np.random.default_rng(8)
    n, width = 400, 115
    around = rng.integers(1, 1 << 16, (n, width)).astype("u2")
    around[:, 32:82] = 7
    for row in around:
        row[rng.choice(np.arange(34, 80), 5, replace=False)] = rng.integers(1, 1 << 16, 5)
    packed = pa.array([row.tobytes() for row in around], pa.binary())
    columns = [np.full(n, 8), np.arange(n), np.full(n, 100), np.full(n, 57), np.full(n, 57)]
    batch = pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), packed], names=list("abcdef"))
    calls, meet = [], c._Key.meet
    monkeypatch.setattr(c._Key, "meet", lambda self, i, *more: (calls.append(len(i)), meet(self, i, *more))[1])
    told = _joined(batch, n)
    assert sum(calls) > 10000 and len(calls) < 100
    assert not told


def test_family_of_near_copies_is_verified_with_few_sources(documents, monkeypatch):
    rng = random.Random(10)
    base, rows = [f"w{rng.randrange(10**6)}" for _ in range(400)], []
    for i in range(80):
        own = list(base)
        for at in rng.sample(range(400), 4 if i else 0):
            own[at] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    verified, verify = [], c._verify
    monkeypatch.setattr(c, "_verify", lambda pairs, *more: (verified.append(pairs.count()), verify(pairs, *more))[1])
    found = _found(documents, rows)
    assert not found[0] and all(sum(map(len, found[i])) > 200 for i in range(1, 80))
    assert sum(verified) < 80 * 4


def _runs(n, words=60, width=115):
    """Windows of one key in texts that say a word many times and then another; two places where words meet have a shingle."""
    rng = np.random.default_rng(11)
    around = np.zeros((n, width), "i8")
    for row in around:
        before, after = rng.integers(1, words, 2)
        a, b = 58 - rng.integers(10, 40), 58 + rng.integers(10, 40)
        row[:a], row[a:b], row[b:] = before, words, after
        for at, x, y in ((a, before, words), (b, words, after)):
            row[at - 2 : at + 2] = 1000 + 4 * (x * 100 + y) + np.arange(4)
    packed = pa.array([row.tobytes() for row in around.astype("u2")], pa.binary())
    columns = [np.full(n, 8), np.arange(n), np.full(n, 100), np.full(n, 70), np.full(n, 70)]
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), packed], names=list("abcdef"))


@pytest.mark.parametrize("batch", [_family(700), _runs(700)])
def test_parts_of_a_frequent_key_tell_the_same(monkeypatch, batch):
    monkeypatch.setattr(c, "PART", 64)
    monkeypatch.setattr(c, "ROWS", 100)
    parts = [_joined(batch, 700), _joined(batch, 190)]
    monkeypatch.setattr(c, "WIDE", 1 << 40)
    one_by_one = _joined(batch, 700)
    assert len(one_by_one) > 300 and parts == [one_by_one] * 2


def test_frequent_word_is_not_met_by_all_pairs(monkeypatch):
    """Windows around one word said over and over, beside others: most share that word only."""
    pairs, turns = [], c._Key.turns
    monkeypatch.setattr(c._Key, "turns", lambda self, i, j: (pairs.append(len(i)), turns(self, i, j))[1])
    monkeypatch.setattr(c, "PART", 64, raising=False)
    n = 2000
    told = _joined(_runs(n), n)
    assert told and sum(pairs) < n * n / 2 / 4


def test_stretches_that_may_be_similar():
    rng, least = np.random.default_rng(12), 10
    codes = rng.integers(0, 12, (300, 24))
    codes[::2] = np.sort(codes[::2], axis=1)
    hit = rng.random((300, 24)) < rng.choice([0.85, 0.95, 1], (300, 1))
    want = []
    for row, h in zip(codes, hit):
        parts = [(a, b) for a in range(24) for b in range(a + least, 25) if h[a] and 9 * h[a:b].sum() >= 8 * (b - a)]
        want.append(any(len({*row[a:b][h[a:b]]}) >= c.SIMILAR * len({*row[a:b]}) for a, b in parts))
    # A code is hit at all its places or at none.
    same = [len({*row[h]} & {*row[~h]}) == 0 for row, h in zip(codes, hit)]
    found = c.may_be_similar(c.place_before(codes), hit, least)
    assert 20 < sum(same) and 0 < sum(want) < 300
    assert all(f == w for f, w, s in zip(found.tolist(), want, same) if s)
