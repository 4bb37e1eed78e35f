import random

import pytest

from litspark.llm import repeat_tree as r


def brute(rows, length=100):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda x: x[0]):
        body = (text or "").encode()
        covered = bytearray(len(body))
        for a in range(len(body) - length + 1):
            own = body[a : a + length]
            if own in seen:
                covered[a : a + length] = b"\1" * length
            seen.add(own)
        runs = sum(1 for k, c in enumerate(covered) if c and (not k or not covered[k - 1]))
        out[i] = (runs, bytes(x for x, c in zip(body, covered) if not c))
    return out


def found(documents, rows, **how):
    return {x.doc_id: (len(x.spans or []), bytes(x.kept)) for x in r.remove(documents(rows, "1 AS KEPT"), **how).collect()}


def mixed():
    random.seed(7)
    letters = "abcdefghij klmno pqrst é"
    some = lambda n: "".join(random.choice(letters) for _ in range(n))
    passages = [some(random.choice([90, 100, 101, 150, 300, 800])) for _ in range(10)]
    rows = []
    for i in range(100):
        text = ""
        for _ in range(random.randint(0, 5)):
            p, at = random.choice(passages), random.randint(0, 60)
            text += some(random.randint(0, 60)) + (p if random.random() < 0.5 else p[at : at + random.randint(60, 200)])
        rows.append((i, text))
    rows += [(200, None), (201, ""), (202, "ab" * 300), (203, "a" * 1000), (204, "a" * 99), (205, "a" * 100)]
    return rows + [(206, rows[5][1]), (207, rows[5][1]), (208, "xyz" * 200 + "ab" * 100), (209, "\0" * 150 + rows[6][1] + "\0" * 120)]


@pytest.mark.parametrize("most", [r.MOST, 1])
def test_against_brute_force(documents, most):
    rows = mixed()
    assert found(documents, rows, most=most) == brute(rows)


def test_long_texts_in_segments(documents, monkeypatch):
    monkeypatch.setattr(r, "SEGMENT", 500)
    random.seed(9)
    part = "".join(random.choice("abcdefgh") for _ in range(700))
    rows = [(1, "x" + part * 2 + "".join(random.choice("abcdefgh") for _ in range(4000)) + part), (2, part[100:400] + "y" * 3000)]
    assert found(documents, rows) == brute(rows)


def test_shorter_strings(documents):
    random.seed(1)
    rows = [(i, "".join(random.choice("ab ") for _ in range(120))) for i in range(40)]
    assert found(documents, rows, length=12, gram=6) == brute(rows, 12)


def test_intervals_of_a_suffix_array():
    text = "mississippi"
    order = sorted(range(len(text)), key=lambda k: text[k:])
    common = lambda a, b: next((k for k in range(12) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or a + k >= 11 or b + k >= 11), 11)
    lcp = [common(a, b) for a, b in zip(order, order[1:])]
    found = {text[order[first] : order[first] + n]: sorted(order[first : last + 1]) for n, first, last in r.intervals(lcp, 1)}
    assert found == {"i": [1, 4, 7, 10], "issi": [1, 4], "p": [8, 9], "s": [2, 3, 5, 6], "si": [3, 6], "ssi": [2, 5]}


def test_groups_are_parted_by_their_left_extension():
    left = [b"xab", b"yab", b"zzb", b"zzc"]
    groups = sorted((d, m) for d, m in r._left_groups([0, 1, 2, 3], left, 0, 0))
    assert groups == [(0, [0, 1, 2, 3]), (2, [2, 3])]


def test_empty_table(documents):
    assert r.remove(documents([(1, "a")]).limit(0)).count() == 0
