import random
import re

import pytest

from litspark.llm import decontaminate as d


def words_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(10, len(w))
        if item is not None and n:
            for a in range(len(w) - n + 1):
                windows.setdefault(tuple(w[a : a + n]), set()).add(str(item))
    out = {}
    for i, text in docs:
        w, hit, names = words_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                own = windows.get(tuple(w[a : a + n]))
                if own:
                    hit |= set(range(a, a + n))
                    names |= own
        out[i] = (len(w), len(hit), sorted(names))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 24, 300])
def test_against_brute_force(spark, documents, block_bytes):
    random.seed(1)
    pool = [f"w{i}" for i in range(40)]
    some = lambda n: [random.choice(pool) for _ in range(n)]
    items = [(i, " ".join(some(n))) for i, n in enumerate([3, 1, 9, 10, 11, 30, 12, 0, 2])]
    items += [(100, items[5][1]), (7, " , ; "), (None, "w1 w2"), (12, None), (3, "zwei drei")]
    docs = []
    for i in range(80):
        w = some(random.randint(0, 40))
        if i % 3:
            at = random.randint(0, len(w))
            w[at:at] = random.choice(items[:7])[1].upper().split()
        docs.append((i, random.choice([" ", ", ", "\n"]).join(w)))
    docs += [(90, None), (91, ""), (92, items[5][1]), (93, (items[5][1] + " ") * 50), (94, "Zwei—drei zwei.DREI")]
    marked = d.mark(
        documents(docs, "1 AS N_WORDS"), spark.createDataFrame(items, "item_id int, text string"), block_bytes=block_bytes
    )
    found = {r.doc_id: (r.n_words, r.n, r["items"]) for r in marked.withColumn("n", d.n_hit()).collect()}
    assert found == brute(docs, items)


def test_empty_tables(spark, documents):
    items = spark.createDataFrame([], "item_id int, text string")
    docs = documents([(1, "a b c"), (1, "a b c")])
    assert d.decontaminate(docs, items).count() == 2
    assert d.mark(docs.limit(0), items).count() == 0


def test_repeated_items_do_not_fill_a_block(spark, documents, monkeypatch):
    items = [(str(i), f"one two three four five six seven eight nine ten {i}") for i in range(20)]
    benchmark = spark.createDataFrame(items + items[:1] * 200, "item_id string, text string")
    blocks, windows_of = [], d.windows_of
    monkeypatch.setattr(d, "windows_of", lambda rows, *how: blocks.append(rows) or windows_of(rows, *how))
    marked = d.mark(documents([(1, "x " + items[0][1]), (2, "y")]), benchmark).collect()
    assert [sorted(x) for x in blocks] == [sorted(items)]
    assert {r.doc_id: list(r["items"]) for r in marked} == {1: sorted(i for i, _ in items), 2: []}
