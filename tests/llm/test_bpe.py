import random

import numpy as np
import pytest

from litspark.llm import bpe
from litspark.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    "", "a", " ", "\n\n  x", "it's don't!!'s <|endoftext|> x<|endoftext|>y", "été là  x  y", "\u2003 \u3000a", "x" * 5000,
    "1 2  3\t\t4", "日本語 テキスト 。", "a\x1c b\x1d\x1d c", 'Hello,world."q" (x)?', "é ​ z", "\x85 q \x85\x85 q", None,
]


def test_same_ids_as_the_library(spark):
    random.seed(3)
    alphabet = list(" \n\t\r\x0b\x0cab'sZé.,!?(\u00a0\u2003\u0085ß漢😀09<|>") + ["<|endoftext|>", "'ll", "  "]
    texts = TEXTS + ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3)
    df = df.selectExpr("*", "1 AS TOKEN_IDS")
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    rows = bpe.decode(bpe.encode(df, tokenizer_path()), tokenizer_path()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.token_ids), "<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_decode_broken_and_unknown_ids(spark):
    import json

    tokens = bpe.token_bytes(json.load(open(tokenizer_path(), encoding="utf-8")))
    half = next(i for i, t in enumerate(tokens) if t == b"\xc3")
    packed = [np.array(x, "<u4").tobytes() for x in ([half], [half, 1 << 20, half], [])]
    df = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(packed)], "i long, token_ids binary").repartition(1)
    found = {r.i: r.decoded for r in bpe.decode(df, tokenizer_path()).collect()}
    assert found == {0: "\ufffd", 1: "\ufffd\ufffd", 2: ""}


def test_empty_table(spark):
    df = spark.createDataFrame([], "i long, text string")
    assert bpe.encode(df, tokenizer_path()).count() == 0


def test_cuts_stand_inside_no_token():
    import json

    model = json.load(open(tokenizer_path(), encoding="utf-8"))
    pairs = bpe.forced_pairs(model)
    assert pairs[ord("a"), ord(" ")] and pairs[ord("a"), ord(",")] and not pairs[ord(" "), ord("a")]
    for token in bpe.token_bytes(model):
        assert not pairs[list(token[:-1]), list(token[1:])].any()
