"""Quality classifier from weak labels.

Heuristic labellers vote on every document, each ``bad``, ``good`` or not at all. They form groups
that look for one fault each: repeated words, table bars, odd symbols, shouting, abuse. Within a
group the labellers overlap, so expectation-maximisation over the votes of all documents tells how
often each is right, without looking at any label. The posteriors of the groups, joined (bad if any
fault is there), are the labels from which a linear scorer over hashed words and the votes is
trained; the scorer judges every document.

The word lists of the abuse labellers are taken from labelled rows: at most ``LABELLED`` ids,
the first by a hash, dealt into three folds with one labeller each. The scorer is fitted
to the posteriors of at most ``TRAIN`` documents, the first by another hash. Both are bounds of
what the driver holds. Votes, their counts and the scores cover all documents and whole texts.

Cases: a null or empty text gets no vote and is kept (there is nothing bad in it). Without
labelled rows the abuse labellers never vote. An empty table gives an empty result. Repeated rows
are scored alike; other columns pass through, columns named like those added are replaced.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.llm.arrays import LOWER, MARKS, SPACES, Texts, Words, mix, pieces, texts, words

LABELLED = 6000
TRAIN = 12000
BITS = 18
FOLDS = 3
ROUNDS = 50
SHARES = 8
PIECE = 1 << 20  # bytes of text that a task looks at together
ADDED = {"score": T.DoubleType(), "keep": T.BooleanType()}

# Bytes that are neither letters, digits, white space nor usual in sentences.
ODD = np.zeros(256, bool)
ODD[list(b"#$%&*+<=>@[\\]^_`{|}~")] = True


def _only(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


BAR, SHOUT = _only(b"|"), _only(b"!")
CAPITAL, SMALL = _only(bytes(range(65, 91))), _only(bytes(range(97, 123)))

BAD, GOOD, NONE = 1, 0, -1
# Labellers by what they look for; the abuse lists follow them.
GROUPS = {
    "repeats": ("equal neighbours", "runs of three"),
    "bars": ("bars", "one word fills the text"),
    "symbols": ("odd bytes", "words with odd bytes"),
    "shouting": ("capitals", "exclamation marks"),
}
OWN = sum(len(x) for x in GROUPS.values())


STEMS = (4, 6, 8)  # bytes
Lists = tuple[np.ndarray, np.ndarray]  # sure and likely words


class Votes(NamedTuple):
    """Votes [text, labeller], and the distinct hashed words and stems of each text."""

    votes: np.ndarray
    bucket: np.ndarray
    first: np.ndarray


def _per_text(hits: np.ndarray, t: Texts) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(hits)])
    return sums[t.end] - sums[t.start]


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs: values, how often, and the first of each owner.

    Owners and the upper bits of values (48 of them for up to 65,536 owners) are sorted as one number;
    the lower bits of the values given back are zero.
    """
    bits = np.uint64(max(16, int(n).bit_length()))
    keys = np.sort((owner.astype("u8") << (np.uint64(64) - bits)) | (values >> bits))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    first = np.searchsorted(keys[at] >> (np.uint64(64) - bits), np.arange(n + 1, dtype="u8"))
    return keys[at] << bits, np.diff(np.append(at, len(keys))), first


class Lookup:
    """Which of several lists of hashes hold a hash: a bit per list, looked up in one table.

    Most hashes are in no list; a bitmap over their upper bits tells nearly all of those.
    """

    def __init__(self, lists: list[np.ndarray]):
        self.hashes = np.unique(np.concatenate([np.zeros(0, "u8"), *lists]))
        self.bits = np.zeros(len(self.hashes), "u1" if len(lists) <= 8 else "u8")
        for i, one in enumerate(lists):
            self.bits[np.searchsorted(self.hashes, one)] |= self.bits.dtype.type(1 << i)
        self.some = np.zeros(1 << 18, bool)
        self.some[(self.hashes >> np.uint64(46)).astype("i8")] = True

    def find(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(values.shape, self.bits.dtype)
        if len(self.hashes):
            near = np.flatnonzero(self.some[(values >> np.uint64(46)).astype("i8")])
            at = np.minimum(np.searchsorted(self.hashes, values[near]), len(self.hashes) - 1)
            out[near] = np.where(self.hashes[at] == values[near], self.bits[at], 0)
        return out


def _terms(t: Texts, w: Words) -> np.ndarray:
    """Hash of each word, and of its first bytes where it is longer: a row for each kind.

    Inflected abuse shares its beginning. Words without such a beginning repeat the word's hash.
    """
    padded = np.concatenate([LOWER[t.data], np.zeros(8, "u1")])
    packed = np.zeros(len(w.hash), "u8")
    for i in range(8):
        packed |= padded[w.start + i].astype("u8") << np.uint64(8 * i)
    rows = [w.hash]
    for n in STEMS:
        stem = mix((packed & np.uint64((1 << (8 * n)) - 1)) + np.uint64(n))
        rows.append(np.where(w.end - w.start > n, stem, w.hash))
    return np.stack(rows)


def vote(t: Texts, lists: list[Lists], features: bool = True) -> Votes:
    """Votes of all labellers; ``lists`` has the words of each abuse labeller.

    Without ``features`` no hashed words are given. One word that is hardly ever in clean texts makes it vote bad, or two that are rarely.
    """
    n = len(t.start)
    size = np.maximum(t.end - t.start, 1)
    w = words(t, SPACES)
    n_words = np.diff(w.first)
    owner = np.repeat(np.arange(n), n_words)
    ends = np.maximum(n_words, 1)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])
    third = same.copy()
    third[1:] &= same[:-1]

    def per_word(hit: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(hit)])
        return (sums[w.first[1:]] - sums[w.first[:-1]]) / ends

    _, times, first = _distinct(w.hash, owner, n)
    most = np.zeros(n)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        most[some] = np.maximum.reduceat(times, first[some]) / n_words[some]
    odd = np.concatenate([[0], np.cumsum(ODD[t.data])])
    capital = _per_text(CAPITAL[t.data], t)
    letters = np.maximum(capital + _per_text(SMALL[t.data], t), 1)

    def band(x: np.ndarray, good: float, bad: float) -> np.ndarray:
        out = np.where(x >= bad, BAD, np.where(x <= good, GOOD, NONE))
        return np.where(n_words >= 5, out, NONE)

    columns = [
        band(per_word(same), 0.1, 0.3),
        band(per_word(third), 0.05, 0.15),
        band(_per_text(BAR[t.data], t) / ends, 0.05, 0.25),
        band(most, 0.2, 0.35),
        band(_per_text(ODD[t.data] & ~BAR[t.data], t) / size, 0.02, 0.08),
        band(per_word(odd[w.end] - odd[w.start] > 0) - _per_text(BAR[t.data], t) / ends, 0.15, 0.4),
        band(capital / letters, 0.2, 0.5),
        band(_per_text(SHOUT[t.data], t) / ends, 0.1, 0.5),
    ]
    plain = words(t, MARKS)
    plain_owner = np.repeat(np.arange(n), np.diff(plain.first))
    terms = _terms(t, plain)
    lookup = Lookup([x for pair in lists for x in pair])
    found_in = np.zeros(len(plain.hash), lookup.bits.dtype)
    for row in terms:
        found_in |= lookup.find(row)
    for i in range(len(lists)):
        sure, likely = ((found_in & found_in.dtype.type(1 << (2 * i + j))) > 0 for j in (0, 1))
        _, _, words_hit = _distinct(plain.hash[likely], plain_owner[likely], n)
        certain = np.bincount(plain_owner[sure], minlength=n) > 0
        n_hit = np.diff(words_hit)
        found = np.where(certain | (n_hit >= 2), BAD, np.where(n_hit == 1, NONE, GOOD))
        columns.append(np.where(np.diff(plain.first) > 0, found, NONE))
    hashes, first = np.zeros(0, "u8"), np.zeros(n + 1, "i8")
    if features:
        hashes, _, first = _distinct(terms.reshape(-1), np.tile(plain_owner, len(terms)), n)
    return Votes(np.stack(columns, axis=1).astype("i1"), (hashes >> np.uint64(64 - BITS)).astype("i8"), first)


def learn_lists(rows: pa.Table, folds: int = FOLDS) -> list[Lists]:
    """Of each fold of rows (``text``, ``toxic``): words found much more often in toxic texts.

    A word counts once with each word before it, so that the words of a text with many copies
    don't look frequent: abuse stands in ever new places. Terms are counted in ``SHARES`` shares by
    their hash, which bounds what is held beside the texts.
    """
    lists = []
    order = np.random.default_rng(0).permutation(len(rows))
    for k in range(folds):
        own = rows.take(pa.array(order[k::folds])).combine_chunks()
        t = texts(own.column("text"))
        toxic = own.column("toxic").to_numpy().astype(bool)
        w = words(t, MARKS)
        owner = np.repeat(np.arange(len(own)), np.diff(w.first))
        before = np.zeros(len(w.hash), "u8")
        before[1:] = np.where(owner[1:] == owner[:-1], w.hash[:-1], 0)
        # With a stem the whole word counts as its surroundings too.
        near = mix(mix(before + mix(w.hash)))
        terms = _terms(t, w)
        bad_word = toxic[owner]
        n_bad, n_good = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
        sure, likely = [], []
        for share in range(SHARES):
            mine = [np.flatnonzero(row % np.uint64(SHARES) == share) for row in terms]
            held = np.concatenate([row[m] for row, m in zip(terms, mine)])
            place = np.concatenate(mine)
            distinct, code = np.unique(held, return_inverse=True)
            counts = []
            for kind in (True, False):
                of = bad_word[place] == kind
                once = np.unique(mix(held[of] + near[place[of]]), return_index=True)[1]
                counts.append(np.bincount(code[of][once], minlength=len(distinct)))
            common = counts[0] >= max(4, 0.08 * n_bad)
            far = common & (counts[0] / n_bad >= 20 * (counts[1] + 0.5) / n_good)
            sure.append(distinct[far & (counts[1] <= 0.001 * n_good)])
            likely.append(distinct[far])
        lists.append((np.sort(np.concatenate(sure)), np.sort(np.concatenate(likely))))
    return lists


def accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Posterior of ``bad`` for each vote pattern, by expectation-maximisation.

    Labellers are taken as independent given the truth; one that abstains says nothing.
    """
    said = patterns != NONE
    bad = patterns == BAD
    # The majority starts it.
    n_said = np.maximum(said.sum(1), 1)
    posterior = np.clip(bad.sum(1) / n_said, 0.05, 0.95)
    for _ in range(rounds):
        weight = posterior * counts
        other = (1 - posterior) * counts
        prior = np.clip(weight.sum() / max(counts.sum(), 1), 1e-4, 1 - 1e-4)
        hit = ((weight[:, None] * bad).sum(0) + 1) / ((weight[:, None] * said).sum(0) + 2)
        false = ((other[:, None] * bad).sum(0) + 1) / ((other[:, None] * said).sum(0) + 2)
        # A labeller better than chance is what makes "bad" mean bad.
        hit, false = np.clip(hit, 0.5, 0.999), np.clip(false, 0.0005, 0.4)
        logs = np.log(prior / (1 - prior)) + np.where(
            bad, np.log(hit / false), np.where(said, np.log((1 - hit) / (1 - false)), 0.0)
        ).sum(1)
        posterior = 1 / (1 + np.exp(-np.clip(logs, -30, 30)))
        posterior[~said.any(1)] = prior if said.any() else 0.0
    posterior[~said.any(1)] = 0.0
    return posterior


def train_scorer(votes: Votes, target: np.ndarray, ranked: np.ndarray, n_labellers: int, epochs: int = 12) -> np.ndarray:
    """Weights of the hashed words, then of each labeller's bad votes, then the offset.

    ``ranked`` are the texts in an order that is the same on every run.
    """
    size = (1 << BITS) + n_labellers + 1
    weights, squares = np.zeros(size), np.full(size, 1e-3)
    n = len(target)
    rng = np.random.default_rng(0)
    batch = 256
    for _ in range(epochs):
        order = ranked[rng.permutation(n)]
        for at in range(0, n, batch):
            rows = order[at : at + batch]
            count = votes.first[rows + 1] - votes.first[rows]
            at_word = np.concatenate([np.arange(a, a + c) for a, c in zip(votes.first[rows], count)] or [[]])
            index = votes.bucket[at_word.astype("i8")]
            text = np.repeat(np.arange(len(rows)), count)
            bad = votes.votes[rows] == BAD
            raw = np.bincount(text, weights[index], len(rows)) + bad @ weights[1 << BITS : -1] + weights[-1]
            miss = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - target[rows]) / len(rows)
            step = np.zeros(size)
            step[: 1 << BITS] = np.bincount(index, miss[text], 1 << BITS)
            step[1 << BITS : -1] = miss @ bad
            step[-1] = miss.sum()
            step += 1e-5 * weights
            squares += step * step
            weights -= 0.1 * step / np.sqrt(squares)
    return weights


def apply_scorer(votes: Votes, weights: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(weights[votes.bucket])])
    raw = sums[votes.first[1:]] - sums[votes.first[:-1]]
    return raw + (votes.votes == BAD) @ weights[1 << BITS : -1] + weights[-1]


class Model(NamedTuple):
    lists: list[Lists]
    patterns: dict[bytes, float]
    weights: np.ndarray


def _first_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The ``n`` rows that come first by a hash of ``key``: the same ones on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Word lists from labelled rows, accuracies from all documents, weights from a sample."""
    spark = documents.sparkSession
    docs = documents.select(F.col(key).alias("id"), F.col(text).alias("text"))
    own = labels.select(F.col(key).alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    chosen = _first_rows(own.groupBy("id").agg(F.max("toxic").alias("toxic")), "id", LABELLED, 1)
    # At most LABELLED narrow rows, so that they may go to every task.
    # Of several texts of one id the least is taken, so that every run learns the same.
    of_id = docs.join(F.broadcast(chosen), "id").where("text IS NOT NULL").groupBy("id")
    rows = of_id.agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).toArrow()
    lists = learn_lists(rows.sort_by("id").select(["text", "toxic"]))
    del rows
    n_labellers = OWN + len(lists)
    shared = spark.sparkContext.broadcast(lists)

    def count(batches):
        seen: dict[bytes, int] = {}
        for piece in pieces(batches, "text", PIECE):
            votes = vote(texts(piece.column(0)), shared.value, features=False).votes
            kinds, times = np.unique(votes, axis=0, return_counts=True)
            for kind, n in zip(kinds, times.tolist()):
                seen[kind.tobytes()] = seen.get(kind.tobytes(), 0) + n
        yield pa.RecordBatch.from_pydict({"pattern": list(seen), "n": list(seen.values())}, schema=counted)

    counted = pa.schema([("pattern", pa.binary()), ("n", pa.int64())])
    found = docs.select("text").mapInArrow(count, "pattern binary, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))
    # At most three to the power of the labellers.
    pattern_rows = sorted((bytes(r["pattern"]), r["n"]) for r in found.collect())
    patterns = np.array([np.frombuffer(p, "i1") for p, _ in pattern_rows], "i1").reshape(-1, n_labellers)
    times = np.array([n for _, n in pattern_rows], float)
    good = np.ones(len(patterns))
    at = 0
    for size in [*(len(x) for x in GROUPS.values()), len(lists)]:
        good *= 1 - accuracies(patterns[:, at : at + size], times)
        at += size
    posterior = {p: float(1 - g) for (p, _), g in zip(pattern_rows, good)}
    sample_ids = _first_rows(docs.select("id").where("id IS NOT NULL").distinct(), "id", TRAIN, 2)

    def features(batches):
        for piece in pieces(batches, "text", PIECE):
            v = vote(texts(piece.column(1)), shared.value)
            packed = [v.bucket[a:b].astype("<i4").tobytes() for a, b in zip(v.first[:-1], v.first[1:])]
            yield pa.RecordBatch.from_pydict(
                {"id": piece.column(0), "votes": [x.tobytes() for x in v.votes], "buckets": packed},
                schema=pa.schema([("id", piece.schema.field(0).type), ("votes", pa.binary()), ("buckets", pa.binary())]),
            )

    taken = docs.join(F.broadcast(sample_ids), "id").groupBy("id").agg(F.min("text").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    sample = taken.mapInArrow(features, f"id {kind}, votes binary, buckets binary").toArrow()
    by_id = pa.compute.sort_indices(sample.column("id")).to_numpy()
    said = sample.column("votes").to_pylist()
    held = texts(sample.column("buckets"))
    del sample
    first = np.append(held.start, held.end[-1:]) // 4 if len(said) else np.zeros(1, "i8")
    votes = np.frombuffer(b"".join(said), "i1").reshape(-1, n_labellers)
    target = np.array([posterior.get(v, 0.0) for v in said])
    return Model(lists, posterior, train_scorer(Votes(votes, held.data.view("<i4"), first), target, by_id, n_labellers))


def score(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` (log-odds of bad) and ``keep`` to every document."""
    names = {n.lower() for n in ADDED}
    documents = documents.select([c for c in documents.columns if c.lower() not in names])
    shared = documents.sparkSession.sparkContext.broadcast((list(model.lists), model.weights))

    def run(batches):
        lists, weights = shared.value
        for piece in pieces(batches, text, PIECE):
            t = texts(piece.column(piece.schema.get_field_index(text)))
            votes = vote(t, lists)
            empty = ~(votes.votes != NONE).any(1) & (np.diff(votes.first) == 0)
            raw = np.where(empty, -30.0, apply_scorer(votes, weights))
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array(raw), pa.array(raw < 0)],
                schema=pa.schema([*piece.schema, pa.field("score", pa.float64()), pa.field("keep", pa.bool_())]),
            )

    fields = [*documents.schema.fields, *(T.StructField(n, k) for n, k in ADDED.items())]
    return documents.mapInArrow(run, T.StructType(fields))


def classify(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return score(documents, fit(documents, labels, key, text), text)
