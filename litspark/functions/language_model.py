"""Language of a text by character n-grams, fitted on rows whose language is known.

Fitting is one count of words per language and one of the n-grams of the distinct words, each word
between two spaces; no text leaves Spark, and no row is left out. A language's profile is its
``top`` most frequent n-grams of 1 to ``longest`` characters; the model holds, for each n-gram of any
profile and each language, the smoothed log-odds of meeting it there and not in the other
languages, as whole thousandths. So its size is bounded by ``top`` and the number of languages.

A text's score for a language is the sum over the n-grams of its words. The best language counts
if it leads the second by ``margin`` thousandths per n-gram known; else, and for texts without a
known n-gram, the answer is ``unclear``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.functions.language import NOT_LETTERS, UNCLEAR
from litspark.functions.text import once, strip
from litspark.operators.selection import top_per_group
from litspark.session import materialize

LONGEST = 4
TOP = 3000
MARGIN = 20
# Words whose scores a task keeps.
CACHE = 200_000
# Rows whose words a task looks at together.
ROWS = 1000


def words_of(text: Column | str) -> Column:
    """Lower-cased words of letters."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(text), NOT_LETTERS), lambda w: w != "")


def grams_of(word: Column, longest: int = LONGEST) -> Column:
    """N-grams of a word between two spaces, but for the spaces alone."""

    def of_size(padded: Column, n: int) -> Column:
        first, last = (2, F.char_length(padded) - 1) if n == 1 else (1, F.char_length(padded) - (n - 1))
        starts = F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))

    # Padded once for all its n-grams.
    return once(F.concat(F.lit(" "), word, F.lit(" ")), lambda p: F.concat(*[of_size(p, n) for n in range(1, longest + 1)]))


def fit(df: DataFrame, text: str, lang: str, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The model: ``gram, lang, weight``. Rows with a null language or text teach nothing."""
    known = df.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(words_of(text)).alias("word"))
    words = known.groupBy("lang", "word").agg(F.count("*").alias("n"))
    grams = words.select("lang", "n", F.explode(grams_of(F.col("word"), longest)).alias("gram"))
    # Looked at three times below; the words are counted and taken apart once.
    counts = materialize(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    profile = top_per_group(counts, ["lang"], [F.desc("n"), F.col("gram")], top, spread_by="gram")
    chosen = profile.select("gram").distinct()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    everything = totals.agg(F.sum("total").alias("all_total"), F.collect_list(F.struct("lang", "total")).alias("langs"))
    in_any = counts.join(chosen, "gram").groupBy("gram").agg(
        F.sum("n").alias("all_n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang")
    )
    spread = in_any.join(F.broadcast(everything)).select("*", F.explode("langs").alias("l"))
    here = F.coalesce(F.try_element_at("by_lang", F.col("l.lang")), F.lit(0))
    inside = (here + 0.5) / (F.col("l.total") + 1)
    outside = (F.col("all_n") - here + 0.5) / (F.col("all_total") - F.col("l.total") + 1)
    weight = F.round(F.log(inside / outside) * 1000).cast("int")
    return spread.select("gram", F.col("l.lang").alias("lang"), weight.alias("weight"))


class Detector:
    """A fitted model on the driver: n-grams and a weight for each language (bounded, see above)."""

    def __init__(self, model: DataFrame, longest: int = LONGEST, margin: int = MARGIN):
        table = model.toArrow()
        langs, grams = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "gram"))
        self.langs = langs.dictionary.to_pylist()
        order = np.argsort(np.array(self.langs, object)) if self.langs else np.zeros(0, "i8")
        self.langs = [self.langs[i] for i in order]
        names = grams.dictionary.to_pylist()
        weights = np.zeros((len(names), len(self.langs)), "i8")
        column = np.argsort(order)
        if len(table):
            weights[grams.indices.to_numpy(), column[langs.indices.to_numpy()]] = table.column("weight").to_numpy()
        self.place = {g: i for i, g in enumerate(names)}
        self.weights, self.longest, self.margin = weights, longest, margin

    def words(self, words: list[str]) -> np.ndarray:
        """Of each word the number of known n-grams, then the score per language."""
        place, sizes, found = self.place.get, [], []
        for word in words:
            padded, before = f" {word} ", len(found)
            found += [at for c in word if (at := place(c)) is not None]
            for n in range(2, self.longest + 1):
                found += [at for i in range(len(padded) - n + 1) if (at := place(padded[i : i + n])) is not None]
            sizes.append(len(found) - before)
        n = np.array(sizes, "i8")
        sums = np.zeros((len(found) + 1, len(self.langs)), "i8")
        np.cumsum(self.weights[found], axis=0, out=sums[1:])
        ends = np.cumsum(n)
        return np.column_stack([n, sums[ends] - sums[ends - n]])

    def judge(self, sums: np.ndarray) -> list[str]:
        """Languages from sums of ``word`` over texts; of equal scores the first by name."""
        if not self.langs:
            return [UNCLEAR] * len(sums)
        known, scores = sums[:, 0], sums[:, 1:]
        best = scores.argmax(axis=1)
        top = scores[np.arange(len(scores)), best]
        rest = scores.copy()
        rest[np.arange(len(scores)), best] = np.iinfo("i8").min
        lead = top - rest.max(axis=1) if len(self.langs) > 1 else self.margin * known
        clear = (known > 0) & (lead >= self.margin * known)
        return [self.langs[b] if c else UNCLEAR for b, c in zip(best, clear)]

    def detect(self, df: DataFrame, out: str, *columns: str) -> DataFrame:
        """Adds ``out``: the language of one text, or, of several, the one that all that are there have.

        Where one text is blank the other decides; texts that disagree are ``unclear``.
        """
        model = df.sparkSession.sparkContext.broadcast(self)
        lists = [f"_words{i}" for i in range(len(columns))]
        plain = [f for f in df.schema.fields if f.name.lower() != out.lower()]
        # A text with a sign that is no letter is there, though it has no words.
        words = [
            F.when(strip(F.col(f"`{c}`")) != "", words_of(F.col(f"`{c}`"))).alias(name) for c, name in zip(columns, lists)
        ]
        kind = T.StructType([*plain, T.StructField(out, T.StringType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            detector: Detector = model.value
            width = len(detector.langs) + 1
            # Words by their row in ``held``.
            cache: dict[str, int] = {}
            held = np.zeros((0, width), "i8")
            for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
                sums, there = [], []
                for name in lists:
                    column = batch.column(batch.schema.get_field_index(name))
                    coded = column.flatten().dictionary_encode()
                    if len(cache) > CACHE:
                        cache.clear()
                        held = held[:0]
                    distinct = coded.dictionary.to_pylist()
                    new = [w for w in distinct if w not in cache]
                    cache.update(zip(new, range(len(cache), len(cache) + len(new))))
                    held = np.concatenate([held, detector.words(new)])
                    per_word = held[[cache[w] for w in distinct]] if distinct else held[:0]
                    per_place = np.zeros((len(coded) + 1, width), "i8")
                    np.cumsum(per_word[coded.indices.to_numpy()], axis=0, out=per_place[1:])
                    ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())])
                    sums.append(per_place[ends[1:]] - per_place[ends[:-1]])
                    there.append(column.is_valid().to_numpy(zero_copy_only=False))
                answers = [detector.judge(s) for s in sums]
                found = []
                for i in range(batch.num_rows):
                    given = {a[i] for a, t in zip(answers, there) if t[i]}
                    found.append(given.pop() if len(given) == 1 else UNCLEAR)
                own = [batch.column(i) for i in range(len(plain))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(found, pa.string())], names=kind.names)

        return df.select(*[f"`{f.name}`" for f in plain], *words).mapInArrow(run, kind)
