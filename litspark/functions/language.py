"""Language of a publication by counting each language's most frequent small words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litspark.functions.text import as_col, once, strip

NOT_LETTERS = r"[^\p{L}]+"

# Small words per language; the order of the languages settles ties.
PROFILES: dict[str, list[str]] = {
    "en": "the of and to in is that for with are this was".split(),
    "fr": "le la les de des et un une est que pour dans".split(),
    "de": "der die das und ist nicht ein eine mit von zu den".split(),
    "es": "el la los las de y que un una es por para".split(),
}
UNCLEAR = "unclear"


def _ranked(words: Column, profiles: dict[str, list[str]]) -> Column:
    def score(lang_words: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(lang_words)))

    best = F.array_max(
        F.array(
            *[
                F.struct(
                    score(lang_words).alias("score"),
                    F.lit(-i).alias("order"),
                    F.lit(name).alias("lang"),
                )
                for i, (name, lang_words) in enumerate(profiles.items())
            ]
        )
    )
    return F.when(best["score"] > 0, best["lang"]).otherwise(F.lit(UNCLEAR))


def detect_text(text: Column | str, profiles: dict[str, list[str]] = PROFILES) -> Column:
    """Language with the most small words; ``unclear`` where there are none.

    The text is split and reduced to known words once, then counted per language.
    """
    every = sorted({w for lang_words in profiles.values() for w in lang_words})
    known = F.filter(F.split(F.lower(as_col(text)), NOT_LETTERS), lambda w: w.isin(every))
    return once(known, lambda words: _ranked(words, profiles))


def detect_language(
    title: Column | str, abstract: Column | str, profiles: dict[str, list[str]] = PROFILES
) -> Column:
    """Where both texts are there they must agree; else the one that is there decides."""
    title, abstract = as_col(title), as_col(abstract)
    has_both = (strip(title) != "") & (strip(abstract) != "")
    both = F.struct(
        detect_text(title, profiles).alias("t"), detect_text(abstract, profiles).alias("a")
    )
    agreed = once(both, lambda d: F.when(d["t"] == d["a"], d["t"]).otherwise(F.lit(UNCLEAR)))
    joined = F.concat_ws(" ", title, abstract)
    return F.when(has_both, agreed).otherwise(detect_text(joined, profiles))
