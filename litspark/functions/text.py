"""Column functions over text, names and identifiers. All stay inside Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space in Unicode text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029"
    "\u202f\u205f\u3000"
)
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.btrim(as_col(c), F.lit(WHITESPACE))


def is_missing(c: Column | str) -> Column:
    """Null, blank, or the text ``nan`` in any case (what a NaN becomes in a text file)."""
    text = strip(as_col(c).cast("string"))
    # Four characters are enough to tell ``nan`` from longer text, so that a long abstract
    # is not lower-cased as a whole.
    return text.isNull() | F.lower(F.substring(text, 1, 4)).isin("", "nan")


def present(c: Column | str) -> Column:
    """The value, or null where it is missing."""
    c = as_col(c)
    return F.when(~is_missing(c), c)


def normalize_text(c: Column | str) -> Column:
    """Lower case, runs of white space as one space, ends stripped; missing gives ``''``."""
    text = as_col(c).cast("string")
    squeezed = F.lower(strip(F.regexp_replace(text, SPACE_RUN, " ")))
    return F.when(is_missing(text), F.lit("")).otherwise(squeezed)


def dedup_key(doi: Column | str = "doi", title: Column | str = "title") -> Column:
    """``doi:...`` where there is a DOI, else ``title:...``, else null."""
    return F.coalesce(
        F.concat(F.lit("doi:"), F.nullif(normalize_text(doi), F.lit(""))),
        F.concat(F.lit("title:"), F.nullif(normalize_text(title), F.lit(""))),
    )


def strip_doi_prefix(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), r"(?i)^(?:https?://)?doi\.org/", "")


def strip_work_id_prefix(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), r"(?i)^(?:https?://)?openalex\.org/", "")


def rebuild_abstract(index: Column | str) -> Column:
    """Text of a word -> positions map; words at one position keep the map's order."""
    index = as_col(index)
    # Position and number of the word as one long: numbers sort far quicker than structs. A null position is first.
    number = lambda pos, i: F.shiftleft(F.coalesce(pos.cast("long"), F.lit(-(1 << 31) - 1)), 31) + i
    placed = F.flatten(
        F.transform(F.map_values(index), lambda at, i: F.transform(at, lambda pos: number(pos, i)))
    )
    word = lambda keys, n: F.get(keys, n.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    words = once(F.map_keys(index), lambda keys: F.transform(F.sort_array(placed), lambda n: word(keys, n)))
    return F.nullif(F.array_join(words, " "), F.lit(""))


def author_names(authorships: Column | str) -> Column:
    """Stripped display names, blank ones dropped."""
    names = F.transform(as_col(authorships), lambda a: strip(a["author"]["display_name"]))
    return F.coalesce(F.filter(names, lambda n: n != ""), F.array().cast("array<string>"))


def join_authors(names: Column | str) -> Column:
    """Names joined by ``; ``; a null name counts as empty."""
    filled = F.transform(as_col(names), lambda n: F.coalesce(n, F.lit("")))
    return F.coalesce(F.array_join(filled, "; "), F.lit(""))


def first_author_last_name(names: Column | str) -> Column:
    """Last word of the first name that is not blank."""
    named = F.filter(F.transform(as_col(names), strip), lambda n: n != "")
    return F.try_element_at(F.split(F.get(named, F.lit(0)), SPACE_RUN), F.lit(-1))


def year_range(c: Column | str) -> Column:
    """``2020-2025`` or ``2023`` as a struct of two years; null without a first year."""
    parts = F.transform(F.split(as_col(c), "-"), strip)
    first = F.nullif(F.get(parts, F.lit(0)), F.lit(""))
    last = F.coalesce(F.nullif(F.get(parts, F.lit(1)), F.lit("")), first)
    return F.when(
        first.isNotNull(),
        F.struct(first.cast("int").alias("from"), last.cast("int").alias("to")),
    )


def translate_query(c: Column | str) -> Column:
    """``+`` as AND, ``|`` as OR, a ``-`` that begins a term as NOT.

    Term by term: a mark followed by nothing of a term, as in ``a - b`` or ``(-)``, stays.
    """
    lone = "(-)"

    def negated(word: Column) -> Column:
        bare = word.startswith("-") & (F.length(word) > 1) & ~word.startswith("-)")
        word = F.when(bare, F.concat(F.lit("NOT "), F.substring(word, 2, 1 << 30))).otherwise(word)
        parts = F.split(word, r"\(-\)")
        # A mark at the very end of a word begins no term.
        opened = lambda p: F.replace(p, F.lit("(-"), F.lit("(NOT "))
        last = lambda p: F.concat(opened(p.substr(F.lit(1), F.length(p) - 2)), F.lit("(-"))
        inner = F.transform(parts, lambda p: F.when(p.endswith("(-"), last(p)).otherwise(opened(p)))
        return F.array_join(inner, lone)

    words = F.split(strip(F.regexp_replace(as_col(c), SPACE_RUN, " ")), " ")
    joined = F.array_join(F.transform(words, negated), " ")
    joined = F.replace(F.replace(joined, F.lit("+"), F.lit(" AND ")), F.lit("|"), F.lit(" OR "))
    return strip(F.regexp_replace(joined, SPACE_RUN, " "))


# Fixed value: what stands in place of an image.
IMAGE_REMOVED = "<!--  Image has been removed. Keeping placeholder only -->\n"


# What counts as such a line; both may go on over several lines. ``$`` stops at line
# feeds only, and nothing that was taken is given back.
IMAGE_COMMENT = r"(?md)^[ \t]*+<!--\s*+image(?::[^\-]*+|\s*+)-->[ \t]*+$\n?"
IMAGE_EMBEDDED = r"(?md)^[ \t]*+!\[[^\]]*+\]\(data:image/[^;]++;base64,[^)]*+\)[ \t]*+$\n?"


def clean_markdown_images(c: Column | str) -> Column:
    """Image comments and embedded images replaced, at most one blank line in a row."""
    text = F.replace(as_col(c), F.lit("\r\n"), F.lit("\n"))
    for pattern in (IMAGE_COMMENT, IMAGE_EMBEDDED):
        text = F.regexp_replace(text, pattern, IMAGE_REMOVED)
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def estimate_tokens(c: Column | str) -> Column:
    """Characters divided by four, rounded down."""
    return F.floor(F.length(as_col(c)) / 4).cast("int")


def sha256_hex(c: Column | str) -> Column:
    return F.sha2(as_col(c), 256)


def json_text(c: Column | str) -> Column:
    """One value as JSON text: quoted and escaped for strings, ``null`` for null."""
    c = as_col(c)
    body = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substr(body, F.lit(2), F.length(body) - 2))


def original_data(row_id: Column | str, columns: list[str]) -> Column:
    """JSON object with ``ID`` first, ``", "`` and ``": "`` as separators, text unescaped.

    This is the byte form the hash of the data row is taken over.
    """
    members = [F.concat(F.lit('"ID": '), json_text(row_id))]
    members += [F.concat(json_text(F.lit(name)), F.lit(": "), json_text(F.col(f"`{name}`"))) for name in columns]
    return F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))


def combo_code(*parts: Column | str) -> Column:
    return F.concat_ws("_", *[as_col(p) for p in parts])


def format_duration(seconds: Column | str) -> Column:
    """``HH:MM:SS`` with as many hours as there are; null is zero."""
    total = F.coalesce(as_col(seconds), F.lit(0)).cast("long")
    minutes = F.floor(total / 60)
    return F.format_string("%02d:%02d:%02d", F.floor(minutes / 60), minutes % 60, total % 60)


def sequence_code(prefix: str, n: Column | str) -> Column:
    """``P01``, ``S107``: a letter and at least two digits."""
    return F.format_string(f"{prefix}%02d", as_col(n))


def safe_name(c: Column | str) -> Column:
    return F.translate(as_col(c), "/:", "--")


def clean_value(c: Column | str) -> Column:
    """NaN as null."""
    return F.nanvl(as_col(c), F.lit(None).cast("double"))


def provider_key(c: Column | str) -> Column:
    return F.lower(as_col(c))
