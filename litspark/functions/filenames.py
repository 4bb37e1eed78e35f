"""File names: built from records, resolved from downloads, taken apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litspark.functions.text import as_col, strip

NOT_NAME_CHAR = r"[^\p{L}\p{N}\-_.]"
# Letters that have an upper and a lower form; a new word starts after anything else.
CASED = r"\p{Lu}\p{Ll}\p{Lt}"
WORD_START = rf"(?<![{CASED}])(?=[{CASED}])"


def _part(c: Column, missing: str, shape=lambda cleaned: cleaned) -> Column:
    text = c.cast("string")
    cleaned = F.btrim(F.regexp_replace(text, NOT_NAME_CHAR, "_"), F.lit("_"))
    return F.when(strip(text) != "", shape(cleaned)).otherwise(F.lit(missing))


def title_case(c: Column | str) -> Column:
    """First letter of each word in upper case, where any non-letter ends a word."""

    def capitalize(word: Column) -> Column:
        # A letter may have two upper-case characters; only the first one stays upper.
        head = F.upper(F.substring(word, 1, 1))
        return F.concat(
            F.substring(head, 1, 1),
            F.lower(F.substr(head, F.lit(2))),
            F.substr(word, F.lit(2)),
        )

    return F.array_join(F.transform(F.split(as_col(c), WORD_START), capitalize), "")


def structured_filename(
    year: Column | str, author: Column | str, title: Column | str, doi: Column | str
) -> Column:
    """``YEAR_AUTHOR_TITLE_DOI.pdf`` with a fixed word for each missing part."""
    parts = [
        _part(as_col(year), "NO_year"),
        _part(as_col(author), "NO_author"),
        _part(as_col(title), "NO_title", lambda t: title_case(F.substring(F.lower(t), 1, 60))),
        _part(as_col(doi), "NO_doi", F.lower),
    ]
    return F.concat(F.concat_ws("_", *parts), F.lit(".pdf"))


def sanitize_filename(doi: Column | str) -> Column:
    return F.concat(F.regexp_replace(as_col(doi), NOT_NAME_CHAR, "_"), F.lit(".pdf"))


def _url_file(url: Column) -> Column:
    path = F.regexp_replace(F.substring_index(url, "?", 1), "/+$", "")
    return F.nullif(F.substring_index(path, "/", -1), F.lit(""))


def _header_file(header: Column) -> Column:
    parts = F.transform(F.split(header, ";"), strip)
    named = F.get(F.filter(parts, lambda p: F.lower(p).startswith("filename=")), F.lit(0))
    value = F.btrim(strip(F.substr(named, F.lit(10))), F.lit('"'))
    return F.when(header.contains("filename="), F.nullif(value, F.lit("")))


def resolve_pdf_filename(
    content_disposition: Column | str,
    final_url: Column | str,
    url: Column | str,
    fallback: Column | str | None = None,
    forced: Column | str | None = None,
) -> Column:
    """Name to save a download under; null where no ``.pdf`` name can be found.

    A forced name wins. Otherwise the response header, the final URL and the first URL are
    tried in turn, and the fallback replaces a name that is not a PDF's.
    """
    none = F.lit(None).cast("string")
    fallback = none if fallback is None else as_col(fallback)
    forced = none if forced is None else as_col(forced)
    found = F.coalesce(
        _header_file(as_col(content_disposition)), _url_file(as_col(final_url)), _url_file(as_col(url))
    )
    return F.coalesce(forced, F.when(F.lower(found).endswith(".pdf"), found).otherwise(fallback))


def stem(file_name: Column | str) -> Column:
    """File name without ``.pdf`` in any case."""
    return F.regexp_replace(as_col(file_name), r"(?i)\.pdf$", "")


def companion(file_name: Column | str, ext: str) -> Column:
    return F.concat(stem(file_name), F.lit(f".{ext}"))


def search_id(file_name: Column | str) -> Column:
    """Search a file belongs to: extension and role are taken off."""
    return F.regexp_replace(as_col(file_name), r"(__results|__filtered)?\.[^.]+$", "")


def split_name(file_name: Column | str) -> Column:
    """Struct of stem and extension (without the dot); a leading dot starts no extension."""
    name = as_col(file_name)
    pattern = r"^(.+)\.([^.]*)$"
    has_ext = name.rlike(pattern)
    return F.struct(
        F.when(has_ext, F.regexp_extract(name, pattern, 1)).otherwise(name).alias("stem"),
        F.when(has_ext, F.regexp_extract(name, pattern, 2)).otherwise(F.lit("")).alias("ext"),
    )
