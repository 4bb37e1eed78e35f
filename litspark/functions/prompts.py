"""Prompt templates: ``{{ name }}`` is replaced by the data column of that name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litspark.functions.text import as_col

SLOT = r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}"


def template_text(c: Column | str) -> Column:
    """A template file's text: one line end at the very end does not count."""
    return F.regexp_replace(as_col(c), r"\r?\n\z", "")


def data_context(row_id: Column | str, columns: list[str]) -> Column:
    """Map from lower-cased column name to text. Missing values give empty text."""
    values: dict[str, Column] = {
        name.lower(): F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) for name in columns
    }
    values["id"] = as_col(row_id)
    return F.create_map(*[x for name, value in values.items() for x in (F.lit(name), value)])


def render_prompt(template: Column | str, context: Column | str) -> Column:
    """Fill the slots; a name the data does not have stays as ``{{ name }}``.

    The template is taken apart per row, so any number of templates fits one plan.
    """
    template, context = as_col(template), as_col(context)
    texts = F.split(template, SLOT)
    names = F.regexp_extract_all(template, F.lit(SLOT), F.lit(1))

    def fill(name: Column, i: Column) -> Column:
        value = F.coalesce(
            F.try_element_at(context, name), F.concat(F.lit("{{ "), name, F.lit(" }}"))
        )
        return F.concat(value, F.get(texts, i + 1))

    return F.concat(F.get(texts, F.lit(0)), F.array_join(F.transform(names, fill), ""))
