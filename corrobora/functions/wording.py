"""Wording helpers for sentences built from counts and names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def text(c) -> Column:
    return c.cast("string")


def counted(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(text(n), F.when(n == 1, f" {one}").otherwise(f" {many or one + 's'}"))


def lower_first(c: Column) -> Column:
    return F.concat(F.lower(F.left(c, F.lit(1))), F.substr(c, F.lit(2), F.length(c)))


def joined(names: Column) -> Column:
    """'A', 'A and B', 'A, B and C'."""
    return let(names, lambda ns: F.when(F.size(ns) > 1, F.concat(
        F.array_join(F.slice(ns, F.lit(1), F.size(ns) - 1), ", "), F.lit(" and "), F.element_at(ns, -1))).otherwise(F.array_join(ns, "")))


def sentence(template: str, *parts: Column) -> Column:
    return F.format_string(template, *parts)


def location(page: Column, section: Column, paragraph: Column) -> Column:
    """'Page 2 · 4.2 Terms', or the paragraph when the format has neither."""
    where = F.concat_ws(" · ", F.when(page.isNotNull(), F.concat(F.lit("Page "), text(page))), F.when(section != "", section))
    return let(where, lambda w: F.when(w != "", w).otherwise(F.concat(F.lit("Paragraph "), text(paragraph))))


def readable_name(filename: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(filename, r"\.[^.]+\z", ""), "_+", " "), r"\s+", " "))


def with_readable_names(sentence_text: Column, filenames: Column) -> Column:
    """Stored file names inside a sentence swapped for their readable form, one after the other."""
    return F.aggregate(filenames, sentence_text, lambda out, name: F.replace(out, name, readable_name(name)))
