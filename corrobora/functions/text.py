"""Text columns: whitespace, cleaning, hashing, headings, tokens. All run inside the JVM except NFKC."""

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed

# Characters that NFKC leaves alone; text made only of these never goes to Python.
_NFKC_STABLE = r"[^\x00-\x7fÀ-ÿ–—‘’“”]"


def let(value: Column, body) -> Column:
    """Bind an expression once and use it many times inside one column expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(frame: DataFrame, **columns: Column) -> DataFrame:
    """Sets columns that are computed once per row, however often they are named afterwards (a projection would be merged into its uses, also into lambdas)."""
    kept = [F.col(c) for c in frame.columns if c not in columns]
    return frame.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(fixed.WS_CHARS))


def squeeze(c: Column) -> Column:
    """Single spaces, no leading or trailing space."""
    return F.trim(F.regexp_replace(c, rf"{fixed.WS}+", " "))


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_all(values: pd.Series) -> pd.Series:
    return values.map(lambda vs: None if vs is None else [unicodedata.normalize("NFKC", v) for v in vs])


def needs_nfkc(c: Column) -> Column:
    return c.rlike(_NFKC_STABLE)


def clean(c: Column) -> Column:
    """NFKC, then single spaces. Only text that can change under NFKC is sent to Python."""
    return squeeze(F.coalesce(_nfkc(F.when(needs_nfkc(c), c)), c))


def nfkc_lines(lines: Column, whole_text: Column) -> Column:
    """NFKC of every string of an array; the array is sent to Python only if its text can change."""
    return F.coalesce(_nfkc_all(F.when(needs_nfkc(whole_text), lines)), lines)


def text_hash(c: Column) -> Column:
    return F.sha2(squeeze(F.lower(c)), 256)


def join_lines(block: Column) -> Column:
    """One line from many: a word hyphenated across a line break is repaired, other breaks become a space."""
    trimmed = strip(F.regexp_replace(block, rf"{fixed.WS}*\n{fixed.WS}*", "\n"))
    return F.replace(F.regexp_replace(trimmed, r"(?<=\p{L})-\n(?=\p{Ll})", ""), F.lit("\n"), F.lit(" "))


def is_heading(text: Column, single_line: Column, styled: Column | None = None) -> Column:
    """`styled` is true when the layout marks the line (large font, bold, heading style)."""
    styled = F.lit(False) if styled is None else styled
    return let(strip(text), lambda t: (
        single_line & (t != "") & (F.length(t) <= fixed.HEADING_MAX_CHARS)
        & ~F.right(t, F.lit(1)).isin(".", ",", ";") & ~t.rlike(fixed.COLON_THEN_TEXT)
        & (styled | t.rlike(fixed.HEADING)
           | (t.rlike(rf"[^\s\p{{Z}}]{fixed.WS}+[^\s\p{{Z}}]") & (F.upper(t) == t) & (F.lower(t) != t)))))


def is_page_number(c: Column) -> Column:
    return c.rlike(fixed.PAGE_NUMBER)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(fixed.TOKEN), F.lit(1))


def passage_tokens(c: Column) -> Column:
    """Tokens of a stored passage; a passage without any gets one placeholder."""
    return let(tokens(c), lambda t: F.when(F.size(t) == 0, F.array(F.lit("_"))).otherwise(t))


def base_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def extension(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def split_long(text: Column) -> Column:
    """Sentences packed greedily up to the target size; a longer sentence is first cut at every target size.

    A cut piece is exactly the target size, so nothing can join it and one packing pass is enough.
    """
    size = fixed.TARGET_CHARS
    units = F.flatten(F.transform(
        F.split(text, fixed.SENTENCE_END),
        lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(s) - 1) / size).cast("int"))),
                              lambda i: F.substring(s, i * size + 1, F.lit(size)))))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("cur"))

    def pack(acc, unit):
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + 1 + F.length(unit) > size)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["cur"] == ""), unit).otherwise(F.concat(acc["cur"], F.lit(" "), unit)).alias("cur"))

    return F.aggregate(units, start, pack,
                       lambda acc: F.when(acc["cur"] != "", F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]))
