"""Document text -> numbered paragraphs -> located passages.

A document is one row and its paragraphs are one array, so everything here is a narrow column expression: no shuffle,
no window and no grouping, whatever the size or skew of the corpus. An uploaded file is at most 20 MB, which bounds the
array. `paras` is array<struct<page,method,confidence,text,heading>> (and `no`, once numbered).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as tx
from ..functions.text import let

CHUNK = "struct<page:int,section:string,paragraph:int,method:string,confidence:double,text:string>"


def text_paragraphs(text: Column) -> Column:
    """Plain-text file -> array of raw blocks separated by blank lines (blank blocks dropped)."""
    blocks = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), rf"\n{fixed.WS}*\n")
    return F.filter(blocks, lambda b: tx.strip(b) != "")


def single_line(block: Column) -> Column:
    return ~tx.strip(block).contains("\n")


def text_file_paras(text: Column) -> Column:
    """Paragraph array of a plain-text file: no pages, lines joined, heading flag on one-line blocks."""
    return F.transform(text_paragraphs(text), lambda b: F.struct(
        F.lit(None).cast("int").alias("page"), F.lit("text").alias("method"), F.lit(None).cast("double").alias("confidence"),
        tx.join_lines(b).alias("text"), tx.is_heading(b, single_line(b)).alias("heading")))


def _replace(p: Column, **values: Column) -> Column:
    names = ["page", "method", "confidence", "text", "heading"]
    return F.struct(*[values.get(n, p[n]).alias(n) for n in names])


def cleaned(paras: Column, whole_text: Column) -> Column:
    """NFKC and single spaces; paragraphs that are empty or only a page number go."""
    def tidy(ps):
        texts = tx.nfkc_lines(F.transform(ps, lambda p: p["text"]), whole_text)
        return F.transform(F.arrays_zip(ps.alias("p"), texts.alias("t")),
                           lambda z: _replace(z["p"], text=tx.squeeze(z["t"])))
    return F.filter(tidy(paras), lambda p: (p["text"] != "") & ~tx.is_page_number(p["text"]))


def _drop_edge(paras: Column, pages: Column, step: int) -> Column:
    """Drop the first (step -1) or last (step 1) paragraph of every page where more than half of the pages share it.

    A text on more than half of the pages is the middle element of the sorted edge texts, so one sort finds it.
    """
    def drop(ps):
        def edge(p, i):
            other = F.get(ps, i + step)
            return p["page"].isNotNull() & (other.isNull() | ~other["page"].eqNullSafe(p["page"]))

        texts = F.array_sort(F.transform(F.filter(ps, edge), lambda p: p["text"]))

        def decide(ts):
            middle = F.get(ts, F.floor(F.size(ts) / 2).cast("int"))
            repeated = (F.length(middle) <= fixed.HEADER_MAX_CHARS) & (
                F.size(F.filter(ts, lambda t: t == middle)) * 2 > pages)
            return let(F.when(repeated, middle), lambda m: F.filter(
                ps, lambda p, i: ~(edge(p, i) & F.coalesce(p["text"] == m, F.lit(False)))))
        return let(texts, decide)
    return let(paras, drop)


def without_headers(paras: Column) -> Column:
    """Repeated page headers, then repeated page footers of what remains, for documents of three or more pages."""
    def apply(ps):
        pages = F.size(F.array_distinct(F.transform(F.filter(ps, lambda p: p["page"].isNotNull()), lambda p: p["page"])))
        return let(pages, lambda n: F.when(
            n >= fixed.HEADER_MIN_PAGES, _drop_edge(_drop_edge(ps, n, -1), n, 1)).otherwise(ps))
    return let(paras, apply)


def numbered(paras: Column) -> Column:
    """Running paragraph number over the whole document, headings counted."""
    return F.transform(paras, lambda p, i: F.struct(
        (i + 1).cast("int").alias("no"), *[p[n].alias(n) for n in ("page", "method", "confidence", "text", "heading")]))


def with_sections(paras: Column) -> Column:
    """Numbered paragraphs with the last heading seen; cut once per heading, so the cost is linear."""
    def carry(ps):
        starts = F.filter(F.sequence(F.lit(1), F.size(ps)), lambda i: (i == 1) | F.element_at(ps, i)["heading"])

        def cut(st):
            def section(s, k):
                end = F.coalesce(F.get(st, k + 1), F.size(ps) + 1)
                head = F.element_at(ps, s)
                label = F.when(head["heading"], head["text"])
                return F.transform(F.slice(ps, s, end - s), lambda p: F.struct(
                    *[p[n].alias(n) for n in ("no", "page", "method", "confidence", "text", "heading")], label.alias("section")))
            return F.flatten(F.transform(st, section))
        return F.when(F.size(ps) > 0, let(starts, cut))
    return let(paras, carry)


def chunked(paras: Column) -> Column:
    """Numbered paragraphs -> passages: page-bounded, about 900 characters, a heading opens its passage."""
    target = fixed.TARGET_CHARS
    start = F.struct(
        F.expr(f"cast(array() as array<{CHUNK}>)").alias("done"), F.lit(None).cast("string").alias("text"),
        F.lit(0).alias("first"), F.lit(False).alias("body"), F.lit(None).cast("string").alias("section"),
        F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("method"),
        F.lit(None).cast("double").alias("confidence"))

    def closed(acc):
        return F.array_append(acc["done"], F.struct(
            acc["page"].alias("page"), acc["section"].alias("section"), acc["first"].alias("paragraph"),
            acc["method"].alias("method"), acc["confidence"].alias("confidence"), acc["text"].alias("text")))

    def step(acc, p):
        pending = acc["text"].isNotNull()
        held = pending & acc["page"].eqNullSafe(p["page"])
        is_long = ~p["heading"] & (F.length(p["text"]) > fixed.MAX_PARAGRAPH_CHARS)
        overflow = acc["body"] & (F.length(acc["text"]) + 1 + F.length(p["text"]) > target)
        waiting_heading = held & ~acc["body"]
        close = pending & (~held | p["heading"] | F.when(is_long, acc["body"]).otherwise(overflow))
        done = F.when(close, closed(acc)).otherwise(acc["done"])

        def piece(t, i):
            prefixed = waiting_heading & (i == 0)
            return F.struct(
                p["page"].alias("page"), acc["section"].alias("section"),
                F.when(prefixed, acc["first"]).otherwise(p["no"]).alias("paragraph"), p["method"].alias("method"),
                p["confidence"].alias("confidence"),
                F.when(prefixed, F.concat(acc["text"], F.lit("\n"), t)).otherwise(t).alias("text"))

        joins = held & ~p["heading"] & ~overflow
        return F.struct(
            F.when(is_long, F.concat(done, F.transform(tx.split_long(p["text"]), piece))).otherwise(done).alias("done"),
            F.when(is_long, F.lit(None).cast("string")).when(joins, F.concat(acc["text"], F.lit("\n"), p["text"]))
             .otherwise(p["text"]).alias("text"),
            F.when(joins, acc["first"]).otherwise(p["no"]).alias("first"),
            (~is_long & ~p["heading"]).alias("body"),
            F.when(p["heading"], p["text"]).otherwise(acc["section"]).alias("section"),
            p["page"].alias("page"), p["method"].alias("method"), p["confidence"].alias("confidence"))

    return F.aggregate(paras, start, step, lambda acc: F.when(acc["text"].isNotNull(), closed(acc)).otherwise(acc["done"]))


def small_merged(chunks: Column) -> Column:
    """A passage under 40 characters joins the previous kept passage of its page, else it is dropped."""
    def step(acc, c):
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(*[last[n].alias(n) for n in ("page", "section", "paragraph", "method", "confidence")],
                         F.concat(last["text"], F.lit("\n"), c["text"]).alias("text"))
        joins = (F.size(acc) > 0) & last["page"].eqNullSafe(c["page"])
        return F.when(F.length(c["text"]) >= fixed.MIN_CHUNK_CHARS, F.array_append(acc, c)).when(
            joins, F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), grown)).otherwise(acc)
    return F.aggregate(chunks, F.expr(f"cast(array() as array<{CHUNK}>)"), step)


def passages(documents: DataFrame, keep: list[str], whole_text: str = "text") -> DataFrame:
    """Documents with raw `paras` -> one row per passage: ordinal, location, text and text hash."""
    ready = small_merged(chunked(numbered(without_headers(cleaned(F.col("paras"), F.col(whole_text))))))
    rows = documents.select(*keep, F.posexplode(ready).alias("ordinal", "c"))
    return rows.select(*keep, "ordinal", "c.page", "c.section", F.col("c.paragraph").alias("paragraph"),
                       F.col("c.method").alias("extraction_method"), F.col("c.confidence").alias("ocr_confidence"),
                       "c.text", tx.text_hash(F.col("c.text")).alias("text_hash"))


def document_rollup(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Pages, passages and extraction method per document."""
    return chunks.groupBy(*keys).agg(
        F.max("page").alias("page_count"), F.count(F.lit(1)).alias("chunk_count"),
        F.when(F.min("extraction_method") != F.max("extraction_method"), "mixed")
         .otherwise(F.min("extraction_method")).alias("extraction_method"))


def document_status(documents: DataFrame, chunks: DataFrame, keys: list[str], error: str = "parse_error") -> DataFrame:
    """ready / failed per document; a failure stays in its own row."""
    counts = chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunk_count"))
    joined = documents.join(counts, keys, "left")
    failed = F.col(error).isNotNull() | F.col("chunk_count").isNull()
    return joined.select(
        *keys, F.when(failed, "failed").otherwise("ready").alias("status"),
        F.when(F.col(error).isNotNull(), F.col(error)).when(failed, fixed.NO_TEXT).alias("error_message"),
        F.when(failed, 0).otherwise(F.coalesce("chunk_count", F.lit(0))).cast("bigint").alias("chunk_count"))
