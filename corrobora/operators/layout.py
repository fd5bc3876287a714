"""Layout rows from file parsers: spans, table cells and recognised text boxes -> blocks, sizes and paragraphs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import fixed
from ..functions import text as tx


def ordered_join(value: Column, order: list[Column], separator: str) -> Column:
    """Aggregate: strings of one short group joined in the given order."""
    rows = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), separator)


def table_rows(cells: DataFrame, keys: list[str], column: str, text: str) -> DataFrame:
    """Cells of a table row, trimmed and joined by ' | '; rows without any text are dropped."""
    return (cells.groupBy(*keys).agg(ordered_join(tx.strip(F.col(text)), [F.col(column)], " | ").alias("text"),
                                     F.max(tx.strip(F.col(text)) != "").alias("any_text"))
            .filter("any_text").drop("any_text"))


def body_size(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Character-weighted median font size. Sizes have one decimal, so a document has few distinct ones."""
    sizes = (spans.filter(tx.strip(F.col("text")) != "").groupBy(doc, F.round("size", 1).alias("size"))
             .agg(F.sum(F.length("text")).alias("chars")))
    by_size = W.partitionBy(doc).orderBy("size")
    marked = sizes.select(doc, "size", F.sum("chars").over(by_size).alias("running"),
                          F.sum("chars").over(W.partitionBy(doc)).alias("total"))
    return marked.filter("running * 2 >= total").groupBy(doc).agg(F.min("size").alias("body_size"))


def lines_and_blocks(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of spans (lines without text dropped), then blocks of lines with size and boldness of their text spans."""
    visible = tx.strip(F.col("text")) != ""
    bold = F.col("flags").bitwiseAND(16).cast("boolean") | F.lower("font").contains("bold")
    lines = (spans.groupBy("doc_id", "page", "block", "line")
             .agg(ordered_join(F.col("text"), [F.col("span")], "").alias("text"), F.max(visible).alias("any_text"),
                  F.max(F.when(visible, F.col("size"))).alias("max_size"), F.min(F.when(visible, bold)).alias("all_bold"))
             .filter("any_text"))
    blocks = lines.groupBy("doc_id", "page", "block").agg(
        ordered_join(F.col("text"), [F.col("line")], "\n").alias("raw"), F.count(F.lit(1)).alias("lines"),
        F.sum(F.length("text")).alias("chars"), F.max("max_size").alias("max_size"), F.min("all_bold").alias("all_bold"))
    return lines, blocks.withColumn("text", tx.join_lines(F.col("raw")))


def block_headings(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Heading flag of a block from its size against the body size, its boldness and its wording."""
    big = F.coalesce((F.col("body_size") > 0) & (F.col("max_size") >= fixed.BIG_FONT_RATIO * F.col("body_size")), F.lit(False))
    return blocks.join(sizes, "doc_id", "left").withColumn(
        "heading", tx.is_heading(F.col("text"), F.col("lines") == 1, big | F.coalesce("all_bold", F.lit(False))))


def ocr_route(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages with fewer than 20 characters of text (also pages without any block) go to recognition."""
    chars = blocks.groupBy("doc_id", "page").agg(F.sum("chars").alias("chars"))
    joined = pages.join(chars, ["doc_id", "page"], "left")
    return joined.select("doc_id", "page", F.coalesce("chars", F.lit(0)).cast("bigint").alias("text_chars"),
                         (F.coalesce("chars", F.lit(0)) < fixed.MIN_PAGE_TEXT_CHARS).alias("to_ocr"))


def ocr_page_stats(boxes: DataFrame) -> DataFrame:
    """Mean score, median height (1 when it is 0) and line count per page of recognised boxes."""
    return boxes.filter(tx.strip(F.col("text")) != "").groupBy("doc_id", "page").agg(
        F.avg("score").alias("confidence"),
        F.expr("nullif(median(bottom - top), 0)").alias("height"),
        F.count(F.lit(1)).alias("boxes")).withColumn("height", F.coalesce("height", F.lit(1.0)))


def ocr_paragraphs(boxes: DataFrame) -> DataFrame:
    """Boxes -> visual rows -> paragraphs per page, in reading order.

    A box joins the current row when its centre is within half a median height of the row's mean centre. That is a
    running mean, so the sorted boxes of one page (one image, a few hundred boxes) are folded in one array expression.
    """
    page = boxes.filter(tx.strip(F.col("text")) != "").withColumn("text", tx.strip(F.col("text"))).groupBy("doc_id", "page").agg(
        F.sort_array(F.collect_list(F.struct(((F.col("top") + F.col("bottom")) / 2).alias("center"), "seq", "left", "top",
                                             "bottom", "text"))).alias("boxes"),
        F.avg("score").alias("confidence"),
        F.coalesce(F.expr("nullif(median(bottom - top), 0)"), F.lit(1.0)).alias("height"))
    box = "struct<center:double,seq:bigint,left:double,top:double,bottom:double,text:string>"
    start = F.expr(f"named_struct('rows', cast(array() as array<array<{box}>>), 'row', cast(array() as array<{box}>), 'sum', 0D)")

    def fold(acc, b):
        near = (F.size(acc["row"]) > 0) & (b["center"] - acc["sum"] / F.size(acc["row"]) <= fixed.OCR_ROW_GAP * F.col("height"))
        return F.struct(
            F.when(near | (F.size(acc["row"]) == 0), acc["rows"]).otherwise(F.array_append(acc["rows"], acc["row"])).alias("rows"),
            F.when(near, F.array_append(acc["row"], b)).otherwise(F.array(b)).alias("row"),
            F.when(near, acc["sum"] + b["center"]).otherwise(b["center"]).alias("sum"))

    rows = F.aggregate("boxes", start, fold, lambda a: F.array_append(a["rows"], a["row"]))
    shaped = F.transform(rows, lambda r: F.struct(
        F.array_min(F.transform(r, lambda b: b["top"])).alias("top"), F.array_max(F.transform(r, lambda b: b["bottom"])).alias("bottom"),
        # the sort is stable, so boxes at the same left edge keep their top-to-bottom order
        F.array_join(F.transform(F.array_sort(r, lambda a, b: F.signum(a["left"] - b["left"]).cast("int")),
                                 lambda b: b["text"]), " ").alias("text")))
    paragraphs = F.aggregate(
        shaped, F.expr("named_struct('done', cast(array() as array<string>), 'cur', cast(null as string), 'bottom', cast(null as double))"),
        lambda acc, r: F.struct(
            F.when(acc["cur"].isNotNull() & (r["top"] - acc["bottom"] > fixed.OCR_PARAGRAPH_GAP * F.col("height")),
                   F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"),
            F.when(acc["cur"].isNotNull() & (r["top"] - acc["bottom"] <= fixed.OCR_PARAGRAPH_GAP * F.col("height")),
                   F.concat(acc["cur"], F.lit("\n"), r["text"])).otherwise(r["text"]).alias("cur"),
            r["bottom"].alias("bottom")),
        lambda a: F.array_append(a["done"], a["cur"]))
    out = page.select("doc_id", "page", "confidence", F.posexplode(paragraphs).alias("paragraph_no", "raw"))
    return out.select("doc_id", "page", "paragraph_no", tx.join_lines(F.col("raw")).alias("text"),
                      tx.is_heading(F.col("raw"), ~F.col("raw").contains("\n")).alias("heading"), "confidence")


def quality_band(method: Column, confidence: Column) -> Column:
    """NULL for text; 'low' below 0.80, else 'good' for recognised text."""
    return F.when(method == "ocr", F.when(confidence < fixed.OCR_LOW, "low").otherwise("good"))
