from pyspark.sql import functions as F

from corrobora.functions import text as tx
from corrobora.operators import documents as docs
from corrobora.operators import layout

PARA = "array<struct<page:int,method:string,confidence:double,text:string,heading:boolean>>"


def passages(spark, paras):
    frame = spark.createDataFrame([(1, [(p, "text", None, t, h) for p, t, h in paras], " ".join(t for _, t, _ in paras))], f"doc_id int, paras {PARA}, text string")
    return docs.passages(frame, ["doc_id"]).orderBy("ordinal").collect()


def test_heading_opens_a_passage_and_pages_are_not_crossed(spark):
    body = "word " * 30
    got = passages(spark, [(1, "1. Terms", True), (1, body, False), (2, body + "next page", False), (2, "2. Fees", True), (3, body, False)])
    assert [(r.page, r.section, r.paragraph) for r in got] == [(1, "1. Terms", 1), (2, "1. Terms", 3), (3, "2. Fees", 5)]
    assert got[0].text == "1. Terms\n" + body.strip()
    assert got[1].text.endswith("next page\n2. Fees")  # a lone heading is small and joins the passage before it


def test_packing_keeps_every_word(spark):
    paras = [(None, f"Sentence {i} of paragraph number {i}. " * (i % 7 * 9 + 1), False) for i in range(40)]
    got = passages(spark, paras)
    assert " ".join(" ".join(r.text.split()) for r in got) == " ".join(" ".join(t.split()) for _, t, _ in paras)
    assert all(len(r.text) <= 1200 for r in got) and [r.ordinal for r in got] == list(range(len(got)))


def test_headers_footers_and_page_numbers_go(spark):
    paras = [row for p in range(1, 5) for row in ((p, "Confidential", False), (p, f"Body text of page {p} which is long enough to keep", False), (p, "Draft", False), (p, f"Page {p} of 4", False))]
    assert {r.text for r in passages(spark, paras)} == {f"Body text of page {p} which is long enough to keep" for p in range(1, 5)}


def test_emptied_pages_do_not_fail(spark):
    assert passages(spark, [(p, "Same", False) for p in range(1, 5)]) == []


def test_text_files(spark):
    text = "Term Sheet Overview\r\n\r\nThe inter-\n national terms\napply.\n \t\nNotes: none\n"
    paras = spark.createDataFrame([(text,)], "t string").select(docs.text_file_paras(F.col("t")).alias("p")).first().p
    assert [(p.text, p.heading) for p in paras] == [("Term Sheet Overview", False), ("The international terms apply.", False), ("Notes: none", False)]
    flags = spark.createDataFrame([("2.1 Scope",), ("Section 4",), ("GENERAL TERMS",), ("Ends here.",), ("30 days notice",), ("ALLCAPS",)], "t string")
    assert [r[0] for r in flags.select(tx.is_heading(F.col("t"), F.lit(True))).collect()] == [True, True, True, False, True, False]


def test_recognised_boxes(spark):
    boxes = [(1, 1, 0, 0.0, 0.0, 10.0, "left", 0.9), (1, 1, 1, 50.0, 1.0, 11.0, "right", 0.7), (1, 1, 2, 0.0, 14.0, 24.0, "second", 0.8), (1, 1, 3, 0.0, 60.0, 70.0, "apart", 0.8)]
    frame = spark.createDataFrame(boxes, "doc_id int, page int, seq bigint, left double, top double, bottom double, text string, score double")
    assert [r.text for r in layout.ocr_paragraphs(frame).orderBy("paragraph_no").collect()] == ["left right second", "apart"]
