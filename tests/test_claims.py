"""Stored claim lines and claims that are checked once."""

from corrobora.operators import verification as vf
from corrobora.plans import views
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stored_claim_lines_hold_no_texts(spark):
    views.claim_base(spark, SF)
    stored = spark.table(views._bases[(spark.sparkContext.applicationId, SF)])
    assert "text" not in stored.columns and "chunk_id" not in stored.columns
    lines = views.table(spark, SF, "lineitem")
    assert stored.count() == lines.count() == views.claim_base(spark, SF).select("run_id", "claim_no").distinct().count()


def test_equal_claims_are_checked_once_with_equal_results(spark):
    t = {n: views.claim_table(spark, SF, n).filter("run_id < 400") for n in ("claims", "evidence", "aspects")}
    plain, once = (vf.check_claims(t["claims"], t["evidence"], t["aspects"], once=o) for o in (False, True))
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, once.select(plain.columns).collect()))


def test_checks_of_equal_inputs_join_back_to_every_row(spark):
    rows = spark.createDataFrame([(i, "the sum is due", "The sum is due now." if i % 3 else None, i % 2 == 0) for i in range(12)], "i int, quote string, text string, scanned boolean")
    asked = []

    def check(frame):
        asked.append(frame.count())
        return vf.found_quotes(frame)
    got = vf.checked_once(rows, F.col("i") != 5, ["quote", "text", "scanned"], check, rows).select("i", "quote", "shown_quote").collect()
    want = {i: "The sum is due" if i % 3 and i != 5 else None for i in range(12)}
    assert asked == [4] and {r.i: r.shown_quote for r in got} == want and all(r.quote for r in got) and len(got) == 12


def test_claims_move_before_the_results_read_them(spark):
    from corrobora.operators import conflicts as cf
    run = spark.createDataFrame([(1, False, False, True)], "run_id long, check_failed boolean, evidence_only boolean, has_documents boolean")
    t = {n: views.claim_table(spark, SF, n) for n in ("claims", "evidence", "aspects", "entries", "note_evidence")}
    rows = cf.case_rows(run, t["aspects"], vf.check_claims(t["claims"], t["evidence"], t["aspects"]), vf.supersession_notes(t["entries"], t["note_evidence"]))
    plan = rows.select("results")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Generate inline" in line and "topics" in line for line in plan.splitlines()) == 1


def test_stored_claim_lines_are_rounded_once(spark):
    views.claim_base(spark, SF)
    kinds = dict(spark.table(views._bases[(spark.sparkContext.applicationId, SF)]).dtypes)
    assert kinds["quantity"] == kinds["discount"] == "int" and "round(" not in views.claim_base(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_spaces_to_strip_are_those_of_the_pattern(spark):
    from corrobora import fixed
    from corrobora.functions import text as tx
    points = spark.createDataFrame([(chr(i),) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000], "c string")
    assert {r.c for r in points.filter(F.col("c").rlike(fixed.WS)).collect()} == set(fixed.WS_CHARS)
    assert points.limit(1).select(tx.strip(F.lit("　 a b\x85\n"))).first()[0] == "a b"


def test_cases_gather_only_what_is_asked_for(spark):
    from corrobora.operators import conflicts as cf
    from corrobora.plans import q_conflicts as qc
    rows = qc.cases(spark, SF)
    assert [f.name for f in rows.schema["claims"].dataType.elementType.fields] == cf.POSITION
    assert "notes" not in rows.schema["results"].dataType.elementType.fieldNames()


def test_citations_read_arrays_that_are_built_once(spark):
    from corrobora.operators import composition as cm
    rows = spark.sql("""SELECT array(named_struct('claim_id', 'C1', 'aspect_id', 'A1', 'document', 'd', 'position_key', 'text:x', 'value', 'x', 'quote', 'q')) AS claims,
      array(named_struct('status', 'consistent', 'aspect_id', 'A1', 'positions', array(named_struct('documents', array('d'), 'display', 'x', 'claim_ids', array('C1'))))) AS results,
      array(named_struct('text', 'Said.', 'claims', array('C1')), named_struct('text', 'Not.', 'claims', array('C2'))) AS answer, id FROM range(2)""")
    done = cm.with_citations(cm.with_sentences(rows))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert all("inline" in line for line in plan.splitlines() if "array_union" in line)
    assert [(r.claims[0].citation, [s.text for s in r.sentences]) for r in done.collect()] == [(1, ["Said."])] * 2


def test_order_lines_are_numbered_without_shuffled_rows(spark):
    lines = views.table(spark, SF, "lineitem").select(*[F.expr(e).alias(c) for e, c in views._LINE.items()])
    placed = spark.table(views._bucketed(spark, lines, 4, "lines"))
    numbered = views.numbered_lines(spark, placed)
    assert "Exchange" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, numbered.collect())) == sorted(map(repr, views.numbered_lines(spark, lines).collect()))


def test_claims_are_checked_once_without_a_join_to_find_them(spark):
    t = {n: views.claim_table(spark, SF, n).filter("run_id < 400") for n in ("claims", "evidence", "aspects")}
    asked = views.claim_base(spark, SF).select("quote", "text", "extraction_method", "value", "value_type")
    plain = vf.check_claims(t["claims"], t["evidence"], t["aspects"])
    once = vf.check_claims(t["claims"], t["evidence"], t["aspects"], once=True, asked=asked)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, once.select(plain.columns).collect()))


def test_results_are_built_once_and_warnings_without_arrays(spark):
    from corrobora.plans import catalog
    catalog.load()
    plan = lambda name: catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan("cfl_positions").splitlines() if "Filter" in line]
    assert filters and not any("transform(" in line for line in filters)
    assert "collect_list" not in plan("unc_warnings")


def test_replies_are_read_once_and_gathered_in_place(spark):
    from corrobora.plans import catalog
    catalog.load()
    query = catalog.QUERIES["clm_lenient_validate"](spark, SF)._jdf.queryExecution()
    nodes = [line.split("- ")[-1] for line in query.executedPlan().toString().splitlines()]
    assert sum("ArrowEvalPython" in n for n in nodes) == 1 and not any("Exchange" in n or "Join" in n for n in nodes)


def test_only_replies_with_text_around_the_object_go_to_python(spark):
    from corrobora.operators import intake
    whole = ['{"claims":[{"a":"}"}]}', '```json\n{"claims":[{"a":"}\\""},2]}\n```']
    more = ['{"claims":[]}]}', '{"claims":[]}, "x"}', '{"claims":[]}}}', '{"claims":[]} {"claims":[1]}', 'so: {"claims":[]} done {', '{"claims":[]}, {"claims":"}x"}']
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(whole + more + ['{"claims":[', None])], "i int, raw_response string")
    got = [r.json for r in intake.with_json(rows).orderBy("i").collect()]
    assert got == ['{"claims":[{"a":"}"}]}', '{"claims":[{"a":"}\\""},2]}'] + ['{"claims":[]}'] * len(more) + [None, None]
    sent = []
    udf, intake._first_object = intake._first_object, lambda c: sent.append(c) or F.lit(None).cast("string")
    try:
        alone = [r.json for r in intake.with_json(rows).orderBy("i").collect()]
    finally:
        intake._first_object = udf
    assert sent and alone == got[:2] + [None] * (len(more) + 2)


def test_runs_are_composed_once_to_be_audited(spark, tmp_path):
    """Shown items with their counts come from one reading of the runs; a run that shows nothing, and one without related passages, keep their rows."""
    item = "struct<chunk_id:string,document_id:int,document:string,page:int,section:string,quote:string>"
    good, other = ("c1", 1, "a.pdf", 1, None, "due within"), ("c1", 2, "a.pdf", 1, None, "due within")
    rows = [(1, 1, [(*good, "C1"), (*other, "C2")], [good], [([other],), ([good],)], [(["C1", "C9"],), (["C2", "C9"],)]), (2, 2, [], [], [], []), (3, 3, [(*good, "C1")], None, [], [(["C1"],)])]
    claim = item[:-1] + ",claim_id:string>"
    spark.createDataFrame(rows, f"run_id long, scope long, claims array<{claim}>, related array<{item}>, results array<struct<notes:array<{item}>>>, sentences array<struct<claim_ids:array<string>>>").write.parquet(f"{tmp_path}/runs")
    stored = spark.createDataFrame([(1, "c1", 1, "a.pdf", 1, None, "payment is due within thirty days")], "scope long, chunk_id string, document_id int, document string, page int, section string, text string")
    out = vf.audit_runs(spark.read.parquet(f"{tmp_path}/runs"), stored)
    assert {tuple(r) for r in out.collect()} == {(1, 2, 1, 2, 1, 0, 1, 2), (2, 0, 0, 0, 0, 0, 0, 0), (3, 1, None, 0, 1, 0, 0, 0)}
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan parquet") == 1
