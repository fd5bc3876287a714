"""Stored runs: a second batch is answered from the first, a failed or repeated batch adds nothing twice."""

import json

import pytest
from corrobora.operators import intake
from corrobora.plans import run_table
from corrobora.plans.stand_ins import passage_reader
from pyspark.sql import functions as F

TEXTS = {1: "payment is due within thirty days of the invoice date in every case", 2: "payment is due within thirty days of receipt unless otherwise agreed",
         3: "late fees apply to payment that is overdue by more than a week or so"}


def given(spark):
    rows = [("a", d, 0, t, f"doc_{d}.pdf", None, None, 0, "text", None) for d, t in TEXTS.items()]
    passages = spark.createDataFrame(rows, "scope string, doc_id long, ordinal int, text string, document string, page int, section string, paragraph int, extraction_method string, ocr_confidence double")
    passages = passages.withColumn("text_hash", F.sha2("text", 256))
    return {"passages": passages, "documents": passages.select("scope", F.lit("ready").alias("status"), F.col("text_hash").alias("sha256"))}


def asked(spark, rows):
    return spark.createDataFrame(rows, "question_id long, scope string, question string, fresh boolean")


def reply(prompts):
    called = intake.call_models(prompts, passage_reader, ["m"], 1)
    return intake.resolve(prompts, intake.recorded(called).limit(0), called, "live")


def test_batches(spark, tmp_path):
    path, inputs = f"{tmp_path}/runs", given(spark)
    first = [(1, "a", "when is payment due at all", False), (2, "a", "When  is payment due at ALL", False), (3, "a", "?" * 600, False), (4, "nowhere", "when is payment due", False)]
    fail = {"now": True}

    def flaky(prompts):
        if fail["now"]:
            raise RuntimeError("the model is not there")
        return reply(prompts)

    with pytest.raises(RuntimeError):
        run_table.answer_batch(asked(spark, first), path=path, batch_id=1, system="s", reply=flaky, **inputs)
    assert run_table.read_runs(spark, path).count() == 0
    fail["now"] = False
    for _ in range(2):                             # the batch, and the batch repeated
        out = {r.run_id: r for r in run_table.answer_batch(asked(spark, first), path=path, batch_id=1, system="s", reply=flaky, **inputs).collect()}
        assert out[1].state == out[2].state and not out[1].cached and out[2].cached and out[3].code == "question_too_long"
        assert out[4].state == "INSUFFICIENT" and out[4].rule == 2
        assert sorted(r.run_id for r in run_table.read_runs(spark, path).collect()) == [1, 4]
    assert json.loads(out[1].result_json)["signals"]["claims_verified"] == 3
    # the same questions again: all from the first batch, unless asked anew or the documents have changed
    fail["now"] = True
    again = run_table.answer_batch(asked(spark, [(10, "a", "when is payment due at all", False), (4, "nowhere", "when is payment due", False)]), path=path, batch_id=2, system="s", reply=flaky, **inputs)
    assert {(r.run_id, r.cached, r.from_batch) for r in again.collect()} == {(10, True, 1), (4, True, 1)} and run_table.read_runs(spark, path).count() == 2
    fail["now"] = False
    anew = run_table.answer_batch(asked(spark, [(1, "a", "when is payment due at all", True)]), path=path, batch_id=3, system="s", reply=flaky, **inputs).collect()
    assert not anew[0].cached and run_table.read_runs(spark, path).count() == 3
    other = given(spark)
    other["documents"] = other["documents"].filter("sha256 <> ''").limit(2)
    assert not run_table.answer_batch(asked(spark, [(1, "a", "when is payment due at all", False)]), path=path, batch_id=4, system="s", reply=flaky, **other).first().cached


def test_a_degraded_run_is_not_served(spark, tmp_path):
    path, inputs = f"{tmp_path}/runs", given(spark)
    nothing = lambda prompts: prompts.select("question_id", "recording_key", F.lit(None).cast("string").alias("raw_response"), F.lit(None).cast("string").alias("model"), F.lit("none").alias("llm_source"))
    rows = [(1, "a", "when is payment due", False), (2, "a", "when is payment due", False)]
    out = run_table.answer_batch(asked(spark, rows), path=path, batch_id=1, system="s", reply=nothing, **inputs).collect()
    assert [(r.state, r.rule, r.degraded, r.cached) for r in out] == [("LOW", 1, True, False)] * 2 and run_table.read_runs(spark, path).count() == 2
    later = run_table.answer_batch(asked(spark, rows[:1]), path=path, batch_id=2, system="s", reply=reply, **inputs).first()
    assert not later.cached and later.rule != 1
