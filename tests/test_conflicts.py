import random
from itertools import combinations

from corrobora.operators import conflicts as cf
from corrobora.operators import rating


def brute_status(claims):
    if not claims:
        return "uncovered"
    for a, b in combinations(claims, 2):
        ka, kb = a["position_key"], b["position_key"]
        if not ka or not kb or ka == kb or ka.split(":")[0] != kb.split(":")[0]:
            continue
        ua, ub = ka.split("|")[1], kb.split("|")[1]
        if ua and ub and ua != ub:
            continue
        if a["text_hash"] != b["text_hash"] and (not a["scope"] or not b["scope"] or a["scope"] == b["scope"]):
            return "conflict"
    return "complementary" if len({c["position_key"] for c in claims if c["position_key"]}) > 1 else "consistent"


def test_table_form_run_form_and_pairs_agree(spark):
    rng = random.Random(5)
    claims, want = [], {}
    for run in range(300):
        own = []
        for no in range(rng.randint(0, 5)):
            h = rng.choice("abc")
            own.append(dict(run_id=run, claim_no=no, claim_id=f"C{no}", aspect_id="A1", value="v", value_type="number", scope=rng.choice([None, None, "x", "y"]),
                            position_key=rng.choice([None, "quantity:1|day", "quantity:2|day", "quantity:2|", "quantity:3|month"]), explicit=True, chunk_id=h, text_hash=h,
                            document_id=1, document="d", page=1, section="s", paragraph=1, quote="q", extraction_method="text", ocr_quality=None))
        want[run] = brute_status(own)
        claims += own
    schema = ("run_id int, claim_no int, claim_id string, aspect_id string, value string, value_type string, position_key string, scope string, explicit boolean, chunk_id string, "
              "text_hash string, document_id int, document string, page int, section string, paragraph int, quote string, extraction_method string, ocr_quality string")
    fields = [f.split()[0] for f in schema.split(", ")]
    frame = spark.createDataFrame([tuple(c[f] for f in fields) for c in claims], schema)
    aspects = spark.createDataFrame([(r, 1, "A1", "Term") for r in range(300)], "run_id int, aspect_no int, aspect_id string, label string")
    merged = cf.merge_aspects(aspects)
    assert {r.run_id: r.status for r in cf.aspect_status(merged, cf.repoint(frame, merged)).collect()} == want
    runs = spark.createDataFrame([(r, False, False, True) for r in range(300)], "run_id int, evidence_only boolean, check_failed boolean, has_documents boolean")
    notes = spark.createDataFrame([], "run_id int, entry_no int, aspect_id string, note string, chunk_id string, document_id int, document string, page int, section string, paragraph int, quote string, extraction_method string, ocr_quality string")
    from pyspark.sql import functions as F
    rows = cf.case_rows(runs, aspects, frame.withColumn("drop_reason", F.lit(None).cast("string")), notes)
    assert {r.run_id: r.results[0].status for r in rows.collect()} == want
    assert len(rating.SIGNALS) == 18
