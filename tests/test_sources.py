from pyspark.sql import functions as F

from corrobora.operators import intake
from corrobora.sources import files, tables


def test_uploads_are_read_and_checked(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.txt").write_bytes("naïve café – ok".encode("cp1252"))
    (tmp_path / "c.txt").write_bytes(b"bad\x00text")
    (tmp_path / "d.docx").write_bytes(b"%PDF")
    (tmp_path / "e.exe").write_bytes(b"MZ")
    (tmp_path / "f.JPEG").write_bytes(b"\xff\xd8\xff\xe0")
    (tmp_path / "h.txt").write_bytes(b"x" * 2000)
    rows = files.validate(files.read_uploads(spark, str(tmp_path), max_bytes=1000), max_bytes=1000)
    got = {r.name: (r.ext, r.reject_reason) for r in rows.collect()}
    assert got["a.pdf"] == ("pdf", None) and got["b.txt"] == ("txt", None) and got["f.JPEG"] == ("jpg", None)
    assert got["c.txt"][1] == got["d.docx"][1] == "File content does not match its extension"
    assert got["e.exe"][1] == "Unsupported file type" and got["h.txt"][1].startswith("File is larger")
    empty = spark.createDataFrame([("g.txt", bytearray(), 0)], "name string, content binary, size bigint")
    assert files.validate(empty).first().reject_reason == "File is empty"
    (tmp_path / "g.txt").write_bytes(b"")
    manifest = spark.createDataFrame([("a.pdf", 10), ("g.txt", 0), ("lost.txt", 7)], "name string, size int")
    listed = {r.name: (r.size, r.reject_reason) for r in files.validate(files.read_uploads(spark, str(tmp_path), max_bytes=1000, manifest=manifest), max_bytes=1000).collect()}
    assert len(listed) == 9 and listed["g.txt"] == (0, "File is empty") and listed["a.pdf"] == (10, None) and listed["lost.txt"][0] == 7 and listed["lost.txt"][1]
    assert rows.filter("name = 'h.txt'").select("content").first()[0] is None
    assert rows.filter("name = 'b.txt'").select(files.decode_text(F.col("content"))).first()[0] == "naïve café – ok"


def test_duplicates_against_stored_originals(spark):
    new = spark.createDataFrame([("s", "h1", 5, "p5", "queued"), ("s", "h2", 6, "p6", "queued"), ("s", "h2", 7, "p7", "queued"), ("t", "h1", 8, "p8", "queued")], "scope string, sha string, no int, path string, status string")
    old = spark.createDataFrame([("s", "h1", "p0")], "scope string, sha string, path string")
    got = {r.no: (r.status, r.stored_path) for r in files.mark_duplicates(new, "scope", "sha", "no", "path", old).collect()}
    assert got == {5: ("duplicate", "p0"), 6: ("queued", "p6"), 7: ("duplicate", "p6"), 8: ("queued", "p8")}


def test_overwrite_replaces_only_its_scopes(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.createDataFrame([(1, "a"), (2, "b")], "n int, scope string"), path, "scope")
    tables.write_table(spark.createDataFrame([(3, "b")], "n int, scope string"), path, "scope", "overwrite")
    assert {(r.n, r.scope) for r in spark.read.parquet(path).collect()} == {(1, "a"), (3, "b")}


def test_reply_objects():
    assert intake.first_object('x ```json {"a": "}{", "b": {"c": 1}} ``` {y') == '{"a": "}{", "b": {"c": 1}}'
    assert intake.first_object('{"claims":[],"aspects":[]} Done, hope this helps {x') == '{"claims":[],"aspects":[]}'
    assert intake.first_object('{"a": 1, "a": 2, "v": NaN, "w": -Infinity}') == '{"a":2,"v":"nan","w":"-inf"}'
    assert intake.well_formed('{"claims": []}') and not any(map(intake.well_formed, ('{"claims": "none"}', "{}", '{"claims": [], "aspects": 1}', "text", None)))
    assert intake.first_object('{"a": 1') is None and intake.first_object("none") is None and intake.first_object("{bad}") is None


def test_replies_are_read_in_spark_as_in_python(spark):
    texts = ['{"claims":[],"aspects":[]} Done, hope this helps {x', '{"claims":[{"a":1,"a":2}],"aspects":[]}', '{"claims":[],"aspects":[],"n":NaN}', '{"claims":[],"q":"} x"}', '{"a":1} {"b":2}', "```json\n{\"claims\":[]}\n```", "none", None]
    frame = intake.with_json(spark.createDataFrame(list(enumerate(texts)), "i int, raw_response string"))
    assert [r.json for r in frame.orderBy("i").collect()] == [intake.first_object(t) for t in texts]
    valid = intake.validated(frame.drop("raw_response"))
    assert [r.valid for r in valid.orderBy("i").collect()] == [True, True, True, True, False, True, False, False]


def test_the_word_false_is_a_yes(spark):
    rows = [(i, '{"claims":[],"ambiguous":%s}' % v) for i, v in enumerate(['"false"', "false", "0", '""', "true", "null", "[1]"])]
    out = intake.validated(spark.createDataFrame(rows, "i int, json string")).orderBy("i").collect()
    assert [r.ambiguous for r in out] == [True, False, False, False, True, False, True]


def test_failed_calls_are_rows(spark):
    def make():
        def call(model, history):
            if "boom" in history[1][1]:
                raise ValueError("boom")
            return '{"claims": "none"}' if len(history) == 2 else '{"claims": []}'
        return call
    asked = spark.createDataFrame([("k1", "s", "boom"), ("k2", "s", "fine")], "recording_key string, system string, user string")
    got = {r.recording_key: r for r in intake.call_models(asked, make, ["m1", "m2"], 2).collect()}
    assert got["k1"].status == "unavailable" and got["k1"].attempts == 2 and "boom" in got["k1"].error
    assert (got["k2"].status, got["k2"].attempts, got["k2"].raw_response) == ("ok", 2, '{"claims": []}')
