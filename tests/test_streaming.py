"""Streams over many batches: keyed state, snapshots of the change log, late lines."""

import datetime as dt

from corrobora.sources import files
from corrobora.streaming import jobs
from pyspark.sql import functions as F


def test_keyed_state_over_restarts(spark, tmp_path):
    rows = [(i, f"s{i % 2}", f"h{(i * 7) % 5}", f"p{i}", "failed" if i % 6 == 0 else "queued") for i in range(24)]
    frame = spark.createDataFrame(rows, "doc_id long, scope string, sha256 string, path string, status string")
    for part in range(3):
        frame.filter(F.floor(F.col("doc_id") / 8) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.keyed_duplicates(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    want = files.mark_duplicates(frame, "scope", "sha256", "doc_id", "path").select("doc_id", "status", "stored_path")
    got = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "status", "stored_path")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_change_log_is_merged(spark, tmp_path):
    path, schema = str(tmp_path / "out"), "doc_id long, status string, at long"
    events, n = [(i % 5, f"v{i}", i) for i in range(28)], 7
    for b in range(n):
        spark.createDataFrame(events[b * 4:b * 4 + 4], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        latest = jobs.latest_status(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "doc_id", "status", F.col("at"))
        jobs.changed_groups(latest, path, str(tmp_path / "check"), ["doc_id"], every=3).awaitTermination()
        want = {d: s for d, s, _ in events[:b * 4 + 4]}
        assert {r.doc_id: r.status for r in jobs.current_groups(spark, path, ["doc_id"], ["status"]).collect()} == want
    assert jobs._numbers(spark, path, "snapshot") == [2, 5] and jobs._numbers(spark, path, "batch") == list(range(n))
    # what came before the last snapshot is not read any more, and an old batch written again changes nothing
    assert {f.split("/")[-2] for f in jobs._versions(spark, path).inputFiles()} == {"snapshot=5", "batch=6"}
    spark.createDataFrame([(0, "old")], "doc_id long, status string").write.mode("overwrite").parquet(f"{path}/batch=1")
    assert {r.doc_id: r.status for r in jobs.current_groups(spark, path, ["doc_id"], ["status"]).collect()} == want


def test_late_lines_are_accounted_for(spark, tmp_path):
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    deliveries = [[0, 5, 60], [55, 40, 90, 49], [81, 79, 10], [100]]
    schema = "ts timestamp, stage string"
    for batch in deliveries:
        spark.createDataFrame([(at(m), "a") for m in batch], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.split_late(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), str(tmp_path / "out"), str(tmp_path / "check"), delay="10 minutes").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out/lines/batch=*").collect()
    assert len(rows) == sum(map(len, deliveries))
    assert sorted(r.ts for r in rows if r.late) == sorted(map(at, [40, 49, 79, 10]))


def test_streams_read_folders_of_parts(spark, tmp_path):
    from __spark_entry__ import queries
    known = queries()
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    documents.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    fields = ["doc_id", "ordinal", "text_hash"]
    got = known["str_ingest"](spark, str(tmp_path)).select(*fields).collect()
    want = known["chunk_finalize"](spark, str(tmp_path)).select(*fields).collect()
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, want))
