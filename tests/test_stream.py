from codeloom.model import files_now
from codeloom.session import table
from codeloom.streaming.ingest import keep_files_snapshot, stream_table, windowed_counts


def test_snapshot_of_a_folder_in_several_batches(spark, tmp_path):
    schema = "id long, path string, content_hash string, indexed_at long"
    for i, rows in enumerate([[(1, "a", "h1", 10), (2, "b", "h1", 10)], [(1, "a", "h2", 20)], [(2, "b", "h0", 5), (2, "b", "h1", 10)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/files.parquet")
    got = keep_files_snapshot(spark, stream_table(spark, str(tmp_path), "files", files_per_batch=1))
    assert sorted(map(tuple, got.collect())) == [(1, "a", "h2", 20), (2, "b", "h1", 10)]
    assert sorted(map(tuple, files_now(table(spark, str(tmp_path), "files")).collect())) == sorted(map(tuple, got.collect()))


def test_a_stream_goes_on_where_it_stood(spark, tmp_path):
    schema = "id long, path string, content_hash string, indexed_at long"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/files.parquet")
    run = lambda: sorted(map(tuple, keep_files_snapshot(spark, stream_table(spark, str(tmp_path), "files"), f"{tmp_path}/kept", 3).collect()))
    put([(i, f"p{i}", "h1", 10) for i in range(20)])
    assert len(run()) == 20
    put([(3, "p3", "h2", 20), (4, "p4", "h0", 5), (90, "p90", "h1", 1)])
    want = sorted([(i, f"p{i}", "h2" if i == 3 else "h1", 20 if i == 3 else 10) for i in range(20)] + [(90, "p90", "h1", 1)])
    assert run() == want and run() == want


def test_windowed_stream(spark, data):
    q = windowed_counts(stream_table(spark, data, "events")).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").count() == windowed_counts(table(spark, data, "events")).count()
