"""Streams against their batch twins, and files against what was written."""

import json

from pyspark.sql import functions as F

from quoin.plans.fixtures import fixture
from quoin.sources.files import read_crawled_text, read_extraction_json, read_plain_documents
from quoin.streaming import ingest as I
from quoin.streaming import live


def test_job_status_stream(spark, sf, tmp_path):
    events = fixture(spark, sf, "job_events")
    for i in range(3):
        events.where(F.col("seq") % 3 == i).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live.stream_job_status(stream).writeStream.format("memory").queryName("jobs").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(tuple, df.select("job_id", "status", "percentage", "n_events").collect()))
    assert key(spark.table("jobs")) == key(live.stream_job_status(events))


def _stream_of(spark, rows, folder, emit, name):
    """What a windowed stream emits for ``rows``, a file a batch in the order of the list, kept by batch."""
    for part in rows:
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
        q = emit(stream).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(lambda df, b: I.write_batch(df, str(folder), name, b)).trigger(availableNow=True).start()
        q.awaitTermination()
    return I.batches(spark, str(folder), name).drop("batch"), q


def test_job_status_windows_end(spark, tmp_path):
    at = lambda h: f"2024-01-{1 + h // 24:02} {h % 24:02}:00:00"
    files = [[(1, 1, 3, "run", 10), (1, 2, 5, "run", 20), (2, 1, 4, "run", 1)], [(1, 3, 6, "done", 100), (2, 2, 30, "run", 50)], [(3, 1, 100, "run", 5), (2, 3, 31, "late", 60)], [(2, 4, 101, "done", 100), (4, 1, None, "lost", 0)], [(2, 5, 32, "too late", 0)]]
    rows = [spark.createDataFrame([(j, s, None if h is None else at(h), x, p) for j, s, h, x, p in f], "job_id long, seq long, ts string, status string, percentage long").withColumn("ts", F.to_timestamp("ts")) for f in files]
    out, q = _stream_of(spark, rows, tmp_path, live.job_status_windows, "jobs")
    got = sorted(map(tuple, live.latest_job_status(out).collect()))
    assert got == [(1, "done", 100, 3), (2, "done", 100, 4), (3, "run", 5, 1)]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2  # jobs 2 and 3 in the last window
    some = rows[0].union(rows[1])
    assert sorted(map(tuple, live.latest_job_status(live.job_status_windows(some)).collect())) == sorted(map(tuple, live.stream_job_status(some).collect()))


def test_query_statistics_windows_end(spark, tmp_path):
    files = [[("a", "2024-01-01 10:00:00", 5, True), ("a", "2024-01-01 11:00:00", None, False), ("b", "2024-01-01 11:00:00", None, None)], [("a", "2024-01-01 23:30:00", 7, True), (None, "2024-01-02 00:10:00", 1, True)], [("a", "2024-01-09 00:00:00", 9, False)]]
    rows = [spark.createDataFrame(f, "key string, ts string, ms long, hit boolean").withColumn("ts", F.to_timestamp("ts")) for f in files]
    out, q = _stream_of(spark, rows, tmp_path, live.query_statistics_windows, "log")
    key = lambda df: sorted(map(tuple, df.select("key", "executions", "mean_ms", "hits").collect()), key=repr)
    assert key(live.query_statistics(out)) == key(live.stream_query_statistics(rows[0].union(rows[1]).union(rows[2])))
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_sessions_expire(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 20:00:00"), (1, "2024-01-03 00:00:00"), (2, "2024-01-01 05:00:00"), (3, "2024-01-09 00:00:00")]
    df = spark.createDataFrame(rows, "session long, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = live.stream_expire(stream).writeStream.format("memory").queryName("gone").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.session, r.messages) for r in spark.table("gone").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Điều 1. abc")
    (tmp_path / "b.bin").write_text("x")
    (tmp_path / "empty.md").write_text("")
    got = {r.file_name: (r.text, r.error) for r in read_plain_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("Điều 1. abc", None) and got["b.bin"] == (None, "unsupported suffix")

    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "p.txt").write_text("URL: http://x/y\nTitle: T\nCrawled: 2024-05-01 10:00:00\nLength: 7 characters\n" + "=" * 100 + "\nbody\n= more")
    row = read_crawled_text(spark, f"{tmp_path}/c").first()
    assert (row.url, row.title, row.length, row.body) == ("http://x/y", "T", 7, "body\n= more")

    (tmp_path / "j").mkdir()
    doc = {"stage1_structure": {"articles": [{"id": "a1", "title": "A", "full_text": "t", "clauses": [{"id": "k1", "title": "K", "full_text": "u"}]}, {"id": "a2", "title": "B", "full_text": "v", "clauses": []}], "clauses": [{"id": "k9", "title": "Z", "full_text": "w"}]}}
    (tmp_path / "j" / "d.json").write_text(json.dumps(doc))
    got = sorted((r.article_id or "", r.clause_id or "", r.text) for r in read_extraction_json(spark, f"{tmp_path}/j").collect())
    assert got == [("", "k9", "Z\nw"), ("a1", "k1", "A\nK\nu"), ("a2", "", "B\nv")]
