"""Keyed state over restarts and any order, timers, and ingestion that can be repeated."""

import pytest
from pyspark.sql import functions as F

from quoin.operators.sessions import prune_history
from quoin.streaming import ingest as I
from quoin.streaming import sessions as T

MESSAGES = "conv_id long, turn long, role string, text string"


def run(stream, name, path, batches=None):
    """Rows that a stream emits until its input ends, appended to those that it emitted before."""
    with T.keyed_state(stream.sparkSession):
        q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/_checkpoint").foreachBatch(lambda df, b: I.write_batch(df, path, name, b)).trigger(availableNow=True).start()
        q.awaitTermination()
    return I.batches(stream.sparkSession, path, name), q


def test_memory_in_any_order_and_after_a_restart(spark, tmp_path):
    rows = [(c, t, "system" if t % 7 == c else "user", f"{c}.{t}") for c in range(4) for t in range(30)] + [(9, t, "system", "s") for t in range(8)] + [(None, 1, "user", "lost"), (8, 1, None, None)]
    df = spark.createDataFrame(rows, MESSAGES)
    folder = f"{tmp_path}/in"
    part = lambda i: df.where(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) == i).coalesce(1)
    stream = lambda: T.stream_conversations(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder), 6)
    part(2).write.parquet(folder)
    run(stream(), "m", str(tmp_path))
    part(0).write.mode("append").parquet(folder)  # another query goes on from the checkpoint
    part(1).write.mode("append").parquet(folder)
    out, _ = run(stream(), "m", str(tmp_path))
    key = lambda d: sorted(map(tuple, d.select("conv_id", "turn", "role", "text").collect()))
    expected = prune_history(df.where("conv_id IS NOT NULL").na.fill("", ["role", "text"]), 6)
    assert key(T.latest_memory(out)) == key(expected)
    assert out.where("conv_id = 9").agg(F.max(F.size("messages"))).first()[0] == 8  # system messages alone pass the limit


def test_sessions_end_and_leave_no_state(spark, tmp_path):
    at = lambda h: f"2024-01-{1 + h // 24:02} {h % 24:02}:00:00"
    files = [[(1, 0), (1, 3), (2, 10)], [(3, 20), (1, 23)], [(2, 30), (4, 31)], [(1, 40), (5, 200)]]
    folder, seen = f"{tmp_path}/in", []
    for file in files:
        df = spark.createDataFrame([(c, h, "user", "x", at(h)) for c, h in file], MESSAGES + ", ts string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(folder)
        out, q = run(T.expire_sessions(spark.readStream.schema(df.schema).parquet(folder)), "m", str(tmp_path))
        seen += file
        last = out.groupBy("conv_id").agg(F.max_by("expired", F.struct("created", "seen", "expired")).alias("gone"))
        alive = {r.conv_id for r in last.where("NOT gone").collect()}
        # a message that comes 24 h or more after its session began starts another one
        began = {}
        for c, h in seen:
            began[c] = h if c not in began or h >= began[c] + 24 else began[c]
        assert alive == {c for c, h in began.items() if h + 24 >= max(h for _, h in seen)}
    assert alive == {5}
    ended = {(r.conv_id, r.created.day, r.seen) for r in out.where("expired").collect()}
    assert ended == {(1, 1, 3), (2, 1, 2), (3, 1, 1), (4, 2, 1), (1, 2, 1)}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # of session 5 alone: facts, messages, timer


def test_a_new_session_asks_little_of_its_state():
    calls = []

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, what):
            return lambda *a: calls.append(f"{self.name}.{what}")

    memory = T.SessionMemory("string", 2, 24)
    memory.handle, memory.facts, memory.system, memory.others = map(State, ("handle", "facts", "system", "others"))
    rows = [{"at": 3_600_000 * h, "turn": h, "role": role, "text": "x"} for h, role in ((5, "user"), (1, "user"), (3, "system"), (4, "user"))]
    (row,) = memory.handleInputRows(("a",), iter(rows), None)
    assert sorted(calls) == ["facts.get", "facts.update", "handle.registerTimer", "others.put", "system.appendList"]
    assert (row.conv_id, row.seen, row.expired, row.created.hour, [m.turn for m in row.messages]) == ("a", 4, False, 1, [3, 5])


def test_batch_filter_of_sessions(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 10:00:00"), (2, "2024-01-01 09:00:00")], "conv_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [r.conv_id for r in T.sessions_left(df, 24, F.to_timestamp(F.lit("2024-01-02 08:00:00"))).collect()] == [2]


LAW = "Số: 1/2020/QH15\nLuật Mẫu\nChương I. Chung\nĐiều 1. Phạm vi\n1. Một\na) Điểm\n2. Hai\nĐiều 2. Khác\n1. Ba"


@pytest.fixture
def ingested(spark, tmp_path):
    folder, path = tmp_path / "files", str(tmp_path / "tables")
    folder.mkdir()

    def go(stages=None):
        I.stream_ingest(I.file_stream(spark, str(folder), 2), path, stages).trigger(availableNow=True).start().awaitTermination()
        return {t: sorted(map(tuple, I.current(spark, path, t).drop("tokens").collect()), key=repr) for t in I.KEYS}

    return folder, path, go


def test_bad_files_do_not_stop_others(spark, ingested):
    folder, path, go = ingested
    (folder / "law.txt").write_text(LAW)
    (folder / "scan.pdf").write_bytes(b"%PDF")
    (folder / "bad.txt").write_bytes(b"\xff\xfe\x00")
    (folder / "none.md").write_text("")  # Spark's file sources pass over files without a byte
    (folder / "plain.md").write_text("no headings at all")
    tables = go()
    assert len({r[0] for r in tables["chunks"]}) == 1 and len(tables["chunks"]) == 2
    assert {r[0] for r in tables["nodes"]} == {"VAN_BAN", "CHUONG", "DIEU", "KHOAN", "DIEM"} and len(tables["edges"]) == 9
    failures = I.batches(spark, path, "failures").collect()
    assert {(r.file_name, r.error) for r in failures} == {("scan.pdf", "unsupported suffix"), ("bad.txt", "not UTF-8")}
    nothing = spark.createDataFrame([("x/none.md", bytearray())], "path string, content binary")
    assert [(r.text, r.error) for r in I.decoded(nothing).collect()] == [(None, "empty")]


def test_a_repeated_batch_changes_nothing_and_a_new_version_replaces(spark, ingested):
    folder, path, go = ingested
    (folder / "law.txt").write_text(LAW)
    first = go()
    files = spark.read.format("binaryFile").load(str(folder)).select("path", "content")
    I.ingest_batch(files, 0, path)
    I.ingest_batch(files.union(files), 0, path)
    again = {t: sorted(map(tuple, I.current(spark, path, t).drop("tokens").collect()), key=repr) for t in I.KEYS}
    assert again == first
    (folder / "law.txt").write_text(LAW.replace("1. Ba", "1. Bốn\n2. Năm") + "\nĐiều 3. Mới")
    I.ingest_batch(spark.read.format("binaryFile").load(str(folder)).select("path", "content"), 1, path)
    later = {t: sorted(map(tuple, I.current(spark, path, t).drop("tokens").collect()), key=repr) for t in I.KEYS}
    assert len(later["chunks"]) == 3 and any("Bốn" in r[3] for r in later["chunks"]) and not any("1. Ba" in r[3] for r in later["chunks"])


def test_a_stage_that_fails_is_kept_apart(spark, ingested):
    folder, path, go = ingested
    (folder / "law.txt").write_text(LAW)

    def broken(documents):
        raise RuntimeError("model is away\nand more")

    I.ingest_batch(spark.read.format("binaryFile").load(str(folder)).select("path", "content"), 0, path, I.STAGES | {"nodes": broken})
    assert I.current(spark, path, "nodes") is None and I.current(spark, path, "chunks").count() == 2
    assert [(r.stage, r.error) for r in I.batches(spark, path, "failures").collect()] == [("nodes", "model is away")]
