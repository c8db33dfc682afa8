import json

from pyspark.sql import functions as F

from mnemora.streaming import events as E

SF = "/root/testdata/sf0.001"


def drain(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams_give_what_batches_give(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(drain(E.tumbling(stream, late="60 days"), "tumbling", "complete", tmp_path)) == rows(E.tumbling(batch))
    assert rows(drain(E.sessions(stream, late="60 days"), "sessions", "complete", tmp_path)) == rows(E.sessions(batch))
    assert drain(E.once(stream, ["user_id", "event_type"], late="60 days"), "once", "append", tmp_path).count() == batch.select("user_id", "event_type").distinct().count()


def test_lines_payloads_and_watching(spark, tmp_path):
    lines = [{"id": "1", "time": "2024-01-01T00:00:00Z", "workspace": "w", "type": "added", "data": json.dumps({"path": "p"})}]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    got = drain(E.payload(E.tail_jsonl(spark, str(tmp_path / "log")), "added", "path string"), "log", "append", tmp_path)
    assert got.first().path == "p"
    known = spark.createDataFrame([("a", "1", "t"), ("b", "1", "t")], "path string, hash string, type string")
    (tmp_path / "snap").mkdir()
    (tmp_path / "snap" / "s.json").write_text('{"path": "a", "hash": "2", "type": "t"}\n{"path": "c", "hash": "1", "type": "t"}')
    stream = spark.readStream.schema(known.schema).json(str(tmp_path / "snap"))
    seen = []
    E.watch(stream, lambda: known, str(tmp_path / "cp"), lambda d: seen.extend(map(tuple, d.collect()))).awaitTermination(120)
    assert sorted(seen) == [("a", "Modified"), ("b", "Removed"), ("c", "Added")]


def test_beats_expire(spark, tmp_path):
    (tmp_path / "beats").mkdir()
    (tmp_path / "beats" / "a.json").write_text('{"item": "x"}\n{"item": "x"}\n{"item": "y"}')
    stream = spark.readStream.schema("item string").json(str(tmp_path / "beats"))
    out = E.expiring(stream, "item", 1).writeStream.format("memory").queryName("beats").outputMode("append").option("checkpointLocation", str(tmp_path / "bcp")).trigger(processingTime="500 milliseconds").start()
    import time

    for _ in range(60):
        time.sleep(1)
        if spark.table("beats").where("status = 'expired'").count() == 2:
            break
    out.stop()
    assert {tuple(r) for r in spark.table("beats").collect()} >= {("x", "alive", 2), ("y", "alive", 1), ("x", "expired", 2), ("y", "expired", 1)}
