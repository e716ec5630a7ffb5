from pyspark.sql import functions as F

from quireline.operators import votes
from quireline.streaming import flows


def test_running_votes_equal_batch(spark, tmp_path):
    rows = [(d, p, [p - 5, p % 3]) for d in (1, 2) for p in range(10, 30)]
    schema = "doc_id long, page long, printed array<bigint>"
    for i in range(4):
        spark.createDataFrame(rows[i::4], schema).write.parquet(f"{tmp_path}/in", mode="append")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    query = flows.running_votes(stream).writeStream.outputMode("complete").format("memory").queryName("votes").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = votes.offset_votes(spark.createDataFrame(rows, schema)).select("doc_id", "offset", "votes")
    assert sorted(map(tuple, spark.table("votes").collect())) == sorted(map(tuple, batch.collect()))


def test_files_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    for i in range(3):
        (tmp_path / "in" / f"{i}.txt").write_text(f"A {i + 1}\n")
    query = flows.each_batch(flows.file_stream(spark, str(tmp_path / "in"), pattern="*.txt"), lambda df, _: seen.extend(r.length for r in df.select("length").collect()), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert seen == [4, 4, 4]


def test_windows_with_watermark(spark, tmp_path):
    rows = [("2024-01-01 00:05:00", "a"), ("2024-01-01 00:40:00", "a"), ("2024-01-01 01:10:00", "b"), ("2024-01-01 05:00:00", "a")]
    events = spark.createDataFrame(rows, "ts string, kind string").select(F.to_timestamp("ts").alias("ts"), "kind")
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    query = flows.tumbling_counts(stream, "ts", "kind").writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.kind, r.n) for r in spark.table("windows").collect()) == [("a", 2), ("b", 1)]
    assert sorted(r.n for r in flows.sessions(events, "ts", "kind", gap="1 hour").collect()) == [1, 1, 2]
    assert sum(r.n for r in flows.sliding_counts(events, "ts", "kind").collect()) == 16
    assert {r.kind: str(r.ts) for r in flows.newest(events, "kind", "ts", "kind").collect()} == {"a": "2024-01-01 05:00:00", "b": "2024-01-01 01:10:00"}
