import datetime as dt

from panelcast.streaming.monitor import online_cusum, windowed_counts


def test_online_cusum_keeps_state_over_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    for i, rows in enumerate(([("a", 1, 3.0)], [("a", 2, 2.5), ("a", 3, 1.0)])):
        spark.createDataFrame(rows, "key string, at long, z double").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("key string, at long, z double").parquet(src)
        q = online_cusum(stream).writeStream.format("memory").queryName(f"out{i}").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True)
        q = q.start() if i == 0 else online_cusum(stream).writeStream.format("parquet").option("path", str(tmp_path / "res")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r["at"]: r["score"] for r in spark.read.parquet(str(tmp_path / "res")).collect()}
    assert got == {1: 2.5, 2: 4.5, 3: 0.5}


def test_windowed_counts_drop_late_messages(spark, tmp_path):
    src = str(tmp_path / "in")
    day = lambda n: dt.datetime(2024, 1, n, 12)
    batches = ([(day(1), 1, 2, "a"), (day(1), 1, 1, "b")], [(day(9), 1, 1, "a")], [(day(2), 1, 5, "a"), (day(20), 1, 1, "a")])
    for rows in batches:
        spark.createDataFrame(rows, "published timestamp, territory_id int, severity int, channel string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("published timestamp, territory_id int, severity int, channel string").parquet(src)
        windowed_counts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r["window"]["start"].day: (r["n"], r["severity"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (2, 3), 9: (1, 1)}
