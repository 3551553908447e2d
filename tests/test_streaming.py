import datetime as dt

from corpusmill.streaming import arrivals


def test_new_chunks_once(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", "one\ntwo", day), ("a", "one\ntwo", day), ("b", "three", day)], "doc_id string, text string, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = arrivals.new_chunks(stream, "line_n_merge", "ts").writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.text for r in spark.table("arrived").collect()) == ["one\ntwo", "three"]


def test_windowed_counts(spark, tmp_path):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    rows = spark.createDataFrame([(at(1, 5), "x", 1.0), (at(1, 50), "x", 2.0), (at(5, 0), "y", 4.0)], "ts timestamp, event_type string, value double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = arrivals.windowed_counts(stream).writeStream.format("memory").outputMode("append").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.event_type, r.n, r.total) for r in spark.table("counted").collect()] == [("x", 2, 3.0)]
