"""The stream and the table give the same windows; late events are left out of closed windows."""

import datetime as dt

from simloom.streaming import windows


def test_stream_equals_table(spark, tmp_path):
    at = lambda h, m: dt.datetime(2025, 1, 1, h, m)
    rows = [(at(1, 5), "a", 1.0), (at(1, 50), "a", 2.0), (at(2, 10), "b", 4.0), (at(3, 1), "a", 8.0)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windows.windowed(stream, "ts", "kind", "value").writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(spark.table("seen")) == key(windows.windowed(df, "ts", "kind", "value"))
    assert key(windows.sessions(df, "ts", "kind", "50 minutes")) == [(at(1, 5), "a", 2), (at(2, 10), "b", 1), (at(3, 1), "a", 1)]
