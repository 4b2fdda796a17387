from pyspark.sql import functions as F

from postura.streaming import packets as S


def test_fixed_windows(spark, tmp_path):
    rows = spark.sql("select 'a' as identity, timestamp_seconds(1000 + id * 10) as at from range(9)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = S.fixed_windows(stream, most=2, seconds=60).writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.allowed for r in spark.table("windows").orderBy("at").collect()] == [True, True, False, False, False, False, True, True, False]


def test_flow_windows(spark, tmp_path):
    rows = spark.sql("select timestamp_seconds(id * 20) as ts, 100L as orig_len, 'a' as src_mac, 'b' as dst_mac, if(id % 2 = 0, 'x', 'y') as src_ip, if(id % 2 = 0, 'y', 'x') as dst_ip, 1 as src_port, 1 as dst_port, 'tcp' as protocol, false as dst_broadcast from range(60)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = S.flow_windows(stream).writeStream.outputMode("complete").format("memory").queryName("flows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("flows").agg(F.sum("packets"), F.count("*"), F.countDistinct("flow_key")).first()[:] == (60, 20, 1)
