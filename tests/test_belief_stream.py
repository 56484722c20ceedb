import numpy as np

from credalis.streaming import online


def test_streamed_beliefs_equal_batch_beliefs(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(f"u{i % 5}", i, "xy"[(i * i) % 3 % 2]) for i in range(60)]
    for k in range(3):  # three files in order of time
        spark.createDataFrame(rows[20 * k : 20 * k + 20], "k string, t int, s string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    model = [0.6, 0.4], [[0.9, 0.1], [0.2, 0.8]], [[0.7, 0.3], [0.1, 0.9]], ["x", "y"]
    stream = spark.readStream.schema("k string, t int, s string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = online.filtered(stream, "k", "t", "s", *model).writeStream.outputMode("update").format("memory").queryName("beliefs").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    batch = {r.k: r.belief for r in online.filtered_batch(spark.read.parquet(f"{tmp_path}/in"), "k", "t", "s", *model).collect()}
    got = {}
    for r in spark.table("beliefs").collect():
        got.setdefault(r.k, []).append(r.belief)
    assert set(got) == set(batch)
    for k, beliefs in got.items():
        assert any(np.allclose(b, batch[k]) for b in beliefs)
