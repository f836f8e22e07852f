from polyquill.streaming import latest


def test_keep_last_table(spark, tmp_path):
    source, table, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))
    want = {}
    for batch in range(4):
        rows = [(f"k{i % 7}" if batch < 3 else "k0", batch * 100 + i, i) for i in range(20)]
        want |= {k: (n, v) for k, n, v in rows}
        spark.createDataFrame(rows, "k string, n int, v int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, n int, v int").parquet(source)
        latest.keep_last_table(stream, ["k"], ["n"], table, mark, buckets=4).awaitTermination()
        assert {r.k: (r.n, r["v"]) for r in latest.read_last(spark, table).select("k", "n", "v").collect()} == want
    assert all(len(vs) <= 2 for vs in latest._versions(spark, table).values())
    assert latest.read_last(spark, str(tmp_path / "none")) is None
