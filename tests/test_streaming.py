from weftline.streaming import reads


def test_stream_is_the_batch(spark, tmp_path):
    rows = [(1, "@a", "acgtACGT", "!", "r", "2024-01-01 00:01:00"), (1, "@a", "acgtACGT", "!", "r", "2024-01-01 00:02:00"), (2, None, None, None, None, None), (3, "b", "TTAC", "", "", "2024-01-01 00:30:00")]
    df = spark.createDataFrame(rows, "ord bigint, name string, seq string, qual string, run string, read_at string").withColumn("read_at", __import__("pyspark.sql.functions", fromlist=["col"]).col("read_at").cast("timestamp_ntz"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    patterns = spark.createDataFrame([(1, "AC"), (2, "T")], "pattern_id bigint, pattern string")
    stream = reads.read_stream(spark, str(tmp_path / "in"), 1)

    def finish(out, name, mode="append"):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    got = sorted((r.text_id, r.pattern_id, r.pos) for r in finish(reads.match_stream(stream, patterns), "hits"))
    assert got == sorted([(1, 1, 0), (1, 1, 4), (1, 2, 3), (1, 2, 7)] * 2 + [(3, 1, 2), (3, 2, 0), (3, 2, 1)])
    assert len([r for r in finish(reads.clean_reads(stream, "1 hour"), "clean") if r.ord == 1]) == 1
    counts = {str(r.beg): (r.reads, r.symbols) for r in finish(reads.counts_by_time(stream), "counts", "complete") if r.beg}
    assert counts == {"2024-01-01 00:00:00": (2, 16), "2024-01-01 00:30:00": (1, 4)}
