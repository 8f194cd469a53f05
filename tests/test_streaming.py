from fabula.streaming.scoring import assign, start


def test_stream_scores_like_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "doc_id long, embedding array<double>")
    protos = spark.createDataFrame([(0, [0.0, 1.0]), (7, [1.0, 0.2])], "id int, vec array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = start(stream, protos, str(tmp_path / "state"), path=str(tmp_path / "out"))
    q.awaitTermination(120)
    got = {r.doc_id: r.z_hat for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.doc_id: r.z_hat for r in assign(rows, protos).collect()} and set(got.values()) == {0, 7}
