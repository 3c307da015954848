"""The state of a stream of chunks: what comes again isn't embedded again, across batches and restarts."""

from millrace.operators import dense
from millrace.streaming import ingest


def test_only_new_and_changed_chunks_are_embedded(spark, tmp_path):
    src, seen = str(tmp_path / "in"), spark.sparkContext.accumulator(0)
    plain = dense.hashed(8)

    def make():
        model = plain.make()

        def run(texts):
            seen.add(len(texts))
            return model(texts)

        return run

    def arrive(rows):
        spark.createDataFrame(rows, "route string, body string").coalesce(1).write.mode("append").parquet(src)
        before = seen.value
        stream = spark.readStream.schema("route string, body string").parquet(src)
        query = ingest.embed_stream(stream, str(tmp_path / "out"), dense.Embedder("m", 8, make), str(tmp_path / "ck"))
        query.processAllAvailable()
        query.stop()
        return seen.value - before

    one = [("r1", "## A\n\nx\n\n## B\n\ny"), ("r2", "z"), ("r2", "z")]
    assert arrive(one) == 3
    assert arrive(one) == 0
    assert arrive([("r1", "## A\n\nx\n\n## B\n\nother"), ("r3", "z")]) == 2
    assert arrive([("r1", "## A\n\nx\n\n## B\n\ny")]) == 1  # back to what it was is a change
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == 6 and rows.filter("route = 'r2'").count() == 1
    latest = rows.filter("route = 'r1' and chunk_index = 1").orderBy("batch").collect()
    assert ["other" in r.body for r in latest] == [False, True, False]
