from chronomotif.operators import adjacency
from chronomotif.schema import EVENTS
from chronomotif.streaming.adjacency import node_pairs, settled


def test_stream_finds_what_the_batch_finds(spark, tmp_path):
    rows = [(k, 3 * k // 2, 3 * k // 2, k % 4, 4 + k % 3, 1) for k in range(30)]
    whole = spark.createDataFrame(rows, EVENTS)
    for n, part in enumerate((rows[:10], rows[10:17], rows[17:])):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    run = node_pairs(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    got = settled(spark.read.parquet(str(tmp_path / "out")), 10)
    want = adjacency.within(adjacency.next_events(whole), 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
