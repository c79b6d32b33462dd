import random

from weightlake.streaming import reads


def expected(rows, ahead):
    out, state = [], {}
    for key, seq, offset, size in rows:
        want, front = state.get(key, (-1, -1))
        end = offset + size
        if offset == want:
            start = max(front, end)
            stop = max(end + ahead, start)
            front = stop
        else:
            start = stop = front = end
        state[key] = (end, front)
        out.append((key, seq, offset, size, start, stop))
    return out


def test_fetch_ahead_over_batches(spark, tmp_path):
    rng = random.Random(2)
    rows, at = [], {"a": 0, "b": 0}
    for seq in range(60):
        key = rng.choice("ab")
        if rng.random() < 0.2:
            at[key] = rng.randrange(10**6)
        size = rng.choice([100, 4096])
        rows.append((key, seq, at[key], size))
        at[key] += size
    # three files, so three batches and state between them
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], "key string, seq long, offset long, size long").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, seq long, offset long, size long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = reads.fetch_ahead(stream, 10_000).writeStream.format("memory").queryName("ahead").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("ahead").collect()), key=lambda r: r[1])
    assert got == expected(rows, 10_000)


def test_append_stream(spark, tmp_path):
    for k in range(2):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = reads.append_stream(stream, lambda df, epoch: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
