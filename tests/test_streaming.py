import datetime
import random
from collections import Counter

from inkspark.streaming import rate_limit

SCHEMA = "key string, at timestamp"


def moment(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def source(spark, folder, *groups):
    """A stream of which each group is a micro-batch, in that order."""
    for g in groups:
        spark.createDataFrame(g, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(frame, folder, mode="append"):
    out = f"{folder}/out"
    writer = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/{n:04d}")
    q = writer.foreachBatch(keep).start()
    try:
        assert q.awaitTermination(180)
    finally:
        q.stop()
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{out}/*").collect()


def plain(rows):
    return sorted((r["key"], r["at"], r["n"], r["refused"]) for r in rows)


def test_counts_of_a_stream_are_the_batch_counts(spark, tmp_path):
    rows = [("a", moment(s)) for s in (1, 2, 3, 61, 62)] + [("b", moment(5))]
    got = run(rate_limit.counts(rate_limit.watermarked(source(spark, tmp_path / "in", rows), "at"), "key", "at"), tmp_path, "complete")
    want = rate_limit.counts(spark.createDataFrame(rows, SCHEMA), "key", "at").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_late_rows_count_in_their_own_window(spark, tmp_path):
    """A request of an earlier window between those of a later one leaves the later count alone."""
    groups = [[("a", moment(s))] for s in (100, 101, 102, 103, 50, 104)]
    got = plain(run(rate_limit.limited_stream(source(spark, tmp_path / "in", *groups), "key", "at", limit=3), tmp_path))
    assert got == [("a", moment(50), 1, False)] + [("a", moment(99 + n), n, n > 3) for n in range(1, 6)]


def test_a_shuffled_stream_equals_the_batch(spark, tmp_path):
    """Out of order by less than the delay: each window has the numbers that the batch gives, and as many refusals. Then the stream is restarted."""
    rng = random.Random(3)
    rows = sorted(((f"k{rng.randrange(5)}", moment(rng.randrange(600))) for _ in range(400)), key=lambda r: r[1] + datetime.timedelta(seconds=rng.random() * 50))
    groups = [rows[i : i + 50] for i in range(0, 400, 50)]
    window = lambda r: (r["key"], int((r["at"] - moment(0)).total_seconds()) // 60)
    tagged = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", i long")
    want = Counter((window(r), r["n"], r["refused"]) for r in rate_limit.limited(tagged, "key", "at", "i", limit=4).collect())
    frame = rate_limit.limited_stream(source(spark, tmp_path / "in", *groups[:4]), "key", "at", limit=4)
    first = run(frame, tmp_path)
    assert len(first) == 200
    source(spark, tmp_path / "in", *groups[4:])
    got = run(frame, tmp_path)  # from the checkpoint
    assert Counter((window(r), r["n"], r["refused"]) for r in got) == want


def test_state_ends_with_its_window(spark, tmp_path):
    """Once the watermark has passed a window's end, its count is gone and later requests of it are dropped."""
    groups = [[("a", moment(1))], [("a", moment(1000))], [("b", moment(1001))], [("a", moment(2))], [("a", moment(1002))]]
    got = plain(run(rate_limit.limited_stream(source(spark, tmp_path / "in", *groups), "key", "at", limit=1, delay="10 seconds"), tmp_path))
    assert got == [("a", moment(1), 1, False), ("a", moment(1000), 1, False), ("a", moment(1002), 2, True), ("b", moment(1001), 1, False)]


def test_a_key_under_attack_is_spread(spark):
    """Numbers come from positions in stored ranges: windows in the plan are over one row a range."""
    rows = spark.range(4000).selectExpr("'one' as key", "timestampadd(SECOND, cast(id as int) % 40, timestamp'2024-01-01') as at", "id as tie")
    frame = rate_limit.limited(rows, "key", "at", "tie", limit=60)
    windows = [x for x in frame._jdf.queryExecution().executedPlan().toString().split("\n") if "Window [" in x]
    assert windows and all("[__part" in x for x in windows)
    assert sorted(r["n"] for r in frame.collect()) == list(range(1, 4001))
    assert frame.filter("refused").count() == 3940
