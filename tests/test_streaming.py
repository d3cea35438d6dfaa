"""Stream and session helpers."""

from pyspark.sql import functions as F

from inkstream.operators.upserts import replace_by_key
from inkstream.streaming import pipelines


def test_decode_rejects(spark):
    rows = spark.createDataFrame([('{"k": 1}',), ("{bad",), (None,), ('{"k": "x"}',), ("{}",)], "props string")
    good, bad = pipelines.decode(rows, "props", pipelines.MESSAGE, ["k"])
    assert (good.count(), bad.count()) == (1, 4)


def test_retry_then_reject_then_replay(spark):
    now = F.lit("2025-01-01").cast("timestamp")
    failed = spark.createDataFrame([("a", 1), ("b", 3)], "id string, attempt int")
    again, dead = pipelines.retry_or_reject(failed, now)
    assert [(r.id, r.attempt, r.due_at.second) for r in again.collect()] == [("a", 2, 30)]
    assert [(r.id, r.attempt) for r in pipelines.replay(dead).collect()] == [("b", 1)]
    assert pipelines.due_messages(again, F.lit("2025-01-02").cast("timestamp")).count() == 1


def test_upsert_sink_is_idempotent(spark, tmp_path):
    sink = pipelines.upsert_sink(str(tmp_path), lambda state, batch: replace_by_key(state, batch, ["k"]))
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sink(first, 0)
    for _ in range(2):
        sink(spark.createDataFrame([(2, "c")], "k int, v string"), 1)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/version=1").select("k", "v").collect())) == [(1, "a"), (2, "c")]


def test_materialize_and_drop(spark, monkeypatch):
    from pathlib import Path

    from inkstream import session

    monkeypatch.setattr(session, "_written", [])
    kept = session.materialize(spark.range(3).where("id > 5"), "t")
    place = Path(session._written[0].removeprefix("file://"))
    assert kept.count() == 0 and kept.columns == ["id"] and str(place).startswith(session.shared_dir(spark).removeprefix("file://"))
    assert place.exists() and session.drop_materialized(spark) == 1 and not place.exists()


def _batches(spark, path, frames):
    """A stream that gives each frame as a micro-batch of its own."""
    import os
    import time

    for k, f in enumerate(frames):
        f.coalesce(1).write.parquet(f"{path}/b{k}")
        for name in os.listdir(f"{path}/b{k}"):
            if name.endswith(".parquet"):
                os.makedirs(f"{path}/in", exist_ok=True)
                os.rename(f"{path}/b{k}/{name}", f"{path}/in/{k}.parquet")
                os.utime(f"{path}/in/{k}.parquet", (time.time() - 100 + k, time.time() - 100 + k))
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_token_bucket_keeps_its_state_between_batches(spark, tmp_path):
    import random

    from inkstream.operators.frontier import token_bucket
    from inkstream.streaming.stateful import stream_token_bucket

    r = random.Random(1)
    rows = sorted((r.randrange(20_000_000), i, r.choice("ab")) for i in range(60))
    frames = [spark.createDataFrame(x, "us long, i long, k string") for x in (rows[:20], rows[20:40], rows[40:])]
    got = pipelines.drain(stream_token_bucket(_batches(spark, str(tmp_path), frames), "k", "i", "us", 0.5, 2.0, idle_out=False), "append")
    want = token_bucket(frames[0].unionByName(frames[1]).unionByName(frames[2]), "k", "i", "us", 0.5, 2.0)
    assert {(x.k, x.i, x.allowed) for x in got.collect()} == {(x.k, x.i, x.allowed) for x in want.collect()}


def test_url_state_is_folded_over_batches(spark, tmp_path):
    import random
    from datetime import datetime, timedelta

    from inkstream.operators.crawl import fold_attempts
    from inkstream.streaming.stateful import stream_url_state

    r = random.Random(3)
    rows = [(i, r.randrange(6), r.choice(["success", "failed", None]), i * 1_000_000) for i in range(90)] + [(91, None, "success", 5)]
    schema = "id long, url_id long, outcome string, us long"
    frames = [spark.createDataFrame(rows[k : k + 31], schema) for k in (0, 31, 62)]
    seen = {}
    q = stream_url_state(_batches(spark, str(tmp_path), frames)).writeStream.outputMode("update").trigger(availableNow=True)
    q = q.foreachBatch(lambda batch, _: seen.update({x.url_id: (x.attempts, x.last_outcome, x.failures) for x in batch.collect()})).option("checkpointLocation", str(tmp_path / "log")).start()
    q.awaitTermination()
    t = datetime(2025, 1, 1)
    table = spark.createDataFrame([(i, u, o, t + timedelta(microseconds=us)) for i, u, o, us in rows], "id long, url_id long, outcome string, attempted_at timestamp")
    want = fold_attempts(table, F.lit(True)).collect()
    assert seen == {x.url_id: (x.attempts, x.last_outcome, x.failures) for x in want}
