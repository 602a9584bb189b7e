import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from stowage.streaming import flows, lease
from stowage.streaming.watch import Progress, ProgressListener


def test_of_many_takers_of_a_stale_lock_one_goes_on(spark, tmp_path):
    path, lock = f"file://{tmp_path}/run.lock", tmp_path / "run.lock"
    for round_ in range(3):
        lock.write_text("")
        os.utime(lock, (time.time() - 500, time.time() - 500))
        ready, taken = threading.Barrier(8), []

        def take():
            ready.wait()
            taken.append(lease.acquire(spark, path, 100))  # noqa: B023

        takers = [threading.Thread(target=take) for _ in range(8)]
        [t.start() for t in takers]
        [t.join() for t in takers]
        (held,) = [t for t in taken if t]
        assert len(taken) == 8 and held.check() == held.token == round_ + 1
        held.release()
        assert not lock.exists() and not any(p.name.endswith(f".{round_}") for p in tmp_path.iterdir())


def test_a_live_run_is_not_robbed_and_a_stalled_one_is_fenced(spark, tmp_path):
    path, lock = f"file://{tmp_path}/run.lock", tmp_path / "run.lock"
    with lease.single_flight(spark, path, 0.8) as live:
        time.sleep(2.5)  # far older than the limit, but it beats
        assert live.check() and not lease.acquire(spark, path, 0.8)
    stalled = lease.acquire(spark, path, 100)
    os.utime(lock, (time.time() - 500, time.time() - 500))
    token = tmp_path / f"run.lock.{stalled.token}"
    os.utime(token, (time.time() - 500, time.time() - 500))
    with lease.single_flight(spark, path, 100) as taker:
        assert taker and taker.token == stalled.token + 1
        with pytest.raises(lease.Fenced):
            stalled.check()
        with pytest.raises(lease.Fenced):
            stalled.beat()
        stalled.release()  # it no longer has anything to give back
        assert lock.exists() and taker.check()


def test_a_taker_that_has_not_written_its_lock_yet_counts(spark, tmp_path):
    path, lock = f"file://{tmp_path}/run.lock", tmp_path / "run.lock"
    lock.write_text("")
    os.utime(lock, (time.time() - 500, time.time() - 500))
    (tmp_path / "run.lock.1").touch()
    assert not lease.acquire(spark, path, 100)


def test_documents_are_replaced_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/ignored.json"
    lease.replace_document(spark, path, "one", None)
    assert lease.read_document(spark, path) == "one"
    lease.replace_document(spark, path, "zwei é", "one")
    for read in ("one", None):
        with pytest.raises(lease.Changed, match="has changed"):
            lease.replace_document(spark, path, "three", read)
    with lease.single_flight(spark, f"{path}.lock"), pytest.raises(lease.Changed, match="is being replaced"):
        lease.replace_document(spark, path, "three", "zwei é")

    def killed(self, source, target):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(lease.Store, "replace", killed)
        with pytest.raises(KeyboardInterrupt):
            lease.replace_document(spark, path, "cut off", "zwei é")
    assert lease.read_document(spark, path) == "zwei é"
    lease.replace_document(spark, path, "three", "zwei é")
    assert lease.read_document(spark, path) == "three" and lease.read_document(spark, f"{path}.none") is None


def test_progress_tells_what_is_left():
    told = []
    watch = ProgressListener("sync", told.append, total=100)
    watch.at = 0.0
    watch.note(20, 5, 10.0)
    watch.note(40, 5, 20.0)
    assert [(p.done, p.rate, p.seconds_left) for p in told] == [(20, 2.0, 40.0), (60, pytest.approx(2.6), pytest.approx(40 / 2.6))]
    by_bytes = ProgressListener("sync", told.append, total=10, total_bytes=1000)
    by_bytes.at = 0.0
    by_bytes.note(9, 100, 1.0)
    assert told[-1] == Progress("sync", 9, 10, 100, 1000, 100.0, 9.0)
    unknown = ProgressListener("sync", told.append)
    unknown.note(5, 0, 3.0)
    assert told[-1].seconds_left is None
    ProgressListener("sync", lambda p: 1 / 0, total=5).note(1, 0, 1.0)


def test_a_listener_follows_a_stream_of_known_size(spark, tmp_path):
    rows = spark.range(1200).select(F.col("id"), (F.col("id") % 7).alias("size")).repartition(6)
    rows.write.parquet(str(tmp_path / "in"))
    total = rows.agg(F.sum("size")).first()[0]
    told, listener = [], None
    listener = ProgressListener("copying", told.append, total=1200, total_bytes=total, observed="seen")
    spark.streams.addListener(listener)
    try:
        source = flows.progress(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")), "seen", "size")
        flow = source.writeStream.queryName("copying").foreachBatch(lambda b, n: b.count()).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        flow.awaitTermination()
        for _ in range(100):
            if told and told[-1].seconds_left == 0.0 and told[-1].done == 1200:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [p.done for p in told][-1] == 1200 and told[-1].done_bytes == total and told[-1].seconds_left == 0.0
    assert len({p.done for p in told}) == 3 and told[0].seconds_left > 0 and all(p.rate > 0 for p in told)
