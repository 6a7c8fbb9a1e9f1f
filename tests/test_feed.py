"""The feed of runs with late, repeated and missing events."""

from __future__ import annotations

import json

import pytest

from quillmill.streaming import runs_feed


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def event(k, run, what, minute, **more):
    return {"id": f"e{k}", "run": run, "event": what, "at": f"2026-01-01T{10 + minute // 60}:{minute % 60:02d}:00", **more}


def test_late_repeated_and_silent(rocks, tmp_path):
    spark, feed = rocks, tmp_path / "feed"
    feed.mkdir()
    batches = [
        [event(1, 1, "start", 0, todo=4), event(2, 1, "page_done", 2, cost=0.2), event(3, 2, "start", 0, todo=2), event(4, 2, "page_done", 1, cost=0.5)],
        # run 1: an event sent again, one that comes late but in time, and its cost is older than what is known
        [event(2, 1, "page_done", 2, cost=0.2), event(5, 1, "page_failed", 1, cost=0.1), event(6, 1, "image_done", 4, cost=0.4)],
        [event(7, 1, "finished", 6)],
        [event(7, 1, "finished", 6), event(8, 3, "start", 50, todo=9)],  # the watermark goes on to 10:40
        [event(9, 1, "page_done", 3, cost=9.0), event(10, 3, "page_done", 55)],  # too late
    ]
    got = []
    for n, batch in enumerate(batches):
        (feed / f"{n}.json").write_text("\n".join(map(json.dumps, batch)))
        q = (
            runs_feed.run_progress(spark.readStream.schema(runs_feed.FEED).json(str(feed)), "10 minutes", 1200)
            .writeStream.foreachBatch(lambda df, k: got.append(sorted((r.run, r.status, r.done, r.failed, r.left_over, r.cost) for r in df.collect())))
            .option("checkpointLocation", str(tmp_path / "state")).outputMode("update").trigger(availableNow=True).start()
        )
        q.awaitTermination(240)
    told = [x for batch in got for x in batch]
    assert told[:2] == [(1, "running", 1, 0, 3, 0.2), (2, "running", 1, 0, 1, 0.5)]
    assert (1, "running", 2, 1, 1, 0.4) in told and (1, "finished", 2, 1, 1, 0.4) in told
    assert (2, "expired", 1, 0, 1, 0.5) in told  # silent for twenty minutes
    assert [x for x in told if x[0] == 3][-1][2] == 1
    assert max(x[2] for x in told if x[0] == 1) == 2 and sum(x[1] == "finished" for x in told) == 1
