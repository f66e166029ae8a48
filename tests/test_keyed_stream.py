import random
import time

import pytest

from lenscape.operators import progress
from lenscape.schema import EVENT
from lenscape.streaming import keyed
from lenscape.streaming import progress as streams
from tests.test_streaming import as_dict, events


def of_run(rows, run):
    at = EVENT.names.index("job_id")
    return [(*r[:at], run, *r[at + 1 :]) for r in rows]


def played(spark, tmp_path, batches, **kw):
    """Each batch a file, each file a trigger."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    stream = streams.events(spark, str(tmp_path / "in"), maxFilesPerTrigger="1")
    with keyed.state_store(spark):
        q = keyed.kept_in(keyed.partials(stream, **kw), f"file://{tmp_path}/out").option("checkpointLocation", str(tmp_path / "check")).start()
        try:
            q.processAllAvailable()
            seen = [p for p in q.recentProgress if p["numInputRows"]]
        finally:
            q.stop()
    return keyed.kept(spark, f"file://{tmp_path}/out", keyed.PARTIAL), seen


def test_runs_in_parallel_agree_with_the_batch_fold(spark, tmp_path):
    by_run = {f"r{i}": of_run(events(80, 20 + i), f"r{i}") for i in range(4)}
    rng = random.Random(2)
    batches = []
    for k in range(3):
        part = [r for rows in by_run.values() for r in rows[k * 27 : k * 27 + 27]]
        rng.shuffle(part)
        batches.append(part)
    rows, seen = played(spark, tmp_path, batches, shards=3)
    assert len(seen) == 3
    got = keyed.state_of(keyed.latest(rows)).collect()
    for run, own in by_run.items():
        want = as_dict(progress.fold(spark.createDataFrame(own, EVENT)).collect())
        assert as_dict([r for r in got if r.run == run]) == want, run
    assert len(got) == 12


def photo(i, seq, run="run", status=None):
    return ("phash", "progress", run, None, seq, "processing", None, None, i, None, status, None)


def test_state_written_is_that_of_the_batch(spark, tmp_path):
    batches = [[photo(i, i) for i in range(1, 401)], [photo(5, 900, status="failed"), photo(500, 901, status="failed")], [photo(i, 1000 + i) for i in range(1, 11)]]
    rows, seen = played(spark, tmp_path, batches, shards=4)
    assert as_dict(keyed.state_of(keyed.latest(rows)).collect())["phash"] == (401, 0, 401, 1)
    updated = [sum(s["numRowsUpdated"] for s in p["stateOperators"]) for p in seen]
    assert updated[0] >= 400 and updated[1] <= 2 * 2 and updated[2] <= 4, updated
    assert rows.where("batch = 1").count() == 2  # shards 1 and 0


def test_photos_expire(spark, tmp_path):
    out = tmp_path / "out"
    for k, (seq, wait) in enumerate(((1, 0), (2, 4))):
        time.sleep(wait)
        spark.createDataFrame([photo(1, seq)], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.events(spark, str(tmp_path / "in"))
        with keyed.state_store(spark):
            # with expiry a stream goes on making batches, so that it is stopped when it has read its input
            q = keyed.kept_in(keyed.partials(stream, keep_ms=3000, shards=1), f"file://{out}").option("checkpointLocation", str(tmp_path / "check")).start()
            try:
                until = time.time() + 60
                while time.time() < until and (not list(out.glob("*/_SUCCESS")) or keyed.kept(spark, f"file://{out}", keyed.PARTIAL).count() <= k):
                    time.sleep(0.3)
            finally:
                q.stop()
    rows = keyed.kept(spark, f"file://{out}", keyed.PARTIAL).orderBy("batch").collect()
    assert [(r["items"], r.item_at) for r in rows] == [(1, 1), (1, 2)]  # sums and photo began anew


@pytest.mark.parametrize("rows", [[], [("scan", "completed", "r", None, 1, None, None, None, None, None, None, None), ("other", "progress", "r", None, 2, None, 5, 5, 7, None, None, None)]])
def test_nothing_to_fold(spark, tmp_path, rows):
    out, _ = played(spark, tmp_path, [rows or [], [photo(None, 3), photo(0, 4)]])
    assert as_dict(keyed.state_of(keyed.latest(out)).collect()) == {t: (0, 0, 0, 0) for t in ("scan", "phash", "embedding")}
