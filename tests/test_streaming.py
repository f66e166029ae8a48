import random

from pyspark.sql import functions as F

from lenscape.operators import progress
from lenscape.schema import EVENT
from lenscape.streaming import progress as streams


def events(n, seed):
    rng = random.Random(seed)
    maybe = lambda v: v if rng.random() < 0.6 else None
    out = []
    for i in range(n):
        task = rng.choice(["scan", "phash", "embedding"])
        kind = rng.choice(["progress"] * 5 + ["active", "completed", "failed"])
        photo = maybe(rng.randrange(30))
        if task == "embedding" and photo is not None:
            current = total = None
        else:
            current, total = maybe(rng.randrange(50)), maybe(rng.randrange(90))
        if task == "phash":
            current = total = None
        out.append((task, kind, "run", None, i, rng.choice(["discovery", "processing"]), current, total, photo, f"p{photo}", maybe("failed"), None))
    return out


def slow(rows):
    state = streams.empty_state()
    for r in rows:
        state = streams.apply_event(state, dict(zip(EVENT.names, r)))
    return {t: (s["current"], s["total"], len(s["items"]), sum(s["items"].values())) for t, s in state.items()}


def as_dict(rows):
    return {r.task_type: (r.current, r.total, r["items"], r.failed) for r in rows}


def test_batch_fold_is_the_event_by_event_fold(spark):
    for seed in range(6):
        rows = events(60, seed)
        got = progress.fold(spark.createDataFrame(rows, EVENT).repartition(3)).collect()
        assert as_dict(got) == slow(rows), seed
    assert as_dict(progress.fold(spark.createDataFrame([], EVENT)).collect()) == slow([])
    assert progress.totals(progress.fold(spark.createDataFrame([], EVENT))).first().active is False


def run(df, keep, mode="update"):
    q = df.writeStream.foreachBatch(keep).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_stream_fold(spark, tmp_path):
    rows = events(90, 7)
    for k in range(3):
        part = spark.createDataFrame(rows[k * 30 : k * 30 + 30], EVENT).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
        import time

        time.sleep(1.1)  # files are taken in the order of their times
    stream = streams.events(spark, str(tmp_path / "in"), maxFilesPerTrigger=1)
    states = []
    run(streams.folded(stream), lambda b, _: states.append(b.collect()))
    assert as_dict([s for s in states if s][-1]) == slow(rows)
    assert as_dict([s for s in states if s][0]) == slow(rows[:30])


def test_append_invalidate_windows(spark, tmp_path):
    rows = [list(r) for r in events(60, 8)]
    df = spark.createDataFrame(rows, EVENT).withColumn("ts", F.timestamp_seconds(F.col("seq") * 10))
    df.write.parquet(str(tmp_path / "in"))
    got = []
    run(streams.appended(streams.events(spark, str(tmp_path / "in"))), lambda b, _: got.extend(b.collect()), "append")
    want = {r[8] for r in rows if r[0] == "scan" and r[1] == "progress" and r[5] == "processing" and r[8] is not None}
    assert sorted(r.id for r in got) == sorted(want)
    got.clear()
    run(streams.appended(streams.events(spark, str(tmp_path / "in")), late="1 day"), lambda b, _: got.extend(b.collect()), "append")
    assert sorted(r.id for r in got) == sorted(want)
    calls = []
    q = streams.on_completed(streams.events(spark, str(tmp_path / "in")), lambda: calls.append(1)).start()
    q.processAllAvailable()
    q.stop()
    assert calls
    counts = []
    run(streams.windowed(streams.events(spark, str(tmp_path / "in"))), lambda b, _: counts.extend(b.collect()))
    assert sum(r.events for r in counts) == 60
    seen = []
    q = streams.delivered(streams.events(spark, str(tmp_path / "in")), lambda b, _: seen.append(b.count()), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 60
    assert "embedding" in open(streams.pools_file(str(tmp_path / "pools.xml"))).read()
