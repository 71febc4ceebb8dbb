"""Streaming jobs over several batches: restart, late rows, windows that still run."""

from pyspark.sql import functions as F

from leafmart.streaming import jobs


def files(spark, folder, *batches, schema):
    """One file a batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/b={i}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_newest_sequence_wins_and_a_restart_finds_the_state(spark, tmp_path):
    src, root, schema = str(tmp_path / "in"), str(tmp_path / "out"), "id long, status string, seq long"
    files(spark, src, [(1, "running", 1), (2, "running", 1)], [(1, "done", 5)], [(1, "running", 2), (3, "running", 1)], schema=schema)
    jobs.run_state_feed(stream(spark, src, schema), root)
    want = [(1, "done"), (2, "running"), (3, "running")]
    assert sorted((r["id"], r["status"]) for r in jobs.latest(spark, root).collect()) == want
    jobs.run_state_feed(stream(spark, src, schema), root)  # nothing new
    assert sorted((r["id"], r["status"]) for r in jobs.latest(spark, root).collect()) == want
    files(spark, f"{src}/later", [(2, "failed", 9)], schema=schema)
    jobs.run_state_feed(stream(spark, src, schema), root)
    assert {r["id"]: r["status"] for r in jobs.latest(spark, root).collect()}[2] == "failed"


def test_late_events_are_accepted_once_and_up_to_the_cap(spark, tmp_path):
    src, root, schema = str(tmp_path / "in"), str(tmp_path / "out"), "id long, anon_id long, created_at string"
    day = lambda d, *ids: [(i, 7, f"2024-01-{d:02d} 10:00:{i % 60:02d}") for i in ids]
    files(spark, src, day(20, 1, 2), day(20, 2, 3, 4) + day(21, 9), day(2, 5, 5) + day(20, 1), schema=schema)
    jobs.event_ingest(stream(spark, src, schema), root, cap=3)
    got = jobs.accepted_events(spark, root)
    ids = sorted(r["id"] for r in got.collect())
    assert len(ids) == len(set(ids)) and {5, 9} <= set(ids)
    per_day = {str(r["day"]): r["n"] for r in got.groupBy("day").agg(F.count("*").alias("n")).collect()}
    assert per_day == {"2024-01-20": 3, "2024-01-21": 1, "2024-01-02": 1}


def test_running_hour_is_there(spark, tmp_path):
    src, root, schema = str(tmp_path / "in"), str(tmp_path / "out"), "event_name string, k long, created_at string"
    files(spark, src, [("deal_saved", 1, "2024-01-01 10:05:00")], [("deal_saved", 1, "2024-01-01 10:20:00"), ("deal_saved", 2, "2024-01-01 11:01:00")], schema=schema)
    jobs.window_saves(stream(spark, src, schema), root, "1 hour", None)
    got = {(r["deal_id"], str(r["window_start"])): r["saves"] for r in jobs.latest(spark, root).collect()}
    assert got == {(1, "2024-01-01 10:00:00"): 2, (2, "2024-01-01 11:00:00"): 1}


def folder_sizes(root):
    return {p.name: sum(f.stat().st_size for f in p.rglob("*.parquet")) for p in root.iterdir() if p.is_dir()}


def test_a_batch_writes_what_it_brings(spark, tmp_path):
    """A big first batch is not written again by small ones until its tier is full; the number of folders stays small."""
    src, root, schema = str(tmp_path / "in"), tmp_path / "out", "id long, status string, seq long"
    files(spark, src, [(i, f"first {i}", 0) for i in range(5000)], *[[(i, "later", i + 1)] for i in range(19)], schema=schema)
    seen = []
    for i in range(3):
        jobs.run_state_feed(stream(spark, src, schema), str(root))
        if i < 2:
            files(spark, f"{src}/more{i}", [(7, f"run {i}", 100 + i)], schema=schema)
        seen.append(folder_sizes(root))
    state = {r["id"]: r["status"] for r in jobs.latest(spark, str(root)).collect()}
    assert len(state) == 5000 and state[7] == "run 1" and state[18] == "later" and state[19] == "first 19"
    live = [n for n in seen[-1] if n.startswith("t")]
    assert len(live) <= 2 * 8 + 2
    assert sum(v for n, v in seen[-1].items() if n.startswith("t0-2")) < 0.2 * max(v for n, v in seen[-1].items() if n.startswith("t1"))


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    from leafmart.streaming.state import Tiers

    rows = lambda *r: spark.createDataFrame(r, "id long, status string, seq long")
    store = Tiers(spark, str(tmp_path / "s"), {"merge": "newest", "keys": ["id"], "seq": "seq"})
    for i in range(20):
        store.add(i, rows((1, f"s{i}", i), (i, "own", i)))
    before = sorted(map(tuple, store.read().collect()))
    store.add(19, rows((1, "s19", 19), (19, "own", 19)))
    assert sorted(map(tuple, store.read().collect())) == before and len(before) == 20
    assert before[1] == (1, "s19", 19)


def test_days_are_opened_alone_and_their_folders_stay_few(spark, tmp_path):
    from leafmart.streaming.state import FAN, Tiers

    store = Tiers(spark, str(tmp_path / "s"), {"merge": "all"}, part="day")
    for i in range(50):
        store.add(i, spark.createDataFrame([(i, "2024-01-01"), (i + 100, f"2024-02-{i % 25 + 1:02d}")], "id long, day string"))
    per_day = {}
    for e in store.live():
        per_day[e["part"]] = per_day.get(e["part"], 0) + 1
    assert max(per_day.values()) <= 2 * FAN and store.read().count() == 100
    assert sorted(r["id"] for r in store.read(["2024-02-03"]).collect()) == [102, 127]


def test_closed_windows_leave_the_state(spark, tmp_path):
    src, root, schema = str(tmp_path / "in"), tmp_path / "out", "event_name string, k long, created_at string"
    batches = [[("deal_saved", 1, f"2024-01-{d:02d} 10:05:00"), ("deal_saved", 1, f"2024-01-{d:02d} 10:06:00")] for d in range(1, 20)]
    files(spark, src, *batches, schema=schema)
    jobs.window_saves(stream(spark, src, schema), str(root), "1 hour", None)
    got = {str(r["window_start"]): r["saves"] for r in jobs.latest(spark, str(root)).collect()}
    assert got == {f"2024-01-{d:02d} 10:00:00": 2 for d in range(1, 20)}
    from leafmart.streaming.state import Tiers

    open_rows = Tiers(spark, str(root)).rows([e for e in Tiers(spark, str(root)).live() if e["tier"] > 0])
    assert open_rows is None or open_rows.count() <= 2
