import glob
import json
import os
import random
import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from postmill.operators.volume import bucket_counts
from postmill.plans import jobs, queries
from postmill.sinks.snapshots import SnapshotStore
from postmill.sources.tables import read_page
from postmill.sources.timeline import read_timeline
from postmill.streaming import collect, publish

CLOCK = 1704067200000


def land(spark, tmp_path, name, texts):
    feed = tmp_path / "in"
    os.makedirs(feed, exist_ok=True)
    (feed / name).write_text("".join(json.dumps({"id_str": t, "text": "fire"}) + "\n" for t in texts))
    rules = spark.createDataFrame([("storm", "COVID19", ""), ("burn", "KEYWORDS", "fire")], "event string, match_key string, condition string")
    lines = collect.file_source(spark, str(feed), files_per_batch=1)
    writer = collect.collect_posts(lines, rules, str(tmp_path / "landed"), str(tmp_path / "ck"), lambda: F.timestamp_millis(F.lit(CLOCK)))
    collect.drain(writer)


def ids(spark, root, event="storm"):
    return sorted(r.id_str for r in read_timeline(spark, root, event).collect())


def test_from_stream_to_pages(spark, tmp_path):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "stored")
    os.makedirs(root)
    for n in range(3):
        land(spark, tmp_path, str(n), [f"{n}-{i:02}" for i in range(20)])
    assert publish.publish_landed(spark, landed, root, 1) == 2
    assert publish.publish_landed(spark, landed, root, 2) == 0
    land(spark, tmp_path, "3", ["late"])
    publish.publish_landed(spark, landed, root, 3)
    publish.publish_landed(spark, landed, root, 3)
    want = sorted([f"{n}-{i:02}" for n in range(3) for i in range(20)] + ["late"])
    assert ids(spark, root) == ids(spark, root, "burn") == want
    names = [os.path.basename(p) for p in glob.glob(f"{root}/storm/2024/01/01/00/*.json.gz")]
    assert sorted(names) == [f"tweet-{CLOCK}-60.json.gz", f"tweet-{CLOCK + 1}-1.json.gz"]
    store = SnapshotStore(spark, str(tmp_path / "results"))
    assert jobs.refresh_file_index(store, root, 5) == 4
    index = jobs.file_index(store)
    assert [(r.event, r["count"]) for r in bucket_counts(index, "day").collect()] == [("burn", 61), ("storm", 61)]
    assert [r.position for r in read_page(spark, root, index, "storm", 2, 50).collect()] == list(range(50, 61))


@pytest.mark.parametrize("after", ["_plan", "_move"])
def test_failed_runs_publish_once(spark, tmp_path, monkeypatch, after):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "stored")
    os.makedirs(root)
    land(spark, tmp_path, "0", [f"{i:04}" for i in range(30)])
    step = getattr(publish, after)

    def lost(*args):
        step(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(publish, after, lost)
    with pytest.raises(RuntimeError):
        publish.publish_landed(spark, landed, root, 1, rows_per_file=10)
    monkeypatch.undo()
    publish.publish_landed(spark, landed, root, 1, rows_per_file=10)
    assert ids(spark, root) == [f"{i:04}" for i in range(30)]
    assert publish.publish_landed(spark, landed, root, 2) == 0


def test_files_are_moved_side_by_side(spark, tmp_path, monkeypatch):
    """A store that answers late must not be asked for one file after the other."""
    both, moved = threading.Barrier(2), []

    class Late:
        def mkdirs(self, folder):
            return True

        def exists(self, source):
            return source.toString() not in moved

        def rename(self, source, target):
            both.wait(20)
            moved.append(source.toString())
            return True

    monkeypatch.setattr(publish, "_files", lambda spark, root: Late())
    moves = spark.createDataFrame([(f"s/{i}", f"e/2024/{i}.json.gz", 1) for i in range(2)], publish.PLAN)
    assert publish._move(spark, moves, str(tmp_path)) == 2 and sorted(moved) == ["s/0", "s/1"]


def land_uneven(spark, landed):
    """One large event and nine small ones in two batches; (event, value) of all lines."""
    rng = random.Random(1)
    rows = [("big", json.dumps({"id_str": str(i), "text": rng.randbytes(300).hex()})) for i in range(400)]
    rows += [(f"e{i % 9}", json.dumps({"id_str": str(i)})) for i in range(90)]
    for n in range(2):
        part = spark.createDataFrame(rows[n::2], "event string, value string")
        collect.write_hourly(part, f"{landed}/batch={n:012d}", F.timestamp_millis(F.lit(CLOCK)), 50)
    return rows


def published(spark, root, rows):
    events = sorted({e for e, _ in rows})
    return sorted((e, r.id_str) for e in events for r in read_timeline(spark, root, e).collect())


@pytest.mark.parametrize(("lost", "keep"), [("_divide", True), ("_gather", False), ("_move", False), ("_remove", False)])
def test_parts_publish_once(spark, tmp_path, monkeypatch, lost, keep):
    """A large hour and dealt small ones, with a run lost in every step of the second part."""
    landed, root = str(tmp_path / "landed"), str(tmp_path / "stored")
    rows = land_uneven(spark, landed)
    want = sorted((e, json.loads(v)["id_str"]) for e, v in rows)
    monkeypatch.setattr(publish, "PART_BYTES", 1)
    monkeypatch.setattr(publish, "PARTS", 8)
    left, step, calls = [], getattr(publish, lost), []

    def fails(*args):
        out = step(*args)
        calls.append(lost)
        if len(calls) == (1 if lost == "_divide" else 2):
            raise RuntimeError("lost")
        return out

    monkeypatch.setattr(publish, lost, fails)
    with pytest.raises(RuntimeError):
        publish.publish_landed(spark, landed, root, 1, 40, keep)
    monkeypatch.setattr(publish, lost, step)
    move = publish._move
    monkeypatch.setattr(publish, "_move", lambda *a: left.append(len(glob.glob(f"{landed}/*/event=*/**/*.gz", recursive=True))) or move(*a))
    count = publish.publish_landed(spark, landed, root, 1, 40, keep)
    names = glob.glob(f"{root}/*/2024/01/01/00/*.json.gz")
    assert len(names) == count == len(set(names)) and published(spark, root, rows) == want
    assert max(int(re.search(r"-(\d+)\.json", n)[1]) for n in names) <= 40
    assert len(left) > 1 and (left[-1] == left[0] if keep else left[-1] < 10)
    assert bool(glob.glob(f"{landed}/*/event=*/**/*.gz", recursive=True)) == keep
    assert publish.publish_landed(spark, landed, root, 2) == 0


def test_a_large_hour_is_not_shuffled(spark, tmp_path, monkeypatch):
    landed, root, plans = str(tmp_path / "landed"), str(tmp_path / "stored"), {}
    rows = land_uneven(spark, landed)
    monkeypatch.setattr(publish, "PART_BYTES", 1)
    monkeypatch.setattr(publish, "PARTS", 2)

    def gather(lines, staging, rows_per_file, alone=None, run=publish._gather):
        before = last_shuffle(spark)
        run(lines, staging, rows_per_file, alone)
        plans[alone.part if alone else None] = last_shuffle(spark) - before - 1

    monkeypatch.setattr(publish, "_gather", gather)
    publish.publish_landed(spark, landed, root, 1, 40)
    assert plans == {"big/2024/01/01/00": 0, None: 1} and len(published(spark, root, rows)) == len(rows)


def last_shuffle(spark):
    """A new number for a shuffle; each shuffle takes the next one."""
    return spark.sparkContext._jsc.sc().newShuffleId()


def written_blocks(spark):
    """Names of the shuffle files that are on disk now."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return set(re.findall(r"shuffle_\d+_\d+", blocks.mkString(",")))


def test_shuffles_of_landing_go_with_it(spark, tmp_path):
    """Shuffle files would else stay until the driver collects its garbage, all of them together."""
    before = written_blocks(spark)
    land_uneven(spark, str(tmp_path / "landed"))
    until = time.time() + 5
    while written_blocks(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not written_blocks(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_feed_and_landed_lines_do_not_stay(spark, monkeypatch):
    """What a step has taken over is gone before the next one makes its own copy."""
    shared, seen = spark.conf.get("spark.checkpoint.dir"), []
    before, publish_landed = set(os.listdir(f"{shared}/postmill")) if os.path.isdir(f"{shared}/postmill") else set(), publish.publish_landed

    def watched(*args, **kwargs):
        seen.extend(x for x in os.listdir(f"{shared}/postmill") if x not in before)
        return publish_landed(*args, **kwargs)

    monkeypatch.setattr(publish, "publish_landed", watched)
    found = queries.collect_to_pages(spark, "/root/testdata/sf0.001").collect()
    assert len([r for r in found if r.kind == "position"]) == 50 and {r.event for r in found if r.kind == "count"} >= {"everything", "fire"}
    assert seen and not [x for x in seen if x.startswith("feed-")]
    (landed,) = (x for x in seen if x.startswith("landed-"))
    assert not glob.glob(f"{shared}/postmill/{landed}/**/*.gz", recursive=True)
