import glob
import os
import random

import pytest

from postmill.operators.volume import file_listing
from postmill.sinks.file_index import read_index, refresh_parts


def names(event, days, hours=(0, 5), per_hour=2):
    out = []
    for day in days:
        for hour in hours:
            for k in range(per_hour):
                ms = 1704067200000 + ((day - 1) * 24 + hour) * 3_600_000 + k
                out.append(f"{event}/2024/01/{day:02d}/{hour:02d}/tweet-{ms}-{(day * 7 + hour + k) % 9}.json.gz")
    return out


def listing(spark, files):
    return file_listing(spark.createDataFrame([(f,) for f in files], "filename string"))


def shown(spark, path, events=None):
    return sorted((r.event, r.filename, r.start_index, r.end_index) for r in read_index(spark, path, events).collect())


def brute(files):
    out, at = [], {}
    for f in sorted(set(files)):
        event, rows = f.split("/")[0], int(f.rsplit("-", 1)[1].split(".")[0])
        out.append((event, f, at.get(event, 0), at.get(event, 0) + rows))
        at[event] = at.get(event, 0) + rows
    return sorted(out)


def stamps(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/event=*/part=*/*.parquet")}


def test_late_files_write_their_own_days_only(spark, tmp_path):
    path = str(tmp_path / "index")
    files = names("storm", range(1, 20)) + names("fire", range(3, 6))
    assert refresh_parts(spark, path, listing(spark, files)) == len(files)
    assert shown(spark, path) == brute(files)
    before = stamps(path)
    late = ["storm/2024/01/04/03/tweet-1704337200000-100.json.gz", "storm/2024/01/21/03/tweet-1705806000000-5.json.gz"]
    assert refresh_parts(spark, path, listing(spark, [*late, *files[-4:]])) == 2
    assert shown(spark, path) == brute(files + late)
    after = stamps(path)
    changed = {f.split("event=")[1].rsplit("/", 1)[0] for f in set(before.items()) ^ set(after.items()) for f in [f[0]]}
    assert changed == {"storm/part=2024-01-04", "storm/part=2024-01-21"}
    assert refresh_parts(spark, path, listing(spark, files + late)) == 0 and stamps(path) == after
    assert shown(spark, path, ["fire"]) == [r for r in brute(files) if r[0] == "fire"]


def test_any_order_of_refreshes_gives_the_same_index(spark, tmp_path):
    rng = random.Random(8)
    files = names("a", range(1, 6)) + names("b", range(2, 4)) + names("a-b", [1])
    for run in range(3):
        path, left = str(tmp_path / str(run)), files[:]
        rng.shuffle(left)
        cuts = sorted(rng.sample(range(1, len(left)), 3))
        for low, high in zip([0, *cuts], [*cuts, len(left)]):
            refresh_parts(spark, path, listing(spark, left[low:high] + left[:low:3]))
        assert shown(spark, path) == brute(files)


def test_no_files_and_repeated_names(spark, tmp_path):
    path = str(tmp_path / "index")
    assert refresh_parts(spark, path, listing(spark, [])) == 0 and shown(spark, path) == []
    twice = names("a", [1]) * 2
    assert refresh_parts(spark, path, listing(spark, twice)) == len(twice) // 2
    assert shown(spark, path) == brute(twice)


def test_a_refresh_that_failed_is_completed(spark, tmp_path, monkeypatch):
    """Some days written, others not, as when the driver is lost while folders are replaced."""
    path, files = str(tmp_path / "index"), names("storm", range(1, 6))
    refresh_parts(spark, path, listing(spark, names("storm", range(1, 4))))
    refresh_parts(spark, path, listing(spark, names("storm", [5])))
    assert refresh_parts(spark, path, listing(spark, files)) == len(names("storm", [4]))
    assert shown(spark, path) == brute(files)


def test_reading_one_event_opens_its_folders_only(spark, tmp_path):
    path = str(tmp_path / "index")
    refresh_parts(spark, path, listing(spark, names("a", [1, 2]) + names("b", [1])))
    for file in glob.glob(f"{path}/event=b/*/*.parquet"):
        with open(file, "wb") as broken:
            broken.write(b"none")
    assert len(shown(spark, path, ["a"])) == len(names("a", [1, 2]))
    with pytest.raises(Exception):
        shown(spark, path)
