import glob
import gzip
import json
import os

from postmill.operators.mentions import mentions_ranking
from postmill.sinks.mention_sums import changed_hours, refresh_sums, stored_ranking
from postmill.sources.timeline import read_timeline


def land(root, event, hour, name, posts):
    folder = f"{root}/{event}/2024/01/{1 + hour // 24:02d}/{hour % 24:02d}"
    os.makedirs(folder, exist_ok=True)
    with gzip.open(f"{folder}/tweet-{1704067200000 + hour * 3_600_000 + name}-{len(posts)}.json.gz", "wt") as out:
        out.write("\n".join(json.dumps(p) for p in posts))


def post(*mentions, likes=1):
    return {"id_str": "1", "favorite_count": likes, "retweet_count": 2, "entities": {"user_mentions": [{"id": i, "screen_name": n} for i, n in mentions]}}


def plain(frame):
    return [tuple(r) for r in frame.collect()]


def test_ranking_reads_new_hours_only(spark, tmp_path):
    root, path = str(tmp_path / "landing"), str(tmp_path / "sums")
    for hour in range(30):
        land(root, "storm", hour, 0, [post((hour % 5, f"n{hour % 3}"), (7, "hot")), post((None, "no id"), likes=None), {"id_str": "2"}])
    land(root, "fire", 1, 0, [post((99, "other"))])
    assert refresh_sums(spark, path, root, "storm") == 30 and refresh_sums(spark, path, root, "storm") == 0
    assert plain(stored_ranking(spark, path)) == plain(mentions_ranking(read_timeline(spark, root, "storm")))
    land(root, "storm", 30, 0, [post((7, "hot2"), (7, "hot"))])
    land(root, "storm", 4, 1, [post((7, "late"))])
    want = plain(mentions_ranking(read_timeline(spark, root, "storm")))
    assert {r.hour for r in changed_hours(spark, path, root, "storm").collect()} == {"2024-01-01-04", "2024-01-02-06"}
    for file in glob.glob(f"{root}/storm/2024/01/*/*/*.gz"):
        if "/01/04/" not in file and "/02/06/" not in file:
            with open(file, "wb") as broken:
                broken.write(b"no gzip")
    assert refresh_sums(spark, path, root, "storm") == 2
    assert plain(stored_ranking(spark, path)) == want
    few = {r.user_id: r.times_mentioned for r in stored_ranking(spark, path, "2024-01-02-05", "2024-01-02-06").collect()}
    assert few == {7: 3, 4: 1, None: 0}


def test_hours_without_mentions_and_repeated_runs(spark, tmp_path):
    root, path = str(tmp_path / "landing"), str(tmp_path / "sums")
    land(root, "storm", 0, 0, [{"id_str": "1"}])
    assert refresh_sums(spark, path, root, "storm") == 1 and plain(stored_ranking(spark, path)) == []
    assert refresh_sums(spark, path, root, "storm") == 0
    land(root, "storm", 0, 1, [post((1, "a"))])
    # Lost after the sums were written: the hour is not covered yet and is summed again.
    assert refresh_sums(spark, path, root, "storm") == 1
    for file in glob.glob(f"{path}/covered/hour=*/*"):
        os.remove(file)
    assert refresh_sums(spark, path, root, "storm") == 1
    assert plain(stored_ranking(spark, path)) == [(1, ["a"], 1, 2, 1)]
