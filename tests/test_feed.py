import os

import pytest

from postmill.streaming import feed


class Bytes:
    """A feed in memory that hands out small pieces."""

    def __init__(self, data, piece=7):
        self.data, self.piece = data, piece

    def read(self, partition, start, end):
        while start < end:
            yield self.data[start : min(start + self.piece, end)]
            start = min(start + self.piece, end)


class Flaky(feed.FileFeed):
    """Loses its connection after every second piece."""

    def read(self, partition, start, end):
        for n, data in enumerate(super().read(partition, start, end)):
            if n == 2:
                raise OSError("connection lost")
            yield data


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 100])
def test_messages_across_pieces_and_keep_alives(piece):
    data = b"one\r\n\r\n\r\ntwo \r three\n\r\n" + "drei é".encode() + b"\r\ncut"
    found = list(feed.messages(Bytes(data, piece).read("", 0, len(data)), 0))
    assert [m for _, m in found] == [b"one", b"two \r three\n", "drei é".encode()]
    assert all(data[p : p + len(m)] == m for p, m in found)


@pytest.mark.parametrize("step", [2, 3, 5, 64])
def test_batches_end_after_a_message(step):
    data = b"aaaa\r\nbb\r\n\r\ncccccccccccc\r\nopen \r"
    ends = {0, 6, 10, 12, 26}
    for start in sorted(ends):
        for wanted in range(start, len(data) + 1):
            end = feed.complete_end(Bytes(data), "", start, wanted, len(data), step)
            within = [e for e in ends if start < e <= wanted]
            assert end == (max(within) if within else min((e for e in ends if e > start), default=start)) or (wanted == start and end in (start, min((e for e in ends if e > start), default=start)))


def test_a_broken_connection_goes_on_where_it_was(tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 50 + b"\r\n" + b"y" * 30 + b"\r\n")
    client = Flaky({"path": str(tmp_path), "piece": "9"})
    assert b"".join(feed.Steady(client, 2, 0).read("a", 0, 84)) == (tmp_path / "a").read_bytes()
    with pytest.raises(OSError):
        list(feed.Steady(client, 3, 0).read("a", 0, 999))


def run(stream, out, mark):
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    query.awaitTermination()


def test_restarts_lose_and_repeat_nothing(spark, tmp_path):
    root, out, mark = str(tmp_path / "feed"), str(tmp_path / "out"), str(tmp_path / "mark")
    os.makedirs(root)
    want = {f"p{n}": [] for n in range(4)}

    def grow(run_no, cut):
        for n, name in enumerate(want):
            new = [f"{name} message {run_no}-{k} {'é' * k}" for k in range(5 + n)]
            want[name] += new
            with open(f"{root}/{name}", "ab") as file:
                data = "\r\n\r\n".join(new + [""]).encode()
                file.write(data if not cut else data + b"begun ")
            if cut:
                want[name].append("begun ")

    grow(0, cut=True)
    options = {"piece": "11", "client": f"{__name__}:Flaky", "tries": "3", "pause": "0"}
    run(feed.read_feed(spark, root, **options), out, mark)
    rows = spark.read.parquet(out).collect()
    assert sorted(r.value for r in rows) == sorted(m for v in want.values() for m in v if m != "begun ")
    for name in want:
        want[name].pop()
        with open(f"{root}/{name}", "ab") as file:
            file.write(b"and ended\r\n")
        want[name].append("begun and ended")
    grow(1, cut=False)
    # Small batches for a while, then all that is left, and then nothing.
    for more in ({"maxBytes": "9"}, {"maxBytes": "40"}, {}, {}):
        run(feed.read_feed(spark, root, **more, **options), out, mark)
    rows = spark.read.parquet(out).collect()
    got = {n: [r.value for r in sorted(rows, key=lambda r: r.position) if r.feed == n] for n in want}
    for name in want:
        assert got[name] == want[name]


def test_batches_are_limited_and_offsets_never_go_back(tmp_path):
    (tmp_path / "a").write_bytes(b"".join(b"%03d\r\n" % i for i in range(20)))
    reader = feed.FeedReader({"path": str(tmp_path), "maxbytes": "12"})
    assert reader.latestOffset() == {"a": 100}
    with open(tmp_path / "a", "ab") as file:
        file.write(b"".join(b"%03d\r\n" % i for i in range(20, 26)) + b"a message longer than the limit\r\n")
    ends = [reader.latestOffset()["a"] for _ in range(5)]
    assert ends == [110, 120, 130, 163, 163]
    stretches = [feed.Stretch("a", low, high) for low, high in zip([0, 100, *ends], [100, *ends])]
    values = [v for s in stretches for _, _, v in reader.read(s)]
    assert values == [f"{i:03d}" for i in range(26)] + ["a message longer than the limit"]
    assert feed.FeedReader({"path": str(tmp_path), "maxbytes": "12"}).latestOffset() == {"a": 163}


def test_what_is_there_at_the_start_is_read_by_many_tasks(tmp_path):
    data = b"".join(b"%03d\r\n" % i for i in range(20)) + b"\r\na message longer than the limit\r\n" + b"last\r\n"
    (tmp_path / "a").write_bytes(data + b"open")
    (tmp_path / "b").write_bytes(b"b\r\n")
    reader = feed.FeedReader({"path": str(tmp_path), "maxbytes": "12"})
    end = reader.latestOffset()
    stretches = reader.partitions({}, end)
    own = [s for s in stretches if s.feed == "a"]
    assert end == {"a": len(data), "b": 3} and len(own) > 10 and max(s.end - s.start for s in own) == 33
    assert own[0].start == 0 and own[-1].end == len(data) and all(a.end == b.start for a, b in zip(own, own[1:]))
    assert [v for s in own for _, _, v in reader.read(s)] == [f"{i:03d}" for i in range(20)] + ["a message longer than the limit", "last"]
    assert reader.partitions({"a": 5, "b": 3}, end)[0] == feed.Stretch("a", 5, 15)
    assert reader.partitions(end, end) == []
