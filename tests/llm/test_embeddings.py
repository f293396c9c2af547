import numpy as np
import pytest

from postmill.llm.components import components, local_roots
from postmill.llm.embeddings import linked_pairs, near_duplicates

NAN, INF = float("nan"), float("inf")


def brute(rows, threshold=0.9):
    good = []
    for n, (i, v) in enumerate(rows):
        ok = i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, float) if ok else None)
    links = [[m for m in range(len(rows)) if m != n and good[n] is not None and good[m] is not None and len(good[n]) == len(good[m])
              and good[n] @ good[m] / (np.linalg.norm(good[n]) * np.linalg.norm(good[m])) >= threshold] for n in range(len(rows))]
    label = [r[0] for r in rows]
    for _ in rows:
        for n, found in enumerate(links):
            for m in found:
                label[n] = label[m] = min(label[n], label[m])
        for i in {r[0] for r in rows if r[0] is not None}:
            same = [n for n in range(len(rows)) if rows[n][0] == i and good[n] is not None]
            for n in same:
                label[n] = min(label[m] for m in same)
    return sorted(((i, len(links[n]), label[n], i == label[n]) for n, (i, _) in enumerate(rows)), key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)


ODD = [
    (4, [1.0, 0.0, 0.0]), (2, [2.0, 0.1, 0.0]), (9, [0.0, 0.0, 5.0]), (7, [0.0, 0.0, 5.0]), (1, None), (3, []), (5, [0.0, 0.0, 0.0]),
    (6, [1.0, None, 0.0]), (8, [NAN, 1.0, 0.0]), (10, [INF, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (11, [1.0, 0.0]), (12, [1.0, 0.01]), (13, [-1.0, 0.0, 0.0]),
    (14, [1e-30, 0.0, 0.0]), (15, [3e30, 1e29, 0.0]), (7, [0.0, 0.0, 5.0]),
]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_vectors(spark, kind):
    assert found(near_duplicates(spark, frame(spark, ODD, kind))) == brute(ODD)


@pytest.mark.parametrize("tile", [7, 4096])
@pytest.mark.parametrize("threshold", [0.9, 0.5])
def test_groups_over_tiles(spark, tile, threshold):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 40))
    vectors = np.concatenate([c + rng.normal(size=(8, 40)) * s for c, s in zip(centres, np.linspace(0.05, 0.6, 12))])
    rows = [(int(i), [float(x) for x in np.float32(v)]) for i, v in zip(rng.permutation(1000), np.concatenate([vectors, vectors[:9]]))]
    assert found(near_duplicates(spark, frame(spark, rows), threshold, tile)) == brute(rows, threshold)


def test_empty_table_and_other_columns(spark):
    assert near_duplicates(spark, frame(spark, [])).count() == 0
    assert found(near_duplicates(spark, frame(spark, [(1, None), (None, None)]))) == [(1, 0, 1, True), (None, 0, None, True)]
    wide = spark.createDataFrame([(1, [1.0], 3, 4, 5)], "vec_id long, embedding array<float>, rep int, mark int, good int")
    assert found(near_duplicates(spark, wide)) == [(1, 0, 1, True)]


def test_stopping_early_loses_nothing():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 48))
    x[150:] = x[:150] + rng.normal(size=(150, 48)) * np.linspace(0.01, 0.8, 150)[:, None]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    for threshold in (0.95, 0.9, 0.3):
        got = {(int(a), int(b)) for i, j in linked_pairs(x, x, axes, threshold) for a, b in zip(i, j)}
        assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(x @ x.T >= threshold))))


def test_components(spark):
    edges = [(5, 4), (4, 9), (9, 1), (7, 8), (8, 8), (20, 21), (21, 22), (22, 20)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {5: 1, 4: 1, 9: 1, 1: 1, 7: 7, 8: 7, 20: 20, 21: 20, 22: 20} | {100 + i: 100 for i in range(41)}
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0
    assert local_roots(6, np.array([5, 3, 4]), np.array([4, 2, 3])).tolist() == [0, 1, 2, 2, 2, 2]
