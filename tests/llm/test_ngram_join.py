from collections import Counter, defaultdict

import numpy as np
import pytest

from postmill.llm import ngram_join
from postmill.llm.ngram_join import bucket_edges, jaccard_join, least_matches, similar
from tests.llm.conftest import words_of


def brute(rows, n=5, num=4, den=5):
    """(id, class, links, component) of every row, by comparing all pairs."""
    sets = []
    for doc_id, text in rows:
        w = words_of(text)
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1)))) if doc_id is not None else frozenset())
    links, parent = Counter(), {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    classes = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        if sets[a]:
            classes[sets[a]].append(i)
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(i), root(rows[b][0])))
                parent[y] = x
    return sorted(((i, min(classes[sets[a]]) if sets[a] else i, links[a], root(i)) for a, (i, _) in enumerate(rows)), key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


BASE = [f"w{i}" for i in range(60)]


def variant(*changes):
    return " ".join(dict(changes).get(i, w) for i, w in enumerate(BASE))


CASES = {
    "exact and near copies": [(5, variant()), (2, variant()), (9, variant((0, "x"))), (7, variant((59, "y"))), (1, "something else altogether now here")],
    "chain": [(i, " ".join(f"c{j}" for j in range(4 * i, 4 * i + 60))) for i in range(12)],
    "just below and at the threshold": [(1, " ".join("abcdefghijklm")), (2, " ".join("abcdefghijkl")), (3, " ".join("abcdefghijk")), (4, " ".join("bcdefghijkl"))],
    "nulls and empty": [(None, variant()), (None, None), (3, None), (4, ""), (5, " \n"), (6, variant()), (7, variant())],
    "few words": [(1, "one two"), (2, "one two"), (3, "one  two"), (4, "two one"), (5, "one")],
    "repeated rows": [(1, variant()), (1, variant()), (2, variant((3, "q")))],
    "one word over and over": [(1, "la " * 50), (2, "la " * 5000), (3, "la la la la")],
    "very long": [(1, " ".join(f"v{i}" for i in range(40_000))), (2, " ".join(f"v{i}" for i in range(2000, 40_000))), (3, " ".join(f"v{i}" for i in range(20_000)))],
}


@pytest.mark.parametrize("case", list(CASES))
def test_same_as_brute_force(spark, docs, case):
    assert found(jaccard_join(spark, docs(*CASES[case]))) == brute(CASES[case])


def test_large_group_over_several_tiles(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET_TILE", 8)
    monkeypatch.setattr(ngram_join, "VERIFY_TILE", 8)
    rng = np.random.default_rng(3)
    rows = [(i, variant(*((int(j), f"z{i}") for j in rng.choice(60, rng.integers(0, 3), replace=False)))) for i in range(50)]
    assert found(jaccard_join(spark, docs(*rows))) == brute(rows)


def test_an_id_with_several_texts_is_one_node(spark, docs):
    rows = [(1, variant()), (2, variant((3, "q"))), (2, "quite another text of a few words"), (4, "quite another text of a few words")]
    assert {(r.doc_id, r.component_id) for r in jaccard_join(spark, docs(*rows)).collect()} == {(1, 1), (2, 1), (4, 1)}


def test_empty_table_and_other_columns(spark, docs):
    assert jaccard_join(spark, docs()).count() == 0
    schema = "doc_id long, text string, n int, rep string, mark int, key int, size int"
    assert found(jaccard_join(spark, docs((1, "a b c d e f", 1, "r", 2, 3, 4), schema=schema))) == [(1, 1, 0, 1)]


def test_pruning_follows_the_posterior():
    """The stage limits against a posterior integrated numerically."""
    p0 = 0.8 + 0.2 / 256
    grid = np.linspace(0, 1, 400_001)
    for n, least in least_matches(0.8, 1e-6):
        for m, kept in ((least, True), (least - 1, False)):
            density = grid**m * (1 - grid) ** (n - m)
            assert (density[grid >= p0].sum() / density.sum() >= 1e-6) == kept


def test_pivots_join_what_all_pairs_join():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 256, (6, 128), dtype=np.uint8)
    sketch = np.repeat(centres, 10, axis=0)
    noise = rng.random(sketch.shape) < 0.1
    sketch[noise] = rng.integers(0, 256, int(noise.sum()))
    needed = least_matches(0.8, 1e-9)
    both = []
    for few in (4, 1000):
        a, b = bucket_edges(sketch, np.array([0]), np.array([60]), needed, few)
        both.append(ngram_join.local_roots(60, a, b).tolist())
    assert both[0] == both[1] and len(set(both[0])) == 6
    assert len(similar(sketch[:1], sketch[:1], needed)) == 1
