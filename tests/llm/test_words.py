"""Hashes of words and spans against the words themselves."""

import numpy as np
import pytest

from postmill.llm.decontaminate import benchmark_hits
from postmill.llm.ngram_join import jaccard_join
from postmill.llm.substrings import remove_repeats
from postmill.llm.words import U64, Words, prefix_hash, span_hash
from tests.llm.test_ngram_join import brute as jaccard_brute
from tests.llm.test_substrings import brute as repeat_brute
from tests.llm.test_substrings import found


def balanced(n, a, b):
    """The word in which each half is the other one with letters swapped; sums of powers cannot tell it from its complement."""
    order = [0]
    while len(order) < n:
        order += [1 - x for x in order]
    return [(a, b)[x] for x in order]


ONE, OTHER = "".join(balanced(1024, "a", "b")), "".join(balanced(1024, "b", "a"))


def texts(middle):
    side = [f"w{i}" for i in range(30)]
    return " ".join([*side[:29], middle, *side])


@pytest.mark.parametrize("which", [0, 1])
def test_spans_of_two_values(which):
    for n in (2, 64, 1000, 1024, 4096):
        both = [np.array(balanced(n, *pair), U64) for pair in ((3, 8), (8, 3))]
        hashes = {int(span_hash(prefix_hash(v, which), np.array([0]), np.array([n]), which)[0]) for v in both}
        assert len(hashes) == 2


@pytest.mark.parametrize("which", [0, 1])
def test_equal_hash_is_equal_words(which):
    rng = np.random.default_rng(which)
    text = " ".join(rng.choice(["a", "b", "ab", "abcdefgh", "abcdefghi", "é" * 9, ONE, OTHER], 3000)).encode()
    words = Words(np.frombuffer(text, np.uint8), np.array([0, 1000, len(text)]))
    spelled = words.spelled(np.arange(len(words)))
    assert b" ".join(spelled).replace(b" ", b"") == text.replace(b" ", b"")
    start = rng.integers(0, len(words) - 300, 2000)
    end = start + rng.integers(0, 5, 2000) * rng.choice([1, 1, 1, 60], 2000)
    hashes = span_hash(prefix_hash(words.hashes(which), which), start, end, which)
    kinds = {}
    for a, b, h in zip(start, end, hashes.tolist()):
        assert kinds.setdefault(tuple(spelled[a:b]), h) == h
    assert len(set(kinds.values())) == len(kinds)
    grams, whole = words.grams(7, which)
    assert all(grams[a] == span_hash(prefix_hash(words.hashes(which), which), np.array([a]), np.array([a + 7]), which)[0] for a in range(50))
    assert len(grams) == len(whole) == len(words) - 6


def test_substrings_of_balanced_words(spark, docs):
    rows = [(1, texts(ONE)), (2, texts(OTHER)), (3, " ".join(balanced(2048, "u", "v"))), (4, " ".join(balanced(2048, "v", "u")) + " w")]
    assert found(remove_repeats(spark, docs(*rows))) == repeat_brute(rows, 50)


def test_benchmark_of_balanced_words(spark, docs):
    items = spark.createDataFrame([(7, texts(ONE))], "item_id long, text string")
    rows = {r.doc_id: r for r in benchmark_hits(spark, docs((1, texts(ONE)), (2, " ".join(texts(OTHER).split()[20:40]))), items).collect()}
    assert (rows[1].n_hit, rows[1].item_ids) == (60, ["7"]) and (rows[2].n_hit, rows[2].item_ids) == (0, [])


def test_links_of_balanced_words(spark, docs):
    rows = [(1, f"{ONE} x y z q"), (2, f"{OTHER} x y z q"), (3, " ".join([ONE] * 60)), (4, " ".join([OTHER] * 60))]
    assert sorted((tuple(r) for r in jaccard_join(spark, docs(*rows)).collect()), key=str) == jaccard_brute(rows)
