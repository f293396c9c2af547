import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.llm.variants import AFTER, BEFORE, bound, decompose, frequent_grams, group_variants, list_keys, near_words

SCHEMA = "doc_id long, text string"
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def edits(word, letters):
    """Words one edit away, without the word itself."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    for c in letters:
        out |= {word[:i] + c + word[i:] for i in range(len(word) + 1)}
        out |= {word[:i] + c + word[i + 1 :] for i in range(len(word))}
    return out - {word}


def brute(rows, one_in=97):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if one_in and h % one_in == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    letters = {c for w in n for c in w}
    near = {w: edits(w, letters) & n.keys() for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    root = {}
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        root[w] = r
    return sorted(((w, form[w], root[w], n[w], len(near[w]), form[w] and n[form[w]]) for w in n), key=str)


def plain(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=str)


CHAIN = " ".join(w for k, w in enumerate(["abcdefgh", "abcdefg", "abcdefgx", "abcdefyx", "abcdeyx"]) for _ in range(3 * 2**k))
ROWS = [
    (1, CHAIN), (2, None), (3, ""), (None, "Zebra zebra ZEBRA zebras zebras zebras"), (None, "zebra zebra"), (4, "élan×÷ élans élans élans élan×÷ élan×÷"),
    (5, "tiess tiess tiess tiesa tiesa tiesa tiesa tiesa tiesa tiesb tiesb tiesb tiesb tiesb tiesb"), (9, "again"), (9, "again"), (9, "again"),
    (6, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaaa aaaaaaa aaaaaaa"), (7, ("q" * 3000 + " ") * 3 + ("q" * 2999 + "r ") * 7),
    (8, "four four four ОЧЕНЬ ĀĀĀĀĀ Ünder ünder ünder ünder"),
]


def test_same_as_brute_force(spark, docs):
    got = plain(group_variants(spark, docs(*ROWS)))
    assert got == brute(ROWS)
    rows = {r[0]: r for r in got}
    assert rows["abcdefgh"][2] == "abcdeyx" and rows["tiess"][1] == "tiesa"


@pytest.mark.parametrize("frequent", [1, 30, 10_000])
def test_dense_words(spark, docs, frequent):
    """Many words over few letters, with every choice of frequent grams."""
    import random

    rng = random.Random(frequent)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 9))) for _ in range(1500)]
    rows = [(i, " ".join(words[i::7] + words[: 40 * i])) for i in range(7)]
    assert plain(group_variants(spark, docs(*rows), least_count=1, frequent=frequent)) != []
    assert plain(group_variants(spark, docs(*rows), frequent=frequent)) == brute(rows)


@settings(max_examples=300, deadline=None)
@given(st.text("abcé", min_size=5, max_size=12), st.data())
def test_near_words_meet_in_a_list(word, data):
    frequent = dict.fromkeys(data.draw(st.sets(st.text("abcé\x02\x03", min_size=2, max_size=4), max_size=40)), 7)
    # Grams that begin a frequent gram are frequent.
    frequent = {g[:k]: 9 - k for g in frequent for k in range(2, len(g) + 1)}
    mine = set(list_keys(word, frequent))
    for other in edits(word, "abcé"):
        if len(other) >= 5:
            length = min(len(word), len(other))
            theirs = {(s, length, x) for s, _, x in list_keys(other, frequent)}
            assert theirs & {(s, length, x) for s, _, x in mine}, other
    grams = decompose(BEFORE + word + AFTER, frequent)
    assert 0 < bound(grams, len(word)) < len(grams) and bound(grams, len(word)) <= 4


def test_lists_are_short_where_words_share_grams(spark):
    """Pairs that meet stay in proportion to the words, not to its square."""
    words = spark.range(20_000).selectExpr("concat('common', lpad(conv(id * 7919, 10, 26), 6, 'p')) AS word")
    words = words.selectExpr("translate(lower(word), '0123456789', 'rstuvwxyzq') AS word", "1L AS n")
    frequent = frequent_grams(words, 1000)
    assert len(frequent) < 3000
    near = near_words(words, frequent)
    assert near.where("levenshtein(a, b) <> 1").count() == 0
    assert near.count() < 5 * 20_000


def test_nothing_is_broadcast(spark, docs):
    """Words and lists grow with the corpus, and Spark takes both for smaller than they are."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    try:
        assert plain(group_variants(spark, docs(*ROWS))) == brute(ROWS)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_empty_table_other_columns_and_options(spark, docs):
    assert group_variants(spark, docs()).count() == 0
    schema = "doc_id long, text string, word string, n int, id string, form string"
    text = "Hallo hallo hallo hallos hallos hallos hallos hallos hallos"
    rows = [(1, text, "x", 1, "y", "z")]
    assert plain(group_variants(spark, docs(*rows, schema=schema))) == brute([(1, text)])
    assert plain(group_variants(spark, docs(*ROWS), one_in=None)) == brute(ROWS, None)
    with pytest.raises(ValueError):
        group_variants(spark, docs(), least_length=2)
