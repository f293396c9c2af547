import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from postmill.llm.packing import Encoder, pack, pack_histogram, slots
from tests.llm.conftest import SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, size, end_id=1):
    """Every id in one piece, pieces gapless in sequences of at most ``size``."""
    tokenizer = Tokenizer.from_file(PATH)
    wanted = sorted(
        [i if i is not None else -1, *tokenizer.encode(t or "", add_special_tokens=False).ids, end_id] for i, t in texts
    )
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(len(w) - 1 for w in wanted)
    for i, *ids in wanted:
        pieces = by_doc[(i if i != -1 else None, len(ids))]
        crc = {(r.start, r.length, r.ids_crc32) for r in pieces}
        at = 0
        while at < len(ids):
            part = next(p for p in crc if p[0] == at and zlib.crc32(np.array(ids[at : at + p[1]], "<u4").tobytes()) == p[2])
            at += part[1]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    assert set(by_sequence) == set(range(len(by_sequence)))
    return len(by_sequence)


TEXTS = [
    (1, "one two three"), (2, None), (3, ""), (4, " \n\n  x"), (None, "no id"), (None, "no id"), (6, "same"), (6, "same"),
    (7, "<|endoftext|> special"), (8, "a  b  c \x0b d"), (9, "中文 и русский ελ 😀"), (10, "don't we'LL they've 12345 ½"),
    (11, "word " * 5000), (12, "x" * 30_000),
]


@pytest.mark.parametrize("size", [16, 2048])
def test_pieces_and_sequences(spark, docs, size):
    frame = pack(spark, docs(*TEXTS), PATH, size)
    check(frame.collect(), TEXTS, size)


def test_empty_table_and_other_columns(spark, docs):
    assert pack(spark, docs(), PATH).count() == 0
    schema = "doc_id long, text string, length string, rank int, start int, part int"
    rows = pack(spark, docs((1, "a b", "x", 1, 2, 3), schema=schema), PATH).collect()
    assert len(rows) == 1 and rows[0].length == rows[0].doc_tokens == 3


def test_encoder_is_the_tokenizer():
    tokenizer, encode = Tokenizer.from_file(PATH), Encoder(PATH, memo=50)
    rng = np.random.default_rng(5)
    letters = list("ab éßñÉ'’\n\t  \r\x0b\x85   中кλ😀12٣½.,!$#\x1fć​") + ["<|endoftext|>", "'ll", " the"]
    for _ in range(3000):
        text = "".join(rng.choice(letters, rng.integers(0, 30)))
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("histogram", [{}, {7: 0}, {10: 3}, {6: 5, 4: 5}, {9: 2, 5: 3, 3: 10, 1: 1000}, {n: n for n in range(1, 11)}])
def test_patterns_hold_every_length_once(histogram):
    patterns = pack_histogram(histogram, 10)
    placed = {}
    for pattern, count in patterns:
        assert sum(length * times for length, times in pattern) <= 10 and count > 0
        for length, times in pattern:
            placed[length] = placed.get(length, 0) + times * count
    assert placed == {k: v for k, v in histogram.items() if v}
    ranks = {}
    for length, low, high, *_ in slots(patterns):
        assert low == ranks.get(length, 0)
        ranks[length] = high
    assert ranks == placed


def test_frequent_lengths_cost_no_more():
    small = pack_histogram({2048: 9, 700: 10, 3: 50}, 2048)
    large = pack_histogram({2048: 9 * 10**9, 700: 10 * 10**9, 3: 50 * 10**9}, 2048)
    assert len(large) <= len(small) + 5
    assert sum(c for _, c in large) <= 10**9 * sum(c for _, c in small)


def test_query_on_whole_table(spark, documents):
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    rows = entry.queries()["op10_packing"](spark, SMALL).collect()
    n = check(rows, texts, 2048)
    assert sum(r.length for r in rows) > 0.95 * 2048 * (n - 1)
