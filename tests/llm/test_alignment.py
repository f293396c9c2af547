import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
from postmill.llm.alignment import ByteSide, PieceSide, Units, align, merge, spill
from postmill.llm.packing import byte_alphabet
from tests.llm.conftest import SMALL

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """Rows by the libraries themselves and plain loops."""
    left, right = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    left.encode_special_tokens = True
    letters = byte_alphabet()
    out, links_of = [], []
    for i, text in texts:
        row, links = [i, 0, 0, 0, 0, ""], Counter()
        if text:
            a, b = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
            as_bytes = [bytes(letters[c] for c in left.id_to_token(x)) for x in a]
            bs_bytes = [
                bytes([int(right.id_to_piece(x)[3:5], 16)]) if right.is_byte(x) else right.id_to_piece(x).replace("▁", " ").encode()
                for x in b
            ]
            if b"".join(as_bytes) == b"".join(bs_bytes) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in as_bytes]), np.cumsum([len(x) for x in bs_bytes])
                common = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
                ga, gb = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
                groups = [([], []) for _ in common]
                for side, ids, where in ((0, a, ga), (1, b, gb)):
                    for x, g in zip(ids, where):
                        groups[g][side].append(x)
                links = Counter((x, y) for p, q in groups for x in p for y in q)
                text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
                row = [i, len(a), len(b), len(common), sum(links.values()), hashlib.sha256(text.encode()).hexdigest()]
        out.append(row)
        links_of.append(links)
    count = Counter(pair for links in links_of for pair in links)
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    for row, links in zip(out, links_of):
        row[5:5] = [
            sum(n for p, n in links.items() if count[p] == top[p[0]]),
            sum(n * count[p] for p, n in links.items()),
        ]
    return sorted(map(tuple, out), key=str)


TEXTS = [
    (1, "one two three two"), (2, None), (3, ""), (4, " \n\n  x"), (5, " "), (6, "\n"), (None, "no id"), (None, "no id"), (7, "same"),
    (7, "same"), (7, "other"), (8, "<|endoftext|> <s>plain</s> <0x0A>"), (9, "a  b \t c \x0b d\x85e　f"), (10, "中文 и русский ελ 😀👩‍👩‍👧"),
    (11, "don't we'LL 12345 ½ x▁y"), (12, "word two " * 5000), (13, "x" * 20_000), (14, "q\x00\r\n z﻿ ​"), (15, "ab\ncd\n\n ef "),
    (16, "é é กำ "), (17, "".join(map(chr, range(0x4E00, 0x4F40)))),
]


@pytest.mark.parametrize("limits", [{}, {"parts": 3, "splits": 1, "run_records": 5}])
def test_same_as_brute_force(spark, docs, limits):
    got = align(spark, docs(*TEXTS, parts=5), A, B, **limits)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(TEXTS)


def test_empty_table_and_other_columns(spark, docs):
    assert align(spark, docs(), A, B).count() == 0
    assert align(spark, docs((1, None), (2, "▁")), A, B).selectExpr("sum(n_links + n_a)").first()[0] == 0
    schema = "doc_id long, text string, row string, part int, pairs string, n int, lane int"
    rows = align(spark, docs((1, "a b", "x", 1, "y", 2, 3), schema=schema), A, B).collect()
    assert [tuple(r) for r in rows] == brute([(1, "a b")])


def test_units_are_the_tokenizers(spark):
    """Texts cut into units give the ids of whole texts."""
    left, right = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    left.encode_special_tokens = True
    units = Units(ByteSide(A), PieceSide(B))
    rng = np.random.default_rng(5)
    letters = list("ab  éßÉ'’\n\t  \r\x0b   中к😀1٣.,!$\x1f") + ["<|endoftext|>", "'ll", " the", "  ", ";\r"]
    for _ in range(2000):
        text = "".join(rng.choice(letters, rng.integers(1, 30)))
        found = "".join(units.text[u] for u in units.of([text])[0])[:-1].split(";")
        a = [x for g in found for x in g.split("|")[0].split(",")]
        b = [x for g in found for x in g.split("|")[1].split(",")]
        assert a == [str(x) for x in left.encode(" " + text, add_special_tokens=False).ids], text
        assert b == [str(x) for x in right.encode(text)], text


def test_runs_and_merge():
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 9, 500).astype(np.uint64) << np.uint64(32) | rng.integers(0, 5, 500).astype(np.uint64)
    runs = [(k, np.unique(pairs[i::7], return_counts=True)[1]) for i in range(7) for k in [np.unique(pairs[i::7])]]
    found = list(merge(runs))
    kinds, counts = np.unique(pairs, return_counts=True)
    assert np.concatenate([p for p, _ in found]).tolist() == kinds.tolist()
    assert np.concatenate([n for _, n in found]).tolist() == counts.tolist()
    assert all(len(set((p >> np.uint64(32)).tolist())) == 1 for p, _ in found)
    assert list(merge([])) == []
    parts = [p for p, _, _ in spill(pairs, np.arange(500), np.ones(500, np.int64), 4)]
    assert parts == [0, 1, 2, 3]


def test_query_on_whole_table(spark, documents):
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    got = entry.queries()["op13_token_alignment"](spark, SMALL).collect()
    assert sorted(map(tuple, got), key=str) == brute(texts)
