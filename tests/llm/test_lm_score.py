import math
import re
from collections import Counter

import numpy as np
import pytest

from postmill.llm.lm_score import packed, stupid_backoff, unpacked


def words(text):
    text = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(rows, order, alpha):
    own, total = [], Counter()
    for _, text in rows:
        w = words(text)
        count = Counter({(): len(w)})
        for n in range(1, order + 1):
            count.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        own.append(count)
        total.update(count)
    out = []
    for (doc_id, text), mine in zip(rows, own):
        w, score = words(text), 0.0
        for i in range(len(w)):
            depth = min(i + 1, order)
            for n in range(depth, 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                if total[gram] > mine[gram]:
                    score += math.log((total[gram] - mine[gram]) / (total[gram[:-1]] - mine[gram[:-1]])) + (depth - n) * math.log(alpha)
                    break
            else:
                score += depth * math.log(alpha) - math.log(total[()] - mine[()] + 1)
        out.append((doc_id, len(w), score))
    return out


ROWS = [
    (1, "the cat sat on the mat"), (2, "The cat sat on a hat."), (3, "a mat, the cat"), (4, None), (5, ""), (None, "the cat sat"), (7, "the cat sat on the mat"),
    (7, "the cat sat on the mat"), (8, "unheard words only"), (9, "the " * 3000), (10, "x"), (11, "été ÉTÉ the cat"), (12, "... ! ?"),
]


@pytest.mark.parametrize("order,alpha", [(1, 0.4), (2, 0.5), (3, 0.4), (5, 0.4)])
@pytest.mark.parametrize("bucket_bytes", [1 << 22, 64])
def test_same_as_brute_force(spark, docs, order, alpha, bucket_bytes):
    rows = stupid_backoff(spark, docs(*ROWS), order, alpha, bucket_bytes=bucket_bytes, part_bytes=bucket_bytes).collect()
    key = lambda r: (str(r[0]), r[1], round(r[2], 6))
    assert sorted(key(r) for r in rows) == sorted(key(r) for r in brute(ROWS, order, alpha))
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in rows)


def test_empty_tables_and_other_columns(spark, docs):
    assert stupid_backoff(spark, docs()).count() == 0
    assert [tuple(r) for r in stupid_backoff(spark, docs((1, None), (2, ""))).orderBy("doc_id").collect()] == [(1, 0, 0.0, None), (2, 0, 0.0, None)]
    wide = docs((1, "a b", 1, 2, 3), schema="doc_id long, text string, bucket int, part int, n_words int")
    assert stupid_backoff(spark, wide).first().n_words == 2


def test_packing_round_trip():
    for values in ([], [0], [1, 2**63, 2**64 - 1, 5]):
        assert unpacked(packed(np.array(values, np.uint64))).tolist() == values
