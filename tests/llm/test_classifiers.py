import zlib

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from postmill.llm import quality, toxicity
from postmill.llm.boosting import train
from postmill.llm.queries import read
from tests.llm.conftest import SMALL

MIDDLE = "/root/testdata/sf0.01"


def held_out(doc_id, parts, part):
    return zlib.crc32(str(doc_id).encode()) % parts == part


@pytest.mark.parametrize("key,label,parts,part,least", [("op9_quality", "quality", 3, 1, 0.97), ("op2_toxicity", "toxic", 4, 2, 0.9)])
def test_held_out_accuracy(spark, key, label, parts, part, least):
    rows = {r.doc_id: r for r in entry.queries()[key](spark, MIDDLE).collect()}
    known = read(spark, MIDDLE, "labels").collect()
    assert len(rows) == read(spark, MIDDLE, "documents").count()
    limit = 0.5 if label == "quality" else 0.3
    for r in rows.values():
        assert r.held_out == held_out(r.doc_id, parts, part) and 0 <= r.score <= 1 and r.predicted == int(r.score >= limit)
    judged = [rows[r.doc_id].predicted == r[label] for r in known if held_out(r.doc_id, parts, part)]
    assert len(judged) > 50 and np.mean(judged) >= least


ROWS = [(1, None), (2, ""), (None, "no id"), (4, "word " * 200_000), (5, "plain words"), (5, "plain words"), (6, "\n\t "), (7, "中文 🙂 \x00")]


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_any_rows(spark, docs, documents, module, label):
    labels = read(spark, SMALL, "labels")
    model = quality.fit(documents, labels) if module is quality else toxicity.fit(spark, documents, labels)
    model = (model,) if module is quality else model
    schema = "doc_id long, text string, score string, x int, label int, HELD_OUT int"
    frame = module.score(spark, docs(*((*r, "s", 1, 2, 3) for r in ROWS), schema=schema), *model)
    assert frame.columns == ["doc_id", "text", "x", "label", "score", "held_out", "predicted"]
    rows = frame.collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert len({r.score for r in rows if r.text in (None, "")}) == 1 and len({r.score for r in rows if r.doc_id == 5}) == 1
    assert module.score(spark, docs(), *model).count() == 0


@pytest.mark.parametrize("rows", [[], [(None, 1), (3, None)], [(0, 1), (3, 1), (0, 0)]])
def test_no_labels_or_one_class(spark, docs, rows):
    texts = docs((0, "a b"), (3, "c d"), (5, "e"))
    table = spark.createDataFrame(rows, "doc_id long, quality int").selectExpr("*", "quality AS toxic")
    model = quality.fit(texts, table, parts=2, held_out=5)
    lexicon, trees = toxicity.fit(spark, texts, table, parts=2, held_out=5)
    scores = {r.score for r in quality.score(spark, texts, model).collect()} | {r.score for r in toxicity.score(spark, texts, lexicon, trees).collect()}
    if not [r for r in rows if None not in r]:
        assert scores == {0.5}
    assert all(0 <= s <= 1 for s in scores)


def test_held_out_labels_are_never_used(spark, documents):
    labels = read(spark, SMALL, "labels")
    turned = labels.selectExpr(
        "doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality",
        "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic",
    )
    one, two = quality.fit(documents, labels), quality.fit(documents, turned)
    assert (one.threshold == two.threshold).all() and (one.value == two.value).all()
    assert toxicity.fit(spark, documents, labels)[0].weights == toxicity.fit(spark, documents, turned)[0].weights


def test_trees_walk_as_a_recursion_does():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = train(x, y, trees=20, depth=3)
    for row in x[:50]:
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + bool(row[f[node]] > t[node])
            total += v[node - len(f)]
        assert np.isclose(model.margin(row[None])[0], total)
    assert ((model.probability(x) > 0.5) == y).mean() > 0.97


def test_statistics_of_one_text_do_not_depend_on_its_neighbours():
    texts = ["Some words here.\nMore | of them!", None, "", "X" * 3000, "a b a b a b"]
    together = quality.statistics(pa.array(texts))
    alone = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone) and not together[1].any() and not together[2].any()


def test_folding_and_exceptions():
    assert toxicity.fold("You ＩＤ10T, аss $cum! naïve​ €nd") == " you idiot ass scum naive end "
    lexicon = toxicity.Lexicon({" idiot ": 5.0, " scum": 3.0, " scumb": 4.0}, {" no idiot "})
    found = lambda text: sorted(toxicity.matches(lexicon.automaton(), toxicity.fold(text)).values())
    assert found("idiot idiot scumbag SCUM idiots") == [3.0, 4.0, 5.0, 5.0]
    assert found("no idiot here, 1d1ot") == [5.0]
    assert found("") == [] and toxicity.Lexicon({}).automaton() is None


def test_matches_by_brute_force():
    """Every entry at every place, and every place in every exception, in plain loops."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        text = " " + " ".join("".join(rng.choice(list("ab"), rng.integers(1, 5))) for _ in range(12)) + " "
        pick = lambda n: {text[i:j] for i, j in np.sort(rng.integers(0, len(text) + 1, (n, 2)), axis=1) if j > i and text[i] == " "}  # noqa: E731,B023
        weights = {e: float(rng.integers(1, 9)) for e in pick(12)}
        void = pick(4) - weights.keys()
        want = {}
        for entry_, weight in weights.items():
            for i in range(len(text)):
                if text.startswith(entry_, i):
                    want[i] = max(weight, want.get(i, 0))
        for phrase in void:
            for i in range(len(text)):
                if text.startswith(phrase, i):
                    for k in range(i, i + len(phrase) - 1):
                        want.pop(k, None)
        assert toxicity.matches(toxicity.Lexicon(weights, void).automaton(), text) == want


def test_many_exceptions_cost_no_more_than_their_number():
    import time

    automaton = toxicity.Lexicon({" bad ": 2.0, " x": 1.0}, {" not bad "}).automaton()
    took = []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        found = toxicity.matches(automaton, " not bad x" * n + " ")
        took.append(time.perf_counter() - start)
        assert len(found) == n
    assert took[1] < 12 * took[0]


def test_every_pattern_is_weighed(spark, docs):
    """A telling word stays in a lexicon of few entries however many neutral ones are more frequent."""
    rows = [(f"{'foul' if k % 2 else 'fair'} " + " ".join(f"n{i}" for i in range(400)), k % 2) for k in range(40)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int"), entries=2)
    assert set(lexicon.weights) == {" foul "}
