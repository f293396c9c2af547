import random

import pytest
from pyspark.sql import functions as F

from postmill.operators import predicates as P
from postmill.operators.predicates import Expression, PostQuery, Predicate


def post(id_str, text, full_text=None, **rest):
    out = {"id_str": id_str, "text": text, **rest}
    if full_text is not None:
        out["extended_tweet"] = {"full_text": full_text}
    return out


def ids(df):
    return sorted(r.id_str for r in df.select("id_str").collect())


def found(posts, kind, words):
    return ids(posts.transform(P.words_match(kind, words)))


@pytest.fixture
def posts(lines):
    return lines(
        post("short", "Red Blue"),
        post("long", "red", "Red green BLUE"),
        post("split", "red", "blue"),
        post("none", "nothing here"),
        post("empty", ""),
    )


def test_all_words_must_meet_in_one_text(posts):
    assert found(posts, "ALLWORDS", "BLUE,red") == ["long", "short"]


def test_any_word_in_either_text(posts):
    assert found(posts, "ANYWORDS", "blue") == ["long", "short", "split"]


def test_not_words_decides_per_text(posts):
    # "long" and "split" are hits when one of their two texts lacks every word.
    assert found(posts, "NOTWORDS", "blue") == ["empty", "long", "none", "split"]
    assert found(posts, "NOTWORDS", "red,blue") == ["empty", "none"]


def test_phrase(posts):
    assert found(posts, "PHRASE", "red blue") == ["short"]


def test_empty_word_means_empty_text(posts):
    assert found(posts, "ALLWORDS", "") == ["empty"]
    assert found(posts, "ALLWORDS", ",red") == []
    assert found(posts, "ANYWORDS", ",green") == ["empty", "long"]


def test_wildcards_and_quotes_are_plain_text(lines):
    posts = lines(post("a", "100% sure"), post("b", "100 sure"), post("c", "it's"))
    assert found(posts, "ALLWORDS", "100%") == ["a"]
    assert found(posts, "ALLWORDS", "it's") == ["c"]


def test_words_are_sorted_and_trailing_empty_items_dropped():
    assert Expression("ALLWORDS", "b,A,,").words == ["a", "b"]
    assert Expression("ALLWORDS", "").words == [""]
    with pytest.raises(ValueError):
        Expression("SOMEWORDS", "a")


def test_no_condition_keeps_everything(posts):
    assert PostQuery().condition() is None
    assert len(ids(PostQuery().apply(posts))) == 5


def test_and_binds_tighter_than_or(lines):
    posts = lines(post("a", "a"), post("b", "b"), post("bc", "b c"), post("c", "c"))
    tree = Predicate([Expression("ALLWORDS", "a"), Expression("ALLWORDS", "b", is_or=True), Expression("ALLWORDS", "c")])
    assert ids(PostQuery([tree]).apply(posts)) == ["a", "bc"]


def test_legacy_lets_an_or_predicate_escape_the_language(lines):
    posts = lines(post("1", "a", lang="en"), post("2", "b", lang="fr"), post("3", "a", lang="fr"))
    query = PostQuery(
        [Predicate([Expression("ALLWORDS", "a")]), Predicate([Expression("ALLWORDS", "b")], is_or=True)], language="en"
    )
    assert ids(query.apply(posts)) == ["1"]
    assert ids(query.apply(posts, legacy=True)) == ["1", "2"]


def test_time_range_is_inclusive_and_open_ended(lines):
    stamps = ["Sat Jan 01 00:00:00 +0000 2000", "Sat Jan 01 00:00:01 +0000 2000", "not a date"]
    posts = lines(*[{"id_str": str(i), "created_at": s} for i, s in enumerate(stamps)])
    low, high = 946684800000, 946684801000
    assert ids(PostQuery(start_ms=low, end_ms=low).apply(posts)) == ["0"]
    assert ids(PostQuery(start_ms=low).apply(posts)) == ["0", "1"]
    assert ids(PostQuery(end_ms=high).apply(posts)) == ["0", "1"]
    assert ids(PostQuery(end_ms=low).apply(posts)) == ["0"]


def test_hashtags_ignore_case_and_missing_lists(lines):
    posts = lines(
        {"id_str": "1", "entities": {"hashtags": [{"text": "Fire"}, {"text": "x"}]}},
        {"id_str": "2", "entities": {"hashtags": []}},
        {"id_str": "3"},
        {"id_str": "4", "entities": {"hashtags": [{"text": "FLOOD"}]}},
    )
    assert ids(PostQuery(hashtags="FIRE,flood").apply(posts)) == ["1", "4"]
    assert ids(PostQuery(hashtags="").apply(posts)) == ["1", "2", "3", "4"]


def test_key_ignores_word_and_hashtag_order_only():
    def query(words, tags, kind="ALLWORDS"):
        return PostQuery([Predicate([Expression(kind, words)])], hashtags=tags, language="en")

    assert query("b,a", "y,x").key("e") == query("A,b", "x,y").key("e")
    assert query("b,a", "x").key("e") != query("b,a", "x", "ANYWORDS").key("e")
    assert query("b", "x").key("e") != query("b", "x").key("f")
    assert query("b", "x").canonical() == "(ALLWORDSb),=x,=en,0,0"
    assert PostQuery(hashtags="null").key("e") != PostQuery().key("e") != PostQuery(hashtags="-").key("e")


def test_key_column_equals_the_query_key(spark):
    from postmill.functions.text import query_key

    query = PostQuery([Predicate([Expression("ALLWORDS", "b,a")])], language="en")
    row = spark.range(1).select(
        query_key(F.lit("storm"), F.lit("(ALLWORDSa,b)"), F.lit(None), F.lit("en"), F.lit(0), F.lit(0)).alias("k")
    ).first()
    assert row.k == query.key("storm")


def naive(query, text, full):
    """Three-valued evaluation of the predicate block, row at a time."""

    def any3(values):
        return True if True in values else (None if None in values else False)

    def all3(values):
        return False if False in values else (None if None in values else True)

    def one(e, value):
        if value is None:
            return None
        hits = [value == "" if w == "" else w in value for w in e.words]
        if e.kind == "NOTWORDS":
            return not any(hits)
        return any(hits) if e.kind == "ANYWORDS" else all(hits)

    def expression(e):
        return any3([one(e, text.lower()), one(e, full.lower() if full is not None else None)])

    def mixed(parts):
        groups = []
        for is_or, value in parts:
            if is_or or not groups:
                groups.append([])
            groups[-1].append(value)
        return any3([all3(g) for g in groups])

    return mixed([(p.is_or, mixed([(e.is_or, expression(e)) for e in p.expressions])) for p in query.predicates]) is True


def test_random_trees_equal_a_row_by_row_evaluator(lines):
    rng = random.Random(7)
    vocabulary = ["ab", "b", "ca", "", "abc"]
    texts = [
        (str(i), "".join(rng.choice("abC ") for _ in range(rng.randint(0, 6))),
         None if rng.random() < 0.4 else "".join(rng.choice("abC ") for _ in range(rng.randint(0, 6))))
        for i in range(60)
    ]
    posts = lines(*[post(*t) for t in texts]).cache()
    for _ in range(12):
        query = PostQuery(
            [
                Predicate(
                    [
                        Expression(
                            rng.choice(P.KINDS), ",".join(["a", *rng.choices(vocabulary, k=2)][: rng.randint(1, 3)]), rng.random() < 0.5
                        )
                        for _ in range(rng.randint(1, 3))
                    ],
                    rng.random() < 0.5,
                )
                for _ in range(rng.randint(1, 3))
            ]
        )
        assert ids(query.apply(posts)) == sorted(t[0] for t in texts if naive(query, t[1], t[2]))
