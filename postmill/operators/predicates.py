"""Structured post search compiled to one filter Column.

A query holds predicates, a predicate holds expressions, an expression holds words.
Everything compiles to built-in expressions with SQL three-valued logic, so a missing
long text leaves the decision to the short text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import ABSENT, GIVEN
from postmill.functions.times import created_ms

ALLWORDS, ANYWORDS, NOTWORDS, PHRASE = "ALLWORDS", "ANYWORDS", "NOTWORDS", "PHRASE"
KINDS = (ALLWORDS, ANYWORDS, NOTWORDS, PHRASE)


def _items(text: str) -> list[str]:
    """Comma items without trailing empty ones; the empty text is one empty item."""
    if text == "":
        return [""]
    items = text.split(",")
    while items and items[-1] == "":
        items.pop()
    return items


def _all(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def _any(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _join_mixed(parts: Sequence[tuple[bool, Column]]) -> Column:
    """Combine ``(is_or, condition)`` pairs left to right, AND binding tighter than OR."""
    runs: list[list[Column]] = []
    for is_or, condition in parts:
        if is_or or not runs:
            runs.append([])
        runs[-1].append(condition)
    return _any([_all(run) for run in runs])


@dataclass(frozen=True)
class Expression:
    """Comma-separated words or phrases and how they must occur."""

    kind: str
    text: str
    is_or: bool = False

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")

    @property
    def words(self) -> list[str]:
        return sorted(_items(self.text.lower()))

    def canonical(self) -> str:
        return self.kind + ",".join(self.words)

    def condition(self, short: Column, long: Column) -> Column:
        """Decide on one lower-case text alone or on the other alone; either suffices."""
        return self._on(short) | self._on(long)

    def _on(self, lowered: Column) -> Column:
        words = self.words
        if not words:
            raise ValueError("an expression needs at least one word")
        hits = [lowered == "" if w == "" else F.contains(lowered, F.lit(w)) for w in words]
        if self.kind == NOTWORDS:
            return _all([~h for h in hits])
        return _any(hits) if self.kind == ANYWORDS else _all(hits)


@dataclass(frozen=True)
class Predicate:
    """Expressions joined left to right by AND/OR."""

    expressions: Sequence[Expression]
    is_or: bool = False

    def canonical(self) -> str:
        out = ""
        for i, e in enumerate(self.expressions):
            out += ("OR" if e.is_or else "AND") * (i > 0) + e.canonical()
        return out

    def condition(self, short: Column, long: Column) -> Column:
        return _join_mixed([(e.is_or, e.condition(short, long)) for e in self.expressions])


@dataclass(frozen=True)
class PostQuery:
    """A search: optional time range (ms, 0 = open), language, hashtags and predicates."""

    predicates: Sequence[Predicate] = field(default_factory=tuple)
    start_ms: int = 0
    end_ms: int = 0
    language: str | None = None
    hashtags: str | None = None

    def canonical(self) -> str:
        """Text that is equal for searches that differ only in word or hashtag order."""
        block = "("
        for i, p in enumerate(self.predicates):
            block += (")OR(" if p.is_or else ")AND(") * (i > 0) + p.canonical()
        tags = None if self.hashtags is None else ",".join(sorted(_items(self.hashtags)))
        shown = [ABSENT if v is None else f"{GIVEN}{v}" for v in (tags, self.language)]
        return f"{block}),{shown[0]},{shown[1]},{self.start_ms},{self.end_ms}"

    def key(self, event: str) -> str:
        return hashlib.sha256((event + self.canonical()).encode()).hexdigest()

    def condition(
        self,
        text: Column | None = None,
        full_text: Column | None = None,
        ms: Column | None = None,
        legacy: bool = False,
    ) -> Column | None:
        """The whole filter, or None if nothing is asked for.

        ``legacy=True`` leaves the predicate block without its outer brackets, so that a
        predicate joined by OR escapes the time, language and hashtag conditions.
        """
        text = F.col("text") if text is None else text
        full_text = F.col("extended_tweet.full_text") if full_text is None else full_text
        fixed = [
            c
            for c in (
                time_range(self.start_ms, self.end_ms, ms),
                language_is(self.language),
                hashtag_any(self.hashtags),
            )
            if c is not None
        ]
        if legacy and fixed and self.predicates:
            parts = self._parts(F.lower(text), F.lower(full_text))
            return _join_mixed([(False, _all(fixed)), (False, parts[0][1]), *parts[1:]])
        if self.predicates:
            fixed.append(self._words(text, full_text))
        return _all(fixed) if fixed else None

    def _parts(self, short: Column, long: Column) -> list[tuple[bool, Column]]:
        return [(p.is_or, p.condition(short, long)) for p in self.predicates]

    def _words(self, text: Column, full_text: Column) -> Column:
        """The predicate block; each text is lower-cased just once, by passing the pair
        through a one-element array."""
        texts = F.array(F.struct(F.lower(text).alias("short"), F.lower(full_text).alias("long")))
        return F.exists(texts, lambda t: _join_mixed(self._parts(t["short"], t["long"])))

    def apply(self, posts: DataFrame, **columns) -> DataFrame:
        condition = self.condition(**columns)
        return posts if condition is None else posts.where(condition)


def time_range(start_ms: int = 0, end_ms: int = 0, ms: Column | None = None) -> Column | None:
    """Inclusive time range; 0 leaves an end open, both 0 mean no condition.

    ``ms`` may name a stored epoch column, whose range then reaches the file scan;
    otherwise the ``created_at`` text is parsed.
    """
    ms = created_ms(F.col("created_at")) if ms is None else ms
    if start_ms and end_ms:
        return ms.between(start_ms, end_ms)
    if start_ms:
        return ms >= start_ms
    return ms <= end_ms if end_ms else None


def language_is(language: str | None) -> Column | None:
    return F.col("lang") == language if language else None


def hashtag_any(hashtags: str | None, column: str = "entities.hashtags") -> Column | None:
    """At least one of the comma-separated hashtags, letter case ignored."""
    if not hashtags:
        return None
    wanted = sorted({h.lower() for h in _items(hashtags)})
    return F.exists(column, lambda tag: F.lower(tag["text"]).isin(wanted))


def words_match(kind: str, words: str) -> Callable[[DataFrame], DataFrame]:
    """A ``DataFrame.transform`` step for a single word expression."""
    return lambda posts: PostQuery([Predicate([Expression(kind, words)])]).apply(posts)


def originals(posts: DataFrame) -> DataFrame:
    """Posts that do not repeat another post."""
    return posts.where(F.col("retweeted_status").isNull())


def has_place(posts: DataFrame) -> DataFrame:
    """Posts with an exact point or a bounding box."""
    return posts.where(
        F.col("coordinates.coordinates").isNotNull()
        | F.col("place.bounding_box.coordinates").isNotNull()
    )
