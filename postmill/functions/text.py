"""Names, word lists and query keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# How search keys write optional texts.
ABSENT, GIVEN = "-", "="

# The patterns of normalized names.
SPACES, DROPPED = r"\s+", "[^-a-zA-Z0-9]"


def slug(value: Column) -> Column:
    """Whitespace runs to ``-``, everything but letters, digits and ``-`` dropped, lower case."""
    dashed = F.regexp_replace(value, SPACES, "-")
    return F.lower(F.regexp_replace(dashed, DROPPED, ""))


def table_name(normalized: Column) -> Column:
    """Table identifier of a normalized name."""
    return F.translate(normalized, "-", "_")


def split_list(value: Column, separator: str = ",") -> Column:
    """Split at single-character ``separator`` and drop trailing empty items.

    The empty text is one empty item; a text of separators only has no item.
    """
    kept = F.rtrim(value, F.lit(separator))
    return (
        F.when(value == "", F.array(F.lit("")))
        .when(kept == "", F.array().cast("array<string>"))
        .otherwise(F.split(kept, f"[{separator}]"))
    )


def canonical_words(value: Column) -> Column:
    """Lower case, split at commas, sort, join again."""
    return F.array_join(F.array_sort(split_list(F.lower(value))), ",")


def canonical_hashtags(value: Column) -> Column:
    """Split at commas, sort, join again; the case is kept."""
    return F.array_join(F.array_sort(split_list(value)), ",")


def query_key(
    event: Column,
    predicates: Column,
    hashtags: Column,
    language: Column,
    start_ms: Column,
    end_ms: Column,
) -> Column:
    """Digest that identifies a search: equal searches on one event get equal keys.

    An absent text differs from every given one, so nothing can be asked for by the word
    that stands for absence.
    """
    def optional(c: Column) -> Column:
        return F.coalesce(F.concat(F.lit(GIVEN), c.cast("string")), F.lit(ABSENT))

    params = F.concat_ws(
        ",", predicates, optional(hashtags), optional(language), start_ms.cast("string"), end_ms.cast("string")
    )
    return F.sha2(F.concat(event, params), 256)
