"""Text scoring by lexicons and patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: str) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"\W+"))


def sentiment(text: str, bull: list[str], bear: list[str]) -> Column:
    """(bull - bear) / (bull + bear) of the distinct words that a lexicon has, rounded to 3; 0 without any."""
    found = lambda lexicon: F.size(F.array_intersect(words(text), F.array(*map(F.lit, lexicon))))
    up, down = found(bull), found(bear)
    return F.coalesce(F.round(F.try_divide(up - down, up + down), 3), F.lit(0.0))


def sentiment_label(score: str) -> Column:
    return F.when(F.col(score) > 0.1, "bullish").when(F.col(score) < -0.1, "bearish").otherwise("neutral")


def relevance(text: str, query: str) -> Column:
    """Share of the query's words that the text contains, rounded to 3."""
    wanted = F.split(F.lower(F.lit(query)), " ")
    return F.round(F.size(F.filter(wanted, lambda w: F.contains(F.lower(text), w))) / F.size(wanted), 3)


def tickers(text: str, known: list[str]) -> Column:
    """Known symbols written as $SYM, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.array_intersect(F.regexp_extract_all(text, F.lit(r"\$([A-Z]{1,5})\b"), 1), F.array(*map(F.lit, known)))))
