"""Scalar functions as Spark columns."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .vocab import DATE_FORMATS


def to_double(col: Column) -> Column:
    """A number, or null where there is none."""
    return col.try_cast("double")


def to_int(col: Column) -> Column:
    """An integer, or null; text with a fraction is not one."""
    return F.when(F.trim(col.cast("string")).rlike(r"^[+-]?\d+$"), F.trim(col.cast("string")).try_cast("bigint"))


def clean_cell(col: Column) -> Column:
    """A statement cell as struct(num, txt): empty cells and dashes are null, percentages stay text, commas go."""
    text = F.trim(F.regexp_replace(col, r"\s+", " "))
    number = F.regexp_replace(text, ",", "").try_cast("double")
    blank = text.isNull() | text.isin("", "-")
    percent = text.contains("%")
    return F.struct(
        F.when(~blank & ~percent, number).alias("num"),
        F.when(~blank & (percent | number.isNull()), text).alias("txt"),
    )


def row_label(col: Column) -> Column:
    """A statement row's label without the mark of an expandable row."""
    return F.trim(F.replace(F.regexp_replace(col, r"\s+", " "), F.lit("+"), F.lit("")))


def ticker_slug(col: Column) -> Column:
    """The ticker without its exchange suffix."""
    return F.upper(F.trim(F.split_part(col, F.lit("."), F.lit(1))))


def currency(ticker: Column) -> Column:
    return F.when(ticker.contains(".NS") | ticker.contains(".BO"), "INR").otherwise("USD")


def snippet(col: Column, n: int = 500) -> Column:
    """The first n characters, with dots if there is more."""
    return F.trim(F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col))


def summary(col: Column, n: int = 200) -> Column:
    """The stand-in for a written summary: the start of a text, trimmed before the dots."""
    text = F.coalesce(col, F.lit(""))
    return F.concat(F.trim(F.substring(text, 1, n)), F.when(F.length(text) > n, "...").otherwise(""))


def parse_date(col: Column) -> Column:
    """The first of the known date formats that fits, as a timestamp; null if none does."""
    text = F.trim(col)
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS))


def feed_date(col: Column) -> Column:
    """A date of mail style, such as ``Tue, 02 Jan 2024 10:00:00 GMT``."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(col), r"^[A-Za-z]{3},\s*", ""), F.lit("dd MMM yyyy HH:mm:ss z"))


def headline(title: Column) -> tuple[Column, Column]:
    """A feed title split at its last dash: headline, and source or null."""
    parts = r"(?s)^(.*) - (.*)$"
    split = title.rlike(parts)
    return F.when(split, F.trim(F.regexp_extract(title, parts, 1))).otherwise(title), F.when(split, F.trim(F.regexp_extract(title, parts, 2)))


def strip_fence(col: Column) -> Column:
    """A model's answer without the fence around its JSON."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(col), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def answer_json(col: Column) -> Column:
    """The JSON of an answer as a variant: all of it, or else its first flat object."""
    text = strip_fence(col)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)\{[^{}]*\}", 0)))


def valid_confidence(col: Column) -> Column:
    """A confidence cut to 0 to 1; 0.7 where there is none."""
    number = F.coalesce(to_double(col), F.lit(0.7))  # before the bounds, as these would take the place of a null
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), number))


def valid_member(col: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(col.isin(*allowed), col).otherwise(default)


def band(value: Column, higher: Column, green: Column, yellow: Column) -> Column:
    """green, yellow or red by bounds; null without a value."""
    up = F.when(value >= green, "green").when(value >= yellow, "yellow").otherwise("red")
    down = F.when(value <= green, "green").when(value <= yellow, "yellow").otherwise("red")
    return F.when(value.isNotNull(), F.when(higher, up).otherwise(down))


def risk_colour(col: Column) -> Column:
    text = F.trim(col)
    return F.when(text == "Low", "green").when(text.isin("Medium", "Elevated"), "yellow").when(text == "High", "red")


def mood_colour(col: Column) -> Column:
    text = F.trim(col)
    return F.when(text == "Positive", "green").when(text == "Neutral", "yellow").when(text == "Negative", "red")


def severity(col: Column) -> Column:
    """Colours as numbers, so that the worst is the largest."""
    return F.when(F.lower(col) == "red", 3).when(F.lower(col) == "yellow", 2).when(F.lower(col) == "green", 1)


def colour(level: Column) -> Column:
    return F.when(level == 3, "red").when(level == 2, "yellow").when(level == 1, "green")


def humanised(col: Column) -> Column:
    """A number with B, M or K, two decimals."""
    size = F.abs(col)
    part = lambda by, unit: F.concat(F.format_number(col / by, 2), F.lit(unit))
    return F.when(size >= 1e9, part(1e9, "B")).when(size >= 1e6, part(1e6, "M")).when(size >= 1e3, part(1e3, "K")).otherwise(F.format_number(col, 2))


def title_words(col: Column) -> Column:
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def verdict_bucket(col: Column) -> Column:
    text = F.lower(col)
    return F.when(text.contains("buy") | text.contains("bull"), "positive").when(text.contains("sell") | text.contains("bear"), "negative").otherwise("neutral")


def state_hash(*columns: Column) -> Column:
    """MD5 of a state as JSON; absent hashes count as equal to any."""
    return F.md5(F.to_json(F.struct(*columns)))


def in_sync(sent: Column, own: Column) -> Column:
    return sent.isNull() | (sent == own)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def sentence_trim(text: Column) -> Column:
    """Cuts after the last sentence end if that is in a text's second half; else the text stays."""
    head = F.regexp_extract(text, r"(?s)^(.*[.!?\n])(?:[ \n\t].*)?$", 1)
    return F.when(F.length(head) - 1 > F.floor(F.length(text) / 2), head).otherwise(text)


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of two texts."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)
