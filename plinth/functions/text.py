"""Scalar functions on text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cell contents that stand for an error or for nothing in spreadsheets.
SENTINELS = ["#N/A", "#REF!", "#VALUE!", "#DIV/0!", "#NAME?", "#NULL!", "#NUM!"]
BLANKS = ["", "-", "–", "—", ".", "..", "n/a", "na", "nil"]


def clean_number(raw: Column) -> Column:
    """A number from a messy cell: thousands commas, per cent signs and spaces go, parentheses mean minus, dashes mean nothing."""
    t = F.trim(raw)
    negative = t.rlike(r"^\(.*\)$")
    digits = F.regexp_replace(t, r"[,%\s()]", "")
    value = F.try_cast(digits, "double") if hasattr(F, "try_cast") else digits.try_cast("double")
    return F.when(F.lower(t).isin(BLANKS) | t.isNull(), F.lit(None).cast("double")).when(negative, -value).otherwise(value)


def parse_id(raw: Column) -> tuple[Column, Column]:
    """A strict whole number, and the note why there is none."""
    t = F.trim(raw)
    value = F.when(t.rlike(r"^[0-9]{1,9}$"), t.try_cast("long"))
    note = F.when(t.isNull() | (t == ""), "empty").when(t.isin(SENTINELS), "sentinel").when(value.isNull(), "not a number")
    return value, note


def scaled_by_words(value: Column, unit: Column) -> Column:
    """A figure in units: words of magnitude in the unit multiply it."""
    u = F.lower(unit)
    return value * F.when(u.rlike(r"\b(bn|billion)\b"), 1e9).when(u.rlike(r"\b(mn|million|m)\b"), 1e6).when(u.rlike(r"\b(thousand|k)\b"), 1e3).otherwise(1.0)


def squash(raw: Column) -> Column:
    return F.trim(F.regexp_replace(raw, r"\s+", " "))


def normalise_name(raw: Column) -> Column:
    """A name for matching (ASCII): lower case, & as and, no apostrophes, other symbols as spaces."""
    t = F.regexp_replace(F.regexp_replace(F.lower(raw), "&", " and "), "['’`]", "")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def slug(raw: Column) -> Column:
    return F.regexp_replace(normalise_name(raw), " ", "-")


def file_key(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[^A-Za-z0-9._-]+", "_")


def ordinal(n: Column) -> Column:
    ten, hundred = n % 10, n % 100
    suffix = F.when(hundred.between(11, 13), "th").when(ten == 1, "st").when(ten == 2, "nd").when(ten == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def search_score(text: Column, label: Column, term: str) -> Column:
    """120 equal, 95 starts with, 72 a word of the label starts with, 50 a word of the text, 24 contained, else 0."""
    low, label = term.lower(), F.lower(label)
    word = r"(^|[^a-z0-9])" + "".join(f"\\{c}" if not c.isalnum() else c for c in low)
    return F.when(label == low, 120).when(label.startswith(low), 95).when(label.rlike(word), 72).when(F.lower(text).rlike(word), 50).when(F.lower(text).contains(low), 24).otherwise(0).cast("long")


def label_score(asked: Column, label: Column) -> Column:
    """100 for equal names, else the shorter length if one holds the other, else 0."""
    a, b = normalise_name(asked), normalise_name(label)
    return F.when(a == b, 100).when(a.contains(b) | b.contains(a), F.least(F.length(a), F.length(b))).otherwise(0).cast("long")


def canonical_url(url: Column) -> Column:
    """Without the fragment, with the query's parameters in order."""
    bare = F.split_part(url, F.lit("#"), F.lit(1))
    path, query = F.split_part(bare, F.lit("?"), F.lit(1)), F.split_part(bare, F.lit("?"), F.lit(2))
    return F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&")))


def uuid5(name: Column, namespace: str) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 8))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def fiscal_year(day: Column, first_month: int = 7) -> Column:
    """Label YYYY/YY of the fiscal year that starts in first_month."""
    start = F.year(day) - F.when(F.month(day) < first_month, 1).otherwise(0)
    return F.format_string("%d/%02d", start, (start + 1) % 100)


def month_index(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day)).cast("long")
