"""The few scalar functions that Spark lacks, as Arrow-batched pandas functions."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(StringType())
def fold_accents(values: pd.Series) -> pd.Series:
    """NFKD without the marks: accented letters as plain ones."""
    return values.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def _plain_letters() -> tuple[str, str]:
    """The letters of U+00C0 to U+024F and U+1E00 to U+1EFF that are an ASCII letter with marks, and those letters."""
    bare = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)) for r in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in r}
    found = {k: v for k, v in bare.items() if len(v) == 1 and v.isascii() and v.isalpha()}
    return "".join(found), "".join(found.values())


ACCENTED, BARE = _plain_letters()


def folded(text: Column) -> Column:
    """As fold_accents, but in the JVM for texts whose only other characters than ASCII are accented Latin letters."""
    t = F.translate(text, ACCENTED, BARE)
    rest = t.rlike(r"[^\x00-\x7F]")
    return F.when(rest, fold_accents(F.when(rest, text))).otherwise(t)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity, 0 to 1; null if either is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")
