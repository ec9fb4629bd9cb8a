"""Text for matching: normal form, phrases, tokens, templates."""

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def _plain(texts: pd.Series) -> pd.Series:
    def one(text):
        if text is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", text).casefold() if not unicodedata.combining(c))

    return texts.map(one)


def normalize(text: Column) -> Column:
    """Decomposed, case-folded, without marks; everything but letters and digits becomes one space. Spark has no NFKD."""
    return F.trim(F.regexp_replace(_plain(text), r"[^a-z0-9]+", " "))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether a normalized text holds a normalized phrase as whole words."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def any_phrase(text: Column, phrases: list[str]) -> Column:
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return F.exists(F.array(*[F.lit(f" {p} ") for p in phrases]), lambda p: F.contains(padded, p))


def has_token(text: Column, token: str) -> Column:
    """Whether an upper-case token stands in the original text between non-alphanumeric characters."""
    return text.rlike(rf"(?<![A-Za-z0-9]){re.escape(token)}(?![A-Za-z0-9])")


def tokens_found(text: Column, tokens: list[str]) -> Column:
    """How many of the tokens stand in a text between characters other than ASCII letters and digits, in any letter case."""
    return sum((F.lower(text).rlike(rf"(?<![a-z0-9]){re.escape(t.lower())}(?![a-z0-9])").cast("int") for t in tokens), F.lit(0))


def opponents(text: Column) -> Column:
    """Both sides of "A vs B" or "A at B"."""
    return F.split(text, r"(?i)\s+(?:vs\.?|at)\s+")


def after_last_dash(text: Column) -> Column:
    return F.substring_index(text, "-", -1)


def is_idempotency_key(text: Column) -> Column:
    """1 to 100 letters, digits and . _ : -, the first a letter or digit."""
    return text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,99}\z")


def signed_percent(value: Column) -> Column:
    """A fraction as a percentage with one digit: signed by + or the minus sign U+2212 unless it is zero; Unavailable where it is missing."""
    exact = value.cast("decimal(20,8)")
    shown = F.concat(F.round(F.abs(exact) * 100, 1).cast("decimal(20,1)").cast("string"), F.lit("%"))
    sign = F.when(exact > 0, "+").when(exact < 0, "\u2212").otherwise("")
    return F.coalesce(F.concat(sign, shown), F.lit("Unavailable"))


def money(value: Column) -> Column:
    return F.concat(F.when(value < 0, F.lit("-$")).otherwise(F.lit("$")), F.format_number(F.abs(value), 2))
