"""Text normalisation, tokens and stop words as column expressions."""

from __future__ import annotations

import unicodedata
import warnings
from functools import cache
from importlib import resources

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_TOKEN_CHARS = 2


# Languages with a list, by tag and by name.
LANGUAGES = {"en": "en", "english": "en", "de": "de", "german": "de", "fr": "fr", "french": "fr", "es": "es", "spanish": "es"}


@cache
def stop_words(language: str) -> tuple[str, ...]:
    """The stop words of a language by its tag, regions aside, or its English name. One without a list warns and has none, so that its tokens pass through."""
    known = LANGUAGES.get(language.lower().replace("_", "-").split("-")[0])
    if known is None:
        warnings.warn(f"no stop words for {language}: nothing is filtered", stacklevel=2)
        return ()
    return tuple(resources.files(__package__).joinpath(f"stopwords_{known}.txt").read_text(encoding="utf-8").split())


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(text: Column) -> Column:
    """Unicode canonical composition, for which Spark has no built-in function. ASCII is composed: only other texts go to Python, each in a batch as it comes."""
    other = text.rlike(r"[^\x00-\x7F]")
    return F.when(other, _composed(F.when(other, text))).otherwise(text)


def normalize_text(text: Column, compose: bool = False) -> Column:
    """Lower case; all that is no letter, digit or white space becomes a space; runs of space become one."""
    lowered = F.lower(nfc(text) if compose else text)
    return F.trim(F.regexp_replace(lowered, r"[^\p{IsAlphabetic}\p{Nd}\p{Nl}\p{No}]+", " "))


def words(normalized: Column) -> Column:
    """Words of a normalised text; Han and Hiragana characters and superscript digits stand alone."""
    apart = F.regexp_replace(normalized, r"([\p{IsHan}\p{IsHiragana}\p{No}])", " $1 ")
    return F.filter(F.split(apart, " "), lambda w: w != "")


def is_token(word: Column) -> Column:
    """At least two characters, and not of ASCII digits alone."""
    return (F.length(word) >= MIN_TOKEN_CHARS) & ~word.rlike("^[0-9]+$")


def tokens(text: Column, language: str | None = None, compose: bool = False) -> Column:
    """The tokens of a text in order, without the stop words of `language`."""
    kept = F.filter(words(normalize_text(text, compose)), is_token)
    stops = stop_words(language) if language else ()
    return F.filter(kept, lambda w: ~w.isin(*stops)) if stops else kept
