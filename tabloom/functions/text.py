"""Text features over whole texts, all JVM-side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# The patterns below decide the flags and must stay as they are.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
PHONE = r"\b[0-9]{3}[-.]?[0-9]{3}[-.]?[0-9]{4}\b"
TITLE = r"\b(Mr|Mrs|Miss|Dr|Prof|Sr|Jr)\.?\b"
WORD = r"[\p{L}\p{N}_]{2,}"


@dataclass(frozen=True)
class TextConfig:
    enable_basic_features: bool = True
    enable_patterns: bool = True
    enable_tfidf: bool = False
    max_tfidf_features: int = 100
    ngram_range: tuple[int, int] = (1, 2)
    stop_words: tuple[str, ...] | None = None


@dataclass(frozen=True)
class TextParams:
    column: str
    has_null: bool


def char_length(text: Column) -> Column:
    return F.char_length(text)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+"))


def uppercase_ratio(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Z]")) / F.greatest(F.char_length(text), F.lit(1))


def digit_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[0-9]"))


def special_char_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^a-zA-Z0-9 \t\n\x0B\f\r]"))


def has_email(text: Column) -> Column:
    # the '@' test is a plain substring search and spares most rows the pattern
    return (text.contains("@") & text.rlike(EMAIL)).cast("int")


def has_url(text: Column) -> Column:
    return (text.contains("://") & text.rlike(URL)).cast("int")


def has_phone(text: Column) -> Column:
    return text.rlike(PHONE).cast("int")


def has_title(text: Column) -> Column:
    return text.rlike(TITLE).cast("int")


def words(text: Column, stop_words: list[str]) -> Column:
    """Lower-case words of two or more characters without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(list(stop_words))) if stop_words else found


def ngrams(words: Column, ngram_range: tuple[int, int] = (1, 2)) -> Column:
    """All n-grams of a words column (give a computed column: it is read once per n)."""
    low, high = ngram_range
    parts = [words if n == 1 else _grams(words, n) for n in range(low, high + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _grams(words: Column, n: int) -> Column:
    size = F.greatest(F.size(words) - (n - 1), F.lit(0))
    grams = F.slice(words, F.lit(1), size)
    for k in range(2, n + 1):
        grams = F.zip_with(grams, F.slice(words, F.lit(k), size), lambda left, right: F.concat_ws(" ", left, right))
    return grams


def text_features(params: TextParams, config: TextConfig, source: Column | None = None) -> dict[str, Column]:
    name = params.column
    raw = source if source is not None else F.col(name)
    text = F.coalesce(raw.cast("string"), F.lit(""))
    out: dict[str, Column] = {}
    if config.enable_basic_features:
        out[f"{name}_length"] = char_length(text)
        out[f"{name}_word_count"] = word_count(text)
        out[f"{name}_char_count"] = char_length(text)
        out[f"{name}_uppercase_ratio"] = uppercase_ratio(text)
        out[f"{name}_digit_count"] = digit_count(text)
        out[f"{name}_special_char_count"] = special_char_count(text)
    if config.enable_patterns:
        out[f"{name}_has_email"] = has_email(text)
        out[f"{name}_has_url"] = has_url(text)
        out[f"{name}_has_phone"] = has_phone(text)
        if "name" in name.lower():
            out[f"{name}_has_title"] = has_title(text)
    if params.has_null:
        out[f"{name}_was_missing"] = raw.isNull().cast("int")
    return out
