"""Text expressions: normal form, tokens, n-grams, similarity, redaction, small cleaners."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ASCII = "^[\\x00-\\x7F]*$"
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def normalize_ascii(text: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 one space, ends stripped."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _compose(values: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(values), dtype=object)
    there = values.notna()
    out[there] = [unicodedata.normalize("NFKC", v).lower() for v in values[there]]
    return out


def with_normalized(df: DataFrame, text: str, out: str = "normalized") -> DataFrame:
    """``df`` with the normal form of ``text``; only texts beyond ASCII visit Python, all others go as nulls.

    Null gives null, text without letters or digits the empty string. The table is read once.
    """
    composed = F.pandas_udf(_compose, "string")(F.when(~F.col(text).rlike(_ASCII), F.col(text)))
    return df.withColumn(out, normalize_ascii(F.coalesce(composed, F.col(text))))


def tokens(normalized: Column) -> Column:
    """Words of a normalised text; the empty text has none."""
    return F.filter(F.split(normalized, " "), lambda x: x != "")


def _jaccard(a: Column, b: Column) -> Column:
    """Set ratio: both empty 1, one empty 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words of two normalised texts."""
    return _jaccard(tokens(a), tokens(b))


def character_ngrams(normalized: Column, n: int = 3) -> Column:
    """Distinct character n-grams, padded by two blanks on both sides."""
    padded = F.concat(F.lit("  "), normalized, F.lit("  "))
    last = F.greatest(F.char_length(padded) - (n - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(padded, i, F.lit(n))))


def ngram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    """Jaccard similarity of the n-grams of two normalised texts."""
    return _jaccard(character_ngrams(a, n), character_ngrams(b, n))


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def sequence_similarity(a: Column, b: Column) -> Column:
    """Matching-blocks ratio of two normalised texts, the query first (not symmetric); Arrow UDF."""
    return F.pandas_udf(_ratio, "double")(a, b)


def sha256(text: Column) -> Column:
    """Hex digest of a text."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def uuid5_url(name: Column) -> Column:
    """Name-based identifier (version 5) in the URL name space."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("long")))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws(
        "-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12)
    )


# What is redacted, and in this order.
EMAIL = "(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b"
PHONE = "(?U)(?<!\\w)(?:\\+?\\d[\\d\\s()./-]{7,}\\d)(?!\\w)"
LONG_NUMBER = "(?U)\\b\\d{8,}\\b"


def redact_emails(text: Column) -> Column:
    """Mail addresses replaced by a mark."""
    return F.regexp_replace(text, EMAIL, "[REDACTED_EMAIL]")


def redact_long_numbers(text: Column) -> Column:
    """Numbers of eight digits or more replaced by a mark."""
    return F.regexp_replace(text, LONG_NUMBER, "[REDACTED_NUMBER]")


def redact_pii(text: Column) -> Column:
    """Mail addresses, then telephone-like strings, then long numbers."""
    return redact_long_numbers(F.regexp_replace(redact_emails(text), PHONE, "[REDACTED_PHONE]"))


def spreadsheet_safe(text: Column) -> Column:
    """A leading quote where a spreadsheet would read a formula."""
    return F.when(F.ltrim(text).rlike("^[=+@-]"), F.concat(F.lit("'"), text)).otherwise(text)


def clean_phone(text: Column) -> Column:
    """Ends and trailing commas stripped."""
    return F.regexp_replace(F.trim(text), ",+$", "")


def collapse_whitespace(text: Column) -> Column:
    """Runs of white space one blank, ends stripped."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


# Currency signs, in the order they are looked for.
CURRENCY_SIGNS = (("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"))


def detect_currency(text: Column, explicit: Column | None = None) -> Column:
    """An explicit code (upper case, 8 characters), else the first sign in order, else a labelled code."""
    signs = [F.when(F.instr(text, sign) > 0, F.lit(code)) for sign, code in CURRENCY_SIGNS]
    label = F.upper(F.regexp_extract(text, "(?im)^\\s*CURRENCY\\s*[:=]\\s*([A-Za-z]{3,8})\\s*$", 1))
    found = [*signs, F.nullif(label, F.lit(""))]
    if explicit is not None:
        found.insert(0, F.nullif(F.substring(F.upper(F.trim(explicit)), 1, 8), F.lit("")))
    return F.coalesce(*found)


def render_template(template: str, values: dict[str, Column]) -> Column:
    """Named placeholders ``{name}`` filled in; a placeholder without a value is an error."""
    import re

    missing = sorted(set(re.findall(r"\{(\w+)\}", template)) - set(values))
    if missing:
        raise ValueError(f"no value for {', '.join(missing)}")
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def between_tags(text: Column, tag: str) -> Column:
    """What stands between the first opening and closing tag, across lines; null where absent."""
    return F.nullif(F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1), F.lit(""))


# Wording that tries to instruct a model, numbered from 1.
INJECTION = (
    "(?i)ignore\\s+(all|any|the)?\\s*(previous|prior)\\s+instructions",
    "(?i)system\\s+prompt",
    "(?i)reveal\\s+.*(secret|database|api\\s*key)",
    "(?i)<\\s*(script|iframe)",
)
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"


def _flags(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in pairs]))


def union_flags(*flags: Column) -> Column:
    """Flags of several arrays in order, each once; a null array has none."""
    return F.array_distinct(F.concat(*[F.coalesce(f, F.array().cast("array<string>")) for f in flags]))


def untrusted_flags(text: Column) -> Column:
    """Ordered flags of instruction-like wording and control characters."""
    found = [(text.rlike(p), f"prompt_injection_pattern_{i}") for i, p in enumerate(INJECTION, 1)]
    return _flags(*found, (text.rlike(CONTROL), "control_characters"))


def description_flags(text: Column) -> Column:
    """Ordered flags of a description that cannot be used."""
    return _flags(
        (text.rlike("(?U)^\\s*$"), "empty_generated_description"),
        (F.char_length(text) > 120, "generated_description_too_long"),
        (F.lower(text).rlike("https?://"), "generated_description_contains_url"),
        (text.rlike(CONTROL), "generated_description_control_characters"),
    )


def sorted_json(entries: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))
