"""Problem 3: one consistent form for text that looks the same.

The form is worked out once per distinct value: characters outside printable ASCII go through
an Arrow UDF, all others are their own form. Two forms are given:

* ``visual``: compatibility characters that look like their plain forms composed, every white
  space one blank, invisible characters removed, look-alike letters and hyphens replaced;
* ``folded``: the same with full case folding, the form under which values are compared.

Superscripts, fractions, circled and similar characters look different from their plain
forms and stay. A letter keeps its accent. Defined results: null stays null and is in no pair, nor is a row without a key;
the empty text is its own form and pairs only with texts of invisible characters; repeated
values share one form.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.runtime import materialize

# Letters of other scripts and the Latin letters they look like.
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Һ": "h",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I", "ɡ": "g",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # hyphens and quotes that cannot be told apart
    "‐": "-", "‑": "-", "−": "-", "﹣": "-", "ʼ": "’",
}

#: Compatibility mappings whose result looks like the source (fixed values).
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>")
#: Ligatures, digraph letters and Roman numerals, which look like the letters they stand for.
_LIGATURES = ((0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F), (0xFB00, 0xFB06))
#: Ranges of default-ignorable characters outside the format category (fixed values).
_IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
PLAIN = "^[\\x20-\\x7E]*$"


class _Looks(dict):
    """Character -> what it looks like, worked out by rule when a character is first met."""

    def __missing__(self, code: int) -> str | None:
        char = chr(code)
        kind = unicodedata.decomposition(char).split(" ")[0]
        ligature = any(a <= code <= b for a, b in _LIGATURES)
        look: str | None = char
        if char in LOOK_ALIKES:
            look = LOOK_ALIKES[char]
        elif char.isspace():
            look = " "
        elif any(a <= code <= b for a, b in _IGNORABLE):
            look = None
        elif kind in _SAME_LOOK or ligature or (kind and kind[0] != "<"):
            look = unicodedata.normalize("NFKC" if kind[0] == "<" else "NFC", char)
        self[code] = look
        return look


_LOOKS = _Looks()


def visual_text(text: str) -> str:
    """The composed form of one text, case kept."""
    # letters are mapped apart from their accents, so accented look-alikes meet as well
    parts = unicodedata.normalize("NFD", text).translate(_LOOKS)
    return unicodedata.normalize("NFC", parts)


def _forms(values: pd.Series) -> pd.DataFrame:
    visual = [None if x is None else visual_text(x) for x in values]
    folded = [None if x is None else unicodedata.normalize("NFC", x.casefold()) for x in visual]
    return pd.DataFrame({"visual": visual, "folded": folded})


def with_forms(values: DataFrame, column: str) -> DataFrame:
    """``values`` (distinct texts in ``column``) with their visual and folded forms."""
    # texts within printable ASCII go as nulls; the table is read once
    made = F.pandas_udf(_forms, "visual string, folded string")(F.when(~F.col(column).rlike(PLAIN), F.col(column)))
    out = values.withColumn("__forms", made)
    forms = {"visual": F.coalesce("__forms.visual", column), "folded": F.coalesce("__forms.folded", F.lower(column))}
    return out.withColumns(forms).drop("__forms")


def normalise_text(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the folded form of ``column`` in ``<column>_form``."""
    forms = with_forms(rows.select(F.col(column).alias("__value")).distinct(), "__value")
    forms = forms.select("__value", F.col("folded").alias(f"{column}_form"))
    kept = rows.drop(f"{column}_form")
    return kept.join(forms, kept[column].eqNullSafe(forms["__value"]), "left").drop("__value")


def look_alike_pairs(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key_a, key_b) of rows whose texts differ but look the same; the smaller key first.

    Pairs are made between the distinct texts of one form and only then spread to the rows, so
    copies of one text never meet each other.
    """
    rows = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("key").isNotNull())
    forms = with_forms(rows.select("text").distinct(), "text")
    # a form that two texts share has a text that is not its own form
    shared = forms.filter(F.col("text") != F.col("visual")).select("folded").distinct()
    members = materialize(forms.join(shared, "folded", "left_semi"))
    a, b = (members.select("folded", "visual", F.col("text").alias(f"text_{x}")) for x in "ab")
    pairs = a.join(b, ["folded", "visual"]).filter(F.col("text_a") < F.col("text_b"))  # same look, case included
    involved = materialize(rows.join(members.select("text"), "text", "left_semi"))
    left = involved.select(F.col("text").alias("text_a"), F.col("key").alias("a"))
    right = involved.select(F.col("text").alias("text_b"), F.col("key").alias("b"))
    both = pairs.select("text_a", "text_b").join(left, "text_a").join(right, "text_b")
    return both.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"))
