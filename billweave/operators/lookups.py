"""Lookups with defaults, and the part of a text that matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billweave.functions.text import redact_pii, with_normalized
from billweave.operators.parties import LINE_BREAK

#: White space at the ends of a line, without-break blanks included.
STRIP = "^[\\s\u00A0\u3000]+|[\\s\u00A0\u3000]+$"


def lookup(rows: DataFrame, dimension: DataFrame, key: str, value: str, default_key: str = "default") -> DataFrame:
    """``rows`` with ``value`` of their key, else that of the default key, else null.

    The dimension has one row a key; the default is read with it, in the same plan.
    """
    named = dimension.select(key, F.col(value).alias("__own")).filter(F.col(key) != default_key)
    fallback = dimension.filter(F.col(key) == default_key).select(F.lit(1).alias("__one"), F.col(value).alias("__default"))
    joined = rows.join(named, key, "left").withColumn("__one", F.lit(1)).join(F.broadcast(fallback.limit(1)), "__one", "left")
    return joined.withColumn(value, F.coalesce("__own", "__default")).drop("__own", "__default", "__one")


def first_contained(text: Column, answers: list[tuple[str, str]], default: str | None = None) -> Column:
    """The answer of the first phrase, in list order, that the text contains."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(phrase)), F.lit(answer)) for phrase, answer in answers], F.lit(default))


def item_region(text: Column) -> Column:
    """The filled lines from two before the item header to one after the subtotal; the whole text where none is left.

    Without a header the text starts at its beginning, without a subtotal it runs to its end.
    """
    lines = F.filter(F.transform(F.split(text, LINE_BREAK), lambda x: F.regexp_replace(x, STRIP, "")), lambda x: x != "")
    place = lambda test: F.array_min(F.transform(lines, lambda x, i: F.when(test(F.lower(x), i), i)))
    header = place(lambda x, i: x.rlike("description|purchased item|line item"))
    first = F.greatest(F.coalesce(header, F.lit(0)) - 2, F.lit(0))
    last = place(lambda x, i: (i >= first) & x.rlike("^(subtotal|balance due)"))
    n = F.least(F.coalesce(last + 2, F.size(lines)), F.size(lines)) - first
    region = F.array_join(F.slice(lines, first + 1, F.greatest(n, F.lit(0))), "\n")
    return F.when(region == "", text).otherwise(region)


def minimized_region(text: Column, limit: int) -> Column:
    """The item region without personal data, cut to a length."""
    return F.substring(redact_pii(item_region(text)), 1, limit)


def proposals(lines: DataFrame, given: DataFrame, normalized: str = "normalized") -> DataFrame:
    """``lines`` with the recorded proposal of their normalised text, else the one under ``default``.

    ``given`` has ``source`` and ``proposal``; sources are normalised here, of equal ones the least proposal counts.
    """
    keyed = with_normalized(given.filter(F.col("source") != "default"), "source", normalized)
    keyed = keyed.groupBy(normalized).agg(F.min("proposal").alias("proposal"))
    default = given.filter(F.col("source") == "default").select(F.lit("default").alias(normalized), F.min("proposal").over(Window.partitionBy("source")).alias("proposal"))
    return lookup(lines, keyed.unionByName(default.limit(1)), normalized, "proposal")
