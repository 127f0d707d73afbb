"""Load delimited rows and typed amounts; set the rows that do not parse apart with a reason.

Numbers are judged and cast once per distinct (column, value): they form a dictionary of numbers
and of invalid values with their reason, which is joined back to the rows. Structure (quoting, column count, the
description) is judged on the row itself by one regular expression.

Defined results: a null or blank number is missing and never fails; a null raw row is no
record and fails with ``quoting``; rows of other sections pass through unjudged; an empty
table gives an empty result. Repeated rows are judged alike, one result a row. Columns of the
input are never read by position, and working columns carry a prefix, so extra columns keep
their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.functions.money import MONEY, QUANTITY, is_missing, number_text, typed_number
from billweave.runtime import broadcast_if_small, materialize

LINE_FIELDS = ("description", "quantity", "unit_price", "total")
DESCRIPTION_LIMIT = 2000
_QUOTED = '"[^"]*+(?:""[^"]*+)*+"'


def _field_pattern(delimiter: Column) -> Column:
    """A field of one record: quoted as a whole, or without quote, line break and delimiter."""
    quoted_mark = F.concat(F.lit("\\Q"), F.coalesce(delimiter, F.lit(",")), F.lit("\\E"))
    plain = F.concat(F.lit("(?:(?!"), quoted_mark, F.lit(')[^"\\r\\n])*+'))
    return F.concat(F.lit(f"(?:{_QUOTED}|"), plain, F.lit(")"))


def split_record(raw: Column, delimiter: Column) -> Column:
    """The fields of one RFC 4180 record, or null where ``raw`` is not exactly one record."""
    field = _field_pattern(delimiter)
    mark = F.concat(F.lit("\\Q"), F.coalesce(delimiter, F.lit(",")), F.lit("\\E"))
    record = F.concat(F.lit("\\A"), field, F.lit("(?:"), mark, field, F.lit(")*+\\z"))
    led = F.concat(F.coalesce(delimiter, F.lit(",")), raw)  # a leading mark gives every field one
    fields = F.regexp_extract_all(led, F.concat(F.lit("\\G"), mark, F.lit("("), field, F.lit(")")), F.lit(1))
    unquoted = F.transform(
        fields,
        lambda x: F.when(
            x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
        ).otherwise(x),
    )
    return F.when(F.regexp_like(raw, record), unquoted)


def number_dictionary(long: DataFrame) -> DataFrame:
    """(field, value, text, number, reason) of the distinct (field, value) pairs, each judged and cast once.

    ``reason`` is the field where the value is no number; ``number`` is null there and where the
    number is longer than its field's type.
    """
    read = long.select("field", "value").distinct().withColumn("text", number_text(F.col("value")))
    number = F.when(F.col("field") == "quantity", typed_number(F.col("text"), QUANTITY)).otherwise(typed_number(F.col("text"), MONEY))
    return read.withColumns({"number": number, "reason": F.when(F.col("text").isNull(), F.col("field"))})


def number_cells(rows: DataFrame, fields: Sequence[str], *keep: str) -> DataFrame:
    """(keep, rank, field, value) of the numbers of each row that are not missing."""
    cells = F.array(
        *[F.struct(F.lit(i).alias("rank"), F.lit(f).alias("field"), F.col(f).alias("value")) for i, f in enumerate(fields)]
    )
    return rows.select(*keep, F.inline(cells)).filter(~is_missing(F.col("value")))


def number_failures(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, rank, reason) of the first of ``fields`` that fails in each row of ``rows``."""
    long = number_cells(rows.withColumnRenamed(key, "key"), fields, "key")
    bad = number_dictionary(long).filter(F.col("reason").isNotNull()).select("field", "value", "reason")
    bad = broadcast_if_small(materialize(bad), "field", "value", "reason")
    hits = long.join(bad, ["field", "value"])
    first = hits.groupBy("key").agg(F.min(F.struct("rank", "reason")).alias("first"))
    return first.select("key", "first.rank", "first.reason")


def raw_row_fields(rows: DataFrame, raw: str = "c1", delimiter: str = "delimiter", key: str = "row_id") -> DataFrame:
    """(key, structural reason, the four fields) of each raw row."""
    parts = rows.select(F.col(key).alias("key"), split_record(F.col(raw), F.col(delimiter)).alias("parts"))
    count_ok = F.size("parts") == len(LINE_FIELDS)
    text = F.get("parts", F.lit(0))
    blank = F.regexp_replace(text, "[\\s\\u00A0\\u3000]+", "") == ""
    reason = (
        F.when(F.col("parts").isNull(), "quoting")
        .when(~count_ok, "column_count")
        .when(blank | (F.char_length(text) > DESCRIPTION_LIMIT), "description")
    )
    return parts.select(
        "key", reason.alias("structure"), *[F.get("parts", F.lit(i)).alias(f) for i, f in enumerate(LINE_FIELDS)]
    )


def rejected_raw_rows(rows: DataFrame) -> DataFrame:
    """(key, reason) of the raw line rows that do not load; the first reason that applies."""
    parsed = raw_row_fields(rows.filter(F.col("section") == "line"))
    structural = parsed.filter(F.col("structure").isNotNull()).select("key", F.col("structure").alias("reason"))
    sound = parsed.filter(F.col("structure").isNull())
    return structural.unionByName(number_failures(sound, "key", LINE_FIELDS[1:]).select("key", "reason"))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """(key, reason) of the stored lines whose amounts are no numbers."""
    return number_failures(lines, "line_id", ("unit_price", "total")).select("key", "reason")


def load_numbers(rows: DataFrame, *keep: str, optional: Sequence[str] = ()) -> DataFrame:
    """``keep`` and the three numbers, typed, of the rows without a failing one; the dictionary's numbers are joined in.

    A row is known by its place in the scan, so rows without a key or with a repeated one stay rows
    of their own. A field of ``optional`` fails nothing. ``untyped`` lists (field=text) what is too
    long for its type and what is no number in an optional field.
    """
    fields = LINE_FIELDS[1:]
    rows = rows.select(F.monotonically_increasing_id().alias("__row"), *keep, *fields)
    long = number_cells(rows, fields, "__row")
    known = broadcast_if_small(materialize(number_dictionary(long)), "field", "value", "text")
    fails = F.col("reason").isNotNull() & ~F.col("field").isin(*optional)
    left = F.when(F.col("number").isNull(), F.concat(F.col("field"), F.lit("="), F.coalesce("text", "value")))
    cells = long.join(known, ["field", "value"]).select("__row", "field", "number", fails.alias("fails"), left.alias("left"))
    together = rows.select("__row", *keep).unionByName(cells, allowMissingColumns=True).groupBy("__row")
    loaded = together.agg(
        *[F.max(c).alias(c) for c in keep],
        F.bool_or(F.coalesce("fails", F.lit(False))).alias("__bad"),
        *[F.max(F.when(F.col("field") == f, F.col("number"))).cast(QUANTITY if f == "quantity" else MONEY).alias(f) for f in fields],
        F.array_join(F.array_sort(F.collect_list("left")), ";").alias("untyped"),
    )
    return loaded.filter(~F.col("__bad")).drop("__row", "__bad")


def loaded_raw_rows(rows: DataFrame) -> DataFrame:
    """The raw line rows that load, typed; the complement of :func:`rejected_raw_rows`."""
    sound = raw_row_fields(rows.filter(F.col("section") == "line")).filter(F.col("structure").isNull())
    return load_numbers(sound.withColumnRenamed("key", "row_id"), "row_id", "description")


def loaded_lines(lines: DataFrame) -> DataFrame:
    """The stored lines whose amounts load, typed; the complement of :func:`rejected_lines`."""
    return load_numbers(lines, "line_id", "description", optional=("quantity",))
