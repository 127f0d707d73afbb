"""Queries of problem 6: rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.operators.row_quarantine import LINE_FIELDS, loaded_lines, loaded_raw_rows, rejected_lines, rejected_raw_rows
from billweave.runtime import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows (R) and lines (L) that fail, with the first reason that applies."""
    raw = rejected_raw_rows(table(spark, sf_dir, "equivalent_invoice"))
    lines = rejected_lines(table(spark, sf_dir, "invoice_lines"))
    tagged = [d.select(F.concat(F.lit(tag), F.col("key")).alias("source_key"), "reason") for tag, d in (("R", raw), ("L", lines))]
    return tagged[0].unionByName(tagged[1])


def p6_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows (R) and lines (L) that load: all that p6_found does not set apart, typed amounts shown as text."""
    raw = loaded_raw_rows(table(spark, sf_dir, "equivalent_invoice"))
    lines = loaded_lines(table(spark, sf_dir, "invoice_lines"))
    tagged = [
        d.select(
            F.concat(F.lit(tag), F.col(key)).alias("source_key"), "description",
            *[F.col(c).cast("string").alias(c) for c in LINE_FIELDS[1:]], "untyped",
        )
        for tag, key, d in (("R", "row_id", raw), ("L", "line_id", lines))
    ]
    return tagged[0].unionByName(tagged[1])


QUERIES = {"p6_found": p6_found, "p6_loaded": p6_loaded}

_NUM = (
    r"^[ \t]*[+-]?[ \t]*(?:[$€£]|[A-Z]{3})?[ \t]*(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+|[0-9]{1,3}(?:\.[0-9]{3})+"
    r"|[0-9]{1,3}(?: [0-9]{3})+|[0-9]{1,3}(?:''[0-9]{3})+)(?:[ \t]*[.,][0-9]{1,4})?[ \t]*(?:[$€£]|[A-Z]{3})?[ \t]*$"
)


def _bad(c: str) -> str:
    return f"coalesce(trim({c}, ' \t\r\n'), '') <> '' AND NOT regexp_matches({c}, '{_NUM}')"


_PARSED = """
    WITH parts AS (
      SELECT row_id, c1, delimiter, CASE delimiter WHEN ',' THEN ',' WHEN ';' THEN ';' ELSE chr(9) END AS d,
        CASE delimiter
          WHEN ',' THEN regexp_full_match(c1, '(?:"(?:[^"]|"")*"|[^",\r\n]*)(?:,(?:"(?:[^"]|"")*"|[^",\r\n]*))*')
          WHEN ';' THEN regexp_full_match(c1, '(?:"(?:[^"]|"")*"|[^";\r\n]*)(?:;(?:"(?:[^"]|"")*"|[^";\r\n]*))*')
          ELSE regexp_full_match(c1, '(?:"(?:[^"]|"")*"|[^"\t\r\n]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t\r\n]*))*') END AS sound,
        CASE delimiter
          WHEN ',' THEN regexp_extract_all(',' || c1, ',("(?:[^"]|"")*"|[^",\r\n]*)', 1)
          WHEN ';' THEN regexp_extract_all(';' || c1, ';("(?:[^"]|"")*"|[^";\r\n]*)', 1)
          ELSE regexp_extract_all(chr(9) || c1, '\t("(?:[^"]|"")*"|[^"\t\r\n]*)', 1) END AS f
      FROM equivalent_invoice WHERE section = 'line'),
    un AS (SELECT row_id, coalesce(sound, false) AS sound, list_transform(f, lambda x: CASE WHEN starts_with(x, '"')
        THEN replace(x[2:-2], '""', '"') ELSE x END) AS f FROM parts)"""
_CAPTURE = (
    r"^[ \t]*([+-]?)[ \t]*(?:[$€£]|[A-Z]{3})?[ \t]*([0-9]+|[0-9]{1,3}(?:,[0-9]{3})+|[0-9]{1,3}(?:\.[0-9]{3})+"
    r"|[0-9]{1,3}(?: [0-9]{3})+|[0-9]{1,3}(?:''[0-9]{3})+)(?:[ \t]*[.,]([0-9]{1,4}))?[ \t]*(?:[$€£]|[A-Z]{3})?[ \t]*$"
)


def _text(c: str) -> str:
    """SQL of the plain decimal text of a number; null for all else."""
    sign, whole, part = (f"regexp_extract({c}, '{_CAPTURE}', {i})" for i in (1, 2, 3))
    digits = f"regexp_replace(regexp_replace({whole}, '[^0-9]', '', 'g'), '^0+([0-9])', '\\1')"
    return (
        f"CASE WHEN regexp_matches({c}, '{_CAPTURE}') THEN (CASE {sign} WHEN '-' THEN '-' ELSE '' END) || {digits} || "
        f"(CASE {part} WHEN '' THEN '' ELSE '.' || {part} END) END"
    )


def _typed(text: str, dtype: str, whole: int) -> str:
    return f"CASE WHEN length(regexp_replace({text}, '^-|[.].*', '', 'g')) <= {whole} THEN try_cast({text} AS {dtype}) END"


def _left(field: str, number: str, text: str, raw: str | None = None) -> str:
    there = f"{text} IS NOT NULL" if raw is None else f"coalesce(trim({raw}, ' \t\r\n'), '') <> ''"
    shown = text if raw is None else f"coalesce({text}, {raw})"
    return f"CASE WHEN {number} IS NULL AND {there} THEN '{field}=' || {shown} END"


_LOAD = f"""
    n AS (SELECT *, {_text('q')} AS qt, {_text('u')} AS ut, {_text('t')} AS tt FROM good),
    d AS (SELECT *, {_typed('qt', 'DECIMAL(20,6)', 14)} AS quantity, {_typed('ut', 'DECIMAL(20,4)', 16)} AS unit_price, {_typed('tt', 'DECIMAL(20,4)', 16)} AS total FROM n)
    SELECT source_key, description, CAST(quantity AS VARCHAR) AS quantity, CAST(unit_price AS VARCHAR) AS unit_price, CAST(total AS VARCHAR) AS total, concat_ws(';', {_left('quantity', 'quantity', 'qt', 'q')},
      {_left('total', 'total', 'tt')}, {_left('unit_price', 'unit_price', 'ut')}) AS untyped FROM d"""

ORACLE = {
    "p6_found": f"""{_PARSED},
    r AS (SELECT 'R' || row_id AS source_key, CASE WHEN NOT sound THEN 'quoting' WHEN len(f) <> 4 THEN 'column_count'
        WHEN regexp_replace(f[1], '\\s+', '', 'g') = '' OR length(f[1]) > 2000 THEN 'description'
        WHEN {_bad('f[2]')} THEN 'quantity' WHEN {_bad('f[3]')} THEN 'unit_price' WHEN {_bad('f[4]')} THEN 'total' END AS reason FROM un),
    l AS (SELECT 'L' || line_id AS source_key, CASE WHEN {_bad('unit_price')} THEN 'unit_price' WHEN {_bad('total')} THEN 'total' END AS reason
      FROM invoice_lines)
    SELECT * FROM r WHERE reason IS NOT NULL UNION ALL SELECT * FROM l WHERE reason IS NOT NULL""",
    "p6_loaded": f"""{_PARSED},
    good AS (SELECT 'R' || row_id AS source_key, f[1] AS description, f[2] AS q, f[3] AS u, f[4] AS t FROM un WHERE sound AND len(f) = 4
        AND regexp_replace(f[1], '\\s+', '', 'g') <> '' AND length(f[1]) <= 2000 AND NOT ({_bad('f[2]')}) AND NOT ({_bad('f[3]')}) AND NOT ({_bad('f[4]')})
      UNION ALL SELECT 'L' || line_id, description, quantity, unit_price, total FROM invoice_lines WHERE NOT ({_bad('unit_price')}) AND NOT ({_bad('total')})),{_LOAD}""",
}
