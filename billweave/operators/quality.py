"""Checks of documents: line arithmetic, subtotals, reconciliation of totals."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.functions.money import parse_decimal, to_decimal

TOLERANCE = "0.01"


def line_arithmetic(lines: DataFrame, *keys: str) -> DataFrame:
    """Per document: complete, valid and invalid lines and the sum of the stated totals.

    A line is complete with quantity, price and total; it is valid when their product meets the
    total within a cent. Unusable numbers count as missing.
    """
    q, u, t = (parse_decimal(F.col(c), "decimal(18,4)") for c in ("quantity", "unit_price", "total"))
    read = lines.select(*keys, q.alias("q"), u.alias("u"), t.alias("t"))
    complete = F.col("q").isNotNull() & F.col("u").isNotNull() & F.col("t").isNotNull()
    off = F.abs(F.col("q") * F.col("u") - F.col("t")) > F.lit(TOLERANCE).cast("decimal(18,4)")
    return read.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("line_count"),
        F.count_if(complete).alias("complete_rows"),
        F.count_if(complete & ~off).alias("valid_rows"),
        F.count_if(complete & off).alias("invalid_rows"),
        F.round(F.coalesce(F.sum("t"), F.lit(0)), 2).cast("decimal(20,2)").alias("calculated_subtotal"),
    )


def extraction_quality(documents: DataFrame, lines: DataFrame, *keys: str) -> DataFrame:
    """Quality of every document, those without lines included: FAIL, WARN or PASS with its checks."""
    sums = line_arithmetic(lines, *keys)
    declared = to_decimal(F.col("subtotal"), "decimal(20,2)")
    joined = documents.select(*keys, declared.alias("declared_subtotal")).join(sums, list(keys), "left")
    counts = ("line_count", "complete_rows", "valid_rows", "invalid_rows")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    calculated = F.coalesce("calculated_subtotal", F.lit(0).cast("decimal(20,2)"))
    match = F.abs(calculated - F.col("declared_subtotal")) <= F.lit(TOLERANCE).cast("decimal(20,2)")
    joined = joined.withColumns({"calculated_subtotal": calculated, "subtotal_match": match})
    failed = (F.col("line_count") == 0) | (F.col("invalid_rows") > 0) | F.coalesce(~F.col("subtotal_match"), F.lit(False))
    status = F.when(failed, "FAIL").when(F.col("complete_rows") == 0, "WARN").otherwise("PASS")
    checks = F.array_compact(
        F.array(
            F.when(F.col("line_count") == 0, "no_lines"),
            F.when(F.col("invalid_rows") > 0, "arithmetic_mismatch"),
            F.when(~F.col("subtotal_match"), "subtotal_mismatch"),
            F.when((F.col("line_count") > 0) & (F.col("complete_rows") == 0), "nothing_complete"),
        )
    )
    return joined.withColumns({"status": status, "checks": F.array_join(checks, ",")})


QUALITY = "struct<status:string,line_count:bigint,complete_rows:bigint,valid_rows:bigint,invalid_rows:bigint,calculated_subtotal:string,declared_subtotal:string,subtotal_match:boolean,checks:string>"


def quality_to_json(quality: DataFrame, *keys: str) -> DataFrame:
    """(keys, quality_json): the extraction quality as it is stored, amounts as text."""
    amounts = {c: F.col(c).cast("string") for c in ("calculated_subtotal", "declared_subtotal")}
    names = [x.split(":")[0] for x in QUALITY[len("struct<") : -1].split(",")]
    return quality.withColumns(amounts).select(*keys, F.to_json(F.struct(*names)).alias("quality_json"))


def quality_from_json(text: Column) -> Column:
    """The stored quality as a record; null for null, empty and broken text."""
    read = F.from_json(text, QUALITY)
    return F.when(read["status"].isNotNull(), read)


def _near(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(TOLERANCE).cast("decimal(20,4)")


def financial_quality(documents: DataFrame, *keys: str) -> DataFrame:
    """Three checks of a document's totals, each null where it cannot be made, and their status."""
    names = ("subtotal", "discount_total", "subtotal_after_discount", "tax_rate_percent", "tax_total", "shipping_total", "amount_due")
    s, d, n, r, t, h, a = (to_decimal(F.col(c), "decimal(16,4)") for c in names)
    discounted = _near(s - d, n)
    taxed = F.abs((n * r).cast("decimal(30,8)") - t * 100) <= F.lit("1").cast("decimal(20,4)")
    nought = F.lit(0).cast("decimal(16,4)")
    base = F.coalesce(n, s - F.coalesce(d, nought))  # only the amount due falls back on the subtotal
    due = _near((base + t + F.coalesce(h, nought)).cast("decimal(20,4)"), a)
    checks = documents.select(*keys, discounted.alias("discount_ok"), taxed.alias("tax_ok"), due.alias("due_ok"))
    seen = F.array_compact(F.array("discount_ok", "tax_ok", "due_ok"))
    status = F.when(F.size(seen) == 0, "WARN").when(F.forall(seen, lambda x: x), "PASS").otherwise("FAIL")
    return checks.withColumn("status", status)


def running_budget(rows: DataFrame, key: str, order: str, cost: Column, calls: int, total: str) -> DataFrame:
    """``rows`` with the calls made and spent up to each row, in order, and whether its own call is ``allowed``.

    A call is made where one more fits the number and its (decimal) cost the total; a refused one
    counts and costs nothing, so a cheaper later one may still be made. One running state a key:
    the rows of a key pass in order and are never held together. A null cost is zero.
    """
    scale = 7
    units = F.coalesce((cost * 10**scale).cast("bigint"), F.lit(0))
    most = int(Decimal(total).scaleb(scale))
    ready = rows.withColumn("__units", units).repartition(key).sortWithinPartitions(key, order)
    names = [f.name for f in rows.schema]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, made, spent = object(), 0, 0
        for batch in batches:
            out = []
            for name, cost_ in zip(batch[key], batch["__units"]):
                name = None if pd.isna(name) else name
                if name != now:
                    now, made, spent = name, 0, 0
                fits = made < calls and spent + cost_ <= most
                if fits:
                    made, spent = made + 1, spent + cost_
                out.append((made, spent, fits))
            yield batch[names].assign(calls=[x[0] for x in out], __spent=[x[1] for x in out], allowed=[x[2] for x in out])

    done = ready.mapInPandas(run, f"{kept}, calls bigint, __spent bigint, allowed boolean")
    return done.withColumn("spent", (F.col("__spent").cast("decimal(20,0)") / F.lit(10**scale)).cast("decimal(18,7)")).drop("__spent")
