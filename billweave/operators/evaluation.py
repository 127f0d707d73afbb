"""Counters, accuracies and their text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counters(rows: DataFrame, name: Column) -> DataFrame:
    """(name, value) counted over all rows; null names are left out."""
    return rows.select(name.alias("name")).filter(F.col("name").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("value"))


def exposition(counted: DataFrame, prefix: str) -> DataFrame:
    """One text line per counter, ``prefix_name value``."""
    line = F.concat(F.lit(f"{prefix}_"), "name", F.lit(" "), F.col("value").cast("string")).alias("line")
    return counted.orderBy("name").select(line)


def accuracies(rows: DataFrame, **checks: Column) -> DataFrame:
    """Share of rows for which each check holds; a null check does not hold."""
    return rows.agg(
        F.count(F.lit(1)).alias("cases"),
        *[F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6).alias(n) for n, c in checks.items()],
    )


def case_metrics(rows: DataFrame) -> DataFrame:
    """Accuracies, safety counters and cost of evaluated cases, one row.

    ``rows`` has expected and actual values of ``answer``, ``kind``, ``blocks``, ``review`` and
    ``assisted`` (as expected_x, actual_x; the last three boolean) and ``cost``. Nulls equal nulls.
    """
    both = lambda x: (F.col(f"expected_{x}"), F.col(f"actual_{x}"))
    right = {x: both(x)[0].eqNullSafe(both(x)[1]) for x in ("answer", "kind", "blocks", "review", "assisted")}
    missed = lambda x: F.count_if(F.coalesce(both(x)[0] & ~both(x)[1], F.lit(False)))
    assisted = F.coalesce(F.col("expected_assisted"), F.lit(False))
    exact = F.avg(F.when(assisted, right["answer"].cast("int")))
    return rows.agg(
        F.count(F.lit(1)).alias("cases"),
        *[F.round(F.avg(c.cast("int")), 6).alias(f"{x}_accuracy") for x, c in right.items()],
        F.count_if(assisted).alias("assisted_cases"),
        F.round(F.coalesce(exact, F.lit(1.0)), 6).alias("assisted_answer_accuracy"),
        missed("blocks").alias("missed_blocks"),
        missed("review").alias("missed_reviews"),
        F.count_if(F.coalesce(F.col("actual_assisted") & ~F.col("expected_assisted"), F.lit(False))).alias("unexpected_assists"),
        F.count_if(F.coalesce(F.col("actual_assisted") & ~F.col("actual_review"), F.lit(False))).alias("unreviewed_assists"),
        F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(20,6)").alias("cost"),
    )


def report(metrics: DataFrame) -> DataFrame:
    """The metrics as one JSON text."""
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("report"))


def rate_per_1000(n: Column) -> Column:
    """Calls per thousand repeats when only the first of n needs one."""
    return F.round(1000.0 / n, 6)
