"""Unresolved wording clustered into review work: counts, value by currency, capped evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billweave.functions.money import parse_decimal
from billweave.functions.scoring import review_priority
from billweave.runtime import materialize

VARIANTS = 25
LINE_IDS = 50


def capped_distinct(rows: DataFrame, keys: list[str], value: str, order: Column, limit: int, out: str) -> DataFrame:
    """Per key the first ``limit`` distinct values in first-seen order.

    Only those values are gathered: the rest is cut by rank before any list is built, so a hot
    key never meets in one list.
    """
    first = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("__at"))
    ranked = first.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("__at", value)))
    kept = ranked.filter(F.col("__n") <= limit).groupBy(*keys)
    listed = F.array_sort(F.collect_list(F.struct("__n", value)))
    return kept.agg(F.transform(listed, lambda x: x[value]).alias(out))


def currency_code(currency: Column) -> Column:
    """Upper case without ends; a missing one is UNSPECIFIED."""
    return F.coalesce(F.nullif(F.upper(F.trim(currency)), F.lit("")), F.lit("UNSPECIFIED"))


def currency_totals(sums: DataFrame, keys: list[str], code: str, amount: str) -> DataFrame:
    """Per key the amounts by currency as sorted JSON, their one total and its currency.

    ``sums`` has absolute amounts of (keys, code), added up or not. Nothing but zeros gives no
    currency, more than one currency with an amount gives MIXED and no total.
    """
    sums = sums.groupBy(*keys, F.col(code).alias("__code")).agg(F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(20,2)").alias("__sum"))
    entries = F.array_sort(F.collect_list(F.struct("__code", F.col("__sum").cast("string").alias("__text"))))
    worth = F.collect_list(F.when(F.col("__sum") != 0, F.struct("__code", "__sum")))
    folded = sums.groupBy(*keys).agg(F.to_json(F.map_from_entries(entries)).alias("affected_values_json"), worth.alias("__w"))
    one = F.size("__w") == 1
    return folded.withColumns(
        {
            "affected_value": F.when(one, F.get("__w", F.lit(0))["__sum"]).otherwise(F.lit(0)).cast("decimal(20,2)"),
            "currency": F.when(one, F.get("__w", F.lit(0))["__code"]).when(F.size("__w") > 1, "MIXED"),
        }
    ).drop("__w")


def pending_clusters(lines: DataFrame) -> DataFrame:
    """One row per unresolved wording of a scope.

    ``lines`` has tenant_id, partner_id, normalized, description, line_id, total, currency and
    created_at; decision_kind and requires_human_review count as null where they are not given. The
    key is a digest of scope and normalised text. All but the line ids comes from one aggregate by
    wording and currency.
    """
    given = {"decision_kind": "string", "requires_human_review": "boolean"}
    lines = lines.withColumns({c: F.lit(None).cast(t) for c, t in given.items() if c not in lines.columns})
    keys = ["candidate_key"]
    key = F.sha2(F.encode(F.concat_ws("|", F.lit("candidate"), "tenant_id", "partner_id", "normalized"), "UTF-8"), 256)
    rows = lines.filter(F.col("normalized").isNotNull()).withColumn("candidate_key", key)
    order = F.struct("created_at", "line_id")
    wordings = rows.groupBy("candidate_key", "tenant_id", "partner_id", "normalized", "description", currency_code(F.col("currency")).alias("code"))
    wordings = materialize(
        wordings.agg(
            F.count(F.lit(1)).alias("n"),
            F.min(order).alias("first"),
            F.min("created_at").alias("first_at"),
            F.max("created_at").alias("last_at"),
            F.sum(F.abs(parse_decimal(F.col("total"), "decimal(18,2)"))).alias("amount"),
            F.bool_or(F.coalesce("requires_human_review", F.lit(False))).alias("blocks"),
            F.bool_or(F.coalesce(F.col("decision_kind") == "generated_candidate", F.lit(False))).alias("assisted"),
        )
    )
    counts = wordings.groupBy("candidate_key", "tenant_id", "partner_id", "normalized").agg(
        F.sum("n").alias("occurrence_count"),
        F.min("first_at").alias("first_seen_at"),
        F.max("last_at").alias("last_seen_at"),
        F.bool_or("blocks").alias("blocks_transaction"),
        F.bool_or("assisted").alias("llm_used"),
    )
    money = currency_totals(wordings, keys, "code", "amount")
    variants = capped_distinct(wordings, keys, "description", F.col("first"), VARIANTS, "variants")
    ids = capped_distinct(rows, keys, "line_id", order, LINE_IDS, "line_ids")
    joined = counts.join(money, keys, "left").join(variants, keys, "left").join(ids, keys, "left")
    priority = review_priority(F.col("occurrence_count"), F.col("affected_value"), F.lit(0.0), F.coalesce("currency", F.lit("")))
    return joined.withColumn("priority_score", priority)


def backlog_summary(clusters: DataFrame, top: int = 10) -> DataFrame:
    """Per tenant: candidates by sort, lines behind them, their value by currency, the share of the top candidates."""
    w = Window.partitionBy("tenant_id").orderBy(F.desc("priority_score"), F.desc("occurrence_count"), "last_seen_at", "candidate_key")
    leading = clusters.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= top)
    leading = leading.groupBy("tenant_id").agg(F.sum("occurrence_count").alias("top_lines"))
    summary = clusters.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.sum("occurrence_count").alias("lines"),
        F.count_if(F.coalesce(F.col("currency") == "MIXED", F.lit(False))).alias("mixed"),
        F.count_if("blocks_transaction").alias("blocking"),
        F.count_if(~F.col("blocks_transaction")).alias("nonblocking"),
        F.count_if("llm_used").alias("assisted"),
    )
    each = clusters.select("tenant_id", F.explode(F.from_json("affected_values_json", "map<string,string>")).alias("code", "text"))
    each = each.groupBy("tenant_id", "code").agg(F.sum(F.col("text").cast("decimal(20,2)")).cast("decimal(38,2)").cast("string").alias("text"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "text"))))
    values = each.groupBy("tenant_id").agg(F.to_json(entries).alias("affected_values_json"))
    joined = summary.join(leading, "tenant_id").join(values, "tenant_id", "left")
    return joined.withColumn("top_share", F.round(F.col("top_lines") / F.col("lines"), 4))


def review_list(clusters: DataFrame, limit: int = 100, by_priority: bool = True) -> DataFrame:
    """The first candidates to look at; the limit is clamped to 1..10000, the key breaks ties."""
    n = max(1, min(10_000, limit))
    order = [F.desc("priority_score"), F.desc("occurrence_count"), "last_seen_at"] if by_priority else ["last_seen_at"]
    return clusters.orderBy(*order, "candidate_key").limit(n)
