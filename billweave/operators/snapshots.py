"""Keyed table states without a transactional format: a new snapshot from the old one and a batch."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(rows: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """One row per key, the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """Existing rows stay; of the incoming ones the first of each new key is added."""
    new = keep_one(incoming, keys, *order).join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(new.select(existing.columns))


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """Incoming rows replace existing ones; ``order`` puts the row to keep first."""
    new = keep_one(incoming, keys, *order)
    return existing.join(new.select(*keys), list(keys), "left_anti").select(existing.columns).unionByName(new.select(existing.columns))


def replace_children(existing: DataFrame, incoming: DataFrame, parent: Sequence[str]) -> DataFrame:
    """All children of the parents in the batch are dropped and the batch's put in their place."""
    touched = incoming.select(*parent).distinct()
    return existing.join(touched, list(parent), "left_anti").select(existing.columns).unionByName(incoming.select(existing.columns))


def missing_parents(children: DataFrame, parents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Children whose key has no parent; a null key has none."""
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return children.filter(complete).join(parents.select(*keys), list(keys), "left_anti")


def occurrence_rank(rows: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """``rows`` with their number among equal keys and whether they are the first."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("occurrence", n).withColumn("is_first", F.col("occurrence") == 1)


def reassemble(documents: DataFrame, parties: DataFrame, lines: DataFrame) -> DataFrame:
    """Documents with their parties in role order and the number of their lines."""
    keys = ["tenant_id", "document_id"]
    role = F.when(F.col("role") == "seller", 1).when(F.col("role") == "bill_to", 2).otherwise(3)
    # a document has at most one party of each role
    by_role = F.array_sort(F.collect_list(F.struct(role.alias("o"), "role", "name")))
    people = parties.groupBy(*keys).agg(F.transform(by_role, lambda x: F.concat_ws("=", x["role"], F.coalesce(x["name"], F.lit("")))).alias("parties"))
    counted = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"))
    joined = documents.join(people, keys, "left").join(counted, keys, "left")
    return joined.withColumn("lines", F.coalesce("lines", F.lit(0)))


def upsert_documents(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], created: str = "created_at") -> DataFrame:
    """Incoming documents replace existing ones but keep the time the first one came."""
    first = existing.groupBy(*keys).agg(F.min(created).alias("__first"))
    dated = incoming.join(first, list(keys), "left").withColumn(created, F.coalesce("__first", created)).drop("__first")
    return upsert(existing, dated.select(incoming.columns), keys, F.desc(created))


def keep_last(rows: DataFrame, keys: Sequence[str], order: Column, first: str) -> DataFrame:
    """The last row of each key, under the ``first`` value that its key came with."""
    ends = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("__last"), F.min_by(first, order).alias("__first"))
    return ends.select(*[F.col("__first").alias(c) if c == first else F.col(f"__last.{c}").alias(c) for c in rows.columns])


def link_outcomes(lines: DataFrame, decisions: DataFrame, keys: Sequence[str], outcome: Sequence[str]) -> DataFrame:
    """``lines`` with the outcome columns of the decision of their key; lines without one keep nulls."""
    return lines.drop(*outcome).join(decisions.select(*keys, *outcome), list(keys), "left")


def line_outcomes(lines: DataFrame, columns: Sequence[str], order: str = "line_id") -> DataFrame:
    """Only the wanted columns of each line, with its ordinal in the document by the order it came in."""
    w = Window.partitionBy("tenant_id", "document_id").orderBy(order)
    return lines.select(*dict.fromkeys(["tenant_id", "document_id", order, *columns])).withColumn("ordinal", F.row_number().over(w))


def document_records(documents: DataFrame, parties: DataFrame, lines: DataFrame, order: str = "line_id") -> DataFrame:
    """Documents with their parties in role order and their lines in the order they came, as nested arrays."""
    keys = ["tenant_id", "document_id"]
    role = F.when(F.col("role") == "seller", 1).when(F.col("role") == "bill_to", 2).otherwise(3)
    address = F.from_json("address_lines_json", "array<string>").alias("address_lines")
    party = F.struct(role.alias("o"), "role", "name", "contact_name", address, "phone", "email", "website", "external_id")
    line = F.struct(order, "source_line_id", "partner_id", "description", "quantity", "unit_price", "total", "currency")
    # a document has at most one party of each role, and as many lines as its file held
    people = parties.groupBy(*keys).agg(F.array_sort(F.collect_list(party)).alias("parties"))
    held = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    joined = documents.join(people, keys, "left").join(held, keys, "left")
    return joined.withColumns({c: F.coalesce(c, F.array()) for c in ("parties", "lines")})


def cached(rows: DataFrame, known: DataFrame, keys: Sequence[str], value: str, order: Column) -> DataFrame:
    """``rows`` with the latest known ``value`` of their key, and whether it is ``from_cache``."""
    latest = known.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.lit(True).alias("from_cache"))
    return rows.join(latest, list(keys), "left").withColumn("from_cache", F.coalesce("from_cache", F.lit(False)))


def in_scope(rows: DataFrame, targets: DataFrame, keys: Sequence[str], out: str = "in_scope") -> DataFrame:
    """``rows`` with whether their target exists; a null key never does."""
    there = targets.select(*keys).distinct().withColumn(out, F.lit(True))
    return rows.join(there, list(keys), "left").withColumn(out, F.coalesce(out, F.lit(False)))


def tenant_rows(rows: DataFrame, tenant: str) -> DataFrame:
    """The rows of one tenant; the predicate reaches the scan."""
    return rows.filter(F.col("tenant_id") == tenant)


def tenants(rows: DataFrame) -> DataFrame:
    """The tenants of the rows, in order."""
    return rows.select("tenant_id").filter(F.col("tenant_id").isNotNull()).distinct().orderBy("tenant_id")
