"""Queries and reference SQL of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.llm.addresses import building_pairs
from billweave.llm.catalogue import map_to_catalogue
from billweave.llm.encoding import encode_corpus
from billweave.llm.items import item_pairs
from billweave.llm.names import party_pairs
from billweave.llm.packing import fill_containers
from billweave.llm.splitting import split_texts
from billweave.llm.visual_form import look_alike_pairs, normalise_text
from billweave.runtime import table


def _line_and_alias_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "invoice_lines").select(
        F.concat(F.lit("L"), "line_id").alias("source_key"), F.col("description").alias("text")
    )
    aliases = table(spark, sf_dir, "product_aliases").select(
        F.concat(F.lit("A"), "alias_id").alias("source_key"), F.col("normalized_alias").alias("text")
    )
    return lines.unionByName(aliases)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of generated lines and catalogue rows of one tenant that describe the same item."""
    lines = table(spark, sf_dir, "invoice_lines").filter(F.col("decision_kind") == "generated_candidate")
    return item_pairs(lines, table(spark, sf_dir, "canonical_products"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product that each unapproved alias and each retrieved line names, or ''."""
    scope = ("tenant_id", "partner_id")
    aliases = table(spark, sf_dir, "product_aliases").filter(~F.col("approved"))
    aliases = aliases.select(F.concat(F.lit("A"), "alias_id").alias("source_key"), *scope, F.col("alias_text").alias("text"))
    lines = table(spark, sf_dir, "invoice_lines").filter(F.col("decision_kind") == "auto_retrieval")
    lines = lines.select(F.concat(F.lit("L"), "line_id").alias("source_key"), *scope, F.col("description").alias("text"))
    return map_to_catalogue(aliases.unionByName(lines), table(spark, sf_dir, "canonical_products"), "source_key", "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of lines and aliases whose texts differ but look the same."""
    return look_alike_pairs(_line_and_alias_texts(spark, sf_dir), "source_key", "text")


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line and alias with the one consistent form of its text."""
    return normalise_text(_line_and_alias_texts(spark, sf_dir), "text").select("source_key", "text_form")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ship_to rows that denote the same building."""
    parties = table(spark, sf_dir, "invoice_parties").filter(F.col("role") == "ship_to")
    return building_pairs(parties)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of bill_to rows of the same organisation, and of the same person in it."""
    return party_pairs(table(spark, sf_dir, "invoice_parties").filter(F.col("role") == "bill_to"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each document by byte_bpe_50k."""
    return encode_corpus(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document or of each piece of an oversized one."""
    return fill_containers(table(spark, sf_dir, "documents"))


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces under the limit."""
    return split_texts(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p3_found": p3_found,
    "p3_forms": p3_forms,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p9_pieces": p9_pieces,
}
ORACLE: dict[str, str] = {}
