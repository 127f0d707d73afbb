"""Catalogue seeds, review queues and archives as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from billweave.functions.text import sha256, spreadsheet_safe, uuid5_url, with_normalized

SEED = (
    "products array<struct<product_id:string,tenant_id:string,partner_id:string,canonical_description:string,category:string,"
    "attributes:map<string,string>,style_version:string,aliases:array<string>>>"
)
# The columns of a review queue file, and those a reviewer edits.
QUEUE_COLUMNS = (
    "review_id", "tenant_id", "partner_id", "candidate_key", "occurrence_count", "affected_value", "affected_values_json",
    "currency", "first_seen_at", "last_seen_at", "source_description", "source_variants_json", "source_line_ids_json",
    "proposed_description", "proposed_category", "proposed_attributes_json", "target_product_id", "decision_score",
    "retrieval_score", "retrieval_margin", "priority_score", "llm_used", "provider", "model", "prompt_version",
    "risk_flags_json", "evidence_json", "blocks_transaction", "approved_description_override", "target_product_id_override",
    "category_override", "reviewer_notes", "status",
)
EDITABLE = ("approved_description_override", "target_product_id_override", "category_override", "reviewer_notes", "status")


def seed_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(products, aliases) of a seed file; an alias is a text or an object of text and language.

    Of aliases with the same normalised text in a scope the first listed is kept.
    """
    rows = spark.read.schema(SEED).option("multiLine", True).json(path).select(F.explode("products").alias("p"))
    products = rows.select("p.product_id", "p.tenant_id", "p.partner_id", "p.canonical_description", "p.category", "p.attributes", "p.style_version")
    products = products.withColumn("active", F.lit(True)).dropDuplicates(["product_id"])
    each = rows.select(F.monotonically_increasing_id().alias("r"), "p.product_id", "p.tenant_id", "p.partner_id", F.posexplode("p.aliases").alias("n", "a"))
    as_object = F.from_json("a", "struct<text:string,language:string>")
    text = F.coalesce(F.when(F.col("a").startswith("{"), as_object["text"]), F.col("a"))
    language = F.coalesce(F.when(F.col("a").startswith("{"), as_object["language"]), F.lit("en"))
    listed = with_normalized(each.withColumns({"alias_text": text, "language": language}), "alias_text", "normalized_alias")
    w = Window.partitionBy("tenant_id", "partner_id", "normalized_alias", "language").orderBy("r", "n")
    kept = listed.withColumn("k", F.row_number().over(w)).filter("k = 1")
    name = F.concat_ws(":", "tenant_id", "partner_id", "normalized_alias", "language")
    aliases = kept.select(uuid5_url(name).alias("alias_id"), "tenant_id", "partner_id", "product_id", "alias_text", "normalized_alias", "language")
    return products, aliases.withColumn("approved", F.lit(True))


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """A review queue file, all columns text; another header is an error."""
    schema = ", ".join(f"{c} string" for c in QUEUE_COLUMNS)
    options = {"header": True, "enforceSchema": False, "multiLine": True, "escape": '"'}
    return spark.read.schema(schema).options(**options).csv(path)


def export_queue(pending: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Pending reviews as queue rows: formulas disarmed, a reviewer's cells of the previous file kept."""
    rows = pending.select(*[F.col(c).cast("string").alias(c) if c in pending.columns else F.lit("").alias(c) for c in QUEUE_COLUMNS])
    rows = rows.withColumn("status", F.when(F.col("status") == "", "waiting").otherwise(F.col("status")))
    if previous is not None:
        kept = previous.select("review_id", *[F.col(c).alias(f"__{c}") for c in EDITABLE])
        rows = rows.join(kept, "review_id", "left")
        rows = rows.withColumns({c: F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")), c) for c in EDITABLE})
    return rows.select(*[spreadsheet_safe(F.col(c)).alias(c) for c in QUEUE_COLUMNS])


def write_queue(rows: DataFrame, path: str) -> None:
    """Queue rows as one delimited file with a header and a byte order mark, as spreadsheets expect it."""
    marked = rows.select(*[F.col(c).alias("\ufeff" + c if i == 0 else c) for i, c in enumerate(QUEUE_COLUMNS)])
    marked.coalesce(1).write.mode("overwrite").options(header=True, escape='"').csv(path)  # a file for a reviewer's hands


def append_archive(rows: DataFrame, path: str, outcome: str) -> None:
    """Processed rows as one JSON object a line, appended."""
    stamped = rows.withColumns({"outcome": F.lit(outcome), "archived_at": F.current_timestamp()})
    stamped.write.mode("append").json(path)


def append_audit(events: DataFrame, path: str) -> None:
    """Audit events (tenant_id, event_type, payload columns) appended, the payload as sorted JSON, a folder a tenant."""
    payload = sorted(c for c in events.columns if c not in ("tenant_id", "event_type"))
    rows = events.select("tenant_id", "event_type", F.to_json(F.struct(*payload)).alias("payload_json"), F.current_timestamp().alias("created_at"))
    rows.write.mode("append").partitionBy("tenant_id").parquet(path)


def rewrite_queue(pending: DataFrame, edited: DataFrame, errors: DataFrame) -> DataFrame:
    """Queue rows of what is still pending, with a reviewer's cells kept and errors noted beside them.

    ``edited`` has the rows of the file, ``errors`` (review_id, error); the status starts anew.
    """
    kept = [c for c in EDITABLE if c != "status"]
    notes = errors.groupBy("review_id").agg(F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("__error"))
    rows = export_queue(pending.withColumn("status", F.lit("")))
    rows = rows.drop(*kept).join(edited.groupBy("review_id").agg(*[F.max(c).alias(c) for c in kept]), "review_id", "left")
    rows = rows.join(notes, "review_id", "left")
    said = F.concat(F.lit("PROCESSING_ERROR: "), "__error")
    notes_ = F.concat_ws(" | ", F.nullif(F.trim(F.coalesce("reviewer_notes", F.lit(""))), F.lit("")), said)
    return rows.withColumns({**{c: F.coalesce(c, F.lit("")) for c in kept}, "reviewer_notes": notes_}).select(*QUEUE_COLUMNS)


def client_styles(spark: SparkSession, path: str) -> DataFrame:
    """(tenant_id, case, maximum_words, flags) of a style file, the fallback under ``default``."""
    entry = "map<string,string>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("tenant_id", "s"))
    flags = F.map_filter("s", lambda k, v: ~k.isin("case", "maximum_words"))
    return rows.select("tenant_id", F.col("s")["case"].alias("case"), F.col("s")["maximum_words"].cast("int").alias("maximum_words"), flags.alias("flags"))


# The columns of a golden case.
CASES = "tenant_id string, partner_id string, description string, expected string, expected_decision_kind string, expected_transaction_review boolean, expected_knowledge_review boolean, expected_llm boolean"


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases, one JSON object a line."""
    return spark.read.schema(CASES).json(path)


def prompt_templates(spark: SparkSession, root: str, *names: str) -> DataFrame:
    """(name, version, header, body, placeholders) of template files under a folder; a name may not leave it.

    The header ends at the first line of three hyphens; the version is the start of the digest.
    """
    for name in names:
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"{name} is outside {root}")
    texts = spark.read.text([f"{root}/{n}" for n in names], wholetext=True).select(F.input_file_name().alias("path"), "value")
    name = F.regexp_extract("path", "([^/]+)$", 1)
    parts = "(?sm)\\A(.*?)^---[ \\t]*$\\r?\\n?(.*)\\z"
    split, body = (F.regexp_extract("value", parts, i) for i in (1, 2))
    has = F.col("value").rlike("(?m)^---[ \\t]*$")
    body = F.when(has, body).otherwise(F.col("value"))
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit("\\{(\\w+)\\}"), F.lit(1))))
    return texts.select(
        name.alias("name"), F.substring(sha256(F.col("value")), 1, 12).alias("version"), F.when(has, split).otherwise(F.lit("")).alias("header"),
        body.alias("body"), found.alias("placeholders"),
    )
