"""The stored tables: their columns, and empty tables of them under a folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

_SCOPE = "tenant_id string, partner_id string"
#: Table -> columns.
TABLES = {
    "canonical_products": f"product_id string, {_SCOPE}, canonical_description string, category string, attributes_json string, style_version string, active boolean, created_at timestamp",
    "product_aliases": f"alias_id string, {_SCOPE}, product_id string, alias_text string, normalized_alias string, language string, approved boolean, created_at timestamp",
    "decisions": "decision_id string, tenant_id string, line_hash string, taxonomy_version string, decision_json string, created_at timestamp",
    "reviews": f"review_id string, {_SCOPE}, candidate_key string, status string, payload_json string, first_seen_at timestamp, last_seen_at timestamp",
    "audit_events": "tenant_id string, event_type string, payload_json string, created_at timestamp",
    "invoice_documents": f"document_id string, {_SCOPE}, source_name string, parser_name string, invoice_number string, invoice_date string, due_date string, payment_terms string, "
    "currency string, subtotal string, discount_total string, subtotal_after_discount string, tax_rate_percent string, tax_total string, shipping_total string, amount_due string, "
    "warnings_json string, created_at timestamp, updated_at timestamp",
    "invoice_parties": "party_id bigint, tenant_id string, document_id string, role string, name string, contact_name string, address_lines_json string, phone string, email string, website string, external_id string",
    "invoice_lines": f"line_id bigint, {_SCOPE}, document_id string, source_line_id string, description string, quantity string, unit_price string, total string, currency string, "
    "metadata_json string, decision_kind string, canonical_product_id string, requires_human_review boolean, created_at timestamp",
}


def create_tables(spark: SparkSession, root: str) -> None:
    """Write an empty table for each that is not there yet; tables are laid out by tenant."""
    for name, columns in TABLES.items():
        spark.createDataFrame([], columns).write.mode("ignore").partitionBy("tenant_id").parquet(f"{root}/{name}")
