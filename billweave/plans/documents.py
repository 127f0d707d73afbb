"""Queries of stored documents, their lines and outcomes, each with reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from billweave.functions import text as T
from billweave.operators import evaluation as E
from billweave.operators import extraction as X
from billweave.operators import quality as Q
from billweave.operators import snapshots as S
from billweave.plans.core import _CTRL, _GATE, _raw_cells, _sql, dec_sql, norm_sql
from billweave.runtime import table

QUERIES = {}
ORACLE: dict[str, str] = {}
_KEY = ["tenant_id", "document_id", "source_line_id"]


def query(sql: str):
    """Register a query with its reference SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@query("""WITH p AS (SELECT tenant_id, document_id, string_agg(role || '=' || coalesce(name, '') || '/' || coalesce(len(from_json(address_lines_json, '["VARCHAR"]')), 0), '|'
  ORDER BY CASE role WHEN 'seller' THEN 1 WHEN 'bill_to' THEN 2 ELSE 3 END) AS parties FROM invoice_parties GROUP BY 1, 2),
l AS (SELECT tenant_id, document_id, md5(string_agg(line_id || ':' || coalesce(description, '') || ':' || coalesce(quantity, ''), '|' ORDER BY line_id)) AS lines FROM invoice_lines GROUP BY 1, 2)
SELECT document_id, coalesce(parties, '') AS parties, coalesce(lines, md5('')) AS lines FROM invoice_documents LEFT JOIN p USING (tenant_id, document_id) LEFT JOIN l USING (tenant_id, document_id)""")
def document_records(spark, d):
    """Documents with their parties and all their lines in order (lines as a digest)."""
    whole = S.document_records(*[table(spark, d, n) for n in ("invoice_documents", "invoice_parties", "invoice_lines")])
    blank = F.lit("")
    party = lambda p: F.concat(p["role"], F.lit("="), F.coalesce(p["name"], blank), F.lit("/"), F.size(F.coalesce(p["address_lines"], F.array())).cast("string"))
    line = lambda x: F.concat_ws(":", x["line_id"], F.coalesce(x["description"], blank), F.coalesce(x["quantity"], blank))
    text = F.array_join(F.transform("lines", line), "|")
    return whole.select("document_id", F.array_join(F.transform("parties", party), "|").alias("parties"), F.md5(F.encode(text, "UTF-8")).alias("lines"))


@query("""SELECT line_id, decision_kind, canonical_product_id, CAST(row_number() OVER (PARTITION BY tenant_id, document_id ORDER BY line_id) AS INT) AS ordinal FROM invoice_lines""")
def line_outcomes(spark, d):
    """The outcome of each line and its place in the document."""
    return S.line_outcomes(table(spark, d, "invoice_lines"), ["decision_kind", "canonical_product_id"]).drop("tenant_id", "document_id")


_LAST = """SELECT tenant_id, document_id, source_line_id, arg_max(decision_kind, [epoch_us(created_at), line_id]) AS decision_kind,
  arg_min(line_id, [epoch_us(created_at), line_id]) AS line_id FROM invoice_lines GROUP BY 1, 2, 3"""


@query(_LAST)
def decision_keep_last_first_id(spark, d):
    """The last decision of each line under the id it first came with."""
    lines = table(spark, d, "invoice_lines").select("line_id", *_KEY, "decision_kind", "created_at")
    order = F.struct("created_at", "line_id")
    return S.keep_last(lines, _KEY, order, "line_id").select("line_id", *_KEY, "decision_kind")


@query(f"""WITH d AS ({_LAST}) SELECT l.line_id, d.decision_kind FROM invoice_lines l LEFT JOIN d ON d.tenant_id = l.tenant_id AND d.document_id = l.document_id AND d.source_line_id = l.source_line_id""")
def outcome_link_back(spark, d):
    """Every delivery of a line with the last decision of its key."""
    lines = table(spark, d, "invoice_lines").select("line_id", *_KEY, "decision_kind", "created_at")
    last = S.keep_last(lines, _KEY, F.struct("created_at", "line_id"), "line_id")
    return S.link_outcomes(lines, last, _KEY, ["decision_kind"]).select("line_id", "decision_kind")


@query(f"""WITH l AS (SELECT *, sha256(concat_ws('|', tenant_id, partner_id, {norm_sql('description')})) AS h FROM invoice_lines WHERE description IS NOT NULL),
k AS (SELECT tenant_id, h, arg_max(canonical_product_id, [epoch_us(created_at), line_id]) AS canonical_product_id FROM l WHERE canonical_product_id IS NOT NULL GROUP BY 1, 2)
SELECT line_id, k.canonical_product_id AS product_id, k.h IS NOT NULL AS from_cache FROM l LEFT JOIN k ON k.tenant_id = l.tenant_id AND k.h = l.h WHERE l.canonical_product_id IS NULL""")
def decision_cache_lookup(spark, d):
    """Lines without a product, with the latest one decided for the same wording of their scope."""
    lines = table(spark, d, "invoice_lines").select("line_id", "tenant_id", "partner_id", "description", "canonical_product_id", "created_at")
    hashed = T.with_normalized(lines.filter("description is not null"), "description")
    hashed = hashed.withColumn("line_hash", T.sha256(F.concat_ws("|", "tenant_id", "partner_id", "normalized")))
    known = hashed.filter("canonical_product_id is not null")
    asked = hashed.filter("canonical_product_id is null").select("line_id", "tenant_id", "line_hash")
    found = S.cached(asked, known, ["tenant_id", "line_hash"], "canonical_product_id", F.struct("created_at", "line_id"))
    return found.select("line_id", F.col("canonical_product_id").alias("product_id"), "from_cache")


@query("""SELECT line_id, EXISTS (SELECT 1 FROM canonical_products p WHERE p.active AND p.tenant_id = l.tenant_id AND p.partner_id = l.partner_id
  AND p.product_id = l.canonical_product_id) AS in_scope FROM invoice_lines l WHERE canonical_product_id IS NOT NULL""")
def target_in_scope(spark, d):
    """Whether the product of each resolved line is an active one of its scope."""
    lines = table(spark, d, "invoice_lines").filter("canonical_product_id is not null")
    lines = lines.select("line_id", "tenant_id", "partner_id", F.col("canonical_product_id").alias("product_id"))
    return S.in_scope(lines, table(spark, d, "canonical_products").filter("active"), ["tenant_id", "partner_id", "product_id"]).select("line_id", "in_scope")


@query("""SELECT product_id, alias_id FROM product_aliases a WHERE product_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM canonical_products p
  WHERE p.tenant_id = a.tenant_id AND p.product_id = a.product_id AND p.active)""")
def references_to_inactive(spark, d):
    """Aliases whose product is missing or not active."""
    aliases = table(spark, d, "product_aliases").select("alias_id", "tenant_id", "product_id").filter("product_id is not null")
    return S.missing_parents(aliases, table(spark, d, "canonical_products").filter("active"), ["tenant_id", "product_id"]).select("product_id", "alias_id")


@query(f"""SELECT {norm_sql('canonical_description')} AS normalized, count(DISTINCT tenant_id) AS tenants, count(DISTINCT product_id) AS products FROM canonical_products
GROUP BY 1 HAVING count(DISTINCT product_id) > 1""")
def description_scope_collision(spark, d):
    """Descriptions that are products of their own in several scopes."""
    held = T.with_normalized(table(spark, d, "canonical_products").select("tenant_id", "product_id", "canonical_description"), "canonical_description")
    found = held.groupBy("normalized").agg(F.count_distinct("tenant_id").alias("tenants"), F.count_distinct("product_id").alias("products"))
    return found.filter("products > 1")


@query("SELECT DISTINCT tenant_id FROM invoice_lines WHERE tenant_id IS NOT NULL")
def tenant_list(spark, d):
    """The tenants of the lines."""
    return S.tenants(table(spark, d, "invoice_lines"))


@query("SELECT tenant_id, count(*) AS lines FROM invoice_lines WHERE tenant_id = (SELECT min(tenant_id) FROM partners) GROUP BY 1")
def one_tenants_lines(spark, d):
    """Lines of the first tenant: the predicate reaches the scan."""
    first = table(spark, d, "partners").agg(F.min("tenant_id")).first()[0]
    return S.tenant_rows(table(spark, d, "invoice_lines"), first).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("lines"))


_WORDS = [f"CASE WHEN regexp_matches(text, {_sql(p)}) THEN 'prompt_injection_pattern_{i}' END" for i, p in enumerate(T.INJECTION, 1)]


@query(f"""SELECT doc_id, concat_ws(',', {', '.join(_WORDS)}, CASE WHEN regexp_matches(text, '{_CTRL}') THEN 'control_characters' END,
CASE WHEN regexp_full_match(text, '[\\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*') THEN 'empty_generated_description' END, CASE WHEN length(text) > 120 THEN 'generated_description_too_long' END,
CASE WHEN regexp_matches(lower(text), 'https?://') THEN 'generated_description_contains_url' END,
CASE WHEN regexp_matches(text, '{_CTRL}') THEN 'generated_description_control_characters' END) AS flags FROM documents""")
def flag_union(spark, d):
    """Flags of both checks of a text in order, each once."""
    flags = T.union_flags(T.untrusted_flags(F.col("text")), T.description_flags(F.col("text")), T.untrusted_flags(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.array_join(flags, ",").alias("flags"))


@query("""WITH c AS (SELECT canonical_product_id AS ea, CASE WHEN line_id % 7 = 0 THEN NULL ELSE canonical_product_id END AS aa, decision_kind AS ek,
  CASE WHEN line_id % 5 = 0 THEN 'cached' ELSE decision_kind END AS ak, decision_kind IN ('abstained', 'generated_candidate') AS eb, requires_human_review AS ab,
  decision_kind IN ('auto_retrieval', 'generated_candidate') AS er, line_id % 3 = 0 AS ar, decision_kind = 'generated_candidate' AS es, line_id % 2 = 0 AS s FROM invoice_lines)
SELECT count(*) AS cases, round(avg((ea IS NOT DISTINCT FROM aa)::INT), 6) AS answer_accuracy, round(avg((ek IS NOT DISTINCT FROM ak)::INT), 6) AS kind_accuracy,
  round(avg((eb IS NOT DISTINCT FROM ab)::INT), 6) AS blocks_accuracy, round(avg((er IS NOT DISTINCT FROM ar)::INT), 6) AS review_accuracy,
  round(avg((es IS NOT DISTINCT FROM s)::INT), 6) AS assisted_accuracy, count(*) FILTER (es) AS assisted_cases,
  round(coalesce(avg((ea IS NOT DISTINCT FROM aa)::INT) FILTER (es), 1.0), 6) AS assisted_answer_accuracy, count(*) FILTER (eb AND NOT ab) AS missed_blocks,
  count(*) FILTER (er AND NOT ar) AS missed_reviews, count(*) FILTER (s AND NOT es) AS unexpected_assists, count(*) FILTER (s AND NOT ar) AS unreviewed_assists FROM c""")
def case_metrics(spark, d):
    """Accuracies and safety counters of lines taken as evaluated cases."""
    n, kind = F.col("line_id"), F.col("decision_kind")
    rows = table(spark, d, "invoice_lines").select(
        F.col("canonical_product_id").alias("expected_answer"), F.when(n % 7 != 0, F.col("canonical_product_id")).alias("actual_answer"),
        kind.alias("expected_kind"), F.when(n % 5 == 0, "cached").otherwise(kind).alias("actual_kind"),
        kind.isin("abstained", "generated_candidate").alias("expected_blocks"), F.col("requires_human_review").alias("actual_blocks"),
        kind.isin("auto_retrieval", "generated_candidate").alias("expected_review"), (n % 3 == 0).alias("actual_review"),
        (kind == "generated_candidate").alias("expected_assisted"), (n % 2 == 0).alias("actual_assisted"), F.lit(None).cast("decimal(10,6)").alias("cost"),
    )
    return E.case_metrics(rows).drop("cost")


@query(_GATE)
def quality_json_round_trip(spark, d):
    """Extraction quality written as stored JSON and read back."""
    made = Q.extraction_quality(table(spark, d, "invoice_documents"), table(spark, d, "invoice_lines"), "tenant_id", "document_id")
    read = Q.quality_to_json(made, "document_id").withColumn("q", Q.quality_from_json(F.col("quality_json")))
    names = ("line_count", "complete_rows", "valid_rows", "invalid_rows", "calculated_subtotal", "subtotal_match", "status", "checks")
    return read.select("document_id", *[f"q.{n}" for n in names])


_WHITE = "[\\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_STOP = "^(" + "|".join(X.STOP_WORDS) + ")"
_SQL_NUM = "([-+]?[0-9][0-9.,'' ]*)"
_SQL_ROW = f"^\\s*(.+?)\\s+{_SQL_NUM}\\s+{_SQL_NUM}\\s+{_SQL_NUM}\\s*$"
_CELL = lambda i, n: f"CAST({dec_sql(f'regexp_extract(r, {chr(39)}{_SQL_ROW}{chr(39)}, {i})', 'DECIMAL(20,4)')} AS VARCHAR) AS {n}"


@query(f"""WITH s AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n|\f') AS a FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(generate_series(1, len(a))) AS n, trim(regexp_replace(unnest(a), '{_WHITE}', ' ', 'g'), ' ') AS line FROM s),
h AS (SELECT *, lower(line) AS low, contains(lower(line), 'description') AND regexp_matches(lower(line), 'qty|quantity') AND contains(lower(line), 'total') AS is_h FROM l),
r AS (SELECT *, CASE WHEN is_h THEN trim(regexp_extract(line, '(?i)\\bdescription\\b.*?\\btotal\\b(.*)$', 1), ' ') ELSE line END AS r, max(is_h::INT) OVER w AS inside FROM h
  WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, max((inside = 1 AND regexp_matches(lower(r), '{_STOP}'))::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS ended FROM r)
SELECT doc_id, CAST(n AS INT) AS line_no, trim(regexp_extract(r, '{_SQL_ROW}', 1), ' ') AS description, {_CELL(2, 'quantity')}, {_CELL(3, 'unit_price')}, {_CELL(4, 'total')}
FROM e WHERE inside = 1 AND ended = 0 AND regexp_matches(r, '{_SQL_ROW}')""")
def text_table_rows(spark, d):
    """Lines of the item tables in documents, amounts as text."""
    found = X.text_to_lines(table(spark, d, "documents"), "doc_id", "text")
    return found.select("doc_id", "line_no", "description", *[F.col(c).cast("string").alias(c) for c in ("quantity", "unit_price", "total")])


@query("""WITH r AS (SELECT source_name, row_no, lower(trim(string_split(c1, delimiter)[1], ' ')) AS label, list_reverse(list_filter(list_transform(string_split(c1, delimiter)[2:], lambda x: trim(x, ' ')), lambda x: x <> '')) AS v
  FROM equivalent_invoice WHERE section = 'totals' AND c1 NOT LIKE '%"%')
SELECT source_name, CAST(arg_min(""" + dec_sql("v[1]", "DECIMAL(20,4)") + """, row_no) AS VARCHAR) AS subtotal FROM r WHERE label = 'subtotal' AND len(v) > 0 GROUP BY 1""")
def delivered_file_subtotals(spark, d):
    """The subtotal that each delivered file declares."""
    found = X.declared_subtotal_of_rows(_raw_cells(spark, d, "totals"), "source_name", "row_no", "cells")
    return found.select("source_name", F.col("subtotal").cast("string").alias("subtotal"))
