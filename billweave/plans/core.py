"""Queries of the engine's own operators over the project's tables, each with reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.functions import attributes as A
from billweave.functions import text as T
from billweave.functions.dates import DAY_FIRST, MONTHS, due_date, parse_invoice_date
from billweave.functions.money import decimal_text, money, parse_decimal, to_decimal
from billweave.functions.scoring import generated_policy, retrieval_policy, review_priority, token_cost
from billweave.operators import evaluation as E
from billweave.operators import extraction as X
from billweave.operators import lookups as K
from billweave.operators import parties as P
from billweave.operators import quality as Q
from billweave.operators import retrieval as R
from billweave.operators import reviews as V
from billweave.operators import snapshots as S
from billweave.operators.row_quarantine import split_record
from billweave.runtime import table

QUERIES = {}
ORACLE: dict[str, str] = {}

# the normal form in SQL: compatibility characters of the data spelled out, the rest composed
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "K"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + "k"


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def norm_sql(column: str) -> str:
    """SQL of the normal form of a column."""
    plain = f"replace(replace(translate(nfc_normalize({column}), {_sql(_WIDE)}, {_sql(_NARROW)}), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    return f"trim(regexp_replace(lower({plain}), '[^a-z0-9]+', ' ', 'g'))"


def dec_sql(column: str, dtype: str = "DECIMAL(18,4)") -> str:
    """SQL of the tolerant decimal of a column."""
    k = f"regexp_replace({column}, '[^0-9,.+\\-]', '', 'g')"
    last_comma, last_dot = f"length({k}) - instr(reverse({k}), ',')", f"length({k}) - instr(reverse({k}), '.')"
    both = f"instr({k}, ',') > 0 AND instr({k}, '.') > 0"
    text = (
        f"CASE WHEN {both} AND {last_comma} > {last_dot} THEN replace(replace({k}, '.', ''), ',', '.')"
        f" WHEN {both} THEN replace({k}, ',', '')"
        f" WHEN regexp_matches({k}, '^[-+]?[0-9]{{1,3}}(,[0-9]{{3}}){{2,}}$') THEN replace({k}, ',', '')"
        f" WHEN instr({k}, ',') > 0 THEN replace({k}, ',', '.')"
        f" WHEN regexp_matches({k}, '^[-+]?[0-9]{{1,3}}([.][0-9]{{3}}){{2,}}$') THEN replace({k}, '.', '') ELSE {k} END"
    )
    return f"CASE WHEN regexp_matches({text}, '^[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN try_cast({text} AS {dtype}) END"


def query(sql: str | None = None):
    """Register a query with its reference SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


SCOPE = list(R.SCOPE)
_LINES_N = f"SELECT *, {norm_sql('description')} AS normalized FROM invoice_lines"
_ALIASES_N = f"SELECT *, {norm_sql('alias_text')} AS normalized FROM product_aliases"


def _lines(spark, d, *columns):
    return T.with_normalized(table(spark, d, "invoice_lines").select(*columns, "description"), "description")


def _aliases(spark, d):
    return T.with_normalized(table(spark, d, "product_aliases"), "alias_text", "normalized")


@query(f"""
WITH l AS ({_LINES_N}), a AS ({_ALIASES_N}),
live AS (SELECT a.tenant_id, a.partner_id, a.normalized, arg_min(a.product_id, [a.language, a.alias_id]) AS resolved
  FROM a JOIN canonical_products p USING (tenant_id, partner_id, product_id) WHERE a.approved AND p.active GROUP BY 1, 2, 3)
SELECT coalesce(resolved, '(unresolved)') AS product_id, count(*) AS lines, count(DISTINCT description) AS variants,
  CAST(coalesce(sum({dec_sql('total', 'DECIMAL(18,2)')}), 0) AS DOUBLE) AS value
FROM l LEFT JOIN live USING (tenant_id, partner_id, normalized) GROUP BY 1""")
def exact_alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Lines resolved by the exact normal form of an approved alias, per product."""
    lines = _lines(spark, d, *SCOPE, "total")
    live = R.approved_aliases(_aliases(spark, d), table(spark, d, "canonical_products"))
    found = R.exact_lookup(lines, live)
    value = F.coalesce(F.sum(parse_decimal(F.col("total"), "decimal(18,2)")), F.lit(0)).cast("double")
    return found.groupBy(F.coalesce("resolved_product_id", F.lit("(unresolved)")).alias("product_id")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("description").alias("variants"), value.alias("value")
    )


@query("""SELECT alias_id, a.product_id FROM product_aliases a WHERE approved AND NOT EXISTS (SELECT 1 FROM canonical_products p
WHERE p.active AND p.tenant_id = a.tenant_id AND p.partner_id = a.partner_id AND p.product_id = a.product_id)""")
def orphan_alias_anti(spark, d):
    """Approved aliases without an active product."""
    return R.orphan_aliases(table(spark, d, "product_aliases"), table(spark, d, "canonical_products")).select("alias_id", "product_id")


@query("""SELECT normalized_alias, count(DISTINCT tenant_id) AS tenants, count(DISTINCT product_id) AS products FROM product_aliases
WHERE approved GROUP BY 1 HAVING count(DISTINCT product_id) > 1""")
def alias_scope_collision(spark, d):
    """Wordings that name different products in different scopes."""
    a = table(spark, d, "product_aliases").filter("approved").groupBy("normalized_alias")
    a = a.agg(F.count_distinct("tenant_id").alias("tenants"), F.count_distinct("product_id").alias("products"))
    return a.filter("products > 1")


@query(f"""SELECT line_id, CAST({dec_sql('unit_price')} AS VARCHAR) AS unit_price, CAST({dec_sql('total')} AS VARCHAR) AS total
FROM invoice_lines""")
def parse_decimal_formats(spark, d):
    """Amounts in any notation as fixed-point text."""
    cols = [decimal_text(parse_decimal(F.col(c), "decimal(18,4)"), 4).alias(c) for c in ("unit_price", "total")]
    return table(spark, d, "invoice_lines").select("line_id", *cols)


_GATE = f"""
WITH l AS (SELECT tenant_id, document_id, {dec_sql('quantity')} AS q, {dec_sql('unit_price')} AS u, {dec_sql('total')} AS t FROM invoice_lines),
s AS (SELECT tenant_id, document_id, count(*) AS n, count(*) FILTER (q IS NOT NULL AND u IS NOT NULL AND t IS NOT NULL) AS c,
  count(*) FILTER (abs(q * u - t) > 0.01) AS bad, CAST(round(coalesce(sum(t), 0), 2) AS DECIMAL(20,2)) AS total FROM l GROUP BY 1, 2),
j AS (SELECT i.tenant_id, i.document_id, coalesce(n, 0) AS n, coalesce(c, 0) AS c, coalesce(bad, 0) AS bad, coalesce(total, 0) AS total,
  try_cast(trim(subtotal) AS DECIMAL(20,2)) AS declared FROM invoice_documents i LEFT JOIN s USING (tenant_id, document_id)),
m AS (SELECT *, abs(total - declared) <= 0.01 AS ok FROM j)
SELECT document_id, n AS line_count, c AS complete_rows, c - bad AS valid_rows, bad AS invalid_rows, CAST(total AS VARCHAR) AS calculated_subtotal,
  ok AS subtotal_match, CASE WHEN n = 0 OR bad > 0 OR NOT coalesce(ok, true) THEN 'FAIL' WHEN c = 0 THEN 'WARN' ELSE 'PASS' END AS status,
  concat_ws(',', CASE WHEN n = 0 THEN 'no_lines' END, CASE WHEN bad > 0 THEN 'arithmetic_mismatch' END, CASE WHEN NOT ok THEN 'subtotal_mismatch' END,
  CASE WHEN n > 0 AND c = 0 THEN 'nothing_complete' END) AS checks FROM m"""


@query(_GATE)
def line_arithmetic_gate(spark, d):
    """Extraction quality of every document, those without lines included."""
    q = Q.extraction_quality(table(spark, d, "invoice_documents"), table(spark, d, "invoice_lines"), "tenant_id", "document_id")
    names = ("line_count", "complete_rows", "valid_rows", "invalid_rows", "subtotal_match", "status", "checks")
    return q.select("document_id", F.col("calculated_subtotal").cast("string").alias("calculated_subtotal"), *names)


_FIN = ", ".join(f"try_cast(trim({c}) AS DECIMAL(16,4)) AS {a}" for c, a in zip(
    ("subtotal", "discount_total", "subtotal_after_discount", "tax_rate_percent", "tax_total", "shipping_total", "amount_due"), "sdnrtha"))


@query(f"""WITH f AS (SELECT document_id, {_FIN} FROM invoice_documents),
k AS (SELECT document_id, abs(s - d - n) <= 0.01 AS discount_ok, abs(n * r - t * 100) <= 1 AS tax_ok,
  abs(coalesce(n, s - coalesce(d, 0)) + t + coalesce(h, 0) - a) <= 0.01 AS due_ok FROM f)
SELECT *, CASE WHEN discount_ok IS NULL AND tax_ok IS NULL AND due_ok IS NULL THEN 'WARN'
  WHEN coalesce(discount_ok, true) AND coalesce(tax_ok, true) AND coalesce(due_ok, true) THEN 'PASS' ELSE 'FAIL' END AS status FROM k""")
def financial_reconciliation(spark, d):
    """Discount, tax and amount due of each document."""
    return Q.financial_quality(table(spark, d, "invoice_documents"), "document_id")


_MONTH_CASE = "CASE lower(m) " + " ".join(
    f"WHEN '{name}' THEN {n}" for name, n in MONTHS.items()
) + " ELSE try_cast(m AS INT) END"
_DMY = DAY_FIRST


@query(rf"""WITH p AS (SELECT document_id, invoice_date AS raw, payment_terms, regexp_extract(trim(invoice_date), '{_DMY}', 1) AS dd,
  regexp_extract(trim(invoice_date), '{_DMY}', 2) AS m, regexp_extract(trim(invoice_date), '{_DMY}', 3) AS y FROM invoice_documents),
q AS (SELECT document_id, payment_terms, CASE WHEN y <> '' THEN try_cast(y || '-' || lpad(CAST({_MONTH_CASE} AS VARCHAR), 2, '0') || '-' || lpad(dd, 2, '0') AS DATE)
  WHEN regexp_full_match(trim(raw), '\d{{4}}-\d{{2}}-\d{{2}}') THEN try_cast(trim(raw) AS DATE) END AS issued FROM p),
t AS (SELECT *, try_cast(regexp_extract(payment_terms, '(?i)due\s+in\s+(\d+)\s+days?', 1) AS INT) AS days FROM q)
SELECT document_id, strftime(issued, '%Y-%m-%d') AS issued, strftime(issued + days, '%Y-%m-%d') AS due FROM t""")
def parse_dates_due(spark, d):
    """Invoice dates in any notation, and the date their terms name."""
    docs = table(spark, d, "invoice_documents")
    issued = parse_invoice_date(F.col("invoice_date"))
    out = docs.select("document_id", issued.alias("i"), "payment_terms")
    due = due_date(F.col("i"), F.col("payment_terms"))
    return out.select("document_id", F.date_format("i", "yyyy-MM-dd").alias("issued"), F.date_format(due, "yyyy-MM-dd").alias("due"))


def _hit_sql(words: str, terms: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN list_contains({words}, '{t}') THEN '{v}'" for t, v in terms.items()) + " END"


_ATTR = f"""SELECT *, string_split(normalized, ' ') AS w FROM ({_LINES_N})"""


@query(f"""WITH l AS ({_ATTR}) SELECT line_id, {_hit_sql('w', A.COLORS)} AS color, {_hit_sql('w', A.MATERIALS)} AS material,
CASE WHEN instr(normalized, 't shirt') > 0 THEN 't-shirt' ELSE {_hit_sql('w', A.CATEGORIES)} END AS category_hint FROM l""")
def attribute_extract(spark, d):
    """Attributes each line states."""
    lines = _lines(spark, d, "line_id").withColumn("a", A.extract_attributes(F.col("normalized")))
    return lines.select("line_id", *[F.try_element_at("a", F.lit(k)).alias(k) for k in ("color", "material", "category_hint")])


_CAND = "json_extract_string(attributes_json, '$.{0}')"


@query(f"""WITH l AS (SELECT line_id, canonical_product_id AS product_id, w FROM ({_ATTR}) WHERE canonical_product_id IS NOT NULL),
a AS (SELECT line_id, {_hit_sql('w', A.COLORS)} AS color, {_hit_sql('w', A.MATERIALS)} AS material, {_CAND.format('color')} AS pc,
  {_CAND.format('material')} AS pm, {_CAND.format('size')} AS ps, {_CAND.format('model')} AS po FROM l JOIN canonical_products USING (product_id))
SELECT line_id, concat_ws(',', CASE WHEN color <> pc THEN 'color' END, CASE WHEN material <> pm THEN 'material' END) AS conflicts,
  concat_ws(',', CASE WHEN pc IS NOT NULL AND color IS NULL THEN 'color' END, CASE WHEN pm IS NOT NULL AND material IS NULL THEN 'material' END,
  CASE WHEN po IS NOT NULL THEN 'model' END, CASE WHEN ps IS NOT NULL THEN 'size' END) AS unsupported FROM a""")
def attribute_conflict(spark, d):
    """Protected attributes in which a line and its product differ, or that only the product states."""
    lines = _lines(spark, d, "line_id", F.col("canonical_product_id").alias("product_id")).filter("product_id is not null")
    held = table(spark, d, "canonical_products").select("product_id", F.from_json("attributes_json", "map<string,string>").alias("held"))
    both = lines.join(held, "product_id").withColumn("said", A.extract_attributes(F.col("normalized")))
    said, have = F.col("said"), F.col("held")
    return both.select(
        "line_id", F.array_join(A.conflicting_attributes(said, have), ",").alias("conflicts"),
        F.array_join(A.unsupported_attributes(said, have), ",").alias("unsupported"),
    )


_JAC = "len(list_intersect(x, y)) / CAST(len(list_distinct(x || y)) AS DOUBLE)"


@query(f"""WITH q AS (SELECT alias_id AS query_id, tenant_id, partner_id, list_distinct(string_split(normalized, ' ')) AS x FROM ({_ALIASES_N}) WHERE NOT approved),
a AS (SELECT alias_id AS item_id, tenant_id, partner_id, list_distinct(string_split(normalized, ' ')) AS y FROM ({_ALIASES_N}) WHERE approved),
s AS (SELECT query_id, item_id, round({_JAC}, 6) AS jaccard FROM q JOIN a USING (tenant_id, partner_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY jaccard DESC, item_id) AS rank,
  lead(jaccard) OVER (PARTITION BY query_id ORDER BY jaccard DESC, item_id) AS nxt FROM s WHERE jaccard >= 0.4)
SELECT query_id, item_id, jaccard, CAST(rank AS INT) AS rank, CASE WHEN rank = 1 THEN round(jaccard - coalesce(nxt, 0), 6) END AS margin FROM r WHERE rank <= 3""")
def token_jaccard_topk(spark, d):
    """The approved aliases whose words are nearest to an unapproved one's, by the exact similarity join."""
    a = _aliases(spark, d)
    left = a.filter(~F.col("approved")).select(F.col("alias_id").alias("lid"), *SCOPE, "normalized")
    right = a.filter("approved").select(F.col("alias_id").alias("rid"), *SCOPE, "normalized")
    pairs = R.token_similarity_pairs(left, right, R.SCOPE, 0.4)
    scored = pairs.select(F.col("lid").alias("query_id"), F.col("rid").alias("item_id"), F.round("jaccard", 6).alias("jaccard"))
    return R.top_k(scored, "query_id", "item_id", "jaccard", 3).select("query_id", "item_id", "jaccard", "rank", "margin")


def _grams_sql(c: str) -> str:
    return f"list_distinct(list_transform(range(1, length({c}) + 3), lambda i: substr('  ' || {c} || '  ', i, 3)))"


_HYB = f"""WITH q AS (SELECT DISTINCT sha256(concat_ws('|', tenant_id, partner_id, normalized)) AS query_id, tenant_id, partner_id, normalized AS qn FROM ({_ALIASES_N}) WHERE NOT approved),
a AS (SELECT a.alias_id, a.tenant_id, a.partner_id, a.normalized AS an, a.product_id, p.category, p.attributes_json FROM ({_ALIASES_N}) a
  JOIN canonical_products p USING (tenant_id, partner_id, product_id) WHERE a.approved AND p.active),
w AS (SELECT query_id, product_id, an, alias_id, category, qn, string_split(qn, ' ') AS w, list_distinct(string_split(qn, ' ')) AS x, list_distinct(string_split(an, ' ')) AS y,
  {_grams_sql('qn')} AS gx, {_grams_sql('an')} AS gy, {_CAND.format('color')} AS pc, {_CAND.format('material')} AS pm FROM q JOIN a USING (tenant_id, partner_id)),
e AS (SELECT *, {_JAC} AS tok, len(list_intersect(gx, gy)) / CAST(len(list_distinct(gx || gy)) AS DOUBLE) AS tri,
  coalesce({_hit_sql('w', A.COLORS)} <> pc, false) OR coalesce({_hit_sql('w', A.MATERIALS)} <> pm, false) AS conflict,
  coalesce(CASE WHEN instr(qn, 't shirt') > 0 THEN 't-shirt' ELSE {_hit_sql('w', A.CATEGORIES)} END = category, false) AS cat FROM w),
s AS (SELECT *, round(least(1.0, 0.30 * tok + 0.20 * tri + CASE WHEN conflict THEN 0 ELSE 0.10 END + CASE WHEN cat THEN 0.1 ELSE 0 END)
  * CASE WHEN conflict THEN 0.35 ELSE 1 END, 6) AS score FROM e),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, product_id ORDER BY score DESC, an, alias_id) AS n FROM s),
r AS (SELECT query_id, product_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM b WHERE n = 1)
SELECT query_id, product_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5"""


def _hybrid(spark, d, lexical: bool) -> DataFrame:
    a = _aliases(spark, d)
    live = R.approved_aliases(a, table(spark, d, "canonical_products"))
    key = F.sha2(F.encode(F.concat_ws("|", *SCOPE, "normalized"), "UTF-8"), 256)
    asked = a.filter(~F.col("approved")).select(key.alias("query_id"), *SCOPE, F.col("normalized").alias("q_normalized"))
    return R.hybrid_search(asked, live, 5, lexical)


@query(_HYB)
def hybrid_native_score(spark, d):
    """The five best products of each unapproved wording, without the sequence ratio."""
    return _hybrid(spark, d, False).select("query_id", "product_id", "score", "rank")


@query()
def hybrid_full_score(spark, d):
    """The five best products of each unapproved wording, with the sequence ratio and the policy score."""
    found = _hybrid(spark, d, True)
    policy = retrieval_policy(F.col("score"), F.coalesce("margin", F.lit(0.0)), F.col("conflict"))
    return found.select("query_id", "product_id", "matched_alias", "score", "rank", "margin", policy.alias("policy_score"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, v.vec_id, round(list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS cosine FROM q JOIN embeddings v ON v.vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, cosine, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def semantic_topk(spark, d):
    """Nearest vectors of every fiftieth vector, in blocks."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return R.cosine_top_k(v.filter("vec_id % 50 = 0"), v, 5).select("query_id", "vec_id", "cosine", "rank")


def _clusters(spark, d) -> DataFrame:
    kinds = ("generated_candidate", "abstained", "pending_review_reuse")
    lines = table(spark, d, "invoice_lines").filter(F.col("decision_kind").isin(*kinds))
    columns = ("line_id", *SCOPE, "description", "total", "currency", "created_at", "decision_kind", "requires_human_review")
    return V.pending_clusters(T.with_normalized(lines.select(*columns), "description"))


_CLUSTER = f"""l AS (SELECT *, sha256(concat_ws('|', 'candidate', tenant_id, partner_id, normalized)) AS k, coalesce(nullif(upper(trim(currency)), ''), 'UNSPECIFIED') AS cur,
  abs({dec_sql('total', 'DECIMAL(18,2)')}) AS amount FROM ({_LINES_N}) WHERE decision_kind IN ('generated_candidate', 'abstained', 'pending_review_reuse') AND description IS NOT NULL),
c AS (SELECT k, tenant_id, count(*) AS n, min(created_at) AS first_seen, max(created_at) AS last_seen, bool_or(coalesce(requires_human_review, false)) AS blocks,
  bool_or(decision_kind = 'generated_candidate') AS assisted FROM l GROUP BY 1, 2),
m AS (SELECT k, cur, CAST(coalesce(sum(amount), 0) AS DECIMAL(20,2)) AS total FROM l GROUP BY 1, 2),
f AS (SELECT k, '{{' || string_agg('"' || cur || '":"' || total || '"', ',' ORDER BY cur) || '}}' AS by_currency, count(*) FILTER (total <> 0) AS nz,
  max(total) AS one, max(cur) FILTER (total <> 0) AS onecur FROM m GROUP BY 1),
j AS (SELECT k, tenant_id, n, first_seen, last_seen, blocks, assisted, by_currency, CASE WHEN nz = 1 THEN one ELSE 0 END AS value, CASE WHEN nz = 1 THEN onecur WHEN nz > 1 THEN 'MIXED' END AS cur,
  round((1 + ln(1 + n)) * (1 + CASE WHEN nz > 1 THEN 0 ELSE ln(1 + CAST(CASE WHEN nz = 1 THEN one ELSE 0 END AS DOUBLE)) END), 6) AS priority FROM c JOIN f USING (k))"""


@query(f"""WITH {_CLUSTER},
v AS (SELECT k, description, row_number() OVER (PARTITION BY k ORDER BY min([epoch_us(created_at), line_id]), description) AS o FROM l GROUP BY 1, 2),
i AS (SELECT k, line_id, row_number() OVER (PARTITION BY k ORDER BY min(created_at), line_id) AS o FROM l GROUP BY 1, 2)
SELECT j.k AS candidate_key, n AS occurrence_count, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us, by_currency AS affected_values_json,
  CAST(value AS VARCHAR) AS affected_value, cur AS currency, priority AS priority_score,
  (SELECT string_agg(description, '~' ORDER BY o) FROM v WHERE v.k = j.k AND o <= 25) AS variants,
  (SELECT string_agg(CAST(line_id AS VARCHAR), ',' ORDER BY o) FROM i WHERE i.k = j.k AND o <= 50) AS line_ids FROM j""")
def pending_review_cluster(spark, d):
    """Unresolved wording of a scope with its value, variants and lines."""
    c = _clusters(spark, d)
    return c.select(
        "candidate_key", "occurrence_count", F.unix_micros(F.col("first_seen_at").cast("timestamp")).alias("first_us"),
        F.unix_micros(F.col("last_seen_at").cast("timestamp")).alias("last_us"), "affected_values_json",
        F.col("affected_value").cast("string").alias("affected_value"), "currency", "priority_score",
        F.array_join("variants", "~").alias("variants"), F.array_join(F.transform("line_ids", lambda x: x.cast("string")), ",").alias("line_ids"),
    )


@query(f"""WITH {_CLUSTER}, r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY priority DESC, n DESC, last_seen, k) AS o FROM j)
, s AS (SELECT tenant_id, '{{' || string_agg('"' || cur || '":"' || total || '"', ',' ORDER BY cur) || '}}' AS affected_values_json FROM (
  SELECT tenant_id, cur, sum(m.total) AS total FROM m JOIN c USING (k) GROUP BY 1, 2) GROUP BY 1)
SELECT tenant_id, count(*) AS candidates, sum(n)::BIGINT AS lines, count(*) FILTER (cur = 'MIXED') AS mixed, count(*) FILTER (blocks) AS blocking,
  count(*) FILTER (NOT blocks) AS nonblocking, count(*) FILTER (assisted) AS assisted, (sum(n) FILTER (o <= 10))::BIGINT AS top_lines,
  round((sum(n) FILTER (o <= 10)) / sum(n), 4) AS top_share, any_value(affected_values_json) AS affected_values_json FROM r JOIN s USING (tenant_id) GROUP BY 1""")
def review_backlog_summary(spark, d):
    """Backlog per tenant and the share of its top ten."""
    return V.backlog_summary(_clusters(spark, d))


@query(f"""WITH {_CLUSTER} SELECT k AS candidate_key, n AS occurrence_count, priority AS priority_score FROM j ORDER BY priority DESC, n DESC, last_seen, k LIMIT 100""")
def review_list_top(spark, d):
    """The hundred candidates to look at first."""
    return V.review_list(_clusters(spark, d), 100).select("candidate_key", "occurrence_count", "priority_score")


@query("""SELECT line_id, tenant_id, document_id, source_line_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, document_id, source_line_id
ORDER BY created_at DESC, line_id DESC) AS n FROM invoice_lines) WHERE n = 1""")
def decision_cache_keep_last(spark, d):
    """The last delivery of each line."""
    lines = table(spark, d, "invoice_lines").select("line_id", "tenant_id", "document_id", "source_line_id", "created_at")
    last = S.keep_one(lines, ["tenant_id", "document_id", "source_line_id"], F.desc("created_at"), F.desc("line_id"))
    return last.drop("created_at")


@query("""SELECT line_id, CAST(occurrence AS INT) AS occurrence, occurrence = 1 AS is_first FROM (SELECT line_id, row_number() OVER (
PARTITION BY tenant_id, document_id, source_line_id ORDER BY created_at, line_id) AS occurrence FROM invoice_lines)""")
def first_vs_repeat(spark, d):
    """Which delivery of a line each row is."""
    lines = table(spark, d, "invoice_lines").select("line_id", "tenant_id", "document_id", "source_line_id", "created_at")
    return S.occurrence_rank(lines, ["tenant_id", "document_id", "source_line_id"], "created_at", "line_id").select("line_id", "occurrence", "is_first")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, partner_id, normalized_alias, language ORDER BY created_at, alias_id) AS n FROM product_aliases WHERE NOT approved)
SELECT alias_id, approved FROM product_aliases WHERE approved UNION ALL SELECT alias_id, approved FROM k WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM product_aliases a
WHERE a.approved AND a.tenant_id = k.tenant_id AND a.partner_id = k.partner_id AND a.normalized_alias = k.normalized_alias AND a.language = k.language)""")
def insert_or_ignore_aliases(spark, d):
    """Unapproved aliases added where no approved one has their key."""
    a = table(spark, d, "product_aliases")
    keys = [*SCOPE, "normalized_alias", "language"]
    return S.insert_or_ignore(a.filter("approved"), a.filter(~F.col("approved")), keys, "created_at", "alias_id").select("alias_id", "approved")


@query("""WITH i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, partner_id, normalized_alias ORDER BY created_at DESC, alias_id) AS n
  FROM product_aliases WHERE language <> 'en') WHERE n = 1), e AS (SELECT * FROM product_aliases WHERE language = 'en')
SELECT alias_id, language FROM i UNION ALL SELECT alias_id, language FROM e WHERE NOT EXISTS (SELECT 1 FROM i
WHERE i.tenant_id = e.tenant_id AND i.partner_id = e.partner_id AND i.normalized_alias = e.normalized_alias)""")
def promote_aliases_upsert(spark, d):
    """Aliases of other languages put over those of the same wording."""
    a = table(spark, d, "product_aliases")
    keys = [*SCOPE, "normalized_alias"]
    old, new = a.filter("language = 'en'"), a.filter("language <> 'en'")
    return S.upsert(old, new, keys, F.desc("created_at"), "alias_id").select("alias_id", "language")


@query("""SELECT line_id, decision_kind FROM invoice_lines WHERE decision_kind = 'cached' UNION ALL SELECT line_id, decision_kind FROM invoice_lines l
WHERE decision_kind IS DISTINCT FROM 'cached' AND NOT EXISTS (SELECT 1 FROM invoice_lines c WHERE c.decision_kind = 'cached' AND c.tenant_id = l.tenant_id AND c.document_id = l.document_id)""")
def replace_children_snapshot(spark, d):
    """Lines of a document replaced as a whole by its second delivery."""
    lines = table(spark, d, "invoice_lines").select("line_id", "tenant_id", "document_id", "decision_kind")
    again = lines.filter("decision_kind = 'cached'")
    first = lines.filter(~F.col("decision_kind").eqNullSafe("cached"))
    return S.replace_children(first, again, ["tenant_id", "document_id"]).select("line_id", "decision_kind")


@query("""SELECT line_id FROM invoice_lines l WHERE canonical_product_id IS NOT NULL AND tenant_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM canonical_products p
WHERE p.product_id = l.canonical_product_id AND p.tenant_id = l.tenant_id)""")
def referential_integrity(spark, d):
    """Lines whose product is missing."""
    lines = table(spark, d, "invoice_lines").select("line_id", "tenant_id", F.col("canonical_product_id").alias("product_id"))
    return S.missing_parents(lines, table(spark, d, "canonical_products"), ["tenant_id", "product_id"]).select("line_id")


@query("""WITH p AS (SELECT tenant_id, document_id, string_agg(role || '=' || coalesce(name, ''), '|' ORDER BY CASE role WHEN 'seller' THEN 1 WHEN 'bill_to' THEN 2 ELSE 3 END) AS parties
FROM invoice_parties GROUP BY 1, 2), l AS (SELECT tenant_id, document_id, count(*) AS lines FROM invoice_lines GROUP BY 1, 2)
SELECT document_id, parties, coalesce(lines, 0) AS lines FROM invoice_documents LEFT JOIN p USING (tenant_id, document_id) LEFT JOIN l USING (tenant_id, document_id)""")
def document_reassembly(spark, d):
    """Documents with their parties in role order and their line counts."""
    whole = S.reassemble(table(spark, d, "invoice_documents"), table(spark, d, "invoice_parties"), table(spark, d, "invoice_lines"))
    return whole.select("document_id", F.array_join("parties", "|").alias("parties"), "lines")


@query("""SELECT sha256(coalesce(text, '')) AS text_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1""")
def document_dedup_hash(spark, d):
    """Documents of equal text by digest."""
    docs = table(spark, d, "documents").select("doc_id", T.sha256(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return docs.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


@query(r"""SELECT doc_id, md5(regexp_replace(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[REDACTED_EMAIL]', 'g')) AS redacted FROM documents""")
def pii_redaction_emails(spark, d):
    """Documents without mail addresses (digest of the text)."""
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode(T.redact_emails(F.col("text")), "UTF-8")).alias("redacted"))


@query()
def pii_redaction(spark, d):
    """Documents without mail addresses, telephone-like strings and long numbers."""
    return table(spark, d, "documents").select("doc_id", T.redact_pii(F.col("text")).alias("redacted"))


_CTRL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


@query("SELECT doc_id, concat_ws(',', " + ", ".join(
    f"CASE WHEN regexp_matches(text, {_sql(p)}) THEN 'prompt_injection_pattern_{i}' END" for i, p in enumerate(T.INJECTION, 1)
) + f", CASE WHEN regexp_matches(text, '{_CTRL}') THEN 'control_characters' END) AS flags FROM documents")
def injection_flags(spark, d):
    """Instruction-like wording and control characters in documents."""
    flags = F.array_join(T.untrusted_flags(F.col("text")), ",")
    return table(spark, d, "documents").select("doc_id", F.coalesce(flags, F.lit("")).alias("flags"))


@query(f"""SELECT line_id, concat_ws(',', CASE WHEN trim(description) = '' THEN 'empty_generated_description' END, CASE WHEN length(description) > 120 THEN
'generated_description_too_long' END, CASE WHEN regexp_matches(lower(description), 'https?://') THEN 'generated_description_contains_url' END,
CASE WHEN regexp_matches(description, '{_CTRL}') THEN 'generated_description_control_characters' END) AS flags FROM invoice_lines""")
def output_validation(spark, d):
    """Descriptions that could not be used."""
    flags = F.array_join(T.description_flags(F.col("description")), ",")
    return table(spark, d, "invoice_lines").select("line_id", F.coalesce(flags, F.lit("")).alias("flags"))


@query("""SELECT alias_id, CASE WHEN regexp_matches(ltrim(alias_text, ' '), '^[=+@-]') THEN '''' || alias_text ELSE alias_text END AS safe FROM product_aliases""")
def spreadsheet_escape(spark, d):
    """Alias texts safe in a spreadsheet."""
    return table(spark, d, "product_aliases").select("alias_id", T.spreadsheet_safe(F.col("alias_text")).alias("safe"))


@query("""SELECT party_id, regexp_replace(trim(phone, ' '), ',+$', '') AS phone, trim(regexp_replace(name, '\\s+', ' ', 'g'), ' ') AS name FROM invoice_parties""")
def party_cleaning(spark, d):
    """Phones and names without stray commas and white space."""
    p = table(spark, d, "invoice_parties")
    return p.select("party_id", T.clean_phone(F.col("phone")).alias("phone"), T.collapse_whitespace(F.col("name")).alias("name"))


@query("""SELECT doc_id, coalesce(CASE WHEN instr(text, '$') > 0 THEN 'USD' END, CASE WHEN instr(text, '€') > 0 THEN 'EUR' END, CASE WHEN instr(text, '£') > 0 THEN 'GBP' END,
CASE WHEN instr(text, '¥') > 0 THEN 'JPY' END, nullif(upper(regexp_extract(text, '(?im)^\\s*CURRENCY\\s*[:=]\\s*([A-Za-z]{3,8})\\s*$', 1)), '')) AS currency FROM documents""")
def currency_detect(spark, d):
    """Currency named in documents."""
    return table(spark, d, "documents").select("doc_id", T.detect_currency(F.col("text")).alias("currency"))


def _raw_cells(spark, d, *sections: str) -> DataFrame:
    rows = table(spark, d, "equivalent_invoice").filter(F.col("section").isin(*sections))
    # a row that is no record stays, as one cell of its raw text
    cells = F.coalesce(split_record(F.col("c1"), F.col("delimiter")), F.array("c1"))
    return rows.select("source_name", "row_no", cells.alias("cells"))


@query("""WITH r AS (SELECT source_name, row_no, lower(replace(trim(string_split(c1, delimiter)[1], ' '), ' ', '_')) AS k, nullif(trim(string_split(c1, delimiter)[2], ' '), '') AS v
FROM equivalent_invoice WHERE section = 'meta' AND c1 NOT LIKE '%"%'), m AS (SELECT source_name, k, arg_max(v, row_no) AS v FROM r WHERE v IS NOT NULL AND k <> '' GROUP BY 1, 2)
SELECT source_name, max(v) FILTER (k = 'invoice_number') AS invoice_number, max(v) FILTER (k = 'invoice_date') AS invoice_date, max(v) FILTER (k = 'currency') AS currency FROM m GROUP BY 1""")
def kv_metadata_pivot(spark, d):
    """Header entries of delivered files."""
    pairs = X.key_values(_raw_cells(spark, d, "meta"), "source_name", "row_no", "cells")
    return X.header_record(pairs, "source_name", ("invoice_number", "invoice_date", "currency"))


@query()
def delivered_file_lines(spark, d):
    """Lines of delivered files, from their ragged rows."""
    return X.rows_to_lines(_raw_cells(spark, d, "meta", "blank", "header", "line", "totals"), "source_name", "row_no", "cells")


@query()
def text_table_extract(spark, d):
    """Lines of the item tables in documents."""
    return X.text_to_lines(table(spark, d, "documents"), "doc_id", "text")


@query()
def text_header_facts(spark, d):
    """Header facts and amounts of documents."""
    return X.header_facts(table(spark, d, "documents"), "doc_id", "text")


@query("""WITH RECURSIVE c AS (SELECT line_id, document_id, CAST(ceil(length(coalesce(description, '')) / 4.0) AS DECIMAL(10,0)) * 0.0005 + 0.01 AS cost,
  row_number() OVER (PARTITION BY document_id ORDER BY line_id) AS n FROM invoice_lines),
w AS (SELECT line_id, document_id, n, CASE WHEN cost <= 0.05 THEN 1 ELSE 0 END AS calls, CASE WHEN cost <= 0.05 THEN cost ELSE 0 END AS spent, cost <= 0.05 AS allowed FROM c WHERE n = 1
  UNION ALL SELECT c.line_id, c.document_id, c.n, CASE WHEN w.calls < 3 AND w.spent + c.cost <= 0.05 THEN w.calls + 1 ELSE w.calls END,
    CASE WHEN w.calls < 3 AND w.spent + c.cost <= 0.05 THEN w.spent + c.cost ELSE w.spent END, w.calls < 3 AND w.spent + c.cost <= 0.05
  FROM w JOIN c ON c.document_id IS NOT DISTINCT FROM w.document_id AND c.n = w.n + 1)
SELECT line_id, calls, CAST(spent AS DOUBLE) AS spent, allowed FROM w""")
def budget_running(spark, d):
    """Calls made and spent in a document up to each line, against three calls and a total that dear lines exceed."""
    lines = table(spark, d, "invoice_lines").select("line_id", "document_id", "description")
    tokens = F.ceil(F.char_length(F.coalesce("description", F.lit(""))) / 4).cast("decimal(10,0)")
    cost = (tokens * F.lit("0.0005").cast("decimal(10,4)") + F.lit("0.01").cast("decimal(5,2)")).cast("decimal(18,7)")
    out = Q.running_budget(lines, "document_id", "line_id", cost, 3, "0.05")
    return out.select("line_id", "calls", F.col("spent").cast("double").alias("spent"), "allowed")


@query("""SELECT 'billweave_' || decision_kind || ' ' || count(*) AS line FROM invoice_lines WHERE decision_kind IS NOT NULL GROUP BY decision_kind""")
def metrics_exposition(spark, d):
    """Counters of decisions as text lines."""
    return E.exposition(E.counters(table(spark, d, "invoice_lines"), F.col("decision_kind")), "billweave")


@query(f"""WITH l AS ({_LINES_N}), a AS ({_ALIASES_N}), live AS (SELECT a.tenant_id, a.partner_id, a.normalized, arg_min(a.product_id, [a.language, a.alias_id]) AS resolved
  FROM a JOIN canonical_products p USING (tenant_id, partner_id, product_id) WHERE a.approved AND p.active GROUP BY 1, 2, 3),
c AS (SELECT canonical_product_id, resolved, requires_human_review, decision_kind FROM l LEFT JOIN live USING (tenant_id, partner_id, normalized) WHERE canonical_product_id IS NOT NULL)
SELECT count(*) AS cases, round(avg(coalesce(canonical_product_id = resolved, false)::INT), 6) AS canonical,
  round(avg(coalesce(decision_kind = 'exact_alias', false)::INT), 6) AS routing, round(avg(coalesce(NOT requires_human_review, false)::INT), 6) AS unattended FROM c""")
def golden_metrics(spark, d):
    """Shares of lines with a known product that the exact lookup and the recorded route agree with."""
    lines = _lines(spark, d, *SCOPE, "canonical_product_id", "requires_human_review", "decision_kind").filter("canonical_product_id is not null")
    found = R.exact_lookup(lines, R.approved_aliases(_aliases(spark, d), table(spark, d, "canonical_products")))
    return E.accuracies(
        found, canonical=F.col("canonical_product_id") == F.col("resolved_product_id"), routing=F.col("decision_kind") == "exact_alias",
        unattended=~F.col("requires_human_review"),
    )


@query("""SELECT product_id, CAST(uuid AS VARCHAR) AS alias_uuid FROM (SELECT product_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
FROM (SELECT product_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat_ws(':', tenant_id, partner_id, product_id))) AS h FROM canonical_products))""")
def name_based_ids(spark, d):
    """Name-based identifiers of catalogue rows."""
    p = table(spark, d, "canonical_products")
    return p.select("product_id", T.uuid5_url(F.concat_ws(":", *SCOPE, "product_id")).alias("alias_uuid"))


@query("""WITH e AS (SELECT product_id, unnest(json_keys(attributes_json)) AS k, attributes_json FROM canonical_products)
SELECT product_id, '{' || string_agg('"' || k || '":"' || json_extract_string(attributes_json, '$."' || k || '"') || '"', ',' ORDER BY k) || '}' AS sorted FROM e GROUP BY 1
UNION ALL SELECT product_id, '{}' FROM canonical_products WHERE len(json_keys(attributes_json)) = 0""")
def sorted_attributes(spark, d):
    """Attribute objects with their keys in order."""
    p = table(spark, d, "canonical_products")
    return p.select("product_id", T.sorted_json(F.from_json("attributes_json", "map<string,string>")).alias("sorted"))


@query("""SELECT party_id, role, CASE role WHEN 'seller' THEN 1 WHEN 'bill_to' THEN 2 ELSE 3 END AS role_order, len(from_json(address_lines_json, '["VARCHAR"]')) AS address_lines FROM invoice_parties""")
def party_roles(spark, d):
    """Parties with their role's place and the length of their address."""
    p = table(spark, d, "invoice_parties")
    order = F.when(F.col("role") == "seller", 1).when(F.col("role") == "bill_to", 2).otherwise(3)
    lines = F.size(F.from_json("address_lines_json", "array<string>"))
    return p.select("party_id", "role", order.alias("role_order"), F.when(F.col("address_lines_json").isNotNull(), lines).alias("address_lines"))


@query("""SELECT tenant_id, count(*) AS documents, count(DISTINCT partner_id) AS partners, CAST(sum(round(coalesce(try_cast(trim(amount_due) AS DECIMAL(20,4)), 0), 2)) AS VARCHAR) AS due
FROM invoice_documents GROUP BY 1""")
def tenant_totals(spark, d):
    """Documents, partners and money due per tenant."""
    docs = table(spark, d, "invoice_documents")
    due = F.sum(money(to_decimal(F.col("amount_due")))).cast("decimal(38,2)").cast("string")
    return docs.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("partner_id").alias("partners"), due.alias("due"))


@query("""SELECT line_id, round(greatest(0.0, least(0.95, 0.45 + 0.3 * 0.6 + 0.1 * least(1.0, (line_id % 10) / 100.0 / 0.25) + CASE WHEN line_id % 2 = 0 THEN 0.1 ELSE 0 END
- CASE WHEN line_id % 3 = 0 THEN 0.35 ELSE 0 END)), 6) AS policy, round((1 + ln(1 + line_id % 7)) * (1 + ln(1 + line_id)) * greatest(0.05, 1 - 0.5), 6) AS priority,
round((ceil(length(coalesce(description, '')) / 4.0) * 0.4 + 300 * 1.6) / 1000000, 6) AS cost FROM invoice_lines""")
def policy_scores(spark, d):
    """The score formulas over every line."""
    lines = table(spark, d, "invoice_lines").select("line_id", "description")
    n = F.col("line_id")
    policy = generated_policy(F.lit(0.6), (n % 10) / 100.0, n % 2 == 0, n % 3 == 0)
    priority = review_priority(n % 7, n.cast("decimal(20,2)"), F.lit(0.5), F.lit("EUR"))
    cost = token_cost(F.coalesce("description", F.lit("")), 300, 0.4, 1.6)
    return lines.select("line_id", policy.alias("policy"), priority.alias("priority"), cost.alias("cost"))


@query("""WITH r AS (SELECT source_name, row_no, lower(replace(trim(string_split(c1, delimiter)[1], ' '), ' ', '_')) AS k, nullif(trim(string_split(c1, delimiter)[2], ' '), '') AS v
FROM equivalent_invoice WHERE section = 'meta' AND c1 NOT LIKE '%"%'), m AS (SELECT source_name, k, arg_max(v, row_no) AS v FROM r WHERE v IS NOT NULL AND k <> '' GROUP BY 1, 2)
SELECT source_name, regexp_extract(k, '^(seller|bill_to|ship_to)_name$', 1) AS role, v AS name FROM m WHERE regexp_matches(k, '^(seller|bill_to|ship_to)_name$')""")
def delivered_file_parties(spark, d):
    """Parties named in the headers of delivered files."""
    pairs = X.key_values(_raw_cells(spark, d, "meta"), "source_name", "row_no", "cells")
    return P.from_key_values(pairs, "source_name").select("source_name", "role", "name")


@query("""SELECT document_id, coalesce(CASE partner_id WHEN 'partner-005' THEN 'upper' END, 'title') AS style FROM invoice_documents""")
def style_with_default(spark, d):
    """A style per document by its partner, else the default one."""
    styles = spark.createDataFrame([("partner-005", "upper"), ("default", "title")], "partner_id string, style string")
    return K.lookup(table(spark, d, "invoice_documents").select("document_id", "partner_id"), styles, "partner_id", "style").select("document_id", "style")


@query("""SELECT doc_id, CASE WHEN contains(text, 'INVOICE') THEN 'invoice' WHEN contains(text, 'reminder') THEN 'reminder' ELSE 'other' END AS kind FROM documents""")
def first_answer_contained(spark, d):
    """The first phrase of a list that a document contains."""
    kind = K.first_contained(F.col("text"), [("INVOICE", "invoice"), ("reminder", "reminder")], "other")
    return table(spark, d, "documents").select("doc_id", kind.alias("kind"))


_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_ENDS = "[\\s\u00a0\u3000]+"


@query(f"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '{_BREAK}'), lambda x: regexp_replace(regexp_replace(x, '^{_ENDS}', ''), '{_ENDS}$', '')), lambda x: x <> '') AS l FROM documents),
h AS (SELECT *, greatest(coalesce(list_min(list_filter(list_transform(l, lambda x, i: CASE WHEN regexp_matches(lower(x), 'description|purchased item|line item') THEN i END), lambda i: i IS NOT NULL)), 1) - 2, 1) AS a FROM l),
e AS (SELECT *, list_min(list_filter(list_transform(l, lambda x, i: CASE WHEN i >= a AND regexp_matches(lower(x), '^(subtotal|balance due)') THEN i END), lambda i: i IS NOT NULL)) AS z FROM h),
r AS (SELECT doc_id, text, array_to_string(l[a:least(coalesce(z + 1, len(l)), len(l))], chr(10)) AS region FROM e)
SELECT doc_id, md5(CASE WHEN region = '' THEN text ELSE region END) AS region FROM r""")
def item_regions(spark, d):
    """The part of each document around its items (digest)."""
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode(K.item_region(F.col("text")), "UTF-8")).alias("region"))


@query()
def item_regions_minimized(spark, d):
    """The part of each document around its items, without personal data."""
    return table(spark, d, "documents").select("doc_id", K.minimized_region(F.col("text"), 12_000).alias("region"))


@query()
def text_item_lines(spark, d):
    """Lines of documents: rows of item tables, else tables whose cells stand one to a text line."""
    return X.item_lines(table(spark, d, "documents"), "doc_id", "text")


def _as_cells(spark, d) -> DataFrame:
    """Sound file lines written as documents of one cell a text line, three lines of a source to a document."""
    lines = X.rows_to_lines(_raw_cells(spark, d, "header", "line", "totals"), "source_name", "row_no", "cells")
    lines = lines.filter("quantity is not null and unit_price is not null and total is not null")
    lines = lines.withColumn("description", F.regexp_replace("description", "[^A-Za-z ]", "x"))
    line = F.concat_ws("\n", "description", *[F.col(c).cast("string") for c in ("quantity", "unit_price", "total")])
    # a delivered file holds a few dozen line rows
    whole = lines.groupBy("source_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", line.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    return whole.select("source_name", F.concat(F.lit("Invoice\nDescription\nQty\nUnit price\nTotal\n"), "body", F.lit("\nSubtotal\n1\n2\n3")).alias("text"))


@query()
def text_vertical_tables(spark, d):
    """Lines of delivered files after they were written as one cell a line: each comes back."""
    found = X.item_lines(_as_cells(spark, d), "source_name", "text")
    return found.select("source_name", "description", *[F.col(c).cast("string").alias(c) for c in ("quantity", "unit_price", "total")])


def _as_layout(spark, d) -> DataFrame:
    """Parties of documents written in three columns of 40 characters."""
    parties = table(spark, d, "invoice_parties").filter("name is not null and role in ('seller', 'bill_to', 'ship_to')")
    one = F.substring(F.regexp_replace("name", "[^A-Za-z ]", "x"), 1, 38)
    wide = parties.groupBy("document_id", "tenant_id").agg(*[F.max(F.when(F.col("role") == r, one)).alias(r) for r in P.ROLES])
    cells = [F.rpad(F.coalesce(r, F.lit("")), 40, " ") for r in P.ROLES]
    head = F.concat(F.rpad(F.lit(""), 40, " "), F.rpad(F.lit("BILL TO"), 40, " "), F.lit("SHIP TO"))
    return wide.select(
        F.concat_ws("/", "tenant_id", "document_id").alias("doc"),
        F.concat(head, F.lit("\n"), F.concat(*cells), F.lit("\nDESCRIPTION QTY TOTAL\n")).alias("text"),
    )


@query("""SELECT tenant_id || '/' || document_id AS doc, role, name FROM (SELECT tenant_id, document_id, role,
  max(trim(regexp_replace(substr(regexp_replace(name, '[^A-Za-z ]', 'x', 'g'), 1, 38), ' +', ' ', 'g'))) AS name FROM invoice_parties
  WHERE role IN ('seller', 'bill_to', 'ship_to') GROUP BY 1, 2, 3) WHERE name IS NOT NULL AND name <> ''""")
def text_layout_parties(spark, d):
    """Parties of documents laid out in three columns: each name comes back under its role."""
    return P.from_layout(_as_layout(spark, d), "doc", "text").select(
        "doc", "role", F.when(F.col("contact_name").isNull(), F.col("name")).otherwise(F.col("contact_name")).alias("name")
    )


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The flagship query."""
    return exact_alias_resolution(spark, d)
