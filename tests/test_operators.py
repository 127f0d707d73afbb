import datetime as dt

from pyspark.sql import functions as F

from billweave.functions.text import normalize_ascii
from billweave.operators import evaluation as E
from billweave.operators import extraction as X
from billweave.operators import quality as Q
from billweave.operators import retrieval as R
from billweave.operators import reviews as V
from billweave.operators import snapshots as S


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_extraction_quality(spark):
    docs = spark.createDataFrame([("t", "a", "30.00"), ("t", "b", "5"), ("t", "c", None), ("t", "d", None)], "tenant_id string, document_id string, subtotal string")
    lines = spark.createDataFrame(
        [("t", "a", "2", "10", "20,00"), ("t", "a", "1", "10", "10.01"), ("t", "b", "1", "5", "6"), ("t", "c", None, "x", "3")],
        "tenant_id string, document_id string, quantity string, unit_price string, total string",
    )
    got = rows(Q.extraction_quality(docs, lines, "tenant_id", "document_id"), "document_id", "status", "checks")
    assert got == [("a", "PASS", ""), ("b", "FAIL", "arithmetic_mismatch,subtotal_mismatch"), ("c", "WARN", "nothing_complete"), ("d", "FAIL", "no_lines")]


def test_financial_quality(spark):
    names = "document_id, subtotal, discount_total, subtotal_after_discount, tax_rate_percent, tax_total, shipping_total, amount_due"
    schema = ", ".join(f"{n.strip()} string" for n in names.split(","))
    df = spark.createDataFrame(
        [("a", "280.00", "13.00", "267.00", "20", "53.40", "12.00", "332.40"), ("b", "280.00", "13.00", "267.00", "20", "53.40", "12.00", "999"),
         ("c", None, None, None, None, None, None, None), ("d", "10", None, None, None, "2", None, "12")], schema,
    )
    got = rows(Q.financial_quality(df, "document_id"), "document_id", "status")
    assert got == [("a", "PASS"), ("b", "FAIL"), ("c", "WARN"), ("d", "PASS")]


def test_running_budget(spark):
    df = spark.createDataFrame([("a", i) for i in range(4)], "k string, n int").withColumn("c", F.lit("0.1").cast("decimal(5,2)"))
    got = rows(Q.running_budget(df, "k", "n", F.col("c"), 3, "0.25"), "n", "allowed")
    assert got == [(0, True), (1, True), (2, False), (3, False)]
    dear = spark.createDataFrame([("a", 1, "0.1"), ("a", 2, "9"), ("a", 3, "0.1"), ("a", 4, None), ("a", 5, "0"), (None, 1, "0.2"), ("b", 1, "0.3")], "k string, n int, c string")
    cost = F.col("c").cast("decimal(5,2)")
    out = Q.running_budget(dear, "k", "n", cost, 3, "0.25").orderBy("k", "n").collect()
    # a refused call costs nothing, so cheaper ones after it are made
    assert [(r.k, r.n, r.calls, float(r.spent), r.allowed) for r in out] == [
        (None, 1, 1, 0.2, True), ("a", 1, 1, 0.1, True), ("a", 2, 1, 0.1, False), ("a", 3, 2, 0.2, True), ("a", 4, 3, 0.2, True), ("a", 5, 3, 0.2, False), ("b", 1, 0, 0.0, False),
    ]
    assert Q.running_budget(dear.limit(0), "k", "n", cost, 3, "0.25").count() == 0


def test_similarity_join_is_exact(spark):
    words = ["red", "blue", "sock", "crew", "tee", "big"]
    texts = [" ".join(words[j] for j in range(6) if i >> j & 1) for i in range(64)]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "id int, scope string, normalized string")
    left, right = df.withColumnRenamed("id", "lid"), df.withColumnRenamed("id", "rid")
    got = {(r.lid, r.rid) for r in R.token_similarity_pairs(left, right, ("scope",), 0.6).collect()}
    sets = [set(t.split()) for t in texts]
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if a and b and len(a & b) / len(a | b) >= 0.6}
    assert got == want


def catalogue(spark):
    products = spark.createDataFrame(
        [("t", "p", "P1", "Crew Socks", "socks", "{}", True), ("t", "p", "P2", "Black Tee", "t-shirt", '{"color": "black"}', True), ("t", "p", "P3", "Old", "x", "{}", False)],
        "tenant_id string, partner_id string, product_id string, canonical_description string, category string, attributes_json string, active boolean",
    )
    aliases = spark.createDataFrame(
        [("a1", "t", "p", "P1", "Athletic Crew Socks", "en", True), ("a2", "t", "p", "P2", "Black Tee", "en", True), ("a3", "t", "p", "P3", "Old", "en", True),
         ("a4", "t", "p", "P9", "Gone", "en", True), ("a5", "t", "p", None, "New", "en", False), ("a6", "t", "p", "P2", "athletic crew  socks", "de", True)],
        "alias_id string, tenant_id string, partner_id string, product_id string, alias_text string, language string, approved boolean",
    )
    return products, aliases.withColumn("normalized", normalize_ascii(F.col("alias_text")))


def test_lookup_and_orphans(spark):
    products, aliases = catalogue(spark)
    assert rows(R.orphan_aliases(aliases, products), "alias_id") == [("a3",), ("a4",)]
    lines = spark.createDataFrame([(1, "t", "p", "athletic crew socks"), (2, "t", "p", "old"), (3, "u", "p", "black tee"), (4, "t", "p", None)], "id int, tenant_id string, partner_id string, normalized string")
    found = R.exact_lookup(lines, R.approved_aliases(aliases, products))
    assert [tuple(r) for r in found.select("id", "resolved_product_id").orderBy("id").collect()] == [(1, "P2"), (2, None), (3, None), (4, None)]


def test_hybrid_search(spark):
    products, aliases = catalogue(spark)
    live = R.approved_aliases(aliases, products).filter("alias_id <> 'a6'")
    ask = spark.createDataFrame([("q", "t", "p", "athletic crew sock"), ("w", "t", "p", "white tee")], "query_id string, tenant_id string, partner_id string, q_normalized string")
    got = {(r.query_id, r.rank): r for r in R.hybrid_search(ask, live, 2).collect()}
    assert got["q", 1].product_id == "P1" and got["q", 1].score == 0.895711 and got["q", 2].margin is None
    assert got["w", 1].product_id == "P1" or got["w", 1].conflict  # the black tee conflicts in color
    few = R.hybrid_search(ask, live, 2, min_token=0.3)
    assert {(r.query_id, r.product_id) for r in few.collect()} == {("q", "P1"), ("w", "P2")}


def test_cosine_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(30)] + [(99, [0.0, 0.0, 0.0])], "vec_id bigint, embedding array<float>")
    q = v.filter("vec_id % 10 = 0")
    whole = rows(R.cosine_top_k(q, v, 3, block=100), "query_id", "vec_id", "rank")
    assert whole == rows(R.cosine_top_k(q, v, 3, block=1), "query_id", "vec_id", "rank") and len(whole) == 9


def test_pending_clusters(spark):
    at = dt.datetime(2024, 1, 1)
    data = [(i, "t", "p", "new thing", f"New thing {i % 30}", "1.50", "EUR" if i < 55 else "USD", at + dt.timedelta(hours=i)) for i in range(60)]
    data += [(100, "t", "p", "odd", "Odd", None, None, at), (101, "t", "p", None, None, "9", "EUR", at)]
    df = spark.createDataFrame(data, "line_id bigint, tenant_id string, partner_id string, normalized string, description string, total string, currency string, created_at timestamp_ntz")
    got = {r.normalized: r for r in V.pending_clusters(df).collect()}
    big, odd = got["new thing"], got["odd"]
    assert big.occurrence_count == 60 and big.currency == "MIXED" and big.affected_value == 0
    assert big.affected_values_json == '{"EUR":"82.50","USD":"7.50"}'
    assert big.variants == [f"New thing {i}" for i in range(25)] and big.line_ids == list(range(50))
    assert odd.currency is None and odd.affected_values_json == '{"UNSPECIFIED":"0.00"}' and len(got) == 2
    summary = V.backlog_summary(V.pending_clusters(df)).first()
    assert (summary.candidates, summary.lines, summary.top_share) == (2, 61, 1.0)
    assert V.review_list(V.pending_clusters(df), 0).count() == 1
    assert V.pending_clusters(df.limit(0)).count() == 0


def test_snapshots(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, at int")
    assert rows(S.upsert(old, new, ["k"], F.desc("at")), "k", "v") == [(1, "a"), (2, "d"), (3, "e")]
    assert rows(S.insert_or_ignore(old, new, ["k"], "at"), "k", "v") == [(1, "a"), (2, "b"), (3, "e")]
    assert rows(S.replace_children(old, new, ["k"]), "k", "v") == [(1, "a"), (2, "c"), (2, "d"), (3, "e")]
    assert rows(S.missing_parents(new, old, ["k"]), "k") == [(3,)]
    assert rows(S.upsert(old, new.limit(0), ["k"], "at"), "k") == [(1,), (2,)]
    assert rows(S.occurrence_rank(new, ["k"], "at"), "k", "v", "is_first") == [(2, "c", True), (2, "d", False), (3, "e", True)]


def test_rows_to_lines(spark):
    cells = [
        ["INVOICE NUMBER", "X1"], ["", ""], ["Description", "QTY", "UNIT PRICE", "TOTAL"], ["Sock", "2", "1,50", "3.00"], ["Bad", "x", "1", "1"],
        ["", "1", "1", "1"], ["Tee", "", "", "5"], ["Short"], ["Shipping box", "1", "2", "2"], ["Late", "1", "1", "1"],
    ]
    df = spark.createDataFrame([("d", i, c) for i, c in enumerate(cells, 1)], "doc string, n int, c array<string>")
    got = [(r.n, r.description, r.quantity and float(r.quantity)) for r in X.rows_to_lines(df, "doc", "n", "c").orderBy("n").collect()]
    assert got == [(4, "Sock", 2.0), (7, "Tee", None)]
    pairs = X.key_values(df.filter("n <= 2"), "doc", "n", "c")
    assert rows(X.header_record(pairs, "doc", ("invoice_number",)), "invoice_number") == [("X1",)]


def test_text_tables_and_headers(spark):
    text = "INVOICE NUMBER: 12345678\nInvoice Date: 3. Mai 2024\nDue in 10 days\nDESCRIPTION QTY TOTAL Sock 1 2.00 2.00\nRed  tee 2 3,00 6.00\n\nSUBTOTAL: 8.00 EUR\nTotal tax: $ 1.60\nTAX RATE 20%\nBALANCE DUE 9.60\nGhost 1 1 1"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    got = [(r.line_no, r.description, float(r.total)) for r in X.text_to_lines(df, "doc_id", "text").orderBy("line_no").collect()]
    assert got == [(4, "Sock", 2.0), (5, "Red tee", 6.0)]
    head = {r.doc_id: r for r in X.header_facts(df, "doc_id", "text").collect()}
    one = head[1]
    # a text with labels is read by its labels alone
    assert (one.invoice_number, str(one.invoice_date), one.payment_terms, one.due_date, one.currency) == ("12345678", "2024-05-03", None, None, "USD")
    assert [float(x) for x in (one.subtotal, one.tax_total, one.tax_rate_percent, one.amount_due)] == [8.0, 1.6, 20.0, 9.6]
    assert head[2].invoice_number is None and head[3].subtotal is None
    assert float(df.select(X.declared_subtotal(F.col("text"))).first()[0]) == 8.0
    plain = spark.createDataFrame([(1, "Invoice\n3. Mai 2024\n12345678\nDue in 10 days\n subtotal less discount 3\nSubtotal x\nSubtotal 5 of 6,50")], "doc_id int, text string")
    two = X.header_facts(plain, "doc_id", "text").first()
    assert (two.invoice_number, str(two.invoice_date), str(two.due_date), two.labelled) == ("12345678", "2024-05-03", "2024-05-13", False)
    assert float(plain.select(X.declared_subtotal(F.col("text"))).first()[0]) == 6.5
    cells = spark.createDataFrame([("d", 1, ["Subtotal", "", "x"]), ("d", 2, ["SUBTOTAL ", "4", "5.5", ""]), ("d", 3, ["subtotal", "9"]), ("e", 1, ["subtotal less", "1"])], "doc string, n int, c array<string>")
    assert [(r[0], float(r[1])) for r in X.declared_subtotal_of_rows(cells, "doc", "n", "c").collect()] == [("d", 5.5)]
    labels = spark.createDataFrame([(1, "SELLER NAME: Acme\nBILL TO NAME = Foo\nBILL TO PHONE: 1")], "doc_id int, text string")
    assert rows(X.labelled_entries(labels, "doc_id", "text"), "key", "value") == [("bill_to_name", "Foo"), ("bill_to_phone", "1"), ("seller_name", "Acme")]


def test_evaluation(spark):
    df = spark.createDataFrame([("a", True), ("a", None), (None, False)], "k string, ok boolean")
    assert rows(E.exposition(E.counters(df, F.col("k")), "m"), "line") == [("m_a 2",)]
    assert E.accuracies(df, ok=F.col("ok")).first() == (3, 0.333333)
    assert spark.range(1).select(E.rate_per_1000(F.lit(10000))).first()[0] == 0.1


def test_documents_and_outcomes(spark):
    old = spark.createDataFrame([("t", "d", 1, "a"), ("t", "e", 1, "b")], "tenant_id string, document_id string, created_at int, v string")
    new = spark.createDataFrame([("t", "d", 5, "c"), ("t", "f", 6, "d")], "tenant_id string, document_id string, created_at int, v string")
    got = rows(S.upsert_documents(old, new, ["tenant_id", "document_id"]), "document_id", "created_at", "v")
    assert got == [("d", 1, "c"), ("e", 1, "b"), ("f", 6, "d")]
    seen = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), (None, 3, "z")], "k string, at int, v string")
    assert sorted(map(tuple, S.keep_last(seen, ["k"], F.col("at"), "at").collect()), key=str) == [("k", 1, "y"), (None, 3, "z")]
    linked = S.link_outcomes(seen, spark.createDataFrame([("k", "new")], "k string, v string"), ["k"], ["v"])
    assert rows(linked.filter("k is not null"), "at", "v") == [(1, "new"), (2, "new")] and linked.count() == 3
    asked = spark.createDataFrame([("k",), ("q",), (None,)], "k string")
    assert {r.k: (r.v, r.from_cache) for r in S.cached(asked, seen, ["k"], "v", F.col("at")).collect()} == {"k": ("y", True), "q": (None, False), None: (None, False)}
    assert {r.k: r.in_scope for r in S.in_scope(asked, seen, ["k"]).collect()} == {"k": True, "q": False, None: False}
    assert [r.tenant_id for r in S.tenants(old).collect()] == ["t"] and S.tenant_rows(old, "u").count() == 0


def test_flags_proposals_and_cases(spark):
    from billweave.functions import text as T
    from billweave.operators import lookups as K

    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), (None, ["c"]), (None, None)], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(T.union_flags(F.col("x"), F.col("y"))).collect()] == [["a", "b", "c"], ["c"], []]
    given = spark.createDataFrame([("White  TEE", "p1"), ("default", "p0")], "source string, proposal string")
    lines = spark.createDataFrame([("white tee",), ("sock",), (None,)], "normalized string")
    assert {r.normalized: r.proposal for r in K.proposals(lines, given).collect()} == {"white tee": "p1", "sock": "p0", None: "p0"}
    schema = ", ".join(f"{s}_{x} {t}" for s in ("expected", "actual") for x, t in (("answer", "string"), ("kind", "string"), ("blocks", "boolean"), ("review", "boolean"), ("assisted", "boolean")))
    cases = [("a", "k", True, True, True, "a", "k", False, False, True, "0.5"), (None, "k", False, True, False, None, "j", False, True, True, None)]
    got = E.case_metrics(spark.createDataFrame(cases, schema + ", cost string")).first()
    assert (got.cases, got.answer_accuracy, got.kind_accuracy, got.assisted_cases, got.assisted_answer_accuracy) == (2, 1.0, 0.5, 1, 1.0)
    assert (got.missed_blocks, got.missed_reviews, got.unexpected_assists, got.unreviewed_assists, str(got.cost)) == (1, 1, 1, 1, "0.500000")
    assert E.report(E.case_metrics(spark.createDataFrame(cases, schema + ", cost string"))).first()[0].startswith('{"cases":2,')
