from pyspark.sql import functions as F

from billweave.operators import extraction as X
from billweave.operators import lookups as K
from billweave.operators import parties as P


def test_key_values(spark):
    rows = [("d", "seller_name", "Acme"), ("d", "seller_address", "Street 1 | | Town"), ("d", "seller_phone", "12 34,"), ("d", "bill_to_name", " "), ("d", "invoice_number", "1"), ("e", "ship_to_email", "a@b.c")]
    got = P.from_key_values(spark.createDataFrame(rows, "doc string, key string, value string"), "doc").collect()
    assert [(r.role, r.name, r.address_lines, r.phone, r.email) for r in got] == [("seller", "Acme", ["Street 1", "Town"], "12 34", None)]


LAYOUT = """INVOICE
Acme GmbH           BILL TO             SHIP TO
Street 1            Mr Bob              Dock AG
+49 123 4567        Foo Ltd             Gate 4
acme.example        foo@bar.example
late seller         DESCRIPTION QTY TOTAL
Sock                1                   2
"""


def test_layout(spark):
    df = spark.createDataFrame([(1, LAYOUT), (2, "SHIP TO  BILL TO"), (3, None), (4, "")], "doc_id int, t string")
    got = {r.role: r for r in P.from_layout(df, "doc_id", "t").collect()}
    assert (got["seller"].name, got["seller"].phone, got["seller"].website) == ("Acme GmbH", "+49 123 4567", "acme.example")
    assert got["seller"].address_lines == ["Street 1", "late seller"]
    assert (got["bill_to"].name, got["bill_to"].contact_name, got["bill_to"].email) == ("Foo Ltd", "Mr Bob", "foo@bar.example")
    assert got["ship_to"].address_lines == ["Gate 4"] and len(got) == 3 and {r.doc_id for r in P.from_layout(df, "doc_id", "t").collect()} == {1}
    array = df.limit(1).select(P.party_of(F.array(F.struct(F.lit("bill_to").alias("role"), F.lit("x").alias("name"))), "bill_to")["name"]).first()[0]
    assert array == "x"


def test_vertical(spark):
    cells = ["Invoice", "Description", "Qty", "Unit price", "Total", "Sock", "2", "1,50", "3.00", "stray", "Red tee", "1", "5", "5", "Subtotal", "8", "9", "9"]
    df = spark.createDataFrame([(1, "\n".join(cells)), (2, "nothing"), (3, None), (4, "description\ntotal\na\n1\n2")], "doc_id int, t string")
    got = [(r.doc_id, r.description, float(r.total)) for r in X.vertical_lines(df, "doc_id", "t").orderBy("doc_id", "position").collect()]
    assert got == [(1, "Sock", 3.0), (1, "Red tee", 5.0)]


def test_lookups(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "tenant string")
    dim = spark.createDataFrame([("a", "x"), ("default", "y")], "tenant string, style string")
    assert sorted(r.style for r in K.lookup(rows, dim, "tenant", "style").collect()) == ["x", "y", "y"]
    assert [r.style for r in K.lookup(rows, dim.limit(0), "tenant", "style").collect()] == [None] * 3
    text = "intro\nkeep 1\nkeep 2\nDescription Qty Total\nmail me@x.example 1 2\n\n Subtotal 2\nthanks\nend"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    got = [r[0] for r in df.select(K.minimized_region(F.col("t"), 1000)).collect()]
    assert got == ["keep 1\nkeep 2\nDescription Qty Total\nmail [REDACTED_EMAIL] 1 2\nSubtotal 2\nthanks", None]
    assert df.select(K.first_contained(F.col("t"), [("zzz", "1"), ("keep", "2"), ("intro", "3")], "0")).first()[0] == "2"
