from decimal import Decimal

from pyspark.sql import functions as F

from billweave.functions.money import NUMBER_GRAMMAR, number_text, parse_decimal
from billweave.operators.row_quarantine import loaded_lines, loaded_raw_rows
from billweave.plans.parsing import p6_found, p6_loaded
from billweave.runtime import table

LINE = "line_id bigint, description string, quantity string, unit_price string, total string"


def test_lines_load(spark):
    rows = [(1, "a", "2", "EUR 1,50", "3.00"), (2, "b", None, None, " "), (3, None, "1", "n/a", "1"), (4, "d", "-1", "2.00", "?"), (5, "e", "1", "1.00", None)]
    df = spark.createDataFrame(rows, LINE)
    got = {r.line_id: tuple(None if x is None else float(x) for x in r[2:5]) for r in loaded_lines(df).collect()}
    assert got == {1: (2, 1.5, 3), 2: (None, None, None), 5: (1, 1, None)}
    assert loaded_lines(df.limit(0)).count() == 0


def test_every_row_is_loaded_or_set_apart(spark, sf):
    loaded, found = (sorted(r.source_key for r in q(spark, sf).select("source_key").collect()) for q in (p6_loaded, p6_found))
    lines = [f"L{r.line_id}" for r in table(spark, sf, "invoice_lines").select("line_id").collect()]
    raws = [f"R{r.row_id}" for r in table(spark, sf, "equivalent_invoice").filter("section = 'line'").select("row_id").collect()]
    assert sorted(loaded + found) == sorted(lines + raws) and found


def test_numbers_are_read_by_their_grammar(spark):
    want = {
        "1.234.567.89": "1234567.89", "1,234,56": "1234.56", "1,234,5678": "1234.5678", "1,234": "1.234", "1,234,567": "1234567", "1.234,5": "1234.5",
        "-$ 1'234.50 ": "-1234.50", "+ EUR 12 ,5": "12.5", "1 234 567": "1234567", "007,10 USD": "7.10", "0": "0", "-0.5": "-0.5", "9" * 40 + ",5": "9" * 40 + ".5",
        "1;5": None, "n/a": None, "1.50-": None, "": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in want], "v string").select("v", number_text(F.col("v")).alias("n"))
    assert {r.v: r.n for r in df.collect()} == want


def test_no_valid_value_is_lost(spark):
    long = "1" + "0" * 30
    rows = [(1, "a", "1.234.567.89", "1,234,56", long), (2, "b", "some", "0000000000000000000000001.5", None), (3, "c", "123456789012345", "9" * 16, "-" + "9" * 17 + ".25")]
    df = spark.createDataFrame(rows, LINE)
    got = {r.line_id: r for r in loaded_lines(df).collect()}
    assert (got[1].quantity, got[1].unit_price, got[1].total) == (Decimal("1234567.89"), Decimal("1234.56"), None)
    assert got[1].untyped == f"total={long}"
    assert got[2].unit_price == Decimal("1.5") and got[2].untyped == "quantity=some"
    assert got[3].unit_price == Decimal("9" * 16) and got[3].untyped == "quantity=123456789012345;total=-" + "9" * 17 + ".25"
    raw = spark.createDataFrame([(1, ",", "line", "a;1.234.567.89;1,234,56;2".replace(";", "\t"))], "row_id bigint, delimiter string, section string, c1 string")
    one = loaded_raw_rows(raw.withColumn("delimiter", F.lit("\t"))).first()
    assert (one.quantity, one.unit_price, one.total, one.untyped) == (Decimal("1234567.89"), Decimal("1234.56"), Decimal(2), "")


def test_readings_agree_where_the_tolerant_parser_knows_the_form(spark, sf):
    lines = table(spark, sf, "invoice_lines")
    values = lines.select(F.explode(F.array("unit_price", "total")).alias("v")).filter(F.col("v").rlike(NUMBER_GRAMMAR)).distinct()
    both = values.select("v", parse_decimal(F.col("v")).alias("a"), number_text(F.col("v")).try_cast("decimal(20,6)").alias("b"))
    assert both.count() > 0 and both.filter(~F.col("a").eqNullSafe(F.col("b"))).collect() == []
