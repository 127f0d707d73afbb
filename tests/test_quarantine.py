import csv
import io
import random

from billweave.operators.row_quarantine import loaded_raw_rows, rejected_lines, rejected_raw_rows

RAW = "row_id bigint, delimiter string, section string, c1 string, key string, reason string"


def judge(spark, *raws, delimiter=","):
    df = spark.createDataFrame([(i, delimiter, "line", r, "own", "own") for i, r in enumerate(raws)], RAW)
    return {r.key: r.reason for r in rejected_raw_rows(df).collect()}


def test_reasons(spark):
    got = judge(
        spark, "Sock,1,2.00,2.00", '"So, ""ck""",1,"2,50",', '"open,1,2,2', 'a"b,1,2,2', '"x"y,1,2,2', "a,1,2", "a,1,2,3,4", " ,1,2,2", ",1,2,2",
        "a" * 2001 + ",1,2,2", "a,two,x,2", "a,1,n/a,?", "a,1,2,?", '"two\nlines",1,2,2', "two\nlines,1,2,2", None, "", "a,,,", "a,1,2,2\n",
    )
    assert got == {
        2: "quoting", 3: "quoting", 4: "quoting", 5: "column_count", 6: "column_count", 7: "description", 8: "description", 9: "description",
        10: "quantity", 11: "unit_price", 12: "total", 14: "quoting", 15: "quoting", 16: "column_count", 18: "quoting",
    }


def test_other_delimiters_and_sections(spark):
    assert judge(spark, "a;1;2,5;2", "a,b;1;2;x", delimiter=";") == {1: "total"}
    assert judge(spark, "a\t1\t2\t2", "a;1;2;2", delimiter="\t") == {1: "column_count"}
    assert judge(spark, "a|1|2|2", delimiter="|") == {}
    df = spark.createDataFrame([(1, ",", "meta", "x", "", "")], RAW)
    assert rejected_raw_rows(df).count() == 0 and loaded_raw_rows(df).count() == 0


def test_against_a_csv_reader(spark):
    rng = random.Random(3)
    raws = []
    for _ in range(300):
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(["".join(rng.choice('ab ,"\n') for _ in range(rng.randrange(1, 9))) + "x", "1", "2,5", "3"])
        raws.append(out.getvalue())
    assert judge(spark, *raws) == {}
    df = spark.createDataFrame([(i, ",", "line", r, "", "") for i, r in enumerate(raws)], RAW)
    read = {r.row_id: r.description for r in loaded_raw_rows(df).collect()}
    assert read == {i: next(csv.reader(io.StringIO(r, newline="")))[0] for i, r in enumerate(raws)}


def test_very_long_fields(spark):
    assert judge(spark, '"' + 'a""' * 300_000 + '",1,2,2', "a,1,2," + "9" * 200_000 + "x") == {0: "description", 1: "total"}


def test_lines_with_repeats_and_missing(spark):
    df = spark.createDataFrame([(1, "1.00", "x"), (1, "1.00", "x"), (2, None, " "), (3, "n/a", "n/a")], "line_id bigint, unit_price string, total string")
    assert sorted(tuple(r) for r in rejected_lines(df).collect()) == [(1, "total"), (3, "unit_price")]
    assert rejected_lines(df.limit(0)).count() == 0
