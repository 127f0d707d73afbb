import json
import zipfile

from billweave.sources import files as S
from billweave.sources import tables as B
from billweave.streaming import occurrences as O


def test_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_bytes('﻿INVOICE NUMBER;X;Y\n"a;b";1;2\n'.encode())
    (src / "b.txt").write_text("one\ttwo\tthree\n1\t2\t3\n")
    (src / "bad.xlsx").write_bytes(b"PK\x03\x04oops")
    (src / "c.pdf").write_bytes(b"nope")
    (src / "d.exe").write_bytes(b"x")
    (src / "e.json").write_bytes(b"")
    with zipfile.ZipFile(src / "s.xlsx", "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Sock</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(src / "t.docx", "w") as z:
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Tee</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    found = S.files(spark, str(src))
    refused = {r.path.rsplit("/", 1)[-1]: r.refused for r in S.admitted(found).collect()}
    assert refused == {"a.csv": None, "b.txt": None, "bad.xlsx": None, "c.pdf": "content", "d.exe": "format", "s.xlsx": None, "t.docx": None}
    got = {(r.path.rsplit("/", 1)[-1], r.row_no): r for r in S.ragged_rows(found).collect()}
    assert got["a.csv", 2].cells == ["a;b", "1", "2"] and got["b.txt", 1].cells == ["one", "two", "three"]
    assert got["s.xlsx", 1].cells == ["Sock", "", "2.5"] and got["t.docx", 1].cells == ["Tee", "1"]
    assert got["bad.xlsx", 1].error == "BadZipFile" and got["bad.xlsx", 1].cells is None
    text = S.plain_text(found, {".pdf": lambda raw: raw.decode()})
    texts = {r.path.rsplit("/", 1)[-1]: r for r in text.collect()}
    assert set(texts) == {"a.csv", "b.txt", "c.pdf", "s.xlsx", "t.docx", "bad.xlsx"}
    assert texts["s.xlsx"].text == "Sock\n2.5" and texts["t.docx"].text == "Tee\n1" and texts["bad.xlsx"].error == "BadZipFile"
    scanned = S.plain_text(found, {".pdf": lambda raw: raw.decode(), "ocr": lambda raw: "read from the picture"})
    assert {r.text for r in scanned.collect() if r.path.endswith("pdf")} == {"read from the picture"}


def test_json_invoices(spark, tmp_path):
    nested = {"invoice": {"invoice_number": "N1", "subtotal": "9", "financials": {"subtotal": "", "currency": "EUR"}, "parties": [{"role": "seller", "name": "S"}, {"role": "x", "name": "Y"}, {"role": "bill_to", "name": " "}]}, "lines": [{"description": "a", "quantity": 1, "unit_price": "2", "total": "2"}]}
    (tmp_path / "n.json").write_text(json.dumps(nested, indent=1))
    (tmp_path / "f.json").write_text(json.dumps({"invoice_number": "F1", "subtotal": "5", "lines": []}))
    (tmp_path / "b.json").write_text(json.dumps({"invoice_number": "B1", "lines": [{"description": " ", "total": "1"}, {"description": "x"}]}))
    (tmp_path / "x.json").write_text("no json")
    invoices = S.json_invoices(S.files(spark, str(tmp_path)))
    got = {r.invoice_number: r for r in invoices.collect()}
    assert got["N1"].subtotal == "9" and got["N1"].currency == "EUR" and [p.name for p in got["N1"].parties] == ["S"] and got["F1"].subtotal == "5"
    assert {r.invoice_number: r.refused for r in invoices.collect()} == {"N1": None, "F1": "no_lines", "B1": "description", None: "no_lines"}
    assert [(r.source_line_id, r.quantity) for r in S.json_lines(invoices).collect()] == [("json-1", "1")]


def test_seed_and_queue(spark, tmp_path):
    seed = {"products": [{"product_id": "P", "tenant_id": "t", "partner_id": "p", "canonical_description": "Tee", "category": "x", "attributes": {"color": "red"}, "aliases": ["White Tee", "white  tee", {"text": "Weißes Tee", "language": "de"}]}]}
    (tmp_path / "seed.json").write_text(json.dumps(seed))
    products, aliases = B.seed_catalogue(spark, str(tmp_path / "seed.json"))
    assert products.first().attributes == {"color": "red"}
    assert sorted((r.alias_text, r.language) for r in aliases.collect()) == [("Weißes Tee", "de"), ("White Tee", "en")]
    pending = spark.createDataFrame([("r1", "=1+1"), ("r2", "ok")], "review_id string, source_description string")
    first = B.export_queue(pending)
    B.write_queue(first, str(tmp_path / "q"))
    back = B.read_queue(spark, str(tmp_path / "q"))
    assert back.columns == list(B.QUEUE_COLUMNS)
    assert {r.review_id: (r.source_description, r.status) for r in back.collect()} == {"r1": ("'=1+1", "waiting"), "r2": ("ok", "waiting")}
    from pyspark.sql import functions as F

    edited = back.withColumn("reviewer_notes", F.when(F.col("review_id") == "r1", "seen"))
    assert {r.review_id: r.reviewer_notes for r in B.export_queue(pending, edited).collect()}["r1"] == "seen"
    B.append_archive(edited, str(tmp_path / "arch"), "done")
    B.append_archive(edited, str(tmp_path / "arch"), "done")
    assert spark.read.json(str(tmp_path / "arch")).count() == 4


def test_stream_equals_batch(spark, sf, tmp_path):
    lines = spark.read.parquet(f"{sf}/invoice_lines.parquet").select("tenant_id", "partner_id", "description", "created_at")
    lines.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    O.start(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = O.latest(spark.read.parquet(str(tmp_path / "out")))
    want = O.running_occurrences(lines)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_queue_rewrite_and_archive(spark, tmp_path):
    pending = spark.createDataFrame([("r1", "a"), ("r2", "b")], "review_id string, source_description string")
    B.write_queue(B.export_queue(pending), str(tmp_path / "q"))
    written = next((tmp_path / "q").glob("*.csv")).read_bytes()
    assert written.startswith("\ufeffreview_id,".encode())
    edited = B.read_queue(spark, str(tmp_path / "q"))
    from pyspark.sql import functions as F

    edited = edited.withColumns({"reviewer_notes": F.lit("seen"), "status": F.lit("approve")})
    errors = spark.createDataFrame([("r2", "no target"), ("r2", "no target"), ("r9", "x")], "review_id string, error string")
    got = {r.review_id: (r.reviewer_notes, r.status) for r in B.rewrite_queue(pending, edited, errors).collect()}
    assert got == {"r1": ("seen", "waiting"), "r2": ("seen | PROCESSING_ERROR: no target", "waiting")}
    events = spark.createDataFrame([("t", "made", 2, 1)], "tenant_id string, event_type string, b int, a int")
    B.append_audit(events, str(tmp_path / "audit"))
    B.append_audit(events, str(tmp_path / "audit"))
    read = spark.read.parquet(str(tmp_path / "audit"))
    assert read.count() == 2 and read.first().payload_json == '{"a":1,"b":2}'


def test_small_sources(spark, tmp_path):
    (tmp_path / "styles.json").write_text(json.dumps({"default": {"case": "title", "maximum_words": 8, "keep": True}, "t": {"case": "upper"}}))
    got = {r.tenant_id: r for r in B.client_styles(spark, str(tmp_path / "styles.json")).collect()}
    assert (got["default"].case, got["default"].maximum_words, got["default"].flags) == ("title", 8, {"keep": "true"}) and got["t"].flags == {}
    (tmp_path / "cases.jsonl").write_text('{"tenant_id": "t", "description": "x", "expected_llm": true}\n')
    case = B.evaluation_cases(spark, str(tmp_path / "cases.jsonl")).first()
    assert case.expected_llm is True and case.expected is None
    (tmp_path / "p.md").write_text("model: x\n---\nSay {b} and {a} and {b}.\n")
    (tmp_path / "q.md").write_text("no header {x}")
    prompts = {r.name: r for r in B.prompt_templates(spark, str(tmp_path), "p.md", "q.md").collect()}
    assert prompts["p.md"].header == "model: x\n" and prompts["p.md"].placeholders == ["a", "b"] and len(prompts["p.md"].version) == 12
    assert prompts["q.md"].header == "" and prompts["q.md"].body == "no header {x}"
    import pytest

    with pytest.raises(ValueError):
        B.prompt_templates(spark, str(tmp_path), "../p.md")


def test_schemas_and_settings(spark, tmp_path):
    from billweave.settings import Settings, dotted
    from billweave.sources.schemas import TABLES, create_tables

    create_tables(spark, str(tmp_path / "db"))
    create_tables(spark, str(tmp_path / "db"))
    for name, columns in TABLES.items():
        assert spark.read.schema(columns).parquet(str(tmp_path / "db" / name)).count() == 0
    (tmp_path / "s.json").write_text('{"a": {"b": 3, "on": true, "name": "x"}}')
    s = Settings(tmp_path / "s.json", {"BILLWEAVE_A_B": "5", "BILLWEAVE_A_ON": "no"})
    assert (s.get("a.b"), s.get("a.on"), s.get("a.name"), s.get("a.c", 7), dotted({"a": 1}, "a.b", "none")) == (5, False, "x", 7, "none")
