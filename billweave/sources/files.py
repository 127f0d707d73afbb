"""Invoice files: admission, format dispatch, and readers that give ragged rows or text.

Every reader works on the ``binaryFile`` source, so any number of files is read in parallel;
one file is one task's work. Files that cannot be read become rows with an error instead; empty
files are not listed by the source at all.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats with the leading bytes that a file of them must have.
FORMATS = {".json": None, ".csv": None, ".txt": None, ".pdf": b"%PDF", ".docx": b"PK\x03\x04", ".xlsx": b"PK\x03\x04"}
MAX_BYTES = 10_000_000
DELIMITERS = ",;\t|"
SNIFF = 4096
ROWS = "path string, document_id string, row_no int, cells array<string>, error string"

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, suffix, length, document_id, content) of the files under a path."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", "(\\.[^./]+)$", 1))
    return read.select("path", suffix.alias("suffix"), "length", F.sha2("content", 256).alias("document_id"), "content")


def admitted(found: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``found`` with the reason a file is refused, or null: format, emptiness, size, leading bytes."""
    magic = F.lit(False)
    for suffix, lead in FORMATS.items():
        if lead:
            magic = magic | ((F.col("suffix") == suffix) & (F.substring("content", 1, len(lead)) != F.lit(bytearray(lead))))
    reason = (
        F.when(~F.col("suffix").isin(*FORMATS), "format")
        .when(F.col("length") == 0, "empty")
        .when(F.col("length") > max_bytes, "size")
        .when(magic, "content")
    )
    return found.withColumn("refused", reason)


def sniff_delimiter(text: str) -> str:
    """The delimiter of a text's first characters, a comma where none is evident."""
    try:
        return csv.Sniffer().sniff(text[:SNIFF], delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ","


def _delimited(raw: bytes) -> list[list[str]]:
    text = raw.decode("utf-8-sig")
    return [list(r) for r in csv.reader(io.StringIO(text, newline=""), delimiter=sniff_delimiter(text))]


def _column(reference: str) -> int:
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _workbook(raw: bytes) -> list[list[str]]:
    """The first sheet; cells keep the column their reference names."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in root.iter(f"{_S}si")]
        sheet = min(n for n in z.namelist() if n.startswith("xl/worksheets/") and n.endswith(".xml"))
        out = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{_S}row"):
            cells: list[str] = []
            for c in row.iter(f"{_S}c"):
                at = _column(c.get("r", "")) if c.get("r") else len(cells)
                cells += [""] * (at - len(cells))
                value = c.findtext(f"{_S}v") or ""
                if c.get("t") == "s":
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                cells.append(value)
            out.append(cells)
        return out


def _document(raw: bytes) -> list[list[str]]:
    """Every table row of a text document, in order."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return [["".join(t.text or "" for t in c.iter(f"{_W}t")) for c in row.iter(f"{_W}tc")] for row in root.iter(f"{_W}tr")]


_READERS = {".csv": _delimited, ".txt": _delimited, ".xlsx": _workbook, ".docx": _document}


def ragged_rows(found: DataFrame) -> DataFrame:
    """Rows of the tabular formats as arrays of cells, numbered from 1 over all rows of a file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, suffix, doc, raw in batch.itertuples(index=False):
                try:
                    rows, error = _READERS[suffix](raw), None
                except Exception as e:  # an unreadable file is a result, not a failure of the job
                    rows, error = [None], type(e).__name__
                yield pd.DataFrame({"path": path, "document_id": doc, "row_no": range(1, len(rows) + 1), "cells": rows, "error": error})

    wanted = found.filter(F.col("suffix").isin(*_READERS)).select("path", "suffix", "document_id", "content")
    return wanted.mapInPandas(read, ROWS)


def _document_text(raw: bytes) -> str:
    """Every text run of a text document, one a line."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join(t.text or "" for t in root.iter(f"{_W}t"))


def _workbook_text(raw: bytes) -> str:
    """Every cell of the first sheet, one a line."""
    return "\n".join(cell for row in _workbook(raw) for cell in row if cell)


#: Least text of a page format before its fallback extractor is asked.
SHORT_TEXT = 40
_TEXTS = {".docx": _document_text, ".xlsx": _workbook_text}


def plain_text(found: DataFrame, extractors: dict[str, object] | None = None) -> DataFrame:
    """(path, document_id, text, error) of text files, office files, and of other formats by given extractors (bytes -> text).

    There is no PDF or picture reader in this package: pass one for ".pdf" to read such files, and
    one for "ocr" that is asked where the first gives under ``SHORT_TEXT`` characters. A file that
    cannot be read has a null text and the error's name.
    """
    extractors = _TEXTS | dict(extractors or {})
    fallback = extractors.pop("ocr", None)

    def one(suffix: str, raw: bytes) -> tuple[str | None, str | None]:
        try:
            text = extractors[suffix](raw) if suffix in extractors else raw.decode("utf-8-sig", "replace")
            if fallback and suffix == ".pdf" and len(text.strip()) < SHORT_TEXT:
                text = fallback(raw)
            return text, None
        except Exception as e:  # an unreadable file is a result, not a failure of the job
            return None, type(e).__name__

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read_ = [one(s, raw) for s, raw in zip(batch["suffix"], batch["content"])]
            texts, errors = [x for x, _ in read_], [e for _, e in read_]
            yield pd.DataFrame({"path": batch["path"], "document_id": batch["document_id"], "text": texts, "error": errors})

    suffixes = [".txt", ".json", ".csv", *extractors]
    wanted = found.filter(F.col("suffix").isin(*suffixes)).select("path", "suffix", "document_id", "content")
    return wanted.mapInPandas(read, "path string, document_id string, text string, error string")


#: The nested invoice object of JSON files.
PARTY = "struct<role:string,name:string,contact_name:string,address_lines:array<string>,phone:string,email:string,website:string,external_id:string>"
AMOUNTS = "currency:string,subtotal:string,discount_total:string,subtotal_after_discount:string,tax_rate_percent:string,tax_total:string,shipping_total:string,amount_due:string"
_HEAD = f"invoice_number:string,invoice_date:string,due_date:string,payment_terms:string,currency:string,parties:array<{PARTY}>,financials:struct<{AMOUNTS}>"
LINES = "array<struct<description:string,quantity:string,unit_price:string,total:string>>"
INVOICE = f"struct<invoice:struct<{_HEAD},subtotal:string>,{_HEAD},subtotal:string,lines:{LINES}>"


def json_invoices(found: DataFrame) -> DataFrame:
    """(document_id, header, parties, financials, lines) of JSON invoices, nested or flat headers alike.

    Missing or empty amounts fall through to the flat fields; parties without a known role or a
    name are dropped.
    """
    text = plain_text(found.filter(F.col("suffix") == ".json"))
    read = text.select("path", "document_id", F.from_json("text", INVOICE).alias("j"))
    blank = F.lit("")

    def either(*names: str):
        return F.coalesce(*[F.nullif(F.col(f"j.{n}"), blank) for n in names])

    head = {n: either(f"invoice.{n}", n) for n in ("invoice_number", "invoice_date", "due_date", "payment_terms")}
    amounts = {
        n: either(f"invoice.financials.{n}", f"financials.{n}", *([f"invoice.{n}", n] if n in ("currency", "subtotal") else []))
        for n in (a.split(":")[0] for a in AMOUNTS.split(","))
    }
    known = lambda p: p["role"].isin("seller", "bill_to", "ship_to") & (F.trim(p["name"]) != "")
    parties = F.filter(F.coalesce("j.invoice.parties", "j.parties"), known)
    # the whole file is refused where it holds no lines or one of them lacks its description
    lacking = F.exists("j.lines", lambda x: F.coalesce(F.trim(x["description"]), F.lit("")) == "")
    refused = F.when(F.col("j").isNull() | F.col("j.lines").isNull() | (F.size("j.lines") == 0), "no_lines").when(lacking, "description")
    return read.select(
        "path", "document_id", refused.alias("refused"), *[v.alias(k) for k, v in head.items()], *[v.alias(k) for k, v in amounts.items()],
        parties.alias("parties"), F.col("j.lines").alias("lines"),
    )


def json_lines(invoices: DataFrame) -> DataFrame:
    """One row per line of JSON invoices, ids ``json-N`` from 1."""
    each = invoices.filter(F.col("refused").isNull()).select("document_id", F.posexplode("lines").alias("n", "l"))
    return each.select("document_id", F.concat(F.lit("json-"), F.col("n") + 1).alias("source_line_id"), "l.*")
