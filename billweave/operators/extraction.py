"""Invoice lines and header facts out of ragged rows and plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billweave.functions.dates import due_date, parse_invoice_date
from billweave.functions.money import parse_decimal
from billweave.functions.text import collapse_whitespace, detect_currency

# Words that end a table, and words of its header.
STOP_WORDS = ("subtotal", "discount", "tax rate", "total tax", "balance due", "shipping")
HEADER_WORDS = ("description", "qty", "quantity", "unit price", "total")
# A number in running text, and a row of an item table.
_NUM = "([-+]?\\d[\\d.,' ]*)"
ROW = f"^\\s*(.+?)\\s+{_NUM}\\s+{_NUM}\\s+{_NUM}\\s*$"
# The labels of a header's entries.
HEADER_LABELS = ("INVOICE NUMBER", "INVOICE DATE", "PAYMENT TERMS", "CURRENCY")
PARTY_LABELS = {
    "seller": ("SELLER NAME", "SELLER CONTACT", "SELLER ADDRESS", "SELLER PHONE", "SELLER EMAIL", "SELLER WEBSITE"),
    "bill_to": ("BILL TO NAME", "BILL TO CONTACT", "BILL TO ADDRESS", "BILL TO PHONE", "BILL TO EMAIL", "BILL TO WEBSITE"),
    "ship_to": ("SHIP TO NAME", "SHIP TO CONTACT", "SHIP TO ADDRESS", "SHIP TO PHONE", "SHIP TO EMAIL", "SHIP TO WEBSITE"),
}
# The labels of a document's amounts.
AMOUNT_LABELS = {
    "subtotal": "\\bSUBTOTAL\\b(?!\\s+LESS)",
    "discount_total": "\\bDISCOUNT\\b",
    "subtotal_after_discount": "\\bSUBTOTAL\\s+(?:LESS(?:\\s+DISCOUNT)?|AFTER\\s+DISCOUNT)\\b",
    "tax_total": "\\bTOTAL\\s+TAX\\b",
    "shipping_total": "\\bSHIPPING(?:/HAND(?:LING|\\s*LING)?)?\\b",
    "amount_due": "\\b(?:AMOUNT\\s+DUE|BALANCE(?:\\s+DUE)?|DUE)\\b",
}


def _starts_with_stop(text: Column) -> Column:
    return F.lower(text).rlike("^(" + "|".join(STOP_WORDS) + ")")


def rows_to_lines(rows: DataFrame, document: str, row_no: str, cells: str) -> DataFrame:
    """Lines of ragged rows: blank and header rows are skipped, the first stop word ends the table.

    A row counts with four cells, a description and three numbers that are readable or missing.
    The line's number is the row's own, counted over all rows.
    """
    trimmed = F.transform(F.col(cells), lambda x: F.trim(x))
    read = rows.select(document, row_no, trimmed.alias("c"))
    blank = ~F.exists("c", lambda x: x != "")
    header = F.arrays_overlap(F.transform("c", F.lower), F.array(*[F.lit(w) for w in HEADER_WORDS]))
    stop = ~blank & ~header & _starts_with_stop(F.get("c", F.lit(0)))
    w = Window.partitionBy(document).orderBy(row_no).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    read = read.withColumns({"skip": blank | header, "ended": F.max(stop.cast("int")).over(w)})
    body = read.filter((F.col("ended") == 0) & ~F.col("skip") & (F.size("c") >= 4) & (F.get("c", F.lit(0)) != ""))
    numbers = [F.get("c", F.lit(i)) for i in (1, 2, 3)]
    parsed = [parse_decimal(n, "decimal(20,4)") for n in numbers]
    usable = F.lit(True)
    for raw, value in zip(numbers, parsed):
        usable = usable & ((raw == "") | value.isNotNull())
    return body.filter(usable).select(
        document, row_no, F.get("c", F.lit(0)).alias("description"),
        parsed[0].alias("quantity"), parsed[1].alias("unit_price"), parsed[2].alias("total"),
    )


def text_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) of every line of a text, white space collapsed, numbered from 1."""
    lines = F.split(F.col(text), "\\r\\n|\\r|\\n|\\f")
    return docs.select(key, F.posexplode(lines).alias("n", "raw")).select(
        key, (F.col("n") + 1).alias("line_no"), collapse_whitespace(F.col("raw")).alias("line")
    )


def text_to_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of the item table of plain text: from its header to the first stop word.

    What follows the header on its own line is a candidate row too. Rows match a description and
    three numbers.
    """
    lines = text_lines(docs, key, text)
    low = F.lower("line")
    header = (F.instr(low, "description") > 0) & low.rlike("qty|quantity") & (F.instr(low, "total") > 0)
    trailing = F.trim(F.regexp_replace(F.regexp_extract("line", "(?i)\\bdescription\\b.*?\\btotal\\b(.*)$", 1), "^\\s+", ""))
    lines = lines.withColumns({"is_header": header, "row": F.when(header, trailing).otherwise(F.col("line"))})
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("inside", F.max(F.col("is_header").cast("int")).over(w))
    stop = (F.col("inside") == 1) & _starts_with_stop(F.col("row"))
    lines = lines.withColumn("ended", F.max(stop.cast("int")).over(w))
    body = lines.filter((F.col("inside") == 1) & (F.col("ended") == 0) & F.col("row").rlike(ROW))
    part = lambda i: F.regexp_extract("row", ROW, i)
    return body.select(
        key, "line_no", F.trim(part(1)).alias("description"),
        *[parse_decimal(part(i), "decimal(20,4)").alias(n) for i, n in ((2, "quantity"), (3, "unit_price"), (4, "total"))],
    )


def vertical_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of tables whose cells stand one to a text line: after the header, groups of four.

    The header runs from a line "description" to a line "total" within eight; a group whose three
    numbers do not parse moves on by one line, a stop word ends the table. Only texts without
    a row of the ordinary form belong here. One text's cells are walked in one expression.
    """
    lines = F.filter(F.transform(F.split(F.col(text), "\\r\\n|\\r|\\n"), collapse_whitespace), lambda x: x != "")
    read = docs.select(key, lines.alias("c")).withColumn("low", F.transform("c", F.lower))
    start = F.array_position("low", "description").cast("int")
    ends = F.array_position(F.slice("low", F.greatest(start, F.lit(1)), F.lit(8)), "total").cast("int")
    first = F.when(ends > 0, start + ends - 1).otherwise(start)
    stop = F.lit("^(" + "|".join(STOP_WORDS) + ")")
    body = read.filter(start > 0).select(key, F.slice("c", first + 1, F.size("c")).alias("c"))
    until = F.get(F.filter(F.transform("c", lambda x, i: F.when(F.regexp_like(F.lower(x), stop), i)), lambda i: i.isNotNull()), F.lit(0))
    body = body.select(key, F.slice("c", F.lit(1), F.coalesce(until, F.size("c"))).alias("c"))
    body = body.withColumn("num", F.transform("c", lambda x: parse_decimal(x, "decimal(20,4)")))
    fits = lambda i: F.forall(F.sequence(i + 1, i + 3), lambda j: F.get("num", j).isNotNull())
    # the walk: state (next free position, starts so far)
    zero = F.struct(F.lit(0).alias("free"), F.array().cast("array<int>").alias("at"))
    walk = F.aggregate(
        F.sequence(F.lit(0), F.size("c") - 4),
        zero,
        lambda s, i: F.when(
            (i >= s["free"]) & fits(i), F.struct((i + 4).alias("free"), F.concat(s["at"], F.array(i)).alias("at"))
        ).otherwise(s),
    )
    rows = body.filter(F.size("c") >= 4).select(key, "c", "num", F.explode(walk["at"]).alias("i"))
    cell = lambda n: F.get("num", F.col("i") + n)
    return rows.select(
        key, (F.col("i") + 1).alias("position"), F.get("c", F.col("i")).alias("description"), cell(1).alias("quantity"),
        cell(2).alias("unit_price"), cell(3).alias("total"),
    )


def item_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, description, numbers, layout) of texts: rows of a table, else a table of one cell a line."""
    rows = text_to_lines(docs, key, text).withColumnRenamed("line_no", "position").withColumn("layout", F.lit("rows"))
    rest = docs.join(rows.select(key).distinct(), key, "left_anti")
    return rows.unionByName(vertical_lines(rest, key, text).withColumn("layout", F.lit("cells")))


def declared_subtotal(text: Column) -> Column:
    """The last readable number of the first line that starts with "subtotal", not "subtotal less", and has one."""
    lines = F.filter(F.transform(F.split(text, "\\r\\n|\\r|\\n"), collapse_whitespace), lambda x: F.lower(x).rlike("^subtotal(?! less)"))
    numbers = F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(_NUM), F.lit(1)))
    parsed = F.transform(numbers, lambda x: F.try_element_at(F.array_compact(F.transform(x, lambda n: parse_decimal(n, "decimal(20,4)"))), F.lit(-1)))
    return F.get(F.array_compact(parsed), F.lit(0))


def declared_subtotal_of_rows(rows: DataFrame, document: str, row_no: str, cells: str) -> DataFrame:
    """(document, subtotal): the right-most readable cell of the first row labelled exactly "subtotal"."""
    trimmed = F.transform(F.col(cells), lambda x: F.trim(x))
    read = rows.select(document, row_no, trimmed.alias("c")).filter(F.lower(F.get("c", F.lit(0))) == "subtotal")
    numbers = F.transform(F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0))), lambda x: parse_decimal(x, "decimal(20,4)"))
    read = read.withColumn("subtotal", F.try_element_at(F.array_compact(numbers), F.lit(-1))).filter(F.col("subtotal").isNotNull())
    return read.groupBy(document).agg(F.min_by("subtotal", row_no).alias("subtotal"))


def labelled_value(text: Column, label: str) -> Column:
    """What follows ``LABEL :`` or ``LABEL =``, on the next filled line where its own is empty; null where absent."""
    return F.nullif(F.trim(F.regexp_extract(text, f"(?im)^\\s*{label}\\s*[:=]\\s*(.*?)\\s*$", 1)), F.lit(""))


def labelled_amount(text: Column, pattern: str) -> Column:
    """The number behind a label as it is written, a currency sign allowed between; null where absent."""
    return F.nullif(F.regexp_extract(text, f"(?im){pattern}\\s*[:=]?\\s*(?:[$€£¥]\\s*)?{_NUM}", 1), F.lit(""))


def header_facts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Header of plain text: number, dates, terms, currency, amounts, and whether it is ``labelled``.

    A text with any labelled entry is read by its labels alone. Else the first date of 30 lines and
    the first number of 8 to 20 digits standing alone in 35 lines count, and the first "due in N days".
    """
    t = F.col(text)
    every = [*HEADER_LABELS, *[x for labels in PARTY_LABELS.values() for x in labels]]
    entries = docs.select(key, text, F.array(*[labelled_value(t, label) for label in every]).alias("e"))
    entries = entries.withColumn("labelled", F.exists("e", lambda x: x.isNotNull()))
    entry = lambda label: F.get("e", F.lit(every.index(label)))
    lines = F.split(t, "\\r\\n|\\r|\\n")
    first = lambda n, f: F.get(F.array_compact(F.transform(F.slice(lines, 1, n), f)), F.lit(0))
    alone = first(35, lambda x: F.when(F.trim(x).rlike("^\\d{8,20}$"), F.trim(x)))
    due = F.nullif(F.regexp_extract(t, "(?i)\\bDue\\s+in\\s+\\d+\\s+days?\\b", 0), F.lit(""))
    found = {
        "invoice_number": (entry("INVOICE NUMBER"), alone),
        "invoice_date": (parse_invoice_date(entry("INVOICE DATE")), first(30, parse_invoice_date)),
        "payment_terms": (entry("PAYMENT TERMS"), due),
    }
    read = {n: F.when(F.col("labelled"), a).otherwise(b).alias(n) for n, (a, b) in found.items()}
    out = entries.select(key, text, "labelled", *read.values(), entry("CURRENCY").alias("said"))
    out = out.withColumn("due_date", due_date(F.col("invoice_date"), F.col("payment_terms")))
    out = out.withColumn("currency", detect_currency(t, F.col("said"))).drop("said")
    rate = F.nullif(F.regexp_extract(t, f"(?im)\\bTAX\\s+RATE\\b\\s*[:=]?\\s*{_NUM}\\s*%", 1), F.lit(""))
    names = [*AMOUNT_LABELS, "tax_rate_percent"]
    written = F.array(*[labelled_amount(t, pattern) for pattern in AMOUNT_LABELS.values()], rate)
    # one parser over an array keeps the generated code small
    out = out.withColumn("amounts", F.transform(written, lambda x: parse_decimal(x, "decimal(20,4)")))
    return out.withColumns({n: F.get("amounts", F.lit(i)) for i, n in enumerate(names)}).drop(text, "amounts")


def labelled_entries(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, key_name, value) of the labelled party entries of texts, as :func:`parties.from_key_values` reads them."""
    t = F.col(text)
    cells = [
        F.struct(F.lit(label.lower().replace(" ", "_")).alias("key"), labelled_value(t, label).alias("value"))
        for labels in PARTY_LABELS.values()
        for label in labels
    ]
    return docs.select(F.col(key).alias("document"), F.inline(F.array(*cells))).filter(F.col("value").isNotNull()).withColumnRenamed("document", key)


def key_values(rows: DataFrame, document: str, row_no: str, cells: str) -> DataFrame:
    """(document, key, value) of metadata rows: the first filled cell after the key, the last row wins."""
    trimmed = F.transform(F.col(cells), lambda x: F.trim(x))
    key = F.replace(F.lower(F.get("c", F.lit(0))), F.lit(" "), F.lit("_"))
    value = F.get(F.filter(F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0))), lambda x: x != ""), F.lit(0))
    read = rows.select(document, row_no, trimmed.alias("c")).select(document, row_no, key.alias("key"), value.alias("value"))
    read = read.filter((F.col("key") != "") & F.col("value").isNotNull())
    return read.groupBy(document, "key").agg(F.max_by("value", row_no).alias("value"))


def header_record(pairs: DataFrame, document: str, keys: tuple[str, ...]) -> DataFrame:
    """One row per document with the wanted keys as columns."""
    return pairs.groupBy(document).agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])
