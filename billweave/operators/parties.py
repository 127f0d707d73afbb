"""Parties of an invoice: from key/value headers, from three-column layouts, and by role."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.functions.text import clean_phone, collapse_whitespace

ROLES = ("seller", "bill_to", "ship_to")
FIELDS = ("name", "contact", "address", "phone", "email", "website", "external_id")
# Forms of address that mark a person, and what a telephone number looks like.
PERSON = "^(mr|mrs|ms|dr|herr|frau) "
PHONE = "^[+()0-9][+()0-9 .\\-/]{5,}$"
LINE_BREAK = "\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]"


def from_key_values(pairs: DataFrame, document: str) -> DataFrame:
    """One row per document and role with a name, out of (document, key, value) header entries.

    Keys are ``<role>_<field>``; an address is divided at bars. Empty fields are null.
    """
    role = F.regexp_extract("key", "^(" + "|".join(ROLES) + ")_", 1)
    read = pairs.select(document, role.alias("role"), F.regexp_replace("key", "^(" + "|".join(ROLES) + ")_", "").alias("field"), "value")
    wanted = read.filter(F.col("role") != "").groupBy(document, "role")
    wide = wanted.agg(*[F.max(F.when(F.col("field") == f, F.nullif(F.trim("value"), F.lit("")))).alias(f) for f in FIELDS])
    lines = F.filter(F.transform(F.split("address", "\\|"), lambda x: F.trim(x)), lambda x: x != "")
    return wide.filter(F.col("name").isNotNull()).select(
        document, "role", "name", F.col("contact").alias("contact_name"), F.coalesce(lines, F.array().cast("array<string>")).alias("address_lines"),
        clean_phone(F.col("phone")).alias("phone"), "email", "website", "external_id",
    )


def _first_place(items: Column, test) -> Column:
    """The place of the first item that a test of (item, place) accepts; null where none does."""
    return F.array_min(F.transform(items, lambda x, i: F.when(test(x, i), i)))


def with_party_fields(rows: DataFrame, items: str) -> DataFrame:
    """``rows`` with the fields of the party that the lines in ``items`` describe; the name is null where there is none.

    A form of address in the first line makes it the contact, the line after it is the name. Of the
    others the first mail address, the first telephone number and the first word with a dot are
    taken out; what is left is the address.
    """
    rows = rows.withColumn("__head", F.when(F.lower(F.get(items, F.lit(0))).rlike(PERSON), F.get(items, F.lit(0))))
    skip = F.when(F.col("__head").isNull(), 0).otherwise(1)
    rest = lambda n: F.slice(F.col(items), n + 1, F.greatest(F.size(items) - n, F.lit(0)))
    rows = rows.withColumns({"__name": F.get(items, skip), "__rest": rest(skip + 1)})
    rows = rows.withColumns(
        {
            "__mail": _first_place(F.col("__rest"), lambda x, i: F.contains(x, F.lit("@"))),
            "__phone": _first_place(F.col("__rest"), lambda x, i: F.regexp_like(x, F.lit(PHONE))),
        }
    )
    taken = lambda i, *names: reduce(lambda a, b: a | b, [F.coalesce(F.col(n) == i, F.lit(False)) for n in names])
    site = lambda x, i: F.contains(x, F.lit(".")) & ~F.contains(x, F.lit(" ")) & ~taken(i, "__mail", "__phone")
    rows = rows.withColumn("__site", _first_place(F.col("__rest"), site))
    at = lambda place: F.get("__rest", F.col(place))
    return rows.withColumns(
        {
            "name": F.col("__name"), "contact_name": F.col("__head"),
            "address_lines": F.filter("__rest", lambda x, i: ~taken(i, "__mail", "__phone", "__site")),
            "phone": at("__phone"), "email": at("__mail"), "website": at("__site"),
        }
    ).drop("__head", "__name", "__rest", "__mail", "__phone", "__site")


def from_layout(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Parties of laid-out text, one row per document and role; texts without such a header give none.

    The line with BILL TO and SHIP TO gives the three columns' places; they run to the header of
    the items, whose own line still counts for the first column.
    """
    has = lambda x, *words: reduce(lambda a, b: a & b, [F.contains(x, F.lit(w)) for w in words])
    wanted = docs.filter(has(F.col(text), "BILL TO", "SHIP TO")).select(key, F.split(text, LINE_BREAK).alias("l"))
    top = _first_place(F.col("l"), lambda x, i: has(x, "BILL TO", "SHIP TO"))
    read = wanted.withColumn("top", top).withColumn("head", F.get("l", F.col("top")))
    read = read.withColumns({"bill": F.instr("head", "BILL TO") - 1, "ship": F.instr("head", "SHIP TO") - 1})
    read = read.filter((F.col("bill") > 0) & (F.col("ship") > F.col("bill")))
    ends = lambda x, i: (i > F.col("top")) & has(x, "DESCRIPTION") & (has(x, "QTY") | has(x, "QUANTITY"))
    read = read.withColumn("end", _first_place(F.col("l"), ends))
    last = F.coalesce("end", F.size("l"))
    body = F.slice("l", F.col("top") + 2, F.greatest(last - F.col("top") - 1, F.lit(0)))
    read = read.select(key, "bill", "ship", "head", body.alias("body"), F.get("l", F.col("end")).alias("final"))
    own = F.array_compact(F.concat(F.array("head"), F.col("body"), F.array("final")))
    part = lambda lines, a, n: F.transform(lines, lambda x: F.substring(x, a + 1, n))
    columns = {
        "seller": part(own, F.lit(0), F.col("bill")),
        "bill_to": part(F.col("body"), F.col("bill"), F.col("ship") - F.col("bill")),
        "ship_to": part(F.col("body"), F.col("ship"), F.lit(1 << 30)),
    }
    tidy = lambda lines: F.filter(F.transform(lines, lambda x: F.rtrim(collapse_whitespace(x), F.lit(","))), lambda x: x != "")
    roles = F.array(*[F.struct(F.lit(r).alias("role"), tidy(c).alias("items")) for r, c in columns.items()])
    found = with_party_fields(read.select(key, F.inline(roles)), "items").filter(F.col("name").isNotNull())
    return found.select(key, "role", "name", "contact_name", "address_lines", "phone", "email", "website")


def party_of(parties: Column, role: str) -> Column:
    """The first party of a role in an array of parties, null where there is none."""
    return F.get(F.filter(parties, lambda p: p["role"] == role), F.lit(0))
