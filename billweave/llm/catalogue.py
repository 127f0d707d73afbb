"""Problem 2: freely typed values and the catalogue product each of them names.

1. Distinct values are read once (:mod:`listings`): properties apart, words apart. Which words of
   the catalogue name a product is learned from it (:func:`naming_words`).
2. An inverted index over character 4-grams of the naming words, and over part numbers, is kept
   per scope and kind. Each distinct value finds its candidates there.
3. A candidate is scored by a weighted cosine over the grams (inverse document frequency) and the
   properties (the entropy of the field in the catalogue); no pack count stated means one. The
   best is taken where its score reaches the threshold and leads by the margin over every product
   that is not described alike; else none is.
4. Exact checks: no property that both state may differ, and the value must mention a naming word
   of the product (one slip in five letters allowed) or its part number.

Defined results: null, empty and unmatched values give ''; repeated values share one answer;
with an empty catalogue every value gives ''; a null scope matches nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billweave.llm.listings import Listing, read_listing, read_product
from billweave.llm.matching import digest, edit_similarities
from billweave.runtime import materialize

THRESHOLD = 0.3
MARGIN = 0.01
GRAM = 4
#: Weight of a property against a gram of the same rarity.
PROPERTY_WEIGHT = 2.0
#: Least edit similarity of a naming word and the word of a text that mentions it.
MENTION = 0.8
#: Share of its wordings in which a naming word has the least spread.
NAMING_SHARE = 1 / 3
SCOPE = ("tenant_id", "partner_id")
PROPERTIES = ("kind", "colour", "measure", "size", "pack", "code")
_FIELDS = Listing._fields
_SCHEMA = ", ".join(f"{f} string" for f in _FIELDS)


def _read_values(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_listing(x) for x in values], columns=_FIELDS)


def _read_products(descriptions: pd.Series, attributes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_product(d, a) for d, a in zip(descriptions, attributes)], columns=_FIELDS)


def _mentions(texts: pd.Series, names: pd.Series) -> pd.Series:
    """Whether a text has a word like one of the naming words; words with digits must be equal."""
    out = np.zeros(len(texts), dtype=bool)
    left, right, at = [], [], []
    for i, (text, name) in enumerate(zip(texts, names)):
        words = text.split(" ")
        for b in name.split(" "):
            if b in words:
                out[i] = True
            elif not any(c.isdigit() for c in b):
                near = [a for a in words if abs(len(a) - len(b)) <= (1 - MENTION) * max(len(a), len(b))]
                left += near
                right += [b] * len(near)
                at += [i] * len(near)
    if at:
        np.logical_or.at(out, at, edit_similarities(left, right) >= MENTION - 1e-9)
    return pd.Series(out)


def read_values(values: DataFrame, text: str) -> DataFrame:
    """``values`` with the listing's fields of ``text``."""
    read = values.withColumn("__said", F.pandas_udf(_read_values, _SCHEMA)(F.col(text)))
    return read.select(*values.columns, "__said.*")


def read_catalogue(products: DataFrame) -> DataFrame:
    """Catalogue rows with the listing's fields."""
    parse = F.pandas_udf(_read_products, _SCHEMA)
    columns = ["product_id", *SCOPE]
    read = products.withColumn("__said", parse("canonical_description", "attributes_json"))
    return read.select(*columns, "__said.*")


def with_words(listings: DataFrame, *keep: str) -> DataFrame:
    """A row (keep, word) for each distinct word of ``names``."""
    words = F.filter(F.array_distinct(F.split("names", " ")), lambda w: w != "")
    return listings.select(*keep, F.explode(words).alias("word"))


def naming_words(words: DataFrame, key: str, *scope: str) -> DataFrame:
    """The rows of ``words`` (key, scope, word, n, ...) whose word names an item, with its frequency ``df``.

    ``n`` is how often a key's wording occurs. A word's spread is the number of different sets of
    words it stands in: a name stands alone or beside its brand, a brand, a material or an
    advertising word beside many names. A word names where it has the least spread of at least
    ``NAMING_SHARE`` of its wordings.
    """
    of_key = Window.partitionBy(key)  # the words of one wording
    counted = words.withColumn("set", F.md5(F.to_json(F.array_sort(F.collect_set("word").over(of_key)))))
    each = counted.groupBy(*scope, "word", "set").agg(F.sum("n").alias("n"))
    spread = each.groupBy(*scope, "word").agg(F.count(F.lit(1)).alias("spread"), F.sum("n").alias("df"))
    counted = words.join(spread, [*scope, "word"]).withColumn("least", F.min("spread").over(of_key))
    sure = F.when(F.col("spread") == F.col("least"), F.col("n")).otherwise(F.lit(0))
    share = counted.groupBy(*scope, "word").agg((F.sum(sure) / F.sum("n")).alias("share"))
    naming = share.filter(F.col("share") >= NAMING_SHARE).select(*scope, "word")
    return counted.drop("least", "spread").join(naming, [*scope, "word"], "left_semi")


def name_grams(words: Column) -> Column:
    """Distinct character grams of each word, padded by two marks."""

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit("__"), word, F.lit("__"))
        return F.transform(F.sequence(F.lit(1), F.char_length(word) + 5 - GRAM), lambda i: F.substring(padded, i, F.lit(GRAM)))

    return F.array_distinct(F.flatten(F.transform(F.filter(F.split(words, " "), lambda w: w != ""), of_word)))


def field_weights(held: DataFrame) -> dict[str, float]:
    """Squared weight of each property: the entropy of its stated values in the catalogue, 1 at least."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in PROPERTIES])
    counted = held.select(F.inline(cells)).filter(F.col("value") != "").groupBy("field", "value").count()
    n = F.sum("count")
    entropy = F.log(n) - F.sum(F.col("count") * F.log("count")) / n
    found = {r["field"]: r["h"] for r in counted.groupBy("field").agg(entropy.alias("h")).collect()}  # a row a property
    return {f: (PROPERTY_WEIGHT * max(found.get(f, 0.0), 1.0)) ** 2 for f in PROPERTIES}


def gram_weights(units: DataFrame) -> DataFrame:
    """(gram, w) of the grams of ``units`` (fid, name): squared inverse frequency."""
    n = float(units.count())
    df = units.select(F.explode(name_grams(F.col("name"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    return materialize(df.select("gram", F.pow(F.log1p(F.lit(n) / F.col("df")), F.lit(2.0)).alias("w")))


def name_norms(rows: DataFrame, key: str, names: str, weights: DataFrame, out: str) -> DataFrame:
    """(key, out): the squared norm of the grams of ``names``; grams that no name holds weigh nothing."""
    grams = rows.select(key, F.explode(name_grams(F.col(names))).alias("gram")).join(weights, "gram")
    return grams.groupBy(key).agg(F.sum("w").alias(out))


def name_candidates(asked: DataFrame, units: DataFrame, weights: DataFrame) -> DataFrame:
    """(nid, fid, dot): the weight of the grams that a wording and a name it mentions share.

    ``asked`` has (nid, scope, kind, names), ``units`` (fid, scope, kind, name), both distinct.
    The index carries numbers only. A posting lies under its kind ('?' if unknown) and under '*';
    a wording of a known kind looks under that and '?', one of an unknown kind under '*'.
    """
    held = units.select("fid", "scope", "kind", F.explode(name_grams(F.col("name"))).alias("gram")).join(weights, "gram")
    kind = F.when(F.col("kind") == "", "?").otherwise(F.col("kind"))
    posts = held.select("fid", "scope", "gram", "w", F.explode(F.array(kind, F.lit("*"))).alias("under"))
    posts = posts.select("fid", F.xxhash64("scope", "under", "gram").alias("g"), "w")
    looks = F.when(F.col("kind") == "", F.array(F.lit("*"))).otherwise(F.array("kind", F.lit("?")))
    looked = asked.select("nid", "scope", F.explode(name_grams(F.col("names"))).alias("gram"), looks.alias("looks"))
    looked = looked.select("nid", "scope", "gram", F.explode("looks").alias("under"))
    looked = looked.select("nid", F.xxhash64("scope", "under", "gram").alias("g"))
    near = looked.join(posts, "g").groupBy("nid", "fid").agg(F.sum("w").alias("dot"))
    near = near.join(asked.select("nid", "names"), "nid").join(units.select("fid", "name"), "fid")
    return near.filter(F.pandas_udf(_mentions, "boolean")("names", "name")).select("nid", "fid", "dot")


def _either(name: str, prefix: str = "") -> Column:
    """A property as it counts: no pack count stated means one."""
    value = F.col(prefix + name)
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("1")) if name == "pack" else value


def _score(weight: dict[str, float]) -> Column:
    """Weighted cosine of a value and a product over grams and properties.

    A part number counts only where both state one: most texts leave it out.
    """
    dot, q, p = F.col("dot"), F.coalesce("q_norm", F.lit(0.0)), F.coalesce("u_norm", F.lit(0.0))
    for f, w in weight.items():
        a, b = _either(f), _either(f, "p_")
        in_q, in_p = (a != "", b != "") if f != "code" else (((a != "") & (b != "")),) * 2
        dot = dot + F.when(in_q & (a == b), w).otherwise(0.0)
        q, p = q + F.when(in_q, w).otherwise(0.0), p + F.when(in_p, w).otherwise(0.0)
    return F.round(dot / F.sqrt(F.nullif(q * p, F.lit(0.0))), 9)


def map_to_catalogue(
    values: DataFrame, products: DataFrame, key: str, text: str, threshold: float = THRESHOLD, margin: float = MARGIN
) -> DataFrame:
    """(key, product_id) of every row of ``values``, '' where its scope holds no such product."""
    scope = F.when(F.col("tenant_id").isNotNull() & F.col("partner_id").isNotNull(), digest(*SCOPE))
    values = values.select(F.col(key).alias("__key"), *SCOPE, F.col(text).alias("__text"))
    distinct = values.select(*SCOPE, "__text").filter(F.col("__text").isNotNull() & scope.isNotNull()).distinct()
    said = read_values(distinct, "__text").select(digest(*SCOPE, "__text").alias("qid"), "tenant_id", scope.alias("scope"), "names", *PROPERTIES)
    said = materialize(said)
    held = read_catalogue(products).withColumn("scope", scope).filter(F.col("scope").isNotNull()).drop("partner_id")
    held = materialize(held)
    weight = field_weights(held)

    # the catalogue's words that name a product, and those of a text that may
    words = with_words(held.withColumn("n", F.lit(1)), "product_id", "tenant_id", "n")
    naming = materialize(naming_words(words, "product_id", "tenant_id"))
    generic = words.select("tenant_id", "word").distinct().join(naming.select("tenant_id", "word").distinct(), ["tenant_id", "word"], "left_anti")
    joined = F.array_join(F.array_sort(F.collect_set("word")), " ")  # the words of one text
    # of several naming words the most frequent is the name, the others stand beside it here and there
    ranked = naming.groupBy("product_id").agg(F.array_sort(F.collect_set(F.struct("df", "word"))).alias("w"))
    most = F.filter("w", lambda x: x["df"] == F.element_at("w", -1)["df"])
    of_product = ranked.select("product_id", F.array_join(F.transform(most, lambda x: x["word"]), " ").alias("name"))
    of_text = with_words(said, "qid", "tenant_id").join(generic, ["tenant_id", "word"], "left_anti").groupBy("qid").agg(joined.alias("named"))
    held = held.drop("names").join(of_product, "product_id", "left").withColumn("name", F.coalesce("name", F.lit("")))
    said = said.drop("names").join(of_text, "qid", "left").withColumn("names", F.coalesce("named", F.lit(""))).drop("named")
    same = [_either(f) for f in PROPERTIES if f != "code"]
    held = held.withColumns({"fid": digest("scope", "kind", "name"), "alike": digest("name", *same)})
    held = materialize(held.select("product_id", "scope", "fid", "alike", "name", *PROPERTIES))
    said = materialize(said.withColumn("nid", digest("scope", "kind", "names")))

    units = held.filter(F.col("name") != "").select("fid", "scope", "kind", "name").distinct()
    asked = said.filter(F.col("names") != "").select("nid", "scope", "kind", "names").distinct()
    grams = gram_weights(units)
    near = name_candidates(asked, units, grams)
    said = said.join(name_norms(asked, "nid", "names", grams, "q_norm"), "nid", "left").drop("names", "tenant_id")
    held = held.join(name_norms(units, "fid", "name", grams, "u_norm"), "fid", "left").drop("name")
    held = held.select("product_id", "scope", "fid", "alike", "u_norm", *[F.col(f).alias(f"p_{f}") for f in PROPERTIES])
    by_name = said.drop("scope").join(near, "nid").join(held.drop("scope"), "fid")
    by_code = said.filter(F.col("code") != "").join(held.withColumn("code", F.col("p_code")), ["scope", "code"])
    pairs = by_name.unionByName(by_code.withColumn("dot", F.lit(0.0)).select(by_name.columns))
    for f in PROPERTIES:
        a, b = F.col(f), F.col(f"p_{f}")
        pairs = pairs.filter((a == "") | (b == "") | (a == b))
    scored = pairs.select("qid", "product_id", "alike", _score(weight).alias("score")).filter(F.col("score") >= threshold)

    # the two best descriptions of each value; products described alike are one
    best_of = scored.groupBy("qid", "alike").agg(F.min(F.struct((-F.col("score")).alias("lost"), "product_id")).alias("b"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("b.lost", "b.product_id"))
    two = best_of.withColumn("place", place).filter("place <= 2").groupBy("qid")
    two = two.agg(F.min("b").alias("first"), F.max("b.lost").alias("last"), F.count(F.lit(1)).alias("n"))
    clear = (F.col("n") == 1) | (F.col("last") - F.col("first.lost") >= margin)
    best = two.filter(clear).select("qid", "first.product_id")
    rows = values.select("__key", digest(*SCOPE, "__text").alias("qid"))
    return rows.join(best, "qid", "left").select(
        F.col("__key").alias(key), F.coalesce("product_id", F.lit("")).alias("product_id")
    )
