"""Attributes stated in a wording: first dictionary hit per kind, conflicts, additions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Dictionaries in the order they are tried.
COLORS = {
    "black": "black", "white": "white", "beige": "beige", "blue": "blue", "red": "red", "green": "green", "grey": "grey",
    "gray": "grey", "brown": "brown", "yellow": "yellow",
}
MATERIALS = {
    "steel": "steel", "leather": "leather", "cotton": "cotton", "wool": "wool", "polyester": "polyester",
    "aluminium": "aluminium", "aluminum": "aluminium",
}
CATEGORIES = {
    "sneaker": "footwear", "sneakers": "footwear", "shoe": "footwear", "shoes": "footwear", "sock": "socks", "socks": "socks",
    "short": "shorts", "shorts": "shorts", "tee": "t-shirt", "tshirt": "t-shirt", "t-shirt": "t-shirt", "jacket": "jacket",
    "component": "components", "components": "components", "accessory": "components", "accessories": "components",
    "fitting": "components", "fittings": "components",
}
PROTECTED = ("color", "material", "size", "model")


def _first_hit(words: Column, terms: dict[str, str]) -> Column:
    """The value of the term that comes first in the dictionary: one look-up a word."""
    place = F.create_map(*[F.lit(x) for i, term in enumerate(terms) for x in (term, i)])
    first = F.array_min(F.transform(words, lambda w: F.try_element_at(place, w)))
    return F.get(F.array(*map(F.lit, terms.values())), first)


def extract_attributes(normalized: Column) -> Column:
    """Map of color, material and category_hint stated in a normalised text; absent where not stated."""
    words = F.split(normalized, " ")  # an empty word is in no dictionary
    shirt = F.when(F.instr(normalized, "t shirt") > 0, F.lit("t-shirt"))
    found = F.create_map(
        F.lit("color"), _first_hit(words, COLORS),
        F.lit("material"), _first_hit(words, MATERIALS),
        F.lit("category_hint"), F.coalesce(shirt, _first_hit(words, CATEGORIES)),
    )
    return F.map_filter(found, lambda _, v: v.isNotNull())


def _protected(test) -> Column:
    return F.filter(F.array(*[F.lit(k) for k in sorted(PROTECTED)]), test)


def conflicting_attributes(source: Column, candidate: Column) -> Column:
    """Protected keys that both state with different values, in order."""
    return _protected(lambda k: F.coalesce(F.try_element_at(source, k) != F.try_element_at(candidate, k), F.lit(False)))


def unsupported_attributes(source: Column, candidate: Column) -> Column:
    """Protected keys the candidate states and the source does not, in order."""
    return _protected(lambda k: F.map_contains_key(candidate, k) & ~F.map_contains_key(source, k))
