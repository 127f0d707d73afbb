"""Reading product wording: kind, colour, measure, size, pack count, part number and names.

Everything that names no property (advertising, material, connecting words) is dropped; what
is left are the names of the item and of its brand. Attribute objects are read by the same
rules, from their values.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

from billweave.llm.matching import nearest
from billweave.llm.visual_form import visual_text

# Product kinds and the other words for them.
KINDS = {
    "backpack": ("rucksack",), "bottle": ("flask",), "cable": ("lead",), "clay": ("modelling paste",),
    "coffee beans": ("roast coffee",), "curtain": ("drape",), "cushion": ("pillow",), "desk lamp": ("table light",),
    "detergent": ("cleaner",), "drill": ("power driver",), "duffel": ("holdall",), "floodlight": ("spot lamp",),
    "flour": ("meal",), "folder": ("binder",), "gloves": ("mitts",), "grease": ("lubricant",), "heater": ("radiator",),
    "hose": ("tubing",), "jacket": ("anorak",), "kettle": ("water boiler",), "mug": ("cup",), "notebook": ("writing pad",),
    "paint": ("lacquer",), "rope": ("cord",), "rug": ("carpet",), "sandal": ("slider",), "sander": ("grinder",),
    "screws": ("fasteners",), "shelf": ("rack",), "sneaker": ("trainer",), "socks": ("stockings",),
    "storage box": ("container bin",), "t-shirt": ("tee", "tshirt", "t shirt"), "towel": ("bath sheet",),
    "trousers": ("pants",), "vest": ("gilet",),
}
# Colours and their short forms.
COLOURS = {
    "beige": ("bge",), "black": ("blk", "jet-black"), "blue": ("blu",), "brown": ("brn",), "green": ("grn",),
    "grey": ("gry", "gray"), "orange": ("orng",), "purple": ("prpl",), "red": ("rd",), "silver": ("slv",), "white": ("wht",),
    "yellow": ("yel", "ylw"),
}
# Units with the base unit and the factor to it.
UNITS = {
    "l": ("ml", 1000), "litre": ("ml", 1000), "litres": ("ml", 1000), "liter": ("ml", 1000), "ltr": ("ml", 1000),
    "cl": ("ml", 10), "ml": ("ml", 1), "m": ("mm", 1000), "cm": ("mm", 10), "mm": ("mm", 1), "kg": ("g", 1000),
    "g": ("g", 1), "gr": ("g", 1), "gram": ("g", 1), "kw": ("w", 1000), "w": ("w", 1), "watt": ("w", 1), "watts": ("w", 1),
}
# Garment sizes.
SIZES = {
    "xs": "xs", "extra small": "xs", "x-small": "xs", "s": "s", "small": "s", "m": "m", "medium": "m", "l": "l", "large": "l",
    "xl": "xl", "extra large": "xl", "x-large": "xl", "xxl": "xxl", "2xl": "xxl", "xx-large": "xxl",
}
# Advertising phrases.
ADVERTISING = (
    "best seller", "customer favourite", "eco line", "free shipping", "great value", "hot deal", "in stock now",
    "limited offer", "neu im sortiment", "new season", "new", "original", "premium", "pro grade", "sale", "ships today",
    "top quality", "special price", "2nd season",
)
# Materials.
MATERIALS = ("recycled pet", "bamboo", "ceramic", "cotton", "leather", "linen", "nylon", "oak", "rubber", "steel")
# Words without a meaning of their own here.
FILLERS = {
    "in", "col", "colour", "color", "tone", "tint", "pure", "bright", "ref", "art", "of", "pack", "set", "pcs", "stk", "er", "size",
    "gr", "eu", "x", "the", "with", "and", "for", "a", "dozen", "nr", "no",
}

_KIND_WORDS = {w: k for k, others in KINDS.items() for w in (k, *others)}
_COLOUR_WORDS = {w: c for c, others in COLOURS.items() for w in (c, *others)}
_LONG_KINDS = {w: k for w, k in _KIND_WORDS.items() if " " not in w and len(w) >= 4}
_PHRASE_KINDS = {w.replace(" ", ""): k for w, k in _KIND_WORDS.items() if " " in w}
_LONG_COLOURS = {w: c for w, c in _COLOUR_WORDS.items() if len(w) >= 5}
_VOCABULARY = {w for x in (*_KIND_WORDS, *_COLOUR_WORDS, *ADVERTISING, *MATERIALS, *SIZES, *UNITS) for w in x.split()} | FILLERS


def _choice(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


_ADS = re.compile(rf"(?<!\w)(?:{_choice(ADVERTISING)})(?!\w)[!*]*")
_MATERIAL = re.compile(rf"(?<![\w-])(?:{_choice(MATERIALS)})(?![\w-])")
_KIND = re.compile(rf"(?<![\w-])(?:{_choice(_KIND_WORDS)})(?![\w-])")
_COLOUR = re.compile(rf"(?<![\w-])(?:{_choice(_COLOUR_WORDS)})(?:-col|-coloured)?(?![\w-])")
_PACK = re.compile(
    r"(?<![\w.,])(?:(?:pack|set|box|case) of (\d+)|(\d+) ?-? ?(?:pack|pcs|stk|pieces|pc|st)\b|(\d+)er[- ]?pack|x ?(\d+)(?!\w)|(\d+)? ?dozen)"
)
_MEASURE = re.compile(rf"(?<![\w.,])(\d+(?:[.,]\d+)?) ?({_choice(UNITS)})(?![\w])\.?")
_EU = re.compile(r"(?<!\w)(?:eu|size|gr\.?) ?(3[4-9]|4[0-9])(?!\w)")
_GARMENT = re.compile(rf"(?<![\w-])(?:(?:size|gr\.?) )?({_choice(SIZES)})(?![\w-])")
_CODE = re.compile(r"(?<![\w-])#?([a-z]{2})[- ]?([a-hjkmnp-z2-9]{5})(?![\w-])")
_MARKED = re.compile(r"(?:#|(?<!\w)(?:ref|art)\b\.?:? ?)([a-z]{2})[- ]?([a-z2-9]{5})(?![\w-])")
_CYRILLIC, _LATIN = re.compile("[\u0400-\u04ff]"), re.compile("[A-Za-z]")
_SYLLABLES = re.compile(r"(?:[b-df-hj-np-tv-z][aeiou]){2,}[b-df-hj-np-tv-z]?")


class Listing(NamedTuple):
    """What a wording says; empty strings where it says nothing."""

    kind: str
    names: str  # the other words, in order
    colour: str
    measure: str  # base unit and amount, as "ml:500"
    size: str  # "eu:42" or "xl"
    pack: str
    code: str


def _is_code(a: str, b: str, raw: str, text: str) -> bool:
    """Whether two letters and five signs are a part number: a digit, or another word's consonants lead it."""
    if re.search(r"\d", b):
        return True
    if a + b in _VOCABULARY:
        return False
    led = rf"(?<!\w){a[0]}[aeiou]+{a[1]}[a-z]*"
    return not _SYLLABLES.fullmatch(a + b) and any(m[0] != a + b for m in re.finditer(led, text))


def read_measure(text: str) -> str:
    """The first amount with a unit, in base units."""
    found = _MEASURE.search(text)
    if not found:
        return ""
    unit, factor = UNITS[found[2]]
    amount = round(float(found[1].replace(",", ".")) * factor, 3)
    return f"{unit}:{amount:g}" if amount < 1e6 else f"{unit}:{amount:.0f}"


def read_pack(text: str) -> str:
    """The pack count."""
    found = _PACK.search(text)
    if not found:
        return ""
    if "dozen" in found[0]:
        return str(12 * int(found[5] or 1))
    return str(int(next(x for x in found.groups() if x)))


def _one_case(text: str) -> str:
    """Lower case; Cyrillic words keep their letters, look-alikes inside Latin words are replaced."""
    words = unicodedata.normalize("NFKC", text).split()
    return " ".join(w.lower() if _CYRILLIC.search(w) and not _LATIN.search(w) else visual_text(w).lower() for w in words)


@lru_cache(maxsize=50_000)
def read_listing(text: str | None) -> Listing:
    """Read one wording."""
    t = _one_case(text or "").replace("’", "'")
    t = re.sub(r"\s+", " ", re.sub(r"[“”\"()\[\]/;|*:]|(?<!\d),|,(?!\d)|\s-\s", " ", t)).strip()
    code = ""
    found = _MARKED.search(t)
    if found is None:
        found = next((m for m in _CODE.finditer(t) if " " not in m[0].strip() and _is_code(m[1], m[2], m[0], t)), None)
    if found:
        code = found[1] + found[2]
        t = t[: found.start()] + " " + t[found.end() :]
    t = _ADS.sub(" ", t)
    t = _MATERIAL.sub(" ", t)
    size = ""
    found = _EU.search(t)
    if found:
        size = "eu:" + found[1]
        t = t[: found.start()] + " " + t[found.end() :]
    pack = read_pack(t)
    t = _PACK.sub(" ", t)
    measure = read_measure(t)
    t = _MEASURE.sub(" ", t)
    found = _COLOUR.search(t)
    colour = ""
    if found:
        colour = _COLOUR_WORDS[re.sub(r"-col(?:oured)?$", "", found[0])]
        t = t[: found.start()] + " " + t[found.end() :]
    kind = ""
    found = _KIND.search(t)
    if found:
        kind = _KIND_WORDS[found[0]]
        t = t[: found.start()] + " " + t[found.end() :]
    if not size:
        found = _GARMENT.search(t)
        if found:
            size = SIZES[found[1]]
            t = t[: found.start()] + " " + t[found.end() :]
    words = [w.strip(".,-'!+&") for w in t.split()]
    words = [w for w in words if w and w not in FILLERS and not re.fullmatch(r"[\d.,]+", w)]
    if not kind:
        kind, words = _slip(words, _LONG_KINDS, _PHRASE_KINDS)
    if not colour:
        colour, words = _slip(words, _LONG_COLOURS, {})
    return Listing(kind, " ".join(words), colour, measure, size, pack, code)


def _slip(words: list[str], single: dict[str, str], phrases: dict[str, str]) -> tuple[str, list[str]]:
    """A word or two neighbouring words that are one slip away from a known one, and the rest."""
    for i in range(len(words) - 1 if phrases else 0):
        found = nearest(words[i] + words[i + 1], phrases, 1)
        if found:
            return found, words[:i] + words[i + 2 :]
    for i, w in enumerate(words):
        found = nearest(w, single, 1) if len(w) >= 3 else None
        found = found or (nearest(w, phrases, 1) if len(w) >= 7 else None)
        if found:
            return found, words[:i] + words[i + 1 :]
    return "", words


_ATTRIBUTE_KINDS = {
    "colour": re.compile(r"^col"),
    "pack": re.compile(r"pack|qty"),
    "code": re.compile(r"mpn|article|model|sku|part"),
    "skip": re.compile(r"material|category"),
}


def read_attributes(text: str | None) -> Listing:
    """Read an attribute object; keys only help where a bare value is ambiguous."""
    try:
        values = json.loads(text) if text else {}
    except ValueError:
        values = {}
    colour = measure = size = pack = code = ""
    for key, value in values.items() if isinstance(values, dict) else ():
        key, value = str(key).lower(), str(value)
        kind = next((k for k, pattern in _ATTRIBUTE_KINDS.items() if pattern.search(key)), "")
        if kind == "skip":
            continue
        if kind == "code":
            code = re.sub(r"[^a-z0-9]", "", value.lower())
        elif kind == "pack":
            bare = re.fullmatch(r"\s*(\d+)\s*", value)
            pack = str(int(bare[1])) if bare else read_pack(value.lower())
        else:
            said = read_listing(value)
            colour, measure, size = said.colour or colour, said.measure or measure, said.size or size
    return Listing("", "", colour, measure, size, pack, code)


def read_product(description: str | None, attributes: str | None) -> Listing:
    """A catalogue row: its description, completed by its attributes."""
    said, more = read_listing(description), read_attributes(attributes)
    return Listing(*(a or b for a, b in zip(said, more)))
