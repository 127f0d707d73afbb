"""Problem 5: organisations and people in many spellings.

1. Every distinct name is read into the organisation's own name (the *stem*) and its branch of
   trade; legal form, department and office are dropped. Branches beyond the given list are
   learned: a last word that stands behind many different stems. Every distinct contact is read
   into family name, first name and initials; titles and forms of address are dropped.
2. Stems are banded by MinHash over padded q-grams. The number of bands comes from the
   collision curve: the fewest with the wanted recall at the similarity two slips leave.
3. Candidates are accepted by a threshold on the Monge-Elkan similarity of their tokens (stem and
   trade, as spellings of one name break its words differently), then clustered by star clustering
   around the most frequent spelling. Two slips or more link two stems only where neither has a
   nearer neighbour more frequent than both.
4. People are linked the same way inside their organisation, by the similarity of family and
   first name; the family names must be alike and the first names must agree.

Defined results: null, empty and placeholder names are in no pair, and neither are the
contacts beside them; repeated rows share a form and are paired; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.matching import (
    band_keys,
    candidate_pairs,
    digest,
    edit_distance,
    edit_distances,
    edit_similarities,
    may_be_similar,
    monge_elkan,
    nearest,
    pairs_within,
    star_clusters,
    tune_bands,
)
from billweave.runtime import materialize

# Branches of trade with their abbreviations.
TRADES = {
    "academy": "acad", "acoustics": "acoust", "aviation": "avia", "bakery": "bkry", "brewing": "brew", "catering": "cat'g",
    "ceramics": "ceram", "chemicals": "chem", "consulting": "cons", "cosmetics": "cosm", "dairy": "dry",
    "electronics": "electr", "energy": "enrgy", "engineering": "eng'g", "fisheries": "fish", "foods": "fds",
    "forestry": "forst", "furniture": "furn", "garments": "garm", "glassworks": "glassw", "holding": "hldg",
    "horticulture": "hort", "hospitality": "hosp", "instruments": "instr", "insurance": "ins", "jewellery": "jewel",
    "lighting": "light'g", "logistics": "log", "machinery": "mach", "mining": "min", "optics": "opt",
    "packaging": "pack'g", "pharma": "phrm", "plumbing": "plumb", "printing": "prtg", "publishing": "publ",
    "real estate": "r e", "recycling": "recyc", "retail": "ret", "roofing": "roof'g", "ropeworks": "ropewks",
    "security": "secur", "software": "softw", "sports": "sprts", "textiles": "txtls", "tooling": "tool'g", "toys": "tys",
    "trading": "trdg", "transport": "transp", "upholstery": "uphol", "ventilation": "vent", "ventures": "ventrs",
}
# Legal forms, as they are left when dots are gone.
LEGAL = (
    "gmbh & co kg", "gmbh und co kg", "gmbh and co kg", "gmbh&co kg", "gmbh&cokg", "gmbh & cokg", "gmbh und cokg", "ges mbh",
    "gesmbh", "gmbh", "g m b h", "ag", "a g", "aktiengesellschaft", "kg", "ltd", "limited", "llc", "l l c", "inc", "incorporated",
    "corp", "corporation", "sa", "s a", "co", "plc", "ohg", "ug", "bv", "oy", "ab",
)
# Departments and offices that may follow or lead a name.
OFFICES = (
    "purchasing", "einkauf", "head office", "accounts payable", "zentrale", "hauptverwaltung", "finance", "buchhaltung",
    "accounting", "procurement", "headquarters", "billing", "rechnungspruefung", "main office", "branch office",
)
# Entries that name nobody.
PLACEHOLDERS = {
    "walk in", "n a", "na", "same as ship to", "same as bill to", "same as above", "blank", "", "unknown", "none", "null", "tbd",
    "customer", "cash customer", "walk in customer", "see above", "not available", "x", "xxx", "test", "unbekannt",
}
# First names with their short forms.
NICKNAMES = {
    "alexander": ("alex", "sascha"), "anthony": ("tony",), "benjamin": ("ben", "benny"), "charlotte": ("charlie", "lotte"),
    "dorothea": ("dora", "thea"), "elizabeth": ("liz", "beth"), "friedrich": ("fritz", "fred"), "gabriele": ("gabi",),
    "isabella": ("isa", "bella"), "johannes": ("hannes", "jo"), "josephine": ("josie", "fina"), "katherine": ("kate", "kathy"),
    "leonard": ("leo", "len"), "margaret": ("maggie", "peg"), "michael": ("mike", "mick"), "nicolas": ("nico", "nick"),
    "patricia": ("pat", "trish"), "richard": ("rick", "dick"), "robert": ("bob", "rob"), "samuel": ("sam", "sammy"),
    "susanne": ("susi", "sanne"), "theodor": ("theo", "teddy"), "victoria": ("vicky", "tori"), "william": ("bill", "will"),
}
TITLES = {"dr", "prof", "mr", "mrs", "ms", "herr", "frau", "mag", "ing", "dipl", "attn", "att", "zhd", "z", "hd", "zh", "h"}

_CAMEL = re.compile(r"(?<=[a-zäöüß])(?=[A-ZÄÖÜ])")
_LEGAL = re.compile(r"(?:^|\s)(?:" + "|".join(re.escape(x) for x in sorted(LEGAL, key=len, reverse=True)) + r")(?=\s|$)")
_OFFICE = re.compile(r"(?:^|\s)(?:" + "|".join(OFFICES) + r")(?=\s|$)")
_TRADE_WORDS = {w.replace("'", ""): t for t, short in TRADES.items() for w in (t, short)}
_LONG_TRADES = {w: t for w, t in _TRADE_WORDS.items() if len(w) >= 4}
_ENDINGS = sorted(((w, t) for w, t in _TRADE_WORDS.items() if len(w) >= 3), key=lambda x: (-len(x[0]), x))
_FIRST = {n: full for full, short in NICKNAMES.items() for n in (full, *short)}
_LONG_FIRST = {n: f for n, f in _FIRST.items() if len(n) >= 5}

#: Two slips in a stem of eight letters leave about this share of its padded q-grams, seldom less.
SLIP_SIMILARITY = 0.3
RECALL = 0.98
ROWS = 2
#: Two slips in a family name of six letters leave about this share; inside an organisation one row is enough.
PERSON_SIMILARITY = 0.25
PERSON_BANDS = tune_bands(PERSON_SIMILARITY, 1, RECALL)
#: Least Monge-Elkan similarity of two spellings: the trade alike and three quarters of the stem's letters.
ORGANISATION_THRESHOLD = 0.875
STEM_SIMILARITY = 2 * ORGANISATION_THRESHOLD - 1
#: The same of people, and the least similarity of their family names alone.
PERSON_THRESHOLD = 0.75
FAMILY_SIMILARITY = 2 / 3
#: Least similarity of two full first names of one person.
FIRST_SIMILARITY = 0.8
#: A last word behind this many different stems is a branch of trade.
LEARNED_STEMS = 20


def _plain(text: str) -> str:
    text = re.sub(r"(?:G|\b)mbH", lambda m: f" {m[0].lower()} ", text)
    text = unicodedata.normalize("NFKC", _CAMEL.sub(" ", text)).lower().replace("'", "").replace("’", "")
    text = re.sub(r"[^\w&]+", " ", text.replace("_", " ").replace("&", " & "))
    return re.sub(r"\s+", " ", text).strip()


def read_organisation(name: str | None) -> tuple[str, str, list[str]] | None:
    """(stem, trade, words where no trade is seen) of a name; None for a placeholder."""
    text = _plain(name or "")
    if text in PLACEHOLDERS:
        return None
    text = _OFFICE.sub(" ", f" {text} ")
    for _ in range(2):
        text = _LEGAL.sub(" ", text)
    words = re.sub(r"^\s*(?:the|firma|fa)\s", " ", text).replace("&", " ").split()
    if not words:
        words = _plain(name or "").split()
    for i in range(len(words) - 1 if len(words) > 2 else 0):
        pair = words[i] + words[i + 1]
        if pair == "re" or (len(pair) > 7 and edit_distance(pair, "realestate", 2) <= 2):
            return "".join(words[:i] + words[i + 2 :]), "real estate", []
    trade, at = "", -1
    order = [len(words) - 1, *range(len(words) - 1)] if len(words) > 1 else []
    for i in order:
        if words[i] in _TRADE_WORDS:
            trade, at = _TRADE_WORDS[words[i]], i
            break
    if at < 0:
        for most in (1, 2):
            for i in order:
                if len(words[i]) >= (4 if most == 1 else 7):
                    found = nearest(words[i], _LONG_TRADES, most)
                    if found:
                        trade, at = found, i
                        break
            if at >= 0:
                break
    if at >= 0:
        return "".join(words[:at] + words[at + 1 :]), trade, []
    joined = "".join(words)
    for word, kind in _ENDINGS:
        if joined.endswith(word) and len(joined) - len(word) >= 5:
            return joined[: -len(word)], kind, []
        if joined.startswith(word) and len(word) >= 5 and len(joined) - len(word) >= 5:
            return joined[len(word) :], kind, []
    for word, kind in _ENDINGS:
        if len(word) >= 5:
            for n in (len(word), len(word) + 1, len(word) - 1):
                if len(joined) - n >= 5 and edit_distance(joined[-n:], word, 1) <= 1:
                    return joined[:-n], kind, []
    return joined, "", words


def read_person(contact: str | None) -> tuple[str, str, str] | None:
    """(family name, first name or its initial, middle initial) of a contact; None if unusable."""
    text = unicodedata.normalize("NFKC", _CAMEL.sub(" ", contact or "")).lower()
    text = re.sub(r"\b(?:z\.?\s*hd?\.?|attn\.?|att\.?|c/o)\s*:?\s+", " ", text)
    comma = "," in text
    head = len(re.findall(r"\w+", text.split(",")[0])) if comma else 0
    words = [w for w in re.findall(r"[^\W\d_]+", text)]
    if _plain(contact or "") in PLACEHOLDERS or not words:
        return None
    kept = [w for i, w in enumerate(words) if w not in TITLES or (len(w) == 1 and w in "zh")]
    if comma:
        lead = [w for w in re.findall(r"[^\W\d_]+", text.split(",")[0]) if w not in TITLES]
        rest = kept[len(lead) :]
        if lead and rest:
            kept = rest + lead
    if not kept:
        return None
    long = [w for w in kept if len(w) > 1]
    short = [w for w in kept if len(w) == 1]
    if not long:
        return None
    if len(long) == 1:
        return long[0], short[0] if short else "", short[1] if len(short) > 1 else ""
    first = [w for w in long if w in _FIRST]
    if not first:
        first = [w for w in long[:-1] if nearest(w, _LONG_FIRST, 1)] or [w for w in long if nearest(w, _LONG_FIRST, 1)]
    if not first:
        first = [w for w in long if nearest(w, _LONG_FIRST, 2)]
    given = first[0] if first else long[0]
    rest = list(long)
    rest.remove(given)
    full = _FIRST.get(given) or nearest(given, _LONG_FIRST, 1) or nearest(given, _LONG_FIRST, 2) or given
    return "".join(rest), full, short[0] if short else ""


def _read_organisations(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_organisation(x) or (None, None, None) for x in values], columns=["stem", "trade", "words"])


def _read_people(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_person(x) or (None,) * 3 for x in values], columns=["family", "first", "middle"])


def with_learned_trades(read: DataFrame) -> DataFrame:
    """``read`` with the trade of names whose last word stands behind many different stems."""
    several = (F.col("trade") == "") & (F.size("words") > 1)
    last = F.when(several, F.element_at("words", -1))
    head = F.when(several, F.array_join(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), ""))
    read = read.withColumns({"last": last, "head": head})
    counted = read.filter(F.col("last").isNotNull()).groupBy("last", "head").count().groupBy("last").agg(F.count(F.lit(1)).alias("stems"))
    learned = counted.filter(F.col("stems") >= LEARNED_STEMS).select("last", F.lit(True).alias("is_trade"))
    read = read.join(learned, "last", "left")
    stem, trade = (F.when(F.col("is_trade"), F.col(c)).otherwise(F.col(o)) for c, o in (("head", "stem"), ("last", "trade")))
    return read.withColumns({"stem": stem, "trade": trade}).drop("last", "head", "words", "is_trade")


def _verify_organisations(left: pd.DataFrame, right: pd.DataFrame) -> pd.Series:
    score = monge_elkan(left[["stem", "trade"]].values.tolist(), right[["stem", "trade"]].values.tolist())
    good = (score >= ORGANISATION_THRESHOLD - 1e-9) & (left["trade"].to_numpy() == right["trade"].to_numpy())
    return pd.Series(np.where(good, score, 0.0))


def _slip_counts(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(edit_distances(list(a), list(b)))


def _unless_nearer(edges: DataFrame, forms: DataFrame) -> DataFrame:
    """``edges`` without those of two slips where an end has a nearer neighbour more frequent than both."""
    weights = forms.select("id", "weight")
    for x in "ab":
        edges = edges.join(weights.select(F.col("id").alias(f"id_{x}"), F.col("weight").alias(f"weight_{x}")), f"id_{x}")
    edges = materialize(edges.withColumn("slips", F.pandas_udf(_slip_counts, "bigint")("stem_a", "stem_b")))
    one = edges.filter(F.col("slips") < 2)
    both = [one.select(F.col(f"id_{x}").alias("id"), F.col(f"weight_{y}").alias("nearer")) for x, y in ("ab", "ba")]
    nearest_of = both[0].unionByName(both[1]).groupBy("id").agg(F.max("nearer").alias("nearer"))
    for x in "ab":
        edges = edges.join(nearest_of.select(F.col("id").alias(f"id_{x}"), F.col("nearer").alias(f"nearer_{x}")), f"id_{x}", "left")
    # greatest skips nulls, so an end without a nearer neighbour does not count
    over = F.greatest("nearer_a", "nearer_b") > F.greatest("weight_a", "weight_b")
    return edges.filter((F.col("slips") < 2) | ~F.coalesce(over, F.lit(False)))


def first_names_agree(a: list[str], b: list[str]) -> np.ndarray:
    """Whether two first names, initials or missing ones can be one person's, of each pair."""
    like = edit_similarities(a, b) >= FIRST_SIMILARITY
    short = [not x or not y or ((len(x) == 1 or len(y) == 1) and x[0] == y[0]) for x, y in zip(a, b)]
    return like | np.array(short, dtype=bool)


def _verify_people(left: pd.DataFrame, right: pd.DataFrame) -> pd.Series:
    names = [side[["family", "first"]].values.tolist() for side in (left, right)]
    full = [len(a[1]) > 1 and len(b[1]) > 1 for a, b in zip(*names)]
    score = monge_elkan(*[[x if f else x[:1] for x, f in zip(side, full)] for side in names])
    family = edit_similarities(*[[x[0] for x in side] for side in names])
    good = first_names_agree(*[[x[1] for x in side] for side in names])
    good &= (score >= PERSON_THRESHOLD - 1e-9) & (family >= FAMILY_SIMILARITY - 1e-9)
    return pd.Series(np.where(good, score, 0.0))


def _clusters(forms: DataFrame, keys, fields: tuple[str, ...], near: str, least: float, verify, keep=None) -> DataFrame:
    pairs = candidate_pairs(forms, keys, *fields)
    pairs = pairs.filter(may_be_similar(F.col(f"{near}_a"), F.col(f"{near}_b"), least)).distinct()
    ends = [F.struct(*[F.col(f"{f}_{x}").alias(f) for f in fields]) for x in "ab"]
    edges = pairs.withColumn("score", F.pandas_udf(verify, "double")(*ends)).filter(F.col("score") > 0)
    edges = keep(edges, forms) if keep else edges
    return star_clusters(forms.select("id", "weight"), edges.select("id_a", "id_b", "score"))


def same_organisations(rows: DataFrame, key: str = "party_id", name: str = "name") -> DataFrame:
    """(key, organisation) of every row whose name names one."""
    rows = rows.select(F.col(key).alias("key"), F.col(name).alias("value")).filter(F.col("value").isNotNull())
    distinct = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    read = distinct.withColumn("p", F.pandas_udf(_read_organisations, "stem string, trade string, words array<string>")("value"))
    read = with_learned_trades(materialize(read.select("value", "n", "p.*").filter(F.col("stem").isNotNull())))
    read = materialize(read.withColumn("id", digest("stem", "trade")))
    forms = materialize(read.groupBy("id", "stem", "trade").agg(F.sum("n").alias("weight")))
    bands = tune_bands(SLIP_SIMILARITY, ROWS, RECALL)
    keys = band_keys(F.col("stem"), bands, ROWS, F.col("trade"))
    centers = _clusters(forms, keys, ("stem", "trade"), "stem", STEM_SIMILARITY, _verify_organisations, _unless_nearer)
    labels = read.select("value", "id").join(centers, "id").select("value", F.col("center").alias("organisation"))
    return rows.join(labels, "value").select(F.col("key").alias(key), "organisation")


def same_people(rows: DataFrame, organisations: DataFrame, key: str = "party_id", contact: str = "contact_name") -> DataFrame:
    """(key, person) of every row with an organisation and a usable contact."""
    contacts = rows.select(key, F.col(contact).alias("value")).filter(F.col("value").isNotNull())
    read = contacts.select("value").distinct()
    read = read.withColumn("p", F.pandas_udf(_read_people, "family string, first string, middle string")("value"))
    read = read.select("value", "p.*").filter(F.col("family").isNotNull())
    named = contacts.join(read, "value").join(organisations, key)
    fields = ("organisation", "family", "first")
    named = materialize(named.select(key, *fields).withColumn("id", digest(F.hex("organisation"), "family", "first")))
    # a full first name outranks an initial, which outranks a bare family name
    full = F.when(F.char_length("first") > 1, 1 << 40).when(F.col("first") != "", 1 << 20).otherwise(0)
    forms = materialize(named.groupBy("id", *fields).agg((F.count(F.lit(1)) + full).alias("weight")))
    keys = band_keys(F.col("family"), PERSON_BANDS, 1, F.col("organisation"))
    centers = _clusters(forms, keys, fields, "family", FAMILY_SIMILARITY, _verify_people)
    return named.join(centers, "id").select(key, F.col("center").alias("person"))


def party_pairs(rows: DataFrame, key: str = "party_id") -> DataFrame:
    """(field, key_a, key_b): same organisation by ``name``, same person in it by ``contact_name``."""
    organisations = materialize(same_organisations(rows, key))
    people = materialize(same_people(rows, organisations, key))
    by_name = pairs_within(organisations, "organisation", key).select(F.lit("name").alias("field"), f"{key}_a", f"{key}_b")
    by_person = pairs_within(people, "person", key).select(F.lit("contact_name").alias("field"), f"{key}_a", f"{key}_b")
    return by_name.unionByName(by_person)
